"""Sinks: what the engine hands on as files, in the forms that other tools read.

Files that Spark writes are committed by its own protocol. Files with names of their own are written under temporary
names and renamed by the tasks, so that a task that runs again does no harm.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.operators.merge import write_one_file_each
from stridemark.sources.logs import append
from stridemark.sources.store import at as _store


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; in local mode below the warehouse if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table of their own in the shared folder, for plans that read them in several branches."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def save_entries(log: str, entries: DataFrame, key: str, at: str) -> DataFrame:
    """Save entries (key, at, ...) into a log that several people write to; the entries as they now stand.

    A save only adds: nobody's save can undo another's, and no lock is needed. The latest entry of a key counts.
    """
    append(entries, log)
    now = entries.sparkSession.read.schema(entries.schema).json(log)
    now = now.select(*entries.columns)
    return now.groupBy(key).agg(F.max_by(F.struct(*now.columns), at).alias("r")).select("r.*")


def bib_export(published: DataFrame) -> DataFrame:
    """image_name and bib_numbers, joined by comma and space, of published photos (photo, numbers)."""
    return published.select(F.col("photo").alias("image_name"), F.array_join("numbers", ", ").alias("bib_numbers"))


def review_bundle(published: DataFrame, hits: DataFrame, least: float = 0.1) -> DataFrame:
    """photo, numbers, model_numbers and reviewed: what an import needs besides the bibs.

    hits: photo, text (normalised), conf. Distinct numbers of the model from a confidence on, sorted.
    """
    model = hits.filter((F.col("conf") >= least) & (F.col("text") != "")).groupBy("photo").agg(F.array_sort(F.collect_set("text")).alias("model_numbers"))
    return published.join(model, "photo", "left").select("photo", "numbers", F.coalesce("model_numbers", F.array().cast("array<string>")).alias("model_numbers"), "reviewed")


def write_export(published: DataFrame, hits: DataFrame, folder: str) -> DataFrame:
    """Write folder/bib_export (CSV) and folder/review_all (JSON lines); one row of counts."""
    bib_export(published).write.mode("overwrite").csv(f"{folder}/bib_export", header=True)
    review_bundle(published, hits).write.mode("overwrite").json(f"{folder}/review_all")
    return published.agg(F.count("*").alias("photos"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("auto"), F.count_if(F.size("numbers") > 0).alias("with_bibs"))


def write_galleries(payloads: DataFrame, stats: DataFrame, folder: str) -> DataFrame:
    """Write folder/bib/<bib>.json and folder/stats.json of one event; files of an earlier export go. One row of counts."""
    spark = payloads.sparkSession
    path, store = _store(spark, f"{folder}/bib")
    store.delete(path, True)
    written = write_one_file_each(payloads, f"{folder}/bib", "bib", "payload").agg(F.count("*").alias("runners"), F.sum("bytes").alias("bytes")).collect()
    one = stats.select(F.lit("stats").alias("name"), F.to_json(F.struct(F.lit(True).alias("ok"), *stats.columns)).alias("payload"))
    write_one_file_each(one.coalesce(1), folder, "name", "payload").collect()
    return spark.createDataFrame(written, "runners bigint, bytes bigint")


def upload(rows: DataFrame, done: DataFrame, key: str, factory: Callable[[], Callable[[dict], None]], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """key, tries and error of rows that a manifest (key, error) doesn't have as done; each is tried up to so often.

    ``factory`` makes, once a task, what sends one row. Errors are data, and the next run tries those rows again.
    """
    todo = rows.join(done.filter("error IS NULL").select(key), key, "left_anti")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = factory()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                for n in range(1, attempts + 1):
                    try:
                        one(row)
                        out.append((str(row[key]), n, None))
                        break
                    except Exception as e:
                        if n == attempts:
                            out.append((str(row[key]), n, f"{type(e).__name__}: {e}"))
                        else:
                            time.sleep(wait * n)
            yield pd.DataFrame(out, columns=[key, "tries", "error"])

    return todo.mapInPandas(send, f"{key} string, tries int, error string")


def write_mistakes(mistakes: DataFrame, folder: str) -> None:
    mistakes.write.mode("overwrite").csv(folder, header=True)


def write_results(results: DataFrame, folder: str) -> None:
    """Results by folder; folders that the rows don't have keep theirs."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(folder)


def write_named(rows: DataFrame, root: str, path: str = "path", data: str = "data") -> DataFrame:
    """Write each row's data (binary) to the path below the root; path and bytes of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, content in zip(b[path], b[data], strict=True):
                folder, _, last = f"{base}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{last}.{attempt}"
                with store.open_output_stream(temporary) as out:
                    out.write(bytes(content))
                if store.get_file_info(f"{folder}/{last}").is_file:
                    store.delete_file(f"{folder}/{last}")
                store.move(temporary, f"{folder}/{last}")
            yield pd.DataFrame({"path": b[path], "bytes": [len(x) for x in b[data]]})

    return rows.select(path, data).mapInPandas(write, "path string, bytes bigint")


def label_files(training: DataFrame, prefix: str = "photo_") -> DataFrame:
    """path and data of detector labels: labels/<split>/<prefix><number>.txt, a line a box, relative to the picture.

    training: photo, split, boxes, width, height; text, the given label of photos labelled by hand, or null.
    """
    from stridemark.functions.geometry import relative_box

    lines = F.transform("boxes", lambda b: F.concat(F.lit("0 "), relative_box(b, F.col("width"), F.col("height")), F.lit("\n")))
    text = F.coalesce("text", F.array_join(F.coalesce(lines, F.array().cast("array<string>")), ""))
    return training.select(F.concat(F.lit("labels/"), "split", F.lit(f"/{prefix}"), F.format_string("%04d", "photo"), F.lit(".txt")).alias("path"), F.encode(text, "UTF-8").alias("data"))


def crop_files(crops: DataFrame, only_legible: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path and data of each crop, the rows of labels.csv) of crops (key, image, text, source, original_height)."""
    rows = crops.filter(F.coalesce(F.trim("text") != "", F.lit(False))) if only_legible else crops
    name = F.concat("key", F.lit(".png"))
    return rows.select(F.concat(F.lit("crops/"), name).alias("path"), F.col("image").alias("data")), rows.select(name.alias("file"), F.coalesce("text", F.lit("")).alias("text"), "source", F.bround("original_height", 1).alias("original_height"))


def write_crops(crops: DataFrame, folder: str, only_legible: bool = True) -> int:
    """Write folder/crops/<key>.png and folder/labels.csv; the number of crops."""
    files, labels = crop_files(crops, only_legible)
    labels.write.mode("overwrite").csv(f"{folder}/labels.csv", header=True)
    return write_named(files, folder).count()


def set_old_aside(spark: SparkSession, folder: str, logs: list[str], ending: str = ".old") -> list[str]:
    """Before a new scan: rename the logs that it replaces, over those of the scan before; the names that were there.

    Other logs, such as the second reader's and people's reviews, stay where they are.
    """
    moved = []
    for name in logs:
        path, store = _store(spark, f"{folder}/{name}")
        if store.exists(path):
            old, _ = _store(spark, f"{folder}/{name}{ending}")
            store.delete(old, True)
            if not store.rename(path, old):
                raise OSError(f"{name} can't be renamed")
            moved.append(name)
    return moved
