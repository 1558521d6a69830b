"""Merges of tables kept as files. Files know no MERGE or DELETE: every operator returns the table's next version."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemark.sources import store


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("row")).select("row.*")


def latest_good(log: DataFrame, key: str, order: str, error: str = "error") -> DataFrame:
    """As latest, without keys whose last row is an error, even if they had a good one before."""
    return latest(log, key, order).filter(F.col(error).isNull())


def pending(jobs: DataFrame, log: DataFrame, key: str, order: str, error: str = "error") -> DataFrame:
    """Jobs that are not done, or failed last time."""
    return jobs.join(latest_good(log, key, order, error).select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows win; of columns that are null in every new row the old values stay.

    Of new rows with the same key the last by ``order`` counts, a column that the result hasn't; without an order they
    must be equal, or it is undefined which one does. There is one row a key either way.
    """
    values = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order) if order else F.struct(*values)).alias("__last")).select(*keys, "__last.*") if values else new.distinct()
    others = [c for c in old.columns if c not in keys]
    fresh = [c for c in others if c in new.columns]
    given = new.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in fresh]).first() if fresh else {}
    kept = [c for c in fresh if given[c]]
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept], F.lit(True).alias("__new"))
    rows = old.join(n, keys, "full_outer")
    return rows.select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in others])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows of the keys that the new rows have go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys; refuses if another number of parents would go than expected."""
    keys = gone.select(key).distinct()
    if expected is not None and (n := parents.join(keys, key, "left_semi").count()) != expected:
        raise ValueError(f"{n} rows would be deleted, not {expected}")
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def newest_wins(mine: DataFrame, theirs: DataFrame, key: str, at: str, known: DataFrame | None = None) -> DataFrame:
    """Rows of both; theirs only if mine is missing or strictly older. Unknown keys of theirs are left out."""
    theirs = theirs if known is None else theirs.join(known.select(key), key, "left_semi")
    columns = [c for c in mine.columns if c != key]
    a, b = mine.select(key, F.struct(*columns).alias("m")), theirs.select(key, F.struct(*columns).alias("t"))
    take = F.col("m").isNull() | (F.coalesce(F.col(f"t.{at}"), F.lit(0)) > F.coalesce(F.col(f"m.{at}"), F.lit(0)))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("t").isNotNull() & take, F.col("t")).otherwise(F.col("m")).alias("r")).select(key, "r.*")


def merge_counts(mine: DataFrame, theirs: DataFrame, key: str, at: str, known: DataFrame) -> DataFrame:
    """took, kept and unknown of a newest-wins merge."""
    rows = theirs.select(key, F.col(at).alias("t")).join(mine.select(key, F.col(at).alias("m"), F.lit(True).alias("mine")), key, "left").join(known.select(key, F.lit(True).alias("known")), key, "left")
    seen = F.col("known").isNotNull()
    took = F.col("mine").isNull() | (F.coalesce("t", F.lit(0)) > F.coalesce("m", F.lit(0)))
    return rows.agg(F.count_if(seen & took).alias("took"), F.count_if(seen & ~took).alias("kept"), F.count_if(~seen).alias("unknown"))


def missing_only(defs: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Get or create: the definitions that don't exist yet."""
    return defs.join(existing.select(*keys), keys, "left_anti")


def renamed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Keys taken through a map of (old, new); others stay."""
    return rows.join(names, rows[key] == names["old"], "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def swap(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries where there are any, old ones otherwise."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_kept(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Rows with ``copy_of``, the first row in order with equal content, null for that one.

    Only the hash and the order travel; the hash keeps wide contents out of the shuffle.
    """
    digest = F.sha1(F.col(content).cast("binary"))
    keyed = rows.withColumn("__h", digest)
    firsts = keyed.filter(F.col(content).isNotNull()).groupBy("__h").agg(F.min(F.struct(*order)).alias("__first"))
    return keyed.join(firsts, "__h", "left").withColumn("copy_of", F.when(F.struct(*order) != F.col("__first"), F.col(f"__first.{order[-1]}"))).drop("__h", "__first")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def last_of(rows: DataFrame, key: str, order: Column) -> DataFrame:
    n = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("__n", F.row_number().over(n)).filter("__n = 1").drop("__n")


def matched_or_fail(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows joined to their ids; fails if any has none."""
    lost = rows.join(ids, key, "left_anti").select(key).limit(5).collect()
    if lost:
        raise ValueError(f"no id for {[r[0] for r in lost]}")
    return rows.join(ids, key)


def set_aside(rows: DataFrame, empty: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside); a union of both undoes it."""
    flag = F.coalesce(empty, F.lit(False))
    return rows.filter(~flag), rows.filter(flag)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a table, oldest first."""
    return [int(n) for n in store.names(spark, f"{folder}/_versions") if n.isdigit()]


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a version of a table. Its pointer is written last, and by one writer only: another one fails."""
    path = f"{folder}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not store.put_if_absent(df.sparkSession, f"{folder}/_versions/{version:012d}", path.rsplit("/", 1)[1]):
        store.delete(df.sparkSession, path)
        raise FileExistsError(f"version {version} was written by another writer")
    return path


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The current or an earlier version."""
    version = versions(spark, folder)[-1] if version is None else version
    return spark.read.parquet(f"{folder}/{store.read_text(spark, f'{folder}/_versions/{version:012d}')}")


def change_version(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 10) -> int:
    """Write what ``change`` makes of the current version (None: there is none) as the next one; its number.

    Of writers that begin with the same version one succeeds, and the others make their change again, of what that one
    has written, so that no change is lost.
    """
    for _ in range(attempts):
        known = versions(spark, folder)
        try:
            write_version(change(read_version(spark, folder, known[-1]) if known else None), folder, number := (known or [0])[-1] + 1)
            return number
        except FileExistsError:
            continue
    raise RuntimeError(f"{folder}: others have written a version before this one {attempts} times")


def write_one_file_each(rows: DataFrame, folder: str, key: str, payload: str) -> DataFrame:
    """One JSON file a key, named by it, under the folder; (key, bytes) of each. Tasks write and rename, so reruns are safe."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            sizes = []
            for k, p in zip(b[key], b[payload], strict=True):
                data, temporary = p.encode(), f"{root}/_{k}.{attempt}"
                with store.open_output_stream(temporary) as out:
                    out.write(data)
                final = f"{root}/{k}.json"
                if store.get_file_info(final).is_file:  # some stores refuse a name that an earlier run has taken
                    store.delete_file(final)
                store.move(temporary, final)
                sizes.append(len(data))
            yield pd.DataFrame({"key": b[key], "bytes": sizes})

    return rows.select(F.col(key).cast("string").alias(key), payload).mapInPandas(write, "key string, bytes bigint")
