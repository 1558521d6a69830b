"""Galleries kept up to date: a change of reads, photos or runners remakes the payloads of the bibs that it concerns.

A photo is in a bib's gallery by a text that is the bib, or within one edit of it and nobody's bib. So a changed photo
concerns the bibs that its texts, before and after, are or are near to; and a runner who comes or goes concerns, besides
the own bib, those near to it, whose near texts it takes away or gives back. Both are equality joins of the few changed
texts with the runners' bibs. All else stays as it is, in the table as in the files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.functions.text import one_deletions, within_one_edit
from stridemark.operators import matching
from stridemark.operators.lookup import counts_nearly, few
from stridemark.operators.merge import read_version, replace_by_key, versions, write_one_file_each, write_version

KEY = ["event_id", "bib"]


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows, as a multiset, aren't the same in both tables."""
    values = sorted(c for c in before.columns if c not in keys)
    rows = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*values) if values else F.lit(1))).alias(name))
    both = rows(before, "was").join(rows(after, "now"), keys, "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys)


@dataclass
class Tables:
    """An event's tables at one time."""

    runners: DataFrame
    races: DataFrame
    photos: DataFrame
    detections: DataFrame


def _texts_of(tables: Tables, photos: DataFrame, least: float) -> DataFrame:
    """event_id, bib_text and nearly (it may match within one edit) of the photos' reads that aren't rejected."""
    reads = tables.detections.join(photos, "photo_id", "left_semi").filter("source <> 'rejected'")
    reads = reads.join(tables.photos.select("photo_id", "event_id"), "photo_id")
    return reads.groupBy("event_id", "bib_text").agg(F.max(F.coalesce(counts_nearly(least), F.lit(False))).alias("nearly"))


def _near(texts: DataFrame, bibs: DataFrame) -> DataFrame:
    """event_id and bib of bibs of three characters or more that a text of their event is within one edit of."""
    x = texts.select("event_id", "bib_text", F.explode(one_deletions(F.col("bib_text"))).alias("k"))
    y = bibs.filter(F.length("bib") >= 3).select("event_id", "bib", F.explode(one_deletions(F.col("bib"))).alias("k"))
    return x.join(y, ["event_id", "k"]).filter((F.col("bib") != F.col("bib_text")) & within_one_edit(F.col("bib"), F.col("bib_text"))).select(*KEY)


def concerned(before: Tables, after: Tables, photos: DataFrame | None = None, least: float = 0.30) -> DataFrame:
    """event_id and bib, of runners before or after, whose payload the change may alter.

    photos (photo_id): those that have changed, with their reads; by comparison of the tables if not given.
    """
    if photos is None:
        photos = changed_keys(before.photos, after.photos, ["photo_id"]).union(changed_keys(before.detections, after.detections, ["photo_id"])).distinct()
    bibs = before.runners.select(*KEY).union(after.runners.select(*KEY)).distinct()
    texts = _texts_of(before, photos, least).unionByName(_texts_of(after, photos, least)).groupBy("event_id", "bib_text").agg(F.max("nearly").alias("nearly"))
    always = before.runners.select(*KEY).distinct().intersect(after.runners.select(*KEY).distinct()).select("event_id", F.col("bib").alias("bib_text"))
    by_photo = bibs.join(texts.select("event_id", F.col("bib_text").alias("bib")), KEY, "left_semi").union(_near(texts.filter("nearly").join(always, ["event_id", "bib_text"], "left_anti"), bibs))
    details = changed_keys(before.runners, after.runners, KEY)
    race = changed_keys(before.races, after.races, ["race_id"])
    of_race = before.runners.select(*KEY, "race_id").union(after.runners.select(*KEY, "race_id")).join(race, "race_id", "left_semi").select(*KEY)
    who = lambda a, b: a.runners.select(*KEY).join(b.runners.select(*KEY), KEY, "left_anti")
    came_or_went = who(before, after).union(who(after, before)).distinct()
    beside = _near(came_or_went.select("event_id", F.col("bib").alias("bib_text")), bibs)
    return by_photo.union(details).union(of_race).union(beside).distinct()


def kept(payloads: DataFrame, bibs: DataFrame) -> DataFrame:
    """The payloads of other bibs. These long rows are shuffled only if neither the bibs nor the others' keys are few."""
    some = few(bibs)
    if some is not None:
        return payloads.join(F.broadcast(some), KEY, "left_anti")
    rest = few(payloads.select(*KEY).join(bibs, KEY, "left_anti"))
    if rest is None:
        return payloads.join(bibs, KEY, "left_anti")
    mine = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
    return payloads.join(F.broadcast(rest.select(*[F.col(k).alias(f"__{k}") for k in KEY])), mine, "left_semi")


def refresh(payloads: DataFrame, after: Tables, bibs: DataFrame, use_chip_time: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all payloads, those remade, event_id and bib of those gone) of the table (event_id, bib, payload).

    Columns besides these are null in payloads that are remade.
    """
    remade = matching.export(after.runners, after.races, after.photos, after.detections, use_chip_time, only=bibs)
    gone = payloads.select(*KEY).join(bibs, KEY, "left_semi").join(after.runners.select(*KEY), KEY, "left_anti")
    return kept(payloads, bibs).unionByName(remade, allowMissingColumns=True), remade, gone


def write_changed(remade: DataFrame, gone: DataFrame, folder: str) -> DataFrame:
    """Write folder/bib/<bib>.json of one event's remade payloads, remove those gone; other files stay. One row of counts."""

    def remove(batches):
        import pandas as pd
        from pyarrow import fs

        on, root = fs.FileSystem.from_uri(f"{folder}/bib")
        for b in batches:
            for bib in b["bib"]:
                if on.get_file_info(f"{root}/{bib}.json").type == fs.FileType.File:
                    on.delete_file(f"{root}/{bib}.json")
            yield pd.DataFrame({"n": [len(b)]})

    written = write_one_file_each(remade, f"{folder}/bib", "bib", "payload").agg(F.count("*").alias("runners"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    removed = gone.select("bib").mapInPandas(remove, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))
    return remade.sparkSession.createDataFrame([(*written.first(), removed.first()[0])], "runners bigint, bytes bigint, removed bigint")


class Galleries:
    """Reads and payloads as tables with versions, which imports of reads and changes of start lists take forward.

    A batch that is imported again changes nothing: all reads of its photos are replaced. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: Tables) -> None:
        self.spark, self.folder, self.tables = spark, folder, tables
        if not versions(spark, f"{folder}/reads"):
            write_version(tables.detections, f"{folder}/reads", 1)
        if not versions(spark, f"{folder}/payloads"):
            now = self._now()
            write_version(matching.export(now.runners, now.races, now.photos, now.detections), f"{folder}/payloads", 1)

    def _now(self, **changed: DataFrame) -> Tables:
        t = self.tables
        return Tables(**{"runners": t.runners, "races": t.races, "photos": t.photos, "detections": read_version(self.spark, f"{self.folder}/reads")} | changed)

    def payloads(self) -> DataFrame:
        return read_version(self.spark, f"{self.folder}/payloads")

    def _take(self, before: Tables, after: Tables, photos: DataFrame | None, out: str | None) -> int:
        """Write the payloads after the change, and files of those remade; the number of bibs concerned."""
        bibs = concerned(before, after, photos)
        path = f"{self.folder}/concerned-{len(versions(self.spark, f'{self.folder}/payloads')) + 1:012d}"
        bibs.write.mode("overwrite").parquet(path)
        bibs = self.spark.read.parquet(path)
        every, remade, gone = refresh(self.payloads(), after, bibs)
        write_version(every, f"{self.folder}/payloads", versions(self.spark, f"{self.folder}/payloads")[-1] + 1)
        if out:
            write_changed(self.payloads().join(bibs, KEY, "left_semi"), gone, out).collect()
        return bibs.count()

    def import_reads(self, new: DataFrame, out: str | None = None) -> int:
        """Replace all reads of the photos that the new reads are of; the number of bibs concerned."""
        before = self._now()
        photos = new.select("photo_id").distinct()
        number = versions(self.spark, f"{self.folder}/reads")[-1] + 1
        write_version(replace_by_key(before.detections, new.select(*before.detections.columns), "photo_id"), f"{self.folder}/reads", number)
        return self._take(before, self._now(), photos, out)

    def change_runners(self, runners: DataFrame, out: str | None = None) -> int:
        """Take over another start list; the number of bibs concerned."""
        before, after = self._now(), self._now(runners=runners)
        n = self._take(before, after, before.photos.select("photo_id").limit(0), out)
        self.tables = Tables(runners, self.tables.races, self.tables.photos, self.tables.detections)
        return n

    def follow(self, reads: DataFrame, checkpoint: str, out: str | None = None, done: Callable[[int, int], None] | None = None):
        """Import a stream of reads batch by batch until nothing is new; done gets each batch's number and bibs concerned."""

        def step(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                n = self.import_reads(batch, out)
                if done:
                    done(number, n)

        return reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
