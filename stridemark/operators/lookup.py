"""Questions at the cost of a question: which texts and photos concern the runners that are asked for.

A question's texts are found first, then the photos that hold one of them, and only those photos' reads are windowed
and joined. What is found is handed on as small tables, whose size is checked before: above ``FEW`` rows the caller
goes the ordinary way, by a shuffle. No read of another photo is shuffled.

``write_reads`` keeps the reads in three orders, so that a question also scans little: by photo, by text, and by the
keys under which texts within one edit meet. Parquet's statistics then leave out the row groups that can't match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.functions.text import one_deletions, similarity, within_one_edit

CONFIRMED = ("review", "manual")
#: So many rows at most are handed to tasks as a table of their own, and so many values as a list in a filter.
FEW, LISTED = 100_000, 1_000


def is_confirmed(source: str = "source") -> Column:
    return F.col(source).isin(*CONFIRMED)


def counts_nearly(least: float) -> Column:
    """Reads that may match a bib within one edit."""
    return ~is_confirmed() & (F.col("source") != "rejected") & (F.col("confidence") >= least)


def likeness(bib: Column, text: Column) -> Column:
    return F.greatest(similarity(text, bib), F.lit(0.2))


def few(rows: DataFrame, most: int = FEW) -> DataFrame | None:
    """The rows as a table at hand, to be broadcast, if there are so many at most; else None."""
    found = rows.limit(most + 1).toArrow()
    return None if found.num_rows > most else rows.sparkSession.createDataFrame(found, rows.schema)


def among(rows: DataFrame, key: str, small: DataFrame) -> DataFrame:
    """The rows whose key a table at hand has. A short one is a list too, by which files and row groups are left out."""
    values = [r[0] for r in small.select(key).distinct().limit(LISTED + 1).collect()]
    if len(values) <= LISTED:
        rows = rows.filter(F.col(key).isin(values))
    return rows.join(F.broadcast(small.select(key).distinct()), key, "left_semi")


@dataclass
class Reads:
    """Reads as questions go through them. keys (k, bib_text, best) may be missing; they are then made on the way."""

    by_photo: DataFrame
    by_text: DataFrame
    keys: DataFrame | None = None

    @staticmethod
    def of(detections: DataFrame | Reads) -> Reads:
        return detections if isinstance(detections, Reads) else Reads(detections, detections)

    def near_keys(self, least: float) -> DataFrame:
        if self.keys is not None:
            return self.keys.filter(F.col("best") >= least).select("k", "bib_text")
        return self.by_text.filter(counts_nearly(least)).select(F.explode(one_deletions(F.col("bib_text"))).alias("k"), "bib_text")


def write_reads(detections: DataFrame, folder: str, block_bytes: int = 16 << 20) -> None:
    """Keep the reads below the folder by photo, by text, and the keys of the texts that may match nearly."""

    def put(rows: DataFrame, key: str, name: str) -> None:
        ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
        ranged.write.mode("overwrite").option("parquet.block.size", block_bytes).option("parquet.page.size", min(block_bytes, 1 << 20)).parquet(f"{folder}/{name}")

    put(detections, "photo_id", "by_photo")
    put(detections, "bib_text", "by_text")
    texts = detections.filter(~is_confirmed() & (F.col("source") != "rejected")).groupBy("bib_text").agg(F.max("confidence").alias("best"))
    put(texts.select(F.explode(one_deletions(F.col("bib_text"))).alias("k"), "bib_text", "best"), "k", "keys")


def read_reads(spark: SparkSession, folder: str) -> Reads:
    return Reads(*[spark.read.parquet(f"{folder}/{name}") for name in ("by_photo", "by_text", "keys")])


def asked_texts(runners: DataFrame, reads: Reads, asked: DataFrame, least: float) -> DataFrame | None:
    """event_id, bib, bib_text, exact and like: the texts that count for the bibs of a table at hand; None if too many."""
    keys = asked.filter(F.length("bib") >= 3).select("event_id", "bib", F.explode(one_deletions(F.col("bib"))).alias("k"))
    near = among(reads.near_keys(least), "k", keys).join(F.broadcast(keys), "k")
    near = few(near.filter(within_one_edit(F.col("bib"), F.col("bib_text")) & (F.col("bib") != F.col("bib_text"))).select("event_id", "bib", "bib_text").distinct())
    if near is None:
        return None
    bibs = runners.select("event_id", F.col("bib").alias("bib_text"))
    someone = bibs.join(F.broadcast(near.select("event_id", "bib_text").distinct()), ["event_id", "bib_text"], "left_semi").distinct()
    fuzzy = near.join(someone, ["event_id", "bib_text"], "left_anti").select("event_id", "bib", "bib_text", F.lit(False).alias("exact"), likeness(F.col("bib"), F.col("bib_text")).alias("like"))
    exact = asked.select("event_id", "bib", F.col("bib").alias("bib_text"), F.lit(True).alias("exact"), F.lit(1.0).alias("like"))
    return few(exact.unionByName(fuzzy))


def concerned(runners: DataFrame, photos: DataFrame, detections: DataFrame | Reads, only: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Texts, and the photos and all their reads that hold one of them, for (event_id, bib) asked; None if too many."""
    reads = Reads.of(detections)
    asked = few(only.select("event_id", "bib").distinct())
    asked = None if asked is None else few(runners.select("event_id", "bib").join(F.broadcast(asked), ["event_id", "bib"], "left_semi").distinct())
    texts = None if asked is None else asked_texts(runners, reads, asked, least)
    held = None if texts is None else few(among(reads.by_text, "bib_text", texts).select("photo_id").distinct())
    if held is None:
        return None
    return texts, among(photos, "photo_id", held), among(reads.by_photo, "photo_id", held)
