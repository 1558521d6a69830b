"""Which photos, reads and rows a step works on: filters, samples, matches by shared names, training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemark.functions.geometry import iou
from stridemark.functions.text import natural_key
from stridemark.operators.windows import split_by_blocks, stratified


def legible(text: Column) -> Column:
    """An annotated box whose text is given."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def confident(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("conf") >= least)


def photos_of_run(photos: DataFrame, folders: list[str] | None = None, reviews: DataFrame | None = None, limit: int | None = None, seed: int = 7) -> DataFrame:
    """The photos (folder, name) of a run: of the named folders, of those with a review, and so many at most.

    With reviews and a limit they are a sample that is spread over the folders and is the same every time; with a limit
    alone they are the first in order of folder and name.
    """
    rows = photos if folders is None else photos.filter(F.col("folder").isin(folders))
    rows = rows if reviews is None else rows.join(reviews.select("folder", "name").distinct(), ["folder", "name"], "left_semi")
    if limit is None:
        return rows
    return rows.orderBy("folder", "name").limit(limit) if reviews is None else stratified(rows, "folder", "name", limit, seed)


def to_recheck(doubts: DataFrame, done: DataFrame, reviews: DataFrame, evaluate: bool = False) -> DataFrame:
    """Doubtful photos that no earlier re-check has settled and that nobody has reviewed; to evaluate, those somebody has.

    done: photo, error, the latest re-check of each photo.
    """
    settled = done.filter(F.coalesce("error", F.lit("")) == "").select("photo")
    return doubts.join(settled, "photo", "left_anti").join(reviews.select("photo").distinct(), "photo", "left_semi" if evaluate else "left_anti")


def to_pack(photos: DataFrame, suggested: DataFrame, reviews: DataFrame, which: str = "needed") -> DataFrame:
    """photo, numbers, needs_human and reviewed of what goes to a reviewer.

    which: all; unreviewed, those that nobody looked at; needed, of these the ones that need a person. Folders without
    any suggestion haven't been scanned and are left out.
    """
    known = photos.join(suggested.withColumnRenamed("needs_human", "__need"), "photo", "left").join(reviews.select("photo", F.lit(True).alias("__seen")).distinct(), "photo", "left")
    scanned = F.max(F.col("__need").isNotNull()).over(Window.partitionBy("folder"))
    rows = known.withColumn("__scanned", scanned).filter("__scanned")
    seen, need = F.coalesce("__seen", F.lit(False)), F.coalesce("__need", F.lit(0)) > 0
    kept = {"all": F.lit(True), "unreviewed": ~seen, "needed": need & ~seen}[which]
    return rows.filter(kept).select("folder", "photo", F.coalesce("numbers", F.array().cast("array<string>")).alias("numbers"), F.coalesce("__need", F.lit(0)).cast("bigint").alias("needs_human"), seen.alias("reviewed"))


def in_review_order(suggested: DataFrame, name: Column, only_needed: bool = False) -> DataFrame:
    """Rows with ``place`` by folder: most disagreements first, then most boxes that need a person, then by name.

    The window is by folder, which is what one person goes through.
    """
    rows = suggested.filter("needs_human > 0") if only_needed else suggested
    disagree = F.size(F.filter("persons", lambda x: x["verdict"] == "disagree"))
    order = Window.partitionBy("folder").orderBy(disagree.desc(), F.desc("needs_human"), natural_key(name))
    return rows.withColumn("place", F.row_number().over(order))


def other_candidates(reads: Column, second: Column, chosen: Column, most: int = 12, least: float = 0.1) -> Column:
    """What a reviewer may pick besides the chosen numbers: the model's by confidence, then the second reader's, sorted."""
    by_conf = F.array_sort(F.transform(reads, lambda r: F.struct((-r["conf"]).alias("c"), r["text"].alias("t"), r["conf"].alias("conf"))))
    own = F.transform(F.filter(by_conf, lambda r: (r["conf"] >= least) | F.array_contains(second, r["t"])), lambda r: r["t"])
    return F.slice(F.array_except(F.concat(own, F.array_sort(second)), chosen), 1, most)


def batch_of(names: DataFrame, photos: DataFrame) -> DataFrame:
    """The folder that shares the most names with a reviewer's file, and how many; the first by name of equal ones.

    names: name. photos: folder, name. Without a shared name it is the first folder.
    """
    shared = photos.select("folder", "name").distinct().join(names.select("name", F.lit(1).alias("__one")).distinct(), "name", "left")
    counted = shared.groupBy("folder").agg(F.coalesce(F.sum("__one"), F.lit(0)).alias("shared"))
    return counted.orderBy(F.desc("shared"), "folder").limit(1)


def still_live(files: DataFrame, live: DataFrame, key: str = "file_name") -> DataFrame:
    """A refresh redoes what is published already, and nothing else."""
    return files.join(live.select(key).distinct(), key, "left_semi")


def refuse_broken(rows: DataFrame, needed: list[str], name: str = "file_name") -> DataFrame:
    """The rows, unless one of them lacks what it needs: then nothing may be written."""
    broken = rows.filter(~F.forall(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in needed]), lambda v: v != ""))
    lost = broken.select(name).orderBy(name).limit(3).collect()
    if lost:
        raise ValueError(f"rows without {' or '.join(needed)}: {[r[0] for r in lost]}")
    return rows


def training_set(key: DataFrame, runs: DataFrame, files: DataFrame, manual: DataFrame, negatives: int = 120, seed: int = 7, least_other: float = 0.5) -> DataFrame:
    """photo, file_name, kind, split and boxes of the photos that a detector learns from.

    key: photo, bibs (distinct, true). runs: photo, regions, hits (array of text, conf, det_conf, box). files: photo,
    file_name. manual: photo, labelled by hand. Kinds: manual; full, where each bib was read in a box, of which the
    surest counts, with every other box that the detector was fairly sure of; background, a sample of photos without
    bibs in which the detector saw nothing. Photos whose bibs were read in part are left out. Boxes that overlap by half
    are one.
    """
    rows = key.join(files, "photo").join(runs, "photo", "left").join(manual.select("photo", F.lit(True).alias("__manual")), "photo", "left")
    hits = F.coalesce("hits", F.filter("hits", lambda h: F.lit(False)))
    of = lambda bib: F.filter("hits", lambda h: h["text"] == bib)
    surest = lambda hs: F.element_at(F.array_sort(hs, lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).otherwise(0)), 1)
    read = F.array_distinct(F.transform(F.filter("hits", lambda h: F.array_contains("bibs", h["text"])), lambda h: h["text"]))
    apart = lambda kept, b: F.when(F.forall(kept, lambda k: iou(k, b) < 0.5), F.array_append(kept, b)).otherwise(kept)
    own = F.transform(read, lambda b: surest(of(b))["box"])
    others = F.transform(F.filter("hits", lambda h: F.coalesce(h["det_conf"], F.lit(0.0)) >= least_other), lambda h: h["box"])
    none = F.filter(F.transform("hits", lambda h: h["box"]), lambda b: F.lit(False))
    is_full = (F.size("bibs") > 0) & hits.isNotNull() & (F.size(read) == F.size("bibs"))
    blank = (F.size("bibs") == 0) & (F.coalesce("regions", F.lit(1)) == 0)
    kind = F.when(F.col("__manual"), "manual").when(is_full, "full").when(blank, "background")
    rows = rows.withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = rows.withColumn("boxes", F.when(F.col("kind") == "full", F.aggregate(F.concat(own, others), none, apart)))
    drawn = rows.filter("kind = 'background'").orderBy(F.xxhash64("photo", F.lit(seed)), "photo").limit(negatives)
    return rows.filter("kind <> 'background'").unionByName(drawn).select("photo", "file_name", "kind", split_by_blocks(F.col("photo")).alias("split"), "boxes")


def training_list(ours: DataFrame, others: DataFrame, most: int = 3000, seed: int = 7) -> DataFrame:
    """Paths to learn from: a sample of others' photos, and our own twice, so that they count. The duplicates are meant."""
    sample = others.select("path").orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(most)
    return sample.unionByName(ours.select("path")).unionByName(ours.select("path"))
