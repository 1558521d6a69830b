"""What several readers of a photo's bibs say, put together.

Reads are arrays of (text, conf). A second reader gives numbers, a map from number to clear or partial, and an error
as data. Array order matters in all of these and is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemark.functions.geometry import box_key
from stridemark.functions.text import bare_number, normalise_digits, only_digits, split_bibs

READS = "array<struct<text:string,conf:double>>"
#: Fixed value: the verdict on a person whose numbers only the second reader gives, as stored tables have it.
ONLY_SECOND = "haiku_only"


def nothing() -> Column:
    return F.array().cast("array<string>")


def best_read(reads: Column) -> Column:
    """The read with the highest confidence, the first of equal ones."""
    return F.element_at(F.array_sort(reads, lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).otherwise(0)), 1)


def merged_reads(rows: DataFrame, key: str) -> DataFrame:
    """From rows (key, pos, text, conf) an array of normalised reads by key: the best confidence of each, best first."""
    good = rows.withColumn("text", normalise_digits(F.col("text"))).filter("text <> ''")
    each = good.groupBy(key, "text").agg(F.max("conf").alias("conf"), F.min("pos").alias("pos"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "pos", "text"))), lambda x: F.struct(x["text"].alias("text"), (-x["c"]).alias("conf"))).alias("reads"))


def best_hits(hits: DataFrame, photo: str) -> DataFrame:
    """The best hit of each number in a photo; the first of equal ones."""
    good = hits.withColumn("number", bare_number(F.col("text"))).filter("number <> ''")
    return good.groupBy(photo, "number").agg(F.max_by(F.struct(*[c for c in hits.columns if c != photo]), F.struct("conf", -F.col("pos"))).alias("hit")).select(photo, "number", "hit.*")


def plausible(number: Column, listed: Column | None) -> Column:
    """On the start list, or of three or four digits if there is none."""
    return listed if listed is not None else F.length(number).between(3, 4)


def judge(reads: Column, second: Column, confident_at: float = 0.8) -> Column:
    """kind, numbers and needs_human of one person's reads and the second reader's answer.

    second is a struct of numbers, clarity and error; null if it was not asked.
    """
    best, some = F.when(F.size(reads) > 0, best_read(reads)), F.size(reads) > 0
    own = F.when(some, F.array(best["text"])).otherwise(nothing())
    numbers = F.coalesce(second["numbers"], nothing())
    agreed = F.filter(numbers, lambda n: F.exists(reads, lambda r: r["text"] == n))
    clear = F.forall(agreed, lambda n: F.coalesce(F.try_element_at(second["clarity"], n) == "clear", F.lit(False)))
    out = lambda kind, nums, human: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), nums.alias("numbers"), (human if isinstance(human, Column) else F.lit(human)).alias("needs_human"))
    return (
        F.when(some & (best["conf"] >= confident_at), out("confident", own, False))
        .when(second.isNull(), out("model_only", own, some))
        .when(F.coalesce(second["error"], F.lit("")) != "", out("error", own, True))
        .when(F.size(agreed) > 0, out("agree", agreed, ~clear))
        .when(F.size(numbers) > 0, out(F.when(some, "disagree").otherwise(ONLY_SECOND), numbers, True))
        .when(some, out("disagree", nothing(), True))
        .otherwise(out("empty", nothing(), False))
    )


def cascade(primary: Column, fallback: Column, threshold: float) -> Column:
    """Unsure first reads go behind the fallback's; a failed (null) or empty fallback changes nothing. Not sorted."""
    sure = F.when(F.size(primary) > 0, primary[0]["conf"]).otherwise(0.0)
    behind = F.filter(primary, lambda p: ~F.exists(fallback, lambda s: s["text"] == p["text"]))
    return F.when((sure >= threshold) | fallback.isNull() | (F.size(fallback) == 0), primary).otherwise(F.concat(fallback, behind))


def cascade_counts(rows: DataFrame, primary: str, fallback: str, threshold: float) -> DataFrame:
    first = lambda c: F.when(F.size(c) > 0, F.col(c)[0]["text"]).otherwise("")
    unsure = F.coalesce(F.when(F.size(primary) > 0, F.col(primary)[0]["conf"]), F.lit(0.0)) < threshold
    return rows.agg(F.count("*").alias("total"), F.count_if(unsure).alias("deferred"), F.count_if(unsure & F.col(fallback).isNull()).alias("failed"), F.count_if(unsure & (F.size(fallback) > 0) & (first(fallback) != first(primary))).alias("improved"))


def fold_tiles(rows: DataFrame, photo: str) -> DataFrame:
    """Rows (photo, pos, number, clear) to numbers in order of first sight and a map; clear in one tile is clear."""
    each = rows.groupBy(photo, "number").agg(F.max("clear").alias("clear"), F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "number", "clear")))
    return each.groupBy(photo).agg(listed.alias("l")).select(photo, F.transform("l", lambda x: x["number"]).alias("numbers"), F.map_from_arrays(F.transform("l", lambda x: x["number"]), F.transform("l", lambda x: F.when(x["clear"], "clear").otherwise("partial"))).alias("clarity"))


def suggestions(hits: DataFrame, second: DataFrame, start: DataFrame | None = None, recheck: DataFrame | None = None, tiles: DataFrame | None = None, prefill_at: float = 0.5) -> DataFrame:
    """numbers, needs_human and persons of each photo, from all that was read of it.

    hits: photo, pos, text, conf, box. second: photo, numbers, clarity, error; one row a photo. recheck: photo, key (of
    the box), numbers, clarity, local (reads). tiles: photo, numbers, clarity. start: number; without one three or four
    digits do. Photos without hits appear if the second reader or the tiles saw something; ``numbers`` lists accepted
    hits by falling confidence, then what only the second reader saw, then what only tiles saw, sorted.

    All that is known of a photo, which is little, is gathered once and then judged in arrays.
    """
    photo, no = "photo", F.lit(False)
    on_list = (lambda df, c: df.join(start.select(F.col("number").alias(c)).distinct().withColumn("real", F.lit(True)), c, "left").withColumn("real", F.coalesce("real", no))) if start is not None else (lambda df, c: df.withColumn("real", F.coalesce(F.length(c).between(3, 4), no)))
    is_clear = lambda n: F.coalesce(F.try_element_at("clarity", n) == "clear", no)
    read = on_list(hits.withColumn("number", bare_number(F.col("text"))).filter("number <> ''"), "number")
    told = second.withColumn("ok", F.col("error").isNull())
    seen = on_list(told.filter("ok").select(photo, F.posexplode(F.array_distinct("numbers")).alias("at", "number"), "clarity"), "number").filter("real")
    parts = [
        read.select(photo, F.struct((-F.col("conf")).alias("c"), F.col("pos").cast("bigint").alias("at"), "number", "conf", box_key(F.col("box")).alias("key"), "real").alias("h")),
        told.select(photo, "ok"),
        seen.select(photo, F.struct(F.col("at").cast("bigint").alias("at"), "number", is_clear(F.col("number")).alias("clear")).alias("s")),
    ]
    if recheck is not None:
        look = on_list(recheck.select(photo, "key", F.explode_outer("numbers").alias("n"), "clarity", "local"), "n")
        first = F.try_element_at(F.col("local"), F.lit(1))
        parts.append(look.select(photo, F.struct("key", F.when(F.col("real"), F.col("n")).alias("n"), is_clear(F.col("n")).alias("clear"), first["text"].alias("near"), F.coalesce(first["conf"], F.lit(0.0)).alias("sure")).alias("k")))
    if tiles is not None:
        wide = tiles.select(photo, F.explode("numbers").alias("number"), "clarity")
        parts.append(on_list(wide.filter(is_clear(F.col("number"))), "number").filter("real").select(photo, F.col("number").alias("w")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    gathered = rows.groupBy(photo).agg(F.array_sort(F.collect_list("h")).alias("h"), F.coalesce(F.bool_or("ok"), no).alias("ok"), F.array_sort(F.collect_list("s")).alias("s"), *([F.collect_list("k").alias("k")] if recheck is not None else []), *([F.array_sort(F.collect_set("w")).alias("w")] if tiles is not None else []))
    # Of each number the surest hit, the first of equal ones; from a confidence on it is a person.
    order = F.transform("h", lambda x: x["number"])
    gathered = gathered.withColumn("h", F.filter("h", lambda x, i: F.array_position(order, x["number"]) == i + 1))
    ok = F.col("ok")
    with_told = F.transform(F.filter("h", lambda x: x["conf"] >= 0.1), lambda x: x.withField("told", ok & x["real"] & F.exists("s", lambda y: y["number"] == x["number"])))
    with_take = F.transform(with_told, lambda x: x.withField("take", x["real"] & F.when(ok, x["told"] | (x["conf"] >= max(prefill_at, 0.9))).otherwise(x["conf"] >= prefill_at)))
    with_doubt = F.transform(with_take, lambda x: x.withField("doubt", x["real"] & ~x["take"] & (x["conf"] >= F.when(ok, 0.6).otherwise(0.3))))
    if recheck is not None:
        looks = lambda x, clear: F.array_distinct(F.transform(F.filter("k", lambda y: (y["key"] == x["key"]) & y["n"].isNotNull() & (y["clear"] == clear)), lambda y: y["n"]))
        with_doubt = F.transform(with_doubt, lambda x: x.withField("clear", looks(x, True)).withField("part", looks(x, False)).withField("look", F.try_element_at(F.filter("k", lambda y: y["key"] == x["key"]), F.lit(1))))
        near = lambda x, n: F.coalesce(x["look"]["near"] == n, no)
        agrees = lambda x: x["doubt"] & x["look"].isNotNull() & (F.array_contains(x["clear"], x["number"]) | (F.array_contains(x["part"], x["number"]) & near(x, x["number"]) & (x["look"]["sure"] >= 0.8)))
        other = lambda x: x["doubt"] & x["look"].isNotNull() & ~x["agrees"] & (F.size(x["clear"]) == 1) & near(x, F.try_element_at(x["clear"], F.lit(1))) & (x["look"]["sure"] >= 0.5)
        with_doubt = F.transform(with_doubt, lambda x: x.withField("agrees", F.coalesce(agrees(x), no)))
        with_doubt = F.transform(with_doubt, lambda x: x.withField("swap", F.when(F.coalesce(other(x), no), F.try_element_at(x["clear"], F.lit(1)))))
    else:
        with_doubt = F.transform(with_doubt, lambda x: x.withField("agrees", no).withField("swap", F.lit(None).cast("string")))
    gathered = gathered.withColumn("h_", with_doubt)

    def person(x: Column) -> Column:
        take = x["take"] | x["agrees"]
        verdict = F.when(x["agrees"], "agree").when(x["swap"].isNotNull(), "replaced").when(x["told"], "agree").when(x["take"], "confident").otherwise("model_only")
        return F.struct(F.lit(0).alias("part"), x["c"].alias("c"), x["at"].alias("at"), x["number"].alias("number"), F.coalesce(x["swap"], F.when(take, x["number"])).alias("gives"), (x["doubt"] & ~x["agrees"] & x["swap"].isNull()).alias("needs_human"), (~take).alias("unsure"), verdict.alias("verdict"))

    # Anything the hits have, at whatever confidence, or were replaced by, is no longer only the second reader's.
    have = F.concat(order, F.filter(F.transform("h_", lambda x: x["swap"]), lambda n: n.isNotNull()))
    extra = F.transform("s", lambda y: F.struct(F.lit(1).alias("part"), y["at"].alias("at"), y["number"].alias("number"), ((y["clear"] | F.array_contains("w", y["number"])) if tiles is not None else y["clear"]).alias("clear")))
    if tiles is not None:
        more = F.filter("w", lambda n: ~F.exists("s", lambda y: y["number"] == n))
        extra = F.concat(extra, F.transform(more, lambda n: F.struct(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("at"), n.alias("number"), F.lit(True).alias("clear"))))
    gathered = gathered.withColumn("only", F.filter(extra, lambda y: ~F.array_contains(have, y["number"])))
    only = F.transform("only", lambda y: F.struct(y["part"].alias("part"), F.lit(0.0).alias("c"), y["at"].alias("at"), y["number"].alias("number"), F.when(y["clear"], y["number"]).alias("gives"), no.alias("needs_human"), (~y["clear"]).alias("unsure"), F.lit("whole_only").alias("verdict")))
    judged = gathered.select(photo, F.array_sort(F.concat(F.transform("h_", person), only)).alias("p")).filter("size(p) > 0")
    return judged.select(photo, F.array_distinct(F.filter(F.transform("p", lambda x: x["gives"]), lambda x: x.isNotNull())).alias("numbers"), F.size(F.filter("p", lambda x: x["needs_human"])).alias("needs_human"), F.transform("p", lambda x: F.struct(x["number"].alias("number"), x["verdict"].alias("verdict"), x["unsure"].alias("unsure"), x["needs_human"].alias("needs_human"))).alias("persons"))


def doubts(suggested: DataFrame, photo: str = "photo") -> DataFrame:
    """Photos that need a closer look: numbers in doubt, and whether partial second reads call for tiles."""
    unsure = F.exists("persons", lambda x: (x["verdict"] == "whole_only") & x["unsure"])
    boxes = F.transform(F.filter("persons", lambda x: x["needs_human"] & (x["verdict"] != "whole_only")), lambda x: x["number"])
    return suggested.select(photo, boxes.alias("in_doubt"), unsure.alias("tiles")).filter((F.size("in_doubt") > 0) | F.col("tiles"))


def imported_reads(bundle: DataFrame) -> DataFrame:
    """file_name, bib_text, confidence, rank, source from rows (file_name, bibs, model_numbers, reviewed).

    Confirmed bibs win over model reads of the same photo. Model reads need two digits; those of a photo that a person
    left empty are kept as rejected.
    """
    confirmed = F.array_distinct(split_bibs(F.col("bibs")))
    rows = bundle.withColumn("__c", confirmed)
    empty = F.coalesce("reviewed", F.lit(False)) & (F.size("__c") == 0)
    models = F.array_distinct(F.filter(F.transform(F.coalesce("model_numbers", nothing()), lambda n: only_digits(n)), lambda n: (F.length(n) >= 2) & ~F.array_contains(F.col("__c"), n)))
    read = lambda n, conf, rank, source: F.struct(n.alias("bib_text"), F.lit(conf).alias("confidence"), F.lit(rank).alias("rank"), source.alias("source"))
    every = F.concat(F.transform("__c", lambda n: read(n, 1.0, 0, F.lit("review"))), F.transform(models, lambda n: read(n, 0.35, 1, F.when(empty, "rejected").otherwise("ocr"))))
    return rows.select("file_name", F.explode(every).alias("r")).select("file_name", "r.*")


def published(photos: DataFrame, reviews: DataFrame, suggested: DataFrame) -> DataFrame:
    """photo, numbers and reviewed: a person's list wins even if empty; photos that nobody looked at are left out."""
    rows = photos.join(reviews.select("photo", F.col("numbers").alias("__r"), F.lit(True).alias("__seen")), "photo", "left").join(suggested.select("photo", F.col("numbers").alias("__s"), F.lit(True).alias("__scanned")), "photo", "left")
    kept = rows.filter("__seen OR __scanned")
    return kept.select("photo", F.when(F.col("__seen"), F.col("__r")).otherwise(F.col("__s")).alias("numbers"), F.coalesce("__seen", F.lit(False)).alias("reviewed"))


def label_kinds(rows: DataFrame) -> DataFrame:
    """full, partial or background for training photos, from their true bibs and those found in boxes."""
    lost = F.size(F.array_except("bibs", "found"))
    return rows.withColumn("kind", F.when(F.size("bibs") == 0, "background").when(lost == 0, "full").otherwise("partial"))


def priority(suggested: DataFrame, photo: str = "photo") -> DataFrame:
    """Rows with ``priority``: disagreements and boxes in doubt, for review in falling order."""
    return suggested.withColumn("priority", F.struct(F.size(F.filter("persons", lambda x: x["verdict"] == "disagree")).alias("disagree"), F.col("needs_human").alias("human")))


def hints(reads: Column, least: float = 0.3) -> Column:
    """Distinct plausible reads for the second reader, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(reads, lambda r: (r["conf"] >= least) & F.length(r["text"]).between(3, 4)), lambda r: r["text"])))


def ranked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
