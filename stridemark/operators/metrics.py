"""Accuracy, calibration and threshold reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemark.functions.text import character_error_rate, within_one_edit

#: Thresholds that a sweep tries, and the lower bounds of the confidence's fifths.
THRESHOLDS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
FIFTHS = (0.0, 0.2, 0.4, 0.6, 0.8)


def scored(rows: DataFrame, read: str, truth: str) -> DataFrame:
    r, t = F.coalesce(read, F.lit("")), F.coalesce(truth, F.lit(""))
    return rows.withColumn("exact", r == t).withColumn("fuzzy1", within_one_edit(r, t)).withColumn("cer", character_error_rate(r, t)).withColumn("empty", r == "")


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double")).alias(flag)


def by_size(rows: DataFrame, height: str) -> DataFrame:
    """n, exact, fuzzy1, cer and empty of all reads and of three sizes."""
    bucket = F.when(F.col(height) < 20, "tiny").when(F.col(height) < 40, "small").otherwise("large")
    return rows.withColumn("bucket", bucket).rollup("bucket").agg(F.count("*").alias("n"), share("exact"), share("fuzzy1"), F.avg("cer").alias("cer"), share("empty")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def calibration(rows: DataFrame, conf: str) -> DataFrame:
    """Fifths of the confidence, each with its lower bound; 1 belongs to the last."""
    low = F.element_at(F.filter(F.array(*map(F.lit, FIFTHS)), lambda b: (b <= F.col(conf)) | (b == FIFTHS[0])), -1)
    return rows.groupBy(low.alias("low")).agg(F.count("*").alias("n"), share("exact"), share("fuzzy1"))


def sweep(rows: DataFrame, conf: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What is accepted at each threshold that any row reaches: conditional sums, one pass and one row to turn."""
    within = lambda t, c: F.when(F.col(conf) >= t, c)
    parts = [F.struct(F.lit(t).alias("threshold"), F.count(within(t, F.lit(1))).alias("n"), *[F.avg(within(t, F.col(c).cast("double"))).alias(c) for c in ("exact", "fuzzy1")]) for t in thresholds]
    turned = rows.agg(F.count("*").alias("total"), *[p.alias(f"__{i}") for i, p in enumerate(parts)]).select("total", F.explode(F.array(*[f"__{i}" for i in range(len(parts))])).alias("t")).filter("t.n > 0")
    return turned.select("t.threshold", (F.col("t.n") / F.col("total")).alias("accepted"), "t.exact", "t.fuzzy1", (F.col("total") - F.col("t.n")).alias("deferred"))


def recommended(table: DataFrame, target: float = 0.98) -> DataFrame:
    """The lowest threshold that reaches the target."""
    return table.filter(F.col("fuzzy1") >= target).agg(F.min("threshold").alias("threshold"))


def micro(rows: DataFrame, truth: str, read: str) -> DataFrame:
    """Precision and recall over photos: truths are a list, reads a set; edit distance 1 counts as found."""
    reads = F.array_distinct(read)
    found = F.size(F.filter(truth, lambda t: F.exists(reads, lambda p: within_one_edit(t, p))))
    right = F.size(F.filter(reads, lambda p: F.exists(truth, lambda t: within_one_edit(t, p))))
    sums = rows.agg(F.sum(found).alias("found"), F.sum(F.size(truth)).alias("truths"), F.sum(right).alias("right"), F.sum(F.size(reads)).alias("reads"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("*", ratio("found", "truths").alias("recall"), ratio("right", "reads").alias("precision"))


def by_folder(rows: DataFrame, folder: str, truth: str, systems: dict[str, str]) -> DataFrame:
    """exact, recall, precision, wrong and missed of each system, by folder and for all. Null sets don't count."""
    long = rows.select(folder, F.array_distinct(truth).alias("t"), F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.array_distinct(c).alias("r")) for n, c in systems.items()])).alias("s")).select(folder, "t", "s.*").filter("r IS NOT NULL")
    tp, fp, fn = F.size(F.array_intersect("t", "r")), F.size(F.array_except("r", "t")), F.size(F.array_except("t", "r"))
    counted = long.select(folder, "system", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    one = F.lit(1)
    sums = [F.count("*").alias("n"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")).alias("exact"), (F.sum("tp") / F.greatest(one, F.sum("tp") + F.sum("fn"))).alias("recall"), (F.sum("tp") / F.greatest(one, F.sum("tp") + F.sum("fp"))).alias("precision"), F.sum("fp").alias("wrong"), F.sum("fn").alias("missed")]
    return counted.groupingSets([[F.col(folder), F.col("system")], [F.col("system")]], folder, "system").agg(*sums).withColumn(folder, F.coalesce(folder, F.lit("ALL")))


def before_after(rows: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """Sets before and after a change against the truth: exact, found, wrong."""
    part = lambda c, n: [F.count_if(F.array_sort(F.array_distinct(c)) == F.array_sort(F.array_distinct(truth))).alias(f"{n}_exact"), F.sum(F.size(F.array_intersect(c, truth))).alias(f"{n}_found"), F.sum(F.size(F.array_except(c, truth))).alias(f"{n}_wrong")]
    return rows.agg(F.count("*").alias("photos"), F.sum(F.size(F.array_distinct(truth))).alias("truths"), *part(before, "before"), *part(after, "after"))


def status(rows: DataFrame, batch: str, flags: dict[str, Column]) -> DataFrame:
    """Counts by batch and in total."""
    return rows.rollup(batch).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()]).withColumn(batch, F.coalesce(batch, F.lit("TOTAL")))


def summary(rows: DataFrame, value: str, limits: dict[str, float]) -> DataFrame:
    """Count, tenth, half and nine tenths, and how many are below each limit."""
    p = [F.percentile(value, F.lit(q)).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)]
    return rows.agg(F.count(value).alias("n"), *p, *[F.count_if(F.col(value) < x).alias(k) for k, x in limits.items()])


def spend(calls: DataFrame, prices: DataFrame, batch_share: float = 0.5, write: float = 1.25, read: float = 0.05) -> DataFrame:
    """Dollars by model: calls (model, input, output, cache_write, cache_read, batch) with prices a million tokens."""
    given = F.col("input") + F.col("cache_write") * write + F.col("cache_read") * read
    rows = calls.join(prices, "model").withColumn("given", given).withColumn("f", F.when(F.col("batch"), batch_share).otherwise(1.0))
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.floor("given")).alias("input"), F.sum("output").alias("output"), F.sum(F.col("f") * (F.col("given") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1e6).alias("usd"))


def worst(rows: DataFrame, position: str, k: int = 15) -> DataFrame:
    """The k most wrong reads, in the order they came in where they are equally wrong."""
    return rows.orderBy(F.desc("cer"), position).limit(k)


def mistakes(rows: DataFrame, truth: str, read: str, bibs: str) -> DataFrame:
    """Photos whose set of numbers isn't the true one: both sets, what is wrong and what is missed, and how it came.

    bibs: array of (status, number, pattern, candidates, how, why).
    """
    t, r = F.array_sort(F.array_distinct(truth)), F.array_sort(F.array_distinct(read))
    joined = lambda c: F.array_join(c, " ")
    blank = lambda c: F.nullif(c, F.lit(""))
    what = lambda b: F.concat(b["status"], F.lit(":"), F.coalesce(blank(b["number"]), blank(b["pattern"]), F.array_join(F.coalesce(b["candidates"], F.array().cast("array<string>")), ",")), F.lit(" ("), F.coalesce(blank(b["how"]), b["why"], F.lit("")), F.lit(")"))
    return rows.filter(t != r).select("folder", "photo", joined(t).alias("people"), joined(r).alias("read"), joined(F.array_except(r, t)).alias("wrong"), joined(F.array_except(t, r)).alias("missed"), F.array_join(F.transform(bibs, what), " | ").alias("bibs"))


def estimate(photos: DataFrame, width: str, height: str, prices: dict[str, float], bibs: float = 3.0, tile_share: float = 0.3, judge_share: float = 0.1, thinking: int = 150, judge_thinking: int = 1000, prompts: dict[str, float] | None = None) -> DataFrame:
    """One row: photos, mean input and output tokens of each step a photo, and dollars a photo, live and batched.

    prices: dollars a million tokens: in, out, judge_in, judge_out. prompts: tokens of the prompts survey and zoom.
    """
    from stridemark.functions.geometry import fit_size, image_tokens

    prompts = prompts or {"survey": 0.0, "zoom": 0.0}
    w, h = F.col(width), F.col(height)
    seen = fit_size(w, h, most=1.0)
    tw, th = F.floor(w * 0.58), F.floor(h * 0.58)
    tile = fit_size(tw, th, most=2.5)
    means = photos.agg(F.count("*").alias("photos"), F.avg(image_tokens(seen["w"], seen["h"])).alias("survey"), F.avg(image_tokens(tile["w"], tile["h"])).alias("tile"))
    # Tokens that a step's answers and its pictures of a bib come to.
    steps = {
        "survey": (F.col("survey") + prompts["survey"], F.lit(60 + 45 * bibs + thinking)),
        "tiles": ((F.col("tile") + prompts["survey"]) * 4 * tile_share, F.lit(4 * (60 + 30 * bibs + thinking) * tile_share)),
        "zoom": (F.lit(bibs * (2 * 560 + 20) + prompts["zoom"]), F.lit(50 + 55 * bibs + thinking)),
        "judge": (F.lit(judge_share * bibs * (3 * 900 + 900)), F.lit(judge_share * bibs * (120 + 2 * judge_thinking))),
    }
    rows = means.select("photos", *[c.cast("double").alias(f"{k}_{n}") for k, v in steps.items() for c, n in zip(v, ("in", "out"), strict=True)])
    cost = lambda k, p: F.col(f"{k}_in") * prices[f"{p}in"] + F.col(f"{k}_out") * prices[f"{p}out"]
    return rows.withColumn("usd", (cost("survey", "") + cost("tiles", "") + cost("zoom", "") + cost("judge", "judge_")) / 1e6).withColumn("batch_usd", F.col("usd") / 2)


def import_summary(reads: DataFrame, photos: DataFrame) -> DataFrame:
    """One row: photos, reads by source, photos with a confirmed bib and without, and distinct numbers.

    reads: file_name, bib_text, source. photos: file_name.
    """
    tagged = reads.groupBy("file_name").agg(*[F.count_if(F.col("source") == s).alias(s) for s in ("review", "ocr", "rejected")])
    rows = photos.select("file_name").join(tagged, "file_name", "left")
    sums = rows.agg(F.count("*").alias("photos"), *[F.coalesce(F.sum(s), F.lit(0)).alias(n) for s, n in (("review", "confirmed"), ("ocr", "model"), ("rejected", "rejected"))], F.count_if(F.col("review") > 0).alias("tagged"))
    return sums.crossJoin(reads.agg(F.count_distinct("bib_text").alias("numbers"))).withColumn("untagged", F.col("photos") - F.col("tagged"))  # one row each


def runner_summary(runners: DataFrame) -> DataFrame:
    """One row: runners, races, and how many have a whole date of birth and a finish time."""
    return runners.agg(F.count("*").alias("runners"), F.count_distinct("race_code").alias("races"), F.count("dob").alias("with_dob"), F.count("finish_s").alias("with_time"))
