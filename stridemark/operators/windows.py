"""Operators on order: bursts, sessions, numbering, halves, samples, chunks. Each window has a partition but where said.

A partition by folder holds a folder's photos in one task, which is what a folder's order means; numbering, halves,
samples and chunks of a key only need each row's place, which ``placed`` gives without that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemark.functions.text import natural_key


def burst_support(frames: DataFrame, folder: str, position: str, values: str, reach: int = 6) -> DataFrame:
    """Rows with ``near``: how many frames within reach have each value, as (value, n), the frame itself left out.

    Positions must count frames without values too.
    """
    w = Window.partitionBy(folder).orderBy(position).rangeBetween(-reach, reach)
    others = F.flatten(F.transform(F.filter(F.collect_list(F.struct(F.col(position).alias("p"), F.array_distinct(values).alias("v"))).over(w), lambda x: x["p"] != F.col("__at")), lambda x: x["v"]))
    rows = frames.withColumn("__at", F.col(position)).withColumn("__o", others)
    return rows.withColumn("near", F.transform(F.array_sort(F.array_distinct("__o")), lambda v: F.struct(v.alias("value"), F.size(F.filter("__o", lambda x: x == v)).alias("n")))).drop("__at", "__o")


def support_pairs(frames: DataFrame, folder: str, position: str, value: str, reach: int = 6) -> DataFrame:
    """folder, position, value and n, how many other frames within reach have the value, of frames where some have.

    One window over the frames that have a value: no array holds a neighbourhood, and no row is sent anywhere else.
    """
    w = Window.partitionBy(folder, value).orderBy(position).rangeBetween(-reach, reach)
    rows = frames.select(folder, position, value).distinct()
    return rows.withColumn("n", F.count("*").over(w) - 1).filter("n > 0")


def sessions(rows: DataFrame, key: str, at: str, gap_ms: int = 5000) -> DataFrame:
    """Rows with ``run``: a new one begins where more than a gap has passed since the row before."""
    w = Window.partitionBy(key).orderBy(at)
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    new = F.coalesce((ms - F.lag(ms).over(w) > gap_ms).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def longest_run(rows: DataFrame, key: str, at: str, gap_ms: int = 5000) -> DataFrame:
    """key, n and last: the length of the longest run and its last time; the later of equal ones."""
    runs = sessions(rows, key, at, gap_ms).groupBy(key, "run").agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return runs.groupBy(key).agg(F.max(F.struct("n", "run", "last")).alias("__b")).select(key, "__b.n", "__b.last")


def cover(gallery: DataFrame, key: str, at: str, bibs: str, photo: str, place: str, gap_ms: int = 5000) -> DataFrame:
    """key and photo: of the photos with the fewest bibs the last of the longest run, or the first without times."""
    fewest = gallery.withColumn("__f", F.min(F.coalesce(bibs, F.lit(1 << 30))).over(Window.partitionBy(key))).filter(F.coalesce(bibs, F.lit(1 << 30)) == F.col("__f"))
    w = Window.partitionBy(key).orderBy(at, place)
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    timed = fewest.filter(F.col(at).isNotNull()).withColumn("__new", F.coalesce((ms - F.lag(ms).over(w) > gap_ms).cast("int"), F.lit(0)))
    timed = timed.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = timed.groupBy(key, "__run").agg(F.count("*").alias("n"), F.max(F.struct(at, place, photo)).alias("last"))
    best = runs.groupBy(key).agg(F.max(F.struct("n", "__run", "last")).alias("__b")).select(key, F.col(f"__b.last.{photo}").alias("__timed"))
    first = fewest.groupBy(key).agg(F.min(F.struct(place, photo)).alias("__b")).select(key, F.col(f"__b.{photo}").alias("__first"))
    return first.join(best, key, "left").select(key, F.coalesce("__timed", "__first").alias(photo))


def numbered(rows: DataFrame, key: str, order: list, start: Column) -> DataFrame:
    """Rows with ``number``, which goes on after a key's largest."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)) + F.coalesce(start, F.lit(0)))


def numbered_after(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """The old rows as they are, and the new ones numbered after the largest number that their key has in old."""
    top = old.groupBy(F.col(key).alias("__key")).agg(F.max("number").alias("__top"))
    known = new.join(top, F.col(key).eqNullSafe(F.col("__key")), "left")
    return old.unionByName(numbered(known, key, order, F.col("__top")).drop("__key", "__top"))


def places_of_all(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``place`` from 1 in an order of all, by columns of any types that sort.

    Spark's ranges of the order are numbered each by itself, from the number of rows in the ranges before; a table in
    between keeps every row in its range. The driver has one number a range; no task has all rows.
    """
    from stridemark.sources.sinks import staged

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before, at = {}, 0
    for k in sorted(counts):
        before[k], at = at, at + counts[k]
    starts = F.create_map(*[F.lit(v) for k in sorted(before) for v in (k, before[k])]) if before else F.lit(None).cast("map<int,int>")
    w = Window.partitionBy("__range").orderBy(*order)
    return ranged.withColumn("place", starts[F.col("__range")] + F.row_number().over(w)).drop("__range")


def natural_places(rows: DataFrame, name: Column, key: str) -> DataFrame:
    """The rows with ``place`` in the natural order of all, then by key."""
    return places_of_all(rows.withColumn("__k", natural_key(name)), ["__k", key]).drop("__k")


def shot_order(photos: DataFrame, folder: str, shot: str, name_key: Column) -> DataFrame:
    """Rows with ``place`` in the folder: by time if every photo has one, else by name."""
    all_timed = F.min(F.col(shot).isNotNull()).over(Window.partitionBy(folder))
    rows = photos.withColumn("__t", F.when(all_timed, F.col(shot))).withColumn("__k", name_key)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(folder).orderBy("__t", "__k"))).drop("__t", "__k")


def stratified(rows: DataFrame, folder: str, name: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, as evenly over folders as they allow, in an order by hash."""
    w = Window.partitionBy(folder).orderBy(F.xxhash64(F.col(name), F.lit(seed)))
    return rows.withColumn("__n", F.row_number().over(w)).orderBy("__n", F.xxhash64(F.col(folder), F.lit(seed))).limit(n).drop("__n")


def placed(rows: DataFrame, key: str, order: str, slices: int = 64) -> DataFrame:
    """Rows with ``place`` from 1 within the key, and ``of``, the key's number of rows.

    The key's rows are cut by quantiles of the order, so that a hot key is numbered slice by slice in many tasks. Equal
    orders are in one slice; they should be few. The order must be a number, date or time.
    """
    at = F.col(order).cast("double") if dict(rows.dtypes)[order] not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    cuts = rows.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000).alias("__cuts"))
    cut = rows.join(cuts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < at)))
    sizes = cut.groupBy(F.col(key).alias("__key"), F.col("__slice").alias("__s")).agg(F.count("*").alias("__m"))
    w = Window.partitionBy("__key")
    starts = sizes.select("__key", "__s", F.coalesce(F.sum("__m").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__m").over(w).alias("of"))
    numbered = cut.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__slice").orderBy(order)))
    joined = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__s")))
    return joined.withColumn("place", F.col("__before") + F.col("__i")).drop("__cuts", "__slice", "__i", "__key", "__s", "__before")


def halves(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with ``half`` 1 or 2; the first has the odd row."""
    return placed(rows, key, order).withColumn("half", F.when(2 * F.col("place") <= F.col("of") + 1, 1).otherwise(2)).drop("place", "of")


def every_kth(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    return placed(rows, key, order).filter((F.col("place") - 1) % k == 0).drop("place", "of")


def split_by_blocks(number: Column, block: int = 20, every: int = 5) -> Column:
    """val for one block of consecutive numbers in five, so that shots of one moment stay together."""
    return F.when(F.floor((number - 1) / block) % every == every - 1, "val").otherwise("train")


def chunks(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    return placed(rows, key, order).withColumn("chunk", F.floor((F.col("place") - 1) / most)).drop("place", "of")


def byte_chunks(rows: DataFrame, key: str, order: list, size: str, most: int) -> DataFrame:
    """Rows with ``chunk``: where the running size passes another multiple of the budget."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("chunk", F.floor(before / most))


def within_budget(rows: DataFrame, key: str, order: list, cost: str, cap: float) -> DataFrame:
    """The head of each key whose running cost stays within a cap."""
    return rows.withColumn("__c", F.sum(cost).over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__c") <= cap).drop("__c")


def next_open(rows: DataFrame, key: str, position: str, after: Column, is_open: Column) -> DataFrame:
    """key and next: the first open position after one, or from the start again."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(is_open & (F.col(position) > after), F.col(position))), F.min(F.when(is_open, F.col(position)))).alias("next"))
