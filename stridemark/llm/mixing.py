"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target number of words. Its documents first get the whole copies that are certain; the words
still missing are drawn by Pareto order sampling: with u uniform from a hash of doc_id and an inclusion probability
p, documents are ranked by (u / (1 - u)) / (p / (1 - p)), and the sample is the head of that order whose words come
nearest to what is missing. The size of the sample is fixed in words, as the targets are.

Inclusion probabilities are unequal: proportional to size / (size + half_size), so that fragments are drawn less
often than whole documents, and 1 at most.

Defined cases. Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: hashed as
an empty id. Repeated rows are documents of their own; equal rows rank next to each other. Empty table: no rows.
Columns of the input named like the new ones are replaced by them; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (5, 2, 1)
NEW = ("size", "source_size", "target", "taken")


def _importance(size: Column, half_size: int) -> Column:
    """Integer, so that its sums do not depend on the order of addition."""
    return F.expr(f"(1024 * __size) div (__size + {half_size})")


def _rank(seed: str, half_size: int, buckets: int) -> dict[str, Column]:
    """Columns p, q and slice from doc_id, __size and the source's row of the plan."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.least(F.lit(1.0), _importance(F.col("__size"), half_size) * F.col("__rest") / F.col("__mass"))
    q = F.when(F.col("__p") >= 1, F.lit(0.0)).when(F.col("__p") > 0, (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p"))))
    part = F.when(F.col("__p") >= 1, F.lit(-1)).otherwise(F.floor(F.lit(buckets) * (F.col("__q") / (1 + F.col("__q")))).cast("int"))
    return {"__u": u, "__p": p, "__q": q, "__slice": part}


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return df


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix:", half_size: int = 64, buckets: int = 4096) -> DataFrame:
    """One row a source: its size, its target, the whole copies and where the order of its sample is cut.

    The documents' sizes are counted once and written as a narrow table; every later pass reads that. Order positions
    are resolved in two steps, by sums over ``buckets`` slices of the order and then within the one slice that the cut
    falls into, so that no task gathers a source. The windows without a partition run over one row a source.
    """
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("__size")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"), F.sum(F.col("__size").cast("decimal(38,0)") * _importance(F.col("__size"), half_size)).cast("double").alias("__mass"))
    big = "decimal(38,0)"
    named = per_source.withColumn("__n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    named = named.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__n") - 1, F.lit(len(weights))) + 1).cast("int")).cast(big)).withColumn("__cap", (F.col("source_size") * most).cast(big))
    every, before = Window.partitionBy(), Window.orderBy(F.col("__cap").cast("double") / F.col("__w").cast("double"), "__n").rowsBetween(Window.unboundedPreceding, -1)
    named = _with(named, {
        "__t": F.sum("source_size").over(every).cast(big),
        "__sum_w": F.sum("__w").over(every).cast(big),
        "__cap_before": F.coalesce(F.sum("__cap").over(before), F.lit(0)).cast(big),
        "__w_before": F.coalesce(F.sum("__w").over(before), F.lit(0)).cast(big),
    })
    # Water filling: by rising cap over weight, those whose cap is below their part of what is left stop at the cap.
    full = F.col("__cap").cast("double") * (F.col("__sum_w") - F.col("__w_before")).cast("double") <= (F.col("__t") - F.col("__cap_before")).cast("double") * F.col("__w").cast("double")
    named = named.withColumn("__full", full)
    left = (F.col("__t") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(F.lit(0).cast(big))).over(every)).cast("double")
    left_w = (F.col("__sum_w") - F.sum(F.when(F.col("__full"), F.col("__w")).otherwise(F.lit(0).cast(big))).over(every)).cast("double")
    named = named.withColumn("target", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(left * F.col("__w").cast("double") / left_w))
    named = named.withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    named = named.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    sources = written(named.select("source", "source_size", "target", "__mass", "__whole", "__rest"), "sources")

    ranked = _with(_join(sizes.filter("__size > 0"), sources.filter("__rest > 0")), _rank(seed, half_size, buckets))
    ordered = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = ranked.groupBy("source", "__slice", "__rest").agg(F.sum("__size").alias("__words")).withColumn("__to", F.sum("__words").over(ordered))
    cut = written(slices.filter("__to > __rest and __to - __words < __rest").select("source", F.col("__slice").alias("__cut_slice"), (F.col("__to") - F.col("__words")).alias("__from")), "cut-slices")
    inner = _join(ranked, cut).filter("__slice = __cut_slice")
    key = F.struct("__q", "doc_id", "__size")
    within = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("__before", F.col("__from") + F.coalesce(F.sum("__size").over(within), F.lit(0)))
    last = inner.filter("__before + __size / 2.0 <= __rest").groupBy("source").agg(F.max(key).alias("__cut"))
    return written(_join(_join(sources, cut.select("source", "__cut_slice"), "left"), last, "left"), "mix-plan")


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On source, null matching null. Spark chooses the strategy from the right side's measured size."""
    key = right.withColumnRenamed("source", "__source")
    return left.join(key, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix:", half_size: int = 64, buckets: int = 4096) -> DataFrame:
    """The documents with size, source_size, target and taken; a copy of a document is ``taken / size`` of it."""
    cuts = plan(docs, weights, most, seed, half_size, buckets)
    sized = docs.drop(*NEW).withColumn("__size", n_words(F.col("text")))
    rows = _with(_join(sized, cuts, "left"), _rank(seed, half_size, buckets))
    head = F.col("__cut_slice").isNull() | (F.col("__slice") < F.col("__cut_slice")) | ((F.col("__slice") == F.col("__cut_slice")) & F.col("__cut").isNotNull() & (F.struct("__q", "doc_id", "__size") <= F.col("__cut")))
    drawn = (F.col("__size") > 0) & (F.col("__rest") > 0) & head
    taken = F.col("__size") * (F.col("__whole") + F.coalesce(drawn, F.lit(False)).cast("bigint"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW], F.col("__size").alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input."""
    rows = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW])
