"""Queries on accuracy, calibration and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import metrics as m

from .adapters import HEAD, detections, table
from .registry import query

READS = """
WITH r AS (SELECT l_partkey::VARCHAR AS truth, CASE WHEN l_linenumber = 7 THEN '' WHEN l_suppkey % 4 = 0 THEN (l_partkey + 1)::VARCHAR ELSE l_partkey::VARCHAR END AS read, l_discount * 10 AS conf, l_quantity AS height, l_returnflag AS flag FROM lineitem),
s AS (SELECT *, (read = truth)::INT AS exact, (levenshtein(read, truth) <= 1)::INT AS fuzzy1, levenshtein(read, truth)::DOUBLE / greatest(length(truth), 1) AS cer, (read = '')::INT AS empty FROM r)
"""


def _scored(spark, d):
    truth = F.col("l_partkey").cast("string")
    read = F.when(F.col("l_linenumber") == 7, "").when(F.col("l_suppkey") % 4 == 0, (F.col("l_partkey") + 1).cast("string")).otherwise(truth)
    rows = table(spark, d, "lineitem").select(truth.alias("truth"), read.alias("read"), (F.col("l_discount") * 10).alias("conf"), F.col("l_quantity").alias("height"), F.col("l_returnflag").alias("flag"))
    return m.scored(rows, "read", "truth")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(READS + """
SELECT coalesce(b, 'all') AS bucket, count(*) AS n, round(avg(exact), 6) AS exact, round(avg(fuzzy1), 6) AS fuzzy1, round(avg(cer), 6) AS cer, round(avg(empty), 6) AS empty
FROM (SELECT *, CASE WHEN height < 20 THEN 'tiny' WHEN height < 40 THEN 'small' ELSE 'large' END AS b FROM s) GROUP BY ROLLUP (b)
""")
def score_buckets(spark, d):
    return _rounded(m.by_size(_scored(spark, d), "height"), "exact", "fuzzy1", "cer", "empty")


@query(READS + "SELECT CASE WHEN conf < 0.2 THEN 0.0 WHEN conf < 0.4 THEN 0.2 WHEN conf < 0.6 THEN 0.4 WHEN conf < 0.8 THEN 0.6 ELSE 0.8 END::DOUBLE AS low, count(*) AS n, round(avg(exact), 6) AS exact, round(avg(fuzzy1), 6) AS fuzzy1 FROM s GROUP BY ALL")
def calibration(spark, d):
    return _rounded(m.calibration(_scored(spark, d), "conf"), "exact", "fuzzy1")


SWEEP = READS + """
, w AS (SELECT t::DOUBLE AS threshold, count(*) AS k, avg(exact) AS exact, avg(fuzzy1) AS fuzzy1 FROM s JOIN (SELECT unnest([0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t) ON conf >= t GROUP BY t)
"""


@query(SWEEP + "SELECT threshold, round(k / (SELECT count(*) FROM s), 6) AS accepted, round(exact, 6) AS exact, round(fuzzy1, 6) AS fuzzy1, (SELECT count(*) FROM s) - k AS deferred FROM w")
def threshold_sweep(spark, d):
    return _rounded(m.sweep(_scored(spark, d), "conf"), "accepted", "exact", "fuzzy1")


@query(SWEEP + "SELECT min(threshold) AS threshold FROM w WHERE fuzzy1 >= 0.85")
def recommended_threshold(spark, d):
    return m.recommended(m.sweep(_scored(spark, d), "conf"), 0.85)


def _sets(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo")).agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))).alias("truth"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 3, (F.col("l_partkey") + F.col("l_suppkey") % 3).cast("string")))).alias("read"))
    return rows


@query("""
WITH p AS (SELECT l_orderkey AS photo, list(l_partkey::VARCHAR) AS truth, list_distinct(coalesce(list((l_partkey + l_suppkey % 3)::VARCHAR) FILTER (l_linenumber <= 3), [])) AS read FROM lineitem GROUP BY ALL),
c AS (SELECT len([x FOR x IN truth IF len([y FOR y IN read IF levenshtein(x, y) <= 1]) > 0]) AS f, len(truth) AS t, len([y FOR y IN read IF len([x FOR x IN truth IF levenshtein(x, y) <= 1]) > 0]) AS r, len(read) AS n FROM p)
SELECT sum(f)::BIGINT AS found, sum(t)::BIGINT AS truths, sum(r)::BIGINT AS "right", sum(n)::BIGINT AS reads, sum(f) / sum(t) AS recall, sum(r) / sum(n) AS precision FROM c
""")
def micro_pr(spark, d):
    return m.micro(_sets(spark, d), "truth", "read")


@query("""
WITH p AS (SELECT l_orderkey, (l_orderkey % 5)::VARCHAR AS folder, list_distinct(list(l_partkey)) AS t, list_distinct(coalesce(list(l_partkey) FILTER (l_linenumber <= 3), [])) AS a, list_distinct(coalesce(list(l_partkey + l_suppkey % 2) FILTER (l_linenumber <= 5), [])) AS b FROM lineitem GROUP BY ALL),
s AS (SELECT folder, system, len(list_intersect(t, r)) AS tp, len(r) - len(list_intersect(t, r)) AS fp, len(t) - len(list_intersect(t, r)) AS fn FROM (SELECT folder, t, 'short' AS system, a AS r FROM p UNION ALL SELECT folder, t, 'wide', b FROM p))
SELECT coalesce(folder, 'ALL') AS folder, system, count(*) AS n, round(avg((fp = 0 AND fn = 0)::INT), 6) AS exact, round(sum(tp) / greatest(1, sum(tp) + sum(fn)), 6) AS recall, round(sum(tp) / greatest(1, sum(tp) + sum(fp)), 6) AS precision, sum(fp)::BIGINT AS wrong, sum(fn)::BIGINT AS missed
FROM s GROUP BY GROUPING SETS ((folder, system), (system))
""")
def eval_by_group(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("t"), F.collect_list(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_linenumber") <= 5, F.col("l_partkey") + F.col("l_suppkey") % 2)).alias("b"))
    return _rounded(m.by_folder(rows.withColumn("folder", (F.col("l_orderkey") % 5).cast("string")), "folder", "t", {"short": "a", "wide": "b"}), "exact", "recall", "precision")


@query("""
WITH p AS (SELECT list_distinct(list(l_partkey)) AS t, list_distinct(coalesce(list(l_partkey) FILTER (l_linenumber <= 3), [])) AS a, list_distinct(coalesce(list(l_partkey + l_suppkey % 2) FILTER (l_linenumber <= 5), [])) AS b FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS photos, sum(len(t))::BIGINT AS truths, count(*) FILTER (list_sort(a) = list_sort(t)) AS before_exact, sum(len(list_intersect(a, t)))::BIGINT AS before_found, sum(len(a) - len(list_intersect(a, t)))::BIGINT AS before_wrong,
  count(*) FILTER (list_sort(b) = list_sort(t)) AS after_exact, sum(len(list_intersect(b, t)))::BIGINT AS after_found, sum(len(b) - len(list_intersect(b, t)))::BIGINT AS after_wrong FROM p
""")
def before_after(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("t"), F.collect_list(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_linenumber") <= 5, F.col("l_partkey") + F.col("l_suppkey") % 2)).alias("b"))
    return m.before_after(rows, "t", "a", "b")


@query(HEAD + "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, count(*) FILTER (confidence >= 0.3) AS sure, count(*) FILTER (confidence < 0.3) AS unsure FROM detections GROUP BY ROLLUP (source)")
def status_rollup(spark, d):
    return m.status(detections(spark, d), "source", {"sure": F.col("confidence") >= 0.3, "unsure": F.col("confidence") < 0.3})


@query("SELECT count(l_quantity) AS n, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, count(*) FILTER (l_quantity < 20) AS tiny, count(*) FILTER (l_quantity < 32) AS low FROM lineitem")
def percentile_summary(spark, d):
    return m.summary(table(spark, d, "lineitem"), "l_quantity", {"tiny": 20, "low": 32})


@query("""
WITH c AS (SELECT ['a', 'b', 'c'][1 + l_linenumber % 3] AS model, l_partkey AS i, l_suppkey AS o, l_linenumber AS w, l_orderkey % 100 AS r, l_returnflag = 'R' AS b FROM lineitem),
g AS (SELECT *, i + w * 1.25::DOUBLE + r * 0.05::DOUBLE AS given, CASE WHEN b THEN 0.5 ELSE 1.0 END::DOUBLE AS f FROM c)
SELECT model, count(*) AS calls, sum(floor(given))::BIGINT AS input, sum(o)::BIGINT AS output, round(sum(f * (given * CASE model WHEN 'a' THEN 2.0 WHEN 'b' THEN 4.0 ELSE 0.1 END::DOUBLE + o * CASE model WHEN 'a' THEN 10.0 WHEN 'b' THEN 20.0 ELSE 0.5 END::DOUBLE) / 1e6), 3) AS usd FROM g GROUP BY model
""")
def spend_by_model(spark, d):
    model = F.element_at(F.array(*map(F.lit, "abc")), F.col("l_linenumber") % 3 + 1)
    calls = table(spark, d, "lineitem").select(model.alias("model"), F.col("l_partkey").alias("input"), F.col("l_suppkey").alias("output"), F.col("l_linenumber").alias("cache_write"), (F.col("l_orderkey") % 100).alias("cache_read"), (F.col("l_returnflag") == "R").alias("batch"))
    prices = spark.createDataFrame([("a", 2.0, 10.0), ("b", 4.0, 20.0), ("c", 0.1, 0.5)], "model string, price_in double, price_out double")
    return m.spend(calls, prices).withColumn("usd", F.round("usd", 3))
