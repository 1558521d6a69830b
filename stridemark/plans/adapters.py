"""The supplied tables seen as an event's tables, in Spark and as the head of the SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = """
WITH races AS (
  SELECT 1 AS event_id, n_nationkey AS race_id, n_name AS name, ['marathon', 'half', '10k'][1 + n_nationkey % 3] AS code,
    [42.195, 21.0975, 10.0][1 + n_nationkey % 3]::DOUBLE AS distance_km FROM nation
), runners AS (
  SELECT 1 AS event_id, c_custkey::VARCHAR AS bib, c_name AS full_name, c_mktsegment AS club, c_nationkey AS race_id,
    CASE WHEN c_acctbal >= 0 THEN 'finished' ELSE 'dnf' END AS status, 7200 + c_custkey % 14400 AS finish_s,
    DATE '1980-01-01' + (c_custkey % 9000)::INT AS dob FROM customer
), photos AS (
  SELECT 1 AS event_id, o_orderkey AS photo_id, 'p' || o_orderkey || '.jpg' AS file_name, o_orderdate AS captured_at,
    o_orderpriority AS photographer, o_orderstatus AS course_point,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey % 42)::DOUBLE END AS course_km FROM orders
), detections AS (
  SELECT l_orderkey AS photo_id, l_partkey::VARCHAR AS bib_text, l_discount * 10 AS confidence, l_linenumber - 1 AS rank,
    CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'review' WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'rejected' ELSE 'ocr' END AS source
  FROM lineitem
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def races(spark: SparkSession, d: str) -> DataFrame:
    at = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("n_nationkey") % 3 + 1)
    return table(spark, d, "nation").select(F.lit(1).alias("event_id"), F.col("n_nationkey").alias("race_id"), F.col("n_name").alias("name"), at("marathon", "half", "10k").alias("code"), at(42.195, 21.0975, 10.0).alias("distance_km"))


def runners(spark: SparkSession, d: str) -> DataFrame:
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    return table(spark, d, "customer").select(
        F.lit(1).alias("event_id"), F.col("c_custkey").cast("string").alias("bib"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("club"), F.col("c_nationkey").alias("race_id"),
        F.when(F.col("c_acctbal") >= 0, "finished").otherwise("dnf").alias("status"), (7200 + F.col("c_custkey") % 14400).alias("finish_s"),
        F.date_add(F.lit("1980-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")).alias("dob"),
        *none("string", "category", "nationality"), *none("int", "place_overall", "place_category"), *none("bigint", "chip_s"),
    )


def photos(spark: SparkSession, d: str) -> DataFrame:
    km = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 42).cast("double"))
    return table(spark, d, "orders").select(F.lit(1).alias("event_id"), F.col("o_orderkey").alias("photo_id"), F.concat(F.lit("p"), F.col("o_orderkey"), F.lit(".jpg")).alias("file_name"), F.col("o_orderdate").alias("captured_at"), F.col("o_orderpriority").alias("photographer"), F.col("o_orderstatus").alias("course_point"), km.alias("course_km"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    source = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "review").when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A"), "rejected").otherwise("ocr")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_partkey").cast("string").alias("bib_text"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") - 1).alias("rank"), source.alias("source"))


def events(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'open', true, true), (2, 'shut', true, false), (3, 'draft', false, true) AS t(event_id, slug, published, db_search)")
