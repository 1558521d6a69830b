"""Queries on changes: logs, galleries kept up to date, versions, and the SQL surface over what is published."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import catalog
from stridemark.operators import matching as m
from stridemark.operators import merge as mg
from stridemark.operators import refresh as rf
from stridemark.sources import files, logs
from stridemark.sources.sinks import scratch, staged

from .adapters import HEAD, detections, events, photos, races, runners, table
from .matching import ASKED, REASONS, TOLD, _asked, _told
from .registry import query


@query("""
SELECT o_custkey AS custkey, max(o_orderkey % 6)::BIGINT AS part, max(o_orderkey) FILTER (o_orderkey % 6 = most) AS orderkey
FROM (SELECT *, max(o_orderkey % 6) OVER (PARTITION BY o_custkey) AS most FROM orders) GROUP BY ALL
""")
def log_of_six_appends(spark, d):
    """The last row of each key of a log that grew by six appends."""
    path = scratch(spark, "log")
    for n in range(6):
        rows = table(spark, d, "orders").filter(F.col("o_orderkey") % 6 == n).groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_orderkey").alias("orderkey"))
        logs.append(rows.select("custkey", F.lit(n).alias("part"), "orderkey"), path)
    return mg.latest(files.append_log(spark, path, "custkey bigint, part int, orderkey bigint"), "custkey", "seq").select("custkey", F.col("part").cast("bigint").alias("part"), "orderkey")


@query("SELECT o_custkey AS custkey, count(*) AS rows, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 3 = 2 GROUP BY ALL")
def log_from_a_position(spark, d):
    """What a log has gained since it was read last."""
    path = scratch(spark, "log")
    part = lambda n: table(spark, d, "orders").filter(F.col("o_orderkey") % 3 == n).select("o_custkey", "o_orderkey")
    logs.append(part(0), path)
    logs.append(part(1), path)
    seen = logs.position(spark, path)
    logs.append(part(2), path)
    rows = logs.read_log(spark, path, "o_custkey bigint, o_orderkey bigint", seen)
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("last"))


@query("SELECT o_orderstatus AS status, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def versions_of_two_writers(spark, d):
    """A table that two writers change, each by its own rows, from the same version on."""
    folder, rows = scratch(spark, "versions"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    mg.change_version(spark, folder, lambda old: rows.limit(0))
    odd = F.col("o_orderkey") % 2 == 1

    def late(old):
        if len(mg.versions(spark, folder)) == 1:  # the other one is through before this one has written
            mg.change_version(spark, folder, lambda now: now.unionByName(rows.filter(odd)))
        return old.unionByName(rows.filter(~odd))

    mg.change_version(spark, folder, late)
    return mg.read_version(spark, folder).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


def _before(spark, d):
    """The tables before odd photos were read again: their reads have another text, and one runner in 50 isn't there yet."""
    odd = F.col("photo_id") % 2 == 1
    reads = detections(spark, d).withColumn("bib_text", F.when(odd, F.concat(F.lit("9"), "bib_text", F.lit("99"))).otherwise(F.col("bib_text")))
    return rf.Tables(runners(spark, d).filter(F.col("bib").cast("bigint") % 50 != 7), races(spark, d), photos(spark, d), reads)


#: A bib is concerned if it is new, a text of an odd photo is the bib or near it, or a new bib is near it.
CONCERNED = """
, old AS (SELECT bib FROM runners WHERE bib::BIGINT % 50 <> 7),
came AS (SELECT bib FROM runners WHERE bib::BIGINT % 50 = 7),
odd AS (
  SELECT text, max((source NOT IN ('review', 'manual') AND confidence >= 0.30)::INT) AS nearly
  FROM (SELECT source, confidence, unnest([bib_text, '9' || bib_text || '99']) AS text FROM detections WHERE photo_id % 2 = 1 AND source <> 'rejected' AND photo_id IN (SELECT photo_id FROM photos)) GROUP BY text
), near AS (
  SELECT text FROM odd WHERE nearly = 1 AND text NOT IN (SELECT bib FROM old) UNION SELECT bib FROM came
), concerned AS (
  SELECT bib FROM came UNION SELECT text FROM odd WHERE text IN (SELECT bib FROM runners)
  UNION SELECT r.bib FROM runners r JOIN near n ON length(r.bib) >= 3 AND r.bib <> n.text AND abs(length(r.bib) - length(n.text)) <= 1 AND levenshtein(r.bib, n.text) <= 1
)
"""


@query(TOLD + CONCERNED.replace("near AS", "near_texts AS").replace("JOIN near n", "JOIN near_texts n") + "SELECT p.*, p.bib IN (SELECT bib FROM concerned) AS remade FROM payloads p")
def galleries_after_a_change(spark, d):
    """All payloads after a change of odd photos and some runners, and which of them the change has remade."""
    before, after = _before(spark, d), rf.Tables(runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d))
    old = staged(m.export(before.runners, before.races, before.photos, before.detections), "payloads")
    bibs = staged(rf.concerned(before, after, photos(spark, d).filter("photo_id % 2 = 1").select("photo_id")), "bibs")
    now, _, _ = rf.refresh(old.withColumn("remade", F.lit(False)), after, bibs)
    return _told(now, "bib", F.coalesce("remade", F.lit(True)).alias("remade"))


@query(HEAD + CONCERNED.replace("near AS", "near_texts AS").replace("JOIN near n", "JOIN near_texts n") + "SELECT bib FROM concerned")
def concerned_bibs(spark, d):
    """The same bibs, found by comparing the tables."""
    after = rf.Tables(runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d))
    return rf.concerned(_before(spark, d), after).select("bib")


def _registered(spark, d):
    tables = runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d)
    catalog.write_galleries_table(m.export(*tables), events(spark), tables[0], path := scratch(spark, "galleries"))
    catalog.register(spark, events(spark), tables[1], spark.read.parquet(path))


@query(TOLD + "SELECT * FROM payloads WHERE bib > '1200' ORDER BY bib LIMIT 100")
def sql_export_event(spark, d):
    _registered(spark, d)
    return _told(spark.sql("SELECT * FROM export_event('open', '1200', 100)"), "bib")


@query(TOLD + ASKED + f"""
SELECT q.slug, q.bib, q.reason, p.name, coalesce(p.n_photos, 0) AS n_photos, coalesce(p.photos, '') AS photos FROM ({REASONS}) q LEFT JOIN payloads p ON p.bib = q.bib AND q.reason = 'ok'
""")
def sql_find_runner(spark, d):
    _registered(spark, d)
    _asked(spark, d).createOrReplaceTempView("stridemark_asked")
    rows = spark.sql("SELECT slug, bib, find_runner(slug, bib, dob, caller_role) AS payload FROM stridemark_asked")
    told = _told(rows, "slug", "bib", F.coalesce("x.reason", F.lit("ok")).alias("reason"))
    return told.select("slug", "bib", "reason", "name", F.when(F.col("reason") == "ok", F.col("n_photos")).otherwise(0).alias("n_photos"), F.when(F.col("reason") == "ok", F.col("photos")).otherwise("").alias("photos"))


@query(HEAD + """
SELECT slug, code, count(*) AS races, min((7200 // 3600) || ':' || lpad((7200 // 60 % 60)::VARCHAR, 2, '0') || ':00') AS clock,
  min((round(12257 / distance_km)::BIGINT // 60 % 60) || ':' || lpad((round(12257 / distance_km)::BIGINT % 60)::VARCHAR, 2, '0')) AS pace
FROM races JOIN (VALUES (1, 'open'), (2, 'shut')) e(event_id, slug) USING (event_id) GROUP BY ALL
""")
def sql_public_views(spark, d):
    """What the views show, of published events, and what the functions say of it. No gallery is asked for or made."""
    catalog.register_views(spark, events(spark), races(spark, d))
    return spark.sql("SELECT slug, code, count(*) AS races, min(runner_clock(7200)) AS clock, min(runner_pace(12257, distance_km)) AS pace FROM public_races JOIN public_events USING (event_id) GROUP BY slug, code")
