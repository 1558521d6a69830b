"""Queries that give the rows that other queries count: what stays, what goes, and decisions with all their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import bursts as b
from stridemark.operators import evidence as ev
from stridemark.operators import merge as mg
from stridemark.operators import publishing as pub
from stridemark.sources.files import inline

from .adapters import HEAD, detections, events, photos, table
from .publishing import _taken_down
from .registry import query

GONE = "('p1.jpg', 'p2.jpg', 'p3.jpg', 'p1000.jpg', 'none.jpg')"


@query(HEAD + """
, gone AS (SELECT bib FROM runners WHERE club = 'BUILDING' UNION SELECT '1600')
SELECT 'runner' AS kind, bib, NULL::BIGINT AS photo_id, 1::BIGINT AS n FROM runners WHERE bib NOT IN (SELECT bib FROM runners WHERE club = 'BUILDING')
UNION ALL SELECT 'read', bib_text, photo_id, count(*) FROM detections WHERE bib_text NOT IN (SELECT bib FROM gone) GROUP BY ALL
""")
def takedown_rows(spark, d):
    """The runners and reads that stay after takedowns."""
    left, reads = _taken_down(spark, d)
    kept = reads.groupBy(F.col("bib_text").alias("bib"), "photo_id").agg(F.count("*").alias("n"))
    return left.select(F.lit("runner").alias("kind"), "bib", F.lit(None).cast("bigint").alias("photo_id"), F.lit(1).cast("bigint").alias("n")).unionByName(kept.select(F.lit("read").alias("kind"), "bib", "photo_id", "n"))


@query(HEAD + f"""
SELECT p.photo_id, file_name, count(bib_text) AS reads FROM photos p LEFT JOIN detections d ON d.photo_id = p.photo_id WHERE file_name NOT IN {GONE} AND file_name <> 'p7.jpg' GROUP BY ALL
""")
def excluded_rows(spark, d):
    """The photos that stay after exclusions, with their number of reads; reads of others are not among them."""
    p = photos(spark, d).withColumn("preview_path", F.lit("/media/a")).withColumn("thumb_path", F.lit(None).cast("string"))
    gone = pub.named_photos(inline(spark, ["p1.jpg", "p2.jpg", "p3.jpg", "p1000.jpg", "none.jpg"]), events(spark), p, "open")
    kept, reads = mg.delete_cascade(p, detections(spark, d), gone, "photo_id")
    kept, reads, _ = pub.take_down_photo(kept, reads, 1, "p7.jpg")
    counts = reads.groupBy("photo_id").agg(F.count("*").alias("reads"))
    return kept.select("photo_id", "file_name").join(counts, "photo_id", "left").select("photo_id", "file_name", F.coalesce("reads", F.lit(0)).alias("reads"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def children_left(spark, d):
    """The rows of children that stay when parents go."""
    orders, lines = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    gone = orders.filter("o_orderstatus = 'P'")
    return mg.delete_cascade(orders, lines, gone, "k", expected=gone.count())[1].select("k", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' || p_partkey % 7 ELSE p_partkey || '/' || p_name END AS name FROM part")
def renamed_rows(spark, d):
    named = table(spark, d, "part").withColumn("name", F.concat_ws("/", "p_partkey", "p_name"))
    names = named.filter("p_size > 25").select(F.col("name").alias("old"), F.concat(F.lit("new"), F.col("p_partkey") % 7).alias("new"))
    return mg.renamed(named.select("p_partkey", "name"), names, "name").select("p_partkey", "name")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'aside' ELSE 'kept' END AS part FROM part")
def set_aside_ids(spark, d):
    kept, aside = mg.set_aside(table(spark, d, "part"), F.col("p_size") > 40)
    return kept.select("p_partkey", F.lit("kept").alias("part")).unionByName(aside.select("p_partkey", F.lit("aside").alias("part")))


@query(HEAD + """
SELECT photo_id, bib_text AS text, confidence AS conf FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, rank, bib_text, source) AS n FROM detections) WHERE n = 1
""")
def best_read_per_photo(spark, d):
    reads = F.array_sort(F.collect_list(F.struct("rank", F.col("bib_text").alias("text"), "source", F.col("confidence").alias("conf"))))
    rows = detections(spark, d).groupBy("photo_id").agg(ev.best_read(reads).alias("r"))
    return rows.select("photo_id", "r.text", "r.conf")


@query(HEAD + """
, seen AS (SELECT photo_id, list(DISTINCT bib_text) AS found FROM detections WHERE confidence >= 0.5 GROUP BY photo_id),
told AS (SELECT photo_id, list(DISTINCT bib_text) AS bibs FROM detections WHERE source = 'review' OR confidence > 0.85 GROUP BY photo_id)
SELECT p.photo_id, CASE WHEN bibs IS NULL THEN 'background' WHEN len(list_filter(bibs, lambda x: NOT list_contains(coalesce(found, []), x))) = 0 THEN 'full' ELSE 'partial' END AS kind
FROM photos p LEFT JOIN seen s ON s.photo_id = p.photo_id LEFT JOIN told t ON t.photo_id = p.photo_id
""")
def kinds_of_labels(spark, d):
    x = detections(spark, d)
    listed = lambda rows, name: rows.groupBy("photo_id").agg(F.collect_set("bib_text").alias(name))
    rows = photos(spark, d).select("photo_id").join(listed(x.filter("confidence >= 0.5"), "found"), "photo_id", "left").join(listed(x.filter("source = 'review' OR confidence > 0.85"), "bibs"), "photo_id", "left")
    return ev.label_kinds(rows.select("photo_id", *[F.coalesce(c, ev.nothing()).alias(c) for c in ("found", "bibs")])).select("photo_id", "kind")


@query(HEAD + """
SELECT photo_id, count(*) FILTER (source = 'rejected') AS disagree, count(*) FILTER (confidence < 0.2) AS human, row_number() OVER (ORDER BY count(*) FILTER (source = 'rejected') DESC, count(*) FILTER (confidence < 0.2) DESC, photo_id) AS place
FROM detections GROUP BY photo_id
""")
def review_priorities(spark, d):
    from stridemark.operators.windows import places_of_all

    person = F.struct(F.when(F.col("source") == "rejected", "disagree").otherwise("agree").alias("verdict"))
    rows = ev.priority(detections(spark, d).groupBy("photo_id").agg(F.collect_list(person).alias("persons"), F.count_if(F.col("confidence") < 0.2).alias("needs_human")))
    keyed = rows.select("photo_id", F.col("priority.disagree").cast("bigint").alias("disagree"), F.col("priority.human").cast("bigint").alias("human"))
    return places_of_all(keyed.withColumn("last", F.struct(-F.col("disagree"), -F.col("human"))), ["last", "photo_id"]).drop("last")


#: A photo's reads in order: two looks, the close-up, the judge's. Numbers are few, so that readings often agree.
READS = """
WITH l AS (
  SELECT l_orderkey AS photo, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
    CASE WHEN l_suppkey % 13 = 0 THEN '' WHEN l_suppkey % 5 = 0 THEN (l_partkey % 2 + 10) || '?' ELSE (l_partkey % 2 + 100)::VARCHAR END AS number,
    CASE WHEN l_tax < 0.04 THEN 'clear' WHEN l_tax > 0.065 THEN 'unreadable' ELSE 'partial' END AS legibility, CASE WHEN l_discount < 0.07 THEN 'none' ELSE 'left' END AS cut, l_suppkey % 4 <> 0 AS is_bib FROM lineitem
), r AS (
  SELECT *, CASE i WHEN 3 THEN 'zoom' WHEN 4 THEN 'judge' ELSE 'survey' END AS source, CASE WHEN is_bib AND legibility <> 'unreadable' AND number <> '' AND NOT contains(number, '?') AND (cut = 'none' OR legibility = 'clear') THEN number END AS f FROM l WHERE i <= 4
), p AS (
  SELECT photo, coalesce(list(f ORDER BY i) FILTER (f IS NOT NULL), []) AS given, coalesce(list(f ORDER BY i) FILTER (f IS NOT NULL AND i <= 3), []) AS earlier,
    coalesce(list_distinct(list(f) FILTER (f IS NOT NULL AND i <= 2)), []) AS others, coalesce(list(f) FILTER (f IS NOT NULL AND i <= 2 AND legibility = 'clear' AND cut = 'none'), []) AS sure,
    max(i) >= 3 AS zoomed, bool_or(is_bib) FILTER (i = 3) AS zbib, max(f) FILTER (i = 3) AS zf, coalesce(bool_or(f IS NOT NULL AND legibility = 'clear' AND cut = 'none') FILTER (i = 3), false) AS zclear,
    max(i) >= 4 AS judged, bool_or(is_bib) FILTER (i = 4) AS jbib, max(f) FILTER (i = 4) AS jf, coalesce(bool_or(legibility = 'clear') FILTER (i = 4), false) AS jclear,
    coalesce(arg_min(number, {'o': CASE source WHEN 'judge' THEN 0 WHEN 'zoom' THEN 1 ELSE 2 END, 'd': -length(replace(number, '?', '')), 'i': i}) FILTER (is_bib AND number <> '' AND legibility <> 'unreadable'), '') AS pattern
  FROM r GROUP BY photo
), v AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(given), lambda n: {'c': -len(list_filter(given, lambda x: x = n)), 'p': list_position(given, n), 'n': n})), lambda x: x.n) AS votes,
    coalesce(list_max(list_transform(list_distinct(sure), lambda n: len(list_filter(sure, lambda x: x = n)))), 0) AS top FROM p
), c AS (
  SELECT *, CASE WHEN zoomed AND NOT zbib AND NOT coalesce(jbib, false) AND top < 2 THEN 'not a bib'
    WHEN judged AND NOT jbib THEN 'judge: not a bib' WHEN judged AND jf IS NOT NULL AND (jclear OR list_contains(earlier, jf)) THEN 'judge' WHEN judged THEN 'judge unsure'
    WHEN zf IS NOT NULL AND zclear AND len(list_filter(others, lambda x: x <> zf)) = 0 THEN CASE WHEN len(others) > 0 THEN 'zoom clear, agreed' ELSE 'zoom clear' END
    WHEN zf IS NOT NULL AND list_contains(others, zf) AND len(others) = 1 THEN 'two readings agree' WHEN len(votes) > 0 THEN 'ask' WHEN length(replace(pattern, '?', '')) >= 1 THEN 'digits hidden' ELSE 'unreadable' END AS k FROM v
)
SELECT photo, CASE WHEN k IN ('not a bib', 'judge: not a bib', 'unreadable') THEN 'drop' WHEN k IN ('judge unsure', 'digits hidden') THEN 'review' WHEN k = 'ask' THEN 'judge' ELSE 'accept' END AS status,
  CASE WHEN k = 'judge' THEN jf WHEN k IN ('zoom clear, agreed', 'zoom clear', 'two readings agree') THEN zf END AS number, CASE WHEN k IN ('judge', 'zoom clear, agreed', 'zoom clear', 'two readings agree') THEN k END AS how,
  CASE k WHEN 'ask' THEN array_to_string(votes, ',') WHEN 'digits hidden' THEN '' WHEN 'judge unsure' THEN array_to_string(list_concat(CASE WHEN jf IS NULL THEN [] ELSE [jf] END, list_filter(votes, lambda n: n IS DISTINCT FROM jf)), ',') ELSE '-' END AS candidates,
  CASE WHEN k IN ('judge unsure', 'digits hidden') THEN pattern ELSE '-' END AS pattern, CASE WHEN k IN ('not a bib', 'judge: not a bib', 'unreadable', 'judge unsure', 'digits hidden') THEN k END AS why
FROM c
"""


@query(READS)
def judged_decisions(spark, d):
    """Every decision with all its fields, from two looks, a close-up and a judge."""
    n, hidden = F.col("l_partkey") % 2, F.col("l_suppkey") % 5 == 0
    number = F.when(F.col("l_suppkey") % 13 == 0, "").when(hidden, F.concat(n + 10, F.lit("?"))).otherwise((n + 100).cast("string"))
    legible = F.when(F.col("l_tax") < 0.04, "clear").when(F.col("l_tax") > 0.065, "unreadable").otherwise("partial")
    read = F.struct(F.lit("survey").alias("source"), number.alias("number"), legible.alias("legibility"), F.when(F.col("l_discount") < 0.07, "none").otherwise("left").alias("cut"), (F.col("l_suppkey") % 4 != 0).alias("is_bib"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), read.alias("r")))).alias("l"))
    rows = rows.select("photo", F.transform("l", lambda x: x["r"]).cast(f"array<{b.READ}>").alias("reads"))
    one = lambda k, name: F.when(F.size("reads") >= k, F.get("reads", F.lit(k - 1)).withField("source", F.lit(name)))
    e = rows.select("photo", b.decide(F.slice("reads", 1, 2), one(3, "zoom"), one(4, "judge")).alias("d"))
    return e.select("photo", "d.status", "d.number", "d.how", F.coalesce(F.array_join("d.candidates", ","), F.lit("-")).alias("candidates"), F.coalesce("d.pattern", F.lit("-")).alias("pattern"), "d.why")
