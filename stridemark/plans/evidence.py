"""Queries on evidence of several readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import bursts as b
from stridemark.operators import evidence as ev

from stridemark.sources.sinks import staged

from .adapters import HEAD, detections, photos, runners, table
from .registry import query


def _hits(spark, d):
    """One hit for each number of a photo: its best line."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_partkey").alias("p")).agg(F.max("l_discount").alias("disc"), F.min("l_linenumber").alias("pos"))
    box = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 10), ("y1", 10))])
    return rows.select("photo", "pos", F.col("p").cast("string").alias("text"), (F.col("disc") * 10).alias("conf"), box.alias("box"))


def _second(spark, d):
    """What the second reader saw: some numbers of a photo; every ninth photo failed, every fifth was not asked."""
    rows = table(spark, d, "lineitem").filter("l_linenumber % 2 = 0 AND l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("photo")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("numbers"))
    clarity = F.map_from_arrays("numbers", F.transform("numbers", lambda n: F.when(n.cast("bigint") % 3 == 0, "partial").otherwise("clear")))
    return rows.select("photo", "numbers", clarity.alias("clarity"), F.when(F.col("photo") % 9 == 0, "down").alias("error"))


SECOND = """
WITH hits AS (SELECT l_orderkey AS photo, l_partkey AS p, max(l_discount) * 10 AS conf, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
told AS (SELECT DISTINCT l_orderkey AS photo, l_partkey AS p FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey % 5 <> 0),
asked AS (SELECT DISTINCT photo, photo % 9 = 0 AS bad FROM told),
best AS (SELECT photo, p, conf FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY conf DESC, pos, p::VARCHAR) AS n FROM hits) WHERE n = 1)
"""


@query(SECOND + """
, agreed AS (SELECT photo, count(*) AS n, bool_and(t.p % 3 <> 0) AS clear FROM told t JOIN hits USING (photo, p) GROUP BY photo)
SELECT b.photo, CASE WHEN conf >= 0.8 THEN 'confident' WHEN a.photo IS NULL THEN 'model_only' WHEN bad THEN 'error' WHEN g.n > 0 THEN 'agree' ELSE 'disagree' END AS kind,
  CASE WHEN conf >= 0.8 THEN false WHEN a.photo IS NULL THEN true WHEN bad THEN true WHEN g.n > 0 THEN NOT clear ELSE true END AS needs_human
FROM best b LEFT JOIN asked a USING (photo) LEFT JOIN agreed g USING (photo)
""")
def verdicts(spark, d):
    reads = _hits(spark, d).groupBy("photo").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "conf"))), lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"))).alias("reads"))
    second = _second(spark, d).select("photo", F.struct("numbers", "clarity", "error").alias("second"))
    return reads.join(second, "photo", "left").select("photo", ev.judge(F.col("reads"), F.col("second")).alias("v")).select("photo", "v.kind", "v.needs_human")


#: persons as (part, c, pl, number, gives, needs, unsure, verdict) to one row a photo.
PERSONS = """
SELECT photo, coalesce(string_agg(gives, ',' ORDER BY part, c, pl, number) FILTER (gives IS NOT NULL AND nth = 1), '') AS numbers, count(*) FILTER (needs)::BIGINT AS needs_human,
  string_agg(concat_ws(':', number, verdict, CASE WHEN unsure THEN 'unsure' END, CASE WHEN needs THEN 'human' END), '|' ORDER BY part, c, pl, number) AS persons
FROM (SELECT *, row_number() OVER (PARTITION BY photo, gives ORDER BY part, c, pl, number) AS nth FROM persons) GROUP BY photo
"""


def _persons(rows):
    told = F.transform("persons", lambda x: F.concat_ws(":", x["number"], x["verdict"], F.when(x["unsure"], "unsure"), F.when(x["needs_human"], "human")))
    return rows.select("photo", F.array_join("numbers", ",").alias("numbers"), F.col("needs_human").cast("bigint").alias("needs_human"), F.array_join(told, "|").alias("persons"))


@query(SECOND + """
, h AS (SELECT h.*, length(p::VARCHAR) BETWEEN 3 AND 4 AS r, a.photo IS NOT NULL AND NOT bad AS ok, t.p IS NOT NULL AS told FROM hits h LEFT JOIN asked a USING (photo) LEFT JOIN told t USING (photo, p) WHERE p > 0),
v AS (SELECT *, r AND CASE WHEN ok THEN told OR conf >= 0.9 ELSE conf >= 0.5 END AS take FROM h WHERE conf >= 0.1),
persons AS (
  SELECT photo, 0 AS part, -conf AS c, pos::VARCHAR AS pl, p::VARCHAR AS number, CASE WHEN take THEN p::VARCHAR END AS gives, r AND NOT take AND conf >= CASE WHEN ok THEN 0.6 ELSE 0.3 END AS needs, NOT take AS unsure,
    CASE WHEN ok AND r AND told THEN 'agree' WHEN take THEN 'confident' ELSE 'model_only' END AS verdict FROM v
  UNION ALL
  SELECT t.photo, 1, 0, t.p::VARCHAR, t.p::VARCHAR, CASE WHEN t.p % 3 <> 0 THEN t.p::VARCHAR END, false, t.p % 3 = 0, 'whole_only' FROM told t JOIN asked a USING (photo)
  WHERE NOT bad AND length(t.p::VARCHAR) BETWEEN 3 AND 4 AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.photo = t.photo AND x.p = t.p)
)
""" + PERSONS)
def evidence_merge(spark, d):
    return _persons(ev.suggestions(_hits(spark, d), _second(spark, d)))


def _rechecked(spark, d):
    """Hits in boxes of their own, a second look at those of odd lines, and what tiles showed."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_partkey").alias("p")).agg(F.max("l_discount").alias("disc"), F.min("l_linenumber").alias("pos"))
    x = (F.col("pos") * 1_000_000 + F.col("p")).cast("double")
    box = F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 9).alias("x1"), F.lit(10.0).alias("y1"))
    hits = rows.select("photo", "pos", F.col("p").cast("string").alias("text"), (F.col("disc") * 10).alias("conf"), box.alias("box"))
    p = F.col("p")
    n = F.when(p % 4 == 0, p + 1).otherwise(p).cast("string")
    local = F.array(F.struct(F.when(p % 5 == 0, p.cast("string")).otherwise(n).alias("text"), F.when(p % 7 == 0, 0.4).otherwise(0.85).alias("conf")))
    again = rows.filter("pos % 2 = 1").select("photo", F.concat_ws(",", x.cast("bigint"), F.lit(0), (x + 9).cast("bigint"), F.lit(10)).alias("key"), F.array(n).alias("numbers"), F.create_map(n, F.when(p % 3 == 0, "partial").otherwise("clear")).alias("clarity"), local.alias("local"))
    more = (p + 2).cast("string")
    tiles = rows.filter("pos = 3").groupBy("photo").agg(F.array_sort(F.collect_set(more)).alias("numbers")).withColumn("clarity", F.map_from_arrays("numbers", F.transform("numbers", lambda t: F.when(t.cast("bigint") % 5 == 0, "partial").otherwise("clear"))))
    return hits, again, tiles


@query(SECOND + """
, start AS (SELECT c_custkey AS p FROM customer),
h AS (SELECT h.*, s.p IS NOT NULL AS r, a.photo IS NOT NULL AND NOT bad AS ok, t.p IS NOT NULL AS told FROM hits h LEFT JOIN start s ON s.p = h.p LEFT JOIN asked a USING (photo) LEFT JOIN told t ON t.photo = h.photo AND t.p = h.p WHERE h.p > 0 AND conf >= 0.1),
v AS (SELECT *, r AND CASE WHEN ok THEN coalesce(told AND r, false) OR conf >= 0.9 ELSE conf >= 0.5 END AS take FROM h),
k AS (SELECT *, r AND NOT take AND conf >= CASE WHEN ok THEN 0.6 ELSE 0.3 END AS doubt, CASE WHEN p % 4 = 0 THEN p + 1 ELSE p END AS n FROM v),
l AS (SELECT k.*, pos % 2 = 1 AS looked, s.p IS NOT NULL AND k.p % 3 <> 0 AS clear, s.p IS NOT NULL AND k.p % 3 = 0 AS part, CASE WHEN k.p % 5 = 0 THEN k.p ELSE n END AS near, CASE WHEN k.p % 7 = 0 THEN 0.4 ELSE 0.85 END AS sure FROM k LEFT JOIN start s ON s.p = k.n),
m AS (SELECT *, doubt AND looked AND ((clear AND n = p) OR (part AND n = p AND near = p AND sure >= 0.8)) AS agrees FROM l),
q AS (SELECT *, doubt AND looked AND NOT agrees AND clear AND near = n AND sure >= 0.5 AS other FROM m),
own AS (
  SELECT photo, 0 AS part, -conf AS c, pos::VARCHAR AS pl, p::VARCHAR AS number, CASE WHEN other THEN n::VARCHAR WHEN take OR agrees THEN p::VARCHAR END AS gives, doubt AND NOT agrees AND NOT other AS needs, NOT (take OR agrees) AS unsure,
    CASE WHEN agrees THEN 'agree' WHEN other THEN 'replaced' WHEN ok AND r AND told THEN 'agree' WHEN take THEN 'confident' ELSE 'model_only' END AS verdict FROM q
), seen AS (SELECT t.photo, t.p, t.p % 3 <> 0 AS clear FROM told t JOIN asked a USING (photo) JOIN start s ON s.p = t.p WHERE NOT bad),
wide AS (SELECT DISTINCT photo, h.p + 2 AS p FROM hits h JOIN start s ON s.p = h.p + 2 WHERE pos = 3 AND (h.p + 2) % 5 <> 0),
extra AS (
  SELECT s.photo, s.p, 1 AS part, s.clear OR w.p IS NOT NULL AS clear FROM seen s LEFT JOIN wide w ON w.photo = s.photo AND w.p = s.p
  UNION ALL SELECT w.photo, w.p, 2, true FROM wide w WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.photo = w.photo AND s.p = w.p)
), persons AS (
  SELECT * FROM own UNION ALL
  SELECT e.photo, e.part, 0, e.p::VARCHAR, e.p::VARCHAR, CASE WHEN clear THEN e.p::VARCHAR END, false, NOT clear, 'whole_only' FROM extra e
  WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.photo = e.photo AND x.p = e.p AND x.p > 0) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.photo = e.photo AND o.verdict = 'replaced' AND o.gives = e.p::VARCHAR)
)
""" + PERSONS)
def evidence_recheck(spark, d):
    """With a start list, second looks at boxes in doubt, and tiles."""
    hits, again, tiles = _rechecked(spark, d)
    start = runners(spark, d).select(F.col("bib").alias("number"))
    return _persons(ev.suggestions(hits, _second(spark, d), start, again, tiles))


@query(SECOND + """
, h AS (SELECT h.*, length(p::VARCHAR) BETWEEN 3 AND 4 AS r, a.photo IS NOT NULL AND NOT bad AS ok, t.p IS NOT NULL AS told FROM hits h LEFT JOIN asked a USING (photo) LEFT JOIN told t USING (photo, p) WHERE p > 0 AND conf >= 0.1),
w AS (SELECT photo, count(*) AS n FROM h WHERE r AND NOT CASE WHEN ok THEN told OR conf >= 0.9 ELSE conf >= 0.5 END AND conf >= CASE WHEN ok THEN 0.6 ELSE 0.3 END GROUP BY photo)
SELECT photo, n AS in_doubt FROM w
""")
def doubtful_photos(spark, d):
    rows = ev.doubts(ev.suggestions(_hits(spark, d), _second(spark, d)))
    return rows.filter(F.size("in_doubt") > 0).select("photo", F.size("in_doubt").cast("bigint").alias("in_doubt"))


def _bundle(spark, d):
    p = photos(spark, d)
    n = F.col("photo_id")
    return p.select("file_name", F.when(n % 3 == 0, "").otherwise(F.concat_ws(", ", n % 900, n % 77, n % 900)).alias("bibs"), F.array((n % 900).cast("string"), (n % 50).cast("string"), (n % 9).cast("string")).alias("model_numbers"), (n % 2 == 0).alias("reviewed"))


@query(HEAD + """
, c AS (SELECT DISTINCT file_name, photo_id, unnest([photo_id % 900, photo_id % 77])::VARCHAR AS bib FROM photos WHERE photo_id % 3 <> 0),
m AS (SELECT DISTINCT file_name, photo_id, unnest([photo_id % 900, photo_id % 50, photo_id % 9])::VARCHAR AS bib FROM photos)
SELECT file_name, bib AS bib_text, 1.0::DOUBLE AS confidence, 0 AS rank, 'review' AS source FROM c
UNION ALL SELECT file_name, bib, 0.35, 1, CASE WHEN photo_id % 2 = 0 AND photo_id % 3 = 0 THEN 'rejected' ELSE 'ocr' END FROM m WHERE length(bib) >= 2 AND NOT EXISTS (SELECT 1 FROM c WHERE c.file_name = m.file_name AND c.bib = m.bib)
""")
def import_reads(spark, d):
    return ev.imported_reads(_bundle(spark, d))


@query(HEAD + """
SELECT photo_id AS photo, CASE WHEN photo_id % 4 = 0 THEN '' ELSE 's' || photo_id END AS numbers, photo_id % 4 = 0 AS reviewed FROM photos WHERE photo_id % 4 = 0 OR photo_id % 3 = 0
""")
def human_over_model(spark, d):
    p = photos(spark, d).select(F.col("photo_id").alias("photo"))
    reviews = p.filter("photo % 4 = 0").select("photo", ev.nothing().alias("numbers"))
    rows = ev.published(p, reviews, p.filter("photo % 3 = 0").select("photo", F.array(F.concat(F.lit("s"), "photo")).alias("numbers")))
    return rows.withColumn("numbers", F.array_join("numbers", ", "))


def _cascade(spark, d):
    n = F.col("o_orderkey")
    read = lambda *pairs: F.array(*[F.struct(t.cast("string").alias("text"), F.lit(c).alias("conf")) for t, c in pairs])
    first = F.when(n % 2 == 0, read((n % 100, 0.9), (n % 7, 0.2))).otherwise(read((n % 100, 0.3), (n % 7, 0.2)))
    second = F.when(n % 3 == 0, F.lit(None).cast(ev.READS)).when(n % 3 == 1, F.array().cast(ev.READS)).otherwise(read((n % 7, 0.95), (n % 5 + 200, 0.1)))
    return table(spark, d, "orders").select(n.alias("id"), first.alias("first"), second.alias("second"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 2 THEN (o_orderkey % 7) || ',' || (o_orderkey % 5 + 200) || CASE WHEN o_orderkey % 100 <> o_orderkey % 7 THEN ',' || (o_orderkey % 100) ELSE '' END ELSE (o_orderkey % 100) || ',' || (o_orderkey % 7) END AS reads FROM orders")
def cascade_merge(spark, d):
    return _cascade(spark, d).select("id", F.array_join(F.transform(ev.cascade(F.col("first"), F.col("second"), 0.5), lambda r: r["text"]), ",").alias("reads"))


@query("SELECT count(*) AS total, count(*) FILTER (k % 2 = 1) AS deferred, count(*) FILTER (k % 2 = 1 AND k % 3 = 0) AS failed, count(*) FILTER (k % 2 = 1 AND k % 3 = 2 AND k % 7 <> k % 100) AS improved FROM (SELECT o_orderkey AS k FROM orders)")
def cascade_counters(spark, d):
    return ev.cascade_counts(_cascade(spark, d), "first", "second", 0.5)


@query(HEAD + "SELECT photo_id, bib_text AS number, confidence AS conf FROM (SELECT photo_id, ltrim(bib_text, '0') AS bib_text, confidence, row_number() OVER (PARTITION BY photo_id, ltrim(bib_text, '0') ORDER BY confidence DESC, rank) AS n FROM detections WHERE ltrim(bib_text, '0') <> '') WHERE n = 1")
def best_hit_per_number(spark, d):
    hits = detections(spark, d).select("photo_id", F.col("rank").alias("pos"), F.col("bib_text").alias("text"), F.col("confidence").alias("conf"))
    return ev.best_hits(hits, "photo_id").select("photo_id", "number", "conf")


@query("SELECT l_orderkey AS photo, count(DISTINCT l_partkey)::INT AS numbers, count(DISTINCT l_partkey) FILTER (l_tax < 0.04)::INT AS clear FROM lineitem GROUP BY l_orderkey")
def tile_fold(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("number"), (F.col("l_tax") < 0.04).alias("clear"))
    return ev.fold_tiles(rows, "photo").select("photo", F.size("numbers").alias("numbers"), F.size(F.map_filter("clarity", lambda k, v: v == "clear")).alias("clear"))


def _reads(spark, d):
    """Looks at bibs: a line's number, with every seventh's last digit hidden and legibility and cut by line."""
    n = F.col("l_partkey").cast("string")
    number = F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("?"))).otherwise(n)
    x, y = (F.col("l_linenumber") * 300).cast("double"), (F.col("l_suppkey") % 3 * 40 + 600).cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("photo"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 80).alias("y1"), F.when(F.col("l_returnflag") == "N", "tile1").otherwise("survey").alias("source"),
        number.alias("number"), F.when(F.col("l_tax") < 0.05, "clear").otherwise("partial").alias("legibility"), F.when(F.col("l_discount") < 0.05, "none").otherwise("left").alias("cut"), F.lit(True).alias("is_bib"),
    )


LOOKS = """
WITH RECURSIVE looks AS (
  SELECT l_orderkey AS photo, l_linenumber * 300.0::DOUBLE AS x0, l_suppkey % 3 * 40.0::DOUBLE + 600 AS y0, CASE WHEN l_returnflag = 'N' THEN 'tile1' ELSE 'survey' END AS source,
    CASE WHEN l_suppkey % 7 = 0 THEN left(l_partkey::VARCHAR, length(l_partkey::VARCHAR)::INT - 1) || '?' ELSE l_partkey::VARCHAR END AS number,
    CASE WHEN l_tax < 0.05 THEN 'clear' ELSE 'partial' END AS legibility, CASE WHEN l_discount < 0.05 THEN 'none' ELSE 'left' END AS cut, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
), placed AS (
  SELECT *, x0 + 120 AS x1, y0 + 80 AS y1, row_number() OVER (PARTITION BY photo ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, source, number, legibility, cut)::INT AS i FROM looks
), same AS (
  SELECT a.photo, a.i, list(b.i) AS js FROM placed a JOIN placed b ON a.photo = b.photo AND b.i < a.i
  WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / (2 * 9600 - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) >= 0.25
    OR ((a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1) GROUP BY ALL
), steps AS (SELECT p.photo, p.i, coalesce(js, []::INT[]) AS js FROM placed p LEFT JOIN same s ON s.photo = p.photo AND s.i = p.i),
grown AS (
  SELECT photo, 0 AS i, []::INT[] AS g FROM (SELECT DISTINCT photo FROM placed)
  UNION ALL
  SELECT r.photo, s.i, list_append(r.g, coalesce(list_min(list_transform(s.js, lambda j: r.g[j])), coalesce(list_max(r.g), 0) + 1)::INT) FROM grown r JOIN steps s ON s.photo = r.photo AND s.i = r.i + 1
), grouped AS (
  SELECT p.*, r.g[p.i] AS grp FROM placed p JOIN (SELECT photo, g FROM grown QUALIFY i = max(i) OVER (PARTITION BY photo)) r USING (photo)
), best AS (
  SELECT photo, grp, x0, y0, x1, y1, cut FROM grouped QUALIFY row_number() OVER (PARTITION BY photo, grp ORDER BY legibility = 'clear' DESC, cut = 'none' DESC, source <> 'survey' DESC, i) = 1
), hull AS (
  SELECT photo, grp, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1, list({'number': number, 'legibility': legibility, 'cut': cut} ORDER BY i) AS reads FROM grouped GROUP BY ALL
), clusters AS (
  SELECT photo, CASE WHEN cut = 'none' THEN x0 ELSE hx0 END AS x0, CASE WHEN cut = 'none' THEN y0 ELSE hy0 END AS y0, CASE WHEN cut = 'none' THEN x1 ELSE hx1 END AS x1, CASE WHEN cut = 'none' THEN y1 ELSE hy1 END AS y1, reads FROM best JOIN hull USING (photo, grp)
)
"""
#: A decision from its reads, the second of which is the close-up; there is no judge.
DECIDED = LOOKS + """
, full_reads AS (
  SELECT *, list_transform(reads, lambda r: CASE WHEN r.number <> '' AND NOT contains(r.number, '?') AND (r.cut = 'none' OR r.legibility = 'clear') THEN r.number END) AS f FROM clusters
), asked AS (
  SELECT *, CASE WHEN len(reads) > 1 THEN f[2] END AS zf, len(reads) > 1 AND reads[2].legibility = 'clear' AND reads[2].cut = 'none' AS zclear, list_filter(f, lambda x: x IS NOT NULL) AS fulls FROM full_reads
), voted AS (
  SELECT *, list_distinct(fulls) AS others, CASE WHEN zf IS NOT NULL THEN list_append(fulls, zf) ELSE fulls END AS given FROM asked
), counted AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(given), lambda n: {'c': -len(list_filter(given, lambda x: x = n)), 'p': list_position(given, n), 'n': n})), lambda x: x.n) AS votes,
    CASE WHEN len(reads) > 1 THEN reads[2].number ELSE (list_sort(list_transform(range(1, len(reads) + 1), lambda i: {'d': -length(replace(reads[i].number, '?', '')), 'i': i, 'n': reads[i].number})))[1].n END AS pattern FROM voted
), decided AS (
  SELECT photo, x0, y0, votes, CASE WHEN zf IS NOT NULL AND ((zclear AND len(others) = 1) OR len(others) = 1) THEN 'accept' WHEN len(votes) > 0 THEN 'judge' WHEN length(replace(pattern, '?', '')) >= 1 THEN 'review' ELSE 'drop' END AS status,
    CASE WHEN zf IS NOT NULL AND len(others) = 1 THEN zf END AS number, CASE WHEN zf IS NOT NULL AND len(others) = 1 THEN CASE WHEN zclear THEN 'zoom clear, agreed' ELSE 'two readings agree' END END AS how, pattern FROM counted
)
"""


@query(LOOKS + "SELECT photo, x0, y0, x1, y1, len(reads)::INT AS looks FROM clusters")
def cluster_boxes(spark, d):
    return b.clusters(_reads(spark, d)).select("photo", "x0", "y0", "x1", "y1", F.size("reads").alias("looks"))


def _decided(spark, d):
    found = b.clusters(_reads(spark, d))
    one = lambda kind, which: F.when(F.size("reads") > 1, F.element_at("reads", which)).otherwise(F.lit(None).cast(b.READ)).withField("source", F.lit(kind))
    rows = found.withColumn("bib", F.struct("x0", "y0")).withColumn("d", b.decide(F.col("reads"), one("zoom", 2), F.lit(None).cast(b.READ)))
    return rows.select("photo", "bib", "d")


@query(DECIDED + "SELECT status, how, CASE status WHEN 'review' THEN 'digits hidden' WHEN 'drop' THEN 'unreadable' END AS why, count(*) AS n FROM decided GROUP BY ALL")
def bib_decisions(spark, d):
    return _decided(spark, d).groupBy("d.status", "d.how", "d.why").agg(F.count("*").alias("n"))


@query(LOOKS + "SELECT photo, count(*) >= 4 OR bool_or(NOT (contains(number, '?') = false AND legibility = 'clear' AND cut = 'none')) AS tiles FROM placed GROUP BY photo")
def tiles_wanted(spark, d):
    reads = _reads(spark, d).groupBy("photo").agg(F.collect_list(F.struct("source", "number", "legibility", "cut", "is_bib")).alias("reads"))
    return reads.select("photo", b.wants_tiles(F.col("reads")).alias("tiles"))


@query(DECIDED + """
, shown AS (SELECT *, CASE status WHEN 'accept' THEN [number] WHEN 'judge' THEN votes WHEN 'review' THEN [pattern] END AS texts FROM decided)
SELECT photo, x0, y0, CASE status WHEN 'accept' THEN 'agree' WHEN 'drop' THEN NULL ELSE 'disagree' END AS verdict, coalesce(array_to_string(list_filter(texts, lambda t: NOT contains(t, '?')), ','), '') AS texts, status <> 'accept' AND status <> 'drop' AS needs_human FROM shown
""")
def review_entries(spark, d):
    rows = _decided(spark, d).withColumn("e", b.review_entry(F.col("d")))
    return rows.select("photo", "bib.x0", "bib.y0", F.col("e.verdict").alias("verdict"), F.coalesce(F.array_join(F.transform("e.ocr", lambda r: r["text"]), ","), F.lit("")).alias("texts"), F.coalesce("e.needs_human", F.lit(False)).alias("needs_human"))


@query(DECIDED + """
, frames AS (SELECT o_orderkey AS photo, o_orderpriority AS folder, floor(o_orderkey / 5)::BIGINT AS position FROM orders),
start AS (SELECT c_custkey::VARCHAR AS number FROM customer),
here AS (SELECT decided.*, folder, position, CASE WHEN status = 'judge' THEN votes ELSE [] END AS cands, CASE WHEN status = 'review' THEN pattern ELSE '' END AS hidden FROM decided JOIN frames USING (photo)),
accepted AS (SELECT DISTINCT folder, position, number FROM here WHERE status = 'accept'),
places AS (SELECT DISTINCT folder, position FROM here WHERE status IN ('judge', 'review')),
near AS (SELECT p.folder, p.position, list(DISTINCT a.number) AS near FROM places p JOIN accepted a ON a.folder = p.folder AND a.position <> p.position AND abs(a.position - p.position) <= 6 GROUP BY ALL),
met AS (
  SELECT h.*, coalesce(near, []) AS near, list_filter(cands, lambda c: list_contains(coalesce(near, []), c)) AS hit,
    CASE WHEN length(hidden) >= 3 AND length(hidden) - length(replace(hidden, '?', '')) = 1 THEN list_filter(coalesce(near, []), lambda n: length(n) = length(hidden) AND n LIKE replace(hidden, '?', '_')) ELSE [] END AS filled FROM here h LEFT JOIN near USING (folder, position)
), valid AS (
  SELECT photo, x0, y0, list(c) AS ok FROM (SELECT photo, x0, y0, unnest(cands) AS c FROM met) JOIN start ON number = c GROUP BY ALL
), settled AS (
  SELECT m.photo, m.x0, m.y0, CASE WHEN status = 'accept' THEN m.number WHEN status = 'drop' THEN NULL WHEN len(hit) = 1 THEN hit[1] WHEN len(filled) = 1 THEN filled[1] WHEN len(ok) = 1 AND len(cands) > 1 THEN ok[1] END AS number, status = 'drop' AS dropped
  FROM met m LEFT JOIN valid v ON v.photo = m.photo AND v.x0 = m.x0 AND v.y0 = m.y0
), listed AS (SELECT s.*, t.number IS NOT NULL AS known, row_number() OVER (PARTITION BY photo, s.number ORDER BY x0, y0) AS nth FROM settled s LEFT JOIN start t ON t.number = s.number)
SELECT photo, coalesce(string_agg(number, ',' ORDER BY x0, y0) FILTER (known AND nth = 1), '') AS numbers, (count(*) FILTER (NOT known AND NOT dropped))::INT AS needs_human FROM listed GROUP BY photo
""")
def burst_resolution(spark, d):
    frames = photos(spark, d).select(F.col("photo_id").alias("photo"), F.col("photographer").alias("folder"), F.floor(F.col("photo_id") / 5).alias("position"))
    start = runners(spark, d).select(F.col("bib").alias("number"))
    return b.results(b.resolve(staged(_decided(spark, d), "decisions"), frames, start)).select("photo", F.array_join("numbers", ",").alias("numbers"), "needs_human")
