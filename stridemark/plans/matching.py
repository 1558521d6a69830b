"""Queries on matching runners to photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.functions.text import clean_number, normalise_digits, one_hidden, pattern_matches, similarity
from stridemark.functions.times import clock, pace
from stridemark.operators import matching as m
from stridemark.operators.lookup import read_reads, write_reads
from stridemark.sources.sinks import scratch

from .adapters import HEAD, detections, events, photos, races, runners, table
from .registry import query

TRIGRAMS = "list_distinct([substr('  ' || {0} || ' ', i, 3) FOR i IN range(1, length({0}) + 2)])"


def similarity_sql(a: str, b: str) -> str:
    x, y = TRIGRAMS.format(a), TRIGRAMS.format(b)
    return f"(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))))"


GATED = HEAD + """
, gate AS (
  SELECT d.*, max((source IN ('review', 'manual'))::INT) OVER (PARTITION BY photo_id) AS g FROM (SELECT d.*, p.event_id FROM detections d JOIN photos p USING (photo_id)) d WHERE source <> 'rejected'
), reads AS (SELECT * FROM gate WHERE source IN ('review', 'manual') OR g = 0)
"""
FOUND = GATED + f"""
, near AS (
  SELECT r.bib, t.bib_text FROM (SELECT DISTINCT bib FROM runners WHERE length(bib) >= 3) r
  JOIN (SELECT DISTINCT bib_text FROM reads WHERE source NOT IN ('review', 'manual') AND confidence >= 0.30 AND bib_text NOT IN (SELECT bib FROM runners)) t
    ON abs(length(r.bib) - length(t.bib_text)) <= 1 AND levenshtein(r.bib, t.bib_text) <= 1
), cand AS (
  SELECT r.bib, d.photo_id, d.bib_text AS read_as, true AS exact, coalesce(confidence, 0.5) AS score FROM reads d JOIN runners r ON r.bib = d.bib_text
  UNION ALL
  SELECT n.bib, d.photo_id, d.bib_text, false, coalesce(confidence, 0.5) * greatest({similarity_sql('d.bib_text', 'n.bib')}, 0.2)
  FROM reads d JOIN near n ON n.bib_text = d.bib_text WHERE source NOT IN ('review', 'manual') AND confidence >= 0.30
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bib, photo_id ORDER BY exact DESC, score DESC, read_as) AS n FROM cand) WHERE n = 1
), counted AS (
  SELECT photo_id, coalesce(nullif(count(DISTINCT CASE WHEN source IN ('review', 'manual') THEN bib_text END), 0), count(DISTINCT bib_text)) AS bibs_in_photo
  FROM detections GROUP BY photo_id
)
"""
GALLERY_ROWS = FOUND + """
, g AS (
SELECT b.bib, b.photo_id, CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS match_kind, round(score, 4) AS match_score, read_as, bibs_in_photo,
  row_number() OVER (PARTITION BY bib ORDER BY course_km NULLS LAST, captured_at NULLS LAST, file_name, b.photo_id) AS place
FROM best b JOIN photos p USING (photo_id) JOIN counted c ON c.photo_id = b.photo_id
)
"""
GALLERY = GALLERY_ROWS + "SELECT * FROM g"
COLUMNS = ("bib", "photo_id", "match_kind", "match_score", "read_as", "bibs_in_photo", "place")


def _gallery(spark, d):
    return m.gallery(runners(spark, d), photos(spark, d), detections(spark, d)).select(*COLUMNS)


@query(GALLERY)
def gallery_full(spark, d):
    return _gallery(spark, d)


@query(f"SELECT * FROM ({GALLERY}) WHERE match_kind = 'exact'")
def gallery_exact(spark, d):
    return _gallery(spark, d).filter("match_kind = 'exact'")


@query(f"SELECT * FROM ({GALLERY}) WHERE bib = '150'")
def find_runner_one(spark, d):
    return m.gallery(runners(spark, d), photos(spark, d), detections(spark, d), only=_one(spark)).select(*COLUMNS)


def _one(spark):
    return spark.sql("SELECT 1 AS event_id, '150' AS bib")


@query(f"SELECT * FROM ({GALLERY}) WHERE bib = '150'")
def find_runner_in_order(spark, d):
    """The same question to reads that are kept in the orders that questions go by."""
    write_reads(detections(spark, d), folder := scratch(spark, "reads"))
    return m.gallery(runners(spark, d), photos(spark, d), read_reads(spark, folder), only=_one(spark)).select(*COLUMNS)


@query(FOUND + """
SELECT bib, count(*) AS photos, count(*) FILTER (exact) AS exact_photos, sum(bibs_in_photo)::BIGINT AS shared FROM best b JOIN counted USING (photo_id) GROUP BY bib ORDER BY photos DESC, bib LIMIT 25
""")
def gallery_top_runners(spark, d):
    rows = m.gallery(runners(spark, d), photos(spark, d), detections(spark, d))
    return rows.groupBy("bib").agg(F.count("*").alias("photos"), F.count_if(F.col("exact")).alias("exact_photos"), F.sum("bibs_in_photo").alias("shared")).orderBy(F.desc("photos"), "bib").limit(25)


@query(HEAD + """
SELECT bib, full_name AS name, CASE WHEN race_id IS NULL THEN 'Marathon' ELSE ra.name END AS race, coalesce(code, 'marathon') AS race_code, status,
  (finish_s // 3600) || ':' || lpad((finish_s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((finish_s % 60)::VARCHAR, 2, '0') AS time,
  (round(finish_s / distance_km)::BIGINT // 60 % 60) || ':' || lpad((round(finish_s / distance_km)::BIGINT % 60)::VARCHAR, 2, '0') AS pace
FROM runners r LEFT JOIN races ra USING (race_id) WHERE bib > '1200' ORDER BY bib LIMIT 100
""")
def export_page(spark, d):
    rows = runners(spark, d).join(races(spark, d).drop("event_id"), "race_id", "left")
    rows = rows.select("bib", F.col("full_name").alias("name"), F.coalesce("name", F.lit("Marathon")).alias("race"), F.coalesce("code", F.lit("marathon")).alias("race_code"), "status", clock(F.col("finish_s")).alias("time"), pace(F.col("finish_s"), F.col("distance_km")).alias("pace"))
    return m.page(rows, "1200", 100)


PHOTO = "<id: bigint, file_name: string, preview_path: string, thumb_path: string, width: int, height: int, captured_at: string, photographer: string, course_point: string, course_km: double, match_kind: string, match_score: double, read_as: string, bibs_in_photo: bigint>"
PAYLOAD = f"struct<ok: boolean, reason: string, runner: struct<bib: string, name: string, category: string, club: string, nationality: string, race: string, race_code: string, distance_km: double, status: string, time: string, pace: string, place_overall: int, place_category: int>, photos: array<struct{PHOTO}>>"
#: Every field of a payload: those of the runner, and of each photo in order as one text.
TOLD = GALLERY_ROWS + """
, told AS (
  SELECT g.bib, count(*) AS n, string_agg(concat_ws('~', p.photo_id::VARCHAR, file_name, '-', strftime(captured_at, '%Y-%m-%d'), photographer, course_point, coalesce(round(course_km * 10)::BIGINT::VARCHAR, '-'), match_kind, round(match_score * 10000)::BIGINT::VARCHAR, read_as, bibs_in_photo::VARCHAR), '|' ORDER BY place) AS photos
  FROM g JOIN photos p USING (photo_id) GROUP BY g.bib
), payloads AS (
  SELECT r.bib, full_name AS name, club, CASE WHEN race_id IS NULL THEN 'Marathon' ELSE ra.name END AS race, coalesce(code, 'marathon') AS race_code, round(coalesce(distance_km, 42.195) * 10000)::BIGINT AS metres, status,
    (finish_s // 3600) || ':' || lpad((finish_s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((finish_s % 60)::VARCHAR, 2, '0') AS time,
    (round(finish_s / distance_km)::BIGINT // 60 % 60) || ':' || lpad((round(finish_s / distance_km)::BIGINT % 60)::VARCHAR, 2, '0') AS pace, coalesce(n, 0) AS n_photos, coalesce(photos, '') AS photos
  FROM runners r LEFT JOIN races ra USING (race_id) LEFT JOIN told USING (bib)
)
"""


def _told(payloads, *keys):
    """The fields of payloads, read back from their JSON."""
    rows = payloads.withColumn("x", F.from_json("payload", PAYLOAD))
    r, no = lambda c: F.col(f"x.runner.{c}"), F.lit("-")
    text = lambda p: F.concat_ws("~", p["id"].cast("string"), p["file_name"], F.coalesce(p["preview_path"], p["thumb_path"], p["width"].cast("string"), p["height"].cast("string"), no), F.substring(p["captured_at"], 1, 10), p["photographer"], p["course_point"], F.coalesce(F.round(p["course_km"] * 10).cast("bigint").cast("string"), no), p["match_kind"], F.round(p["match_score"] * 10000).cast("bigint").cast("string"), p["read_as"], p["bibs_in_photo"].cast("string"))
    photos = F.array_join(F.transform("x.photos", text), "|")
    return rows.select(*keys, r("name").alias("name"), r("club").alias("club"), r("race").alias("race"), r("race_code").alias("race_code"), F.round(r("distance_km") * 10000).cast("bigint").alias("metres"), r("status").alias("status"), r("time").alias("time"), r("pace").alias("pace"), F.size("x.photos").cast("bigint").alias("n_photos"), photos.alias("photos"))


@query(TOLD + "SELECT * FROM payloads")
def export_payload(spark, d):
    return _told(m.export(runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d)), "bib")


@query(TOLD + "SELECT * FROM payloads WHERE bib > '1200' ORDER BY bib LIMIT 100")
def export_payload_page(spark, d):
    return _told(m.export_page(events(spark), runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d), "open", "1200"), "bib")


ASKED = """
, asked AS (
  SELECT ['open', 'shut', 'draft'][1 + c_custkey % 3] AS slug, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE (c_custkey * 2)::VARCHAR END AS bib,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '1980-01-01' + (c_custkey % 50)::INT END AS dob, CASE WHEN c_custkey % 5 = 0 THEN 'anon' END AS caller_role FROM customer
)
"""
REASONS = """
SELECT a.slug, a.bib, a.dob::VARCHAR AS dob, a.caller_role, CASE WHEN a.bib = '' THEN 'missing_input' WHEN slug = 'draft' OR (slug = 'shut' AND caller_role IS NOT NULL) THEN 'no_event'
  WHEN r.bib IS NULL THEN 'no_bib' WHEN a.dob IS NOT NULL AND a.dob <> r.dob THEN 'dob_mismatch' ELSE 'ok' END AS reason
FROM asked a LEFT JOIN runners r ON r.bib = a.bib AND a.slug = 'open'
"""


def _asked(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.element_at(F.array(*map(F.lit, ("open", "shut", "draft"))), (c % 3 + 1).cast("int")).alias("slug"), F.when(c % 7 == 0, "").otherwise((c * 2).cast("string")).alias("bib"),
        F.when(c % 2 == 0, F.date_add(F.lit("1980-01-01").cast("date"), (c % 50).cast("int"))).alias("dob"), F.when(c % 5 == 0, "anon").alias("caller_role"),
    )


@query(HEAD + ASKED + REASONS)
def find_runner_reasons(spark, d):
    return m.find_runner(_asked(spark, d), events(spark), runners(spark, d)).withColumn("dob", F.col("dob").cast("string"))


@query(TOLD + ASKED + f"""
SELECT q.slug, q.bib, q.dob, q.caller_role, q.reason, q.reason = 'ok' AS ok, p.* EXCLUDE (bib) REPLACE (coalesce(metres, 0) AS metres, coalesce(n_photos, 0) AS n_photos) FROM ({REASONS}) q LEFT JOIN payloads p ON p.bib = q.bib AND q.reason = 'ok'
""")
def find_runner_answers(spark, d):
    """Every question with its whole answer; where it is refused, the numbers are 0 and the rest is null."""
    rows = m.answers(_asked(spark, d), events(spark), runners(spark, d), races(spark, d), photos(spark, d), detections(spark, d))
    told = _told(rows, "slug", "bib", F.col("dob").cast("string").alias("dob"), "caller_role", F.coalesce("x.reason", F.lit("ok")).alias("reason"), F.col("x.ok").alias("ok"))
    return told.withColumn("n_photos", F.when(F.col("ok"), F.col("n_photos")).otherwise(0)).withColumn("metres", F.coalesce("metres", F.lit(0))).withColumn("photos", F.when(F.col("ok"), F.col("photos")))


@query(HEAD + """
SELECT slug, CASE WHEN slug = 'open' THEN (SELECT count(*) FROM runners WHERE status = 'finished') ELSE 0 END AS finishers, CASE WHEN slug = 'open' THEN (SELECT count(*) FROM photos) ELSE 0 END AS photos,
  CASE WHEN slug = 'open' THEN (SELECT count(*) FROM runners WHERE bib IN (SELECT bib_text FROM detections JOIN photos USING (photo_id))) ELSE 0 END AS tagged_bibs,
  CASE WHEN slug = 'open' THEN (SELECT count(*) FROM detections JOIN photos USING (photo_id) WHERE source = 'review') ELSE 0 END AS recognitions,
  CASE WHEN slug = 'open' THEN (SELECT max(distance_km) FROM races) END AS distance_km,
  CASE WHEN slug = 'open' THEN (SELECT (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') FROM (SELECT min(finish_s) AS s FROM runners JOIN races USING (race_id) WHERE code = 'marathon' AND status = 'finished')) END AS course_record
FROM (VALUES ('open'), ('shut')) t(slug)
""")
def event_stats(spark, d):
    return m.event_stats(events(spark), races(spark, d), runners(spark, d), photos(spark, d), detections(spark, d))


@query(GATED + "SELECT photo_id, bib_text, source, count(*) AS n FROM reads GROUP BY ALL")
def review_gate(spark, d):
    reads = detections(spark, d).join(photos(spark, d).select("photo_id"), "photo_id")
    return m.gated(reads).groupBy("photo_id", "bib_text", "source").agg(F.count("*").alias("n"))


@query(HEAD + "SELECT photo_id, bib_text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, bib_text) AS n FROM detections) WHERE n = 1")
def distinct_on_best(spark, d):
    rows = detections(spark, d).select(F.lit(1).alias("event_id"), F.lit("").alias("bib"), "photo_id", F.lit(True).alias("exact"), F.col("confidence").alias("score"), F.col("bib_text").alias("read_as"))
    return m.best_reads(rows).select("photo_id", F.col("read_as").alias("bib_text"), F.col("score").alias("confidence"))


@query(HEAD + "SELECT bib_text, count(*) AS reads FROM detections WHERE bib_text NOT IN (SELECT bib FROM runners) GROUP BY bib_text")
def not_other_runner_anti(spark, d):
    return detections(spark, d).join(runners(spark, d).select(F.col("bib").alias("bib_text")), "bib_text", "left_anti").groupBy("bib_text").agg(F.count("*").alias("reads"))


@query(HEAD + "SELECT bib, status FROM runners WHERE bib IN (SELECT bib_text FROM detections WHERE source = 'review')")
def confirmed_semi(spark, d):
    return runners(spark, d).join(detections(spark, d).filter(m.is_confirmed()).select(F.col("bib_text").alias("bib")), "bib", "left_semi").select("bib", "status")


@query(HEAD + "SELECT photographer, count(*) AS photos, count(*) FILTER (course_km IS NULL) AS unplaced FROM photos WHERE photo_id NOT IN (SELECT photo_id FROM detections WHERE source = 'review') GROUP BY photographer")
def photos_without_confirmed(spark, d):
    return m.without_confirmed(photos(spark, d), detections(spark, d)).groupBy("photographer").agg(F.count("*").alias("photos"), F.count_if(F.col("course_km").isNull()).alias("unplaced"))


@query(HEAD + "SELECT photographer, count(*) AS photos, string_agg(file_name, ', ' ORDER BY file_name) AS files FROM photos GROUP BY photographer")
def photographer_files(spark, d):
    photos(spark, d).createOrReplaceTempView("stridemark_photos")
    return spark.sql("SELECT photographer, count(*) AS photos, string_agg(file_name, ', ') WITHIN GROUP (ORDER BY file_name) AS files FROM stridemark_photos GROUP BY photographer")


@query("SELECT a.t AS a, b.t AS b FROM (SELECT c_custkey::VARCHAR AS t FROM customer) a JOIN (SELECT p_partkey::VARCHAR AS t FROM part) b ON a.t <> b.t AND abs(length(a.t) - length(b.t)) <= 1 AND levenshtein(a.t, b.t) <= 1")
def fuzzy_lev1_pairs(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"))
    return m.near_texts(a, table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("b")), "a", "b")


@query(f"SELECT a, b, {similarity_sql('a', 'b')} AS similarity FROM (SELECT c_custkey::VARCHAR AS a, (c_custkey + 7)::VARCHAR AS b FROM customer)")
def trigram_similarity(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), (F.col("c_custkey") + 7).cast("string").alias("b")).withColumn("similarity", similarity(F.col("a"), F.col("b")))


@query(r"""
SELECT p_name, CASE WHEN length(x) BETWEEN 2 AND 6 THEN x ELSE '' END AS digits
FROM (SELECT p_name, regexp_replace(translate(trim(p_name || p_partkey), 'OoQDIl|i!ZzEASsGbT?Bgq', '0000111112234556677899'), '[^0-9]', '', 'g') AS x FROM part)
""")
def normalised_digits(spark, d):
    return table(spark, d, "part").select("p_name", normalise_digits(F.concat("p_name", "p_partkey")).alias("digits"))


@query(r"""
SELECT raw, substr(CASE WHEN k LIKE '0?%' AND substr(k, 2, 1) = '?' THEN k ELSE ltrim(k, '0') END, 1, 7) AS number
FROM (SELECT raw, regexp_replace(raw, '[^0-9?]', '', 'g') AS k FROM (SELECT 'No. 00' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE '' END AS raw FROM customer UNION ALL SELECT '0?' || c_custkey FROM customer))
""")
def cleaned_numbers(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.concat(F.lit("No. 00"), F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "?").otherwise("")).alias("raw")).unionByName(c.select(F.concat(F.lit("0?"), F.col("c_custkey")).alias("raw")))
    return raw.select("raw", clean_number(F.col("raw")).alias("number"))


@query("SELECT DISTINCT p AS pattern, n AS number FROM (SELECT DISTINCT substr(c_custkey::VARCHAR, 1, length(c_custkey::VARCHAR) - 1) || '?' AS p FROM customer) JOIN (SELECT p_partkey::VARCHAR AS n FROM part) ON length(p) = length(n) AND substr(p, 1, length(p) - 1) = substr(n, 1, length(n) - 1)")
def pattern_completions(spark, d):
    bib = F.col("c_custkey").cast("string")
    patterns = table(spark, d, "customer").select(F.concat(F.substring(bib, F.lit(1), F.length(bib) - 1), F.lit("?")).alias("pattern"))
    known = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("number"))
    return m.complete_patterns(patterns, known, "pattern", "number").filter(pattern_matches(F.col("pattern"), F.col("number")))


@query("SELECT a.t AS a, b.t AS b FROM (SELECT c_custkey::VARCHAR AS t FROM customer) a JOIN (SELECT p_partkey::VARCHAR AS t FROM part) b ON length(a.t) = length(b.t) AND hamming(a.t, b.t) = 1")
def start_list_neighbours(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"))
    return m.one_digit_apart(a, table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("b")), "a", "b")
