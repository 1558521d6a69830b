"""Queries on selections, exports, labels, takedowns and what the public sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import evidence as ev
from stridemark.operators import merge as mg
from stridemark.operators import metrics as mt
from stridemark.operators import publishing as pub
from stridemark.operators import selection as sel
from stridemark.sources import results, sinks

from .adapters import HEAD, detections, events, photos, races, runners, table
from .registry import query

#: What a review of the tables' photos would hold: a person's reads, the model's sure numbers, and how many are in doubt.
STATE = HEAD + """
, reviewed AS (SELECT DISTINCT photo_id FROM detections WHERE source = 'review'),
doubted AS (SELECT DISTINCT photo_id FROM detections WHERE confidence > 0.25 AND confidence < 0.45),
rejected AS (SELECT photo_id, max(confidence) > 0.85 AS bad FROM detections GROUP BY photo_id HAVING count(*) FILTER (source = 'rejected') > 0),
suggested AS (
  SELECT photo_id, list_sort(list(DISTINCT bib_text) FILTER (confidence > 0.45)) AS numbers, count(*) FILTER (confidence > 0.25 AND confidence < 0.45) AS needs_human,
    count(*) FILTER (source = 'rejected') AS disagree FROM detections GROUP BY photo_id
)
"""


def _reviewed(spark, d):
    return detections(spark, d).filter("source = 'review'").select(F.col("photo_id").alias("photo")).distinct()


def _suggested(spark, d):
    sure, unsure = F.col("confidence") > 0.45, (F.col("confidence") > 0.25) & (F.col("confidence") < 0.45)
    person = F.struct(F.when(F.col("source") == "rejected", "disagree").otherwise("agree").alias("verdict"))
    return detections(spark, d).groupBy(F.col("photo_id").alias("photo")).agg(F.array_sort(F.collect_set(F.when(sure, F.col("bib_text")))).alias("numbers"), F.count_if(unsure).alias("needs_human"), F.collect_list(person).alias("persons"))


def _photos(spark, d):
    return photos(spark, d).select(F.col("photo_id").alias("photo"), F.col("photographer").alias("folder"), "file_name")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 3 = 0 THEN '  ' WHEN p_partkey % 5 = 0 THEN NULL ELSE trim(p_name) END <> '' AND p_partkey % 3 <> 0")
def legible_boxes(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").withColumn("text", F.when(n % 3 == 0, "  ").when(n % 5 == 0, F.lit(None)).otherwise(F.col("p_name")))
    return rows.filter(sel.legible(F.col("text"))).select("p_partkey")


@query(STATE + """
SELECT photo_id AS photo, t.evaluate FROM doubted JOIN (VALUES (true), (false)) t(evaluate) ON evaluate = (photo_id IN (SELECT photo_id FROM reviewed))
WHERE photo_id NOT IN (SELECT photo_id FROM rejected WHERE NOT bad)
""")
def recheck_jobs(spark, d):
    """Photos to look at again: those nobody reviewed, and those that somebody did, to evaluate."""
    reads = detections(spark, d)
    doubts = reads.filter("confidence > 0.25 AND confidence < 0.45").select(F.col("photo_id").alias("photo")).distinct()
    done = reads.groupBy(F.col("photo_id").alias("photo")).agg(F.count_if(F.col("source") == "rejected").alias("n"), F.max("confidence").alias("c")).filter("n > 0").select("photo", F.when(F.col("c") > 0.85, "down").alias("error"))
    part = lambda evaluate: sel.to_recheck(doubts, done, _reviewed(spark, d), evaluate).select("photo", F.lit(evaluate).alias("evaluate"))
    return part(True).unionByName(part(False))


@query(STATE + """
SELECT w.which, p.photographer AS folder, p.photo_id AS photo, coalesce(array_to_string(numbers, ','), '') AS numbers, coalesce(needs_human, 0) AS needs_human, r.photo_id IS NOT NULL AS reviewed
FROM photos p LEFT JOIN suggested USING (photo_id) LEFT JOIN reviewed r ON r.photo_id = p.photo_id JOIN (VALUES ('all'), ('unreviewed'), ('needed')) w(which)
  ON which = 'all' OR (r.photo_id IS NULL AND (which = 'unreviewed' OR needs_human > 0))
""")
def review_packs(spark, d):
    parts = [sel.to_pack(_photos(spark, d).select("folder", "photo"), _suggested(spark, d).drop("persons"), _reviewed(spark, d), w).withColumn("which", F.lit(w)) for w in ("all", "unreviewed", "needed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("numbers", F.array_join("numbers", ","))


@query(STATE + "SELECT photo_id AS photo, row_number() OVER (PARTITION BY photographer ORDER BY disagree DESC, needs_human DESC, photo_id) AS place FROM photos JOIN suggested USING (photo_id) WHERE needs_human > 0")
def review_order(spark, d):
    rows = _photos(spark, d).join(_suggested(spark, d), "photo")
    return sel.in_review_order(rows, F.col("file_name"), only_needed=True).select("photo", "place")


@query(HEAD + """
, best AS (SELECT photo_id, bib_text, max(confidence) AS conf FROM detections GROUP BY ALL),
second AS (SELECT DISTINCT photo_id, t FROM (SELECT photo_id, unnest([bib_text, (bib_text::BIGINT + 1)::VARCHAR]) AS t FROM detections WHERE rank % 2 = 0)),
listed AS (
  SELECT photo_id, bib_text AS t, 0 AS part, -conf AS c FROM best b WHERE conf >= 0.1 OR EXISTS (SELECT 1 FROM second s WHERE s.photo_id = b.photo_id AND s.t = b.bib_text)
  UNION ALL SELECT photo_id, t, 1, 0 FROM second s WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.photo_id = s.photo_id AND b.bib_text = s.t)
), kept AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY part, c, t) AS n FROM listed l WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.photo_id = l.photo_id AND b.bib_text = l.t AND b.conf > 0.75))
SELECT p.photo_id AS photo, coalesce(string_agg(t, ',' ORDER BY n) FILTER (n <= 12), '') AS others FROM (SELECT DISTINCT photo_id FROM detections) p LEFT JOIN kept k USING (photo_id) GROUP BY p.photo_id
""")
def other_candidates(spark, d):
    best = detections(spark, d).groupBy("photo_id", "bib_text").agg(F.max("confidence").alias("conf"), F.max((F.col("rank") % 2 == 0)).alias("even"))
    rows = best.groupBy(F.col("photo_id").alias("photo")).agg(
        F.collect_list(F.struct(F.col("bib_text").alias("text"), "conf")).alias("reads"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("even"), F.array("bib_text", (F.col("bib_text").cast("bigint") + 1).cast("string")))))).alias("second"),
        F.collect_list(F.when(F.col("conf") > 0.75, F.col("bib_text"))).alias("chosen"),
    )
    return rows.select("photo", F.array_join(sel.other_candidates(F.col("reads"), F.col("second"), F.col("chosen")), ",").alias("others"))


@query(HEAD + "SELECT photographer AS folder, count(*) FILTER (course_point = 'P') AS shared FROM photos GROUP BY ALL ORDER BY shared DESC, folder LIMIT 1")
def batch_of_review(spark, d):
    rows = photos(spark, d).select(F.col("photographer").alias("folder"), F.col("file_name").alias("name"), "course_point")
    return sel.batch_of(rows.filter("course_point = 'P'").select("name"), rows.select("folder", "name"))


@query(STATE + "SELECT file_name FROM photos WHERE photo_id IN (SELECT photo_id FROM reviewed)")
def refresh_live(spark, d):
    live = photos(spark, d).join(_reviewed(spark, d).withColumnRenamed("photo", "photo_id"), "photo_id").select("file_name")
    return sel.refuse_broken(sel.still_live(photos(spark, d), live), ["file_name"]).select("file_name")


def _training(spark, d):
    """The first two lines of a photo are its true bibs; every third supplier's line was read wrongly."""
    n = F.col("l_partkey")
    rows = table(spark, d, "lineitem").withColumn("photo", F.col("l_orderkey"))
    key = rows.groupBy("photo").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, n.cast("string")))).alias("bibs")).withColumn("bibs", F.when(F.col("photo") % 6 == 0, ev.nothing()).otherwise(F.col("bibs")))
    x, y = (n % 50 * 10).cast("double"), (F.col("l_suppkey") % 20 * 10).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 40).alias("y1"))
    hit = F.struct(F.when(F.col("l_suppkey") % 3 == 0, (n + 1).cast("string")).otherwise(n.cast("string")).alias("text"), (F.col("l_discount") * 10).alias("conf"), (F.col("l_tax") * 10).alias("det_conf"), box.alias("box"))
    runs = rows.filter("l_orderkey % 4 <> 1").groupBy("photo").agg(F.when(F.col("photo") % 12 == 0, 0).otherwise(F.count("*")).alias("regions"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", hit.alias("h")))).alias("hits")).withColumn("hits", F.transform("hits", lambda s: s["h"]))
    files = photos(spark, d).select(F.col("photo_id").alias("photo"), "file_name")
    return sel.training_set(key, runs, files, rows.filter("l_returnflag = 'A' AND l_linenumber = 5").select("photo").distinct(), negatives=1 << 30)


@query("""
WITH key AS (SELECT l_orderkey AS photo, l_partkey AS bib FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 6 <> 0 GROUP BY ALL),
hits AS (SELECT DISTINCT l_orderkey AS photo, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END AS text FROM lineitem WHERE l_orderkey % 4 <> 1),
p AS (SELECT DISTINCT l_orderkey AS photo FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (
  SELECT p.photo, p.photo IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 5) AS manual, count(k.bib) AS bibs, count(h.text) AS found
  FROM p LEFT JOIN key k USING (photo) LEFT JOIN hits h ON h.photo = k.photo AND h.text = k.bib GROUP BY p.photo
), t AS (
  SELECT photo, CASE WHEN manual THEN 'manual' WHEN bibs > 0 AND found = bibs AND photo % 4 <> 1 THEN 'full' WHEN bibs = 0 AND photo % 12 = 0 AND photo % 4 <> 1 THEN 'background' END AS kind FROM s
)
SELECT photo, kind, CASE WHEN (photo - 1) // 20 % 5 = 4 THEN 'val' ELSE 'train' END AS split FROM t WHERE kind IS NOT NULL
""")
def training_kinds(spark, d):
    return _training(spark, d).select("photo", "kind", "split")


@query(HEAD + "SELECT path, count(*) AS n FROM (SELECT 'b' || p_partkey AS path FROM part UNION ALL SELECT file_name FROM photos UNION ALL SELECT file_name FROM photos) GROUP BY path")
def training_paths(spark, d):
    others = table(spark, d, "part").select(F.concat(F.lit("b"), "p_partkey").alias("path"))
    return sel.training_list(photos(spark, d).select(F.col("file_name").alias("path")), others, most=1 << 30).groupBy("path").agg(F.count("*").alias("n"))


@query(HEAD + "SELECT name, code FROM races")
def public_races(spark, d):
    return pub.public_views(events(spark), races(spark, d))["races"].select("name", "code")


#: An event a race: its finishers, photos by number, and runners whose bib a read has.
STATS = HEAD + """
, stats AS (
  SELECT name AS slug, DATE '1997-01-01' + (race_id * 30)::INT AS race_date, (SELECT count(*) FROM runners r WHERE r.race_id = a.race_id AND status = 'dnf' AND finish_s % 5 = a.race_id % 7) AS finishers,
    (SELECT count(*) FROM photos p WHERE p.photo_id % 50 = a.race_id) * (race_id % 3 > 0)::INT AS photos, (SELECT count(*) FROM runners r WHERE r.race_id = a.race_id AND bib LIKE '%99') AS tagged_bibs FROM races a
)
"""


def _stats(spark, d):
    race = races(spark, d)
    mine = runners(spark, d).withColumn("f", (F.col("status") == "dnf") & (F.col("finish_s") % 5 == F.col("race_id") % 7)).groupBy("race_id").agg(F.count_if("f").alias("finishers"), F.count_if(F.col("bib").endswith("99")).alias("tagged_bibs"))
    shot = photos(spark, d).groupBy((F.col("photo_id") % 50).alias("race_id")).agg(F.count("*").alias("photos"))
    rows = race.join(mine, "race_id", "left").join(shot, "race_id", "left").na.fill(0)
    return rows.select(F.col("name").alias("slug"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("race_id") * 30).cast("int")).alias("race_date"), "finishers", F.when(F.col("race_id") % 3 > 0, F.col("photos")).otherwise(0).alias("photos"), "tagged_bibs")


@query(STATS + """
SELECT slug, array_to_string(list_filter([CASE WHEN finishers = 0 THEN 'no results imported yet' END, CASE WHEN photos = 0 THEN 'no photos published yet' END, CASE WHEN photos > 0 AND tagged_bibs = 0 THEN 'photos have no bibs yet' END], lambda x: x IS NOT NULL), '; ') AS problems FROM stats
""")
def publish_readiness(spark, d):
    return pub.readiness(_stats(spark, d)).withColumn("problems", F.array_join("problems", "; "))


@query(STATS + "SELECT slug, (TIMESTAMP '1998-01-27 23:59:58' < race_date::TIMESTAMP + INTERVAL 86399 SECOND OR photos = 0) AS upcoming FROM stats")
def upcoming_events(spark, d):
    return pub.upcoming(_stats(spark, d), F.to_timestamp(F.lit("1998-01-27 23:59:58")))


@query(HEAD + """
, g AS (SELECT photo_id, row_number() OVER (PARTITION BY course_point, photographer ORDER BY photo_id) AS place, course_point, nullif(photographer, '5-LOW') AS photographer,
  CASE photo_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '/media/' || file_name WHEN 2 THEN 'https://x/' || file_name ELSE file_name END AS preview, CASE photo_id % 3 WHEN 0 THEN NULL ELSE '/t/' || file_name END AS thumb,
  CASE WHEN photo_id % 5 > 0 THEN photo_id % 1000 END AS width, CASE WHEN photo_id % 7 > 0 THEN 600 END AS height, CASE WHEN photo_id % 2 = 0 THEN captured_at END AS shot FROM photos),
u AS (SELECT *, CASE WHEN preview IS NULL OR preview LIKE '/%' OR preview LIKE 'http%' THEN preview ELSE 'https://store/previews/' || preview END AS src FROM g)
SELECT photo_id, coalesce(src, '') AS src, coalesce(thumb, src, '') AS thumb, CASE WHEN shot IS NOT NULL THEN strftime(shot, '%H:%M') ELSE printf('%02d:%02d', 9 + (place - 1) * 20 // 60, (place - 1) * 20 % 60) END AS clock,
  CASE WHEN photographer IS NULL THEN course_point ELSE course_point || ' · ' || photographer END AS hint, CASE WHEN width > 0 AND height > 0 THEN width || ' × ' || height || ' px' ELSE '—' END AS dims, coalesce(width, 3) || '/' || coalesce(height, 2) AS ratio FROM u
""")
def gallery_labels(spark, d):
    from stridemark.operators.windows import numbered

    n, name = F.col("photo_id"), F.col("file_name")
    rows = numbered(photos(spark, d).withColumn("at", F.concat_ws(" ", "course_point", "photographer")), "at", ["photo_id"], F.lit(0)).withColumnRenamed("number", "place")
    preview = F.when(n % 4 == 1, F.concat(F.lit("/media/"), name)).when(n % 4 == 2, F.concat(F.lit("https://x/"), name)).when(n % 4 == 3, name)
    rows = rows.select("photo_id", "place", "course_point", F.nullif("photographer", F.lit("5-LOW")).alias("photographer"), preview.alias("preview_path"), F.when(n % 3 > 0, F.concat(F.lit("/t/"), name)).alias("thumb_path"), F.when(n % 5 > 0, n % 1000).alias("width"), F.when(n % 7 > 0, 600).alias("height"), F.when(n % 2 == 0, F.col("captured_at")).alias("captured_at"))
    return pub.gallery_labels(rows, "UTC", "https://store/previews/").select("photo_id", "src", "thumb", "clock", "hint", "dims", "ratio")


def _taken_down(spark, d):
    """Runners without a club's, and reads without those of their bibs and of 1600, whose runner, if any, stays."""
    r, p, x = runners(spark, d), photos(spark, d), detections(spark, d)
    club = r.filter("club = 'BUILDING'").select("event_id", "bib")
    more = club.unionByName(spark.createDataFrame([(1, "No. 1600")], "event_id int, bib string"))
    return pub.take_down_runner(r, p, x, club)[0], pub.take_down_runner(r, p, x, more)[1]


@query(HEAD + "SELECT (SELECT count(*) FROM runners WHERE club <> 'BUILDING') AS runners, (SELECT count(*) FROM detections WHERE bib_text NOT IN (SELECT bib FROM runners WHERE club = 'BUILDING') AND bib_text <> '1600') AS reads")
def takedown_runners(spark, d):
    """Without the runners of a club and all reads of their bibs, and without the reads of one bib more."""
    left, reads = _taken_down(spark, d)
    return left.agg(F.count("*").alias("runners")).crossJoin(reads.agg(F.count("*").alias("reads")))  # one row each


@query(HEAD + """
, x AS (SELECT photo_id FROM photos WHERE file_name IN ('p1.jpg', 'p2.jpg', 'p3.jpg', 'p1000.jpg', 'none.jpg'))
SELECT (SELECT count(*) FROM photos WHERE photo_id NOT IN (SELECT photo_id FROM x) AND file_name <> 'p7.jpg') AS photos, (SELECT count(*) FROM detections WHERE photo_id NOT IN (SELECT photo_id FROM x) AND photo_id <> 7) AS reads
""")
def excluded_photos(spark, d):
    """Without photos that a list names, their reads, and one that is taken down."""
    from stridemark.sources.files import inline

    p, x = photos(spark, d), detections(spark, d)
    gone = pub.named_photos(inline(spark, ["p1.jpg", "p2.jpg", "p3.jpg", "p1000.jpg", "none.jpg"]), events(spark).withColumn("event_id", F.col("event_id").cast("int")), p, "open")
    kept, reads = mg.delete_cascade(p.withColumn("preview_path", F.lit("/media/a")).withColumn("thumb_path", F.lit(None).cast("string")), x, gone, "photo_id")
    kept, reads, _ = pub.take_down_photo(kept, reads, 1, "p7.jpg")
    return kept.agg(F.count("*").alias("photos")).crossJoin(reads.agg(F.count("*").alias("reads")))  # one row each


def _published(spark, d):
    reviews = detections(spark, d).filter("source = 'review'").groupBy(F.col("photo_id").alias("photo")).agg(F.array_sort(F.collect_set("bib_text")).alias("numbers"))
    return ev.published(photos(spark, d).select(F.col("photo_id").alias("photo")), reviews, _suggested(spark, d).filter("size(numbers) <> 1").select("photo", "numbers"))


PUBLISHED = STATE + """
, confirmed AS (SELECT photo_id, list_sort(list(DISTINCT bib_text)) AS numbers FROM detections WHERE source = 'review' GROUP BY photo_id),
published AS (SELECT p.photo_id AS photo, coalesce(c.numbers, s.numbers, []) AS numbers, c.photo_id IS NOT NULL AS reviewed FROM photos p LEFT JOIN confirmed c USING (photo_id) LEFT JOIN suggested s ON s.photo_id = p.photo_id AND coalesce(len(s.numbers), 0) <> 1 WHERE c.photo_id IS NOT NULL OR s.photo_id IS NOT NULL)
"""


@query(PUBLISHED + """
SELECT p.photo::VARCHAR AS image_name, array_to_string(numbers, ', ') AS bib_numbers, coalesce((SELECT string_agg(DISTINCT bib_text, ',' ORDER BY bib_text) FROM detections x WHERE x.photo_id = p.photo AND confidence >= 0.1), '') AS model_numbers, reviewed FROM published p
""")
def bib_export_files(spark, d):
    """The export's CSV and review bundle, written and read back."""
    folder = sinks.scratch(spark, "export")
    hits = detections(spark, d).select(F.col("photo_id").alias("photo"), F.col("bib_text").alias("text"), F.col("confidence").alias("conf"))
    sinks.write_export(_published(spark, d), hits, folder)
    csv = spark.read.schema("image_name string, bib_numbers string").csv(f"{folder}/bib_export", header=True)
    more = spark.read.schema("photo string, numbers array<string>, model_numbers array<string>, reviewed boolean").json(f"{folder}/review_all")
    rows = csv.join(more.withColumnRenamed("photo", "image_name"), "image_name").filter(F.coalesce("bib_numbers", F.lit("")) == F.array_join("numbers", ", "))
    return rows.select("image_name", F.coalesce("bib_numbers", F.lit("")).alias("bib_numbers"), F.array_join("model_numbers", ",").alias("model_numbers"), "reviewed")


@query(PUBLISHED + "SELECT photographer AS folder, count(*) AS photos, sum(len(numbers) * CASE WHEN photographer = '5-LOW' THEN 0 ELSE 1 END)::BIGINT AS numbers FROM published JOIN photos ON photo_id = photo GROUP BY ALL")
def results_by_folder(spark, d):
    """Results written for all folders and again for one, whose numbers are gone then; the others stay."""
    folder = sinks.scratch(spark, "results")
    rows = _published(spark, d).join(_photos(spark, d), "photo").select("folder", "photo", "numbers")
    sinks.write_results(rows, folder)
    sinks.write_results(rows.filter("folder = '5-LOW'").withColumn("numbers", ev.nothing()), folder)
    back = spark.read.schema("photo bigint, numbers array<string>, folder string").json(folder)
    return back.groupBy("folder").agg(F.count("*").alias("photos"), F.sum(F.size("numbers").cast("bigint")).alias("numbers"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS photo, l_linenumber AS n, l_partkey % 50 * 10.0::DOUBLE AS x, l_suppkey % 20 * 10.0::DOUBLE AS y FROM lineitem),
t AS (SELECT photo, string_agg(printf('0 %.6f %.6f %.6f %.6f', (x + 30) / 800, (y + 20) / 600, 60 / 800.0::DOUBLE, 40 / 600.0::DOUBLE) || chr(10), '' ORDER BY n, x, y) AS data FROM b GROUP BY photo)
SELECT 'labels/' || CASE WHEN (photo - 1) // 20 % 5 = 4 THEN 'val' ELSE 'train' END || '/photo_' || lpad(photo::VARCHAR, greatest(4, length(photo::VARCHAR))::INT, '0') || '.txt' AS path, CASE WHEN photo % 10 = 0 THEN 'by hand' ELSE data END AS data FROM t
""")
def detector_labels(spark, d):
    from stridemark.operators.windows import split_by_blocks

    x, y = (F.col("l_partkey") % 50 * 10).cast("double"), (F.col("l_suppkey") % 20 * 10).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 40).alias("y1"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo"), F.struct("l_linenumber", x.alias("x"), y.alias("y"), box.alias("box")).alias("b")).distinct().groupBy("photo").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["box"]).alias("boxes"))
    rows = rows.withColumn("split", split_by_blocks(F.col("photo"))).withColumn("width", F.lit(800)).withColumn("height", F.lit(600)).withColumn("text", F.when(F.col("photo") % 10 == 0, "by hand"))
    return sinks.label_files(rows).withColumn("data", F.decode("data", "UTF-8"))


def _eval(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo")).agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))).alias("truth"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 3, (F.col("l_partkey") + F.col("l_suppkey") % 3).cast("string")))).alias("read"))
    none = F.lit(None).cast("string")
    bib = lambda n: F.struct(F.lit("accept").alias("status"), n.alias("number"), none.alias("pattern"), ev.nothing().alias("candidates"), F.lit("zoom clear").alias("how"), none.alias("why"))
    return rows.select(F.lit("f").alias("folder"), "photo", "truth", "read", F.transform("read", bib).alias("bibs"))


@query("""
WITH s AS (SELECT l_orderkey AS photo, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS t, list_sort(list(DISTINCT (l_partkey + l_suppkey % 3)::VARCHAR) FILTER (l_linenumber <= 3)) AS r, list_sort(list((l_partkey + l_suppkey % 3)::VARCHAR) FILTER (l_linenumber <= 3)) AS every FROM lineitem GROUP BY ALL),
c AS (SELECT photo, t, coalesce(r, []) AS r, coalesce(every, []) AS every FROM s)
SELECT photo, array_to_string(t, ' ') AS people, array_to_string(r, ' ') AS read, coalesce(array_to_string(list_filter(r, lambda x: NOT list_contains(t, x)), ' '), '') AS wrong, coalesce(array_to_string(list_filter(t, lambda x: NOT list_contains(r, x)), ' '), '') AS missed,
  coalesce(array_to_string(list_transform(every, lambda x: 'accept:' || x || ' (zoom clear)'), ' | '), '') AS bibs FROM c WHERE t <> r
""")
def eval_mistakes(spark, d):
    """The report of mistakes, written and read back."""
    folder = sinks.scratch(spark, "mistakes")
    sinks.write_mistakes(mt.mistakes(_eval(spark, d), "truth", "read", "bibs"), folder)
    rows = spark.read.schema("folder string, photo bigint, people string, read string, wrong string, missed string, bibs string").csv(folder, header=True)
    return rows.drop("folder").na.fill("")


@query("""
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey::VARCHAR AS truth, (l_partkey + l_suppkey)::VARCHAR AS read FROM lineitem GROUP BY ALL)
SELECT pos, truth, read, round(levenshtein(read, truth)::DOUBLE / length(truth), 6) AS cer FROM r ORDER BY levenshtein(read, truth)::DOUBLE / length(truth) DESC, pos, truth, read LIMIT 15
""")
def worst_reads(spark, d):
    n = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), n.cast("string").alias("truth"), (n + F.col("l_suppkey")).cast("string").alias("read")).distinct()
    scored = mt.scored(rows, "read", "truth").withColumn("at", F.struct("pos", "truth", "read"))
    return mt.worst(scored, "at").select("pos", "truth", "read", F.round("cer", 6).alias("cer"))


@query("""
WITH p AS (SELECT p_size * 20 + 300 AS w, p_size * 14 + 200 AS h FROM part), q AS (SELECT w, h, round_even(floor(w * 0.58) * 2.5, 0) AS tw, round_even(floor(h * 0.58) * 2.5, 0) AS th FROM p),
m AS (SELECT count(*) AS photos, avg(ceil(w / 28) * ceil(h / 28)) + 500 AS survey, avg(ceil(tw / 28) * ceil(th / 28)) + 500 AS tile FROM q)
SELECT photos, round(survey, 3) AS survey, round((survey + tile * 1.2 + 3 * 1140 + 100) * 3 / 1e6 + (60 + 135 + 150 + 1.2 * (60 + 90 + 150) + 50 + 165 + 150) * 15 / 1e6 + 0.3 * (3600 * 5 + 2120 * 25) / 1e6, 9) AS usd FROM m
""")
def cost_estimate(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") * 20 + 300).alias("w"), (F.col("p_size") * 14 + 200).alias("h"))
    out = mt.estimate(rows, "w", "h", {"in": 3.0, "out": 15.0, "judge_in": 5.0, "judge_out": 25.0}, prompts={"survey": 500.0, "zoom": 100.0})
    return out.select("photos", F.round("survey_in", 3).alias("survey"), F.round("usd", 9).alias("usd"))


@query(HEAD + """
, r AS (SELECT photo_id, count(*) FILTER (source = 'review') AS v, count(*) FILTER (source = 'ocr') AS o, count(*) FILTER (source = 'rejected') AS x FROM detections GROUP BY photo_id)
SELECT count(*) AS photos, coalesce(sum(v), 0)::BIGINT AS confirmed, coalesce(sum(o), 0)::BIGINT AS model, coalesce(sum(x), 0)::BIGINT AS rejected, count(*) FILTER (v > 0) AS tagged, (SELECT count(DISTINCT bib_text) FROM detections) AS numbers, count(*) - count(*) FILTER (v > 0) AS untagged FROM photos LEFT JOIN r USING (photo_id)
""")
def import_summary(spark, d):
    p = photos(spark, d)
    reads = detections(spark, d).join(p.select("photo_id", "file_name"), "photo_id").select("file_name", "bib_text", "source")
    return mt.import_summary(reads, p)


@query(HEAD + "SELECT bib, CASE WHEN r.race_id < 20 THEN r.race_id END AS race_id FROM runners r")
def runners_with_race_ids(spark, d):
    r = runners(spark, d).select("bib", F.col("race_id").cast("string").alias("race_code"))
    known = races(spark, d).filter("race_id < 20").select("race_id", F.col("race_id").cast("string").alias("code"))
    return results.with_race_ids(r, known).select("bib", "race_id")


@query("SELECT coalesce(n, p_name) AS name, count(*) AS parts FROM part LEFT JOIN (SELECT p_partkey AS k, 'new' || p_partkey % 7 AS n FROM part WHERE p_size > 25) ON k = p_partkey GROUP BY ALL")
def renamed_keys(spark, d):
    parts = table(spark, d, "part")
    named = parts.withColumn("name", F.concat_ws("/", "p_partkey", "p_name"))
    names = named.filter("p_size > 25").select(F.col("name").alias("old"), F.concat(F.lit("new"), F.col("p_partkey") % 7).alias("new"))
    rows = mg.renamed(named.select("name"), names, "name").withColumn("name", F.regexp_replace("name", "^[0-9]+/", ""))
    return rows.groupBy("name").agg(F.count("*").alias("parts"))


@query("SELECT p_brand AS brand, count(*) FILTER (p_size <= 40) AS kept, count(*) FILTER (p_size > 40) AS aside FROM part GROUP BY ALL")
def set_aside_rows(spark, d):
    kept, aside = mg.set_aside(table(spark, d, "part"), F.col("p_size") > 40)
    count = lambda df, n: df.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias(n))
    return count(kept, "kept").join(count(aside, "aside"), "brand", "full_outer").select("brand", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("aside", F.lit(0)).alias("aside"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -500)")
def missing_definitions(spark, d):
    there = table(spark, d, "customer").filter("c_acctbal < -500").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return mg.missing_only(table(spark, d, "nation").select("n_nationkey", "n_name"), there, ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS entry FROM customer")
def swapped_suggestions(spark, d):
    old = table(spark, d, "customer").select("c_custkey", F.lit("old").alias("entry"))
    return mg.swap(old, old.filter("c_custkey % 2 = 0").withColumn("entry", F.lit("new")), "c_custkey")


@query(HEAD + "SELECT photo_id AS photo, coalesce(string_agg(DISTINCT bib_text, ',' ORDER BY bib_text) FILTER (confidence >= 0.3 AND length(bib_text) BETWEEN 3 AND 4), '') AS hints FROM detections GROUP BY ALL")
def second_reader_hints(spark, d):
    reads = detections(spark, d).groupBy(F.col("photo_id").alias("photo")).agg(F.collect_list(F.struct(F.col("bib_text").alias("text"), F.col("confidence").alias("conf"))).alias("reads"))
    return reads.select("photo", F.array_join(ev.hints(F.col("reads")), ",").alias("hints"))
