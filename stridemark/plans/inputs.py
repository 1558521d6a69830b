"""Queries that write the tables as the files that sources read, and read them back: lists, labels, listings, photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.functions import text as t
from stridemark.operators import merge as mg
from stridemark.sources import files, results, sinks

from .adapters import table
from .registry import query

#: How a customer stands in a result list: dates in three forms, none, or one that doesn't exist; times in two forms or a status.
LISTED = """
SELECT c_custkey AS k, 'Ana ' || c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN DATE '1980-01-01' + (c_custkey % 9000)::INT WHEN 2 THEN DATE '1980-01-01' + (c_custkey % 9000)::INT WHEN 3 THEN DATE '1980-01-01' + (c_custkey % 9000)::INT ELSE NULL END AS dob,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 3600 + c_custkey % 7000 END AS finish_s, CASE WHEN c_custkey % 4 = 0 THEN 'dnf' ELSE 'finished' END AS status, c_mktsegment AS club FROM customer
"""


def _result_list(spark, d):
    """The list as a file: separated by semicolons, headers with accents, blanks around values."""
    k, day = F.col("c_custkey"), F.date_add(F.lit("1980-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int"))
    s = 3600 + k % 7000
    born = F.when(k % 5 == 1, F.date_format(day, "dd.MM.yyyy")).when(k % 5 == 2, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 3, F.date_format(day, "yyyyMMdd")).when(k % 5 == 4, "31.02.1990").otherwise("")
    time = F.when(k % 4 == 0, "DNF").when(k % 4 == 1, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
    rows = table(spark, d, "customer").select(F.concat(F.lit("No. "), k).alias("St. br."), F.lit("Ana").alias("Ime"), F.concat(F.lit("  "), k, F.lit(" ")).alias("Prezime"), born.alias("Datum rođenja"), time.alias("Rezultat"), F.col("c_mktsegment").alias("Klub"))
    rows.write.option("header", True).option("sep", ";").csv(path := sinks.scratch(spark, "results"))
    return results.read(spark, path)


@query(f"SELECT k::VARCHAR AS bib, name AS full_name, dob::VARCHAR AS dob, finish_s::BIGINT AS finish_s, status, club FROM ({LISTED})")
def result_list_file(spark, d):
    good, _ = results.runners(_result_list(spark, d))
    return good.select("bib", "full_name", F.col("dob").cast("string").alias("dob"), F.col("finish_s").cast("bigint").alias("finish_s"), "status", "club")


@query(f"SELECT k::VARCHAR AS bib, 'unparseable birthdate' AS problem FROM ({LISTED}) WHERE dob IS NULL")
def result_list_problems(spark, d):
    return results.runners(_result_list(spark, d))[1].select("bib", "problem")


@query("""
SELECT 'p' || o_orderkey || '.jpg' AS file_name, (o_orderkey % 900) || ', ' || (o_orderkey % 77) AS bibs, CASE WHEN o_orderkey % 3 = 0 THEN 'Cilj' END AS course_point, CASE WHEN o_orderkey % 3 = 0 THEN 21.5 END AS course_km,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS photographer, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50)::VARCHAR END AS model, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END AS reviewed
FROM orders
""")
def bib_export_with_metadata(spark, d):
    """An export of bibs with the metadata of some photos, as files, and reviews of others."""
    k, orders = F.col("o_orderkey"), table(spark, d, "orders")
    name = F.concat(F.lit("p"), k, F.lit(".jpg"))
    folder = sinks.scratch(spark, "bundle")
    orders.select(name.alias("Image name"), F.concat_ws(", ", k % 900, k % 77).alias("bib_numbers")).write.option("header", True).csv(f"{folder}/bibs")
    orders.filter(k % 3 == 0).select(name.alias("file_name"), F.lit("Cilj").alias("point"), F.lit("21.5").alias("km"), F.col("o_orderpriority").alias("author")).write.option("header", True).csv(f"{folder}/meta")
    review = orders.filter(k % 2 == 0).select(name.alias("file_name"), F.array((k % 50).cast("string")).alias("model_numbers"), (k % 4 == 0).alias("reviewed"))
    rows = results.bundle(results.read(spark, f"{folder}/bibs"), results.read(spark, f"{folder}/meta"), review)
    return rows.select("file_name", "bibs", "course_point", "course_km", "photographer", F.array_join("model_numbers", ",").alias("model"), "reviewed")


@query("SELECT 'csv' AS kind, c_custkey::VARCHAR AS number FROM customer WHERE c_custkey > 0 UNION ALL SELECT DISTINCT 'txt', p_partkey::VARCHAR FROM part WHERE p_partkey > 0")
def start_list_files(spark, d):
    """Start lists as a table with a column of bibs, which has another name, and as a text of numbers."""
    folder = sinks.scratch(spark, "start")
    table(spark, d, "customer").select(F.col("c_name").alias("Ime"), F.concat(F.lit("00"), "c_custkey").alias("Startni broj")).write.option("header", True).csv(f"{folder}/start.csv")
    table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", F.concat(F.lit("0"), "p_partkey")).alias("value")).write.text(f"{folder}/start.txt")
    of = lambda kind: files.start_list(spark, f"{folder}/start.{kind}").select(F.lit(kind).alias("kind"), "number")
    return of("csv").unionByName(of("txt"))


@query("SELECT s_suppkey AS photo, s_suppkey || ',' || (s_suppkey % 7 + 1) AS bibs FROM supplier WHERE s_suppkey <> s_suppkey % 7 + 1 AND s_suppkey > 0")
def answer_key_file(spark, d):
    """A key of photos by the number at the end of their names, whose accents come in two forms."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").filter((k != k % 7 + 1) & (k > 0)).select(F.concat(F.when(k % 2 == 0, "Žig ").otherwise("Žig "), k, F.lit(".JPG")).alias("photo"), F.concat(k, F.lit(", 00"), k % 7 + 1, F.lit(", "), k).alias("bibs"))
    rows.write.option("header", True).csv(path := sinks.scratch(spark, "key"))
    return files.answer_key(spark, path).select(F.col("photo").cast("bigint").alias("photo"), F.array_join("bibs", ",").alias("bibs"))


@query("""
SELECT s_nationkey % 5 = 0 AS held, n_name AS stem, 0 AS class, ((s_suppkey % 90 + 5) / 100.0)::DOUBLE AS cx, 0.25::DOUBLE AS h FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def label_files_read(spark, d):
    """Labels of detectors, a file a nation and a line a supplier, written under names of their own and read back."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.format_string("0 %.2f 0.5 0.1 0.25", ((F.col("s_suppkey") % 90 + 5) / 100).cast("double"))
    split = F.when(F.col("s_nationkey") % 5 == 0, "val").otherwise("train")
    named = rows.groupBy(F.concat(F.lit("labels/"), split, F.lit("/"), "n_name", F.lit(".txt")).alias("path")).agg(F.encode(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\n")), "UTF-8").alias("data"))
    sinks.write_named(named, folder := sinks.scratch(spark, "labels")).count()
    got = files.labels(spark, f"{folder}/labels")
    return got.select((F.col("split") == "val").alias("held"), F.regexp_replace("stem", "%20", " ").alias("stem"), "class", "cx", "h")


@query("""
SELECT p_partkey AS image_id, 'img' || p_partkey || '.jpg' AS image, (p_partkey % 100)::DOUBLE AS x0, CASE WHEN p_partkey % 360 > 180 THEN p_partkey % 360 - 360 ELSE p_partkey % 360 END::DOUBLE AS rotation,
  CASE WHEN p_partkey % 3 <> 0 THEN lpad((p_partkey % 1000)::VARCHAR, 4, '0') END AS text FROM part WHERE p_partkey % 7 <> 0
""")
def annotation_file(spark, d):
    """Annotated boxes from XML; some pictures have none, some boxes no text. Texts keep their zeros."""
    k = F.col("p_partkey")
    attribute = F.when(k % 3 != 0, F.concat(F.lit('<attribute name="n">'), F.lpad((k % 1000).cast("string"), 4, "0"), F.lit("</attribute>"))).otherwise("")
    box = F.concat(F.lit('<box label="bib" source="manual" occluded="0" xtl="'), k % 100, F.lit('" ytl="1" xbr="200" ybr="9" rotation="'), k % 360, F.lit('" z_order="0">'), attribute, F.lit("</box>"))
    image = F.concat(F.lit('<image id="'), k, F.lit('" name="img'), k, F.lit('.jpg" width="300" height="20">'), F.when(k % 7 != 0, box).otherwise(""), F.lit("</image>"))
    whole = F.concat(F.lit("<annotations>\n"), F.array_join(F.collect_list(image), "\n"), F.lit("\n</annotations>\n"))
    parts = table(spark, d, "part").groupBy(F.concat(F.lit("a/"), F.floor(k / 500), F.lit(".xml")).alias("path")).agg(F.encode(whole, "UTF-8").alias("data"))
    sinks.write_named(parts, folder := sinks.scratch(spark, "annotations")).count()
    return files.annotated_boxes(files.annotations(spark, f"{folder}/a")).select("image_id", "image", "x0", "rotation", "text")


PHOTOS = """
SELECT *, 'day' || k % 3 || '/' || CASE k % 4 WHEN 1 THEN 'a' ELSE 'b' END || '/s' || k || '.' || CASE k % 6 WHEN 2 THEN 'PNG' WHEN 4 THEN 'txt' ELSE 'jpg' END AS key, DATE '2024-01-01' + (k % 300)::INT AS day FROM (SELECT s_suppkey AS k FROM supplier)
"""


@query(f"SELECT key, regexp_replace(key, '/[^/]*$', '') AS folder, strftime(day, '%Y-%m-%d') || ' 09:00:00' AS captured FROM ({PHOTOS}) WHERE k % 6 <> 4 AND k % 5 <> 0")
def photo_files(spark, d):
    """A tree of photos, a file a supplier: other endings and hidden folders are left out; the time is in the bytes."""
    k = F.col("s_suppkey")
    ending = F.when(k % 6 == 2, "PNG").when(k % 6 == 4, "txt").otherwise("jpg")
    path = F.concat(F.when(k % 5 == 0, "_old/").otherwise(""), F.lit("day"), k % 3, F.lit("/"), F.when(k % 4 == 1, "a").otherwise("b"), F.lit("/s"), k, F.lit("."), ending)
    stamp = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy:MM:dd")
    block = F.concat(F.lit("....Exif\x00\x00 1998:01:01 00:00:00 "), stamp, F.lit(" 11:00:00\x00 \x00+02:00\x00"))
    root = sinks.scratch(spark, "photos")
    sinks.write_named(table(spark, d, "supplier").select(path.alias("path"), F.encode(block, "UTF-8").alias("data")), root).count()
    rows = files.photos(spark, root, content=True)
    key = files.relative_key(F.col("path"), root.rsplit("/", 1)[-1])
    return rows.select(key.alias("key"), F.regexp_replace(key, "/[^/]*$", "").alias("folder"), F.date_format(files.captured_at(F.col("content"), "UTC"), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("SELECT n_name AS key, n_nationkey::BIGINT AS n FROM nation")
def json_map_file(spark, d):
    """A file that is one object, in place of an older one that isn't there."""
    folder = sinks.scratch(spark, "maps")
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").cast("bigint").alias("n")))))
    table(spark, d, "nation").agg(F.to_json(entries).alias("value")).write.text(f"{folder}/older")
    return files.first_map(spark, [f"{folder}/newer", f"{folder}/older"], "struct<n: bigint>").select("key", "value.n")


@query("SELECT 'p' || o_orderkey || '.jpg' AS file_name FROM orders WHERE o_orderkey % 3 = 0")
def reviewed_without_bibs(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit("p"), k, F.lit(".jpg")).alias("image_name"), F.when(k % 3 == 0, " ; ,").otherwise(F.concat(F.lit(" ;"), k)).alias("bib_numbers"))
    rows.write.option("header", True).csv(path := sinks.scratch(spark, "reviewed"))
    return results.without_bibs(spark, path)


@query("SELECT l_orderkey AS k, l_linenumber AS line, o_custkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def matched_ids(spark, d):
    """Names taken to their ids, of which none may be missing."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("id"))
    return mg.matched_or_fail(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")), ids, "k")


@query("SELECT c_custkey AS k, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS slug, lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) AS header FROM customer")
def slugs(spark, d):
    """Names with accents and signs as parts of paths, and headers without them."""
    rows = table(spark, d, "customer")
    accented = F.translate(F.col("c_name"), "Cs", "Čš")
    keys = {r[0]: t.header_key(f" {r[0].replace('A', 'Ä')} (đ)".replace("(đ)", "")) for r in rows.select("c_mktsegment").distinct().collect()}
    known = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return rows.select(F.col("c_custkey").alias("k"), t.slug(F.concat(accented, F.lit(" –"))).alias("slug"), known[F.col("c_mktsegment")].alias("header"))
