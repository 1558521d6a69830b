"""Queries on merges of tables and on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridemark.operators import incremental as inc
from stridemark.operators import merge as mg
from stridemark.operators import windows as w

from .adapters import HEAD, detections, photos, runners, table
from .registry import query


def _log(spark, d, part):
    return table(spark, d, "events").filter(F.col("event_id") % 2 == part).select("user_id", "event_id", F.col("value").alias("v"), F.when(F.col("event_type") == "click", "bad").alias("error"))


LOG = "SELECT user_id, event_id, value AS v, CASE WHEN event_type = 'click' THEN 'bad' END AS error FROM events"
LAST = f"SELECT user_id, event_id, v, error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM ({LOG})) WHERE n = 1"


@query(LAST)
def latest_per_key(spark, d):
    return mg.latest(_log(spark, d, 0).unionByName(_log(spark, d, 1)), "user_id", "event_id")


@query(f"SELECT * FROM ({LAST}) WHERE error IS NULL")
def latest_without_error(spark, d):
    return mg.latest_good(_log(spark, d, 0).unionByName(_log(spark, d, 1)), "user_id", "event_id")


@query(f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ({LAST}) WHERE error IS NULL)")
def pending_work(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return mg.pending(jobs, _log(spark, d, 0).unionByName(_log(spark, d, 1)), "user_id", "event_id")


def _reviews(spark, d, part):
    rows = table(spark, d, "events").filter(F.col("event_id") % 2 == part).groupBy("user_id").agg(F.max("event_id").alias("at"))
    return rows.withColumn("by", F.lit("mine" if part == 0 else "theirs"))


REVIEWS = """
WITH m AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_id % 2 = 0 GROUP BY user_id), t AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
"""


@query(REVIEWS + "SELECT coalesce(m.user_id, t.user_id) AS user_id, CASE WHEN t.at IS NOT NULL AND (m.at IS NULL OR t.at > m.at) THEN t.at ELSE m.at END AS at, CASE WHEN t.at IS NOT NULL AND (m.at IS NULL OR t.at > m.at) THEN 'theirs' ELSE 'mine' END AS by FROM m FULL JOIN t ON m.user_id = t.user_id")
def newest_wins_merge(spark, d):
    return mg.newest_wins(_reviews(spark, d, 0), _reviews(spark, d, 1), "user_id", "at")


@query(REVIEWS + "SELECT count(*) FILTER (k AND (m.at IS NULL OR t.at > m.at)) AS took, count(*) FILTER (k AND NOT (m.at IS NULL OR t.at > m.at)) AS kept, count(*) FILTER (NOT k) AS unknown FROM (SELECT *, user_id % 3 <> 0 AS k FROM t) t LEFT JOIN m USING (user_id)")
def merge_counters(spark, d):
    known = table(spark, d, "events").select("user_id").distinct().filter("user_id % 3 <> 0")
    return mg.merge_counts(_reviews(spark, d, 0), _reviews(spark, d, 1), "user_id", "at", known)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice, p_brand, p_size FROM part UNION ALL SELECT -c_custkey, 1.0, NULL, NULL FROM customer WHERE c_custkey BETWEEN 1 AND 10")
def upsert_merge(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size")
    new = old.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"), F.lit(None).cast("string").alias("p_brand"))
    more = table(spark, d, "customer").filter("c_custkey BETWEEN 1 AND 10").select((-F.col("c_custkey")).alias("p_partkey"), F.lit(1.0).alias("p_retailprice"), F.lit(None).cast("string").alias("p_brand"))
    # Every tenth incoming row comes twice; of those the one with the larger order counts.
    incoming = new.unionByName(more).withColumn("line", F.lit(2))
    first = incoming.filter("p_partkey % 10 = 0").withColumn("line", F.lit(1)).withColumn("p_retailprice", F.lit(-1.0))
    return mg.upsert(old, incoming.unionByName(first), ["p_partkey"], order="line")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT l_orderkey, l_partkey, 0.0 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 2")
def replace_by_key(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    new = table(spark, d, "lineitem").filter("l_orderkey % 10 = 0 AND l_linenumber = 2").select("l_orderkey", "l_partkey", F.lit(0.0).alias("l_quantity"))
    return mg.replace_by_key(old, new, "l_orderkey")


@query("SELECT count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def delete_with_children(spark, d):
    orders, lines = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    kept, left = mg.delete_cascade(orders, lines, orders.filter("o_orderstatus = 'P'"), "k")
    return kept.agg(F.count("*").alias("orders")).crossJoin(left.join(kept.select("k"), "k", "left_semi").agg(F.count("*").alias("lines")))


@query("SELECT doc_id, CASE WHEN doc_id > f THEN f END AS copy_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def exact_dupes_first_kept(spark, d):
    return mg.first_kept(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "copy_of")


@query("SELECT l_orderkey * 10 + l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_key_report(spark, d):
    return mg.repeated_keys(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")), "key")


@query(HEAD + "SELECT bib, coalesce(name, 'none') AS race, n FROM (SELECT bib, race_id, row_number() OVER (PARTITION BY club ORDER BY finish_s, bib) AS n FROM runners) LEFT JOIN races USING (race_id) WHERE n <= 3")
def first_in_club(spark, d):
    from .adapters import races

    rows = w.numbered(runners(spark, d), "club", ["finish_s", "bib"], F.lit(0)).filter("number <= 3").join(races(spark, d).select("race_id", "name"), "race_id", "left")
    return rows.select("bib", F.coalesce("name", F.lit("none")).alias("race"), F.col("number").alias("n"))


def _frames(spark, d):
    p = photos(spark, d)
    return w.numbered(p, "photographer", ["captured_at", "photo_id"], F.lit(0)).select("photo_id", "photographer", F.col("number").alias("position"))


FRAMES = HEAD + ", f AS (SELECT photo_id, photographer, row_number() OVER (PARTITION BY photographer ORDER BY captured_at, photo_id) AS position FROM photos)"


@query(FRAMES + """
, a AS (SELECT DISTINCT photographer, position, bib_text FROM f JOIN detections USING (photo_id) WHERE source <> 'rejected')
SELECT x.photographer, x.position, x.bib_text, count(*) AS n FROM a x JOIN a y ON x.photographer = y.photographer AND x.bib_text = y.bib_text AND x.position <> y.position AND abs(x.position - y.position) <= 6 GROUP BY ALL
""")
def burst_support(spark, d):
    seen = _frames(spark, d).join(detections(spark, d).filter("source <> 'rejected'"), "photo_id").select("photographer", "position", "bib_text").distinct()
    return w.support_pairs(seen, "photographer", "position", "bib_text")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000 THEN 1 ELSE 0 END AS new FROM events),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s), g AS (SELECT user_id, run, count(*) AS n, max(ts) AS last FROM r GROUP BY ALL)
SELECT user_id, n, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run DESC) AS k FROM g) WHERE k = 1
""")
def gap_sessions_longest(spark, d):
    return w.longest_run(table(spark, d, "events"), "user_id", "ts", 3_600_000).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query(FRAMES + """
, g AS (SELECT bib_text AS bib, photo_id, min(captured_at) AS shot, min(rank) AS bibs FROM detections JOIN photos USING (photo_id) GROUP BY ALL),
f2 AS (SELECT *, min(bibs) OVER (PARTITION BY bib) AS m FROM g), s AS (SELECT *, CASE WHEN epoch_ms(shot) - epoch_ms(lag(shot) OVER (PARTITION BY bib ORDER BY shot, photo_id)) > 864000000 THEN 1 ELSE 0 END AS new FROM f2 WHERE bibs = m),
r AS (SELECT *, sum(new) OVER (PARTITION BY bib ORDER BY shot, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM s), c AS (SELECT bib, run, count(*) AS n, arg_max(photo_id, (shot, photo_id)) AS photo_id FROM r GROUP BY ALL)
SELECT bib, photo_id FROM (SELECT *, row_number() OVER (PARTITION BY bib ORDER BY n DESC, run DESC) AS k FROM c) WHERE k = 1
""")
def cover_photo(spark, d):
    g = detections(spark, d).join(photos(spark, d), "photo_id").groupBy(F.col("bib_text").alias("bib"), "photo_id").agg(F.min("captured_at").alias("at"), F.min("rank").alias("bibs"))
    return w.cover(g.withColumn("place", F.col("photo_id")), "bib", "at", "bibs", "photo_id", "place", 864_000_000)


@query(HEAD + """
, old AS (SELECT photographer, max(photo_id) AS top FROM photos WHERE photo_id % 2 = 0 GROUP BY photographer)
SELECT photo_id, photo_id AS number FROM photos WHERE photo_id % 2 = 0
UNION ALL SELECT photo_id, coalesce(top, 0) + row_number() OVER (PARTITION BY photographer ORDER BY captured_at, photo_id) FROM photos LEFT JOIN old USING (photographer) WHERE photo_id % 2 = 1
""")
def number_after_max(spark, d):
    """Even photos are there already, with their photo_id as number; odd ones are numbered after their photographer's largest."""
    old = photos(spark, d).filter("photo_id % 2 = 0").withColumn("number", F.col("photo_id"))
    return w.numbered_after(old, photos(spark, d).filter("photo_id % 2 = 1"), "photographer", ["captured_at", "photo_id"]).select("photo_id", "number")


@query(HEAD + """
, s AS (SELECT *, CASE WHEN photographer < '3' OR photo_id % 100 <> 0 THEN captured_at END AS shot FROM photos), a AS (SELECT *, count(*) OVER p = count(shot) OVER p AS timed FROM s WINDOW p AS (PARTITION BY photographer))
SELECT photo_id, row_number() OVER (PARTITION BY photographer ORDER BY CASE WHEN timed THEN shot END, file_name) AS place FROM a
""")
def shot_order(spark, d):
    rows = photos(spark, d).withColumn("shot", F.when((F.col("photographer") < "3") | (F.col("photo_id") % 100 != 0), F.col("captured_at")))
    return w.shot_order(rows, "photographer", "shot", F.col("file_name")).select("photo_id", "place")


@query(HEAD + "SELECT photo_id, ntile(2) OVER (PARTITION BY photographer ORDER BY photo_id) AS half FROM photos")
def half_split(spark, d):
    return w.halves(photos(spark, d), "photographer", "photo_id").select("photo_id", "half")


@query(HEAD + "SELECT photo_id FROM (SELECT photo_id, row_number() OVER (PARTITION BY photographer ORDER BY photo_id) AS n FROM photos) WHERE (n - 1) % 25 = 0")
def every_kth(spark, d):
    return w.every_kth(photos(spark, d), "photographer", "photo_id", 25).select("photo_id")


@query(HEAD + "SELECT photo_id, CASE WHEN (photo_id - 1) // 20 % 5 = 4 THEN 'val' ELSE 'train' END AS split FROM photos WHERE photo_id > 0")
def block_split(spark, d):
    return photos(spark, d).filter("photo_id > 0").select("photo_id", w.split_by_blocks(F.col("photo_id")).alias("split"))


@query(HEAD + "SELECT photo_id, (row_number() OVER (PARTITION BY photographer ORDER BY photo_id) - 1) // 500 AS chunk, coalesce(sum(photo_id % 1000) OVER (PARTITION BY photographer ORDER BY photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 150000 AS bytes FROM photos")
def chunk_rows(spark, d):
    rows = w.chunks(photos(spark, d).withColumn("size", F.col("photo_id") % 1000), "photographer", "photo_id", 500).withColumnRenamed("chunk", "c")
    return w.byte_chunks(rows, "photographer", ["photo_id"], "size", 150_000).select("photo_id", F.col("c").alias("chunk"), F.col("chunk").alias("bytes"))


@query(HEAD + "SELECT photo_id FROM (SELECT photo_id, sum(1 + photo_id % 10) OVER (PARTITION BY photographer ORDER BY photo_id) AS c FROM photos) WHERE c <= 500")
def within_budget(spark, d):
    return w.within_budget(photos(spark, d).withColumn("cost", 1 + F.col("photo_id") % 10), "photographer", ["photo_id"], "cost", 500).select("photo_id")


@query(HEAD + "SELECT photographer, coalesce(min(photo_id) FILTER (course_km IS NULL AND photo_id > 7000), min(photo_id) FILTER (course_km IS NULL)) AS next FROM photos GROUP BY photographer")
def next_open(spark, d):
    return w.next_open(photos(spark, d), "photographer", "photo_id", F.lit(7000), F.col("course_km").isNull())


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (k <= 30) AS allowed, count(DISTINCT v) AS distinct_values FROM (SELECT user_id, v, dense_rank() OVER (PARTITION BY user_id ORDER BY f, v) AS k FROM (SELECT user_id, (value * 10)::BIGINT AS v, min(event_id) OVER (PARTITION BY user_id, (value * 10)::BIGINT) AS f FROM events)) GROUP BY user_id")
def session_quota(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.bround(F.col("value") * 10).cast("bigint").alias("v"))
    return inc.quota(rows, "user_id", "event_id", "v", 30).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("allowed")).alias("allowed"), F.count_distinct("v").alias("distinct_values"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY ALL")
def rate_windows(spark, d):
    rows = inc.rates(table(spark, d, "events"), "ts", "event_type", 2, "1 hour")
    return rows.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("minute"), "n", "over")
