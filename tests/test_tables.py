import datetime

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stridemark.operators import incremental, merge, plugins, windows
from stridemark.operators import publishing as pub
from stridemark.plans import registry


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_latest_hides_keys_whose_last_row_failed(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, "bad"), ("b", 1, "bad"), ("b", 2, None)], "k string, seq int, error string")
    assert rows(merge.latest_good(log, "k", "seq"), "k") == [("b",)]
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(merge.pending(jobs, log, "k", "seq")) == [("a",), ("c",)]


def test_upsert_twice_is_upsert(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, a string, b int")
    new = spark.createDataFrame([(2, None, 7), (3, None, 8)], "k int, a string, b int")
    once = merge.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=lambda r: r[0]) == [(1, "x", 5), (2, "y", 7), (3, None, 8)]
    assert rows(merge.upsert(once, new, ["k"]).fillna("")) == rows(once.fillna(""))


def test_newest_wins(spark):
    mine = spark.createDataFrame([("a", 5, "m"), ("b", 5, "m"), ("c", 5, "m")], "k string, at int, by string")
    theirs = spark.createDataFrame([("a", 5, "t"), ("b", 6, "t"), ("d", 1, "t"), ("e", 1, "t")], "k string, at int, by string")
    known = spark.createDataFrame([("a",), ("b",), ("d",)], "k string")
    assert rows(merge.newest_wins(mine, theirs, "k", "at", known), "k", "by") == [("a", "m"), ("b", "t"), ("c", "m"), ("d", "t")]
    assert tuple(merge.merge_counts(mine, theirs, "k", "at", known).first()) == (2, 1, 1)


def test_deletes(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    kept, left = merge.delete_cascade(p, c, p.filter("k = 1"), "k", expected=1)
    assert rows(kept) == [(2,)] and rows(left) == [(2, "y")]
    with pytest.raises(ValueError):
        merge.delete_cascade(p, c, p, "k", expected=1)
    with pytest.raises(ValueError):
        merge.matched_or_fail(c, p.filter("k = 1"), "k")


def test_versions_and_files(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    merge.write_version(spark.range(3), folder, 1)
    merge.write_version(spark.range(5), folder, 2)
    assert merge.read_version(spark, folder).count() == 5 and merge.read_version(spark, folder, 1).count() == 3 and merge.versions(spark, folder) == [1, 2]
    out = merge.write_one_file_each(spark.createDataFrame([("7", "{}"), ("12", '{"a":1}')], "bib string, payload string"), f"file://{tmp_path}/json", "bib", "payload")
    assert rows(out) == [("12", 7), ("7", 2)] and (tmp_path / "json/12.json").read_text() == '{"a":1}'


def test_windows(spark):
    t0 = datetime.datetime(2025, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    seen = spark.createDataFrame([("k", at(s)) for s in (0, 2, 4, 60, 62, 64)] + [("z", at(0))], "k string, t timestamp")
    got = {r["k"]: (r["n"], r["last"]) for r in windows.longest_run(seen, "k", "t").collect()}
    assert got == {"k": (3, at(64)), "z": (1, at(0))}
    frames = spark.createDataFrame([("f", i, v) for i, v in enumerate([["1"], [], ["1", "2"], ["1"]])], "f string, i int, v array<string>")
    near = {r["i"]: {x["value"]: x["n"] for x in r["near"]} for r in windows.burst_support(frames, "f", "i", "v", 2).collect()}
    assert near == {0: {"1": 1, "2": 1}, 1: {"1": 3, "2": 1}, 2: {"1": 2}, 3: {"1": 1, "2": 1}}
    gallery = spark.createDataFrame([("b", 1, at(0), 2, 1), ("b", 2, at(10), 1, 2), ("b", 3, at(12), 1, 3), ("b", 4, at(90), 1, 4), ("c", 5, None, 3, 1), ("c", 6, None, 3, 2)], "b string, p int, t timestamp, n int, place int")
    assert rows(windows.cover(gallery, "b", "t", "n", "p", "place")) == [("b", 3), ("c", 5)]
    q = spark.createDataFrame([("s", i, v) for i, v in enumerate("abacd")], "s string, i int, v string")
    assert rows(incremental.quota(q, "s", "i", "v", 2), "i", "allowed") == [(0, True), (1, True), (2, True), (3, False), (4, False)]
    assert rows(windows.stratified(spark.createDataFrame([(f, str(i)) for f in "ab" for i in range(9)], "f string, n string"), "f", "n", 4).groupBy("f").count()) == [("a", 2), ("b", 2)]


def test_numbers_go_on_after_the_largest(spark):
    old = spark.createDataFrame([("a", 7, 40), ("a", 3, 41), ("b", 2, 42)], "k string, number long, i int")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("c", 3), ("b", 4)], "k string, i int")
    assert rows(windows.numbered_after(old, new, "k", ["i"]), "k", "i", "number") == [("a", 1, 8), ("a", 2, 9), ("a", 40, 7), ("a", 41, 3), ("b", 4, 3), ("b", 42, 2), ("c", 3, 1)]


def test_plugins_keep_errors_as_data(spark):
    class Broken:
        def read_batch(self, crops):
            if any(bytes(c) == b"bad" for c in crops):
                raise ValueError("unreadable")
            return [[(bytes(c).decode(), 0.5)] for c in crops]

    plugins.register("broken", Broken)
    crops = spark.createDataFrame([(bytearray(b"12"),), (bytearray(b"bad"),)], "c binary")
    got = plugins.recognise(crops, "c", plugins.build("broken")).select(F.size("reads").alias("n"), "error").collect()
    assert sorted((r["n"], r["error"]) for r in got if r["error"] is None) == [(1, None)] and [r["error"] for r in got if r["error"]] == ["ValueError: unreadable"]


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, 5)], "k int, v int")
    new = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 9, 2), (2, 8, 1)], "k int, v int, line int")
    assert rows(merge.upsert(old, new, ["k"], order="line")) == [(1, 7), (2, 9)]
    assert rows(merge.upsert(old, new.drop("line"), ["k"])) == [(1, 7), (2, 9)]


def test_places_without_a_task_for_a_key(spark):
    df = spark.createDataFrame([("hot", i * 3) for i in range(500)] + [("cold", 1), (None, 4), (None, 2)], "k string, o int").repartition(7)
    got = {(r["k"], r["o"]): (r["place"], r["of"]) for r in windows.placed(df, "k", "o", slices=8).collect()}
    assert got == {**{("hot", i * 3): (i + 1, 500) for i in range(500)}, ("cold", 1): (1, 1), (None, 2): (1, 2), (None, 4): (2, 2)}
    assert sorted(r["half"] for r in windows.halves(df.filter("k IS NULL"), "k", "o").collect()) == [1, 2]


def test_takedowns(spark):
    photos = spark.createDataFrame([(1, 1, "a", "/media/p", "/media/t"), (2, 1, "b", None, "x"), (3, 2, "a", "/media/q", None)], "photo_id int, event_id int, file_name string, preview_path string, thumb_path string")
    reads = spark.createDataFrame([(1, "7"), (2, "7"), (3, "7"), (2, "8")], "photo_id int, bib_text string")
    kept, left, paths = pub.take_down_photo(photos, reads, 1, "a")
    assert rows(kept, "photo_id") == [(2,), (3,)] and rows(left) == [(2, "7"), (2, "8"), (3, "7")] and rows(paths) == [("media/p",), ("media/t",)]
    runners = spark.createDataFrame([(1, "7"), (1, "8"), (2, "7")], "event_id int, bib string")
    left, reads = pub.take_down_runner(runners, photos, reads, spark.createDataFrame([(1, "#7")], "event_id int, bib string"))
    assert rows(left) == [(1, "8"), (2, "7")] and rows(reads) == [(2, "8"), (3, "7")]


def test_places_of_all(spark):
    from stridemark.functions.text import natural_key

    names = [f"IMG_{i % 70}-{i}.jpg" for i in range(500)] + [None, None, "", "img_7", "IMG_07"]
    frame = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(5)
    got = windows.natural_places(frame, F.col("name"), "k")
    want = [r["k"] for r in frame.withColumn("n", natural_key(F.col("name"))).orderBy("n", "k").collect()]
    assert [r["k"] for r in got.orderBy("place").collect()] == want and sorted(r["place"] for r in got.collect()) == list(range(1, 506))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert windows.natural_places(frame.limit(0), F.col("name"), "k").count() == 0


def test_takedowns_meet_photos_by_reads(spark):
    asked = spark.createDataFrame([(1, "No. 7")], "event_id int, bib string")
    runners = spark.createDataFrame([(1, "7"), (1, "8"), (2, "7")], "event_id int, bib string")
    photos = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 2)], "photo_id int, event_id int")
    reads = spark.createDataFrame([(1, "7"), (1, "8"), (2, "7"), (3, "7"), (9, "7"), (None, "7"), (1, None)], "photo_id int, bib_text string")
    left, kept = pub.take_down_runner(runners, photos, reads, asked)
    assert {tuple(r) for r in left.collect()} == {(1, "8"), (2, "7")}
    assert sorted(kept.collect(), key=str) == sorted([(1, "8"), (3, "7"), (9, "7"), (None, "7"), (1, None)], key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("bib_text" in j or "photo_id" in j for j in joins)  # an event's photos don't meet its bibs


@pytest.mark.parametrize("name", ["takedown_rows", "takedown_runners"])
def test_takedowns_of_a_bib_that_someone_has(spark, tmp_path, name):
    db = duckdb.connect()
    for t in ("nation", "orders", "lineitem"):
        db.sql(f"COPY (FROM '{SMALL}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    db.sql(f"COPY (FROM '{SMALL}/customer.parquet' UNION ALL SELECT 1600, 'x', 1, 2.0, 'MACHINERY') TO '{tmp_path}/customer.parquet'")
    for t in ("nation", "orders", "lineitem", "customer"):
        db.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
