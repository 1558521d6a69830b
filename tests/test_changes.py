import json
import random

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stridemark.operators import catalog, lookup
from stridemark.operators import matching as m
from stridemark.operators import refresh as rf
from stridemark.plans import registry
from stridemark.sources import logs

from test_lookup import made


def tables(spark, seed):
    runners, photos, reads = made(spark, seed)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("category", "string"), ("club", "string"), ("nationality", "string"), ("place_overall", "int"), ("place_category", "int"), ("chip_s", "bigint"))]
    runners = runners.select("event_id", "bib", F.concat(F.lit("n"), "bib").alias("full_name"), F.lit(1).alias("race_id"), F.lit("finished").alias("status"), F.lit(9000).cast("bigint").alias("finish_s"), F.lit("1990-01-02").cast("date").alias("dob"), *none)
    races = spark.createDataFrame([(1, 1, "half", "Half", 21.0975)], "event_id int, race_id int, code string, name string, distance_km double")
    return rf.Tables(runners, races, photos, reads)


def changed(spark, t, seed):
    """Some reads, photos and runners come, go or change."""
    r = random.Random(seed)
    gone, new = {r.randrange(60) for _ in range(3)}, [(r.randrange(60), str(r.randrange(10, 9999)), 0.9, "ocr") for _ in range(4)]
    reads = t.detections.filter(~F.col("photo_id").isin(list(gone))).unionByName(spark.createDataFrame(new, t.detections.schema))
    bibs = sorted(x["bib"] for x in t.runners.collect())
    out, other = r.choice(bibs), r.choice(bibs)
    come = t.runners.limit(1).withColumn("bib", F.lit(str(r.randrange(100, 9999)))).withColumn("event_id", F.lit(1)).join(t.runners.select("event_id", "bib"), ["event_id", "bib"], "left_anti").select(*t.runners.columns)
    runners = t.runners.filter(F.col("bib") != out).withColumn("full_name", F.when(F.col("bib") == other, "renamed").otherwise(F.col("full_name"))).unionByName(come)
    photos = t.photos.withColumn("file_name", F.when(F.col("photo_id") == r.randrange(60), "other.jpg").otherwise(F.col("file_name")))
    return rf.Tables(runners, t.races, photos, reads)


def payloads(df):
    return sorted((r["event_id"], r["bib"], r["payload"]) for r in df.collect())


def export(t):
    return m.export(t.runners, t.races, t.photos, t.detections)


@pytest.mark.parametrize("seed", range(4))
def test_a_change_gives_what_a_full_run_gives(spark, seed):
    before = tables(spark, seed)
    after = changed(spark, before, seed)
    old, want = export(before).cache(), payloads(export(after))
    bibs = rf.concerned(before, after).cache()
    now, _, gone = rf.refresh(old, after, bibs)
    assert payloads(now) == want
    asked = {tuple(r) for r in bibs.collect()}
    was = {(e, b): p for e, b, p in payloads(old)}
    really = {(e, b) for e, b, p in want if was.get((e, b)) != p} | (set(was) - {(e, b) for e, b, _ in want})
    assert really <= asked and len(asked) < len(was)  # nothing is missed, and not all is made again
    assert {tuple(r) for r in gone.collect()} == set(was) - {(e, b) for e, b, _ in want}


def test_nothing_changed_concerns_nobody(spark):
    t = tables(spark, 1)
    assert rf.concerned(t, t).count() == 0


def test_galleries_follow_a_log(spark, tmp_path):
    t = tables(spark, 2)
    base = rf.Tables(t.runners, t.races, t.photos, t.detections.filter("photo_id < 40"))
    g = rf.Galleries(spark, str(tmp_path / "g"), base)
    log, out, steps = str(tmp_path / "log"), f"file://{tmp_path}/out", []
    logs.append(t.detections.filter("photo_id BETWEEN 40 AND 44"), log)
    reads = lambda: logs.follow_log(spark, log, t.detections.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).drop("seq")
    g.follow(reads(), str(tmp_path / "at"), out, lambda n, k: steps.append(k)).awaitTermination()
    logs.append(t.detections.filter("photo_id >= 45"), log)
    g.follow(reads(), str(tmp_path / "at"), out, lambda n, k: steps.append(k)).awaitTermination()
    want = payloads(export(t))
    assert payloads(g.payloads()) == want
    assert len(steps) == 2 and 0 < steps[0] < len(want)
    files = {f.stem: json.loads(f.read_text()) for f in (tmp_path / "out" / "bib").glob("*.json")}
    assert 0 < len(files) < len(want) and all(files[b] == json.loads(p) for _, b, p in want if b in files)
    few = t.runners.filter(F.col("bib") != want[0][1])
    g.change_runners(few, out)
    after = payloads(export(rf.Tables(few, t.races, t.photos, t.detections)))
    assert payloads(g.payloads()) == after and not (tmp_path / "out" / "bib" / f"{want[0][1]}.json").exists()


def test_functions_and_views(spark, tmp_path):
    t = tables(spark, 3)
    events = spark.sql("SELECT * FROM VALUES (1, 'open', true, true), (2, 'shut', true, false), (3, 'draft', false, true) AS t(event_id, slug, published, db_search)")
    whole = export(t).cache()
    catalog.write_galleries_table(whole, events, t.runners, str(tmp_path / "p"))
    catalog.register(spark, events, t.races, spark.read.parquet(str(tmp_path / "p")))
    mine = sorted(r["bib"] for r in t.runners.filter("event_id = 1").collect())
    shut = t.runners.filter("event_id = 2").first()["bib"]
    after = mine[3]
    page = spark.sql(f"SELECT * FROM export_event('open', '{after}', 5)")
    assert [r["bib"] for r in page.collect()] == mine[4:9]
    assert {r["bib"]: r["payload"] for r in page.collect()} == {b: p for e, b, p in payloads(whole) if b in mine[4:9] and e == 1}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(slug), IsNotNull(bib), EqualTo(slug,open), GreaterThan(bib" in plan
    ask = lambda *a: spark.sql("SELECT find_runner(" + ", ".join("NULL" if x is None else repr(x) for x in a) + ")").first()[0]
    reason = lambda *a: json.loads(ask(*a)).get("reason")
    assert json.loads(ask("open", f"no. {after}"))["runner"]["bib"] == after and json.loads(ask("shut", shut))["ok"]
    assert reason("open", "x") == reason("open", None) == "missing_input" and reason("draft", after) == reason(None, after) == "no_event"
    assert reason("shut", shut, None, "anon") == "no_event" and reason("shut", shut, None, "service") is None
    assert reason("open", "123456") == "no_bib"
    assert spark.sql(f"SELECT find_runner('open', '{after}', DATE '1990-01-02') LIKE '%true%', find_runner('open', '{after}', DATE '1990-01-03')").first()[1] == '{"ok":false,"reason":"dob_mismatch"}'
    assert spark.sql("SELECT slug FROM public_events ORDER BY slug").collect() == [("open",), ("shut",)]
    assert spark.sql("SELECT runner_pace(12257, 42.195D), runner_pace(1, 0D), runner_clock(12257)").first() == ("4:50", None, "3:24:17")


def test_galleries_are_sorted_where_they_are_made(spark, tmp_path):
    t = tables(spark, 3)
    events = spark.sql("SELECT * FROM VALUES (1, 'open', true), (2, 'shut', true) AS t(event_id, slug, published)")
    whole = export(t)
    catalog.write_galleries_table(spark.createDataFrame(whole.collect(), whole.schema).repartition(3, "bib"), events, t.runners, str(tmp_path / "p"))
    files = sorted((tmp_path / "p").glob("*.parquet"))
    parts = [[(r["slug"], r["bib"]) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(parts) == 3 and all(len(p) > 1 and p == sorted(p) for p in parts)
    assert sorted(sum(parts, [])) == sorted(({1: "open", 2: "shut"}[e], b) for e, b, _ in payloads(whole) if e < 3)
    assert {pq.ParquetFile(f).metadata.row_group(0).column(3).compression for f in files} == {"ZSTD"}


def test_galleries_are_read_in_few_rows(spark, tmp_path):
    """A reader keeps a batch of a row group at once, and a writer the filters of a whole file."""
    payloads = spark.range(500).select(F.lit(1).alias("event_id"), F.col("id").cast("string").alias("bib"), F.repeat(F.col("id").cast("string"), F.lit(2000)).alias("payload")).coalesce(1)
    events = spark.sql("SELECT * FROM VALUES (1, 'open', true) AS t(event_id, slug, published)")
    runners = payloads.select("event_id", "bib", F.lit(None).cast("date").alias("dob"))
    catalog.write_galleries_table(payloads, events, runners, str(tmp_path / "p"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "p").glob("*.parquet")]
    groups = [f.row_group(n).num_rows for f in files for n in range(f.num_row_groups)]
    assert sum(groups) == 500 and max(groups) <= 64
    assert sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet")) < 200_000
    assert spark.read.parquet(str(tmp_path / "p")).filter("bib = '321' AND payload = repeat('321', 2000)").count() == 1


def test_views_make_no_galleries(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("galleries-*"))
    assert registry.queries()["sql_public_views"](spark, SMALL).count() == 3
    assert set(shared.glob("galleries-*")) == before


@pytest.mark.parametrize("few", [0, 3, 100_000])
def test_payloads_that_stay_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(rf, "few", lambda rows: lookup.few(rows, few))
    old = spark.createDataFrame([(1, str(i), f"p{i}", False) for i in range(9)] + [(1, None, "x", False), (None, "3", "y", False)], "event_id int, bib string, payload string, remade boolean")
    bibs = spark.createDataFrame([(1, str(i)) for i in range(8)], "event_id int, bib string")
    got = rf.kept(old, bibs)
    assert {r["payload"] for r in got.collect()} == {"p8", "x", "y"}
    assert few == 0 or "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_events_bib_are_near_in_others(spark):
    runners = spark.createDataFrame([(1, "123"), (2, "124"), (1, "777"), (2, "777"), (1, "778")], "event_id int, bib string")
    reads = spark.createDataFrame([(1, t, 0.9, "ocr") for t in ("124", "777", "125")], "photo_id int, bib_text string, confidence double, source string")
    got = {(r["event_id"], r["bib"], r["bib_text"]) for r in m.bib_texts(runners, reads).filter("NOT exact").collect()}
    assert got == {(1, "123", "124"), (1, "123", "125"), (2, "124", "125")}
