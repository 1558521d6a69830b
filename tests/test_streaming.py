import datetime
import random

import pytest

from stridemark.operators import incremental
from stridemark.streaming import quota

T0 = datetime.datetime(2025, 1, 1)
KIND = "session string, value string, ts timestamp"


@pytest.fixture
def kept(spark):
    """A session whose streams keep maps, lists and timers."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    quota.keep_state(spark)
    yield spark
    spark.conf.set(key, before)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def put(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, path, check, **options):
    seen = []
    stream = spark.readStream.schema(KIND).parquet(str(path))
    quota.run_incrementally(quota.session_quota(stream, **options), str(check), lambda df, _: seen.extend(df.collect())).awaitTermination(120)
    return seen


def test_session_quota_and_rates(kept, tmp_path):
    put(kept, tmp_path / "in", [("s", v, at(i)) for i, v in enumerate("abacdb")] + [("s", None, at(1)), ("s", "z", None)])
    seen = run(kept, tmp_path / "in", tmp_path / "ck", most=2)
    assert [(r["value"], r["allowed"]) for r in sorted(seen, key=lambda r: r["ts"])] == [("a", True), ("b", True), ("a", True), ("c", False), ("d", False), ("b", True)]
    put(kept, tmp_path / "in", [("s", "a", at(3600))])
    assert [(r["value"], r["allowed"]) for r in run(kept, tmp_path / "in", tmp_path / "ck", most=2)] == [("a", True)]
    alerts = []
    stream = kept.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    quota.run_incrementally(quota.rate_alerts(stream, "session", 5), str(tmp_path / "ck2"), lambda df, _: alerts.extend(df.collect())).awaitTermination(120)
    assert [(r["session"], r["n"]) for r in alerts] == [("s", 7)]


def test_a_session_is_forgotten_by_its_timer_across_restarts(kept, tmp_path):
    path, check = tmp_path / "in", tmp_path / "ck"
    put(kept, path, [("s", "a", at(0)), ("s", "b", at(1)), ("t", "a", at(2))])
    assert all(r["allowed"] for r in run(kept, path, check, most=2))
    put(kept, path, [("s", "c", at(60)), ("t", "b", at(900))])  # within the sessions' life, by another run: still full
    assert {(r["session"], r["value"]): r["allowed"] for r in run(kept, path, check, most=2)} == {("s", "c"): False, ("t", "b"): True}
    put(kept, path, [("u", "x", at(7200))])  # event time passes both timers
    run(kept, path, check, most=2)
    put(kept, path, [("u", "y", at(7201))])
    run(kept, path, check, most=2)
    put(kept, path, [("s", "c", at(7210)), ("s", "d", at(7211)), ("s", "e", at(7212))])
    assert sorted((r["value"], r["allowed"]) for r in run(kept, path, check, most=2)) == [("c", True), ("d", True), ("e", False)]


def test_a_replayed_stream_gives_what_the_batch_gives(kept, tmp_path):
    r = random.Random(1)
    rows = [(f"s{r.randrange(4)}", f"v{r.randrange(60)}", at(i)) for i in range(3000)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    put(kept, tmp_path / "in", shuffled)
    got = run(kept, tmp_path / "in", tmp_path / "ck", most=12)
    want = incremental.quota(kept.createDataFrame(rows, KIND), "session", "ts", "value", 12).collect()
    assert sorted((x["session"], x["value"], x["ts"], x["allowed"]) for x in got) == sorted((x["session"], x["value"], x["ts"], x["allowed"]) for x in want)
    assert 0 < sum(x["allowed"] for x in got) < 3000


def test_quota_over_chunks(kept, tmp_path):
    """A session's requests come in several Arrow chunks that aren't in order."""
    put(kept, tmp_path / "in", [("s", f"v{i}", at(i)) for i in range(40)][::-1])
    kept.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        seen = run(kept, tmp_path / "in", tmp_path / "ck", most=10)
    finally:
        kept.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["value"] for r in seen if r["allowed"]) == sorted(f"v{i}" for i in range(10)) and len(seen) == 40
