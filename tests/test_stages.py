from pyspark.sql import functions as F
import json

from stridemark.operators import plugins
from stridemark.streaming.stages import Batches, Stages

PHOTOS = [("f", i, f"p{i}.jpg", 1000, 600) for i in range(6)]


def answer(step, photo, key):
    """What a reader sees: photo n has bib 10n, clear; photo 2's is unsure, photo 3 has none, photo 4's survey fails."""
    n = int(photo[1:-4])
    look = {"box": [100, 100, 200, 180], "number": str(100 + n), "legibility": "partial" if n == 2 else "clear", "cut": "none"}
    if step == "survey":
        return (None, "busy") if n == 4 else ({"bibs": [] if n == 3 else [look]}, None)
    if step == "tiles":
        return {"bibs": [look] if n == 2 and key.endswith("#0") else []}, None
    return {"is_bib": True, "number": str(100 + n), "legibility": "clear", "cut": "none"}, None


def reader(log):
    def ask(jobs):
        rows = []
        for r in jobs.collect():
            log.append((r["step"], r["key"]))
            reply, error = answer(r["step"], r["photo"], r["key"])
            rows.append((r["photo"], r["key"], None if reply is None else json.dumps(reply), error))
        return jobs.sparkSession.createDataFrame(rows, "photo string, key string, reply string, error string")

    return ask


def test_stages_send_nothing_twice(spark, tmp_path):
    photos = spark.createDataFrame(PHOTOS, "folder string, position int, photo string, width int, height int")
    log = []
    stages = Stages(spark, str(tmp_path), photos, reader(log))
    got = {r["photo"]: (r["numbers"], r["needs_human"], r["complete"]) for r in stages.run().collect()}
    assert got == {f"p{i}.jpg": ([] if i == 3 else [str(100 + i)], 0, True) for i in range(6) if i != 4}
    assert stages.sent == {"survey": 6, "tiles": 8, "zoom": 4, "judge": 0}
    first = len(log)
    again = Stages(spark, str(tmp_path), photos, reader(log))
    assert again.run().count() == 5 and again.sent == {"survey": 1, "tiles": 0, "zoom": 0, "judge": 0}
    assert log[first:] == [("survey", "p4.jpg")]  # what failed is asked again, and nothing else


def test_batches_are_registered_once(spark, tmp_path):
    jobs = spark.createDataFrame([(f"p{i}", f"k{i}", "zoom", "x" * 10) for i in range(7)], "photo string, key string, step string, request string")
    batches = Batches(spark, str(tmp_path), most=3)
    sent = batches.submit(jobs)
    assert sent.count() == 7 and max(r["count"] for r in sent.groupBy("chunk").count().collect()) <= 3
    assert batches.submit(jobs).count() == 0
    more = jobs.unionByName(spark.createDataFrame([("p9", "k9", "zoom", "y")], jobs.schema))
    assert [r["key"] for r in batches.submit(more).collect()] == ["k9"]
    ids = {r["key"]: r["custom_id"] for r in batches.requests().collect()}
    replies = spark.createDataFrame([(ids["k1"], "{}", None), (ids["k2"], None, "expired"), ("r-unknown", "{}", None)], "custom_id string, reply string, error string")
    done = spark.createDataFrame([("k1",)], "key string")
    assert [tuple(r) for r in batches.collect(replies, done).collect()] == [("p2", "k2", None, "expired")]


def test_detectors(spark):
    a, b = plugins.Fixed({b"1": [(0, 0, 10, 10, 0.9)], b"2": []}), plugins.Fixed({b"1": [(0, 0, 10, 11, 0.8), (50, 0, 60, 10, 0.3)], b"2": [(1, 1, 2, 2, 0.5)]})
    photos = spark.createDataFrame([(1, bytearray(b"1")), (2, bytearray(b"2")), (3, bytearray(b"broken"))], "id int, content binary")
    photos = photos.withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    got = {r["id"]: (r["boxes"], r["error"]) for r in plugins.detect_all(photos, "content", [lambda: a, lambda: b]).collect()}
    assert [x["conf"] for x in got[1][0]] == [0.9, 0.3] and got[1][1] is None
    assert len(got[2][0]) == 1 and got[3][0] == [] and got[3][1].startswith("KeyError")
    alone = {r["id"]: len(r["boxes"]) for r in plugins.detect(photos, "content", lambda: b).collect()}
    assert alone == {1: 2, 2: 1, 3: 0}

    def cut(photo, tile):
        return b"t" if photo == b"1" else photo

    tiled = plugins.detect_all(photos, "content", [lambda: plugins.Fixed({b"1": [], b"2": [], b"t": [(0, 0, 5, 5, 0.7)]})], crop=lambda: cut)
    assert "Exchange" not in tiled._jdf.queryExecution().executedPlan().toString()
    boxes = {r["id"]: sorted((x["box"]["x0"], x["box"]["y0"]) for x in r["boxes"]) for r in tiled.collect()}
    assert boxes == {1: [(0, 0), (0, 43), (43, 0), (43, 43)], 2: [], 3: []}
    person = plugins.detect(photos.limit(1), "content", lambda: plugins.Fixed({b"1": [(0.0, 0.0, 100.0, 200.0, 0.6)]}))
    assert [(x["conf"], *x["box"]) for x in person.select(plugins.of_persons(F.col("boxes")).alias("b")).first()["b"]] == [(0.6, 15.0, 60.0, 85.0, 130.0)]
    assert plugins.Whole(lambda p: (4, 3)).detect(b"") == [(0.0, 0.0, 4.0, 3.0, 1.0)]


def test_a_request_without_a_reply_is_asked_again_once(spark, tmp_path):
    import datetime

    from stridemark.sources import logs

    t0, replies, ticks, out = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC), str(tmp_path / "replies"), str(tmp_path / "clock"), []
    hand = [0]
    batches = Batches(spark, str(tmp_path / "b"), now=lambda: int(after(hand[0]).timestamp()) * 1_000_000)
    after = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    came, tick = "custom_id string, reply string, error string, at timestamp", "at timestamp"
    logs.append(spark.createDataFrame([], came), replies)
    names = {r["key"]: r["custom_id"] for r in batches.submit(spark.createDataFrame([("p1", "k1", "zoom", "{}"), ("p2", "k2", "zoom", "{}")], "photo string, key string, step string, request string")).collect()}
    first = lambda name: spark.createDataFrame([name], came)

    def run(minutes):
        for step in (0, 1):  # event time moves between batches
            hand[0] = minutes + step
            logs.append(spark.createDataFrame([(after(minutes + step),)], tick), ticks)
            clock = logs.follow_log(spark, ticks, tick).drop("seq")
            stream = logs.follow_log(spark, replies, came).drop("seq")
            batches.run(stream, str(tmp_path / "at"), lambda rows: out.extend(map(tuple, rows.collect())), patience="60 minutes", late="1 minute", clock=clock).awaitTermination(120)

    logs.append(first((names["k1"], "yes", None, after(5))), replies)
    run(10)
    assert out == [("p1", "k1", "yes", None)] and batches.requests().count() == 2
    run(100)  # k2's time is over
    asked = batches.requests().filter("attempt = 2").collect()
    assert [r["key"] for r in asked] == ["k2"] and asked[0]["custom_id"] == names["k2"] + "-2" and len(out) == 1
    logs.append(first((names["k2"], "too late", None, after(101))), replies)
    run(102)
    assert len(out) == 1 and batches.requests().count() == 3
    run(400)  # the second attempt has no reply either: given up, and never asked a third time
    run(800)
    assert out[1:] == [("p2", "k2", None, "no reply")] and batches.requests().count() == 3
    again = spark.createDataFrame([("p2", "k2", "zoom", "{}")], "photo string, key string, step string, request string")
    assert batches.submit(again).count() == 0
