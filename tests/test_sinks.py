import json

from pyspark.sql import functions as F

from stridemark.operators import selection
from stridemark.sources import sinks


def uri(path):
    return f"file://{path}"


def test_galleries_replace_those_of_before(spark, tmp_path):
    stats = spark.createDataFrame([("open", 2)], "slug string, photos int")
    rows = lambda *bibs: spark.createDataFrame([(b, json.dumps({"bib": b})) for b in bibs], "bib string, payload string")
    sinks.write_galleries(rows("1", "2"), stats, uri(tmp_path / "out"))
    assert sinks.write_galleries(rows("2", "30"), stats, uri(tmp_path / "out")).first()["runners"] == 2
    assert sorted(p.name for p in (tmp_path / "out/bib").glob("*.json")) == ["2.json", "30.json"]
    assert json.loads((tmp_path / "out/stats.json").read_text()) == {"ok": True, "slug": "open", "photos": 2}


def test_saved_entries(spark, tmp_path):
    entry = lambda *rows: spark.createDataFrame(rows, "photo string, numbers string, at int")
    sinks.save_entries(str(tmp_path / "log"), entry(("a", "1", 5), ("b", "2", 5)), "photo", "at")
    now = sinks.save_entries(str(tmp_path / "log"), entry(("a", "9", 6), ("c", "3", 1)), "photo", "at")
    assert sorted(map(tuple, now.select("photo", "numbers").collect())) == [("a", "9"), ("b", "2"), ("c", "3")]


def test_uploads_try_again_and_skip_what_is_done(spark, tmp_path):
    log = str(tmp_path / "sent")

    def factory():
        tries = {}

        def send(row):
            tries[row["key"]] = tries.get(row["key"], 0) + 1
            if row["key"] == "never" or (row["key"] == "later" and tries["later"] < 3):
                raise OSError("store is busy")
            with open(log, "a") as out:
                out.write(row["key"] + "\n")

        return send

    rows = spark.createDataFrame([("now", 1), ("later", 2), ("never", 3), ("done", 4)], "key string, n int").coalesce(1)
    done = spark.createDataFrame([("done", None), ("never", "failed before")], "key string, error string")
    got = {r["key"]: (r["tries"], r["error"]) for r in sinks.upload(rows, done, "key", factory, wait=0).collect()}
    assert got == {"now": (1, None), "later": (3, None), "never": (3, "OSError: store is busy")}
    assert sorted(open(log).read().split()) == ["later", "now"]


def test_crops_and_named_files(spark, tmp_path):
    crops = spark.createDataFrame([("a-1", bytearray(b"png"), "42", "manual", 10.25), ("a-2", bytearray(b"x"), " ", "manual", 3.0)], "key string, image binary, text string, source string, original_height double")
    assert sinks.write_crops(crops, uri(tmp_path / "set")) == 1
    assert (tmp_path / "set/crops/a-1.png").read_bytes() == b"png"
    labels = spark.read.csv(str(tmp_path / "set/labels.csv"), header=True).collect()
    assert [tuple(r) for r in labels] == [("a-1.png", "42", "manual", "10.2")]
    sinks.write_named(spark.createDataFrame([("x/y.txt", bytearray(b"1"))], "path string, data binary"), uri(tmp_path / "n")).collect()
    sinks.write_named(spark.createDataFrame([("x/y.txt", bytearray(b"22"))], "path string, data binary"), uri(tmp_path / "n")).collect()
    assert (tmp_path / "n/x/y.txt").read_text() == "22"


def test_old_scans_are_set_aside(spark, tmp_path):
    for name in ("reads", "recheck", "second"):
        (tmp_path / name).write_text("new")
    (tmp_path / "reads.old").write_text("older")
    assert sinks.set_old_aside(spark, uri(tmp_path), ["reads", "recheck", "none"]) == ["reads", "recheck"]
    assert sorted(p.name for p in tmp_path.glob("[!.]*")) == ["reads.old", "recheck.old", "second"] and (tmp_path / "reads.old").read_text() == "new"


def test_photos_of_a_run(spark):
    photos = spark.createDataFrame([(f, f"{i}.jpg") for f in "abc" for i in range(20)], "folder string, name string")
    reviews = photos.filter("folder <> 'c'")
    some = [tuple(r) for r in selection.photos_of_run(photos, reviews=reviews, limit=10).collect()]
    assert some == [tuple(r) for r in selection.photos_of_run(photos.repartition(5), reviews=reviews, limit=10).collect()]
    assert len(some) == 10 and sum(f == "a" for f, _ in some) == 5
    assert selection.photos_of_run(photos, folders=["a"]).count() == 20 and [r["name"] for r in selection.photos_of_run(photos, limit=2).collect()] == ["0.jpg", "1.jpg"]


def test_training_boxes(spark):
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    hits = [("7", 0.5, 0.9, box(0)), ("7", 0.9, 0.9, box(100)), ("8", 0.8, 0.1, box(101)), ("", 0.1, 0.7, box(300)), ("", 0.1, 0.2, box(400))]
    key = spark.createDataFrame([(1, ["7", "8"]), (2, ["9"]), (3, []), (4, []), (5, ["1"])], "photo int, bibs array<string>")
    runs = spark.createDataFrame([(1, 5, hits), (2, 1, []), (3, 0, []), (4, 2, [])], "photo int, regions int, hits array<struct<text:string,conf:double,det_conf:double,box:struct<x0:double,y0:double,x1:double,y1:double>>>")
    files = spark.createDataFrame([(i, f"{i}.jpg") for i in range(1, 6)], "photo int, file_name string")
    manual = spark.createDataFrame([(5,)], "photo int")
    got = {r["photo"]: (r["kind"], r["boxes"]) for r in selection.training_set(key, runs, files, manual).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "full", 3: "background", 5: "manual"}
    assert [b["x0"] for b in got[1][1]] == [100.0, 0.0, 300.0]  # the sure read, then what the detector was sure of
    with_sizes = selection.training_set(key, runs, files, manual).withColumn("width", F.lit(1000)).withColumn("height", F.lit(100)).withColumn("text", F.when(F.col("kind") == "manual", "by hand"))
    labels = {r["path"]: bytes(r["data"]).decode() for r in sinks.label_files(with_sizes).collect()}
    assert labels["labels/train/photo_0003.txt"] == "" and labels["labels/train/photo_0005.txt"] == "by hand" and labels["labels/train/photo_0001.txt"].startswith("0 0.105000 0.050000 0.010000 0.100000\n")
