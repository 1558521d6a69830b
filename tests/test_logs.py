import json
import threading

import pytest
from pyspark.sql import functions as F

from stridemark.operators import merge
from stridemark.sources import logs
from stridemark.sources.files import append_log
from stridemark.sources.sinks import save_entries

SCHEMA = "k string, n int"


def test_the_last_append_counts(spark, tmp_path):
    for name in "abcdef":
        path = str(tmp_path / name)
        for n in range(6):
            logs.append(spark.createDataFrame([("x", n), ("y", 10 * n)], SCHEMA).repartition(2, "k"), path)
        log = append_log(spark, path, SCHEMA)
        assert log.count() == 12
        assert {(r["k"], r["n"]) for r in merge.latest(log, "k", "seq").collect()} == {("x", 5), ("y", 50)}


def test_rows_of_one_append_stay_in_order(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("n"))
    logs.append(rows, str(tmp_path / "log"))
    got = logs.read_log(spark, str(tmp_path / "log"), SCHEMA, size=1000)
    assert got.rdd.getNumPartitions() > 20
    assert [r["n"] for r in got.orderBy("seq").collect()] == list(range(5000))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 1000])
def test_every_line_is_in_one_range(spark, tmp_path, size):
    texts = [json.dumps({"k": "é" * i, "n": i}, ensure_ascii=False) for i in range(6)] + ["", '{"k": "torn', json.dumps({"k": "last", "n": 7})]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(texts) + "\n" + '{"k": "no end')
    got = [r["n"] for r in logs.read_log(spark, str(path), SCHEMA, size=size).orderBy("seq").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 7]


def test_a_torn_line_is_read_when_it_is_whole(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"k": "a", "n": 1}\n{"k": "b", ')
    assert [r["n"] for r in logs.read_log(spark, str(path), SCHEMA).collect()] == [1]
    at = logs.position(spark, str(path))
    assert at == {"": 19}
    with path.open("a") as f:
        f.write('"n": 2}\n{"k": "c", "n": 3}\n')
    assert [r["n"] for r in append_log(spark, str(path), SCHEMA, at).orderBy("seq").collect()] == [2, 3]
    assert logs.position(spark, str(path), at)[""] == path.stat().st_size


def test_a_log_is_followed(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    logs.append(spark.createDataFrame([("a", 1)], SCHEMA), path)

    def run():
        query = logs.follow_log(spark, path, SCHEMA).writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda b, _: seen.extend(r["n"] for r in b.collect())).trigger(availableNow=True).start()
        query.awaitTermination(60)

    run()
    assert seen == [1]
    logs.append(spark.createDataFrame([("b", 2), ("c", 3)], SCHEMA).coalesce(1), path)
    run()
    assert seen == [1, 2, 3]
    run()
    assert seen == [1, 2, 3]


def test_appends_of_several_writers_all_stay(spark, tmp_path):
    path = str(tmp_path / "log")
    work = [threading.Thread(target=lambda i=i: logs.append(spark.createDataFrame([(f"w{i}", i)], SCHEMA), path)) for i in range(6)]
    [t.start() for t in work]
    [t.join() for t in work]
    rows = logs.read_log(spark, path, SCHEMA).collect()
    assert sorted(r["n"] for r in rows) == list(range(6)) and len({r["seq"]["file"].split("/")[0] for r in rows}) == 6


def test_an_empty_or_missing_log(spark, tmp_path):
    assert logs.read_log(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    logs.append(spark.createDataFrame([], SCHEMA), str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log"), SCHEMA).count() == 0


def test_saved_entries(spark, tmp_path):
    kind, log = "k string, n int, at bigint", str(tmp_path / "entries")
    save_entries(log, spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kind), "k", "at")
    now = save_entries(log, spark.createDataFrame([("a", 2, 2)], kind), "k", "at")
    assert now.columns == ["k", "n", "at"] and sorted(map(tuple, now.collect())) == [("a", 2, 2), ("b", 1, 1)]


def test_two_writers_of_a_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    merge.change_version(spark, folder, lambda old: spark.createDataFrame([("start",)], "who string"))
    begun, tries = threading.Barrier(2, timeout=60), []

    def writer(name):
        def change(old):
            tries.append(name)
            if tries.count(name) == 1:
                begun.wait()  # both have read the same version
            return old.unionByName(spark.createDataFrame([(name,)], "who string"))

        merge.change_version(spark, folder, change)

    work = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    [t.start() for t in work]
    [t.join() for t in work]
    assert sorted(r["who"] for r in merge.read_version(spark, folder).collect()) == ["a", "b", "start"]
    assert merge.versions(spark, folder) == [1, 2, 3] and len(tries) == 3
    with pytest.raises(FileExistsError):
        merge.write_version(spark.range(1), folder, 2)
