import random

from pyspark.sql import functions as F

from stridemark.operators import lookup
from stridemark.operators import matching as m

from test_matching import event


def made(spark, seed, runners=40, photos=60):
    r = random.Random(seed)
    numbers = lambda k: str(r.randint(10 ** (k - 1), 10**k - 1))
    bibs = sorted({numbers(r.choice((2, 3, 3, 4))) for _ in range(runners)})
    reads = []
    for p in range(photos):
        for _ in range(r.randint(0, 5)):
            text = r.choice(bibs)
            if r.random() < 0.6:
                i = r.randrange(len(text))
                text = r.choice((text[:i] + r.choice("0123456789") + text[i + 1 :], text[:i] + text[i + 1 :], text[:i] + "7" + text[i:]))
            reads.append((p, text, r.choice((None, 0.2, 0.3, 0.8)), r.choice(("ocr", "ocr", "ocr", "ocr", "review", "rejected"))))
    run = spark.createDataFrame([(1 + (len(b) == 2), b) for b in bibs], "event_id int, bib string")
    pic = spark.createDataFrame([(p, 1 + p % 2, f"{p}.jpg", None) for p in range(photos)], "photo_id int, event_id int, file_name string, captured_at timestamp").withColumn("course_km", F.lit(None).cast("double"))
    return run, pic, spark.createDataFrame(reads, "photo_id int, bib_text string, confidence double, source string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_question_is_part_of_the_whole(spark, tmp_path):
    for seed in range(3):
        runners, photos, reads = made(spark, seed)
        whole = m.gallery(runners, photos, reads).cache()
        asked = runners.filter(F.xxhash64("bib") % 3 == 0)
        want = rows(whole.join(asked, ["event_id", "bib"], "left_semi").select(*whole.columns))
        assert want and rows(m.gallery(runners, photos, reads, only=asked).select(*whole.columns)) == want
        folder = str(tmp_path / str(seed))
        lookup.write_reads(reads, folder, 1024)
        assert rows(m.gallery(runners, photos, lookup.read_reads(spark, folder), only=asked).select(*whole.columns)) == want


def test_more_than_a_few_go_the_ordinary_way(spark, monkeypatch):
    runners, photos, reads = event(spark)
    whole = m.gallery(runners, photos, reads)
    for most in (0, 1, 2, 3, 5):
        monkeypatch.setattr(lookup.few, "__defaults__", (most,))
        assert rows(m.gallery(runners, photos, reads, only=runners).select(*whole.columns)) == rows(whole)


def test_no_read_of_another_photo_is_shuffled(spark, tmp_path):
    runners, photos, reads = made(spark, 5, photos=400)
    reads.write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    asked = runners.limit(1)
    plan = m.gallery(runners, photos, reads, only=asked)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    dealt = [part.split("FileScan")[0] for part in plan.split("Exchange hashpartitioning(photo_id")[1:] if "FileScan" in part]
    assert dealt and all("LeftSemi" in part or "Exchange hashpartitioning" in part for part in dealt), plan  # reduced before


def test_reads_in_order_leave_out_what_does_not_match(spark, tmp_path):
    rows = spark.range(200_000).select(F.floor(F.col("id") / 4).alias("photo_id"), (F.col("id") * 7919 % 90_000 + 10_000).cast("string").alias("bib_text"), F.lit(0.9).alias("confidence"), F.lit("ocr").alias("source"))
    lookup.write_reads(rows, str(tmp_path / "r"), 64 << 10)
    kept = lookup.read_reads(spark, str(tmp_path / "r"))
    some = lookup.among(kept.by_text, "bib_text", spark.createDataFrame([("12345",)], "bib_text string"))
    assert some.count() == rows.filter("bib_text = '12345'").count()

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.finalPhysicalPlan() if plan.nodeName().startswith("Adaptive") else plan
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName())

    assert scanned(some) < 0.2 * rows.count() and scanned(lookup.among(kept.by_photo, "photo_id", spark.createDataFrame([(77,)], "photo_id bigint"))) < 0.2 * rows.count()
