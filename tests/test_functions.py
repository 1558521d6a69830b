from pyspark.sql import functions as F

from stridemark.functions import geometry as g
from stridemark.functions import text as t
from stridemark.functions import times


def table(spark, column, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(column).collect()]


def test_digits(spark):
    v = F.col("v")
    assert table(spark, t.normalise_digits(v), ["O1S", " l7B ", "5", "1234567", None, "#42"]) == ["015", "178", "", "", "", "42"]
    assert table(spark, t.clean_number(v), ["No. 0042", "2?15", "0?5", "00?1", "123456789", None]) == ["42", "2?15", "0?5", "?1", "1234567", ""]
    assert table(spark, t.only_digits(v), ["a1b2345678", None]) == ["123456", ""]
    assert table(spark, t.bare_number(v), ["bib 007", "000", "٣4"]) == ["7", "", "4"]
    assert table(spark, t.split_bibs(v), [" 12; #34|,x 5", None, ""]) == [["12", "34", "5"], [], []]


def test_patterns_and_similarity(spark):
    rows = spark.createDataFrame([("23?5", "2315"), ("23?5", "235"), ("2?15", "2315")], "p string, n string")
    assert [r[0] for r in rows.select(t.pattern_matches(F.col("p"), F.col("n"))).collect()] == [True, False, True]
    pairs = spark.createDataFrame([("word", "words"), ("1514", "514"), ("1308", "1300")], "a string, b string")
    assert [round(r[0], 4) for r in pairs.select(t.similarity(F.col("a"), F.col("b"))).collect()] == [0.5714, 0.2857, 0.4286]
    assert table(spark, t.one_deletions(F.col("v")), ["112", ""]) == [["112", "12", "11"], [""]]


def test_names(spark):
    v = F.col("v")
    point, km = t.course_point(v)
    assert table(spark, point, ["IMG_START_1", "a 10 K", "x5k", "polumaraton", "Cilj", "IMG"]) == ["Start", "10K", "5K", "Half", "Finish", None]
    assert table(spark, km, ["a30k"]) == [30.0]
    assert table(spark, t.race_code(v, F.lit("2100")), ["42K štafeta", "Polumaraton", "Maraton", "10K", "fun 5 k", None]) == ["relay", "half", "marathon", "10k", "10k", "half"]
    assert table(spark, t.gender(v), ["žena", "W", "muški", "x", None]) == ["F", "F", "M", None, None]
    assert table(spark, t.slug(v), ["Đorđe šah 7", None]) == ["OreSah7", None]
    assert t.header_key("Datum rođenja") == "datumrodenja" and t.header_key("Start No.") == "startno"
    assert table(spark, t.first_object(v, "struct<a:int>")["a"], ['said ```json\n{"a": 1}\n```', '{"a": 2}', 'so {"a": 3} it', "no"]) == [1, 2, 3, None]
    order = spark.createDataFrame([("a_10.jpg",), ("a_2.jpg",), ("B1.jpg",)], "v string").orderBy(t.natural_key(v))
    assert [r[0] for r in order.collect()] == ["a_2.jpg", "a_10.jpg", "B1.jpg"]
    import hashlib
    import hmac

    assert table(spark, t.media_token(F.lit("e"), v, "k"), ["f.jpg"]) == [hmac.new(b"k", b"e/f.jpg", hashlib.sha256).hexdigest()[:24]]
    assert table(spark, t.ordinal(F.col("v")), [1, 2, 3, 11, 112, 23], "int") == ["1st", "2nd", "3rd", "11th", "112th", "23rd"]


def test_times(spark):
    v = F.col("v")
    raw = ["3:24:17", "03:24:17.4", "41:12", "95:12", "3h24m17s", "DNF", "1:00:61", "100:00:00", "n/a", None]
    assert table(spark, times.parse_duration(v), raw) == [12257, 12257, 2472, 5712, 12257, None, None, None, None, None]
    dates = ["1989-03-14", "14.03.1989", "14-3-89", "19890314", "31.02.1990", "3/4/05", "x", None]
    assert [str(x) if x else None for x in table(spark, times.parse_date(v), dates)] == ["1989-03-14", "1989-03-14", "1989-03-14", "1989-03-14", None, "2005-04-03", None, None]
    assert table(spark, times.pace(F.col("v"), F.lit(42.195)), [12257, None], "int") == ["4:50", None]
    assert table(spark, times.pace(F.col("v"), F.lit(1.0)), [3700], "int") == ["1:40"]  # the hour is lost, as it has to be
    assert table(spark, times.clock(F.col("v")), [108000], "int") == ["30:00:00"]
    assert table(spark, times.clock_label(v.try_cast("timestamp"), "Europe/Zagreb", 80), ["2025-07-01 08:37:00", None]) == ["10:37", "10:20"]


def test_boxes(spark, one):
    a, b = g.box(0, 0, 100, 50), g.box(5, 3, 104, 55)
    assert one(g.same_bib(a, b)) and not one(g.same_bib(a, g.box(300, 0, 400, 50)))
    assert one(g.iou(a, a)) == 1 and one(g.iou(a, g.box(200, 0, 300, 10))) == 0
    assert tuple(one(g.fit_size(F.lit(2000), F.lit(1333), 1.0))) == (2000, 1333)
    w, h = one(g.fit_size(F.lit(6000), F.lit(4000), 1.0))
    assert max(w, h) <= 2576 and -(-w // 28) * -(-h // 28) <= 4784
    assert one(g.box_key(g.box(0.5, 1.5, 2.5, 3.49))) == "0,2,2,3"
    assert one(g.wrapped_rotation(F.lit(190.0))) == -170 and one(g.wrapped_rotation(F.lit(180.0))) == 180
    turned = one(g.bounds(g.corners(g.box(0, 0, 10, 20), F.lit(90.0))))
    assert [round(x, 6) for x in turned] == [-5, 5, 15, 15]
    assert one(g.relative_box(g.box(10, 10, 30, 20), F.lit(100), F.lit(100))) == "0.200000 0.150000 0.200000 0.100000"
    boxes = F.array(*[F.struct(F.lit(c).alias("conf"), g.box(x, 0, x + 10, 10).alias("box")) for c, x in ((0.5, 0), (0.9, 1), (0.4, 30))])
    assert [k["conf"] for k in one(g.suppress(boxes))] == [0.9, 0.4]


def test_numbers_of_lists_are_whole(spark, tmp_path):
    from stridemark.plans import registry

    rows = [(9, 1234567, 1234568, 7), (9, 12, 3, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["split_bib_lists"](spark, str(tmp_path)).collect()
    assert {r["bibs"] for r in got} == {"1234567/1234568/7", "12/3/1"}
