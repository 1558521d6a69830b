from pyspark.sql import functions as F

from stridemark.operators import bursts as b
from stridemark.operators import evidence as ev


def read(source, number, legibility="clear", cut="none", is_bib=True):
    return F.struct(F.lit(source).alias("source"), F.lit(number).alias("number"), F.lit(legibility).alias("legibility"), F.lit(cut).alias("cut"), F.lit(is_bib).alias("is_bib"))


def none():
    return F.lit(None).cast(b.READ)


def test_full_and_clear(one):
    assert one(b.full(read("s", "2315"))) == "2315" and one(b.clear(read("s", "2315")))
    assert one(b.full(read("s", "2315", "partial", "left"))) is None and one(b.full(read("s", "23?5"))) is None
    assert one(b.full(read("s", "2315", "clear", "left"))) == "2315" and not one(b.clear(read("s", "2315", "clear", "left")))


def test_decide(one):
    d = lambda looks, zoom=None, judge=None: one(b.decide(F.array(*looks), none() if zoom is None else zoom, none() if judge is None else judge))
    assert (r := d([read("survey", "2315")], read("zoom", "2315")))["status"] == "accept" and r["number"] == "2315"
    assert d([read("survey", "2315")], read("zoom", "2316"))["status"] == "judge"
    r = d([read("survey", "2315")], read("zoom", "2316"), read("judge", "2316"))
    assert (r["status"], r["number"], r["how"]) == ("accept", "2316", "judge")
    assert d([read("survey", "2315")], read("zoom", "", "unreadable", is_bib=False))["status"] == "drop"
    r = d([read("survey", "23?5", "partial")])
    assert (r["status"], r["pattern"]) == ("review", "23?5")
    assert d([read("survey", "", "unreadable")])["why"] == "unreadable"
    r = d([read("survey", "1")], read("zoom", "2"), read("judge", "3", "partial", "none"))
    assert r["status"] == "review" and r["candidates"] == ["3", "1", "2"]


def decisions(spark, rows):
    schema = f"photo string, bib int, d {b.DECISION}"
    return spark.createDataFrame([(p, n, dict({"status": None, "number": None, "how": None, "candidates": None, "pattern": None, "why": None}, **d)) for p, n, d in rows], schema)


def test_resolve(spark):
    rows = decisions(spark, [
        ("a1", 0, {"status": "accept", "number": "2315"}), ("a2", 0, {"status": "accept", "number": "861"}),
        ("a3", 0, {"status": "judge", "candidates": ["2315", "2316"]}), ("a4", 0, {"status": "review", "candidates": [], "pattern": "8?1"}),
        ("a6", 0, {"status": "judge", "candidates": ["1", "2"]}), ("b1", 0, {"status": "accept", "number": "2316"}),
    ])
    frames = spark.createDataFrame([("f", i, f"a{i}") for i in range(1, 7)] + [("g", 1, "b1")], "folder string, position int, photo string")
    got = {r["photo"]: (r["numbers"], r["needs_human"]) for r in b.results(b.resolve(rows, frames, None, 2)).collect()}
    assert got["a3"] == (["2315"], 0) and got["a4"] == (["861"], 0) and got["a6"] == ([], 1)
    start = spark.createDataFrame([("2315",), ("861",)], "number string")
    d = {r["photo"]: r["d"] for r in b.resolve(rows, frames, start, 2).collect()}
    assert d["b1"]["status"] == "review" and "2315" in d["b1"]["candidates"] and d["b1"]["why"] == "not on the start list"


def test_valid_candidates_of_one_name_count_together(spark):
    judge = lambda *c: {"status": "judge", "candidates": list(c)}
    rows = decisions(spark, [("a", 0, judge("1", "9")), ("a", 0, judge("2")), ("a", 1, judge("1", "9")), ("b", 0, judge("1", "9")), ("b", 0, judge("1", "9")), ("c", 0, judge("8", "9")), ("c", 0, judge("2"))])
    frames = spark.createDataFrame([("f", 0, "a"), ("f", 100, "b"), ("f", 200, "c")], "folder string, position int, photo string")
    start = spark.createDataFrame([("1",), ("2",)], "number string")
    got = {r["photo"]: (r["numbers"], r["needs_human"]) for r in b.results(b.resolve(rows, frames, start)).collect()}
    assert got == {"a": (["1"], 2), "b": ([], 2), "c": (["2"], 1)}


def test_clusters(spark):
    rows = [("p", 0, 0.0, 0.0, 100.0, 50.0, "survey", "1", "partial", "none", True), ("p", 1, 5.0, 3.0, 104.0, 55.0, "tile0", "12", "clear", "left", True), ("p", 2, 300.0, 0.0, 400.0, 50.0, "survey", "7", "clear", "none", True)]
    got = b.clusters(spark.createDataFrame(rows, "photo string, pos int, x0 double, y0 double, x1 double, y1 double, source string, number string, legibility string, cut string, is_bib boolean")).collect()
    assert [(r["x0"], r["x1"], r["y1"], len(r["reads"])) for r in got] == [(0.0, 104.0, 55.0, 2), (300.0, 400.0, 50.0, 1)]


def test_verdicts(spark):
    schema = "reads array<struct<text:string,conf:double>>, s struct<numbers:array<string>,clarity:map<string,string>,error:string>"
    rows = [
        ([("12", 0.9)], None), ([("12", 0.5)], None), ([], None), ([("12", 0.5)], ([], {}, "down")), ([("12", 0.5), ("13", 0.4)], (["13"], {"13": "clear"}, None)),
        ([("12", 0.5)], (["12"], {"12": "partial"}, None)), ([("12", 0.5)], (["99"], {}, None)), ([], (["99"], {}, None)), ([("12", 0.5)], ([], {}, None)), ([], ([], {}, None)),
    ]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, schema).coalesce(1).select(ev.judge(F.col("reads"), F.col("s"))).collect()]
    assert got == [("confident", ["12"], False), ("model_only", ["12"], True), ("model_only", [], False), ("error", ["12"], True), ("agree", ["13"], False), ("agree", ["12"], True), ("disagree", ["99"], True), ("haiku_only", ["99"], True), ("disagree", [], True), ("empty", [], False)]


def test_suggestions(spark):
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    hits = [("p", 0, "1234", 0.95, box(0)), ("p", 1, "555", 0.7, box(20)), ("p", 2, "666", 0.2, box(40)), ("q", 0, "321", 0.65, box(0)), ("q", 1, "400", 0.65, box(50))]
    h = spark.createDataFrame(hits, "photo string, pos int, text string, conf double, box struct<x0:double,y0:double,x1:double,y1:double>")
    second = spark.createDataFrame([("p", ["1234", "888", "9"], {"1234": "clear", "888": "clear"}, None), ("q", [], {}, None)], "photo string, numbers array<string>, clarity map<string,string>, error string")
    got = {r["photo"]: r for r in ev.suggestions(h, second).collect()}
    assert got["p"]["numbers"] == ["1234", "888"] and got["p"]["needs_human"] == 1
    assert [(x["number"], x["verdict"]) for x in got["p"]["persons"]] == [("1234", "agree"), ("555", "model_only"), ("666", "model_only"), ("888", "whole_only")]
    recheck = spark.createDataFrame([("q", "0,0,10,10", ["321"], {"321": "clear"}, []), ("q", "50,0,60,10", ["401"], {"401": "clear"}, [("401", 0.6)])], "photo string, key string, numbers array<string>, clarity map<string,string>, local array<struct<text:string,conf:double>>")
    q = {r["photo"]: r for r in ev.suggestions(h, second, recheck=recheck).collect()}["q"]
    assert q["numbers"] == ["321", "401"] and q["needs_human"] == 0 and [x["verdict"] for x in q["persons"]] == ["agree", "replaced"]


def test_import_reads(spark):
    rows = spark.createDataFrame([("a", "12, 7", ["12", "34", "5"], True), ("b", "", ["88", "9"], True), ("c", None, ["77"], None)], "file_name string, bibs string, model_numbers array<string>, reviewed boolean")
    got = {tuple(r) for r in ev.imported_reads(rows).collect()}
    assert got == {("a", "12", 1.0, 0, "review"), ("a", "7", 1.0, 0, "review"), ("a", "34", 0.35, 1, "ocr"), ("b", "88", 0.35, 1, "rejected"), ("c", "77", 0.35, 1, "ocr")}
