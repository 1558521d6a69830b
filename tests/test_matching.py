import datetime
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridemark.operators import matching as m


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123", max_size=5), max_size=15), st.lists(st.text("0123", max_size=5), max_size=15))
def test_near_texts(spark, a, b):
    x, y = (spark.createDataFrame([(v,) for v in vs], f"{n} string") for vs, n in ((a, "a"), (b, "b")))
    got = {tuple(r) for r in m.near_texts(x, y, "a", "b").collect()}
    assert got == {(p, q) for p in a for q in b if p != q and edit(p, q) <= 1}


def event(spark):
    runners = spark.createDataFrame([(1, b, f"n{b}", 1 if b == "1234" else None, "finished", 12257) for b in ("1234", "1235", "77")], "event_id int, bib string, full_name string, race_id int, status string, finish_s bigint")
    runners = runners.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("category", "string"), ("club", "string"), ("nationality", "string"), ("place_overall", "int"), ("place_category", "int"), ("chip_s", "bigint"))])
    day = datetime.datetime(2025, 1, 1)
    photos = spark.createDataFrame([(1, 1, "b.jpg", 5.0, day), (2, 1, "a.jpg", None, None), (3, 1, "c.jpg", 5.0, None), (4, 1, "d.jpg", 1.0, day), (5, 1, "_test/e.jpg", None, day)], "photo_id int, event_id int, file_name string, course_km double, captured_at timestamp")
    reads = [
        (1, "1234", 0.9, "ocr"), (1, "1234", 0.7, "ocr"), (1, "1235", 0.9, "ocr"),
        (2, "1236", 0.3, "ocr"), (2, "123", 0.29, "ocr"), (2, "1244", None, "ocr"),
        (3, "1234", None, "ocr"), (3, "1237", 0.9, "ocr"),
        (4, "1235", 1.0, "review"), (4, "1234", 0.9, "ocr"), (4, "999", 0.9, "rejected"),
        (5, "77", 0.9, "rejected"), (5, "7", 0.9, "ocr"),
    ]
    return runners, photos, spark.createDataFrame(reads, "photo_id int, bib_text string, confidence double, source string")


def test_gallery(spark):
    rows = m.gallery(*event(spark)).collect()
    got = {(r["bib"], r["photo_id"]): (r["match_kind"], r["read_as"], r["match_score"], r["bibs_in_photo"], r["place"]) for r in rows}
    assert got[("1234", 1)][:2] == ("exact", "1234") and got[("1234", 1)][2:4] == (0.9, 2)
    assert got[("1234", 2)][:2] == ("fuzzy", "1236")  # 123 is too unsure, 1244 has no confidence
    assert got[("1234", 3)][:3] == ("exact", "1234", 0.5)
    assert ("1234", 4) not in got and got[("1235", 4)][3] == 1  # a person confirmed another bib there
    assert ("77", 5) not in got  # rejected; and two digits never match nearly
    assert [got[("1234", p)][4] for p in (1, 3, 2)] == [1, 2, 3]
    for (bib, _), (kind, read, score, _, _) in got.items():
        assert (kind == "exact") == (bib == read) and 0 <= score <= 1 and edit(bib, read) <= 1


def test_export_and_stats(spark):
    runners, photos, detections = event(spark)
    races = spark.createDataFrame([(1, 1, "marathon", "Maraton", 42.195)], "event_id int, race_id int, code string, name string, distance_km double")
    out = {r["bib"]: json.loads(r["payload"]) for r in m.export(runners, races, photos, detections).collect()}
    assert set(out) == {"1234", "1235", "77"} and out["77"]["photos"] == []
    assert out["1234"]["runner"]["time"] == "3:24:17" and out["1234"]["runner"]["category"] is None and out["77"]["runner"]["race"] == "Marathon"
    assert [p["id"] for p in out["1234"]["photos"]] == [1, 3, 2]
    events = spark.createDataFrame([(1, "e", True, True)], "event_id int, slug string, published boolean, db_search boolean")
    stats = m.event_stats(events, races, runners, photos, detections).first()
    assert (stats["finishers"], stats["photos"], stats["tagged_bibs"], stats["recognitions"], stats["course_record"]) == (3, 4, 3, 1, "3:24:17")


def test_reasons(spark):
    events = spark.createDataFrame([(1, "e", True, True), (2, "shut", True, False), (3, "no", False, True)], "event_id int, slug string, published boolean, db_search boolean")
    runners = spark.createDataFrame([(1, "12", datetime.date(1990, 1, 1)), (1, "13", None), (2, "12", None)], "event_id int, bib string, dob date")
    d = datetime.date(1990, 1, 1)
    asked = [("e", " 12", d, None), ("e", "12", datetime.date(1991, 1, 1), None), ("e", "13", d, None), ("e", "13", None, None), ("e", "99", None, None), ("e", "x", None, None), ("shut", "12", None, "anon"), ("shut", "12", None, "service"), ("no", "12", None, None)]
    rows = spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "slug string, bib string, dob date, caller_role string, i int")
    got = m.find_runner(rows.drop("i"), events, runners).collect()
    want = {("e", "12", d, None): "ok", ("e", "12", datetime.date(1991, 1, 1), None): "dob_mismatch", ("e", "13", d, None): "dob_mismatch", ("e", "13", None, None): "ok", ("e", "99", None, None): "no_bib", ("e", "", None, None): "missing_input", ("shut", "12", None, "anon"): "no_event", ("shut", "12", None, "service"): "ok", ("no", "12", None, None): "no_event"}
    assert {tuple(r)[:4]: r["reason"] for r in got} == want


def test_patterns(spark):
    p = spark.createDataFrame([("23?5",), ("?1",), ("7",)], "p string")
    n = spark.createDataFrame([("2315",), ("2395",), ("235",), ("71",), ("7",)], "n string")
    assert {tuple(r) for r in m.complete_patterns(p, n, "p", "n").collect()} == {("23?5", "2315"), ("23?5", "2395"), ("?1", "71"), ("7", "7")}
    a = spark.createDataFrame([("123",), ("12",)], "a string")
    b = spark.createDataFrame([("124",), ("223",), ("123",), ("321",), ("13",)], "b string")
    assert {tuple(r) for r in m.one_digit_apart(a, b, "a", "b").collect()} == {("123", "124"), ("123", "223"), ("12", "13")}
