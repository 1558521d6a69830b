import duckdb
import pytest
from conftest import SMALL

from stridemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def values(rows):
    norm = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", ["gallery_full", "event_stats", "export_page", "evidence_merge", "import_reads", "score_buckets", "threshold_sweep", "upsert_merge", "burst_support", "session_quota", "parse_duration", "export_payload", "find_runner_answers", "evidence_recheck", "iou_nms", "fitted_sizes", "cluster_boxes", "bib_decisions", "burst_resolution", "review_packs", "training_kinds", "bib_export_files", "gallery_labels", "takedown_runners", "cost_estimate"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.queries()[name](spark, SMALL)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert values(got.select(*columns).collect()) == values(want.select(*[f'"{c}"' for c in columns]).fetchall())


def sql_rows(sql, tables=TABLES):
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db.sql(sql).fetchall()


def same(got, name):
    columns = sorted(got.columns)
    return values(got.select(*columns).collect()) == values(sql_rows(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})"))


def test_all_photographer_files(spark):
    got = registry.queries()["photographer_files"](spark, SMALL)
    assert same(got, "photographer_files")
    assert sum(r["photos"] for r in got.collect()) == sum(r["files"].count(".jpg") for r in got.collect()) == sql_rows("SELECT count(*) FROM orders")[0][0]


def test_all_start_list_neighbours(spark):
    got = registry.queries()["start_list_neighbours"](spark, SMALL)
    assert same(got, "start_list_neighbours")
    assert {r["a"] for r in got.collect()} == {str(k) for (k,) in sql_rows("SELECT c_custkey FROM customer WHERE length(c_custkey::VARCHAR) <= (SELECT max(length(p_partkey::VARCHAR)) FROM part)")}


def test_all_pattern_completions(spark, tmp_path):
    assert same(registry.queries()["pattern_completions"](spark, SMALL), "pattern_completions")
    spark.createDataFrame([(k,) for k in (3, 12, 20, 21, 140)], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k,) for k in (1, 10, 25, 29, 30, 149)], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["pattern_completions"](spark, str(tmp_path)).collect()  # no decade but the first has a ..3
    assert {tuple(r) for r in got} == {("?", "1"), ("1?", "10"), ("2?", "25"), ("2?", "29"), ("14?", "149")} and len(got) == 5


def test_natural_order_of_all(spark, tmp_path):
    got = registry.queries()["natural_order"](spark, SMALL)
    assert same(got, "natural_order")
    assert sorted(r["place"] for r in got.collect()) == list(range(1, sql_rows("SELECT count(*) FROM part")[0][0] + 1))
    brands = ["b10", "B9", "b9", "a2x10", "a2x9", "a", None]
    spark.createDataFrame(list(enumerate(brands)), "p_partkey bigint, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["natural_order"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["brand"] for r in got] == [None, "a", "a2x9", "a2x10", "b9", "b9", "b10"] and [r["p_partkey"] for r in got][4:6] == [1, 2]


def test_every_query_has_a_plan(spark):
    for name, q in registry.queries().items():
        assert q(spark, SMALL).columns, name


def test_all_photos_are_numbered(spark):
    got = registry.queries()["number_after_max"](spark, SMALL)
    assert same(got, "number_after_max")
    assert got.count() == sql_rows("SELECT count(*) FROM orders")[0][0]
