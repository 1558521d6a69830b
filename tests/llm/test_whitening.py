import math
import random

import numpy as np
import pytest
from conftest import SMALL

from stridemark.llm import queries, whitening

KIND = "vec_id bigint, embedding array<double>, n string, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in vectors], KIND)


def brute(vectors, k):
    """x of the vectors that take part, by id; mean, eigenvalues and components by LAPACK."""
    ok = [(i, v) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in ok]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    ok = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in ok if len(v) == d]
    x = np.array([v for _, v in ok], float)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return [i for i, _ in ok], [v for _, v in ok], c, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check(got, vectors, k=32):
    ids, x, centred, values, parts, total = brute(vectors, k)
    keep = values > 1e-9 * values[0]
    values, parts = values[keep], parts[:, keep]
    n, sums = len(ids), [sum(col) for col in zip(*x, strict=True)]
    assert len(got) == n * len(values)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, len(values) + 1))
    assert max(abs(r["identity_error"]) for r in got) < 1e-9 and {r["n"] for r in got} == {n}
    far = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in zip(ids, x, strict=True)}
    assert all(r["deviation"] == far[r["vec_id"]] for r in got)
    for j, rows in by.items():
        want = centred @ parts[:, j - 1] / np.sqrt(values[j - 1])
        mine = {r["vec_id"]: r["whitened"] for r in rows}
        z = np.array([mine[i] for i in ids])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-8
        assert abs(rows[0]["explained"] - values[j - 1] / total) < 1e-10


def some(n, d, seed=0, scale=None):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * (np.linspace(4, 0.5, d) if scale is None else scale)
    return [(i, list(map(float, v))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "block"), [(300, 40, None), (200, 40, 34), (90, 7, None), (20, 40, None), (500, 90, 33)])
def test_against_brute_force(spark, n, d, block):
    vectors = some(n, d, d)
    check(whitening.whiten(table(spark, vectors).repartition(3), block=block).collect(), vectors)


def test_a_flat_spectrum_grows_the_block(spark):
    vectors = some(3000, 48, 3, 1.0)
    rows = whitening.whole_numbers(table(spark, vectors))
    slow = whitening.fit(rows, k=8, block=9, patience=3)
    assert slow.residual <= 1e-13 or slow.passes < 20
    _, _, centred, values, parts, _ = brute(vectors, 8)
    assert np.allclose(slow.values, values, rtol=1e-12) and np.allclose(np.abs((slow.components * parts).sum(axis=0)), 1, atol=1e-10)


def test_odd_rows(spark):
    vectors = some(60, 5, 1) + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0])]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)
    twice = vectors + [(3, vectors[3][1])]
    got = whitening.whiten(table(spark, twice)).collect()
    assert sum(r["vec_id"] == 3 for r in got) == 10 and got[0]["n"] == 61
    none = whitening.whiten(table(spark, [(None, v) for _, v in vectors]))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and {r["vec_id"] for r in none.collect()} == {None}


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whiten(table(spark, vectors)).collect() == []
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]  # one direction only
    check(whitening.whiten(table(spark, line)).collect(), line)


def test_large_entries_stay_exact(spark):
    r = random.Random(1)
    vectors = [(i, [r.uniform(-1e12, 1e12), r.uniform(-1, 1), float(i)]) for i in range(40)] + [(99, [1e300, 0.0, 0.0])]
    got = {x["vec_id"]: x["deviation"] for x in whitening.whiten(table(spark, vectors)).collect()}
    assert 99 not in got and len(got) == 40 and set(got.values()) == {None}
    fine = [(i, [v[0] / 1e6, *v[1:]]) for i, v in vectors[:-1]]
    exact = {x["vec_id"]: x["deviation"] for x in whitening.whiten(table(spark, fine)).collect()}
    whole = [[math.floor(64 * a) + 1_000_000 for a in v] for _, v in fine]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert exact == {i: e if (e := sum((40 * a - s) ** 2 for a, s in zip(v, sums, strict=True))) < 1 << 63 else None for (i, _), v in zip(fine, whole, strict=True)}


def test_query(spark):
    import duckdb

    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    check(queries.queries()["op13_whitening"](spark, SMALL).collect(), vectors)
