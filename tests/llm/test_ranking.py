import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stridemark.llm import ranking

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """item, rank, doc_id, score; of rows with one item_id and text one, null doc_ids last of equal scores."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


WORDS = ["the", "Of", "zeta9", "año", "日本", "x", "rare", "𝒳", "aa", "bb", "cc", "dd"]


def corpus(r, n):
    weights = [40, 30, 5, 5, 3, 3, 1, 1, 10, 10, 8, 8]
    text = lambda size: "".join(w + r.choice([" ", "-", "\n", "_", " x ", "\x00"]) for w in r.choices(WORDS, weights, k=size))
    docs = [(i, text(r.choice((0, 1, 3, 20, 60)))) for i in range(n)]
    docs += [(None, "rare Rare zeta9"), (3, "rare zeta9"), (3, "rare zeta9"), (n + 1, None), (n + 2, ""), (n + 3, "--- \x7f@`"), (n + 4, "rare " * 4000)]
    docs += [(n + 10 + i, "the same copy of aa") for i in range(40)]  # ties of many
    r.shuffle(docs)
    items = [(1, "rare"), (2, "the Of"), (3, "aa bb cc aa"), (4, None), (5, ""), (6, "unknown"), (7, "the zeta9 año 日本 𝒳"), (7, "copy"), (8, "SAME same Copy"), (8, "SAME same Copy"), (None, "dd x"), (9, " ".join(WORDS) * 3)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = corpus(random.Random(seed), 150)
    frame = spark.createDataFrame(docs, DOCS).withColumnRenamed("text", "text")
    index = ranking.build(frame.repartition(3), shard_docs=(1 << 16, 7, 40)[seed], shard_bytes=(8 << 20, 1 << 20, 3000)[seed])
    got = rows(ranking.search(index, spark.createDataFrame(items, ITEMS), block_terms=(1 << 18, 4, 1)[seed]))
    assert got == brute(docs, items)


def test_fewer_and_none(spark):
    docs = [(1, "a b"), (2, "a"), (3, None)]
    index = ranking.build(spark.createDataFrame(docs, DOCS))
    assert rows(ranking.search(index, spark.createDataFrame([(1, "b a a"), (2, "c")], ITEMS))) == brute(docs, [(1, "b a a"), (2, "c")])
    assert rows(ranking.search(index, spark.createDataFrame([], ITEMS))) == []
    nothing = ranking.build(spark.createDataFrame([], DOCS))
    assert (nothing.n_docs, nothing.n_terms) == (0, 0) and rows(ranking.search(nothing, spark.createDataFrame([(1, "a")], ITEMS))) == []
    other = spark.createDataFrame([(1, "a b", "s", 7)], "doc_id bigint, text string, score string, rank bigint")
    assert rows(ranking.search(ranking.build(other), spark.createDataFrame([(1, "b")], ITEMS))) == brute([(1, "a b")], [(1, "b")])


def test_the_index_is_by_falling_impact(spark):
    docs = [(i, "a " * (i + 1) + "b") for i in range(9)]
    index = ranking.build(spark.createDataFrame(docs, DOCS).coalesce(1))
    row = index.rows.filter("term = 'a'").first()
    assert row["size"] == 9 and row["impacts"] == sorted(row["impacts"], reverse=True) and sorted(row["places"]) == list(range(9))
    assert index.rows.filter("term IS NULL").first()["ids"] == list(range(9))


def test_a_search_stops_early_and_is_exact(monkeypatch):
    """Most postings of a common term aren't read where a rare one decides, and what is left is completed."""
    n, r = 5000, np.random.default_rng(1)
    lists = [(1, r.permutation(n), np.sort(r.integers(100, 4000, n))[::-1].copy()), (1, r.choice(n, 12, replace=False), np.arange(220_000, 100_000, -10_000))]
    keep = defaultdict(int)
    for w, p, i in lists:
        for a, b in zip(p, i, strict=True):
            keep[int(a)] += w * int(b)

    def sorted_places(p):
        order = np.argsort(p)
        return order, p[order]

    cand, score, read = ranking.best_of_shard(n, lists, 10, 0, sorted_places)
    assert {int(c): int(s) for c, s in zip(cand, score, strict=True)}.items() >= dict(sorted(keep.items(), key=lambda x: -x[1])[:10]).items()
    assert read < 0.2 * sum(len(p) for _, p, _ in lists)
    assert len(ranking.best_of_shard(n, lists, 10, 300_000, sorted_places)[0]) == 0  # no document can reach that


def test_split_terms(spark):
    import pyarrow as pa

    texts = ["A-b_c9 Éa b\n日本x", None, "", "\x00\x1f/:@[`{\x7f", "é" * 3]
    got = [[t for t in x if t] for x in ranking.split_terms(pa.array(["x", *texts])[1:]).to_pylist()]
    assert got == [terms(t) for t in texts]
