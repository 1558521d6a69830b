import random

import numpy as np
import pytest

from stridemark.llm import ngram_join, runs, substring_dedup
from stridemark.llm.components import components
from stridemark.llm.runs import Folder, bucket_of, pack, unpack
from stridemark.llm.shingles import Words


def brute_force(docs, k=13):
    """docs: (doc_id, text) rows; the rows' (n_words, n_removed, digest)."""
    words = [substring_dedup.split_words(t) for _, t in docs]
    first = {}
    for (i, _), ws in zip(docs, words):
        for a in range(len(ws) - k + 1):
            w = tuple(ws[a : a + k])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), ws in zip(docs, words):
        gone = set()
        for a in range(len(ws) - k + 1) if i is not None else ():
            if first[tuple(ws[a : a + k])] < i:
                gone |= set(range(a, a + k))
        out.append((i, len(ws), len(gone), substring_dedup.digest_words([w for n, w in enumerate(ws) if n not in gone])))
    return sorted(out, key=str)


def corpus(seed=5):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 30)) for _ in range(n))
    shared, long = text(40), text(3000)
    docs = [(i, text(rnd.randint(0, 60))) for i in range(20)]
    docs += [(20 + i, text(10) + "\n" + shared + "\t " + text(rnd.randint(0, 20))) for i in range(25)]
    docs += [(50, long), (51, long[: len(long) // 2]), (52, "é " + long), (60, None), (61, ""), (62, " \n"), (63, "ONE two"), (None, shared), (70, shared), (70, shared), (71, shared), (71, text(30)), (72, "a " * 200), (73, "a " * 100), (3, docs[3][1])]
    return docs


SCHEMA = "doc_id bigint, text string"


def test_substring_dedup(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", row string, n_words int")
    got = sorted(map(tuple, substring_dedup.dedup(df, batches=4, ranges=5).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute_force(docs)


def test_colliding_hashes_are_found_out(spark):
    docs = [d for d in corpus(6) if d[0] is not None]
    df = spark.createDataFrame(docs, SCHEMA)
    got = sorted(map(tuple, substring_dedup.dedup(df, batches=1, hash_bits=(10, 64)).collect()), key=str)
    assert got == brute_force(docs)


def test_empty_dedup(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup(empty).count() == 0
    assert ngram_join.jaccard_groups(empty).count() == 0


def test_many_compactions_keep_the_history(spark, monkeypatch):
    monkeypatch.setattr(runs, "FRAME", 50)
    docs = sorted({d[0]: d for d in corpus(8) if d[0] is not None}.values())
    index = substring_dedup.WindowIndex(spark, ranges=3, compact_at=1)
    out, seen, names = [], None, set()
    for a in range(0, len(docs), 8):  # seven batches
        batch = spark.createDataFrame([(i << 16, t) for i, t in docs[a : a + 8]], "row bigint, text string")
        seen = batch if seen is None else seen.unionByName(batch)
        out += [(r["row"] >> 16, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.add(batch, seen).collect()]
        folders = {g.folder for g in index.generations}
        assert len(folders) == 1 + (a > 0) and not folders & {n for n in names if n not in folders} and all(Folder(f).names() for f in folders)
        names |= folders
    assert len(names) >= 10 and sorted(out, key=str) == brute_force(docs)


def test_doc_ids_beyond_the_index_are_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup.dedup(spark.createDataFrame([(1 << 50, "a"), (1, "a")], SCHEMA))


def test_runs(tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FRAME", 7)
    monkeypatch.setattr(runs, "BLOCK", 20)
    rnd = np.random.default_rng(1)
    folder, rows = Folder(str(tmp_path)), []
    for part in range(5):
        h = np.sort(rnd.integers(0, 40, 300).astype(np.uint64) << np.uint64(58))
        row = np.arange(300) * 5 + part
        order = np.lexsort((row, h))
        h, row, place = h[order], row[order] - 700, np.arange(300, dtype=np.uint32)
        rows += zip(h.tolist(), row.tolist(), place.tolist())
        more = pack(h, row, h[::-1].copy(), np.where(h % np.uint64(3) > 0, h, np.uint64(0)))  # hashes that repeat, in any order
        assert (unpack(more)[2] == h[::-1]).all() and unpack(more)[3].tolist() == [x if x % 3 else 0 for x in h.tolist()]
        back = unpack(pack(h, row, place))
        assert all((a == b).all() for a, b in zip(back, (h, row, place)))
        cuts = np.searchsorted(bucket_of(h, 4), np.arange(5))
        folder.write(f"p{part}.run", [pack(h[a:b], row[a:b], place[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], part)
        folder.write(f"p{part}.run", [pack(h[a:b], row[a:b], place[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], part + 10)  # a task done twice
    assert len(folder.names()) == 5
    got = [x for b in range(4) for block in runs.merged([folder.frames(n, b) for n in folder.names()]) for x in zip(*(c.tolist() for c in block))]
    assert got == sorted(rows)


def test_runs_settle(spark, tmp_path):
    folder = Folder(str(tmp_path))
    rnd = np.random.default_rng(2)
    want = []
    for part in range(11):
        h = np.sort(rnd.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2))
        cuts = np.searchsorted(bucket_of(h, 3), np.arange(4))
        folder.write(f"p{part}.run", [pack(h[a:b], np.full(b - a, part)) for a, b in zip(cuts[:-1], cuts[1:])], part)
        want += h.tolist()
    names = runs.settled(spark, str(tmp_path), 3, fan=3)
    assert len(names) <= 3 and folder.names() == names
    assert [x for b in range(3) for block in runs.merged([folder.frames(n, b) for n in names]) for x in block[0].tolist()] == sorted(want)


def test_words_are_bytes_split():
    import pyarrow as pa

    texts = ["a  b\x1cc d\x0b\x0ce", "", None, " x ", "É é \x85", "\t"]
    w = Words(pa.array(texts))
    assert np.diff(w.offsets).tolist() == [len((t or "").encode().split()) for t in texts]
    assert Words(pa.array(["AbÉ"]), lower=True).hash[0] == Words(pa.array(["abÉ"])).hash[0]


def near_corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: [rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(n)]
    docs, passage = [], text(30)
    for _ in range(6):
        base = text(rnd.randint(4, 120))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 2)] = text(rnd.randint(0, 2))
            docs.append(" ".join(copy))
    docs += [" ".join(text(12) + passage + text(rnd.randint(0, 12))) for _ in range(8)]
    docs += ["", None, "one", "ONE", "two words", "a b c d e", "A  B\nC D E", docs[0], docs[0].upper(), " ".join(text(2500))]
    docs.append(docs[-1] + " tail")
    rnd.shuffle(docs)
    return dict(enumerate(docs))


def test_jaccard_groups(spark):
    for seed in (1, 2):
        texts = near_corpus(seed)
        df = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id bigint, text string, n bigint")
        want = ngram_join.brute_force(texts)
        for options in ({}, {"ranges": 3}, {"most": 300}, {"most": 60}):  # units taken apart into tiles, and tiles into blocks
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, **options).collect()}
            assert got == want


def linked_pairs(texts):
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def test_jaccard_links_within_groups(spark):
    for seed in (1, 2):
        texts = near_corpus(seed)
        df = spark.createDataFrame(list(texts.items()), SCHEMA)
        want = linked_pairs(texts)
        groups = ngram_join.brute_force(texts)
        for options in ({}, {"most": 400}, {"most": 60}):
            rows, links = ngram_join.jaccard_links(df, **options)
            of = {}
            for r in rows.filter("c1 IS NOT NULL").collect():
                of.setdefault((r["c1"], r["c2"]), []).append(r["doc_id"])
            pairs = [((r["a1"], r["a2"]), (r["b1"], r["b2"])) for r in links.collect()]
            assert len({frozenset(p) for p in pairs}) == len(pairs)
            got = {tuple(sorted((x, y))) for a, b in pairs for x in of[a] for y in of[b]} | {(x, y) for c in of.values() for x in c for y in c if x < y}
            assert got == want
            rows = ngram_join.jaccard_join(df, **options).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == groups
            assert {r["doc_id"]: r["n_links"] for r in rows} == {k: sum(k in p for p in want) for k in texts}
            alike = {d: min(c) for c in of.values() for d in c}
            assert {r["doc_id"]: r["class_id"] for r in rows} == {k: alike.get(k, k) for k in texts}


def test_jaccard_chains_and_hot_groups(spark):
    """A chain whose ends are unlike, and many unlike copies of one text, with and without their base."""
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 10**6))
    chain = [[word() for _ in range(120)]]
    for _ in range(12):
        chain.append([*chain[-1][6:], *[word() for _ in range(6)]])
    base, copies = [word() for _ in range(100)], []
    for _ in range(80):
        copy = list(base)
        for at in rnd.sample(range(100), 2):
            copy[at] = word()
        copies.append(copy)
    texts = dict(enumerate(" ".join(t) for t in chain + copies))
    want, pairs = ngram_join.brute_force(texts), linked_pairs(texts)
    assert len({c for i, (_, c) in want.items() if i < 13}) == 1 and (0, 12) not in pairs
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA + ", n_links string")
    for options in ({}, {"most": 2000}):
        rows = ngram_join.jaccard_join(df, **options).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
        assert {r["doc_id"]: r["n_links"] for r in rows} == {k: sum(k in p for p in pairs) for k in texts}


def test_hot_shingles_stay_bounded(spark, monkeypatch):
    texts = near_corpus(3)
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)
    monkeypatch.setattr(ngram_join, "MOST", 3)  # from so many rows on a shingle's rows go out block by block
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, ranges=2).collect()}
    assert got == ngram_join.brute_force(texts)


def test_jaccard_nulls_and_repeats(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (9, None)], SCHEMA)
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(df).select("doc_id", "n_shingles", "component_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted([(5, 2, 3, 3, 2), (5, 2, 3, 3, 2), (None, 2, None, None, 0), (3, 2, 3, 3, 2), (9, 0, 9, 9, 0)], key=str)
    assert ngram_join.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bitmaps_bound_overlaps():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        sets = [np.unique(rnd.integers(0, 4000, rnd.integers(1, 600)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(3)]
        sizes = np.array([len(x) for x in sets])
        maps = ngram_join.bitmaps(np.concatenate(sets), np.repeat(np.arange(3), sizes), 3, 256)
        bound = ngram_join.overlap_bound(maps[0], sizes[0], maps, sizes)
        assert all(m >= len(np.intersect1d(sets[0], x)) for m, x in zip(bound, sets)) and bound[0] == sizes[0]


def test_prefixes_meet():
    for n in range(1, 200):
        for m in range(n, 200):
            need = -(-3 * (n + m) // 7)
            if need <= n:  # the most shingles that two linked sets can hide behind their prefixes
                assert n - ngram_join.prefix_length(n) < need or m - ngram_join.prefix_length(m) < need
                assert abs(int(ngram_join.band(np.array([n]))[0]) - int(ngram_join.band(np.array([m]))[0])) <= 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 1)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
