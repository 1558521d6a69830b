import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stridemark.llm import ann, langid, lm_scoring, media, mixing, packing, queries, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, rnd):
    return " ".join(rnd.choice(["ab", "Cde", "f,", "gh1", "ñandú", "i"]) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns
    norm = lambda rows: sorted(tuple("" if v is None else repr(v) for v in r) for r in rows)
    assert norm(got.select(*columns).collect()) == norm(want.select(*columns).fetchall())


def test_mix(spark):
    rnd = random.Random(1)
    rows = [(i, words(rnd.randint(0, 80), rnd), None, rnd.choice(["a", "a", "a", "a", "b", "b", "c", None, "d"]), 0) for i in range(600)] + [(7, None, None, "a", 0), (None, "x y", None, "b", 0), (8, "x y", None, "b", 0), (8, "x y", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert len({r["target"] for r in rs}) == 1 and rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 80
        assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in rs)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs.drop("size").filter("doc_id NOT IN (7, 8)")).collect())
    once = {r["doc_id"]: r for r in mixing.mix(docs.filter("doc_id NOT IN (7, 8)")).collect()}
    assert all(copies[i] * r["size"] == r["taken"] for i, r in once.items())
    assert mixing.mix(docs.filter(F.lit(False))).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(5, "http://a/ b", body), (3, None, body), (9, "u", body), (9, "u", body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", body), (7, "u\r\nX: y", "é" * 60), (8, "z", "y" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=300, shards=2)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 4
    got = warc.read_archives(spark, f"file://{tmp_path}/w", with_payload=True).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == sorted([(0, "response", 0), (1, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "revisit", 3), (6, "response", 0), (7, "response", 0), (8, "response", 0), (9, "revisit", 3), (9, "revisit", 3)])
    for r in got:
        want = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == want
    (tmp_path / "w/data/part-000099-00000.warc.gz").write_bytes(b"never committed")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == len(rows)
    warc.write_archives(pages, f"file://{tmp_path}/again", roll_bytes=300, shards=2)
    files = lambda d: {p.name: p.read_bytes() for p in (tmp_path / d / "data").glob("part-00000[01]*.gz")}
    assert files("w") == files("again")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").filter("page_id = 5").first()["url"] == "http://a/%20b"
    warc.write_archives(pages.filter(F.lit(False)), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_ann(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(900, 16))
    x[100:400] = x[100]  # a third are one vector
    x[500] = 3 * x[501]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] * 16), (2200, [1.0]), (None, x[0].tolist()), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    found = ann.nearest(df, shard_size=300)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(range(0, 900, 50))
    hits = 0
    for q, rs in got.items():
        assert len(rs) == 5 and [(-s, i) for i, s in rs] == sorted((-s, i) for i, s in rs) and q not in dict(rs)
        cos = unit @ unit[q]
        assert all(abs(cos[i] - s) < 1e-12 for i, s in rs)
        best = sorted((-round(c, 12), i) for i, c in enumerate(cos) if i != q)[:5]
        hits += len({i for _, i in best} & set(dict(rs)))
    assert hits >= 0.9 * 5 * len(got) and [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.filter("vec_id IN (50, 51, 52)")).count() == 2
    assert ann.nearest(df.filter(F.lit(False))).count() == 0
    assert ann.recall(df.filter("vec_id < 1000").dropDuplicates(["vec_id"]), found) >= 0.85  # ties may differ there


def test_ann_of_very_large_and_small_numbers(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(20, 3))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(50, [1e200, 1e200, 0.0]), (100, [1e-200, 1e-200, 0.0]), (150, [1e300, -1e-300, 1.0]), (200, [5e-324, 0.0, 0.0])]
    vectors = {i: np.array([float(c) for c in v]) / max(abs(c) for c in v) for i, v in rows}
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    assert set(got) == {50, 100, 150, 200}
    for q, found in got.items():
        want = sorted((-cos(vectors[q], v) for i, v in vectors.items() if i != q))[:5]
        assert np.allclose([-s for _, s in found], want, rtol=0, atol=1e-12) and len({i for i, _ in found} - {q}) == 5
        assert all(abs(s - cos(vectors[q], vectors[i])) < 1e-12 for i, s in found)


def test_ann_reads_queries_in_blocks(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, every=2).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, every=2).collect()} == want and len(want) == 350 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_warc_is_the_same_every_time(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = []
    for name, given, setting in (("a", pages, "4"), ("b", pages.repartition(7, "url"), "9")):
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        warc.write_archives(given.withColumn("payload", F.lit(1)), f"file://{tmp_path}/{name}", shards=4)
        rows.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/manifest").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] and len(rows[0]) == 4 and sum(r[1] for r in rows[0]) == pages.count()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    rows = [(i, t, g, "s", 0) for i, (t, g) in enumerate([("the house is old", "en"), ("la casa es vieja", "es")] * 20)]
    odd = [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "123 !!", "en", "s", 0), (103, "the house " * 20_000, None, "s", 0), (None, "la casa", None, "s", 0), (104, "la casa es", None, "s", 0), (104, "la casa es", None, "s", 0)]
    small = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("x"))).collect() if r["doc_id"] is None or r["doc_id"] >= 100}
    assert small == {(100, "und", True), (101, "und", True), (102, "und", True), (103, "en", False), (None, "es", False), (104, "es", False)}
    nothing = langid.identify(spark.createDataFrame(odd, DOCS).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def slow_grams(text, dims):
    """Counts of hashed 1- to 3-grams, gram by gram."""
    low, spaced = text.lower(), [" "]
    for c in low:
        if c.isalpha():
            spaced.append(c)
        elif spaced[-1] != " ":
            spaced.append(" ")
    # Another character than a letter counts where it follows one; the end counts as one more.
    spaced = [" "] + spaced[1:] + [" "]
    codes, counts, top = [ord(c) for c in spaced], np.zeros(dims), 2**32
    for i in range(len(codes)):
        h = codes[i] * 2654435761 % top
        counts[h >> (32 - (dims.bit_length() - 1))] += 1
        for n in (1, 2):
            if i + n < len(codes):
                h = ((h ^ (h >> 15)) * 2246822519 + codes[i + n] * 3266489917) % top
                counts[h >> (32 - (dims.bit_length() - 1))] += 1
    return counts


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame([(10**6, "İstanbul? ¡Ñandú! 3x", None, "s", 0), (10**6 + 1, "the " * 30_000 + "x", None, "s", 0), (10**6 + 2, "?", None, "s", 0)], DOCS))
    model = langid.fit(docs.filter(langid.crc_part(F.col("doc_id")) != 0))
    assert set(model.languages) == {r["lang"] for r in docs.filter(langid.crc_part(F.col("doc_id")) != 0).select("lang").distinct().collect()} - {None}
    for r in langid.classify(docs, model).collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text.lower()):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        x = np.log1p(slow_grams(text, len(model.idf))) * model.idf
        x /= np.sqrt((x * x).sum())
        cosines = [float((x * c).sum()) for c in model.centroids.T]
        best = max(cosines)
        assert abs(r["score"] - min(1, max(0, best))) < 1e-4
        near = {model.languages[model.owner[i]] for i, c in enumerate(cosines) if c > best - 1e-4}
        assert r["lang_pred"] in near


def test_many_languages_and_repeated_rows(spark):
    rnd = random.Random(4)
    word = lambda k: "".join(chr(97 + (k * 7 + rnd.randrange(5)) % 26) for _ in range(5))
    rows = [(i, " ".join(word(i % 300) for _ in range(30)), f"l{i % 300:03d}", "s", 0) for i in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert len(model.languages) == 300  # no language is left out
    hot = spark.createDataFrame([(1, "the house", "en", "s", 0)] * 3000 + [(2, "la casa", "es", "s", 0)] * 3, DOCS)
    assert langid.fit(hot, per_language=50).languages == ["en", "es"]


def test_unknown_languages_are_rejected(spark):
    import base64
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(langid.crc_part(F.col("doc_id")) != 0))
    short = docs.filter((langid.crc_part(F.col("doc_id")) == 0) & F.col("text").rlike("[A-Za-z]")).select("doc_id", F.substring("text", 1, 60).alias("text"))
    assert langid.classify(short, model).select(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.02
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    odd = [finnish, letters(300), " ".join(letters(6) for _ in range(100)), base64.b64encode(rnd.randbytes(300)).decode(), rnd.randbytes(300).hex()]
    clean = ["the house", "the cat and the dog were in the house", "la casa es de la mujer", "der Mann und die Frau sind in der Stadt", "the " * 1000]
    rows = spark.createDataFrame(list(enumerate(odd + clean)), "doc_id bigint, text string")
    assert [r["rejected"] for r in langid.classify(rows, model).orderBy("doc_id").collect()] == [True] * len(odd) + [False] * len(clean)


def lm_brute_force(rows, least=2):
    toks = [(t or "").split() for _, t in rows]
    uni = Counter(w for ws in toks for w in ws)
    two = Counter(p for ws in toks for p in zip(ws, ws[1:]))
    ctx = Counter(v for ws in toks for v in ws[:-1])
    n, out = sum(uni.values()), []
    for (i, _), ws in zip(rows, toks):
        s, backs = 0.0, 0
        for v, w in zip([None, *ws], ws):
            if v is None:
                s += np.log(uni[w] / n)
            elif two[v, w] >= least:
                s += np.log(two[v, w] / ctx[v])
            else:
                s, backs = s + np.log(0.4) + np.log(uni[w] / n), backs + 1
        out.append((i, len(ws), backs, round(s / len(ws), 8) if ws else None))
    return sorted(out, key=str)


def lm_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_backoff"], r["score"] if r["score"] is None else round(r["score"], 8)) for r in df.collect()), key=str)


def test_lm_hot_words_and_pairs(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["of the", "of", "the", "a"] + [f"w{k}" for k in range(60)]) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 80))) for i in range(60)] + [(100, "of the " * 400), (101, text(5000))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, row string, part int")
    for options in ({}, {"ranges": 3, "hot": 4}, {"ranges": 50}, {"least": 5}):
        assert lm_rows(lm_scoring.score(df, **options)) == lm_brute_force(rows, options.get("least", 2))


def test_lm_repeats_and_nulls(spark):
    rows = [(1, "a b a b c"), (1, "a b a b c"), (2, None), (None, "a b"), (3, " "), (4, "z")]
    assert lm_rows(lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"))) == lm_brute_force(rows)
    assert lm_scoring.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing._default_tokenizer())


def test_word_tokens():
    rnd = random.Random(3)
    plain = tokenizer()
    tokens = packing.WordTokens(plain.to_str(), most=200)
    letters = [chr(c) for c in range(1, 0x260)] + list("'s'll é ǅ  ẞ Σς\U0001f600 ͅ가 ́") + ["<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [None, ""]
    for a in range(0, len(texts), 50):
        ids, starts = tokens.ids(pa.array(texts).slice(a, 50))  # a part of a larger array, too
        for t, i, j in zip(texts[a : a + 50], starts[:-1], starts[1:], strict=True):
            assert ids[i:j].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_bins():
    rnd = random.Random(2)
    for capacity in (10, 100):
        histogram = Counter(rnd.randint(1, capacity) for _ in range(400))
        plan = packing.plan_bins(histogram, capacity)
        used = Counter()
        for uses, chosen in plan:
            assert uses > 0 and sum(k * m for k, m in chosen.items()) <= capacity
            for k, m in chosen.items():
                used[k] += uses * m
        assert used == histogram
        least = -(-sum(k * n for k, n in histogram.items()) // capacity)
        assert sum(u for u, _ in plan) <= 1.1 * max(least, sum(n for k, n in histogram.items() if 2 * k > capacity)) + 1
    assert packing._fullest({7: 2, 5: 3, 4: 1}, 13) == {4: 1, 5: 1} or sum(k * m for k, m in packing._fullest({7: 2, 5: 3, 4: 1}, 13).items()) == 12
    assert packing.plan_bins({}) == []


def test_packing(spark):
    rnd = random.Random(4)
    texts = [words(rnd.randint(0, 400), rnd) for _ in range(120)] + [None, "", words(9000, rnd)] + ["x"] * 60
    rows = [(i, t, "o") for i, t in enumerate(texts)] + [(3, texts[3], "o"), (3, "other", "o"), (None, "n", "o")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, offset string")).collect()
    plain, capacity = tokenizer(), 2048
    want = Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r["length"] for r in got) // capacity) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with_ids = packing.pieces(spark.createDataFrame(rows[:3], "doc_id bigint, text string, o string"), with_ids=True).collect()
    assert [r["ids"] for r in with_ids if r["doc_id"] == 0][0] == [*plain.encode(texts[0], add_special_tokens=False).ids, 0][:capacity]


def test_media(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", "a" * 192, "a" * 193, "é" * 500, words(8000, rnd), words(30, rnd)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(50, texts[6], "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op10_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        wav = media.to_wav(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest()) and media.from_wav(wav) == payload
    assert got[0]["feature"] == got[1]["feature"] != got[6]["feature"] == got[50]["feature"]
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * np.arange(192 * 10) / 192)).astype(np.uint8).tobytes()
    pairs = media.fingerprint(tone)
    assert len(pairs) and (Counter((pairs >> 16 & 255).tolist()).most_common(1)[0][0]) == 20 and (np.diff(pairs >> 24) >= 0).all()


def slow_fingerprint(payload):
    """Pairs of spectral peaks by the definition of the Fourier transform, frame by frame."""
    n, hop = media.FRAME, media.HOP
    wave = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    peaks = []
    for a in range(0, len(payload) - n + 1, hop):
        power = np.abs(wave @ ((np.array(list(payload[a : a + n]), float) - 128) * window))
        found = [(-power[k], k) for k in range(1, n // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        peaks.append([k for _, k in sorted(found)[:2]])
    out = []
    for t, own in enumerate(peaks):
        for step in range(media.REACH + 1):
            if own and t + step < len(peaks):
                out += [t << 24 | own[0] << 16 | k << 8 | step for k in (peaks[t + step] if step else own[1:])]
    return sorted(out)


def test_fingerprints_by_brute_force():
    rnd = random.Random(8)
    for n in (1, 5, 40, 300):
        payload = words(n, rnd).encode()
        payload += b" " * (-len(payload) % 192)
        assert media.fingerprint(payload).tolist() == slow_fingerprint(payload)


def test_media_of_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "p", "f", "m", "r")], "doc_id bigint, text string, payload string, fingerprint string, media string, __read string")
    got = media.decode(media.encode(df))
    assert set(got.columns) == {"doc_id", "text", "payload", "fingerprint", "media", "__read"}
    row = got.first()
    assert bytes(row["payload"]) == b"a b".ljust(192) and row["__read"] == "r" and row["text"] == "a b" and isinstance(row["fingerprint"], list)
    assert media.decode(media.encode(df.filter("doc_id > 1"))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from stridemark.llm.ngram_join import brute_force

    spark.read.parquet(f"{SMALL}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    planted = "the quick reader and the other one met here with AKIA" + "Q7" * 8 + " in a text that nobody else has"
    spark.createDataFrame([(10**6, planted, "en", "src0", len(planted))], DOCS).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    frames = {"in": docs}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = frames[name] = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert now.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in frames["language_id"].collect()}
    assert set(texts) == {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    kept = {r["doc_id"] for r in frames["ngram_jaccard"].collect()}
    assert kept == {i for i, (_, c) in brute_force(texts).items() if c == i}
    clean = {r["doc_id"]: r["text"] for r in frames["secret_scan"].collect()}
    assert set(clean) == kept and "[secret]" in clean[10**6] and not any("AKIA" in t for t in clean.values())
    taken = Counter(r["doc_id"] for r in frames["mix_sources"].collect())
    size = {i: len(t.encode().split()) for i, t in clean.items()}
    assert abs(sum(n * size[i] for i, n in taken.items()) - sum(size.values())) < 0.1 * sum(size.values())
    packed = Counter(r["doc_id"] for r in now.filter("piece = 0").collect())
    assert packed == taken


def test_stages_of_odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like those that stages make."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    extra = ", size string, rejected string, spans string, payload string, taken string, score string, held_out string"
    more = ("s", "r", "p", "y", "t", "c", "h")
    english, long = "the house is old and the garden behind it is green", "the house is old and " * 8000 + "api_key=abcdefgh12345678"
    rows = [(i, t, g, "a", len(t), *more) for i, (t, g) in enumerate([(f"the house number {k} is old", "en") if k % 2 else (f"la casa número {k} es vieja", "es") for k in range(40)])]
    odd = [(100, english, "en", "b", 5, *more), (100, english, "en", "b", 5, *more), (101, english, None, None, None, *([None] * 7)), (None, english, None, None, None, *more), (102, None, "en", "a", None, *more), (103, "", "en", "a", 0, *more), (104, "12 !", None, "b", 4, *more), (105, long, "en", "b", 1, *more)]
    docs = spark.createDataFrame(rows + odd, DOCS + extra)
    count = lambda df: Counter(r["doc_id"] for r in df.collect())
    kept = stages["language_id"](spark, docs, "")
    assert kept.dtypes == docs.dtypes
    got = count(kept)
    assert got[100] == 2 and got[101] == got[None] == got[105] == 1 and not {102, 103, 104} & set(got) and kept.filter("doc_id = 100").first()["rejected"] == "r"
    groups = stages["ngram_jaccard"](spark, docs, "")
    got = count(groups)
    assert groups.dtypes == docs.dtypes and got[100] == 1 and got[101] == 0 and got[None] == got[102] == got[103] == got[104] == got[105] == 1
    clean = stages["secret_scan"](spark, docs, "")
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert clean.dtypes == docs.dtypes and clean.count() == docs.count() and texts[105]["text"].endswith("[secret]") and texts[105]["n_chars"] == len(texts[105]["text"]) and texts[102]["text"] is None and texts[102]["n_chars"] is None and texts[100]["spans"] == "p"
    mix = stages["mix_sources"](spark, docs, "")
    assert mix.dtypes == docs.dtypes and not {102, 103} & set(count(mix)) and mix.filter("doc_id = 105").first()["size"] == "s"
    packed = stages["best_fit_packing"](spark, docs, "")
    pieces = packed.collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == count(docs) and all(r["length"] <= 2048 for r in pieces)
    assert {r["length"] for r in pieces if r["doc_id"] in (102, 103)} == {1}
    for name, stage in stages.items():
        assert stage(spark, docs.filter(F.lit(False)), "").count() == 0, name
