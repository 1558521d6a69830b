import random

import pytest

from stridemark.llm import queries, quality

KIND = "doc_id bigint, text string, kept string, words string"
SPACE = " \t\n\x0b\f\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def features(text):
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_letters": sum(c.isalpha() for c in t)}


def texts(r):
    made = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "a b c d e f", "x\ny\nx\n \nx", "# * $ % & | < >", "  é 日本 𝒳", "a\r\na\ra\x0bb\x0cb", "- a\n* b\n• c"]
    for _ in range(80):
        n = r.choice((3, 12, 30, 60))
        made.append("".join(r.choice(["ab", "c", "dé", "f#", "g|"][: r.choice((2, 3, 5))]) + r.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n)))
    long = "".join(f"w{i} " for i in range(30000)) + "q r s t u v w " * 2
    return made + [made[-1], long]


def test_features_against_brute_force(spark):
    rows = list(enumerate(texts(random.Random(2))))
    docs = spark.createDataFrame([(i, t, "no", "x") for i, t in rows], KIND).repartition(3)
    want = {i: features(t) for i, t in rows[:-1]}
    got = {r["doc_id"]: r.asDict() for r in quality.judged(docs, quality.RULES, tuple(want[0])).select("doc.doc_id", *want[0], "failed").collect()}
    assert {i: {k: v for k, v in got[i].items() if k in want[0]} for i in want} == want
    last = got[rows[-1][0]]
    assert last["n_words"] == 30014 and last["n_repeat_words"] == 14


def test_verdict_is_the_same_in_any_order(spark):
    rows = list(enumerate(texts(random.Random(3))))
    docs = spark.createDataFrame([(i, t, "no", "x") for i, t in rows], KIND)
    names = {r["doc_id"]: r["failed"] for r in quality.judged(docs, quality.RULES).select("doc.doc_id", "failed").collect()}
    back = {r["doc_id"]: r["failed"] for r in quality.judged(docs, quality.RULES[::-1]).select("doc.doc_id", "failed").collect()}
    assert {i for i, n in names.items() if n is None} == {i for i, n in back.items() if n is None} and names != back
    out = quality.cascade(docs)
    assert out.columns == ["doc_id", "text", "words", "kept", "failed"]  # the input's own kept is replaced, words stays
    assert {r["doc_id"] for r in out.filter("kept").collect()} == {i for i, n in names.items() if n is None}


def test_a_feature_is_computed_only_of_what_is_left(spark):
    docs = spark.createDataFrame([(1, "too few", "", ""), (2, " ".join(f"w{i}" for i in range(12)), "", "")], KIND)
    rows = quality.judged(docs, [quality.RULES[0], quality.RULES[1]]).select("doc.doc_id", "n_words", "n_repeat_words", "failed").orderBy("doc_id").collect()
    assert [(r["failed"], r["n_repeat_words"]) for r in rows] == [("words", None), (None, 0)]
    plan = quality.judged(docs, quality.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_order_by_rejection_per_cost(spark):
    cheap = quality.Rule("cheap", ("n_symbols",), "n_symbols > 0")
    dear = quality.Rule("dear", ("n_repeat_words",), "n_repeat_words >= 0")
    never = quality.Rule("never", ("n_symbols",), "n_symbols < 0")
    text = " ".join(f"a{i} #" for i in range(3000))
    docs = spark.createDataFrame([(i, text, "", "") for i in range(200)], KIND)
    order = quality.estimate(docs, (never, dear, cheap))
    assert [r.name for r, _, _ in order] == ["cheap", "dear", "never"] and [p for _, _, p in order] == [1.0, 1.0, 0.0]
    assert order[0][1] < order[1][1]
    some = quality.estimate(docs, (never, cheap), rows=20)
    assert [r.name for r, _, _ in some] == ["cheap", "never"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    assert [r for r, _, _ in quality.estimate(docs)] == list(quality.RULES) and quality.cascade(docs).count() == 0


@pytest.mark.parametrize("name", ["op12_quality_rules"])
def test_base_failed_is_not_kept(spark, name):
    from conftest import SMALL

    rows = queries.queries()[name](spark, SMALL).collect()
    assert any(r["base_failed"] for r in rows) and not any(r["base_failed"] and r["kept"] for r in rows)
    assert sum(r["kept"] for r in rows) > len(rows) / 2
