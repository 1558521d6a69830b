"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule rejects a document by what it needs to know of it: features, which are columns made of the text or of other
features. On a sample each rule's cost (seconds of a pass that computes its features and nothing else, above those of a
pass that only reads the texts, the least of some runs) and its selectivity (the part that it rejects) are estimated, and rules
run in falling order of rejection per cost. A feature is computed where the first rule that needs it comes, and only of
documents that no rule has rejected yet. Whether a document is kept doesn't depend on the order; which rule is named
for a rejected one does, as it is the first that rejects it.

Repeats within a text are found in its row: 64-bit hashes of the windows tell texts without any repeat; of the others
the windows themselves are sorted, so that equal ones are neighbours.

The sample is a bounded one, of ``rows`` documents or so, and decides the order alone.

Defined cases. Null text: as an empty one, which has too few words. Repeated rows are judged each for itself. Very long
texts are judged whole; a text's windows are in its row's memory. Empty table: no rows, and the rules' order as given.
Columns of the input may have any name: they are kept apart, and only ``kept`` and ``failed`` replace ones named so.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

SPACE, SYMBOLS, WINDOW = "[\\x20\\x09-\\x0D]+", "#*$%&|<>", 5


@dataclass(frozen=True)
class Rule:
    """Rejects documents where the condition, SQL on features, holds."""

    name: str
    needs: tuple[str, ...]
    rejects: str


#: The thresholds follow published heuristics for web text; ``words`` and ``repeats`` are the base.
BASE = (
    Rule("words", ("n_words",), "n_words < 10"),
    Rule("repeats", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
)
RULES = BASE + (
    Rule("symbols", ("n_words", "n_symbols"), "100 * n_symbols > 10 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("same_lines", ("n_lines", "n_dup_lines"), "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("letters", ("word_chars", "n_letters"), "100 * n_letters < 25 * word_chars"),
    Rule("bullets", ("n_lines", "n_bullets"), "100 * n_bullets > 90 * n_lines"),
    Rule("trailing_off", ("n_lines", "n_ellipses"), "100 * n_ellipses > 30 * n_lines"),
)


def _following(i: Column) -> list[Column]:
    return [F.get("words", i + j) for j in range(1, WINDOW)]


def _windows(f) -> Column:
    """f of the first word and the place of each window; there are two or more."""
    return F.transform(F.slice("words", 1, F.size("words") - (WINDOW - 1)), f)


def _equal(x: Column, k: Column) -> Column:
    """Whether the sorted window at k is the same as x."""
    return F.coalesce(F.get("places", k)["g"] == x["g"], F.lit(False))


def _count_lines(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda x: x.rlike(pattern))).cast("bigint")


def _long(c: Column) -> Column:
    return c.cast("bigint")


#: Feature: what it is made of, and how. ``text`` is never null.
FEATURES = {
    "words": (("text",), lambda: F.array_remove(F.split("text", SPACE, -1), "")),
    "lines": (("text",), lambda: F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))),
    "n_words": (("words",), lambda: _long(F.size("words"))),
    "word_chars": (("text",), lambda: _long(F.length(F.regexp_replace("text", SPACE, "")))),
    "n_symbols": (("text",), lambda: _long(F.length("text") - F.length(F.translate("text", SYMBOLS, "")))),
    "n_letters": (("text",), lambda: _long(F.length(F.regexp_replace("text", "[^\\p{L}]+", "")))),
    "n_lines": (("lines",), lambda: _long(F.size("lines"))),
    "n_dup_lines": (("lines",), lambda: _long(F.size("lines") - F.size(F.array_distinct("lines")))),
    "n_bullets": (("lines",), lambda: _count_lines("^[\\x20\\x09]*[-*•●▪]")),
    "n_ellipses": (("lines",), lambda: _count_lines("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")),
    "hashes": (("words",), lambda: F.when(F.size("words") > WINDOW, _windows(lambda w, i: F.xxhash64(w, *_following(i))))),
    "places": (("words", "hashes"), lambda: F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(_windows(lambda w, i: F.struct(F.concat_ws(" ", w, *_following(i)).alias("g"), i.alias("i")))))),
    "spots": (("places",), lambda: F.array_sort(F.transform(F.filter("places", lambda x, k: _equal(x, k - 1) | _equal(x, k + 1)), lambda x: x["i"]))),
    "n_repeat_words": (("spots",), lambda: _long(F.coalesce(F.aggregate(F.transform("spots", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("spots", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x), F.lit(0)))),
}


def _with(rows: DataFrame, names: Iterable[str], only: Column | None = None) -> DataFrame:
    """The rows with the features, and those that they are made of, each once; of rows where ``only`` holds."""
    for name in names:
        if name not in rows.columns:
            needs, make = FEATURES[name]
            rows = _with(rows, needs, only)
            rows = rows.withColumn(name, make() if only is None else F.when(only, make()))
    return rows


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 2048, runs: int = 3, text: str = "text", seed: int = 0) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost in seconds on the sample and the part of it that it rejects, best first; without documents as given."""
    n = docs.count()
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = texts if n <= rows else texts.sample(fraction=min(1.0, rows / max(n, 1)), seed=seed)
    part = written(part.repartition(8), "quality-sample")
    count = part.count()
    if not count:
        return [(r, 0.0, 0.0) for r in rules]

    def timed(pass_over: DataFrame) -> tuple[float, int]:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            found = pass_over.head()[0] or 0
            took.append(time.perf_counter() - began)
        return min(took), int(found)

    reading, _ = timed(part.agg(F.sum(F.octet_length("text"))))
    out = []
    for r in rules:
        took, rejected = timed(_with(part, r.needs).agg(F.count_if(F.expr(r.rejects))))
        out.append((r, max(took - reading, 1e-4), rejected / count))
    return sorted(out, key=lambda x: -x[2] / x[1])


def judged(docs: DataFrame, rules: Iterable[Rule], always: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``doc``, the input's row as a struct, ``failed``, the first of the rules that rejects it or null, and the numbers
    among the features.

    Those in ``always`` are computed of every document; others are null where no rule needed them.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with(rows, always).withColumn("failed", F.lit(None).cast("string"))
    for r in rules:
        alive = F.col("failed").isNull()
        rows = _with(rows, r.needs, alive)
        rows = rows.withColumn("failed", F.when(alive, F.when(F.expr(r.rejects), F.lit(r.name))).otherwise(F.col("failed")))
    numbers = [c for c, kind in rows.dtypes if kind == "bigint" and c != "doc"]
    # A filter on ``failed`` must not be pushed through the steps: each names the one before twice, so that it would double.
    return rows.select("doc", F.explode(F.array(F.struct("failed", *numbers))).alias("x")).select("doc", "x.*")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = 2048) -> DataFrame:
    """The documents with ``kept`` and ``failed``, by rules in the order that the sample gives."""
    rows = judged(docs, [r for r, _, _ in estimate(docs, rules, sample, text=text)], text=text)
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in ("kept", "failed")], F.col("failed").isNull().alias("kept"), "failed")
