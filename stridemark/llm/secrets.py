"""Secret scans: the rules' regular expressions in one minimal automaton that reads every byte once.

Base rules are assign, access and hex; further rules add spans and never take one away. Spans are in code points, end
exclusive. A rule that needs its match to be judged (the length of an assigned value) is judged after the match, which
stays consumed.

Defined cases. Null or empty text: no spans. Repeated rows: each by itself. Equal starts: in the rules' order. Columns
of the input stay, other than one named like the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Scanner
from .common import bounded_batches, trim

#: Fixed values of the contract, then rules of our own: name, pattern, whether letters match in either case.
BASE = ("assign", "access", "hex")
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True),
    ("access", r"AKIA[A-Z0-9]+", False),
    ("hex", r"[0-9a-f]{32,}", False),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False),
    # To the END line; where there is none, the first line alone.
    ("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----(((Proc-Type|DEK-Info):[A-Za-z0-9,\x20\-]+|[A-Za-z0-9+/=\\\x09\x0A\x0D\x20])*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----)?", False),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False),
]
#: How many characters a match needs, and the value that ends it. Judged after the match: counted repetitions of
#: several rules would multiply the automaton's states.
LEAST = {"access": 16, "github": 40, "jwt": 36}
VALUE_LEAST = {"assign": 8}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _value_length(match: bytes) -> int:
    """Characters after the first : or =, spaces and a quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def _keeps(name: str, match: bytes, least: dict[str, int], value_least: dict[str, int]) -> bool:
    return len(match) >= least.get(name, 0) and (name not in value_least or _value_length(match) >= value_least[name])


def find_spans(scanner: Scanner, text: str, least: dict[str, int] = LEAST, value_least: dict[str, int] = VALUE_LEAST) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then rule."""
    data = text.encode("utf-8", "surrogatepass")
    found = [(a, k, b) for a, b, k in scanner.scan(data) if _keeps(scanner.names[k], data[a:b], least, value_least)]
    found.sort()
    if not found or len(data) == len(text):
        return [(scanner.names[k], a, b) for a, k, b in found]
    out, at, points = [], 0, 0  # every span is ASCII, so that its length is the same in code points
    for a, k, b in found:
        points += len(data[at:a].decode("utf-8", "surrogatepass"))
        at = a
        out.append((scanner.names[k], points, points + b - a))
    return out


def scan(docs: DataFrame, text: str = "text", into: str = "spans", rules=RULES, least=LEAST, value_least=VALUE_LEAST) -> DataFrame:
    """The rows with an array of (kind, start, end), by start and then by the rules' order."""
    bounded_batches(docs.sparkSession)
    scanner = Scanner(rules)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(scanner, t, least, value_least)] if t else [] for t in texts], dtype=object)
        trim()

    return docs.withColumn(into, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every span of the text replaced by a mark; overlapping spans by one. Null texts stay null."""
    spans = F.col("__spans")
    # Fold the sorted spans into (text so far, place reached); spans that begin inside what is replaced only extend it.
    zero = F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["t"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["t"]).alias("t"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["t"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    rows = scan(docs, text, "__spans")
    return rows.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop("__spans")
