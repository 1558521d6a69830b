"""Column functions on texts: digits of bibs, similarity, names, replies. All run in the JVM but where said."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alikes and the digits they are read as.
LOOK_ALIKES = "OoQDIl|i!ZzEASsGbT?Bgq"
LOOK_DIGITS = "0000111112234556677899"
MIN_DIGITS, MAX_DIGITS = 2, 6

#: Where on the course a file name says it was taken, first match wins.
COURSE_POINTS = [
    (r"(^|[^a-z])start", "Start", 0.0),
    (r"(^|[^0-9])5\s?k", "5K", 5.0),
    (r"(^|[^0-9])10\s?k", "10K", 10.0),
    (r"half|polumaraton|21\s?k", "Half", 21.0975),
    (r"(^|[^0-9])30\s?k", "30K", 30.0),
    (r"(^|[^0-9])35\s?k", "35K", 35.0),
    (r"finish|cilj|medal", "Finish", 42.195),
]


def only_digits(text: Column, most: int | None = 6) -> Column:
    """ASCII digits, cut to a number of them unless that is None; null gives an empty text."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return digits if most is None else F.substring(digits, 1, most)


def bare_number(text: Column) -> Column:
    """All digits without leading zeros."""
    return F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""), F.lit("0"))


def normalise_digits(text: Column) -> Column:
    """Look-alikes read as digits; what has too few or too many digits becomes empty."""
    digits = F.regexp_replace(F.translate(F.trim(F.coalesce(text, F.lit(""))), LOOK_ALIKES, LOOK_DIGITS), "[^0-9]", "")
    return F.when(F.length(digits).between(MIN_DIGITS, MAX_DIGITS), digits).otherwise("")


def clean_number(text: Column) -> Column:
    """Digits and ? for hidden ones; leading zeros go unless a ? follows the first."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9?]", "")
    return F.substring(F.when(kept.startswith("0?"), kept).otherwise(F.ltrim(kept, F.lit("0"))), 1, 7)


def pattern_matches(pattern: Column, number: Column) -> Column:
    """Equal but for hidden digits."""
    return (F.length(pattern) == F.length(number)) & F.rlike(number, F.concat(F.lit("^"), F.replace(pattern, F.lit("?"), F.lit(".")), F.lit("$")))


def known_digits(pattern: Column) -> Column:
    return F.length(F.replace(pattern, F.lit("?"), F.lit("")))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text of one word, with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def character_error_rate(read: Column, truth: Column) -> Column:
    return F.levenshtein(read, truth) / F.greatest(F.length(truth), F.lit(1))


def one_deletions(text: Column) -> Column:
    """The text and what is left of it without one of its characters: two texts within one edit share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))))


def one_hidden(text: Column) -> Column:
    """The text with each of its characters hidden in turn: texts that differ in one place share one of these."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.lit("?"), F.substring(text, i + 1, F.length(text))))


def split_bibs(text: Column, most: int | None = 6) -> Column:
    """Digits of each part of a list of bibs, cut to a number of them unless that is None."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;|\s]+"), lambda x: only_digits(x, most))
    return F.filter(parts, lambda x: x != "")


def course_point(name: Column, default: str | None = None, default_km: float | None = None) -> tuple[Column, Column]:
    point, km = F.lit(default).cast("string"), F.lit(default_km).cast("double")
    for pattern, label, at in reversed(COURSE_POINTS):
        hit = name.rlike(f"(?i){pattern}")
        point, km = F.when(hit, label).otherwise(point), F.when(hit, at).otherwise(km)
    return point, km


#: What a race's text must have, what it must not have, and the code; the first that fits counts.
RACE_CODES = [
    ("štafet|stafet|relay", None, "relay"),
    (r"(^|[^0-9])(42|maraton|marathon|full)", "pol|half|1/2", "marathon"),
    ("pol|half|1/2|21", None, "half"),
    (r"(^|[^0-9])(10\s*k|10k|10 km|deset)", None, "10k"),
    (r"(^|[^0-9])(5\s*k|5k)", None, "10k"),
]
#: The first bib of a race, largest first, where the text says nothing.
RACE_BIBS = [(5000, "10k"), (2000, "half")]


def race_code(text: Column, bib: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    n = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(bib, F.lit("")), r"^\s*([0-9]+)", 1), F.lit("")), F.lit("999999999999")).cast("bigint")
    rules = [(t.rlike(has) if hasnt is None else t.rlike(has) & ~t.rlike(hasnt), code) for has, hasnt, code in RACE_CODES]
    return F.coalesce(*[F.when(fits, code) for fits, code in [*rules, *((n >= least, code) for least, code in RACE_BIBS)]], F.lit("marathon"))


def race_label(bib: Column) -> Column:
    n = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(bib, F.lit("")), r"^\s*([0-9]+)", 1), F.lit("")), F.lit("999999999999"))
    return F.when(n >= 5000, "10K").when(n >= 2000, "21K").otherwise("42K")


def finish_status(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("dnf"), "dnf").when(t.contains("dns"), "dns").when(t.rlike("dsq|disq"), "dsq").otherwise("finished")


def gender(text: Column) -> Column:
    first = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), "^[MFWŽ]", 0)
    return F.nullif(F.translate(first, "WŽ", "FF"), F.lit(""))


def integer_in(text: Column) -> Column:
    """Digits and minus signs read as a whole number, null if there is none."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9-]", ""), "^-?[0-9]+", 0).try_cast("bigint")


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\.[A-Za-z]+$", 1).try_cast("bigint")


def natural_key(name: Column) -> Column:
    """Sorts numbers in names by value: text parts and numbers side by side."""
    parts, numbers = F.split(F.lower(name), "[0-9]+"), F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    return F.arrays_zip(parts.alias("t"), F.transform(numbers, lambda d: d.cast("decimal(38,0)")).alias("n"))


def first_object(text: Column, schema: str) -> Column:
    """The JSON object in a reply that may have prose or a fence around it; null if there is none."""
    whole = F.from_json(text, schema)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.from_json(F.when(F.trim(text).startswith("{") & F.trim(text).endswith("}"), F.trim(text)).otherwise(F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))), schema) if schema else whole


def at_least(n: Column) -> Column:
    """A counter rounded down to hundreds."""
    return F.floor(n / 100) * 100


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


@F.pandas_udf(T.StringType())
def composed(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Names in composed form (NFC). In Python: Spark has no normalisation."""
    for part in names:
        yield pd.Series([None if n is None else unicodedata.normalize("NFC", n) for n in part], dtype=object)


#: Terms that tables hold in Croatian, and in English.
TERMS = {
    "Polovica": "Half",
    "Cilj": "Finish",
    "Maraton": "Marathon",
    "Polumaraton": "Half marathon",
    "Utrka 10 km": "10K run",
}


def data_term(language: str, value: Column) -> Column:
    """A term of the tables in a language, hr or en; what is not known stays, null becomes empty."""
    known = F.create_map(*[F.lit(x) for pair in TERMS.items() for x in pair])
    return F.coalesce(value if language == "hr" else F.coalesce(F.try_element_at(known, value), value), F.lit(""))


def croatian_plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun after a number: 1, 21, 31 ..., then 2 to 4, 22 to 24 ..., then all others."""
    ten, hundred = F.pmod(F.abs(n), F.lit(10)), F.pmod(F.abs(n), F.lit(100))
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def local_number(language: str, n: Column, digits: int = 0) -> Column:
    """A number with its language's signs: 6.214,5 in Croatian, 6,214.5 in English."""
    english = F.format_number(n, digits)
    return F.translate(english, ",.", ".,") if language == "hr" else english


def event_title(language: str, name: Column, edition: Column) -> Column:
    """34. name in Croatian, 34th name in English; the name alone without an edition."""
    return F.when(edition.isNull(), name).otherwise(F.concat_ws(" ", F.concat(edition.cast("string"), F.lit(".")) if language == "hr" else ordinal(edition), name))


def valid_reply(text: Column, schema: str, required: list[str], choices: dict[str, list[str]] | None = None) -> Column:
    """(reply, error): a reply's JSON object, or why it isn't one that was asked for. Errors are data.

    required: fields that must be there. choices: the values that a field may have.
    """
    reply = first_object(text, schema)
    error = F.when(reply.isNull(), F.lit("no JSON object"))
    for name in required:
        error = error.when(reply[name].isNull(), F.lit(f"no {name}"))
    for name, values in (choices or {}).items():
        error = error.when(reply[name].isNotNull() & ~reply[name].isin(values), F.concat(F.lit(f"{name} may not be "), reply[name]))
    return F.struct(F.when(error.isNull(), reply).alias("reply"), error.alias("error"))


def header_key(header: str) -> str:
    """A column header in lower case, without accents or anything but letters and digits. For headers, on the driver."""
    for given, plain in (("đĐ", "d"), ("ßẞ", "ss"), ("øØ", "o"), ("łŁ", "l")):
        header = "".join(plain if c in given else c for c in header)
    flat = "".join(c for c in unicodedata.normalize("NFD", header) if not 0x300 <= ord(c) <= 0x36F)
    return "".join(c for c in flat.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


@F.pandas_udf(T.StringType())
def slug(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Title case, ASCII letters and digits. In Python: Spark has no compatibility decomposition."""
    for part in names:
        flat = (None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().title() for n in part)
        yield pd.Series([None if n is None else "".join(filter(str.isalnum, n)) for n in flat], dtype=object)


def media_token(event: Column, name: Column, key: str) -> Column:
    """The first 24 hex digits of an HMAC-SHA-256 of event/name. In Python: Spark has no HMAC."""

    @F.pandas_udf("string")
    def token(messages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in messages:
            yield pd.Series([None if m is None else hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest()[:24] for m in part], dtype=object)

    return token(F.concat_ws("/", event, name))
