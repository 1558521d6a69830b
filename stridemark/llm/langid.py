"""Language identification: the nearest of several centroids a language, by cosine over TF-IDF n-gram vectors.

A text is lower-cased; each run of other characters than letters counts as one space. Its 1- to 3-grams are hashed
into ``dims`` places, counted over the whole text, damped by log(1 + n), weighed by inverse document frequency and
normalised. Each language's sample is clustered into ``centroids`` unit vectors by spherical k-means. A text gets the
language of the nearest centroid; its score is that cosine. A text is rejected if it has no letter, or if its cosine
is under the centroid's floor for texts of its length, or under ``least``.

The floors come from the learned rows: every one, whole and cut after 1, 2, 4, ... letters, gives a cosine to the
nearest centroid of its language, and of a centroid's cosines at a length the ``quantile``, times ``margin`` as the
rows have been learned from, is the floor. Length is the number of different n-grams, so that a word said a thousand
times is a short text. A length with fewer than ``enough`` cosines has the floor of the next shorter one.

The model is fitted on a bounded sample: ``per_language`` rows of each language at most and about ``sample`` in all, but
FEWEST of every language that has them, so that none is left out; they are chosen by a hash of doc_id and text, of which
each language's smallest are taken. Prediction reads every whole text, and nothing else of a row.

Defined cases. Null text or no letter: ``und``, score 0, rejected. Nothing to learn from: the same for every text. Null
lang: never learned from. Null doc_id: neither held out nor learned from. Ties: the language that sorts first. Repeated
rows: each by itself; in the sample they count as they come. Very long texts: a text's codes are in one task's memory.
Empty table: no rows. Columns of the input stay, other than those named like the new ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop, trim, written

UND = "und"
NEW = ("lang_pred", "score", "rejected")
#: Rows that a language's sample has at least, if there are so many.
FEWEST = 20
#: Levels of length; the last is that of all longer texts.
LEVELS = 13


@dataclass
class Model:
    languages: list[str]
    #: Language number of each centroid, and the centroids as columns, already weighed.
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: float
    #: Least cosine by level of length and centroid; none has ``least`` alone.
    floors: np.ndarray | None = None


class Vectors:
    """Counts of hashed n-grams of whole texts."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        self.shift = np.uint32(32 - dims.bit_length() + 1)
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """None if there is no letter."""
        return self.counts_and_level(text)[0]

    def cuts(self, text: str) -> list[str]:
        """The text's beginnings with 1, 2, 4, ... letters, and the text."""
        low = text.lower()
        at = np.flatnonzero(self.letter[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)])
        return [low[: at[(1 << k) - 1] + 1] for k in range(min(LEVELS, len(at).bit_length()))] + [text] * (len(at) > 0)

    def counts_and_level(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """The counts, None if there is no letter, and the level of length: the binary logarithm of the different n-grams."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[codes]
        if not letters.any():
            return None, 0
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # of other characters, the first after a letter
        c = np.where(letters, codes, 32)[keep].astype(np.uint32)
        c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
        h = c * np.uint32(2654435761)
        out = np.bincount(h >> self.shift, minlength=self.dims)
        for n in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[n:] * np.uint32(3266489917)
            out += np.bincount(h >> self.shift, minlength=self.dims)
        return out, min(LEVELS, int(np.count_nonzero(out)).bit_length()) - 1


def crc_part(doc_id: Column, parts: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def _cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same input gives the same centroids."""
    seeds = [x.sum(axis=0)]
    seeds[0] = seeds[0] / np.linalg.norm(seeds[0])
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[np.max(np.stack([x @ s for s in seeds]), axis=0).argmin()])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(labelled: DataFrame, dims: int = 4096, centroids: int = 4, per_language: int = 400, sample: int = 2400, least: float = 0.1, quantile: float = 0.01, margin: float = 0.6, enough: int = 20) -> Model:
    """Learn from the rows with text and lang given, which must not be those held out."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 11) / float(1 << 53)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang", u.alias("__u"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("__u").alias("first"))
    n_languages = sizes.count()
    empty = Model([], np.zeros(0, int), np.zeros((dims, 0), np.float32), np.ones(dims, np.float32), least)
    if not n_languages:
        return empty
    most = max(FEWEST, min(per_language, sample // n_languages))
    bounded_batches(labelled.sparkSession)
    # Twice as many as needed pass the hash, or all of the smallest, and the window takes each language's smallest.
    near = rows.join(F.broadcast(sizes) if n_languages < 10_000 else sizes, "lang").filter((F.col("__u") * F.col("n") < 2 * most + 100) | (F.col("__u") == F.col("first")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__u", "doc_id"))
    chosen = written(near.withColumn("__place", place).filter(F.col("__place") <= most).select("lang", "__u", "doc_id", "text"), "sample")

    @F.pandas_udf("binary")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors(dims)
        for texts in batches:
            found = [vectors.counts(t) for t in texts]
            yield pd.Series([None if v is None else zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in found], dtype=object)

    # A filter or an order by Spark would count every text two and four times; these are about ``sample`` rows.
    got = chosen.select("lang", "__u", "doc_id", counted("text").alias("v")).collect()
    got = sorted((r for r in got if r["v"] is not None), key=lambda r: (r["lang"], r["__u"], r["doc_id"] is not None, r["doc_id"] or 0))
    if not got:
        return empty
    x = np.log1p(np.stack([np.frombuffer(zlib.decompress(r["v"]), np.uint32) for r in got]).astype(np.float32))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = np.array([r["lang"] for r in got], dtype=object)
    names = sorted(set(langs))
    parts = [_cluster(x[langs == name], centroids) for name in names]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    model = Model(names, owner, np.concatenate(parts).T.astype(np.float32), idf, least)
    model.floors = _floors(chosen, model, quantile, margin, enough)
    drop(chosen)
    return model


def _floors(chosen: DataFrame, model: Model, quantile: float, margin: float, enough: int) -> np.ndarray:
    """The floors by level and centroid, from the learned rows."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<level:int,centroid:int,cosine:double>>")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        vectors = Vectors(len(m.idf))
        for texts, langs in batches:
            out = []
            for text, lang in zip(texts, langs, strict=True):
                cuts = vectors.cuts(text)
                if not cuts or lang not in m.languages:
                    out.append([])
                    continue
                own = np.flatnonzero(m.owner == m.languages.index(lang))
                levels, x = zip(*[(n, v) for v, n in map(vectors.counts_and_level, cuts)], strict=True)
                x = np.log1p(np.stack(x).astype(np.float32)) * m.idf
                cosine = (x @ m.centroids[:, own]) / np.linalg.norm(x, axis=1, keepdims=True)
                out.append([{"level": n, "centroid": int(own[j]), "cosine": float(c[j])} for n, c in zip(levels, cosine, strict=True) for j in [c.argmax()]])
            yield pd.Series(out, dtype=object)

    # About sample rows, LEVELS + 1 numbers each.
    got = chosen.select(F.explode(measured("text", "lang")).alias("c")).select("c.*").toPandas()
    floors = np.full((LEVELS, len(model.owner)), model.least)
    for level in range(LEVELS):
        floors[level] = floors[max(0, level - 1)]
        for centroid, found in got[got["level"] == level].groupby("centroid")["cosine"]:
            if len(found) >= enough:
                floors[level, centroid] = max(model.least, margin * found.quantile(quantile))
    return floors


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred, score and rejected, from the text alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # dims x centroids floats, bounded by the parameters of fit

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        vectors = Vectors(len(m.idf))
        for texts in batches:
            names, scores, floors = np.full(len(texts), UND, dtype=object), np.zeros(len(texts)), np.full(len(texts), m.least)
            for a in range(0, len(texts), 256) if m.languages else ():
                found = [(i, *v) for i, t in enumerate(texts.iloc[a : a + 256], a) if (v := vectors.counts_and_level(t))[0] is not None]
                if not found:
                    continue
                at = np.array([i for i, _, _ in found])
                x = np.log1p(np.stack([v for _, v, _ in found]).astype(np.float32)) * m.idf
                cosine = (x @ m.centroids) / np.linalg.norm(x, axis=1, keepdims=True)
                best = cosine.argmax(axis=1)
                scores[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
                if m.floors is not None:
                    floors[at] = m.floors[[n for _, _, n in found], best]
                names[at] = [m.languages[m.owner[b]] for b in best]
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": (names == UND) | (scores < floors)})
            found = x = cosine = None
        vectors = None
        trim()

    rows = docs.drop(*NEW).withColumn("__p", predict(F.col("text")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW], *[F.col(f"__p.{c}").alias(c) for c in NEW])


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the documents that are not held out and classify all, with the column held_out."""
    part = crc_part(F.col("doc_id"))
    model = fit(docs.filter(part != 0), **options)
    return classify(docs, model).withColumn("held_out", F.coalesce(part == 0, F.lit(False)))
