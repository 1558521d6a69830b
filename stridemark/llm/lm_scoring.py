"""Stupid-backoff scores of documents against counts of the whole corpus, of bigrams and words.

A word's score is c(v w) / c(v .) if the pair v w occurs ``least`` times or more, and otherwise 0.4 * c(w) / N; a
document's first word has c(w) / N. A document's score is the mean of the words' logarithms.

The count tables and the exploded n-grams they are joined to are partitioned by hash in the same sorted runs (see
``runs``), so that a range of hashes is counted, joined and scored by one task that reads nothing else:

1. words: each task's words with counts, in runs by the word's hash. Merged by range they give N and the hot words,
   those with over an eighth of a range's average load, 2 * HOT at most. Pairs that a chunk has often enough give the
   candidates for hot pairs: a pair that makes up 1 / limit of the corpus has half its places in chunks of which it
   makes up 1 / (2 * limit). Both words of such a pair are hot.
2. pairs: each place of a pair, in runs by the first word's hash, so that c(v .) is in the same range; pairs that begin
   with a hot word are spread by the pair's hash instead, their c(v .) being known from 1. Places of hot pairs go by
   their document, as the pair's exact count is known to all after this pass.
3. what backs off goes in runs by the second word's hash, where it meets the counts of 1 again.
4. sums: what a range gives to a document goes in runs by document, and is added up by range of documents, with the hot
   pairs. One row a document comes out.

Logarithms are rounded to multiples of 2^-36, of which doubles add up exactly, so that the order of adding matters
only for documents whose sum is above 2^17, and there in the last bits. Nothing is pruned but by
``least``, which is part of the model. Words are 64-bit hashes: among 10^9 different words two collide, and share their
counts, with odds of about 3 %.

Defined cases. Null or empty text: no words, score null. Very long texts: a batch's words are in one task's memory.
Null doc_id and repeated rows: rows are numbered, so that each is scored by itself; all are part of the corpus. Ties:
none, a score depends on counts alone. Empty table: no rows. Only doc_id and text are read, so that other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, written
from .runs import Folder, Writer, merged, ranges_for, ranges_of, settled
from .shingles import Words, mixed

BACKOFF = 0.4
#: Hot words, and hot pairs, are so many at most, whatever the corpus.
HOT = 1 << 18
UNIT = float(1 << 36)


def _sums(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], *[np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights]


def _find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in the sorted known, and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v) + w)


def _rounded(value: np.ndarray) -> np.ndarray:
    """Rounded so that sums don't depend on their order."""
    return np.rint(value * UNIT) / UNIT


def score(docs: DataFrame, least: int = 2, ranges: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_backoff and score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    if ranges is None:
        ranges = ranges_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    folder, limit = shared_dir(spark, "lm"), min(4 * ranges, hot)
    # Rows get numbers once; the narrow key travels, and doc_id comes back at the end.
    rows = docs.select(F.col("doc_id").alias("row"), "doc_id", "text") if _unique(docs) else written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    sizes = written(_count_words(rows, folder, ranges, limit), "lm-sizes")
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    hot_words = _frequent(spark, f"{folder}/words", ranges, total / (2 * limit))
    pairs, _ = _frequent(spark, f"{folder}/often", ranges, max(total / (2 * limit), least - 0.5))  # so that none backs off
    counted = written(_write_pairs(rows, folder, ranges, hot_words, pairs, total), "lm-hot")
    values = np.zeros(len(pairs))
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n"), F.max("first").alias("first")).collect():  # the hot pairs
        values[r["pair"]] = _rounded(np.log(r["n"] / hot_words[2][r["first"]]))
    _score_pairs(spark, folder, ranges, hot_words, total, least)
    Folder(f"{folder}/pairs").delete()
    _score_back(spark, folder, ranges, total)
    Folder(f"{folder}/back").delete()
    sums = written(_add_up(spark, folder, ranges, values), "lm-sums")
    Folder(folder).delete()
    return sizes.join(sums, "key", "left").select("doc_id", "n_words", F.coalesce("backs", F.lit(0)).cast("bigint").alias("n_backoff"), (F.col("part") / F.col("n_words")).alias("score"))


def _unique(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own, so that it can be the key without writing the texts again."""
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        return False
    return docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places that follow another word of their document, and the first places of documents."""
    follows = np.ones(len(words.hash), bool)
    starts = words.offsets[:-1][np.diff(words.offsets) > 0]
    follows[starts] = False
    return np.flatnonzero(follows), starts


def _count_words(rows: DataFrame, folder: str, ranges: int, limit: int) -> DataFrame:
    """key, doc_id and n_words; runs of (word, count, count before another word) and of a chunk's frequent pairs."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, often = Writer(f"{folder}/words", ranges), Writer(f"{folder}/often", ranges)
        held: list[np.ndarray] = []

        def chunk() -> None:
            keys, counts = _sums(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            many = counts * 2 * limit >= sum(map(len, held))
            often.add(keys[many], counts[many])
            held.clear()

        for b in batches:
            words = Words(b.column("text"))
            followed = np.ones(len(words.hash), np.int64)
            ends = words.offsets[1:][np.diff(words.offsets) > 0] - 1
            followed[ends] = 0
            out.add(*_sums(words.hash, np.ones(len(words.hash), np.int64), followed))
            at, _ = _pairs(words)
            held.append(_pair_key(words.hash[at - 1], words.hash[at]))
            if sum(map(len, held)) >= 1_000_000:
                chunk()
            key = mixed(b.column("row").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id"), pa.array(np.diff(words.offsets))], ["key", "doc_id", "n_words"])
        if held:
            chunk()
        out.flush()
        often.flush()

    return rows.mapInArrow(of, f"key bigint, doc_id {kind}, n_words bigint")


def _totals(folder: str, names: list[str], bucket: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted distinct keys with the sums of the other columns, block by block, of all runs of a range."""
    files, held = Folder(folder), None
    for block in merged([files.frames(n, bucket) for n in names]):
        block = block if held is None else tuple(map(np.concatenate, zip(held, block, strict=True)))
        sums = _sums(*block)
        yield tuple(x[:-1] for x in sums)
        held = tuple(x[-1:] for x in sums)  # the last key may go on
    if held is not None:
        yield held


def _frequent(spark: SparkSession, folder: str, ranges: int, least: float) -> tuple[np.ndarray, ...]:
    """Sorted keys whose first column adds up to over ``least``, with the sums of their columns, which is all but few."""
    names = settled(spark, folder, ranges)
    n = 2 if folder.endswith("words") else 1
    columns = ["k", "x", "y"][: n + 1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in (k for b in batches for k in b.column("id").to_pylist()):
            for key, *sums in _totals(folder, names, bucket):
                at = np.flatnonzero(sums[0] > least)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), *[pa.array(x[at]) for x in sums]], columns)

    found = ranges_of(spark, ranges).mapInArrow(of, ", ".join(f"{c} bigint" for c in columns)).toArrow()
    key, *sums = (found[c].to_numpy().astype(np.int64) for c in columns)
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], *[x[order] for x in sums]


def _write_pairs(rows: DataFrame, folder: str, ranges: int, hot, pairs: np.ndarray, total: int) -> DataFrame:
    """The number of places of each hot pair in a task, and its first word's place; all places go into runs.

    pairs: (first word or, if that is hot, the pair's key; second word; row; place of a hot first word + 1).
    back: (first word of a document, row). sums: what documents' hot first words give. hot: (row's key, hot pair).
    """
    known = rows.sparkSession.sparkContext.broadcast((*hot, pairs))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_w, hot_count, _, hot_pairs = known.value
        out, back, places = (Writer(f"{folder}/{x}", ranges) for x in ("pairs", "back", "hot"))
        sums = _Sums(f"{folder}/sums", ranges)
        counts, first = np.zeros(len(hot_pairs), np.int64), np.zeros(len(hot_pairs), np.int64)
        for b in batches:
            words = Words(b.column("text"))
            h, n = words.hash, np.diff(words.offsets)
            row = np.repeat(b.column("row").to_numpy(zero_copy_only=False).astype(np.int64), n)
            at, starts = _pairs(words)
            is_hot, where = _find(hot_w, h[starts])
            back.add(h[starts][~is_hot], row[starts][~is_hot])
            sums.add(row[starts][is_hot], _rounded(np.log(hot_count[where[is_hot]] / total)), np.zeros(is_hot.sum(), np.int64))
            v, w, row = h[at - 1], h[at], row[at]
            key = _pair_key(v, w)
            is_hot, where = _find(hot_pairs, key)
            counts += np.bincount(where[is_hot], minlength=len(counts))
            first[where[is_hot]] = _find(hot_w, v[is_hot])[1]
            places.add(mixed(row[is_hot].view(np.uint64)), where[is_hot])
            v, w, row, key = v[~is_hot], w[~is_hot], row[~is_hot], key[~is_hot]
            is_hot, where = _find(hot_w, v)
            out.add(np.where(is_hot, key, v), w, row, np.where(is_hot, where + 1, 0).astype(np.uint32))
        for writer in (out, back, sums, places):
            writer.flush()
        got = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(counts[got]), pa.array(first[got])], ["pair", "n", "first"])

    return rows.mapInArrow(of, "pair bigint, n bigint, first bigint")


class _Sums:
    """What documents get in a task, added up by document, in runs by the row's key.

    So many rows are held, and added up when there are more; only what is left after that is written early.
    """

    def __init__(self, folder: str, ranges: int, prefix: str = "p", most: int = 1_000_000) -> None:
        self.out, self.most, self.size = Writer(folder, ranges, prefix), most, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, row: np.ndarray, part: np.ndarray, backs: np.ndarray) -> None:
        if len(row):
            self.held.append(_sums(row, part, backs))
            self.size += len(self.held[-1][0])
            if self.size > self.most:
                self._add_up()
                if self.size > self.most // 2:
                    self._write()

    def _add_up(self) -> None:
        self.held = [_sums(*map(np.concatenate, zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])

    def _write(self) -> None:
        row, part, backs = self.held[0]
        self.out.add(mixed(row.view(np.uint64)), part, backs)
        self.held, self.size = [], 0

    def flush(self) -> None:
        if self.held:
            self._add_up()
            self._write()
        self.out.flush()


def _score_pairs(spark: SparkSession, folder: str, ranges: int, hot, total: int, least: int) -> None:
    """What each range's pairs give to their documents, in runs, and what backs off, in others."""
    known, names = spark.sparkContext.broadcast(hot), settled(spark, f"{folder}/pairs", ranges)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_w, hot_count, hot_followed = known.value
        files = Folder(f"{folder}/pairs")
        for b in batches:
            for bucket in b.column("id").to_pylist():
                sums, back = _Sums(f"{folder}/sums", ranges, "q"), Writer(f"{folder}/back", ranges, "q")
                held = None

                def scored(h: np.ndarray, w: np.ndarray, row: np.ndarray, place: np.ndarray, sums=sums, back=back) -> None:
                    new_h = np.concatenate(([True], h[1:] != h[:-1]))
                    new = new_h | np.concatenate(([True], w[1:] != w[:-1]))
                    first, first_h = np.flatnonzero(new), np.flatnonzero(new_h)
                    pair_count = np.diff(np.append(first, len(h)))[np.cumsum(new) - 1]
                    context = np.diff(np.append(first_h, len(h)))[np.cumsum(new_h) - 1]
                    if len(hot_w):
                        context = np.where(place > 0, hot_followed[np.maximum(place.astype(np.int64), 1) - 1], context)
                    kept = pair_count >= least
                    value = np.where(kept, np.log(pair_count / context), np.log(BACKOFF))
                    is_hot, where = _find(hot_w, w)
                    now = ~kept & is_hot
                    value[now] += np.log(hot_count[where[now]] / total)
                    later = ~kept & ~is_hot
                    back.add(w[later], row[later])
                    sums.add(row, _rounded(value), (~kept).astype(np.int64))

                for block in merged([files.frames(n, bucket) for n in names]):
                    block = block if held is None else tuple(map(np.concatenate, zip(held, block, strict=True)))
                    end = int(np.searchsorted(block[0], block[0][-1]))  # the last word may go on
                    if end:
                        scored(*(x[:end] for x in block))
                    held = tuple(x[end:] for x in block)
                if held is not None:
                    scored(*held)
                sums.flush()
                back.flush()
            yield b

    ranges_of(spark, ranges).mapInArrow(of, "id bigint").write.format("noop").mode("overwrite").save()


def _score_back(spark: SparkSession, folder: str, ranges: int, total: int) -> None:
    """What words that are scored by themselves give to their documents, in runs."""
    words, back = (settled(spark, f"{folder}/{x}", ranges) for x in ("words", "back"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(f"{folder}/back")
        for b in batches:
            for bucket in b.column("id").to_pylist():
                sums = _Sums(f"{folder}/sums", ranges, "r")
                blocks = list(_totals(f"{folder}/words", words, bucket))  # different words of a range
                known, count = (np.concatenate([x[i] for x in blocks]) for i in (0, 1)) if blocks else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for w, row in merged([files.frames(n, bucket) for n in back]):
                    _, where = _find(known, w)
                    sums.add(row, _rounded(np.log(count[where] / total)), np.zeros(len(row), np.int64))
                sums.flush()
            yield b

    ranges_of(spark, ranges).mapInArrow(of, "id bigint").write.format("noop").mode("overwrite").save()


def _add_up(spark: SparkSession, folder: str, ranges: int, values: np.ndarray) -> DataFrame:
    """key, part and backs of every document with a word; values are those of the hot pairs."""
    known = spark.sparkContext.broadcast(values)
    sums, hot = (settled(spark, f"{folder}/{x}", ranges) for x in ("sums", "hot"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_sums, of_hot = Folder(f"{folder}/sums"), Folder(f"{folder}/hot")
        for bucket in (k for b in batches for k in b.column("id").to_pylist()):
            found = [_sums(*block) for block in merged([of_sums.frames(n, bucket) for n in sums])]
            found += [_sums(key, known.value[pair], np.zeros(len(key), np.int64)) for key, pair in merged([of_hot.frames(n, bucket) for n in hot])]
            if found:  # at most a row a document of the range and block
                key, part, backs = _sums(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part), pa.array(backs)], ["key", "part", "backs"])

    return ranges_of(spark, ranges).mapInArrow(of, "key bigint, part double, backs bigint")
