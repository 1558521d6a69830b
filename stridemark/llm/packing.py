"""Best-fit packing of tokenised documents by minimum bin slack.

Every document becomes its token ids and a closing id; only those longer than a sequence are cut into pieces of its
length. Bins are planned from the histogram of piece lengths, which has no more entries than the capacity: the largest
length left opens a bin, a bitset subset-sum over the lengths left finds the fullest combination that fits beside it,
and the combination is used as often as all its lengths last. Each use removes at least one length or leaves fewer of
it than the combination needs, so that the plan's size depends on the capacity, not on the input.

Pieces then get ranks within their length, from counts by length and slice (a hash of the piece), and a rank finds its
sequence and place in the plan by binary search.

Defined cases. Null or empty text: the closing id alone, one piece. Very long texts: a batch's ids are in one task's
memory. Null doc_id: kept. Repeated rows: packed each by itself. Ties: pieces of equal length are interchangeable; which
of them goes where is by hash. Empty table: no rows. Only doc_id and text are read, so that other columns may have any
name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, released, trim, written
from .shingles import split_words


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the tokenizer's file: how it normalises, and what it takes for a piece of a text.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + n) for n in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


class WordTokens:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of its words in turn.
    Words repeat: a bounded table keeps their ids, in two generations, so that words still in use outlive the others.

    A new word goes through the tokenizer, or, if it has only characters below ``SIMPLE`` (which NFC leaves alone) and
    the tokenizer is of the kind known here, through its steps one by one: lower case, pieces, byte characters and the
    model's merges. That gives the same ids without the library's bookkeeping of offsets.
    """

    SIMPLE = "\u0250"

    def __init__(self, tokenizer: str, most: int = 100_000) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.older = Tokenizer.from_str(tokenizer), most, {}, {}
        state = lambda part: {} if part is None else json.loads(part.__getstate__())
        normal, split = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer).get("pretokenizers") or [{}]
        known = [x["type"] for x in normal.get("normalizers", [])] == NORMALIZERS and split[0].get("pattern") == {"Regex": PIECE} and [x["type"] for x in split] == ["Split", "ByteLevel"]
        self.piece = regex.compile(PIECE).findall if known else None
        self.model, self.characters = self.tokenizer.model.tokenize, _byte_characters()

    def _new(self, word: str) -> bytes:
        if not self.piece or "<|" in word or not (word.isascii() or max(word) < self.SIMPLE):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low, ids = word.lower(), []
        for p in (low,) if low.isalpha() else self.piece(low):  # letters alone are one piece
            ids += [t.id for t in self.model(p if p.isascii() and p.isprintable() else "".join([self.characters[b] for b in p.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's begin, with the end.

        Words are told apart by Arrow, once a batch, and their ids put in place by NumPy.
        """
        split = split_words(texts)
        flat = split.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, found = self.known, self.older, []
        for w in flat.dictionary.to_pylist():
            ids = known.get(w)
            if ids is None:
                known[w] = ids = (older[w] if w in older else self._new(w)) if w else b""
            found.append(ids)
        every = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(length) - length
        word = flat.indices.to_numpy(zero_copy_only=False)
        n = length[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(ends[-1]) + np.repeat(start[word] - ends[:-1], n)
        offsets = split.offsets.to_numpy()
        return every[at], ends[offsets - offsets[0]]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    bounded_batches(docs.sparkSession, rows=1000)
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path or _default_tokenizer()).read_text("utf-8"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordTokens(tokenizer.value), np.array([closing_id], "<u4")
        trim()  # reading the vocabulary takes more than keeping it
        for b in batches:
            ids, starts = words.ids(b.column("text"))
            total = np.diff(starts) + 1  # with the closing id
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            parts = [np.concatenate((ids[a:z], end)) if z < a + m else ids[a:z] for a, m, z in zip((starts[:-1][doc] + start).tolist(), length.tolist(), np.minimum(starts[:-1][doc] + start + length, starts[1:][doc]).tolist(), strict=True)]
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(cut(batches)), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum up to room."""
    reach, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left:
            take = min(unit, left)
            new = (reach | reach << (take * length)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            unit *= 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            out[length] = out.get(length, 0) + take
    return out


def plan_bins(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, dict[int, int]]]:
    """(uses, lengths with how many of each) in order; every piece is in exactly one use."""
    counts, plan = {k: n for k, n in histogram.items() if n}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        chosen = _fullest({k: n for k, n in counts.items() if n}, capacity - first) if first < capacity else {}
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        uses = min(counts[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            counts[k] -= uses * m
            if not counts[k]:
                del counts[k]
        plan.append((uses, chosen))
    return plan


def place(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Rows with a length from 1 to the capacity, with sequence_id and offset. Only the histogram is collected."""
    spark = parts.sparkSession
    n = buckets(spark)
    sliced = parts.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    counts = sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    starts = written(counts.withColumn("__from", F.sum("__n").over(Window.partitionBy("length").orderBy("__slice")) - F.col("__n")), "lengths")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    used, sequence, ranges = dict.fromkeys(histogram, 0), 0, []
    for uses, chosen in plan_bins(histogram, capacity):
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            ranges.append((length << 44 | used[length], used[length], times, sequence, offset))
            used[length] += uses * times
            offset += times * length
        sequence += uses
    ranges.sort()
    found = spark.sparkContext.broadcast(np.array(ranges, np.int64).reshape(-1, 5))  # rows bounded by the capacity

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = found.value
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(r[:, 0], size << 44 | rank, side="right") - 1
        nth = rank - r[at, 1]
        return pd.DataFrame({"sequence_id": r[at, 3] + nth // r[at, 2], "offset": r[at, 4] + nth % r[at, 2] * size})

    order = Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("__rank", F.row_number().over(order) - 1).join(starts.drop("__n").hint("merge"), ["length", "__slice"])
    rows = ranked.withColumn("__seat", seat(F.col("length"), F.col("__from") + F.col("__rank")))
    return rows.select(*[F.col(f"`{c}`") for c in parts.columns], F.col("__seat.sequence_id"), F.col("__seat.offset"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """One row a piece with its place. Texts are tokenised once; what is kept of a piece is a few numbers."""
    return place(written(pieces(docs, tokenizer_path, capacity, closing_id), "pieces"), capacity)
