"""Substring dedup with a log-structured index of window hashes.

A window is ``k`` consecutive words of one document. The index holds, for batches of documents taken in order of
doc_id, sorted immutable runs of (hash, document, place); see ``runs``. A new batch adds its own runs and is then
merge-joined, one task a range of hashes, with all runs: a k-way merge by blocks gives the windows in order of hash,
document and place, so that the first of a hash is its source and each later one in a document of the batch with a
larger doc_id is a match. Matches go to their documents, one row a window, where consecutive ones with the same source
and distance are joined to segments. Every segment is verified: a digest of its words must equal that of the source's
words. Should hashes ever collide, everything is done again with another hash. Before a batch is added to
``compact_at`` generations these are compacted into one, which keeps of every hash the first window.

Texts are shuffled only for documents with a match and for their sources, which a bitmap picks out; it is sized by
their number, up to 2^28 bits (32 MB), above which it lets more through and the join does the rest.

Defined cases. Null or empty text: no words; the digest of nothing. Fewer words than a window: nothing removed. Very
long texts: a document's words and segments are in one task's memory. Null doc_id: counted, not indexed, nothing
removed. Repeated rows: same result each; rows of one doc_id with other texts are judged one by one, and never against
each other. Ties: of a hash's windows the one with the smallest doc_id, text number and place is the source, which
can't change what is removed. Empty table: no rows. Only doc_id and text are read, so that other columns may have any
name. A doc_id beyond 47 bits, or with over 65,536 different texts, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, buckets, drop, released, shared_dir, trim, written
from .runs import Folder, Writer, merged, pack, ranges_for, ranges_of, settled
from .shingles import Words

K = 13
LOW = 16
#: Bytes of text that make a batch; three batches at least.
BATCH_BYTES = 1 << 40


def split_words(text: str | None) -> list[bytes]:
    """bytes.split() without an argument splits at exactly the six characters that end words here."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def digest_words(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def segments(row: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joined runs of matches: row, first place, number of windows, source and its first place.

    The matches are sorted by row and place; a place that comes again, as in repeated rows, counts once.
    """
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    row, place, source, source_place = row[new], place[new], source[new], source_place[new]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (source_place[1:] != source_place[:-1] + 1)
    at = np.flatnonzero(first)
    return row[at], place[at], np.diff(np.append(at, len(row))), source[at], source_place[at]


def _slots(rows: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(rows), F.lit(bits))


def _passing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose row is among rows, by a bitmap sized by their number; more may pass, never less."""
    bits = min(1 << 28, max(1 << 16, 1 << (8 * rows.count()).bit_length()))
    filled = np.zeros(bits // 8, np.uint8)
    slots = rows.select((_slots(F.col("row"), bits) + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k"))
    for r in slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("v")).collect():
        filled[(r["k"] - 1) * len(r["v"]) : r["k"] * len(r["v"])] = np.frombuffer(r["v"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def has(slot: pd.Series) -> pd.Series:
        x = slot.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 3] >> (x & 7) & 1).astype(bool))

    # Not deterministic for Spark, which would otherwise apply it to the other side of a join on row as well.
    return docs.filter(has.asNondeterministic()(_slots(F.col("row"), bits))).dropDuplicates(["row"])


class HashesCollide(Exception):
    """Different windows have the same hash; another seed is needed."""


class Generation:
    """A folder of runs: those that tasks wrote, or after compaction one a range."""

    def __init__(self, folder: str, names: list[str] | None) -> None:
        self.folder, self.names = folder, names

    def frames(self, bucket: int) -> list[Iterator]:
        files = Folder(self.folder)
        return [files.frames(f"b{bucket:06d}.run", 0)] if self.names is None else [files.frames(n, bucket) for n in self.names]


def _tagged(frames: Iterator, tag: bool) -> Iterator:
    for columns, last in frames:
        yield (*columns, np.full(len(columns[0]), tag)), last


def _firsts(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
    """Each block with whether a row is the first of its hash, and the row and place of that first one."""
    last = None
    for h, row, place, *more in blocks:
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        first[0] = last is None or h[0] != last[0]
        at, group = np.flatnonzero(first), np.cumsum(first) - 1
        own_row, own_place = (np.concatenate((x[at], [x[0] if last is None else last[k]]))[group] for k, x in ((1, row), (2, place)))  # group -1: the block before
        last = h[-1], own_row[-1], own_place[-1]
        yield first, own_row, own_place, (h, row, place, *more)


class WindowIndex:
    """A folder of generations. Batches must come in order of doc_id for the smaller document to be the one that stays."""

    def __init__(self, spark: SparkSession, ranges: int, folder: str | None = None, k: int = K, compact_at: int = 2, seed: int = 0, hash_bits: int = 64) -> None:
        self.spark, self.folder, self.k, self.ranges = spark, folder or shared_dir(spark, "windows"), k, ranges
        self.compact_at, self.seed = compact_at, seed
        self.mask = np.uint64((1 << 64) - (1 << (64 - hash_bits)))
        self.generations: list[Generation] = []
        self.made = 0

    def _name(self, kind: str) -> str:
        """A folder for a new generation; no name comes twice."""
        self.made += 1
        return f"{self.folder}/{kind}{self.made:05d}-{self.seed}"

    def add(self, batch: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Index the rows (row, text) and return row, n_words, n_removed, kept_sha256 of them.

        row is doc_id << 16 and a number that tells different texts of one doc_id apart. corpus has the rows of this
        and of earlier batches, for verification; the batch alone is enough for the first.
        """
        if len(self.generations) >= self.compact_at:
            self.compact()
        name = self._name("g")
        whole = self._write_runs(batch, name)
        new = Generation(name, settled(self.spark, name, self.ranges))
        found = written(self._segments(self._matches(new)), "segments")
        changed = self._removed(batch, batch if corpus is None else corpus, found)
        self.generations.append(new)
        drop(found)
        out = whole.join(changed, "row", "left")
        kept = F.when(F.col("removed").isNull(), F.col("whole_sha256")).otherwise(F.col("rest_sha256"))
        return out.select("row", "n_words", F.coalesce("removed", F.lit(0)).cast("bigint").alias("n_removed"), kept.alias("kept_sha256"))

    def _write_runs(self, batch: DataFrame, folder: str) -> DataFrame:
        """row, n_words and whole_sha256 of each row; the runs are written on the way."""
        k, ranges, seed, mask = self.k, self.ranges, self.seed, self.mask

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(folder, ranges)
            for b in batches:
                rows = b.column("row").to_numpy(zero_copy_only=False)
                words = Words(b.column("text"), seed=seed)
                h, whole = words.runs(k)
                counts = np.diff(words.offsets)
                place = np.arange(len(h)) - np.repeat(words.offsets[:-1], counts)
                out.add(h[whole] & mask, np.repeat(rows, counts)[whole], place[whole].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts.astype(np.int64)), pa.array([digest_words(split_words(t)) for t in b.column("text").to_pylist()], pa.string())], ["row", "n_words", "whole_sha256"])
            out.flush()

        return written(batch.select("row", "text").mapInArrow(of, "row bigint, n_words bigint, whole_sha256 string"), "whole")

    def _matches(self, new: Generation) -> DataFrame:
        """row, place, source and source_place of each window of the new generation that a smaller document has."""
        old = list(self.generations)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket in (k for b in batches for k in b.column("id").to_pylist()):
                frames = [_tagged(f, g is new) for g in [*old, new] for f in g.frames(bucket)]
                for _, source, source_place, (_, row, place, fresh) in _firsts(merged(frames)):
                    hit = np.flatnonzero(fresh & (source >> LOW < row >> LOW))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(place[hit].astype(np.int32)), pa.array(source[hit]), pa.array(source_place[hit].astype(np.int32))], ["row", "place", "source", "source_place"])

        return ranges_of(self.spark, self.ranges).mapInArrow(lambda batches: released(of(batches)), "row bigint, place int, source bigint, source_place int")

    def _segments(self, matches: DataFrame) -> DataFrame:
        """Arrays of place, n, source and source_place for each row with matches."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def result(columns: list[np.ndarray]) -> pa.RecordBatch:
                row, *rest = segments(*columns)
                at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                ends = pa.array(np.append(at, len(row)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(kind))) for x, kind in zip(rest, (np.int32, np.int32, np.int64, np.int32), strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(row[at]), *lists], ["row", "place", "n", "source", "source_place"])

            for b in batches:
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if len(now[0]):
                    now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
                    end = int(np.searchsorted(now[0], now[0][-1]))  # the last row may go on
                    if end:
                        yield result([x[:end] for x in now])
                    held = [x[end:] for x in now]
            if held:
                yield result(held)

        dealt = matches.repartition(buckets(self.spark), "row").sortWithinPartitions("row", "place")
        return dealt.mapInArrow(of, "row bigint, place array<int>, n array<int>, source array<bigint>, source_place array<int>")

    def _removed(self, batch: DataFrame, corpus: DataFrame, found: DataFrame) -> DataFrame:
        """row, removed and rest_sha256 of the batch's rows with matches, once every segment is found to be equal."""
        k = self.k
        joined = _passing(batch.select("row", "text"), found.select("row")).join(found, "row")

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row, text, at, n, src, src_at in zip(*[b[c] for c in ("row", "text", "place", "n", "source", "source_place")], strict=True):
                    words = split_words(text)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + k - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    parts = [(int(s), int(p), int(m) + k - 1, digest_words(words[a : a + m + k - 1])) for a, m, s, p in zip(at, n, src, src_at, strict=True)]
                    out.append((row, int(gone.sum()), digest_words([w for w, g in zip(words, gone, strict=True) if not g]), [{"source": s, "at": p, "length": m, "digest": d} for s, p, m, d in parts]))
                yield pd.DataFrame(out, columns=["row", "removed", "rest_sha256", "parts"])
            trim()

        removed = written(joined.mapInPandas(of, "row bigint, removed bigint, rest_sha256 string, parts array<struct<source:bigint,at:int,length:int,digest:string>>"), "removed")
        asked = removed.select(F.explode("parts").alias("p")).select("p.*").distinct()
        asked = written(asked.groupBy("source", F.pmod(F.xxhash64("digest"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("at", "length", "digest")).alias("parts")).select(F.col("source").alias("row"), "parts"), "asked")
        sources = _passing(corpus.select("row", "text"), asked.select("row").distinct())

        @F.pandas_udf("boolean")
        def unequal(text: pd.Series, parts: pd.Series) -> pd.Series:
            return pd.Series([any(digest_words(w[p["at"] : p["at"] + p["length"]]) != p["digest"] for p in ps) for t, ps in zip(text, parts, strict=True) for w in [split_words(t)]], dtype=bool)

        if not asked.join(sources, "row", "left").filter(unequal("text", "parts")).select("row").isEmpty():
            raise HashesCollide(f"seed {self.seed}")
        drop(asked)
        return removed.select("row", "removed", "rest_sha256")

    def compact(self) -> None:
        """Merge all runs into one generation, a run a range; of every hash the first window stays."""
        old, name = list(self.generations), self._name("c")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = Folder(name)
            for b in batches:
                for bucket in b.column("id").to_pylist():
                    kept = (pack(*[x[first] for x in columns]) for first, _, _, columns in _firsts(merged([f for g in old for f in g.frames(bucket)])))
                    files.write(f"b{bucket:06d}.run", [kept], TaskContext.get().taskAttemptId())
                yield b

        ranges_of(self.spark, self.ranges).mapInArrow(of, "id bigint").write.format("noop").mode("overwrite").save()
        self.generations = [Generation(name, None)]
        for g in old:
            Folder(g.folder).delete()


def _rows(docs: DataFrame) -> DataFrame:
    """row and text of the documents with a doc_id; different texts of one doc_id are numbered by their hash."""
    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    keyed = given.select("doc_id", F.xxhash64("text").alias("t"))
    unlike = keyed.groupBy("doc_id").agg(F.min("t").alias("x"), F.max("t").alias("y")).filter("x <> y").select("doc_id")
    base = F.shiftleft("doc_id", LOW)
    if unlike.isEmpty():
        return given.select(base.alias("row"), "text")
    ranks = keyed.join(unlike, "doc_id", "left_semi").distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("t")) - 1)
    if not ranks.filter(F.col("n") >= 1 << LOW).isEmpty():
        raise ValueError(f"a doc_id has over {1 << LOW} different texts")
    return given.withColumn("t", F.xxhash64("text")).join(ranks, ["doc_id", "t"], "left").select((base + F.coalesce("n", F.lit(0))).alias("row"), "text")


def dedup(docs: DataFrame, batches: int | None = None, seeds: int = 4, hash_bits: tuple[int, ...] = (64,), folder: str | None = None, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, with the documents indexed in batches by doc_id.

    The index stays in ``folder``, if one is named.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size, least, most = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    size, reach = size or 0, 1 << (62 - LOW)
    if least is not None and not (-reach <= int(least) and int(most) < reach):
        raise ValueError(f"doc_id must be from {-reach} to {reach - 1}")
    rows = _rows(docs)
    batches = batches or max(3, -(-size // BATCH_BYTES))
    parts = [i / batches for i in range(1, batches)]
    cuts = sorted({int(x) << LOW for x in rows.select(F.shiftright("row", LOW).alias("x")).approxQuantile("x", parts, 0.01)}) if parts else []
    edges = [None, *cuts, None]
    options.setdefault("ranges", ranges_for(size))
    for seed in range(seeds):
        index = WindowIndex(spark, folder=folder, seed=seed, hash_bits=hash_bits[min(seed, len(hash_bits) - 1)], **options)
        try:
            out = None
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                batch = rows if a is None else rows.filter(F.col("row") >= a)
                part = index.add(batch if b is None else batch.filter(F.col("row") < b), rows if b is None else rows.filter(F.col("row") < b))
                out = part if out is None else out.unionByName(part)
            break
        except HashesCollide:
            if seed == seeds - 1:
                raise
        finally:
            if folder is None:
                Folder(index.folder).delete()
    kind = docs.schema["doc_id"].dataType
    named = out.select(F.shiftright("row", LOW).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    bare = docs.filter("doc_id IS NULL").select(F.col("doc_id"), F.size(words).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))
    return named.unionByName(bare)
