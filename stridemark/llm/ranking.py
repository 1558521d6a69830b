"""Ranked lexical search, score at a time over postings in order of exact impact.

``build`` writes the index. Documents are dealt to shards as tasks read them, by size of text and number of documents,
so that a term that a third of all documents hold has a short list of postings in each shard, and no term is gathered
anywhere. A row of the index is a term's postings in a shard, the places of the documents by falling impact, which is
whole numbers of term frequency and length only, so that postings of one impact are a group. The length's share needs
the numbers of documents and of terms, which a pass of Spark's own functions counts before.

``search`` joins the rows with the terms that are asked for, and deals them out by shard. A task takes its shards one
after the other. For each item the levels of score fall, and every list's groups above the level are added to what
the documents have. An item is done with a shard when no more than k documents can still be among the best k: what a
document has and what remains in each list where it hasn't been met is compared with the k-th best score so far, of
this shard or of those before. Only then are the scores of those documents completed, by looking them up in the lists'
rest. What can equal the k-th best score stays, as the smaller doc_id wins. Results are exact.

Items are read in blocks of about ``block_terms`` terms, so that no task and no driver holds all of them. The terms of
a block are broadcast, which ``block_terms`` bounds; the driver reads a block's items and their weights, not documents.
Terms are compared as texts, not as hashes.

Defined cases. Null or empty text: no terms; such a document is in no number, and such an item has no results. Very long
texts are indexed whole; a text above the size of a shard is one. Repeated rows of documents are documents of their own.
Equal scores: by ascending doc_id, null last. Repeated items count once; items with one id and different texts are items
of their own, with ranks of their own. Empty tables: no rows. Of documents only id and text are read, and of items the
same, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop, released, written

#: A term: a longest run of ASCII letters and digits and of all characters beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard bigint, term string, size int, places array<int>, impacts array<int>, ids array<bigint>"


def _table() -> np.ndarray:
    """A byte's lower case, and space for bytes that no term has."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalnum():
            out[b] = 32
        elif chr(b).isupper():
            out[b] = b + 32
    return out


def split_terms(texts: pa.Array) -> pa.ListArray:
    """Of each text the list of its terms in lower case, among which are empty ones; null: none."""
    if texts.offset:
        texts = pa.array(texts.to_pylist(), texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    plain = _table()[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain)))


def _shard(number: int, ids: list[pa.Array], texts: list[pa.Array], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of the index of a shard's documents."""
    split = [split_terms(t) for t in texts]
    sizes = np.concatenate([np.diff(s.offsets.to_numpy()) for s in split])
    every = pa.chunked_array([s.flatten() for s in split], pa.large_string()).dictionary_encode().combine_chunks()
    every = every.chunk(0) if isinstance(every, pa.ChunkedArray) else every
    names, codes = every.dictionary, every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    doc, codes = np.repeat(np.arange(len(sizes)), sizes)[filled], codes[filled]
    length = np.bincount(doc, minlength=len(sizes)).astype(np.int64)
    pairs, tf = np.unique(codes * len(sizes) + doc, return_counts=True)
    term, place, tf = pairs // max(1, len(sizes)), pairs % max(1, len(sizes)), tf.astype(np.int64)
    m = 25 + (75 * length * n_docs) // max(1, n_terms)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
    order = np.lexsort((place, -impact, term))
    term, place, impact = term[order], place[order], impact[order]
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(cuts, len(term)).astype(np.int32)
    lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
    rows = len(cuts)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("size", pa.int32()), ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([None], schema.types[3]), pa.array([None], schema.types[4]), pa.array([pa.concat_arrays(ids).to_pylist()], schema.types[5])], schema=schema)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number), pa.int64()), names.take(pa.array(term[cuts])).cast(pa.string()), pa.array(np.diff(ends), pa.int32()), lists(place), lists(impact), pa.nulls(rows, schema.types[5])], schema=schema)


@dataclass
class Index:
    """The table of postings, and the numbers of documents with a term and of their terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20, shard_docs: int = 1 << 16) -> Index:
    """The index of all documents, in the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    counts = rows.select(F.regexp_count("text", F.lit(TERM)).cast("bigint").alias("n")).filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    n_docs, n_terms = int(counts[0]), int(counts[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            ids.append(b.column("id"))
            texts.append(b.column("text"))
            held += b.column("text").nbytes
            if held >= shard_bytes or sum(map(len, ids)) >= shard_docs:
                yield from _shard(number, ids, texts, n_docs, n_terms)
                number, ids, texts, held = number + 1, [], [], 0
        if sum(map(len, ids)):
            yield from _shard(number, ids, texts, n_docs, n_terms)

    return Index(written(rows.mapInArrow(lambda it: released(work(it), 1 << 12), INDEX), "impacts"), n_docs, n_terms)


def _completed(cand: np.ndarray, have: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], done: list[int], sorted_places) -> np.ndarray:
    """The exact scores of documents: what they have, and their impacts in the rest of each list."""
    total = have[cand]
    for (weight, places, impacts), at in zip(lists, done, strict=True):
        if at < len(places):
            order, by_place = sorted_places(places)
            spot = np.minimum(np.searchsorted(by_place, cand), len(by_place) - 1)
            where = order[spot]
            total = total + np.where((by_place[spot] == cand) & (where >= at), weight * impacts[where], 0)
    return total


def best_of_shard(n: int, lists: list[tuple[int, np.ndarray, np.ndarray]], k: int, least: int, sorted_places) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the documents, k or a few more, that can be among the best k; the number of postings read.

    lists: weight, places and impacts of each term, falling; least: the score that k documents elsewhere have, or 0.
    """
    none = np.zeros(0, np.int64)
    done, rest = [0] * len(lists), [w * int(i[0]) for w, _, i in lists]
    if sum(rest) < max(least, 1):
        return none, none, 0
    have, level, floor = np.zeros(n, np.int64), max(rest), max(least, 1)
    while any(rest):
        level = max(rest) * 3 // 4  # every group of scores above it is read whole
        for t, (w, places, impacts) in enumerate(lists):
            if rest[t] and rest[t] >= level:
                a, z = done[t], len(impacts) - int(np.searchsorted(impacts[::-1], max(-(-level // w), 1)))
                have[places[a:z]] += w * impacts[a:z]
                done[t], rest[t] = z, w * int(impacts[z]) if z < len(impacts) else 0
        if n > k:
            floor = max(floor, int(np.partition(have, n - k)[n - k]))
        if sum(rest) < floor:  # no document that hasn't been met can be among them
            most = have + sum(rest)
            for t, (_, places, _) in enumerate(lists):
                if rest[t]:
                    most[places[: done[t]]] -= rest[t]
            cand = np.flatnonzero(most >= floor)
            if len(cand) <= k:
                return cand, _completed(cand, have, lists, done, sorted_places), sum(done)
    cand = np.flatnonzero(have >= floor)
    return cand, have[cand], sum(done)


def _found(batches: Iterator[pa.RecordBatch], items: list[tuple[str, list[tuple[str, int]]]], k: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of each item in the shards of a task, whose rows come shard by shard."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]  # scores, ids, no id

    def shard(parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        named = rows.filter(pc.is_valid(rows["term"]))
        ids = rows.filter(pc.is_null(rows["term"]))["ids"].combine_chunks().flatten()
        missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        places, impacts = named["places"].combine_chunks(), named["impacts"].combine_chunks()
        cuts = (places.offsets.to_numpy() - places.offsets[0].as_py()) if len(named) else np.zeros(1, int)
        flat, value = places.flatten().to_numpy(zero_copy_only=False), impacts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        spans = {t: (cuts[i], cuts[i + 1]) for i, t in enumerate(named["term"].to_pylist())}
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def sorted_places(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = p.ctypes.data
            if at not in kept:
                order = np.argsort(p)
                kept[at] = (order, p[order])
            return kept[at]

        for n, (_, terms) in enumerate(items):
            lists = [(w, flat[slice(*spans[t])], value[slice(*spans[t])]) for t, w in terms if t in spans]
            if not lists:
                continue
            scores, names, empty = best[n]
            cand, score, _ = best_of_shard(len(ids), lists, k, int(scores[-1]) if len(scores) == k else 0, sorted_places)
            scores, names, empty = np.concatenate([scores, score]), np.concatenate([names, ids[cand]]), np.concatenate([empty, missing[cand]])
            order = np.lexsort((names, empty, -scores))[:k]
            best[n] = (scores[order], names[order], empty[order])

    parts, now = [], None
    for b in batches:
        shards = b.column("shard").to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)), len(shards)] if len(shards) else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and shards[a] != now:
                shard(parts)
                parts = []
            now = shards[a]
            parts.append(b.slice(a, z - a))
    if parts:
        shard(parts)
    for (key, _), (scores, names, empty) in zip(items, best, strict=True):
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(scores), pa.string()), pa.array(names, pa.int64(), mask=empty), pa.array(scores, pa.int64())], names=["item", "id", "score"])


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def search(index: Index, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", key: str = "doc_id", block_terms: int = 1 << 18) -> DataFrame:
    """The k best documents of each item: its id, rank, doc_id and score."""
    spark = items.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    asked = asked.withColumn("item", F.sha2(F.to_json(F.struct("name", "text"), {"ignoreNullFields": "false"}), 256))
    terms = asked.select("item", F.explode(F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    terms = written(terms, "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    dfs = index.rows.filter("term IS NOT NULL").select("term", "size").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weighed = written(terms.join(dfs, "term").select("item", "term", (weight * F.col("times")).alias("weight"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).filter("weight > 0"), "item-weights")
    drop(terms)
    out = None
    for b in range(blocks):
        block = weighed.filter(F.col("block") == b)
        listed = [(r["item"], [(t["term"], t["weight"]) for t in r["terms"]]) for r in block.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")).orderBy("item").collect()]
        if not listed:
            continue
        wanted = block.select("term").distinct().withColumn("wanted", F.lit(True))
        rows = index.rows.drop("size").join(F.broadcast(wanted), "term", "left").filter("term IS NULL OR wanted").select("shard", "term", "places", "impacts", "ids")
        found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it, listed=listed: _found(it, listed, k), "item string, id bigint, score bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item string, id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "name"), "item").select(F.col("name").alias(item), "rank", F.col("id").alias(key), "score")
