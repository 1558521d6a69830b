"""Approximate nearest neighbours by cosine, on a robust-pruned directed graph for each shard of the vectors.

Vectors are dealt to shards by hash; one task builds a shard's graph and answers all queries on it, block by block, as
they come after the shard's points. Shards grow with the table, from ``shard_size`` points to ``most``, so that queries
times shards grow less than with the square of the table until shards are as large as a task can hold. Points enter the graph in batches that double: a greedy beam search from the middlemost point proposes
neighbours, and relaxed pruning keeps a candidate only if no nearer one that is kept lies closer to it by the factor
``alpha``, so that edges stay few and diverse; edges back are added and pruned alike. A query's beam in each shard is
measured again in double precision on the vectors as given, and the best of all shards are its result. For that every
vector is divided by a power of two, which changes no digit, so that the squares of very large or very small numbers
stay within range.

Equal vectors are one point that keeps its ``k + 1`` smallest ids, which is all that ties can ask for. So every row is
indexed, and a vector that many rows share neither spoils the graph nor fills a shard.

Defined cases. Vectors that are null, empty, zero or hold null or non-finite numbers take no part, as queries or as
candidates; nor do rows without an id, or of another length than most. Ties go to the smaller id. Fewer candidates than
k: all of them. Repeated ids with other vectors: the smallest score is not used twice, each id is given once with its
best score. Empty table: no rows. Only the id and the vector are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written


class Graph:
    """A directed graph over unit vectors; row i of ``edges`` has i's neighbours, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 0) -> None:
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int((x @ x.mean(axis=0)).argmax())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate(([self.start], order[order != self.start]))
        for rounds in range(2):  # the second time every point is placed in a full graph
            done, step = (1, 1) if not rounds else (0, 512)
            while done < n:
                self._insert(order[done : done + step])
                done += step
                step = min(2 * step, 512)

    def search(self, q: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the beam of each query, best first; -1 where there are fewer."""
        size, b = beam or self.beam, np.arange(len(q))
        ids, cos = np.full((len(q), size), -1, np.int32), np.full((len(q), size), -np.inf, np.float32)
        ids[:, 0], cos[:, 0] = self.start, q @ self.x[self.start]
        open_ = ids >= 0
        while open_.any():
            at = open_.argmax(axis=1)
            live = open_[b, at]
            node = ids[b, at]
            open_[b, at] = False
            near = np.where(live[:, None], self.edges[np.maximum(node, 0)], -1)
            new = (near >= 0) & ~(near[:, :, None] == ids[:, None, :]).any(axis=2)
            c = np.where(new, np.einsum("brd,bd->br", self.x[np.maximum(near, 0)], q), -np.inf).astype(np.float32)
            every, score, fresh = np.hstack((ids, np.where(new, near, -1))), np.hstack((cos, c)), np.hstack((open_, new))
            best = np.argsort(-score, axis=1, kind="stable")[:, :size]
            ids, cos, open_ = np.take_along_axis(every, best, 1), np.take_along_axis(score, best, 1), np.take_along_axis(fresh, best, 1)
        return ids, cos

    def _insert(self, points: np.ndarray) -> None:
        found = np.vstack([self.search(self.x[points[a : a + 256]])[0] for a in range(0, len(points), 256)])
        self._set(points, np.hstack((found, self.edges[points])))
        target, source = self.edges[points].ravel(), np.repeat(points, self.degree)
        ok = target >= 0
        target, source = target[ok], source[ok].astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        cuts = np.flatnonzero(np.diff(target, prepend=-1))
        full, lists = [], []
        for a, z in zip(cuts, np.append(cuts[1:], len(target)), strict=True):
            t = target[a]
            row = self.edges[t]
            have = row[row >= 0]
            more = np.setdiff1d(source[a:z], have)
            if len(have) + len(more) <= self.degree:
                row[len(have) : len(have) + len(more)] = more
            else:
                full.append(t)
                lists.append(np.concatenate((have, more)))
        if full:
            width = max(map(len, lists))
            wide = np.full((len(full), width), -1, np.int32)
            for row, x in zip(wide, lists, strict=True):
                row[: len(x)] = x
            self._set(np.array(full), wide)

    def _set(self, points: np.ndarray, candidates: np.ndarray) -> None:
        """Relaxed pruning of each point's candidates to its new neighbours."""
        for a in range(0, len(points), 128):
            p, c = points[a : a + 128], candidates[a : a + 128]
            far = 1 - np.einsum("bcd,bd->bc", self.x[np.maximum(c, 0)], self.x[p])
            far = np.where((c >= 0) & (c != p[:, None]), far, np.inf)
            order = np.argsort(far, axis=1, kind="stable")[:, : 3 * self.degree]
            c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
            far[:, 1:][(c[:, 1:] == c[:, :-1])] = np.inf  # the same candidate twice stands side by side
            x = self.x[np.maximum(c, 0)]
            apart = 1 - np.matmul(x, x.transpose(0, 2, 1))
            alive, b = np.isfinite(far), np.arange(len(p))
            kept = np.full((len(p), self.degree), -1, np.int32)
            for j in range(self.degree):
                first = alive.argmax(axis=1)
                some = alive[b, first]
                if not some.any():
                    break
                kept[some, j] = c[b, first][some]
                alive &= ~((self.alpha * apart[b, first] <= far) & some[:, None])
                alive[b, first] = False
            self.edges[p] = kept


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) of rows that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that the largest component of each is from a half to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", shard_size: int = 4096, most: int = 1 << 17, degree: int = 32, beam: int = 64, query_beam: int = 96, alpha: float = 1.2) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark, rows=5000)
    rows = written(_clean(vectors, key, vector), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == lengths[0]["d"]).dropDuplicates()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    points = written(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    shards = max(1, -(-n // min(most, max(shard_size, int(n**0.75)))))
    # The stated queries against all rows: every shard gets them all.
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.array("vec_id").alias("ids"), "v", F.lit(True).alias("query"))
    dealt = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "ids", "v", F.lit(False).alias("query")).unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "query", F.col("ids")[0])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the points, in order of id, which come before the queries
        graph = None
        for b in batches:
            is_query = b["query"].to_numpy(bool)
            if not is_query.all():
                held.append(b[~is_query])
            if not is_query.any() or not held:
                continue
            if graph is None:
                base_rows = pd.concat(held, ignore_index=True)
                base, base_ids = _scaled(np.stack(base_rows["v"].to_numpy())), base_rows["ids"].to_numpy()
                base_length = np.sqrt((base * base).sum(axis=1))
                graph = Graph((base / base_length[:, None]).astype(np.float32), degree, beam, alpha)
            q, q_id = _scaled(np.stack(b["v"].to_numpy()[is_query])), np.array([i[0] for i in b["ids"].to_numpy()[is_query]])
            out = []
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                length = np.sqrt((part * part).sum(axis=1))
                found, _ = graph.search((part / length[:, None]).astype(np.float32), query_beam)
                for one, n, me, near in zip(part, length, q_id[a : a + 256], found, strict=True):
                    near = near[near >= 0]
                    score = (base[near] * one).sum(axis=1) / (base_length[near] * n)
                    best = sorted({(-s, i) for s, x in zip(score.tolist(), near, strict=True) for i in base_ids[x] if i != me})[:k]
                    out += [(me, i, -s) for s, i in best]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.mapInPandas(of, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", block: int = 256) -> float:
    """Share of the true nearest that were found, by comparing with every row; for tests and measurements."""
    rows = _clean(vectors, key, vector).orderBy("vec_id").toPandas()
    x, ids = _scaled(np.stack(rows["v"].to_numpy())), rows["vec_id"].to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = found.groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).toPandas().set_index("query_id")["ids"]
    hit = total = 0
    at = np.flatnonzero(ids % every == 0)
    for a in range(0, len(at), block):
        cos = unit[at[a : a + block]] @ unit.T
        cos[np.arange(len(cos)), at[a : a + block]] = -np.inf
        for i, c in zip(at[a : a + block], cos, strict=True):
            best = ids[np.argsort(-c, kind="stable")[: min(k, len(ids) - 1)]]
            hit += len(set(best.tolist()) & set(got.get(ids[i], [])))
            total += len(best)
    return hit / max(1, total)
