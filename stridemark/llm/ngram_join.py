"""N-gram Jaccard join: which documents' sets of word shingles overlap by a share or more, and the groups they form.

Documents with the same set are one class. Classes get candidates by prefixes: in one order of all shingles, two sets
that are similar enough share one of the first ``n - ceil(share * n) + 1``. The order is by document frequency over the
whole corpus, rarest first, so that a set with enough shingles of its own has no candidate at all:

1. One pass over the different texts (by their SHA-256) gives each one's set size and class and writes the sets'
   shingles in sorted runs by hash (see ``runs``). Texts of one class in a task are written once.
2. One task a range of hashes merges the runs and gives back, for every shingle that two rows or more have, the row and
   the shingle's frequency. A row's shingles that don't come back are its own; they fill its prefix first.
3. Classes whose prefix reaches a shared shingle are candidates; they keep their shared shingles, which is all that an
   intersection can consist of. Those that share a prefix shingle form a tile; of tiles with the same members one stays.
4. Tiles with a class in common are put together into units of bounded size. A unit that is too large is taken apart
   into its tiles, and a tile that is too large into blocks by size band, which meet blocks of their own and of the
   next band only. In a unit, members of a tile whose sizes allow a link are compared: bitmaps, into which every
   shingle is hashed, bound the overlap from above (a set bit that the other bitmap lacks is at least one shingle that
   the other set lacks), and what is left is settled by the exact intersection of the sorted arrays.
5. Every member leaves its unit as one row, with the number of rows it is linked to there and the first member that it
   is joined to; never a pair. A pair that meets in several units counts in that of its first common tile. What units
   joined is joined further by ``components``.

``jaccard_join`` gives groups and numbers of links. ``jaccard_groups`` gives groups alone and so skips pairs that are
joined already. ``jaccard_links`` has the pairs of classes themselves, with the rows of each class.

Sets are compared as sorted 64-bit hashes; class keys have 128 bits. Two sets that are compared would need colliding
shingles for a wrong result, which among n * n pairs of shingles has odds of n * n / 2^64.

Defined cases. Null or empty text, or no word: set size 0, linked with nothing. Fewer words than a shingle has: the
whole sequence is the only shingle. Very long texts: a row's shingles are one array, 8 bytes a word. Null doc_id:
counted, but linked with nothing; its component and class are null. Repeated rows: rows of one doc_id may differ in
text; they are in one class or not as any others, and the smallest doc_id of a group stands for it. Links are counted by
rows. Ties: shingles of equal frequency are ordered by hash; neither that nor the number of ranges changes the result.
Empty table: no rows. Only doc_id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, drop, released, shared_dir, written
from .components import components
from .runs import Folder, Writer, merged, ranges_for, ranges_of, settled
from .shingles import Words

K = 5
#: 100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (sum of sizes).
MORE, OF = 3, 7
#: Frequencies from here on are taken for equal, so that a range needn't hold all rows of a shingle.
MOST = 1 << 20
#: Shingles of all members of a unit.
UNIT = 4_000_000


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def prefix_length(n):
    return n - (3 * n + 3) // 4 + 1


def band(n: np.ndarray) -> np.ndarray:
    """Sizes that may link are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)


def bitmaps(shingles: np.ndarray, owner: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """A row of 64-bit words for each owner, with the bit set that each of its shingles is hashed to."""
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(rows * (bits // 64), np.uint64)
    np.bitwise_or.at(out, owner * (bits // 64) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out.reshape(rows, bits // 64)


def overlap_bound(x: np.ndarray, nx: int, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """No intersection of the set of bitmap x with those of the rows of y is larger."""
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and digest of every row; of every text its smallest doc_id and its rows; and each text once, or nearly."""
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    rows = written(keyed.select("doc_id", "digest"), "rows")
    texts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("rows"), F.count("*").alias("all")), "texts")
    again = texts.filter("all > 1").select("digest", "first")
    return rows, texts, keyed.join(again, "digest", "left").filter("first IS NULL OR doc_id = first").select("doc_id", "digest", "text")


def _index(texts: DataFrame, folder: str, ranges: int) -> DataFrame:
    """rid, digest, n and class (c1, c2) of every text, and whether it has a doc_id; the shingles of those go into runs.

    rid numbers the texts, by partition and place.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base, count, seen = Writer(folder, ranges), TaskContext.get().partitionId() << 33, 0, set()
        for b in batches:
            sets = Words(b.column("text"), lower=True).sets(K)
            rid = base + count + np.arange(len(sets))
            count += len(sets)
            keys = [class_key(s) if len(s) else (None, None) for s in sets]
            known = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            fresh = []
            for i, (s, key) in enumerate(zip(sets, keys, strict=True)):
                if len(s) and known[i] and key not in seen:  # copies in the same task add nothing
                    fresh.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(key)
            if fresh:
                sizes = [len(sets[i]) for i in fresh]
                out.add(np.concatenate([sets[i] for i in fresh]), np.repeat(rid[fresh], sizes))
            yield pa.RecordBatch.from_arrays([pa.array(rid), b.column("digest"), pa.array(known), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)]], ["rid", "digest", "known", "n", "c1", "c2"])
        out.flush()

    return texts.mapInArrow(lambda batches: released(of(batches)), "rid bigint, digest binary, known boolean, n bigint, c1 bigint, c2 bigint")


def _shared(spark: SparkSession, folder: str, ranges: int) -> DataFrame:
    """rid, df and s for every shingle that two rows or more have; df is MOST at most."""
    names = settled(spark, folder, ranges)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(folder)
        batch = lambda h, row, df: pa.RecordBatch.from_arrays([pa.array(row), pa.array(df.astype(np.int32)), pa.array(h.view(np.int64))], ["rid", "df", "s"])
        for bucket in (k for b in batches for k in b.column("id").to_pylist()):
            held_h, held_row, over = np.zeros(0, np.uint64), np.zeros(0, np.int64), None  # over: a shingle with MOST rows
            for h, row in merged([files.frames(n, bucket) for n in names]):
                h, row = np.concatenate((held_h, h)), np.concatenate((held_row, row))
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                df = np.diff(np.append(first, len(h)))
                full = len(h) - first[-1] >= MOST  # the last shingle goes on in the next block, unless it has enough
                end = len(h) if full or h[-1] == over else int(first[-1])
                each = np.repeat(df, df)
                if over is not None:
                    each[h == over] = MOST
                each = np.minimum(each, MOST)
                over = h[-1] if end == len(h) else None
                give = np.flatnonzero(each[:end] > 1)
                if len(give):
                    yield batch(h[give], row[give], each[give])
                held_h, held_row = h[end:], row[end:]
            if len(held_h) > 1:
                yield batch(held_h, held_row, np.full(len(held_h), len(held_h)))

    return ranges_of(spark, ranges).mapInArrow(lambda batches: released(of(batches)), "rid bigint, df int, s bigint")


def _candidates(sets: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """rid, n, the sorted shared shingles and the shared ones in the prefix, of rows whose prefix reaches one."""
    rows = shared.unionByName(_known(sets).select("rid", F.lit(-1).alias("df"), F.col("n").alias("s"))).repartition(parts, "rid").sortWithinPartitions("rid", "df", "s")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _and_none(batches):
            if b is None:
                if held is None:
                    return
                rid, df, s = held
                end = len(rid)
            else:
                now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "df", "s")]
                if not len(now[0]):
                    continue
                rid, df, s = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                end = int(np.searchsorted(rid, rid[-1]))  # the last row may go on
                held = [x[end:] for x in (rid, df, s)]
            at = np.flatnonzero(df[:end] == -1)
            m = np.diff(np.append(at, end)) - 1
            n = s[at]
            need = prefix_length(n) - (n - m)
            pick = np.flatnonzero((need > 0) & (m > 0))
            if len(pick):
                arrays = [np.sort(s[at[i] + 1 : at[i] + 1 + m[i]].view(np.uint64)).view(np.int64) for i in pick]
                heads = [s[at[i] + 1 : at[i] + 1 + need[i]] for i in pick]
                yield pa.RecordBatch.from_arrays([pa.array(rid[at[pick]]), pa.array(n[pick]), _lists(arrays), _lists(heads)], ["rid", "n", "shared", "prefix"])

    return rows.mapInArrow(lambda batches: released(of(batches)), "rid bigint, n bigint, shared array<bigint>, prefix array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))), pa.int32()), pa.array(np.concatenate(arrays)))


def _and_none(batches):
    yield from batches
    yield None


def _tiles(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """rid, tile and unit key g of the classes in tiles of two or more, of tiles with the same members only one."""
    rows = candidates.join(members, "rid").select("rid", F.explode("prefix").alias("s"))
    same = [F.expr(f"bit_xor(xxhash64(rid, {k}))").alias(f"x{k}") for k in (0, 1)]
    by_shingle = rows.groupBy("s").agg(F.count("*").alias("size"), F.min("rid").alias("g"), *same).filter("size > 1")
    kept = by_shingle.groupBy("size", "g", "x0", "x1").agg(F.min("s").alias("tile"))
    return rows.join(kept, F.col("s") == F.col("tile")).select("rid", "tile", "g")


def _units(tiles: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """rid, tile, own block and unit: the tile's group g, or the tile alone, or a pair of its blocks, so that none is too large.

    unit is a struct of g, tile (null for a whole group), and the blocks (band and number) that meet in it.
    """
    sized = written(tiles.join(members.select("rid", "n", "m"), "rid"), "sized")
    group = sized.dropDuplicates(["g", "rid"]).groupBy("g").agg(F.sum("m").alias("all"))
    large = written(group.filter(F.col("all") > most).select("g"), "large")
    none = F.lit(None).cast("bigint")
    blocks = lambda *four: F.struct("g", *[x.cast("bigint").alias(k) for k, x in zip(("tile", "band1", "block1", "band2", "block2"), four, strict=True)]).alias("unit")
    whole = sized.join(large, "g", "left_anti").select("rid", "tile", none.alias("block"), blocks(none, none, none, none, none))
    if large.isEmpty():
        return whole
    size_band = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("bigint").alias("band")
    big = written(sized.join(large, "g", "left_semi").withColumn("band", size_band), "big")
    per = big.groupBy("tile", "band").agg(F.sum("m").alias("all"))
    sums = per.groupBy("tile").agg(F.sum("all").alias("tile_all"))
    counts = written(per.join(sums, "tile").select("tile", "band", "tile_all", F.ceil(2 * F.col("all") / most).cast("bigint").alias("n_blocks")), "counts")
    small = big.join(counts.filter(F.col("tile_all") <= most), ["tile", "band"]).select("rid", "tile", none.alias("block"), blocks(F.col("tile"), none, none, none, none))
    apart = counts.filter(F.col("tile_all") > most)
    own = big.join(apart, ["tile", "band"]).withColumn("block", F.pmod(F.xxhash64("rid", F.lit("block")), F.col("n_blocks")))
    other = lambda by, name: apart.select("tile", (F.col("band") + by).alias("band"), F.col("n_blocks").alias(name))
    near = own.join(other(-1, "above"), ["tile", "band"], "left").join(other(1, "below"), ["tile", "band"], "left")
    spread = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("j")
    with_own = near.select("*", spread(F.col("n_blocks"))).select("rid", "tile", "block", blocks(F.col("tile"), F.col("band"), F.least("block", "j"), F.col("band"), F.greatest("block", "j")))
    with_above = near.filter("above IS NOT NULL").select("*", spread(F.col("above"))).select("rid", "tile", "block", blocks(F.col("tile"), F.col("band"), F.col("block"), F.col("band") + 1, F.col("j")))
    with_below = near.filter("below IS NOT NULL").select("*", spread(F.col("below"))).select("rid", "tile", "block", blocks(F.col("tile"), F.col("band") - 1, F.col("j"), F.col("band"), F.col("block")))
    return whole.unionByName(small).unionByName(with_own.unionByName(with_above).unionByName(with_below).distinct())


class Unit:
    """The members of a unit, sorted by size, and what links them."""

    def __init__(self, rid, n, weight, shared: list[np.ndarray], tiles: list[np.ndarray], all_tiles: list[np.ndarray], side: np.ndarray | None = None) -> None:
        order = np.lexsort((rid, n))
        self.rid, self.n, self.weight = rid[order], n[order], weight[order]
        arrays, self.tiles, self.all_tiles = ([x[i] for i in order] for x in (shared, tiles, all_tiles))
        #: 0 and 1: blocks that are compared with each other only; None: all with all.
        self.side = None if side is None else side[order]
        self.m = np.array([len(a) for a in arrays], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.m)))
        self.flat = np.concatenate(arrays).view(np.uint64) if len(arrays) else np.zeros(0, np.uint64)
        words, self.ids = np.unique(self.flat, return_inverse=True)
        self.mark = np.zeros(len(words), bool)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        members, at = np.repeat(np.arange(len(order)), [len(t) for t in self.tiles]), np.concatenate(self.tiles)
        by_tile = np.lexsort((members, at))
        self.tile_ids, first = np.unique(at[by_tile], return_index=True)
        self.in_tile = np.split(members[by_tile], first[1:])
        self.whole = np.array([len(t) == len(a) for t, a in zip(self.tiles, self.all_tiles, strict=True)])

    def _map(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the members that may be linked with one of this length, and the row of each."""
        if bits not in self.maps:
            rows = np.flatnonzero(self.m >= (3 * bits // 16 if bits > 64 else 0))  # three quarters of a set and more are shared
            at = np.zeros(len(self.m), np.int64)
            at[rows] = np.arange(len(rows))
            sizes = self.m[rows]
            flat = np.concatenate([self.flat[a : a + k] for a, k in zip(self.start[rows], sizes, strict=True)])
            self.maps[bits] = bitmaps(flat, np.repeat(np.arange(len(rows)), sizes), len(rows), bits), at
        return self.maps[bits]

    def _linked(self, i: int, near: np.ndarray) -> np.ndarray:
        """Which of near are linked with i."""
        need = MORE * (self.n[i] + self.n[near])
        bits = 1 << min(15, max(4, int(self.m[i] - 1).bit_length()) + 1)
        maps, at = self._map(max(64, bits))
        possible = OF * overlap_bound(maps[at[i]], self.m[i], maps[at[near]], self.m[near]) >= need
        near, need = near[possible], need[possible]
        if not len(near):
            return near
        own = self.ids[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        sizes = self.m[near]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(int(sizes.sum())) + np.repeat(self.start[near] - begins, sizes)
        common = np.add.reduceat(self.mark[self.ids[at]].astype(np.int64), begins)
        self.mark[own] = False
        return near[OF * common >= need]

    def _counts_here(self, i: int, j: int) -> bool:
        """Whether the first tile that i and j have in common is one of this unit's."""
        both = np.intersect1d(self.all_tiles[i], self.all_tiles[j], assume_unique=True)
        at = np.searchsorted(self.tile_ids, both[0])
        return at < len(self.tile_ids) and self.tile_ids[at] == both[0]

    def links(self, every: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each member the rid it is joined to and the weight linked to it; the linked pairs of places, if every.

        Otherwise pairs that are joined already are skipped, and the weights and pairs mean nothing.
        """
        label, groups = np.arange(len(self.n)), {i: [i] for i in range(len(self.n))}
        far, pairs = np.zeros(len(self.n), np.int64), []
        most = np.searchsorted(self.n, 4 * self.n // 3, "right")  # sorted by size: later ones are too large
        for i in range(len(self.n)):
            lists = [self.in_tile[k] for k in np.searchsorted(self.tile_ids, self.tiles[i])]
            near = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            near = near[np.searchsorted(near, i, "right") : np.searchsorted(near, most[i])]
            if self.side is not None:
                near = near[self.side[near] != self.side[i]]
            if not every:
                near = near[label[near] != label[i]]
            if not len(near):
                continue
            near = self._linked(i, near)
            for j in near[label[near] != label[i]]:
                a, b = label[i], label[j]
                if a != b:
                    a, b = (a, b) if len(groups[a]) >= len(groups[b]) else (b, a)
                    label[groups[b]] = a
                    groups[a] += groups.pop(b)
            if every and len(near):
                if not self.whole[i]:
                    near = near[[bool(self.whole[j]) or self._counts_here(i, j) for j in near]]
                far[i] += self.weight[near].sum()
                far[near] += self.weight[i]
                pairs.append((np.full(len(near), i), near))
        root = self.rid.copy()
        for members in groups.values():
            root[members] = self.rid[members].min()
        return root, far, pairs


def _compared(units: DataFrame, members: DataFrame, parts: int, every: bool, as_pairs: bool = False) -> DataFrame:
    """rid, root and far of every member of every unit, or the linked pairs of rids (a, b)."""
    own = units.groupBy("unit", "rid").agg(F.max("block").alias("block"), F.sort_array(F.collect_list("tile")).alias("tiles"))
    all_tiles = units.groupBy("rid").agg(F.sort_array(F.collect_set("tile")).alias("all_tiles"))
    rows = own.join(all_tiles, "rid").join(members, "rid").select(F.xxhash64("unit").alias("key"), "unit", "block", "rid", "n", "weight", "shared", "tiles", "all_tiles")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "unit")

    def unit_of(b: pa.Table) -> Unit:
        plain = lambda c: b.column(c).to_numpy().astype(np.int64)
        lists = lambda c: _split(b.column(c).combine_chunks())
        unit, side = b.column("unit")[0].as_py(), None
        rid = plain("rid")
        if unit["block1"] is not None and (unit["band1"], unit["block1"]) != (unit["band2"], unit["block2"]):
            in_band = band(plain("n"))
            side = (in_band != unit["band1"]).astype(int) if unit["band1"] != unit["band2"] else plain("block") != unit["block1"]
        return Unit(rid, plain("n"), plain("weight"), lists("shared"), lists("tiles"), lists("all_tiles"), side)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result() -> pa.RecordBatch:
            u = unit_of(pa.Table.from_batches(held))
            root, far, pairs = u.links(every)
            if as_pairs:
                a, b = (u.rid[np.concatenate(x)] if pairs else u.rid[:0] for x in ([p[0] for p in pairs], [p[1] for p in pairs]))
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            return pa.RecordBatch.from_arrays([pa.array(u.rid), pa.array(root), pa.array(far)], ["rid", "root", "far"])

        for b in batches:
            units = b.column("unit").to_pylist() if b.num_rows else []
            cuts = [i for i in range(1, len(units)) if units[i] != units[i - 1]]
            for a, e in zip([0, *cuts], [*cuts, len(units)], strict=True):
                if e > a and held and held[-1].column("unit")[0].as_py() != units[a]:
                    yield result()
                    held = []
                if e > a:
                    held.append(b.slice(a, e - a))
        if held:
            yield result()

    return rows.mapInArrow(lambda batches: released(of(batches)), "a bigint, b bigint" if as_pairs else "rid bigint, root bigint, far bigint")


def _split(lists: pa.ListArray) -> list[np.ndarray]:
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _known(sets: DataFrame) -> DataFrame:
    return sets.filter("known AND n > 0")


class _Prepared:
    """What comes before the comparison.

    rows: doc_id and digest of every row. sets: what _index gives. classes: c1, c2, weight (rows) and class_id.
    members: rid, class, n, weight, m and shared shingles of those that are in tiles. units: what _units gives.
    """

    def __init__(self, docs: DataFrame, most: int, ranges: int | None) -> None:
        spark = docs.sparkSession
        bounded_batches(spark)
        docs = docs.select("doc_id", "text")
        if ranges is None:
            ranges = ranges_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        folder, self.parts = shared_dir(spark, "shingles"), buckets(spark)
        self.rows, texts, once = _texts(docs)
        self.sets = written(_index(once, folder, ranges), "sets")
        known = _known(self.sets)
        per_text = known.dropDuplicates(["digest"]).select("digest", "c1", "c2").join(texts, "digest")
        self.classes = written(per_text.groupBy("c1", "c2").agg(F.sum("rows").alias("weight"), F.min("first").alias("class_id")), "classes")
        found = written(_candidates(self.sets, _shared(spark, folder, ranges), self.parts), "candidates")
        Folder(folder).delete()
        firsts = found.select("rid").join(known.select("rid", "c1", "c2"), "rid").groupBy("c1", "c2").agg(F.min("rid").alias("rid"))
        heads = written(firsts.join(self.classes, ["c1", "c2"]).drop("class_id"), "heads")
        self.members = written(found.join(heads, "rid").select("rid", "c1", "c2", "n", "weight", F.size("shared").cast("bigint").alias("m"), "shared"), "members")
        self.units = written(_units(_tiles(heads.select("rid"), found.select("rid", "prefix")), self.members, most), "units")
        drop(found, heads, texts)

    def compared(self, every: bool, as_pairs: bool = False) -> DataFrame:
        return _compared(self.units, self.members, self.parts, every, as_pairs)


def _roots(joined: DataFrame) -> DataFrame:
    """rid and root, the smallest rid that units join it to, of rows (rid, root) of several units.

    Only members of several units join units, so that a unit's star isn't taken through the rounds.
    """
    sets = joined.select("rid", "root").distinct()
    several = sets.groupBy("rid").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("rid", "a")
    edges = sets.join(several, "rid").filter("a <> root").select("a", F.col("root").alias("b"))
    far = components(edges).withColumnRenamed("root", "far_root")
    one = sets.groupBy("rid").agg(F.min("root").alias("root"))
    return one.join(far, F.col("root") == F.col("node"), "left").select("rid", F.coalesce("far_root", "root").alias("root"))


def _answer(p: _Prepared, joined: DataFrame) -> DataFrame:
    """doc_id, n, class_id, component_id and n_links of every row."""
    far = joined.groupBy("rid").agg(F.sum("far").alias("far"))
    named = written(p.members.select("rid", "c1", "c2").join(_roots(joined), "rid").join(far, "rid").join(p.classes, ["c1", "c2"]).select("c1", "c2", "root", "far", "class_id"), "named")
    heads = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    more = named.join(heads, "root").select("c1", "c2", "far", "component_id")
    per = p.classes.join(more, ["c1", "c2"], "left").select("c1", "c2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    per_text = written(p.sets.dropDuplicates(["digest"]).select("digest", "n", "c1", "c2").join(per, ["c1", "c2"], "left").drop("c1", "c2"), "per-text")
    alone = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links")
    return p.rows.join(per_text, "digest").select("doc_id", F.col("n").alias("n_shingles"), alone("component_id"), alone("class_id"), links)


def jaccard_join(docs: DataFrame, most: int = UNIT, ranges: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every row.

    component_id is the smallest doc_id that links reach, class_id that of the rows with the same set (each other's
    copies), and n_links the number of other rows that the row is linked with.
    """
    p = _Prepared(docs, most, ranges)
    return _answer(p, written(p.compared(True), "joined"))


def jaccard_groups(docs: DataFrame, most: int = UNIT, ranges: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row."""
    p = _Prepared(docs, most, ranges)
    return _answer(p, written(p.compared(False), "joined")).drop("n_links")


def jaccard_links(docs: DataFrame, most: int = UNIT, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and class (c1, c2) of every row, and all pairs of different classes (a1, a2), (b1, b2) that are linked.

    Rows of one class are linked with each other. Rows without a doc_id or a word have no class.
    """
    p = _Prepared(docs, most, ranges)
    x, y = (p.members.select(F.col("rid").alias(k), F.col("c1").alias(f"{k}1"), F.col("c2").alias(f"{k}2")) for k in "ab")
    kept = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    rows = p.rows.join(p.sets.dropDuplicates(["digest"]), "digest").select("doc_id", "n", kept("c1"), kept("c2"))
    return rows, p.compared(True, as_pairs=True).join(x, "a").join(y, "b").select("a1", "a2", "b1", "b2")


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), by comparing every two sets of strings; for tests."""
    sets = {}
    for k, t in texts.items():
        words = [w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]
        sets[k] = {tuple(words[i : i + K]) for i in range(len(words) - K + 1)} if len(words) >= K else {tuple(words)} if words else set()
    root = {k: k for k in sets}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for k in sets:
        for j in sets:
            if j < k and sets[j] and sets[k] and 100 * len(sets[j] & sets[k]) >= 75 * len(sets[j] | sets[k]):
                a, b = sorted((find(j), find(k)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}
