"""Immutable sorted runs of hashes with other columns, in files that are read by hash range.

A run is one file: a block for each bucket (a range of hashes), then an index of byte offsets and a trailer. A block is
a row of frames of at most FRAME rows, each compressed by itself, so that a reader holds one frame of each run. Within
a frame hashes are sorted and kept as differences, those of further columns once each; every column's bytes are kept by
significance, so that bytes that don't vary cost nothing. Reading a bucket of a run is one range read, as a shuffle's fetch is.

``merged`` is a k-way merge by blocks: it needs one frame a run, however large the bucket or however frequent a hash.
``settled`` merges runs in groups of FAN until a folder has FAN at most, so that neither the number of files a task
opens nor the list of names grows with the input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import trim

MAGIC = b"SMRUN\x00\x00\x02"
FRAME = 1 << 16
FAN = 256
#: Rows of a merged block, about.
BLOCK = 400_000
#: Bytes of text whose hashes one range holds.
RANGE_BYTES = 16 << 20
KINDS = ("<u8", "<i8", "<u4")


def ranges_for(n_bytes: int) -> int:
    """Number of ranges for so many bytes of text: as many as keep a range's share the same at every size."""
    return max(8, -(-n_bytes // RANGE_BYTES))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits, in order of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _column(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    part = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return np.ascontiguousarray(part).view(kind).reshape(n), at + n * size


def _frame(columns: list[np.ndarray]) -> bytes:
    plain, data = struct.pack("<IB", len(columns[0]), len(columns)), b""
    for i, x in enumerate(columns):
        if x.dtype == np.uint64 and i:  # hashes that repeat: the different ones, and which it is
            known, which = np.unique(x, return_inverse=True)
            plain += b"dict"
            data += struct.pack("<I", len(known)) + _planes(np.diff(known, prepend=np.uint64(0))) + _planes(which.astype(np.uint16))
        else:
            plain += x.dtype.str.encode().ljust(4)
            data += _planes(np.diff(x, prepend=np.uint64(0)) if x.dtype == np.uint64 else np.ascontiguousarray(x))
    plain += data
    body = zstandard.ZstdCompressor(level=1).compress(plain)
    return struct.pack("<I", len(body)) + body


def pack(*columns: np.ndarray) -> bytes:
    """A block of columns of equal length. Unsigned 64-bit ones are hashes: the first is sorted, others may repeat."""
    return b"".join(_frame([c[a : a + FRAME] for c in columns]) for a in range(0, len(columns[0]), FRAME))


def frames(block: bytes) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
    """The columns of each frame, and whether it is the block's last."""
    at = 0
    while at < len(block):
        (size,) = struct.unpack_from("<I", block, at)
        data = zstandard.ZstdDecompressor().decompress(block[at + 4 : at + 4 + size])
        at += 4 + size
        n, count = struct.unpack_from("<IB", data)
        place, out = 5 + 4 * count, []
        for i in range(count):
            kind = data[5 + 4 * i : 9 + 4 * i].decode().strip()
            if kind == "dict":
                known, place = _column(data, place + 4, struct.unpack_from("<I", data, place)[0], "<u8")
                which, place = _column(data, place, n, "<u2")
                out.append(np.cumsum(known, dtype=np.uint64)[which])
                continue
            x, place = _column(data, place, n, kind)
            out.append(np.cumsum(x, dtype=np.uint64) if x.dtype == np.uint64 else x)
        yield tuple(out), at >= len(block)


def unpack(block: bytes, kinds: tuple[str, ...] = KINDS) -> tuple[np.ndarray, ...]:
    """The columns of the whole block; kinds are their types, for a block without rows."""
    parts = [c for c, _ in frames(block)]
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else tuple(np.zeros(0, k) for k in kinds)


def _up_to(columns: tuple[np.ndarray, ...], cut: tuple) -> int:
    """How many rows have (first, second column) no larger than cut."""
    a, b = np.searchsorted(columns[0], cut[0], "left"), np.searchsorted(columns[0], cut[0], "right")
    return int(a + np.searchsorted(columns[1][a:b], cut[1], "right"))


def merged(runs: Iterable[Iterator[tuple[tuple[np.ndarray, ...], bool]]]) -> Iterator[tuple[np.ndarray, ...]]:
    """All rows of runs sorted by their first two columns, in that order, block by block.

    Rows that agree in both columns must be of one run; they keep their order. A block may end within a hash.
    """
    heads = [[*first, r] for r in runs for first in [next(r, None)] if first is not None]
    while heads:
        open_ends = [(c[0][-1], c[1][-1]) for c, last, _ in heads if not last]
        cut = min(open_ends) if open_ends else None
        total = sum(len(c[0]) for c, _, _ in heads)
        if total > BLOCK:  # about so many rows: each head's share of them ends somewhere, half of them by the middle one
            shares = sorted((c[0][k - 1], c[1][k - 1]) for c, _, _ in heads for k in [max(1, len(c[0]) * BLOCK // total)])
            middle = shares[len(shares) // 2]
            cut = middle if cut is None else min(cut, middle)
        parts, still = [], []
        for columns, last, rest in heads:
            k = len(columns[0]) if cut is None else _up_to(columns, cut)
            if k:
                parts.append(tuple(c[:k] for c in columns))
            if k < len(columns[0]):
                still.append([tuple(c[k:] for c in columns), last, rest])
            elif not last:
                still.append([*next(rest), rest])
        heads = still
        if len(parts) == 1:
            yield parts[0]
        else:
            columns = tuple(map(np.concatenate, zip(*parts, strict=True)))
            order = np.lexsort((columns[1], columns[0]))
            yield tuple(c[order] for c in columns)


class Folder:
    """Run files of one folder of a shared store."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.kind = fs

    def write(self, name: str, blocks: Iterable[bytes | Iterable[bytes]], attempt: int) -> None:
        """Under a temporary name first; the same task writes the same bytes again. A block may come in parts."""
        self.fs.create_dir(self.path, recursive=True)
        temporary, offsets = f"{self.path}/_temporary-{name}-{attempt}", [0]
        with self.fs.open_output_stream(temporary) as out:
            for block in blocks:
                size = 0
                for part in [block] if isinstance(block, bytes) else block:
                    out.write(part)
                    size += len(part)
                offsets.append(offsets[-1] + size)
            out.write(np.array(offsets, "<u8").tobytes() + struct.pack("<Q", len(offsets)) + MAGIC)
        final = f"{self.path}/{name}"
        try:
            self.fs.move(temporary, final)
        except OSError:  # some stores refuse a name that an earlier attempt of the same task has taken
            if self.fs.get_file_info(final).type != self.kind.FileType.File:
                raise
            self.fs.delete_file(temporary)

    def names(self) -> list[str]:
        found = self.fs.get_file_info(self.kind.FileSelector(self.path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".run"))

    def block(self, name: str, bucket: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            size = f.size()
            f.seek(size - 16)
            (n,) = struct.unpack("<Q", f.read(8))
            if f.read(8) != MAGIC:
                raise ValueError(f"{name} is not a run")
            f.seek(size - 16 - 8 * n + 8 * bucket)
            a, b = struct.unpack("<QQ", f.read(16))
            f.seek(a)
            return f.read(b - a)

    def frames(self, name: str, bucket: int) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
        return frames(self.block(name, bucket))

    def read(self, name: str, bucket: int, kinds: tuple[str, ...] = KINDS) -> tuple[np.ndarray, ...]:
        return unpack(self.block(name, bucket), kinds)

    def delete(self, names: list[str] | None = None) -> None:
        """The named files, or the folder."""
        if names is not None:
            for name in names:
                self.fs.delete_file(f"{self.path}/{name}")
        elif self.fs.get_file_info(self.path).type == self.kind.FileType.Directory:
            self.fs.delete_dir(self.path)


class Writer:
    """Sorts a task's rows in chunks by their first two columns and writes each chunk as a run of the folder.

    Jobs that write to one folder need prefixes of their own, and each task (of a range) one writer.
    """

    def __init__(self, folder: str, ranges: int, prefix: str = "p", chunk: int = 500_000) -> None:
        context = TaskContext.get()
        self.folder, self.ranges, self.chunk = Folder(folder), ranges, chunk
        self.part, self.attempt, self.prefix = context.partitionId(), context.taskAttemptId(), prefix
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.number = 0

    def add(self, *columns: np.ndarray) -> None:
        """Rows that agree in the first two columns must come in one call, in the order they are to have."""
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
            if self.size >= self.chunk:
                self.flush()

    def flush(self) -> None:
        if self.held:
            columns = tuple(map(np.concatenate, zip(*self.held, strict=True)))
            order = np.lexsort((columns[1], columns[0]))
            columns = tuple(c[order] for c in columns)
            cuts = np.searchsorted(bucket_of(columns[0], self.ranges), np.arange(self.ranges + 1))
            self.folder.write(f"{self.prefix}{self.part:06d}-{self.number:05d}.run", (pack(*[c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), self.attempt)
            self.held, self.size, self.number = [], 0, self.number + 1
            del columns, order
            trim()


def ranges_of(spark: SparkSession, ranges: int) -> DataFrame:
    """One row a range, each in a task of its own."""
    return spark.range(0, ranges, 1, ranges)


def settled(spark: SparkSession, folder: str, ranges: int, fan: int = FAN) -> list[str]:
    """The names of the folder's runs, once there are ``fan`` of them at most."""
    level = 0
    while len(names := Folder(folder).names()) > fan:
        groups = [names[a : a + fan] for a in range(0, len(names), fan)]
        level += 1

        def of(batches: Iterator, groups=groups, level=level) -> Iterator:
            files = Folder(folder)
            for b in batches:
                for g in b.column("id").to_pylist():
                    files.write(f"m{level:02d}-{g:06d}.run", ((pack(*c) for c in merged([files.frames(n, k) for n in groups[g]])) for k in range(ranges)), TaskContext.get().taskAttemptId())
                yield b

        spark.range(0, len(groups), 1, len(groups)).mapInArrow(of, "id bigint").write.format("noop").mode("overwrite").save()
        Folder(folder).delete(names)
    return names
