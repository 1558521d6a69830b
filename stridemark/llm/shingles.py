"""Hashes of words and of runs of words, for whole Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the polynomial that joins the hashes of consecutive words, and of the final mixing.
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def split_words(texts: pa.Array, lower: bool = False) -> pa.Array:
    """Of each text the list of its parts between white space, of which the first and last may be empty; null: none.

    An array that is a part of another is copied first: Arrow's lower case takes the wrong bytes of such a one.
    """
    if texts.offset:
        texts = pa.array(texts.to_pylist(), texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    return pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: the 64-bit hash of each, and where each document's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False, seed: int = 0) -> None:
        split = split_words(texts, lower)
        flat = split.flatten().dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False)
        names = flat.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in names), np.uint64, len(names))
        filled = np.fromiter((w != "" for w in names), bool, len(names))[ids] if len(ids) else np.zeros(0, bool)
        ends = np.concatenate(([0], np.cumsum(filled)))
        offsets = split.offsets.to_numpy()
        self.offsets = ends[offsets - offsets[0]].astype(np.int64)
        self.hash = hashes[ids[filled]] if len(ids) else np.zeros(0, np.uint64)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place on, and whether they are of one document; as long as the words."""
        n = len(self.hash)
        h, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            part = self.hash[: n - k + 1].copy()
            for j in range(1, k):
                part = part * STEP + self.hash[j : n - k + 1 + j]
            h[: n - k + 1] = mixed(part + np.uint64(k))
            doc_end = np.repeat(self.offsets[1:], np.diff(self.offsets))
            whole = np.arange(n) + k <= doc_end
        return h, whole

    def sets(self, k: int) -> list[np.ndarray]:
        """Of each document the sorted distinct hashes of its k-word runs; of a shorter one that of all its words."""
        h, whole = self.runs(k)
        out = []
        for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif b > a:
                part = self.hash[a : a + 1].copy()
                for j in range(a + 1, b):
                    part = part * STEP + self.hash[j : j + 1]
                out.append(mixed(part + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
