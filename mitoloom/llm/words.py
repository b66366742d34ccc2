"""Vectorised word tables over Arrow text: codes into a per-batch dictionary, hashes, shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd 64-bit multipliers of the mixing functions.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds about ``limit`` bytes of text, or one text if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordTable:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: ``codes[offsets[i]:offsets[i + 1]]`` index ``vocabulary``."""

    def __init__(self, texts: pa.Array, lower: str | None = "ascii"):
        texts = pc.fill_null(texts, "")
        if lower == "ascii":
            texts = pc.ascii_lower(texts)
        elif lower == "utf8":
            texts = pc.utf8_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        encoded = lists.flatten().dictionary_encode()
        self.codes = encoded.indices.to_numpy()
        self.vocabulary: list[str] = encoded.dictionary.to_pylist()
        self.offsets = offsets
        if "" in (empty := self.vocabulary):
            self.keep(np.array([w != "" for w in empty], dtype=bool))

    def keep(self, wanted: np.ndarray) -> None:
        """Drops the words whose dictionary entry is not wanted."""
        mask = wanted[self.codes] if len(self.codes) else np.zeros(0, dtype=bool)
        self.offsets = np.concatenate([[0], np.cumsum(mask)])[self.offsets]
        self.codes = self.codes[mask]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """An order-sensitive hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        out = (out ^ values[j : j + n]) * M1
        out ^= out >> np.uint64(29)
    return mix(out)


def ngram_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat start positions of the n-grams that lie within one text, and each text's number of them."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(counts.sum())
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(total), counts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's distinct shingles, sorted; a shorter text gives its whole sequence as one."""
    words = WordTable(texts)
    flat = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, dtype=np.uint64)
    starts, counts = ngram_starts(words.offsets, width)
    grams = rolling(flat, width)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    for length in range(1, width):
        short = np.flatnonzero(words.counts == length)
        if len(short):
            extra = rolling(flat, length)[words.offsets[short]]
            at = np.concatenate([[0], np.cumsum(counts)])[short]
            grams = np.insert(grams, at, extra)
            counts[short] = 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a > 1:
            grams[a:b].sort()
    if not len(grams):
        return offsets, grams
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[offsets[:-1][counts > 0]] = True
    return np.concatenate([[0], np.cumsum(fresh)])[offsets], grams[fresh]


def sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Wrapping 64-bit sums by group; the two halves stay exact in doubles for up to 2**20 values a group."""
    low = np.bincount(groups, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(groups, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def set_hashes(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set, whatever its order; 0 only for empty sets (with odds of 2**-64)."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), dtype=np.uint64)
    if len(values):
        full = sizes > 0
        out[full] = np.add.reduceat(mix(values), offsets[:-1][full])
        out[full] = mix(out[full] + sizes[full].astype(np.uint64) * M1)
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(total)
