"""Indexes of files that are sorted by place: levels of bins with their chunks, and the least offset of each window (BAI, TBI, CSI)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

#: log2 of the positions of the smallest bins and of the windows, and the levels of bins below the whole, in BAI and TBI.
SHIFT, DEPTH = 14, 5
Chunk = tuple[int, int]


def bin_of(start: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds the 0-based, half-open interval whole."""
    end = max(end, start + 1) - 1
    first = ((1 << 3 * depth) - 1) // 7
    for level in range(depth, 0, -1):
        at = shift + 3 * (depth - level)
        if start >> at == end >> at:
            return first + (start >> at)
        first -= 1 << 3 * (level - 1)
    return 0


def bins_of(start: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> Iterator[range]:
    """The bins that may hold something that meets the interval: a range of bins for each level."""
    first = 0
    for level in range(depth + 1):
        at = shift + 3 * (depth - level)
        yield range(first + (start >> at), first + (max(end, start + 1) - 1 >> at) + 1)
        first += 1 << 3 * level


def merged(chunks: Iterable[Chunk]) -> list[Chunk]:
    """Chunks in order, joined where they meet or end and start in one block."""
    out: list[Chunk] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass
class Contig:
    bins: dict[int, list[Chunk]] = field(default_factory=dict)
    #: The least offset of what meets each window (0: nothing), or of what is in each bin or right of it.
    windows: list[int] = field(default_factory=list)
    least: dict[int, int] = field(default_factory=dict)


@dataclass
class Index:
    contigs: list[Contig]
    names: list[str] = field(default_factory=list)
    shift: int = SHIFT
    depth: int = DEPTH

    @property
    def _last_bin(self) -> int:
        return ((1 << 3 * (self.depth + 1)) - 1) // 7 - 1

    def chunks(self, contig: int, start: int, end: int) -> list[Chunk]:
        """What must be read for all that meets the interval."""
        if not 0 <= contig < len(self.contigs):
            return []
        of = self.contigs[contig]
        end = min(end, 1 << self.shift + 3 * self.depth)
        low = self._least(of, start)
        found = []
        for bins in bins_of(start, end, self.shift, self.depth):
            for b in bins if len(bins) < len(of.bins) else (b for b in of.bins if b in bins):
                found += of.bins.get(b, ())
        # nothing that meets the interval begins before ``low``, which is itself the start of a record
        return merged((max(a, low), b) for a, b in found if b > low)

    def _least(self, of: Contig, start: int) -> int:
        if of.least:
            b = ((1 << 3 * self.depth) - 1) // 7 + (start >> self.shift)
            while b and b not in of.least:
                b = b - 1 if b & 7 != 1 else (b - 1) >> 3  # the bin to its left, or else the one around it
            return of.least.get(b, 0)
        return next((o for o in of.windows[start >> self.shift :] if o), max(of.windows, default=0))

    def last(self) -> int:
        """Where the last placed record ends; 0 without any."""
        return max((b for c in self.contigs for k, chunks in c.bins.items() if k <= self._last_bin for _, b in chunks), default=0)


def _bins(raw: bytes, at: int, with_least: bool) -> tuple[Contig, int]:
    out = Contig()
    (n,) = struct.unpack_from("<i", raw, at)
    at += 4
    for _ in range(n):
        (b,) = struct.unpack_from("<I", raw, at)
        at += 4
        if with_least:
            (out.least[b],) = struct.unpack_from("<Q", raw, at)
            at += 8
        (chunks,) = struct.unpack_from("<i", raw, at)
        flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 4)
        out.bins[b] = list(zip(flat[::2], flat[1::2], strict=True))
        at += 4 + 16 * chunks
    return out, at


def _windows(raw: bytes, at: int, contig: Contig) -> int:
    (n,) = struct.unpack_from("<i", raw, at)
    contig.windows = list(struct.unpack_from(f"<{n}Q", raw, at + 4))
    return at + 4 + 8 * n


def parse(raw: bytes) -> Index:
    """Any of the three kinds, unpacked."""
    kind, at = raw[:4], 4
    if kind not in (b"BAI\x01", b"TBI\x01", b"CSI\x01"):
        raise ValueError("not an index (BAI, TBI or CSI)")
    names: list[str] = []
    shift, depth = SHIFT, DEPTH
    if kind == b"CSI\x01":
        shift, depth, extra = struct.unpack_from("<3i", raw, at)
        if extra >= 28:
            names = _names(raw[at + 12 + 28 : at + 12 + extra])
        at += 12 + extra
    (n,) = struct.unpack_from("<i", raw, at)
    at += 4
    if kind == b"TBI\x01":
        (length,) = struct.unpack_from("<i", raw, at + 24)
        names = _names(raw[at + 28 : at + 28 + length])
        at += 28 + length
    contigs = []
    for _ in range(n):
        contig, at = _bins(raw, at, kind == b"CSI\x01")
        if kind != b"CSI\x01":
            at = _windows(raw, at, contig)
        contigs.append(contig)
    return Index(contigs, names, shift, depth)


def _names(raw: bytes) -> list[str]:
    return [x.decode() for x in raw.split(b"\0")[:-1]]


#: The layout of a VCF's lines in a TBI or CSI index (format, columns of contig, start and end, comment sign, lines to skip).
VCF_LAYOUT = (2, 1, 2, 0, ord("#"), 0)


def _layout(names: Sequence[str]) -> bytes:
    text = b"".join(n.encode() + b"\0" for n in names)
    return struct.pack("<7i", *VCF_LAYOUT, len(text)) + text


def serialised(index: Index, kind: str) -> bytes:
    """The index in the layout of ``kind`` (bai, tbi or csi), not yet packed."""
    out = []
    if kind == "bai":
        out.append(b"BAI\x01" + struct.pack("<i", len(index.contigs)))
    elif kind == "tbi":
        out.append(b"TBI\x01" + struct.pack("<i", len(index.contigs)) + _layout(index.names))
    else:
        extra = _layout(index.names) if index.names else b""
        out.append(b"CSI\x01" + struct.pack("<3i", index.shift, index.depth, len(extra)) + extra + struct.pack("<i", len(index.contigs)))
    for contig in index.contigs:
        out.append(struct.pack("<i", len(contig.bins)))
        for b, chunks in sorted(contig.bins.items()):
            out.append(struct.pack("<I", b))
            if kind == "csi":
                out.append(struct.pack("<Q", contig.least.get(b, 0)))
            out.append(struct.pack(f"<i{2 * len(chunks)}Q", len(chunks), *(x for c in chunks for x in c)))
        if kind != "csi":
            out.append(struct.pack(f"<i{len(contig.windows)}Q", len(contig.windows), *contig.windows))
    return b"".join(out)


class Builder:
    """Tables of one stretch of a file from its records in order; stretches are put together by put_together."""

    def __init__(self, shift: int = SHIFT, depth: int = DEPTH):
        self.shift, self.depth = shift, depth
        self.bins: dict[tuple[int, int], list[list[int]]] = {}
        self.windows: dict[tuple[int, int], int] = {}
        self._last: tuple[int, int] | None = None

    def add(self, contig: int, start: int, end: int, low: int, high: int) -> None:
        """A record of the 0-based, half-open interval that lies between two virtual offsets."""
        key = (contig, bin_of(start, end, self.shift, self.depth))
        chunks = self.bins.setdefault(key, [])
        if chunks and (key == self._last or chunks[-1][1] >> 16 == low >> 16):
            chunks[-1][1] = high
        else:
            chunks.append([low, high])
        self._last = key
        for w in range(start >> self.shift, (max(end, start + 1) - 1 >> self.shift) + 1):
            self.windows.setdefault((contig, w), low)

    def tables(self) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
        """((contig, bin, low, high) of each chunk, (contig, window, offset) of each window)."""
        return [(c, b, low, high) for (c, b), chunks in self.bins.items() for low, high in chunks], [(c, w, o) for (c, w), o in self.windows.items()]


def put_together(stretches: Iterable[tuple[int, tuple[list, list]]], contigs: int, names: Sequence[str] = (), shift: int = SHIFT, depth: int = DEPTH) -> Index:
    """The index of a file from (place in the file, tables) of its stretches, whose offsets count from the stretch's own start."""
    found = [Contig() for _ in range(contigs)]
    windows: list[dict[int, int]] = [{} for _ in range(contigs)]
    for base, (chunks, starts) in stretches:
        move = base << 16
        for c, b, low, high in chunks:
            found[c].bins.setdefault(b, []).append((low + move, high + move))
        for c, w, offset in starts:
            windows[c][w] = min(windows[c].get(w, offset + move), offset + move)
    for contig, own in zip(found, windows, strict=True):
        contig.bins = {b: merged(chunks) for b, chunks in contig.bins.items()}
        contig.windows = [own.get(w, 0) for w in range(max(own, default=-1) + 1)]
        # a window that nothing meets takes the offset of the next that something does
        after = 0
        for w in range(len(contig.windows) - 1, -1, -1):
            after = contig.windows[w] = contig.windows[w] or after
        for b in contig.bins:
            level = next(k for k in range(depth + 1) if b < ((1 << 3 * (k + 1)) - 1) // 7)
            w = (b - ((1 << 3 * level) - 1) // 7) << 3 * (depth - level)
            contig.least[b] = contig.windows[w] if w < len(contig.windows) else 0
    return Index(found, list(names), shift, depth)
