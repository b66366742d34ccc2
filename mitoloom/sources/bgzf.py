"""BGZF: blocks from any place of a file on, without an index, and blocks written with the virtual offsets of what is in them.

A virtual offset is a block's place in the file, shifted by 16 bits, plus a place in the block's unpacked bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any, BinaryIO

MAGIC = b"\x1f\x8b\x08\x04"
#: Most bytes of a block, packed and unpacked, and how many are packed together when written.
MOST, FILL = 1 << 16, 65_280
#: Headers that must follow one another for a place inside a file to count as the start of a block.
LINKS = 3
#: The empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(data: bytes, at: int = 0) -> int:
    """The size of the block whose header is at ``at``; 0 where no whole header is."""
    if data[at : at + 4] != MAGIC or at + 12 > len(data):
        return 0
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(data)):
        (size,) = struct.unpack_from("<H", data, at + 2)
        if data[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + size
    return 0


def is_bgzf(head: bytes) -> bool:
    return block_size(head) > 0


def unpacked(block: bytes) -> bytes:
    (extra,) = struct.unpack_from("<H", block, 10)
    data = zlib.decompress(block[12 + extra : -8], -15)
    if len(data) != struct.unpack_from("<I", block, len(block) - 4)[0]:
        raise ValueError("BGZF block of another size than it says")
    return data


def packed(data: bytes) -> bytes:
    """One block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) + 26 > MOST:
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)  # stored as it is
        body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, block: int = 60_000) -> bytes:
    """BGZF blocks of data, and the empty block that ends a file."""
    return b"".join(packed(data[at : at + block]) for at in range(0, len(data), block)) + END


class Blocks:
    """The blocks of an open file from ``at`` on, as (place in the file, unpacked bytes); a broken block raises."""

    def __init__(self, raw: Any, size: int, at: int = 0, ahead: int = 1 << 18):
        self.raw, self.size, self.ahead = raw, size, ahead
        self.at, self.have = at, b""

    def _fill(self, n: int) -> None:
        if len(self.have) < n and self.at + len(self.have) < self.size:
            self.raw.seek(self.at + len(self.have))
            self.have += self.raw.read(min(max(n - len(self.have), self.ahead), self.size - self.at - len(self.have)))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return self

    def __next__(self) -> tuple[int, bytes]:
        self._fill(18)
        if not self.have:
            raise StopIteration
        size = block_size(self.have)
        if not size:
            self._fill(MOST)
            size = block_size(self.have)
        if not size:
            raise ValueError(f"not a BGZF block at {self.at}")
        self._fill(size)
        if len(self.have) < size:
            raise ValueError(f"BGZF block cut short at {self.at}")
        place, data = self.at, unpacked(self.have[:size])
        self.at, self.have = self.at + size, self.have[size:]
        return place, data


def first_block(raw: Any, size: int, at: int) -> int:
    """The place of the first block that starts at ``at`` or behind it; the file's size where there is none.

    Packed bytes may look like a header: a place counts only if LINKS further headers follow, each where the one before says,
    or the file ends where the last one says.
    """
    if at <= 0 or at >= size:
        return 0 if at <= 0 else size
    raw.seek(at)
    data = raw.read(min((LINKS + 2) * MOST, size - at))
    whole = at + len(data) >= size
    place = data.find(MAGIC)
    while 0 <= place < MOST or (whole and place >= 0):
        end, links = place, 0
        while links <= LINKS and (step := block_size(data, end)):
            end, links = end + step, links + 1
        if links > LINKS or (links and whole and end == len(data)):
            return at + place
        place = data.find(MAGIC, place + 1)
    if whole:
        return size
    raise ValueError(f"no BGZF block within {MOST} bytes of {at}")


class Writer:
    """Packs what is written into blocks; tell() is the virtual offset of what is written next."""

    def __init__(self, out: BinaryIO, fill: int = FILL):
        self.out, self.fill = out, fill
        self.at, self.have = 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.have)

    def write(self, data: bytes) -> None:
        while data:
            take = min(len(data), self.fill - len(self.have))
            self.have += data[:take]
            data = data[take:]
            if len(self.have) == self.fill:
                self.flush()

    def flush(self) -> None:
        """Ends the block, so that what follows starts one."""
        if self.have:
            self.at += self.out.write(block := packed(bytes(self.have))) or len(block)
            self.have.clear()

    def end(self) -> None:
        self.flush()
        self.out.write(END)


def _rest(data: bytes, cut: int, starts: list[int], offsets: list[int]) -> tuple[bytes, list[int], list[int]]:
    """What lies behind ``cut``, with the blocks that it lies in."""
    k = bisect_right(starts, cut) - 1
    return data[cut:], [0, *(s - cut for s in starts[k + 1 :])], [offsets[k] + cut - starts[k], *offsets[k + 1 :]]


def lines_of_split(raw: Any, size: int, low: int, high: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """The lines of the split ``low`` to ``high`` of a BGZF file, whole, with the blocks that they lie in.

    Yields (bytes, places in these bytes at which blocks begin, virtual offsets of those places). A split begins behind the first
    line feed in the blocks that start at ``low`` or later and ends with the first one in those that start at ``high`` or later, so
    that each line is in one split, wherever blocks and splits are cut.
    """
    blocks = Blocks(raw, size, first_block(raw, size, low))
    skipping, pending, starts, offsets = low > 0, b"", [], []
    for place, data in blocks:
        if skipping:
            feed = data.find(b"\n") + 1
            if not feed:
                if place >= high:
                    return
                continue
            skipping = False
            if place >= high:
                return
            piece, first = data[feed:], place << 16 | feed
        else:
            piece, first = data, place << 16
        last = place >= high
        if last:
            feed = piece.find(b"\n") + 1
            piece = piece[:feed] if feed else piece
        starts.append(len(pending))
        offsets.append(first)
        pending += piece
        if last and feed:
            break
        if len(pending) >= 1 << 20 and not last and (cut := pending.rfind(b"\n") + 1):
            yield pending[:cut], starts, offsets
            pending, starts, offsets = _rest(pending, cut, starts, offsets)
    if pending:
        yield pending, starts, offsets


def lines_of_range(raw: Any, size: int, low: int, high: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """What lies between two virtual offsets that are starts of lines, in the same form."""
    pending, starts, offsets = b"", [], []
    for place, data in Blocks(raw, size, low >> 16, ahead=MOST):
        first = low & 0xFFFF if place == low >> 16 else 0
        end = high & 0xFFFF if place == high >> 16 else 0 if place > high >> 16 else len(data)
        if end > first:
            starts.append(len(pending))
            offsets.append(place << 16 | first)
            pending += data[first:end]
        if place >= high >> 16:
            break
        if len(pending) >= 1 << 20 and (cut := pending.rfind(b"\n") + 1):
            yield pending[:cut], starts, offsets
            pending, starts, offsets = _rest(pending, cut, starts, offsets)
    if pending:
        yield pending, starts, offsets
