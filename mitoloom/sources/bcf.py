"""BCF records: typed binary vectors that name fields and contigs by the header's dictionaries, to and from a VCF line's fields."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa

from mitoloom.sources import bgzf, genome_index

MAGIC = b"BCF\x02\x02"
# Codes of the vectors' types, and their missing and end-of-vector values.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
KINDS = {INT8: np.dtype("i1"), INT16: np.dtype("<i2"), INT32: np.dtype("<i4"), FLOAT: np.dtype("<f4"), CHAR: np.dtype("S1")}
MISSING = {INT8: -(1 << 7), INT16: -(1 << 15), INT32: -(1 << 31)}
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002
#: So many of the smallest values of an integer type stand for something else.
RESERVED = 8


def header_text(have: bytes) -> str | None:
    """The VCF header in the first unpacked bytes of a file; None if they do not reach so far."""
    if have[:5] != MAGIC:
        raise ValueError("not a BCF 2.2 file")
    if len(have) < 9 or len(have) < 9 + (size := struct.unpack_from("<I", have, 5)[0]):
        return None
    return have[9 : 9 + size].rstrip(b"\0").decode()


def header_bytes(lines: Sequence[str]) -> bytes:
    text = "\n".join(lines).encode() + b"\n\0"
    return MAGIC + struct.pack("<I", len(text)) + text


class Dictionary:
    """Numbers of the names that a header declares: filters and fields in one list, which PASS begins, contigs in another."""

    def __init__(self, lines: Sequence[str]):
        self.names: dict[int, str] = {0: "PASS"}
        self.kinds: dict[tuple[str, str], str] = {}
        by_number: dict[int, tuple[str, int | None]] = {}
        for line in lines:
            if not (m := re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>\s*$", line)):
                continue
            kind, body = m.groups()
            plain = re.sub(r'"(?:[^"\\]|\\.)*"', '""', body)  # commas and equal signs within quotes mean nothing
            found = dict(x.split("=", 1) for x in plain.split(",") if "=" in x)
            name, number = found["ID"], int(found["IDX"]) if "IDX" in found else None
            if kind == "contig":
                length = int(found["length"]) if found.get("length", "").isdigit() else None
                by_number.setdefault(max(by_number, default=-1) + 1 if number is None else number, (name, length))
                continue
            if kind != "FILTER":
                self.kinds.setdefault((kind, name), found["Type"])
            if name not in self.names.values():
                self.names[max(self.names) + 1 if number is None else number] = name
        self.contigs = [by_number.get(i, ("", None)) for i in range(max(by_number, default=-1) + 1)]
        self.number = {v: k for k, v in self.names.items()}
        self.contig_number = {c: i for i, (c, _) in enumerate(self.contigs)}
        last = lines[-1].split("\t") if lines else []
        self.samples = last[9:] if last and last[0] == "#CHROM" else []


def float_text(x: np.float32) -> str:
    """The shortest text that gives the same single-precision number again."""
    text = str(x)
    return text[:-2] if text.endswith(".0") else text


class _Vectors:
    """Typed values one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def kind(self) -> tuple[int, int]:
        """(type, length) of the next vector."""
        code = self.data[self.at]
        self.at += 1
        n = code >> 4
        if n == 15:
            n = int(self.integers()[0])
        return code & 15, n

    def take(self, kind: int, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, KINDS[kind], n, self.at)
        self.at += n * KINDS[kind].itemsize
        return out

    def integers(self) -> np.ndarray:
        kind, n = self.kind()
        return self.take(kind, n).astype(np.int64) if n else np.zeros(0, np.int64)

    def text(self) -> str:
        kind, n = self.kind()
        out = self.data[self.at : self.at + n].rstrip(b"\0").decode()
        self.at += n * (KINDS[kind].itemsize if n else 0)
        return out


def _value_texts(kind: int, values: np.ndarray) -> list[str]:
    """Texts of a vector up to its end; missing ones are points."""
    if kind == FLOAT:
        bits = values.view("<u4")
        ends = np.flatnonzero(bits == FLOAT_END)
        n = ends[0] if len(ends) else len(values)
        return ["." if b == FLOAT_MISSING else float_text(x) for x, b in zip(values[:n], bits[:n], strict=True)]
    ends = np.flatnonzero(values == MISSING[kind] + 1)
    n = ends[0] if len(ends) else len(values)
    return ["." if x == MISSING[kind] else str(x) for x in values[:n].tolist()]


def _chars(row: bytes) -> str:
    return row.rstrip(b"\0").decode() or "."


def _genotype(kind: int, values: np.ndarray) -> str:
    out = ""
    for x in values.tolist():
        if x == MISSING[kind] + 1:
            break
        allele = "." if x == MISSING[kind] or x >> 1 == 0 else str((x >> 1) - 1)
        out += ("|" if x & 1 and x != MISSING[kind] else "/") * bool(out) + allele
    return out or "."


def decoded(shared: bytes, individual: bytes, names: Dictionary) -> tuple:
    """(chrom, pos, id, ref, alt, qual, filter, info, format, samples) of a record."""
    contig, pos, _, qual, counts, shape = struct.unpack_from("<iii4sII", shared)
    n_info, n_alleles, n_samples, n_format = counts & 0xFFFF, counts >> 16, shape & 0xFFFFFF, shape >> 24
    at = _Vectors(shared, 24)
    ident = at.text() or "."
    alleles = [at.text() for _ in range(n_alleles)]
    filters = [names.names[i] for i in at.integers().tolist()]
    info = []
    for _ in range(n_info):
        key = names.names[int(at.integers()[0])]
        kind, n = at.kind()
        if kind == 0 or not n:
            info.append(key)
        elif kind == CHAR:
            info.append(f"{key}={_chars(at.data[at.at : at.at + n])}")
            at.at += n
        else:
            info.append(f"{key}={','.join(_value_texts(kind, at.take(kind, n)))}")
    at, keys, columns = _Vectors(individual), [], []
    for _ in range(n_format):
        key = names.names[int(at.integers()[0])]
        kind, n = at.kind()
        keys.append(key)
        if not n:
            columns.append(["."] * n_samples)
        elif kind == CHAR:
            columns.append([_chars(at.data[at.at + i * n : at.at + (i + 1) * n]) for i in range(n_samples)])
            at.at += n * n_samples
        else:
            rows = at.take(kind, n * n_samples).reshape(n_samples, n)
            columns.append([_genotype(kind, r) for r in rows] if key == "GT" else [",".join(_value_texts(kind, r)) or "." for r in rows])
    quality = "." if struct.unpack("<I", qual)[0] == FLOAT_MISSING else float_text(np.frombuffer(qual, "<f4")[0])
    return (
        names.contigs[contig][0], pos + 1, ident, alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", quality, ";".join(filters) or ".", ";".join(info) or ".",
        ":".join(keys) if keys else None, [":".join(x) for x in zip(*columns, strict=True)] if keys else None,
    )


def _kind(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _integers([n])


def _integer_kind(values: Sequence[int | None]) -> int:
    seen = [v for v in values if v is not None]
    low, high = min(seen, default=0), max(seen, default=0)
    for kind in (INT8, INT16, INT32):
        if MISSING[kind] + RESERVED <= low and high < -MISSING[kind]:
            return kind
    raise ValueError(f"integers beyond 32 bits: {low}, {high}")


def _integers(values: Sequence[int | None]) -> bytes:
    kind = _integer_kind(values)
    return _kind(kind, len(values)) + np.array([MISSING[kind] if v is None else v for v in values], KINDS[kind]).tobytes()


def _floats(values: Sequence[float | None], width: int = 0) -> bytes:
    out = np.full(max(width, len(values)), FLOAT_END, "<u4")
    for i, v in enumerate(values):
        out[i] = FLOAT_MISSING if v is None else np.float32(v).view(np.uint32)
    return out.tobytes()


def _text(value: str) -> bytes:
    data = value.encode()
    return _kind(CHAR, len(data)) + data


def _listed(value: str, kind: str) -> list:
    return [None if x == "." else (int if kind == "Integer" else float)(x) for x in value.split(",")]


def _matrix(rows: list[list[int | None]]) -> bytes:
    """One vector a sample, all as long as the longest."""
    wide = max(map(len, rows))
    kind = _integer_kind([v for r in rows for v in r])
    out = np.full((len(rows), wide), MISSING[kind] + 1, KINDS[kind])
    for i, r in enumerate(rows):
        out[i, : len(r)] = [MISSING[kind] if v is None else v for v in r]
    return _kind(kind, wide) + out.tobytes()


def _genotypes(values: list[str]) -> bytes:
    rows = []
    for value in values:
        tokens = re.findall(r"([/|]?)(\.|\d+)", value)
        rows.append([(0 if a == "." else int(a) + 1) << 1 | (sep == "|") for sep, a in tokens] or [0])
    return _matrix(rows)


def encoded(row: Sequence[Any], names: Dictionary) -> tuple[bytes, int, int, int]:
    """(record, contig, start, end): a VCF line's fields as a record of BCF, and its place, 0-based and half-open.

    Contigs, filters and fields that the header does not declare raise, as they have no number.
    """
    chrom, pos, ident, ref, alt, qual, filters, info, form, samples = row
    number = lambda name: names.number[name]
    try:
        alleles = [ref, *(alt.split(",") if alt not in (".", None) else [])]
        ending = re.search(r"(?:^|;)END=(\d+)", info or "")
        length = int(ending[1]) - pos + 1 if ending and int(ending[1]) >= pos else len(ref)
        fields = [x for x in (info or ".").split(";") if x not in (".", "")]
        body = _text("" if ident in (".", None) else ident) + b"".join(map(_text, alleles))
        body += _integers([number(x) for x in filters.split(";")]) if filters not in (".", None) else b"\0"
        for x in fields:
            key, given, value = x.partition("=")
            kind = names.kinds["INFO", key]
            body += _integers([number(key)])
            if kind == "Flag" or not given:
                body += b"\0"
            elif kind in ("Integer", "Float"):
                listed = _listed(value, kind)
                body += _integers(listed) if kind == "Integer" else _kind(FLOAT, len(listed)) + _floats(listed)
            else:
                body += _text(value)
        keys = form.split(":") if form not in (".", None) and names.samples else []
        table = [((s or ".").split(":") + ["."] * len(keys))[: len(keys)] for s in samples or []]
        own = b""
        for i, key in enumerate(keys):
            column = [r[i] for r in table]
            kind = names.kinds["FORMAT", key]
            own += _integers([number(key)])
            if key == "GT":
                own += _genotypes(column)
            elif kind == "Integer":
                own += _matrix([_listed(v, kind) for v in column])
            elif kind == "Float":
                listed = [_listed(v, kind) for v in column]
                wide = max(map(len, listed))
                own += _kind(FLOAT, wide) + b"".join(_floats(v, wide) for v in listed)
            else:
                wide = max(len(v.encode()) for v in column)
                own += _kind(CHAR, wide) + b"".join(v.encode().ljust(wide, b"\0") for v in column)
        contig = names.contig_number[chrom]
    except KeyError as e:
        name = e.args[0] if isinstance(e.args[0], str) else e.args[0][-1]
        raise ValueError(f"the header does not declare {name!r} ({chrom}:{pos})") from e
    quality = struct.pack("<I", FLOAT_MISSING) if qual in (".", None) else struct.pack("<f", float(qual))
    shared = struct.pack("<iii", contig, pos - 1, length) + quality + struct.pack("<II", len(alleles) << 16 | len(fields), len(keys) << 24 | (len(table) if keys else len(names.samples))) + body
    return struct.pack("<II", len(shared), len(own)) + shared + own, contig, pos - 1, pos - 1 + length


def batches(raw: Any, size: int, path: str, chunks: list[genome_index.Chunk] | None, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Records in Arrow batches: of the whole file, or those that lie in chunks of it; packed as BGZF or not packed at all."""
    from mitoloom.sources.variants import ARROW

    raw.seek(0)
    packed = bgzf.is_bgzf(raw.read(64))
    blocks = lambda at: bgzf.Blocks(raw, size, at, bgzf.MOST) if packed else _whole(raw)
    have, names, start = b"", None, 0
    for _, data in blocks(0):
        have += data
        if (text := header_text(have)) is not None:
            names, start = Dictionary(text.rstrip("\n").split("\n")), 9 + struct.unpack_from("<I", have, 5)[0]
            break
    if names is None:
        raise ValueError(f"BCF header cut short in {path}")
    rows: list[tuple] = []
    for place, record in _stretches(blocks, start, chunks):
        l_shared, l_own = struct.unpack_from("<II", record)
        rows.append((path, place, *decoded(record[8 : 8 + l_shared], record[8 + l_shared : 8 + l_shared + l_own], names)))
        if len(rows) == most:
            yield _batch(rows, ARROW)
            rows = []
    if rows:
        yield _batch(rows, ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _whole(raw: Any) -> Iterator[tuple[int, bytes]]:
    raw.seek(0)
    at = 0
    while data := raw.read(1 << 16):
        yield at, data
        at += len(data)


def _stretches(blocks: Any, start: int, chunks: list[genome_index.Chunk] | None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records behind a header of ``start`` bytes, or of those in chunks."""
    for low, high in chunks if chunks is not None else [(None, None)]:
        have, skip, begins = b"", start if low is None else low & 0xFFFF, []
        for place, data in blocks(0 if low is None else low >> 16):
            begins.append((len(have), place))
            have += data
            at = 0
            if skip:
                if len(have) < skip:
                    continue
                at, skip = skip, 0
            done = False
            while at + 8 <= len(have) and at + 8 + (own := sum(struct.unpack_from("<II", have, at))) <= len(have):
                k = max(i for i, (s, _) in enumerate(begins) if s <= at)
                offset = begins[k][1] << 16 | at - begins[k][0]
                if high is not None and offset >= high:
                    done = True
                    break
                yield offset, have[at : at + 8 + own]
                at += 8 + own
            if done or (high is not None and place > high >> 16 and at == len(have)):
                have = b""
                break
            k = max(i for i, (s, _) in enumerate(begins) if s <= at)
            begins = [(s - at, p) for s, p in begins[k:]]
            have = have[at:]
        if have and high is None:
            raise ValueError("BCF record cut short")
