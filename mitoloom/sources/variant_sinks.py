"""VCF and BCF written as BGZF in order of place, each part with its index; or one file, whose index is put together from theirs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.operators.ordered import in_ranges
from mitoloom.sources import bcf, bgzf, genome_index
from mitoloom.sources.headers import VcfHeader
from mitoloom.sources.variants import COLUMNS, store_of

#: What a part is and what its index says: chunks as (contig, bin, low, high), windows as (contig, window, offset), flat.
MANIFEST = "range int, path string, body long, size long, rows long, chunks array<long>, windows array<long>"


def _shape(header: VcfHeader) -> tuple[int, str]:
    """(levels of bins, kind of index) for the header's longest contig."""
    longest, depth = max((n or 0 for _, n in header.contigs), default=0), genome_index.DEPTH
    while longest > 1 << genome_index.SHIFT + 3 * depth:
        depth += 1
    return depth, "tbi" if depth == genome_index.DEPTH else "csi"


def _line(row: Sequence) -> bytes:
    fixed = ["." if v is None else str(v) for v in row[:8]]
    if row[8] is not None:
        fixed += [row[8], *(("." if s is None else s) for s in row[9] or [])]
    return ("\t".join(fixed) + "\n").encode()


def _head(header: VcfHeader, binary: bool) -> bytes:
    return bcf.header_bytes(header.lines) if binary else ("\n".join(header.lines) + "\n").encode()


def _save(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def write_variants(rows: DataFrame, header: VcfHeader, folder: str, *, binary: bool = False, single: str | None = None) -> DataFrame:
    """Writes rows (the columns of variants.SCHEMA; file and place are not needed) in the order of the header's contigs, then of place.

    Each range of places is a file of ``folder``, with the header and an index beside it (TBI; CSI for BCF and for contigs that
    TBI cannot hold), so that the folder can be read by region. Returned is a row a file: path, rows, size. With ``single``, one
    file of that path instead: one task appends the parts as they are, block for block, and shifts their indexes to where they
    now lie. Parts are written under names of their own and moved when all are there, so that a task that is run again leaves
    nothing to be read. Rows on contigs that the header does not have raise; no rows give a file of the header alone.
    """
    spark = rows.sparkSession
    ending = ".bcf" if binary else ".vcf.gz"
    contigs = [c for c, _ in header.contigs]
    depth, kind = _shape(header)
    kind = "csi" if binary else kind
    store, root = store_of(folder)
    work = f"{root}/_parts-{uuid.uuid4().hex}"
    store.create_dir(work, recursive=True)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("chrom")), F.lit(0)) if contigs else F.lit(0)
    known = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("contig not in the header: "), F.col("chrom"))).cast("long"))
    ranged = in_ranges(rows.select(known.alias("__contig"), *COLUMNS, "samples"), [F.col("__contig"), F.col("pos"), F.col("id"), F.col("ref"), F.col("alt")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        names = bcf.Dictionary(header.lines) if binary else None
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("__contig", *COLUMNS, "samples", "__range")), strict=True):
                if out is None:
                    number, path = row[-1], f"{work}/{uuid.uuid4().hex}{ending}"
                    stream = store.open_output_stream(path, compression=None)
                    out, built, count = bgzf.Writer(stream), genome_index.Builder(depth=depth), 0
                    out.write(_head(header, binary))
                    out.flush()
                    body = out.at
                if binary:
                    data, contig, start, end = bcf.encoded(row[1:-1], names)
                else:
                    data, contig, start, end = _line(row[1:-1]), row[0] - 1, row[2] - 1, row[2] - 1 + max(1, len(row[4]))
                low = out.tell()
                out.write(data)
                built.add(contig, start, end, low, out.tell())
                count += 1
        if out is not None:
            out.end()
            stream.close()
            chunks, windows = built.tables()
            _save(store, f"{path}.{kind}", _index([(0, (chunks, windows))], contigs, depth, kind, binary))
            flat = lambda rows: pa.array([[x for r in rows for x in r]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (body, out.at, count)), flat(chunks), flat(windows)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    from mitoloom.operators.ordered import durable

    manifest = durable(ranged.mapInArrow(write, MANIFEST))
    parts = manifest.select("range", "path", "rows", "size").orderBy("range").collect()  # names alone
    if single is not None:
        target = store_of(single)[1]

        def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = store_of(folder)
            stretches = []
            with store.open_output_stream(target, compression=None) as stream:
                out = bgzf.Writer(stream)
                out.write(_head(header, binary))
                out.flush()
                at = out.at
                for batch in batches:
                    for part in batch.to_pylist():
                        stretches.append((at - part["body"], (_rows(part["chunks"], 4), _rows(part["windows"], 3))))
                        with store.open_input_file(part["path"]) as raw:
                            raw.seek(part["body"])
                            left = part["size"] - part["body"]
                            while left:
                                stream.write(data := raw.read(min(left, 1 << 20)))
                                left -= len(data)
                        at += part["size"] - part["body"]
                stream.write(bgzf.END)
            _save(store, f"{target}.{kind}", _index(stretches, contigs, depth, kind, binary))
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([at], pa.int64())], names=["path", "size"])

        placed = manifest.repartitionByRange(1, "range").sortWithinPartitions("range").mapInArrow(append, "path string, size long").collect()
        if not placed:
            _alone(store, target, header, binary, contigs, depth, kind)
        out = [(target, sum(p.rows for p in parts), placed[0].size if placed else 0)]
    else:
        out = []
        for i, part in enumerate(parts):
            target = f"{root}/part-{i:05d}{ending}"
            store.move(part.path + f".{kind}", target + f".{kind}")
            store.move(part.path, target)
            out.append((target, part.rows, part.size))
        if not parts:
            _alone(store, f"{root}/part-00000{ending}", header, binary, contigs, depth, kind)
    store.delete_dir(work)
    return spark.createDataFrame(out, "path string, rows long, size long")


def _rows(flat: list[int], width: int) -> list[tuple[int, ...]]:
    return list(zip(*(flat[i::width] for i in range(width)), strict=True))


def _index(stretches: list, contigs: list[str], depth: int, kind: str, binary: bool) -> bytes:
    return bgzf.compress(genome_index.serialised(genome_index.put_together(stretches, len(contigs), () if binary else contigs, depth=depth), kind))


def _alone(store, path: str, header: VcfHeader, binary: bool, contigs: list[str], depth: int, kind: str) -> None:
    """A file without records."""
    _save(store, path, bgzf.compress(_head(header, binary)))
    _save(store, f"{path}.{kind}", _index([], contigs, depth, kind, binary))
