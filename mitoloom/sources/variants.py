"""VCF and BCF as Spark data sources: split anywhere, also when packed; regions and filters read only their blocks where there is an index."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from mitoloom.sources import bcf, bgzf, genome_index
from mitoloom.sources.headers import VcfHeader

COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
SCHEMA = "file string, place long, chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>"
ARROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("chrom", pa.string()), ("pos", pa.int32()), *((c, pa.string()) for c in COLUMNS[2:]), ("samples", pa.list_(pa.string()))])
#: Bytes of a file, as it lies there, that a task reads where nothing else is asked for.
SPLIT_BYTES = 64 << 20
#: Bounds that no position reaches.
WHOLE = (-(1 << 31), (1 << 31) - 1)
Region = tuple[str, int, int]


def store_of(uri: str) -> tuple[Any, str]:
    """(file system, path) in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def files_of(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files with one of the endings."""
    from pyarrow import fs

    store, root = store_of(uri)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(endings))


def parsed_regions(text: str) -> list[Region]:
    """``contig``, ``contig:start`` or ``contig:start-end`` (1-based, closed), several with commas between them."""
    out = []
    for token in filter(None, (x.strip() for x in text.split(","))):
        contig, _, span = token.rpartition(":") if ":" in token else (token, "", "")
        first, dash, last = span.partition("-")
        start = max(int(first), 1) if first else 1
        end = int(last) if last else WHOLE[1]
        if not contig or start > end:
            raise ValueError(f"bad region: {token}")
        out.append((contig, start, end))
    return out


def joined_regions(regions: list[Region]) -> list[Region]:
    """Regions in order, those that meet or touch joined, so that nothing is in two."""
    out: list[Region] = []
    for contig, start, end in sorted(regions):
        if out and out[-1][0] == contig and start <= out[-1][2] + 1:
            out[-1] = (contig, out[-1][1], max(out[-1][2], end))
        else:
            out.append((contig, start, end))
    return out


class Bounds:
    """What filters on a contig's column and a position's column ask for: contigs (None: any) and the closed bounds of positions."""

    def __init__(self, contig: str, pos: str, shift: int = 0):
        self.contig, self.pos, self.shift = contig, pos, shift
        self.contigs: set[str] | None = None
        self.low, self.high = WHOLE
        self.present: set[str] = set()

    def take(self, f: Filter) -> bool:
        """Whether the filter is one of these; then it is kept exactly and Spark need not look again."""
        column = getattr(f, "attribute", None)
        if isinstance(f, IsNotNull) and column in ((self.contig,), (self.pos,)):
            self.present.add(column[0])
            return True
        if column == (self.contig,) and isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if all(isinstance(x, str) for x in asked):
                self.contigs = asked if self.contigs is None else self.contigs & asked
                return True
        if column == (self.pos,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
            at = f.value + self.shift
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, at + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high = min(self.high, at - isinstance(f, LessThan))
            return True
        return False

    @property
    def set(self) -> bool:
        return self.contigs is not None or bool(self.present) or (self.low, self.high) != WHOLE

    def regions(self) -> list[Region] | None:
        """The regions that can hold what is asked for; None where no contig is named."""
        if self.contigs is None:
            return None
        return [(c, max(1, self.low), self.high) for c in sorted(self.contigs)] if self.low <= self.high else []

    def hold(self, chrom: pa.Array, pos: pa.Array) -> pa.Array:
        """Which rows to keep; null ones are not."""
        ok = pa.array(np.ones(len(pos), dtype=bool))
        if self.contig in self.present:
            ok = pc.and_(ok, pc.is_valid(chrom))
        if self.pos in self.present or (self.low, self.high) != WHOLE:
            at = pos.cast(pa.int64())
            ok = pc.and_(ok, pc.and_(pc.greater_equal(at, self.low), pc.less_equal(at, self.high)))
        return ok if self.contigs is None else pc.and_(ok, pc.is_in(chrom, pa.array(sorted(self.contigs), pa.string())))


def cut_chunks(chunks: list[genome_index.Chunk], split: int) -> list[list[genome_index.Chunk]]:
    """Chunks dealt to tasks, each with about ``split`` bytes of the file or one chunk."""
    out: list[list[genome_index.Chunk]] = []
    size = split
    for a, b in chunks:
        own = (b >> 16) - (a >> 16) + 1
        if size + own > split:
            out.append([])
            size = 0
        out[-1].append((a, b))
        size += own
    return out


class Part(InputPartition):
    def __init__(self, path: str, size: int, kind: str, split: tuple[int, int] | None = None, chunks: list[genome_index.Chunk] | None = None):
        self.path, self.size, self.kind, self.split, self.chunks = path, size, kind, split, chunks


def header_of(store: Any, path: str, size: int) -> tuple[str, list[str]]:
    """(kind of file, header lines), read no further than they go. Kinds: text, gzip, bgzf, bcf."""
    import zlib

    with store.open_input_file(path) as raw:
        head = raw.read(1 << 16)
        if bgzf.is_bgzf(head):
            kind, pieces = "bgzf", (data for _, data in bgzf.Blocks(raw, size, ahead=bgzf.MOST))
        elif head[:2] == b"\x1f\x8b":
            packer = zlib.decompressobj(31)
            kind, pieces = "gzip", (packer.decompress(x) for x in _reads(raw, head))
        else:
            kind, pieces = "text", _reads(raw, head)
        have = b""
        for piece in pieces:
            have += piece
            if have[:4] == bcf.MAGIC[:4]:
                if (text := bcf.header_text(have)) is not None:
                    return "bcf", text.rstrip("\n").split("\n")
            elif (cut := _head_end(have)) is not None:
                return kind, have[:cut].decode().rstrip("\n").split("\n") if cut else []
        if have[:4] == bcf.MAGIC[:4]:
            raise ValueError(f"BCF header cut short in {path}")
        return kind, have.decode().rstrip("\n").split("\n") if have else []


def _reads(raw: Any, head: bytes) -> Iterator[bytes]:
    while head:
        yield head
        head = raw.read(1 << 16)


def _head_end(have: bytes) -> int | None:
    """Where the first line that is no comment begins; None if that is not seen yet."""
    at = 0
    while have[at : at + 1] == b"#":
        at = have.find(b"\n", at) + 1
        if not at:
            return None
    return at if at < len(have) else None


def index_beside(store: Any, path: str) -> genome_index.Index | None:
    for f in store.get_file_info([path + ".tbi", path + ".csi"]):
        if f.is_file:
            with store.open_input_file(f.path) as raw:
                data = raw.read()
            return genome_index.parse(b"".join(d for _, d in bgzf.Blocks(pa.BufferReader(data), len(data))) if bgzf.is_bgzf(data) else data)
    return None


class VariantReader(DataSourceReader):
    """Options: ``region`` (see parsed_regions) keeps the records that meet one of the regions with any base of their REF;
    ``splitBytes`` is how much of a file a task reads."""

    ENDINGS: tuple[str, ...] = (".vcf", ".vcf.gz", ".vcf.bgz", ".bcf")

    def __init__(self, options: Any):
        self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.asked = joined_regions(parsed_regions(options["region"])) if options.get("region") else None
        self.bounds = Bounds("chrom", "pos")

    def _wanted(self) -> list[Region] | None:
        """The regions to look up, those of the option where there are some: filters then only drop what has been read."""
        return self.asked if self.asked is not None else self.bounds.regions()

    def partitions(self) -> list[Part]:
        store, _ = store_of(self.uri)
        return [part for path, size in files_of(self.uri, self.ENDINGS) for part in self._parts(store, path, size)]

    def _parts(self, store: Any, path: str, size: int) -> list[Part]:
        wanted = self._wanted()
        kind, lines = header_of(store, path, size)
        if wanted is not None and kind in ("bgzf", "bcf") and (index := index_beside(store, path)):
            names = index.names or [c for c, _ in bcf.Dictionary(lines).contigs]
            number = {n: i for i, n in enumerate(names)}
            chunks = genome_index.merged(c for name, start, end in wanted if name in number for c in index.chunks(number[name], start - 1, end))
            return [Part(path, size, kind, chunks=some) for some in cut_chunks(chunks, self.split)]
        if kind in ("gzip", "bcf"):  # without an index, nothing tells where a record begins
            return [Part(path, size, kind, (0, size))]
        return [Part(path, size, kind, (a, min(a + self.split, size))) for a in range(0, size, self.split)]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read
            return
        store, _ = store_of(self.uri)
        with store.open_input_file(part.path) as raw:
            for batch in self.batches(raw, part):
                batch = self._kept(batch)
                if batch.num_rows:
                    yield batch

    def batches(self, raw: Any, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "bcf":
            yield from bcf.batches(raw, part.size, part.path, part.chunks)
            return
        if part.chunks is not None:
            pieces = (x for a, b in part.chunks for x in bgzf.lines_of_range(raw, part.size, a, b))
        elif part.kind == "bgzf":
            pieces = bgzf.lines_of_split(raw, part.size, *part.split)
        else:
            pieces = _plain_lines(raw, part.size, *part.split) if part.kind == "text" else _gzip_lines(raw)
        for data, starts, offsets in pieces:
            yield table_of(data, np.array(starts, np.int64), np.array(offsets, np.int64), part.path)

    def _kept(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.bounds.set:
            batch = batch.filter(self.bounds.hold(batch["chrom"], batch["pos"]))
        if self.asked is not None:
            pos = batch["pos"].cast(pa.int64())
            end = pc.add(pos, pc.subtract(pc.max_element_wise(pc.utf8_length(batch["ref"]), 1).cast(pa.int64()), 1))
            ok = pa.array(np.zeros(batch.num_rows, dtype=bool))
            for contig, low, high in self.asked:
                ok = pc.or_(ok, pc.and_(pc.equal(batch["chrom"], contig), pc.and_(pc.less_equal(pos, high), pc.greater_equal(end, low))))
            batch = batch.filter(ok)
        return batch


def table_of(data: bytes, starts: np.ndarray, offsets: np.ndarray, path: str) -> pa.RecordBatch:
    """The body lines among whole lines, field by field; ``place`` is the virtual offset (or place in a plain file) of each line."""
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 0x0A)
    begins = np.concatenate([[0], feeds + 1])
    ends = np.append(feeds, len(raw))
    ends = ends - ((ends > begins) & (raw[np.maximum(ends - 1, 0)] == 0x0D)) if len(raw) else ends
    body = ends > begins
    body[body] &= raw[begins[body]] != 0x23
    begins, ends = begins[body], ends[body]
    at = np.searchsorted(starts, begins, side="right") - 1
    places = offsets[at] + begins - starts[at]
    text = pa.array([data[a:b] for a, b in zip(begins, ends, strict=True)], pa.binary()).cast(pa.string())
    fields = pc.split_pattern(text, "\t", max_splits=9)
    counts = np.diff(fields.offsets.to_numpy())
    first, flat = fields.offsets.to_numpy()[:-1].astype(np.int64), fields.flatten()
    column = lambda i: flat.take(pa.array(np.where(counts > i, first + i, 0), mask=counts <= i))
    pos = column(1)
    whole = pc.match_substring_regex(pos, r"^[0-9]{1,9}$")
    pos = pc.if_else(whole, pos, None).cast(pa.int32())
    samples = pc.split_pattern(column(9), "\t")
    return pa.RecordBatch.from_arrays([pa.array([path] * len(text), pa.string()), pa.array(places, pa.int64()), column(0), pos, *(column(i) for i in range(2, 9)), samples.cast(pa.list_(pa.string()))], schema=ARROW)


def _plain_lines(raw: Any, size: int, low: int, high: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """The lines of a split of a plain file: from behind the first line feed at or after ``low`` to that at or after ``high``."""
    raw.seek(low)
    at, skipping, pending, ending = low, low > 0, b"", False
    while data := raw.read(1 << 20):
        begin, at = at, at + len(data)
        if skipping:
            feed = data.find(b"\n") + 1
            if not feed:
                if at > high:
                    return
                continue
            if begin + feed - 1 >= high:
                return
            skipping, data, begin = False, data[feed:], begin + feed
        if at > high or ending:
            feed = data.find(b"\n", max(0, high - begin)) + 1
            if feed:
                yield pending + data[:feed], [0], [begin - len(pending)]
                return
            ending = True
        pending, begin = pending + data, begin - len(pending)
        if not ending and (cut := pending.rfind(b"\n") + 1):
            yield pending[:cut], [0], [begin]
            pending = pending[cut:]
    if pending:
        yield pending, [0], [at - len(pending)]


def _gzip_lines(raw: Any) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """All lines of a gzip file, also one of several members; places count unpacked bytes."""
    import gzip

    raw.seek(0)
    at, pending = 0, b""
    with gzip.GzipFile(fileobj=raw) as text:
        while data := text.read(1 << 20):
            pending += data
            if cut := pending.rfind(b"\n") + 1:
                yield pending[:cut], [0], [at]
                at, pending = at + cut, pending[cut:]
    if pending:
        yield pending, [0], [at]


class FilteredVariantReader(VariantReader):
    """Filters on chrom and pos become regions."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f


class VariantSource(DataSource):
    """``spark.read.format("variants").load(path)``: a row for each record of VCF (plain, gzip, BGZF) and BCF files. Filters are
    pushed into it with the option ``pushFilters`` and Spark's ``spark.sql.python.filterPushdown.enabled``; records() sets both."""

    @classmethod
    def name(cls) -> str:
        return "variants"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> VariantReader:
        return (FilteredVariantReader if self.options.get("pushFilters") == "true" else VariantReader)(self.options)


def header(path: str) -> VcfHeader:
    """The header of a file, or of the first file of a folder."""
    store, _ = store_of(path)
    file, size = files_of(path, VariantReader.ENDINGS)[0]
    return VcfHeader(header_of(store, file, size)[1])


def records(spark: SparkSession, path: str, region: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the files at ``path`` (those that meet a region), in the columns of SCHEMA."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VariantSource)
    reader = spark.read.format("variants").option("pushFilters", "true").option("splitBytes", str(split_bytes))
    return (reader.option("region", region) if region else reader).load(path)


def calls(spark: SparkSession, path: str, region: str | None = None, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, headers) in the form of text.vcf, for files of any kind, of which a region's blocks alone are read where there is an index."""
    store, _ = store_of(path)
    heads = [(file, header_of(store, file, size)[1]) for file, size in files_of(path, VariantReader.ENDINGS)]
    names = spark.createDataFrame([(f, next((x.split("\t")[9:] for x in lines if x.startswith("#CHROM")), [])) for f, lines in heads], "file string, names array<string>")
    wide = records(spark, path, region, split_bytes).join(F.broadcast(names), "file")  # a row a file
    long = wide.withColumn("s", F.explode_outer(F.arrays_zip(F.col("names").alias("sample"), F.col("samples").alias("value"))))
    keys, values = F.split("format", ":"), F.split("s.value", ":")
    n = F.least(F.size(keys), F.size(values))
    fields = F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))
    alts = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    rows = long.select(F.struct("file", "place").alias("record"), "chrom", "pos", "id", "ref", alts.alias("alts"), F.col("qual").try_cast("double").alias("qual"), "filter", "info", F.col("s.sample").alias("sample"), F.when(F.col("s.value").isNotNull() & F.col("format").isNotNull(), fields).alias("fields"))
    return rows, spark.createDataFrame([(f, i, x) for f, lines in heads for i, x in enumerate(lines) if x.startswith("##")], "file string, line int, value string")
