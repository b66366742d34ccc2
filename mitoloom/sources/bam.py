"""BAM as a Python data source: split anywhere, by an index read by region; records are decoded with the standard library. No CRAM."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from mitoloom.sources import bgzf, genome_index
from mitoloom.sources.bgzf import compress
from mitoloom.sources.variants import SPLIT_BYTES, Bounds, Region, cut_chunks, files_of, joined_regions, parsed_regions, store_of

__all__ = ["SCHEMA", "BamDataSource", "BamReader", "compress", "index_of", "reads"]

SCHEMA = "sample string, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


class Stream:
    """The bytes of a BAM file from a block on."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]], skip: int = 0):
        self.blocks, self.have, self.begins = blocks, bytearray(), []
        self.at = 0  # bytes taken so far
        if skip:
            self.take(skip)

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            place, block = next(self.blocks, (0, None))
            if block is None:
                break
            self.begins.append((self.at + len(self.have), place))
            self.have += block
        out = bytes(self.have[:n])
        del self.have[:n]
        self.at += len(out)
        return out

    def tell(self) -> int:
        """The virtual offset of what is taken next; past the end, that of the end of the last block."""
        if not self.have:
            place, block = next(self.blocks, (0, None))
            while block == b"":
                place, block = next(self.blocks, (0, None))
            if block is not None:
                self.begins.append((self.at, place))
                self.have += block
        while len(self.begins) > 1 and self.begins[1][0] <= self.at:
            self.begins.pop(0)
        return self.begins[0][1] << 16 | self.at - self.begins[0][0] if self.begins else 0


def header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """(header text, contigs with lengths)."""
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file; CRAM is not supported")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return text, contigs


def sample_name(text: str) -> str:
    """SM of the first @RG line; without one it raises, as calls must have a sample (see text.sample_of_path for names of files)."""
    for line in text.split("\n"):
        if line.startswith("@RG"):
            for field in line.split("\t"):
                if field.startswith("SM:"):
                    return field[3:]
    raise ValueError("no @RG line with a sample (SM) in the header")


def tags_of(data: bytes, at: int) -> dict[str, str]:
    """The tags of a record from ``at``, as text: numbers plainly, arrays with commas."""
    kinds, out = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}, {}
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = kinds[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            out[name] = ",".join(map(str, struct.unpack_from(f"<{n}{of}", data, at + 5)))
            at += 5 + n * struct.calcsize(of)
        else:
            out[name] = str(struct.unpack_from(f"<{kinds[kind]}", data, at)[0])
            at += struct.calcsize(kinds[kind])
    return out


def span(cigar: list[int]) -> int:
    """Reference bases that packed CIGAR operations cover; 1 where they cover none."""
    return sum(c >> 4 for c in cigar if OPS[c & 15] in "MDN=X") or 1


#: Fixed-size head of a record behind its size.
HEAD = struct.Struct("<iiBBHHHiiii")


def plausible(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int:
    """Where the record at ``at`` ends if one may begin there, else 0: every number within its bounds, lengths that fit together."""
    if at + 36 > len(data):
        return 0
    (size,) = struct.unpack_from("<i", data, at)
    ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = HEAD.unpack_from(data, at + 4)
    if not (32 <= size < 1 << 28 and l_name >= 1 and 0 <= l_seq and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
        return 0
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not -1 <= r < len(contigs) or p < -1 or (r >= 0 and p >= max(1, contigs[r][1])):
            return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return 0
    return at + 4 + size


#: Records that must follow one another for a place to count as the start of one, and bytes that are looked through for it.
CHAIN, LOOK = 6, 4 << 20


def first_record(raw: Any, size: int, low: int, high: int, contigs: list[tuple[str, int]]) -> int | None:
    """The virtual offset of the first record that starts in a block between ``low`` and ``high`` of a file; None without any.

    Nothing in a BAM file marks a record's start; one is taken for it if CHAIN records follow one another from there, or as many as
    there are up to the end.
    """
    at = bgzf.first_block(raw, size, low)
    if at >= high:
        return None
    data, begins, ended, searched = b"", [], False, 0
    for place, block in bgzf.Blocks(raw, size, at):
        begins.append((len(data), place))
        data += block
        if len(data) - searched < 1 << 17:
            continue
        if (found := _chain(data, searched, contigs, False)) is not None:
            break
        searched = max(searched, len(data) - (1 << 17))
        if len(data) > LOOK:
            raise ValueError(f"no record found within {LOOK} bytes of {low}")
    else:
        ended, found = True, _chain(data, 0, contigs, True)
    if found is None:
        return None
    start, place = [b for b in begins if b[0] <= found][-1]
    return (place << 16 | found - start) if place < high else None


def _chain(data: bytes, at: int, contigs: list[tuple[str, int]], ended: bool) -> int | None:
    for start in range(at, len(data) - 35):
        end, links = start, 0
        while links < CHAIN and (after := plausible(data, end, contigs)):
            end, links = after, links + 1
            if end + 36 > len(data):
                break
        if links == CHAIN or (links and ended and end == len(data)) or (links > 1 and not ended and end + 36 > len(data)):
            return start
    return None


def records(stream: Stream, contigs: list[tuple[str, int]], wanted: list[tuple[int, int, int]] | None = None, stop: int | None = None, keep: Any = None) -> Iterator[tuple]:
    """Decoded records that start before the virtual offset ``stop``; of those, the ones that meet one of the wanted regions (contig
    number, start, end; 0-based, half-open) and that ``keep`` (of contig number and pos) lets through. Others are not decoded.
    """
    name = lambda i: contigs[i][0] if 0 <= i < len(contigs) else "*"
    while (stop is None or stream.tell() < stop) and (size := stream.take(4)):
        data = stream.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = HEAD.unpack_from(data)
        at = 32 + l_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, at)
        if wanted is not None and not any(ref == c and pos < end and pos + span(ops) > start for c, start, end in wanted):
            continue
        if keep is not None and not keep(ref, pos):
            continue
        qname = data[32 : at - 1].decode()
        cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in ops) or "*"
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] or "*"
        at += (l_seq + 1) // 2
        qual = data[at : at + l_seq]
        yield qname, flag, name(ref), pos, mapq, cigar, name(next_ref), next_pos, tlen, seq, "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual), tags_of(data, at + l_seq)


def index_of(raw: Any) -> bytes:
    """A .bai index of a BAM stream that is sorted by place, in one pass over it."""
    raw.seek(0, 2)
    stream = Stream(bgzf.Blocks(raw, raw.tell()))
    _, contigs = header(stream)
    built = genome_index.Builder()
    low = stream.tell()
    while size := stream.take(4):
        data = stream.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, _, _, n_cigar, *_ = HEAD.unpack_from(data)
        high = stream.tell()
        if ref >= 0:
            built.add(ref, pos, pos + span(struct.unpack_from(f"<{n_cigar}I", data, 32 + l_name)), low, high)
        low = high
    return genome_index.serialised(genome_index.put_together([(0, built.tables())], len(contigs)), "bai")


class Part(InputPartition):
    """Either chunks of virtual offsets, or the blocks between two places of the file; and what to keep of their records."""

    def __init__(self, path: str, size: int, split: tuple[int, int] | None = None, chunks: list[genome_index.Chunk] | None = None, wanted: list[tuple[int, int, int]] | None = None, starting: tuple[int, int, int] | None = None):
        self.path, self.size, self.split, self.chunks, self.wanted, self.starting = path, size, split, chunks, wanted, starting


class BamReader(DataSourceReader):
    """Options: ``region`` (see variants.parsed_regions, several with commas) keeps the records that meet one of the regions;
    ``splitBytes`` is how much of a file a task reads; ``split`` makes a task of so many positions of an indexed file instead.

    With an index beside the file (.bam.bai, .bai or .bam.csi), regions, and filters on rname and pos, read their blocks alone.
    """

    def __init__(self, options):
        self.uri, self.positions = options["path"], int(options.get("split", 0))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.asked = joined_regions(parsed_regions(options["region"])) if options.get("region") else None
        self.bounds = Bounds("rname", "pos", 1)

    def partitions(self) -> list[Part]:
        store, _ = store_of(self.uri)
        return [part for path, size in files_of(self.uri, (".bam",)) for part in self._parts(store, path, size)]

    def _regions(self, contigs: list[tuple[str, int]], asked: list[Region]) -> list[tuple[int, int, int]]:
        number = {c: i for i, (c, _) in enumerate(contigs)}
        return [(number[c], start - 1, end) for c, start, end in asked if c in number]

    def _parts(self, store, path: str, size: int) -> list[Part]:
        with store.open_input_file(path) as raw:
            text, contigs = header(Stream(bgzf.Blocks(raw, size, ahead=bgzf.MOST)))
        index = None
        beside = [f for f in store.get_file_info([path + ".bai", path[:-4] + ".bai", path + ".csi"]) if f.is_file]
        if beside and "SO:unsorted" not in text:
            with store.open_input_file(beside[0].path) as raw:
                data = raw.read()
                index = genome_index.parse(data if not bgzf.is_bgzf(data) else b"".join(d for _, d in bgzf.Blocks(raw, len(data))))
        wanted = None
        if self.asked is not None:
            if absent := {c for c, *_ in self.asked} - {c for c, _ in contigs}:
                raise ValueError(f"no contig {', '.join(sorted(absent))} in {path}")
            wanted = self._regions(contigs, self.asked)
        looked_up = wanted if wanted is not None else self._regions(contigs, asked) if (asked := self.bounds.regions()) is not None and "*" not in (self.bounds.contigs or ()) else None
        if index is not None and looked_up is not None:
            chunks = genome_index.merged(c for k, start, end in looked_up for c in index.chunks(k, max(0, start), end))
            return [Part(path, size, chunks=some, wanted=wanted) for some in cut_chunks(chunks, self.split)]
        if index is not None and self.positions and wanted is None:
            parts = []
            for k, (_, length) in enumerate(contigs):
                ends = [*range(self.positions, length, self.positions), 1 << 31]  # the last also has what lies beyond the contig's end
                for a, b in zip([-1, *ends[:-1]], ends, strict=True):
                    if chunks := index.chunks(k, max(a, 0), b):
                        parts.append(Part(path, size, chunks=chunks, starting=(k, a, b)))
            tail = index.last()  # the records without a place
            return [*parts, Part(path, size, chunks=[(tail, size << 16)] if tail else None, split=None if tail else (0, size), starting=(-1, -1 << 31, 1 << 31))]
        return [Part(path, size, (a, min(a + self.split, size)), wanted=wanted) for a in range(0, size, self.split)]

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # nothing to read
            return
        store, _ = store_of(self.uri)
        with store.open_input_file(part.path) as raw:
            yield from self.rows(raw, part)

    def rows(self, raw: Any, part: Part) -> Iterator[tuple]:
        head = Stream(bgzf.Blocks(raw, part.size, ahead=bgzf.MOST))
        text, contigs = header(head)
        sample, body = sample_name(text), head.tell()
        named = None if self.bounds.contigs is None else {i for i, (c, _) in enumerate(contigs) if c in self.bounds.contigs} | ({-1} if "*" in self.bounds.contigs else set())

        def keep(ref: int, pos: int) -> bool:
            if part.starting and not (ref == part.starting[0] and part.starting[1] <= pos < part.starting[2]):
                return False
            return (named is None or ref in named) and self.bounds.low <= pos + 1 <= self.bounds.high

        free = not part.starting and not self.bounds.set
        for low, stop in part.chunks if part.chunks is not None else self._stretch(raw, part, contigs, body):
            stream = Stream(bgzf.Blocks(raw, part.size, low >> 16, bgzf.MOST if part.chunks else 1 << 18), low & 0xFFFF)
            for row in records(stream, contigs, part.wanted, stop, None if free else keep):
                yield (sample, *row)

    @staticmethod
    def _stretch(raw: Any, part: Part, contigs: list[tuple[str, int]], body: int) -> list[genome_index.Chunk]:
        low, high = part.split
        start = body if low <= body >> 16 else first_record(raw, part.size, low, high, contigs)
        # blocks that start behind the split's end are another's
        return [] if start is None or start >> 16 >= high else [(start, high << 16)]


class FilteredBamReader(BamReader):
    """Filters on rname and pos become regions."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f


class BamDataSource(DataSource):
    """``spark.dataSource.register(BamDataSource)``, then ``spark.read.format("bam").load(path)``; or reads(), which also has filters
    pushed into the source: that needs the option ``pushFilters`` and Spark's ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return (FilteredBamReader if self.options.get("pushFilters") == "true" else BamReader)(self.options)


def reads(spark: SparkSession, path: str, region: str | None = None, **options: Any) -> DataFrame:
    """The reads of BAM files (those that meet a region), with filters on rname and pos pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
    reader = spark.read.format("bam").option("pushFilters", "true").options(**options)
    return (reader.option("region", region) if region else reader).load(path)
