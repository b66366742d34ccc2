"""WARC archives: segmented, chunk-framed records out; continuation records reassembled by origin and verified in."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import new_folder, open_folder, pick
from mitoloom.llm.words import pieces

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing (RFC 9112, 7.1)."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; chunk extensions and trailers are skipped. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        piece = body[line + 2 : line + 2 + size]
        if len(piece) < size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(piece)
        at = line + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, freed of its transfer framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding", b"").split(b",")[-1].strip() == b"chunked" else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def segments(record_id: str, fields: list[tuple[str, str]], block: bytes, limit: int) -> Iterator[bytes]:
    """A response record; one longer than ``limit`` goes on in continuation records."""
    if len(block) <= limit:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", "1")], block[:limit])
    count = -(-len(block) // limit)
    for k in range(2, count + 1):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if k == count else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-segment:{k}:{record_id[1:-1]}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(k)), *more], block[(k - 1) * limit : k * limit])


def revisits(pages: DataFrame, shortest: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload, of ``shortest`` bytes or more, a smaller page_id has."""
    digests = pages.where(F.octet_length("html") >= shortest).select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return digests.join(first.drop("n"), "digest").where("page_id IS NULL OR page_id <> refers_to").distinct()


def write_warc(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = 100, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, roll_bytes: int = 64 << 20) -> list[str]:
    """Writes a record for each row into gzip archives under ``folder`` and returns their names.

    Of equal payloads of ``shortest`` bytes or more, the row with the smallest id becomes a response and the others become
    revisits of it; rows that repeat that id and payload are responses too. Null html counts as empty, a null url as empty; a
    null id is never the one referred to. Duplicates are found on digests alone; the pages are then joined by id, so that a
    payload that very many pages share lands in no one task. Archives roll at ``roll_bytes`` and get their names when complete.
    """
    pages = pick(df, page_id=id_col, url=url_col, html=html_col).withColumns({"page_id": F.col("page_id").cast("long"), "html": F.coalesce("html", F.lit(""))})
    again = revisits(pages, shortest).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    marked = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        own, names, out, done = uuid.uuid4().hex, [], None, 0

        def close() -> None:
            out.close()
            names.append(f"part-{part:06d}-{len(names):04d}-{own}.warc.gz")
            store.move(f"{root}/.{own}", f"{root}/{names[-1]}")

        for batch in pieces(batches, "html"):
            for row, page_id, url, html, digest, refers_to in zip(range(done, done + batch.num_rows), *(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=False):
                if out is None:
                    out = store.open_output_stream(f"{root}/.{own}")
                payload = html.encode("utf-8", "surrogatepass")
                record_id = f"<urn:x-page:{'' if page_id is None else page_id}:{part}:{row}>"
                fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(len(payload)))]
                if refers_to is None:
                    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    out.write(b"".join(segments(record_id, [*fields, ("Content-Type", "application/http; msgtype=response")], block, segment_bytes)))
                else:
                    out.write(record([*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to)), ("Content-Type", "application/http; msgtype=response")], HTTP + b"\r\n"))
                if out.tell() >= roll_bytes:
                    close()
                    out = None
            done += batch.num_rows
        if out is not None:
            close()
        if names:
            yield pa.RecordBatch.from_pydict({"name": pa.array(names)})

    return sorted(r.name for r in marked.mapInArrow(lean(write), "name string").collect())


def records(raw, gzipped: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive stream, gzip by members or plain."""

    def plain() -> Iterator[bytes]:
        unpack = zlib.decompressobj(31) if gzipped else None
        while data := raw.read(1 << 20):
            while unpack and data:
                yield unpack.decompress(data)
                data = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            if not unpack:
                yield data

    stream, have = plain(), bytearray()
    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if (more := next(stream, None)) is None:
                if have.strip():
                    raise ValueError("archive ends within a record's headers")
                return
            have += more
        lines = bytes(have[:end]).decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        while len(have) < stop + 4 and (more := next(stream, None)) is not None:
            have += more
        yield fields, bytes(have[end + 4 : stop])
        del have[: stop + 4]


PARSED = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared", pa.string()), ("length", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())])
SCHEMA = "origin string, segment long, total long, record_type string, url string, page_id long, refers_to long, declared string, length long, block binary, payload binary, payload_bytes long, payload_digest string, status string"


def finish(row: dict, block: bytes | None, with_payload: bool) -> dict:
    """Decodes a whole record's block and checks the payload against the digest that the record declares."""
    row |= {"block": None, "payload": None}
    try:
        payload = http_payload(block)
    except ValueError as error:
        return row | {"payload_bytes": None, "payload_digest": None, "status": f"broken: {error}"}
    digest = hashlib.sha256(payload).hexdigest()
    return row | {"payload": payload if with_payload else None, "payload_bytes": len(payload), "payload_digest": digest, "status": "ok" if row["declared"] in ("", digest) else "digest differs"}


def read_warc(spark: SparkSession, folder: str, names: list[str], *, with_payload: bool = False) -> DataFrame:
    """One row a logical record: page_id, url, record_type, refers_to, payload (on request), payload_bytes, payload_digest, status.

    Archives are parsed in parallel, a task an archive, as streams. Records in one piece are decoded where they are read;
    segments travel to their origin's task, are put in order by segment number, checked (numbers without gaps, length equal to
    WARC-Segment-Total-Length) and only then decoded. A record that fails a check keeps its row, with the reason in ``status``
    and a null payload. A revisit carries its payload's declared digest and length. No archives give no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for f, block in records(raw, name.endswith(".gz")):
                        kind, number = f.get("warc-type", ""), int(f.get("warc-segment-number", 0))
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        ident = lambda key, f=f: int(f[key]) if f.get(key) else None
                        row = {"origin": f.get("warc-segment-origin-id") or f["warc-record-id"], "segment": number, "total": ident("warc-segment-total-length"), "record_type": kind, "url": f.get("warc-target-uri"), "page_id": ident("warc-page-id"), "refers_to": ident("warc-refers-to-page-id"), "declared": f.get("warc-payload-digest", "").removeprefix("sha256:"), "length": len(block)}
                        if number:
                            row["block"] = block
                        elif kind == "revisit":
                            row |= {"payload_bytes": ident("warc-payload-length"), "payload_digest": row["declared"] or None, "status": "ok"}
                        else:
                            row = finish(row, block, with_payload)
                        rows.append(row)
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, PARSED)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PARSED)

    def whole(parts: list[dict]) -> dict:
        row = dict(parts[0])
        numbers, total = [p["segment"] for p in parts], parts[-1]["total"]
        block = b"".join(p["block"] for p in parts)
        if numbers != list(range(1, len(parts) + 1)):
            return row | {"block": None, "status": "broken: segments missing or repeated"}
        if total is None or total != len(block):
            return row | {"block": None, "status": "broken: length differs from the total"}
        return finish(row, block, with_payload)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held and held[0]["origin"] != row["origin"]:
                    done.append(whole(held))
                    held = []
                if row["segment"]:
                    held.append(row)
                else:
                    done.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, PARSED)
        if held:
            yield pa.RecordBatch.from_pylist([whole(held)], PARSED)

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    parsed = listed.mapInArrow(lean(parse), SCHEMA)
    ordered = parsed.repartition("origin").sortWithinPartitions("origin", "segment")
    return ordered.mapInArrow(lean(join), SCHEMA).select("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "status")


def warc_round_trip(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes df's rows as archives and returns what read_warc finds in them."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    return read_warc(spark, folder, write_warc(df, folder, **options))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NULL OR p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
