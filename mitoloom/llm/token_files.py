"""Token-ID output: flat unsigned integers plus 64-bit document offsets, written in id order and memory-mapped back."""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import new_folder, open_folder, pick
from mitoloom.llm.words import WordTable, pieces, ranges

#: Entries in each of the two generations of a task's caches: of words, and of the runs of letters and the like in them.
CACHED_WORDS, CACHED_RUNS = 250_000, 350_000

#: Words that are cut into runs.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")


#: Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the other bytes as U+0100 and on, in order.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in PRINTABLE)}


class Cache(dict):
    """A dictionary of bounded size: when it is full, it starts anew, but keeps what is used of its previous generation."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys) -> list[str]:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out, old = [], self.old
        for k in keys:
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    out.append(k)
        return out


class WordEncoder:
    """Encodes texts with the tokenizers library, through bounded caches of what it gave for words and for runs within words.

    Where a vocabulary's own settings cut texts into runs by a pattern that no run with white space matches, and drop the white
    space, a text's ids are those of its words, one after another, and a word's are those of its runs. Words are cut at
    ASCII white space. Runs are used for words of Latin letters, digits and signs up to U+024F but U+0130, which lower-case one
    by one and are their own composed form; other words are encoded whole, as are texts that hold a special token, and all
    texts for vocabularies without such settings.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        dropped = [s["pattern"].get("Regex", "") for s in (settings.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
        kinds = [s.get("type") for s in (settings.get("normalizer") or {}).get("normalizers", [])]
        last = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
        self.by_word = last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and len(dropped) == 1 and r"[^\s" in dropped[0] and not settings.get("post_processor") and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        if self.by_word:  # the same pattern for the standard library, within the range of LATIN
            members = {k: "".join(chr(c) for c in range(0x250) if regex.match(rf"\p{{{k}}}", chr(c))) for k in "LN"}
            self.run = re.compile(re.sub(r"\[\\p\{([LN])\}\]", r"\\p{\1}", dropped[0]).replace(r"\p{L}+", f"[{members['L']}]+").replace(r"|\p{N}|", f"|[{members['N']}]|").replace(r"\p{L}", members["L"]).replace(r"\p{N}", members["N"]))
        self.lower = "Lowercase" in kinds
        self.special = [t["content"] for t in settings.get("added_tokens", [])]
        self.words, self.runs = Cache(CACHED_WORDS), Cache(CACHED_RUNS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str], to: dict) -> None:
        for at in range(0, len(missing), 1_000):
            some = missing[at : at + 1_000]
            to.update(zip(some, self._encode(some), strict=True))

    def _model(self, runs: list[str]) -> list[bytes]:
        """Runs straight through the library's merge model: they are normalised and cut already, so only the bytes' letters are due."""
        tokenize, dtype = self.tokenizer.model.tokenize, self.dtype
        return [np.array([t.id for t in tokenize(r if r.isascii() else r.encode().decode("latin-1").translate(BYTE_LETTERS))], dtype=dtype).tobytes() for r in runs]

    def _words(self, vocabulary: list[str]) -> list[bytes]:
        missing = self.words.missing(vocabulary)
        cut = {w: self.run.findall(w.lower() if self.lower else w) for w in missing if (w.isascii() and w.isprintable()) or LATIN.fullmatch(w)}
        runs = self.runs
        unknown = runs.missing({r for rs in cut.values() for r in rs})
        runs.update(zip(unknown, self._model(unknown), strict=True))
        self.words.update((w, runs[rs[0]] if len(rs) == 1 else b"".join([runs[r] for r in rs])) for w, rs in cut.items())
        self._learn([w for w in missing if w not in cut], self.words)
        words = self.words
        return [words[w] for w in vocabulary]

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), each text's followed by ``end``."""
        texts = pc.fill_null(texts, "")
        whole = np.ones(len(texts), dtype=bool)
        if self.by_word:
            whole = np.zeros(len(texts), dtype=bool)
            for s in self.special:
                whole |= np.asarray(pc.match_substring(texts, s))
        table = WordTable(pc.if_else(pa.array(whole), "", texts), lower=None)
        at = np.flatnonzero(whole)
        values = [*self._words(table.vocabulary), *self._encode([texts[int(i)].as_py() for i in at]), end]
        n = len(table.vocabulary)
        # a text that is encoded whole is one word of its own, and the end is a word that every text has
        rows = np.arange(len(texts))
        order = np.argsort(np.concatenate([np.repeat(rows, table.counts), at, rows]), kind="stable")
        codes = np.concatenate([table.codes, n + np.arange(len(at)), np.full(len(texts), n + len(at))])[order]
        counts = table.counts + whole + 1
        sizes = np.array([len(v) for v in values], dtype=np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(values), self.dtype)
        starts = np.cumsum(sizes) - sizes
        ids = flat[ranges(starts[codes], sizes[codes])]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum(counts)]
        return np.diff(ends, prepend=0), ids


def write_token_files(df: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, dtype: str = "uint16") -> list[dict]:
    """Writes ``part-*`` files of token ids, offsets and document ids under ``folder`` and returns the parts in order.

    Documents are dealt into ascending ranges of id (null ids first; rows that share an id are ordered by their text, so
    reruns agree). Each task streams its range into one file of ids, flat and little-endian, and one of int64 offsets and
    ids; files get their names only when complete, so that retried and speculative tasks do no harm. A null text counts as
    empty and gives the end id alone. The driver gets one row a part (path, documents, ids) and turns the parts' counts into
    bases by a prefix sum; ``manifest.json`` keeps them. No rows give no parts.
    """
    limit = np.iinfo(np.dtype(dtype)).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        encoder, own = WordEncoder(tokenizer, dtype), uuid.uuid4().hex
        end = b"" if end_id is None else np.asarray([end_id], dtype=dtype).tobytes()
        at, docs = 0, 0
        if encoder.tokenizer.get_vocab_size() - 1 > limit or (end_id or 0) > limit:
            raise ValueError(f"ids of this vocabulary do not fit in {dtype}")
        offsets, ids, known = io.BytesIO(), io.BytesIO(), io.BytesIO()
        with store.open_output_stream(f"{root}/.{own}.ids") as out:
            for batch in pieces(batches, limit=1 << 20):
                lengths, encoded = encoder.encode(batch.column("text"), end)
                out.write(encoded.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
                offsets.write((at + np.concatenate([[0], np.cumsum(lengths)[:-1]])).astype("<i8").tobytes())
                column = batch.column("doc_id")
                ids.write(pc.fill_null(column, 0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                known.write(np.asarray(column.is_valid(), dtype=np.uint8).tobytes())
                at, docs = at + int(lengths.sum()), docs + batch.num_rows
        if not docs:
            store.delete_file(f"{root}/.{own}.ids")
            return
        with store.open_output_stream(f"{root}/.{own}.docs") as out:
            out.write(offsets.getvalue() + np.asarray([at], dtype="<i8").tobytes() + ids.getvalue() + known.getvalue())
        name = f"part-{part:06d}-{own}"
        for kind in ("ids", "docs"):
            store.move(f"{root}/.{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": pa.array([name]), "docs": pa.array([docs], pa.int64()), "ids": pa.array([at], pa.int64())})

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    parts = sorted((r.asDict() for r in ordered.mapInArrow(lean(write), "part long, name string, docs long, ids long").collect()), key=lambda r: r["part"])
    base = doc_base = 0
    for row in parts:
        row |= {"base": base, "doc_base": doc_base}
        base, doc_base = base + row["ids"], doc_base + row["docs"]
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "ids": base, "docs": doc_base, "parts": parts}).encode())
    return parts


def read_token_files(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row a document from the files alone: doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers) and, on request, the ids. Local files are memory-mapped."""
    store, root = open_folder(folder)
    with store.open_input_stream(f"{root}/manifest.json") as file:
        manifest = json.loads(file.read())
    dtype, parts = manifest["dtype"], manifest["parts"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                docs = row["docs"]
                with store.open_input_stream(f"{root}/{row['name']}.docs") as file:
                    raw = file.read()
                offsets = np.frombuffer(raw, "<i8", docs + 1)
                ids = np.frombuffer(raw, "<i8", docs, 8 * (docs + 1))
                known = np.frombuffer(raw, np.uint8, docs, 8 * (2 * docs + 1)).astype(bool)
                mapped = np.memmap(f"{root}/{row['name']}.ids", dtype=np.dtype(dtype).newbyteorder("<"), mode="r") if isinstance(store, fs.LocalFileSystem) else None
                file = None if mapped is not None else store.open_input_file(f"{root}/{row['name']}.ids")
                for a in range(0, docs, 2000):
                    b = min(docs, a + 2000)
                    low, high = int(offsets[a]), int(offsets[b])
                    width = np.dtype(dtype).itemsize
                    tokens = np.asarray(mapped[low:high]) if mapped is not None else np.frombuffer(file.read_at((high - low) * width, low * width), np.dtype(dtype).newbyteorder("<"))
                    wide, at = tokens.astype("<u4"), offsets[a : b + 1] - low
                    out = {
                        "doc_id": pa.array(ids[a:b], pa.int64(), mask=~known[a:b]),
                        "start": pa.array(offsets[a:b] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(wide[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([wide[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    frame = spark.createDataFrame([(r["name"], r["docs"], r["base"]) for r in parts], "name string, docs long, base long")
    return frame.repartition(max(1, min(len(parts), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(lean(read), schema)


def token_output(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files (see write_token_files) and returns what read_token_files finds in them."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    write_token_files(df, folder, tokenizer, **options)
    return read_token_files(spark, folder)
