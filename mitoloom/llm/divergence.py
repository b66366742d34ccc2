"""Source divergence audit: count-min document frequencies discard terms before they are shuffled, sparse joins compare the sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import cut, free_finished, pick, stored
from mitoloom.llm.words import M1, WordTable, mix, pieces

#: Counters of the sketch: DEPTH rows of 2**WIDTH_BITS, in pages of PAGE. They count to the threshold asked for and no further.
DEPTH, WIDTH_BITS, PAGE = 4, 22, 1 << 14
#: Bytes of text whose terms are counted together.
PIECE = 8 << 20
#: Bytes that part terms become spaces; A-Z become a-z, all others stay.
_BYTES = np.arange(256, dtype=np.uint8)
_FOLDED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, np.where((_BYTES >= 0x80) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)), _BYTES, 0x20)).astype(np.uint8)


def _terms(texts: pa.Array) -> WordTable:
    """Terms: maximal runs of ASCII letters, folded to lower case, and of all that is not ASCII."""
    texts = pa.concat_arrays([texts.fill_null("")]).cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = _FOLDED[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    return WordTable(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(folded)), lower=None)


def _numbered(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.fill_null("").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, how often each): by hashing, which takes less than to sort them."""
    found = pc.value_counts(pa.array(keys))
    return found.field(0).to_numpy(), found.field(1).to_numpy()


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, the number of each key among them)."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _document_terms(table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(text * words + word, how often the text has it) of a piece."""
    return _counted(np.repeat(np.arange(len(table.counts)) * np.int64(max(1, len(table.vocabulary))), table.counts) + table.codes)


class Sketch:
    """Places of (language, term) in the rows of counters."""

    def __init__(self, depth: int, width_bits: int):
        self.depth, self.width_bits = depth, width_bits

    def places(self, table: WordTable, langs: list[str], keys: np.ndarray) -> np.ndarray:
        """(depth, keys) places of the keys ``language * words + word``."""
        size = max(1, len(table.vocabulary))
        word = table.hashes()[keys % size]
        lang = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], dtype=np.uint64)[keys // size]
        both = mix(word ^ (lang * M1))
        mask = np.uint64((1 << self.width_bits) - 1)
        rows = [(mix(both + np.uint64(j * int(M1) % (1 << 64))) & mask) | np.uint64(j << self.width_bits) for j in range(self.depth)]
        return np.array(rows).astype(np.int64)


def document_sketch(rows: DataFrame, least: int, depth: int = DEPTH, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """Merged count-min counters of the documents of each language that hold each term, capped at ``least``.

    Each task counts what it reads; only the pages of counters that it touched leave it, few counters as (place, count), and are
    summed by page. A counter is never below the smaller of ``least`` and the documents of any term that falls on it. depth *
    2**width_bits counters, 16 MB unless ``least`` is over 255, come to the driver, however large the corpus.
    """
    sketch, counters = Sketch(depth, width_bits), depth << width_bits
    kind = np.uint8 if least <= 0xFF else np.uint32
    page = min(PAGE, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, added = np.zeros(counters, kind), np.zeros(1 << width_bits, np.uint32)
        for batch in pieces(batches, limit=PIECE):
            table = _terms(batch.column("text"))
            langs, names = _numbered(batch.column("lang"))
            size = max(1, len(table.vocabulary))
            once, _ = _document_terms(table)
            keys, docs = _counted(langs[once // size] * size + once % size)
            for row in sketch.places(table, names, keys):
                within = row & ((1 << width_bits) - 1)
                np.add.at(added, within, docs)  # two terms of a piece may meet in a place
                seen[row] = np.minimum(seen[row] + added[within], least).astype(kind)
                added[within] = 0
        by_page = seen.reshape(-1, page)
        touched = np.flatnonzero(by_page.any(axis=1))
        for some in np.array_split(touched, max(1, len(touched) // 256)):
            if len(some):
                at = [np.flatnonzero(by_page[p]) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([by_page[p][x].tobytes() for p, x in zip(some, at, strict=True)], pa.binary())], names=["page", "at", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, at, counts in zip(*(batch.column(c).to_pylist() for c in ("page", "at", "counts")), strict=True):
                total = held.setdefault(p, np.zeros(page, np.uint32))
                at = np.frombuffer(at, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, kind), least)
        for p, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["page", "counts"])

    merged = rows.select("lang", "text").mapInArrow(lean(count), "page int, at binary, counts binary").repartition("page").mapInArrow(lean(merge), "page int, counts binary")
    out = np.zeros(counters, kind)
    for row in merged.toLocalIterator():
        out[row.page * page : (row.page + 1) * page] = np.frombuffer(row.counts, kind)
    return out


def term_counts(rows: DataFrame, least: int, depth: int = DEPTH, width_bits: int = WIDTH_BITS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of the terms that ``least`` documents of the language may hold.

    What the sketch rules out is dropped where it is read; the rest is counted exactly, a piece of text at a time, then by Spark.
    """
    sketch = Sketch(depth, width_bits)
    counters = rows.sparkSession.sparkContext.broadcast(document_sketch(rows, least, depth, width_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            table = _terms(batch.column("text"))
            langs, names = _numbered(batch.column("lang"))
            sources, source_names = _numbered(batch.column("source"))
            size, groups = max(1, len(table.vocabulary)), langs * len(source_names) + sources
            once, times = _document_terms(table)
            text, word = once // size, once % size
            keys, back = _numbers(langs[text] * size + word)
            possible = counters.value[sketch.places(table, names, keys)].min(axis=0) >= least if len(keys) else np.zeros(0, dtype=bool)
            use = possible[back]
            pairs, back = _numbers(groups[text[use]] * size + word[use])
            n, docs = np.bincount(back, times[use], len(pairs)).astype(np.int64), np.bincount(back, minlength=len(pairs))
            group, word = pairs // size, pairs % size
            take = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([take(names, group // len(source_names)), take(source_names, group % len(source_names)), take(table.vocabulary, word), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    counted = rows.mapInArrow(lean(count), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(10**9 (n + smooth) / (total + smooth * terms)), in whole numbers of 38 digits; 0 where there is no term."""
    upper = F.lit(10**9).cast("decimal(10,0)") * (n + F.lit(smooth)).cast("decimal(20,0)")
    lower = (total + terms * F.lit(smooth)).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", upper, lower).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def divergence(df: DataFrame, *, least_docs: int = 30, smooth: int = 5, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", depth: int = DEPTH, width_bits: int = WIDTH_BITS) -> DataFrame:
    """How far each source's use of terms is from its language's other sources and from the whole language.

    lang, source, part, item, value, rank. A language keeps the terms that ``least_docs`` of its rows hold. Part ``pair``: item is
    another source of the language, value the sum over kept terms of the difference of the smoothed shares, in billionths. Part
    ``term``: item is a term that the source has and uses more than the language does, by how much, up to rank ``top``.
    Ranks are by value, descending, then by item.

    Null texts, languages and sources count as ''. Repeated rows each count. A language without kept terms has pairs of value 0.
    No rows give no rows.

    A pair's sum is over all kept terms, most of which neither source has. Three parts give it from what is there: for each source
    the differences of its own terms from the other's share of an absent term, by distinct counts; a correction for terms
    that both have, from a join on the term; and the number of terms left times the difference of the two absent shares.
    """
    spark = df.sparkSession
    rows = pick(df, text=text_col, lang=lang_col, source=source_col).select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counts = stored(term_counts(rows, least_docs, depth, width_bits), "terms")
    free_finished(spark)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    counts = cut(counts.drop("docs").join(kept, ["lang", "term"]))
    every = rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = every.join(terms, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total", "own"])
    groups = cut(groups.withColumn("absent", _share(F.lit(0), F.col("total"), F.col("terms"), smooth)))
    use = counts.join(groups.drop("own"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"), smooth))
    use = use.withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth))
    use = cut(use.select("lang", "source", "term", "n", "p", "q", "absent"))
    free_finished(spark)

    best = use.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)

    a = use.select("lang", "term", *[F.col(c).alias(f"{c}_a") for c in ("source", "p", "absent")])
    b = use.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "absent")])
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(gap("p_a", "p_b") - gap("p_a", "absent_b") - gap("absent_a", "p_b") + gap("absent_a", "absent_b")).alias("both"))
    one = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "own", "absent")], "terms")
    other = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "own", "absent")])
    pairs = one.join(other, "lang").where("source_a <> source_b")
    levels = use.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a")).agg(F.count("*").alias("times"))
    alone = levels.join(other, "lang").where("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("times") * gap("p_a", "absent_b")).alias("alone"))
    turned = alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), F.col("alone").alias("turned"))
    met = both.unionByName(both.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), "both"))
    for part in (alone, turned, met):
        pairs = pairs.join(part, ["lang", "source_a", "source_b"], "left")
    value = sum((F.coalesce(c, F.lit(0)) for c in ("alone", "turned", "both")), (F.col("terms") - F.col("own_a") - F.col("own_b")) * gap("absent_a", "absent_b"))
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value")).withColumn("rank", rank)
    return pairs.unionByName(best)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM r
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))
QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""
