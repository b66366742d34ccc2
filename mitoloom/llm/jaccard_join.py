"""N-gram Jaccard join: exact links at a similarity threshold, found by signature trees over co-located candidates.

A text becomes its set of 64-bit shingle hashes, equal sets become one class, and only classes are compared.

1. Buckets and clumps. The hash space is cut into more parts than two linked sets can differ in, so that by the pigeonhole
   principle linked sets agree on a whole part that is not empty. Each class gives one key for each part; classes that share
   a key form a bucket. In each bucket a signature tree over the classes' bitmaps tells which of them can be similar enough;
   the connected components of those chances are the clumps, and every link lies in one. A bucket of very many classes is
   taken as one chain without a tree, which can only make its clump larger.
2. Trees. A clump's sets go to one task, or in blocks of bounded weight to several. There a signature tree is built and
   traversed against itself; node pairs whose largest possible overlap is too small, or that are already in one group, are
   not opened. What remains is verified exactly.
3. Heavy clumps. Their blocks are joined with themselves, then representatives of the groups found are joined with each
   other, and what is still apart from the clump's main group is joined, block by block, with the whole clump.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.bitfilter import bit_filter, may_hold
from mitoloom.llm.components import connected_components
from mitoloom.llm.lean import lean
from mitoloom.llm.shared import cut, pick, stored, unused
from mitoloom.llm.signature_tree import Sets, Sketches, linked_groups, sketch
from mitoloom.llm.words import M1, M2, mix, pieces, ranges, set_hashes, shingle_sets, sums

#: Shingles that a tree task holds at a time: 8 bytes each as read, and some 50 more while their ids and bitmaps are made.
BLOCK_WEIGHT = 1_000_000
SEEN = 200_000
#: Members of a bucket that a task holds; larger buckets become chains.
BUCKET = 4096


class Partition:
    """Size classes, and for each the number of parts that its pairs need at threshold num/den.

    Bounds grow so that a partner's size lies in the same class or the next. A class has k + 1 + m parts, where k is the most
    elements in which a linked pair can differ and m allows for parts that are empty: a set with more than m empty parts gives
    keys for them too. Linked sets agree on m + 1 parts at least, so they share a key in every case.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 32:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * den * den // (num * num), (bounds[-1] - 1) * den // num + 1))
        self.bounds = np.array(bounds, dtype=np.int64)
        most = [2 * (high - 1) * (den - num) // (den + num) for _, high in pairwise(bounds)]
        self.parts, self.spare = [], []
        for k, low in zip(most, bounds, strict=False):
            low = max(1, -(-low * num // den))
            m = 0
            for _ in range(50 if k else 0):  # the empty parts to expect, and two deviations
                expected = (k + 1 + m) * np.exp(-low / (k + 1 + m))
                m = max(m, int(np.ceil(expected + 2 * np.sqrt(expected))))
                if m > k:
                    break
            self.parts.append(k + 1 + m)
            self.spare.append(m)
        self.parts, self.spare = np.array(self.parts, np.int64), np.array(self.spare, np.int64)

    def keys(self, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set position, key) for every key of every set."""
        sizes = np.diff(offsets)
        own = np.searchsorted(self.bounds, sizes, side="right") - 1
        out = [self._at(offsets, values, np.flatnonzero(sizes > 0), own), self._at(offsets, values, np.flatnonzero((sizes > 0) & (sizes * self.den // self.num >= self.bounds[own + 1])), own + 1)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _at(self, offsets: np.ndarray, values: np.ndarray, which: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, level = np.diff(offsets)[which], level[which]
        parts = self.parts[level]
        first = np.concatenate([[0], np.cumsum(parts)])
        shift = np.repeat(offsets[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(which) else np.zeros(0, np.int64)
        elements = values[shift + np.arange(len(shift))]
        slot = (((mix(elements ^ M1) >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(first[:-1], sizes)
        total = int(first[-1])
        count = np.bincount(slot, minlength=total)
        content = sums(slot, mix(elements), total)
        at = np.repeat(np.arange(len(which)), parts)
        part = np.arange(total) - first[:-1][at]
        empty = np.bincount(at, count == 0, len(which)).astype(np.int64)
        give = (count > 0) | (empty > self.spare[level])[at]
        key = mix(content ^ (part.astype(np.uint64) * M1) ^ (level[at].astype(np.uint64) * M2) ^ count.astype(np.uint64))
        return which[at[give]], key[give]


def documents_and_classes(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, class, sketch): class is a 64-bit hash of the set, null where the set is empty, as is the sketch."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            offsets, values = shingle_sets(batch.column("text"), width)
            hashes, sizes = set_hashes(offsets, values), np.diff(offsets)
            sketches = [sketch(values[x:y]) if y > x else None for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes.view(np.int64), mask=sizes == 0), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "class", "sketch"])

    return rows.mapInArrow(lean(classes), "doc_id long, n_shingles long, class long, sketch binary")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, class) in order to (bucket, class) for keys of several classes, or (leader, class) for keys of very many.

    Buckets are named by their members, so that the many keys that the same classes share make one bucket.
    """
    none = np.zeros(0, np.int64)
    held_key, held, over, leader, seen = none, none, None, 0, set()

    def rows(bucket: np.ndarray, member: np.ndarray, chained: bool) -> pa.RecordBatch:
        name, null = pa.array(bucket), pa.nulls(len(member), pa.int64())
        return pa.RecordBatch.from_arrays([null if chained else name, pa.array(member), name if chained else null], names=["bucket", "class", "leader"])

    def emit(key: np.ndarray, member: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
        key, member = key[fresh], member[fresh]
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        name = mix(np.add.reduceat(mix(member.view(np.uint64)), starts) ^ (sizes.astype(np.uint64) * M2)).view(np.int64)
        long = np.flatnonzero(sizes > BUCKET)
        if len(long):
            at = ranges(starts[long], sizes[long])
            yield rows(np.repeat(member[starts[long]], sizes[long]), member[at], True)
        _, first = np.unique(name, return_index=True)
        if len(seen) > SEEN:
            seen.clear()
        chosen = np.array([i for i in first.tolist() if 1 < sizes[i] <= BUCKET and int(name[i]) not in seen], dtype=np.int64)
        if len(chosen):
            seen.update(name[chosen].tolist())
            yield rows(np.repeat(name[chosen], sizes[chosen]), member[ranges(starts[chosen], sizes[chosen])], False)

    for batch in batches:
        key, member = batch.column("key").to_numpy(), batch.column("class").to_numpy()
        if over is not None and len(key):
            same = int(np.searchsorted(key, over, side="right"))
            if same:
                yield rows(np.full(same, leader), member[:same], True)
                key, member = key[same:], member[same:]
            if len(key):
                over = None
        if not len(key):
            continue
        key, member = np.concatenate([held_key, key]), np.concatenate([held, member])
        last = int(np.searchsorted(key, key[-1]))
        yield from emit(key[:last], member[:last])
        held_key, held = key[last:], member[last:]
        if len(held) > 4 * BUCKET:
            yield rows(np.full(len(held), held[0]), held, True)
            over, leader, held_key, held = held_key[0], held[0], none, none
    yield from emit(held_key, held)


def clumps(rows: DataFrame, documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) of the classes that share a bucket with a class that could be similar enough, by their bitmaps."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seen = Partition(num, den), set()
        for batch in pieces(batches):
            offsets, values = shingle_sets(batch.column("text"), width)
            hashes = set_hashes(offsets, values).view(np.int64)
            if len(seen) > SEEN:  # sets met before in this task need no second set of keys; forgetting them is harmless
                seen.clear()
            fresh = np.zeros(len(hashes), dtype=bool)
            for i, h in enumerate(hashes.tolist()):
                if h not in seen:
                    seen.add(h)
                    fresh[i] = True
            at, key = partition.keys(offsets, values)
            use = fresh[at]
            yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(hashes[at[use]])], names=["key", "class"])

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, raw = None, [], []

        def found() -> pa.RecordBatch | None:
            labels = linked_groups(Sketches(raw), num, den)
            to = np.array(ids)[labels]
            moved = to != np.array(ids)
            return pa.RecordBatch.from_arrays([pa.array(to[moved]), pa.array(np.array(ids)[moved])], names=["u", "v"]) if moved.any() else None

        for batch in batches:
            for b, i, r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "class", "sketch")), strict=True):
                if b != bucket:
                    if len(ids) > 1 and (out := found()) is not None:
                        yield out
                    bucket, ids, raw = b, [], []
                ids.append(i)
                raw.append(r)
        if len(ids) > 1 and (out := found()) is not None:
            yield out

    keys = rows.mapInArrow(lean(keyed), "key long, class long")
    found = cut(keys.repartition("key").sortWithinPartitions("key", "class").mapInArrow(lean(runs), "bucket long, class long, leader long"))
    buckets = found.where("bucket IS NOT NULL").select("bucket", "class").distinct()
    wanted = buckets.select("class").distinct()
    # one sketch a class before the shuffle, so that a class of very many copies is no hot key
    sketches = documents.where("class IS NOT NULL").groupBy("class").agg(F.first("sketch").alias("sketch")).join(wanted, "class", "left_semi")
    members = buckets.join(sketches, "class").select("bucket", "class", "sketch").repartition("bucket").sortWithinPartitions("bucket", "class")
    chained = found.where("leader IS NOT NULL").select(F.col("leader").alias("u"), F.col("class").alias("v"))
    return connected_components(members.mapInArrow(lean(chances), "u long, v long").unionByName(chained))


SETS = "clump long, block long, class long, side boolean, label long, values binary"


def _joined(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Runs the trees over rows SETS, a group for each (clump, block); links (u, v) between classes come out.

    ``side`` is true on rows to be searched for; where all of a group's rows are, the group is joined with itself.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch | None:
            ids = np.array([r[1] for r in held], dtype=np.int64)
            values = [np.frombuffer(r[4], "<u8") for r in held]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
            _, before = np.unique(np.array([r[3] for r in held]), return_inverse=True)
            left = np.flatnonzero([r[2] for r in held])
            labels = linked_groups(Sets(offsets, np.concatenate(values)), num, den, before, None if len(left) == len(held) else left)
            _, first, group = np.unique(labels, return_index=True, return_inverse=True)
            to = ids[first[group]]
            moved = to != ids
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(to[moved])], names=["u", "v"]) if moved.any() else None

        for batch in batches:
            for clump, block, *row in zip(*(batch.column(c).to_pylist() for c in ("clump", "block", "class", "side", "label", "values")), strict=True):
                if held and held[0][0] != (clump, block):
                    if len(held) > 1 and (out := done()) is not None:
                        yield out
                    held = []
                if not held or held[-1][1] != row[0]:  # a class comes twice where ids repeat
                    held.append(((clump, block), *row))
        if len(held) > 1 and (out := done()) is not None:
            yield out

    return sets.select("clump", "block", "class", "side", "label", "values").repartition("clump", "block").sortWithinPartitions("clump", "block", "class").mapInArrow(lean(links), "u long, v long")


def fetched_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(clump, block, class, values) of the wanted classes, from the documents that stand for them.

    A filter of fixed size keeps other documents' texts from being shuffled; the join by id after it decides.
    """
    bits = bit_filter(wanted.select(F.xxhash64("doc_id").alias("h")), "h")
    wanted = wanted.withColumnRenamed("doc_id", "__id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            offsets, values = shingle_sets(batch.column("text"), width)
            hashes, bounds = set_hashes(offsets, values).view(np.int64), offsets.tolist()
            right = np.flatnonzero(hashes == batch.column("wanted").to_numpy())  # ids may repeat with other texts
            at = pa.array(right)
            yield pa.RecordBatch.from_arrays([batch.column("clump").take(at), batch.column("block").take(at), pa.array(hashes[right]), pa.array([values[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in right], pa.binary())], names=["clump", "block", "class", "values"])

    near = rows.where(may_hold(bits, F.col("doc_id")))
    joined = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "wanted", "clump", "block")
    return joined.mapInArrow(lean(fetch), "clump long, block long, class long, values binary")


def class_links(rows: DataFrame, first: DataFrame, members: DataFrame, width: int, num: int, den: int, weight: int) -> DataFrame:
    """Links (u, v) that connect all linked classes of ``members`` (node, root)."""
    wanted = members.join(first, F.col("node") == F.col("class")).select(F.col("min_id").alias("doc_id"), F.col("class").alias("wanted"), F.col("root").alias("clump"), "n")
    loads = wanted.groupBy("clump").agg((F.floor(F.sum("n") / weight) + 1).alias("blocks"))
    wanted = cut(wanted.join(loads, "clump").select("doc_id", "wanted", "clump", "blocks", F.pmod(F.xxhash64("wanted"), F.col("blocks")).alias("block")))
    alone = {"side": F.lit(True), "label": F.col("class")}
    links = cut(_joined(fetched_sets(rows, wanted, width).withColumns(alone), num, den))
    heavy = wanted.where("blocks > 1").select("clump", F.col("wanted").alias("class"), "blocks", "block")
    if heavy.isEmpty():
        return links
    sets = cut(fetched_sets(rows, wanted.where("blocks > 1"), width).drop("block").dropDuplicates(["class"]))
    # representatives of each block's groups, gathered until they fit a block or no longer merge
    before = -1
    while True:
        groups = connected_components(links)
        labelled = heavy.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.coalesce("root", "class"))
        speakers = labelled.groupBy("clump", "label", "block").agg(F.min("class").alias("class"))
        apart = labelled.groupBy("clump").agg(F.count_distinct("label").alias("labels")).where("labels > 1")
        left = apart.agg(F.sum("labels")).first()[0]
        if left is None:
            return links
        if before == left:
            break
        before = left
        again = sets.join(speakers.drop("block"), ["clump", "class"])
        loads = again.groupBy("clump").agg((F.floor(F.sum(F.octet_length("values") / 8) / weight) + 1).alias("blocks"))
        again = again.join(loads, "clump").withColumns({"block": F.pmod(F.xxhash64("class", F.lit(left)), F.col("blocks")), "side": F.lit(True)})
        links = cut(links.unionByName(_joined(again, num, den)))
    # all that is not in its clump's main group meets the whole clump, a pair of blocks at a time
    main = labelled.groupBy("clump", "label").count().groupBy("clump").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    labelled = labelled.join(apart.select("clump"), "clump").join(main, "clump").select("clump", "class", "label", "main", "blocks")
    full = sets.join(labelled, ["clump", "class"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    searched = full.where("label <> main").withColumn("other", F.explode(every)).withColumns({"block": own * F.col("blocks") + F.col("other"), "side": F.lit(True)})
    against = full.withColumn("other", F.explode(every)).withColumns({"block": F.col("other") * F.col("blocks") + own, "side": F.lit(False)})
    both = searched.unionByName(against).groupBy("clump", "block", "class").agg(F.max("side").alias("side"), F.first("label").alias("label"), F.first("values").alias("values"))
    return cut(links.unionByName(_joined(both, num, den)))


def jaccard_groups(df: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, class, representative.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lowered; a set holds the distinct ``width``-word shingles, or
    the whole sequence where there are fewer words. Rows link when den * common >= num * united; component_id is the smallest
    id that links reach. Null texts and texts without words have n_shingles 0, no class, and link with nothing. Rows that
    repeat an id each give a row; null ids count as larger than any other. representative marks one row of each component
    (the one with that smallest id; of rows that repeat it, all). Shingles and sets are told apart by 64-bit hashes.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    num, den = num // np.gcd(num, den).item(), den // np.gcd(num, den).item()
    documents = cut(documents_and_classes(rows, width))
    first = documents.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"))
    members = cut(clumps(rows, documents, width, num, den))
    links = class_links(rows, first, members, width, num, den, block_weight)
    groups = connected_components(links)
    tied = first.join(groups, F.col("class") == F.col("node")).select("class", "min_id", "root")
    lowest = tied.groupBy("root").agg(F.min("min_id").alias("lowest"))
    tied = tied.join(lowest, "root").select("class", "lowest")
    # a table of its own, so that both sides of the join are plain shuffles, of which Spark splits a hot class
    ids = stored(first.join(tied, "class", "left").select(F.col("class").alias("__class"), F.coalesce("lowest", "min_id").alias("component_id")), "components")
    joined = documents.join(ids, F.col("class") == F.col("__class"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "class").withColumn("representative", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the rows that are linked to a row with a smaller id; of rows that repeat an id and a set, one stays."""
    groups = cut(jaccard_groups(df, id_col=id_col, text_col=text_col, **options))
    away, may, again = (unused(df, name) for name in ("__gone", "__may", "__twice"))
    gone = groups.where("NOT representative").select(F.col("doc_id").alias(away)).distinct()
    ident = F.col(id_col).cast("long")
    bits = bit_filter(gone.select(F.xxhash64(away).alias("h")), "h")  # most rows need no shuffle to be known as kept
    marked = df.withColumn(may, may_hold(bits, ident))
    kept = marked.where(~F.col(may)).unionByName(marked.where(F.col(may)).join(gone, ident.eqNullSafe(F.col(away)), "left_anti")).drop(may)
    twice = groups.groupBy(F.col("doc_id").alias(again)).count().where("count > 1").select(again)
    if twice.isEmpty():
        return kept
    same = ident.eqNullSafe(F.col(again))
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(g) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 90 * (x.n_shingles + y.n_shingles - c.k)),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, s.b FROM r JOIN s ON s.a = r.reached)
SELECT n.doc_id, n.n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""
