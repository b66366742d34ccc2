"""Exact top-k search: blocks in order of their upper bounds, scored through forward indexes until bounds fall below the kth."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import cut, new_folder, open_folder, pick

#: Rows of a block; queries searched at a time; most components of the vectors that a range, one task's forward index, holds.
BLOCK, QUERIES, RANGE = 256, 512, 4 << 20


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<long>): floor(scale * x); rows with a null id or vector, or a component that is null or not finite, go."""
    rows = pick(df, vec_id=id_col, vector=vector_col).withColumns({"vec_id": F.col("vec_id").cast("long"), "vector": F.col("vector").cast("array<double>")})
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def dense(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones padded with zeros."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def smallest(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the fewest bytes that hold it."""
    most = int(np.abs(matrix).max(initial=0))
    return matrix.astype(next((f"<i{b}" for b in (1, 2, 4) if most < 1 << (8 * b - 1)), "<i8"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, matrix, other columns' arrays) of each run of rows (g, vec_id, vector, ...) with one g."""
    group, held = None, []

    def whole() -> tuple[np.ndarray, np.ndarray, list]:
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(1, held[0].num_columns)]
        vectors = columns[1]
        return columns[0].to_numpy(), dense(vectors.offsets.to_numpy(), vectors.values.to_numpy()), columns[2:]

    for batch in batches:
        g = batch.column("g").to_numpy()
        edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else []
        for a, b in zip(edges, [*edges[1:], len(g)], strict=True) if len(g) else ():
            if held and g[a] != group:
                yield whole()
                held = []
            group = g[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _dealt(rows: DataFrame, per_group: int, count: int) -> DataFrame:
    """rows with g, in groups of about ``per_group`` of the ``count`` rows, whatever ids they share; a group comes in one run.

    rows must be read from storage, so that the numbers given here are the same when a lost part is made again.
    """
    groups = int(max(1, -(-count // per_group)))
    numbered = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return numbered.select("g", *rows.columns).repartition("g").sortWithinPartitions("g", "vec_id")


def _write_queries(queries: DataFrame, count: int, folder: str) -> None:
    """One file a group of queries, in ``folder``: vec_id, vector as bytes of the smallest integers, floor (a score to reach)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix, (floor,) in gathered(batches):
            kind = smallest(matrix)
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()]), pa.array([kind.tobytes()]), pa.array([kind.dtype.itemsize], pa.int64()), pa.array([matrix.shape[1]], pa.int64()), pa.array([floor.to_numpy(zero_copy_only=False).astype("<f8").tobytes()])], names=["ids", "matrix", "kind", "width", "floor"])

    _dealt(queries, QUERIES, count).mapInArrow(lean(write), "ids binary, matrix binary, kind long, width long, floor binary").write.parquet(folder)


def _read_queries(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, floor) of one group after another, from the shared folder."""
    store, root = open_folder(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with store.open_input_stream(info.path) as file:
            table = pq.ParquetFile(io.BytesIO(file.read()))
        for batch in table.iter_batches(batch_size=1):
            row = batch.to_pylist()[0]
            ids = np.frombuffer(row["ids"], "<i8")
            yield ids, np.frombuffer(row["matrix"], f"<i{row['kind']}").reshape(len(ids), row["width"]).astype(np.int64), np.frombuffer(row["floor"], "<f8")


def _place_in_run(*columns: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of rows that are equal in all columns."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - np.repeat(first, np.diff(np.r_[first, len(fresh)]))


class Blocks:
    """A range of candidates in blocks of like vectors, with the largest and smallest value of each dimension in each block.

    Of rows with one id and vector, k stay, and of equal vectors the 2k with the smallest ids: as a query leaves out its own id
    alone, which k of them have at most, no other row can be among its k best.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        wide = matrix.shape[1]
        lead = np.argsort(-np.abs(matrix), axis=1, kind="stable")[:, :2] if wide else np.zeros((len(ids), 1), int)
        signs = np.take_along_axis(matrix, lead, axis=1) > 0 if wide else lead > 0
        alike = np.ascontiguousarray(matrix).view(np.dtype((np.void, max(1, 8 * wide)))).ravel() if wide else np.zeros(len(ids), "V1")
        _, alike = np.unique(alike, return_inverse=True)
        order = np.lexsort((ids, alike, *(x for c in range(lead.shape[1] - 1, -1, -1) for x in (signs[:, c], lead[:, c]))))
        order = order[_place_in_run(alike[order], ids[order]) < k]
        order = order[_place_in_run(alike[order]) < 2 * k]
        self.ids, self.matrix = ids[order], matrix[order]
        self.starts = np.arange(0, len(order), BLOCK)
        self.ends = np.minimum(self.starts + BLOCK, len(order))
        self.high, self.low = np.maximum.reduceat(self.matrix, self.starts, axis=0), np.minimum.reduceat(self.matrix, self.starts, axis=0)
        self.first = np.minimum.reduceat(self.ids, self.starts)
        self.largest = int(np.abs(self.matrix).max(initial=0))

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of each query's k best here, but none below its floor.

        All queries take their blocks in the order of their own bounds, one block each a round, and a query is done when its next
        bound is below its kth score. A block whose bound equals that score is opened only if it holds a smaller id.
        """
        width = min(queries.shape[1], self.matrix.shape[1])
        # products of doubles are exact while sums stay below 2**53; beyond that, integers are multiplied
        exact = width * self.largest * int(np.abs(queries).max(initial=0)) < 1 << 53
        kind, none = (np.float64, -np.inf) if exact else (np.int64, np.iinfo(np.int64).min)
        queries, index = queries[:, :width].astype(kind), self.matrix[:, :width].astype(kind)
        bounds = np.maximum(queries, 0) @ self.high[:, :width].T.astype(kind) + np.minimum(queries, 0) @ self.low[:, :width].T.astype(kind)
        order = np.argsort(-bounds, axis=1, kind="stable")
        start = np.where(np.isfinite(floor), floor, none).astype(kind)
        best, names = np.full((len(ids), k), none, kind), np.full((len(ids), k), np.iinfo(np.int64).max)
        open_ = np.arange(len(ids))
        for place in range(len(self.starts)):
            block = order[open_, place]
            bound, kth = bounds[open_, block], np.maximum(best[open_, -1], start[open_])
            more = bound >= kth
            open_, block, bound, kth = open_[more], block[more], bound[more], kth[more]
            if not len(open_):
                break
            wanted = (bound > best[open_, -1]) | (self.first[block] < names[open_, -1])
            for b in np.unique(block[wanted]):
                at = open_[wanted & (block == b)]
                part = slice(self.starts[b], self.ends[b])
                scores = queries[at] @ index[part].T
                scores[self.ids[part][None, :] == ids[at][:, None]] = none
                scores[scores < np.maximum(best[at, -1], start[at])[:, None]] = none
                hit = (scores > none).any(axis=1)
                at, scores = at[hit], scores[hit]
                if not len(at):
                    continue
                found, named = np.hstack([best[at], scores]), np.hstack([names[at], np.broadcast_to(self.ids[part], scores.shape)])
                named[found == none] = np.iinfo(np.int64).max
                top = np.lexsort((named, -found), axis=1)[:, :k] if exact else np.lexsort((named, ~found), axis=1)[:, :k]
                best[at], names[at] = np.take_along_axis(found, top, axis=1), np.take_along_axis(named, top, axis=1)
        query, column = np.nonzero(best > none)
        return ids[query], names[query, column], best[query, column].astype(np.int64)


def top_k(df: DataFrame, *, k: int = 20, query_modulus: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", range_size: int = RANGE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest integer inner product, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates are all rows but those with the query's id. That is
    the stated query set against all rows, in blocks: queries are written in groups to the shared folder, candidates are dealt
    once into ranges of ``range_size`` vector components, fewer where tasks would be left without any, and each range's task reads one group of queries after another. There
    each query takes the blocks in order of the sum of its terms' maxima and stops when no bound reaches its kth score; the
    ranges' lists are merged by rank. Where there are several ranges, one of them is searched first, and its kth scores are the
    floors from which all ranges start. Vectors of other lengths count as padded with zeros, empty ones score 0; nulls take no
    part. Rows that repeat an id are candidates each; as a query such an id stands for its smallest integer vector, compared
    from the first component on. Few rows give short lists, none gives none.
    """
    rows = cut(integer_vectors(df, scale, id_col, vector_col))
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("vec_id") % query_modulus == 0, 1)).alias("asking"), F.max(F.size("vector")).alias("width")).first()
    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism)
    per_range = max(BLOCK, min(range_size // max(1, n.width or 1), -(-n.rows // tasks)))
    queries = cut(rows.where(F.col("vec_id") % query_modulus == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    dealt = _dealt(rows, per_range, n.rows)
    if n.rows > per_range:
        dealt = cut(dealt)  # one range is read by itself before all are

    def searched(candidates: DataFrame, floors: DataFrame | None) -> DataFrame:
        folder = new_folder(df.sparkSession, "queries")
        asked = queries.withColumn("floor", F.lit(None).cast("double")) if floors is None else queries.join(floors, "vec_id", "left")
        _write_queries(cut(asked.select("vec_id", "vector", "floor")), n.asking, folder)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, matrix, _ in gathered(batches):
                blocks = Blocks(ids, matrix, k)
                for asking, vectors, floor in _read_queries(folder):
                    found = blocks.search(asking, vectors, floor, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        return candidates.mapInArrow(lean(search), "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    floors = None
    if n.rows > per_range:
        # a floor is a double; scores beyond its whole numbers get none, and are searched without
        kth = ranked(searched(dealt.where("g = 0"), None)).where((F.col("rank") == k) & (F.abs("score") < F.lit(1 << 53)))
        floors = kth.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    return ranked(searched(dealt, floors)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
