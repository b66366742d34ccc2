"""Toxicity: a non-negative positive-unlabelled linear classifier over words and their parts (Kiryo et al., 2017)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import bucket, pick
from mitoloom.llm.words import WordTable, pieces, ranges

PUNCTUATION = re.compile(r"^[\W_]+|[\W_]+$")
#: Bits of a feature's hash; features of a word are itself, its first 4 to 6 letters and its inner 5-grams.
FEATURE_BITS = 20


def word_features(word: str) -> list[int]:
    word = PUNCTUATION.sub("", word)
    if not word:
        return []
    names = {f"={word}"} | {f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n} | {word[i : i + 5] for i in range(1, len(word) - 4)}
    return [xxhash.xxh64_intdigest(n) >> (64 - FEATURE_BITS) for n in names]


class TextFeatures:
    """The distinct features of each text of a batch: (text, feature) pairs, in order of the text.

    With ``only``, a sorted list of features, the others are left out; then most words have none and drop out early.
    """

    def __init__(self, only: np.ndarray | None = None):
        self.known: dict[str, tuple[int, ...]] = {}
        self.only = None if only is None else frozenset(only.tolist())

    def _of(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        return tuple(found if self.only is None else [f for f in found if f in self.only])

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        table = WordTable(texts, lower="utf8")
        if len(self.known) > 100_000:
            self.known.clear()
        known = self.known
        lists = [known[w] if w in known else known.setdefault(w, self._of(w)) for w in table.vocabulary]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.array([f for x in lists for f in x], dtype=np.int64)
        bearing = sizes[table.codes] > 0 if len(sizes) else np.zeros(0, dtype=bool)
        text = np.repeat(np.arange(len(table.counts)), table.counts)[bearing]
        words = np.unique(text * np.int64(max(1, len(sizes))) + table.codes[bearing])
        text, words = words // max(1, len(sizes)), words % max(1, len(sizes))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        both = np.unique((np.repeat(text, sizes[words]) << FEATURE_BITS) | flat[ranges(starts[words], sizes[words])])
        return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        if not len(self.features):
            return np.full(n, _sigmoid(np.array(self.bias)))
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        return _sigmoid(np.bincount(text[hit], self.weights[at[hit]], n) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative positive-unlabelled risk, with the logistic loss.

    Risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]). Where the second term, an estimate of the
    negatives' risk, falls below -slack, the step goes against it instead, so that it cannot be driven below zero by overfitting.
    Full batches, Adam; no randomness.
    """
    d = positive.shape[1]
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        w = theta[:d].astype(positive.dtype)
        sp, su = _sigmoid(positive @ w + theta[d]), _sigmoid(unlabelled @ w + theta[d])
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        back = lambda x, g: np.r_[g.astype(x.dtype) @ x, g.sum()] / len(g)
        g_negative = back(unlabelled, su) - prior * back(positive, sp)
        g = prior * back(positive, sp - 1) + g_negative if negative >= -slack else -g_negative
        g[:d] += decay * theta[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], float(theta[d])


def train(df: DataFrame, labels: DataFrame, *, most_positive: int = 3000, most_unlabelled: int = 9000, most_features: int = 600, least_texts: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int = 5) -> Model:
    """Fits on at most ``most_positive`` confirmed and ``most_unlabelled`` other texts, chosen by a hash of the id.

    Only rows outside the held-out fifth are used. The class prior is the share of confirmed rows among all labelled ones there.
    The sample's features are made on the executors; of those in ``least_texts`` positive texts or more, the ``most_features``
    whose share differs most between the two samples (in standard errors) enter the classifier. Without confirmed rows or
    without others the model scores everything alike, at the prior (0 without labels).
    """
    marks = pick(labels, doc_id=id_col, label=label_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("label IS NOT NULL AND doc_id IS NOT NULL").where(bucket(F.col("doc_id"), holdout) != 0)
    marks = marks.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    prior = float(np.clip(seen.p / max(1, seen.n), 1e-3, 0.5)) if seen.p else 1e-6
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").where(bucket(F.col("doc_id"), holdout) != 0)
    confirmed = marks.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive).select("doc_id", F.lit(True).alias("sure"))
    others = rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_unlabelled).select("doc_id", F.lit(False).alias("sure"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TextFeatures()
        for batch in pieces(batches, limit=1 << 20):
            text, feature = maker.pairs(batch.column("text"))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("sure"), pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["sure", "features"])

    # both id lists are bounded by the two parameters
    sample = rows.join(F.broadcast(confirmed.unionByName(others)), "doc_id").select("text", "sure").mapInArrow(lean(featurise), "sure boolean, features binary")
    sets: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for row in sample.toLocalIterator():
        sets[row.sure].append(np.frombuffer(row.features, "<u4"))
    sets = {k: sorted(v, key=lambda x: x.tobytes()) for k, v in sets.items()}
    if not sets[True] or not sets[False]:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    counts = {k: np.bincount(np.concatenate(v), minlength=1 << FEATURE_BITS) for k, v in sets.items()}
    p, u = counts[True] / len(sets[True]), counts[False] / len(sets[False])
    error = np.sqrt((p * (1 - p) + 1e-4) / len(sets[True]) + (u * (1 - u) + 1e-4) / len(sets[False]))
    z = np.where(counts[True] >= least_texts, np.abs(p - u) / error, 0)
    features = np.sort(np.argsort(-z, kind="stable")[:most_features])
    features = features[z[features] > 3]

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(features)), dtype=np.float32)
        for i, r in enumerate(rows):
            out[i] = np.isin(features, r, assume_unique=True)
        return out

    weights, bias = fit_nnpu(dense(sets[True]), dense(sets[False]), prior)
    return Model(features.astype(np.int64), weights, bias, prior)


def score_toxicity(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holdout: int = 5, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Trains first (see train), then maps over every whole text.

    held_out: crc32 of the id's decimal text is divisible by ``holdout`` (false for null ids). Null and empty texts get the
    model's bias as their score. Rows that repeat an id each get a row.
    """
    model = train(df, labels, id_col=id_col, text_col=text_col, holdout=holdout, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TextFeatures(model.features)
        for batch in pieces(batches, limit=2 << 20):
            scores = model.scores(*maker.pairs(batch.column("text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("held_out", bucket(F.col("doc_id"), holdout) == 0).mapInArrow(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """df's rows, in df's columns, whose score is below ``least``. A map over rows: each is judged by its own text."""
    model = train(df, labels, id_col=id_col, text_col=text_col, **options)
    names, text_at = df.columns, df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TextFeatures(model.features)
        for batch in pieces(batches, text=names[text_at], limit=2 << 20):
            yield batch.filter(pa.array(model.scores(*maker.pairs(batch.column(text_at)), batch.num_rows) < least))

    return df.mapInArrow(lean(keep), df.schema)
