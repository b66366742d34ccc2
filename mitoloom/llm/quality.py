"""Quality: a generalised additive model with pairwise interactions, boosted in cycles by shallow trees into lookup tables by bins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import bucket, pick
from mitoloom.llm.words import WordTable, pieces

#: Classes of bytes whose shares are features of the text and, the highest of any line, of its lines.
CLASSES = ("upper", "digit", "space", "stop", "loud", "sign", "beyond")
NAMES = ("chars", "words", "word_length", "distinct", "top_word", "repeats", "longest_repeat", "short", "lines", "wordiest_line", *CLASSES, *(f"line_{c}" for c in ("upper", "digit", "loud", "sign", "repeats")))
#: Lines of fewer bytes say nothing of their own.
LEAST_LINE = 40


def _byte_classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    within = lambda chars: np.isin(code, np.frombuffer(chars, np.uint8))
    return {"upper": (code >= 0x41) & (code <= 0x5A), "digit": (code >= 0x30) & (code <= 0x39), "space": within(b" \t\r\n\x0b\x0c"), "stop": within(b".,;:"), "loud": within(b"!?"), "sign": within(b"#$%&*|<>{}[]\\^~@=+_/`"), "beyond": code >= 0x80}


_IN_CLASS = _byte_classes()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _best(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest value of each run of values; 0 for empty runs."""
    out = np.zeros(len(counts))
    if (some := counts > 0).any():
        out[some] = np.maximum.reduceat(values, starts[some])
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """One row a text, one column for each of NAMES, from counts of bytes and words of the whole text and of its lines."""
    texts = pa.concat_arrays([texts.fill_null("")]).cast(pa.string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends -= ends[0]
    size = np.diff(ends)
    # lines: from each text's start, and from behind each line feed
    starts = np.unique(np.concatenate([ends[:-1][size > 0], np.flatnonzero(raw == 0x0A) + 1]))
    starts = starts[starts < len(raw)]
    line_ends = np.append(starts[1:], len(raw))[: len(starts)]
    first_line = np.searchsorted(starts, ends)
    lines, line_size = np.diff(first_line), line_ends - starts
    told = line_size >= LEAST_LINE
    out = dict.fromkeys(NAMES)
    for name in CLASSES:
        upto = np.concatenate([[0], np.cumsum(_IN_CLASS[name][raw], dtype=np.int32)])
        out[name] = _share(np.diff(upto[ends]), size)
        if f"line_{name}" in out:
            out[f"line_{name}"] = _best(np.where(told, _share(upto[line_ends] - upto[starts], line_size), 0), first_line[:-1], lines)
    table = WordTable(texts, lower=None)
    words, codes = table.counts, table.codes
    lengths = np.array([len(w) for w in table.vocabulary], dtype=np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(n), words)
    base = max(1, len(table.vocabulary))
    pairs, times = np.unique(text * np.int64(base) + codes, return_counts=True)
    of = pairs // base
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    # the length of the run of equal words that ends at each word
    place = np.arange(len(codes))
    run = place - np.maximum.accumulate(np.where(same, 0, place)) if len(codes) else place
    upto = np.concatenate([[0], np.cumsum(same)])
    begins = WordStarts(raw, starts, line_ends)
    out["line_repeats"] = _best(np.where(told, _share(upto[begins.last] - upto[begins.first], begins.last - begins.first), 0), first_line[:-1], lines)
    total = lambda values: np.bincount(text, values, n)
    out |= {"chars": np.log1p(size), "words": np.log1p(words), "word_length": _share(total(lengths), words), "distinct": _share(np.bincount(of, minlength=n), words), "short": _share(total(lengths <= 3), words)}
    out["top_word"] = _share(_best(times, np.searchsorted(of, np.arange(n)), np.bincount(of, minlength=n)), words)
    out |= {"repeats": _share(total(same), words), "longest_repeat": np.log1p(_best(run, table.offsets[:-1], words)), "lines": np.log1p(lines)}
    out["wordiest_line"] = np.log1p(_best(begins.last - begins.first, first_line[:-1], lines))
    return np.column_stack([out[name] for name in NAMES]).astype(np.float32)


class WordStarts:
    """Numbers of the words that begin in each line: from ``first`` to before ``last``, counted over all texts of a piece."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, line_ends: np.ndarray):
        inner = ~_IN_CLASS["space"][raw]
        fresh = inner.copy()
        fresh[1:] &= ~inner[:-1]
        fresh[starts[starts < len(raw)]] = inner[starts[starts < len(raw)]]  # a text's first word, right behind another's last
        upto = np.concatenate([[0], np.cumsum(fresh)])
        self.first, self.last = upto[starts], upto[line_ends]


@dataclass
class Additive:
    """score = sigmoid(bias + sum of tables[f][bin of f] + sum of pair tables[bin of a, bin of b])."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        at, total = self.bins(x), np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            total += table[at[:, f]]
        for a, b, table in self.pairs:
            total += table[self.coarse[a][at[:, a]], self.coarse[b][at[:, b]]]
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Steps by bin of a tree over one ordered axis: the cut of largest gain is made again until there are ``leaves`` leaves."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            gl, hl = gs[a + 1 : b] - gs[a], hs[a + 1 : b] - hs[a]
            gr, hr = gs[b] - gs[a] - gl, hs[b] - hs[a] - hl
            gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(gs[b] - gs[a], hs[b] - hs[a], ridge), 0)
            best = max(best, (float(gain.max()), a + 1 + int(gain.argmax())))
        if not best[1]:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out if len(cuts) > 2 else np.zeros(len(g))


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, steps by cell) of a tree of four leaves over two axes: one cut of an axis, then one cut of the other on each side."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    whole = _gain(g.sum(), h.sum(), ridge)
    for turned in (False, True):
        x, y = (g.T, h.T) if turned else (g, h)
        gs, hs = np.cumsum(np.cumsum(x, 0), 1), np.cumsum(np.cumsum(y, 0), 1)
        sides = []
        for gq, hq in ((gs[:-1], hs[:-1]), (gs[-1:] - gs[:-1], hs[-1:] - hs[:-1])):
            rest_g, rest_h = gq[:, -1:] - gq[:, :-1], hq[:, -1:] - hq[:, :-1]
            gain = np.where((hq[:, :-1] >= least) & (rest_h >= least), _gain(gq[:, :-1], hq[:, :-1], ridge) + _gain(rest_g, rest_h, ridge), 0)
            at = gain.argmax(1)
            i = np.arange(len(gain))
            sides.append((gain[i, at], at, gq[i, at] / (hq[i, at] + ridge), rest_g[i, at] / (rest_h[i, at] + ridge)))
        both = np.where((sides[0][0] > 0) & (sides[1][0] > 0), sides[0][0] + sides[1][0] - whole, 0)
        i = int(both.argmax())
        if both[i] > best[0]:
            steps = np.zeros_like(x)
            for rows, (_, at, low, high) in ((slice(0, i + 1), sides[0]), (slice(i + 1, None), sides[1])):
                steps[rows, : at[i] + 1], steps[rows, at[i] + 1 :] = low[i], high[i]
            best = (float(both[i]), steps.T if turned else steps)
    return best


def fit_additive(x: np.ndarray, y: np.ndarray, weights: np.ndarray, *, bins: int = 48, coarse_bins: int = 12, cycles: int = 120, pair_cycles: int = 60, most_pairs: int = 8, leaves: int = 4, rate: float = 0.08, ridge: float = 1.0, least: float = 2.0) -> Additive:
    """Newton boosting of the logistic loss in cycles: one shallow tree for each feature in turn, added to its table.

    Then the pairs whose tree gains most on what the features leave are boosted alike, on coarser bins. Weights sum to the number
    of rows; no randomness, so that equal rows give equal tables.
    """
    share = float(np.clip((weights * y).sum() / weights.sum(), 1e-4, 1 - 1e-4))
    model = Additive(float(np.log(share / (1 - share))))
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T.astype(np.float64)]
    at = model.bins(x)
    width = [len(e) + 1 for e in model.edges]
    model.coarse = [np.arange(w) * min(coarse_bins, w) // w for w in width]
    model.tables = [np.zeros(w) for w in width]
    score = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(score)
        return weights * (y - p), weights * np.maximum(p * (1 - p), 1e-6)

    for _ in range(cycles):
        for f, w in enumerate(width):
            g, h = slopes()
            steps = rate * _tree(np.bincount(at[:, f], g, w), np.bincount(at[:, f], h, w), leaves, ridge, least)
            model.tables[f] += steps
            score += steps[at[:, f]]
    low = [c[at[:, f]] for f, c in enumerate(model.coarse)]
    deep = [int(c[-1]) + 1 for c in model.coarse]
    grid = lambda a, b, v: np.bincount(low[a] * deep[b] + low[b], v, deep[a] * deep[b]).reshape(deep[a], deep[b])
    g, h = slopes()
    gains = [(_pair_tree(grid(a, b, g), grid(a, b, h), ridge, least)[0], -a, -b) for a in range(len(width)) for b in range(a) if deep[a] > 1 and deep[b] > 1]
    chosen = [(-a, -b) for gain, a, b in sorted(gains, reverse=True)[:most_pairs] if gain > 0]
    tables = {c: np.zeros((deep[c[0]], deep[c[1]])) for c in chosen}
    for _ in range(pair_cycles):
        for a, b in chosen:
            g, h = slopes()
            steps = rate * _pair_tree(grid(a, b, g), grid(a, b, h), ridge, least)[1]
            tables[a, b] += steps
            score += steps[low[a], low[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def train(df: DataFrame, labels: DataFrame, *, most_each: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: int = 5, **options) -> Additive:
    """Fits on at most ``most_each`` labelled texts of each label, chosen by a hash of the id, weighed to the labels' true shares.

    Only rows outside the held-out fifth are used; of labels that repeat an id the largest counts. Features are made on the
    executors; only theirs, some dozens of numbers a sampled text, reach the driver. Without both labels the model gives all texts
    the share of label 1 (0 without labels).
    """
    marks = pick(labels, doc_id=id_col, label=label_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("label IS NOT NULL AND doc_id IS NOT NULL").where(bucket(F.col("doc_id"), holdout) != 0)
    marks = marks.groupBy("doc_id").agg(F.max((F.col("label") == 1).cast("int")).alias("label"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")).first()
    chosen = [marks.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_each) for v in (0, 1)]
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.astype("<f4").tobytes() for r in text_features(batch.column("text"))], pa.binary())], names=["label", "features"])

    # 2 * most_each ids
    sample = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "label").mapInArrow(lean(featurise), "label int, features binary")
    found = sorted((r.label, bytes(r.features)) for r in sample.toLocalIterator())
    y = np.array([label for label, _ in found], dtype=np.float64)
    if not found or y.min() == y.max():
        share = float(np.clip(seen.good / max(1, seen.n), 1e-6, 1 - 1e-6))
        return Additive(float(np.log(share / (1 - share))))
    x = np.frombuffer(b"".join(f for _, f in found), "<f4").reshape(len(found), len(NAMES))
    true = np.where(y == 1, seen.good / seen.n, 1 - seen.good / seen.n) / np.where(y == 1, y.mean(), 1 - y.mean())
    return fit_additive(x, y, true * len(y) / true.sum(), **options)


def score_quality(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holdout: int = 5, least: float = 0.3, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (score is ``least`` or more). Trains first (see train).

    held_out: crc32 of the id's decimal text is divisible by ``holdout`` (false for null ids). Null and empty texts are scored as
    texts without words. Rows that repeat an id each get a row. A map over rows: texts are not shuffled, long ones come alone.
    """
    model = train(df, labels, id_col=id_col, text_col=text_col, holdout=holdout, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = model.scores(text_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("held_out", bucket(F.col("doc_id"), holdout) == 0).mapInArrow(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, **options) -> DataFrame:
    """df's rows, in df's columns, whose score is ``least`` or more."""
    model = train(df, labels, id_col=id_col, text_col=text_col, **options)
    names, text_at = df.columns, df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=names[text_at]):
            yield batch.filter(pa.array(model.scores(text_features(batch.column(text_at))) >= least))

    return df.mapInArrow(lean(keep), df.schema)
