"""Language ID: the language family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import bucket, pick
from mitoloom.llm.words import M1, WordTable, mix, pieces

# Families of closely related languages, by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he am mt",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
}
DIMENSIONS, SCALE = 8192, 16


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.lower().split("-")[0] in members.split()), language)


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): hashed character 1- to 4-grams of words set between spaces; words without letters give none."""
    words = [w if any(c.isalpha() for c in w) else "" for w in words]
    text = " " + " ".join(words) + " "
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    space = chars == 32
    owner = np.cumsum(space) - 1
    out_word, out_feature = [], []
    for n in (1, 2, 3, 4):
        if len(chars) < n:
            break
        code = np.zeros(len(chars) - n + 1, dtype=np.uint64)
        for j in range(n):
            code = (code * np.uint64(0x10FFFF + 2) + chars[j : len(chars) - n + 1 + j]) * M1
        inner = np.ones(len(code), dtype=bool)  # a space may stand first or last only
        for j in range(1, n - 1):
            inner &= ~space[j : len(chars) - n + 1 + j]
        inner &= ~(space[: len(code)] & space[n - 1 : n - 1 + len(code)])
        at = np.flatnonzero(inner)
        out_word.append(owner[at])
        out_feature.append((mix(code[at] ^ np.uint64(n)) >> np.uint64(51)).astype(np.int64))
    word = np.concatenate(out_word)
    keep = word < len(words)
    return word[keep], np.concatenate(out_feature)[keep]


class Profiles:
    """Character n-grams by text through the distinct words of a batch."""

    def __init__(self, texts: pa.Array):
        self.table = WordTable(texts, lower="utf8")
        self.word, self.feature = word_ngrams(self.table.vocabulary) if self.table.vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        """Sums over each text's words of a value by dictionary word."""
        flat = np.concatenate([[0.0], np.cumsum(by_word[self.table.codes])]) if len(by_word) else np.zeros(1)
        return flat[self.table.offsets[1:]] - flat[self.table.offsets[:-1]]

    def lengths(self) -> np.ndarray:
        return self.sums(np.bincount(self.word, minlength=len(self.table.vocabulary)).astype(float))

    def dense(self, text: int) -> np.ndarray:
        a, b = self.table.offsets[text], self.table.offsets[text + 1]
        times = np.bincount(self.table.codes[a:b], minlength=len(self.table.vocabulary))
        return np.bincount(self.feature, times[self.word], DIMENSIONS)


@dataclass
class Machine:
    """One linear machine: positive margins speak for ``first``, negative ones for ``second``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def fit_svm(x: np.ndarray, y: np.ndarray, *, penalty: float = 1e-4, epochs: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss, full batches with momentum); y is +1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    step = 0.25
    for _ in range(epochs):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight * y
        gw, gb = penalty * w - 2 * (slack @ x), -2 * slack.sum()
        vw, vb = 0.9 * vw - step * gw.astype(np.float32), 0.9 * vb - step * gb
        w, b = w + vw, b + vb
    return w, float(b)


def vote(names: list[str], machines: list[Machine], margins: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(winner, confidence) by one-versus-one votes, ties by summed margins; a class alone wins with confidence 1."""
    if len(names) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, total, chance = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
    for m, margin in zip(machines, margins, strict=True):
        a, b = names.index(m.first), names.index(m.second)
        p = 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        votes[:, a] += margin >= 0
        votes[:, b] += margin < 0
        total[:, a] += margin
        total[:, b] -= margin
        chance[:, a], chance[:, b] = np.minimum(chance[:, a], p), np.minimum(chance[:, b], 1 - p)
    best = np.argmax(votes + np.tanh(total / 100) / 3, axis=1)
    return best, chance[np.arange(n), best]


def train(df: DataFrame, *, most: int = 700, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", holdout: int = 4, held: int = 2) -> Model:
    """Fits on at most ``most`` texts of each language, chosen by a hash of the id, outside the held-out quarter.

    Profiles (shares of hashed character n-grams, times 16) are made on the executors. Families are voted on by one-versus-one machines between families, languages by machines between the languages of a family.
    """
    rows = pick(df, doc_id=id_col, text=text_col, lang=label_col).withColumns({"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string")})
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(bucket(F.col("doc_id"), holdout) != held)
    found = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            table, out = Profiles(batch.column("text")), []
            for i in range(batch.num_rows):
                counts = table.dense(i)
                at = np.flatnonzero(counts)
                out.append(at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("lot"), pa.array(out, pa.binary())], names=["lang", "lot", "profile"])

    # one pass: a share of each language by the id's hash that gives twice the bound at most, of which the lowest hashes stay
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, 1.5 * most / n) * (1 << 20)) + 1)) for k, n in sorted(found.items())]) if found else F.lit(0)
    sample = rows.where(lot < share).select("lang", lot.alias("lot"), "text").mapInArrow(lean(profile), "lang string, lot long, profile binary")
    by_language: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.toLocalIterator():
        held = by_language.setdefault(row.lang, [])
        held.append((row.lot, row.profile))
        if len(held) > 2 * most:
            by_language[row.lang] = sorted(held)[:most]
    x, y = [], []
    for language, held in sorted(by_language.items()):
        for _, raw in sorted(held)[:most]:
            n = len(raw) // 6
            dense = np.zeros(DIMENSIONS, dtype=np.float32)
            dense[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
            if dense.any():
                x.append(dense * (SCALE / dense.sum()))
                y.append(language)
    families: dict[str, list[str]] = {}
    for language in sorted(set(y)):
        families.setdefault(family_of(language), []).append(language)
    if not x:
        return Model({}, [], {})
    matrix = np.array(x)
    group, lang = np.array([family_of(v) for v in y]), np.array(y)

    def machines(names: list[str], of: np.ndarray) -> list[Machine]:
        out = []
        for a, b in combinations(names, 2):
            use = (of == a) | (of == b)
            out.append(Machine(a, b, *fit_svm(matrix[use], np.where(of[use] == a, 1.0, -1.0).astype(np.float32))))
        return out

    return Model(families, machines(sorted(families), group), {f: machines(members, lang) for f, members in families.items()})


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", holdout: int = 4, held: int = 2, **options) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, family. Trains first (see train), then maps over every whole text.

    held_out: crc32 of the id's decimal text leaves ``held`` modulo ``holdout`` (false for null ids). A text that is null or has
    no letter is ``und`` with score 0, as is every text where nothing could be learned. Rows that repeat an id each get a row.
    The score is the weaker of the family's and the language's confidence.
    """
    model = train(df, id_col=id_col, text_col=text_col, label_col=label_col, holdout=holdout, held=held, **options)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=2 << 20):
            n = batch.num_rows
            table = Profiles(batch.column("text"))
            length = table.lengths()
            margin = lambda m, table=table, length=length: table.sums(np.bincount(table.word, m.weights[table.feature], len(table.table.vocabulary))) * SCALE / np.maximum(length, 1) + m.bias
            lang, family, score = np.full(n, "und", object), np.full(n, None, object), np.zeros(n)
            known = length > 0
            if model.families and known.any():
                names = sorted(model.families)
                best, sure = vote(names, model.between, [margin(m) for m in model.between], n)
                for k, name in enumerate(names):
                    at = np.flatnonzero(known & (best == k))
                    if not len(at):
                        continue
                    members = model.families[name]
                    inner, more = vote(members, model.within[name], [margin(m)[at] for m in model.within[name]], len(at))
                    lang[at], family[at] = np.array(members, object)[inner], name
                    score[at] = np.minimum(sure[at], more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(family, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "family"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("held_out", bucket(F.col("doc_id"), holdout) == held).mapInArrow(lean(predict), "doc_id long, held_out boolean, lang_pred string, score double, family string")
