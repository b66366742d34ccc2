"""Benchmark decontamination: rare words of test items as seeds join them to passages, Smith-Waterman scores what may reach the bound."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import cut, pick, unused
from mitoloom.llm.words import pieces, ranges
from mitoloom.operators.ordered import running

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the items that are sought in one pass over the texts, and bytes of text that are searched together.
BLOCK_WORDS, PIECE = 1_000_000, 8 << 20
#: What it costs to look at a window, in postings of a seed.
WINDOW_COST = 100.0


class PlainWords:
    """Words of each text in lower case, of letters and digits alone; words without any are dropped."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.vocabulary = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{N}]+", "")
        codes = coded.indices.to_numpy()
        kept = pc.not_equal(self.vocabulary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, dtype=bool)
        self.codes = codes[kept]
        self.offsets = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def words(self, text: int, low: int, high: int) -> str:
        a = self.offsets[text]
        return " ".join(self.vocabulary.take(pa.array(self.codes[a + low : a + high])).to_pylist())

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, number among ``words``) of the words that are among them, in order."""
        number = pc.fill_null(pc.index_in(self.vocabulary, value_set=words), -1).to_numpy()
        token = number[self.codes] if len(number) else np.zeros(0, np.int32)
        at = np.flatnonzero(token >= 0)
        text = np.searchsorted(self.offsets, at, side="right") - 1
        return text, at - self.offsets[text], token[at].astype(np.int64)


@dataclass
class Bounds:
    """What an alignment of an item must have to score enough: so many of the item's words, within so many words of the text."""

    words: int
    window: int

    @classmethod
    def of(cls, n: int, least: float) -> Bounds:
        """k matches less the gaps and mismatches among them score 2 * k - g, which must be least * 2n: so k >= least * n, and at most
        2n * (1 - least) further words of the text lie between them."""
        return cls(max(1, math.ceil(least * n - 1e-9)), n + math.floor(2 * n * (1 - least) + 1e-9))


def _tail(rate: float, least: int) -> float:
    """P(X >= least) for a Poisson variable."""
    below, term = 0.0, math.exp(-rate)
    for k in range(least):
        below += term
        term *= rate / (k + 1)
    return max(0.0, 1 - below)


def seeds_of(words: Counter, bounds: Bounds, frequency: dict[str, float]) -> tuple[int, list[str]]:
    """(j, the item's rarest words): words such that no alignment that scores enough has fewer than j of them.

    All but ``bounds.words - j`` of the item's words, counted as often as they occur, hold at least j of any bounds.words of them.
    More words meet more often by chance, and several must meet in one window; j is where the work expected of both is least.
    """
    order = sorted(words, key=lambda w: (frequency.get(w, 0.0), w))
    n, chosen, held, rate = sum(words.values()), [], 0, 0.0
    best: tuple[float, int, int] | None = None
    for j in range(1, bounds.words + 1):
        while held < n - bounds.words + j:
            word = order[len(chosen)]
            chosen.append(word)
            held += words[word]
            rate += frequency.get(word, 0.0)
        cost = rate + WINDOW_COST * _tail(rate * bounds.window, j) / bounds.window
        if best is None or cost < best[0]:
            best = (cost, j, len(chosen))
        if rate > best[0]:
            break
    return best[1], chosen[: best[2]]


class Items:
    """A block of items, ready to be looked for: words by number, seeds' items, and how often each item has each of its words."""

    def __init__(self, rows: list[tuple[int, int, str]], width: int, least: float, frequency: dict[str, float] | None = None):
        self.ids, self.texts = [r[1] for r in rows], [r[2] for r in rows]
        counts = [Counter(t.split()) for t in self.texts]
        vocabulary = sorted({w for c in counts for w in c})
        self.words = pa.array(vocabulary, pa.string())
        if frequency is None:
            return
        number = {w: i for i, w in enumerate(vocabulary)}
        sizes = [sum(c.values()) for c in counts]
        bounds = [Bounds.of(n, 1.0 if n < width else least) for n in sizes]
        self.needed, self.window = (np.array([getattr(b, k) for b in bounds], np.int64) for k in ("words", "window"))
        found = [seeds_of(c, b, frequency) for c, b in zip(counts, bounds, strict=True)]
        self.together = np.array([j for j, _ in found], np.int64)
        pairs = sorted((number[w], i) for i, (_, seeds) in enumerate(found) for w in seeds)
        self.seed_items = np.array([i for _, i in pairs], np.int64)
        self.seed_offsets = np.searchsorted([w for w, _ in pairs], np.arange(len(vocabulary) + 1))
        own = sorted((i * len(vocabulary) + number[w], n) for i, c in enumerate(counts) for w, n in c.items())
        self.own, self.times = np.array([k for k, _ in own], np.int64), np.array([n for _, n in own], np.int64)

    def passages(self, text: np.ndarray, pos: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, first place, last place) of the passages that may hold an item, from the items' words in texts, in order.

        First, where enough of the item's seeds lie within a window, everything that a window around them reaches; what overlaps is one
        passage. Of these stay the ones that have, in some window, enough of all the item's words.
        """
        counts = self.seed_offsets[word + 1] - self.seed_offsets[word]
        item = self.seed_items[ranges(self.seed_offsets[word], counts)]
        at = np.repeat(np.arange(len(word)), counts)
        key = text[at] * len(self.ids) + item
        order = np.argsort(key, kind="stable")
        key, item, place = key[order], item[order], pos[at][order]
        last = np.arange(len(key)) + self.together[item] - 1
        near = np.flatnonzero(last < len(key))
        near = near[(key[last[near]] == key[near]) & (place[last[near]] - place[near] < self.window[item[near]])]
        if not len(near):
            return (np.zeros(0, np.int64),) * 4
        key, item, reach = key[near], item[near], self.window[item[near]]
        low, high = np.maximum(place[last[near]] - reach + 1, 0), place[near] + reach - 1
        # low and high both grow with the place within a key
        fresh = np.r_[True, (key[1:] != key[:-1]) | (low[1:] > high[:-1] + 1)]
        starts = np.flatnonzero(fresh)
        key, item, low, high = key[starts], item[starts], low[starts], high[np.r_[starts[1:], len(high)] - 1]
        enough = self._most_words(text, pos, word, key // len(self.ids), item, low, high) >= self.needed[item]
        return key[enough] // len(self.ids), item[enough], low[enough], high[enough]

    def _most_words(self, text: np.ndarray, pos: np.ndarray, word: np.ndarray, of: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each passage, the most of the item's words that a window of it has, each counted as often as the item has it at most."""
        line = text * (np.int64(1) << 40) + pos
        begin, end = np.searchsorted(line, of * (np.int64(1) << 40) + low), np.searchsorted(line, of * (np.int64(1) << 40) + high, side="right")
        passage, token = np.repeat(np.arange(len(of)), end - begin), ranges(begin, end - begin)
        wanted = item[passage] * len(self.words) + word[token]
        at = np.minimum(np.searchsorted(self.own, wanted), len(self.own) - 1)
        held = self.own[at] == wanted
        passage, place, wanted, times = passage[held], pos[token[held]], word[token[held]], self.times[at[held]]
        order = np.lexsort((place, wanted, passage))
        passage, place, wanted, times = passage[order], place[order], wanted[order], times[order]
        # a word counts in the windows that begin behind the place where it had come as often as the item has it
        earlier = np.arange(len(place)) - times
        back = np.maximum(earlier, 0)
        full = (earlier >= 0) & (passage[back] == passage) & (wanted[back] == wanted)
        first = np.maximum(np.where(full, place[back], -1), place - self.window[item[passage]]) + 1
        edge, change, whose = np.concatenate([first, place + 1]), np.repeat([1, -1], len(place)), np.concatenate([passage, passage])
        order = np.lexsort((change, edge, whose))
        level = np.cumsum(change[order])
        out = np.zeros(len(of), np.int64)
        np.maximum.at(out, whose[order], level)  # each passage's changes sum to 0
        return out


def smith_waterman(items: list[list[str]], texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of it in the text) of each pair of word lists, all pairs at once.

    Row by row over the items' words; a row's horizontal gaps are a running maximum, as the gap cost is linear.
    """
    codes: dict[str, int] = {}
    number = lambda words: [codes.setdefault(w, len(codes)) for w in words]
    wide, deep = max(map(len, texts), default=0), max(map(len, items), default=0)
    x, y = np.full((len(items), deep), -1), np.full((len(texts), wide), -2)
    for i, (a, b) in enumerate(zip(items, texts, strict=True)):
        x[i, : len(a)], y[i, : len(b)] = number(a), number(b)
    score, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    steps = -GAP * np.arange(wide + 1)
    h = np.zeros((len(items), wide + 1), np.int64)
    for k in range(deep):
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(y == x[:, k : k + 1], MATCH, MISMATCH), h[:, 1:] + GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps, axis=1) - steps, 0)
        h = np.where((x[:, k] >= 0)[:, None], new, h)
        best = h.argmax(axis=1)
        top = h[np.arange(len(h)), best]
        better = (top > score) & (x[:, k] >= 0)
        score[better], end[better] = top[better], best[better]
    return score, end


def item_texts(items: DataFrame) -> DataFrame:
    """(item, item_id, words) of each different item; ``item`` tells items apart, also of one id."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            table = PlainWords(batch.column("text"))
            words = pa.array([table.words(i, 0, int(n)) for i, n in enumerate(table.counts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), words], names=["item_id", "words"])

    texts = items.mapInArrow(lean(plain), "item_id long, words string").where("words <> ''").distinct()
    return texts.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def word_frequencies(rows: DataFrame, words: pa.Array) -> dict[str, float]:
    """The share of all words of all texts that each of ``words`` makes up; the driver gets a number a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(words), np.int64), 0
        for batch in pieces(batches, limit=PIECE):
            table = PlainWords(batch.column("text"))
            total += len(table.codes)
            seen += np.bincount(table.known(words)[2], minlength=len(words))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], total])], names=["word", "n"])

    sums = {r["word"]: r["n"] for r in rows.select("text").mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}
    total = max(1, sums.pop(-1, 1))
    names = words.to_pylist()
    return {names[w]: n / total for w, n in sums.items()}


def candidates(rows: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, item_words, words, start) of the passages that may hold an item of the block."""
    spread = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = spread.value
        for batch in pieces(batches, limit=PIECE):
            table = PlainWords(batch.column("text"))
            text, item, low, high = block.passages(*table.known(block.words))
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text)), pa.array([block.ids[i] for i in item], pa.int64()), pa.array([block.texts[i] for i in item], pa.string()), pa.array([table.words(int(t), int(a), int(b) + 1) for t, a, b in zip(text, low, np.minimum(high, table.counts[text] - 1), strict=True)], pa.string()), pa.array(low)],
                    names=["doc_id", "item_id", "item_words", "words", "start"],
                )

    return rows.select("doc_id", "text").mapInArrow(lean(search), "doc_id long, item_id long, item_words string, words string, start long")


def contaminated(df: DataFrame, items: DataFrame, *, width: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that a passage of the document copies: doc_id, item_id, score, start, end.

    Words are compared in lower case, as letters and digits alone. Score is the best local alignment's score over that of a full match
    (1: the whole item, word for word); pairs of ``least`` or more are returned, the best place each (the first of equal ones), as
    word positions with an exclusive end. Nothing is lost on the way there: seeds are an item's rarest words in the corpus, as
    many as no alignment of that score can do without (see seeds_of). Copies with a word put in behind each word, which keep no two
    words in a row, are found like others.

    Items go in blocks of ``block_words`` words (more by less than an item), each block through the texts twice: to count its words,
    and to look for its items. A block is all that is broadcast or known to the driver.

    Null or empty texts and items match nothing; an item of fewer than ``width`` words must occur whole. Rows that repeat an id give
    one row together; so do items of one id. Rows with a null id give rows with a null doc_id.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = item_texts(pick(items, item_id=item_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("long")))
    size = F.size(F.split("words", " "))
    blocks = cut(running(texts.withColumn("n", size), size.cast("long"), [F.col("item")], "upto").select("item", "item_id", "words", F.floor((F.col("upto") - F.col("n")) / block_words).alias("block")))
    schema = "doc_id long, item_id long, score double, start long, end long"
    found: DataFrame | None = None
    for number in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        block = sorted((r["item"], r["item_id"], r["words"]) for r in blocks.where(F.col("block") == number).collect())
        frequency = word_frequencies(rows, Items(block, width, least).words)
        part = candidates(rows, Items(block, width, least, frequency))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, text = ([(w or "").split() for w in batch.column(c).to_pylist()] for c in ("item_words", "words"))
            order = sorted(range(len(item)), key=lambda i: (len(text[i]), len(item[i])))
            at = 0
            while at < len(order):
                size = max(1, min(256, 400_000 // (len(text[order[at]]) + 1)))
                some, at = order[at : at + size], at + size
                a, b = [item[i] for i in some], [text[i] for i in some]
                score, end = smith_waterman(a, b)
                share = score / (MATCH * np.array([max(1, len(x)) for x in a]))
                good = [k for k in range(len(some)) if share[k] >= least and (len(a[k]) >= width or share[k] == 1)]
                if not good:
                    continue
                _, back = smith_waterman([a[k][::-1] for k in good], [b[k][: end[k]][::-1] for k in good])
                take = pa.array([some[k] for k in good])
                shift = batch.column("start").take(take).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("item_id").take(take), pa.array(share[good]), pa.array(shift + end[good] - back), pa.array(shift + end[good])], names=["doc_id", "item_id", "score", "start", "end"])

    scored = found.repartition("doc_id", "item_id", "start").mapInArrow(lean(align), schema)
    return scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("best")).select("doc_id", "item_id", "best.score", "best.start", "best.end")


def decontaminate(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the documents that contaminated() finds; rows with a null id stay."""
    held = unused(df, "__found")
    found = contaminated(df, items, id_col=id_col, **options).select(F.col("doc_id").alias(held)).distinct()
    return df.join(found, F.col(id_col).cast("long") == F.col(held), "left_anti")
