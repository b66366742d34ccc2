"""Secret scans: fixed patterns plus guess-cost segmentation of values that stand in a credential context."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.llm.lean import lean
from mitoloom.llm.shared import pick, stored
from mitoloom.llm.words import pieces

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Contexts whose value is weighed by its guess cost: wider than ASSIGN in names, separators and characters.
CONTEXT = re.compile(r"""(?:password|passwd|pass_?phrase|pwd|secret|token|api_?key|auth_?key|credentials?)["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*["'`]?([^\s"'`<>,;]{6,})""", re.IGNORECASE | re.ASCII)
HINT = re.compile(r"pass|pwd|secret|token|api_?key|auth_?key|credential", re.IGNORECASE | re.ASCII)
#: Repeat units longer than this many characters are not sought as such; shorter pieces of them are.
SPAN = 128
#: Log10 of the guesses from which a value counts as a secret.
STRONG = 8.0
#: A value of letters alone is made of plain words, also ones that are not ranked, if its letters follow one another as those of words
#: do: at most NATURAL digits each, by how often one letter follows another in the ranked words, no more than CONSONANTS consonants in a
#: row, and one vowel in VOWELS letters or more.
NATURAL, CONSONANTS, VOWELS = 1.5, 4, 5
PLAIN = re.compile(r"[^\W\d_]+(?:(?:[-'’._/:]|\(\))[^\W\d_]+)*[-_./:()]*[.!?:)\]}…]*")
PART = re.compile(r"[^\W\d_]+")
HUMP = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
RUN = re.compile(rf"[bcdfghjklmnpqrstvwxzçñß]{{{CONSONANTS + 1},}}")
VOWEL = re.compile(r"[aeiouyà-æè-ïò-öù-ýœ]|[^a-zà-ÿœ]")
#: Values up to this long are remembered with their cost.
SHORT = 64
#: Words that are ranked by how often the corpus has them, and documents that must have a word for that.
MOST_WORDS, LEAST_DOCS = 50_000, 5

# Common words in passwords, most common first.
COMMON = "password letmein welcome monkey dragon master admin login qwerty iloveyou sunshine princess football baseball shadow superman michael jordan hunter secret summer winter spring autumn flower hello freedom whatever trustno test guest root user default changeme pass love god money cookie orange banana cheese coffee computer internet server database example sample token access key".split()
ENGLISH = "the and for are but not you all any can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use this that with have from they know want been good much some time very when come here just like long make many more only over such take than them well were what your which their about would there could other after first never these think where being every great might shall still those under while house world right place again water light night point thing north south east west blue green red black white".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301578$@!", "aeolstbsai")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:1[0-2]|0?[1-9])[-/.]?(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])[-/.]?(?:1[0-2]|0?[1-9])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
NEXT = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {(a, b) for up, low in zip(KEYBOARD[1:], KEYBOARD[2:]) for i, b in enumerate(low) for j in (i, i + 1) if j < len(up) for a, b in ((up[j], b), (b, up[j]))}


class Ranks:
    """Words by rank, most common first, to be found in values all at once; and how letters follow one another in them."""

    def __init__(self, words: Iterable[str]):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for w in words if len(w) >= 3))}
        self.found = ahocorasick.Automaton()
        for w, r in self.rank.items():
            self.found.add_word(w, (len(w), r))
        if self.rank:
            self.found.make_automaton()
        self.after: dict[str, int] = {}
        self.pairs: dict[str, int] = {}
        for w in self.rank:
            for x, y in pairwise(f" {w} "):
                self.after[x] = self.after.get(x, 0) + 1
                self.pairs[x + y] = self.pairs.get(x + y, 0) + 1
        self.cost = lru_cache(maxsize=20_000)(self._cost)

    def surprise(self, word: str) -> float:
        """Digits a letter of a word costs when the one before it is known; unseen pairs count as half of one that was seen once."""
        steps = list(pairwise(f" {word} "))
        return sum(math.log10((self.after.get(x, 0) + 15) / (self.pairs.get(x + y, 0) + 0.5)) for x, y in steps) / len(steps)

    def is_plain(self, value: str) -> bool:
        """Whether a value is words of plain text, also ones that are not ranked."""
        if not PLAIN.fullmatch(value):
            return False
        return all(self._like_a_word(w) and (w == part or len(w) > 3 or w.lower() in self.rank) for part in PART.findall(value) for w in HUMP.split(part))

    def _like_a_word(self, word: str) -> bool:
        low = word.lower()
        if low in self.rank:
            return True
        shape = word.islower() or word.isupper() or word.istitle()
        return shape and (len(low) <= 3 or (len(VOWEL.findall(low)) * VOWELS >= len(low) and not RUN.search(low) and self.surprise(low) <= NATURAL))

    def guess_cost(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        """(log10 of guesses, segments) of the cheapest segmentation of a value; see _cost."""
        return self.cost(value) if len(value) <= SHORT else self._cost(value)

    def strong(self, value: str) -> bool:
        return not self.is_plain(value) and self.guess_cost(value)[0] >= STRONG

    def _words(self, low: str, plain: str, capitals: list[int]) -> Iterator[tuple[int, int, float]]:
        """(start, end, cost) of ranked words, also in leet; each capital beyond a first costs a factor of two, unless all are."""
        if not self.rank:
            return
        for text, more in ((low, 0.0), (plain, math.log10(2))) if plain != low else ((low, 0.0),):
            for last, (size, rank) in self.found.iter(text):
                start, end = last + 1 - size, last + 1
                if not more or low[start:end] != plain[start:end]:
                    upper = capitals[end] - capitals[start]
                    yield start, end, math.log10(rank) + more + (0.3 if upper else 0) + max(0, upper - 1) * 0.3 * (upper < size)

    def _cost(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        """best[j] is the least sum of log10 costs over segmentations of value[:j]; spans are ranked words (also in leet and with
        capitals), dates, the longest repeats of a unit and keyboard walks, and single brute-force characters, which the last step
        joins. Each further span costs a factor of two, for its kind and place. Work and memory are linear in the length; an
        empty value costs 0.
        """
        n, low = len(value), value.lower()
        if len(low) != n:  # a letter whose small form is two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        spans: dict[int, list[tuple[int, float, str]]] = {}
        brute = [0.0, *accumulate(map(_brute, value))]
        for i, j, cost in self._words(low, low.translate(LEET), [0, *accumulate(map(str.isupper, value))]):
            spans.setdefault(j, []).append((i, cost, "word"))
        for i, j, digits in _dates(value):
            spans.setdefault(j, []).append((i, math.log10(365.25 * 120 if j - i > 4 else 120) + (0 if digits else 0.6), "date"))
        for i, j, unit in _repeats(value):
            spans.setdefault(j, []).append((i, brute[i + unit] - brute[i] + math.log10((j - i) / unit), "repeat"))
        for i, j in _walks(low):
            spans.setdefault(j, []).append((i, math.log10(47 * 4 * (j - i)), "walk"))
        best, via = [0.0] * (n + 1), [(0, "")] * (n + 1)
        two = math.log10(2)
        for j in range(1, n + 1):
            i = j - 1
            total, at = best[i] + brute[j] - brute[i] + (two if i and via[i][1] != "brute" else 0), (i, "brute")
            for i, cost, kind in spans.get(j, ()):
                other = best[i] + cost + (two if i else 0)
                if other < total:
                    total, at = other, (i, kind)
            best[j], via[j] = total, at
        out, j = [], n
        while j:
            i, kind = via[j]
            if out and kind == "brute" == out[-1][0]:
                out[-1] = (kind, i, out[-1][2])
            else:
                out.append((kind, i, j))
            j = i
        return best[n], tuple(reversed(out))


def _brute(char: str) -> float:
    return math.log10(10 if char.isdigit() else 26 if char.isalpha() and char.isascii() else 33 if char.isascii() else 100)


def _dates(value: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, of digits alone) of the longest date at each place."""
    for m in re.finditer(r"\d", value):
        if found := DATE.match(value, m.start()):
            yield found.start(), found.end(), found.group().isdigit()


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, unit) of each longest stretch that goes on as it began: two units or more, and three characters.

    A stretch is found under its smallest unit alone, so that one character repeated is one stretch, not one for each unit.
    """
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, known = len(codes), set()
    for unit in range(1, min(SPAN, n // 2) + 1):
        alike = np.concatenate([[False], codes[unit:] == codes[:-unit], [False]])
        edges = np.flatnonzero(alike[1:] != alike[:-1])
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + unit).tolist(), strict=True):
            if b - a >= max(2 * unit, 3) and (a, b) not in known:
                known.add((a, b))
                yield a, b, unit


def _walks(low: str) -> Iterator[tuple[int, int]]:
    """The longest stretches of three characters or more that are neighbours on a keyboard, or in the alphabet or the digits."""
    start = 0
    for j in range(1, len(low) + 1):
        x, y = low[j - 1], low[j : j + 1]
        if y and ((x, y) in NEXT or (abs(ord(y) - ord(x)) == 1 and y.isalnum() and x.isalnum())):
            continue
        if j - start >= 3:
            yield start, j
        start = j


#: The words that are ranked where no corpus is at hand.
WORDS = Ranks(COMMON + ENGLISH)


def guess_cost(value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """(log10 of guesses, segments) of the cheapest segmentation of a value, by the fixed words alone."""
    return WORDS.guess_cost(value)


def corpus_words(df: DataFrame, *, text_col: str = "text", most: int = MOST_WORDS, least_docs: int = LEAST_DOCS) -> list[str]:
    """The ``most`` words of 3 to 20 letters that most rows hold, ``least_docs`` at least.

    Values in a credential context are left out, so that a secret that is often copied does not become a word. Counts are over
    all rows; of words that as many rows hold, all are taken or none, so that ``most`` words reach the driver at most.
    """
    plain = F.when(F.col("text").rlike(f"(?i){HINT.pattern}"), F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")).otherwise(F.col("text"))
    words = pick(df, text=text_col).where("text IS NOT NULL").select(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+"), 0).alias("words"))
    counted = words.select(F.explode(F.array_distinct("words")).alias("word")).where(F.length("word").between(3, 20)).groupBy("word").agg(F.count("*").alias("n"))
    counted = stored(counted.where(F.col("n") >= least_docs), "words")
    # the least count from which there are no more than ``most`` words: a row for each different count is summed from the top
    upto = F.sum("words").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto)
    least = levels.where(F.col("upto") <= most).agg(F.min("n").alias("n")).first()["n"]
    chosen = counted.where(F.col("n") >= least).collect() if least is not None else []
    return [r["word"] for r in sorted(chosen, key=lambda r: (-r["n"], r["word"]))]


def find_secrets(text: str, ranks: Ranks = WORDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; base kinds are leftmost matches that do not overlap within a kind."""
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if HINT.search(text):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        taken = sorted((a, b) for _, a, b in spans)
        furthest = list(accumulate((b for _, b in taken), max))
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            before = bisect_right(taken, (a, len(text) + 1))
            if not (before and furthest[before - 1] >= b) and ranks.strong(text[a:b]):
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, kinds and places as an array.

    Every whole text is read; a null text counts as empty and has no spans (base_sha256 is then that of the empty string).
    Places are code points, ends exclusive. Repeated rows each give their row. Values in a credential context are weighed by the
    fixed words and, behind them, ``words``: those of the texts themselves (see corpus_words) unless given. The scan is a map
    over rows without a shuffle, and batches are cut by bytes, so that very long texts come alone.
    """
    ranked = [*COMMON, *ENGLISH, *(corpus_words(df, text_col=text_col) if words is None else words)]
    spread = df.sparkSession.sparkContext.broadcast(ranked)
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        for batch in pieces(batches):
            ranks = ranks or Ranks(spread.value)
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found")}
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                spans = find_secrets(text, ranks)
                kinds = [s[0] for s in spans]
                for kind in KINDS:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "guess").encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                out["found"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_assign", "n_access", "n_hex")), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["n_guess"], pa.int64()), pa.array(out["found"], found)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "found"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lean(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, found array<struct<kind:string,start:long,end:long>>")


def _any_case(pattern: str) -> str:
    """The pattern with a class of both cases for each letter outside of a class: RE2's own flag folds letters beyond ASCII too."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in pattern)


_NAMES = _any_case("(password|passwd|secret|token|api_?key)")
#: kind, pattern, least characters of the whole match, least characters of its value.
_BASE = [("assign", _NAMES + "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 0, 12), ("access", "(AKIA)([A-Z0-9]+)", 18, 0), ("hex", "()([0-9a-f]+)", 16, 0)]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, {whole} AS whole, {value} AS value, '{pattern}' AS p, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d" for i, (kind, pattern, whole, value) in enumerate(_BASE))
#: A match starts behind all pieces between matches, and all matches, before it.
BASE_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND.replace("SELECT doc_id", "SELECT row, doc_id")}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f),
s AS (SELECT row, k, kind, ms[i] AS m, whole, value, p,
  list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a FROM e),
g AS (SELECT row, k, kind, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM s WHERE length(m) >= whole AND (value = 0 OR length(regexp_extract(m, p, 2)) >= value)),
j AS (SELECT row, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, count(CASE k WHEN 0 THEN 1 END) AS n0, count(CASE k WHEN 1 THEN 1 END) AS n1, count(CASE k WHEN 2 THEN 1 END) AS n2 FROM g GROUP BY row)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN j ON j.row = d.row
"""
