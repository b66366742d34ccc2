"""The quality model on held-out rows and by its own sums; both audits against brute force over small tables with all their edges."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mitoloom.llm import divergence, filter_audit, quality

DOCS = "doc_id long, text string, lang string, source string, part string, n string"


def _texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "Éa", "x1y", "The", "日本"]
    out = []
    for _ in range(n):
        size = rng.choice([0, 1, 5, 40, 250])
        text = " ".join(rng.choice(words[: rng.choice([2, 8])]) + (str(rng.randrange(400)) if rng.random() < 0.6 else "") for _ in range(size))
        out.append(rng.choice([text, text.upper(), text + " #", text.replace(" ", "\x0b\n"), "", None]))
    return out


def _documents(rng, n=160):
    texts = _texts(rng, n)
    texts[20:50] = [texts[3]] * 30
    rows = [(i * 7 % n, t, rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", None]), "clash", "n") for i, t in enumerate(texts)]
    return rows + rows[:5] + [(None, texts[3], "en", "s1", "c", "n"), (None, None, None, None, None, None), (5, texts[3], "de", "s2", "c", "n"), (9999, "word " * 60_000, "en", "s1", "c", "n")]


def test_filter_audit_against_brute_force(spark):
    rows = _documents(random.Random(3))
    marks = [(i, q, t, "x") for i, (q, t) in enumerate(itertools.islice(itertools.cycle([(1, 0), (0, 1), (1, 1), (None, None), (0, 0)]), 120))] + [(7, 1, 1, "x"), (None, 1, 1, "x")]
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    label = {i: (int(any(q == 1 for j, q, _, _ in marks if j == i)), int(any(t == 1 for j, _, t, _ in marks if j == i))) for i in range(200)}
    told = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i}
        told[lang or ""].append(("".join(f for f in "ABCDE" if fails[f]), *label.get(i, (0, 0))))
    expected, shapley = {}, Counter()
    for part, docs in told.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                expected[part, order, step] = (len(kept), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
                shapley[part, f] += len(gone)
                left = kept
    df, labels = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_audit(df, labels).collect()}
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for k, r in got.items()} == expected
    assert all(r.shapley == shapley[k[0], k[1][k[2] - 1]] for k, r in got.items())
    assert filter_audit.filter_audit(df.limit(0), labels).count() == 0 and filter_audit.filter_audit(df, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def _divergence(rows, least, smooth, top):
    folded = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    docs, uses, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        terms, key = folded(text), (lang or "", source or "")
        groups.add(key)
        uses.update((*key, t) for t in terms)
        docs.update((key[0], t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (l, t), n in docs.items() if l == lang and n >= least]
        sources = [s for l, s in groups if l == lang]
        share = lambda n, total: 1 + 10**9 * (n + smooth) // (total + smooth * len(kept))
        total = {s: sum(uses[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): share(uses[lang, s, t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(uses[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s, t] - p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s, t] - q[t], t) for t in kept if uses[lang, s, t] and p[s, t] > q[t]]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most], 1)}
    return out


def test_divergence_against_brute_force(spark):
    rows = _documents(random.Random(4), 400)
    rows += [(1, "tie one two", "xx", s, "c", "n") for s in ("a", "b", "c")] * 3 + [(1, "", "none", s, "c", "n") for s in ("a", "b")]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    # of the last, every counter holds several terms: more are counted, and none is lost
    for least, width_bits in ((30, 16), (3, 16), (3, 4)):
        got = [tuple(r) for r in divergence.divergence(df, least_docs=least, top=7, width_bits=width_bits, depth=2).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == _divergence(rows, least, 5, 7)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_sketch_never_underestimates_and_discards(spark):
    rng = random.Random(5)
    words = ["common", "often"] + [f"w{''.join(rng.choices('abcdefgh', k=9))}" for _ in range(3000)]
    rows = [(i, " ".join(["Common"] * 3 + ["often"] * (i % 2) + [words[2 + (i * 5 + j) % 3000] for j in range(12)]), "en", f"s{i % 4}", "", "") for i in range(1200)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    docs = Counter(t for _, text, *_ in rows for t in set(text.lower().split()))
    counters = divergence.document_sketch(df, 30, 4, 14)
    table = divergence._terms(pa.array([" ".join(words)]))
    keys = np.arange(len(table.vocabulary))
    estimate = counters[divergence.Sketch(4, 14).places(table, ["en"], keys)].min(axis=0)
    assert all(e >= min(30, docs[w]) for e, w in zip(estimate, table.vocabulary, strict=True))
    assert (estimate >= 30).sum() < 50 and {r.term for r in divergence.term_counts(df, 30, 4, 14).collect()} >= {"common", "often"}


def test_quality_features_by_hand():
    text = "The The The THE cat! 12 é\n" + "word " * 20
    x = dict(zip(quality.NAMES, quality.text_features(pa.array([text, "", None, " \n", "a"]))[0], strict=True))
    words = text.split()
    close = lambda name, value: abs(x[name] - value) < 1e-5
    assert close("words", np.log1p(27)) and close("distinct", len(set(words)) / 27) and close("top_word", 20 / 27) and close("repeats", 21 / 27) and close("longest_repeat", np.log1p(19))
    assert close("upper", 6 / len(text.encode())) and close("lines", np.log1p(2)) and close("line_repeats", 19 / 20) and close("wordiest_line", np.log1p(20)) and close("word_length", sum(map(len, words)) / 27)
    one = quality.text_features(pa.array(["x y", text, "The The z" * 9]))
    assert np.allclose(one[1], list(x.values())) and np.allclose(quality.text_features(pa.array([None, text, None]).slice(1, 1))[0], one[1])


def test_additive_model_learns_pairs_and_sums_tables():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells anything
    model = quality.fit_additive(x, y, np.ones(4000))
    assert (model.pairs[0][0], model.pairs[0][1]) == (1, 0) and ((model.scores(x) >= 0.5) == y).mean() > 0.97
    single = quality.fit_additive(x, (x[:, 2] > 0.3).astype(float), np.ones(4000), most_pairs=0)
    assert ((single.scores(x) >= 0.5) == (x[:, 2] > 0.3)).mean() > 0.98 and np.ptp(single.tables[3]) < 0.2 * np.ptp(single.tables[2])
    at, row = model.bins(x[:1])[0], 0.0
    for f, table in enumerate(model.tables):
        row += table[at[f]]
    for a, b, table in model.pairs:
        row += table[model.coarse[a][at[a]], model.coarse[b][at[b]]]
    assert np.isclose(model.scores(x[:1])[0], 1 / (1 + np.exp(-(row + model.bias))))


def test_quality_on_held_out_rows_and_edges(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    clean = lambda: ". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(5, 15))).capitalize() for _ in range(rng.randint(2, 40)))
    junk = lambda: rng.choice([lambda: " ".join(w for w in rng.choices(vocabulary, k=9) for _ in range(12)), lambda: clean().upper().replace(" ", "!! "), lambda: clean().replace(" ", "%%% ")])()
    rows = [(i, clean() if i % 3 else junk(), "c", "c") for i in range(900)]
    extra = [(None, clean(), "c", "c"), (4, rows[4][1], "c", "c"), (5000, "", "c", "c"), (5001, None, "c", "c"), (5002, (clean() + "\n") * 3000, "c", "c"), (5003, (junk() + " ") * 300, "c", "c")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, label string, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(900)] + [(4, 1), (None, 0), (9, None)], "doc_id long, quality int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.97
    assert {r.score for r in got if r.doc_id == 5000} == {r.score for r in got if r.doc_id == 5001} and len({r.score for r in got if r.doc_id == 4}) == 1
    assert next(r.predicted for r in got if r.doc_id == 5002) == 1 and not next(r.held_out for r in got if r.doc_id is None)
    again = {(r.doc_id, r.score) for r in quality.score_quality(df.repartition(9), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert {round(r.score, 9) for r in quality.score_quality(df, labels.limit(0)).collect()} == {1e-6} and quality.score_quality(df.limit(0), labels).count() == 0
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
