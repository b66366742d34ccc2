"""Near-duplicate operators against brute force."""

import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from mitoloom.llm import jaccard_join as jj
from mitoloom.llm import line_dedup as ld
from mitoloom.llm import shared
from mitoloom.llm.components import connected_components
from mitoloom.llm.signature_tree import Sets, linked_groups
from mitoloom.llm.words import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, key long, u long"


def groups_of(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def shingles(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
        docs.append(base)
        for _ in range(rng.choice([0, 1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(copy)
    texts = [" ".join(d) for d in docs] + ["", None, "a", "a", "A", "a b", "b a", " \n\t "]
    return [(i, t) for i, t in enumerate(texts)]


def test_shingle_sets_equal_plain_sets():
    texts = [t for _, t in corpus(3)]
    offsets, values = shingle_sets(pa.array(texts, pa.string()), 3)
    assert list(np.diff(offsets)) == [len(shingles(t, 3)) for t in texts]
    got = [set(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    for a, b in combinations(range(len(texts)), 2):
        assert len(got[a] & got[b]) == len(shingles(texts[a], 3) & shingles(texts[b], 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_join_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 8)):
            drop = rng.random(len(base)) < rng.choice([0, 0.02, 0.1])
            sets.append(np.unique(np.where(drop, rng.integers(0, 1 << 63, len(base)).astype(np.uint64), base)))
    plain = [set(s.tolist()) for s in sets]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 10 * len(plain[i] & plain[j]) >= 9 * len(plain[i] | plain[j])]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    labels = linked_groups(Sets(offsets, np.concatenate(sets)), 9, 10)
    expected = groups_of(len(sets), links)
    assert all((labels[i] == labels[j]) == (expected[i] == expected[j]) for i, j in combinations(range(len(sets)), 2))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = groups_of(60, [e for e in edges if None not in e])
    assert got == {n: expected[n] for n in range(60) if any(n in e and e[0] != e[1] and None not in e for e in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("width", "num", "den", "weight"), [(3, 90, 100, 4_000_000), (5, 80, 100, 300)])
def test_jaccard_groups(spark, width, num, den, weight):
    rows = corpus(7)
    links = [(i, j) for (i, a), (j, b) in combinations(rows, 2) if (x := shingles(a, width)) and (y := shingles(b, width)) and den * len(x & y) >= num * len(x | y)]
    expected = groups_of(len(rows), links)
    df = spark.createDataFrame([(i, t, "en", "s", 1, "c", 2, 3) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_groups(df, width=width, num=num, den=den, block_weight=weight).collect()}
    assert got == {i: (len(shingles(t, width)), expected[i]) for i, t in rows}


def test_keep_one_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x"), (3, "x"), (None, None), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in jj.keep_one(df).collect()) == [-1, 1, 3, 4]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jj.keep_one(none).count() == 0 and ld.line_groups(none).count() == 0


def near_pairs(lines):
    """(i, j) of all different lines whose edit distance is a tenth of the longer one's length or less."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE l (i INT, x VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(enumerate(lines)))
    like = "length(a.x) * 10 >= length(b.x) * 9 AND length(b.x) * 10 >= length(a.x) * 9"
    return con.execute(f"SELECT a.i, b.i FROM l a JOIN l b ON a.i < b.i AND {like} WHERE a.x <> b.x AND levenshtein(a.x, b.x) * 10 <= greatest(length(a.x), length(b.x))").fetchall()


def test_line_groups(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(30):
        picked = []
        for _ in range(4):
            line = rng.choice(base).split()
            if rng.random() < 0.5:
                line[rng.randrange(60)] = rng.choice(words)
            picked.append(" ".join(line) + rng.choice(["", "!", " ."]))
        texts.append("\n".join([*picked, "", "hi"]))
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): ((r.group_doc_id, r.group_line_no), r.kept) for r in ld.line_groups(df).collect()}
    norm = {(d, n): " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()) for d, t in enumerate([*texts, ""]) for n, line in enumerate(t.split("\n"))}
    norm = {(k[0] if k[0] < 30 else 31, k[1]): v for k, v in norm.items()}
    unique = sorted({v for v in norm.values() if v})
    links = near_pairs(unique)
    assert links
    label = dict(zip(unique, groups_of(len(unique), links)))
    first = {}
    for at, v in sorted(norm.items()):
        if v in label:
            first.setdefault(label[v], at)
    expected = {at: ((first[label[v]] if v in label else at), first.get(label.get(v), at) == at) for at, v in norm.items()}
    assert got == expected
    cleaned = {r.doc_id: r.text for r in ld.drop_repeated_lines(df).collect()}
    assert cleaned[30] is None and sum(t.count("\n") + 1 for t in cleaned.values() if t is not None) == sum(kept for _, kept in got.values())


def edited(rng, line, words):
    kind, w = rng.randrange(5), line.split()
    at = rng.randrange(len(w))
    if kind == 0:
        w[at] = rng.choice(words)
    elif kind == 1:
        del w[at]
    elif kind == 2:
        w.insert(at, rng.choice(words))
    elif kind == 3:
        w[at] = w[at][::-1]
    else:
        return "".join(rng.choice("xyz") if c != " " and rng.random() < 0.03 else c for c in line)
    return " ".join(w)


def test_recall_against_edit_similarity_alone(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    lines = []
    for _ in range(170):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
        lines += [line, *(edited(rng, line, words) for _ in range(rng.randint(0, 2)))]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_doc_id for r in ld.line_groups(df).collect()}
    near = near_pairs(lines)
    assert len(near) > 100 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    label = groups_of(len(lines), near)
    assert all(label[i] == label[g] or lines[i] == lines[g] for i, g in got.items())  # nothing is linked that is not near


def test_line_groups_of_odd_rows(spark):
    schema = "doc_id long, text string, line_no string, key string, line_id string, kept string, __gone string"
    clash = ("x",) * 5
    rows = [(1, "one two three four\n--\nfive", *clash), (1, "one two three four\n--\nfive", *clash), (None, "One, two: three four!", *clash), (2, None, *clash), (3, "", *clash), (4, "five\nfive", *clash)]
    got = sorted(((r.doc_id or 99, r.line_no), (r.group_doc_id or 99, r.group_line_no), r.kept) for r in ld.line_groups(spark.createDataFrame(rows, schema)).collect())
    same = [((1, 0), (1, 0), True), ((1, 1), (1, 1), True), ((1, 2), (1, 2), True)]
    assert got == sorted([*same, *same, ((99, 0), (1, 0), False), ((3, 0), (3, 0), True), ((4, 0), (1, 2), False), ((4, 1), (1, 2), False)])
    cleaned = ld.drop_repeated_lines(spark.createDataFrame(rows, schema))
    assert cleaned.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id or 99, r.text) for r in cleaned.where("text IS NOT NULL").collect()) == [(1, rows[0][1]), (1, rows[0][1]), (3, ""), (4, ""), (99, "")]


def test_a_key_that_very_many_lines_have_is_summed_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    head = "this line begins alike in every text and then goes on with the number"
    lines = [f"{head} {' '.join(str(rng.randrange(10**6)) for _ in range(20))}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*lines, lines[7] + "0"])), "doc_id long, text string")
    expected = sorted(map(tuple, ld.line_groups(df).collect()))
    monkeypatch.setattr(ld, "LOOK", 1)
    monkeypatch.setattr(ld, "HOT_SHARE", 100)
    unique = ld.cut(ld.fingerprints(ld.lines_of(df, "text")))
    assert ld.hot_keys(unique) and sorted(map(tuple, ld.line_groups(df).collect())) == expected
    assert (300, 0, 7, 0) in {tuple(r)[:4] for r in expected}


def test_fingerprints_of_very_long_lines_take_the_majority_over_all_words(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)]
    line = [rng.choice(words) for _ in range(70_000)]
    edited = ["more", *line[:50_000], "other", *line[50_001:]]
    df = spark.createDataFrame([(0, " ".join(line)), (1, " ".join(edited)), (2, "a b c")], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in ld.fingerprints(ld.lines_of(df, "text")).collect()}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {*line, *edited, "a", "b", "c"}], "w string").select("w", ld.F.xxhash64("w").alias("h")).collect()}
    for doc, text in ((0, line), (1, edited), (2, ["a", "b", "c"])):
        ones = [sum(hashes[w] >> k & 1 for w in text) * 2 > len(text) for k in range(64)]
        assert prints[doc] & ((1 << 64) - 1) == sum(1 << k for k in range(64) if ones[k])
    assert bin((prints[0] ^ prints[1]) & ((1 << 64) - 1)).count("1") <= 3


def test_one_changed_letter_is_linked_at_every_length(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    sizes = {(3, 9): 40, (10, 19): 40, (20, 39): 40, (40, 79): 40, (80, 160): 40}
    pairs, of = [], []
    for (low, high), n in sizes.items():
        for _ in range(n):
            line = " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
            at = rng.choice([i for i, c in enumerate(line) if c != " "])
            pairs.append((line, line[:at] + "z" + line[at + 1 :]))
            of.append((low, high))
    line = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(25))  # no spaces at all
    pairs.append((line, line[:11] + "。" + line[12:]))
    of.append("unspaced")
    df = spark.createDataFrame([(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)], "doc_id long, text string")
    got = {r.doc_id: r.group_doc_id for r in ld.line_groups(df).collect()}
    near = [i for i, (a, _) in enumerate(pairs) if len(a) >= 10]
    assert len(near) > 195 and all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(len(pairs)))
    recall = {k: sum(got[2 * i + 1] == 2 * i for i in near if of[i] == k) / sum(of[i] == k for i in near) for k in set(of)}
    assert min(recall.values()) >= 0.95


def test_fingerprints_are_compiled_and_no_pair_is_compared_twice(spark, monkeypatch):
    lines = [f"one two three four five six seven eight nine {w}" for w in ("ten", "tan", "tin", "ton", "tun")] + ["a b c", "a b d"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    plan = ld.fingerprints(ld.lines_of(df, "text"))._jdf.queryExecution().sparkPlan()
    assert "lambdafunction" not in plan.toString()
    stages = spark.newSession()
    stages.conf.set("spark.sql.adaptive.enabled", "false")
    whole = ld.fingerprints(ld.lines_of(stages.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "text"))
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(whole._jdf.queryExecution().executedPlan())
    assert code.size() and all(code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))  # what the JVM compiles
    seen, verified = [], ld.verified
    monkeypatch.setattr(ld, "verified", lambda pairs, *rest: seen.extend((min(r), max(r)) for r in pairs.select("u", "v").collect()) or verified(pairs, *rest))
    assert {r.group_doc_id for r in ld.line_groups(df).collect() if r.doc_id < 5} == {0}
    assert seen and len(seen) == len(set(seen))


def test_query_groups_equal_lines_of_any_length(spark, tmp_path):
    from mitoloom.llm import registry

    texts = ["les\n日本語のとても長い行です\nMenu", "Les!\n\n日本語のとても長い行です", "menu\nhome page\n--", "home page\n\n--"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line_no): (r.group_doc_id, r.group_line_no) for r in registry.op1_line_dedup(spark, str(tmp_path)).collect()}
    moved = {(1, 0): (0, 0), (1, 2): (0, 1), (2, 0): (0, 2), (3, 0): (2, 1)}
    assert got == {(d, n): moved.get((d, n), (d, n)) for d, t in enumerate(texts) for n in range(t.count("\n") + 1)}


def test_tables_of_finished_steps_are_deleted(spark, monkeypatch):
    folders, make = [], shared.new_folder
    monkeypatch.setattr(shared, "new_folder", lambda session, name: folders.append(make(session, name)) or folders[-1])
    rng = random.Random(9)
    words = [rng.choices([f"w{i}" for i in range(300)], k=30) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:-1], "x"])) for i, w in enumerate(words)]
    got = {r.doc_id: r.group_doc_id for r in ld.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    left = {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in folders if os.path.exists(f.removeprefix("file://"))}
    assert {"lines", "fingerprints", "blocks", "unique", "texts"} == {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in folders} and left == {"lines", "unique"}


def test_shuffles_of_labelling_are_freed_once_it_ends(spark, monkeypatch):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    left, free = [], shared.free_finished
    for _ in range(3):
        shared.free_finished(spark)

    def counted(session, **options):
        free(session, **options)
        if len(left) < 7:
            left.append(files())
            for _ in range(3):
                free(session)
            left[-1] -= files()

    monkeypatch.setattr(ld, "free_finished", counted)
    rng = random.Random(9)
    words = [rng.choices([f"w{i}" for i in range(300)], k=30) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:-1], "x"])) for i, w in enumerate(words)]
    assert {r.doc_id: r.group_doc_id for r in ld.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i % 100 for i, _ in rows}
    assert left[6] == 0, left  # behind the labelling of blocks
