"""Filter interaction audit: a CUBE over failure flags gives the survivors of every subset of filters, pairs of subsets give each step."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.llm.shared import pick, stored

FILTERS = "ABCDE"
#: Rows without an id are dealt over so many keys, where others are dealt by their id.
SALTS = 1024
SPACES = r"[\x20\x09-\x0D]+"


def failure_bits(text: Column) -> Column:
    """Bits 0 to 3 of a text: it has under 200 words; under half of its words are distinct; over 3 % of its code points are A-Z;
    it holds one of ``#$%&*|``."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    few = F.size(words) < 200
    alike = F.size(F.array_distinct(words)) * 100 < F.size(words) * 50
    loud = F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3
    marked = text.rlike(r"[#$%&*|]")
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, alike, loud, marked))), F.lit(0))


def flag_counts(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): rows of df by part and failure flags, with how many have each label.

    E is a text that a row with a smaller id has too, anywhere in the table; a row without an id neither fails E nor makes others
    fail it. Texts are told apart by SHA-256 and never shuffled. A group of copies is summed up where it lies: by id, then by part
    and flags, with its smallest id; what is left of it for the last step is a row for each part and label.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(df, doc_id=id_col, text=text_col, part=part_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), failure_bits(text).alias("bits"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.crc32("key") % SALTS).otherwise(-1))
    marks = pick(labels, doc_id=id_col, quality=quality_col, toxic=toxic_col).where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    is_one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).cast("long").alias(c)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("salt")).agg(is_one("quality"), is_one("toxic"))
    ids = rows.join(marks, ["doc_id", "salt"], "left").groupBy("doc_id", "salt", "key", "part", "bits", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = ids.groupBy("key", "part", "bits", "quality", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), first)
    groups = groups.withColumn("lowest", F.min("first.doc_id").over(Window.partitionBy("key")))
    once = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), once.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - once).alias("n"))))
    flags = [(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias(f) for i, f in enumerate(FILTERS[:4])]
    told = groups.select("part", *flags, "quality", "toxic", split.alias("x")).select("part", *FILTERS[:4], "x.E", "quality", "toxic", "x.n")
    sums = told.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return sums.where("n > 0")


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic) for each part and each subset of the filters (bit i: filter i): the rows that pass them all.

    One CUBE over part and flags. A grouping set of the chosen flags has its survivors in the row in which these are all false.
    """
    cube = counts.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"g{f}") for f in filters])
    passing = F.lit(True)
    for f in filters:
        passing = passing & ((F.col(f"g{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"g{f}")) * (1 << i) for i, f in enumerate(filters)), F.lit(0)).cast("int")
    found = cube.where((F.col("all_parts") == 0) & passing).select("part", subset.alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *filled)


def filter_steps(survived: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, each order of the filters and each of its steps, from pairs of subsets: those before and after it."""
    plan = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order):
            plan.append(("".join(filters[i] for i in order), step + 1, before, before | 1 << f, 1 << f, ((1 << len(filters)) - 1) ^ (1 << f)))
            before |= 1 << f
    steps = survived.sparkSession.createDataFrame(plan, "filter_order string, step int, before int, after int, own int, others int")
    count = lambda name, *columns: survived.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    # n! times n rows, whatever the data are
    paired = F.broadcast(steps).join(count("before", "n", "good", "toxic"), "before").join(count("after", "n", "good", "toxic"), ["part", "after"])
    paired = paired.join(count("own", "n"), ["part", "own"]).join(count("others", "n"), ["part", "others"])
    none, every = survived.where("subset = 0").select("part", F.col("n").alias("total")), survived.where(F.col("subset") == (1 << len(filters)) - 1).select("part", F.col("n").alias("last"))
    removed = F.col("n_before") - F.col("n_after")
    told = paired.join(none, "part").join(every, "part").select(
        "part", "filter_order", "step", "own", F.col("n_after").alias("kept"), removed.alias("removed"), (F.col("total") - F.col("n_own") - removed).alias("redundant"),
        (F.col("n_others") - F.col("last")).alias("unique_fails"), (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def filter_audit(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A null text counts as empty, a null part as the part ''. Rows that repeat an id each count; rows with an equal id do not make one
    another fail E. Of labels that repeat an id the largest counts. Without rows there are no parts, and no rows.
    """
    counts = stored(flag_counts(df, labels, **options), "flags")  # 32 rows a part at most
    return filter_steps(survivors(counts))


_ORDERS = ", ".join(f"('{''.join(order)}')" for order in permutations(FILTERS))
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 1 ELSE 0 END) AS good, max(CASE toxic WHEN 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT g.part, filter_order, step, substr(filter_order, CAST(step AS BIGINT), 1) AS f, fails, n, good, toxic,
  list_min(list_filter([strpos(filter_order, 'A'), strpos(filter_order, 'B'), strpos(filter_order, 'C'), strpos(filter_order, 'D'), strpos(filter_order, 'E')], lambda p, i: contains(fails, substr('ABCDE', i, 1)))) AS gone FROM g, s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(CASE WHEN gone IS NULL OR gone > step THEN n END), 0) AS kept, coalesce(sum(CASE WHEN gone = step THEN n END), 0) AS removed,
  coalesce(sum(CASE WHEN contains(fails, f) AND gone < step THEN n END), 0) AS redundant, coalesce(sum(CASE WHEN fails = f THEN n END), 0) AS unique_fails,
  coalesce(sum(CASE WHEN gone = step THEN good END), 0) AS good_lost, coalesce(sum(CASE WHEN gone = step THEN toxic END), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
