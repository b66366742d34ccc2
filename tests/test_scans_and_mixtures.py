"""Scans carried over ranges, incomplete gamma and beta functions, mixtures and contrastive scores, against plain sums and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mitoloom.functions import numeric, special
from mitoloom.operators import intervals, ordered, recalibrate


def islands_of(rows):
    out = []
    for chrom, s, e in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[0] or "", r[0] is not None, r[1], r[2])):
        if out and out[-1][0] == chrom and s <= out[-1][2] + 1:
            out[-1] = (chrom, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
        else:
            out.append((chrom, s, e, 1))
    return out


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_islands_go_over_ranges_and_start_anew_with_each_key(spark, many_ranges, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), a, a + rng.choice([0, 3, 40])) for a in (rng.randrange(4000) for _ in range(500))]
    rows += [("a", 1, 9_999), ("c", 5, 1_000_000), *(("c", a, a + 1) for a in range(6, 900_000, 5000)), ("d", 4, 4), ("d", 4, 4), ("d", 5, 6), ("d", 8, 8), ("e", None, 3), ("e", 3, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = spark.createDataFrame([(*r, "x") for r in rows], "chrom string, s long, e long, k0 string")
        got = [tuple(r) for r in intervals.merged(df, ["chrom"]).select("chrom", "s", "e", "n").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(islands_of(rows), key=str)
    assert intervals.merged(df.limit(0), ["chrom"]).count() == 0


def test_scans_over_ranges(spark, many_ranges):
    rng = random.Random(2)
    values = [(i, rng.choice([None, rng.randrange(100)]), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(values, "i int, v int, x boolean").repartition(5)
    rows = ordered.in_ranges(df, [F.col("i")])
    assert rows.select("__range").distinct().count() > 1
    for fold, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        for inclusive in (True, False):
            got = {r.i: r.out for r in ordered.scanned(rows, F.col("v"), [F.col("i")], "out", fold, inclusive).collect()}
            for i in (0, 1, 2, 77, 299):
                seen = [v for k, v, _ in values if v is not None and (k <= i if inclusive else k < i)]
                assert got[i] == (plain(seen) if seen else None)
    with pytest.raises(ValueError, match="reserved"):
        ordered.in_ranges(df.withColumn("__range_v", F.lit(1)), [F.col("i")])
    assert [r.i for r in ordered.every_nth(df, 50, 3, [F.col("i")]).orderBy("i").collect()] == [0, 50, 100]
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, "z")], "k int, n string")
    assert sorted(r.row for r in ordered.numbered(ties, [F.col("k")]).collect()) == [0, 1, 2, 3]


def test_gamma_and_beta_against_sql():
    con = duckdb.connect()
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 9.99, 10, 11, 80, 1e4, 1e6])
    assert np.allclose(special.lgamma(x), [con.execute("SELECT lgamma(?)", [v]).fetchone()[0] for v in x.tolist()], rtol=1e-13, atol=1e-13)
    series = "SELECT list_sum(list_transform(range(0, 4000), lambda n: exp({a} * ln({x}) - {x} + n * ln({x}) - lgamma({a} + n + 1))))"
    for a in (0.5, 1.0, 1.5, 3.0, 25.5, 400.0):
        for at in (0.01, 0.5, 2.0, 7.5, 30.0, 390.0, 500.0):
            below = con.execute(series.format(a=a, x=at)).fetchone()[0]
            assert abs(special.gamma_tail(np.array([a]), np.array([at]))[0] - (1 - below)) < 1e-11
    assert special.gamma_tail([0.5, 0.5, 2, -1], [0, -3, math.inf, 1])[:3].tolist() == [1, 1, 0] and math.isnan(special.gamma_tail([-1.0], [1.0])[0])
    tail = special.gamma_tail(np.array([0.5]), np.array([200.0]))[0]  # far out the tail keeps its digits
    assert abs(tail / math.erfc(math.sqrt(200.0)) - 1) < 1e-9
    terms = "SELECT sum(exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p}))) FROM (SELECT unnest(range(0, {k} + 1))::DOUBLE AS k)"
    for n, p, ks in ((10, 0.3, (0, 3, 9)), (1000, 0.004, (0, 4, 12)), (1_000_000, 0.001, (900, 1000, 1100)), (500, 0.97, (470, 485, 499))):
        for k in ks:
            assert abs(special.binomial_below(np.array([k]), np.array([n]), np.array([p]))[0] - con.execute(terms.format(n=n, p=p, k=k)).fetchone()[0]) < 1e-9


def test_quantiles_equal_plain_sums(spark):
    rng = random.Random(3)
    cases = [(rng.choice([0.01, 0.5, 0.9, 0.99]), rng.randrange(0, 400), rng.choice([0.0, 1.0, 1e-5, rng.random()])) for _ in range(300)] + [(0.99, 0, 0.5), (0.99, -3, 0.5), (0.99, 7, 1.0)]
    got = special.binomial_quantiles(*map(np.array, zip(*cases)))
    assert got.tolist() == [numeric.binomial_quantile(*c) if c[1] > 0 else 0 for c in cases]
    deep = special.binomial_quantiles(0.99, 1_000_000, 0.001)
    assert special.binomial_below(deep, 1e6, 0.001)[0] >= 0.99 > special.binomial_below(deep - 1, 1e6, 0.001)[0] and 1073 < deep[0] < 1076
    df = spark.createDataFrame([(10, 0.5, 0.99), (None, 0.5, 0.99), (10, None, 0.99)], "n long, p double, q double")
    assert [r[0] for r in df.select(special.binomial_quantile(F.col("n"), F.col("p"), F.col("q"))).collect()] == [numeric.binomial_quantile(0.99, 10, 0.5), None, None]
    tails = spark.createDataFrame([(3.84, 1), (0.0, 4), (None, 1), (5.0, 2)], "x double, df int").select(special.chi2_tail(F.col("x"), F.col("df"))).collect()
    assert tails[0][0] == pytest.approx(numeric.chi2_tail(3.84), abs=1e-12) and tails[1][0] == 1 and tails[2][0] is None and tails[3][0] == pytest.approx(math.exp(-2.5), abs=1e-14)


def clouds(n=600, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.multivariate_normal([-3, 0], [[1, 0.8], [0.8, 1]], n), rng.multivariate_normal([3, 1], [[0.5, 0], [0, 2]], n)])


def test_mixture_finds_the_number_of_gaussians(spark):
    x = clouds()
    df = spark.createDataFrame([(v,) for v in x.tolist()], "features array<double>").repartition(7)
    model, table = recalibrate.fit_mixtures(df, 4)
    order = np.argsort(model.means[:, 0])
    assert [k for k, _ in table] == [1, 2, 3, 4] and min(table, key=lambda t: t[1])[0] == 2
    assert np.allclose(model.means[order], [[-3, 0], [3, 1]], atol=0.2) and np.allclose(model.covariances[order][0], [[1, 0.8], [0.8, 1]], atol=0.2) and np.allclose(model.weights, 0.5, atol=0.02)
    # the bound on Gaussian 1 is exact, and densities are those of the formula
    cov, d = np.cov(x.T, bias=True) + 1e-6 * np.eye(2), x - x.mean(axis=0)
    level = -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(2 * np.pi * cov))
    assert table[0][1] == pytest.approx(5 * math.log(len(x)) - 2 * level.sum(), rel=1e-9)
    again, same = recalibrate.fit_mixtures(df.repartition(3), 4)
    assert [b for _, b in same] == pytest.approx([b for _, b in table], rel=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        recalibrate.fit_mixtures(df.limit(0))
    few, table = recalibrate.fit_mixtures(spark.createDataFrame([([1.0, 2.0],)] * 3, "features array<double>"), 5)
    assert len(table) == 1 and np.isfinite([b for _, b in table]).all()
    assert len(recalibrate.fit_mixtures(spark.createDataFrame([([float(i), float(i * i % 7)],) for i in range(10)], "features array<double>"), 5)[1]) == 3


def test_contrastive_scores(spark):
    rng = np.random.default_rng(4)
    good, bad = rng.normal([0, 0, 0], 0.5, (500, 3)), rng.normal([4, 0, 0], 1.5, (120, 3))
    rows = [(i, v, bool(i < 400)) for i, v in enumerate([*good.tolist(), *bad.tolist(), [0.0, 90.0, 0.0], *good[:3].tolist()])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "i int, features array<double>, truth boolean, good string, score double").drop("good", "score").repartition(5)
    got = {r.i: r for r in recalibrate.recalibrated(df, most=3).collect()}
    assert len(got) == len(rows) and np.mean([got[i].score for i in range(500)]) > 1 > -1 > np.mean([got[i].score for i in range(500, 620)])
    far = [got[i].culprit for i in range(500, 620) if got[i].features[0] > 1.2]
    assert np.mean([c == 0 for c in far]) > 0.8 and got[620].failing and not got[620].negative
    assert not any(got[i].negative and got[i].failing for i in got) and sum(got[i].negative for i in range(500, 620)) > 60
    assert got[0].score == pytest.approx(got[621].score) and got[0].quality == pytest.approx(round(got[0].score * 10, 2), abs=0.0101)
    x = np.array([got[i].features for i in range(620)])
    assert np.allclose(x.mean(axis=0), np.array([got[620].features, *(got[i].features for i in (621, 622, 623))]).sum(axis=0) / -620, atol=1e-6)
    reached, culprits = recalibrate.report(recalibrate.recalibrated(df, most=2), [0, 10])
    assert {r.threshold for r in reached.collect()} == {0.0, 10.0} and culprits.agg(F.sum("n")).first()[0] == len(rows)
    with pytest.raises(ValueError, match="no variance"):
        recalibrate.recalibrated(df.withColumn("features", F.array(F.lit(1.0), F.col("features")[0])))
    for broken in (None, [1.0, None, 2.0], [1.0, math.nan, 2.0]):
        with pytest.raises(Exception, match="null or not finite"):
            recalibrate.recalibrated(df.unionByName(spark.createDataFrame([(999, broken, True)], "i int, features array<double>, truth boolean")))


def test_mixture_parts_and_features_by_hand():
    m = recalibrate.Mixture(np.array([0.25, 0.75]), np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[[2.0, 0.5], [0.5, 1.0]], [[1.0, 0.0], [0.0, 4.0]]]))
    x = np.array([[0.3, -0.2]])
    dense = [w * math.exp(-0.5 * (x[0] - mu) @ np.linalg.inv(c) @ (x[0] - mu)) / math.sqrt(np.linalg.det(2 * math.pi * c)) for w, mu, c in zip(m.weights, m.means, m.covariances)]
    assert m.log10_density(x)[0] == pytest.approx(math.log10(sum(dense)))
    one = sum(w * math.exp(-0.5 * ((0.3 - mu) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for w, mu, s in ((0.25, 0, 2.0), (0.75, 2, 1.0)))
    assert m.log10_by_feature(x)[0, 0] == pytest.approx(math.log10(one))
