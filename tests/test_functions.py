import math

import numpy as np
from pyspark.sql import functions as F

from mitoloom.functions import alleles as al
from mitoloom.functions import numeric
from mitoloom.functions import stats as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lgamma_matches_the_standard_library(spark):
    points = [1e-3, 0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 123.4, 5e4]
    rows = spark.createDataFrame([(x,) for x in points], "x double").select("x", st.lgamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) < 1e-8 * max(1, abs(math.lgamma(r.x))) for r in rows)


def test_fisher_tails_agree_with_counting(spark):
    def tables(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        return {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, k - (n - r)), min(r, k) + 1)}

    cases = [(8, 2, 1, 5), (0, 10, 10, 0), (3, 3, 3, 3), (89, 353, 41, 0)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d int")
    cells = [F.col(c) for c in "abcd"]
    rows = df.select("a", "b", "c", "d", st.fisher_two_sided(*cells).alias("two"), st.fisher_less(*cells).alias("less"), st.fisher_greater(*cells).alias("more")).collect()
    for r in rows:
        p = tables(r.a, r.b, r.c, r.d)
        assert abs(r.two - sum(v for v in p.values() if v <= p[r.a] * (1 + 1e-8))) < 1e-9
        assert abs(r.less - sum(v for k, v in p.items() if k <= r.a)) < 1e-9
        assert abs(r.more - sum(v for k, v in p.items() if k >= r.a)) < 1e-9
        if (r.a, r.b) == (89, 353):
            assert abs(-10 * math.log10(r.two) - 256.9) < 0.01


def test_genotypes_and_aligned_lookup(spark):
    df = spark.createDataFrame([("0/1", [5, 7]), (".", [1]), ("2|1|0", [1, 2, 3]), ("0/1", [5])], "gt string, ad array<int>")
    got = [r.x for r in df.select(al.by_genotype(al.genotype(F.col("gt")), F.col("ad"), F.lit(1)).alias("x")).collect()]
    assert got == [7, None, 2, None]


def test_suffix_and_prefix_trimming(spark):
    df = spark.createDataFrame([(1, "ACGT", "ACT"), (1, "A", "A"), (5, "ACG", "ATG"), (1, "CAA", "CA")], "pos int, ref string, alt string")
    assert [(r.ref, r.alt) for r in al.suffix_trimmed(df).collect()] == [("ACG", "AC"), ("A", "A"), ("AC", "AT"), ("CA", "C")]
    assert [(r.pos, r.ref, r.alt) for r in al.prefix_trimmed(df).collect()][2] == (6, "CG", "TG")


def test_small_helpers(spark):
    assert one(spark, al.rotated(F.lit("ACGTN"), F.lit(7))) == "GTNAC"
    assert one(spark, al.trimmed_number(F.lit(0.5))) == "0.5" and one(spark, al.trimmed_number(F.lit(2.0))) == "2"
    assert one(spark, st.phred(F.lit(0.0))) == 10000 and one(spark, st.logit(F.lit(1.0))) == 10000


def plain_em(likelihood, share):
    """EM read by read, for one problem."""
    before = None
    for _ in range(101):
        joint = likelihood * share
        marginal = joint.sum(axis=1)
        share = (joint / marginal[:, None]).mean(axis=0)
        if before is not None and np.abs(np.log(marginal) - before).sum() < 1e-3:
            break
        before = np.log(marginal)
    return share, np.log(marginal).sum()


def test_em_of_counted_observations_equals_em_over_reads():
    rng = np.random.default_rng(3)
    problems = []
    for _ in range(20):
        seen, alleles = rng.integers(1, 9), rng.integers(1, 4)
        problems.append((rng.uniform(0.001, 0.999, (seen, alleles)), rng.integers(1, 40, seen), rng.dirichlet(np.ones(alleles)) * rng.uniform(0.8, 1)))
    for wide in (1, 2, 3):
        some = [p for p in problems if p[0].shape[1] == wide]
        deep = max(len(p[1]) for p in some)
        likelihood, times = np.ones((len(some), deep, wide)), np.zeros((len(some), deep))
        for i, (x, n, _) in enumerate(some):
            likelihood[i, : len(n)], times[i, : len(n)] = x, n
        shares, levels = numeric.em(likelihood, times, np.array([p[2] for p in some]))
        for (x, n, start), share, level in zip(some, shares, levels):
            expected, at = plain_em(np.repeat(x, n, axis=0), start)
            assert np.allclose(share, expected, atol=1e-9) and abs(level - at) < 1e-6


def test_allele_sets_drop_noise_and_keep_a_minor_allele():
    def call(*depths):
        sites = [numeric.Site(list("ACGT"), np.flatnonzero(d), np.full(np.count_nonzero(d), 0.001), np.array([x for x in d if x], float)) for d in depths]
        return numeric.allele_sets(sites, 0.01)

    alone, mixed, noisy, empty, tied = call([100, 0, 0, 0], [60, 40, 0, 0], [995, 0, 5, 0], [0, 0, 0, 0], [5, 5, 0, 0])
    assert alone == ([0], 10000) and noisy == ([0], 10000) and empty == ([], 0.0)
    assert mixed[0] == [0, 1] and mixed[1] > 100 and tied[0] == [0, 1]


def test_fits_recover_their_parameters():
    rng = np.random.default_rng(5)
    x = rng.beta(2, 5, 20000)
    a, b = numeric.fit_beta(len(x), np.log(x).sum(), np.log1p(-x).sum())
    assert abs(a - 2) < 0.1 and abs(b - 5) < 0.25
    k = rng.binomial(200, rng.beta(2, 6, 4000))
    counts = lambda x: tuple(map(list, np.unique(x, return_counts=True)))
    a, b = numeric.fit_beta_binomial(counts(k), counts(200 - k), ([200], [len(k)]), (k / 200).mean(), (k / 200).var())
    assert abs(a - 2) < 0.25 and abs(b - 6) < 0.8
    assert numeric.fit_beta(2, 0, 0) == (2.5, 1680.0)
    assert numeric.binomial_quantile(0.99, 100, 0.01) == 4 and numeric.binomial_quantile(0.9, 0, 0.5) == 0


def test_fisher_by_ratios_equals_sums_over_all_tables(spark):
    from math import comb

    rng = np.random.default_rng(1)
    tables = [tuple(int(x) for x in rng.integers(0, 30, 4)) for _ in range(60)] + [(0, 0, 0, 0), (0, 5, 5, 0), (400, 3, 380, 90), (7, 0, 0, 0)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    cols = [F.col(x) for x in "abcd"]
    got = df.select("a", "b", "c", "d", st.fisher_two_sided(*cols).alias("two"), st.fisher_less(*cols).alias("less"), st.fisher_greater(*cols).alias("more")).collect()
    for a, b, c, d, two, less, more in got:
        n, row, column = a + b + c + d, a + b, a + c
        p = {k: comb(row, k) * comb(n - row, column - k) / comb(n, column) for k in range(max(0, column - (c + d)), min(row, column) + 1)}
        expected = (sum(x for x in p.values() if x <= p[a] * (1 + 1e-7)), sum(x for k, x in p.items() if k <= a), sum(x for k, x in p.items() if k >= a))
        assert np.allclose((two, less, more), np.minimum(expected, 1), rtol=1e-8, atol=1e-12)


def test_discrete_pairs_equal_the_sum():
    from math import comb, exp, lgamma, log

    beta = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    rows = [(3, 17, 4, 30, 5), (0, 9, 0, 8, 1), (5, 0, 7, 7, 3), (2, 2, 1, 9, 2)]
    for (a, b, x, n, s), ll in zip(rows, numeric.discrete_pairs(*np.array(rows, float).T)):
        total = sum(comb(s, k) * exp(beta(k + a + 1, s - k + b + 1) - beta(a + 1, b + 1)) * comb(n, x) * (k / s) ** x * (1 - k / s) ** (n - x) for k in range(s + 1))
        assert abs(ll - log(total)) < 1e-9
    assert np.isnan(numeric.discrete_pairs(*np.array([[1.0], [1.0], [3.0], [2.0], [4.0]]))).all()


def test_closed_and_exact_trio_likelihoods_differ_as_known():
    closed = lambda s: one_value(0.3, 15, 50, 20, 80, s)
    exact = lambda s: numeric.trio_likelihood_exact(0.3, 15, 50, 20, 80, s)
    assert abs((closed(5) - closed(50)) + 1.095) < 0.01 and abs((exact(5) - exact(50)) + 1.892) < 0.01


def one_value(p, ma, md, ca, cd, size):
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    a, b = p * (size - 1), (1 - p) * (size - 1)
    return math.log(math.comb(md, ma)) + math.log(math.comb(cd, ca)) + beta(ma + ca + a, md + cd - ma - ca + b) - beta(a, b)
