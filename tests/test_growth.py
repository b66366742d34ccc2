"""Work that must not grow faster than the tables: what is counted once, fitted together, and dealt to all tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mitoloom.functions import numeric, special
from mitoloom.operators import annotate, summaries
from mitoloom.plans import bottleneck, caller, variant_qc


def tasks(df):
    """How many tasks' output holds rows."""
    return sum(df.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect())


def test_family_fits_run_in_several_tasks_and_equal_the_sum_over_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"F{i % 8}", f"M{i % 8}", float(p), int(min(n, max(0, k))), int(n)) for i, p, n, k in zip(range(4000), rng.integers(1, 10, 4000) / 10, rng.integers(50, 60, 4000), rng.integers(0, 50, 4000), strict=True)]
    fits = bottleneck.families(spark.createDataFrame(rows, "fam string, mother string, p double, c_alt int, c_dp int"), 2, 40)
    assert tasks(fits) > 1
    for r in fits.collect():
        ll = lambda s, fam=r.fam: sum(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + math.lgamma(k + p * (s - 1)) + math.lgamma(n - k + (1 - p) * (s - 1)) - math.lgamma(n + s - 1) - math.lgamma(p * (s - 1)) - math.lgamma((1 - p) * (s - 1)) + math.lgamma(s - 1) for f, _, p, k, n in rows if f == fam)
        assert r.max_ll == pytest.approx(ll(r.ne), rel=1e-12) and all(ll(r.ne + d) <= r.max_ll + 1e-6 for d in (-0.05, 0.05) if 2 <= r.ne + d <= 40)


def test_beta_fits_of_many_sites_go_together():
    rng = np.random.default_rng(6)
    samples = [rng.beta(*rng.uniform(0.3, 50, 2), rng.integers(0, 9)).clip(1e-9, 1 - 1e-9) for _ in range(300)]
    n, one, other = np.array([len(x) for x in samples]), np.array([np.log(x).sum() for x in samples]), np.array([np.log1p(-x).sum() for x in samples])
    fits = numeric.fit_betas(n, one, other)
    assert (fits[n < 3] == (2.5, 1680.0)).all()
    for i in range(300):
        assert tuple(fits[i]) == numeric.fit_beta(n[i], one[i], other[i])
        ll = lambda a, b, i=i: (a - 1) * one[i] + (b - 1) * other[i] - n[i] * (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert n[i] < 3 or all(ll(*fits[i]) >= ll(fits[i][0] * x, fits[i][1] * y) - 1e-5 for x, y in ((1.1, 1), (0.9, 1), (1, 1.1), (1, 0.9)) if fits[i].max() < 9e5)
    calls = []
    numeric.simplexes(lambda points, which: calls.append(len(which)) or ((points - which[:, None]) ** 2).sum(axis=1), np.zeros((300, 2)))
    assert len(calls) < 3000 < sum(calls)


def test_background_is_fitted_in_several_tasks(spark):
    calls = spark.range(4000).selectExpr("CAST(id % 500 AS INT) AS pos", "concat('s', id) AS sample", "0 AS idx", "100 AS ad", "100 AS dp", "0.99D - id / 1e5 AS af", "60.0D AS aq", "1L AS ploidy", "0.0D AS fs", "1.0D AS sor", "0 AS low", "0 AS high", "'A' AS allele")
    sites = variant_qc.background(calls, 1, 0.0)
    assert tasks(sites) > 1 and sites.count() == 500


def test_alignment_columns_leave_gaps_out_and_go_round(spark):
    """Places are numbered outside of functions over arrays, which are interpreted: one of those is left, for the gaps."""
    rows = spark.createDataFrame([(1, "AC-GT", "A-TG"), (2, "", "A"), (3, "--", "AC"), (4, None, "A"), (5, "G", "TT")], "id int, x string, y string")
    found = annotate.alignment_columns(rows, F.col("x"), F.col("y"), 4, 5, ["id"])
    got = sorted((r.id, r.pos, r.one, r.other) for r in found.collect())
    assert got == sorted([(1, 4, "A", "A"), (1, 5, "C", "-"), (1, 1, "G", "G"), (1, 2, "T", None), (5, 4, "G", "T")], key=lambda r: r[:2])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") == 1


def test_quantiles_hold_no_key_in_one_task(spark):
    """Keys with ties, nulls and one value, against values sorted whole."""
    rng = np.random.default_rng(9)
    values = [("a", float(x)) for x in rng.integers(0, 900, 5000) / 7] + [(None, float(x)) for x in rng.normal(size=1001)] + [("b", 2.0), ("b", None), ("c", None)]
    found = summaries.quantiles(spark.createDataFrame(values, "k string, x double"), ["k"], "x", [0.0, 0.025, 0.5, 0.975, 1.0])
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: list(r)[1:] for r in found.collect()}
    assert got.keys() == {"a", "b", "c", None} and got["b"] == [2.0] * 5 and got["c"] == [None] * 5
    for k in ("a", None):
        assert got[k] == pytest.approx(np.quantile([x for i, x in values if i == k], [0.0, 0.025, 0.5, 0.975, 1.0]).tolist(), rel=1e-12)


def test_log_beta_share_equals_gamma_functions_and_loop_holds_none(spark):
    """The quality control's scores come in Arrow batches: as columns they make code too long to be compiled."""
    rows = [(3.0, 10.0, 0.5, 20.0), (0.0, 7.0, 2.0, 0.2), (7.0, 7.0, 1e3, 1e-2), (8.0, 7.0, 1.0, 1.0), (None, 7.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (600.0, 90000.0, 0.01, 1e6)]
    got = [r.x for r in spark.createDataFrame(rows, "k double, n double, a double, b double").select(special.log_beta_share("k", "n", "a", "b").alias("x")).collect()]
    g = math.lgamma
    want = [g(k + a) + g(n - k + b) - g(n + a + b) - g(a) - g(b) + g(a + b) if k is not None and k <= n and n else None for k, n, a, b in rows]
    assert [x is None for x in got] == [x is None for x in want] and all(x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(got, want, strict=True))


def test_fisher_of_calls_is_summed_in_batches_and_equals_the_sum_over_tables(spark):
    assert isinstance(special.table_tails(*np.array([[3.0], [1.0], [2.0], [9.0]]), "less"), np.ndarray)
    rng = np.random.default_rng(2)
    cells = np.concatenate([rng.integers(0, 40, (200, 4)), [[0, 0, 0, 0], [5, 0, 0, 0], [0, 7, 3, 0], [900, 2000, 700, 1500]]])
    for tail in ("no likelier", "less", "greater"):
        got = special.table_tails(*cells.T.astype(float), tail)
        for (a, b, c, d), p in zip(cells.tolist(), got.tolist(), strict=True):
            log = lambda k, a=a, b=b, c=c, d=d: math.lgamma(a + b + 1) - math.lgamma(k + 1) - math.lgamma(a + b - k + 1) + math.lgamma(c + d + 1) - math.lgamma(a + c - k + 1) - math.lgamma(d - a + k + 1) - math.lgamma(a + b + c + d + 1) + math.lgamma(a + c + 1) + math.lgamma(b + d + 1)
            chosen = [math.exp(log(k)) for k in range(max(0, a - d), min(a + b, a + c) + 1) if {"no likelier": log(k) <= log(a) + 1e-8, "less": k <= a, "greater": k >= a}[tail]]
            assert p == pytest.approx(sum(chosen), rel=1e-8)
    assert np.isnan(special.table_tails(*np.array([[np.nan], [1.0], [2.0], [9.0]]), "less")).all()
    calls = spark.createDataFrame([("A", "G", "A", 30, 100, 0.3, 10, 20, 70, 40, 30)], "ref string, allele string, major string, ad int, dp int, af double, fwd int, rev int, major_ad int, major_fwd int, major_rev int")
    plan = caller.with_statistics(calls)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "aggregate(sequence" not in plan
