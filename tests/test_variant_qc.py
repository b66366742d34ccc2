"""Variant QC against the same steps over plain rows, and order over whole tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mitoloom.functions import numeric
from mitoloom.operators import annotate, ordered
from mitoloom.plans import variant_qc as qc

CALL = "pos int, sample string, idx int, ploidy int, ad int, dp int, af double, aq double, srf double, fs double, sor double, fs_note string"


def cohort(seed=3):
    rng = random.Random(seed)
    rows = []
    for pos in range(1, 13):
        for s in range(30):
            dp = rng.randint(150, 400)
            kind = rng.random()
            if pos % 3 == 0 and kind < 0.3:
                ad = rng.randint(int(0.05 * dp), int(0.9 * dp))
                rows += [(pos, f"s{s}", 0, 2, dp - ad, dp, (dp - ad) / dp, 60.0, 0.9), (pos, f"s{s}", 1, 2, ad, dp, ad / dp, 45.0, 0.8)]
            elif pos % 4 == 0 and kind > 0.8:
                rows.append((pos, f"s{s}", 1, 1, dp - 2, dp, (dp - 2) / dp, 60.0, 0.9))
            else:
                ad = dp - rng.randint(0, 3)
                rows.append((pos, f"s{s}", 0, 1, ad, dp, ad / dp, 60.0, 0.9))
    return [(*r, 1.0, 1.0, "x") for r in rows]


def plain(rows, least_depth=100, least_quality=20.0, prior=5e-8 * 16569, least=0.9):
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    sites, samples = {}, {}
    for r in rows:
        samples.setdefault((r[0], r[1]), []).append(r)
        if r[3] == 1 and r[5] >= least_depth and r[7] >= least_quality:
            sites.setdefault(r[0], []).append(1 - r[6])
    model = {}
    for pos, rates in sites.items():
        inside = [x for x in rates if 0 < x < 1]
        model[pos] = (sum(rates) / len(rates), *numeric.fit_beta(len(inside), sum(map(math.log, inside)), sum(map(math.log1p, (-x for x in inside)))))
    found = []
    for (pos, _), alleles in sorted(samples.items()):
        if max(r[2] for r in alleles) > 0 and min(r[7] for r in alleles) >= least_quality and alleles[0][5] >= least_depth:
            most = numeric.binomial_quantile(0.99, alleles[0][5], model[pos][0])
            found += [r for r in alleles if r[2] > 0 and r[4] > most]
    inside = [r for r in found if 0 < r[6] < 1]
    high, low = [r for r in inside if r[6] > 0.95], [r for r in inside if r[6] <= 0.95]
    target = min(len(high), len(low))
    if target:
        step = max(len(high), len(low)) // target
        high, low = (x if len(x) <= target else x[::step][:target] for x in (high, low))
        found = high + low

    def fit(pairs):
        count = lambda xs: (sorted(set(xs)), [xs.count(x) for x in sorted(set(xs))])
        shares = [a / n for a, n in pairs if 0 < a < n]
        mean = sum(shares) / len(shares)
        return numeric.fit_beta_binomial(count([a for a, _ in pairs]), count([n - a for a, n in pairs]), count([n for _, n in pairs]), mean, sum((x - mean) ** 2 for x in shares) / len(shares))

    def posterior(r, a, b):
        _, x, y = model[r[0]]
        error = beta(r[4] + x, r[5] - r[4] + y) - beta(x, y)
        mutation = beta(r[4] + a, r[5] - r[4] + b) - beta(a, b) + math.log(r[8] + 1e-12)
        return 1 / (1 + math.exp(-min(700, max(-700, mutation - error + math.log(prior) - math.log1p(-prior)))))

    shape, flags, lowest = fit([(r[4], r[5]) for r in found]), dict.fromkeys(samples, False), {}
    for _ in range(20):
        pp = {(r[0], r[1], r[2]): posterior(r, *shape) for r in rows}
        for key, x in pp.items():
            lowest[key] = min(x, lowest.get(key, 1))
        new = {key: max(pp[r[0], r[1], r[2]] for r in alleles) > least for key, alleles in samples.items()}
        changed, flags = sum(new[key] != flags[key] for key in new), new
        if changed / len(new) < 1e-3:
            break
        called = [(r[4], r[5]) for key, alleles in samples.items() if flags[key] for r in alleles if r[2] > 0 and 0 < r[4] < r[5]]
        if len(called) < 3:
            break
        shape = fit(called)
    return pp, flags, {key: key[2] > 0 and x > least for key, x in lowest.items()}


def test_quality_control_equals_its_steps_over_plain_rows(spark):
    rows = cohort()
    scored, sites = qc.quality_control(spark.createDataFrame(rows, CALL).repartition(3))
    got = {(r.pos, r["sample"], r.idx): r for r in scored.collect()}
    pp, flags, kept = plain(rows)
    assert got.keys() == pp.keys()
    assert all(abs(got[k].pp - pp[k]) < 1e-4 and got[k].kept == kept[k] and got[k].mutation == flags[k[:2]] for k in pp)
    assert {r.pos: r["pass"] for r in sites.collect()} == {p: any(f for (q, _), f in flags.items() if q == p) for p in {k[0] for k in flags}}
    assert any(kept.values()) and not all(kept.values())


def test_quality_control_of_nulls_and_no_rows(spark):
    rows = cohort() + [(1, "n", 1, 1, None, None, None, None, None, None, None, None)]
    scored, _ = qc.quality_control(spark.createDataFrame(rows, CALL))
    null = scored.where("sample = 'n'").first()
    assert null.pp == 0 and not null.good and not null.mutation
    nothing, sites = qc.quality_control(spark.createDataFrame([], CALL))
    assert nothing.count() == 0 and sites.count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_are_numbered_over_ranges(spark, parts):
    values = [(i * 37) % 101 for i in range(300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(parts)
    got = ordered.numbered(df, [F.col("v"), F.col("i")]).collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.row)] == sorted((v, i) for i, v in enumerate(values)) and sorted(r.row for r in got) == list(range(300))
    some = sorted((r.v, r.i) for r in ordered.every_nth(df, 7, 11, [F.col("v"), F.col("i")]).collect())
    assert some == sorted((v, i) for i, v in enumerate(values))[::7][:11]
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_rank_sums(spark):
    rows = [("a", x, True) for x in (1.0, 2.0, 2.0, 5.0)] + [("a", x, False) for x in (2.0, 7.0, 8.0)] + [("b", 1.0, True), ("a", None, True)]
    got = {r.k: r for r in annotate.rank_sums(spark.createDataFrame(rows, "k string, v double, one boolean"), ["k"], "v", "one").collect()}
    down = sorted((-v for k, v, _ in rows if k == "a" and v is not None))
    rank = lambda v: sum(i + 1 for i, x in enumerate(down) if x == -v) / down.count(-v)
    total = sum(rank(v) for v in (1.0, 2.0, 2.0, 5.0))
    assert got["a"].n1 == 4 and got["a"].n2 == 3 and abs(got["a"].p - numeric.rank_sum_p(total, 4, 3)) < 1e-12
    assert got["b"].z is None and got["b"].p is None
