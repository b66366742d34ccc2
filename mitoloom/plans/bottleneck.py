"""Bottleneck sizes: transmission pairs to fits, families, profiles and drift moments."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.functions.numeric import golden_section
from mitoloom.functions.special import lgamma
from mitoloom.operators import drift, filters, likelihood
from mitoloom.operators.ordered import dealt, durable


def load_pairs(raw: DataFrame, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Rows of a pair table by column name; optional columns may be absent, numbers that do not parse drop their row."""
    have = {c.upper(): c for c in raw.columns}
    text = lambda name, default="": F.col(have[name]) if name in have else F.lit(default)
    number = lambda name, kind, default="0": (F.col(have[name]) if name in have else F.lit(default)).cast("string").try_cast(kind)
    rows = raw.select(
        text("CHROM").alias("chrom"), number("POS", "int").alias("pos"), text("REF").alias("ref"), text("ALT").alias("alt"), text("FAM_ID").alias("fam"), text("MOTHER_ID").alias("mother"), text("CHILD_ID").alias("child"),
        number("GRANDMOTHER_DP", "int").alias("g_dp"), number("GRANDMOTHER_AD_ALT", "int").alias("g_alt"), number("HAS_G", "int").alias("has_g"),
        number("MOTHER_DP", "int").alias("m_dp"), number("MOTHER_AD_ALT", "int").alias("m_alt"), number("MOTHER_VAF", "double").alias("m_vaf"), number("CHILD_DP", "int").alias("c_dp"), number("CHILD_AD_ALT", "int").alias("c_alt"), number("CHILD_VAF", "double").alias("c_vaf"), text("QC", "PASS").alias("qc"),
    )
    sound = rows.dropna(subset=["pos", "m_dp", "m_alt", "m_vaf", "c_dp", "c_alt", "c_vaf", "has_g", "g_dp", "g_alt"])
    kept = sound.where((F.col("qc") == "PASS") & (F.col("m_dp") > 0) & (F.col("c_dp") > 0) & F.col("m_alt").between(0, F.col("m_dp")) & F.col("c_alt").between(0, F.col("c_dp")) & F.col("m_vaf").between(low, high))
    return kept.withColumns({"p": F.col("m_alt") / F.col("m_dp"), "c": F.col("c_alt") / F.col("c_dp"), "g": F.when((F.col("has_g") == 1) & (F.col("g_dp") > 0), F.col("g_alt") / F.col("g_dp"))})


def surface(pairs: DataFrame, sizes: list[float], model: str) -> DataFrame:
    if model == "discrete":
        return likelihood.surface(pairs, sizes, "discrete")
    pairwise, trios = pairs.where("g IS NULL"), pairs.where("g IS NOT NULL")
    parts = likelihood.surface(pairwise, sizes).unionByName(likelihood.surface(trios, sizes, "trio"))
    return parts.groupBy("ne").agg(F.sum("ll").alias("ll"))


def estimate(pairs: DataFrame, low: int = 1, high: int = 100, model: str = "continuous") -> dict[str, Any]:
    """ne, ci_low, ci_high, clipped flags, max_ll and n of a set of pairs.

    The surface is scanned at whole sizes, then, for the continuous model, at hundredths around the peak and around each end
    of the interval. Each scan is one distributed aggregate whose result has as many rows as sizes.
    """
    informative = durable(pairs.where("p > 0 AND p < 1"))
    n = informative.count()
    if not n:
        return {"ne": None, "ci_low": None, "ci_high": None, "low_clipped": False, "high_clipped": False, "max_ll": None, "n": 0}
    floor = max(low, 2) if model == "continuous" else low
    values = {}

    def scan(sizes: list[float]) -> None:
        fresh = sorted({round(x, 2) for x in sizes} - values.keys())
        if fresh:
            values.update((round(r.ne, 2), r.ll) for r in surface(informative, fresh, model).collect())

    scan([float(x) for x in range(floor, high + 1)])
    peak = max(values, key=lambda x: (values[x], -x))
    if model == "continuous":
        coarse = [max(floor, peak - 1) + 0.1 * i for i in range(21)]
        scan([x for x in coarse if x <= high])
        peak = max(values, key=lambda x: (values[x], -x))
        scan([x for x in (peak - 0.1 + 0.01 * i for i in range(21)) if floor <= x <= high])
        peak = max(values, key=lambda x: (values[x], -x))
    wall = values[peak] - likelihood.DROP

    def end(direction: int) -> tuple[float, bool]:
        edge = floor if direction < 0 else high
        inside, outside = peak, None
        for x in sorted((x for x in values if (x - peak) * direction > 0), key=lambda x: abs(x - peak)):
            if values[x] < wall:
                outside = x
                break
            inside = x
        if outside is None:
            return float(edge), True
        while model == "continuous" and abs(outside - inside) > 0.0101:
            step = max(0.01, round(abs(outside - inside) / 10, 2))
            scan([inside + direction * step * i for i in range(1, int(abs(outside - inside) / step) + 1)])
            for x in sorted((x for x in values if min(inside, outside) <= x <= max(inside, outside)), key=lambda x: abs(x - peak)):
                if values[x] < wall:
                    outside = x
                    break
                inside = x
        return inside, False

    (ci_low, low_clipped), (ci_high, high_clipped) = end(-1), end(1)
    return {"ne": peak, "ci_low": ci_low, "ci_high": ci_high, "low_clipped": low_clipped, "high_clipped": high_clipped, "max_ll": values[peak], "n": n}


def kimura(pairs: DataFrame) -> dict[str, Any]:
    """b, ne and n by drift moments; a note where b is at its bound, as when nothing seems to drift."""
    row = drift.kimura(drift.terms(pairs)).first()
    if row is None or not row.n:
        return {"b": None, "ne": None, "n": 0, "note": "no informative pairs"}
    return {"b": row.b, "ne": row.ne, "n": row.n, "note": "b at its bound" if row.b >= 1 - drift.CLIP or row.b <= drift.CLIP else ""}


FAMILY = "fam string, mother string, sites long, informative long, ne double, ci_low double, ci_high double, max_ll double, low_clipped boolean, high_clipped boolean, skipped boolean, warning string"


def families(pairs: DataFrame, low: int = 2, high: int = 100, least: int = 3) -> DataFrame:
    """A continuous fit for each (fam, mother); families under ``least`` informative sites are skipped, with a warning.

    Equal observations of a family are counted before they travel, so that its group is bounded by distinct (p, c_alt, c_dp).
    A likelihood sums over distinct (p, c_alt), (p, c_dp - c_alt), c_dp and p. Pairs without a family share the family ALL. No pairs
    give no rows.
    """

    def fit(key, frame):
        import numpy as np
        import pandas as pd

        rows = frame[(frame["p"] > 0) & (frame["p"] < 1)]
        times = rows["times"].to_numpy(float)
        head = [*key, int(frame["times"].sum()), int(times.sum())]
        names = [c.split()[0] for c in FAMILY.split(", ")]
        if times.sum() < least:
            return pd.DataFrame([[*head, None, None, None, None, False, False, True, f"fewer than {least} informative sites"]], columns=names)
        p, k, n = (rows[c].to_numpy(float) for c in ("p", "c_alt", "c_dp"))
        constant = float((times * (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))).sum())

        def counted(*columns):
            """Different rows of some columns, and how often each is there."""
            sums = pd.DataFrame([*columns, times]).T.groupby([*range(len(columns))])[len(columns)].sum()
            return *(sums.index.get_level_values(i).to_numpy() for i in range(len(columns))), sums.to_numpy()

        # each term depends on some of p, k and n only, so that equal ones are counted once
        (hit_p, hits, by_hit), (miss_p, misses, by_miss), (trials, by_trials), (share, by_share) = counted(p, k), counted(1 - p, n - k), counted(n), counted(p)

        def ll(size: float) -> float:
            s = size - 1
            drawn = (by_hit * lgamma(hits + hit_p * s)).sum() + (by_miss * lgamma(misses + miss_p * s)).sum() - (by_trials * lgamma(trials + s)).sum()
            return float(constant + drawn - (by_share * (lgamma(share * s) + lgamma((1 - share) * s))).sum() + times.sum() * math.lgamma(s))

        whole = np.array([ll(x) for x in range(low, high + 1)])
        peak = float(low + whole.argmax())
        best = golden_section(ll, max(low, peak - 1), min(high, peak + 1))
        best = max((best, peak, float(low), float(high)), key=ll)
        top = ll(best)

        def end(direction: int) -> tuple[float, bool]:
            """The last hundredth before the likelihood falls by DROP: by whole sizes, tenths, then hundredths."""
            edge = low if direction < 0 else high
            at = 0
            for step in (100, 10, 1):  # in hundredths
                while (edge - (best + direction * 0.01 * (at + step))) * direction >= 0 and ll(best + direction * 0.01 * (at + step)) >= top - likelihood.DROP:
                    at += step
            beyond = best + direction * 0.01 * (at + 1)
            return (float(edge), True) if (edge - beyond) * direction < 0 else (best + direction * 0.01 * at, False)

        (a, ca), (b, cb) = end(-1), end(1)
        return pd.DataFrame([[*head, best, a, b, top, ca, cb, False, "at a bound" if ca or cb else ""]], columns=names)

    fam = F.when(F.coalesce("fam", F.lit("")) == "", "ALL").otherwise(F.col("fam"))
    counted = pairs.groupBy(fam.alias("fam"), "mother", "p", "c_alt", "c_dp").agg(F.count("*").alias("times"))
    return dealt(counted, "fam", "mother").groupBy("fam", "mother").applyInPandas(fit, FAMILY)


def result(pairs: DataFrame, **options: Any) -> dict[str, Any]:
    """Everything about one set of pairs, ready for JSON: numbers that are not finite become strings."""
    out = {"fit": estimate(pairs, **options), "kimura": kimura(pairs)}
    clean = lambda x: {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else str(x) if isinstance(x, float) and not math.isfinite(x) else x
    return clean(out)


def from_records(pedigree_rows: DataFrame, records: DataFrame, least_depth: int = 500, require_pass: bool = True, snv_only: bool = True) -> DataFrame:
    """Transmission pairs straight from call records (chrom, pos, ref, alts, filter, sample, gt, ad, dp) and a pedigree."""
    from mitoloom.functions import alleles as al
    from mitoloom.operators import pedigree

    rows = records.where(filters.passing(F.col("filter"))) if require_pass else records
    rows = rows.select("*", F.posexplode("alts").alias("__k", "alt"))
    if snv_only:
        rows = rows.where((F.length("ref") == 1) & (F.length("alt") == 1))
    rows = rows.select(F.struct("chrom", "pos", "ref").alias("pos"), "alt", "sample", "dp", al.by_genotype(F.col("gt"), F.col("ad"), F.col("__k") + 1).alias("ad_alt"))
    return pedigree.transmission_pairs(pedigree_rows, rows, least_depth).select("pos.chrom", "pos.pos", "pos.ref", "alt", *[c for c in ("fam", "grandmother", "mother", "child", "grandmother_dp", "grandmother_alt", "has_g", "mother_dp", "mother_alt", "mother_vaf", "child_dp", "child_alt", "child_vaf", "qc")])
