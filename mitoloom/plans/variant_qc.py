"""Variant QC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mitoloom.functions import stats as st
from mitoloom.functions.numeric import fit_beta_binomial, fit_betas
from mitoloom.functions.special import binomial_quantile, log_beta_share
from mitoloom.operators import filters
from mitoloom.operators.ordered import dealt, durable, every_nth

#: Beta-Binomial parameters where there is too little to fit.
DEFAULT_SHAPE = (0.5, 0.2)


def histogram_divergence(calls: DataFrame, by: list[str], bins: int, a: Column | float, b: Column | float) -> DataFrame:
    """kl: divergence of each key's histogram of af, within (0, 1), from Beta(a, b) at the bins' middles; null becomes 1000.

    a and b are numbers, or columns of calls that depend on the key alone.
    """
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    inside = calls.where((F.col("af") > 0) & (F.col("af") < 1)).withColumns({"__x": a, "__y": b})
    cell = F.least(F.floor(F.col("af") * bins), F.lit(bins - 1)).alias("__b")
    counts = inside.groupBy(*by, cell).agg(F.count("*").alias("__n"), F.first("__x").alias("__x"), F.first("__y").alias("__y"))
    q = F.col("__n") / F.sum("__n").over(Window.partitionBy(*by))
    middle = (F.col("__b") + 0.5) / bins
    log_density = (F.col("__x") - 1) * F.ln(middle) + (F.col("__y") - 1) * F.ln(F.lit(1.0) - middle) - st.log_beta(F.col("__x"), F.col("__y"))
    return counts.withColumn("__t", q * (F.ln(q) - log_density + F.log(F.lit(float(bins))))).groupBy(*by).agg(F.coalesce(F.sum("__t"), F.lit(1000.0)).alias("kl"))


def background(calls: DataFrame, least_depth: int, least_quality: float) -> DataFrame:
    """(site key, n, error, alpha, beta): each site's background error over its one-allele samples, and its Beta fit.

    The fit needs a count and two sums of logarithms, so a site travels as one row, and all sites of an Arrow batch are searched together.
    """
    error = F.lit(1.0) - F.col("af")
    ready = filters.background_ready(calls, least_depth, least_quality)
    inside = (error > 0) & (error < 1)
    sums = ready.groupBy("pos").agg(F.count("*").alias("n"), F.avg(error).alias("error"), F.count_if(inside).alias("k"), F.coalesce(F.sum(F.when(inside, F.ln(error))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(inside, F.ln(F.col("af")))), F.lit(0.0)).alias("b"))

    def fit(frames):
        for frame in frames:
            fits = fit_betas(*(frame[c].to_numpy(float) for c in "kab"))
            yield frame.assign(alpha=fits[:, 0], beta=fits[:, 1])[["pos", "n", "error", "alpha", "beta"]]

    kind = dict(sums.dtypes)["pos"]
    return dealt(sums, F.xxhash64("pos")).mapInPandas(fit, f"pos {kind}, n long, error double, alpha double, beta double")


def evidence(calls: DataFrame, sites: DataFrame, least_depth: int, least_quality: float, level: float = 0.99) -> DataFrame:
    """The alternative alleles that errors do not explain: deep and sure samples, more reads than all but 1 % of error counts.

    calls: pos, sample, idx, ad, dp, af, aq; sites: pos, error. Samples that hold the reference alone, and those with any allele below
    the quality, give none. The quantile is sought once for each different depth and error.
    """
    sample = Window.partitionBy("pos", "sample")
    sure = calls.withColumns({"__q": F.min("aq").over(sample), "__top": F.max("idx").over(sample)}).where((F.col("__q") >= least_quality) & (F.col("__top") > 0) & (F.col("dp") >= least_depth))
    rows = sure.where("idx > 0").join(sites.select("pos", "error"), "pos")
    bounds = dealt(rows.select("dp", "error").distinct(), F.xxhash64("dp", "error")).withColumn("__most", binomial_quantile(F.col("dp"), F.col("error"), F.lit(level)))
    return rows.join(bounds, ["dp", "error"]).where(F.col("ad") > F.col("__most")).select(*calls.columns)


def balanced(seen: DataFrame) -> DataFrame:
    """seen (pos, sample, idx, af, ...) with as many shares above 0.95 as below: of the more frequent kind, every step-th by place.

    Where one kind is missing, all rows, also those with a share of 0 or 1.
    """
    inside = seen.where("af > 0 AND af < 1")
    kinds = {r["high"]: r["n"] for r in inside.groupBy((F.col("af") > 0.95).alias("high")).agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return seen
    most, least = max(kinds.values()), min(kinds.values())
    frequent = kinds[True] == most
    many, few = (inside.where((F.col("af") > 0.95) == flag) for flag in (frequent, not frequent))
    if most == least:
        return inside
    return every_nth(many, most // least, least, [F.col("pos"), F.col("sample"), F.col("idx")]).unionByName(few)


def _shape(seen: DataFrame) -> tuple[float, float] | None:
    """Beta-Binomial parameters of (ad, dp) pairs, or None under three.

    The likelihood needs how often each ad, dp - ad and dp occurs, three lists no longer than the depth, and starts from the
    shares' moments.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), x.cast("long").alias("x")) for name, x in (("k", F.col("ad")), ("m", F.col("dp") - F.col("ad")), ("n", F.col("dp")))])).alias("c")
    share = F.when((F.col("af") > 0) & (F.col("af") < 1), F.col("af"))
    moments = seen.agg(F.count("*").alias("n"), F.avg(share).alias("mean"), F.var_pop(share).alias("var")).first()
    if moments.n < 3:
        return None
    lists = {kind: ([], []) for kind in "kmn"}
    for r in seen.select(kinds).groupBy("c.kind", "c.x").agg(F.count("*").alias("n")).toLocalIterator():
        lists[r["kind"]][0].append(r["x"])
        lists[r["kind"]][1].append(r["n"])
    return fit_beta_binomial(*(lists[kind] for kind in "kmn"), moments.mean, moments["var"])


def quality_control(calls: DataFrame, *, least_depth: int = 100, least_quality: float = 20.0, prior: float = 5e-8 * 16569, least_posterior: float = 0.9, rounds: int = 20, tolerance: float = 1e-3, bins: int = 100) -> tuple[DataFrame, DataFrame]:
    """(calls with error, alpha, beta, pp, good, kept and mutation; sites with pass and kl).

    calls: pos, sample, idx (0: reference), ploidy, ad, dp, af, aq, srf, fs, sor; a sample with a missing number takes no part, but
    stays, with pp 0. Sites without background samples are left out. A site's error model comes from its background; the model
    of true shares is a Beta-Binomial, fitted first to the balanced evidence, then to all alternative alleles of the samples called as
    mutations (a posterior above ``least_posterior``), until fewer than ``tolerance`` of the samples' calls change, at most
    ``rounds`` times, or fewer than three are left to fit. good is that last round's; kept is an alternative allele that no round has
    found below the posterior; as every allele is weighed against errors, mutation is also true of samples that hold the reference
    alone and surely. kl holds the site's shares against its own error model, 0 without any.
    """
    sites = durable(background(calls, least_depth, least_quality))
    sample = Window.partitionBy("pos", "sample")
    numbers = ["ad", "dp", "af", "aq", "srf"]
    missing = F.max(F.coalesce(*[F.when(F.col(c).isNull(), 1) for c in numbers], F.lit(0))).over(sample) > 0
    k, n = F.col("ad").cast("double"), F.col("dp").cast("double")
    error = log_beta_share(k, n, F.col("alpha"), F.col("beta"))
    known = ~F.col("pre_filtered") & (n > 0) & (k >= 0) & (k <= n)
    joined = calls.join(sites.select("pos", "error", "alpha", "beta"), "pos").withColumn("pre_filtered", missing)
    rows = durable(joined.withColumns({"log_error": F.when(known, error), "lowest": F.lit(1.0), "mutation": F.lit(False)}))
    total = rows.select("pos", "sample").distinct().count()
    sure = F.when(F.col("aq") < least_quality, 1 / (1 + F.exp(10 * (F.lit(float(least_quality)) - F.col("aq"))))).otherwise(F.lit(1.0))
    weight = F.ln(sure * F.col("srf") + 1e-12)
    shape = _shape(balanced(durable(evidence(rows.where("NOT pre_filtered").select(*calls.columns), sites, least_depth, least_quality)))) or DEFAULT_SHAPE
    for turn in range(rounds):
        a, b = shape
        mutation = log_beta_share(k, n, F.lit(float(a)), F.lit(float(b))) + weight
        scored = rows.withColumn("pp", F.when(F.col("log_error").isNotNull(), st.posterior(F.col("log_error"), mutation, prior)).otherwise(F.lit(0.0)))
        flagged = scored.withColumns({"before": F.col("mutation"), "lowest": F.least("lowest", "pp"), "mutation": F.max("pp").over(sample) > least_posterior})
        rows = durable(flagged)
        changed = rows.where("mutation <> before").select("pos", "sample").distinct().count()
        if changed < tolerance * max(1, total):
            break
        called = rows.where("mutation AND idx > 0 AND ad > 0 AND ad < dp").withColumn("af", F.col("ad") / F.col("dp"))
        fitted = _shape(called) if turn + 1 < rounds else None
        if fitted is None:
            break
        shape = fitted
    out = rows.withColumns({"good": F.col("pp") > least_posterior, "kept": (F.col("idx") > 0) & (F.col("lowest") > least_posterior)})
    divergence = histogram_divergence(rows.where("NOT pre_filtered"), ["pos"], bins, F.col("alpha"), F.col("beta"))
    passes = out.groupBy("pos").agg(F.bool_or("mutation").alias("pass")).join(divergence, "pos", "left").withColumn("kl", F.greatest(F.coalesce("kl", F.lit(0.0)), F.lit(0.0)))
    return out.drop("log_error", "lowest", "before"), passes
