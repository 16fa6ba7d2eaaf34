"""Association of feature dosages with a phenotype, one feature per group of sparse rows.

Dosages come sparse (feature, sample, dose), zeros left out; the phenotype table (sample, y) is the sample
axis. All linear tests need only sums over the carriers plus sums over all samples, so a feature costs one
row per carrier and one partial aggregation; no dense matrix is made. Tests with covariates take them out
of y once (Frisch-Waugh); only small per-feature sums reach the Arrow functions, which turn statistics
into tail probabilities.

Defined results: rows whose sample has no phenotype take no part; a null dose counts as 0; constant
features have null statistics; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions import tails
from spangraph.session import cut_lineage


def _elementwise(f, *cols: Column | str) -> Column:
    """``f`` on each row of the columns, as an Arrow function; null where any of them is null."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([f(*row) if all(v == v for v in row) else None for row in zip(*parts)], dtype="float64")

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf((one, two, three)[len(cols) - 1], "double")(*cols)


def t_p(t: Column | str, df: Column | str) -> Column:
    return _elementwise(tails.t_two_sided, t, df)


def f_p(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _elementwise(tails.f_tail, f, d1, d2)


def chi2_p(x: Column | str, df: Column | str) -> Column:
    return _elementwise(tails.chi2_tail, x, df)


def quantile(p: Column | str) -> Column:
    return _elementwise(tails.normal_quantile, p)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def exact_sum(rows: DataFrame, *factors: str) -> Column:
    """The sum of a product of columns as a double; whole numbers are added exactly, since sums of squares leave the range of a long."""
    wide = [F.col(c).cast("decimal(20,0)") if rows.schema[c].dataType.simpleString() in WHOLE else F.col(c) for c in factors]
    return F.sum(math.prod(wide[1:], start=wide[0])).cast("double")


def sums(doses: DataFrame, pheno: DataFrame) -> DataFrame:
    """(feature, carriers, g, gg, gy, n, y, yy): the sums that every linear test needs; all but ``carriers`` are doubles, as their products leave the range of a long."""
    known = pheno.where("y is not null")
    rows = doses.join(known, "sample").withColumn("d", F.coalesce("dose", F.lit(0)))
    per = rows.groupBy("feature").agg(
        F.count_if(F.col("d") != 0).alias("carriers"), exact_sum(rows, "d").alias("g"), exact_sum(rows, "d", "d").alias("gg"), exact_sum(rows, "d", "y").alias("gy")
    )
    whole = known.agg(F.struct(F.count("y").cast("double").alias("n"), exact_sum(known, "y").alias("y"), exact_sum(known, "y", "y").alias("yy")))
    return per.withColumn("__w", whole.scalar()).select("*", "__w.*").drop("__w")


def linear(stats: DataFrame) -> DataFrame:
    """Adds beta, se and t of the least-squares fit with an intercept, from the sums."""
    sxx = F.col("n") * F.col("gg") - F.col("g") * F.col("g")
    sxy = F.col("n") * F.col("gy") - F.col("g") * F.col("y")
    syy = F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    out = stats.withColumn("beta", F.try_divide(sxy.cast("double"), F.when(sxx != 0, sxx.cast("double"))))
    rss = (syy.cast("double") - F.col("beta") * sxy.cast("double")) / F.col("n")
    spread = F.try_divide(F.try_divide(F.greatest(rss, F.lit(0.0)), F.col("n") - 2), F.when(sxx != 0, sxx.cast("double") / F.col("n")))
    out = out.withColumn("se", F.sqrt(spread))
    return out.withColumn("t", F.try_divide("beta", F.when(F.col("se") > 0, F.col("se"))))


def linear_with_covariates(doses: DataFrame, pheno: DataFrame, covariates: list[str]) -> DataFrame:
    """(feature, beta, se, t, df) of the least-squares fit of y on the dose, an intercept and the covariates.

    The covariates are projected out through cross-products: those of the sample axis are a matrix of
    (covariates + 2) squared numbers, the only thing that reaches the driver; those of a feature are sums
    over its carriers. Samples with any null among y and the covariates take no part.
    """
    known = pheno.select("sample", "y", *covariates).dropna().withColumn("__1", F.lit(1.0))
    axis = ["__1", *covariates]
    sides = [*axis, "y"]
    cross = known.agg(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a in sides for b in sides], F.count(F.lit(1))).first()
    q = len(sides)
    whole = np.array([x or 0.0 for x in cross[:-1]], float).reshape(q, q)
    n = cross[-1]
    inverse = np.linalg.pinv(whole[:-1, :-1])
    df = n - len(axis) - 1
    per = doses.join(known, "sample").groupBy("feature").agg(
        F.array(*[F.sum(F.col("dose") * F.col(a)).cast("double") for a in axis]).alias("gx"),
        F.sum(F.col("dose") * F.col("dose")).cast("double").alias("gg"), F.sum(F.col("dose") * F.col("y")).cast("double").alias("gy"),
    )

    def fit(gx: pd.Series, gg: pd.Series, gy: pd.Series) -> pd.DataFrame:
        x = np.stack(gx.to_numpy())
        ss = gg.to_numpy() - np.einsum("ij,jk,ik->i", x, inverse, x)
        sxy = gy.to_numpy() - x @ inverse @ whole[:-1, -1]
        rss0 = whole[-1, -1] - whole[-1, :-1] @ inverse @ whole[:-1, -1]
        live = (ss > 1e-9 * np.maximum(gg.to_numpy(), 1e-300)) & (df > 0)
        beta = np.where(live, sxy / np.where(live, ss, 1), np.nan)
        se = np.sqrt(np.maximum(rss0 - beta * sxy, 0) / max(df, 1) / np.where(live, ss, 1))
        return pd.DataFrame({"beta": beta, "se": se}).astype(object).where(lambda d: d.notna(), None)

    made = per.select("feature", F.pandas_udf(fit, "beta double, se double")("gx", "gg", "gy").alias("r"))
    t = F.when(F.col("r.se") > 0, F.col("r.beta") / F.col("r.se"))
    return made.select("feature", "r.beta", "r.se", t.alias("t"), F.lit(df).alias("df"))


def score(stats: DataFrame) -> DataFrame:
    """Adds u, v and z of the score test of a 0/1 phenotype under the intercept-only null model."""
    share = F.col("y") / F.col("n")
    u = F.col("gy") - F.col("g") * share
    v = share * (1 - share) * (F.col("gg") - F.col("g") * F.col("g") / F.col("n"))
    out = stats.withColumn("u", u).withColumn("v", v)
    return out.withColumn("z", F.when(F.col("v") > 0, F.col("u") / F.sqrt("v")))


def score_with_covariates(doses: DataFrame, pheno: DataFrame, covariates: list[str], rounds: int = 50) -> DataFrame:
    """(feature, u, v, z) of the score test of a 0/1 phenotype beside an intercept and covariates.

    The null model is fitted by reweighted least squares in rounds, each one aggregate over the samples that
    brings (covariates + 1) squared sums to the driver. A feature then needs the sums of g(y - mu), g^2 w and g w x over its
    carriers. Samples with any null take no part; raises if the null model has not settled.
    """
    axis = ["__1", *covariates]
    known = pheno.select("sample", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in covariates]).dropna().withColumn("__1", F.lit(1.0))
    beta = np.zeros(len(axis))

    def with_mu(b: np.ndarray) -> DataFrame:
        eta = sum((F.lit(float(v)) * F.col(a) for v, a in zip(b, axis)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
        return known.withColumn("__mu", mu).withColumn("__w", F.col("__mu") * (1 - F.col("__mu")))

    for _ in range(rounds):
        at = with_mu(beta)
        row = at.agg(*[F.sum(F.col("__w") * F.col(a) * F.col(b)) for a in axis for b in axis], *[F.sum((F.col("y") - F.col("__mu")) * F.col(a)) for a in axis]).first()
        sums = np.array([x or 0.0 for x in row], float)
        cov = np.linalg.pinv(sums[: len(axis) ** 2].reshape(len(axis), len(axis)))
        step = cov @ sums[len(axis) ** 2 :]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    else:
        raise RuntimeError("the null model has not settled: a covariate may separate the cases")
    g = F.col("dose").cast("double")
    per = doses.join(with_mu(beta), "sample").groupBy("feature").agg(
        F.sum(g * (F.col("y") - F.col("__mu"))).alias("u"), F.sum(g * g * F.col("__w")).alias("gg"), F.array(*[F.sum(g * F.col("__w") * F.col(a)) for a in axis]).alias("gx")
    )
    inner = sum((F.col("gx")[i] * F.col("gx")[j] * F.lit(float(cov[i, j])) for i in range(len(axis)) for j in range(len(axis))), F.lit(0.0))
    out = per.withColumn("v", F.col("gg") - inner)
    z = F.when(F.col("v") > 1e-9 * F.col("gg"), F.col("u") / F.sqrt("v"))
    return out.select("feature", "u", "v", z.alias("z"))


def genotypic(doses: DataFrame, pheno: DataFrame) -> DataFrame:
    """(feature, classes, f, df1, df2): the means of the dose classes (no dose is class 0) against one mean."""
    y = pheno.where("y is not null").select("sample", "y")
    total = exact_sum(y, "y").alias("s")
    d = doses.where("dose <> 0").join(y, "sample").groupBy("feature", "dose").agg(F.count(F.lit(1)).alias("n"), total)
    whole = y.agg(F.struct(F.count("y").alias("n"), total, exact_sum(y, "y", "y").alias("ss")).alias("w"))
    held = d.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    r = held.withColumn("w", whole.scalar()).withColumn("n0", F.col("w.n") - F.col("n")).withColumn("s0", F.col("w.s") - F.col("s"))
    k = F.col("k") + F.when(F.col("n0") > 0, 1).otherwise(0)
    between = F.col("b") + F.when(F.col("n0") > 0, F.col("s0") * F.col("s0") / F.col("n0")).otherwise(0.0) - F.col("w.s") * F.col("w.s") / F.col("w.n")
    within = F.col("w.ss") - F.col("w.s") * F.col("w.s") / F.col("w.n") - between
    f = F.when((k > 1) & (F.col("w.n") > k), F.try_divide(between / (k - 1), within / (F.col("w.n") - k)))
    return r.select("feature", k.alias("classes"), f.alias("f"), (k - 1).alias("df1"), (F.col("w.n") - k).alias("df2"))


def burden(doses: DataFrame, pheno: DataFrame, group: str, most_carriers: int = 10) -> DataFrame:
    """The linear test of the summed doses of the rare features of each group; ``feature`` holds the group."""
    rare = doses.groupBy("feature").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= most_carriers).select("feature")
    summed = doses.join(rare, "feature").groupBy(F.col(group).alias("feature"), "sample").agg(F.sum("dose").alias("dose"))
    return linear(sums(summed, pheno))


def running_counts(values: DataFrame, value: str, blocks: int = 256) -> DataFrame:
    """(value, block, c, upto): how often each distinct value occurs, and how many rows have at most that value.

    Distinct values are laid into at most ``blocks`` ranges by approximate quantiles, so that each range
    is counted in a task of its own; only the totals of the ranges are added up in one place. Null values
    are left out. ``values`` is read twice and should be materialised if it is costly or not repeatable.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    marks = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    bounds = sorted(set(counts.agg(F.percentile_approx(value, marks)).first()[0] or []))
    block = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col(value))) if bounds else F.lit(0)
    laid = counts.withColumn("block", block)
    totals = laid.groupBy("block").agg(F.sum("c").alias("__all"))
    before = totals.select("block", (F.sum("__all").over(W.orderBy("block")) - F.col("__all")).alias("__before"))  # at most ``blocks`` rows
    inside = W.partitionBy("block").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return laid.join(F.broadcast(before), "block").select(value, "block", "c", (F.col("__before") + F.sum("c").over(inside)).alias("upto"))


def adjusted(tested: DataFrame, feature: str, p: str) -> DataFrame:
    """(feature, p, bonferroni, q): corrected for the number of tests; null and NaN p take no part.

    Ties share the q of their last rank, so ranks are those of distinct p, counted range by range.
    """
    known = cut_lineage(tested.where(F.col(p).isNotNull() & ~F.isnan(p)).select(feature, p))
    m = known.agg(F.count(F.lit(1))).scalar()
    ranked = running_counts(known, p).withColumn("step", F.least(F.lit(1.0), F.col(p) * m / F.col("upto")))
    lows = ranked.groupBy("block").agg(F.min("step").alias("low"))
    later = lows.select("block", F.min("low").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))  # one row per range
    back = W.partitionBy("block").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    q = ranked.join(F.broadcast(later), "block").select(p, F.least(F.min("step").over(back), "later").alias("q"))
    return known.join(q, p).select(feature, p, F.least(F.lit(1.0), F.col(p) * m).alias("bonferroni"), "q")


def pairs_r2(doses: DataFrame, n_samples: DataFrame, group: str) -> DataFrame:
    """(group, a, b, r2), a < b: squared correlation of the doses of features of one group that share a carrier."""
    one = doses.where("dose <> 0")
    per = one.groupBy(group, "feature").agg(F.sum("dose").alias("g"), F.sum(F.col("dose") * F.col("dose")).alias("gg"))
    left = one.select(group, "sample", F.col("feature").alias("a"), F.col("dose").alias("da"))
    right = one.select(group, "sample", F.col("feature").alias("b"), F.col("dose").alias("db"))
    both = left.join(right, [group, "sample"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.col("da") * F.col("db")).alias("gh"))
    side = lambda x: per.select(group, F.col("feature").alias(x), F.col("g").alias(f"g_{x}"), F.col("gg").alias(f"gg_{x}"))
    n = n_samples.scalar()
    out = both.join(side("a"), [group, "a"]).join(side("b"), [group, "b"]).withColumn("n", n)
    cov = F.col("n") * F.col("gh") - F.col("g_a") * F.col("g_b")
    va = F.col("n") * F.col("gg_a") - F.col("g_a") * F.col("g_a")
    vb = F.col("n") * F.col("gg_b") - F.col("g_b") * F.col("g_b")
    r2 = F.try_divide(cov.cast("double") * cov.cast("double"), va.cast("double") * vb.cast("double"))
    return out.select(group, "a", "b", r2.alias("r2"))


def dose_columns(doses: DataFrame, group: str) -> DataFrame:
    """(group, feature, samples, values): each feature's carriers as two arrays; a feature's row is bounded by the samples."""
    return doses.where("dose <> 0").groupBy(group, "feature").agg(F.sort_array(F.collect_list(F.struct("sample", "dose"))).alias("__d")).select(
        group, "feature", F.col("__d.sample").alias("samples"), F.col("__d.dose").alias("values")
    )


def dense(samples: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """The dense (feature, sample) matrix of one group."""
    at = {s: i for i, s in enumerate(samples)}
    out = np.zeros((len(rows), len(samples)))
    for i, (who, what) in enumerate(zip(rows["samples"], rows["values"])):
        for s, v in zip(who, what):
            if s in at:
                out[i, at[s]] = v
    return out


def effective_tests(matrix: np.ndarray) -> float:
    """Number of independent tests by Li and Ji (2005): over the eigenvalues x of the features' correlation, the sum of [x >= 1] + x - floor(x).

    Eigenvalues are squared singular values of the standardised rows. Equal rows (or opposite ones) are kept once, with
    their number as a weight, so that exact copies give exact whole numbers; a whole number is one reached within
    the error bound of the decomposition. Rounded up, and never more than the features that vary.
    """
    live = matrix[matrix.std(axis=1) > 0]
    if not len(live):
        return 0.0
    z = live - live.mean(axis=1, keepdims=True)
    z /= np.sqrt((z**2).sum(axis=1, keepdims=True))
    lead = np.take_along_axis(z, np.argmax(np.abs(z) > 1e-12, axis=1)[:, None], axis=1)
    kept, copies = np.unique(np.round(z * np.sign(lead), 12), axis=0, return_counts=True)
    return effective_of(np.linalg.svd(kept * np.sqrt(copies)[:, None], compute_uv=False) ** 2, len(live))


def effective_of(values: np.ndarray, n_varying: int) -> float:
    """The same from the eigenvalues of the correlation, given as those of the features' or of the samples' products."""
    if not n_varying:
        return 0.0
    slack = 1e-9 + 4 * max(len(values), n_varying) * np.finfo(float).eps * values.max()
    whole = np.floor(values + slack)
    total = float(np.clip(whole, 0, 1).sum() + np.maximum(values - whole, 0)[values > slack].sum())
    return float(min(n_varying, math.ceil(total - 1e-6)))


def logistic(
    x: np.ndarray, y: np.ndarray, rounds: int = 50, tol: float = 1e-8, firth: bool = False, counts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors by reweighted least squares, with Jeffreys' penalty where ``firth``.

    With ``counts`` a row stands for so many samples and ``y`` is their share of cases. NaN where the rounds do not settle.
    """
    times = np.ones(len(y)) if counts is None else counts
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = times * mu * (1 - mu)
        cov = np.linalg.pinv(x.T @ (w[:, None] * x))
        gap = times * (y - mu)
        if firth:
            hat = w * np.einsum("ij,jk,ik->i", x, cov, x)
            gap = gap + hat * (0.5 - mu)
        step = cov @ (x.T @ gap)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta += step
        if np.abs(step).max() < tol:
            break
    else:  # not settled: no estimate is better than the last of a run that goes on
        return np.full(len(beta), np.nan), np.full(len(beta), np.nan)
    return beta, np.sqrt(np.diag(cov))


def dose_classes(doses: DataFrame, group: str, cases: DataFrame) -> DataFrame:
    """(group, feature, n, cases, classes): per feature the samples and cases of each non-zero dose.

    ``cases`` is (group, sample, case). ``classes`` holds (dose, n, cases), one entry per distinct dose, so
    a feature stays small however many samples carry it; ``n`` and ``cases`` are those of the whole group.
    """
    known = cases.where("case is not null")
    whole = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("case").cast("long").alias("cases"))
    per = doses.where("dose <> 0").join(known, [group, "sample"]).groupBy(group, "feature", "dose").agg(F.count(F.lit(1)).alias("k"), F.sum("case").cast("long").alias("hit"))
    held = per.groupBy(group, "feature").agg(F.sort_array(F.collect_list(F.struct(F.col("dose").cast("double").alias("dose"), "k", "hit"))).alias("classes"))
    return held.join(whole, group)


# The grid of mixing shares between kernel and burden test.
SHARES = (0.0, 0.01, 0.04, 0.09, 0.16, 0.25, 0.5, 1.0)


def kernel_tests(z: np.ndarray, residual: np.ndarray) -> tuple[float, float, float]:
    """(burden, kernel, optimal) p-values of a set of features, one weighted, centred feature per row of ``z``."""
    _, single, vectors = np.linalg.svd(z, full_matrices=False)
    return kernel_tests_of(single**2, vectors.T, z.sum(axis=0), len(z), residual)


def kernel_tests_of(values: np.ndarray, vectors: np.ndarray, summed: np.ndarray, p: int, residual: np.ndarray) -> tuple[float, float, float]:
    """(burden, kernel, optimal) p-values of ``p`` features against the residual of the null model.

    The features come as eigenvalues and vectors of the samples' products and as their sum per sample; all is worked
    in the space of those vectors. For each mixing share the statistic is a mixture of
    chi-squares. The optimal test takes the least p of the grid and integrates over the part that all
    shares have in common, a one-df chi-square; within the integral tails are matched by moments. Its
    result is kept between the least p and that times the size of the grid.
    """
    spread = float(residual.std(ddof=1))
    keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    if not keep.any() or not spread > 0:
        return math.nan, math.nan, math.nan
    size_all = float(values[keep].sum())
    lengths, basis = values[keep] / size_all, vectors[:, keep]
    total = basis.T @ summed / math.sqrt(size_all)
    r = basis.T @ residual / spread
    squares, burden_score = float(lengths @ r**2), float(total @ r)

    def live(square: np.ndarray) -> np.ndarray:
        found = np.linalg.eigvalsh(square)
        return found[found > 1e-10 * max(found.max(), 1e-300)]

    weights = [live((1 - share) * np.diag(lengths) + share * np.outer(total, total)) for share in SHARES]
    stats = [(1 - share) * squares + share * burden_score**2 for share in SHARES]
    found = [tails.mixture_tail(q, w) if len(w) else 1.0 for q, w in zip(stats, weights)]
    burden, kernel, least = found[-1], found[0], min(found)
    mean = total / p
    size = float(mean @ mean)
    if p == 1 or size * p <= 1e-12 or least <= 0:
        return burden, kernel, min(1.0, least * (1 if p == 1 else len(SHARES)))
    along = float(lengths @ mean**2) / size**2  # squared length of the features' parts along the mean feature
    cross_part = lengths * mean / size - mean * along
    both = np.outer(lengths * mean / size, mean)
    other = live(np.diag(lengths) - both - both.T + along * np.outer(mean, mean))
    if not len(other):
        return burden, kernel, least
    own, cross = 2 * float((other**2).sum()), 4 * size * float((cross_part**2).sum())
    centre, shrink = float(other.sum()), math.sqrt(own / (own + cross))
    shares = np.minimum(SHARES, 0.999)
    limits = np.array([tails.moment_quantile(least, w) if len(w) else np.inf for w in weights])
    common = size * (p * p * shares + (1 - shares) * along)
    nodes, gauss = np.polynomial.legendre.leggauss(96)
    at, step = 4.5 * (nodes + 1), 4.5 * gauss  # the common part is the square of a normal variable, from 0 to 9
    bound = ((limits - np.outer(at**2, common)) / (1 - shares)).min(axis=1)
    inner = np.array([tails.moment_tail((b - centre) * shrink + centre, other) for b in bound])
    optimal = float((step * inner * 2 * np.exp(-at * at / 2) / math.sqrt(2 * math.pi)).sum())
    return burden, kernel, min(1.0, max(least, min(optimal, len(SHARES) * least)))


def partial_t(m: np.ndarray, y: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(t, beta, df) of each row of ``m`` in a linear fit of ``y`` beside the columns ``base``; t is NaN where the base explains the row."""
    q, _ = np.linalg.qr(base)
    ry = y - q @ (q.T @ y)
    rg = m - (m @ q) @ q.T
    ss = (rg**2).sum(axis=1)
    ok = ss > 1e-8 * np.maximum((m**2).sum(axis=1), 1e-12)
    df = len(y) - base.shape[1] - 1
    beta = np.where(ok, (rg @ ry) / np.where(ok, ss, 1), 0)
    rss = np.maximum((ry**2).sum() - beta**2 * ss, 1e-12)
    return np.where(ok, beta / np.sqrt(rss / max(df, 1) / np.where(ok, ss, 1)), np.nan), beta, df


def variance_ratio(values: np.ndarray, ry: np.ndarray, rx: np.ndarray) -> float:
    """The ratio of residual to kinship variance that maximises the restricted likelihood, on rotated data.

    Roots of the likelihood's derivative in the ratio d: with weights 1 / (value + d), residuals r and their weighted sum
    of squares q, it is df * sum(w^2 r^2) / q - sum(w) + tr((X'WX)^-1 X'W^2X). Signs are taken at powers of two over the
    scale of the eigenvalues, each fall through zero is narrowed 64-fold at a time, and the likeliest of the
    roots and of the two ends is the answer.
    """
    df = len(ry) - rx.shape[1]

    def at(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(derivative, log-likelihood), both times two, of each ratio."""
        w = 1 / (values + ratios[:, None])
        inverse = np.linalg.pinv(np.einsum("dn,ni,nj->dij", w, rx, rx, optimize=True))
        r = ry - np.einsum("dij,dj->di", inverse, (w * ry) @ rx) @ rx.T
        q = np.maximum((w * r * r).sum(axis=1), 1e-300)
        trace = np.einsum("dij,dji->d", inverse, np.einsum("dn,ni,nj->dij", w * w, rx, rx, optimize=True))
        slope = df * (w * w * r * r).sum(axis=1) / q - w.sum(axis=1) + trace
        return slope, -df * np.log(q / df) + np.log(w).sum(axis=1) + np.linalg.slogdet(inverse)[1]

    def falls(marks: np.ndarray) -> list[tuple[float, float]]:
        slopes = at(marks)[0]
        return [(marks[i], marks[i + 1]) for i in np.flatnonzero((slopes[:-1] > 0) & (slopes[1:] <= 0))]

    marks = max(float(values.max()), 1e-12) * 2.0 ** np.arange(-24, 25)
    found = [marks[0], marks[-1]]
    for lo, hi in falls(marks):
        for _ in range(7):
            lo, hi = next(iter(falls(np.geomspace(lo, hi, 65))), (lo, hi))
        found.append(math.sqrt(lo * hi))
    found = np.array(found)
    return float(found[np.argmax(at(found)[1])])


def mixed_null(y: np.ndarray, x: np.ndarray, kinship: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Variance ratio of the null model, and eigenvalues and vectors of the kinship."""
    values, vectors = np.linalg.eigh(kinship)
    values = np.maximum(values, 0)
    return variance_ratio(values, vectors.T @ y, vectors.T @ x), values, vectors


def mixed_test(g: np.ndarray, y: np.ndarray, x: np.ndarray, delta: float | None, values: np.ndarray, vectors: np.ndarray) -> tuple[float, float, float]:
    """(beta, se, p) of one dosage under the mixed model; the variance ratio is fitted anew beside the dosage where ``delta`` is None."""
    z = vectors.T @ np.column_stack([x, g])
    ry = vectors.T @ y
    w = 1 / (values + (variance_ratio(values, ry, z) if delta is None else delta))
    cov = np.linalg.pinv(z.T @ (w[:, None] * z))
    beta = cov @ (z.T @ (w * ry))
    df = len(y) - z.shape[1]
    s2 = float(np.sum(w * (ry - z @ beta) ** 2)) / df
    se = math.sqrt(max(s2 * cov[-1, -1], 0))
    return float(beta[-1]), se, tails.t_two_sided(beta[-1] / se, df) if se > 0 else math.nan


def fine_map(matrix: np.ndarray, y: np.ndarray, effects: int = 10, rounds: int = 100, coverage: float = 0.95) -> tuple[np.ndarray, list[list[int]]]:
    """Sum of single effects: inclusion probabilities and credible sets, by iterative Bayesian stepwise selection.

    Each effect is one-hot over the features with a normal prior whose variance is re-estimated by a few
    moment updates; sets must have a least absolute correlation of 0.5.
    """
    live = matrix.std(axis=1) > 0
    z = np.where(live[:, None], (matrix - matrix.mean(axis=1, keepdims=True)) / np.where(live, matrix.std(axis=1), 1)[:, None], 0)
    target = y - y.mean()
    n, p = len(y), len(z)
    sigma = float(target.var()) or 1.0
    alpha, mean = np.full((effects, p), 1 / max(p, 1)), np.zeros((effects, p))
    second, prior = np.zeros((effects, p)), np.full(effects, 0.2 * sigma)
    for _ in range(rounds):
        old = alpha.copy()
        fitted = (alpha * mean).sum(axis=0) @ z
        for k in range(effects):
            fitted -= (alpha[k] * mean[k]) @ z
            bhat = z @ (target - fitted) / n
            s2 = sigma / n
            v = prior[k]
            log_bf = 0.5 * (np.log(s2 / (s2 + v)) + bhat**2 / s2 * v / (s2 + v))
            log_bf[~live] = -np.inf
            weight = np.exp(log_bf - log_bf.max()) if p else log_bf
            alpha[k] = weight / weight.sum()
            post = v * s2 / (v + s2)
            mean[k] = bhat * v / (v + s2)
            second[k] = post + mean[k] ** 2
            prior[k] = max(float(alpha[k] @ second[k]), 1e-12 * sigma)
            fitted += (alpha[k] * mean[k]) @ z
        spread = n * (alpha * second).sum() - sum(float(((alpha[k] * mean[k]) @ z) @ ((alpha[k] * mean[k]) @ z)) for k in range(effects))
        sigma = max((float(((target - fitted) ** 2).sum()) + spread) / n, 1e-12)
        if np.abs(alpha - old).max() < 1e-6:
            break
    strong = [k for k in range(effects) if prior[k] > 1e-6 * float(target.var() or 1)]
    pip = 1 - np.prod([1 - alpha[k] for k in strong], axis=0) if strong else np.zeros(p)
    sets = []
    for k in strong:
        order = np.argsort(-alpha[k], kind="stable")
        size = int(np.searchsorted(np.cumsum(alpha[k][order]), coverage)) + 1
        members = sorted(order[:size].tolist())
        if size <= n and np.abs(np.corrcoef(z[members])).min() >= 0.5 and members not in sets:
            sets.append(members)
    return pip, sets
