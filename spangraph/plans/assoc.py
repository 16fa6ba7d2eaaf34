"""Queries of dosage features and their association with a phenotype.

Features are the nodes of ``graph_paths``, a locus is a graph, a sample is a person with up to two
haplotype slots. The phenotype of sample ``smpN`` is the balance of customer N in cents, the 0/1
phenotype whether the customer's market segment is one of the first three by name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions import tails
from spangraph.operators import assoc as A
from spangraph.operators import locus as L
from spangraph.operators.cluster import greedy_leaders
from spangraph.plans.walks import SITES, STEPS, paths, read_crossings, sites, steps
from spangraph.tables import load

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")


def phenotypes(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, y, case) of the samples that have a walk."""
    who = paths(spark, folder).select(F.col("sample_name").alias("sample"), F.expr("try_cast(substring(sample_name, 4) as bigint)").alias("c_custkey")).distinct()
    c = load(spark, folder, "customer")
    return who.join(c, "c_custkey").select("sample", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("y"), F.col("c_mktsegment").isin(*SEGMENTS).cast("bigint").alias("case"))


def doses(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_name, feature, sample, dose): visits to each node by all haplotypes of each sample."""
    walked = steps(spark, folder, "graph_name", "sample_name")
    return walked.groupBy("graph_name", F.col("node_id").alias("feature"), F.col("sample_name").alias("sample")).agg(F.count(F.lit(1)).alias("dose"))


def sample_dosage(spark: SparkSession, folder: str) -> DataFrame:
    """Dose of each sample with its completeness: observed only where both slots have exactly one walk of the graph."""
    p = paths(spark, folder).where("haplotype is not null")
    slots = p.groupBy("graph_name", "sample_name", "haplotype").agg(F.count(F.lit(1)).alias("n"))
    whole = slots.groupBy("graph_name", "sample_name").agg((F.count(F.lit(1)) == 2).alias("two"), (F.max("n") == 1).alias("once"))
    ok = whole.select("graph_name", F.col("sample_name").alias("sample"), (F.col("two") & F.col("once")).alias("complete"))
    return doses(spark, folder).join(ok, ["graph_name", "sample"]).select("feature", "sample", F.when(F.col("complete"), F.col("dose")).alias("dose"))


def pooled_dosage(spark: SparkSession, folder: str) -> DataFrame:
    """Inside steps per path pooled over all sites of one kind in a graph; null unless every one of them is crossed."""
    at = read_crossings(spark, folder).join(sites(spark, folder).where("kind is not null").select("bubble_id", "kind"), "bubble_id")
    at = at.join(paths(spark, folder).select("path_name", "graph_name"), "path_name")
    n_sites = at.select("graph_name", "kind", "bubble_id").distinct().groupBy("graph_name", "kind").agg(F.count(F.lit(1)).alias("n_sites"))
    per = at.groupBy("graph_name", "kind", "path_name").agg(F.count_distinct("bubble_id").alias("crossed"), F.sum(F.size("inside")).alias("n"))
    return per.join(n_sites, ["graph_name", "kind"]).select("kind", "path_name", "crossed", F.when(F.col("crossed") == F.col("n_sites"), F.col("n")).alias("dose"))


def dosage_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Doses scaled to 0..2 by the feature's least and largest; constant features are 0."""
    one = W.partitionBy("feature")
    d = doses(spark, folder).withColumn("lo", F.min("dose").over(one)).withColumn("hi", F.max("dose").over(one))
    scaled = F.when(F.col("hi") > F.col("lo"), 2.0 * (F.col("dose") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return d.select("feature", "sample", F.round(scaled, 6).alias("dose"))


def minor_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """One less the share of the most frequent dose among carriers; ties to the smaller dose."""
    per = doses(spark, folder).groupBy("feature", "dose").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("feature").agg(F.max(F.struct(F.col("n"), (-F.col("dose")).alias("d"))).alias("t"), F.sum("n").alias("all"))
    return top.select("feature", (-F.col("t.d")).alias("mode"), F.round(1 - F.col("t.n") / F.col("all"), 6).alias("minor_freq"))


def haplotype_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Sum, least and largest dose over the haplotypes of a sample."""
    walked = steps(spark, folder, "sample_name")
    per = walked.groupBy("node_id", "sample_name", "path_name").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("node_id").alias("feature"), F.col("sample_name").alias("sample")).agg(
        F.sum("n").alias("dose_sum"), F.min("n").alias("dose_min"), F.max("n").alias("dose_max")
    )


def pheno_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """(rank - 0.5) / n of each phenotype, ties sharing their mean rank."""
    y = phenotypes(spark, folder).where("y is not null")
    counts = A.running_counts(y, "y")
    rank = F.col("upto") - (F.col("c") - 1) / 2
    share = (rank - 0.5) / y.agg(F.count(F.lit(1))).scalar()
    return y.join(counts, "y").select("sample", F.round(share, 9).alias("share"))


def pheno_inverse_normal(spark: SparkSession, folder: str) -> DataFrame:
    return pheno_ranks(spark, folder).select("sample", A.quantile("share").alias("z"))


def _linear(spark: SparkSession, folder: str) -> DataFrame:
    return A.linear(A.sums(doses(spark, folder), phenotypes(spark, folder).select("sample", "y")))


def assoc_linear(spark: SparkSession, folder: str) -> DataFrame:
    r = _linear(spark, folder)
    return r.select("feature", "carriers", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("t", 6).alias("t"))


def assoc_tested(spark: SparkSession, folder: str) -> DataFrame:
    """Linear test with p, Bonferroni and Benjamini-Hochberg q."""
    p = _linear(spark, folder).where("t is not null").select("feature", A.t_p("t", (F.col("n") - 2).cast("double")).alias("p"))
    return A.adjusted(p, "feature", "p")


def assoc_score(spark: SparkSession, folder: str) -> DataFrame:
    r = A.score(A.sums(doses(spark, folder), phenotypes(spark, folder).select("sample", F.col("case").alias("y"))))
    return r.select("feature", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round("z", 6).alias("z"))


def assoc_genotypic(spark: SparkSession, folder: str) -> DataFrame:
    """F statistic of the means of the dose classes (no visit is class 0) against one mean."""
    return A.genotypic(doses(spark, folder), phenotypes(spark, folder)).select("feature", "classes", F.round("f", 5).alias("f"))


def assoc_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The ten strongest features of each locus by |t|, ties to the lesser id."""
    r = _linear(spark, folder).join(doses(spark, folder).select("graph_name", "feature").distinct(), "feature").where("t is not null")
    order = W.partitionBy("graph_name").orderBy(F.desc(F.round(F.abs("t"), 6)), "feature")
    return r.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("graph_name", "feature", "rank")


def assoc_lambda(spark: SparkSession, folder: str) -> DataFrame:
    """Genomic inflation: the median of t squared over that of chi-square with one degree of freedom."""
    return _linear(spark, folder).agg(F.count("t").alias("n_tests"), F.round(F.percentile(F.round(F.col("t") * F.col("t"), 6), F.lit(0.5)) / 0.4549364, 4).alias("lambda_gc"))


def assoc_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Per locus: tests, the best feature, and how many pass |t| of 2 and 3."""
    r = _linear(spark, folder).join(doses(spark, folder).select("graph_name", "feature").distinct(), "feature").withColumn("a", F.round(F.abs("t"), 6))
    best = F.min_by("feature", F.struct((-F.col("a")).alias("a"), "feature"))
    return r.where("a is not null").groupBy("graph_name").agg(
        F.count(F.lit(1)).alias("n_tests"), best.alias("best"), F.max("a").alias("best_t"), F.count_if(F.col("a") >= 2).alias("past_2"), F.count_if(F.col("a") >= 3).alias("past_3")
    )


def burden(spark: SparkSession, folder: str) -> DataFrame:
    """Linear test of the summed doses of the rare nodes of each locus (at most 10 carriers)."""
    r = A.burden(doses(spark, folder), phenotypes(spark, folder).select("sample", "y"), "graph_name")
    return r.select(F.col("feature").alias("graph_name"), "carriers", F.round("beta", 6).alias("beta"), F.round("t", 6).alias("t"))


def assoc_meff(spark: SparkSession, folder: str) -> DataFrame:
    """p of the linear test times the effective tests of the feature's locus, at most 1."""
    p = _linear(spark, folder).where("t is not null").select("feature", A.t_p("t", (F.col("n") - 2).cast("double")).alias("p"))
    loc = doses(spark, folder).select("graph_name", "feature").distinct()
    held = p.join(loc, "feature").join(locus_meff(spark, folder).select("graph_name", "meff"), "graph_name")
    return held.select("graph_name", "feature", "p", F.least(F.lit(1.0), F.col("p") * F.col("meff")).alias("p_meff"))


def ld_pairs(spark: SparkSession, folder: str) -> DataFrame:
    n = paths(spark, folder).agg(F.count_distinct("sample_name"))
    out = A.pairs_r2(doses(spark, folder), n, "graph_name")
    return out.select("graph_name", "a", "b", F.round("r2", 6).alias("r2"))


def ld_clumps(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy clumps by strength: a feature joins the first stronger leader with r2 above 0.5."""
    near = ld_pairs(spark, folder).where("r2 > 0.5")
    both = near.select("graph_name", F.inline(F.array(F.struct(F.col("a").alias("feature"), F.col("b").alias("other")), F.struct(F.col("b").alias("feature"), F.col("a").alias("other")))))
    ranked = _linear(spark, folder).join(doses(spark, folder).select("graph_name", "feature").distinct(), "feature").where("t is not null")
    ranked = ranked.select("graph_name", "feature", F.round(-F.abs("t"), 6).alias("rank"))
    return greedy_leaders(ranked, "graph_name", "feature", "rank", both, "other")


def locus_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_name, sample, y, case): the samples with a walk of each locus."""
    walked = paths(spark, folder).select("graph_name", F.col("sample_name").alias("sample")).distinct()
    return walked.join(phenotypes(spark, folder), "sample").select("graph_name", "sample", "y", "case")


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_name, sample, y): y in units of the account."""
    return locus_samples(spark, folder).select("graph_name", "sample", (F.col("y") / 100).alias("y"))


def locus_meff(spark: SparkSession, folder: str) -> DataFrame:
    return L.effective(doses(spark, folder), _measured(spark, folder), "graph_name")


def locus_permutation(spark: SparkSession, folder: str, shuffles: int = 199, block_features: int = 512) -> DataFrame:
    """Largest |r| of the locus against shuffles of the phenotype, seeded by the locus name.

    A locus is worked in blocks of about ``block_features`` features, each with the same shuffles; only one
    maximum per shuffle leaves a block.
    """
    cols = A.dose_columns(doses(spark, folder), "graph_name")
    blocks = cols.groupBy("graph_name").agg(F.ceil(F.count(F.lit(1)) / block_features).alias("n_blocks"))
    cols = cols.join(blocks, "graph_name").withColumn("block", F.pmod(F.xxhash64("feature"), F.col("n_blocks"))).drop("n_blocks")
    who = locus_samples(spark, folder).where("y is not null").join(blocks, "graph_name")
    who = who.select("graph_name", "sample", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("sample")
        m = A.dense(right["sample"].to_numpy(), left) if len(left) and len(right) >= 4 else np.zeros((0, 1))
        m = m[m.std(axis=1) > 0]
        y = right["y"].to_numpy(float)
        if not len(m) or y.std() == 0:
            return pd.DataFrame([], columns=["graph_name", "k", "r"])  # columns of no type, since Arrow takes no empty column of texts
        z = (m - m.mean(axis=1, keepdims=True)) / m.std(axis=1, keepdims=True)
        locus = left["graph_name"].iloc[0]
        rng = np.random.default_rng(list(locus.encode()))
        ys = np.stack([y, *[rng.permutation(y) for _ in range(shuffles)]])
        ys = (ys - ys.mean(axis=1, keepdims=True)) / ys.std(axis=1, keepdims=True)
        return pd.DataFrame({"graph_name": locus, "k": range(shuffles + 1), "r": np.abs(z @ ys.T / len(y)).max(axis=0)})

    found = cols.groupBy("graph_name", "block").cogroup(who.groupBy("graph_name", "block")).applyInPandas(best, "graph_name string, k int, r double")
    tops = found.groupBy("graph_name", "k").agg(F.max("r").alias("r"))
    per = tops.groupBy("graph_name").agg(F.max(F.when(F.col("k") == 0, F.col("r"))).alias("best_r"), F.collect_list(F.when(F.col("k") > 0, F.col("r"))).alias("rs"))
    reached = F.size(F.filter("rs", lambda r: r >= F.col("best_r") - 1e-12))
    return per.select("graph_name", "best_r", ((1 + reached) / (shuffles + 1)).alias("p_perm"))


def _case_classes(spark: SparkSession, folder: str) -> DataFrame:
    cases = locus_samples(spark, folder).where("y is not null").select("graph_name", "sample", "case")
    return A.dose_classes(doses(spark, folder), "graph_name", cases)


def locus_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic fit of the 0/1 phenotype on each feature, with Jeffreys' penalty; a feature comes as its dose classes."""

    @F.pandas_udf("beta double, se double, p double")
    def fit(classes: pd.Series, n: pd.Series, cases: pd.Series) -> pd.DataFrame:
        out = []
        for held, total, hit in zip(classes, n, cases):
            d = np.array([(c["dose"], c["k"], c["hit"]) for c in held], float)
            rest = np.array([[0.0, total - d[:, 1].sum(), hit - d[:, 2].sum()]])
            d = np.vstack([d, rest]) if rest[0, 1] > 0 else d
            if total < 4 or len(d) < 2:
                out.append((None, None, None))
                continue
            beta, se = A.logistic(np.column_stack([np.ones(len(d)), d[:, 0]]), d[:, 2] / d[:, 1], firth=True, counts=d[:, 1])
            out.append((float(beta[1]), float(se[1]), tails.normal_two_sided(beta[1] / se[1]) if se[1] > 0 else None))
        return pd.DataFrame(out, columns=["beta", "se", "p"])

    made = _case_classes(spark, folder).select("graph_name", "feature", fit("classes", "n", "cases").alias("r"))
    return made.where("r.beta is not null").select("graph_name", "feature", "r.*")


def locus_mixed_model(spark: SparkSession, folder: str) -> DataFrame:
    """Mixed-model test of each feature; the kinship is that of the locus's own dosages, and the variance ratio is fitted with each feature."""
    return L.mixed_model(doses(spark, folder), _measured(spark, folder), "graph_name")


def locus_fine_map(spark: SparkSession, folder: str) -> DataFrame:
    """Inclusion probabilities and credible sets; every step of an effect reads all features of the locus, so a locus is one task's matrix."""
    cols = A.dose_columns(doses(spark, folder), "graph_name")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("sample")
        if len(right) < 4 or not len(left):
            return pd.DataFrame([], columns=["graph_name", "feature", "pip", "credible_set"])  # columns of no type, since Arrow takes no empty column of texts
        left = left.sort_values("feature")
        pip, sets = A.fine_map(A.dense(right["sample"].to_numpy(), left), right["y"].to_numpy(float))
        inside = {i: k for k, s in enumerate(sets) for i in s}
        return pd.DataFrame({"graph_name": left["graph_name"], "feature": left["feature"], "pip": pip, "credible_set": [inside.get(i, -1) for i in range(len(left))]})

    who = _measured(spark, folder).where("y is not null")
    return cols.groupBy("graph_name").cogroup(who.groupBy("graph_name")).applyInPandas(both, "graph_name string, feature string, pip double, credible_set long")


def locus_conditional(spark: SparkSession, folder: str) -> DataFrame:
    """Forward selection with backward drop: the strongest feature given those chosen, while p is below 0.05 over the tests."""
    return L.conditional(doses(spark, folder), _measured(spark, folder), "graph_name")


def locus_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel test of each locus: weighted squared scores (Beta(1, 25) of the carrier share) against a mixture of chi-squares."""
    return L.kernel(doses(spark, folder), _measured(spark, folder), "graph_name").select("graph_name", "n_features", "q", F.col("p_kernel").alias("p"))


def locus_optimal(spark: SparkSession, folder: str) -> DataFrame:
    """Burden, kernel, optimal and Cauchy-combined p-values of each locus; weights are Beta(1, 25) of the carrier share."""
    return L.kernel(doses(spark, folder), _measured(spark, folder), "graph_name").drop("q")


# The distribution function of a Poisson variable of mean 1 at 0, 1, 2, ..., times 2^32.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9))


def layer_bootstrap(spark: SparkSession, folder: str, resamples: int = 200) -> DataFrame:
    """Out-of-bag r2 of the best feature of each locus: median and 95% interval over resamples of its samples.

    A sample's weight in a resample is a Poisson count drawn from a digest of its name and the resample's
    number, so resamples need no shared state: weights are made where the row lies and only eleven sums
    per locus and resample are shuffled.
    """
    loc = doses(spark, folder).select("graph_name", "feature").distinct()
    best = _linear(spark, folder).where("t is not null").join(loc, "feature").groupBy("graph_name").agg(
        F.min_by("feature", F.struct(F.round(-F.abs("t"), 6).alias("a"), "feature")).alias("feature")
    )
    held = doses(spark, folder).join(best, ["graph_name", "feature"])
    axis = locus_samples(spark, folder).where("y is not null").join(best, "graph_name").join(held, ["graph_name", "feature", "sample"], "left")
    rows = axis.select("graph_name", "feature", "sample", (F.col("y") / 100).alias("y"), F.coalesce("dose", F.lit(0)).cast("double").alias("g"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "graph_name", "sample", "b")), 1, 8), 16, 10).cast("bigint")
    count = F.size(F.filter(F.array(*[F.lit(x) for x in POISSON]), lambda x: x <= F.col("u")))
    drawn = drawn.withColumn("u", digest).withColumn("w", count.cast("double")).withColumn("out", (F.col("w") == 0).cast("double"))
    w, o, g, y = (F.col(x) for x in ("w", "out", "g", "y"))
    per = drawn.groupBy("graph_name", "feature", "b").agg(
        F.sum(w).alias("w"), F.sum(w * g).alias("wg"), F.sum(w * y).alias("wy"), F.sum(w * g * g).alias("wgg"), F.sum(w * g * y).alias("wgy"),
        F.sum(o).alias("n"), F.sum(o * g).alias("g"), F.sum(o * y).alias("y"), F.sum(o * g * g).alias("gg"), F.sum(o * g * y).alias("gy"), F.sum(o * y * y).alias("yy"),
    )
    wide = F.col("w") * F.col("wgg") - F.col("wg") * F.col("wg")
    fit = per.where("w > 0 and n > 0").withColumn("s", F.when(wide > 0, (F.col("w") * F.col("wgy") - F.col("wg") * F.col("wy")) / wide).otherwise(0.0))
    fit = fit.withColumn("i", (F.col("wy") - F.col("s") * F.col("wg")) / F.col("w")).withColumn("m", F.col("wy") / F.col("w"))
    rss = F.expr("yy - 2 * i * y - 2 * s * gy + n * i * i + 2 * i * s * g + s * s * gg")
    tss = F.expr("yy - 2 * m * y + n * m * m")
    scored = fit.withColumn("r2", F.when(tss > 1e-9, 1 - rss / tss)).groupBy("graph_name", "feature")
    return scored.agg(
        F.count("r2").alias("n_resamples"), F.round(F.percentile("r2", F.lit(0.025)), 5).alias("r2_low"), F.round(F.percentile("r2", F.lit(0.5)), 5).alias("r2_mid"), F.round(F.percentile("r2", F.lit(0.975)), 5).alias("r2_high")
    )


def locus_rare_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Two-sided tails of the score of each feature on the 0/1 phenotype: counted by dose classes, and by saddlepoint."""

    @F.pandas_udf("carriers long, p double, p_saddle double")
    def tail(classes: pd.Series, n: pd.Series, cases: pd.Series) -> pd.DataFrame:
        out = []
        for held, total, hit in zip(classes, n, cases):
            d = np.array([(c["dose"], c["k"], c["hit"]) for c in held], float)
            rate, carriers = hit / total, int(d[:, 1].sum())
            observed = float((d[:, 0] * (d[:, 2] - rate * d[:, 1])).sum())
            rates = np.full(len(d), rate)
            out.append((carriers, tails.classes_tail(d[:, 0], d[:, 1], rates, observed), tails.saddlepoint_tail(d[:, 0], rates, observed, d[:, 1])))
        return pd.DataFrame(out, columns=["carriers", "p", "p_saddle"])

    made = _case_classes(spark, folder).where("n >= 4").select("graph_name", "feature", tail("classes", "n", "cases").alias("r"))
    return made.select("graph_name", "feature", "r.*")


def covariates(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, y, case, nation): the phenotypes with the customer's nation number as a covariate."""
    who = phenotypes(spark, folder).withColumn("c_custkey", F.expr("try_cast(substring(sample, 4) as bigint)"))
    return who.join(load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation")), "c_custkey").drop("c_custkey")


def assoc_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """The linear test of each feature beside the covariate."""
    r = A.linear_with_covariates(doses(spark, folder), covariates(spark, folder), ["nation"])
    return r.where("beta is not null").select("feature", F.round("beta", 4).alias("beta"), F.round("t", 5).alias("t"), F.col("df").cast("long").alias("df"))


def assoc_score_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """The score test of each feature beside the covariate."""
    r = A.score_with_covariates(doses(spark, folder), covariates(spark, folder).select("sample", F.col("case").alias("y"), "nation"), ["nation"])
    return r.select("feature", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round("z", 6).alias("z"))


PHENO = f"""pheno AS (SELECT sample, round(c_acctbal * 100)::BIGINT AS y, (c_mktsegment IN {SEGMENTS})::BIGINT AS "case"
  FROM (SELECT DISTINCT sample_name AS sample, try_cast(sample_name[4:] AS BIGINT) AS k FROM paths) JOIN customer ON c_custkey = k),
doses AS (SELECT graph_name, node_id AS feature, sample_name AS sample, count(*) AS dose FROM steps GROUP BY ALL)"""


def _sums(doses: str, y: str) -> str:
    return f"""per AS (SELECT feature, count_if(dose <> 0)::BIGINT AS carriers, sum(dose)::DOUBLE AS g, sum(dose * dose)::DOUBLE AS gg, sum(dose * {y})::DOUBLE AS gy FROM {doses} JOIN pheno USING (sample) WHERE {y} IS NOT NULL GROUP BY feature),
whole AS (SELECT count({y})::DOUBLE AS n, sum({y})::DOUBLE AS y, sum({y} * {y})::DOUBLE AS yy FROM pheno),
st AS (SELECT * FROM per, whole)"""


LIN = """lin1 AS (SELECT *, n * gg - g * g AS sxx, n * gy - g * y AS sxy, n * yy - y * y AS syy FROM st),
lin2 AS (SELECT *, CASE WHEN sxx <> 0 THEN sxy / sxx END AS beta FROM lin1),
lin3 AS (SELECT *, CASE WHEN sxx <> 0 THEN sqrt(greatest((syy - beta * sxy) / n, 0) / (n - 2) / (sxx / n)) END AS se FROM lin2),
lin AS (SELECT *, CASE WHEN se > 0 THEN beta / se END AS t FROM lin3)"""
BASE = f"WITH {STEPS}, {PHENO}"
FULL = f"{BASE}, {_sums('doses', 'y')}, {LIN}, loc AS (SELECT DISTINCT graph_name, feature FROM doses)"

ORACLES = {
    "sample_dosage": f"""{BASE}, sl AS (SELECT graph_name, sample_name, haplotype, count(*) AS n FROM paths WHERE haplotype IS NOT NULL GROUP BY ALL),
ok AS (SELECT graph_name, sample_name AS sample, count(*) = 2 AND max(n) = 1 AS complete FROM sl GROUP BY ALL)
SELECT feature, sample, CASE WHEN complete THEN dose END AS dose FROM doses JOIN ok USING (graph_name, sample)""",
    "pooled_dosage": f"""WITH {SITES}, a AS (SELECT s.*, kind, graph_name FROM signed s JOIN sites USING (bubble_id) JOIN paths p ON p.path_name = s.path_name WHERE kind IS NOT NULL),
ns AS (SELECT graph_name, kind, count(DISTINCT bubble_id) AS n_sites FROM a GROUP BY ALL),
pr AS (SELECT graph_name, kind, path_name, count(DISTINCT bubble_id) AS crossed, sum(len(inside))::BIGINT AS n FROM a GROUP BY ALL)
SELECT kind, path_name, crossed, CASE WHEN crossed = n_sites THEN n END AS dose FROM pr JOIN ns USING (graph_name, kind)""",
    "dosage_scaled": f"""{BASE} SELECT feature, sample, round(CASE WHEN max(dose) OVER w > min(dose) OVER w THEN 2.0::DOUBLE * (dose - min(dose) OVER w) / (max(dose) OVER w - min(dose) OVER w) ELSE 0 END, 6) AS dose
FROM doses WINDOW w AS (PARTITION BY feature)""",
    "minor_frequency": f"""{BASE}, c AS (SELECT feature, dose, count(*) AS n FROM doses GROUP BY ALL)
SELECT feature, first(dose ORDER BY n DESC, dose) AS mode, round(1 - max(n) / sum(n), 6) AS minor_freq FROM c GROUP BY feature""",
    "haplotype_pairs": f"""{BASE}, c AS (SELECT node_id, sample_name, path_name, count(*) AS n FROM steps GROUP BY ALL)
SELECT node_id AS feature, sample_name AS sample, sum(n)::BIGINT AS dose_sum, min(n) AS dose_min, max(n) AS dose_max FROM c GROUP BY ALL""",
    "pheno_ranks": f"""{BASE} SELECT sample, round((avg(r) OVER (PARTITION BY y) - 0.5) / count(*) OVER (), 9) AS share FROM (SELECT *, row_number() OVER (ORDER BY y) AS r FROM pheno WHERE y IS NOT NULL)""",
    "assoc_linear": FULL + " SELECT feature, carriers, round(beta, 6) AS beta, round(se, 6) AS se, round(t, 6) AS t FROM lin",
    "assoc_score": f"""{BASE}, {_sums('doses', '"case"')}, s AS (SELECT feature, gy - g * (y / n) AS u, y / n * (1 - y / n) * (gg - g * g / n) AS v FROM st)
SELECT feature, round(u, 6) AS u, round(v, 6) AS v, round(CASE WHEN v > 0 THEN u / sqrt(v) END, 6) AS z FROM s""",
    "assoc_genotypic": f"""{BASE}, d AS (SELECT feature, dose, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM doses JOIN pheno USING (sample) WHERE y IS NOT NULL GROUP BY ALL),
w AS (SELECT count(y)::DOUBLE AS wn, sum(y)::DOUBLE AS ws, sum(y * y)::DOUBLE AS wss FROM pheno),
h AS (SELECT feature, sum(n) AS n, sum(s) AS s, count(*) AS k, sum(s * s / n) AS b FROM d GROUP BY feature),
r AS (SELECT feature, k + (wn - n > 0)::INT AS classes, b + CASE WHEN wn - n > 0 THEN (ws - s) * (ws - s) / (wn - n) ELSE 0 END - ws * ws / wn AS btw, wn, wss - ws * ws / wn AS tot FROM h, w)
SELECT feature, classes, round(CASE WHEN classes > 1 AND wn > classes THEN (btw / (classes - 1)) / ((tot - btw) / (wn - classes)) END, 5) AS f FROM r""",
    "assoc_ranked": FULL + """ SELECT graph_name, feature, rank FROM (SELECT graph_name, feature, row_number() OVER (PARTITION BY graph_name ORDER BY round(abs(t), 6) DESC, feature) AS rank FROM lin JOIN loc USING (feature) WHERE t IS NOT NULL) WHERE rank <= 10""",
    "assoc_lambda": FULL + " SELECT count(t) AS n_tests, round(quantile_cont(round(t * t, 6), 0.5) / 0.4549364, 4) AS lambda_gc FROM lin",
    "assoc_layers": FULL + """ SELECT graph_name, count(*) AS n_tests, first(feature ORDER BY a DESC, feature) AS best, max(a) AS best_t, count_if(a >= 2)::BIGINT AS past_2, count_if(a >= 3)::BIGINT AS past_3
FROM (SELECT *, round(abs(t), 6) AS a FROM lin) JOIN loc USING (feature) WHERE a IS NOT NULL GROUP BY graph_name""",
    "layer_bootstrap": FULL
    + f""", best AS (SELECT graph_name, first(feature ORDER BY round(-abs(t), 6), feature) AS feature FROM lin JOIN loc USING (feature) WHERE t IS NOT NULL GROUP BY graph_name),
ax AS (SELECT DISTINCT p.graph_name, b.feature, p.sample_name AS sample, o.y / 100 AS y, coalesce(d.dose, 0)::DOUBLE AS g
  FROM paths p JOIN pheno o ON o.sample = p.sample_name JOIN best b USING (graph_name) LEFT JOIN doses d ON d.graph_name = p.graph_name AND d.feature = b.feature AND d.sample = p.sample_name WHERE o.y IS NOT NULL),
dr AS (SELECT *, len(list_filter([{', '.join(map(str, POISSON))}], lambda x: x <= ('0x' || md5(graph_name || '|' || sample || '|' || b)[1:8])::BIGINT))::DOUBLE AS w FROM ax, (SELECT unnest(generate_series(1, 200)) AS b)),
pb AS (SELECT graph_name, feature, b, sum(w) AS w, sum(w * g) AS wg, sum(w * y) AS wy, sum(w * g * g) AS wgg, sum(w * g * y) AS wgy, sum(o) AS n, sum(o * g) AS g, sum(o * y) AS y, sum(o * g * g) AS gg, sum(o * g * y) AS gy, sum(o * y * y) AS yy
  FROM (SELECT *, (w = 0)::INT::DOUBLE AS o FROM dr) GROUP BY ALL),
f1 AS (SELECT *, wy / w AS m, CASE WHEN w * wgg - wg * wg > 0 THEN (w * wgy - wg * wy) / (w * wgg - wg * wg) ELSE 0 END AS s FROM pb WHERE w > 0 AND n > 0),
f2 AS (SELECT *, (wy - s * wg) / w AS i FROM f1),
f3 AS (SELECT graph_name, feature, CASE WHEN yy - 2 * m * y + n * m * m > 1e-9 THEN 1 - (yy - 2 * i * y - 2 * s * gy + n * i * i + 2 * i * s * g + s * s * gg) / (yy - 2 * m * y + n * m * m) END AS r2 FROM f2)
SELECT graph_name, feature, count(r2) AS n_resamples, round(quantile_cont(r2, 0.025), 5) AS r2_low, round(quantile_cont(r2, 0.5), 5) AS r2_mid, round(quantile_cont(r2, 0.975), 5) AS r2_high FROM f3 GROUP BY ALL""",
    "burden": f"""{BASE}, rare AS (SELECT feature FROM doses GROUP BY feature HAVING count(*) <= 10), bd AS (SELECT graph_name AS feature, sample, sum(dose)::BIGINT AS dose FROM doses JOIN rare USING (feature) GROUP BY ALL),
{_sums('bd', 'y')}, {LIN} SELECT feature AS graph_name, carriers, round(beta, 6) AS beta, round(t, 6) AS t FROM lin""",
    "assoc_adjusted": f"""{BASE}, ph AS (SELECT sample, y::DOUBLE AS y, c_nationkey::DOUBLE AS c FROM pheno JOIN customer ON c_custkey = try_cast(sample[4:] AS BIGINT) WHERE y IS NOT NULL AND c_nationkey IS NOT NULL),
w AS (SELECT count(*)::DOUBLE AS n, sum(c) AS c, sum(c * c) AS cc, sum(y) AS y, sum(y * y) AS yy, sum(c * y) AS cy FROM ph),
f AS (SELECT feature, sum(dose)::DOUBLE AS g, sum(dose * dose)::DOUBLE AS gg, sum(dose * c) AS gc, sum(dose * ph.y) AS gy FROM doses JOIN ph USING (sample) GROUP BY feature),
r AS (SELECT feature, n, gg - g * g / n AS sgg, gc - g * c / n AS sgc, gy - g * y / n AS sgy, cc - c * c / n AS scc, cy - c * y / n AS scy, yy - y * y / n AS syy FROM f, w),
q AS (SELECT *, sgg - sgc * sgc / scc AS a, sgy - sgc * scy / scc AS b, syy - scy * scy / scc AS e FROM r)
SELECT feature, round(b / a, 4) AS beta, round(b / a / sqrt(greatest(e - b * b / a, 0) / (n - 3) / a), 5) AS t, (n - 3)::BIGINT AS df FROM q WHERE a > 1e-9 * (sgg + 1e-300) AND a > 1e-6""",
    "ld_pairs": f"""{BASE}, p AS (SELECT graph_name, feature, sum(dose)::DOUBLE AS g, sum(dose * dose)::DOUBLE AS gg FROM doses GROUP BY ALL), n AS (SELECT count(DISTINCT sample_name)::DOUBLE AS n FROM paths),
x AS (SELECT l.graph_name, l.feature AS a, r.feature AS b, sum(l.dose * r.dose)::DOUBLE AS gh FROM doses l JOIN doses r ON l.graph_name = r.graph_name AND l.sample = r.sample AND l.feature < r.feature GROUP BY ALL),
y AS (SELECT x.*, n, n * gh - pa.g * pb.g AS cov, n * pa.gg - pa.g * pa.g AS va, n * pb.gg - pb.g * pb.g AS vb FROM x, n, p pa, p pb WHERE pa.graph_name = x.graph_name AND pa.feature = x.a AND pb.graph_name = x.graph_name AND pb.feature = x.b)
SELECT graph_name, a, b, round(CASE WHEN va * vb <> 0 THEN cov * cov / (va * vb) END, 6) AS r2 FROM y""",
}
QUERIES = {f.__name__: f for f in (
    sample_dosage, pooled_dosage, dosage_scaled, minor_frequency, haplotype_pairs, pheno_ranks, pheno_inverse_normal, assoc_linear, assoc_tested, assoc_score,
    assoc_genotypic, assoc_ranked, assoc_lambda, assoc_layers, burden, ld_pairs, ld_clumps, locus_meff, locus_permutation, locus_logistic, locus_mixed_model,
    locus_fine_map, locus_conditional, locus_kernel, locus_rare_tails, locus_optimal, layer_bootstrap, assoc_adjusted, assoc_score_adjusted, assoc_meff,
)}
