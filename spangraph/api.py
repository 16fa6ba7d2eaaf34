"""The library as functions over DataFrames, with thresholds as arguments; the registered queries call the same operators.

``paths`` has path_name, steps and, where a graph is meant, graph_name; ``nodes`` has node_id, sequence and length_bp; ``sites`` has
bubble_id, row_no (or is distinct already), source_node, source_orient, sink_node, sink_orient. Other columns are carried by none
of the functions and do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.operators import alleles as L
from spangraph.operators import assoc as A
from spangraph.operators import intervals as I
from spangraph.operators import locus as M
from spangraph.operators import recruit as R
from spangraph.operators import sites as T
from spangraph.operators import walks as K
from spangraph.operators.store import KmerStore  # noqa: F401  part of the interface
from spangraph.sources.tables import variant_dosage
from spangraph.session import written


def _read(paths: DataFrame, sites: DataFrame) -> DataFrame:
    known = K.distinct_paths(paths)
    one = K.distinct_sites(sites if "row_no" in sites.columns else sites.withColumn("row_no", F.lit(0)))
    return K.signatures(K.crossings(one, K.explode_steps(known)), K.step_arrays(known))


def find_sites(paths: DataFrame, nodes: DataFrame, least_share: float = 1.0, least_paths: int = 3, least_alt: int = 2, least_bp: int = 50, most_bp: int = 100_000) -> DataFrame:
    """Sites between backbone nodes with their support and status; those that pass all floors have the status kept."""
    found = T.backbone_sites(K.explode_steps(K.distinct_paths(paths), "graph_name"), least_share)
    supported = T.support(_read(paths, found), K.distinct_nodes(nodes))
    why = T.status(supported, least_paths, least_alt, least_bp, most_bp)
    return found.join(supported, "bubble_id", "left").join(why, "bubble_id", "left").withColumn("status", F.coalesce("status", F.lit("not_crossed")))


def tandem_arrays(paths: DataFrame, least_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(runs, units): the maximal repeats of each walk, and their units over all walks."""
    known = K.distinct_paths(paths)
    runs = K.tandem_runs(K.explode_steps(known))
    return runs, T.tandem_units(runs, K.step_arrays(known), known.agg(F.count(F.lit(1))), least_share)


def merge_twins(paths: DataFrame, nodes: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(twins, steps): nodes with equal sequence and equal neighbours on either side become the least of them, round by round.

    ``twins`` is (node_id, keeper), ``steps`` the walks' steps with keepers in place. A merge can make new twins, so rounds go on
    until none is left; raises if ``rounds`` do not suffice.
    """
    known = K.distinct_nodes(nodes).where("sequence is not null")
    steps = written(K.explode_steps(K.distinct_paths(paths)).select("path_name", "idx", "node_id", "reverse"), "steps")
    twins = None
    for _ in range(rounds):
        arrow = F.concat(F.when(F.col("reverse"), "<").otherwise(">"), "node_id")
        signed = steps.withColumn("step", arrow)
        both = K.edges(signed).select(F.regexp_extract_all("edge", F.lit("[<>][^<>]+"), F.lit(0)).alias("e")).distinct()
        ends = both.select(F.inline(F.array(F.struct(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")), F.struct(K.flip(F.col("e")[1]).alias("a"), K.flip(F.col("e")[0]).alias("b")))))
        near = ends.groupBy(F.expr("substring(a, 2)").alias("node_id")).agg(F.sort_array(F.collect_set(F.struct(F.col("a").startswith(">").alias("right"), "b"))).alias("near"))
        walked = signed.select("node_id").distinct().join(known, "node_id").join(near, "node_id")
        groups = walked.groupBy("sequence", F.xxhash64("near").alias("n1"), F.xxhash64(F.lit(1), "near").alias("n2")).agg(F.sort_array(F.collect_set("node_id")).alias("ids")).where("size(ids) > 1")
        found = written(groups.select(F.explode(F.slice("ids", 2, F.size("ids"))).alias("node_id"), F.col("ids")[0].alias("keeper")), "twins")
        if found.isEmpty():
            return (found if twins is None else twins), steps
        moved = steps.join(found, "node_id", "left").select("path_name", "idx", F.coalesce("keeper", "node_id").alias("node_id"), "reverse")
        earlier = found if twins is None else twins.join(found.select(F.col("node_id").alias("keeper"), F.col("keeper").alias("next")), "keeper", "left").select("node_id", F.coalesce("next", "keeper").alias("keeper")).unionByName(found)
        twins, steps = written(earlier, "twins"), written(moved, "steps")
    raise RuntimeError(f"twins not settled after {rounds} rounds")


def call_events(paths: DataFrame, nodes: DataFrame, sites: DataFrame, least_bp: int = 50) -> tuple[DataFrame, DataFrame]:
    """(records, genotypes): the typed differences of alleles of at least ``least_bp``, and the allele of every crossing.

    Records are (bubble_id, allele, event, kind, del_bp, ins_bp, size_bp, n_paths); genotypes (bubble_id, path_name, crossing, allele).
    """
    read, known = _read(paths, sites), K.distinct_nodes(nodes)
    numbered = L.alleles(read)
    records = L.allele_differences(read, known).where(F.col("size_bp") >= least_bp).join(numbered.select("bubble_id", "allele", "n_paths"), ["bubble_id", "allele"])
    return records, read.join(numbered, ["bubble_id", "signature"]).select("bubble_id", "path_name", "crossing", "allele")


def graph_features(paths: DataFrame, min_paths: int = 1) -> DataFrame:
    """Figures of every node and edge over the walks: (feature, present, min_count, max_count, total, informative, layer)."""
    known = K.distinct_paths(paths)
    n = known.agg(F.count(F.lit(1)))
    node = K.feature_stats(K.dosage(K.explode_steps(known), "node_id"), n, min_paths).withColumn("layer", F.lit("node"))
    return node.unionByName(K.feature_stats(K.dosage(K.edges(K.explode_pairs(known)), "edge"), n, min_paths).withColumn("layer", F.lit("edge")))


def kmer_features(paths: DataFrame, nodes: DataFrame, k: int = 31, min_paths: int = 1) -> DataFrame:
    """The same figures of every canonical k-mer of the spelled walks."""
    known = K.distinct_paths(paths)
    blocks = K.spelled_blocks(K.explode_steps(known), K.distinct_nodes(nodes), overlap=k - 1)
    words = S.kmer_codes(blocks, ["path_name", "block"], "text", k)
    stats = K.feature_stats(K.dosage(words, "kmer"), known.agg(F.count(F.lit(1))), min_paths)
    return stats.withColumn("feature", S.decode(F.col("feature"), k)).withColumn("layer", F.lit("kmer"))


def variant_features(vcf: DataFrame) -> DataFrame:
    """(feature, sample, dose) of the records of ``sources.tables.read_vcf``."""
    return variant_dosage(vcf)


def associate(doses: DataFrame, pheno: DataFrame, covariates: Sequence[str] = (), model: str = "linear", least_carriers: int = 1) -> DataFrame:
    """(feature, statistic, p, bonferroni, q) of every feature by the linear, score or genotypic test.

    ``doses`` is (feature, sample, dose), zeros left out; ``pheno`` (sample, y, covariates...), y 0 or 1 for the score test.
    The genotypic test takes no covariates.
    """
    enough = doses.where("dose <> 0").groupBy("feature").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_carriers).select("feature")
    rows = doses.join(enough, "feature")
    if model == "linear":
        if covariates:
            made = A.linear_with_covariates(rows, pheno, list(covariates)).select("feature", F.col("t").alias("statistic"), A.t_p("t", F.col("df").cast("double")).alias("p"))
        else:
            made = A.linear(A.sums(rows, pheno.select("sample", "y"))).select("feature", F.col("t").alias("statistic"), A.t_p("t", (F.col("n") - 2).cast("double")).alias("p"))
    elif model == "score":
        scored = A.score_with_covariates(rows, pheno, list(covariates))
        made = scored.select("feature", F.col("z").alias("statistic"), A.chi2_p(F.col("z") * F.col("z"), F.lit(1.0)).alias("p"))
    elif model == "genotypic" and not covariates:
        tested = A.genotypic(rows, pheno)
        made = tested.select("feature", F.col("f").alias("statistic"), A.f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")).alias("p"))
    else:
        raise ValueError(f"no such test: {model}, covariates {list(covariates)}")
    made = written(made, "tests")
    return made.drop("p").join(A.adjusted(made, "feature", "p"), "feature")


def associate_locus(doses: DataFrame, pheno: DataFrame, group: str, model: str = "kernel") -> DataFrame:
    """Models of whole loci: ``kernel`` (with burden, optimal and combined p), ``mixed`` (a test per feature), ``conditional``, ``effective``.

    ``doses`` is (group, feature, sample, dose), zeros left out; ``pheno`` (group, sample, y) or (sample, y), which then holds for all groups.
    """
    models = {"kernel": M.kernel, "mixed": M.mixed_model, "conditional": M.conditional, "effective": M.effective}
    if model not in models:
        raise ValueError(f"no such model: {model}")
    who = pheno if group in pheno.columns else doses.select(group, "sample").distinct().join(pheno, "sample")
    return models[model](doses.select(group, "feature", "sample", "dose"), who.select(group, "sample", "y"), group)


def crossing_table(paths: DataFrame, sites: DataFrame) -> DataFrame:
    """Every crossing of a site by a walk with its steps inside and its allele."""
    read = _read(paths, sites)
    return read.join(L.alleles(read).select("bubble_id", "signature", "allele"), ["bubble_id", "signature"])


def allele_table(paths: DataFrame, sites: DataFrame) -> DataFrame:
    return L.alleles(_read(paths, sites))


def cluster_walks(paths: DataFrame, nodes: DataFrame, sites: DataFrame, least: float = 0.8) -> DataFrame:
    """(bubble_id, allele, leader): alleles clustered around the most carried ones."""
    return L.clustered_alleles(_read(paths, sites), K.distinct_nodes(nodes), least)


def score_calls(calls: DataFrame, truth: DataFrame, reach: int = 500, least_ratio: float = 0.7, rounds: int = 50) -> DataFrame:
    """(haplotype, tp, fp, fn, precision, recall, f1) of calls against a truth set, matched one to one.

    Both sides are (haplotype, id, pos, change), the change in bases with its sign. A pair may match where positions differ by at
    most ``reach`` and sizes, of one sign, have a ratio of at least ``least_ratio``. In each round a call and a truth that are
    each other's nearest (then most alike in size, then least ids) match and leave.
    """
    side = lambda d, x: d.select("haplotype", F.col("id").alias(f"{x}_id"), F.col("pos").cast("long").alias(f"{x}_pos"), F.col("change").alias(f"{x}_change"), F.col("pos").cast("long").alias(f"{x}_lo"), (F.col("pos") + (1 if x == "t" else reach + 1)).cast("long").alias(f"{x}_hi"))
    called = side(calls, "c").withColumn("c_lo", F.col("c_lo") - reach)
    near = I.overlap_join(called, side(truth, "t"), "haplotype", ("c_lo", "c_hi"), ("t_lo", "t_hi"), max(4 * reach, 1))
    ratio = F.try_divide(F.least(F.abs("c_change"), F.abs("t_change")).cast("double"), F.greatest(F.abs("c_change"), F.abs("t_change")).cast("double"))
    fits = near.where((F.signum("c_change") == F.signum("t_change")) & (ratio >= least_ratio))
    links = written(fits.select("haplotype", "c_id", "t_id", F.struct(F.abs(F.col("c_pos") - F.col("t_pos")).alias("d"), (-ratio).alias("r"), "c_id", "t_id").alias("o")), "links")
    matched = None
    for _ in range(rounds):
        best_c, best_t = links.groupBy("haplotype", "c_id").agg(F.min("o").alias("o")), links.groupBy("haplotype", "t_id").agg(F.min("o").alias("o"))
        new = written(best_c.select("haplotype", "o").join(best_t.select("haplotype", "o"), ["haplotype", "o"]).select("haplotype", "o.c_id", "o.t_id"), "matches")
        matched = new if matched is None else matched.unionByName(new)
        links = written(links.join(new.select("haplotype", "c_id"), ["haplotype", "c_id"], "left_anti").join(new.select("haplotype", "t_id"), ["haplotype", "t_id"], "left_anti"), "links")
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"matches not settled after {rounds} rounds")
    n = lambda d, name: d.groupBy("haplotype").agg(F.count(F.lit(1)).alias(name))
    all_ = n(calls, "calls").join(n(truth, "truths"), "haplotype", "full_outer").join(n(matched, "tp"), "haplotype", "left").na.fill(0)
    out = all_.select("haplotype", "tp", (F.col("calls") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"))
    share = lambda a, b: F.try_divide(a, b)
    tp = F.col("tp")
    return out.select("*", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def graph_shape(paths: DataFrame, hub: int = 50, tangled: int = 10) -> DataFrame:
    """(graph_name, n_nodes, n_edges, self_loops, most_neighbours, hubs, tangled) by distinct neighbours on either side of a node."""
    met = K.explode_pairs(K.distinct_paths(paths), "graph_name").select("graph_name", "step", "nxt").distinct()
    both = met.unionByName(met.select("graph_name", K.flip(F.col("nxt")).alias("step"), K.flip(F.col("step")).alias("nxt"))).distinct()
    side = both.select("graph_name", F.expr("substring(step, 2)").alias("node_id"), F.col("step").startswith(">").alias("right"), F.expr("substring(nxt, 2)").alias("to"))
    other = F.when(F.col("to") != F.col("node_id"), F.col("to"))
    per = side.groupBy("graph_name", "node_id").agg(F.count_distinct(F.when(F.col("right"), other)).alias("r"), F.count_distinct(F.when(~F.col("right"), other)).alias("l"), F.bool_or(F.col("to") == F.col("node_id")).alias("loop"))
    edges = K.edges(K.explode_pairs(K.distinct_paths(paths))).join(K.distinct_paths(paths).select("path_name", "graph_name"), "path_name").groupBy("graph_name").agg(F.count_distinct("edge").alias("n_edges"))
    most = F.greatest("r", "l")
    out = per.groupBy("graph_name").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("loop").alias("self_loops"), F.max(most).alias("most_neighbours"), F.count_if(most >= hub).alias("hubs"))
    return out.join(edges, "graph_name").withColumn("tangled", F.col("hubs") >= tangled)


def haplotype_order(paths: DataFrame, nodes: DataFrame, k: int = 31) -> DataFrame:
    """(path_name, distinct_kmers, kmers), to be taken from the richest on: most distinct k-mers, then most k-mers, then name."""
    known = K.distinct_paths(paths)
    words = S.kmer_codes(K.spelled_blocks(K.explode_steps(known), K.distinct_nodes(nodes), overlap=k - 1), ["path_name", "block"], "text", k)
    per = words.groupBy("path_name", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("path_name").agg(F.count(F.lit(1)).alias("distinct_kmers"), F.sum("n").alias("kmers")).orderBy(F.desc("distinct_kmers"), F.desc("kmers"), "path_name")


def index_locus(texts: DataFrame, k: int = 31, s: int = 11, informative_max: int = 2) -> DataFrame:
    """(locus, kmer, mult, outside, cls, screen) of (locus, name, sequence), k-mers as codes."""
    counts = R.words(texts, ["locus", "name"], "sequence", k).groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("mult"))
    return R.with_screen(R.locus_index(counts, k, informative_max), texts, ["locus", "name"], "sequence", k, s)


def recruit(fragments: DataFrame, index: DataFrame, k: int = 31, least_sites: int = 2, error: float = 0.01) -> DataFrame:
    """Evidence, fate and reason of every (fragment, sequence) for every locus whose screen it meets."""
    return R.verdict(R.evidence(R.labelled(fragments, ["fragment"], "sequence", index, k), k, error), k, least_sites, error)
