"""Sites between two boundary nodes: support, status, interior, wider boundaries, joined pieces, normalised alleles, order of nodes.

``read`` is (bubble_id, path_name, crossing, signature, inside), the crossings of ``operators.walks`` with their
steps; ``steps`` is (graph_name, path_name, idx, node_id, reverse). The reference of a graph is its path with the least
name unless one is given. Defined results: sites without a crossing have no row; nodes of no known length count 0
bases; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions.seq import bounded, kmer_codes, reverse_complement, rolled
from spangraph.operators import intervals as I
from spangraph.session import written


def support(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """Support, alleles and size range of each site; the reference is the least path of the site's crossings."""
    sized = (
        read.select("bubble_id", "path_name", "crossing", "signature", F.explode_outer("inside").alias("step"))
        .withColumn("node_id", F.expr("substring(step, 2)"))
        .join(nodes, "node_id", "left")
        .groupBy("bubble_id", "path_name", "crossing", "signature")
        .agg(F.sum(F.coalesce("bp", F.lit(0))).alias("bp"), F.coalesce(F.bool_or(F.col("step").startswith("<")), F.lit(False)).alias("inverted"))
    )
    first = F.min(F.struct("path_name", "crossing", "signature")).over(W.partitionBy("bubble_id"))["signature"]
    marked = sized.withColumn("is_ref", F.col("signature") == first)
    alleles = marked.groupBy("bubble_id", "signature").agg(
        F.count_distinct("path_name").alias("n"), F.bool_or("is_ref").alias("is_ref"), F.min("bp").alias("bp"), F.bool_or("inverted").alias("inverted")
    )
    paths = read.groupBy("bubble_id").agg(F.count_distinct("path_name").alias("path_support"))
    out = alleles.groupBy("bubble_id").agg(
        F.count(F.lit(1)).alias("distinct_alleles"),
        F.max(F.when(F.col("is_ref"), F.col("n"))).alias("ref_support"),
        F.coalesce(F.max(F.when(~F.col("is_ref"), F.col("n"))), F.lit(0)).alias("alt_support_max"),
        F.coalesce(F.min(F.when(~F.col("is_ref"), F.col("n"))), F.lit(0)).alias("alt_support_min"),
        F.min("bp").alias("min_inside_bp"), F.max("bp").alias("max_inside_bp"), F.bool_or("inverted").alias("inversion_signal"),
    )
    return out.join(paths, "bubble_id")


def status(supported: DataFrame, least_paths: int = 3, least_alt: int = 2, least_bp: int = 50, most_bp: int = 100_000) -> DataFrame:
    """(bubble_id, status): why a site is kept or not, by the first rule that holds; an inversion signal lifts the size floor."""
    why = (
        F.when(F.col("path_support") < least_paths, "few_paths").when(F.col("distinct_alleles") < 2, "one_allele").when(F.col("alt_support_max") < least_alt, "rare_alternative")
        .when(F.col("max_inside_bp") > most_bp, "too_long").when((F.col("max_inside_bp") < least_bp) & ~F.col("inversion_signal"), "too_short").otherwise("kept")
    )
    return supported.select("bubble_id", why.alias("status"))


def interior(read: DataFrame) -> DataFrame:
    """(bubble_id, node_id, n_paths): the nodes that walks reach between the boundaries of a site."""
    inside = read.select("bubble_id", "path_name", F.explode("inside").alias("step"))
    return inside.groupBy("bubble_id", F.expr("substring(step, 2)").alias("node_id")).agg(F.count_distinct("path_name").alias("n_paths"))


def backbone_sites(steps: DataFrame, least_share: float = 1.0) -> DataFrame:
    """(bubble_id, graph_name, source_node, source_orient, sink_node, sink_orient): the stretches between neighbouring backbone nodes.

    A backbone node is one that at least ``least_share`` of its graph's walks take, and none twice. Sites follow the reference; a stretch that the
    reference crosses without a step counts when some other walk has steps in it. ``bubble_id`` numbers the sites of a
    graph, after a digest of its name. These are the outermost sites; where walks are partial there is no backbone and so no site.
    """
    per = steps.groupBy("graph_name", "node_id", "path_name").agg(F.count(F.lit(1)).alias("n"))
    held = per.groupBy("graph_name", "node_id").agg(F.count(F.lit(1)).alias("paths"), F.max("n").alias("most"))
    whole = steps.groupBy("graph_name").agg(F.count_distinct("path_name").alias("all"))
    firm = held.join(whole, "graph_name").where((F.col("most") == 1) & (F.col("paths") >= F.lit(least_share) * F.col("all"))).select("graph_name", "node_id")
    order = W.partitionBy("graph_name", "path_name").orderBy("idx")
    ends = steps.join(firm, ["graph_name", "node_id"]).withColumn("sink", F.lead(F.struct("node_id", "reverse", "idx")).over(order)).where("sink is not null")
    wide = ends.groupBy("graph_name", F.least("node_id", "sink.node_id").alias("lo"), F.greatest("node_id", "sink.node_id").alias("hi")).agg(F.max(F.col("sink.idx") - F.col("idx")).alias("gap")).where("gap > 1")
    ref = ends.join(reference_of(steps), ["graph_name", "path_name"]).withColumn("lo", F.least("node_id", "sink.node_id")).withColumn("hi", F.greatest("node_id", "sink.node_id"))
    kept = ref.join(wide.select("graph_name", "lo", "hi"), ["graph_name", "lo", "hi"])
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    number = F.row_number().over(W.partitionBy("graph_name").orderBy("idx"))
    return kept.select(
        (F.shiftleft(F.conv(F.substring(F.md5("graph_name"), 1, 10), 16, 10).cast("bigint"), 20) + number).alias("bubble_id"), "graph_name",
        F.col("node_id").alias("source_node"), sign("reverse").alias("source_orient"), F.col("sink.node_id").alias("sink_node"), sign("sink.reverse").alias("sink_orient"),
    )


def reference_of(steps: DataFrame) -> DataFrame:
    """(graph_name, path_name): the reference of each graph."""
    return steps.groupBy("graph_name").agg(F.min("path_name").alias("path_name"))


def widened(sites: DataFrame, located: DataFrame, most_bp: int = 100_000) -> DataFrame:
    """(bubble_id, source_node, sink_node, moved_bp): boundaries moved outwards to the nearest node that no path walks twice.

    ``located`` is (graph_name, path_name, idx, node_id, start_bp, end_bp). Sites whose boundaries the reference does not
    walk once each, or that would move by more than ``most_bp``, are left out.
    """
    visits = located.groupBy("node_id", "path_name").agg(F.count(F.lit(1)).alias("n")).groupBy("node_id").agg(F.max("n").alias("most"))
    ref = located.join(reference_of(located), ["graph_name", "path_name"]).join(visits, "node_id")
    order = W.partitionBy("graph_name").orderBy("idx")
    firm = F.when(F.col("most") == 1, F.struct("node_id", "start_bp", "end_bp"))
    at = ref.withColumn("before", F.last(firm, ignorenulls=True).over(order)).withColumn("after", F.first(firm, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    once = at.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("graph_name", "node_id"))).where("__n = 1")
    side = lambda x: once.select(*[F.col(c).alias(f"{x}_{c}") for c in ("graph_name", "node_id", "idx", "start_bp", "end_bp", "before", "after")])
    both = sites.select("bubble_id", "source_node", "sink_node").join(side("a"), F.col("source_node") == F.col("a_node_id")).join(side("b"), (F.col("sink_node") == F.col("b_node_id")) & (F.col("a_graph_name") == F.col("b_graph_name")))
    ahead = F.col("a_idx") <= F.col("b_idx")
    low = F.when(ahead, F.col("a_before")).otherwise(F.col("b_before"))
    high = F.when(ahead, F.col("b_after")).otherwise(F.col("a_after"))
    moved = both.withColumn("low", low).withColumn("high", high).where("low is not null and high is not null")
    left = F.least("a_end_bp", "b_end_bp") - F.col("low.end_bp")
    right = F.col("high.start_bp") - F.greatest("a_start_bp", "b_start_bp")
    out = moved.select("bubble_id", F.when(ahead, F.col("low.node_id")).otherwise(F.col("high.node_id")).alias("source_node"), F.when(ahead, F.col("high.node_id")).otherwise(F.col("low.node_id")).alias("sink_node"), (left + right).alias("moved_bp"))
    return out.where(F.col("moved_bp") <= most_bp)


def rescued(spans: DataFrame, supported: DataFrame, least_bp: int = 50, gap: int = 1000) -> DataFrame:
    """(path_name, lo, hi, n_sites, bp): neighbouring sites below the size floor that reach it together.

    ``spans`` is (path_name, bubble_id, lo, hi). Sites join along a path when they lie at most ``gap`` apart and no site of
    the full size lies between them; ``bp`` adds up their largest alleles.
    """
    rows = spans.join(supported.select("bubble_id", F.col("max_inside_bp").alias("bp")), "bubble_id")
    order = W.partitionBy("path_name").orderBy("lo", "hi", "bubble_id")
    big = (F.col("bp") >= least_bp).cast("int")
    fenced = rows.withColumn("fence", F.sum(big).over(order)).where(F.col("bp") < least_bp)
    linked = I.islands(fenced, ["path_name", "fence"], "lo", "hi", gap, tie=["bubble_id"])
    out = linked.groupBy("path_name", "fence", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n_sites"), F.sum("bp").alias("bp"))
    return out.where((F.col("n_sites") > 1) & (F.col("bp") >= least_bp)).drop("fence", "island")


def allele_texts(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bubble_id, signature, text): the bases of each distinct allele between the boundaries; unknown bases are N."""
    one = read.select("bubble_id", "signature", "inside").dropDuplicates(["bubble_id", "signature"])
    steps = one.select("bubble_id", "signature", F.posexplode_outer("inside").alias("i", "step")).withColumn("node_id", F.expr("substring(step, 2)"))
    base = F.coalesce("sequence", F.expr("repeat('N', cast(bp as int))"), F.lit(""))
    piece = F.when(F.col("step").startswith("<"), reverse_complement(base)).otherwise(base)
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("t"))))
    return steps.join(nodes, "node_id", "left").groupBy("bubble_id", "signature").agg(F.upper(F.array_join(F.transform(ordered, lambda p: p["t"]), "")).alias("text"))


def common_prefix(a: Column, b: Column, bits: int = 31) -> Column:
    """How many letters two texts have in common from their start, a power of two at a time; linear in the texts."""
    fits = lambda n, size: (n + size <= F.least(F.length(a), F.length(b))) & (a.substr(n + 1, size) == b.substr(n + 1, size))
    sizes = F.array(*[F.lit(1 << bit) for bit in range(bits - 1, -1, -1)])
    return F.aggregate(sizes, F.lit(0), lambda n, size: F.when(F.coalesce(fits(n, size), F.lit(False)), n + size).otherwise(n))


def normalised(pairs: DataFrame, ref: str, alt: str, longest_bits: int = 20) -> DataFrame:
    """Adds pos, ref_part, alt_part and homlen: the least representation of each pair of texts, placed as far left as it goes.

    The common end is cut off before the common start, so a pure insertion or deletion comes out left-aligned within the
    texts; ``homlen`` is how far it could slide to the right again. Texts have fewer than 2^``longest_bits`` letters.
    """
    rows = pairs.withColumn("__x", F.reverse(F.col(ref))).withColumn("__y", F.reverse(F.col(alt))).withColumn("__tail", common_prefix(F.col("__x"), F.col("__y"), longest_bits))
    rows = rows.withColumn("__r", F.left(F.col(ref), F.length(ref) - F.col("__tail"))).withColumn("__a", F.left(F.col(alt), F.length(alt) - F.col("__tail"))).drop("__x", "__y")
    rows = rows.withColumn("pos", common_prefix(F.col("__r"), F.col("__a"), longest_bits)).withColumn("__head", common_prefix(F.col(ref), F.col(alt), longest_bits))
    part = lambda x: F.substring(F.col(x), F.col("pos") + 1, F.length(x))
    rows = rows.withColumn("ref_part", part("__r")).withColumn("alt_part", part("__a"))
    pure = (F.col("ref_part") == "") != (F.col("alt_part") == "")
    return rows.withColumn("homlen", F.when(pure, F.col("__head") - F.col("pos")).otherwise(0)).drop("__tail", "__head", "__r", "__a")


def inversions(runs: DataFrame) -> DataFrame:
    """(graph_name, lo, hi, n_paths): stretches of the reference that walks cross backwards between two forward runs.

    ``runs`` is (graph_name, path_name, run, backward, ref_lo, ref_hi) in places of the reference. A run counts when the
    forward runs before and after it lie on either side of it; runs of several paths that overlap are one inversion.
    """
    order = W.partitionBy("path_name").orderBy("run")
    near = runs.withColumn("before", F.lag(F.struct("backward", "ref_hi")).over(order)).withColumn("after", F.lead(F.struct("backward", "ref_lo")).over(order))
    found = near.where("backward and not before.backward and not after.backward and before.ref_hi < ref_lo and after.ref_lo > ref_hi")
    spans = found.select("graph_name", "path_name", F.col("ref_lo").alias("lo"), (F.col("ref_hi") + 1).alias("hi"))
    linked = I.islands(spans, ["graph_name"], "lo", "hi", -1, tie=["path_name"])
    return linked.groupBy("graph_name", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_distinct("path_name").alias("n_paths")).drop("island")


def tandem_units(runs: DataFrame, arrays: DataFrame, n_paths: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(unit, period, n_paths, min_copies, max_copies, prevalent): the repeated units of walks, over all walks that hold them.

    A unit is the least rotation of its steps, on either strand. ``runs`` is that of ``walks.tandem_runs``; a unit is
    prevalent when at least ``least_share`` of the ``n_paths`` (one row, one column) repeat it.
    """
    turned = lambda a: F.transform(F.reverse(a), lambda s: F.concat(F.when(s.startswith(">"), "<").otherwise(">"), s.substr(F.lit(2), F.length(s))))
    spins = lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.concat(F.slice(a, i, F.size(a)), F.slice(a, 1, i - 1)), ""))
    cut = runs.join(arrays.select("path_name", "steps"), "path_name").withColumn("__u", F.slice("steps", F.col("first_idx") + 1, F.col("period").cast("int")))
    named = cut.select("path_name", "period", "copies", F.array_min(F.concat(spins(F.col("__u")), spins(turned(F.col("__u"))))).alias("unit"))
    per = named.groupBy("unit", "period", "path_name").agg(F.max("copies").alias("copies"))
    out = per.groupBy("unit", "period").agg(F.count(F.lit(1)).alias("n_paths"), F.min("copies").alias("min_copies"), F.max("copies").alias("max_copies"))
    return out.withColumn("prevalent", F.col("n_paths") >= F.lit(least_share) * n_paths.scalar())


def node_order(steps: DataFrame) -> DataFrame:
    """(graph_name, node_id, bucket, flipped, rank): nodes in the order of the reference.

    A node of the reference lies at its first place there, and is flipped where that is backwards. Another one lies in the
    bucket of the reference node last walked before it, the earliest over all walks, -1 before any. Ties go by name.
    """
    ref = steps.join(reference_of(steps), ["graph_name", "path_name"]).groupBy("graph_name", "node_id").agg(F.min(F.struct("idx", "reverse")).alias("r"))
    at = steps.join(ref, ["graph_name", "node_id"], "left")
    before = F.last("r.idx", ignorenulls=True).over(W.partitionBy("graph_name", "path_name").orderBy("idx"))
    own = F.coalesce(F.col("r.idx"), before, F.lit(-1))
    rows = at.withColumn("__b", own).groupBy("graph_name", "node_id").agg(F.min("__b").alias("bucket"), F.max(F.col("r.idx").isNotNull()).alias("__known"), F.bool_or(F.coalesce("r.reverse", F.lit(False))).alias("flipped"))
    order = W.partitionBy("graph_name").orderBy("bucket", F.desc("__known"), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("__known")


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(site, kmer, is_a, k-mers of a at each site, of b) of the discriminating sites of two texts, which are given by their k-mers in order.

    A site is a stretch between the same two shared k-mers (or ends) where both texts hold k-mers that the other lacks; each counts once there.
    """
    shared, own = np.intersect1d(a, b), []
    for is_a, codes in ((1, a), (0, b)):
        met = np.isin(codes, shared)
        place = np.arange(len(codes))
        before = np.maximum.accumulate(np.where(met, place, -1))
        after = np.minimum.accumulate(np.where(met, place, len(codes))[::-1])[::-1]
        ends = np.append(codes, -1)  # beyond either end of the text
        at = np.flatnonzero(~met)
        own.append(np.stack([ends[before[at]], ends[after[at]], np.full(len(at), is_a), codes[at]], axis=1))
    rows = np.unique(np.concatenate(own), axis=0)
    _, site = np.unique(rows[:, :2], axis=0, return_inverse=True)
    site = site.reshape(-1)
    sizes = [np.bincount(site[rows[:, 2] == x], minlength=site.max(initial=-1) + 1) for x in (1, 0)]
    firm = (sizes[0] > 0) & (sizes[1] > 0)
    number = np.cumsum(firm) - 1
    kept = firm[site]
    return number[site[kept]], rows[kept, 3], rows[kept, 2] == 1, sizes[0][firm], sizes[1][firm]


def _codes_of(texts: list[str], k: int) -> list[np.ndarray]:
    codes, owner, _, plain = rolled(texts, k)
    kept = np.flatnonzero(plain)
    return np.split(codes[kept], np.searchsorted(owner[kept], np.arange(1, len(texts))))


def _shares(part: DataFrame, totals: DataFrame) -> DataFrame:
    """The share and copies of each (pair, hap) from ``part`` (pair, hap, a, b), the hits at each site over its size."""
    voted = part.where("a + b >= 0.5").groupBy("pair", "hap").agg(F.count(F.lit(1)).alias("usable"), F.percentile(F.col("a") / (F.col("a") + F.col("b")), F.lit(0.5)).alias("share"))
    cn_a = F.least("total", F.floor(F.round(F.col("share") * F.col("total"), 9) + 0.5).cast("long"))
    out = voted.join(totals.select("pair", "hap", F.col("total").cast("long").alias("total")), ["pair", "hap"])
    cn_a = F.when(F.col("total").isNotNull(), cn_a)
    return out.select("pair", "hap", "total", "usable", F.round("share", 6).alias("share"), cn_a.alias("cn_a"), (F.col("total") - cn_a).alias("cn_b"))


def allele_split(crossed: DataFrame, nodes: DataFrame, k: int = 11) -> DataFrame:
    """What ``paralog_split`` gives for the two most carried alleles of each site, with the walks that cross it as haplotypes.

    ``crossed`` is (bubble_id, path_name, signature, times), one row per walk and allele of a site, read more than once; ``nodes`` (node_id, sequence, bp). Each
    distinct allele is spelled once. The alleles of a site come one after another, the most carried first, so a task holds the k-mers of two
    of them and counts the others as they pass; what is shuffled are texts and hits at sites, not k-mers. A walk's hits are those of its alleles.
    """
    carried = crossed.groupBy("bubble_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    ranked = carried.withColumn("allele", F.row_number().over(W.partitionBy("bubble_id").orderBy(F.desc("n"), "signature"))).drop("n")
    met = ranked.withColumn("__most", F.max("allele").over(W.partitionBy("bubble_id"))).where(F.col("__most") >= 2)
    steps = met.select("bubble_id", "allele", F.posexplode_outer(F.regexp_extract_all("signature", F.lit("[<>][^<>]+"), F.lit(0))).alias("i", "step")).withColumn("node_id", F.expr("substring(step, 2)"))
    base = F.coalesce("sequence", F.expr("repeat('N', cast(bp as int))"), F.lit(""))
    piece = F.when(F.col("step").startswith("<"), reverse_complement(base)).otherwise(base)
    pieces = steps.join(nodes, "node_id", "left").select("bubble_id", "allele", F.struct("i", piece.alias("t")).alias("p"))
    # by site alone, so that the alleles of a site are put together where they are then read
    made = pieces.repartition("bubble_id").groupBy("bubble_id", "allele").agg(F.array_sort(F.collect_list("p")).alias("p"))
    texts = made.select("bubble_id", "allele", F.upper(F.array_join(F.transform("p", lambda p: p["t"]), "")).alias("text")).sortWithinPartitions("bubble_id", "allele")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bubble, first, marks = None, None, None
        for batch in bounded(batches, 2):
            out = []
            for b, n, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _codes_of(batch.column(2).to_pylist(), k)):
                if b != bubble:
                    bubble, first, marks = b, None, None
                if n == 1:
                    first = codes.copy()
                    continue
                fresh = n == 2
                if fresh:
                    site, kmer, is_a, size_a, size_b = _stretches(first, codes)
                    marks = np.unique(kmer)
                if not len(marks):
                    continue
                for number, held in ((1, first), (2, codes)) if fresh else ((n, codes),):
                    at = np.searchsorted(marks, held)
                    at = at[(at < len(marks)) & (marks[np.minimum(at, len(marks) - 1)] == held)]
                    times = np.bincount(at, minlength=len(marks))[np.searchsorted(marks, kmer)]
                    hits = [np.bincount(site[x], times[x], len(size_a)).astype(np.int64) for x in (is_a, ~is_a)]
                    some = np.flatnonzero(hits[0] + hits[1])
                    out += zip([b] * len(some), [number] * len(some), some.tolist(), *(x[some].tolist() for x in (*hits, size_a, size_b)))
                if fresh:
                    first = None
            names = ["bubble_id", "allele", "site", "hits_a", "hits_b", "size_a", "size_b"]
            kinds = [batch.column(0).type, pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    hits = texts.mapInArrow(run, f"bubble_id {dict(crossed.dtypes)['bubble_id']}, allele int, site long, hits_a long, hits_b long, size_a long, size_b long")
    walked = crossed.join(ranked, ["bubble_id", "signature"]).select("bubble_id", "path_name", "allele", "times")
    # out of Python, hits are of a size that the planner does not know
    both = walked.join(hits.hint("merge"), ["bubble_id", "allele"]).groupBy("bubble_id", "path_name", "site", "size_a", "size_b")
    summed = both.agg(*[F.sum(F.col("times") * F.col(f"hits_{x}")).alias(f"hits_{x}") for x in "ab"])
    part = summed.select(F.col("bubble_id").alias("pair"), F.col("path_name").alias("hap"), (F.col("hits_a") / F.col("size_a")).alias("a"), (F.col("hits_b") / F.col("size_b")).alias("b"))
    totals = crossed.groupBy(F.col("bubble_id").alias("pair"), F.col("path_name").alias("hap")).agg(F.sum("times").alias("total"))
    return _shares(part, totals).withColumnsRenamed({"pair": "bubble_id", "hap": "path_name"})


def paralog_split(pairs: DataFrame, words: DataFrame, totals: DataFrame, k: int = 11) -> DataFrame:
    """(pair, hap, total, usable, share, cn_a, cn_b): the copies of a haplotype split between two near-identical sequences.

    ``pairs`` is (pair, a, b) of texts, ``words`` (pair, hap, kmer, n) the canonical k-mers of each haplotype as codes with
    their number, ``totals`` (pair, hap, total). A discriminating site is a stretch between the same two shared k-mers (or
    ends) of a and b where both hold k-mers that the other lacks. At each site the hits of a haplotype over the site's k-mers of a
    and of b give the fraction of a; sites with less than half a copy of both together are not usable, and the median of the
    others is the share. Only pairs with such a site and haplotypes with a usable one have a row. A null total has null copies;
    a null text has no site.
    """
    sides = pairs.select("pair", F.explode(F.array(*[F.struct(F.lit(x == "a").alias("is_a"), F.col(x).alias("text")) for x in "ab"])).alias("s")).select("pair", "s.*")
    placed = written(kmer_codes(sides.where("text is not null"), ["pair", "is_a"], "text", k), "pairs")
    both = placed.groupBy("pair", "kmer").agg((F.bool_or("is_a") & F.bool_or(~F.col("is_a"))).alias("shared"))
    known = placed.join(both, ["pair", "kmer"])
    met = F.last(F.when(F.col("shared"), F.col("kmer")), ignorenulls=True)
    order = W.partitionBy("pair", "is_a")
    before, after = (order.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("pos", F.desc("pos")))
    ranged = known.withColumn("lo", F.coalesce(met.over(before), F.lit(-1))).withColumn("hi", F.coalesce(met.over(after), F.lit(-1)))
    own = ranged.where(~F.col("shared")).select("pair", "lo", "hi", "is_a", "kmer").distinct()
    sizes = own.groupBy("pair", "lo", "hi").agg(F.count_if("is_a").alias("size_a"), F.count_if(~F.col("is_a")).alias("size_b")).where("size_a > 0 and size_b > 0")
    hits = own.join(words, ["pair", "kmer"]).groupBy("pair", "hap", "lo", "hi").agg(*[F.sum(F.when(F.col("is_a") == F.lit(x == "a"), F.col("n")).otherwise(0)).alias(f"hits_{x}") for x in "ab"])
    part = hits.join(sizes, ["pair", "lo", "hi"]).select("pair", "hap", (F.col("hits_a") / F.col("size_a")).alias("a"), (F.col("hits_b") / F.col("size_b")).alias("b"))
    return _shares(part, totals)
