"""Read classification per locus: index classes, labels, best segment, flanks, independent sites, unknown runs, mates, verdict.

An index is (locus, kmer, mult, outside, cls, screen). K-mers are two-bit codes. The k-mers of a fragment meet it in one join; the hits of
a fragment and a locus are gathered into one row, whose size is bounded by the fragment, and everything
after that is a projection of that row: a text of labels, one letter per k-mer.

Labels: P private, S shared, R repeated, D of a decoy (a stretch elsewhere that resembles the locus), N unknown,
- not callable (a letter that is no base).

Defined results: null texts and texts shorter than k have no row; fragments that meet no screen of a locus
have no row for it; repeated fragments of one key count as one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions import seq as S
from spangraph.operators import intervals as I

# Scores and thresholds of the classification.
DECOY_SCORE, DECOY_SHARE, DENSITY, FULL = -2.0, 0.05, 0.05, 0.9
GAP_SHARE, FLANK_SHARE, NEW_ALLELES, DEVIATIONS, SPARE_RUNS = 0.5, 0.25, 0.001, 3.1, 2.0
DUST_LIMIT = 2.5


def words(rows: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """(*keys, pos, kmer): the canonical k-mers of a text as two-bit codes; places with other letters are left out."""
    return S.kmer_codes(rows, keys, text, k)


def syncmers(rows: DataFrame, keys: list[str], text: str, k: int, s: int) -> DataFrame:
    """(*keys, pos): where closed syncmers start, k-mers whose least s-mer hash stands first or last."""
    at = S.with_window_hashes(rows, keys, text, k, s)
    return at.where("first = low or last = low").select(*keys, "pos")


def counted_words(texts: DataFrame, keys: list[str], text: str, k: int, s: int) -> DataFrame:
    """(locus, kmer, mult, screen): how often each locus holds each k-mer, and whether the k-mer is a closed syncmer.

    Both strands agree on a closed syncmer, so the k-mer alone tells, and one pass over the texts gives both.
    """
    made = S.kmer_codes(texts, keys, text, k, smer=s)
    return made.groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("mult"), F.bool_or("screen").alias("screen"))


def locus_index(counts: DataFrame, k: int, informative_max: int = 2) -> DataFrame:
    """Adds ``outside`` and ``cls`` to (locus, kmer, mult, ...), k-mers as codes: private, shared or repeated by the count outside the locus.

    Private k-mers of low complexity are demoted to shared; only k-mers with nothing outside are looked at for that.
    """
    out = counts.withColumn("outside", F.sum("mult").over(W.partitionBy("kmer")) - F.col("mult"))  # a k-mer has a row per locus
    private = (F.col("outside") == 0) & (S.dust_of_codes(F.when(F.col("outside") == 0, F.col("kmer")), k) < DUST_LIMIT)
    return out.withColumn("cls", F.when(private, "P").when(F.col("outside") <= informative_max, "S").otherwise("R"))


def with_screen(index: DataFrame, texts: DataFrame, keys: list[str], text: str, k: int, s: int) -> DataFrame:
    """Adds ``screen``: whether the k-mer is a closed syncmer, found along the texts that the index was made of.

    Both strands agree on a closed syncmer, so the k-mer alone tells.
    """
    marks = words(texts, keys, text, k).join(syncmers(texts, keys, text, k, s), [*keys, "pos"]).select("kmer", F.lit(True).alias("screen")).distinct()
    return index.join(marks, "kmer", "left").withColumn("screen", F.coalesce("screen", F.lit(False)))


def decoy_kmers(index: DataFrame, placed: DataFrame, blocks: DataFrame, k: int, size: int, gap: int = 1500, least: int = 20, pad: int = 50) -> DataFrame:
    """(locus, kmer): k-mers of stretches of other loci that resemble the locus, which the locus itself does not hold.

    ``placed`` is (path_name, locus, pos): where the walks of other loci hold a shared k-mer of a
    locus. ``blocks`` is (path_name, start_bp, text), the walks in blocks of ``size`` bases, each going on for k - 1 bases into the next. A
    stretch is a cluster of at least ``least`` places, at most ``gap`` apart. Repeated k-mers open no stretch, so a k-mer meets few
    loci. Only the texts of stretches are cut into k-mers, each text once for its locus.
    """
    hits = placed.select("path_name", "locus", "pos", (F.col("pos") + 1).alias("end"))
    linked = I.islands(hits, ["path_name", "locus"], "pos", "end", gap).groupBy("path_name", "locus", "island")
    spans = linked.agg(F.min("pos").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    lo, hi = F.greatest(F.col("lo") - pad, F.lit(0)), F.col("hi") + pad
    windows = spans.select("path_name", "locus", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / size), F.floor((hi - 1) / size))).alias("__bin"))
    begin = F.greatest(F.col("lo"), F.col("start_bp"))
    end = F.least(F.col("hi"), F.col("start_bp") + size)
    texts = blocks.withColumn("__bin", F.floor(F.col("start_bp") / size)).join(windows, ["path_name", "__bin"])
    cut = F.col("text").substr((begin - F.col("start_bp") + 1).cast("int"), (end - begin + k - 1).cast("int"))
    inside = words(texts.select("locus", cut.alias("text")).distinct(), ["locus"], "text", k).select("locus", "kmer").distinct()
    return inside.join(index.select("locus", "kmer"), ["locus", "kmer"], "left_anti")


def shared_places(index: DataFrame, node_words: DataFrame, steps: DataFrame, borders: DataFrame, homes: DataFrame, k: int) -> DataFrame:
    """(path_name, locus, pos): where walks hold a shared k-mer of another locus than their own.

    K-mers inside a node are looked up once per node and then placed along the ``steps`` (path_name, node_id, reverse, start_bp,
    end_bp); those over the ends of steps are ``borders`` (path_name, pos, kmer). ``homes`` is (path_name, home), ``node_words``
    (node_id, pos, kmer).
    """
    shared = index.where("cls = 'S'").select("locus", "kmer")
    inside = node_words.join(shared, "kmer").select("node_id", F.col("pos").alias("at"), "locus").join(steps, "node_id")
    pos = F.when(F.col("reverse"), F.col("end_bp") - F.col("at") - k).otherwise(F.col("start_bp") + F.col("at"))
    both = inside.select("path_name", "locus", pos.alias("pos")).unionByName(borders.join(shared, "kmer").select("path_name", "locus", "pos"))
    return both.join(homes, "path_name").where("locus <> home").select("path_name", "locus", "pos")


def border_kmers(blocks: DataFrame, k: int) -> DataFrame:
    """(path_name, pos, kmer): the k-mers of walks that no single step holds.

    ``blocks`` is (path_name, start_bp, text, sizes), texts that go on for k - 1 bases into the next block, with the
    lengths of the pieces of steps that they are made of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.bounded(batches, 2):
            codes, owner, place, plain = S.rolled(batch.column(2).to_pylist(), k)
            first = np.flatnonzero(place == 0)
            change = np.zeros(len(place) + 1, np.int64)
            for begin, sizes in zip(first, batch.column(3).to_pylist()):
                ends = begin + np.cumsum(sizes[:-1], dtype=np.int64)
                np.add.at(change, np.maximum(ends - (k - 1), 0), 1)
                np.add.at(change, ends, -1)
            at = np.flatnonzero(plain & (np.cumsum(change)[: len(plain)] > 0))
            start = batch.column(1).to_numpy(zero_copy_only=False)[owner[at]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(place[at] + start), pa.array(codes[at])], ["path_name", "pos", "kmer"])

    cut = blocks.select("path_name", "start_bp", F.upper("text").alias("text"), "sizes")
    return cut.mapInArrow(run, "path_name string, pos long, kmer long")


def node_hits(wanted: DataFrame, node_words: DataFrame) -> DataFrame:
    """(node_id, locus, n): how many k-mers inside a node are among ``wanted`` (locus, kmer); ``node_words`` is (node_id, pos, kmer)."""
    return node_words.join(wanted.hint("merge"), "kmer").groupBy("node_id", "locus").agg(F.count(F.lit(1)).alias("n"))


def walk_hits(wanted: DataFrame, per_node: DataFrame, steps: DataFrame, borders: DataFrame) -> DataFrame:
    """(path_name, locus, hits): how many k-mers of a walk are among ``wanted`` (locus, kmer), a place counting each time.

    ``per_node`` is that of ``node_hits`` and counts once for each visit of a node; ``steps`` is (path_name, node_id), ``borders`` (path_name,
    kmer), the k-mers that no single step holds. The planner takes what comes out of Python for as small as what goes in, so a broadcast is ruled out there.
    """
    visits = steps.groupBy("path_name", "node_id").agg(F.count(F.lit(1)).alias("times"))
    inside = visits.join(per_node, "node_id").groupBy("path_name", "locus").agg(F.sum(F.col("times") * F.col("n")).alias("hits"))
    over = borders.join(wanted.hint("merge"), "kmer").groupBy("path_name", "locus").agg(F.count(F.lit(1)).alias("hits"))
    return inside.unionByName(over).groupBy("path_name", "locus").agg(F.sum("hits").alias("hits"))


def with_decoys(index: DataFrame, decoys: DataFrame) -> DataFrame:
    """The index with its decoy k-mers as rows of class D, which screen nothing."""
    more = decoys.select("locus", "kmer", F.lit(0).cast("long").alias("mult"), F.lit(0).cast("long").alias("outside"), F.lit("D").alias("cls"), F.lit(False).alias("screen"))
    return index.select(*more.columns).unionByName(more)


def labelled(fragments: DataFrame, keys: list[str], text: str, index: DataFrame, k: int) -> DataFrame:
    """(*keys, locus, windows, labels, hits): one row per fragment and screened locus, with its text of labels.

    ``hits`` holds (pos, cls, kmer) of the known k-mers, ``windows`` counts all places of the fragment.
    """
    one = fragments.where(F.length(text) >= k).groupBy(*keys).agg(F.min(text).alias("__t"))
    rows = words(one, keys, "__t", k)
    met = rows.join(index.select("locus", "kmer", "cls", "screen"), "kmer").groupBy(*keys, "locus")
    hits = met.agg(F.bool_or("screen").alias("screen"), F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "cls", "kmer"))).alias("hits")).where("screen")
    info = one.select(*keys, blank_labels(F.col("__t"), k).alias("mask"), (F.length("__t") - (k - 1)).cast("long").alias("windows"))
    return hits.join(info, keys).select(*keys, "locus", "windows", _filled("hits", "cls").alias("labels"), "hits")


def blank_labels(text: Column, k: int) -> Column:
    """The labels of a text whose k-mers are all unknown."""
    odd = F.array_join(F.transform(S.canonical_kmers(text, k), lambda x: F.when(x.isNull(), "-").otherwise("N")), "")
    return F.when(S.is_plain(F.upper(text)), F.repeat(F.lit("N"), F.length(text) - (k - 1))).otherwise(odd)


def _filled(parts: str, text: str) -> Column:
    """``mask`` with the sorted ``parts`` laid over it: arrays of structs with ``pos`` and a text."""
    end = lambda i: F.when(i > 0, F.get(parts, i - 1)["pos"] + F.length(F.get(parts, i - 1)[text])).otherwise(0)
    laid = F.transform(parts, lambda h, i: F.concat(F.col("mask").substr(end(i) + 1, h["pos"] - end(i)), h[text]))
    last = F.element_at(parts, -1)
    return F.concat(F.array_join(laid, ""), F.col("mask").substr(last["pos"] + F.length(last[text]) + 1, F.length("mask")))


def _letter() -> Column:
    """The label of an index row; lower case where the k-mer is in the screen."""
    return F.when(F.col("screen"), F.lower("cls")).otherwise(F.col("cls"))


def labelled_windows(steps: DataFrame, nodes: DataFrame, node_words: DataFrame, borders: DataFrame, windows: DataFrame, index: DataFrame, k: int, length: int, size: int = 10_000) -> DataFrame:
    """(path_name, win, locus, windows, labels): what ``labelled`` gives for the windows of ``length`` bases of walks.

    The k-mers inside nodes are labelled once per node, in blocks of ``size`` places, and their texts of labels are laid along the
    ``steps`` (path_name, node_id, reverse, start_bp, end_bp) and cut at the windows. K-mers over the ends of steps
    are ``borders`` (path_name, pos, kmer). ``nodes`` is (node_id, sequence), ``windows`` (path_name, win, sequence).
    """
    known = index.select("kmer", "locus", _letter().alias("letter"))
    at = F.col("pos") - F.col("start") * size
    hits = node_words.join(known, "kmer").withColumn("start", F.floor(F.col("pos") / size)).groupBy("node_id", "start", "locus")
    parts = hits.agg(F.sort_array(F.collect_list(F.struct(at.cast("int").alias("pos"), "letter"))).alias("parts"))
    blank = S.text_blocks(nodes, ["node_id"], "sequence", size, k - 1).select("node_id", (F.col("start") / size).cast("long").alias("start"), blank_labels(F.col("text"), k).alias("mask"))
    texts = parts.join(blank, ["node_id", "start"]).select("node_id", (F.col("start") * size).alias("from"), "locus", _filled("parts", "letter").alias("text"))

    n = F.length("text")
    lo = F.when(F.col("reverse"), F.col("end_bp") - F.col("from") - n - (k - 1)).otherwise(F.col("start_bp") + F.col("from"))
    along = texts.join(steps, "node_id").select("path_name", "locus", lo.alias("lo"), n.alias("n"), F.when(F.col("reverse"), F.reverse("text")).otherwise(F.col("text")).alias("text"))
    spread = along.withColumn("win", F.explode(F.sequence(F.floor(F.col("lo") / length), F.floor((F.col("lo") + F.col("n") - 1) / length))))
    begin = F.greatest(F.col("lo"), F.col("win") * length)
    end = F.least(F.col("lo") + F.col("n"), F.col("win") * length + (length - k + 1))
    cut = F.col("text").substr((begin - F.col("lo") + 1).cast("int"), (end - begin).cast("int"))
    inside = spread.where(end > begin).select("path_name", "win", "locus", (begin - F.col("win") * length).cast("int").alias("pos"), cut.alias("text")).where("text rlike '[^N-]'")

    over = borders.withColumn("win", F.floor(F.col("pos") / length)).withColumn("pos", (F.col("pos") % length).cast("int")).where(F.col("pos") <= length - k)
    over = over.join(known, "kmer").select("path_name", "win", "locus", "pos", F.col("letter").alias("text"))
    met = inside.unionByName(over).groupBy("path_name", "win", "locus")
    held = met.agg(F.bool_or(F.col("text").rlike("[psr]")).alias("screen"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("parts")).where("screen")
    one = windows.where(F.length("sequence") >= k)
    info = one.select("path_name", F.col("win").cast("long").alias("win"), blank_labels(F.col("sequence"), k).alias("mask"), (F.length("sequence") - (k - 1)).cast("long").alias("windows"))
    both = held.join(info, ["path_name", "win"])
    return both.select("path_name", F.col("win").cast("int").alias("win"), "locus", "windows", F.upper(_filled("parts", "text")).alias("labels"))


def costs(error: Column | float, k: int = 31) -> tuple[Column, Column]:
    """(gap cost, flank share) of a read's error rate."""
    q = F.pow(F.greatest(F.lit(0.0), 1 - _column(error) - NEW_ALLELES), F.lit(k))
    return F.when(q >= 1, 1e9).otherwise(GAP_SHARE * q / (1 - q)), FLANK_SHARE * q


def tolerated_runs(error: Column | float, callable_bases: Column) -> Column:
    """How many unknown runs a read of this error rate may have."""
    rate = (_column(error) + NEW_ALLELES) * callable_bases
    return rate + DEVIATIONS * F.sqrt(rate) + SPARE_RUNS


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def segment(labels: Column, k: int, gap_cost: Column | float) -> Column:
    """struct(score, first, last, at, to) of the best stretch of a text of labels.

    P, S and R score 1, D -2; the first k of a run of N nothing, the others the gap cost. Of equal scores the longest,
    then the first. ``first`` and ``last`` count callable k-mers, ``at`` and ``to`` places in the text; ``last`` is
    less than ``first`` where nothing scores. Runs of like labels are folded, not single ones.
    """
    gap = _column(gap_cost)
    state = {"cur": 0.0, "first": 0, "at": 0, "score": 0.0, "bfirst": 1, "blast": 0, "bat": 1, "bto": 0, "i": 0, "j": 0}
    start = F.struct(*[F.lit(v).alias(n) for n, v in state.items()])

    def take(a: Column, run: Column) -> Column:
        n, c = F.length(run), run.substr(1, 1)
        known, skip = c.isin("P", "S", "R"), c == "-"
        fresh = a["cur"] <= 0
        first, at, cur = F.when(fresh, a["i"]).otherwise(a["first"]), F.when(fresh, a["j"]).otherwise(a["at"]), F.greatest(a["cur"], F.lit(0.0))
        lost = F.when(c == "D", -DECOY_SCORE * n).otherwise(gap * F.greatest(n - k, F.lit(0)))
        reach = F.when(known, n).otherwise(F.least(n, F.lit(k)))  # as far as the score has not begun to fall
        top = F.when(known, cur + n).otherwise(cur)
        longer = a["i"] + reach - 1 - first > a["blast"] - a["bfirst"]
        better = (c != "D") & (top > 0) & ((top > a["score"]) | ((top == a["score"]) & longer))
        new = {
            "cur": F.when(known, top).otherwise(F.greatest(cur - lost, F.lit(0.0))), "first": first, "at": at, "score": F.when(better, top).otherwise(a["score"]),
            "bfirst": F.when(better, first).otherwise(a["bfirst"]), "blast": F.when(better, a["i"] + reach - 1).otherwise(a["blast"]),
            "bat": F.when(better, at).otherwise(a["bat"]), "bto": F.when(better, a["j"] + reach - 1).otherwise(a["bto"]), "i": a["i"] + n, "j": a["j"] + n,
        }
        past = {name: a[name] if name != "j" else a["j"] + n for name in state}
        pack = lambda d: F.struct(*[d[name].alias(name) for name in state])
        return F.when(skip, pack(past)).otherwise(pack(new))

    done = lambda a: F.struct(a["score"].alias("score"), a["bfirst"].alias("first"), a["blast"].alias("last"), a["bat"].alias("at"), a["bto"].alias("to"))
    return F.aggregate(F.regexp_extract_all(labels, F.lit("[PSR]+|D+|N+|-+"), F.lit(0)), start, take, done)


def sites(labels: Column, letter: str, k: int) -> Column:
    """Greedy count of the places of a label that lie at least k from the last one taken; runs are folded whole."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"), F.lit(0).alias("at"))

    def take(a: Column, run: Column) -> Column:
        n = F.length(run)
        begin = F.greatest(a["at"], a["last"] + k)
        more = F.when(run.startswith(letter) & (begin < a["at"] + n), F.floor((a["at"] + n - 1 - begin) / k).cast("int") + 1).otherwise(0)
        last = F.when(more > 0, begin + (more - 1) * k).otherwise(a["last"])
        return F.struct((a["n"] + more).alias("n"), last.alias("last"), (a["at"] + n).alias("at"))

    return F.aggregate(F.regexp_extract_all(labels, F.lit(f"{letter}+|[^{letter}]+"), F.lit(0)), start, take, lambda a: a["n"])


def count_of(labels: Column, letters: str) -> Column:
    """How many of the letters a text of labels holds."""
    return F.length(F.regexp_replace(labels, f"[^{letters}]", ""))


def evidence(rows: DataFrame, k: int, error: Column | float = 0.01) -> DataFrame:
    """Adds to the rows of ``labelled`` the counts, the segment, whether it ends at flanks, sites and unknown runs in it, and its status.

    A segment of fewer than k k-mers is none. The segment alone is judged where little of the locus lies beyond its
    ends, below the flank share, and decoys beyond one end at most; otherwise the whole fragment is.
    """
    gap, flank = costs(error, k)
    text = F.col("labels")
    at = rows.withColumn("__s", segment(text, k, gap)).withColumn("__some", F.col("__s.last") - F.col("__s.first") + 1 >= k)
    left, right = text.substr(F.lit(1), F.col("__s.at")), text.substr(F.col("__s.to") + 2, F.length(text))
    share = lambda x: F.coalesce(F.try_divide(count_of(x, "PSR").cast("double"), count_of(x, "PSRDN").cast("double")), F.lit(0.0))
    both_decoys = left.contains("D") & right.contains("D")
    ends = at.withColumn("boundary", F.col("__some") & (share(left) < flank) & (share(right) < flank) & ~both_decoys)
    own = F.when(~F.col("__some"), "").when(F.col("boundary"), text.substr(F.col("__s.at") + 1, F.col("__s.to") - F.col("__s.at") + 1)).otherwise(text)
    # places outside the segment are kept as gaps, so that distances across it stay
    rest = F.when(~F.col("__some"), text).when(F.col("boundary"), F.concat(left, F.repeat(F.lit("N"), F.length(own)), right)).otherwise("")
    out = ends.withColumn("__own", own).withColumn("__rest", rest)
    n = lambda c: count_of(text, c).cast("long").alias("n_" + c.lower())
    out = out.select(
        *[c for c in rows.columns if c not in ("labels", "hits")], count_of(text, "PSRDN").cast("long").alias("kmers"), n("P"), n("S"), n("R"), n("D"), n("N"),
        F.when(F.col("__some"), F.col("__s.at")).alias("seg_from"), F.when(F.col("__some"), F.col("__s.to") + k).alias("seg_to"), "boundary",
        count_of(F.col("__own"), "PSRDN").cast("long").alias("seg_kmers"), sites(F.col("__own"), "P", k).alias("sites_p"),
        (sites(F.col("__own"), "D", k) + F.when(F.col("boundary"), 0).otherwise(sites(F.col("__rest"), "D", k))).alias("sites_d"),
        F.when(F.col("boundary"), sites(F.col("__rest"), "D", k)).otherwise(0).alias("decoy_out"),
        F.size(F.regexp_extract_all("__own", F.lit("N+"), F.lit(0))).alias("runs_n"),
    )
    status = F.when(F.col("seg_kmers") == 0, "out").when(F.col("seg_kmers") >= F.col("kmers") * FULL, "in").otherwise("part")
    return out.withColumn("status", status)


def certain(least_sites: int, k: int, error: Column | float = 0.01, prefix: str = "") -> Column:
    """Whether the evidence of a row makes it certain: enough private sites, few decoys, dense enough, callable and not too divergent."""
    c = lambda name: F.col(prefix + name)
    return (
        (c("seg_kmers") > 0) & (c("kmers") * 2 >= c("windows")) & (c("runs_n") <= tolerated_runs(error, c("seg_kmers"))) & (c("sites_p") >= least_sites)
        & (c("sites_d") <= DECOY_SHARE * c("sites_p")) & (c("sites_p") >= DENSITY * c("seg_kmers") / k)
    )


def verdict(rows: DataFrame, k: int, least_sites: int = 2, error: Column | float = 0.01, sure: Column | None = None) -> DataFrame:
    """Adds fate and reason, by the first rule that holds; ``sure`` replaces the rule of a single fragment."""
    sure = certain(least_sites, k, error) if sure is None else sure
    decoys = F.col("sites_d") + F.col("decoy_out")
    some = F.col("sites_p") >= 1
    reason = (
        F.when(sure, F.when(F.col("status") == "part", "partial").otherwise("."))
        .when((F.col("sites_p") == 0) & (decoys >= 2), "homolog").when(some & (decoys >= 1), "conflict").when(some & (F.col("kmers") * 2 < F.col("windows")), "uncallable")
        .when(some & (F.col("runs_n") > tolerated_runs(error, F.col("seg_kmers"))), "divergent").when(F.col("sites_p") >= least_sites, "sparse")
        .when(some, "single_site").when(F.col("n_s") >= 1, "shared_only").otherwise("no_evidence")
    )
    fate = F.when(sure, "certain").when(F.col("reason").isin("homolog", "no_evidence"), "unrecruited").otherwise("ambiguous")
    return rows.withColumn("reason", reason).withColumn("fate", fate)


def pooled(rows: DataFrame, pair: list[str], mate: str, k: int, least_sites: int = 2, error: Column | float = 0.01) -> DataFrame:
    """(*pair, locus, mates, pooled evidence, fate, reason): the two mates of a pair judged together.

    ``rows`` is the evidence of single mates, ``mate`` 1 or 2. Counts add up; a mate without a row for the locus is
    out. The pair is certain by its pooled evidence where a mate lies wholly in the locus, or by one mate alone
    unless the other leans to a homolog away from an edge of the locus. Independent sites of the two mates are
    added: mates are taken not to overlap.
    """
    sums = ["kmers", "windows", "n_p", "n_s", "n_r", "n_d", "n_n", "seg_kmers", "sites_p", "sites_d", "decoy_out", "runs_n"]
    side = lambda m: F.max(F.when(F.col(mate) == m, F.struct("status", F.lit(True).alias("known"), *sums)))
    both = rows.groupBy(*pair, "locus").agg(side(1).alias("a"), side(2).alias("b"), *[F.sum(c).alias(c) for c in sums])
    for m in "ab":
        both = both.select("*", F.coalesce(f"{m}.status", F.lit("out")).alias(f"{m}_status"), *[F.coalesce(f"{m}.{c}", F.lit(0)).alias(f"{m}_{c}") for c in sums])
    carries = lambda x, y: certain(least_sites, k, error, f"{x}_") & ((F.col(f"{y}_sites_d") + F.col(f"{y}_decoy_out") <= F.col(f"{y}_sites_p")) | (F.col(f"{x}_status") == "part"))
    whole = certain(least_sites, k, error) & ((F.col("a_status") == "in") | (F.col("b_status") == "in"))
    out = both.withColumn("__whole", whole).withColumn("__sure", whole | carries("a", "b") | carries("b", "a"))
    out = out.withColumn("status", F.when(F.col("a_status").isin("part") | F.col("b_status").isin("part"), "part").otherwise("in"))
    judged = verdict(out, k, least_sites, error, F.col("__sure"))
    away = ~F.col("__whole") | (F.col("a_status") == "out") | (F.col("b_status") == "out")
    reason = F.when(F.col("__sure") & away, "rescued").otherwise(F.col("reason"))
    return judged.select(*pair, "locus", F.concat_ws(",", "a_status", "b_status").alias("mates"), *sums, "fate", reason.alias("reason"))


def private_runs(index: DataFrame, node_words: DataFrame) -> DataFrame:
    """(node_id, locus, at, n): runs of neighbouring private k-mers inside a node; ``node_words`` is (node_id, pos, kmer)."""
    private = index.where("cls = 'P'").select("locus", "kmer")
    held = node_words.join(private.hint("merge"), "kmer").select("node_id", "locus", "pos")
    order = W.partitionBy("node_id", "locus").orderBy("pos")
    return held.withColumn("__g", F.col("pos") - F.row_number().over(order)).groupBy("node_id", "locus", "__g").agg(F.min("pos").alias("at"), F.count(F.lit(1)).alias("n")).drop("__g")


def private_spans(index: DataFrame, runs: DataFrame, steps: DataFrame, borders: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(home, path_name, n_bases, lo, n): runs of places where a walk holds private k-mers of its own locus.

    ``runs`` is that of ``private_runs``, laid along the ``steps`` (path_name, node_id, reverse, start_bp, end_bp); ``borders`` (path_name, pos, kmer) are the
    k-mers over the ends of steps, ``lengths`` (path_name, home, n_bases). What comes out of Python is of unknown size, so it is not broadcast.
    """
    private = index.where("cls = 'P'").select("locus", "kmer")
    lo = F.when(F.col("reverse"), F.col("end_bp") - F.col("at") - F.col("n") - (k - 1)).otherwise(F.col("start_bp") + F.col("at"))
    inside = steps.join(runs, "node_id").select("path_name", "locus", lo.alias("lo"), "n")
    over = borders.join(private.hint("merge"), "kmer").select("path_name", "locus", F.col("pos").alias("lo"), F.lit(1).cast("long").alias("n"))
    return inside.unionByName(over).join(lengths, "path_name").where("locus = home").select("home", "path_name", "n_bases", "lo", "n")


def ceilings(spans: DataFrame, lengths: DataFrame, k: int, length: int = 150, step: int = 25, size: int = 10_000) -> DataFrame:
    """(locus, path_name, windows, private_3, sites_2): the share of a walk's windows that hold at least three private k-mers, and at least two sites.

    ``spans`` is that of ``private_spans``, ``lengths`` (path_name, home, n_bases). Windows of ``length`` bases start every ``step``. Spans are gathered by
    blocks of ``size`` bases (a multiple of ``step``) where windows start, so a row is bounded by its block, and a block's windows are counted as
    arrays. The sites of a window are those of its runs of consecutive private k-mers, one for every k or part of k.
    """
    wide = length - k + 1  # places of a window

    @F.pandas_udf("three int, two int")
    def counted(starts: pd.Series, los: pd.Series, sizes: pd.Series, most: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(starts), 2), np.int32)
        for i, (start, lo, n, last) in enumerate(zip(starts, los, sizes, most)):
            first = np.arange(0, min(size - 1, last - length - start) + 1, step)
            if not len(first):
                continue
            lo = np.asarray(lo, np.int64) - start
            end = np.clip(lo + np.asarray(n, np.int64), 0, first[-1] + wide)
            change = np.zeros(first[-1] + wide + 1, np.int32)
            np.add.at(change, np.clip(lo, 0, first[-1] + wide), 1)
            np.add.at(change, end, -1)
            held = np.cumsum(change)[:-1] > 0
            place = np.arange(len(held))
            run = place - np.maximum.accumulate(np.where(held, -1, place))  # 1 for the first of a run
            window = first[:, None] + np.arange(wide)
            of = held[window]
            opens = of & (np.minimum(run[window] - 1, np.arange(wide)) % k == 0)  # a site begins with a run, or with the window, and again after every k
            out[i] = (of.sum(axis=1) >= 3).sum(), (opens.sum(axis=1) >= 2).sum()
        return pd.DataFrame({"three": out[:, 0], "two": out[:, 1]})

    first = F.greatest(F.floor((F.col("lo") - (length - k)) / size), F.lit(0))
    spread = spans.withColumn("b", F.explode(F.sequence(first, F.floor((F.col("lo") + F.col("n") - 1) / size))))
    held = spread.groupBy("home", "path_name", "n_bases", "b").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    done = held.select("home", "path_name", counted(F.col("b") * size, "lo", "n", "n_bases").alias("c"))
    per = done.groupBy("home", "path_name").agg(F.sum("c.three").alias("three"), F.sum("c.two").alias("two"))
    windows = F.floor((F.col("n_bases") - length) / step) + 1
    out = lengths.where(F.col("n_bases") >= length).join(per, ["home", "path_name"], "left").withColumn("windows", windows)
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("windows")
    return out.select(F.col("home").alias("locus"), "path_name", "windows", share("three").alias("private_3"), share("two").alias("sites_2"))


def false_certain(rows: DataFrame, lowest: int = 2, highest: int = 8) -> DataFrame:
    """(cut, false_certain, screened) from (sites_p, fit, own): how many fragments of elsewhere a cut would call certain.

    ``own`` tells whether the fragment comes from the locus, only the others count; ``fit`` whether all rules of
    certainty but the number of sites hold.
    """
    cuts = rows.where("not own").withColumn("cut", F.explode(F.sequence(F.lit(lowest), F.lit(highest))))
    return cuts.groupBy("cut").agg(F.count_if(F.col("fit") & (F.col("sites_p") >= F.col("cut"))).alias("false_certain"), F.count(F.lit(1)).alias("screened"))


def calibrated_cut(counted: DataFrame, rate: float, lowest: int = 2, highest: int = 8) -> DataFrame:
    """(cut, met): the least cut whose false-certain count is within rate x screened, else ``highest`` and unmet.

    ``counted`` is (cut, false_certain, screened), one row per cut tried.
    """
    fine = counted.where(F.col("cut").between(lowest, highest) & (F.col("false_certain") <= F.lit(rate) * F.col("screened")))
    best = fine.agg(F.min("cut").alias("cut"))
    return best.select(F.coalesce("cut", F.lit(highest)).alias("cut"), F.col("cut").isNotNull().alias("met"))
