"""Sequences rebuilt from events, ordered matches of repeated crossings, chains of anchors, approximate tandem periods.

Defined results: an event that overlaps an earlier one of its haplotype is left out and counted; a null or
``.`` alternative is empty; haplotypes without a reference have no row; null anchors and texts take no
part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def apply_events(events: DataFrame, references: DataFrame) -> DataFrame:
    """(haplotype, reference, n_applied, n_skipped, sequence): each haplotype with its events put into its reference.

    ``events`` is (haplotype, reference, event, start, stop, alt), positions from 0 and ``stop`` exclusive;
    ``references`` is (reference, sequence). Events are taken from left to right, ties by ``stop`` and name;
    one that begins before the end of any earlier one is skipped. A haplotype's applied events do not
    overlap, so its row is bounded by its reference.
    """
    before = W.partitionBy("haplotype", "reference").orderBy("start", "stop", "event").rowsBetween(W.unboundedPreceding, -1)
    rows = events.where("haplotype is not null and start is not null and stop >= start").select("haplotype", "reference", "event", "start", "stop", "alt")
    marked = rows.withColumn("__ok", F.coalesce(F.col("start") >= F.max("stop").over(before), F.lit(True)))
    marked = marked.withColumn("__from", F.coalesce(F.max(F.when(F.col("__ok"), F.col("stop"))).over(before), F.lit(0)))
    alt = F.when(F.col("alt") != ".", F.col("alt"))
    piece = F.struct("start", "stop", "event", F.col("__from").alias("from"), F.coalesce(alt, F.lit("")).alias("alt"))
    lists = marked.groupBy("haplotype", "reference").agg(
        F.count_if("__ok").alias("n_applied"), F.count_if(~F.col("__ok")).alias("n_skipped"), F.sort_array(F.collect_list(F.when(F.col("__ok"), piece))).alias("__p")
    )
    whole = F.col("sequence")
    parts = F.transform("__p", lambda e: F.concat(whole.substr((e["from"] + 1).cast("int"), (e["start"] - e["from"]).cast("int")), e["alt"]))
    tail = whole.substr((F.element_at("__p", -1)["stop"] + 1).cast("int"), F.length(whole))
    made = lists.join(references.select("reference", "sequence"), "reference")
    return made.select("haplotype", "reference", "n_applied", "n_skipped", F.concat(F.array_join(parts, ""), tail).alias("sequence"))


def similarity(a: list[str], b: list[str]) -> float:
    """Dice of two lists of steps as multisets; two empty lists are alike."""
    if not len(a) and not len(b):
        return 1.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def ordered_match(a: list, b: list, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that keep the order of both lists, each pair at least ``least`` alike: as many as possible, then the most alike, then the earliest."""
    n, m = len(a), len(b)
    left, right = [tuple(x) for x in a], [tuple(y) for y in b]
    known = {(x, y): similarity(x, y) for x in set(left) for y in set(right)}
    alike = [[known[x, y] for y in right] for x in left]
    best = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]  # of what is left from i and j on
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            here = max(best[i + 1][j], best[i][j + 1])
            if alike[i][j] >= least:
                k, s = best[i + 1][j + 1]
                here = max(here, (k + 1, round(s + alike[i][j], 9)))
            best[i][j] = here
    out, i, j = [], 0, 0
    while i < n and j < m:
        k, s = best[i + 1][j + 1]
        if alike[i][j] >= least and best[i][j] == (k + 1, round(s + alike[i][j], 9)):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return out


def crossing_matches(read: DataFrame, least: float = 0.5) -> DataFrame:
    """(bubble_id, path_name, crossing, ref_crossing, same): the crossings of each path paired in order with those of the site's reference.

    ``read`` is (bubble_id, path_name, crossing, inside); the reference is the least path of the site. The
    unit of work is one path at one site.
    """
    lists = read.groupBy("bubble_id", "path_name").agg(F.sort_array(F.collect_list(F.struct("crossing", "inside"))).alias("own"))
    first = read.groupBy("bubble_id").agg(F.min("path_name").alias("path_name"))
    reference = lists.join(first, ["bubble_id", "path_name"]).select("bubble_id", F.col("path_name").alias("__ref"), F.col("own").alias("ref"))
    both = lists.join(reference, "bubble_id").where("path_name <> __ref")

    @F.pandas_udf("array<struct<i: int, j: int>>")
    def matched(own: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([ordered_match([list(x) for x in a], [list(x) for x in b], least) for a, b in zip(own, ref)])

    pairs = both.select("bubble_id", "path_name", "own", "ref", F.explode(matched("own.inside", "ref.inside")).alias("p"))
    at = lambda side, i: F.get(F.col(side), F.col(f"p.{i}"))
    return pairs.select(
        "bubble_id", "path_name", at("own", "i")["crossing"].alias("crossing"), at("ref", "j")["crossing"].alias("ref_crossing"), (at("own", "i")["inside"] == at("ref", "j")["inside"]).alias("same")
    )


def chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, gap: int, least: int) -> list[np.ndarray]:
    """Chains of anchors that rise in x and y with steps of at most ``gap`` in both: the heaviest first, then again among the rest.

    Chains of fewer than ``least`` anchors are not reported. Ties go to the chain that ends first.
    """
    order = np.lexsort((y, x))
    left, out = order, []
    while len(left) >= least:
        a, b, best, back = x[left], y[left], weight[left].astype(float), np.full(len(left), -1)
        for i in range(1, len(left)):
            lo = np.searchsorted(a, a[i] - gap, side="left")
            fits = (a[lo:i] < a[i]) & (b[lo:i] < b[i]) & (b[i] - b[lo:i] <= gap)
            if fits.any():
                scores = np.where(fits, best[lo:i], -1)
                j = int(scores.argmax())
                best[i] += scores[j]
                back[i] = lo + j
        at, took = int(best.argmax()), []
        while at >= 0:
            took.append(at)
            at = back[at]
        if len(took) < least:
            # the heaviest chain is too short: its anchors are spent, longer and lighter ones may be left
            left = np.delete(left, took)
            continue
        out.append(left[took[::-1]])
        left = np.delete(left, took)
    return out


def anchor_chains(anchors: DataFrame, keys: list[str], gap: int, least: int = 3) -> DataFrame:
    """(*keys, backward, chain, n_anchors, weight, ref_lo, ref_hi, lo, hi): chains of each record and strand, numbered from the heaviest.

    ``anchors`` is (*keys, backward, ref_pos, pos, weight); on the backward strand ``pos`` falls as
    ``ref_pos`` rises. The unit of work is one record's anchors.
    """
    known = anchors.where("ref_pos is not null and pos is not null").select(*keys, "backward", F.struct("ref_pos", "pos", F.coalesce("weight", F.lit(0)).alias("weight")).alias("a"))
    lists = known.groupBy(*keys, "backward").agg(F.sort_array(F.collect_list("a")).alias("a"))

    @F.pandas_udf("array<struct<n: long, weight: long, ref_lo: long, ref_hi: long, lo: long, hi: long>>")
    def chained(rows: pd.Series, backward: pd.Series) -> pd.Series:
        out = []
        for row, turned in zip(rows, backward):
            x, y, w = (np.array([r[k] for r in row], np.int64) for k in ("ref_pos", "pos", "weight"))
            found = chain(x, -y if turned else y, w, gap, least)
            out.append([(len(c), int(w[c].sum()), int(x[c].min()), int(x[c].max()), int(y[c].min()), int(y[c].max())) for c in found])
        return pd.Series(out)

    made = lists.select(*keys, "backward", F.posexplode(chained("a", "backward")).alias("chain", "c"))
    return made.select(*keys, "backward", F.col("chain") + 1, "c.*").toDF(*keys, "backward", "chain", "n_anchors", "weight", "ref_lo", "ref_hi", "lo", "hi")


def tandem_periods(words: DataFrame, key: str, least_seeds: int = 3) -> DataFrame:
    """(key, period, n_seeds, first_pos, last_pos, copies): the most usual distance between a word and its next occurrence.

    ``words`` is (key, pos, word). Ties go to the shorter period. ``copies`` is the stretch from the first
    to the last seed over the period, so that imperfect copies count as long as seeds lie on both sides.
    """
    following = F.lead("pos").over(W.partitionBy(key, "word").orderBy("pos"))
    lags = words.withColumn("period", following - F.col("pos")).where("period is not null")
    per = lags.groupBy(key, "period").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    best = per.where(F.col("n_seeds") >= least_seeds).groupBy(key).agg(F.min_by(F.struct("period", "n_seeds", "first_pos", "last_pos"), F.struct(-F.col("n_seeds"), "period")).alias("b"))
    copies = (F.col("b.last_pos") - F.col("b.first_pos")) / F.col("b.period") + 2
    return best.select(key, "b.*", F.floor(copies).cast("long").alias("copies"))
