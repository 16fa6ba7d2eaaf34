"""Alleles of sites: numbered by carriers, compared as weighted multisets of nodes, clustered, and aligned step by step.

``read`` is (bubble_id, path_name, crossing, signature, inside), the crossings of ``operators.walks`` with their steps. Defined
results: an empty allele is an allele; two empty ones are alike; nodes of no known length weigh 1; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.operators.cluster import greedy_leaders


def alleles(read: DataFrame) -> DataFrame:
    """(bubble_id, signature, n_paths, n_crossings, allele): alleles numbered from the most carried."""
    grouped = read.groupBy("bubble_id", "signature").agg(F.count_distinct("path_name").alias("n_paths"), F.count(F.lit(1)).alias("n_crossings"))
    return grouped.withColumn("allele", F.row_number().over(W.partitionBy("bubble_id").orderBy(F.desc("n_paths"), "signature")))


def allele_weights(read: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bubble_id, allele, node_id, occurrence, bp), the inside nodes of each allele as a multiset, and (bubble_id, allele, size) of every allele."""
    ranked = alleles(read).select("bubble_id", "signature", "allele")
    read = read.select("bubble_id", "signature", "inside").dropDuplicates(["bubble_id", "signature"])
    one = read.join(ranked, ["bubble_id", "signature"]).select("bubble_id", "allele", F.posexplode("inside").alias("i", "step")).withColumn("node_id", F.expr("substring(step, 2)"))
    nth = F.row_number().over(W.partitionBy("bubble_id", "allele", "node_id").orderBy("i"))
    weight = F.greatest(F.coalesce("bp", F.lit(0)), F.lit(1)).alias("bp")
    weights = one.withColumn("occurrence", nth).join(nodes.select("node_id", "bp"), "node_id", "left").select("bubble_id", "allele", "node_id", "occurrence", weight)
    held = weights.groupBy("bubble_id", "allele").agg(F.sum("bp").alias("size"))
    sizes = ranked.select("bubble_id", "allele").join(held, ["bubble_id", "allele"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return weights, sizes


def clustered_alleles(read: DataFrame, nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """(bubble_id, allele, leader): most carried first, an allele joins the first leader whose Dice with it is at least ``least``."""
    w, size = allele_weights(read, nodes)
    a, b = w.withColumnRenamed("allele", "a"), w.select("bubble_id", F.col("allele").alias("b"), "node_id", "occurrence")
    both = a.join(b, ["bubble_id", "node_id", "occurrence"]).where("a <> b").groupBy("bubble_id", "a", "b").agg(F.sum("bp").alias("both"))
    sized = both.join(size.select("bubble_id", F.col("allele").alias("a"), F.col("size").alias("sa")), ["bubble_id", "a"]).join(
        size.select("bubble_id", F.col("allele").alias("b"), F.col("size").alias("sb")), ["bubble_id", "b"]
    )
    near = sized.where(2 * F.col("both") >= least * (F.col("sa") + F.col("sb"))).select("bubble_id", F.col("a").alias("allele"), F.col("b").alias("other"))
    return greedy_leaders(size.select("bubble_id", "allele", F.col("allele").alias("rank")), "bubble_id", "allele", "rank", near, "other")


def _codes(a: list[str], b: list[str]):
    import numpy as np

    codes = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    return np.array([codes[s] for s in a], np.int64), np.array([codes[s] for s in b], np.int64)


def _next_row(row, x, y):
    """The row of the alignment table that follows ``row``, for the step ``x`` against all of ``y``."""
    import numpy as np

    drop = np.arange(len(y) + 1)
    best = row - 1
    if len(y):
        best[1:] = np.maximum(best[1:], np.where(y == x, row[:-1] + 2, np.iinfo(np.int64).min // 2))
    return np.maximum.accumulate(best + drop) - drop


def _matches(x, y) -> list[tuple[int, int]]:
    """The matched places of a global alignment, from its whole table."""
    import numpy as np

    n, m = len(x), len(y)
    score = np.zeros((n + 1, m + 1), np.int64)
    score[0, :] = -np.arange(m + 1)
    for i in range(1, n + 1):
        score[i] = _next_row(score[i - 1], x[i - 1], y)
    i, j, out = n, m, []
    while i or j:
        if i and j and x[i - 1] == y[j - 1] and score[i, j] == score[i - 1, j - 1] + 2:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _long_matches(x, y, cells: int) -> list[tuple[int, int]]:
    """As ``_matches``, in memory that grows with the lengths alone: equal ends are stripped, the rest is halved (Hirschberg)."""
    import numpy as np

    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n == 1 or (n + 1) * (m + 1) <= cells:
            out.extend((i0 + i, j0 + j) for i, j in _matches(x[i0:i1], y[j0:j1]))
            continue
        mid, part = (i0 + i1) // 2, y[j0:j1]
        head = tail = -np.arange(m + 1)
        for i in range(i0, mid):
            head = _next_row(head, x[i], part)
        for i in range(i1 - 1, mid - 1, -1):
            tail = _next_row(tail, x[i], part[::-1])
        cut = j0 + int(np.argmax(head + tail[::-1]))
        todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return sorted(out)


def _typed(a: list[str], b: list[str], matches: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
    turned = {">": "<", "<": ">"}
    i0 = j0 = 0
    events = []
    for i1, j1 in [*matches, (len(a), len(b))]:
        if (i0, j0) != (i1, j1):
            inverse = [turned[s[0]] + s[1:] for s in reversed(b[j0:j1])]
            kind = "ins" if i0 == i1 else "del" if j0 == j1 else "inv" if a[i0:i1] == inverse else "sub"
            events.append((kind, i0, i1, j0, j1))
        i0, j0 = i1 + 1, j1 + 1
    return events


def align_tokens(a: list[str], b: list[str], cap: int = 4_000_000) -> list[tuple[str, int, int, int, int]] | None:
    """Global alignment of two step lists (match +2, gap -1, no mismatch): the blocks that differ, as (type, a from, a to, b from, b to).

    None where the table would have more than ``cap`` cells. An inversion is a block that is the other
    one reversed with every strand flipped.
    """
    if (len(a) + 1) * (len(b) + 1) > cap:
        return None
    return _typed(a, b, _matches(*_codes(a, b)))


def align_any(a: list[str], b: list[str], cells: int = 4_000_000) -> list[tuple[str, int, int, int, int]]:
    """As ``align_tokens`` for lists of any length; beyond ``cells`` the table is never held as a whole."""
    short = align_tokens(a, b, cells)
    return _typed(a, b, _long_matches(*_codes(a, b), cells)) if short is None else short


def allele_differences(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bubble_id, allele, event, kind, del_bp, ins_bp, size_bp): the typed differences of each distinct allele from the most carried one of its site."""
    one = read.select("bubble_id", "signature", "inside").dropDuplicates(["bubble_id", "signature"])
    ranked = one.join(alleles(read).select("bubble_id", "signature", "allele"), ["bubble_id", "signature"])
    top = ranked.where("allele = 1").select("bubble_id", F.col("inside").alias("ref"))
    pairs = ranked.where("allele > 1").join(top, "bubble_id")

    @F.pandas_udf("array<struct<kind: string, i0: int, i1: int, j0: int, j1: int>>")
    def differ(ref: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series([align_any(list(r), list(s)) for r, s in zip(ref, alt)])

    made = pairs.withColumn("e", differ("ref", "inside")).select("bubble_id", "allele", "ref", "inside", F.posexplode("e").alias("event", "e"))
    cut = made.select("bubble_id", "allele", "event", "e.kind", F.slice("ref", F.col("e.i0") + 1, F.col("e.i1") - F.col("e.i0")).alias("gone"), F.slice("inside", F.col("e.j0") + 1, F.col("e.j1") - F.col("e.j0")).alias("come"))
    parts = cut.select("bubble_id", "allele", "event", "kind", F.explode_outer(F.concat(F.transform("gone", lambda s: F.struct(s.alias("s"), F.lit(0).alias("side"))), F.transform("come", lambda s: F.struct(s.alias("s"), F.lit(1).alias("side"))))).alias("p"))
    sized = parts.select("bubble_id", "allele", "event", "kind", F.expr("substring(p.s, 2)").alias("node_id"), F.col("p.side").alias("side")).join(nodes.select("node_id", "bp"), "node_id", "left")
    bp = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("bp"))), F.lit(0))
    return sized.groupBy("bubble_id", "allele", "event", "kind").agg(bp(0).alias("del_bp"), bp(1).alias("ins_bp")).withColumn("size_bp", F.greatest("del_bp", "ins_bp"))
