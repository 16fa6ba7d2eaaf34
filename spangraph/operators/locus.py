"""Models of a whole locus from sums over blocks of its features.

No task holds a locus: its features are worked in blocks of at most about ``cells`` carrier entries, and what leaves a block
is one row per sample (products of samples, sums) or one row per feature. A task therefore holds the samples' products
(8 bytes x samples x samples) and one block, however many features a locus has.

``doses`` is (group, feature, sample, dose), zeros left out; ``who`` is (group, sample, y) and whatever else a model reads per sample.
A null y leaves its sample out; doses of samples outside ``who`` and null doses do not count; groups of fewer than 4
samples have no result. Equal doses of two features are two features. Rows must be distinct in (group, feature, sample).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spangraph.functions import tails
from spangraph.operators import assoc as A
from spangraph.session import written

LEAST_SAMPLES = 4


def in_blocks(doses: DataFrame, who: DataFrame, group: str, run: Callable, schema: str, cells: int = 4_000_000, chunk: int = 512) -> DataFrame:
    """``run(group, axis, chunks)`` for every block of features of every group.

    ``axis`` is the group's rows of ``who`` in order of sample; ``chunks`` gives (features, matrix) of up to ``chunk`` features each,
    in order of feature, so that only that many rows are dense at a time.
    """
    known = who.where("y is not null").select(*[F.col(c).alias(c) for c in who.columns])  # columns of its own, as it may stem from the doses
    cols = A.dose_columns(doses.where("dose is not null"), group)
    sized = cols.groupBy(group).agg(F.ceil(F.sum(F.size("samples")) / cells).alias("__n"))
    left = cols.join(sized, group).withColumn("__block", F.pmod(F.xxhash64("feature"), F.col("__n"))).drop("__n")
    right = known.join(sized, group).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    names = [c.split()[0] for c in schema.split(", ")]

    def both(key: tuple, held: pd.DataFrame, axis: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or len(axis) < LEAST_SAMPLES:
            return pd.DataFrame([], columns=names)
        axis, held = axis.sort_values("sample", ignore_index=True), held.sort_values("feature", ignore_index=True)
        samples = axis["sample"].to_numpy()

        def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(held), chunk):
                part = held.iloc[i : i + chunk]
                yield part["feature"].to_numpy(), A.dense(samples, part)

        return pd.DataFrame(run(key[0], axis, chunks()), columns=names)

    # a named number of partitions, since adaptive coalescing goes by bytes and would put small but costly blocks into one task
    width = int(doses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(width, group, "__block") for side in (left, right))
    return left.groupBy(group, "__block").cogroup(right.groupBy(group, "__block")).applyInPandas(both, schema)


def _varying(m: np.ndarray) -> np.ndarray:
    return m[m.std(axis=1) > 0]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows centred and of length 1, so that their products are correlations."""
    z = m - m.mean(axis=1, keepdims=True)
    return z / np.sqrt((z**2).sum(axis=1, keepdims=True))


def rarity(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, weight) of each row: the lesser of carriers and others, and its Beta(1, 25) density."""
    held = (m > 0).mean(axis=1)
    share = np.minimum(held, 1 - held).clip(min=0)
    return share, 25 * (1 - share) ** 24


def rare_rows(m: np.ndarray) -> np.ndarray:
    """Rows centred and weighted by rarity."""
    return rarity(m)[1][:, None] * (m - m.mean(axis=1, keepdims=True))


def products(doses: DataFrame, who: DataFrame, group: str, rows: Callable[[np.ndarray], np.ndarray], **sizes: int) -> DataFrame:
    """(group, sample, gram, summed, n_features, n_varying, top, weight): products of samples over the prepared rows of all varying features.

    ``gram`` holds the products of the sample with those up to itself in order of sample, ``summed`` the sum of its entries. The
    other four belong to the group and stand on its first sample, 0 elsewhere: the features, those that vary, and
    numerator and weights of the Cauchy combination of the single features' score tests.
    """
    kind = dict(doses.dtypes)[group]

    def run(name, axis, chunks):
        y = axis["y"].to_numpy(float)
        residual, n = y - y.mean(), len(axis)
        gram, summed, counts = np.zeros((n, n)), np.zeros(n), np.zeros(4)
        for _, m in chunks:
            live = _varying(m)
            counts[:2] += len(m), len(live)
            if not len(live):
                continue
            z = rows(live)
            gram += z.T @ z
            summed += z.sum(axis=0)
            if residual.any():
                share, weight = rarity(live)
                score = unit_rows(live) @ residual / residual.std(ddof=1)
                much = weight**2 * np.maximum(share * (1 - share), 1e-12)
                counts[2] += float(much @ [tails.cauchy_quantile(tails.normal_two_sided(v)) for v in score])
                counts[3] += float(much.sum())
        return [(name, s, gram[i, : i + 1], summed[i], *(counts if i == 0 else np.zeros(4))) for i, s in enumerate(axis["sample"])]

    figures = ("summed", "n_features", "n_varying", "top", "weight")
    parts = in_blocks(doses, who, group, run, f"{group} {kind}, sample string, gram array<double>, " + ", ".join(f"{f} double" for f in figures), **sizes)
    parts = written(parts, "products")  # read twice below
    cells = parts.select(group, "sample", F.posexplode("gram").alias("at", "v")).groupBy(group, "sample", "at").agg(F.sum("v").alias("v"))
    grams = cells.groupBy(group, "sample").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).getField("v").alias("gram"))
    return grams.join(parts.groupBy(group, "sample").agg(*[F.sum(f).alias(f) for f in figures]), [group, "sample"])


def per_group(summed: DataFrame, who: DataFrame, group: str, run: Callable, schema: str) -> DataFrame:
    """``run(group, axis, gram, facts)`` per group: ``axis`` its samples in order with the columns of ``products`` and ``who``, ``facts`` its sums."""
    joined = summed.join(who.where("y is not null"), [group, "sample"])
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple, axis: pd.DataFrame) -> pd.DataFrame:
        axis = axis.sort_values("sample", ignore_index=True)
        gram = np.zeros((len(axis), len(axis)))
        for i, row in enumerate(axis["gram"]):
            gram[i, : i + 1] = row
            gram[: i + 1, i] = row
        facts = axis[["n_features", "n_varying", "top", "weight"]].sum()
        return pd.DataFrame(run(key[0], axis, gram, facts), columns=names)

    return joined.groupBy(group).applyInPandas(one, schema)


def effective(doses: DataFrame, who: DataFrame, group: str, **sizes: int) -> DataFrame:
    """(group, n_features, meff): the number of independent tests among the features of each group."""

    def run(name, axis, gram, facts):
        return [(name, int(facts["n_features"]), A.effective_of(np.linalg.eigvalsh(gram), int(facts["n_varying"])))]

    return per_group(products(doses, who, group, unit_rows, **sizes), who, group, run, f"{group} {dict(doses.dtypes)[group]}, n_features long, meff double")


def kernel(doses: DataFrame, who: DataFrame, group: str, **sizes: int) -> DataFrame:
    """(group, n_features, q, p_burden, p_kernel, p_optimal, p_cauchy) of each group with a feature and a y that vary; features counted are those."""

    def run(name, axis, gram, facts):
        y = axis["y"].to_numpy(float)
        if not facts["n_varying"] or y.std() == 0:
            return []
        residual = y - y.mean()
        values, vectors = np.linalg.eigh(gram)
        q = float(residual @ gram @ residual / residual.var(ddof=1))
        three = A.kernel_tests_of(values, vectors, axis["summed"].to_numpy(float), int(facts["n_varying"]), residual)
        single = tails.cauchy_tail(facts["top"] / facts["weight"])
        return [(name, int(facts["n_varying"]), q, *three, tails.cauchy([three[0], three[1], single]))]

    schema = f"{group} {dict(doses.dtypes)[group]}, n_features long, q double, p_burden double, p_kernel double, p_optimal double, p_cauchy double"
    return per_group(products(doses, who, group, rare_rows, **sizes), who, group, run, schema)


def mixed_model(doses: DataFrame, who: DataFrame, group: str, **sizes: int) -> DataFrame:
    """(group, feature, beta, se, p) of every varying feature beside the kinship of the group's own doses; the variance ratio is fitted with each feature."""
    kind = dict(doses.dtypes)

    def decompose(name, axis, gram, facts):
        if not facts["n_varying"]:
            return []
        values, vectors = np.linalg.eigh(gram * len(axis) / facts["n_varying"])
        return [(name, s, float(y), max(float(v), 0.0), row) for s, y, v, row in zip(axis["sample"], axis["y"], values, vectors)]

    spectrum = per_group(products(doses, who, group, unit_rows, **sizes), who, group, decompose, f"{group} {kind[group]}, sample string, y double, value double, vector array<double>")

    def run(name, axis, chunks):
        y, values, vectors = axis["y"].to_numpy(float), axis["value"].to_numpy(float), np.stack(axis["vector"])
        x = np.ones((len(y), 1))
        return [(name, f, *A.mixed_test(row, y, x, None, values, vectors)) for features, m in chunks for f, row in zip(features, m) if row.std() > 0]

    return in_blocks(doses, written(spectrum, "spectrum"), group, run, f"{group} {kind[group]}, feature {kind['feature']}, beta double, se double, p double", **sizes)


def conditional(doses: DataFrame, who: DataFrame, group: str, level: float = 0.05, **sizes: int) -> DataFrame:
    """(group, feature, step, beta, p): forward selection with backward drop, all groups at once, one round of jobs per entry.

    The strongest feature beside those chosen enters while its p is below ``level`` over the group's features (ties within 1e-9 of |t|
    go to the least name). After an entry the weakest chosen feature that is no longer below that p beside the others is
    dropped for good, one by one. Steps number the features kept, in order of entry; beta and p are those at entry.
    """
    kind = dict(doses.dtypes)
    doses, who = written(doses.where("dose <> 0"), "doses"), written(who.where("y is not null").select(group, "sample", "y"), "samples")
    bars = doses.select(group, "feature").distinct().groupBy(group).agg((F.lit(level) / F.count(F.lit(1))).alias("bar"))
    bars = written(bars, "bars")
    key = f"{group} {kind[group]}, feature {kind['feature']}"
    chosen = doses.sparkSession.createDataFrame([], f"{key}, entry long, beta double, p double")
    entered, entry = chosen.select(group, "feature"), 0
    active = bars.select(group)

    def strongest(name, axis, chunks):
        y, best = axis["y"].to_numpy(float), None
        base = np.column_stack([np.ones((len(y), 1)), np.stack(axis["held"])])
        for features, m in chunks:
            t, beta, df = A.partial_t(m, y, base)
            t = np.round(np.abs(t), 9)
            if df < 1 or np.isnan(t).all():
                continue
            k = int(np.nanargmax(t))
            if best is None or t[k] > best[2]:
                best = (name, features[k], float(t[k]), float(beta[k]), tails.t_two_sided(float(t[k]), df))
        return [] if best is None else [best]

    def still(key: tuple, cols: pd.DataFrame, axis: pd.DataFrame) -> pd.DataFrame:
        axis, cols = axis.sort_values("sample"), cols.sort_values("entry", ignore_index=True)
        y, kept = axis["y"].to_numpy(float), list(range(len(cols)))
        m = A.dense(axis["sample"].to_numpy(), cols)
        while len(kept) > 1:
            ps = []
            for k in kept:
                t, _, df = A.partial_t(m[k : k + 1], y, np.column_stack([np.ones(len(y)), *(m[o] for o in kept if o != k)]))
                ps.append(1.0 if df < 1 or np.isnan(t[0]) else tails.t_two_sided(float(abs(t[0])), df))
            if max(ps) < cols["bar"][0]:
                break
            del kept[int(np.argmax(ps))]
        return pd.DataFrame({group: key[0], "feature": cols["feature"][kept]})

    while True:
        now = doses.join(active, group, "left_semi")
        mine = now.join(chosen.select(group, "feature", "entry"), [group, "feature"])
        places = chosen.groupBy(group).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        had = mine.groupBy(group, "sample").agg(F.map_from_entries(F.collect_list(F.struct("entry", F.col("dose").cast("double")))).alias("had"))
        axis = who.join(active, group, "left_semi").join(places, group, "left").join(had, [group, "sample"], "left")
        held = F.transform(F.coalesce("entries", F.array().cast("array<bigint>")), lambda e: F.coalesce(F.try_element_at("had", e), F.lit(0.0)))
        free = now.join(entered, [group, "feature"], "left_anti")
        tops = in_blocks(free, axis.select(group, "sample", "y", held.alias("held")), group, strongest, f"{key}, t double, beta double, p double", **sizes)
        top = tops.groupBy(group).agg(F.min_by(F.struct("feature", "beta", "p"), F.struct((-F.col("t")).alias("t"), "feature")).alias("b"))
        new = written(top.join(bars, group).where("b.p < bar").select(group, "b.feature", F.lit(entry).cast("long").alias("entry"), "b.beta", "b.p"), "entered")
        if new.isEmpty():
            break
        entered, active, entry = entered.unionByName(new.select(group, "feature")), new.select(group), entry + 1
        both = chosen.unionByName(new)
        changed = both.join(active, group, "left_semi")
        cols = A.dose_columns(doses.join(changed.select(group, "feature"), [group, "feature"], "left_semi"), group).join(changed.select(group, "feature", "entry"), [group, "feature"]).join(bars, group)
        kept = cols.groupBy(group).cogroup(who.join(active, group, "left_semi").groupBy(group)).applyInPandas(still, key)
        chosen = written(both.join(active, group, "left_anti").unionByName(changed.join(kept, [group, "feature"], "left_semi")), "chosen")
    ranked = chosen.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("entry", "feature", "beta", "p"))).alias("c")).select(group, F.posexplode("c").alias("at", "c"))
    return ranked.select(group, "c.feature", (F.col("at") + 1).cast("long").alias("step"), "c.beta", "c.p")
