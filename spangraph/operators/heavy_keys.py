"""Per-key results when a few keys hold most records.

Every aggregate here is algebraic, so Spark's own two-step aggregation does the work: each input
partition keeps a bounded hash table of mergeable key states (spilling to sorted runs when full), and
only one compact row per key and partition is shuffled. A key that holds a third of all rows costs the
reducer as many rows as there are input partitions, no more, so neither salting nor a split is needed.

Defined results: rows whose key is null form no group; a null measure counts as 0; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.session import written


def first_arrivals(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per ``key``, the one that arrived first (null times last, then ties by row content).

    The key is near-unique, so the shuffle on it is even.
    """
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in (key, arrived)]
    order = W.partitionBy(key).orderBy(F.col(arrived).asc_nulls_last(), *rest)
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def key_totals(df: DataFrame, key: str, measure: str, distinct_of: str | None = None) -> DataFrame:
    """(key, total[, n_distinct]) per non-null key.

    The distinct count is kept algebraic as well: partial sums per (key, value) first, then one row per
    value is counted, so a heavy key's values are spread over all reducers.
    """
    rows = df.where(F.col(key).isNotNull())
    total = F.sum(F.coalesce(F.col(measure), F.lit(0)).cast("long"))
    if distinct_of is None:
        return rows.groupBy(key).agg(total.alias("total"))
    pairs = rows.groupBy(key, distinct_of).agg(total.alias("__part"))
    return pairs.groupBy(key).agg(F.sum("__part").alias("total"), F.count(F.col(distinct_of)).alias("n_distinct"))


def mark_heavy(totals: DataFrame, one_in: int, whole: DataFrame | None = None) -> DataFrame:
    """Adds ``heavy``: the key's total is at least 1/``one_in`` of the sum of all totals.

    ``whole`` is a one-row, one-column frame with the sum to compare with, if not that of ``totals``.
    """
    whole = whole if whole is not None else totals.agg(F.sum("total"))
    return totals.withColumn("heavy", F.coalesce(F.col("total") * F.lit(one_in) >= whole.scalar(), F.lit(False)))


def totals_of_keys(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """(key_field, key_value, total) of several key columns from one pass over the rows (grouping sets); null keys are left out."""
    total = F.sum(F.coalesce(F.col(measure), F.lit(0)).cast("long")).alias("total")
    sets = df.groupingSets([[k] for k in keys], *keys).agg(total, *[F.grouping(k).alias(f"__g_{k}") for k in keys])
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        field = F.when(F.col(f"__g_{k}") == 0, F.lit(k)).otherwise(field)
        value = F.when(F.col(f"__g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return sets.select(field.alias("key_field"), value.alias("key_value"), "total").where("key_value is not null")


def heavy_of_keys(df: DataFrame, one_in: Mapping[str, int], measure: str) -> DataFrame:
    """(key_field, key_value): the keys that hold at least 1/``one_in[key]`` of the measure of all rows that have the key."""
    totals = written(totals_of_keys(df, list(one_in), measure), "totals")  # one row per key, read again for the sums
    heavy = F.lit(False)
    for key, share in one_in.items():
        whole = totals.where(F.col("key_field") == key).agg(F.sum("total")).scalar()
        heavy = heavy | ((F.col("key_field") == key) & (F.col("total") * F.lit(share) >= whole))
    return totals.where(F.coalesce(heavy, F.lit(False))).select("key_field", "key_value")


def heavy_keys(df: DataFrame, key: str, measure: str, one_in: int) -> DataFrame:
    """(key_field, key_value): the heavy keys of one key column."""
    return heavy_of_keys(df, {key: one_in}, measure)
