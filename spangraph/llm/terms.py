"""Frequency of every distinct term over the whole collection, with the number of records that hold it.

Last-seen counters: tokens are hash-partitioned by term and ordered by record, so one pass keeps, per
term, its occurrences, its records and the record it saw last; a record counts when it differs from the
last one seen. No set of records is ever held. A term that makes up a large part of all tokens is spread
by a hash of its *record* over ``buckets`` partitions; buckets hold disjoint records, so their counters
merge by plain sums and maxima.

Defined results: tokens with a null term or record are not counted; a null weight counts as 0; repeated
tokens add up; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def term_counts(tokens: DataFrame, term: str, record: str, weight: str | None = None, buckets: int = 64) -> DataFrame:
    """(term, occurrences, records, most_in_record) per term."""
    n = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    rows = tokens.where(F.col(term).isNotNull() & F.col(record).isNotNull()).select(
        F.col(term).alias("term"),
        F.col(record).alias("__record"),
        n.cast("long").alias("__n"),
        F.pmod(F.xxhash64(F.col(record)), F.lit(buckets)).alias("__bucket"),
    )
    by_record = W.partitionBy("term", "__bucket").orderBy("__record")
    one_record = W.partitionBy("term", "__bucket", "__record")
    seen = rows.withColumn("__last", F.lag("__record").over(by_record)).withColumn("__in_record", F.sum("__n").over(one_record))
    return seen.groupBy("term").agg(
        F.sum("__n").alias("occurrences"),
        F.count_if(F.col("__last").isNull() | (F.col("__last") != F.col("__record"))).alias("records"),
        F.max("__in_record").alias("most_in_record"),
    )


def mark_terms(counts: DataFrame, rare: Column, common: Column) -> DataFrame:
    """Adds ``mark``: ``rare``, else ``common``, else null."""
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common"))
