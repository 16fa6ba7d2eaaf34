"""Queries of the skewed keys (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions.seq import canonical
from spangraph.operators.heavy_keys import first_arrivals, heavy_of_keys, key_totals, mark_heavy
from spangraph.tables import load


def counted_hits(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The hits that count, each once, with the canonical kmer and the named columns."""
    hits = load(spark, folder, "kmer_hits").select(
        "hit_id", "loaded_at", canonical(F.col("kmer")).alias("kmer"), "path_name", "segment_name", "hit_count"
    )
    valid = hits.where("path_name is not null and hit_count > 0 and kmer is not null").select("hit_id", "loaded_at", *columns)
    return first_arrivals(valid, "hit_id", "loaded_at").drop("hit_id", "loaded_at")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = counted_hits(spark, folder, "kmer", "segment_name", "hit_count")
    return heavy_of_keys(hits, {"kmer": 50, "segment_name": 20}, "hit_count")


def p2_kmers(spark: SparkSession, folder: str) -> DataFrame:
    totals = key_totals(counted_hits(spark, folder, "kmer", "hit_count"), "kmer", "hit_count")
    return mark_heavy(totals, 50).select("kmer", F.col("total").alias("total_count"), "heavy")


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    totals = key_totals(counted_hits(spark, folder, "kmer", "segment_name", "hit_count"), "segment_name", "hit_count", distinct_of="kmer")
    return mark_heavy(totals, 20).select(
        "segment_name", F.col("total").alias("occurrences"), F.col("n_distinct").alias("distinct_kmers"), "heavy"
    )


COUNTED = """
counted AS (
  SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, path_name, segment_name, hit_count FROM (
    SELECT upper(kmer) AS k, path_name, segment_name, hit_count,
      row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at) AS rn
    FROM kmer_hits
    WHERE path_name IS NOT NULL AND hit_count > 0 AND regexp_full_match(upper(kmer), '[ACGT]+'))
  WHERE rn = 1)"""

ORACLES = {
    "p2_found": f"""WITH {COUNTED}
SELECT 'kmer' AS key_field, kmer AS key_value FROM counted GROUP BY kmer
HAVING sum(hit_count) * 50 >= (SELECT sum(hit_count) FROM counted)
UNION ALL
SELECT 'segment_name', segment_name FROM counted WHERE segment_name IS NOT NULL GROUP BY segment_name
HAVING sum(hit_count) * 20 >= (SELECT sum(hit_count) FROM counted WHERE segment_name IS NOT NULL)""",
    "p2_kmers": f"""WITH {COUNTED}
SELECT kmer, sum(hit_count)::BIGINT AS total_count,
  sum(hit_count) * 50 >= (SELECT sum(hit_count) FROM counted) AS heavy FROM counted GROUP BY kmer""",
    "p2_segments": f"""WITH {COUNTED}
SELECT segment_name, sum(hit_count)::BIGINT AS occurrences, count(DISTINCT kmer) AS distinct_kmers,
  sum(hit_count) * 20 >= (SELECT sum(hit_count) FROM counted WHERE segment_name IS NOT NULL) AS heavy
FROM counted WHERE segment_name IS NOT NULL GROUP BY segment_name""",
}
QUERIES = {"p2_found": p2_found, "p2_kmers": p2_kmers, "p2_segments": p2_segments}
