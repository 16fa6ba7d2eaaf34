"""Queries over intervals: reference records, walks, variants and k-mer positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.operators import intervals as I
from spangraph.plans.bad_rows import _CHECKED, p5_good
from spangraph.tables import load


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_id, contig, lo, hi): the good reference records as half-open intervals."""
    start = F.col("region_start_1based") - 1
    size = F.expr("try_cast(path_length_bp as bigint)")
    return p5_good(spark, folder).select("raw_id", F.col("chrom").alias("contig"), start.alias("lo"), F.try_add(start, size).alias("hi"))


def _walks(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "graph_paths").where("walk_start is not null and walk_end is not null")
    return rows.select("path_name", "contig", F.col("walk_start").alias("w_lo"), F.col("walk_end").alias("w_hi")).distinct()


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "kmer_hits").where("path_name is not null and hit_pos is not null").select("path_name", "hit_pos").distinct()


def interval_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    out = I.overlap_join(_records(spark, folder), _walks(spark, folder), "contig", ("lo", "hi"), ("w_lo", "w_hi"), 100_000)
    return out.select("raw_id", "path_name", (F.least("hi", "w_hi") - F.greatest("lo", "w_lo")).alias("bp"))


def interval_merged(spark: SparkSession, folder: str) -> DataFrame:
    return I.merge(_records(spark, folder), ["contig"], "lo", "hi", gap=1000)


def interval_left(spark: SparkSession, folder: str) -> DataFrame:
    return I.subtract(_walks(spark, folder), _records(spark, folder), "contig", "w_lo", "w_hi", "lo", "hi")


def dense_positions(spark: SparkSession, folder: str) -> DataFrame:
    return I.dense(_positions(spark, folder), ["path_name"], "hit_pos", 200, 20)


def hit_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of at least 20 hits at most 150 apart on one path, padded by 50."""
    rows = _positions(spark, folder).withColumn("end", F.col("hit_pos"))
    found = I.islands(rows, ["path_name"], "hit_pos", "end", 150).groupBy("path_name", "island").agg(
        F.min("hit_pos").alias("a"), F.max("hit_pos").alias("b"), F.count(F.lit(1)).alias("n_hits")
    )
    return found.where("n_hits >= 20").select("path_name", F.greatest(F.col("a") - 50, F.lit(0)).alias("lo"), (F.col("b") + 50).alias("hi"), "n_hits")


def repeat_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one site, not copy-number ones and at most 1 kb long, that overlap or lie at most 10 bp apart: two or more make a repeat site."""
    rows = load(spark, folder, "carrier_events").where("kind <> 'cn' and ref_start is not null and ref_end is not null and bubble_id is not null")
    rows = rows.withColumn("hi", F.greatest("ref_end", "ref_start")).where("hi - ref_start <= 1000")
    one = rows.groupBy("bubble_id", "variant_id").agg(F.min("ref_start").alias("lo"), F.max("hi").alias("hi"))
    linked = I.islands(one, ["bubble_id"], "lo", "hi", 10, tie=["variant_id"])
    return linked.groupBy("bubble_id", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n_records"), F.min("variant_id").alias("first_variant")
    ).where("n_records > 1").drop("island")


_REC = _CHECKED + """, rec AS (SELECT raw_id, f[2] AS contig, f[3]::BIGINT - 1 AS lo, f[3]::BIGINT - 1 + try_cast(f[4] AS BIGINT) AS hi FROM c WHERE reason IS NULL),
wk AS (SELECT DISTINCT path_name, contig, walk_start AS w_lo, walk_end AS w_hi FROM graph_paths WHERE walk_start IS NOT NULL AND walk_end IS NOT NULL)"""


def _merge(table: str, key: str, lo: str, hi: str, gap: int) -> str:
    return f"""SELECT {key}, min({lo}) AS lo, max({hi}) AS hi, count(*) AS n FROM (
  SELECT *, sum(coalesce(({lo} > prev + {gap})::INT, 0)) OVER (PARTITION BY {key} ORDER BY {lo}, {hi} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, max({hi}) OVER (PARTITION BY {key} ORDER BY {lo}, {hi} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM {table} WHERE {hi} > {lo})) GROUP BY {key}, g"""


_POS = "pos AS (SELECT DISTINCT path_name, hit_pos FROM kmer_hits WHERE path_name IS NOT NULL AND hit_pos IS NOT NULL)"
ORACLES = {
    "interval_overlaps": _REC + " SELECT raw_id, path_name, least(hi, w_hi) - greatest(lo, w_lo) AS bp FROM rec JOIN wk ON rec.contig = wk.contig AND lo < w_hi AND w_lo < hi AND hi > lo AND w_hi > w_lo",
    "interval_merged": _REC + " " + _merge("rec", "contig", "lo", "hi", 1000),
    "interval_left": _REC
    + f""", wa AS ({_merge('wk', 'contig', 'w_lo', 'w_hi', 0)}), rb AS ({_merge('rec', 'contig', 'lo', 'hi', 0)}),
cutp AS (SELECT contig, p FROM (SELECT contig, lo AS p FROM wa UNION SELECT contig, hi FROM wa UNION SELECT contig, lo FROM rb UNION SELECT contig, hi FROM rb)),
seg AS (SELECT contig, p AS lo, lead(p) OVER (PARTITION BY contig ORDER BY p) AS hi FROM cutp),
keep AS (SELECT s.* FROM seg s WHERE hi IS NOT NULL AND EXISTS (SELECT 1 FROM wa WHERE wa.contig = s.contig AND wa.lo <= s.lo AND wa.hi >= s.hi)
  AND NOT EXISTS (SELECT 1 FROM rb WHERE rb.contig = s.contig AND rb.lo <= s.lo AND rb.hi >= s.hi))
SELECT contig, lo, hi FROM ({_merge('keep', 'contig', 'lo', 'hi', 0)})""",
    "dense_positions": f"""WITH {_POS} SELECT * FROM (SELECT path_name, hit_pos, count(*) OVER (PARTITION BY path_name ORDER BY hit_pos RANGE BETWEEN CURRENT ROW AND 199 FOLLOWING) AS n FROM pos) WHERE n >= 20""",
    "hit_clusters": f"""WITH {_POS}, g AS (SELECT *, sum(coalesce((hit_pos > p + 150)::INT, 0)) OVER (PARTITION BY path_name ORDER BY hit_pos) AS g FROM (
  SELECT *, lag(hit_pos) OVER (PARTITION BY path_name ORDER BY hit_pos) AS p FROM pos))
SELECT path_name, greatest(min(hit_pos) - 50, 0) AS lo, max(hit_pos) + 50 AS hi, count(*) AS n_hits FROM g GROUP BY path_name, g HAVING count(*) >= 20""",
    "repeat_sites": """WITH o AS (SELECT bubble_id, variant_id, min(ref_start) AS lo, max(greatest(ref_end, ref_start)) AS hi FROM carrier_events
  WHERE kind <> 'cn' AND ref_start IS NOT NULL AND ref_end IS NOT NULL AND bubble_id IS NOT NULL AND greatest(ref_end, ref_start) - ref_start <= 1000 GROUP BY ALL),
g AS (SELECT *, sum(coalesce((lo > p + 10)::INT, 0)) OVER (PARTITION BY bubble_id ORDER BY lo, hi, variant_id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(hi) OVER (PARTITION BY bubble_id ORDER BY lo, hi, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o))
SELECT bubble_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n_records, min(variant_id) AS first_variant FROM g GROUP BY bubble_id, g HAVING count(*) > 1""",
}
QUERIES = {f.__name__: f for f in (interval_overlaps, interval_merged, interval_left, dense_positions, hit_clusters, repeat_sites)}
