"""Queries of the raw reference-path lines (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.operators.bad_rows import accepted, boolean_text, positive_long, rejected, with_errors
from spangraph.tables import load

NAMES = ("path_name", "chrom", "region_start_1based", "path_length_bp", "half_open", "length_mismatch", "path_type")
RULES = {"region_start_1based": positive_long, "half_open": boolean_text, "length_mismatch": boolean_text}


def checked_lines(spark: SparkSession, folder: str) -> DataFrame:
    return with_errors(load(spark, folder, "raw_ref_paths").select("raw_id", "line"), "line", NAMES, RULES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(checked_lines(spark, folder), ["raw_id"])


def p5_good(spark: SparkSession, folder: str) -> DataFrame:
    truth = lambda c: F.lower(c).isin("true", "1")
    return accepted(checked_lines(spark, folder)).select(
        "raw_id", "path_name", "chrom", F.col("region_start_1based").try_cast("bigint").alias("region_start_1based"), "path_length_bp",
        truth(F.col("half_open")).alias("half_open"), truth(F.col("length_mismatch")).alias("length_mismatch"), "path_type",
    )


_CHECKED = r"""
WITH a AS (
  SELECT raw_id, line, coalesce(NOT regexp_full_match(',' || line, '(?s)(,("([^"]|"")*"|[^",]*))*'), false) AS broken,
    CASE WHEN line IS NULL OR trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN []
      ELSE regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) END AS p
  FROM raw_ref_paths),
b AS (
  SELECT raw_id, broken, len(p) AS n, list_transform(p, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ')) AS f
  FROM a),
c AS (
  SELECT *, CASE WHEN broken THEN 'quoting' WHEN n <> 7 THEN 'column_count'
    WHEN NOT regexp_full_match(f[3], '[0-9]+') OR coalesce(try_cast(f[3] AS BIGINT), 0) < 1 THEN 'region_start_1based'
    WHEN lower(f[5]) NOT IN ('true', 'false', '1', '0') THEN 'half_open'
    WHEN lower(f[6]) NOT IN ('true', 'false', '1', '0') THEN 'length_mismatch' END AS reason
  FROM b)
"""
ORACLES = {
    "p5_found": _CHECKED + "SELECT raw_id, reason FROM c WHERE reason IS NOT NULL",
    "p5_good": _CHECKED
    + """SELECT raw_id, f[1] AS path_name, f[2] AS chrom, f[3]::BIGINT AS region_start_1based, f[4] AS path_length_bp,
  lower(f[5]) IN ('true', '1') AS half_open, lower(f[6]) IN ('true', '1') AS length_mismatch, f[7] AS path_type
FROM c WHERE reason IS NULL""",
}
QUERIES = {"p5_found": p5_found, "p5_good": p5_good}
