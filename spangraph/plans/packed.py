"""Queries of the packed fields (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.operators.packed import delimiter_scores, unpack
from spangraph.tables import load

FIELDS = (("haplotypes", "carrier_events"), ("inside_nodes", "bubble_sites"), ("anchor_nodes", "unit_graphs"), ("nodes", "unit_graphs"))
NAMES = ("haplotypes",)


def packed_fields(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        load(spark, folder, table).select(F.lit(field).alias("field_name"), "row_no", F.col(field).alias("packed"))
        for field, table in FIELDS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack(packed_fields(spark, folder), "field_name", ["row_no"], "packed", protected=NAMES)


def p1_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    scores = delimiter_scores(packed_fields(spark, folder), "field_name", "packed", protected=NAMES)
    return scores.select(
        F.col("source").alias("field_name"), "delimiter", "n_rows",
        F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"), "accepted",
    )


_ALL = " UNION ALL ".join(f"SELECT '{f}' AS field_name, row_no, {f} AS packed FROM {t}" for f, t in FIELDS)

ORACLES = {
    "p1_found": f"""
WITH f AS ({_ALL}),
t AS (
  SELECT field_name, row_no, CASE WHEN field_name = 'haplotypes'
    THEN regexp_extract_all(packed, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^"''; ,|\\t]+')
    ELSE string_split_regex(packed, '["'';,|/\\t ]') END AS toks
  FROM f WHERE packed IS NOT NULL),
v AS (
  SELECT field_name, row_no, list_filter(list_transform(toks, lambda x: CASE
      WHEN field_name = 'haplotypes' AND x LIKE '"%' THEN trim(replace(x[2:-2], '""', '"'))
      WHEN field_name = 'haplotypes' AND x LIKE '''%' THEN trim(replace(x[2:-2], '''''', ''''))
      ELSE trim(x, '[]{{}}() ' || chr(9) || chr(10) || chr(13)) END),
    lambda x: x NOT IN ('', '.', 'NA')) AS vals FROM t)
SELECT field_name, row_no, i::INT AS pos, vals[i] AS val
FROM (SELECT field_name, row_no, vals, unnest(generate_series(1, len(vals))) AS i FROM v)
""",
}
QUERIES = {"p1_found": p1_found, "p1_delimiters": p1_delimiters}
