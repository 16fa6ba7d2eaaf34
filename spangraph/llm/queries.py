"""Registered queries of the llm operators: ``QUERIES`` (name to Spark) and ``ORACLES`` (name to SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.llm.form import form_classes, forms, look_alike_pairs
from spangraph.llm.leakage import leaked_items
from spangraph.llm.spans import Kind, shared_spans_of_kinds
from spangraph.llm.terms import mark_terms, term_counts
from spangraph.llm.tokenize import encode_corpus
from spangraph.operators.walks import walk_text
from spangraph.plans.heavy_keys import COUNTED, counted_hits
from spangraph.tables import load

RARE_TOTAL, COMMON_SHARE, COMMON_IN_PATH = 3, 5, 60
SPANS = {"sequence": Kind(50, 24), "steps": Kind(16, 8, by_step=True)}


def kmer_terms(spark: SparkSession, folder: str) -> DataFrame:
    hits = counted_hits(spark, folder, "kmer", "path_name", "hit_count")
    counts = term_counts(hits, "kmer", "path_name", "hit_count")
    n_paths = load(spark, folder, "graph_paths").agg(F.count_distinct("path_name"))
    common = (F.col("records") * COMMON_SHARE > n_paths.scalar()) | (F.col("most_in_record") >= COMMON_IN_PATH)
    return mark_terms(counts, F.col("occurrences") <= RARE_TOTAL, common).select(
        F.col("term").alias("kmer"), F.col("occurrences").alias("total_count"), F.col("records").alias("present_paths"),
        F.col("most_in_record").alias("max_count"), "mark",
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return kmer_terms(spark, folder).where("mark is not null").select("kmer", "mark")


def _one_row(df: DataFrame, key: str, units: str) -> DataFrame:
    """One row per key: repeated rows have the same content, of others the least is read."""
    return df.where(f"{key} is not null and {units} is not null and {units} <> '*'").groupBy(key).agg(F.min(units).alias("units"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _one_row(load(spark, folder, "graph_nodes"), "node_id", "sequence")
    walks = load(spark, folder, "graph_paths").select("path_name", walk_text(F.col("steps")).alias("steps"))
    paths = _one_row(walks, "path_name", "steps")
    a = nodes.select(F.lit("sequence").alias("field_name"), F.col("node_id").alias("record_key"), "units")
    b = paths.select(F.lit("steps").alias("field_name"), F.col("path_name").alias("record_key"), "units")
    return shared_spans_of_kinds(a.unionByName(b), ["field_name", "record_key"], "units", "field_name", SPANS)


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each record lies in spans that other records hold too."""
    spans = p4_found(spark, folder)
    return spans.groupBy("field_name", "record_key").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_units")
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(load(spark, folder, "documents"))


def p7_tiles(spark: SparkSession, folder: str) -> DataFrame:
    found = leaked_items(load(spark, folder, "documents"), load(spark, folder, "eval_items"))
    return found.withColumn("leaked", F.col("coverage") >= 0.5).withColumn("coverage", F.round("coverage", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of 8 words are tiled; a pair is found where its longest tile has 12 words or more."""
    found = leaked_items(load(spark, folder, "documents"), load(spark, folder, "eval_items"), min_words=12, seed_words=8)
    return found.select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_pairs(load(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return form_classes(load(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return forms(load(spark, folder, "documents"))


_TERMS = f"""WITH {COUNTED},
per_path AS (SELECT kmer, path_name, sum(hit_count) AS n FROM counted GROUP BY kmer, path_name),
terms AS (SELECT kmer, sum(n)::BIGINT AS total_count, count(*) AS present_paths, max(n)::BIGINT AS max_count FROM per_path GROUP BY kmer),
marked AS (SELECT *, CASE WHEN total_count <= 3 THEN 'rare'
  WHEN present_paths * 5 > (SELECT count(DISTINCT path_name) FROM graph_paths) OR max_count >= 60 THEN 'common' END AS mark FROM terms)
"""

_SPANS = """
WITH recs AS (
  SELECT 'sequence' AS field_name, node_id AS record_key, string_split(min(sequence), '') AS u, 50 AS l
  FROM graph_nodes WHERE sequence IS NOT NULL AND sequence <> '*' GROUP BY node_id
  UNION ALL
  SELECT 'steps', path_name, CASE WHEN contains(min(steps), ',') OR min(steps) NOT SIMILAR TO '[<>].*'
    THEN list_transform(string_split(min(steps), ','), lambda x: CASE WHEN x LIKE '%+' THEN '>' ELSE '<' END || x[:-2])
    ELSE regexp_extract_all(min(steps), '[<>][^<>]+') END, 16
  FROM graph_paths WHERE steps IS NOT NULL AND steps <> '*' GROUP BY path_name),
grams AS (
  SELECT field_name, record_key, l, i - 1 AS s, array_to_string(u[i:i + l - 1], '') AS g
  FROM (SELECT *, unnest(generate_series(1, len(u) - l + 1)) AS i FROM recs)),
twice AS (SELECT field_name, g FROM grams GROUP BY ALL HAVING count(DISTINCT record_key) > 1),
hit AS (SELECT field_name, record_key, l, s FROM grams JOIN twice USING (field_name, g)),
runs AS (
  SELECT *, sum(CASE WHEN p IS NULL OR s > p + l THEN 1 ELSE 0 END) OVER (PARTITION BY field_name, record_key ORDER BY s) AS r
  FROM (SELECT *, lag(s) OVER (PARTITION BY field_name, record_key ORDER BY s) AS p FROM hit)),
spans AS (SELECT field_name, record_key, min(s)::BIGINT AS span_start, (max(s) + any_value(l))::BIGINT AS span_end FROM runs GROUP BY field_name, record_key, r)
"""

ORACLES = {
    "p3_found": _TERMS + "SELECT kmer, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT * FROM marked",
    "p4_found": _SPANS + "SELECT * FROM spans",
    "p4_shares": _SPANS
    + "SELECT field_name, record_key, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_units FROM spans GROUP BY ALL",
}
QUERIES = {
    "p3_found": p3_found,
    "p3_terms": kmer_terms,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_tiles": p7_tiles,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
}
