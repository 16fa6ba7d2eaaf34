"""Queries over variant records and their carriers: frequencies, copy numbers, merging, deduplication, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.operators.alleles import align_any, align_tokens, allele_differences, allele_weights, clustered_alleles  # noqa: F401
from spangraph.operators.cluster import connected_components
from spangraph.operators.intervals import overlap_join
from spangraph.operators.packed import unpack
from spangraph.plans.packed import ORACLES as PACKED
from spangraph.plans.packed import packed_fields
from spangraph.plans.walks import SITES, STEPS, nodes, read_crossings, steps
from spangraph.tables import load


def _first(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per variant, the one with the least row_no."""
    return _first(load(spark, folder, "carrier_events"), "variant_id", "row_no")


def carriers(spark: SparkSession, folder: str) -> DataFrame:
    """(variant_id, haplotype): the distinct carriers of each variant."""
    names = unpack(packed_fields(spark, folder).where("field_name = 'haplotypes'"), "field_name", ["row_no"], "packed", protected=("haplotypes",))
    rows = load(spark, folder, "carrier_events").select("row_no", "variant_id")
    return names.join(rows, "row_no").where("variant_id is not null").select("variant_id", F.col("val").alias("haplotype")).distinct()


def record_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Carriers, observed haplotypes (those that cross the site) and frequency of each variant."""
    ac = carriers(spark, folder).groupBy("variant_id").agg(F.count(F.lit(1)).alias("ac"))
    an = read_crossings(spark, folder).groupBy("bubble_id").agg(F.count_distinct("path_name").alias("an"))
    out = records(spark, folder).select("variant_id", "bubble_id").join(ac, "variant_id", "left").join(an, "bubble_id", "left")
    af = F.round(F.try_divide("ac", "an"), 6)
    return out.select("variant_id", F.coalesce("ac", F.lit(0)).alias("ac"), F.coalesce("an", F.lit(0)).alias("an"), af.alias("af"))


def record_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return record_frequencies(spark, folder).where("ac >= 2 and af >= 0.01").select("variant_id")


def carrier_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Carriers collapsed to samples: which haplotype slots carry the variant, in slot order."""
    c = carriers(spark, folder).withColumn("sample", F.split_part("haplotype", F.lit("#"), F.lit(1))).withColumn("slot", F.split_part("haplotype", F.lit("#"), F.lit(2)))
    slots = c.select("variant_id", "sample", "slot").distinct()
    return slots.groupBy("variant_id", "sample").agg(F.array_join(F.sort_array(F.collect_list("slot")), "|").alias("slots"), F.count(F.lit(1)).alias("dose"))


def copy_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each repeat unit in each path: visits to its anchor nodes over their number; bp and residual against the graph's reference path."""
    units = _first(load(spark, folder, "unit_graphs"), "input_bubble_id", "row_no").select("row_no", "input_bubble_id", "unit_bp")
    anchors = unpack(packed_fields(spark, folder).where("field_name = 'anchor_nodes'"), "field_name", ["row_no"], "packed").select("row_no", F.col("val").alias("node_id")).distinct()
    at = units.join(anchors, "row_no").withColumn("n_anchors", F.count(F.lit(1)).over(W.partitionBy("row_no")))
    hit = steps(spark, folder, "graph_name").join(at, "node_id").join(nodes(spark, folder).select("node_id", "bp"), "node_id", "left")
    per = hit.groupBy("graph_name", "input_bubble_id", "path_name").agg(
        (F.count(F.lit(1)) / F.max("n_anchors")).alias("cn"), F.sum(F.coalesce("bp", F.lit(0))).alias("bp"), F.max("unit_bp").alias("unit_bp")
    )
    ref = W.partitionBy("graph_name", "input_bubble_id").orderBy("path_name")
    out = per.withColumn("ref_cn", F.first("cn").over(ref)).withColumn("cnbp", F.col("bp") - F.first("bp").over(ref))
    resid = F.col("cnbp") - (F.col("cn") - F.col("ref_cn")) * F.col("unit_bp")
    return out.select("input_bubble_id", "path_name", F.round("cn", 6).alias("cn"), F.round("ref_cn", 6).alias("ref_cn"), "cnbp", F.round(resid, 4).alias("cnresid"))


def cn_carriers(spark: SparkSession, folder: str) -> DataFrame:
    """Paths whose copies differ from the reference by at least 50 bp."""
    return copy_numbers(spark, folder).where("cn <> ref_cn and abs(cnbp) >= 50").select("input_bubble_id", "path_name", "cnbp")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    net = F.coalesce("alt_bp", F.lit(0)) - F.coalesce(F.col("ref_end") - F.col("ref_start"), F.lit(0))
    return records(spark, folder).where("ref_start is not null and bubble_id is not null and kind is not null").select(
        "variant_id", "bubble_id", "kind", F.col("ref_start").alias("pos"), F.coalesce("event_bp", F.lit(0)).alias("size"), net.alias("net")
    )


def event_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that may be one event: same type, positions within 100 bp plus the lesser size, net lengths within 50 bp.

    A banded self-join: each record reaches 50 bp plus its size to either side, and records whose reaches
    overlap are compared exactly.
    """
    e = _events(spark, folder).withColumn("lo", F.col("pos") - 50 - F.col("size")).withColumn("hi", F.col("pos") + 51 + F.col("size"))
    side = lambda x: e.select("kind", *[F.col(c).alias(f"{x}_{c}") for c in ("variant_id", "pos", "size", "net", "lo", "hi")])
    pairs = overlap_join(side("a"), side("b"), "kind", ("a_lo", "a_hi"), ("b_lo", "b_hi"), 2000).where("a_variant_id < b_variant_id")
    return pairs.where("abs(a_pos - b_pos) <= 100 + least(a_size, b_size) and abs(a_net - b_net) < 50").select(F.col("a_variant_id").alias("a"), F.col("b_variant_id").alias("b"))


def event_components(spark: SparkSession, folder: str) -> DataFrame:
    """Records merged through chains of links, those without a link on their own: component and its representative (most carriers, then larger, then least name)."""
    comp = connected_components(event_links(spark, folder), "a", "b", vertices=_events(spark, folder).select("variant_id")).withColumnRenamed("id", "variant_id")
    ac = carriers(spark, folder).groupBy("variant_id").agg(F.count(F.lit(1)).alias("ac"))
    size = _events(spark, folder).select("variant_id", "size")
    rows = comp.join(ac, "variant_id", "left").join(size, "variant_id")
    best = W.partitionBy("component").orderBy(F.desc(F.coalesce("ac", F.lit(0))), F.desc("size"), "variant_id")
    return rows.select("variant_id", "component", F.first("variant_id").over(best).alias("representative"))


def record_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that repeat another one's content under a new row_no: the row kept for each."""
    t = load(spark, folder, "carrier_events")
    content = [c for c in t.columns if c not in ("row_no", "loaded_at")]
    same = W.partitionBy(*content)
    return t.select("row_no", F.min("row_no").over(same).alias("kept")).where("row_no <> kept")


def carrier_check(spark: SparkSession, folder: str) -> DataFrame:
    """Own against reported size of each record: shrunk, grown, equal or unknown."""
    span = F.col("ref_end") - F.col("ref_start")
    gap = F.abs(F.greatest(span, F.coalesce("alt_bp", F.lit(0))) - F.col("event_bp"))
    status = F.when(span.isNull() | F.col("event_bp").isNull(), "unknown").when(gap == 0, "equal").when(gap <= 10, "near").otherwise("differs")
    return load(spark, folder, "carrier_events").select("row_no", status.alias("status"))


def insertion_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of kinds with carriers: how many records, rows and base pairs, with a grand total."""
    t = load(spark, folder, "carrier_events")
    return t.rollup("kind").agg(F.count_distinct("variant_id").alias("n_variants"), F.count(F.lit(1)).alias("n_rows"), F.sum("event_bp").alias("bp"), F.grouping("kind").cast("int").alias("is_total"))


def _weights(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(bubble_id, allele, node_id, occurrence, bp), the inside nodes of each allele as a multiset, and (bubble_id, allele, size) of every allele.

    A node without a known length weighs 1. An allele with nothing between the boundaries has the size 0.
    """
    return allele_weights(read_crossings(spark, folder), nodes(spark, folder))


def allele_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted Jaccard of each allele with the most carried allele of its site; two empty alleles are equal."""
    w, size = _weights(spark, folder)
    top = w.where("allele = 1").select("bubble_id", "node_id", "occurrence", F.lit(1).alias("shared"))
    both = w.join(top, ["bubble_id", "node_id", "occurrence"]).groupBy("bubble_id", "allele").agg(F.sum("bp").alias("both"))
    first = size.where("allele = 1").select("bubble_id", F.col("size").alias("top"))
    out = size.where("allele > 1").join(first, "bubble_id").join(both, ["bubble_id", "allele"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    jaccard = F.coalesce(F.try_divide("both", F.col("size") + F.col("top") - F.col("both")), F.lit(1.0))
    return out.select("bubble_id", "allele", F.round(jaccard, 6).alias("jaccard"))


def allele_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Leader clusters of the alleles of each site: most carried first, Dice of at least 0.8 joins. An empty allele is like none of the others."""
    return clustered_alleles(read_crossings(spark, folder), nodes(spark, folder))


def allele_events(spark: SparkSession, folder: str) -> DataFrame:
    """The typed differences of each distinct allele from the most carried one of its site, sized in bp."""
    return allele_differences(read_crossings(spark, folder), nodes(spark, folder))


_VALS = PACKED["p1_found"]
REC = f"""
vals AS ({_VALS}),
records AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY row_no) AS r FROM carrier_events WHERE variant_id IS NOT NULL) WHERE r = 1),
carriers AS (SELECT DISTINCT variant_id, val AS haplotype FROM vals v JOIN carrier_events e USING (row_no) WHERE v.field_name = 'haplotypes' AND variant_id IS NOT NULL)"""
FREQ = f"""WITH {SITES}, {REC},
an AS (SELECT bubble_id, count(DISTINCT path_name) AS an FROM signed GROUP BY bubble_id),
ac AS (SELECT variant_id, count(*) AS ac FROM carriers GROUP BY variant_id),
freq AS (SELECT variant_id, coalesce(ac, 0) AS ac, coalesce(an, 0) AS an, round(ac / an, 6) AS af FROM records LEFT JOIN ac USING (variant_id) LEFT JOIN an USING (bubble_id))"""
COPIES = f"""WITH {STEPS}, vals AS ({_VALS}),
units AS (SELECT row_no, input_bubble_id, unit_bp FROM (SELECT *, row_number() OVER (PARTITION BY input_bubble_id ORDER BY row_no) AS r FROM unit_graphs WHERE input_bubble_id IS NOT NULL) WHERE r = 1),
anch AS (SELECT DISTINCT row_no, val AS node_id FROM vals WHERE field_name = 'anchor_nodes'),
att AS (SELECT u.*, node_id, count(*) OVER (PARTITION BY row_no) AS na FROM units u JOIN anch USING (row_no)),
per AS (SELECT graph_name, input_bubble_id, path_name, count(*) / max(na) AS cn, sum(coalesce(bp, 0)) AS bp, max(unit_bp) AS unit_bp
  FROM steps JOIN att USING (node_id) LEFT JOIN nodes USING (node_id) GROUP BY ALL),
cop AS (SELECT *, first_value(cn) OVER w AS ref_cn, (bp - first_value(bp) OVER w)::BIGINT AS cnbp FROM per WINDOW w AS (PARTITION BY graph_name, input_bubble_id ORDER BY path_name)),
cn AS (SELECT input_bubble_id, path_name, round(cn, 6) AS cn, round(ref_cn, 6) AS ref_cn, cnbp, round(cnbp - (cn - ref_cn) * unit_bp, 4) AS cnresid FROM cop)"""
EV = f"""WITH RECURSIVE {REC},
ev AS (SELECT variant_id, bubble_id, kind, ref_start AS pos, coalesce(event_bp, 0) AS size, coalesce(alt_bp, 0) - coalesce(ref_end - ref_start, 0) AS net
  FROM records WHERE ref_start IS NOT NULL AND bubble_id IS NOT NULL AND kind IS NOT NULL),
lk AS (SELECT a.variant_id AS a, b.variant_id AS b FROM ev a JOIN ev b ON a.kind = b.kind AND a.variant_id < b.variant_id
  AND abs(a.pos - b.pos) <= 100 + least(a.size, b.size) AND abs(a.net - b.net) < 50)"""
WEIGHTS = f"""WITH {SITES},
al AS (SELECT bubble_id, signature, any_value(inside) AS inside, row_number() OVER (PARTITION BY bubble_id ORDER BY count(DISTINCT path_name) DESC, signature) AS allele FROM signed GROUP BY bubble_id, signature),
one AS (SELECT bubble_id, allele, inside[i][2:] AS node_id, i FROM (SELECT *, unnest(generate_series(1, len(inside))) AS i FROM al)),
wt AS (SELECT o.*, greatest(coalesce(bp, 0), 1) AS bp FROM (SELECT bubble_id, allele, node_id, row_number() OVER (PARTITION BY bubble_id, allele, node_id ORDER BY i) AS occurrence FROM one) o LEFT JOIN nodes USING (node_id)),
sz AS (SELECT al.bubble_id, al.allele, coalesce(sum(bp), 0) AS size FROM al LEFT JOIN wt USING (bubble_id, allele) GROUP BY ALL)"""

ORACLES = {
    "record_frequencies": FREQ + " SELECT * FROM freq",
    "record_filtered": FREQ + " SELECT variant_id FROM freq WHERE ac >= 2 AND af >= 0.01",
    "carrier_samples": f"""WITH {REC}, s AS (SELECT DISTINCT variant_id, split_part(haplotype, '#', 1) AS sample, split_part(haplotype, '#', 2) AS slot FROM carriers)
SELECT variant_id, sample, string_agg(slot, '|' ORDER BY slot) AS slots, count(*) AS dose FROM s GROUP BY ALL""",
    "copy_numbers": COPIES + " SELECT * FROM cn",
    "cn_carriers": COPIES + " SELECT input_bubble_id, path_name, cnbp FROM cn WHERE cn <> ref_cn AND abs(cnbp) >= 50",
    "event_links": EV + " SELECT a, b FROM lk",
    "event_components": EV
    + """, e2 AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT variant_id AS x, variant_id AS y FROM ev UNION SELECT r.x, e2.y FROM reach r JOIN e2 ON r.y = e2.x),
comp AS (SELECT x AS variant_id, min(y) AS component FROM reach GROUP BY x),
ac AS (SELECT variant_id, count(*) AS ac FROM carriers GROUP BY variant_id)
SELECT variant_id, component, first_value(variant_id) OVER (PARTITION BY component ORDER BY coalesce(ac, 0) DESC, size DESC, variant_id) AS representative
FROM comp LEFT JOIN ac USING (variant_id) JOIN ev USING (variant_id)""",
    "record_duplicates": """SELECT row_no, kept FROM (SELECT row_no, min(row_no) OVER (PARTITION BY variant_id, bubble_id, kind, ref_start, ref_end, cn, walk_cn, event_bp, alt_bp, alt, haplotypes) AS kept FROM carrier_events) WHERE row_no <> kept""",
    "carrier_check": """SELECT row_no, CASE WHEN ref_end - ref_start IS NULL OR event_bp IS NULL THEN 'unknown' WHEN g = 0 THEN 'equal' WHEN g <= 10 THEN 'near' ELSE 'differs' END AS status
FROM (SELECT *, abs(greatest(ref_end - ref_start, coalesce(alt_bp, 0)) - event_bp) AS g FROM carrier_events)""",
    "insertion_subtypes": "SELECT kind, count(DISTINCT variant_id) AS n_variants, count(*) AS n_rows, sum(event_bp)::BIGINT AS bp, grouping(kind)::INT AS is_total FROM carrier_events GROUP BY ROLLUP (kind)",
    "allele_similarity": WEIGHTS
    + """, sh AS (SELECT w.bubble_id, w.allele, sum(w.bp) AS shared FROM wt w JOIN wt t ON t.allele = 1 AND t.bubble_id = w.bubble_id AND t.node_id = w.node_id AND t.occurrence = w.occurrence GROUP BY ALL)
SELECT s.bubble_id, s.allele, round(CASE WHEN s.size + t.size = 0 THEN 1 ELSE coalesce(shared, 0) / (s.size + t.size - coalesce(shared, 0)) END, 6) AS jaccard
FROM sz s JOIN sz t ON t.allele = 1 AND t.bubble_id = s.bubble_id LEFT JOIN sh ON sh.bubble_id = s.bubble_id AND sh.allele = s.allele WHERE s.allele > 1""",
}
QUERIES = {f.__name__: f for f in (
    record_frequencies, record_filtered, carrier_samples, copy_numbers, cn_carriers, event_links, event_components, record_duplicates, carrier_check,
    insertion_subtypes, allele_similarity, allele_clusters, allele_events,
)}
