"""Queries over the walks of ``graph_paths``: coordinates, edges, dosages, sites, alleles, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spangraph.operators import sites as T
from spangraph.operators import walks as K
from spangraph.operators.alleles import alleles
from spangraph.operators.intervals import merge
from spangraph.operators.packed import unpack
from spangraph.plans.packed import ORACLES as PACKED
from spangraph.plans.packed import packed_fields
from spangraph.tables import load


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return K.distinct_paths(load(spark, folder, "graph_paths"))


def steps(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    return K.explode_steps(paths(spark, folder), *carry)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return K.distinct_nodes(load(spark, folder, "graph_nodes"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return K.distinct_sites(load(spark, folder, "bubble_sites"))


def read_crossings(spark: SparkSession, folder: str) -> DataFrame:
    found = K.crossings(sites(spark, folder), steps(spark, folder))
    return K.signatures(found, K.step_arrays(paths(spark, folder)))


def walk_steps(spark: SparkSession, folder: str) -> DataFrame:
    return steps(spark, folder).drop("step")


def walk_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    return K.coordinates(steps(spark, folder), nodes(spark, folder)).select("path_name", "idx", "node_id", "start_bp", "end_bp")


def pairs(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    return K.explode_pairs(paths(spark, folder), *carry)


def blocks(spark: SparkSession, folder: str, size: int = 10_000, overlap: int = 0) -> DataFrame:
    """The spelled walks in blocks."""
    return K.spelled_blocks(steps(spark, folder), nodes(spark, folder), size, overlap)


def walk_edges(spark: SparkSession, folder: str) -> DataFrame:
    return K.edges(pairs(spark, folder))


def graph_features(spark: SparkSession, folder: str) -> DataFrame:
    walked = steps(spark, folder)
    n_paths = paths(spark, folder).agg(F.count(F.lit(1)))
    by_node = K.feature_stats(K.dosage(walked, "node_id"), n_paths).withColumn("layer", F.lit("node"))
    by_edge = K.feature_stats(K.dosage(K.edges(pairs(spark, folder)), "edge"), n_paths).withColumn("layer", F.lit("edge"))
    return by_node.unionByName(by_edge)


def node_dosage(spark: SparkSession, folder: str) -> DataFrame:
    return K.dosage(steps(spark, folder), "node_id")


def edge_dosage(spark: SparkSession, folder: str) -> DataFrame:
    return K.dosage(K.edges(pairs(spark, folder)), "edge")


def site_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return read_crossings(spark, folder).drop("inside")


def site_alleles(spark: SparkSession, folder: str) -> DataFrame:
    return alleles(read_crossings(spark, folder))


def site_support(spark: SparkSession, folder: str) -> DataFrame:
    """Support, alleles and size range of each site; the reference is the least path of the site's crossings."""
    return T.support(read_crossings(spark, folder), nodes(spark, folder))


def site_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Sites kept by support, alternative support and size floors; an inversion signal lifts the size floor."""
    s = site_support(spark, folder)
    return s.where("path_support >= 3 and alt_support_max >= 2 and (max_inside_bp >= 50 or inversion_signal) and max_inside_bp <= 100000").select(
        "bubble_id", "path_support", "max_inside_bp"
    )


def site_recorded_check(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded against computed support: which sites of the table disagree with the walks."""
    mine = site_support(spark, folder).select("bubble_id", F.col("path_support").alias("computed"))
    return (
        sites(spark, folder).select("bubble_id", F.col("path_support").alias("recorded")).join(mine, "bubble_id", "full_outer")
        .withColumn("status", F.when(F.col("computed").isNull(), "not_crossed").when(F.col("recorded").isNull(), "not_recorded")
                    .when(F.col("computed") == F.col("recorded"), "equal").otherwise("differs"))
    )


def site_passes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive steps of a path that lie inside a site, and how many there are."""
    ids = unpack(packed_fields(spark, folder).where("field_name = 'inside_nodes'"), "field_name", ["row_no"], "packed").select("row_no", F.col("val").alias("node_id"))
    inside = sites(spark, folder).select("row_no", "bubble_id").join(ids, "row_no").select("bubble_id", "node_id").distinct()
    order = W.partitionBy("bubble_id", "path_name").orderBy("idx")
    hits = steps(spark, folder).join(inside, "node_id").withColumn("__i", F.col("idx") - F.row_number().over(order))
    runs = hits.groupBy("bubble_id", "path_name", "__i").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("bubble_id", "path_name").agg(F.count(F.lit(1)).alias("passes"), F.max("n").alias("longest"))


def tandem_runs(spark: SparkSession, folder: str) -> DataFrame:
    return K.tandem_runs(steps(spark, folder))


def walk_spelled(spark: SparkSession, folder: str) -> DataFrame:
    """The spelled walks, in blocks of 10 000 bases: length and digest of each."""
    return blocks(spark, folder).select("path_name", "block", F.length("text").alias("bp"), F.md5("text").alias("digest"))


def gap_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Assembly gaps: runs of at least ten N in the spelled walks.

    Runs are found block by block, those at the border of a block whatever their length, and those that touch are one.
    """
    cut = blocks(spark, folder).where(F.col("text").rlike("[Nn]")).select("path_name", "block", "start_bp", F.posexplode(F.regexp_extract_all("text", F.lit("[Nn]+|[^Nn]+"), F.lit(0))).alias("i", "piece"))
    before = W.partitionBy("path_name", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    hi = F.col("start_bp") + F.sum(F.length("piece")).over(before)
    runs = cut.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.length("piece")).where("upper(substring(piece, 1, 1)) = 'N'")
    gaps = merge(runs, ["path_name"], "lo", "hi").where("hi - lo >= 10")
    return gaps.groupBy("path_name").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum(F.col("hi") - F.col("lo")).alias("gap_bp"))


def graph_backbone(spark: SparkSession, folder: str) -> DataFrame:
    return K.shared_support(steps(spark, folder, "graph_name"), 0.5)


def path_inversions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each walk against its graph's reference, the path with the least name."""
    walked = steps(spark, folder, "graph_name")
    ref = walked.join(paths(spark, folder).groupBy("graph_name").agg(F.min("path_name").alias("path_name")), ["graph_name", "path_name"])
    once = ref.groupBy("graph_name", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("ref_idx"), F.bool_or("reverse").alias("ref_reverse"))
    # a node belongs to one graph only, so the node id alone is the key
    return K.orientation_runs(walked, once.where("n = 1").select("node_id", "ref_idx", "ref_reverse"))


def node_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct neighbours of each node on either side, self-loops apart; hubs have at least 8 on one side."""
    met = pairs(spark, folder).select("step", "nxt").distinct()
    both = met.unionByName(met.select(K.flip(F.col("nxt")).alias("step"), K.flip(F.col("step")).alias("nxt"))).distinct()
    side = both.select(F.expr("substring(step, 2)").alias("node_id"), F.col("step").startswith(">").alias("right"), F.expr("substring(nxt, 2)").alias("to"))
    out = side.groupBy("node_id").agg(
        F.count_distinct(F.when(F.col("right") & (F.col("to") != F.col("node_id")), F.col("to"))).alias("right_degree"),
        F.count_distinct(F.when(~F.col("right") & (F.col("to") != F.col("node_id")), F.col("to"))).alias("left_degree"),
        F.bool_or(F.col("to") == F.col("node_id")).alias("self_loop"),
    )
    return out.withColumn("hub", F.greatest("right_degree", "left_degree") >= 8)


def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Size figures of each graph: paths, steps, distinct nodes and edges, revisits, walked bp."""
    walked = steps(spark, folder, "graph_name").join(nodes(spark, folder).select("node_id", "bp"), "node_id", "left")
    per_path = walked.groupBy("graph_name", "path_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("d"), F.sum(F.coalesce("bp", F.lit(0))).alias("bp")
    )
    per_node = walked.groupBy("graph_name").agg(F.count_distinct("node_id").alias("n_nodes"))
    return (
        per_path.groupBy("graph_name").agg(
            F.count(F.lit(1)).alias("n_paths"), F.sum("n").alias("n_steps"), F.sum(F.col("n") - F.col("d")).alias("revisits"),
            F.sum("bp").alias("walked_bp"), F.percentile("bp", F.lit(0.5)).alias("median_bp"))
        .join(per_node, "graph_name")
    )


def nodes_numeric_order(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric-aware rank of node ids within their graph."""
    ids = load(spark, folder, "graph_nodes").select("graph_name", "node_id").distinct()
    order = W.partitionBy("graph_name").orderBy(F.expr("try_cast(node_id as bigint)").asc_nulls_last(), "node_id")
    return ids.withColumn("rank", F.row_number().over(order))


def best_crossing(spark: SparkSession, folder: str) -> DataFrame:
    """The crossing with the most inside steps of each site and path; ties to the first."""
    read = read_crossings(spark, folder).withColumn("n_inside", F.size("inside"))
    order = W.partitionBy("bubble_id", "path_name").orderBy(F.desc("n_inside"), "crossing")
    return read.withColumn("r", F.row_number().over(order)).where("r = 1").select("bubble_id", "path_name", "crossing", "n_inside")


def twin_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of one graph with equal sequence (upper-cased): class and size."""
    rows = load(spark, folder, "graph_nodes").where("sequence is not null and sequence <> '*'").select("graph_name", "node_id", F.upper("sequence").alias("s")).distinct()
    groups = rows.groupBy("graph_name", "s").agg(F.min("node_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, ["graph_name", "s"]).select("graph_name", "node_id", "keeper", "n")


def node_support(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that no walk visits (set difference)."""
    return load(spark, folder, "graph_nodes").select("node_id").subtract(steps(spark, folder).select("node_id"))


def sample_intersection(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that have walks of both record types (set intersection)."""
    rows = load(spark, folder, "graph_paths")
    return rows.where("path_type = 'P'").select("sample_name").intersect(rows.where("path_type = 'W'").select("sample_name"))


STEPS = """
paths AS (
  SELECT path_name, max(graph_name) AS graph_name, max(sample_name) AS sample_name, max(haplotype) AS haplotype, max(contig) AS contig,
    min(CASE WHEN steps LIKE '>%' OR steps LIKE '<%' THEN regexp_extract_all(steps, '[<>][^<>]+')
      ELSE list_transform(string_split(steps, ','), lambda x: CASE WHEN x LIKE '%-' THEN '<' ELSE '>' END || x[:-2]) END) AS w
  FROM graph_paths WHERE path_name IS NOT NULL AND steps IS NOT NULL AND steps NOT IN ('*', '') GROUP BY path_name),
steps AS (
  SELECT path_name, graph_name, sample_name, haplotype, i - 1 AS idx, w[i] AS step, w[i][2:] AS node_id, w[i] LIKE '<%' AS reverse
  FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM paths)),
nodes AS (
  SELECT node_id, sequence, coalesce(length(sequence), length_bp, 0) AS bp FROM (
    SELECT node_id, max(CASE WHEN sequence <> '*' THEN sequence END) AS sequence, max(length_bp) AS length_bp
    FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id)),
pairs AS (SELECT *, lead(step) OVER (PARTITION BY path_name ORDER BY idx) AS nxt FROM steps),
edges AS (
  SELECT path_name, idx, least(step || nxt, translate(nxt[1:1], '<>', '><') || nxt[2:] || translate(step[1:1], '<>', '><') || step[2:]) AS edge
  FROM pairs WHERE nxt IS NOT NULL)"""
SITES = (
    STEPS
    + """,
sites AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY bubble_id ORDER BY row_no) AS r FROM bubble_sites WHERE bubble_id IS NOT NULL) WHERE r = 1),
hits AS (
  SELECT bubble_id, path_name, idx, role, reverse = flipped AS straight FROM steps JOIN (
    SELECT bubble_id, source_node AS node_id, source_orient = '-' AS flipped, 's' AS role FROM sites WHERE source_node <> sink_node
    UNION ALL SELECT bubble_id, sink_node, sink_orient = '-', 't' FROM sites WHERE source_node <> sink_node) USING (node_id)),
nexts AS (
  SELECT *, lead(role) OVER w AS to_role, lead(straight) OVER w AS to_straight, lead(idx) OVER w AS right_idx
  FROM hits WINDOW w AS (PARTITION BY bubble_id, path_name ORDER BY idx)),
crossed AS (
  SELECT bubble_id, path_name, row_number() OVER (PARTITION BY bubble_id, path_name ORDER BY idx) AS crossing, idx AS left_idx, right_idx, role = 's' AS forward
  FROM nexts WHERE (role = 's' AND to_role = 't' AND straight AND to_straight) OR (role = 't' AND to_role = 's' AND NOT straight AND NOT to_straight)),
cuts AS (SELECT c.*, w[left_idx + 2:right_idx] AS cut FROM crossed c JOIN paths USING (path_name)),
crossings AS (
  SELECT * EXCLUDE (cut), CASE WHEN forward THEN cut ELSE list_transform(list_reverse(cut), lambda s: translate(s[1:1], '<>', '><') || s[2:]) END AS inside
  FROM cuts),
signed AS (SELECT *, array_to_string(inside, '') AS signature FROM crossings)"""
)
SUPPORT = (
    SITES
    + """,
sized AS (
  SELECT s.bubble_id, s.path_name, s.crossing, s.signature, coalesce(sum(bp), 0) AS bp, coalesce(bool_or(step LIKE '<%'), false) AS inverted
  FROM signed s LEFT JOIN (SELECT bubble_id, path_name, crossing, unnest(inside) AS step FROM signed) u USING (bubble_id, path_name, crossing)
  LEFT JOIN nodes n ON n.node_id = u.step[2:] GROUP BY ALL),
marked AS (SELECT *, signature = first_value(signature) OVER (PARTITION BY bubble_id ORDER BY path_name, crossing) AS is_ref FROM sized),
alleles AS (SELECT bubble_id, signature, count(DISTINCT path_name) AS n, bool_or(is_ref) AS is_ref, min(bp) AS bp, bool_or(inverted) AS inverted FROM marked GROUP BY ALL),
support AS (
  SELECT a.bubble_id, count(*) AS distinct_alleles, max(CASE WHEN is_ref THEN n END) AS ref_support,
    coalesce(max(CASE WHEN NOT is_ref THEN n END), 0) AS alt_support_max, coalesce(min(CASE WHEN NOT is_ref THEN n END), 0) AS alt_support_min,
    min(bp)::BIGINT AS min_inside_bp, max(bp)::BIGINT AS max_inside_bp, bool_or(inverted) AS inversion_signal, any_value(p) AS path_support
  FROM alleles a JOIN (SELECT bubble_id, count(DISTINCT path_name) AS p FROM signed GROUP BY bubble_id) s ON s.bubble_id = a.bubble_id GROUP BY a.bubble_id)"""
)


def _stats(table: str, feature: str, layer: str) -> str:
    return f"""SELECT feature, present, min_count, max_count, total, min_count <> max_count OR least(present, (SELECT count(*) FROM paths) - present) > 1 AS informative,
  '{layer}' AS layer FROM (SELECT feature, count(*) AS present, min(n) AS min_count, max(n) AS max_count, sum(n)::BIGINT AS total
  FROM (SELECT {feature} AS feature, path_name, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY feature)"""


SPELLED = """
spelled AS (
  SELECT path_name, string_agg(CASE WHEN reverse THEN reverse(translate(part, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd')) ELSE part END, '' ORDER BY idx) AS sequence
  FROM (SELECT path_name, idx, reverse, coalesce(sequence, repeat('N', bp::INT), '') AS part FROM steps LEFT JOIN nodes USING (node_id)) GROUP BY path_name)"""

ORACLES = {
    "walk_steps": f"WITH {STEPS} SELECT path_name, idx, node_id, reverse FROM steps",
    "walk_coordinates": f"""WITH {STEPS} SELECT path_name, idx, node_id, (e - bp)::BIGINT AS start_bp, e::BIGINT AS end_bp FROM (
  SELECT s.*, coalesce(bp, 0) AS bp, sum(coalesce(bp, 0)) OVER (PARTITION BY path_name ORDER BY idx) AS e FROM steps s LEFT JOIN nodes USING (node_id))""",
    "walk_edges": f"WITH {STEPS} SELECT * FROM edges",
    "graph_features": f"WITH {STEPS} {_stats('steps', 'node_id', 'node')} UNION ALL {_stats('edges', 'edge', 'edge')}",
    "node_dosage": f"WITH {STEPS} SELECT node_id AS feature, path_name, count(*) AS n FROM steps GROUP BY ALL",
    "edge_dosage": f"WITH {STEPS} SELECT edge AS feature, path_name, count(*) AS n FROM edges GROUP BY ALL",
    "site_crossings": f"WITH {SITES} SELECT * EXCLUDE (inside) FROM signed",
    "site_alleles": f"""WITH {SITES} SELECT *, row_number() OVER (PARTITION BY bubble_id ORDER BY n_paths DESC, signature) AS allele FROM (
  SELECT bubble_id, signature, count(DISTINCT path_name) AS n_paths, count(*) AS n_crossings FROM signed GROUP BY ALL)""",
    "site_support": f"WITH {SUPPORT} SELECT * FROM support",
    "site_filtered": f"""WITH {SUPPORT} SELECT bubble_id, path_support, max_inside_bp FROM support
WHERE path_support >= 3 AND alt_support_max >= 2 AND (max_inside_bp >= 50 OR inversion_signal) AND max_inside_bp <= 100000""",
    "site_recorded_check": f"""WITH {SUPPORT} SELECT coalesce(s.bubble_id, u.bubble_id) AS bubble_id, s.path_support AS recorded, u.path_support AS computed,
  CASE WHEN u.path_support IS NULL THEN 'not_crossed' WHEN s.path_support IS NULL THEN 'not_recorded'
    WHEN u.path_support = s.path_support THEN 'equal' ELSE 'differs' END AS status
FROM sites s FULL OUTER JOIN support u ON s.bubble_id = u.bubble_id""",
    "site_passes": f"""WITH {SITES}, vals AS ({PACKED["p1_found"]}),
inside AS (SELECT DISTINCT bubble_id, val AS node_id FROM vals v JOIN sites s USING (row_no) WHERE v.field_name = 'inside_nodes'),
runs AS (SELECT bubble_id, path_name, i, count(*) AS n FROM (
  SELECT bubble_id, path_name, idx - row_number() OVER (PARTITION BY bubble_id, path_name ORDER BY idx) AS i FROM steps JOIN inside USING (node_id)) GROUP BY ALL)
SELECT bubble_id, path_name, count(*) AS passes, max(n) AS longest FROM runs GROUP BY ALL""",
    "tandem_runs": f"""WITH {STEPS},
same AS (SELECT a.path_name, a.idx - b.idx AS period, a.idx, a.idx - row_number() OVER (PARTITION BY a.path_name, a.idx - b.idx ORDER BY a.idx) AS island
  FROM steps a JOIN steps b ON a.path_name = b.path_name AND a.step = b.step AND b.idx < a.idx),
runs AS (SELECT path_name, period, min(idx) - period AS first_idx, max(idx) AS last_idx, count(*) // period + 1 AS copies FROM same GROUP BY path_name, period, island HAVING count(*) >= period)
SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.path_name = r.path_name AND s.period < r.period AND r.period % s.period = 0 AND s.first_idx <= r.first_idx AND s.last_idx >= r.last_idx)""",
    "walk_spelled": f"""WITH {STEPS}, {SPELLED}, bl AS (SELECT path_name, b AS block, substring(sequence, b * 10000 + 1, 10000) AS t FROM (SELECT *, unnest(generate_series(0, (length(sequence) - 1) // 10000)) AS b FROM spelled WHERE sequence <> ''))
SELECT path_name, block, length(t) AS bp, md5(t) AS digest FROM bl""",
    "gap_runs": f"""WITH {STEPS}, {SPELLED} SELECT path_name, count(*) AS n_gaps, sum(length(gap))::BIGINT AS gap_bp
FROM (SELECT path_name, unnest(regexp_extract_all(sequence, '[Nn]{{10,}}')) AS gap FROM spelled) GROUP BY path_name""",
    "graph_backbone": f"""WITH {STEPS}, per AS (SELECT graph_name, node_id, path_name, count(*) AS n FROM steps GROUP BY ALL),
nd AS (SELECT graph_name, node_id, count_if(n = 1)::BIGINT AS n_paths FROM per GROUP BY ALL),
al AS (SELECT graph_name, count(DISTINCT path_name) AS a FROM steps GROUP BY ALL)
SELECT graph_name, node_id, n_paths, round(n_paths / a, 6) AS share FROM nd JOIN al USING (graph_name) WHERE n_paths >= a * 0.5""",
    "path_inversions": f"""WITH {STEPS}, refs AS (SELECT graph_name, min(path_name) AS path_name FROM paths GROUP BY graph_name),
once AS (SELECT node_id, min(idx) AS ref_idx, bool_or(reverse) AS ref_reverse FROM steps JOIN refs USING (graph_name, path_name) GROUP BY graph_name, node_id HAVING count(*) = 1),
aligned AS (SELECT path_name, idx, ref_idx, reverse <> ref_reverse AS backward FROM steps JOIN once USING (node_id)),
ch AS (SELECT *, coalesce((backward <> lag(backward) OVER (PARTITION BY path_name ORDER BY idx))::INT, 0) AS c FROM aligned),
ru AS (SELECT *, sum(c) OVER (PARTITION BY path_name ORDER BY idx) AS run FROM ch)
SELECT path_name, run::BIGINT AS run, bool_or(backward) AS backward, count(*) AS n_steps, min(ref_idx) AS ref_lo, max(ref_idx) AS ref_hi FROM ru GROUP BY path_name, run""",
    "node_degrees": f"""WITH {STEPS}, d AS (SELECT DISTINCT step, nxt FROM pairs WHERE nxt IS NOT NULL),
b AS (SELECT step, nxt FROM d UNION SELECT translate(nxt[1:1], '<>', '><') || nxt[2:], translate(step[1:1], '<>', '><') || step[2:] FROM d),
s AS (SELECT step[2:] AS node_id, step LIKE '>%' AS r, nxt[2:] AS t FROM b),
o AS (SELECT node_id, count(DISTINCT CASE WHEN r AND t <> node_id THEN t END) AS right_degree, count(DISTINCT CASE WHEN NOT r AND t <> node_id THEN t END) AS left_degree,
  bool_or(t = node_id) AS self_loop FROM s GROUP BY node_id)
SELECT *, greatest(right_degree, left_degree) >= 8 AS hub FROM o""",
    "graph_summary": f"""WITH {STEPS}, w AS (SELECT s.*, coalesce(bp, 0) AS bp FROM steps s LEFT JOIN nodes USING (node_id)),
pp AS (SELECT graph_name, path_name, count(*) AS n, count(DISTINCT node_id) AS d, sum(bp) AS bp FROM w GROUP BY ALL),
pn AS (SELECT graph_name, count(DISTINCT node_id) AS n_nodes FROM w GROUP BY ALL)
SELECT graph_name, count(*) AS n_paths, sum(n)::BIGINT AS n_steps, sum(n - d)::BIGINT AS revisits, sum(bp)::BIGINT AS walked_bp, quantile_cont(bp, 0.5)::DOUBLE AS median_bp, any_value(n_nodes) AS n_nodes
FROM pp JOIN pn USING (graph_name) GROUP BY graph_name""",
    "nodes_numeric_order": """SELECT graph_name, node_id, row_number() OVER (PARTITION BY graph_name ORDER BY try_cast(node_id AS BIGINT) NULLS LAST, node_id) AS rank
FROM (SELECT DISTINCT graph_name, node_id FROM graph_nodes)""",
    "best_crossing": f"""WITH {SITES} SELECT bubble_id, path_name, crossing, len(inside) AS n_inside FROM (
  SELECT *, row_number() OVER (PARTITION BY bubble_id, path_name ORDER BY len(inside) DESC, crossing) AS r FROM signed) WHERE r = 1""",
    "twin_nodes": """WITH r AS (SELECT DISTINCT graph_name, node_id, upper(sequence) AS s FROM graph_nodes WHERE sequence IS NOT NULL AND sequence <> '*'),
g AS (SELECT graph_name, s, min(node_id) AS keeper, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT graph_name, node_id, keeper, n FROM r JOIN g USING (graph_name, s)""",
    "node_support": f"WITH {STEPS} SELECT node_id FROM graph_nodes EXCEPT SELECT node_id FROM steps",
    "sample_intersection": "SELECT sample_name FROM graph_paths WHERE path_type = 'P' INTERSECT SELECT sample_name FROM graph_paths WHERE path_type = 'W'",
}
QUERIES = {f.__name__: f for f in (
    walk_steps, walk_coordinates, walk_edges, graph_features, node_dosage, edge_dosage, site_crossings, site_alleles, site_support, site_filtered,
    site_recorded_check, site_passes, tandem_runs, walk_spelled, gap_runs, graph_backbone, path_inversions, node_degrees, graph_summary,
    nodes_numeric_order, best_crossing, twin_nodes, node_support, sample_intersection,
)}
