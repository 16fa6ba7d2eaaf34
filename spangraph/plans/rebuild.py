"""Queries of rebuilt haplotypes, ordered crossings, anchor chains, approximate repeats and lead conditioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.operators import assoc as A
from spangraph.operators import rebuild as R
from spangraph.operators import walks as K
from spangraph.plans.assoc import FULL, _linear, doses, phenotypes
from spangraph.plans.calls import REC, carriers, records
from spangraph.plans.walks import SPELLED, STEPS, blocks, nodes, paths, read_crossings, steps

WORD, GAP = 11, 2000


def haplotype_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each carrier's haplotype with its events applied to its contig's reference.

    The reference of a contig is the spelled walk of the least path of the contig's first graph; the
    events' genome coordinates are laid onto it modulo its length.
    """
    p = paths(spark, folder).where("contig is not null")
    graph = p.groupBy("contig").agg(F.min("graph_name").alias("graph_name"))
    least = p.groupBy("graph_name").agg(F.min("path_name").alias("path_name"))
    chosen = graph.join(least, "graph_name").select("contig", "path_name")
    walked = steps(spark, folder).join(chosen.select("path_name").distinct(), "path_name", "left_semi")
    texts = K.spelled(walked, nodes(spark, folder)).join(chosen, "path_name").where("sequence <> ''")
    references = texts.select(F.col("contig").alias("reference"), "sequence", F.length("sequence").cast("long").alias("n"))
    contig = F.regexp_extract(F.split_part("haplotype", F.lit("#"), F.lit(3)), "^[A-Za-z0-9]+", 0)
    held = carriers(spark, folder).withColumn("reference", contig).join(records(spark, folder).where("ref_start is not null and ref_end is not null"), "variant_id")
    start = F.pmod(F.col("ref_start") - 1, F.col("n"))
    laid = held.join(references.select("reference", "n"), "reference").withColumn("start", start)
    stop = F.least(F.col("start") + F.greatest(F.col("ref_end") - F.col("ref_start") + 1, F.lit(0)), F.col("n"))
    events = laid.select("haplotype", "reference", F.col("variant_id").alias("event"), "start", stop.alias("stop"), "alt")
    out = R.apply_events(events, references)
    return out.select("haplotype", "reference", "n_applied", "n_skipped", F.length("sequence").alias("bp"), F.md5("sequence").alias("digest"))


def crossing_matches(spark: SparkSession, folder: str) -> DataFrame:
    return R.crossing_matches(read_crossings(spark, folder))


def anchor_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of each walk against its graph's reference (the least path); anchors are nodes that the reference walks once."""
    at = K.coordinates(steps(spark, folder, "graph_name"), nodes(spark, folder))
    least = paths(spark, folder).groupBy("graph_name").agg(F.min("path_name").alias("path_name"))
    ref = at.join(least, ["graph_name", "path_name"]).groupBy("graph_name", "node_id")
    once = ref.agg(F.count(F.lit(1)).alias("n"), F.min("start_bp").alias("ref_pos"), F.bool_or("reverse").alias("ref_reverse")).where("n = 1")
    anchors = at.join(once, ["graph_name", "node_id"]).select(
        "path_name", (F.col("reverse") != F.col("ref_reverse")).alias("backward"), "ref_pos", F.col("start_bp").alias("pos"), (F.col("end_bp") - F.col("start_bp")).alias("weight")
    )
    return R.anchor_chains(anchors, ["path_name"], GAP)


def tandem_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """The most usual repeat period of each spelled walk, from the distances between equal words."""
    words = S.kmer_codes(blocks(spark, folder, overlap=WORD - 1), ["path_name", "start_bp"], "text", WORD, canonical_form=False)
    return R.tandem_periods(words.select("path_name", (F.col("start_bp") + F.col("pos")).alias("pos"), F.col("kmer").alias("word")), "path_name")


def lead_conditioned(spark: SparkSession, folder: str) -> DataFrame:
    """Each feature of a locus against the locus's strongest: collinear with it (r2 above 0.95), or its t given the lead.

    Only sums are needed: those of each feature, of the lead, and of their common carriers.
    """
    st = _linear(spark, folder).where("t is not null")
    loc = doses(spark, folder).select("graph_name", "feature").distinct()
    ranked = st.join(loc, "feature")
    lead = ranked.groupBy("graph_name").agg(F.min_by(F.struct("feature", "g", "gg", "gy"), F.struct(F.round(-F.abs("t"), 6).alias("a"), "feature")).alias("lead"))
    d = doses(spark, folder).join(phenotypes(spark, folder).where("y is not null").select("sample"), "sample")
    top = d.join(lead.select("graph_name", F.col("lead.feature").alias("feature")), ["graph_name", "feature"]).select("graph_name", "sample", F.col("dose").alias("h"))
    shared = d.join(top, ["graph_name", "sample"]).groupBy("graph_name", "feature").agg(F.sum(F.col("dose") * F.col("h")).alias("gh"))
    rows = ranked.join(lead, "graph_name").where("feature <> lead.feature").join(shared, ["graph_name", "feature"], "left").na.fill(0, ["gh"])
    n = F.col("n").cast("double")
    dot = lambda ab, a, b: n * ab - F.col(a) * F.col(b)
    sgg, shh, syy = dot(F.col("gg"), "g", "g"), dot(F.col("lead.gg"), "lead.g", "lead.g"), dot(F.col("yy"), "y", "y")
    rgy = dot(F.col("gy"), "g", "y") / F.sqrt(sgg * syy)
    rhy = dot(F.col("lead.gy"), "lead.g", "y") / F.sqrt(shh * syy)
    rgh = dot(F.col("gh"), "g", "lead.g") / F.sqrt(sgg * shh)
    rows = rows.select("graph_name", "feature", F.col("lead.feature").alias("lead"), "n", rgy.alias("rgy"), rhy.alias("rhy"), rgh.alias("rgh"))
    tied = F.col("rgh") * F.col("rgh") > 0.95
    part = (F.col("rgy") - F.col("rhy") * F.col("rgh")) / F.sqrt((1 - F.col("rhy") * F.col("rhy")) * (1 - F.col("rgh") * F.col("rgh")))
    rows = rows.withColumn("pr", F.when(~tied & (F.abs("rhy") < 1), part))
    t = F.when(F.abs("pr") < 1, F.col("pr") * F.sqrt((F.col("n") - 3) / (1 - F.col("pr") * F.col("pr"))))
    return rows.select("graph_name", "feature", "lead", F.round(F.col("rgh") * F.col("rgh"), 6).alias("r2_lead"), F.when(tied, "collinear").otherwise("conditioned").alias("tier"), F.round(t, 5).alias("t"))


def lead_tested(spark: SparkSession, folder: str) -> DataFrame:
    """The conditioned features with p and Benjamini-Hochberg q."""
    n = phenotypes(spark, folder).where("y is not null").agg(F.count(F.lit(1))).scalar()
    p = lead_conditioned(spark, folder).where("t is not null").select("feature", A.t_p("t", (n - 3).cast("double")).alias("p"))
    return A.adjusted(p, "feature", "p")


ORACLES = {
    "haplotype_rebuilt": f"""WITH {STEPS}, {SPELLED}, {REC},
gr AS (SELECT contig, min(graph_name) AS graph_name FROM paths WHERE contig IS NOT NULL GROUP BY contig),
le AS (SELECT graph_name, min(path_name) AS path_name FROM paths WHERE contig IS NOT NULL GROUP BY graph_name),
rf AS (SELECT gr.contig AS reference, sequence, length(sequence) AS n FROM gr JOIN le USING (graph_name) JOIN spelled USING (path_name) WHERE sequence <> ''),
e0 AS (SELECT haplotype, reference, variant_id, (ref_start - 1) % n AS s, greatest(ref_end - ref_start + 1, 0) AS w, n, CASE WHEN alt IS NULL OR alt = '.' THEN '' ELSE alt END AS alt
  FROM (SELECT *, regexp_extract(split_part(haplotype, '#', 3), '^[A-Za-z0-9]+') AS reference FROM carriers) JOIN records USING (variant_id) JOIN rf USING (reference) WHERE ref_start IS NOT NULL AND ref_end IS NOT NULL),
e1 AS (SELECT *, least(s + w, n) AS t FROM e0),
e2 AS (SELECT *, coalesce(s >= max(t) OVER b, true) AS ok FROM e1 WINDOW b AS (PARTITION BY haplotype, reference ORDER BY s, t, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e3 AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY haplotype, reference ORDER BY s, t, variant_id), 0) AS p FROM e2 WHERE ok),
mk AS (SELECT haplotype, reference, string_agg(substring(sequence, p + 1, s - p) || alt, '' ORDER BY s, t, variant_id) || substring(any_value(sequence), max(t) + 1) AS made FROM e3 JOIN rf USING (reference) GROUP BY ALL),
ct AS (SELECT haplotype, reference, count_if(ok)::BIGINT AS n_applied, count_if(NOT ok)::BIGINT AS n_skipped FROM e2 GROUP BY ALL)
SELECT haplotype, reference, n_applied, n_skipped, length(made)::INT AS bp, md5(made) AS digest FROM mk JOIN ct USING (haplotype, reference)""",
    "tandem_approximate": f"""WITH {STEPS}, {SPELLED},
wd AS (SELECT path_name, i - 1 AS pos, substring(s, i, {WORD}) AS word FROM (SELECT path_name, upper(sequence) AS s, unnest(generate_series(1, length(sequence) - {WORD - 1})) AS i FROM spelled)),
lg AS (SELECT path_name, pos, lead(pos) OVER (PARTITION BY path_name, word ORDER BY pos) - pos AS period FROM wd WHERE regexp_full_match(word, '[ACGT]+')),
pr AS (SELECT path_name, period, count(*) AS n_seeds, min(pos) AS first_pos, max(pos) AS last_pos FROM lg WHERE period IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT path_name, period, n_seeds, first_pos, last_pos, floor((last_pos - first_pos) / period + 2)::BIGINT AS copies
FROM pr QUALIFY row_number() OVER (PARTITION BY path_name ORDER BY n_seeds DESC, period) = 1""",
    "lead_conditioned": FULL
    + """, rk AS (SELECT * FROM lin JOIN loc USING (feature) WHERE t IS NOT NULL),
ld AS (SELECT graph_name, feature AS lead, g AS hg, gg AS hh, gy AS hy FROM rk QUALIFY row_number() OVER (PARTITION BY graph_name ORDER BY round(-abs(t), 6), feature) = 1),
dd AS (SELECT d.* FROM doses d JOIN pheno USING (sample) WHERE y IS NOT NULL),
sh AS (SELECT a.graph_name, a.feature, sum(a.dose * b.dose)::DOUBLE AS gh FROM dd a JOIN ld USING (graph_name) JOIN dd b ON b.graph_name = a.graph_name AND b.feature = ld.lead AND b.sample = a.sample GROUP BY ALL),
rr AS (SELECT graph_name, feature, lead, n, (n * gy - g * y) / sqrt((n * gg - g * g) * (n * yy - y * y)) AS rgy, (n * hy - hg * y) / sqrt((n * hh - hg * hg) * (n * yy - y * y)) AS rhy,
  (n * coalesce(gh, 0) - g * hg) / sqrt((n * gg - g * g) * (n * hh - hg * hg)) AS rgh FROM rk JOIN ld USING (graph_name) LEFT JOIN sh USING (graph_name, feature) WHERE feature <> lead),
pt AS (SELECT *, CASE WHEN rgh * rgh <= 0.95 AND abs(rhy) < 1 THEN (rgy - rhy * rgh) / sqrt((1 - rhy * rhy) * (1 - rgh * rgh)) END AS pr FROM rr)
SELECT graph_name, feature, lead, round(rgh * rgh, 6) AS r2_lead, CASE WHEN rgh * rgh > 0.95 THEN 'collinear' ELSE 'conditioned' END AS tier, round(CASE WHEN abs(pr) < 1 THEN pr * sqrt((n - 3) / (1 - pr * pr)) END, 5) AS t FROM pt""",
}
QUERIES = {f.__name__: f for f in (haplotype_rebuilt, crossing_matches, anchor_chains, tandem_approximate, lead_conditioned, lead_tested)}
