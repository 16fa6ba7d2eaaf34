"""Queries that compare and summarise: genotypes in long form, reasons, concordance, merged sites, weighted k-mers, run summaries."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.operators import intervals as I
from spangraph.operators import walks as K
from spangraph.plans.calls import REC, carriers, records
from spangraph.plans.heavy_keys import COUNTED, counted_hits
from spangraph.plans.sequences import node_kmers
from spangraph.plans.walks import SITES, SPELLED, STEPS, nodes, paths, read_crossings, sites, steps
from spangraph.tables import load


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    """(bubble_id, name): haplotype names (without their interval) whose walk crosses the site."""
    name = F.regexp_replace("path_name", r":\d+-\d+$", "")
    return read_crossings(spark, folder).select("bubble_id", name.alias("haplotype")).distinct()


def record_genotypes(spark: SparkSession, folder: str) -> DataFrame:
    """Genotype of every record in every haplotype that crosses its site: 1 carried, 0 not; haplotypes that do not cross have no row."""
    seen = records(spark, folder).select("variant_id", "bubble_id").join(_observed(spark, folder), "bubble_id")
    carried = carriers(spark, folder).select("variant_id", "haplotype", F.lit(1).alias("gt"))
    return seen.join(carried, ["variant_id", "haplotype"], "left").select("variant_id", "haplotype", F.coalesce("gt", F.lit(0)).alias("gt"))


def carrier_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each named carrier can be confirmed: it crosses the site, has walks that do not, or has no walk."""
    named = carriers(spark, folder).join(records(spark, folder).select("variant_id", "bubble_id"), "variant_id")
    crossing = _observed(spark, folder).withColumn("crosses", F.lit(True))
    walked = paths(spark, folder).select(F.regexp_replace("path_name", r":\d+-\d+$", "").alias("haplotype")).distinct().withColumn("walked", F.lit(True))
    out = named.join(crossing, ["bubble_id", "haplotype"], "left").join(walked, "haplotype", "left")
    reason = F.when(F.col("crosses"), "crosses").when(F.col("walked"), "not_crossed").otherwise("no_walk")
    return out.groupBy("variant_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def count_concordance(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded against counted totals per k-mer: pairs, share equal, correlation."""
    mine = counted_hits(spark, folder, "kmer", "hit_count").groupBy("kmer").agg(F.sum("hit_count").alias("mine"))
    kept = load(spark, folder, "kmer_features").where("total_count is not null").groupBy("kmer").agg(F.max("total_count").alias("kept"))
    both = mine.join(kept, "kmer")
    r = F.corr(F.col("mine").cast("double"), F.col("kept").cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("mine") == F.col("kept")) / F.count(F.lit(1)), 6).alias("equal"), F.round(r, 6).alias("r"))


def feature_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the recorded k-mers against the counted ones, by band of count."""
    mine = counted_hits(spark, folder, "kmer", "hit_count").groupBy("kmer").agg(F.sum("hit_count").alias("n")).withColumnRenamed("kmer", "a")
    kept = load(spark, folder, "kmer_features").where("kmer is not null").groupBy(F.col("kmer").alias("b")).agg(F.max("total_count").alias("m"))
    both = mine.join(kept, F.col("a") == F.col("b"), "full_outer").withColumn("size", F.coalesce("n", "m", F.lit(0)))
    band = F.when(F.col("size") <= 3, "low").when(F.col("size") <= 50, "mid").otherwise("high")
    per = both.groupBy(band.alias("band")).agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("b").isNull()).alias("fn")
    )
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per.select("band", "tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _site_spans(spark: SparkSession, folder: str) -> DataFrame:
    """(path_name, bubble_id, lo, hi): where each site lies on each path, from the end of the left boundary to the start of the right one."""
    at = K.coordinates(steps(spark, folder), nodes(spark, folder))
    found = K.crossings(sites(spark, folder), steps(spark, folder))
    left = at.select("path_name", F.col("idx").alias("left_idx"), F.col("end_bp").alias("lo"))
    right = at.select("path_name", F.col("idx").alias("right_idx"), F.col("start_bp").alias("hi"))
    return found.join(left, ["path_name", "left_idx"]).join(right, ["path_name", "right_idx"]).select("path_name", "bubble_id", "lo", "hi")


def site_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of each path covered by sites that overlap or lie at most 10 bp apart."""
    return I.merge(_site_spans(spark, folder), ["path_name"], "lo", "hi", gap=10)


def site_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    """A set of sites of each path that do not overlap, chosen greedily from the shortest; ties by place and id. A path is the unit of work."""
    rows = _site_spans(spark, folder).where("hi > lo").distinct()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        """Kept intervals stay disjoint, so their sorted starts and ends tell by one search whether the next one fits."""
        pdf = pdf.assign(size=pdf["hi"] - pdf["lo"]).sort_values(["size", "lo", "bubble_id"])
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for name, bubble, lo, hi in pdf[["path_name", "bubble_id", "lo", "hi"]].itertuples(index=False):
            at = bisect.bisect_right(ends, lo)
            if at == len(starts) or hi <= starts[at]:
                starts.insert(at, lo)
                ends.insert(at, hi)
                out.append((name, bubble, lo, hi))
        return pd.DataFrame(out, columns=["path_name", "bubble_id", "lo", "hi"])

    return rows.groupBy("path_name").applyInPandas(pick, "path_name string, bubble_id long, lo long, hi long")


def walked_kmers(spark: SparkSession, folder: str) -> DataFrame:
    """21-mers of the walks, each counted as often as it is walked, without spelling a walk.

    Those inside a node count as often as the node is visited. Those that begin in a step and end beyond it depend
    on the step and the next twenty alone, so they are made once for each distinct stretch of steps.
    """
    k = 21
    visits = steps(spark, folder).groupBy("node_id").agg(F.count(F.lit(1)).alias("visits"))
    per = node_kmers(spark, folder, k).groupBy("node_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    inside = per.join(visits, "node_id").groupBy("kmer").agg(F.sum(F.col("n") * F.col("visits")).alias("n"))
    over = K.border_texts(paths(spark, folder), nodes(spark, folder), k)
    crossing = S.kmer_codes(over, ["stretch", "times"], "text", k).groupBy("kmer").agg(F.sum("times").alias("n"))
    both = inside.unionByName(crossing).groupBy("kmer").agg(F.sum("n").alias("n"))
    return both.withColumn("kmer", S.decode(F.col("kmer"), k))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Key and value of the main counts of the tables."""
    t = load(spark, folder, "carrier_events").agg(F.count(F.lit(1)).alias("event_rows"), F.count_distinct("variant_id").alias("variants"), F.sum("event_bp").alias("event_bp"), F.count_if(F.col("haplotypes").isNull()).alias("without_carriers"))
    return t.unpivot([], ["event_rows", "variants", "event_bp", "without_carriers"], "key", "value")


def hap_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes private to one sample: features whose walks all belong to it."""
    walked = steps(spark, folder, "sample_name")
    return walked.groupBy("node_id").agg(F.count_distinct("sample_name").alias("n"), F.min("sample_name").alias("sample_name"), F.count_distinct("path_name").alias("n_paths")).where("n = 1").drop("n")


_OBS = r"""obs AS (SELECT DISTINCT bubble_id, regexp_replace(path_name, ':\d+-\d+$', '') AS haplotype FROM signed)"""
_SPANS = f"""WITH {SITES}, co AS (SELECT path_name, idx, (e - bp)::BIGINT AS s, e::BIGINT AS e FROM (SELECT s.path_name, s.idx, coalesce(bp, 0) AS bp, sum(coalesce(bp, 0)) OVER (PARTITION BY path_name ORDER BY idx) AS e FROM steps s LEFT JOIN nodes USING (node_id))),
sp AS (SELECT c.path_name, bubble_id, l.e AS lo, r.s AS hi FROM crossed c JOIN co l ON l.path_name = c.path_name AND l.idx = c.left_idx JOIN co r ON r.path_name = c.path_name AND r.idx = c.right_idx)"""
ORACLES = {
    "record_genotypes": f"""WITH {SITES}, {REC}, {_OBS} SELECT r.variant_id, o.haplotype, CASE WHEN c.haplotype IS NULL THEN 0 ELSE 1 END AS gt
FROM records r JOIN obs o USING (bubble_id) LEFT JOIN carriers c ON c.variant_id = r.variant_id AND c.haplotype = o.haplotype""",
    "carrier_reasons": f"""WITH {SITES}, {REC}, {_OBS}, wk AS (SELECT DISTINCT regexp_replace(path_name, ':\\d+-\\d+$', '') AS haplotype FROM paths)
SELECT c.variant_id, CASE WHEN o.haplotype IS NOT NULL THEN 'crosses' WHEN w.haplotype IS NOT NULL THEN 'not_crossed' ELSE 'no_walk' END AS reason, count(*) AS n
FROM carriers c JOIN records r USING (variant_id) LEFT JOIN obs o ON o.bubble_id = r.bubble_id AND o.haplotype = c.haplotype LEFT JOIN wk w ON w.haplotype = c.haplotype GROUP BY ALL""",
    "count_concordance": f"""WITH {COUNTED}, m AS (SELECT kmer, sum(hit_count)::DOUBLE AS mine FROM counted GROUP BY kmer), k AS (SELECT kmer, max(total_count)::DOUBLE AS kept FROM kmer_features WHERE total_count IS NOT NULL GROUP BY kmer)
SELECT count(*) AS n, round(count_if(mine = kept) / count(*), 6) AS equal, round(corr(mine, kept), 6) AS r FROM m JOIN k USING (kmer)""",
    "feature_precision": f"""WITH {COUNTED}, m AS (SELECT kmer AS a, sum(hit_count) AS n FROM counted GROUP BY kmer), k AS (SELECT kmer AS b, max(total_count) AS m FROM kmer_features WHERE kmer IS NOT NULL GROUP BY kmer),
j AS (SELECT *, coalesce(n, m, 0) AS size FROM m FULL OUTER JOIN k ON a = b),
p AS (SELECT CASE WHEN size <= 3 THEN 'low' WHEN size <= 50 THEN 'mid' ELSE 'high' END AS band, count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS tp, count_if(a IS NULL)::BIGINT AS fp, count_if(b IS NULL)::BIGINT AS fn FROM j GROUP BY ALL)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM p""",
    "site_merged": _SPANS
    + """ SELECT path_name, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(coalesce((lo > prev + 10)::INT, 0)) OVER (PARTITION BY path_name ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(hi) OVER (PARTITION BY path_name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sp WHERE hi > lo)) GROUP BY path_name, g""",
    "walked_kmers": f"""WITH {STEPS}, {SPELLED}, w AS (SELECT substring(s, i, 21) AS word FROM (SELECT upper(sequence) AS s, unnest(generate_series(1, length(sequence) - 20)) AS i FROM spelled))
SELECT least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w WHERE regexp_full_match(word, '[ACGT]+') GROUP BY 1""",
    "run_summary": """SELECT unnest(['event_rows', 'variants', 'event_bp', 'without_carriers']) AS key, unnest([a, b, c, d]) AS value FROM (
  SELECT count(*) AS a, count(DISTINCT variant_id) AS b, sum(event_bp)::BIGINT AS c, count_if(haplotypes IS NULL)::BIGINT AS d FROM carrier_events)""",
    "hap_presence": f"WITH {STEPS} SELECT node_id, min(sample_name) AS sample_name, count(DISTINCT path_name) AS n_paths FROM steps GROUP BY node_id HAVING count(DISTINCT sample_name) = 1",
}
QUERIES = {f.__name__: f for f in (
    record_genotypes, carrier_reasons, count_concordance, feature_precision, site_merged, site_disjoint, walked_kmers, run_summary, hap_presence,
)}
