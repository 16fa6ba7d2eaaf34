"""Queries over sites and records: status, interior, wider boundaries, joined pieces, normal forms, inversions, units, private dosages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.operators import intervals as I
from spangraph.operators import recruit as R
from spangraph.operators import sites as T
from spangraph.operators import walks as K
from spangraph.plans.calls import COPIES, copy_numbers, records
from spangraph.plans.compare import _SPANS, _site_spans
from spangraph.plans.recruit import INDEX, KMER, _borders, _index, _node_words, _placed, _words
from spangraph.plans.walks import ORACLES as WALKS
from spangraph.plans.walks import SITES, STEPS, SUPPORT, nodes, path_inversions, paths, read_crossings, site_alleles, site_support, sites, steps, tandem_runs
from spangraph.session import written

SEED = 11


def site_status(spark: SparkSession, folder: str) -> DataFrame:
    return T.status(site_support(spark, folder))


def site_interior(spark: SparkSession, folder: str) -> DataFrame:
    return T.interior(read_crossings(spark, folder))


def sites_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sites found from the walks alone, between nodes that at least half of the graph's walks take, and none twice."""
    return T.backbone_sites(steps(spark, folder, "graph_name"), 0.5)


def site_widened(spark: SparkSession, folder: str) -> DataFrame:
    located = K.coordinates(steps(spark, folder, "graph_name"), nodes(spark, folder))
    return T.widened(sites(spark, folder), located)


def site_rescued(spark: SparkSession, folder: str) -> DataFrame:
    return T.rescued(_site_spans(spark, folder), site_support(spark, folder))


def allele_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """The least left-aligned difference of each allele from the most carried one of its site."""
    texts = T.allele_texts(read_crossings(spark, folder), nodes(spark, folder))
    named = texts.join(site_alleles(spark, folder).select("bubble_id", "signature", "allele"), ["bubble_id", "signature"])
    top = named.where("allele = 1").select("bubble_id", F.col("text").alias("ref"))
    out = T.normalised(named.where("allele > 1").join(top, "bubble_id"), "ref", "text")
    return out.select("bubble_id", "allele", "pos", "homlen", F.length("ref_part").alias("ref_bp"), F.length("alt_part").alias("alt_bp"), F.md5(F.concat("ref_part", F.lit("|"), "alt_part")).alias("digest"))


def insertion_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Inserted sequences by the share of their 11-mers that the graph's nodes hold: a copy of something known, or new."""
    ins = records(spark, folder).where("kind = 'ins' and alt is not null and alt <> '.'").select("variant_id", "alt")
    own = S.kmer_codes(ins, ["variant_id"], "alt", SEED).select("variant_id", "kmer").distinct()
    known = S.kmer_codes(nodes(spark, folder).where("sequence is not null"), ["node_id"], "sequence", SEED).select("kmer", F.lit(1).alias("k")).distinct()
    per = own.join(known, "kmer", "left").groupBy("variant_id").agg(F.count(F.lit(1)).alias("kmers"), F.count("k").alias("shared"))
    return per.select("variant_id", "kmers", "shared", F.when(F.col("shared") >= 0.9 * F.col("kmers"), "DUP").otherwise("NOVEL").alias("subtype"))


def _private(spark: SparkSession, folder: str) -> DataFrame:
    """(locus, kmer, mult) of the k-mers that one locus alone holds, written once, so that the plans that read it stay small."""
    return written(_index(spark, folder).where("outside = 0").select("locus", "kmer", "mult"), "private")


def _private_hits(spark: SparkSession, folder: str, private: DataFrame) -> DataFrame:
    return _placed(spark, folder).join(private.select("locus", "kmer"), "kmer").select("path_name", "locus", "pos")


def private_dosage(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each locus in each walk: hits on the k-mers that only the locus holds, over their occurrences in it."""
    private = _private(spark, folder)
    size = private.groupBy("locus").agg(F.sum("mult").alias("private_kmers"))
    per_node = written(R.node_hits(private.select("locus", "kmer"), _node_words(spark, folder)), "node_hits")
    hits = R.walk_hits(private.select("locus", "kmer"), per_node, steps(spark, folder), _borders(spark, folder))
    share = F.col("hits") / F.col("private_kmers")
    return hits.join(size, "locus").select("path_name", "locus", "hits", "private_kmers", F.round(share, 6).alias("dosage"), F.floor(share + 0.5).cast("long").alias("cn"))


def private_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of private hits along a walk; hits further apart than 200 bases and a hundredth of the locus begin a new one."""
    bases = _index(spark, folder).groupBy("locus").agg((F.sum("mult") / 100).cast("long").alias("near"))
    rows = _private_hits(spark, folder, _private(spark, folder)).join(bases, "locus").withColumn("gap", F.greatest(F.col("near"), F.lit(200).cast("long"))).withColumn("end", F.col("pos") + KMER)
    linked = I.islands(rows, ["path_name", "locus"], "pos", "end", F.col("gap"))
    return linked.groupBy("path_name", "locus", "island").agg(F.min("pos").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("hits")).drop("island")


def copy_split(spark: SparkSession, folder: str) -> DataFrame:
    """What a walk's change at a repeat is made of: whole copies, something else, both, or nothing."""
    copies, other = F.abs(F.col("cn") - F.col("ref_cn")) >= 0.5, F.abs(F.coalesce("cnresid", F.lit(0.0))) >= 50
    kind = F.when(copies & other, "copies_and_other").when(copies, "copies").when(other, "other").otherwise("same")
    return copy_numbers(spark, folder).select("input_bubble_id", "path_name", kind.alias("kind"), "cnbp", "cnresid")


def allele_split(spark: SparkSession, folder: str) -> DataFrame:
    """A walk's crossings of a site split between the two most carried alleles, by the median over their discriminating positions."""
    crossed = read_crossings(spark, folder).groupBy("bubble_id", "path_name", "signature").agg(F.count(F.lit(1)).alias("times"))
    return T.allele_split(written(crossed, "crossed"), nodes(spark, folder), SEED)


def walk_inversions(spark: SparkSession, folder: str) -> DataFrame:
    runs = path_inversions(spark, folder).join(paths(spark, folder).select("path_name", "graph_name"), "path_name")
    return T.inversions(runs)


def tandem_units(spark: SparkSession, folder: str) -> DataFrame:
    n = paths(spark, folder).agg(F.count(F.lit(1)))
    return T.tandem_units(tandem_runs(spark, folder), K.step_arrays(paths(spark, folder)), n)


def node_order(spark: SparkSession, folder: str) -> DataFrame:
    return T.node_order(steps(spark, folder, "graph_name"))


def step_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A 60-bit token of each distinct oriented step."""
    token = F.conv(F.substring(F.md5("step"), 1, 15), 16, 10).cast("bigint")
    return steps(spark, folder).select("step").distinct().select("step", token.alias("token"))


_COORD = "co AS (SELECT graph_name, path_name, idx, node_id, reverse, (e - bp)::BIGINT AS s, e::BIGINT AS e FROM (SELECT s.*, coalesce(bp, 0) AS bp, sum(coalesce(bp, 0)) OVER (PARTITION BY path_name ORDER BY idx) AS e FROM steps s LEFT JOIN nodes USING (node_id)))"
_REF = "rp AS (SELECT graph_name, min(path_name) AS path_name FROM steps GROUP BY graph_name)"
_PRIV = f"""{INDEX}, wk AS (SELECT path_name, upper(sequence) AS sequence FROM spelled WHERE length(sequence) >= {KMER}),
pw AS ({_words('wk', 'path_name')}), ph AS (SELECT path_name, locus, pos FROM pw JOIN idx USING (kmer) WHERE outside = 0)"""
_CANON = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"
_TEXTS = """al AS (SELECT bubble_id, signature, any_value(inside) AS inside, row_number() OVER (PARTITION BY bubble_id ORDER BY count(DISTINCT path_name) DESC, signature) AS allele FROM signed GROUP BY bubble_id, signature),
pc AS (SELECT bubble_id, allele, i, CASE WHEN x LIKE '<%' THEN reverse(translate(t, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd')) ELSE t END AS t FROM (
  SELECT bubble_id, allele, i, x, coalesce(sequence, repeat('N', bp::INT), '') AS t FROM (SELECT bubble_id, allele, inside[i] AS x, i FROM (SELECT *, unnest(generate_series(1, len(inside))) AS i FROM al)) LEFT JOIN nodes n ON n.node_id = x[2:])),
tx AS (SELECT al.bubble_id, al.allele, upper(coalesce(string_agg(t, '' ORDER BY i), '')) AS t FROM al LEFT JOIN pc USING (bubble_id, allele) GROUP BY ALL)"""
ORACLES = {
    "site_status": f"""WITH {SUPPORT} SELECT bubble_id, CASE WHEN path_support < 3 THEN 'few_paths' WHEN distinct_alleles < 2 THEN 'one_allele' WHEN alt_support_max < 2 THEN 'rare_alternative'
  WHEN max_inside_bp > 100000 THEN 'too_long' WHEN max_inside_bp < 50 AND NOT inversion_signal THEN 'too_short' ELSE 'kept' END AS status FROM support""",
    "site_interior": f"WITH {SITES} SELECT bubble_id, x[2:] AS node_id, count(DISTINCT path_name) AS n_paths FROM (SELECT bubble_id, path_name, unnest(inside) AS x FROM signed) GROUP BY ALL",
    "sites_found": f"""WITH {STEPS}, {_REF}, pc AS (SELECT graph_name, node_id, path_name, count(*) AS n FROM steps GROUP BY ALL),
fm AS (SELECT graph_name, node_id FROM pc JOIN (SELECT graph_name, count(DISTINCT path_name) AS a FROM steps GROUP BY graph_name) USING (graph_name) GROUP BY graph_name, node_id HAVING max(n) = 1 AND count(*) >= 0.5 * any_value(a)),
en AS (SELECT graph_name, path_name, idx, node_id, reverse, lead(node_id) OVER w AS tn, lead(reverse) OVER w AS tr, lead(idx) OVER w AS ti FROM steps JOIN fm USING (graph_name, node_id) WINDOW w AS (PARTITION BY graph_name, path_name ORDER BY idx)),
wd AS (SELECT graph_name, least(node_id, tn) AS lo, greatest(node_id, tn) AS hi FROM en WHERE tn IS NOT NULL GROUP BY ALL HAVING max(ti - idx) > 1),
kp AS (SELECT en.* FROM en JOIN rp USING (graph_name, path_name) JOIN wd ON wd.graph_name = en.graph_name AND wd.lo = least(node_id, tn) AND wd.hi = greatest(node_id, tn))
SELECT ('0x' || md5(graph_name)[1:10])::BIGINT * 1048576 + row_number() OVER (PARTITION BY graph_name ORDER BY idx) AS bubble_id, graph_name, node_id AS source_node,
  CASE WHEN reverse THEN '-' ELSE '+' END AS source_orient, tn AS sink_node, CASE WHEN tr THEN '-' ELSE '+' END AS sink_orient FROM kp""",
    "site_widened": f"""WITH {SITES}, {_COORD}, {_REF},
vi AS (SELECT node_id, max(n) AS most FROM (SELECT node_id, path_name, count(*) AS n FROM steps GROUP BY ALL) GROUP BY node_id),
rf AS (SELECT co.*, most, count(*) OVER (PARTITION BY graph_name, node_id) AS n FROM co JOIN rp USING (graph_name, path_name) JOIN vi USING (node_id)),
pr AS (SELECT si.bubble_id, a.graph_name AS g, source_node, sink_node, a.idx AS ai, b.idx AS bi, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e FROM sites si JOIN rf a ON a.node_id = source_node AND a.n = 1 JOIN rf b ON b.node_id = sink_node AND b.n = 1 AND b.graph_name = a.graph_name),
mv AS (SELECT pr.*, (SELECT max(idx) FROM rf WHERE graph_name = g AND most = 1 AND idx <= least(ai, bi)) AS li, (SELECT min(idx) FROM rf WHERE graph_name = g AND most = 1 AND idx >= greatest(ai, bi)) AS hi FROM pr),
fn AS (SELECT bubble_id, ai <= bi AS fw, l.node_id AS ln, h.node_id AS hn, least(a_e, b_e) - l.e + h.s - greatest(a_s, b_s) AS moved_bp FROM mv JOIN rf l ON l.graph_name = g AND l.idx = li JOIN rf h ON h.graph_name = g AND h.idx = hi)
SELECT bubble_id, CASE WHEN fw THEN ln ELSE hn END AS source_node, CASE WHEN fw THEN hn ELSE ln END AS sink_node, moved_bp FROM fn WHERE moved_bp <= 100000""",
    "site_rescued": _SPANS.replace(f"WITH {SITES}", f"WITH {SUPPORT}")
    + """, rw AS (SELECT sp.*, max_inside_bp AS bp, sum((max_inside_bp >= 50)::INT) OVER (PARTITION BY path_name ORDER BY lo, hi, bubble_id RANGE UNBOUNDED PRECEDING) AS fence FROM sp JOIN support USING (bubble_id)),
gp AS (SELECT *, sum(coalesce((lo > p + 1000)::INT, 0)) OVER (PARTITION BY path_name, fence ORDER BY lo, hi, bubble_id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(hi) OVER (PARTITION BY path_name, fence ORDER BY lo, hi, bubble_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM rw WHERE bp < 50))
SELECT path_name, min(lo) AS lo, max(hi) AS hi, count(*) AS n_sites, sum(bp)::BIGINT AS bp FROM gp GROUP BY path_name, fence, g HAVING count(*) > 1 AND sum(bp) >= 50""",
    "allele_normalised": f"""WITH {SITES}, {_TEXTS},
pp AS (SELECT a.bubble_id, a.allele, r.t AS r, a.t AS a, least(length(r.t), length(a.t)) AS m FROM tx a JOIN tx r ON r.bubble_id = a.bubble_id AND r.allele = 1 WHERE a.allele > 1),
tl AS (SELECT *, len(list_filter(generate_series(1, m), lambda n: right(r, n) = right(a, n))) AS tail, len(list_filter(generate_series(1, m), lambda n: left(r, n) = left(a, n))) AS head FROM pp),
ct AS (SELECT *, left(r, (length(r) - tail)::BIGINT) AS r2, left(a, (length(a) - tail)::BIGINT) AS a2 FROM tl),
ps AS (SELECT *, len(list_filter(generate_series(1, least(length(r2), length(a2))), lambda n: left(r2, n) = left(a2, n))) AS pos FROM ct),
fn AS (SELECT *, substring(r2, pos + 1) AS rp, substring(a2, pos + 1) AS ap FROM ps)
SELECT bubble_id, allele, pos, CASE WHEN (rp = '') <> (ap = '') THEN head - pos ELSE 0 END AS homlen, length(rp) AS ref_bp, length(ap) AS alt_bp, md5(rp || '|' || ap) AS digest FROM fn""",
    "insertion_novelty": f"""WITH {STEPS}, ins AS (SELECT variant_id, upper(alt) AS s FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY row_no) AS r FROM carrier_events WHERE variant_id IS NOT NULL) WHERE r = 1 AND kind = 'ins' AND alt IS NOT NULL AND alt <> '.'),
iw AS (SELECT DISTINCT variant_id, {_CANON} AS k FROM (SELECT variant_id, substring(s, i, {SEED}) AS w FROM (SELECT *, unnest(generate_series(1, length(s) - {SEED - 1})) AS i FROM ins)) WHERE regexp_full_match(w, '[ACGT]+')),
nw AS (SELECT DISTINCT {_CANON} AS k FROM (SELECT substring(s, i, {SEED}) AS w FROM (SELECT upper(sequence) AS s, unnest(generate_series(1, length(sequence) - {SEED - 1})) AS i FROM nodes)) WHERE regexp_full_match(w, '[ACGT]+'))
SELECT variant_id, count(*) AS kmers, count(nw.k) AS shared, CASE WHEN count(nw.k) >= 0.9 * count(*) THEN 'DUP' ELSE 'NOVEL' END AS subtype FROM iw LEFT JOIN nw USING (k) GROUP BY variant_id""",
    "private_dosage": f"""{_PRIV}, sz AS (SELECT locus, sum(mult)::BIGINT AS private_kmers FROM idx WHERE outside = 0 GROUP BY locus)
SELECT path_name, locus, count(*) AS hits, any_value(private_kmers) AS private_kmers, round(count(*) / any_value(private_kmers), 6) AS dosage, floor(count(*) / any_value(private_kmers) + 0.5)::BIGINT AS cn FROM ph JOIN sz USING (locus) GROUP BY path_name, locus""",
    "private_runs": f"""{_PRIV}, gp AS (SELECT locus, greatest(sum(mult)::BIGINT // 100, 200) AS gap FROM idx GROUP BY locus),
rn AS (SELECT *, sum(coalesce((pos > p + {KMER} + gap)::INT, 0)) OVER (PARTITION BY path_name, locus ORDER BY pos) AS g FROM (SELECT ph.*, gap, lag(pos) OVER (PARTITION BY path_name, locus ORDER BY pos) AS p FROM ph JOIN gp USING (locus)))
SELECT path_name, locus, min(pos) AS lo, max(pos) + {KMER} AS hi, count(*) AS hits FROM rn GROUP BY path_name, locus, g""",
    "copy_split": COPIES + """ SELECT input_bubble_id, path_name, CASE WHEN abs(cn - ref_cn) >= 0.5 AND abs(coalesce(cnresid, 0)) >= 50 THEN 'copies_and_other' WHEN abs(cn - ref_cn) >= 0.5 THEN 'copies'
  WHEN abs(coalesce(cnresid, 0)) >= 50 THEN 'other' ELSE 'same' END AS kind, cnbp, cnresid FROM cn""",
    "walk_inversions": f"""WITH ru AS ({WALKS['path_inversions']}), rg AS (SELECT DISTINCT path_name, graph_name FROM graph_paths WHERE steps IS NOT NULL AND steps NOT IN ('*', '')),
nr AS (SELECT *, lag(backward) OVER w AS pb, lag(ref_hi) OVER w AS ph, lead(backward) OVER w AS nb, lead(ref_lo) OVER w AS nl FROM ru WINDOW w AS (PARTITION BY path_name ORDER BY run)),
fo AS (SELECT graph_name, path_name, ref_lo AS lo, ref_hi + 1 AS hi FROM nr JOIN rg USING (path_name) WHERE backward AND NOT pb AND NOT nb AND ph < ref_lo AND nl > ref_hi),
il AS (SELECT *, sum(coalesce((lo >= p)::INT, 0)) OVER (PARTITION BY graph_name ORDER BY lo, hi, path_name ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(hi) OVER (PARTITION BY graph_name ORDER BY lo, hi, path_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fo))
SELECT graph_name, min(lo) AS lo, max(hi) AS hi, count(DISTINCT path_name) AS n_paths FROM il GROUP BY graph_name, g""",
    "tandem_units": f"""WITH tr AS ({WALKS['tandem_runs']}), {STEPS},
cu AS (SELECT tr.path_name, period, copies, w[first_idx + 1:first_idx + period] AS u FROM tr JOIN paths USING (path_name)),
bo AS (SELECT *, u AS v FROM cu UNION ALL SELECT *, list_transform(list_reverse(u), lambda s: translate(s[1:1], '<>', '><') || s[2:]) FROM cu),
sp AS (SELECT path_name, period, copies, u, array_to_string(list_concat(v[i:], v[1:i - 1]), '') AS t FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM bo)),
un AS (SELECT path_name, period, copies, u, min(t) AS unit FROM sp GROUP BY ALL),
pe AS (SELECT unit, period, path_name, max(copies) AS copies FROM un GROUP BY ALL)
SELECT unit, period, count(*) AS n_paths, min(copies) AS min_copies, max(copies) AS max_copies, count(*) >= 0.5 * (SELECT count(*) FROM paths) AS prevalent FROM pe GROUP BY unit, period""",
    "allele_split": f"""WITH {SITES}, {_TEXTS},
sg AS (SELECT bubble_id, signature, row_number() OVER (PARTITION BY bubble_id ORDER BY count(DISTINCT path_name) DESC, signature) AS allele FROM signed GROUP BY bubble_id, signature),
km AS (SELECT bubble_id, allele, i, {_CANON} AS k FROM (SELECT bubble_id, allele, i, substring(t, i, {SEED}) AS w FROM (SELECT *, unnest(generate_series(1, length(t) - {SEED - 1})) AS i FROM tx)) WHERE regexp_full_match(w, '[ACGT]+')),
sd AS (SELECT *, count(DISTINCT allele) OVER (PARTITION BY bubble_id, k) = 2 AS shared FROM km WHERE allele <= 2),
rg AS (SELECT *, coalesce(last_value(CASE WHEN shared THEN k END IGNORE NULLS) OVER (PARTITION BY bubble_id, allele ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
  coalesce(first_value(CASE WHEN shared THEN k END IGNORE NULLS) OVER (PARTITION BY bubble_id, allele ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM sd),
ow AS (SELECT DISTINCT bubble_id, lo, hi, allele, k FROM rg WHERE NOT shared),
sz AS (SELECT bubble_id, lo, hi, count_if(allele = 1) AS na, count_if(allele = 2) AS nb FROM ow GROUP BY ALL HAVING count_if(allele = 1) > 0 AND count_if(allele = 2) > 0),
wd AS (SELECT s.bubble_id, path_name, k, count(*) AS n FROM signed s JOIN sg USING (bubble_id, signature) JOIN km ON km.bubble_id = s.bubble_id AND km.allele = sg.allele GROUP BY ALL),
ht AS (SELECT bubble_id, path_name, lo, hi, sum(CASE WHEN allele = 1 THEN n ELSE 0 END) / any_value(na) AS a, sum(CASE WHEN allele = 2 THEN n ELSE 0 END) / any_value(nb) AS b FROM ow JOIN sz USING (bubble_id, lo, hi) JOIN wd USING (bubble_id, k) GROUP BY ALL),
sh AS (SELECT bubble_id, path_name, count(*) AS usable, quantile_cont(a / (a + b), 0.5) AS share FROM ht WHERE a + b >= 0.5 GROUP BY ALL),
tt AS (SELECT bubble_id, path_name, count(*) AS total FROM signed GROUP BY ALL),
cn AS (SELECT *, least(total, floor(round(share * total, 9) + 0.5)::BIGINT) AS cn_a FROM sh JOIN tt USING (bubble_id, path_name))
SELECT bubble_id, path_name, total, usable, round(share, 6) AS share, cn_a, total - cn_a AS cn_b FROM cn""",
    "node_order": f"""WITH {STEPS}, {_REF}, rf AS (SELECT graph_name, node_id, min(idx) AS ri, arg_min(reverse, idx) AS rr FROM steps JOIN rp USING (graph_name, path_name) GROUP BY ALL),
bk AS (SELECT s.graph_name, s.node_id, ri, rr, coalesce(ri, last_value(ri IGNORE NULLS) OVER (PARTITION BY s.graph_name, path_name ORDER BY idx ROWS UNBOUNDED PRECEDING), -1) AS b FROM steps s LEFT JOIN rf ON rf.graph_name = s.graph_name AND rf.node_id = s.node_id),
nd AS (SELECT graph_name, node_id, min(b) AS bucket, coalesce(bool_or(rr), false) AS flipped, max(ri) IS NOT NULL AS known FROM bk GROUP BY ALL)
SELECT graph_name, node_id, bucket, flipped, row_number() OVER (PARTITION BY graph_name ORDER BY bucket, known DESC, node_id) AS rank FROM nd""",
    "step_tokens": f"WITH {STEPS} SELECT DISTINCT step, ('0x' || md5(step)[1:15])::BIGINT AS token FROM steps",
}
QUERIES = {f.__name__: f for f in (
    sites_found, site_status, site_interior, site_widened, site_rescued, allele_normalised, insertion_novelty, private_dosage, private_runs, copy_split, allele_split, walk_inversions,
    tandem_units, node_order, step_tokens,
)}
