"""Queries of the k-mer store and of read classification.

Loci are graphs. Fragments are windows of 150 bases of the spelled walks, so that they grow
with the walks; k-mers have 21 bases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.operators import recruit as R
from spangraph.operators import walks as K
from spangraph.plans.heavy_keys import COUNTED, counted_hits
from spangraph.plans.walks import SPELLED, STEPS, blocks, nodes, paths, steps
from spangraph.session import fresh_folder, written
from spangraph.streaming.streams import hit_stream, store_stream
from spangraph.tables import load

KMER, SMER, WINDOW, BLOCK = 21, 7, 150, 15_000
ERROR = 0.01  # of a walk's window, which has no qualities


def _node_texts(spark: SparkSession, folder: str) -> DataFrame:
    graphs = load(spark, folder, "graph_nodes").groupBy("node_id").agg(F.min("graph_name").alias("locus"))
    return nodes(spark, folder).where("sequence is not null").join(graphs, "node_id").select("locus", "node_id", F.upper("sequence").alias("sequence"))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.counted_words(_node_texts(spark, folder), ["locus", "node_id"], "sequence", KMER, SMER)


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """(path_name, win, sequence): the windows of each spelled walk; a last shorter one is kept from 21 bases on."""
    return _windows(blocks(spark, folder, BLOCK))


def _windows(texts: DataFrame) -> DataFrame:
    """The windows of walks in blocks of ``BLOCK`` bases."""
    cut = F.regexp_extract_all(F.upper(F.left("text", F.lit(BLOCK))), F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
    made = texts.select("path_name", "block", F.posexplode(cut).alias("i", "sequence"))
    win = (F.col("block") * (BLOCK // WINDOW) + F.col("i")).cast("int")
    return made.select("path_name", win.alias("win"), "sequence").where(F.length("sequence") >= KMER)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """(path_name, home, pos, kmer): the k-mers of the walks, with the locus of each walk."""
    made = S.kmer_codes(blocks(spark, folder, overlap=KMER - 1), ["path_name", "start_bp"], "text", KMER)
    made = made.select("path_name", (F.col("start_bp") + F.col("pos")).alias("pos"), "kmer")
    return made.join(paths(spark, folder).select("path_name", F.col("graph_name").alias("home")), "path_name").select("path_name", "home", "pos", "kmer")


def _node_words(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, pos, kmer): the k-mers inside nodes."""
    return R.words(nodes(spark, folder).where("sequence is not null"), ["node_id"], "sequence", KMER)


def _borders(spark: SparkSession, folder: str) -> DataFrame:
    """(path_name, pos, kmer): the k-mers over the ends of steps."""
    return R.border_kmers(blocks(spark, folder, BLOCK, KMER - 1), KMER)


def walk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of the walks that are classified: length and digest."""
    return fragments(spark, folder).select("path_name", "win", F.length("sequence").alias("bp"), F.md5("sequence").alias("digest"))


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return R.locus_index(_counts(spark, folder), KMER).select("kmer", "locus", "mult", "outside", "cls", "screen")


def locus_index(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).withColumn("kmer", S.decode(F.col("kmer"), KMER))


class _Parts:
    """What decoys and evidence are made of, each written once: the index, the walks in blocks, their steps, and the k-mers inside nodes and over the ends of steps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.index = written(_index(spark, folder), "index")
        self.blocks = written(blocks(spark, folder, BLOCK, KMER - 1), "blocks")
        self.borders = written(R.border_kmers(self.blocks, KMER), "borders")
        self.steps = written(K.coordinates(steps(spark, folder), nodes(spark, folder)).where("end_bp > start_bp").select("path_name", "node_id", "reverse", "start_bp", "end_bp"), "steps")
        self.nodes = nodes(spark, folder).where("sequence is not null").select("node_id", F.upper("sequence").alias("sequence"))
        self.words = written(R.words(self.nodes, ["node_id"], "sequence", KMER), "words")
        homes = paths(spark, folder).select("path_name", F.col("graph_name").alias("home"))
        places = written(R.shared_places(self.index, self.words, self.steps, self.borders, homes, KMER), "places")
        self.decoys = R.decoy_kmers(self.index, places, self.blocks, KMER, BLOCK)


def locus_decoys(spark: SparkSession, folder: str) -> DataFrame:
    """K-mers of stretches of other loci that resemble a locus, and that the locus does not hold."""
    return _Parts(spark, folder).decoys.withColumn("kmer", S.decode(F.col("kmer"), KMER))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    made = _Parts(spark, folder)
    index = R.with_decoys(made.index, written(made.decoys, "decoys"))
    rows = R.labelled_windows(made.steps, made.nodes, made.words, made.borders, _windows(made.blocks), index, KMER, WINDOW)
    return R.evidence(written(rows, "labels"), KMER, ERROR)


def recruit_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return R.verdict(_evidence(spark, folder), KMER, error=ERROR)


def recruit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments by locus, fate and reason, with subtotals."""
    return recruit_evidence(spark, folder).rollup("locus", "fate", "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def recruit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring windows of a walk judged as the mates of a pair."""
    mates = _evidence(spark, folder).withColumn("pair", F.floor(F.col("win") / 2)).withColumn("mate", F.col("win") % 2 + 1)
    return R.pooled(mates, ["path_name", "pair"], "mate", KMER, error=ERROR)


def window_ceilings(spark: SparkSession, folder: str) -> DataFrame:
    """Per walk, the share of windows of 150 bases that could be told apart by private k-mers of the walk's locus."""
    # written, so that the plan of the windows does not hold that of the index and of the steps
    at = written(K.coordinates(steps(spark, folder), nodes(spark, folder)).select("path_name", "node_id", "reverse", "start_bp", "end_bp"), "steps")
    ends = at.groupBy("path_name").agg(F.max("end_bp").alias("n_bases"))
    lengths = ends.join(paths(spark, folder).select("path_name", F.col("graph_name").alias("home")), "path_name")
    private = written(_index(spark, folder).where("cls = 'P'").select("locus", "kmer", "cls"), "private")
    runs = written(R.private_runs(private, _node_words(spark, folder)), "runs")
    spans = R.private_spans(private, runs, at.where("end_bp > start_bp"), _borders(spark, folder), lengths, KMER)
    out = R.ceilings(spans, lengths, KMER, WINDOW)
    return out.select("locus", "path_name", "windows", F.round("private_3", 6).alias("private_3"), F.round("sites_2", 6).alias("sites_2"))


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """For each cut of independent private sites: windows of other loci that it would call certain, and which cut is chosen at one in 10 000."""
    home = paths(spark, folder).select("path_name", "graph_name")
    rows = _evidence(spark, folder).join(home, "path_name").select("sites_p", R.certain(0, KMER, ERROR).alias("fit"), (F.col("locus") == F.col("graph_name")).alias("own"))
    counted = R.false_certain(rows)
    chosen = R.calibrated_cut(counted, 0.0001).select(F.struct(F.col("cut").alias("c"), "met").alias("s")).scalar()
    return counted.withColumn("__s", chosen).select("cut", "false_certain", "screened", (F.col("cut") == F.col("__s.c")).alias("chosen"), F.col("__s.met").alias("met"))


def store_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The store's segments merged: each k-mer's count over all segments and the number of segments that hold it."""
    hits = counted_hits(spark, folder, "kmer", "segment_name", "hit_count")
    per = hits.where("segment_name is not null").groupBy("segment_name", "kmer").agg(F.sum("hit_count").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("segments"))


def store_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The k-mers of the feature map looked up in the merged store; 0 where it has none."""
    wanted = load(spark, folder, "kmer_features").select("kmer").where("kmer is not null").distinct()
    return wanted.join(store_merged(spark, folder), "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def store_sealed_check(spark: SparkSession, folder: str) -> DataFrame:
    """Sealed figures of each segment against what the hits hold now."""
    hits = counted_hits(spark, folder, "kmer", "segment_name", "hit_count").where("segment_name is not null")
    per = hits.groupBy("segment_name", "kmer").agg(F.sum("hit_count").alias("n"))
    now = per.groupBy("segment_name").agg(F.sum("n").alias("occurrences_now"), F.count(F.lit(1)).alias("distinct_now"))
    sealed = load(spark, folder, "store_segments").select("segment_name", "occurrences", "distinct_kmers")
    both = sealed.join(now, "segment_name", "full_outer")
    return both.select("segment_name", "occurrences", F.coalesce("occurrences_now", F.lit(0)).alias("occurrences_now"), "distinct_kmers", F.coalesce("distinct_now", F.lit(0)).alias("distinct_now"))


def stream_store(spark: SparkSession, folder: str) -> DataFrame:
    """The hits streamed in micro-batches into a store, then read back: (kmer, n)."""
    base = fresh_folder(spark, "stream")
    store_stream(hit_stream(spark, f"{folder}/kmer_hits.parque[t]"), f"{base}/store", f"{base}/state")
    return spark.read.parquet(f"{base}/store/segment=*").groupBy("kmer").agg(F.sum("n").alias("n"))


def _canon(m: str) -> str:
    return f"least({m}, reverse(translate({m}, 'ACGT', 'TGCA')))"


def _syncs(table: str, keys: str) -> str:
    from spangraph.plans.sequences import _code, _mix

    return f"""SELECT {keys}, pos FROM (SELECT {keys}, pos, h, min(h) OVER a AS low, count(h) OVER a AS n, lead(h, {KMER - SMER}) OVER (PARTITION BY {keys} ORDER BY pos) AS last FROM (
    SELECT {keys}, pos, CASE WHEN regexp_full_match(word, '[ACGT]+') THEN {_mix(_code(_canon("regexp_replace(word, '[^ACGT]', 'A', 'g')")))} END AS h
    FROM (SELECT {keys}, i - 1 AS pos, substring(sequence, i, {SMER}) AS word FROM (SELECT *, unnest(generate_series(1, length(sequence) - {SMER - 1})) AS i FROM {table})))
    WINDOW a AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {KMER - SMER} FOLLOWING)) WHERE n = {KMER - SMER + 1} AND (h = low OR last = low)"""


def _words(table: str, keys: str) -> str:
    return f"""SELECT {keys}, pos, {_canon('word')} AS kmer FROM (SELECT {keys}, i - 1 AS pos, substring(sequence, i, {KMER}) AS word
    FROM (SELECT *, unnest(generate_series(1, length(sequence) - {KMER - 1})) AS i FROM {table})) WHERE regexp_full_match(word, '[ACGT]+')"""


INDEX = f"""WITH {STEPS}, {SPELLED},
txt AS (SELECT g.locus, node_id, upper(sequence) AS sequence FROM nodes JOIN (SELECT node_id, min(graph_name) AS locus FROM graph_nodes GROUP BY node_id) g USING (node_id) WHERE sequence IS NOT NULL),
nw AS ({_words('txt', 'locus, node_id')}), cnt AS (SELECT locus, kmer, count(*) AS mult FROM nw GROUP BY ALL),
tot AS (SELECT kmer, sum(mult)::BIGINT AS total FROM cnt GROUP BY kmer),
tri AS (SELECT kmer, sum(c * (c - 1) / 2) / {KMER - 3} AS d FROM (SELECT kmer, substring(kmer, j, 3) AS t, count(*) AS c FROM (SELECT kmer, unnest(generate_series(1, {KMER - 2})) AS j FROM tot) GROUP BY ALL) GROUP BY kmer),
idx AS (SELECT locus, kmer, mult, total - mult AS outside, CASE WHEN total = mult AND d < 2.5 THEN 'P' WHEN total - mult <= 2 THEN 'S' ELSE 'R' END AS cls FROM cnt JOIN tot USING (kmer) JOIN tri USING (kmer))"""
FRAGMENTS = f"""frag AS (SELECT path_name, w AS win, substring(upper(sequence), w * {WINDOW} + 1, {WINDOW}) AS sequence FROM (SELECT *, unnest(generate_series(0, (length(sequence) - 1) // {WINDOW})) AS w FROM spelled)
  WHERE length(substring(sequence, w * {WINDOW} + 1, {WINDOW})) >= {KMER})"""
DECOYS = f"""wk AS (SELECT p.graph_name AS home, s.path_name, upper(sequence) AS sequence FROM spelled s JOIN paths p USING (path_name) WHERE length(sequence) >= {KMER}),
pw AS ({_words('wk', 'path_name, home')}),
dh AS (SELECT path_name, locus, pos FROM pw JOIN idx USING (kmer) WHERE cls = 'S' AND locus <> home),
dg AS (SELECT *, sum(coalesce((pos > p + 1501)::INT, 0)) OVER (PARTITION BY path_name, locus ORDER BY pos) AS g FROM (SELECT *, lag(pos) OVER (PARTITION BY path_name, locus ORDER BY pos) AS p FROM dh)),
dw AS (SELECT path_name, locus, min(pos) - 50 AS lo, max(pos) + 51 AS hi FROM dg GROUP BY path_name, locus, g HAVING count(*) >= 20),
dk AS (SELECT DISTINCT locus, kmer FROM pw JOIN dw USING (path_name) WHERE pos >= lo AND pos < hi AND NOT EXISTS (SELECT 1 FROM idx i WHERE i.locus = dw.locus AND i.kmer = pw.kmer))"""
_Q = (1 - ERROR - 0.001) ** KMER
GAP, FLANK = 0.5 * _Q / (1 - _Q), 0.25 * _Q


def _greedy(positions: str) -> str:
    """Places of a sorted list at least k from the last one taken."""
    return f"""CASE WHEN {positions} IS NULL THEN 0 ELSE (list_reduce(list_transform({positions}, lambda x: {{'n': 1, 'last': x}}), lambda a, b: CASE WHEN b.last - a.last >= {KMER} THEN {{'n': a.n + 1, 'last': b.last}} ELSE a END)).n END"""


def _certain(least: int, p: str = "") -> str:
    lam = f"(({ERROR} + 0.001) * {p}seg_kmers)"
    return f"({p}seg_kmers > 0 AND {p}kmers * 2 >= {p}windows AND {p}runs_n <= {lam} + 3.1 * sqrt({lam}) + 2.0 AND {p}sites_p >= {least} AND {p}sites_d <= 0.05 * {p}sites_p AND {p}sites_p >= 0.05 * {p}seg_kmers / {KMER})"


def _reason(sure: str) -> str:
    lam = f"(({ERROR} + 0.001) * seg_kmers)"
    return f"""CASE WHEN {sure} THEN CASE WHEN status = 'part' THEN 'partial' ELSE '.' END WHEN sites_p = 0 AND sites_d + decoy_out >= 2 THEN 'homolog' WHEN sites_p >= 1 AND sites_d + decoy_out >= 1 THEN 'conflict'
  WHEN sites_p >= 1 AND kmers * 2 < windows THEN 'uncallable' WHEN sites_p >= 1 AND runs_n > {lam} + 3.1 * sqrt({lam}) + 2.0 THEN 'divergent' WHEN sites_p >= 2 THEN 'sparse' WHEN sites_p >= 1 THEN 'single_site' WHEN n_s >= 1 THEN 'shared_only' ELSE 'no_evidence' END"""


def _fate(sure: str) -> str:
    return f"CASE WHEN {sure} THEN 'certain' WHEN reason IN ('homolog', 'no_evidence') THEN 'unrecruited' ELSE 'ambiguous' END"


_U = "PARTITION BY path_name, win, locus"
EVIDENCE = f"""{INDEX},
{FRAGMENTS}, {DECOYS},
allk AS (SELECT locus, kmer, cls FROM idx UNION ALL SELECT locus, kmer, 'D' FROM dk),
ns AS ({_syncs('txt', 'locus, node_id')}), fs AS ({_syncs('frag', 'path_name, win')}), fw AS ({_words('frag', 'path_name, win')}),
scr AS (SELECT DISTINCT f.path_name, f.win, n.locus FROM (SELECT DISTINCT locus, kmer FROM nw JOIN ns USING (locus, node_id, pos)) n JOIN (SELECT path_name, win, kmer FROM fw JOIN fs USING (path_name, win, pos)) f USING (kmer)),
lab AS (SELECT fw.path_name, fw.win, scr.locus, pos, coalesce(cls, 'N') AS cls, row_number() OVER (PARTITION BY fw.path_name, fw.win, scr.locus ORDER BY pos) - 1 AS ci
  FROM fw JOIN scr USING (path_name, win) LEFT JOIN allk i ON i.locus = scr.locus AND i.kmer = fw.kmer),
r1 AS (SELECT *, coalesce((cls = 'N' AND (lag(cls) OVER w <> 'N' OR lag(pos) OVER w <> pos - 1))::INT, (cls = 'N')::INT) AS new FROM lab WINDOW w AS ({_U} ORDER BY pos)),
r2 AS (SELECT *, sum(new) OVER ({_U} ORDER BY pos) AS run FROM r1),
r3 AS (SELECT *, CASE WHEN cls = 'D' THEN -2.0::DOUBLE WHEN cls <> 'N' THEN 1.0 WHEN row_number() OVER (PARTITION BY path_name, win, locus, run, cls ORDER BY pos) <= {KMER} THEN 0.0 ELSE -{GAP}::DOUBLE END AS x FROM r2),
r4 AS (SELECT *, round(sum(x) OVER ({_U} ORDER BY pos), 9) AS s FROM r3),
r5 AS (SELECT *, min({{'s': s, 'm': -ci}}) OVER ({_U} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM r4),
r6 AS (SELECT *, CASE WHEN low IS NULL OR low.s > 0 THEN 0 ELSE 1 - low.m END AS f, s - CASE WHEN low IS NULL OR low.s > 0 THEN 0 ELSE low.s END AS b FROM r5),
r7 AS (SELECT *, row_number() OVER ({_U} ORDER BY round(b, 6) DESC, ci - f DESC, ci) AS r FROM r6),
sg AS (SELECT path_name, win, locus, f, ci AS l FROM r7 WHERE r = 1 AND b > 0 AND ci - f + 1 >= {KMER}),
la AS (SELECT t.*, f, l, CASE WHEN f IS NULL THEN 'none' WHEN ci < f THEN 'left' WHEN ci > l THEN 'right' ELSE 'seg' END AS side FROM r1 t LEFT JOIN sg USING (path_name, win, locus)),
sh AS (SELECT path_name, win, locus, max(f) IS NOT NULL AND coalesce(count_if(side = 'left' AND cls IN ('P', 'S', 'R')) / nullif(count_if(side = 'left'), 0), 0) < {FLANK}
    AND coalesce(count_if(side = 'right' AND cls IN ('P', 'S', 'R')) / nullif(count_if(side = 'right'), 0), 0) < {FLANK}
    AND NOT (count_if(side = 'left' AND cls = 'D') > 0 AND count_if(side = 'right' AND cls = 'D') > 0) AS boundary,
  max(f) IS NOT NULL AS sm, min(pos) FILTER (side = 'seg') AS seg_from, max(pos) FILTER (side = 'seg') + {KMER} AS seg_to FROM la GROUP BY ALL),
lb AS (SELECT la.*, boundary, sm, sm AND (NOT boundary OR side = 'seg') AS own FROM la JOIN sh USING (path_name, win, locus)),
lc AS (SELECT *, own AND cls = 'N' AND coalesce(NOT (lag(own) OVER w AND lag(cls) OVER w = 'N' AND lag(pos) OVER w = pos - 1), true) AS nrun FROM lb WINDOW w AS ({_U} ORDER BY pos)),
ev AS (SELECT path_name, win, locus, count(*) AS kmers, count_if(cls = 'P')::BIGINT AS n_p, count_if(cls = 'S')::BIGINT AS n_s, count_if(cls = 'R')::BIGINT AS n_r, count_if(cls = 'D')::BIGINT AS n_d, count_if(cls = 'N')::BIGINT AS n_n,
  count_if(own)::BIGINT AS seg_kmers, count_if(nrun)::INT AS runs_n, list(pos ORDER BY pos) FILTER (own AND cls = 'P') AS lp, list(pos ORDER BY pos) FILTER (own AND cls = 'D') AS ld, list(pos ORDER BY pos) FILTER (NOT own AND cls = 'D') AS lo FROM lc GROUP BY ALL),
e2 AS (SELECT ev.* EXCLUDE (lp, ld, lo), {_greedy('lp')} AS sites_p, {_greedy('ld')} + CASE WHEN boundary THEN 0 ELSE {_greedy('lo')} END AS sites_d, CASE WHEN boundary THEN {_greedy('lo')} ELSE 0 END AS decoy_out,
  seg_from, seg_to, boundary, length(sequence) - {KMER - 1} AS windows, CASE WHEN seg_kmers = 0 THEN 'out' WHEN seg_kmers >= kmers * 0.9 THEN 'in' ELSE 'part' END AS status
  FROM ev JOIN sh USING (path_name, win, locus) JOIN frag USING (path_name, win)),
ver AS (SELECT *, {_fate(_certain(2))} AS fate FROM (SELECT *, {_reason(_certain(2))} AS reason FROM e2))"""
_SUMS = ("kmers", "windows", "n_p", "n_s", "n_r", "n_d", "n_n", "seg_kmers", "sites_p", "sites_d", "decoy_out", "runs_n")
_MATES = f"""pr AS (SELECT path_name, win // 2 AS pair, locus, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _SUMS)}, {', '.join(f"coalesce(max(CASE WHEN win % 2 = {m} THEN {c} END), {d}) AS {x}_{c}" for m, x in ((0, 'a'), (1, 'b')) for c, d in (*((c, 0) for c in _SUMS), ('status', "'out'")))} FROM e2 GROUP BY ALL),
ps AS (SELECT *, {_certain(2)} AND (a_status = 'in' OR b_status = 'in') AS whole, CASE WHEN a_status = 'part' OR b_status = 'part' THEN 'part' ELSE 'in' END AS status FROM pr),
pt AS (SELECT *, whole OR ({_certain(2, 'a_')} AND (b_sites_d + b_decoy_out <= b_sites_p OR a_status = 'part')) OR ({_certain(2, 'b_')} AND (a_sites_d + a_decoy_out <= a_sites_p OR b_status = 'part')) AS sure FROM ps),
pu AS (SELECT *, {_fate('sure')} AS fate FROM (SELECT *, {_reason('sure')} AS reason FROM pt))"""
CEILINGS = f"""{INDEX}, wk AS (SELECT p.graph_name AS home, s.path_name, upper(sequence) AS sequence FROM spelled s JOIN paths p USING (path_name) WHERE length(sequence) >= {WINDOW}),
pw AS ({_words('wk', 'path_name, home')}), pv AS (SELECT path_name, pos FROM pw JOIN idx ON idx.locus = pw.home AND idx.kmer = pw.kmer WHERE cls = 'P'),
wi AS (SELECT path_name, home, unnest(generate_series(0, (length(sequence) - {WINDOW}) // 25)) AS w FROM wk),
ws AS (SELECT wi.path_name, home, w, pos, row_number() OVER (PARTITION BY wi.path_name, w ORDER BY pos) AS r FROM wi LEFT JOIN pv ON pv.path_name = wi.path_name AND pos >= w * 25 AND pos <= w * 25 + {WINDOW - KMER}),
wr AS (SELECT path_name, home, w, pos - r AS g, count(pos) AS n FROM ws GROUP BY ALL), wt AS (SELECT path_name, home, w, sum(n) AS p, sum(ceil(n / {KMER})) AS s FROM wr GROUP BY ALL)
SELECT home AS locus, path_name, count(*) AS windows, round(count_if(p >= 3) / count(*), 6) AS private_3, round(count_if(s >= 2) / count(*), 6) AS sites_2 FROM wt GROUP BY ALL"""
_MERGED = f"""WITH {COUNTED}, mg AS (SELECT kmer, sum(n)::BIGINT AS n, count(*) AS segments FROM (SELECT segment_name, kmer, sum(hit_count) AS n FROM counted WHERE segment_name IS NOT NULL GROUP BY ALL) GROUP BY kmer)"""
ORACLES = {
    "locus_index": f"""{INDEX}, ns AS ({_syncs('txt', 'locus, node_id')}), sk AS (SELECT DISTINCT kmer FROM nw JOIN ns USING (locus, node_id, pos))
SELECT idx.*, kmer IN (SELECT kmer FROM sk) AS screen FROM idx""",
    "locus_decoys": f"{INDEX}, {DECOYS} SELECT * FROM dk",
    "walk_windows": f"WITH {STEPS}, {SPELLED}, {FRAGMENTS} SELECT path_name, win::INT AS win, length(sequence)::INT AS bp, md5(sequence) AS digest FROM frag",
    "recruit_evidence": f"{EVIDENCE} SELECT * FROM ver",
    "recruit_summary": f"{EVIDENCE} SELECT locus, fate, reason, count(*) AS n, grouping_id(locus, fate, reason)::INT AS level FROM ver GROUP BY ROLLUP (locus, fate, reason)",
    "recruit_pairs": f"""{EVIDENCE}, {_MATES} SELECT path_name, pair, locus, a_status || ',' || b_status AS mates, {', '.join(_SUMS)}, fate,
  CASE WHEN sure AND (NOT whole OR a_status = 'out' OR b_status = 'out') THEN 'rescued' ELSE reason END AS reason FROM pu""",
    "window_ceilings": CEILINGS,
    "calibration": EVIDENCE
    + f""", ow AS (SELECT e2.*, locus = p.graph_name AS own, {_certain(0)} AS fit FROM e2 JOIN paths p USING (path_name)),
cc AS (SELECT cut, count_if(sites_p >= cut AND fit)::BIGINT AS false_certain, count(*) AS screened FROM (SELECT * FROM ow WHERE NOT own), (SELECT unnest(generate_series(2, 8)) AS cut) GROUP BY cut),
ch AS (SELECT coalesce(min(cut), 8) AS c, min(cut) IS NOT NULL AS met FROM cc WHERE false_certain <= 0.0001::DOUBLE * screened)
SELECT cut::INT AS cut, false_certain, screened, cut = c AS chosen, met FROM cc, ch""",
    "store_merged": _MERGED + " SELECT * FROM mg",
    "store_lookup": _MERGED + " SELECT kmer, coalesce(n, 0) AS n FROM (SELECT DISTINCT kmer FROM kmer_features WHERE kmer IS NOT NULL) LEFT JOIN mg USING (kmer)",
    "store_sealed_check": f"""WITH {COUNTED}, now AS (SELECT segment_name, sum(hit_count)::BIGINT AS o, count(DISTINCT kmer) AS d FROM counted WHERE segment_name IS NOT NULL GROUP BY ALL)
SELECT coalesce(s.segment_name, now.segment_name) AS segment_name, s.occurrences, coalesce(o, 0) AS occurrences_now, s.distinct_kmers, coalesce(d, 0) AS distinct_now FROM store_segments s FULL OUTER JOIN now ON s.segment_name = now.segment_name""",
    "stream_store": f"WITH {COUNTED} SELECT kmer, sum(hit_count)::BIGINT AS n FROM counted GROUP BY kmer",
}
QUERIES = {f.__name__: f for f in (locus_index, locus_decoys, walk_windows, recruit_evidence, recruit_summary, recruit_pairs, window_ceilings, calibration, store_merged, store_lookup, store_sealed_check, stream_store)}
