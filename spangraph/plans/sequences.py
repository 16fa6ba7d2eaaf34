"""Queries over sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions import seq as S
from spangraph.operators.assoc import running_counts
from spangraph.plans.heavy_keys import COUNTED, counted_hits
from spangraph.plans.walks import SPELLED, STEPS, blocks, nodes, steps
from spangraph.session import written
from spangraph.tables import load

PARTITIONS = 4096


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).where("sequence is not null and sequence <> ''").select("node_id", F.upper("sequence").alias("sequence"))


def node_kmers(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """(node_id, pos, kmer): the canonical k-mers of the nodes, as codes."""
    return S.kmer_codes(_known(spark, folder), ["node_id"], "sequence", k)


def _text(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("kmer", S.decode(F.col("kmer"), k))


def _hit_kmers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "kmer_hits").select(S.canonical(F.col("kmer")).alias("kmer")).where("kmer is not null").distinct()


def seq_reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    rc = S.reverse_complement(F.col("sequence"))
    gc = F.length("sequence") - F.length(F.translate("sequence", "GCgc", ""))
    return nodes(spark, folder).where("sequence is not null").select("node_id", F.md5(rc).alias("rc_digest"), gc.alias("gc"))


def seq_kmer_counts(spark: SparkSession, folder: str) -> DataFrame:
    per = node_kmers(spark, folder, 11).groupBy("kmer", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return _text(per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_nodes")), 11)


def seq_kmer_codes(spark: SparkSession, folder: str) -> DataFrame:
    code = S.encode(F.col("kmer"))
    return _hit_kmers(spark, folder).select("kmer", code.alias("code"), (S.decode(code, 21) == F.col("kmer")).alias("back"))


def seq_mix64(spark: SparkSession, folder: str) -> DataFrame:
    return S.with_mix64(_hit_kmers(spark, folder), S.encode(F.col("kmer")), "hash").select("kmer", "hash")


def seq_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    at = S.with_window_hashes(_hit_kmers(spark, folder), ["kmer"], "kmer", 21, 7)
    return at.select("kmer", ((F.col("first") == F.col("low")) | (F.col("last") == F.col("low"))).alias("syncmer"))


def seq_minimizers(spark: SparkSession, folder: str) -> DataFrame:
    at = S.with_window_hashes(_hit_kmers(spark, folder), ["kmer"], "kmer", 21, 11, S.MINIMIZER_SEED)
    return at.select("kmer", S.unsigned(F.col("low")).bitwiseAND(PARTITIONS - 1).alias("bucket"))


def seq_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of consecutive 21-mers of a node that share a minimizer (11-mers), as spans."""
    at = S.with_window_hashes(_known(spark, folder), ["node_id"], "sequence", 21, 11, S.MINIMIZER_SEED)
    order = W.partitionBy("node_id").orderBy("pos")
    new = F.coalesce(((F.lag("low").over(order) != F.col("low")) | (F.lag("pos").over(order) != F.col("pos") - 1)).cast("int"), F.lit(1))
    runs = at.withColumn("c", new).withColumn("run", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("node_id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 21).alias("end")).drop("run")


def seq_dust(spark: SparkSession, folder: str) -> DataFrame:
    score = F.round(S.dust(F.col("kmer")), 6)
    return _hit_kmers(spark, folder).select("kmer", score.alias("score"), (score >= 2.5).alias("low_complexity"))


def seq_kmer_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct nodes where each 21-mer starts, for k-mers of more than one node."""
    pairs = node_kmers(spark, folder, 21).select("kmer", "node_id").distinct()
    return _text(pairs.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("first_node")).where("n_nodes > 1"), 21)


def path_richness(spark: SparkSession, folder: str) -> DataFrame:
    """Total and distinct canonical 21-mers of each walk, and its rank: one more than the walks with more distinct ones."""
    words = S.kmer_codes(blocks(spark, folder, overlap=20), ["path_name", "block"], "text", 21)
    per = words.groupBy("path_name", "kmer").agg(F.count(F.lit(1)).alias("n"))
    rich = written(per.groupBy("path_name").agg(F.count(F.lit(1)).alias("distinct_kmers"), F.sum("n").alias("kmers")), "richness")
    counts = running_counts(rich, "distinct_kmers").select("distinct_kmers", "upto")
    rank = rich.agg(F.count(F.lit(1))).scalar() - F.col("upto") + 1
    return rich.join(counts, "distinct_kmers").select("path_name", "distinct_kmers", "kmers", rank.alias("rank"))


def pansn_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sample, haplotype, contig and 1-based interval out of each path name."""
    name, span = F.col("path_name"), r":(\d+)-(\d+)$"
    last = F.split_part(name, F.lit("#"), F.lit(3))
    part = lambda i: F.expr(f"try_cast(regexp_extract(path_name, ':(\\\\d+)-(\\\\d+)$', {i}) as bigint)")
    return load(spark, folder, "graph_paths").select("path_name").distinct().select(
        "path_name", F.split_part(name, F.lit("#"), F.lit(1)).alias("sample"), F.expr("try_cast(split_part(path_name, '#', 2) as int)").alias("hap"),
        F.regexp_replace(last, span, "").alias("contig"), part(1).alias("first"), part(2).alias("last"),
    )


def resolve_name(names: DataFrame, column: str, wanted: str) -> DataFrame:
    """(name, rank): the names that ``wanted`` means by the best rank that has any: exact, substring, substring in any case."""
    low = F.lower(F.lit(wanted))
    rank = F.when(F.col(column) == wanted, 1).when(F.contains(F.col(column), F.lit(wanted)), 2).when(F.contains(F.lower(column), low), 3)
    ranked = names.select(F.col(column).alias("name"), rank.alias("rank")).where("rank is not null").distinct()
    return ranked.where(F.col("rank") == ranked.agg(F.min("rank")).scalar())


def resolved_names(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_name(load(spark, folder, "graph_paths"), "path_name", "SMP0000001#1")


def unit_motifs(spark: SparkSession, folder: str) -> DataFrame:
    """Least rotation on either strand and shortest period of each repeat unit, against the recorded motif."""
    u = load(spark, folder, "unit_graphs").where("unit_seq is not null")
    period = S.shortest_period(F.col("unit_seq"))
    motif = S.least_rotation(F.substring("unit_seq", F.lit(1), period))
    return u.select("row_no", period.alias("period"), motif.alias("motif"), (F.col("copy_quantum") == F.length("unit_seq") / period).alias("quantum_agrees"))


def feature_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded k-mer figures against those of the hits: equal, stale or missing on one side."""
    hits = counted_hits(spark, folder, "kmer", "path_name", "hit_count")
    per = hits.groupBy("kmer", "path_name").agg(F.sum("hit_count").alias("n"))
    mine = per.groupBy("kmer").agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("total"), F.max("n").alias("most"))
    kept = load(spark, folder, "kmer_features").groupBy("kmer").agg(
        F.max("present_paths").alias("r_paths"), F.max("total_count").alias("r_total"), F.max("max_count").alias("r_most")
    )
    pairs = (("paths", "r_paths"), ("total", "r_total"), ("most", "r_most"))
    same = F.lit(True)
    for x, y in pairs:
        same = same & F.col(x).eqNullSafe(F.col(y))
    status = F.when(F.col("total").isNull(), "only_recorded").when(F.col("r_kmer").isNull(), "only_counted").when(same, "equal").otherwise("stale")
    both = mine.join(kept.withColumnRenamed("kmer", "r_kmer"), F.col("kmer") == F.col("r_kmer"), "full_outer")
    return both.select(F.coalesce("kmer", "r_kmer").alias("kmer"), status.alias("status"))


def escaped_names(spark: SparkSession, folder: str) -> DataFrame:
    e = S.percent_escape(F.col("haplotypes"))
    return load(spark, folder, "carrier_events").where("haplotypes is not null").select("row_no", e.alias("escaped"), (S.percent_unescape(e) == F.col("haplotypes")).alias("back"))


_KNOWN = "known AS (SELECT node_id, upper(sequence) AS sequence FROM nodes WHERE sequence IS NOT NULL AND sequence <> '')"


def _words(k: int) -> str:
    return f"""{_KNOWN}, words AS (SELECT node_id, i - 1 AS pos, substring(sequence, i, {k}) AS word FROM (
    SELECT *, unnest(generate_series(1, length(sequence) - {k} + 1)) AS i FROM known)),
plain AS (SELECT node_id, pos, word, least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS kmer FROM words WHERE regexp_full_match(word, '[ACGT]+'))"""


_HITS = """hk AS (SELECT DISTINCT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT upper(kmer) AS k FROM kmer_hits) WHERE regexp_full_match(k, '[ACGT]+'))"""


def _code(text: str) -> str:
    return f"list_reduce(list_transform(string_split(translate({text}, 'ACGT', '0123'), ''), lambda x: x::UBIGINT), lambda a, b: a * 4 + b)"


def _mix(x: str) -> str:
    def times(v: str, k: int) -> str:
        return f"((({v})::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    return f"""list_transform(list_transform(list_transform([{x}], lambda a: {times('xor(a, a >> 30)', S.MIX_1)}), lambda b: {times('xor(b, b >> 27)', S.MIX_2)}), lambda c: xor(c, c >> 31))[1]"""


def _smers(table: str, cols: str, word: str, s: int, seed: int) -> str:
    """One row per s-mer with its hash."""
    m = f"substring({word}, j, {s})"
    inner = f"SELECT {cols}, j, least({m}, reverse(translate({m}, 'ACGT', 'TGCA'))) AS m FROM (SELECT *, unnest(generate_series(1, length({word}) - {s} + 1)) AS j FROM {table})"
    return f"SELECT {cols}, j, {_mix(f'xor(code, {seed}::UBIGINT)')} AS h FROM (SELECT *, {_code('m')} AS code FROM ({inner}))"


ORACLES = {
    "seq_reverse_complement": f"""WITH {STEPS} SELECT node_id, md5(reverse(translate(sequence, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd'))) AS rc_digest,
  length(regexp_replace(sequence, '[^GCgc]', '', 'g')) AS gc FROM nodes WHERE sequence IS NOT NULL""",
    "seq_kmer_counts": f"WITH {STEPS}, {_words(11)} SELECT kmer, count(*) AS n, count(DISTINCT node_id) AS n_nodes FROM plain GROUP BY kmer",
    "seq_kmer_codes": f"WITH {_HITS} SELECT kmer, {_code('kmer')}::BIGINT AS code, true AS back FROM hk",
    "seq_mix64": f"WITH {_HITS} SELECT kmer, CASE WHEN h > 9223372036854775807 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM (SELECT kmer, {_mix(_code('kmer'))} AS h FROM hk)",
    "seq_syncmers": f"""WITH {_HITS}, sm AS ({_smers('hk', 'kmer', 'kmer', 7, 0)})
SELECT kmer, min(h) IN (arg_min(h, j), arg_max(h, j)) AS syncmer FROM sm GROUP BY kmer""",
    "seq_minimizers": f"WITH {_HITS}, sm AS ({_smers('hk', 'kmer', 'kmer', 11, S.MINIMIZER_SEED)}) SELECT kmer, (min(h) % {PARTITIONS})::BIGINT AS bucket FROM sm GROUP BY kmer",
    "seq_super_kmers": f"""WITH {STEPS}, {_words(21)}, sm AS ({_smers('plain', 'node_id, pos', 'word', 11, S.MINIMIZER_SEED)}),
mi AS (SELECT node_id, pos, min(h) AS m FROM sm GROUP BY ALL),
c AS (SELECT *, coalesce((lag(m) OVER w <> m OR lag(pos) OVER w <> pos - 1)::INT, 1) AS c FROM mi WINDOW w AS (PARTITION BY node_id ORDER BY pos)),
r AS (SELECT *, sum(c) OVER (PARTITION BY node_id ORDER BY pos) AS run FROM c)
SELECT node_id, min(pos) AS start, max(pos) + 21 AS "end" FROM r GROUP BY node_id, run""",
    "seq_dust": f"""WITH {_HITS}, t AS (SELECT kmer, substring(kmer, j, 3) AS t FROM (SELECT kmer, unnest(generate_series(1, length(kmer) - 2)) AS j FROM hk)),
p AS (SELECT kmer, sum(c * (c - 1) / 2) AS p FROM (SELECT kmer, t, count(*) AS c FROM t GROUP BY ALL) GROUP BY kmer)
SELECT kmer, round(p / (length(kmer) - 3), 6) AS score, round(p / (length(kmer) - 3), 6) >= 2.5 AS low_complexity FROM p""",
    "seq_kmer_nodes": f"WITH {STEPS}, {_words(21)} SELECT kmer, count(DISTINCT node_id) AS n_nodes, min(node_id) AS first_node FROM plain GROUP BY kmer HAVING count(DISTINCT node_id) > 1",
    "path_richness": f"""WITH {STEPS}, {SPELLED}, w AS (SELECT path_name, substring(s, i, 21) AS word FROM (SELECT path_name, upper(sequence) AS s, unnest(generate_series(1, length(sequence) - 20)) AS i FROM spelled))
SELECT path_name, distinct_kmers, kmers, rank() OVER (ORDER BY distinct_kmers DESC) AS rank FROM (
  SELECT path_name, count(DISTINCT least(word, reverse(translate(word, 'ACGT', 'TGCA')))) AS distinct_kmers, count(*) AS kmers FROM w WHERE regexp_full_match(word, '[ACGT]+') GROUP BY path_name)""",
    "pansn_names": r"""SELECT DISTINCT path_name, split_part(path_name, '#', 1) AS sample, try_cast(split_part(path_name, '#', 2) AS INT) AS hap,
  regexp_replace(split_part(path_name, '#', 3), ':(\d+)-(\d+)$', '') AS contig, try_cast(regexp_extract(path_name, ':(\d+)-(\d+)$', 1) AS BIGINT) AS first,
  try_cast(regexp_extract(path_name, ':(\d+)-(\d+)$', 2) AS BIGINT) AS last FROM graph_paths""",
    "resolved_names": """WITH r AS (SELECT DISTINCT path_name AS name, CASE WHEN path_name = 'SMP0000001#1' THEN 1 WHEN contains(path_name, 'SMP0000001#1') THEN 2
  WHEN contains(lower(path_name), lower('SMP0000001#1')) THEN 3 END AS rank FROM graph_paths)
SELECT name, rank FROM r WHERE rank = (SELECT min(rank) FROM r)""",
    "unit_motifs": """WITH u AS (SELECT row_no, unit_seq AS u, copy_quantum, length(unit_seq) AS n FROM unit_graphs WHERE unit_seq IS NOT NULL),
p AS (SELECT row_no, any_value(u) AS u, any_value(n) AS n, any_value(copy_quantum) AS q, min(p) AS p FROM (SELECT *, unnest(generate_series(1, n)) AS p FROM u)
  WHERE n % p = 0 AND repeat(substring(u, 1, p), n // p) = u GROUP BY row_no),
m AS (SELECT row_no, p, n, q, substring(u, 1, p) AS m, reverse(translate(substring(u, 1, p), 'ACGTacgt', 'TGCAtgca')) AS r FROM p),
t AS (SELECT *, unnest(generate_series(1, p)) AS i FROM m)
SELECT row_no, any_value(p)::INT AS period, min(least(substring(m, i) || substring(m, 1, i - 1), substring(r, i) || substring(r, 1, i - 1))) AS motif,
  any_value(q) = any_value(n) / any_value(p) AS quantum_agrees FROM t GROUP BY row_no""",
    "feature_consistency": f"""WITH {COUNTED}, per AS (SELECT kmer, path_name, sum(hit_count) AS n FROM counted GROUP BY ALL),
mine AS (SELECT kmer, count(*) AS paths, sum(n) AS total, max(n) AS most FROM per GROUP BY kmer),
kept AS (SELECT kmer, max(present_paths) AS p, max(total_count) AS t, max(max_count) AS m FROM kmer_features GROUP BY kmer)
SELECT coalesce(a.kmer, b.kmer) AS kmer, CASE WHEN total IS NULL THEN 'only_recorded' WHEN b.kmer IS NULL THEN 'only_counted'
  WHEN paths IS NOT DISTINCT FROM p AND total IS NOT DISTINCT FROM t AND most IS NOT DISTINCT FROM m THEN 'equal' ELSE 'stale' END AS status
FROM mine a FULL OUTER JOIN kept b ON a.kmer = b.kmer""",
    "escaped_names": """SELECT row_no, replace(replace(replace(replace(replace(replace(replace(haplotypes, '%', '%25'), ';', '%3B'), '=', '%3D'), ',', '%2C'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D') AS escaped, true AS back
FROM carrier_events WHERE haplotypes IS NOT NULL""",
}
QUERIES = {f.__name__: f for f in (
    seq_reverse_complement, seq_kmer_counts, seq_kmer_codes, seq_mix64, seq_syncmers, seq_minimizers, seq_super_kmers, seq_dust, seq_kmer_nodes,
    path_richness, pansn_names, resolved_names, unit_motifs, feature_consistency, escaped_names,
)}
