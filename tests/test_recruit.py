"""Index, decoys and labels of walks, which are worked out once per node, against the same worked out at every place of every walk."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spangraph.functions import seq as S
from spangraph.operators import intervals as I
from spangraph.operators import recruit as R
from spangraph.operators import walks as K

KMER, SMER = 5, 3


def _canonical(word):
    back = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return min(word, back)


def _graph(spark):
    """(nodes, paths, spelled): nodes shorter and longer than a k-mer, with unknown letters, lower case and without letters; walks that visit them over and over, both ways."""
    draw = random.Random(5)
    texts = {f"n{i}": "".join(draw.choice("ACGT") for _ in range(draw.choice((1, 2, 4, 7, 30, 61)))) for i in range(24)}
    texts["n3"], texts["n4"], texts["n5"] = "ACGTNACGGTACNNTTGACA", "acgttgcaacgtgg", None
    locus = {n: f"g{int(n[1:]) % 3}" for n in texts}
    walks = {f"w{i}": [(draw.choice("><"), draw.choice(list(texts))) for _ in range(draw.randint(1, 40))] for i in range(12)}
    nodes = spark.createDataFrame([(n, locus[n], t, len(t or "NNN")) for n, t in texts.items()], "node_id string, locus string, sequence string, length_bp long")
    paths = spark.createDataFrame([(w, f"g{int(w[1:]) % 3}", "".join(o + n for o, n in s)) for w, s in walks.items()], "path_name string, graph_name string, steps string")
    turn = lambda o, t: t if o == ">" else t[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    spelled = {w: "".join(turn(o, texts[n] or "NNN") for o, n in s).upper() for w, s in walks.items()}
    return nodes, K.distinct_paths(paths), spelled


def _inputs(spark, size):
    nodes, paths, spelled = _graph(spark)
    steps = K.explode_steps(paths)
    known = K.distinct_nodes(nodes)
    at = K.coordinates(steps, known).where("end_bp > start_bp").select("path_name", "node_id", "reverse", "start_bp", "end_bp")
    blocks = K.spelled_blocks(steps, known, size, KMER - 1)
    with_text = known.where("sequence is not null").select("node_id", F.upper("sequence").alias("sequence"))
    index = R.locus_index(R.counted_words(nodes.where("sequence is not null"), ["locus", "node_id"], "sequence", KMER, SMER), KMER)
    return nodes, paths, spelled, at, blocks, with_text, index


def test_screen_comes_with_the_counts(spark):
    nodes = _graph(spark)[0].where("sequence is not null")
    counted = R.counted_words(nodes, ["locus", "node_id"], "sequence", KMER, SMER)
    got = R.locus_index(counted, KMER)
    plain = R.words(nodes, ["locus", "node_id"], "sequence", KMER).groupBy("locus", "kmer").agg(F.count(F.lit(1)).alias("mult"))
    want = R.with_screen(R.locus_index(plain, KMER), nodes, ["locus", "node_id"], "sequence", KMER, SMER)
    columns = ["locus", "kmer", "mult", "outside", "cls", "screen"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()) and {r.screen for r in got.collect()} == {True, False}
    # the texts are read once, not once more for the totals and twice for the screen
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_border_kmers_are_those_of_no_single_step(spark):
    for size in (20, 1000):
        _, paths, spelled, at, blocks, _, _ = _inputs(spark, size)
        got = sorted((r.path_name, r.pos, r.kmer) for r in R.border_kmers(blocks, KMER).withColumn("kmer", S.decode(F.col("kmer"), KMER)).collect())
        held = {}
        for r in at.collect():
            held.setdefault(r.path_name, []).append((r.start_bp, r.end_bp))
        words = [(w, i, t[i : i + KMER]) for w, t in spelled.items() for i in range(len(t) - KMER + 1)]
        assert got == sorted((w, i, _canonical(x)) for w, i, x in words if set(x) <= set("ACGT") and not any(a <= i and i + KMER <= b for a, b in held[w]))


def test_labels_of_windows_equal_those_of_fragments(spark):
    _, _, spelled, at, blocks, nodes, index = _inputs(spark, 60)
    index = R.with_decoys(index, spark.createDataFrame([("g0", 7), ("g1", 7), ("g1", 30), ("g2", 99)], "locus string, kmer long").join(index.select("locus", "kmer"), ["locus", "kmer"], "left_anti"))
    length = 20
    cut = [(w, i // length, t[i : i + length]) for w, t in spelled.items() for i in range(0, len(t), length)]
    windows = spark.createDataFrame(cut, "path_name string, win int, sequence string")
    want = R.labelled(windows, ["path_name", "win"], "sequence", index, KMER).drop("hits")
    words = R.words(nodes, ["node_id"], "sequence", KMER)
    for size in (8, 10_000):
        got = R.labelled_windows(at, nodes, words, R.border_kmers(blocks, KMER), windows, index, KMER, length, size)
        assert got.dtypes == want.dtypes
        assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 100


def test_decoys_equal_those_of_all_places(spark):
    for size in (16, 1000):
        _, paths, spelled, at, blocks, nodes, index = _inputs(spark, size)
        homes = paths.select("path_name", F.col("graph_name").alias("home"))
        placed = spark.createDataFrame([(w, i, _canonical(t[i : i + KMER])) for w, t in spelled.items() for i in range(len(t) - KMER + 1) if set(t[i : i + KMER]) <= set("ACGT")], "path_name string, pos long, word string")
        placed = placed.select("path_name", "pos", S.encode(F.col("word")).alias("kmer")).join(homes, "path_name")
        hits = placed.join(index.where("cls = 'S'").select("locus", "kmer"), "kmer").where("locus <> home")
        words = R.words(nodes, ["node_id"], "sequence", KMER)
        places = R.shared_places(index, words, at, R.border_kmers(blocks, KMER), homes, KMER)
        assert sorted(map(tuple, places.collect())) == sorted(map(tuple, hits.select("path_name", "locus", "pos").collect())) and hits.count() > 10
        linked = I.islands(hits.withColumn("end", F.col("pos") + 1), ["path_name", "locus"], "pos", "end", 3).groupBy("path_name", "locus", "island")
        spans = linked.agg(F.min("pos").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        inside = placed.select("path_name", "pos", "kmer").join(spans, "path_name").where("pos >= lo - 4 and pos < hi + 4").select("locus", "kmer").distinct()
        want = inside.join(index.select("locus", "kmer"), ["locus", "kmer"], "left_anti")
        got = R.decoy_kmers(index, places, blocks, KMER, size, gap=3, least=2, pad=4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_hits_of_walks_are_counted_by_node_and_border(spark):
    nodes, paths, spelled, at, blocks, with_text, index = _inputs(spark, 20)
    for cls in ("P", "S"):
        wanted = index.where(F.col("cls") == cls).select("locus", "kmer")
        held = {(r.kmer, r.locus) for r in wanted.withColumn("kmer", S.decode(F.col("kmer"), KMER)).collect()}
        want = {}
        for w, text in spelled.items():
            for i in range(len(text) - KMER + 1):
                if set(word := text[i : i + KMER]) <= set("ACGT"):
                    for locus in (x for k, x in held if k == _canonical(word)):
                        want[w, locus] = want.get((w, locus), 0) + 1
        got = R.walk_hits(wanted, R.node_hits(wanted, R.words(with_text, ["node_id"], "sequence", KMER)), at, R.border_kmers(blocks, KMER))
        assert {(r.path_name, r.locus): r.hits for r in got.collect()} == want and want


@pytest.mark.parametrize("name", [
    "private_dosage",
    "window_ceilings",
])
def test_kmers_of_walks_are_never_broadcast(spark, name):
    """The planner knows no size of what comes out of Python, and sent all k-mers of the walks to the driver for a table that it took for small."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [kmer" not in plan and "SortMergeJoin [kmer" in plan


def test_ceilings_count_every_window(spark):
    for size in (20, 1000):
        nodes, paths, spelled, at, blocks, with_text, index = _inputs(spark, size)
        private = {(r.kmer, r.locus) for r in index.where("cls = 'P'").withColumn("kmer", S.decode(F.col("kmer"), KMER)).collect()}
        home = {r.path_name: r.graph_name for r in paths.collect()}
        length, step, want = 17, 4, []
        for w, text in spelled.items():
            mark = [(_canonical(text[i : i + KMER]), home[w]) in private for i in range(len(text) - KMER + 1)]
            three = two = windows = 0
            for at_ in range(0, len(text) - length + 1, step):
                inside = "".join("p" if m else " " for m in mark[at_ : at_ + length - KMER + 1])
                windows += 1
                three += inside.count("p") >= 3
                two += sum(-(-len(run) // KMER) for run in inside.split()) >= 2
            if windows:
                want.append((home[w], w, windows, round(three / windows, 9), round(two / windows, 9)))
        lengths = spark.createDataFrame([(w, home[w], len(t)) for w, t in spelled.items()], "path_name string, home string, n_bases long")
        runs = R.private_runs(index, R.words(with_text, ["node_id"], "sequence", KMER))
        spans = R.private_spans(index, runs, at, R.border_kmers(blocks, KMER), lengths, KMER)
        got = R.ceilings(spans, lengths, KMER, length, step, size)
        assert sorted((r.locus, r.path_name, r.windows, round(r.private_3, 9), round(r.sites_2, 9)) for r in got.collect()) == sorted(want)
        assert any(r[3] for r in want) and any(r[4] for r in want)
