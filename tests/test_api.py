"""The interface over hand-made frames, with thresholds as arguments, and the files that it writes."""

import pytest
from pyspark.sql import functions as F

from spangraph import api
from spangraph.operators import sites as T
from spangraph.sources import tables

PATHS = "graph_name string, path_name string, steps string"
NODES = "node_id string, sequence string, length_bp long"
SITES = "bubble_id long, source_node string, source_orient string, sink_node string, sink_orient string"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.fixture(scope="module")
def graph(spark):
    walks = ["1+,2+,3+,4+", "1+,2+,3+,4+", "1+,3+,4+", "1+,2+,3-,4+", ">1>3>3>4"]
    paths = spark.createDataFrame([("g", f"p{i}", w) for i, w in enumerate(walks)], PATHS)
    nodes = spark.createDataFrame([("1", "A" * 100, None), ("2", "AC" * 35, None), ("3", "ACGTT" * 16, None), ("4", "T" * 50, None)], NODES)
    return paths, nodes


def test_sites_and_calls(spark, graph):
    paths, nodes = graph
    assert rows(api.find_sites(paths, nodes, least_alt=1), "source_node", "sink_node", "path_support", "distinct_alleles", "status") == [("1", "4", 5, 4, "kept")]
    assert rows(api.find_sites(paths, nodes, least_paths=6), "status") == [("few_paths",)]
    sites = spark.createDataFrame([(1, "1", "+", "4", "+")], SITES)
    records, genotypes = api.call_events(paths, nodes, sites)
    alleles = {r.signature: r.allele for r in api.allele_table(paths, sites).collect()}
    assert alleles[">2>3"] == 1 and len(alleles) == 4
    got = {(r.allele, r.kind, r.del_bp, r.ins_bp) for r in records.collect()}
    assert (alleles[">3"], "del", 70, 0) in got and (alleles[">2<3"], "inv", 80, 80) in got
    assert rows(genotypes, "path_name", "allele") == [(f"p{i}", alleles[s]) for i, s in enumerate([">2>3", ">2>3", ">3", ">2<3", ">3>3"])]
    assert api.crossing_table(paths, sites).count() == 5
    assert rows(api.cluster_walks(paths, nodes, sites, 0.99), "allele", "leader") == [(1, 1), (2, 1), (3, 3), (4, 4)] or alleles[">2<3"] != 2


def test_features_and_shape(spark, graph):
    paths, nodes = graph
    node = {r.feature: (r.present, r.max_count, r.total) for r in api.graph_features(paths).where("layer = 'node'").collect()}
    assert node == {"1": (5, 1, 5), "2": (3, 1, 3), "3": (5, 2, 6), "4": (5, 1, 5)}
    assert api.kmer_features(paths, nodes, 21).where("feature = repeat('A', 21)").select("present", "total").first() == (5, 5 * (80 + 1 + 30) + 4 * 2 + 1)  # letters of the neighbours go on
    assert rows(api.graph_shape(paths, hub=2, tangled=1), "n_nodes", "n_edges", "self_loops", "hubs", "tangled") == [(4, 7, 1, 2, True)]
    assert [r.path_name for r in api.haplotype_order(paths, nodes, 21).collect()][0] == "p3"
    runs, units = api.tandem_arrays(paths)
    assert rows(runs, "path_name", "period", "copies") == [("p4", 1, 2)] and rows(units, "unit", "n_paths", "max_copies", "prevalent") == [("<3", 1, 2, False)]


def test_twins(spark):
    paths = spark.createDataFrame([("g", "p", ">a>x>y>b"), ("g", "q", ">a>u>v>b"), ("g", "r", ">a>w>b")], PATHS)
    nodes = spark.createDataFrame([(n, s, None) for n, s in zip("axyuvwb", ["A", "CC", "GG", "CC", "GG", "CC", "T"])], NODES)
    twins, steps = api.merge_twins(paths, nodes)
    assert rows(twins) == []  # u and x are followed by different nodes
    nodes = nodes.where("node_id <> 'v'").unionByName(spark.createDataFrame([("v", "GT", None)], NODES))
    same = spark.createDataFrame([("g", "p", ">a>x>b"), ("g", "q", ">a>u>b"), ("g", "r", ">a>w>b")], PATHS)
    twins, steps = api.merge_twins(same, nodes)
    assert rows(twins) == [("w", "u"), ("x", "u")] and rows(steps.where("idx = 1"), "node_id") == [("u",)] * 3


def test_association_of_the_hand_derived_case(spark):
    g = [0, 1, 2] * 4
    y = [2.1, 3.4, 5.2, 2.8, 3.9, 5.9, 3.2, 4.6, 6.1, 3.7, 4.9, 6.8]
    pheno = spark.createDataFrame([(i, y[i], float(i + 1)) for i in range(12)], "sample long, y double, c double")
    doses = spark.createDataFrame([("f", i, v) for i, v in enumerate(g) if v], "feature string, sample long, dose long")
    got = api.associate(doses, pheno, ["c"]).first()
    assert got.p == pytest.approx(7.58033045421e-09, rel=1e-6) and got.q == got.p  # fixed value of the hand-derived case
    assert api.associate(doses, pheno).first().p > got.p and api.associate(doses, pheno, model="genotypic").first().p < 0.01
    with pytest.raises(ValueError):
        api.associate(doses, pheno, ["c"], model="genotypic")


def test_matching_of_calls(spark):
    schema = "haplotype string, id string, pos long, change long"
    truth = spark.createDataFrame([("h", "t1", 1000, 100), ("h", "t2", 1300, 120), ("h", "t3", 9000, -80), ("k", "t4", 5, 60)], schema)
    calls = spark.createDataFrame([("h", "c1", 1100, 100), ("h", "c2", 1350, 110), ("h", "c3", 9000, 80), ("m", "c4", 5, 60)], schema)
    got = rows(api.score_calls(calls, truth), "haplotype", "tp", "fp", "fn")
    assert got == [("h", 2, 1, 1), ("k", 0, 0, 1), ("m", 0, 1, 0)]


def test_recruit(spark):
    import random

    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, shared = make(400), make(400), make(200)
    index = api.index_locus(spark.createDataFrame([("A", "1", a + shared), ("B", "1", b + shared)], "locus string, name string, sequence string"), 21, 7)
    frags = spark.createDataFrame([("in_a", a[100:250]), ("shared", shared[20:170]), ("edge", a[320:400] + make(70)), ("none", make(150)), ("short", "ACGT"), ("null", None)], "fragment string, sequence string")
    got = {(r.fragment, r.locus): (r.fate, r.reason, r.status) for r in api.recruit(frags, index, 21).collect()}
    assert got["in_a", "A"] == ("certain", ".", "in") and got["edge", "A"] == ("certain", "partial", "part")
    assert got["shared", "A"] == got["shared", "B"] == ("ambiguous", "shared_only", "in") and not {k for k in got if k[0] in ("none", "short", "null")}


def test_normal_form(spark):
    pairs = [("GGCACACATT", "GGCACATT"), ("AAAA", "AAA"), ("ACGT", "ACGT"), ("ACGT", "TTTT"), ("", "AC"), ("AC", "")]
    out = T.normalised(spark.createDataFrame(pairs, "r string, a string"), "r", "a").collect()
    got = {(x.r, x.a): (x.pos, x.ref_part, x.alt_part, x.homlen) for x in out}
    assert got["GGCACACATT", "GGCACATT"] == (2, "CA", "", 4) and got["AAAA", "AAA"] == (0, "A", "", 3) and got["ACGT", "ACGT"] == (0, "", "", 0)
    assert got["ACGT", "TTTT"] == (0, "ACG", "TTT", 0) and got["", "AC"] == (0, "", "AC", 0) and got["AC", ""] == (0, "AC", "", 0)


def test_files(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "k.txt").write_text("1 0.5\n0.5,1\n")
    good = tables.read_kinship(spark, at("k.txt"), ["a", "b"])
    assert rows(good) == [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)] and tables.kinship_problems(good, 2).count() == 0
    (tmp_path / "bad.txt").write_text("1 0.5 3\n0.4 x\n")
    assert {r.reason for r in tables.kinship_problems(tables.read_kinship(spark, at("bad.txt"), ["a", "b"]), 2).collect()} == {"not 2 by 2", "no number", "not symmetric"}
    (tmp_path / "g.gfa").write_text("H\tVN\nS\t1\tA\nS\t2\tC\nP\tp\t1+\n")
    assert rows(tables.census(spark, at("g.gfa"))) == [("H", 1), ("P", 1), ("S", 2)]
    doses = spark.createDataFrame([("p", "x", 1), ("q", "y", 2)], "path_name string, feature string, n int")
    tables.write_matrix(doses, at("wide"))
    assert rows(spark.read.csv(at("wide"), header=True, sep="\t")) == [("p", "1", "0"), ("q", "0", "2")]
    with pytest.raises(ValueError):
        tables.write_matrix(doses, at("wide2"), most=1)
    units = spark.createDataFrame([(1, "ACG", ["5", "6"], None), (2, None, [], 3)], "id long, seq string, nodes array<string>, n long")
    tables.write_tsv(units, at("units"))
    back = tables.read_tsv(spark, at("units"), "id long, seq string, nodes array<string>, n long, extra string", {"nodes": ","})
    assert rows(back, "id", "seq", "n", "extra") == [(1, "ACG", None, None), (2, None, 3, None)] and back.where("id = 1").first().nodes == ["5", "6"]
    reads = spark.createDataFrame([("L", "certain", "r1", "ACGT", "IIII"), ("L", "ambiguous", "r2", "AC", None)], "locus string, fate string, name string, sequence string, quality string")
    tables.write_reads(reads, at("reads"), "locus", "fate")
    assert rows(tables.read_fastq(spark, at("reads/locus=L/fate=certain")), "name", "sequence", "quality") == [("r1", "ACGT", "IIII")]
    records = spark.createDataFrame([("v1", "A" * 9, "C"), ("v2", "G", None)], "id string, ref string, alt string")
    short, side = tables.split_sequences(records, "id", ["ref", "alt"], 5)
    assert rows(short) == [("v1", "<v1.ref>", "C"), ("v2", "G", None)] and rows(side) == [("v1.ref", "A" * 9)]
    assert rows(tables.join_sequences(short, side, ["ref", "alt"]).select("id", "ref", "alt")) == rows(records)
    tables.write_fasta(side, at("side"))
    assert rows(tables.read_fasta(spark, at("side"))) == [("v1.ref", "A" * 9)]
    tables.staged(spark, {"a": side.write.parquet, "b": records.write.parquet}, at("both"))
    assert spark.read.parquet(at("both/b")).count() == 2

    def broken(folder):
        raise OSError("disk full")

    with pytest.raises(OSError):
        tables.staged(spark, {"a": side.write.parquet, "b": broken}, at("none"))
    assert not (tmp_path / "none").exists() and not list(tmp_path.glob("*.stage"))
    with pytest.raises(FileExistsError):
        tables.staged(spark, {}, at("both"))


def test_models_of_loci(spark):
    doses = spark.createDataFrame([("g", f, f"s{i}", 1.0, 0) for f, m in (("x", 3), ("y", 3), ("z", 2)) for i in range(12) if i % m == 0] + [("g", "w", f"s{i}", 1.0, 0) for i in range(12)], "g string, feature string, sample string, dose double, y int")
    pheno = spark.createDataFrame([(f"s{i}", float(i % 3 == 0) + 0.01 * i, 1) for i in range(12)], "sample string, y double, feature int")
    assert [(r.n_features, r.meff) for r in api.associate_locus(doses, pheno, "g", "effective").collect()] == [(4, 2.0)]
    assert [(r.feature, r.step) for r in api.associate_locus(doses, pheno, "g", "conditional").collect()] == [("x", 1)]
    with pytest.raises(ValueError):
        api.associate_locus(doses, pheno, "g", "other")
