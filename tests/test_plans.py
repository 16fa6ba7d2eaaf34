"""Queries over small tables written for the case at hand."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spangraph.functions import seq as S
from spangraph.functions import tails
from spangraph.operators import assoc as Assoc
from spangraph.operators import locus as L
from spangraph.operators import sites as T
from spangraph.operators import walks as K
from spangraph.plans import calls as C
from spangraph.plans import walks as P

PACKED = {
    "carrier_events": ([], "row_no long, haplotypes string"),
    "unit_graphs": ([], "row_no long, anchor_nodes string, nodes string"),
}


def tables(spark, tmp_path, **named):
    for name, (data, schema) in {**PACKED, **named}.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_passes_through_every_packing_of_inside_nodes(spark, tmp_path):
    packed = ["2;3", "2,3", "[2|3]", "2/3", "2\t3", '"2 3"', "'2','3'"]
    sites = [(i, i, None if i == 1 else 2, x) for i, x in enumerate(packed)] + [(90, 90, 2, None), (91, 1, 1, "4")]
    folder = tables(
        spark, tmp_path,
        bubble_sites=(sites, "row_no long, bubble_id long, inside_node_count long, inside_nodes string"),
        graph_paths=([("g", "p", ">1>2>3>4>2>5")], "graph_name string, path_name string, steps string"),
    )
    got = rows(P.site_passes(spark, folder), "bubble_id", "path_name", "passes", "longest")
    assert got == [(i, "p", 2, 2) for i in range(len(packed))]


SITE = "row_no long, bubble_id long, source_node string, source_orient string, sink_node string, sink_orient string"
PATHS = "graph_name string, path_name string, steps string"
NODES = "node_id string, sequence string, length_bp long"


def test_alleles_without_nodes_or_lengths_stay(spark, tmp_path):
    """Site 1: the most carried allele is empty; site 2: the empty one is rare; site 3: nodes of no known length weigh 1."""
    walks = [">a>b", ">a>b", ">a>x>b", ">c>x>y>d", ">c>x>y>d", ">c>d", ">e>u>v>f", ">e>u>v>f", ">e>u>w>f"]
    folder = tables(
        spark, tmp_path,
        bubble_sites=([(1, 1, "a", "+", "b", "+"), (2, 2, "c", "+", "d", "+"), (3, 3, "e", "+", "f", "+")], SITE),
        graph_paths=([("g", f"p{i}", w) for i, w in enumerate(walks)], PATHS),
        graph_nodes=([("x", "ACGT", None), ("y", None, 6), ("u", None, None), ("v", "*", None), ("a", "A", 1)], NODES),
    )
    assert rows(C.allele_similarity(spark, folder), "bubble_id", "allele", "jaccard") == [(1, 2, 0.0), (2, 2, 0.0), (3, 2, 0.333333)]
    got = rows(C.allele_clusters(spark, folder), "bubble_id", "allele", "leader")
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2)]


def conditional(spark, m, y):
    doses, who = dose_frames(spark, m, y)
    return [tuple(r) for r in L.conditional(doses, who, "g", cells=2000).orderBy("step").collect()]


def dose_frames(spark, m, y, g="g"):
    doses = pd.DataFrame([(g, i, f"s{j:04d}", v) for i, row in enumerate(m) for j, v in enumerate(row) if v], columns=["g", "feature", "sample", "dose"])
    who = pd.DataFrame({"g": g, "sample": [f"s{j:04d}" for j in range(len(y))], "y": y})
    return spark.createDataFrame(doses, "g string, feature long, sample string, dose double"), spark.createDataFrame(who, "g string, sample string, y double")


def test_selection_goes_on_while_features_clear_the_bar(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 3, (30, 400)).astype(float)
    y = m[:14].sum(axis=0) + 0.2 * rng.normal(size=400)
    got = conditional(spark, m, y)
    assert {r[1] for r in got} == set(range(14)) and [r[2] for r in got] == list(range(1, 15))


def test_selection_drops_what_later_features_explain(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 300))
    y = a + b + 0.3 * rng.normal(size=300)
    got = conditional(spark, np.array([a, b, a + b + 0.5 * rng.normal(size=300)]), y)
    assert {r[1] for r in got} == {0, 1} and [r[2] for r in got] == [1, 2]


def test_locus_models_in_blocks_equal_the_dense_ones(spark):
    rng = np.random.default_rng(11)
    m = rng.binomial(2, rng.uniform(0.02, 0.5, (90, 1)), (90, 40)).astype(float)
    m[7], m[8], m[9] = m[6], 1, 2 * m[6]  # copies and a feature that does not vary
    y = m[3] + rng.normal(size=40)
    doses, who = dose_frames(spark, m, y)
    live = m[m.std(axis=1) > 0]
    for cells in (60, 4_000_000):  # dozens of blocks, and one
        (e,) = L.effective(doses, who, "g", cells=cells).collect()
        assert (e.n_features, e.meff) == ((m.sum(axis=1) > 0).sum(), Assoc.effective_tests(m))
        (k,) = L.kernel(doses, who, "g", cells=cells).collect()
        share, weight = L.rarity(live)
        z, r = L.rare_rows(live), y - y.mean()
        assert k.n_features == len(live) and k.q == pytest.approx(((z @ r) ** 2).sum() / r.var(ddof=1))
        assert (k.p_burden, k.p_kernel, k.p_optimal) == pytest.approx(Assoc.kernel_tests(z, r), rel=1e-4)
        single = [tails.normal_two_sided(v) for v in L.unit_rows(live) @ r / r.std(ddof=1)]
        assert k.p_cauchy == pytest.approx(tails.cauchy([k.p_burden, k.p_kernel, tails.cauchy(single, weight**2 * np.maximum(share * (1 - share), 1e-12))]))
        u, x = L.unit_rows(live) * np.sqrt(40), np.ones((40, 1))
        _, values, vectors = Assoc.mixed_null(y, x, u.T @ u / len(u))
        found = {f.feature: (f.beta, f.se, f.p) for f in L.mixed_model(doses, who, "g", cells=cells).collect()}
        assert len(found) == len(live) and all(found[i] == pytest.approx(Assoc.mixed_test(m[i], y, x, None, values, vectors), rel=1e-4) for i in found)


def test_locus_models_on_nulls_small_groups_and_nothing(spark):
    rng = np.random.default_rng(12)
    m, y = rng.integers(0, 3, (5, 12)).astype(float), rng.normal(size=12)
    doses, who = dose_frames(spark, m, y)
    few, trio = dose_frames(spark, m[:, :3], y[:3], "few")
    same, flat = dose_frames(spark, m, np.ones(12), "same")
    odd = spark.createDataFrame([("g", 1, None, 1.0), ("g", 2, "s9999", 2.0), ("g", 4, "s0000x", None), ("lost", 1, "s0001", 1.0)], doses.schema)
    blank = spark.createDataFrame([("g", "s0000x", None)], who.schema)
    more = doses.unionByName(few).unionByName(same).unionByName(odd).selectExpr("*", "1 as block", "'x' as held")
    axis = who.unionByName(trio).unionByName(flat).unionByName(blank).selectExpr("*", "1 as block", "2 as vector")
    for model in (L.effective, L.kernel, L.mixed_model, L.conditional):
        plain = rows(model(doses, who, "g"))
        got = [r for r in rows(model(more, axis.drop("vector") if model is L.mixed_model else axis, "g")) if r[0] != "same"]
        assert [r[:2] for r in got] == [r[:2] for r in plain] and {r[0] for r in got} <= {"g"}
        assert rows(model(doses.limit(0), who, "g")) == [] and rows(model(doses, who.limit(0), "g")) == []


def brute_runs(word):
    found = []
    for p in range(1, len(word) // 2 + 1):
        i = p
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[j - p]:
                j += 1
            if j - i >= p and not any(p % d == 0 and a <= i - p and b >= j - 1 for d, a, b, _ in found):
                found.append((p, i - p, j - 1, (j - i) // p + 1))
            i = max(j, i + 1)
    return found


def test_repeats_of_any_period_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["abcde" * 3, "x" + "abcdefgh" * 2, "aaaaaa", "ababab", "abcabd"] + ["".join(rng.choices("ab", k=rng.randint(1, 25))) for _ in range(40)]
    walked = K.explode_steps(spark.createDataFrame([(f"p{i}", "".join(">" + c for c in w)) for i, w in enumerate(words)], "path_name string, walk string"))
    want = sorted(((f"p{i}", *r) for i, w in enumerate(words) for r in brute_runs(w)), key=str)
    assert ("p0", 5, 0, 14, 3) in want and ("p1", 8, 1, 16, 2) in want
    assert rows(K.tandem_runs(walked), "path_name", "period", "first_idx", "last_idx", "copies") == want


def test_long_alleles_keep_their_events(spark, tmp_path):
    mine = [">p", *(f">{i}" for i in range(2100)), ">q"]
    other = [">r", *(f">{i}" for i in range(2100) if not 700 <= i < 710), ">s"]
    folder = tables(
        spark, tmp_path,
        bubble_sites=([(1, 1, "a", "+", "b", "+")], SITE),
        graph_paths=([("g", f"w{i}", ">a" + "".join(w) + ">b") for i, w in enumerate([mine, mine, other])], PATHS),
        graph_nodes=([(str(i), None, 3) for i in range(2100)], NODES),
    )
    got = rows(C.allele_events(spark, folder), "allele", "event", "kind", "del_bp", "ins_bp")
    assert got == [(2, 0, "sub", 0, 0), (2, 1, "del", 30, 0), (2, 2, "sub", 0, 0)]


def test_alignment_by_halves_is_as_good():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("<>") + rng.choice("123") for _ in range(rng.randint(0, 14))] for _ in range(2))
        differ = [sum(i1 - i0 + j1 - j0 for _, i0, i1, j0, j1 in e) for e in (C.align_any(a, b, 5), C.align_tokens(a, b))]
        assert differ[0] == differ[1]
        i = j = 0
        for _, i0, i1, j0, j1 in [*C.align_any(a, b, 5), ("end", len(a), 0, len(b), 0)]:
            assert a[i:i0] == b[j:j0]
            i, j = i1, j1


def test_copies_split_between_near_identical_sequences(spark):
    rng = random.Random(8)
    a = "".join(rng.choices("ACGT", k=240))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    b = "".join(other[c] if i in (60, 130, 200) else c for i, c in enumerate(a))
    texts = {"aab": [a, a, b], "b": [b], "mixed": [a[:100] + b[100:]], "nothing": ["ACGT"], "unknown": [a]}
    haps = spark.createDataFrame([("p", h, f"{h}{i}", t) for h, ts in texts.items() for i, t in enumerate(ts)], "pair string, hap string, piece string, text string")
    words = S.kmer_codes(haps, ["pair", "hap", "piece"], "text", 11).groupBy("pair", "hap", "kmer").count().selectExpr("pair", "hap", "kmer", "count as n", "1 as total")
    totals = spark.createDataFrame([("p", h, None if h == "unknown" else len(t), "x") for h, t in texts.items()], "pair string, hap string, total long, share string")
    pairs = spark.createDataFrame([("p", a, b, 1), ("null", a, None, 1), ("same", a, a, 1), ("blank", "", "", 1)], "pair string, a string, b string, kmer int")
    got = rows(T.paralog_split(pairs, words, totals))
    assert got == [("p", "aab", 3, 3, 0.666667, 2, 1), ("p", "b", 1, 3, 0.0, 0, 1), ("p", "mixed", 1, 3, 0.0, 0, 1), ("p", "unknown", None, 3, 1.0, None, None)]
    assert rows(T.paralog_split(pairs.limit(0), words, totals)) == [] and rows(T.paralog_split(pairs, words.limit(0), totals)) == []


@pytest.fixture(scope="module")
def many_samples(spark, tmp_path_factory):
    """5 000 samples with balances near 9 000: products of their sums in cents leave the range of a long."""
    n, rng = 5000, random.Random(5)
    walks = [("g", f"smp{i:07d}#1#c", f"smp{i:07d}", 1, "c", ">1" + (">2" if rng.random() < 0.4 else "") + (">3>3" if rng.random() < 0.3 else "") + (">4" if i % 700 == 0 else "")) for i in range(1, n + 1)]
    who = [(i, round(9000 + 900 * rng.random() + (60 if ">2" in walks[i - 1][5] else 0), 2), rng.choice(["BUILDING", "MACHINERY"]), i % 25) for i in range(1, n + 1)]
    return tables(
        spark, tmp_path_factory.mktemp("many"),
        graph_paths=(walks, "graph_name string, path_name string, sample_name string, haplotype int, contig string, steps string"),
        customer=(who, "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int"),
    )


def equals_sql(spark, folder, name):
    """The rows of a query; compared with its SQL where it has one."""
    con, query = duckdb.connect(), entry.queries()[name](spark, folder)
    for table in ("graph_paths", "customer"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = query.collect()
    if name in entry.oracle_sql():
        want = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(map(str, want.fetchall()))
    return got


@pytest.mark.parametrize("name, n_rows", [
    ("assoc_lambda", 1),
    ("assoc_meff", 3),
    ("burden", 1),
    ("assoc_genotypic", 4),
    ("assoc_linear", 4),
    ("assoc_tested", 3),
    ("ld_clumps", 3),
    ("assoc_layers", 1),
    ("assoc_ranked", 3),
    ("layer_bootstrap", 1),
    ("lead_conditioned", 2),
    ("lead_tested", 2),
])
def test_association_of_many_samples(spark, many_samples, name, n_rows):
    got = equals_sql(spark, many_samples, name)
    assert len(got) == n_rows and None not in [x for r in got for c, x in r.asDict().items() if c in ("p", "q", "p_meff", "lambda_gc", "best_t")]


@pytest.mark.parametrize("name", [
    "private_dosage",
    "window_ceilings",
])
def test_index_is_worked_out_once(spark, name):
    """The k-mers of the index are a written table in the plan, not worked out again wherever they are read; results are those of the SQL."""
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    made = entry.queries()[name](spark, folder)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for table in ("graph_paths", "graph_nodes"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(str(tuple(r)) for r in made.select(*columns).collect()) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def odd_loci(spark, tmp_path_factory):
    """Beside a locus of 8 samples: one of 2, one whose features do not vary, and one of samples without a phenotype."""
    walk = lambda g, i, steps: (g, f"smp{i}#1#{g}", f"smp{i}", 1, g, steps)
    walks = [walk("g", i, ">1>2" if i % 2 else ">1>3>3") for i in range(1, 9)] + [walk("h", i, ">4" + ">5" * i) for i in (1, 2)]
    walks += [walk("k", i, ">6>7") for i in range(1, 9)] + [walk("z", i, ">8" + ">9" * (i % 2)) for i in range(91, 99)]
    return tables(
        spark, tmp_path_factory.mktemp("odd"),
        graph_paths=(walks, "graph_name string, path_name string, sample_name string, haplotype int, contig string, steps string"),
        customer=([(i, 10.0 * i * i, "BUILDING") for i in range(1, 9)], "c_custkey long, c_acctbal double, c_mktsegment string"),
    )


def test_permutation_leaves_out_loci_without_a_result(spark, odd_loci):
    assert [r["graph_name"] for r in entry.queries()["locus_permutation"](spark, odd_loci).collect()] == ["g"]


def test_fine_map_leaves_out_loci_without_a_result(spark, odd_loci):
    assert {r["graph_name"] for r in entry.queries()["locus_fine_map"](spark, odd_loci).collect()} == {"g", "k"}


def test_alleles_split_without_shuffled_kmers(spark, tmp_path):
    """Alleles are read one after another, so no k-mer is shuffled; results are those of the SQL, with empty, unknown, turned and repeated alleles."""
    rng, con = random.Random(3), duckdb.connect()
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    one, end = text(90), text(40)
    parts = {"a": text(20), "b": text(20), "x": one, "y": one[:40] + text(3) + one[43:70] + text(1) + one[71:], "s": "acgtn", "u": None, "e": end, "f": end[:25] + text(2) + end[27:], "c": text(20), "d": text(20)}
    inside = [">x>e", ">x>e", ">x>e", ">y>f", ">y>f", ">y>e", "", ">s", ">u>x", "<x", ">x>f>y"]
    walks = [("g", f"w{i:02d}", f"s{i}", 1, "c", f">a{w}>b>c{'>x' if i % 3 else w}>d" + (f">a{inside[i - 3]}>b" if i % 2 else "")) for i, w in enumerate(inside)]
    walks += [("g", "back", "s", 1, "c", "<b<f<y<a<d<x<c")]
    folder = tables(
        spark, tmp_path, graph_nodes=([(n, t, len(t or "N" * 15)) for n, t in parts.items()], NODES),
        graph_paths=(walks, "graph_name string, path_name string, sample_name string, haplotype int, contig string, steps string"),
        bubble_sites=([(1, 1, "a", "+", "b", "+"), (2, 2, "c", "+", "d", "+"), (3, 3, "a", "+", "d", "+"), (4, 4, "u", "+", "x", "+"), (5, None, "a", "+", "b", "+")], SITE),
    )
    made = entry.queries()["allele_split"](spark, folder)
    assert "kmer" not in made._jdf.queryExecution().executedPlan().toString()
    for table in ("graph_paths", "graph_nodes", "bubble_sites"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["allele_split"])
    columns = [c[0] for c in want.description]
    want = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in made.select(*columns).collect()) == want and len(want) > 10


def test_stretches_of_texts_without_kmers():
    empty, some = np.zeros(0, np.int64), np.array([3, 5, 3, 9])
    for a, b in ((empty, empty), (some, empty), (empty, some), (some, some)):
        assert all(len(x) == 0 for x in T._stretches(a, b))
    site, kmer, is_a, size_a, size_b = T._stretches(np.array([1, 7, 7, 2, 8, 3]), np.array([1, 4, 2, 3, 6]))
    assert (site.tolist(), kmer.tolist(), is_a.tolist(), size_a.tolist(), size_b.tolist()) == ([0, 0], [4, 7], [False, True], [1], [1])
