"""Core operators on small fixtures: brute force, hand-derived numbers, round trips, and odd inputs."""

import math
import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spangraph.functions import seq as S
from spangraph.functions import tails
from spangraph.operators import assoc as A
from spangraph.operators import bad_rows as B
from spangraph.operators import heavy_keys as H
from spangraph.operators import intervals as I
from spangraph.operators import recruit as R
from spangraph.operators import walks as K
from spangraph.operators.cluster import connected_components, greedy_leaders
from spangraph.operators.packed import delimiter_scores, unpack
from spangraph.operators.store import KmerStore
from spangraph.plans.bad_rows import NAMES, RULES
from spangraph.plans.calls import align_tokens
from spangraph.sources import gfa, tables
from spangraph.streaming.streams import mates, recruit_stream


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# packed fields


def test_unpack(spark):
    data = [
        ("name", 1, 'a1#1#c2,"a2#1#c2, alt";a3#2#c9', 0), ("name", 2, "['a1#1#c2' 'a2#2#c3']", 0), ("name", 3, '"x ""folded"" y"', 0), ("name", 4, None, 0),
        ("name", 5, " ", 0), ("name", 6, "NA", 0), ("name", 7, "a1#1#c2,,.,a1#1#c2", 0), ("name", 7, "a1#1#c2,,.,a1#1#c2", 0), ("name", 8, "a1#1#c2;a2#1#c2;a3#1#c2", 0),
        ("id", 1, '"1;2;3"', 0), ("id", 2, "4/5", 0), ("id", 3, "[6, 7]", 0), ("id", 4, "s8|NA|s9", 0), ("id", 5, "1 2\t3", 0), ("id", 6, ";".join(map(str, range(5000))), 0), ("id", 7, "10", 0),
    ]
    df = spark.createDataFrame(data, "src string, row_no long, packed string, delims int")
    got = {}
    for s, r, p, v in sorted((r.src, r.row_no, r.pos, r.val) for r in unpack(df, "src", ["row_no"], "packed", protected=("name",)).collect()):
        got.setdefault((s, r), []).append((p, v))
    val = {k: [v for _, v in x] for k, x in got.items()}
    assert val["name", 1] == ["a1#1#c2", "a2#1#c2, alt", "a3#2#c9"] and [p for p, _ in got["name", 1]] == [1, 2, 3]
    assert val["name", 2] == ["a1#1#c2", "a2#2#c3"] and val["name", 3] == ['x "folded" y']
    assert not {("name", 4), ("name", 5), ("name", 6)} & set(val)
    assert got["name", 7] == [(1, "a1#1#c2"), (1, "a1#1#c2"), (2, "a1#1#c2"), (2, "a1#1#c2")]
    assert val["id", 1] == ["1", "2", "3"] and val["id", 2] == ["4", "5"] and val["id", 3] == ["6", "7"] and val["id", 4] == ["s8", "s9"]
    assert val["id", 5] == ["1", "2", "3"] and len(val["id", 6]) == 5000 and val["id", 7] == ["10"]
    scored = {(r.source, r.delimiter): r.accepted for r in delimiter_scores(df, "src", "packed", ("name",)).collect()}
    assert scored["id", ";"] and ("name", "/") not in scored
    assert unpack(df.limit(0), "src", ["row_no"], "packed").count() == 0


# heavy keys


def test_key_totals(spark):
    df = spark.createDataFrame([(1, "hot", 5, "x"), (2, "hot", None, "y"), (3, "cold", 1, None), (4, None, 9, "z"), (5, "hot", 5, "x")], "id long, k string, n int, v string")
    assert rows(H.key_totals(df, "k", "n")) == [("cold", 1), ("hot", 10)]
    assert rows(H.key_totals(df, "k", "n", "v")) == [("cold", 1, 0), ("hot", 10, 2)]
    assert rows(H.heavy_keys(df, "k", "n", 2)) == [("k", "hot")]
    assert H.heavy_keys(df.limit(0), "k", "n", 2).count() == 0
    twice = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (2, None, "c")], "id long, at int, v string")
    assert rows(H.first_arrivals(twice, "id", "at"), "id", "v") == [(1, "a"), (2, "c")]


# bad rows


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("p,c,1,2,true,false,P", None), ('"p, ""q"" \n r",c, 007 ,2,"1",0,P', None), ("p,c,9223372036854775807,2,TRUE,0,P", None),
        ("p,c,9223372036854775808,2,TRUE,0,P", "region_start_1based"), ("p,c,0,2,true,false,P", "region_start_1based"), ("p,c,+1,2,true,false,P", "region_start_1based"),
        ("p,c,９,2,true,false,P", "region_start_1based"), ("p,c,,2,x,y,P", "region_start_1based"), ("p,c,1,2,yes,false,P", "half_open"), ("p,c,1,2,1,null,P", "length_mismatch"),
        ('p"q,c,1,2,1,0,P', "quoting"), ('"p,c,1,2,1,0,P', "quoting"), (' "p",c,1,2,1,0,P', "quoting"), ('"p" ,c,1,2,1,0,P', "quoting"), ('p,"', "quoting"),
        ("p,c,1", "column_count"), (None, "column_count"), ("", "column_count"), ("  \t", "column_count"), ("p,c,1,2,1,0,P,", "column_count"), (",,1,,1,0,", None),
        ("x," * 30000, "column_count"), ('"' + 'a""' * 30000 + '",c,1,2,1,0,P', None),
    ],
)
def test_bad_rows(spark, line, reason):
    df = spark.createDataFrame([(1, line, "extra")], "raw_id long, line string, errors_seen string")
    out = B.with_errors(df, "line", NAMES, RULES)
    assert [r.reason for r in B.rejected(out, ["raw_id"]).collect()] == ([reason] if reason else [])
    assert B.accepted(out).count() == (0 if reason else 1)
    assert B.with_errors(df.limit(0), "line", NAMES, RULES).count() == 0


# sequences


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def mix(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * S.MIX_1 & m
    x = (x ^ x >> 27) * S.MIX_2 & m
    return x ^ x >> 31


def code(s):
    return int(s.translate(str.maketrans("ACGT", "0123")), 4)


def test_kmer_functions(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT" + "N" * (i % 2)) for _ in range(rng.randint(0, 70))) for i in range(80)] + ["A" * 40, "acgtACGT", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {r.id: r.k for r in df.select("id", S.canonical_kmers(F.col("s"), 5).alias("k")).collect()}
    for i, t in enumerate(texts):
        up = (t or "").upper()
        want = [min(w, revcomp(w)) if set(w) <= set("ACGT") else None for w in (up[j : j + 5] for j in range(len(up) - 4))]
        assert (got[i] or []) == want
    plain = [t.upper() for t in texts if t and len(t) >= 21 and set(t) <= set("ACGT")]
    words = spark.createDataFrame([(t[:21],) for t in plain], "w string")
    hashed = {r.w: r.h & (1 << 64) - 1 for r in S.with_mix64(words, S.encode(F.col("w")), "h").collect()}
    assert hashed == {t[:21]: mix(code(t[:21])) for t in plain}
    assert all(r.back for r in words.select((S.decode(S.encode(F.col("w")), 21) == F.col("w")).alias("back")).collect())
    spots = {(r.id, r.pos) for r in R.syncmers(df.where("s is not null"), ["id"], "s", 21, 7).collect()}
    for i, t in enumerate(texts):
        up = (t or "").upper()
        for j in range(len(up) - 20):
            w = up[j : j + 21]
            if set(w) <= set("ACGT"):
                h = [mix(code(min(w[a : a + 7], revcomp(w[a : a + 7])))) for a in range(15)]
                assert ((i, j) in spots) == (min(h) in (h[0], h[-1]))
            else:
                assert (i, j) not in spots


def test_texts_are_worked_a_bounded_number_of_letters_at_a_time():
    """A batch of long texts is cut by letters, so the arrays of its k-mers, about 58 bytes a letter, do not grow with the batch."""
    texts = ["ACGT" * (i % 9 * 10) for i in range(500)] + ["", None, "A" * 3000, "C"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(S.bounded(iter([batch, batch.slice(0, 0)]), 1, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[1:]) <= 1000 for p in parts) and len(parts) > 50


def test_small_functions(spark):
    df = spark.createDataFrame([("ACACAC", "A;b=c,%\t", "II#")], "s string, t string, q string")
    r = df.select(
        S.reverse_complement(F.lit("AcgN")).alias("rc"), S.least_rotation(F.lit("TGA")).alias("rot"), S.shortest_period(F.col("s")).alias("period"), S.dust(F.lit("A" * 31)).alias("dust"),
        S.percent_escape(F.col("t")).alias("esc"), (S.percent_unescape(S.percent_escape(F.col("t"))) == F.col("t")).alias("back"), S.error_rate(F.col("q")).alias("err"), S.error_rate(F.lit("")).alias("none"),
    ).first()
    assert (r.rc, r.rot, r.period, r.dust) == ("NcgT", "ATC", 2, 14.5)
    assert r.esc == "A%3Bb%3Dc%2C%25%09" and r.back and r.none == 0.01 and r.err == 0.08
    gap, flank = df.select(*[c.alias(str(i)) for i, c in enumerate(R.costs(F.lit(0.01)))]).first()
    q = (1 - 0.011) ** 31
    assert gap == pytest.approx(0.5 * q / (1 - q)) and flank == pytest.approx(0.25 * q)


# intervals


def test_intervals_equal_brute_force(spark):
    rng = random.Random(4)
    span = lambda: (rng.choice("xyz"), *sorted((rng.randint(0, 300), rng.randint(0, 300))))
    a, b = [(i, *span()) for i in range(80)], [(i, *span()) for i in range(60)]
    left = spark.createDataFrame([*a, (900, "x", None, 3)], "i long, k string, lo long, hi long")
    right = spark.createDataFrame(b, "j long, k string, c long, d long")
    want = sorted((i, j) for i, k, lo, hi in a for j, m, c, d in b if k == m and lo < d and c < hi and lo < hi and c < d)
    assert sorted(tuple(r) for r in I.overlap_join(left, right, "k", ("lo", "hi"), ("c", "d"), 17).select("i", "j").collect()) == want
    cover = lambda rows, key: {p for _, k, lo, hi in rows if k == key for p in range(lo, hi)}
    for out, expect in ((I.merge(left, ["k"], "lo", "hi"), lambda k: cover(a, k)), (I.subtract(left, right, "k", "lo", "hi", "c", "d"), lambda k: cover(a, k) - cover(b, k))):
        for key in "xyz":
            spans = sorted((r.lo, r.hi) for r in out.where(F.col("k") == key).collect())
            assert {p for lo, hi in spans for p in range(lo, hi)} == expect(key)
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


# walks


def test_walks(spark):
    p = spark.createDataFrame([("r", "1+,2+,3+,4+"), ("d", "1+,3+,1+,3+,4+"), ("i", ">1<2>3>4"), ("x", "*"), ("n", None), ("r", "1+,2+,3+,4+")], "path_name string, steps string")
    n = spark.createDataFrame([("1", "AA", 2), ("2", "ACG", 3), ("3", None, 4), ("4", "*", None)], "node_id string, sequence string, length_bp long")
    walked, nodes = K.explode_steps(K.distinct_paths(p)), K.distinct_nodes(n)
    assert rows(walked.where("path_name = 'i'"), "idx", "step") == [(0, ">1"), (1, "<2"), (2, ">3"), (3, ">4")]
    assert rows(K.spelled(walked, nodes)) == [("d", "AANNNNAANNNN"), ("i", "AACGTNNNN"), ("r", "AAACGNNNN")]
    assert rows(K.coordinates(walked, nodes).where("path_name = 'r'"), "start_bp", "end_bp") == [(0, 2), (2, 5), (5, 9), (9, 9)]
    site = spark.createDataFrame([(7, 1, "1", "+", "3", "+")], "bubble_id long, row_no long, source_node string, source_orient string, sink_node string, sink_orient string")
    found = K.signatures(K.crossings(site, walked), K.step_arrays(K.distinct_paths(p)))
    assert rows(found, "path_name", "crossing", "signature") == [("d", 1, ""), ("d", 2, ""), ("i", 1, "<2"), ("r", 1, ">2")]
    assert rows(K.tandem_runs(walked), "path_name", "period", "first_idx", "last_idx", "copies") == [("d", 2, 0, 3, 2)]
    back = spark.createDataFrame([("b", "4-,3-,2-,1-")], "path_name string, steps string")
    turned = K.signatures(K.crossings(site, K.explode_steps(K.distinct_paths(back))), K.step_arrays(K.distinct_paths(back)))
    assert rows(turned, "forward", "signature") == [(False, ">2")]


def test_alignment_blocks():
    assert align_tokens([">1", ">2", ">3"], [">1", ">3"]) == [("del", 1, 2, 1, 1)]
    assert align_tokens([">1", ">3"], [">1", ">2", ">2", ">3"]) == [("ins", 1, 1, 1, 3)]
    assert align_tokens([">1", ">2", ">3", ">4"], [">1", "<3", "<2", ">4"]) == [("inv", 1, 3, 1, 3)]
    assert align_tokens([], []) == [] and align_tokens([">1"] * 10, [">1"] * 10, cap=5) is None


# clusters


def test_components_and_leaders(spark):
    links = spark.createDataFrame([*[(i, i + 1) for i in range(1, 40)], (100, 101), (5, 5), (None, 3)], "a long, b long")
    got = dict(rows(connected_components(links, "a", "b")))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and 5 in got
    assert connected_components(links.limit(0), "a", "b").count() == 0
    scored = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("g", "d", 4)], "g string, item string, rank int")
    near = spark.createDataFrame([("g", "b", "a"), ("g", "a", "b"), ("g", "c", "b"), ("g", "b", "c")], "g string, item string, other string")
    assert rows(greedy_leaders(scored, "g", "item", "rank", near, "other"), "item", "leader") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


# association


def test_linear_model_of_the_hand_derived_case(spark):
    y = [2.1, 3.4, 5.2, 2.8, 3.9, 5.9, 3.2, 4.6, 6.1, 3.7, 4.9, 6.8]
    pheno = spark.createDataFrame([(i, v, float(i + 1)) for i, v in enumerate(y)], "sample long, y double, c double")
    doses = spark.createDataFrame([("f", i, i % 3) for i in range(12) if i % 3], "feature string, sample long, dose int")
    r = A.linear_with_covariates(doses, pheno, ["c"]).first()
    assert (r.beta, r.se, r.df) == (pytest.approx(1.353888889, rel=1e-9), pytest.approx(0.06632396484, rel=1e-9), 9)
    p = tails.t_two_sided(r.t, r.df)
    assert p == pytest.approx(7.58033045421e-09, rel=1e-8)
    assert tails.chi2_of_p(p) / 0.4549364 == pytest.approx(73.37267376, rel=1e-6)
    plain = A.linear(A.sums(doses, pheno.select("sample", "y"))).first()
    x = np.array([i % 3 for i in range(12)])
    assert plain.beta == pytest.approx(np.polyfit(x, y, 1)[0])


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-10)
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(tails.t_two_sided(2.0, 10), rel=1e-10)
    assert tails.chi2_tail(3.84145882069412, 1) == pytest.approx(0.05, rel=1e-10) and tails.chi2_tail(50, 2) == pytest.approx(math.exp(-25), rel=1e-10)
    for p in (1e-12, 0.01, 0.3, 0.5, 0.999):
        assert 0.5 * math.erfc(-tails.normal_quantile(p) / math.sqrt(2)) == pytest.approx(p, rel=1e-9)


def test_mixture_and_rare_tails():
    rng = np.random.default_rng(3)
    for weights in ([1.0, 1.0], [3.0, 1.0, 0.2], [1.0] * 6):
        for q in (0.5, 4.0, 20.0):
            sample = (rng.normal(size=(400_000, len(weights))) ** 2) @ np.array(weights)
            assert tails.mixture_tail(q, weights) == pytest.approx(float((sample >= q).mean()), abs=0.004)
    assert tails.mixture_tail(9.0, [1.0, 1.0]) == pytest.approx(math.exp(-4.5), rel=1e-5)
    doses, rates = [1, 2, 1, 1], [0.1, 0.3, 0.2, 0.5]
    want = 0.0
    for bits in range(16):
        y = [bits >> i & 1 for i in range(4)]
        s = sum(g * (v - r) for g, v, r in zip(doses, y, rates))
        want += math.prod(r if v else 1 - r for v, r in zip(y, rates)) * (abs(s) >= 1.5 - 1e-9)
    assert tails.exact_tail(doses, rates, 1.5) == pytest.approx(want)
    assert tails.exact_tail([1] * 17, [0.1] * 17, 1) is None
    many = [1] * 16
    for observed in (5.4, 7.4):
        assert tails.saddlepoint_tail(many, [0.1] * 16, observed - 0.5) == pytest.approx(tails.exact_tail(many, [0.1] * 16, observed), rel=0.6)


def test_tails_by_dose_classes():
    doses, rates = [1] * 5 + [2] * 4, [0.1] * 5 + [0.1] * 4
    for observed in (0.0, 0.4, 2.3, 5.1, 11.7, 30.0):
        assert tails.classes_tail([1, 2], [5, 4], [0.1, 0.1], observed) == pytest.approx(tails.exact_tail(doses, rates, observed), rel=1e-9, abs=1e-300)
    assert tails.classes_tail([1, -2], [3, 2], [0.3, 0.6], 2.0) == pytest.approx(tails.exact_tail([1] * 3 + [-2] * 2, [0.3] * 3 + [0.6] * 2, 2.0), rel=1e-9)
    # 400 carriers, hand-summed in logarithms
    n, r, k = 400, 0.01, 30
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(r) + (n - i) * math.log1p(-r)) for i in range(k, n + 1))
    assert tails.classes_tail([1], [n], [r], k - n * r) == pytest.approx(want, rel=1e-7)
    assert tails.saddlepoint_tail([1], [r], k - n * r - 0.5, [n]) == pytest.approx(want, rel=0.2)


def test_score_test_beside_a_covariate(spark):
    rng = np.random.default_rng(7)
    g, c = rng.integers(0, 3, 300), rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(c + 0.5 * g - 1)))).astype(int)
    pheno = spark.createDataFrame([(i, int(y[i]), float(c[i])) for i in range(300)] + [(999, None, 0.0)], "sample long, y long, c double")
    doses = spark.createDataFrame([("f", i, int(v)) for i, v in enumerate(g) if v], "feature string, sample long, dose long")
    got = A.score_with_covariates(doses, pheno, ["c"]).first()
    x = np.column_stack([np.ones(300), c])
    beta, _ = A.logistic(x, y.astype(float))
    mu = 1 / (1 + np.exp(-x @ beta))
    w = mu * (1 - mu)
    v = (w * g * g).sum() - (w * g) @ x @ np.linalg.inv(x.T @ (w[:, None] * x)) @ x.T @ (w * g)
    assert (got.u, got.v) == pytest.approx(((g * (y - mu)).sum(), v), rel=1e-6) and got.z == pytest.approx(got.u / math.sqrt(v), rel=1e-6)


def test_effective_tests_and_variance_ratio():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 500))
    assert A.effective_tests(np.array([a, a, -a, 3 * a + 1])) == 1.0 and A.effective_tests(np.array([a, a, np.ones(500)])) == 1.0
    assert A.effective_tests(np.array([a, b])) == 2.0 and A.effective_tests(np.ones((3, 9))) == 0.0
    half = rng.normal(size=(120, 60))
    kinship = half @ half.T / 60
    y = np.linalg.cholesky(kinship + 1e-6 * np.eye(120)) @ rng.normal(size=120) + 0.7 * rng.normal(size=120)
    x = np.ones((120, 1))
    delta, values, vectors = A.mixed_null(y, x, kinship)

    def likelihood(d):
        v = kinship + d * np.eye(120)
        inv = np.linalg.inv(v)
        r = y - x @ np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
        return -0.5 * (119 * math.log(r @ inv @ r) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ inv @ x)[1])

    assert all(likelihood(delta) >= likelihood(delta * f) - 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2.0))


def test_correction(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    out = A.adjusted(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "feature string, p double"), "feature", "p")
    assert {r.feature: (round(r.bonferroni, 9), round(r.q, 9)) for r in out.collect()} == {"3": (0.02, 0.02), "0": (0.04, 0.02), "2": (0.12, 0.04), "1": (0.16, 0.04)}


def test_correction_of_ties_and_many_ranges(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(3000), 3).tolist() + [0.5] * 700 + [float("nan")]
    out = A.adjusted(spark.createDataFrame(list(enumerate(p)), "feature long, p double"), "feature", "p").collect()
    known = np.sort(np.array(p[:-1]))
    step = np.minimum(1, known * len(known) / np.arange(1, len(known) + 1))
    q = dict(zip(known.tolist(), np.minimum.accumulate(step[::-1])[::-1].tolist()))  # the first of a tie holds the least
    first = {v: min(q[v], min(x for k, x in q.items() if k >= v)) for v in set(known.tolist())}
    assert len(out) == len(known) and all(r.q == pytest.approx(first[r.p], abs=1e-12) for r in out)
    assert A.adjusted(spark.createDataFrame([], "feature long, p double"), "feature", "p").count() == 0


def test_running_counts(spark):
    v = [3, 1, 1, 2, None, 3, 3]
    out = A.running_counts(spark.createDataFrame([(x,) for x in v], "v long"), "v", blocks=2)
    assert sorted((r.v, r.c, r.upto) for r in out.collect()) == [(1, 2, 2), (2, 1, 3), (3, 3, 6)]


def test_dose_classes_give_the_results_of_single_samples(spark):
    rng = np.random.default_rng(2)
    g, y = rng.integers(0, 3, 200), rng.integers(0, 2, 200)
    cases = spark.createDataFrame([("l", i, int(v)) for i, v in enumerate(y)] + [("l", 999, None)], "locus string, sample long, case long")
    doses = spark.createDataFrame([("l", "f", i, int(v)) for i, v in enumerate(g)] + [("l", "f", 999, 1)], "locus string, feature string, sample long, dose long")
    r = A.dose_classes(doses, "locus", cases).first()
    d = np.array([(c.dose, c.k, c.hit) for c in r.classes])
    assert (r.n, r.cases) == (200, y.sum()) and d[:, 0].tolist() == [1, 2] and d[:, 1].tolist() == [(g == 1).sum(), (g == 2).sum()]
    d = np.vstack([d, [0, 200 - d[:, 1].sum(), y.sum() - d[:, 2].sum()]])
    for firth in (False, True):
        a = A.logistic(np.column_stack([np.ones(200), g]), y.astype(float), firth=firth)
        b = A.logistic(np.column_stack([np.ones(3), d[:, 0]]), d[:, 2] / d[:, 1], firth=firth, counts=d[:, 1])
        assert np.allclose(a, b, atol=1e-7)
    one = tails.saddlepoint_tail([1] * 20 + [2] * 10, [0.1] * 30, 9.0)
    assert tails.saddlepoint_tail([1, 2], [0.1, 0.1], 9.0, [20, 10]) == pytest.approx(one, rel=1e-9)


def test_kernel_tests_and_cauchy():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (6, 150)).astype(float)
    z = m - m.mean(axis=1, keepdims=True)
    found = []
    for _ in range(400):
        y = rng.normal(size=150)
        found.append(A.kernel_tests(z, y - y.mean()))
    for k in range(3):
        share = np.mean([f[k] < 0.1 for f in found])
        assert 0.055 < share < 0.15  # three standard errors of 400 draws at 0.1
    y = 0.4 * z.sum(axis=0) + rng.normal(size=150)
    burden, kernel, optimal = A.kernel_tests(z, y - y.mean())
    assert burden < kernel and burden <= optimal <= 8 * burden
    s = z.sum(axis=0)
    assert burden == pytest.approx(tails.normal_two_sided(s @ (y - y.mean()) / math.sqrt(s @ s) / y.std(ddof=1)), rel=1e-6)
    y = z.T @ np.array([0.5, -0.5, 0.5, -0.5, 0.5, -0.5]) + rng.normal(size=150)
    burden, kernel, optimal = A.kernel_tests(z, y - y.mean())
    assert kernel < burden and optimal < 1e-4
    wide = np.vstack([z] * 40)  # more features than samples
    assert A.kernel_tests(wide, y - y.mean())[1] == pytest.approx(kernel, rel=1e-4)
    assert tails.cauchy([0.03]) == pytest.approx(0.03) and tails.cauchy([0.2] * 5) == pytest.approx(0.2)
    assert tails.cauchy([1e-20, 0.5]) == pytest.approx(2e-20, rel=1e-6)
    assert tails.moment_tail(tails.moment_quantile(0.01, [2, 1, 1]), [2, 1, 1]) == pytest.approx(0.01, rel=1e-6)


def test_false_certain(spark):
    seen = spark.createDataFrame([(3, True, False), (2, True, False), (8, False, False), (8, True, True)], "sites_p int, fit boolean, own boolean")
    counted = R.false_certain(seen, 2, 4)
    assert rows(counted, "cut", "false_certain", "screened") == [(2, 2, 3), (3, 1, 3), (4, 0, 3)]
    assert R.calibrated_cut(counted, 0.1, 2, 4).first() == (4, True) and R.calibrated_cut(counted, 0.4).first()[0] == 3


def test_models():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (20, 300)).astype(float)
    y = 1.5 * g[4] + rng.normal(size=300)
    pip, sets = A.fine_map(g, y)
    assert pip.argmax() == 4 and pip[4] > 0.99 and [4] in sets
    assert A.effective_tests(np.vstack([g[0], g[0], g[0]])) == 1.0
    case = (rng.random(300) < 1 / (1 + np.exp(-(g[2] - 1)))).astype(float)
    beta, se = A.logistic(np.column_stack([np.ones(300), g[2]]), case)
    assert beta[1] == pytest.approx(1.0, abs=3 * se[1])
    assert np.isfinite(A.logistic(np.column_stack([np.ones(6), [0, 0, 0, 1, 1, 1]]), np.array([0, 0, 0, 1, 1, 1.0]), firth=True)[0]).all()
    delta, values, vectors = A.mixed_null(y, np.ones((300, 1)), np.eye(300) + 0.01 * np.cov(g.T))
    assert A.mixed_test(g[4], y, np.ones((300, 1)), delta, values, vectors)[0] == pytest.approx(1.5, abs=0.3)


# store, streams, sources


def test_store(spark, tmp_path):
    store = KmerStore(spark, str(tmp_path / "s"))
    make = lambda r: spark.createDataFrame(r, "kmer string, n long")
    store.add("a", make([("AC", 1), ("AC", 2), (None, 9)]))
    store.add("b", make([("AC", 4), ("GG", 1)]))
    store.add("b", make([("AC", 5), ("GG", 1)]))
    assert rows(store.dump()) == [("AC", 8), ("GG", 1)]
    assert rows(store.lookup(spark.createDataFrame([("AC",), ("TT",)], "kmer string"))) == [("AC", 8), ("TT", 0)]
    assert rows(store.verify(make([("AC", 8), ("GG", 2)]))) == [("GG", 1, 2)]
    store.compact(str(tmp_path / "c"))
    assert rows(KmerStore(spark, str(tmp_path / "c")).dump()) == rows(store.dump())


def test_streams(spark, tmp_path):
    spark.createDataFrame([("f1", "ACGTACGTT"), ("f2", "GGGGGGGG")], "fragment string, sequence string").write.parquet(str(tmp_path / "f"))
    code = lambda x: sum("ACGT".index(b) * 4 ** i for i, b in enumerate(reversed(x)))
    known = [("L", code("ACGTA"), "P", True), ("L", code("CGTAC"), "P", False), ("L", code("CCCCC"), "S", True)]
    index = spark.createDataFrame(known, "locus string, kmer long, cls string, screen boolean")
    stream = spark.readStream.schema("fragment string, sequence string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    recruit_stream(stream, index, 5, str(tmp_path / "verdicts"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "verdicts" / "batch=*"))
    assert rows(got, "fragment", "locus", "n_p", "n_s", "n_n", "fate") == [("f1", "L", 4, 0, 1, "ambiguous"), ("f2", "L", 0, 4, 0, "ambiguous")]
    for name, data in (("a", [("r1", 10), ("r2", 20), ("r3", 400_000)]), ("b", [("r1", 60), ("r2", 300_000), ("r9", 500_000)])):
        spark.createDataFrame(data, "name string, pos long").write.parquet(str(tmp_path / name))
    sides = [spark.readStream.schema("name string, pos long").parquet(str(tmp_path / x)) for x in "ab"]
    q = mates(*sides).writeStream.format("memory").queryName("mates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("r1", 10, 60) in rows(spark.table("mates")) and ("r2", 20, None) in rows(spark.table("mates"))


def test_no_hit_is_lost_by_its_time(spark, tmp_path):
    from spangraph.streaming.streams import store_stream

    hit = "hit_id long, path_name string, kmer string, hit_count int, seen_at timestamp, loaded_at timestamp"
    day = lambda d: datetime.datetime(2020, 1, d)
    batches = [
        [(1, "p", "ACG", 1, day(20), day(21)), (2, "p", "ACG", 2, None, day(21)), (7, None, "ACG", 5, None, None)],
        [(3, "p", "ACG", 4, None, None), (1, "p", "ACG", 1, day(20), day(25)), (4, "p", "CGT", 8, day(1), day(2))],
        [(2, "p", "ACG", 2, None, day(30)), (3, "p", "ACG", 4, None, None), (5, "p", "TTT", 16, None, day(3))],
    ]
    for i, data in enumerate(batches):
        spark.createDataFrame(data, hit).coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
        stream = spark.readStream.schema(hit).parquet(str(tmp_path / "hits"))
        store_stream(stream, str(tmp_path / "store"), str(tmp_path / "state"), "60 days" if i else None)
    got = spark.read.parquet(str(tmp_path / "store" / "segment=*")).groupBy("kmer").agg(F.sum("n"))
    assert rows(got) == [("AAA", 16), ("ACG", 15)]


def test_mates_on_a_second_contig(spark, tmp_path):
    schema, far = "name string, contig string, pos long", 200_000_000
    sides = {"a": [("r1", "c1", far)], "b": [("r1", "c1", far + 50)]}, {"a": [("r2", "c2", 10)], "b": []}, {"a": [], "b": [("r2", "c2", 90), ("r2", "c1", 90)]}
    for batch in sides:
        for name, data in batch.items():
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in "ab"]
        offsets = spark.createDataFrame([("c1", 0), ("c2", 250_000_000)], "contig string, offset long")
        q = mates(*streams, offsets=offsets).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {("r1", "c1", far, far + 50), ("r2", "c2", 10, 90)} <= set(rows(spark.read.parquet(str(tmp_path / "out"))))


def test_intervals_of_any_length(spark):
    left = spark.createDataFrame([("c", 0, 10**15, 1), ("c", 5, 9, 2), ("c", 10**9, 10**9 + 10**8, 3), ("c", -(2**62), 2**62, 4), ("c", 7, 7, 5), ("c", None, 3, 6)], "k string, a long, b long, i int")
    right = spark.createDataFrame([("c", 8, 12, 1), ("c", 10**9 + 5, 10**9 + 6, 2), ("c", 10**14, 10**15 + 5, 3), ("d", 0, 9, 4)], "k string, c long, d long, j int")
    assert rows(I.overlap_join(left, right, "k", ("a", "b"), ("c", "d"), 100), "i", "j") == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 2), (4, 1), (4, 2), (4, 3)]


def test_blocks_spell_the_walk(spark):
    rng = random.Random(2)
    texts = {str(i): "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 3, 40, 700]))) for i in range(30)}
    walk = [(rng.choice("<>"), str(rng.randrange(32))) for _ in range(80)]
    whole = "".join(revcomp(texts.get(n, "N" * 13)) if s == "<" else texts.get(n, "N" * 13) for s, n in walk)
    walked = K.explode_steps(spark.createDataFrame([("p", "".join(s + n for s, n in walk))], "path_name string, walk string"))
    nodes = K.distinct_nodes(spark.createDataFrame([*((k, v, None) for k, v in texts.items()), ("30", None, 13), ("31", "*", 13)], "node_id string, sequence string, length_bp long"))
    for size, overlap in ((100, 0), (64, 20), (5000, 3)):
        got = K.spelled_blocks(walked, nodes, size, overlap).orderBy("block").collect()
        assert [r.text for r in got] == [whole[i : i + size + overlap] for i in range(0, len(whole), size)]
    text = spark.createDataFrame([(1, whole.lower())], "i int, t string")
    want = sorted(((i, min(whole[i : i + 21], revcomp(whole[i : i + 21]))) for i in range(len(whole) - 20) if "N" not in whole[i : i + 21]), key=str)
    assert rows(S.kmer_codes(text, ["i"], "t", 21).select("pos", S.decode(F.col("kmer"), 21))) == want


def test_graph_files(spark, tmp_path):
    text = "H\tVN:Z:1.0\nS\t1\tACGT\nS\t2\t*\tLN:i:7\nL\t1\t+\t2\t-\t*\nL\t1\t+\t2\t+\t3M\nP\tp\t1+,2-\t*\nW\ts\t1\tc\t0\t9\t>1<2\nW\ts\t2\tc\t*\t*\t>1>9\nS\t1\tA\nP\te\n"
    path = tmp_path / "g.gfa"
    path.write_text(text)
    assert rows(gfa.segments(spark, str(path))) == [("1", "A", 1), ("1", "ACGT", 4), ("2", None, 7)]
    assert rows(gfa.links(spark, str(path)), "to_orient", "overlap") == [("+", 3), ("-", None)]
    assert rows(gfa.paths(spark, str(path)), "path_name", "steps", "walk_start") == [("p", ">1<2", None), ("s#1#c:1-9", ">1<2", 0), ("s#2#c", ">1>9", None)]
    assert {r.reason for r in gfa.problems(spark, str(path)).collect()} == {"duplicate_segment", "undefined_step", "too_few_fields"}
    good = gfa.segments(spark, str(path)).where("sequence is null or length(sequence) > 1")
    gfa.write(good, gfa.links(spark, str(path)), gfa.paths(spark, str(path)), str(tmp_path / "out"))
    assert rows(gfa.links(spark, str(tmp_path / "out"))) == rows(gfa.links(spark, str(path)))
    assert rows(gfa.paths(spark, str(tmp_path / "out")), "steps") == rows(gfa.paths(spark, str(path)), "steps")


def test_graph_file_comes_back_line_by_line(spark, tmp_path):
    lines = ["H\tVN:Z:1.1", "S\t2\tACGT\tRC:i:5\tXX:Z:a b", "P\tp\t1+,2-\t*", "S\t1\t*\tLN:i:7", "L\t1\t+\t2\t-\t3M\tNM:i:0", "W\ts\t1\tc#x\t0\t9\t>1<2\tID:Z:q", "W\ts\t2\tc\t*\t*\t>1", "H\tXX:i:1"]
    path, out = tmp_path / "g.gfa", tmp_path / "out"
    path.write_text("\n".join(lines) + "\n")
    read = [f(spark, str(path), extras=True) for f in (gfa.segments, gfa.links, gfa.paths)]
    gfa.write(*read, str(out), gfa.headers(spark, str(path)))
    assert [x for f in sorted(out.glob("part-*")) for x in f.read_text().splitlines()] == lines
    plain = [d.drop("tags", "place") for d in read]
    gfa.write(*plain, str(out))
    assert sorted(r.value for r in spark.read.text(str(out)).collect()) == sorted(["S\t2\tACGT", "S\t1\t*\tLN:i:7", "L\t1\t+\t2\t-\t3M", "P\tp\t1+,2-\t*", "W\ts\t1\tc#x\t0\t9\t>1<2", "W\ts\t2\tc\t*\t*\t>1"])


def test_table_files(spark, tmp_path):
    vcf = tmp_path / "v.vcf"
    vcf.write_text(
        "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\nc\t5\tV1\tN\t<CNV>\t.\t.\tSVTYPE=CNV\tGT:CN\t1:3\t0:2\t1:4\t.:.\n"
        "c\t6\tV2\tN\t<DEL>\t.\t.\tSVTYPE=DEL\tGT\t1\t0\t1\t0\nc\t7\tV3\tA\tC,G\t.\t.\tX\tGT\t1\t2\t0\t.\n"
    )
    want = {"V1": [3, 2, 4, None], "V2": [1, 0, 1, 0], "V3_a1": [1, 0, 0, None], "V3_a2": [0, 1, 0, None]}
    doses = tables.variant_dosage(tables.read_vcf(spark, str(vcf)))
    assert {(r.feature, r.sample): r.dose for r in doses.collect()} == {(f, s): v for f, x in want.items() for s, v in zip("abcd", x)}
    tables.write_dosages(doses, list("abcd"), str(tmp_path / "m"))
    assert rows(tables.read_dosages(spark, str(tmp_path / "m"), list("abcd"))) == rows(doses)
    (tmp_path / "p.tsv").write_text("sample\ty\tc\na\t-9\t1\nb\t2.5\tNA\n")
    assert rows(tables.read_phenotypes(spark, str(tmp_path / "p.tsv"))) == [("a", None, 1.0), ("b", 2.5, None)]
    (tmp_path / "s.tsv").write_text("a\tc1,c2\tc3\nb\t.\tc4\n")
    assert rows(tables.read_sample_slots(spark, str(tmp_path / "s.tsv"))) == [("a", 0, "c1"), ("a", 0, "c2"), ("a", 1, "c3"), ("b", 1, "c4")]
    (tmp_path / "r.fa").write_text(">x one\nAC\nGT\n>y\nTT\n")
    assert rows(tables.read_fasta(spark, str(tmp_path / "r.fa"))) == [("x", "ACGT"), ("y", "TT")]
    (tmp_path / "r.fq").write_text("".join(f"@r{i} x\nAC{i}\n+\n@I{i}\n" for i in range(500)) + "@last\nA\n")
    reads = tables.read_fastq(spark, str(tmp_path / "r.fq"))
    assert rows(reads, "record", "name", "sequence", "quality") == sorted([(i, f"r{i}", f"AC{i}", f"@I{i}") for i in range(500)], key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    split = rows(tables.read_fastq(spark, str(tmp_path / "r.fq")), "record", "quality")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == rows(reads, "record", "quality")
    (tmp_path / "g.gtf").write_text('c\ts\tgene\t1\t90\t.\t+\t.\tgene_id "G"; gene_name "N";\nc\ts\tCDS\t1\t9\t.\t+\t.\tgene_id "G";\nc\ts\tCDS\t5\t20\t.\t+\t.\tgene_id "G";\nc\ts\tCDS\t40\t50\t.\t+\t.\tgene_id "G";\n')
    r = tables.read_genes(spark, str(tmp_path / "g.gtf"), "c", 1, 60).first()
    assert (r.gene_id, r.gene_name, [tuple(x) for x in r.cds]) == ("G", "N", [(1, 20), (40, 50)])
    (tmp_path / "b.csv").write_text("bubble_id,source,inside_nodes,path_support\n1,a,x;y,3\n2,b,,4\n")
    sites = tables.read_sites(spark, str(tmp_path / "b.csv"))
    assert rows(sites, "bubble_id", "inside_nodes", "kind") == [(1, ["x", "y"], None), (2, [], None)]
    tables.write_sites(sites, str(tmp_path / "b2"))
    assert rows(tables.read_sites(spark, str(tmp_path / "b2")), "bubble_id", "inside_nodes") == rows(sites, "bubble_id", "inside_nodes")
    (tmp_path / "s.jsonl").write_text('{"start": {"node_id": "1"}, "end": {"node_id": "4", "backward": true}, "type": 1}\n')
    assert rows(tables.read_snarls(spark, str(tmp_path / "s.jsonl"))) == [("1", "+", "4", "-")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([">1", "<1", ">2", ">3"]), max_size=12), st.lists(st.sampled_from([">1", "<1", ">2", ">3"]), max_size=12))
def test_alignment_rebuilds_the_other_side(a, b):
    at, out = 0, []
    for _, i0, i1, j0, j1 in align_tokens(a, b):
        out += a[at:i0] + b[j0:j1]
        at = i1
    assert out + a[at:] == b


def test_components_of_a_long_band(spark):
    """A long band of shuffled names: labels handed on from neighbour to neighbour need more than 60 rounds."""
    rng = random.Random(7)
    n = 6000
    names = [f"v{i:05d}" for i in range(n)]
    rng.shuffle(names)
    pairs = [(names[i], names[j]) for i in range(n) for j in (i + 1, i + 2) if j < n and rng.random() < 0.9]
    near = {x: [] for x in names}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    want, seen = {}, set()
    for x in sorted(names):
        todo = [x] if x not in seen and near[x] else []
        seen.update(todo)
        while todo:
            y = todo.pop()
            want[y] = x
            fresh = [z for z in near[y] if z not in seen]
            seen.update(fresh)
            todo += fresh
    assert dict(rows(connected_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b"))) == want
