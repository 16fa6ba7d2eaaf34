"""Rebuilt sequences, ordered matches, chains and repeat periods against brute force and hand-derived cases."""

import itertools

import numpy as np
import pytest

from spangraph.operators import rebuild as R

EVENT = "haplotype string, reference string, event string, start long, stop long, alt string"


def test_events_applied(spark):
    events = [
        ("h", "r", "del", 2, 4, "."), ("h", "r", "late", 3, 6, "T"), ("h", "r", "ins", 6, 6, "GG"), ("h", "r", "sub", 8, 9, "T"),
        ("k", "r", "all", 0, 10, None), ("n", "none", "x", 0, 1, "A"), (None, "r", "x", 0, 1, "A"), ("z", "r", "x", None, 1, "A"),
        ("e", "r", "front", 0, 0, "AA"), ("e", "r", "end", 10, 10, "CC"),
    ]
    references = spark.createDataFrame([("r", "ACGTACGTAC")], "reference string, sequence string")
    got = {r.haplotype: (r.n_applied, r.n_skipped, r.sequence) for r in R.apply_events(spark.createDataFrame(events, EVENT), references).collect()}
    assert got == {"h": (3, 1, "ACACGGGTTC"), "k": (1, 0, ""), "e": (2, 0, "AAACGTACGTACCC")}
    assert R.apply_events(spark.createDataFrame([], EVENT), references).count() == 0


def test_events_applied_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGT"), 300))
    events = [(f"h{h}", "r", f"e{i:03d}", int(s), int(s + rng.integers(0, 30)), "".join(rng.choice(list("ACGT"), rng.integers(0, 5)))) for h in range(6) for i, s in enumerate(rng.integers(0, 270, 25))]
    got = {r.haplotype: r.sequence for r in R.apply_events(spark.createDataFrame(events, EVENT), spark.createDataFrame([("r", text)], "reference string, sequence string")).collect()}
    for h in range(6):
        reach, kept = -1, []
        for e in sorted((e for e in events if e[0] == f"h{h}"), key=lambda e: (e[3], e[4], e[2])):
            if e[3] >= reach:
                kept.append(e)
            reach = max(reach, e[4])
        want = text
        for e in reversed(kept):
            want = want[: e[3]] + e[5] + want[e[4] :]
        assert got[f"h{h}"] == want


def test_ordered_match_equals_brute_force():
    rng = np.random.default_rng(7)
    pool = [[], [">1"], [">1", ">2"], [">1", ">2", ">3"], ["<9"]]
    for _ in range(150):
        a, b = ([pool[i] for i in rng.integers(0, 5, rng.integers(0, 5))] for _ in range(2))
        best = (0, 0.0)
        for k in range(min(len(a), len(b)) + 1):
            for i in itertools.combinations(range(len(a)), k):
                for j in itertools.combinations(range(len(b)), k):
                    alike = [R.similarity(a[x], b[y]) for x, y in zip(i, j)]
                    if all(v >= 0.5 for v in alike):
                        best = max(best, (k, round(sum(alike), 6)))
        got = R.ordered_match(a, b, 0.5)
        assert all(x < y for p, q in zip(got, got[1:]) for x, y in zip(p, q))
        assert (len(got), round(sum(R.similarity(a[x], b[y]) for x, y in got), 6)) == best


def test_crossings_are_matched_in_order(spark):
    read = [("b", "p0", 1, [">1"]), ("b", "p0", 2, [">2"]), ("b", "p1", 1, [">2"]), ("b", "p2", 1, [">1"]), ("b", "p2", 2, [">7"]), ("b", "p2", 3, [">2"]), ("b", "p3", 1, [])]
    got = R.crossing_matches(spark.createDataFrame(read, "bubble_id string, path_name string, crossing int, inside array<string>")).collect()
    assert sorted((r.path_name, r.crossing, r.ref_crossing, r.same) for r in got) == [("p1", 1, 2, True), ("p2", 1, 1, True), ("p2", 3, 2, True)]


def test_heaviest_chain_equals_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(3, 10))
        x, y, w = rng.integers(0, 30, n), rng.integers(0, 30, n), rng.integers(1, 9, n)
        best = 0
        for k in range(1, n + 1):
            for c in itertools.combinations(np.lexsort((y, x)), k):
                if all(0 < x[q] - x[p] <= 12 and 0 < y[q] - y[p] <= 12 for p, q in zip(c, c[1:])):
                    best = max(best, int(w[list(c)].sum()))
        found = R.chain(x, y, w, 12, 1)
        assert int(w[found[0]].sum()) == best
        assert sorted(np.concatenate(found).tolist()) == list(range(n))
    assert R.chain(x[:2], y[:2], w[:2], 12, 3) == []


def test_chains_on_both_strands(spark):
    rows = [("p", False, i * 10, i * 10 + 5, 3) for i in range(4)] + [("p", True, i * 10, 90 - i * 10, 2) for i in range(3)] + [("q", False, 0, None, 1)]
    got = R.anchor_chains(spark.createDataFrame(rows, "path_name string, backward boolean, ref_pos long, pos long, weight int"), ["path_name"], 50)
    assert sorted((r.backward, r.chain, r.n_anchors, r.weight, r.ref_lo, r.ref_hi, r.lo, r.hi) for r in got.collect()) == [(False, 1, 4, 12, 0, 30, 5, 35), (True, 1, 3, 6, 0, 20, 70, 90)]


def test_repeat_period(spark):
    text = "GATTACAGC" * 5
    words = [("t", i, text[i : i + 6]) for i in range(len(text) - 5)] + [("u", i, w) for i, w in enumerate(["a", "b", "a"])]
    got = R.tandem_periods(spark.createDataFrame(words, "name string, pos int, word string"), "name").collect()
    assert [(r.name, r.period, r.copies) for r in got] == [("t", 9, 5)]


def test_lead_conditioning_equals_two_variable_regression(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    from spangraph.plans.assoc import doses, phenotypes
    from spangraph.plans.rebuild import lead_conditioned

    y = phenotypes(spark, folder).where("y is not null").toPandas().set_index("sample")["y"].astype(float)
    table = doses(spark, folder).toPandas().pivot_table(index="sample", columns="feature", values="dose", fill_value=0).reindex(y.index).fillna(0)
    rows = [r for r in lead_conditioned(spark, folder).collect() if r.t is not None]
    assert rows
    for r in rows[:20]:
        x = np.column_stack([np.ones(len(y)), table[r.feature], table[r["lead"]]])
        beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
        assert r.t == pytest.approx(beta[1] / se, abs=1e-4)
