"""The llm operators against brute force, on small fixtures."""

import base64
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spangraph.llm.form import confusables, form_classes, forms, look_alike_pairs, skeleton
from spangraph.llm.leakage import leaked_items, tile, words_of
from spangraph.llm.spans import shared_spans
from spangraph.llm.terms import mark_terms, term_counts
from spangraph.llm.tokenize import PATTERN, VOCABULARY, Texts, encode_corpus

DOCS = "doc_id long, text string, lang string"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# terms


def test_terms_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([*"pqrstuv", None]), rng.choice([1, 2, None]), 7) for _ in range(900)]
    got = rows(term_counts(spark.createDataFrame(data, "k string, r string, n int, bucket int"), "k", "r", "n", buckets=3))
    want = {}
    for k, r, n, _ in data:
        if k is not None and r is not None:
            want.setdefault(k, {}).setdefault(r, []).append(n or 0)
    assert got == sorted((k, sum(map(sum, v.values())), len(v), max(map(sum, v.values()))) for k, v in want.items())


def test_terms_without_weight_marks_and_empty(spark):
    data = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 1)], "k string, r long")
    counts = term_counts(data, "k", "r")
    assert rows(counts) == [("x", 3, 2, 2), ("y", 1, 1, 1)]
    marked = mark_terms(counts, F.col("occurrences") <= 1, F.col("records") > 1)
    assert rows(marked, "term", "mark") == [("x", "common"), ("y", "rare")]
    assert term_counts(data.limit(0), "k", "r").count() == 0


# spans


def brute_spans(records, least):
    grams = {}
    for key, units in records.items():
        for i in range(len(units) - least + 1):
            grams.setdefault(tuple(units[i : i + least]), set()).add(key)
    out = []
    for key, units in records.items():
        at = set()
        for i in range(len(units) - least + 1):
            if len(grams[tuple(units[i : i + least])]) > 1:
                at.update(range(i, i + least))
        start = None
        for i in range(len(units) + 1):
            if i in at and start is None:
                start = i
            elif i not in at and start is not None:
                out.append((key, start, i))
                start = None
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ACGT" if seed % 2 else "AC") for _ in range(rng.randint(5, 90))) for _ in range(8)]
    records = {f"r{i}": "".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for i in range(40)}
    records["long"] = "".join(rng.choice(pool) for _ in range(400))
    records["poly"], records["poly2"] = "A" * 130, "C" + "A" * 70 + "C"
    df = spark.createDataFrame([(k, v) for k, v in records.items()], "key string, units string")
    assert rows(shared_spans(df, ["key"], "units", 30, window=14)) == brute_spans(records, 30)


def test_step_spans_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [[rng.choice("<>") + str(rng.randint(1, 400)) for _ in range(rng.randint(1, 12))] for _ in range(7)]
    records = {f"r{i}": [s for _ in range(rng.randint(0, 5)) for s in rng.choice(pool)] for i in range(30)}
    df = spark.createDataFrame([(k, "".join(v)) for k, v in records.items()], "key string, units string")
    assert rows(shared_spans(df, ["key"], "units", 8, window=4, by_step=True)) == brute_spans(records, 8)


def test_spans_of_empty_and_short_records(spark):
    df = spark.createDataFrame([("a", ""), ("b", "ACGT"), ("c", "ACGT")], "key string, units string")
    assert shared_spans(df, ["key"], "units", 30, window=14).count() == 0
    assert shared_spans(df.limit(0), ["key"], "units", 30, window=14).count() == 0


# tokenizer


def by_rank(ranks, piece):
    """Byte pairs merged by rank, one at a time."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 31))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def vocabulary():
    return open(VOCABULARY, "rb").read()


def test_encoding_equals_merging_by_rank(vocabulary):
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = Texts(vocabulary)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("abcdehilnorstu  \n\t'_.,09éß漢́​\x1c\x85　😀"), max_size=80))
    def check(text):
        want = [i for piece in regex.findall(PATTERN, text) for i in by_rank(ranks, piece.encode())]
        assert list(memoryview(encode(text)).cast("i") if text else []) == want

    check()


def test_corpus_of_odd_texts(spark, vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "a", "<|endoftext|>", "a" * 3000, "  two  blanks \n", "word " * 20000, "a"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: known.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0)).count() == 0


# leakage


def longest_common(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(words) for _ in range(rng.randint(8, 40))] for i in range(12)}
    docs = {}
    for d in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if d % 2:
            item = items[rng.randrange(12)]
            a = rng.randrange(len(item))
            own[5:5] = item[a : a + rng.randint(5, 30)]
        docs[d] = own
    glue = [" ", "\n", " - ", ", ", "​ "]
    text = lambda ws: "".join(w.upper() + rng.choice(glue) for w in ws)
    left = spark.createDataFrame([(k, text(v), "en") for k, v in docs.items()] + [(900, None, None), (901, "", "de")], DOCS)
    right = spark.createDataFrame([(k, " ".join(v), 1) for k, v in items.items()] + [(99, None, None)], "item_id long, text string, lang int")
    want = sorted((d, i) for d, a in docs.items() for i, b in items.items() if longest_common(a, b) >= 12)
    assert want
    assert rows(leaked_items(left, right), "doc_id", "item_id") == want
    assert rows(leaked_items(left, right, broadcast_rows=0), "doc_id", "item_id") == want
    longest = {(r.doc_id, r.item_id): r.longest for r in leaked_items(left, right).collect()}
    assert all(n == longest_common(docs[d], items[i]) for (d, i), n in longest.items())


def test_reordered_passage_is_covered(spark):
    item = [f"w{i}" for i in range(48)]
    moved = item[24:] + ["x", "y"] + item[:24]
    docs = spark.createDataFrame([(1, " ".join(moved), "en"), (2, " ".join(item[:11]), "en")], DOCS)
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert rows(leaked_items(docs, items)) == [(1, 7, 2, 24, 48, 48, 1.0)]
    assert leaked_items(docs.limit(0), items).count() == 0


def test_tiles_never_overlap():
    assert tile([(20, 0, 0), (15, 10, 30), (30, 100, 60)], 12) == [(30, 100, 60), (20, 0, 0)]
    assert sorted(tile([(40, 0, 0), (40, 26, 50)], 12)) == [(26, 40, 64), (40, 0, 0)]


def test_words():
    assert words_of("Ｆｕｌｌ-wi­dth, Ça va ﬁne 12") == ["full", "width", "ça", "va", "fine", "12"]
    assert words_of(None) == words_of("") == []


# form


def test_skeleton_joins_and_keeps_apart():
    same = [("Ｆｕｌｌ １", "Full 1"), ("é", "é"), ("a​b­", "ab"), ("a b　c", "a b c"), ("ﬁne", "fine"), ("раураl", "paypal"), ("Йод", "Йод")]
    apart = [("é", "e"), ("A", "a"), ("1", "2"), ("a.", "a"), ("a\nb", "a b"), ("²", "2"), ("a\r\nb", "a\nb"), ("ø", "o"), ("0", "O"), ("1", "l")]
    assert all(skeleton(a) == skeleton(b) for a, b in same)
    assert all(skeleton(a) != skeleton(b) for a, b in apart)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(text):
    once = skeleton(text)
    assert skeleton(once) == once and unicodedata.is_normalized("NFD", once)


def test_pairs_and_classes(spark):
    texts = ["café", "café", "café", "cafe", None, "", " ", "​", "ｃａｆé", "cafe" * 50000]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    want = sorted(
        (a, b) for a in range(10) for b in range(a + 1, 10)
        if texts[a] and texts[b] and texts[a] != texts[b] and skeleton(texts[a]).strip() and skeleton(texts[a]) == skeleton(texts[b])
    )
    assert rows(look_alike_pairs(df)) == want == [(0, 1), (0, 2), (0, 8), (1, 8), (2, 8)]
    assert rows(form_classes(df)) == [(0, 0, 4, 3), (1, 0, 4, 3), (2, 0, 4, 3), (3, 3, 1, 1), (8, 0, 4, 3), (9, 9, 1, 1)]
    made = {r.doc_id: r.form for r in forms(df).collect()}
    assert made[0] == made[8] == "café" and made[4] is None and made[6] is None
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    from spangraph.llm.queries import ORACLES, QUERIES

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {f"p{n}_found" for n in (3, 4, 7, 8)} | {"p6_ids"} <= set(QUERIES)


def test_published_look_alikes(spark):
    pairs = zip("αρνӏҮԌѵսոꓮı𝐀", "apviYGvunAiA")
    df = spark.createDataFrame([(i, f"x{a}y") for i, p in enumerate(pairs) for a in p], DOCS.replace(", lang string", ""))
    made = {}
    for r in forms(df).collect():
        made.setdefault(r.doc_id, set()).add(r.form)
    assert made == {i: {f"x{b}y"} for i, b in enumerate("apviYGvunAiA")}


def test_one_variant_among_many_copies(spark):
    df = spark.range(50_000).selectExpr("id as doc_id", "if(id = 7, 'cаfe', 'cafe') as text")
    assert look_alike_pairs(df).agg(F.count("*"), F.min("doc_a"), F.max("doc_b")).first() == (49_999, 0, 49_999)


def test_texts_that_repeat_themselves(spark):
    docs = spark.createDataFrame([(1, "la " * 4000), (2, "la li " * 2000), (3, "lo " * 11)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 4000), (2, "li la " * 50), (3, "lo " * 40)], "item_id long, text string")
    got = rows(leaked_items(docs, items), "doc_id", "item_id", "n_tiles", "longest", "tiled_words")
    assert got == [(1, 1, 1, 4000, 4000), (2, 2, 1, 100, 100)]


def test_tiles_of_repeats_equal_plain_tiling():
    import numpy as np

    from spangraph.llm.leakage import tile_places

    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("ab" if rng.random() < 0.7 else "abcdef") for _ in range(rng.randint(3, 40))] for _ in range(2))
        seed = lambda ws, i: hash(tuple(ws[i : i + 3])) % (1 << 62)
        common = {seed(a, i) for i in range(len(a) - 2)} & {seed(b, i) for i in range(len(b) - 2)}
        side = lambda ws: [(i, seed(ws, i)) for i in range(len(ws) - 2) if seed(ws, i) in common]
        d, e = (np.array(side(ws), np.int64).reshape(-1, 2) for ws in (a, b))
        got = tile_places(d[:, 0], d[:, 1].view(np.uint64), e[:, 0], e[:, 1].view(np.uint64), 3)
        matches = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= 3:
                    matches.append((n, i, j))
        assert [n for n, _, _ in got][:1] == [n for n, _, _ in tile(matches, 3)][:1]
        used_a, used_b = set(), set()
        for n, i, j in got:
            assert a[i : i + n] == b[j : j + n] and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))


def test_missing_confusables_are_no_result(spark):
    """A session without ICU, and an ICU that fails or gives too little, raise instead of going on with a short table."""

    class Checker:
        def build(self):
            return self

        def getSkeleton(self, text):
            return "a\nb"

    def session(builder):
        return type("Session", (), {"_jvm": type("Jvm", (), {"com.ibm.icu.text.SpoofChecker$Builder": builder})()})()

    for broken in (type("Connect", (), {})(), session(None), session(Checker)):
        with pytest.raises(RuntimeError):
            confusables(broken)
    assert len(confusables(spark)) > 1000
