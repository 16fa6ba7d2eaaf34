"""Sequence functions: Column expressions that stay inside Spark's own operators, and rolling hashes as arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(col: Column) -> Column:
    """Reverse complement, case kept; IUPAC codes map to their complements, other letters stay."""
    return F.reverse(F.translate(col, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"))


def is_plain(col: Column) -> Column:
    """True for a non-empty text of the letters A, C, G and T only (upper case)."""
    return (F.length(col) > 0) & (F.translate(col, BASES, "") == "")


def canonical(col: Column) -> Column:
    """The lesser of an upper-case k-mer and its reverse complement; null where another letter occurs."""
    upper = F.upper(col)
    return F.when(is_plain(upper), F.least(upper, F.reverse(F.translate(upper, BASES, "TGCA"))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once; keeps deep arithmetic from growing with each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(col: Column, k: int) -> Column:
    """Array of the k-mers of a text, in order; empty where the text is shorter. Linear in the text: one regular expression with a look-ahead."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def canonical_kmers(col: Column, k: int) -> Column:
    """Array of the canonical k-mers of a text, in order; null where another letter than A, C, G, T occurs.

    The reverse complement is made once for the whole text; its k-mers, read backwards, pair up with the text's own.
    """
    up = F.upper(col)
    back = F.reverse(kmers(F.reverse(F.translate(up, BASES, "TGCA")), k))
    return F.zip_with(kmers(up, k), back, lambda a, b: F.when(~a.rlike("[^ACGT]"), F.least(a, b)))


def encode(col: Column) -> Column:
    """Two bits a base (A0 C1 G2 T3) of an upper-case plain k-mer of at most 31 bases."""
    return F.conv(F.translate(col, BASES, "0123"), 4, 10).cast("bigint")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


# The constants of the splitmix64 finalizer, and the seed that sets minimizer hashes apart.
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MINIMIZER_SEED = 0x6A09E667F3BCC908


def with_mix64(df: DataFrame, source: Column, out: str) -> DataFrame:
    """Adds the splitmix64 finalizer of a long, as a signed long.

    The products modulo 2^64 are made of 16-bit limbs, so that nothing overflows. Each step is a column of
    its own: the planner keeps columns that are used several times apart, so the arithmetic stays compiled
    and does not grow with each use.
    """
    names = []

    def put(name: str, value: Column) -> Column:
        nonlocal df
        df = df.withColumn(name, value)
        names.append(name)
        return F.col(name)

    x = put("__x0", source)
    for turn, (shift, constant) in enumerate(((30, MIX_1), (27, MIX_2))):
        x = put(f"__f{turn}", x.bitwiseXOR(F.shiftrightunsigned(x, shift)))
        limb = [put(f"__l{turn}{i}", F.shiftrightunsigned(x, 16 * i).bitwiseAND(65535)) for i in range(4)]
        k = [(constant >> 16 * i) & 65535 for i in range(4)]
        carry, parts = None, []
        for i in range(4):
            total = limb[0] * F.lit(k[i])
            for j in range(1, i + 1):
                total = total + limb[j] * F.lit(k[i - j])
            carry = put(f"__c{turn}{i}", total if carry is None else total + F.shiftrightunsigned(carry, 16))
            parts.append(F.shiftleft(carry.bitwiseAND(65535), 16 * i))
        x = put(f"__x{turn + 1}", parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3]))
    return df.withColumn(out, x.bitwiseXOR(F.shiftrightunsigned(x, 31))).drop(*names)


def unsigned(x: Column) -> Column:
    """A signed long whose order is that of ``x`` taken as unsigned."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _laid(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, owner of each place, place in its text) of texts laid end to end, each followed by a letter that is no base."""
    raw = np.frombuffer("\n".join([*texts, ""]).encode("ascii", "replace"), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return raw, owner, np.arange(len(raw)) - (np.cumsum(sizes) - sizes)[owner]


LETTERS = 1 << 20  # that are worked at once


def bounded(batches: Iterator[pa.RecordBatch], text: int, letters: int = LETTERS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part's texts have at most about ``letters`` letters: a batch goes by rows, and its arrays by letters."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        part = np.floor_divide(sizes, letters)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _codes(raw: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each s-mer, of its reverse complement, whether all its letters are bases), two bits a base."""
    codes = CODES[raw]
    n = len(codes) - s + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    two = np.where(codes > 3, 0, codes).astype(np.uint64)
    ahead, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(s):
        ahead = (ahead << np.uint64(2)) | two[i : i + n]
        back |= (np.uint64(3) - two[i : i + n]) << np.uint64(2 * i)
    return ahead, back, bad[s:] == bad[:-s]


def _smer_hashes(raw: np.ndarray, s: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the canonical form of each s-mer, whether it is plain); the same hash as ``with_mix64`` of the code."""
    ahead, back, plain = _codes(raw, s)
    x = np.minimum(ahead, back) ^ np.uint64(seed)
    for shift, times in ((30, MIX_1), (27, MIX_2)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31)), plain


def rolled(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(canonical code, owner, place in its text, whether all letters are bases) of the k-mers of upper-case texts laid end to end."""
    raw, owner, place = _laid(texts, k)
    ahead, back, plain = _codes(raw, k)
    return np.minimum(ahead, back).view(np.int64), owner, place, plain


def kmer_codes(rows: DataFrame, keys: list[str], text: str, k: int, canonical_form: bool = True, smer: int = 0) -> DataFrame:
    """(*keys, pos, kmer): the k-mers of a text as two-bit codes (k at most 31), pos counting from 0, whatever the case of the letters.

    Codes order like the texts. Texts come in blocks, and a block's codes are rolled as arrays; k-mers with a letter that
    is no base are left out. ``decode`` gives the text back. With ``smer`` also ``screen``, whether the k-mer is a closed syncmer.
    """
    cut = text_blocks(rows, keys, text, 20_000, k - 1).withColumn("text", F.upper("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, len(keys) + 1):
            raw, owner, place = _laid(batch.column(len(keys) + 1).to_pylist(), k)
            ahead, back, plain = _codes(raw, k)
            at = np.flatnonzero(plain)
            rows_of = pa.array(owner[at])
            start = batch.column(len(keys)).to_numpy(zero_copy_only=False)[owner[at]]
            codes = (np.minimum(ahead, back) if canonical_form else ahead)[at].view(np.int64)
            made = [*(batch.column(i).take(rows_of) for i in range(len(keys))), pa.array(place[at] + start), pa.array(codes)]
            if smer:
                _, first, last, low = _window_hashes(raw, k, smer, 0)  # of the same places
                made.append(pa.array((first == low) | (last == low)))
            yield pa.RecordBatch.from_arrays(made, [*keys, "pos", "kmer", *(["screen"] if smer else [])])

    kinds = dict(cut.dtypes)
    return cut.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", pos long, kmer long" + (", screen boolean" if smer else ""))


CODES = np.full(256, 4, np.uint8)
CODES[[ord(c) for c in BASES]] = range(4)


def _window_hashes(raw: np.ndarray, k: int, s: int, seed: int):
    """(pos, first, last, least) of the s-mer hashes of each k-mer whose letters are all bases."""
    hashes, plain = _smer_hashes(raw, s, seed)
    w = k - s + 1
    if len(hashes) < w:
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3))
    low, size = hashes, 1
    while size * 2 <= w:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (w - size)], low[w - size :]) if w > size else low
    wrong = np.concatenate([[0], np.cumsum(~plain)])
    pos = np.flatnonzero(wrong[w:] == wrong[:-w])
    return pos, hashes[pos], hashes[pos + w - 1], low[pos]


def with_window_hashes(rows: DataFrame, keys: list[str], text: str, k: int, s: int, seed: int = 0) -> DataFrame:
    """(*keys, pos, first, last, low): for each k-mer of a text its first, last and least s-mer hash, ordered as unsigned.

    Texts come in blocks, hashed as arrays in Arrow batches. K-mers with a letter that is no base are left out.
    """
    cut = text_blocks(rows, keys, text, 20_000, k - 1).withColumn("text", F.upper("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, len(keys) + 1):
            raw, owner, place = _laid(batch.column(len(keys) + 1).to_pylist(), k)
            at, *found = _window_hashes(raw, k, s, seed)
            rows_of = pa.array(owner[at])
            start = batch.column(len(keys)).to_numpy(zero_copy_only=False)[owner[at]]
            signed = [pa.array((x ^ np.uint64(1 << 63)).view(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows_of) for i in range(len(keys))), pa.array(place[at] + start), *signed], [*keys, "pos", "first", "last", "low"])

    kinds = dict(cut.dtypes)
    return cut.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", pos long, first long, last long, low long")


def dust(kmer: Column) -> Column:
    """Low-complexity score: pairs of equal triplets over (length - 3); equal triplets are counted in sorted order."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("pairs"))
    same = lambda a, x: F.struct(x.alias("last"), (a["run"] + 1).alias("run"), (a["pairs"] + a["run"] + 1).alias("pairs"))
    other = lambda a, x: F.struct(x.alias("last"), F.lit(0).alias("run"), a["pairs"].alias("pairs"))
    pairs = F.aggregate(F.array_sort(kmers(kmer, 3)), start, lambda a, x: F.when(x == a["last"], same(a, x)).otherwise(other(a, x)), lambda a: a["pairs"])
    return F.when(F.length(kmer) < 4, 0.0).otherwise(pairs / (F.length(kmer) - 3))


def dust_of_codes(code: Column, k: int) -> Column:
    """``dust`` of two-bit codes of k letters, as an Arrow function: equal triplets are counted lag by lag over whole columns."""

    @F.pandas_udf("double")
    def score(codes: pd.Series) -> pd.Series:
        x = codes.to_numpy(np.int64, na_value=0)
        triplets = np.stack([(x >> 2 * i) & 63 for i in range(k - 2)]) if k > 3 else np.zeros((1, len(x)), np.int64)
        pairs = sum((triplets[lag:] == triplets[:-lag]).sum(axis=0) for lag in range(1, len(triplets)))
        return pd.Series(pairs / max(k - 3, 1) * np.ones(len(x))).where(codes.notna())

    return score(code)


def text_blocks(rows: DataFrame, keys: list[str], text: str, size: int = 10_000, overlap: int = 0) -> DataFrame:
    """(*keys, start, text): a text in blocks of ``size`` letters, each going on for ``overlap`` into the next, so that no row of words grows with the text."""
    n = F.length(text)
    last = F.floor((F.greatest(n - overlap, F.lit(1)) - 1) / size)
    spread = rows.where(n > 0).select(*keys, text, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__b"))
    at, to = (F.col("__b") * size).cast("int"), F.lit(size + overlap)
    # plain texts are cut as bytes, without counting letters up to the start
    cut = F.when(F.octet_length(text) == F.length(text), F.encode(F.col(text), "UTF-8").substr(at + 1, to).cast("string")).otherwise(F.col(text).substr(at + 1, to))
    return spread.select(*keys, at.cast("long").alias("start"), cut.alias("text"))


def least_rotation(unit: Column) -> Column:
    """The least of all rotations of a text and of its reverse complement."""
    turns = lambda u: F.transform(F.sequence(F.lit(1), F.length(u)), lambda i: F.concat(F.substring(u, i, F.length(u)), F.substring(u, F.lit(1), i - 1)))
    return F.when(F.length(unit) > 0, F.array_min(F.concat(turns(unit), turns(reverse_complement(unit)))))


def shortest_period(unit: Column) -> Column:
    """The least p that divides the length, with the text a repeat of its first p letters."""
    n = F.length(unit)
    fits = F.filter(F.sequence(F.lit(1), n), lambda p: (n % p == 0) & (F.repeat(F.substring(unit, F.lit(1), p), (n / p).cast("int")) == unit))
    return F.when(n > 0, F.array_min(fits))


def error_rate(quality: Column, low: float = 0.001, high: float = 0.08, missing: float = 0.01) -> Column:
    """Mean error rate of a Phred+33 quality text, kept within [low, high]; ``missing`` where there is none."""
    chars = F.filter(F.split(quality, ""), lambda c: c != "")
    mean = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0)) / F.size(chars)
    return F.when(F.length(quality) > 0, F.least(F.lit(high), F.greatest(F.lit(low), mean))).otherwise(missing)


def percent_escape(col: Column) -> Column:
    """Percent, semicolon, equals, comma, tab and line ends as percent codes; percent first."""
    for ch, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        col = F.replace(col, F.lit(ch), F.lit(code))
    return col


def percent_unescape(col: Column) -> Column:
    for ch, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (",", "%2C"), ("=", "%3D"), (";", "%3B"), ("%", "%25")):
        col = F.replace(col, F.lit(code), F.lit(ch))
    return col
