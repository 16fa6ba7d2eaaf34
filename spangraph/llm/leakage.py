"""Evaluation passages inside training documents: greedy string tiling over shared-token seeds.

Both sides are brought to the consistent form of ``spangraph.llm.form``, lower-cased and cut into words.
A running Karp-Rabin hash gives the digest of every window of ``seed_words`` words; equal digests are the
seeds, found by one join. A seed comes to the join once per text, with the list of its places, so that
texts which repeat themselves cost what they are long and not the product of their repeats. Greedy tiling
then repeatedly marks the longest match that is still unmarked on both sides, so that passages whose parts
were reordered are covered by several tiles; the longest tile and the covered share of the item tell how
much of it leaked.

The corpus is read once, in a narrow pass. Only its window digests meet the items' digests: the items are
broadcast when their counted size is within ``broadcast_rows``. Beyond it both sides shuffle by digest, and
the corpus first passes a bit table of the items' digests, whose size is fixed, whatever the items.

Defined results: null texts and texts with fewer than ``seed_words`` words have no pair; repeated items and
documents each give their own pairs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spangraph.llm.form import confusables, learn, skeleton
from spangraph.session import written

BASE = 0x9E3779B97F4A7C15  # odd multiplier of the running hash, modulo 2^64
MEMO_SIZE = 500_000


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters or digits of its consistent form, in lower case."""
    import regex

    if not text:
        return []
    if text.isascii():
        return re.findall("[a-z0-9]+", text.lower())
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", skeleton(text)).lower())


class _WordKeys(dict):
    """A stretch without white space to the digests of its words, eight bytes each; cleared when full.

    White space stays white space in the consistent form, so stretches can be brought to it one by one.
    """

    def __missing__(self, stretch: str) -> bytes:
        words = words_of(stretch)
        out = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)
        if len(stretch) <= 64:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[stretch] = out
        return out


def seeds(texts: DataFrame, key: str, text: str, n_words: int, met: np.ndarray | None = None) -> DataFrame:
    """(key, n_words, pos, seed): the digest of each window of ``n_words`` words, pos counting from 0.

    With ``met``, a table of bits, only digests whose bit is set.
    """
    letters = confusables(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn(letters)
        keys = _WordKeys()
        get = keys.__getitem__
        for batch in batches:
            made = [b"".join(map(get, t.split())) if t else b"" for t in batch.column(1).to_pylist()]
            lengths = np.array([len(m) // 8 for m in made], np.int64)
            words = np.frombuffer(b"".join(made), np.uint64)
            windows = np.maximum(lengths - n_words + 1, 0)
            rolled = np.zeros(max(len(words) - n_words + 1, 0), np.uint64)
            for i in range(n_words):
                rolled *= np.uint64(BASE)
                rolled += words[i : i + len(rolled)]
            starts = np.cumsum(lengths) - lengths
            offsets = np.concatenate([[0], np.cumsum(windows)])
            owner = np.repeat(np.arange(len(windows)), windows)
            pos = np.arange(offsets[-1]) - offsets[owner]
            own = rolled[starts[owner] + pos].view(np.int64)
            if met is not None:
                kept = np.flatnonzero(met[(own & (len(met) * 64 - 1)) >> 6] >> (own & 63).astype(np.uint64) & np.uint64(1))
                owner, pos, own = owner[kept], pos[kept], own[kept]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(lengths.astype(np.int32)).take(rows), pa.array(pos.astype(np.int32)), pa.array(own)], [key, "n_words", "pos", "seed"]
            )

    packed = texts.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return packed.mapInArrow(run, f"{key} long, n_words int, pos int, seed long")


def bits_of(seeds: DataFrame, power: int = 26) -> np.ndarray:
    """A table of 2^``power`` bits with those of the seeds set; 8 MB at 26, put together by Spark, at most 2^(power - 6) rows reach the driver."""
    place = F.col("seed").bitwiseAND((1 << power) - 1)
    words = seeds.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit"))
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def tile(matches: list, min_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair: (length, start in document, start in item) of each tile, longest first."""
    heap = [(-n, d, i) for n, d, i in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n, d, i = -int(n), int(d), int(i)
        free = [k for k in range(n) if d + k not in in_doc and i + k not in in_item]
        if len(free) == n:
            tiles.append((n, d, i))
            in_doc.update(range(d, d + n))
            in_item.update(range(i, i + n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= min_words:
                    heapq.heappush(heap, (start - k, d + free[start], i + free[start]))
                start = k
    return tiles


def _runs(values: np.ndarray) -> np.ndarray:
    """For each place, the number of places from there on that follow one another without a gap."""
    last = np.append(np.flatnonzero(np.diff(values) != 1), len(values) - 1)
    return last[np.searchsorted(last, np.arange(len(values)))] - np.arange(len(values)) + 1


def _windows(seeds: np.ndarray, runs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each ``n`` seeds in a row that lie in one run."""
    at = np.flatnonzero(runs >= n)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    power, size, out, done = seeds, 1, None, 0
    while done < n:
        if n & size:
            out = power if out is None else power[: len(out) - size] * np.uint64(pow(BASE, done, 1 << 64)) + out[size:]
            done += size
        if done < n:
            power = power[: len(power) - size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
            size *= 2
    return at, out[at]


def tile_places(d_pos: np.ndarray, d_seed: np.ndarray, i_pos: np.ndarray, i_seed: np.ndarray, seed_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair from the places of its common seeds: (length, start in document, start in item), longest first.

    The length of the longest match is found by halving, each trial with the running hashes of both sides
    in one sorted look-up, so a tile costs the length of the two texts times a logarithm, also where they
    repeat themselves. Ties go to the first place in the document, then in the item.
    """
    tiles = []
    while len(d_pos) and len(i_pos):
        d_runs, i_runs = _runs(d_pos), _runs(i_pos)

        def common(n: int) -> tuple[int, int] | None:
            a, x = _windows(d_seed, d_runs, n)  # noqa: B023
            b, y = _windows(i_seed, i_runs, n)  # noqa: B023
            hit = np.flatnonzero(np.isin(x, y))
            return (int(a[hit[0]]), int(b[np.flatnonzero(y == x[hit[0]])[0]])) if len(hit) else None

        low, high, best = 0, int(min(d_runs.max(), i_runs.max())), None
        while low < high:
            mid = (low + high + 1) // 2
            found = common(mid)
            low, high, best = (mid, high, found) if found else (low, mid - 1, best)
        if not low:
            break
        n, d, i = low + seed_words - 1, int(d_pos[best[0]]), int(i_pos[best[1]])
        tiles.append((n, d, i))
        keep_d, keep_i = (d_pos + seed_words <= d) | (d_pos >= d + n), (i_pos + seed_words <= i) | (i_pos >= i + n)
        d_pos, d_seed, i_pos, i_seed = d_pos[keep_d], d_seed[keep_d], i_pos[keep_i], i_seed[keep_i]
    return tiles


def tiles_of(common: list, seed_words: int) -> list[tuple[int, int, int]]:
    """The tiles of one pair from its common seeds, each with its places in the document and in the item."""
    places = [(d, i) for c in common for d in c["docs"] for i in c["items"]] if all(len(c["docs"]) * len(c["items"]) < 4 for c in common) else None
    if places is not None:
        matches, last = [], {}
        for d, i in sorted(places):
            run = last.pop(d - i, None)
            if run is not None and run[1] + run[0] == d:
                run[0] += 1
            else:
                run = [1, d, i]
                matches.append(run)
            last[d - i] = run
        return tile([(n + seed_words - 1, d, i) for n, d, i in matches], seed_words)
    d = np.array(sorted((p, c["seed"]) for c in common for p in c["docs"]), np.int64)
    i = np.array(sorted((p, c["seed"]) for c in common for p in c["items"]), np.int64)
    return tile_places(d[:, 0], d[:, 1].view(np.uint64), i[:, 0], i[:, 1].view(np.uint64), seed_words)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 12,
    broadcast_rows: int = 2_000_000,
    seed_words: int | None = None,
) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, tiled_words, n_words, coverage), one row per pair with a tile.

    ``n_words`` is the length of the item and ``coverage`` the share of it that lies in tiles. Tiles have
    ``seed_words`` words or more, as many as ``min_words`` if not given; pairs whose longest tile has fewer than
    ``min_words`` words are left out.
    """
    size = min_words if seed_words is None else seed_words
    wanted = written(
        seeds(items, item_id, text, size).groupBy(F.col(item_id).alias("item_id"), "seed").agg(F.max("n_words").alias("n_words"), F.collect_list("pos").alias("items")),
        "items",
    )
    small = wanted.count() <= broadcast_rows
    met = None if small else bits_of(wanted)
    held = seeds(docs, doc_id, text, size, met).select(F.col(doc_id).alias("doc_id"), F.col("pos").alias("doc_pos"), "seed")
    if small:
        known = held.join(F.broadcast(wanted.select("seed").distinct()), "seed", "left_semi")
        shared = known.groupBy("doc_id", "seed").agg(F.collect_list("doc_pos").alias("docs")).join(F.broadcast(wanted), "seed")
    else:
        shared = held.groupBy("doc_id", "seed").agg(F.collect_list("doc_pos").alias("docs")).join(wanted, "seed")
    # the common seeds of one pair with their places: no longer than the two texts, each of which was one row already
    pairs = shared.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("seed", "docs", "items")).alias("common"))

    @F.pandas_udf("array<int>")
    def tiles(common: pd.Series) -> pd.Series:
        return common.map(lambda c: [n for n, _, _ in tiles_of(c, size)])

    tiled = pairs.select("doc_id", "item_id", "n_words", tiles("common").alias("tiles"))
    words = F.aggregate("tiles", F.lit(0), lambda a, n: a + n)
    return tiled.select(
        "doc_id", "item_id", F.size("tiles").alias("n_tiles"), F.array_max("tiles").alias("longest"), words.alias("tiled_words"), "n_words",
        (words / F.col("n_words")).alias("coverage"),
    ).where(F.col("longest") >= min_words)
