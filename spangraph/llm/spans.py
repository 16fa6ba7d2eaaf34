"""Long exact spans that several records share.

Records are cut by content: a gear rolling hash runs over the units (characters or steps) with a memory of
``window`` units, and of every ``least - window + 1`` neighbouring hash values the least (the rightmost of
equals) is a cut. All stretches of ``least`` units that have the same cut form one chunk, so chunks overlap
by ``least - 1`` units, depend on nothing outside themselves, and an insertion moves only the chunks that
it touches. Unlike cuts at masked hash values, these leave no stretch of ``least`` units without a chunk
that holds it whole, which makes the result exact.

One pass over the texts turns them into digests, which are written once: the digest of the cut window (the
anchor) and that of the chunk. Chunks whose anchor no other record holds share nothing and are let go
first. The others are deduplicated by digest: a chunk that two records hold is shared as a whole; a chunk of
one record, whose anchor others hold too, lies at the border of something shared. Only the texts of border
chunks, and of those they may agree with, are fetched again, one for each distinct chunk, and taken apart into
stretches, which are again deduplicated by digest. Every count is a minimum and a maximum of record
digests per key, so exact copies, however many, collapse before the shuffle and no pair of records is ever made.

Defined results: records that are null, ``*`` or shorter than ``least`` share nothing; keys are distinct,
which the caller sees to; a stretch that repeats only within one record is not shared; an empty table gives
an empty result; extra columns are ignored. A key of chunks is two 64-bit digests, a record one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions.seq import let
from spangraph.session import release, written

BLOCK = 4_000_000  # units that are hashed at a time
HASH_BITS = 24  # of the rolling hash, so that a value and a place fit into 64 bits
GEAR = 0x9E3779B97F4A7C15
SCATTER = 0xBF58476D1CE4E5B9


class Kind(NamedTuple):
    """How the records of one field are cut: least length, window of the hash, and whether units are steps."""

    least: int
    window: int
    by_step: bool = False


def _mixed(codes):
    """A pseudo-random 64-bit value of each unit code."""
    import numpy as np

    x = codes.astype(np.uint64) * np.uint64(GEAR) + np.uint64(GEAR)
    x ^= x >> np.uint64(29)
    x *= np.uint64(SCATTER)
    return x ^ (x >> np.uint64(32))


def rolling(codes, window: int):
    """The gear hash of each ``window`` units: hashes of 1, 2, 4, ... units are put together to that length."""
    import numpy as np

    power, size = _mixed(codes), 1  # hash of ``size`` units from each place on
    out, done = None, 0
    while True:
        if window & size:
            if out is None:
                out = power
            else:  # ``size`` units, followed by the ``done`` units that are hashed already
                n = len(out) - size
                out = (power[:n] << np.uint64(done)) + out[size:]
            done += size
        if done == window:
            return out
        n = len(power) - size
        power = (power[:n] << np.uint64(size)) + power[size : size + n]
        size *= 2


def least_of(values, reach: int):
    """The least of each ``reach`` neighbouring values, by windows that double in width."""
    import numpy as np

    size = 1
    while size * 2 <= reach:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = reach - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cuts(codes, ends, least: int, window: int):
    """For records laid end to end: (first stretch, last stretch, place of the cut, hash there), in units from the start.

    ``ends`` holds where each record ends. Stretches that would cross an end are left out.
    """
    import numpy as np

    n, reach = len(codes), least - window + 1
    if n < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    rolled = rolling(codes, window)
    bits = min(window, HASH_BITS)
    low = np.uint64((1 << (64 - bits)) - 1)
    # the value above, its place counted from the end below, so that the least is also the rightmost
    ranked = ((rolled & np.uint64((1 << bits) - 1)) << np.uint64(64 - bits)) | (low - np.arange(len(rolled), dtype=np.uint64))
    cut = (low - (least_of(ranked, reach) & low)).astype(np.int64)
    first = np.arange(len(cut))
    owner = np.searchsorted(ends, first, side="right")
    whole = ends[owner] >= first + least
    first, cut, owner = first[whole], cut[whole], owner[whole]
    new = np.ones(len(first), bool)
    new[1:] = (cut[1:] != cut[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(first)) - 1
    return first[begin], first[last], cut[begin], rolled[cut[begin]]


class _StepCodes(dict):
    def __missing__(self, step: str) -> int:
        import xxhash

        if len(self) > BLOCK:
            self.clear()
        self[step] = code = xxhash.xxh3_64_intdigest(step)
        return code


def chunks(records: DataFrame, keys: list[str], units: str, kind: str, kinds: Mapping[str, Kind]) -> DataFrame:
    """(*keys, start, n, at, bytes, anchor, chunk): the chunks of each record.

    ``start`` and ``n`` count units, ``at`` and ``bytes`` the same place in bytes of the text; ``anchor`` and
    ``chunk`` are digests of the cut window and of the whole. ``kind`` is one of the keys.
    """
    fields = ", ".join(f"{k} string" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import xxhash

        digest, step, known = xxhash.xxh3_64_intdigest, re.compile("[<>][^<>]*"), _StepCodes()
        for whole in batches:
            names = whole.column(keys.index(kind))
            for name in names.unique().to_pylist():
                least, window, by_step = kinds[name]
                batch = whole.filter(pa.compute.equal(names, name))
                texts = batch.column(len(keys)).to_pylist()
                at = 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                        size += len(texts[to])
                        to += 1
                    text = "".join(texts[at:to])
                    raw = text.encode("utf-8", "surrogatepass")
                    if by_step:
                        parts = [step.findall(t) for t in texts[at:to]]
                        lengths = np.array([len(p) for p in parts], np.int64)
                        codes = np.array([known[s] for p in parts for s in p], np.uint64)
                        sizes = np.array([len(s.encode()) for p in parts for s in p], np.int64)
                        begins = np.concatenate([[0], np.cumsum(sizes)])
                    else:
                        lengths = np.array([len(t) for t in texts[at:to]], np.int64)
                        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                        begins = None if len(raw) == len(text) else np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
                    ends = np.cumsum(lengths)
                    first, last, cut, value = cuts(codes, ends, least, window)
                    owner = np.searchsorted(ends, first, side="right")
                    base = (ends - lengths)[owner]
                    a, b = (first, last + least) if begins is None else (begins[first], begins[last + least])
                    zero = base if begins is None else begins[base]
                    own = np.array([digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())], np.uint64)
                    salt = np.uint64(digest(name))
                    out = [batch.column(k).slice(at, to - at).take(pa.array(owner)) for k in range(len(keys))]
                    out += [pa.array(first - base), pa.array((last - first + least).astype(np.int32)), pa.array(a - zero), pa.array((b - a).astype(np.int32))]
                    out += [pa.array((value ^ salt).view(np.int64)), pa.array((own ^ salt).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(out, [*keys, "start", "n", "at", "bytes", "anchor", "chunk"])
                    at = to

    known = records.where(F.col(units).isNotNull() & (F.col(units) != "*")).select(*keys, units)
    return known.mapInArrow(run, f"{fields}, start long, n int, at long, bytes int, anchor long, chunk long")


def shared_spans_of_kinds(records: DataFrame, keys: list[str], units: str, kind: str, kinds: Mapping[str, Kind]) -> DataFrame:
    """(*keys, span_start, span_end): the maximal runs of shared positions of each record, end exclusive.

    ``kind``, one of the keys, names how a record is cut; records of different kinds share nothing.
    ``units`` is a text of characters, or of steps that each begin with ``>`` or ``<``.
    """
    records = written(records.select(*keys, units), "records")
    rows = written(chunks(records, keys, units, kind, kinds).withColumn("record", F.xxhash64(*keys)), "chunks")
    met = rows.groupBy("anchor").agg(F.min("record").alias("lo"), F.max("record").alias("hi")).where("lo <> hi").select("anchor")
    live = written(rows.join(met, "anchor", "left_semi"), "live")
    classes = live.groupBy("anchor", "chunk").agg(F.min("record").alias("lo"), F.max("record").alias("hi"))
    marked = written(live.join(classes, ["anchor", "chunk"]), "marked")
    borders = marked.where("lo = hi").select("anchor").distinct()
    # one record stands for all that hold the same chunk
    taken = marked.where("record = lo").join(borders, "anchor", "left_semi").select(*keys, "start", "at", "bytes", "n", "lo", "hi")
    text = F.encode(F.col(units), "UTF-8").substr(F.col("at").cast("int") + 1, F.col("bytes")).cast("string")
    fetched = written(taken.join(records, keys).select(*keys, "start", "n", "lo", "hi", text.alias("text")), "borders")
    steps = F.regexp_extract_all("text", F.lit("[<>][^<>]*"), F.lit(0))
    least, opened = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    for name, (size, _, by_step) in kinds.items():
        offsets = F.sequence(F.lit(0), F.col("n") - F.lit(size))
        if by_step:
            cut = let(steps, lambda s: F.transform(offsets, lambda i: F.array_join(F.slice(s, i + 1, size), "")))  # noqa: B023
        else:
            cut = F.transform(offsets, lambda i: F.substring(F.col("text"), i + 1, F.lit(size)))  # noqa: B023
        least, opened = F.when(F.col(kind) == name, size).otherwise(least), F.when(F.col(kind) == name, cut).otherwise(opened)
    parts = fetched.select(*keys, "start", "lo", "hi", least.alias("least"), F.posexplode(opened).alias("offset", "stretch"))
    stretches = parts.select(
        *keys, (F.col("start") + F.col("offset")).alias("a"), "least", "lo", "hi",
        F.xxhash64(kind, "stretch").alias("s_a"), F.xxhash64(F.lit("2nd"), kind, "stretch").alias("s_b"),
    )
    twice = stretches.groupBy("s_a", "s_b").agg(F.min("lo").alias("s_lo"), F.max("hi").alias("s_hi")).where("s_lo <> s_hi").select("s_a", "s_b")
    pieces = stretches.where("lo = hi").join(twice, ["s_a", "s_b"], "left_semi").select(*keys, "a", (F.col("a") + F.col("least")).alias("b"))
    whole = marked.where("lo <> hi").select(*keys, F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    for done in (rows, live):
        release(done)
    return merged(whole.unionByName(pieces), keys)


def shared_spans(records: DataFrame, keys: list[str], units: str, least: int, window: int, by_step: bool = False) -> DataFrame:
    """As ``shared_spans_of_kinds`` for records that are all cut alike."""
    named = records.select(*[F.col(k).cast("string").alias(k) for k in keys], units, F.lit("one").alias("__kind"))
    return shared_spans_of_kinds(named, [*keys, "__kind"], units, "__kind", {"one": Kind(least, window, by_step)}).drop("__kind")


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching intervals [a, b) of each record as one span."""
    order = W.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("__new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)).withColumn(
        "__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    return runs.groupBy(*keys, "__run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("__run")
