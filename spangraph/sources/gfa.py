"""Graph text files (records S, L, P and W): read into segments, links and paths, and written back.

Compressed files are read by their suffix. Malformed input is refused by ``problems``, not repaired: the
readers themselves keep what parses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.operators.walks import walk_text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with its fields and its place: the file, the start of the block it was read from, and a number that rises within the block."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.split("value", "\t").alias("f"), place.alias("place"))


def _extras(from_field: int, extras: bool) -> list:
    """With ``extras``, the optional fields from ``from_field`` on as one text (null if none) and the place of the record."""
    tags = F.when(F.size("f") > from_field, F.array_join(F.slice("f", from_field + 1, F.greatest(F.size("f") - from_field, F.lit(0))), "\t"))
    return [tags.alias("tags"), F.col("place")] if extras else []


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(tags, place) of the H records."""
    return _lines(spark, path).where("f[0] = 'H'").select(*_extras(1, True))


def _field(i: int):
    return F.get("f", F.lit(i))


def segments(spark: SparkSession, path: str, extras: bool = False) -> DataFrame:
    """(node_id, sequence, length_bp): ``*`` is no sequence; its length may stand in an LN tag."""
    tag = F.regexp_extract("value", r"\tLN:i:(\d+)", 1)
    known = F.when(_field(2) != "*", _field(2))
    length = F.coalesce(F.length(known).cast("long"), tag.try_cast("bigint"))
    return _lines(spark, path).where("f[0] = 'S' and size(f) >= 3").select(_field(1).alias("node_id"), known.alias("sequence"), length.alias("length_bp"), *_extras(3, extras))


def links(spark: SparkSession, path: str, extras: bool = False) -> DataFrame:
    """(from_id, from_orient, to_id, to_orient, overlap): an overlap of ``*`` is unknown, null."""
    overlap = F.regexp_extract(_field(5), r"^(\d+)M$", 1).try_cast("bigint")
    return _lines(spark, path).where("f[0] = 'L' and size(f) >= 5").select(
        _field(1).alias("from_id"), _field(2).alias("from_orient"), _field(3).alias("to_id"), _field(4).alias("to_orient"), overlap.alias("overlap"), *_extras(6, extras)
    )


def paths(spark: SparkSession, path: str, extras: bool = False) -> DataFrame:
    """(path_name, path_type, steps, walk_start, walk_end): both record types, steps in arrowed form.

    A W record's name is sample#haplotype#contig, with its 0-based start made 1-based where it has a range.
    """
    at = lambda i: F.when(_field(i) != "*", _field(i)).try_cast("bigint")
    p = _lines(spark, path).where("f[0] = 'P' and size(f) >= 3").select(
        _field(1).alias("path_name"), F.lit("P").alias("path_type"), walk_text(_field(2)).alias("steps"),
        F.lit(None).cast("bigint").alias("walk_start"), F.lit(None).cast("bigint").alias("walk_end"), *_extras(4, extras),
    )
    name = F.concat_ws("#", _field(1), _field(2), _field(3))
    ranged = F.concat(name, F.lit(":"), at(4) + 1, F.lit("-"), at(5))
    w = _lines(spark, path).where("f[0] = 'W' and size(f) >= 7").select(
        F.coalesce(ranged, name).alias("path_name"), F.lit("W").alias("path_type"), _field(6).alias("steps"), at(4).alias("walk_start"), at(5).alias("walk_end"), *_extras(7, extras)
    )
    return p.unionByName(w)


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(reason, what): segments given twice, links and steps to undefined segments, empty walks, records with too few fields."""
    s, link, p = segments(spark, path), links(spark, path), paths(spark, path)
    ids = s.select("node_id").distinct()
    twice = s.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate_segment").alias("reason"), F.col("node_id").alias("what"))
    ends = link.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct().join(ids, "node_id", "left_anti")
    steps = p.select(F.explode(F.regexp_extract_all("steps", F.lit("[<>]([^<>]+)"), F.lit(1))).alias("node_id")).distinct().join(ids, "node_id", "left_anti")
    least = F.when(F.col("f")[0] == "S", 3).when(F.col("f")[0] == "L", 5).when(F.col("f")[0] == "P", 3).when(F.col("f")[0] == "W", 7)
    short = _lines(spark, path).where(F.size("f") < least).select(F.lit("too_few_fields").alias("reason"), F.col("value").alias("what"))
    empty = p.where("coalesce(steps, '') in ('', '*')").select(F.lit("empty_walk").alias("reason"), F.col("path_name").alias("what"))
    undefined = lambda d, why: d.select(F.lit(why).alias("reason"), F.col("node_id").alias("what"))
    return twice.unionByName(undefined(ends, "undefined_link_end")).unionByName(undefined(steps, "undefined_step")).unionByName(short).unionByName(empty)


def write(segment_rows: DataFrame, link_rows: DataFrame, path_rows: DataFrame, path: str, header_rows: DataFrame | None = None) -> None:
    """The tables as one folder of text.

    A ``tags`` column, where a table has one, is put behind the fields. Where all tables have ``place`` (read with
    ``extras``) the records come in that order, otherwise headers before segments before links before paths, each
    sorted. A row whose path_type is W, whose name is sample#haplotype#contig with or without a range, becomes a W record; all
    others become P records. A segment of known length without sequence gets an LN tag unless its tags hold one.
    """
    given = [d for d in (header_rows, segment_rows, link_rows, path_rows) if d is not None]
    ordered = all("place" in d.columns for d in given)

    def line(d: DataFrame, rank: int, *fields, more=None) -> DataFrame:
        tags = F.col("tags") if "tags" in d.columns else F.lit(None).cast("string")
        tags = tags if more is None else F.concat_ws("\t", more(F.coalesce(tags, F.lit(""))), tags)
        value = F.concat_ws("\t", *fields, F.when(tags != "", tags))
        return d.select((F.lit(0) if ordered else F.lit(rank)).alias("o"), *([F.col("place")] if ordered else []), value.alias("value"))

    arrows = F.regexp_extract_all("steps", F.lit("[<>][^<>]+"), F.lit(0))
    signed = F.array_join(F.transform(arrows, lambda s: F.concat(s.substr(F.lit(2), F.length(s)), F.when(s.startswith(">"), "+").otherwise("-"))), ",")
    parts = F.split("path_name", "#", 3)
    of_walk = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("*")) if name in path_rows.columns else F.lit("*")
    is_walk = (F.coalesce(F.col("path_type"), F.lit("P")) == "W") & (F.size(parts) == 3) if "path_type" in path_rows.columns else F.lit(False)
    length = F.col("length_bp").cast("string") if "length_bp" in segment_rows.columns else F.lit(None).cast("string")
    long = lambda tags: F.when(F.col("sequence").isNull() & ~F.concat(F.lit("\t"), tags).contains("\tLN:i:"), F.concat(F.lit("LN:i:"), length))
    lines = [
        line(segment_rows, 1, F.lit("S"), "node_id", F.coalesce("sequence", F.lit("*")), more=long),
        line(link_rows, 2, F.lit("L"), "from_id", "from_orient", "to_id", "to_orient", F.coalesce(F.concat("overlap", F.lit("M")), F.lit("*"))),
        line(path_rows.where(~is_walk), 3, F.lit("P"), "path_name", signed, F.lit("*")),
        line(path_rows.where(is_walk), 3, F.lit("W"), parts[0], parts[1], F.regexp_replace(parts[2], r":[0-9]+-[0-9]+$", ""), of_walk("walk_start"), of_walk("walk_end"), "steps"),
    ]
    if header_rows is not None:
        lines.append(line(header_rows, 0, F.lit("H")))
    out = lines[0]
    for other in lines[1:]:
        out = out.unionByName(other)
    keys = ["o", "place", "value"] if ordered else ["o", "value"]
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)
