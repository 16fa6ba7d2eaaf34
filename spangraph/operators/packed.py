"""Several values packed in one field: infer the delimiters per source, then split and explode with position.

``delimiter_scores`` scores each candidate delimiter of a source on two things:

* consistency: over the rows that hold the candidate, how much of the piece count under all candidates together
  the candidate alone already gives (1 where the counts agree, less where a row mixes delimiters);
* regularity: of the pieces that the candidate makes, the share whose shape (letter runs and digit
  runs collapsed) is a usual shape of the source's values, one that at least ``usual_share`` of its rows hold.

A candidate is a delimiter of the source where the product of the two is at least ``min_score``.

Scoring runs on distinct *layouts* (the packed text with letter and digit runs collapsed), so that one
partial aggregation shrinks the data before any piece is looked at.

Defined results: null, empty and blank fields give no rows; repeated rows each give their own rows;
places that are empty or hold only a missing-value mark take no position; extra columns of the input
are ignored unless named in ``keys``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = (";", ",", "|", "/", "\t", " ")
MISSING = ("", ".", "NA")
QUOTED = r"""\"[^\"]*+(?:\"\"[^\"]*+)*+\"|'[^']*+(?:''[^']*+)*+'"""
WRAPPING = "\"'[]{}()"
MARK = "\u001f"


def _strip(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def _char_class(chars: Column) -> Column:
    """Every character of ``chars`` escaped for use inside a regular-expression class."""
    return F.regexp_replace(chars, r"([^\sA-Za-z0-9])", r"\\$1")


def layouts(df: DataFrame, source: str, packed: str, protected: Sequence[str]) -> DataFrame:
    """(source, layout, n): the packed texts with quoted names, letter runs and digit runs collapsed."""
    text = F.col(packed)
    masked = F.when(F.col(source).isin(*protected), F.regexp_replace(text, QUOTED, "q")).otherwise(text) if protected else text
    bare = F.regexp_replace(F.translate(masked, WRAPPING, ""), r"(?<![A-Za-z0-9])NA(?![A-Za-z0-9])", "")
    shape = F.regexp_replace(F.regexp_replace(bare, "[A-Za-z]+", "a"), "[0-9]+", "9")
    return (
        df.where(text.isNotNull())
        .select(F.col(source).alias("source"), _strip(shape, " \t").alias("layout"))
        .groupBy("source", "layout")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def delimiter_scores(
    df: DataFrame,
    source: str,
    packed: str,
    protected: Sequence[str] = (),
    candidates: Sequence[str] = CANDIDATES,
    min_score: float = 0.25,
    usual_share: float = 0.05,
) -> DataFrame:
    """(source, delimiter, n_rows, consistency, regularity, score, accepted), one row per source and candidate in use.

    ``protected`` lists the sources whose quoted pieces are single values that may hold a delimiter.
    """
    every = "[" + "".join("\\" + c if not c.isspace() else c for c in candidates) + "]"
    found = layouts(df, source, packed, protected).withColumn(
        "pieces", F.filter(F.split("layout", every), lambda p: ~p.isin(*MISSING))
    )
    shapes = (
        found.select("source", "n", F.explode(F.array_distinct("pieces")).alias("shape"))
        .groupBy("source", "shape")
        .agg(F.sum("n").alias("n"))
    )
    totals = found.groupBy("source").agg(F.sum("n").alias("all_rows"))
    usual = (
        shapes.join(totals, "source")
        .where(F.col("n") >= F.col("all_rows") * F.lit(usual_share))
        .groupBy("source")
        .agg(F.collect_set("shape").alias("usual"))
    )
    ends = "".join(candidates)
    tried = (
        found.withColumn("delimiter", F.explode(F.array(*[F.lit(c) for c in candidates])))
        .where(F.instr(F.col("layout"), F.col("delimiter")) > 0)
        .withColumn(
            "own",
            F.filter(
                F.transform(F.split("layout", F.concat(F.lit("["), _char_class(F.col("delimiter")), F.lit("]"))), lambda p: _strip(p, ends)),
                lambda p: ~p.isin(*MISSING),
            ),
        )
        .join(usual, "source")
    )
    regular = F.size(F.filter("own", lambda p: F.array_contains(F.col("usual"), p) | p.contains("q")))
    # own pieces are never more than all pieces; a row of no values agrees
    agree = F.coalesce(F.try_divide(F.size("own").cast("double"), F.size("pieces").cast("double")), F.lit(1.0))
    scored = tried.groupBy("source", "delimiter").agg(
        F.sum("n").alias("n_rows"),
        (F.sum(agree * F.col("n")) / F.sum("n")).alias("consistency"),
        F.coalesce(F.try_divide(F.sum(regular * F.col("n")), F.sum(F.size("own") * F.col("n"))), F.lit(0.0)).alias("regularity"),
    )
    return scored.withColumn("score", F.col("consistency") * F.col("regularity")).withColumn(
        "accepted", F.col("score") >= F.lit(min_score)
    )


def unpack(
    df: DataFrame,
    source: str,
    keys: Sequence[str],
    packed: str,
    protected: Sequence[str] = (),
    candidates: Sequence[str] = CANDIDATES,
    min_score: float = 0.25,
) -> DataFrame:
    """(source, *keys, pos, val): one row per packed value, ``pos`` counting from 1.

    The delimiters of a source are those that ``delimiter_scores`` accepts. In sources named in
    ``protected`` a quoted piece is one value (a doubled quote inside stands for one quote); in the
    others quotes are dropped, since they may enclose several values.
    """
    accepted = (
        delimiter_scores(df, source, packed, protected, candidates, min_score)
        .where("accepted")
        .groupBy("source")
        .agg(F.concat_ws("", F.sort_array(F.collect_set("delimiter"))).alias("__delims"))
        .withColumnRenamed("source", "__source")
    )
    # one row per source, so the broadcast is bounded by the number of sources
    joined = df.select(source, *keys, packed).where(F.col(packed).isNotNull()).join(F.broadcast(accepted), F.col(source) == F.col("__source"), "left")
    klass = _char_class(F.coalesce(F.col("__delims"), F.lit("")))
    blank = WRAPPING[2:] + " \t\r\n"
    named = F.transform(
        F.regexp_extract_all(F.col(packed), F.concat(F.lit(QUOTED + "|[^\"'"), klass, F.lit("]+")), F.lit(0)),
        lambda t: F.when(t.startswith('"'), F.btrim(F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))))
        .when(t.startswith("'"), F.btrim(F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))))
        .otherwise(_strip(t, blank)),
    )
    plain = F.transform(
        F.split(F.translate(F.col(packed), "\"'", MARK * 2), F.concat(F.lit("[" + MARK), klass, F.lit("]"))),
        lambda t: _strip(t, blank),
    )
    values = F.when(F.col(source).isin(*protected), named).otherwise(plain) if protected else plain
    return joined.select(
        F.col(source), *keys, F.posexplode(F.filter(values, lambda v: ~v.isin(*MISSING))).alias("__pos", "val")
    ).select(source, *keys, (F.col("__pos") + 1).alias("pos"), "val")
