"""Rows that fail to parse: every column as nullable text, rules into an error array, split on its size.

A line of comma-separated fields is taken apart by Spark's own regular expressions. Quantifiers are
possessive, so that lines of any length are matched without backtracking.

Defined results: null, empty and blank lines fail with ``column_count``; repeated lines each keep their
row; an empty table gives empty results; extra columns are carried through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
LINE = rf"\A(?:,{FIELD})*+\z"


def text_columns(df: DataFrame, line: str, names: Sequence[str]) -> DataFrame:
    """Adds ``__quoting`` (broken quoting), ``__n`` (number of fields) and each named field as trimmed text.

    Fields are null where the line's quoting or number of fields is wrong.
    """
    lead = F.concat(F.lit(","), F.col(line))
    whole = lead.rlike(LINE)
    parts = F.when(whole, F.regexp_extract_all(lead, F.lit(f",({FIELD})"), F.lit(1)))
    out = df.withColumn("__parts", parts).withColumn("__quoting", F.coalesce(~whole, F.lit(False)))
    blank = F.col(line).isNull() | (F.btrim(F.col(line), F.lit(" \t\r\n\f\u000b")) == "")
    out = out.withColumn("__n", F.when(blank, 0).otherwise(F.size("__parts")))
    right = F.col("__n") == len(names)
    for i, name in enumerate(names):
        raw = F.get("__parts", F.lit(i))
        bare = F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
        out = out.withColumn(name, F.when(right, F.btrim(bare, F.lit(" "))))
    return out.drop("__parts")


def with_errors(df: DataFrame, line: str, names: Sequence[str], rules: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds the named fields and ``errors``, the reasons that hold of the line, in the order of the rules.

    A rule maps a field's text to true where it is valid; null or false is an error named like the field.
    """
    out = text_columns(df, line, names)
    wrong = [F.when(F.col("__quoting"), F.lit("quoting")), F.when(~F.col("__quoting") & (F.col("__n") != len(names)), F.lit("column_count"))]
    fine = ~F.col("__quoting") & (F.col("__n") == len(names))
    wrong += [F.when(fine & ~F.coalesce(rule(F.col(name)), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return out.withColumn("errors", F.array_compact(F.array(*wrong))).drop("__quoting", "__n")


def positive_long(text: Column) -> Column:
    """Digits 0-9 only, of a value from 1 to the largest long."""
    return F.when(text.rlike(r"\A[0-9]+\z"), F.coalesce(text.try_cast("bigint") >= 1, F.lit(False))).otherwise(False)


def boolean_text(text: Column) -> Column:
    return F.lower(text).isin("true", "false", "1", "0")


def rejected(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, reason): the bad lines with the first reason."""
    return checked.where(F.size("errors") > 0).select(*keys, F.get("errors", F.lit(0)).alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")
