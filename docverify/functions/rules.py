"""Violations: rows of key, rule, subject, detail and severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
FOUND = "array<struct<rule:string,subject:string,detail:string,severity:string>>"


def _text(x: Column | str | None) -> Column:
    return F.lit(x) if x is None or isinstance(x, str) else x.cast("string")


def broken(rules: list[tuple[str, Column, Column | None] | tuple[str, Column, Column | None, str]], subject: Column | str) -> Column:
    """Array of rule, subject, detail, severity of the rules that hold in a row.  A rule: its name, when it is broken, a detail, and the severity."""
    found = [F.when(F.coalesce(r[1], F.lit(False)), F.struct(F.lit(r[0]).alias("rule"), _text(F.col(subject) if isinstance(subject, str) else subject).alias("subject"), _text(r[2]).cast("string").alias("detail"), F.lit(r[3] if len(r) > 3 else ERROR).alias("severity"))) for r in rules]
    some = reduce(Column.__or__, (F.coalesce(r[1], F.lit(False)) for r in rules))  # most rows break none
    return F.when(some, F.array_compact(F.array(*found))).otherwise(F.array().cast(FOUND))


def violations(rows: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column | None] | tuple[str, Column, Column | None, str]], subject: Column | str) -> DataFrame:
    """A row for each rule that holds in a row: all rules in one pass."""
    return rows.select(*keys, F.explode(broken(rules, subject)).alias("v")).select(*keys, "v.*")


def as_violation(rows: DataFrame, keys: list[str], rule: str, subject: Column | str, detail: Column | str | None = None, severity: str = ERROR) -> DataFrame:
    """Every row as a violation of one rule."""
    return rows.select(*keys, F.lit(rule).alias("rule"), _text(F.col(subject) if isinstance(subject, str) else subject).alias("subject"), (F.lit(None) if detail is None else _text(detail)).cast("string").alias("detail"), F.lit(severity).alias("severity"))


def repeated(rows: DataFrame, keys: list[str], col: str, rule: str, severity: str = ERROR) -> DataFrame:
    """Values that occur more than once under a key; detail: how often."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count("*").alias("_n")).where("_n > 1")
    return as_violation(counts, keys, rule, "_v", F.col("_n"), severity)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def absent(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner."""
    return rows.join(others.select(on).distinct(), on, "left_anti")
