"""Column functions over text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the checks take it: Unicode's, and the four separators below the blank.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Any other character.
INK = r"(?U)[^\s\x1c-\x1f]"


def normalize_ws(col: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.btrim(F.regexp_replace(col, f"{SPACE}+", " "))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+\\z", "")


def blank(col: Column) -> Column:
    """Null, or nothing but white space."""
    return col.isNull() | ~col.rlike(INK)


def _composed(values: pd.Series) -> pd.Series:
    return values if values.isna().all() else values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(col: Column) -> Column:
    """Composed form; only values beyond ASCII go to Python."""
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def slot_key(col: Column) -> Column:
    """Composed form, white space collapsed, A-Z lower-cased."""
    return F.translate(normalize_ws(nfc(col)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(col: Column) -> Column:
    """Struct of sha256 and its first 16 digits."""
    full = F.sha2(col, 256)
    return F.struct(full.alias("sha256"), F.substring(full, 1, 16).alias("sha16"))


def title_key(col: Column) -> Column:
    """Without a leading number and blanks, lower-cased."""
    return F.lower(F.replace(F.regexp_replace(col, r"^\s*\d+[.)]\s*", ""), F.lit(" "), F.lit("")))


def occurrences(text: Column, part: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too; none of an empty part.

    The text is cut before each occurrence, and the pieces' lengths are added up: one pass over it."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(text, literal, -1)
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, part), F.array(F.lit(0))).otherwise(none).alias("out"))

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    return F.when(F.coalesce(F.length(part) > 0, F.lit(False)), F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda s: s["out"])).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_count(flags: Column) -> Column:
    """For each element of an array of booleans, how many are true up to it, itself included; null counts as false.

    The flags are written as a string and cut at each true one, so it is one pass over them."""
    runs = F.split(F.array_join(F.transform(flags, lambda f: F.when(f, "1").otherwise("0")), ""), "1", -1)
    return F.flatten(F.transform(runs, lambda run, i: F.array_repeat(i, F.length(run) + F.when(i > 0, 1).otherwise(0))))


def places(flags: Column) -> Column:
    """0-based positions of what is true in an array of booleans."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
