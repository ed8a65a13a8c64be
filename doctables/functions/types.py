"""Cell classification, type votes and storage types.

One pass gives every cell a one-letter kind; labels and storage types are counts of kinds:

    m missing   e blank   d a single dash   z exactly 0 or 1   i 64-bit integer
    n wider integer   u integer with underscores   f float   t true/false
    b other boolean word   D date (only when asked for)   s anything else
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import json_string, strip

INTEGER_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT_PATTERN = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
DATE_PATTERN = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$"

# Words read as booleans, and the spellings a reader turns into real booleans.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "on", "off", "1", "0"]
BOOLEAN_LITERALS = ["True", "TRUE", "true", "False", "FALSE", "false"]

# Cell texts that stand for a missing value.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A number that may carry thousands separators.
GROUPED_NUMBER_PATTERN = r"^[-+]?(\d+,|\d)*(\.\d*)?(\d?[eE]-?\d+)?$"

VOTE_THRESHOLD = 0.8


def is_integer(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN)


def is_float(c: Column) -> Column:
    return c.rlike(FLOAT_PATTERN)


def is_boolean(c: Column) -> Column:
    return F.lower(c).isin(BOOLEAN_WORDS)


def is_date(c: Column) -> Column:
    as_iso = F.regexp_replace(strip(c), "/", "-")
    return c.rlike(DATE_PATTERN) & as_iso.try_cast("date").isNotNull()


def cell_kind(c: Column, dates: bool = False) -> Column:
    word = F.length(c) <= max(map(len, BOOLEAN_WORDS))  # spares longer texts the word lists
    kind = (
        F.when(c.isNull(), "m")
        .when(c == "-", "d")
        .when(c.isin("0", "1"), "z")
        .when(
            is_integer(c),
            F.when(F.contains(c, F.lit("_")), "u")
            .when(strip(c).try_cast("bigint").isNotNull(), "i")
            .otherwise("n"),
        )
        .when(is_float(c), "f")
        .when(word & c.isin(BOOLEAN_LITERALS), "t")
        .when(word & is_boolean(c), "b")
        .when(strip(c) == "", "e")
    )
    if dates:
        kind = kind.when(is_date(c), "D")
    return kind.otherwise("s")


def storage_from_counts(count: Callable[[str], Column], total: Column) -> Column:
    """int64 / float64 / bool / object from ``count(kinds)`` = cells whose kind is in ``kinds``."""
    return (
        F.when(total == 0, "object")
        .when(count("iz") == total, "int64")
        .when(count("izfm") == total, "float64")
        .when(count("t") == total, "bool")
        .otherwise("object")
    )


def label_from_counts(
    count: Callable[[str], Column],
    total: Column,
    missing_counts_as_float: bool = True,
    dates: bool = False,
) -> Column:
    """integer / float / boolean / string by a vote of strictly more than 80 % of the
    non-empty cells. A float among numbers makes the column float, as a reader would store
    it; so does a missing cell, which reads as a float unless told otherwise."""
    missing = "m" if missing_counts_as_float else ""
    voters = total - count("de" if missing_counts_as_float else "dem")
    turns_float = count("f" + missing) > 0
    label = F.when(voters <= 0, "string")
    label = label.when((count("izfm") == total) & turns_float, "float")
    label = (
        label.when(count("izun") > voters * VOTE_THRESHOLD, "integer")
        .when(count("izunf" + missing) > voters * VOTE_THRESHOLD, "float")
        .when(count("tbz") > voters * VOTE_THRESHOLD, "boolean")
    )
    if dates:
        label = label.when(count("D") > voters * VOTE_THRESHOLD, "date")
    return label.otherwise("string")


def count_kinds(kinds: Column) -> Callable[[str], Column]:
    """Counter over a string of kind letters."""
    return lambda letters: F.length(kinds) - F.length(F.translate(kinds, letters, ""))


def normalize_cell(c: Column) -> Column:
    """Missing markers become NULL; thousands separators leave cells that read as numbers."""
    grouped = F.contains(c, F.lit(",")) & strip(c).rlike(GROUPED_NUMBER_PATTERN)
    return F.when(c.isin(MISSING_MARKERS), F.lit(None).cast("string")).otherwise(
        F.when(grouped, F.replace(c, F.lit(","), F.lit(""))).otherwise(c)
    )


def json_literal(c: Column, storage: Column) -> Column:
    """A cell as JSON: numbers and booleans stay such, a missing cell is null."""
    as_double = strip(c).try_cast("double")
    finite = as_double.isNotNull() & ~F.isnan(as_double) & (F.abs(as_double) < float("inf"))
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(storage == "int64", strip(c).try_cast("bigint").cast("string"))
        .when((storage == "float64") & finite, as_double.cast("string"))
        .when(storage == "bool", F.lower(c))
        .otherwise(json_string(c))
    )
