"""Text helpers shared by the operators; every one is a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Remove surrounding whitespace of any kind (Spark's bare trim removes blanks only)."""
    return F.trim(c, F.lit(WHITESPACE))


def json_string(c: Column) -> Column:
    """A string as a JSON literal; the JSON writer runs only where escaping is needed."""
    quoted = F.to_json(F.array(c))
    return F.when(
        c.rlike(r'["\\\x00-\x1F\x7F]'), F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    ).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def file_stem(path: Column) -> Column:
    """Last path segment without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' when there is none (a leading dot is not one)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
