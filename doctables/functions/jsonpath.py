"""Access to fields of JSON rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str, row: str | Column = "row_data") -> Column:
    """One field of a JSON object by its literal name, as text; NULL when absent."""
    row = F.col(row) if isinstance(row, str) else row
    if "'" in name:
        return F.from_json(row, "map<string,string>").getItem(name)
    return F.get_json_object(row, f"$['{name}']")


def number(name: str, row: str | Column = "row_data", type_: str = "double") -> Column:
    """One field as a number; NULL when it does not read as one."""
    return field(name, row).try_cast(type_)


def lenient_integer(c: Column) -> Column:
    """SQLite's CAST AS INTEGER: the leading digits, 0 when there are none, NULL stays NULL."""
    digits = F.regexp_extract(F.ltrim(c), r"^[+-]?\d+", 0)
    return F.when(c.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0).cast("bigint"))
    )


def lenient_real(c: Column) -> Column:
    """SQLite's CAST AS REAL: the leading number, 0.0 when there is none, NULL stays NULL."""
    digits = F.regexp_extract(F.ltrim(c), r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", 0)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.when(digits != "", digits.try_cast("double")), F.lit(0.0))
    )
