"""Guards against computing an expression more often than once.

The optimizer pushes a filter on a computed column below the projection that computes it, and
puts a column that is used once into the expression that uses it. Both repeat the work when the
column is an array built over a whole document, or is captured by a lambda."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """``filter`` on a condition over computed columns, which stays above their projection."""
    return df.withColumn("_keep", F.explode(F.when(condition, F.array(F.lit(True))))).drop("_keep")


def explodable(array: Column | str) -> Column:
    """A computed array to explode, without a filter on its size below its projection."""
    array = F.col(array) if isinstance(array, str) else array
    return F.when(F.size(array) > 0, array)


def captured(name: str, result: Column) -> Column:
    """``result`` has a lambda over the array column ``name``; using that once more keeps it a
    column of its own instead of being computed again for every element."""
    return F.when(F.size(name) >= 0, result)
