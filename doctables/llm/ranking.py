"""Numbers 1, 2, 3, ... in an order, over any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written


def ranked(df: DataFrame, order: list[Column], folder: str, name: str, rank: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 by ``order``: a range sort, stored, and one offset per partition
    of it (a table of as many rows as partitions). Rows equal in ``order`` get their numbers in any order."""
    at, part = f"_{rank}_at", f"_{rank}_part"
    sorted_ = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), folder, name,
    ).withColumn(part, F.shiftright(at, 33))
    first, before = f"_{rank}_first", f"_{rank}_before"
    counts = sorted_.groupBy(part).agg(F.min(at).alias(first), F.count("*").alias(before))
    offsets = counts.select(part, first, (F.sum(before).over(W.orderBy(part)) - F.col(before)).alias(before))
    return sorted_.join(F.broadcast(offsets), part).withColumn(
        rank, F.col(at) - F.col(first) + F.col(before) + 1).drop(at, part, first, before)
