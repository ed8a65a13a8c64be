"""Totals of JSON rows over several groupings at once, with distinct counts.

Rows are first combined per finest group and counted value, map-side and by one shuffle; only what is left is expanded
to the grouping sets. Distinct values are counted exactly, and by a sketch that can be stored and merged with others."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import field, number

#: 2^12 registers: the estimate has a relative standard error of 1.6 %.
SKETCH_BITS = 12


def cube_sets(by: list[str]) -> list[list[str]]:
    return [list(s) for n in range(len(by), -1, -1) for s in combinations(by, n)]


def rollup_sets(by: list[str]) -> list[list[str]]:
    return [by[:n] for n in range(len(by), -1, -1)]


def field_totals(table_data: DataFrame, by: list[str], measure: str, distinct: str, sets: list[list[str]] | None = None,
                 sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Per grouping set (default: the cube of ``by``) and group: the fields of ``by``, ``level`` (bit i from the right is set where
    the i-th field from the end is totalled over, which tells a total from a missing field), n rows, total, lowest and highest
    of the number in ``measure``, n_distinct values of the field ``distinct`` and their sketch. Rows without a readable number count in n."""
    unknown = {f for s in sets or [] for f in s} - set(by)
    if unknown:
        raise ValueError(f"not among the grouping fields: {sorted(unknown)}")
    keys = [f"_k{i}" for i in range(len(by))]
    name_of = dict(zip(by, keys, strict=True))
    value = F.col("_value")
    finest = table_data.select(*[field(f).alias(k) for f, k in name_of.items()], field(distinct).alias("_counted"), number(measure).alias("_value"))
    finest = finest.groupBy(*keys, "_counted").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_total"), F.min(value).alias("_lowest"), F.max(value).alias("_highest"))
    wanted = [[F.col(name_of[f]) for f in s] for s in (cube_sets(by) if sets is None else sets)]
    return finest.groupingSets(wanted, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("level"), F.sum("_n").alias("n"), F.sum("_total").alias("total"), F.min("_lowest").alias("lowest"),
        F.max("_highest").alias("highest"), F.count_distinct("_counted").alias("n_distinct"),
        F.hll_sketch_agg("_counted", F.lit(sketch_bits)).alias("sketch"),
    ).withColumnsRenamed({k: f for f, k in name_of.items()})


def estimate(sketch: str | Column = "sketch") -> Column:
    """The number of distinct values a sketch stands for."""
    return F.hll_sketch_estimate(sketch)


def merge_totals(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of several writes or sources, of any grouping, put together per ``keys``; distinct values as an estimate,
    since exact counts can't be added."""
    merged = totals.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("distinct_estimate", estimate())
