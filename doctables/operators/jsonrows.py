"""Queries over stored JSON rows: ``f(tables, table_data, ...) -> DataFrame``.

Joins are plain equi joins: Catalyst broadcasts the metadata when its measured size allows and
adaptive execution splits the partitions of a table that dominates; grouped results are
combined map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import field, number

NUMERIC_LABELS = ["integer", "float"]


def contains(c: Column | str, term: str) -> Column:
    """Case-insensitive substring test; the term is taken literally."""
    c = F.col(c) if isinstance(c, str) else c
    return F.contains(F.lower(c), F.lit(term.lower()))


def tables_by_source_term(tables: DataFrame, term: str) -> DataFrame:
    return tables.filter(contains("source_file", term))


def count_tables(tables: DataFrame) -> DataFrame:
    return tables.agg(F.count(F.lit(1)).alias("n"))


def count_rows(table_data: DataFrame, table_id: str) -> DataFrame:
    return table_data.filter(F.col("table_id") == table_id).agg(F.count(F.lit(1)).alias("n"))


def tables_with_more_rows(tables: DataFrame, n: int) -> DataFrame:
    return tables.filter(F.col("rows") > n)


def rows_where_text(table_data: DataFrame, name: str, value: str) -> DataFrame:
    return table_data.filter(field(name) == value)


def average_where(table_data: DataFrame, name: str, where: str, value: str) -> DataFrame:
    return table_data.filter(field(where) == value).agg(F.avg(number(name)).alias("average"))


def rows_where_number(table_data: DataFrame, name: str, low: float | None = None,
                      high: float | None = None, type_: str = "double") -> DataFrame:
    """Rows whose field reads as a number in (low, high]."""
    value = number(name, type_=type_)
    if low is not None:
        table_data = table_data.filter(value > low)
    if high is not None:
        table_data = table_data.filter(value <= high)
    return table_data


def rows_where_equal(table_data: DataFrame, name: str, value: int) -> DataFrame:
    return table_data.filter(number(name, type_="bigint") == value)


def project_fields(table_data: DataFrame, names: list[str]) -> DataFrame:
    """Several fields; each row is parsed once."""
    parsed = table_data.withColumn("_row", F.from_json("row_data", "map<string,string>"))
    return parsed.select(
        "table_id", "row_index", *[F.col("_row").getItem(n).alias(n) for n in names]
    )


def join_metadata(table_data: DataFrame, tables: DataFrame, columns: list[str]) -> DataFrame:
    return table_data.join(tables.select("table_id", *columns), "table_id")


def aggregate_by_field(table_data: DataFrame, by: str, measure: str) -> DataFrame:
    value = number(measure)
    return table_data.groupBy(field(by).alias(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("average"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def row_counts(table_data: DataFrame) -> DataFrame:
    return (
        table_data.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "table_id")
    )


def largest_table(tables: DataFrame) -> DataFrame:
    """The table with most rows; the smaller id on a tie."""
    return tables.orderBy(F.desc("rows"), "table_id").limit(1).select("table_id", "rows")


def tables_with_label(tables: DataFrame, labels: list[str] = NUMERIC_LABELS) -> DataFrame:
    return tables.filter(F.exists(F.map_values("column_types"), lambda t: t.isin(labels)))


def table_columns(tables: DataFrame) -> DataFrame:
    return tables.select("table_id", F.posexplode("column_names").alias("position", "column_name"))


def tables_mentioning(tables: DataFrame, word: str) -> DataFrame:
    return tables.filter(
        F.exists("column_names", lambda c: contains(c, word)) | contains("description", word)
    )


def rows_of_described(table_data: DataFrame, tables: DataFrame, word: str) -> DataFrame:
    wanted = tables.filter(contains("description", word)).select("table_id")
    return table_data.join(wanted, "table_id", "left_semi")


def distinct_values(table_data: DataFrame, name: str) -> DataFrame:
    return table_data.select(field(name).alias("value")).filter(F.col("value").isNotNull()).distinct()


def rows_above(table_data: DataFrame, name: str, low: float) -> DataFrame:
    """Rows over any tables that have the field and exceed a value in it."""
    return table_data.filter(field(name).isNotNull() & (number(name) > low))
