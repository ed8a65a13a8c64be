"""The grid record: one row per extracted table, header and body as nested arrays.

A table always comes out of one document cell, so its grid is bounded by that cell; keeping
it in one row makes cleaning, profiling and JSON encoding of a corpus free of shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explodable

GRID_SCHEMA = (
    "doc_id string, source_file string, ordinal int, tables_found int, table_id string, "
    "html string, header array<array<string>>, body array<array<string>>, "
    "ok boolean, error string"
)


def tables(extracted: DataFrame) -> DataFrame:
    """The table rows of an extraction (a document without tables leaves a row of ordinal 0)."""
    return extracted.filter(F.col("ordinal") > 0)


def outcomes(extracted: DataFrame) -> DataFrame:
    """One record per document: how many tables, and whether and why it failed."""
    first = extracted.filter(F.col("ordinal") <= 1)
    failed = (F.col("ordinal") == 0) & ~F.col("ok")
    return first.select(
        "doc_id",
        "source_file",
        F.col("tables_found"),
        (~failed).alias("ok"),
        F.when(failed, F.col("error")).alias("error"),
    )


def cap_tables(extracted: DataFrame, max_tables_per_document: int) -> DataFrame:
    """Keep the first n tables of every document, when the caller asks for a cap."""
    return extracted.filter(F.col("ordinal") <= max_tables_per_document)


def grid_from_columns(
    df: DataFrame,
    table_id: Column,
    ordinal: Column,
    header: Column,
    body: Column,
    source_file: Column | None = None,
    html: Column | None = None,
) -> DataFrame:
    """Grids from rows that already hold their cells as nested arrays."""
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (source_file if source_file is not None else F.lit(None).cast("string")).alias("source_file"),
        ordinal.cast("int").alias("ordinal"),
        F.lit(1).alias("tables_found"),
        table_id.alias("table_id"),
        (html if html is not None else F.lit(None).cast("string")).alias("html"),
        header.alias("header"),
        body.alias("body"),
        F.lit(True).alias("ok"),
        F.lit(None).cast("string").alias("error"),
    )


def from_cell_lists(df: DataFrame, rows: str, columns: str | None = None) -> DataFrame:
    """Grids from an array-of-rows column, with names from a second column if there is one;
    otherwise the columns are named by position. Missing cells become ''."""
    body = F.transform(
        F.col(rows), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))
    )
    if columns:
        header = F.array(F.col(columns))
    else:
        width = F.coalesce(F.array_max(F.transform(F.col(rows), F.size)), F.lit(0))
        header = F.array(
            F.transform(_positions(width), lambda i: i.cast("string"))
        )
    return grid_from_columns(
        df, F.col("table_id"), F.coalesce(F.col("ordinal"), F.lit(1)), header, body
    )


def from_column_map(df: DataFrame, columns: str) -> DataFrame:
    """Grids from a map of column name to its cells; short columns are padded with ''."""
    names = F.map_keys(F.col(columns))
    values = F.map_values(F.col(columns))
    height = F.coalesce(F.array_max(F.transform(values, F.size)), F.lit(0))
    body = F.transform(
        _positions(height),
        lambda r: F.transform(values, lambda v: F.coalesce(F.get(v, r), F.lit(""))),
    )
    return grid_from_columns(
        df, F.col("table_id"), F.coalesce(F.col("ordinal"), F.lit(1)), F.array(names), body
    )


def _positions(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def explode_rows(grids: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per body row with its index and cells."""
    return grids.select(
        "doc_id", "table_id", *keep, F.posexplode(explodable("body")).alias("row_index", "cells")
    )


def explode_cells(grids: DataFrame, names: str = "columns") -> DataFrame:
    """Long form: one row per cell with its row index, position and column name."""
    return explode_rows(grids, names).select(
        "doc_id",
        "table_id",
        "row_index",
        F.posexplode("cells").alias("position", "value"),
        names,
    ).withColumn("name", F.get(names, F.col("position"))).drop(names)
