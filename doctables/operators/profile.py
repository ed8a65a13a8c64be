"""Schema inference: storage types, labels, shapes, schema records and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import (
    cell_kind,
    count_kinds,
    json_literal,
    label_from_counts,
    storage_from_counts,
)
from ..functions.text import json_string

ALL_KINDS = "medzinuftbDs"
SAMPLE_ROWS = 5


def profile_grids(
    grids: DataFrame, missing_counts_as_float: bool = True, dates: bool = False
) -> DataFrame:
    """Add ``n_rows, n_cols, storage, labels`` to named grids, without any shuffle."""
    kinds = F.transform(
        F.sequence(F.lit(0), F.size("columns") - 1),
        lambda i: F.array_join(
            F.transform("body", lambda row: cell_kind(F.get(row, i), dates)), ""
        ),
    )
    staged = grids.withColumn(
        "_kinds", F.when(F.size("columns") > 0, kinds).otherwise(F.array().cast("array<string>"))
    )
    return (
        staged.withColumn("n_rows", F.size("body").cast("bigint"))
        .withColumn("n_cols", F.size("columns").cast("bigint"))
        .withColumn(
            "storage",
            F.transform("_kinds", lambda k: storage_from_counts(count_kinds(k), F.length(k))),
        )
        .withColumn(
            "labels",
            F.transform(
                "_kinds",
                lambda k: label_from_counts(
                    count_kinds(k), F.length(k), missing_counts_as_float, dates
                ),
            ),
        )
        .drop("_kinds")
    )


def profile_cells(
    cells: DataFrame,
    keys: list[str],
    value: str = "value",
    missing_counts_as_float: bool = True,
    dates: bool = False,
) -> DataFrame:
    """Storage type and label per group of long-form cells: one aggregation for all tables,
    combined map-side, so a table that holds most of the data does not gather anywhere."""
    kind = cell_kind(F.col(value), dates)
    counted = (
        cells.select(*keys, kind.alias("_kind"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            *[F.count_if(F.col("_kind") == k).alias(f"_{i}") for i, k in enumerate(ALL_KINDS)],
        )
    )

    def count(letters: str) -> Column:
        total = F.lit(0)
        for i, k in enumerate(ALL_KINDS):
            if k in letters:
                total = total + F.col(f"_{i}")
        return total

    return counted.select(
        *keys,
        "n_cells",
        storage_from_counts(count, F.col("n_cells")).alias("storage"),
        label_from_counts(count, F.col("n_cells"), missing_counts_as_float, dates).alias("label"),
    )


def unpivot_cells(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """A flat DataFrame as long-form cells (table_id, position, name, value as text)."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                     F.col(c).cast("string").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(key.alias("table_id"), F.explode(cells).alias("cell")).select(
        "table_id", "cell.*"
    )


def table_shapes(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows and columns per table of long-form rows."""
    return rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(cells)).cast("bigint").alias("n_cols"),
    )


def json_keys() -> Column:
    return F.transform("columns", json_string)


def row_objects(body: Column, keys: Column) -> Column:
    """Body rows as JSON objects keyed by column name; numbers stay numbers."""

    def one(row: Column) -> Column:
        values = F.transform(row, lambda c, i: json_literal(c, F.get("storage", i)))
        pairs = F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit(": "), v))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    return F.transform(body, one)


def schema_records(profiled: DataFrame, sample_rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """One schema record per table, good or failed, with its first ``sample_rows`` rows (None: all)."""
    good = F.col("ok")
    return profiled.select(
        "doc_id",
        "source_file",
        "ordinal",
        "table_id",
        "html",
        "n_rows",
        "n_cols",
        "has_multi_index",
        F.col("has_multi_index").alias("flattened"),
        "columns",
        "labels",
        "storage",
        F.when(good, F.map_from_arrays("columns", "labels")).alias("dtypes"),
        F.when(good, F.map_from_arrays("columns", "storage")).alias("storage_types"),
        F.when(good, row_objects(F.col("body") if sample_rows is None else F.slice("body", 1, sample_rows), json_keys())).alias("sample"),
        "ok",
        "error",
    )


def schema_counts(records: DataFrame) -> DataFrame:
    """Schemas per document: all and successful."""
    return records.groupBy("doc_id", "source_file").agg(
        F.count(F.lit(1)).alias("total_schemas"),
        F.count_if("ok").alias("successful_schemas"),
    )


def sample_rows(grids: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of every table; the index is already there, so nothing is sorted."""
    return grids.select(
        "doc_id", "table_id", F.posexplode(F.slice("body", 1, n)).alias("row_index", "cells")
    )


def schema_summary(records: DataFrame) -> DataFrame:
    """Human-readable summary of each schema record."""
    label = F.col("ordinal").cast("string")
    lines = F.transform(
        F.arrays_zip("columns", "labels"),
        lambda s: F.concat(F.lit("    - "), s["columns"], F.lit(" ("), s["labels"], F.lit(")\n")),
    )
    text = F.concat(
        F.lit("Table "), label, F.lit(":\n  Shape: "), F.col("n_rows").cast("string"),
        F.lit(" rows × "), F.col("n_cols").cast("string"), F.lit(" columns\n"),
        F.when(F.col("has_multi_index"), "  Multi-index columns detected and flattened\n").otherwise(""),
        F.lit("  Columns:\n"), F.array_join(lines, ""),
    )
    failed = F.concat(
        F.lit("Table "), label, F.lit(": Schema extraction failed - "),
        F.coalesce("error", F.lit("Unknown error")),
    )
    return records.select(
        "doc_id", "table_id", "ordinal", F.when(F.col("ok"), text).otherwise(failed).alias("summary")
    )
