"""Cleaning of grids. A grid is one row, so each step is a projection; only the re-indexing of
tables of any size (long form) shuffles, and it does so in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import captured
from ..functions.types import normalize_cell

# Header parts which a flattened name leaves out.
SKIPPED_HEADER_PARTS = ["", "Unnamed: 0", "Unnamed"]

BLOCK_ROWS = 65_536


def _map_cells(body: Column, f) -> Column:
    return F.transform(body, lambda row: F.transform(row, f))


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def normalize_missing(grids: DataFrame) -> DataFrame:
    """Missing markers to NULL, thousands separators out of numbers."""
    return grids.withColumn("body", _map_cells(F.col("body"), normalize_cell))


def drop_empty_rows(grids: DataFrame) -> DataFrame:
    return grids.withColumn(
        "body", F.filter("body", lambda row: F.exists(row, lambda c: c.isNotNull()))
    )


def drop_empty_columns(grids: DataFrame) -> DataFrame:
    """Columns with every cell missing go, from the header too."""
    kept = F.filter(
        _positions(F.size(F.get("header", F.lit(0)))),
        lambda i: F.exists("body", lambda row: F.get(row, i).isNotNull()),
    )
    staged = grids.withColumn("_kept", kept)

    def pick(row: Column) -> Column:
        return F.transform("_kept", lambda i: F.get(row, i))

    return (
        staged.withColumn("header", captured("_kept", F.transform("header", pick)))
        .withColumn("body", captured("_kept", F.transform("body", pick)))
        .drop("_kept")
    )


def name_blank_headers(grids: DataFrame) -> DataFrame:
    """A header cell which is missing, blank or ``Unnamed:`` becomes ``Column_<position>``."""
    return grids.withColumn(
        "header",
        F.transform(
            "header",
            lambda level: F.transform(
                level,
                lambda name, i: F.when(
                    name.isNull() | (name == "") | F.startswith(name, F.lit("Unnamed:")),
                    F.concat(F.lit("Column_"), (i + 1).cast("string")),
                ).otherwise(name),
            ),
        ),
    )


def fill_missing(grids: DataFrame) -> DataFrame:
    return grids.withColumn(
        "body", _map_cells(F.col("body"), lambda c: F.coalesce(c, F.lit("")))
    )


def clean_sheet(grids: DataFrame) -> DataFrame:
    """All steps for a sheet; body positions are the new row index."""
    return fill_missing(name_blank_headers(drop_empty_columns(drop_empty_rows(grids))))


def unique_names(names: Column) -> Column:
    """``A, A, A`` to ``A, A.1, A.2``; a suffix that is already a header name is passed over."""

    def suffixed(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == name))
        free = F.filter(
            F.sequence(F.lit(1), F.size(names)),
            lambda k: ~F.array_contains(names, F.concat(name, F.lit("."), k.cast("string"))),
        )
        return F.when(earlier == 0, name).otherwise(
            F.concat(name, F.lit("."), F.get(free, earlier - 1).cast("string"))
        )

    return F.transform(names, suffixed)


def name_columns(grids: DataFrame) -> DataFrame:
    """Add ``columns`` and ``has_multi_index``: positional names without a header, unique names
    for one header row, levels joined by ``_`` for several."""
    width = F.size(F.coalesce(F.get("header", F.lit(0)), F.get("body", F.lit(0))))
    depth = F.size("header")
    levels = F.transform(
        "header",
        lambda level, k: F.transform(
            level,
            lambda name, i: F.when(
                name == "",
                F.concat(
                    F.lit("Unnamed: "), i.cast("string"),
                    F.when(depth > 1, F.concat(F.lit("_level_"), k.cast("string"))).otherwise(""),
                ),
            ).otherwise(name),
        ),
    )
    staged = grids.withColumn("_levels", levels)

    def joined(i: Column) -> Column:
        parts = F.filter(
            F.transform("_levels", lambda level: F.get(level, i)),
            lambda p: p.isNotNull() & ~p.isin(SKIPPED_HEADER_PARTS),
        )
        return F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise(
            F.concat(F.lit("col_"), i.cast("string"))
        )

    columns = (
        F.when(depth == 0, F.transform(_positions(width), lambda i: i.cast("string")))
        .when(depth == 1, unique_names(F.get("_levels", F.lit(0))))
        .otherwise(F.transform(_positions(width), joined))
    )
    duplicated = F.size(F.array_distinct("columns")) < F.size("columns")
    return (
        staged.withColumn("columns", columns)
        .withColumn("has_multi_index", F.coalesce(depth > 1, F.lit(False)))
        .drop("_levels")
        # joined names may meet; a table with two columns of one name has no schema
        .withColumn(
            "error",
            F.when(
                F.col("ok") & duplicated, "Schema extraction failed: duplicate column name"
            ).otherwise(F.col("error")),
        )
        .withColumn("ok", F.col("ok") & ~duplicated)
    )


def split_islands(grids: DataFrame) -> DataFrame:
    """Several tables of one sheet: blocks of rows between all-missing rows, each with its
    first row as header, numbered ``<stem>_table_<n>`` (the id stem is that of the file)."""
    lines = F.concat(
        F.transform("header", lambda level: F.transform(level, lambda c: F.nullif(c, F.lit("")))),
        F.col("body"),
    )
    staged = grids.withColumn("_lines", lines)
    blank = F.filter(
        _positions(F.size("_lines")),
        lambda i: ~F.exists(F.get("_lines", i), lambda c: c.isNotNull()),
    )
    staged = staged.withColumn(
        "_cuts", F.concat(F.array(F.lit(-1)), blank, F.array(F.size("_lines")))
    )
    islands = F.filter(
        F.transform(
            _positions(F.size("_cuts") - 1),
            lambda k: F.slice(
                "_lines",
                F.get("_cuts", k) + 2,
                F.get("_cuts", k + 1) - F.get("_cuts", k) - 1,
            ),
        ),
        lambda block: F.size(block) > 1,
    )
    exploded = staged.select(
        "doc_id", "source_file", "stem", "ok", "error",
        F.size(islands).alias("tables_found"),
        F.posexplode(islands).alias("island", "block"),
    )
    return exploded.select(
        "doc_id",
        "source_file",
        (F.col("island") + 1).alias("ordinal"),
        "tables_found",
        F.concat("stem", F.lit("_table_"), (F.col("island") + 1).cast("string")).alias("table_id"),
        F.lit(None).cast("string").alias("html"),
        F.transform(
            F.slice("block", 1, 1),
            lambda level: F.transform(level, lambda c: F.coalesce(c, F.lit(""))),
        ).alias("header"),
        F.slice("block", F.lit(2), F.size("block") - 1).alias("body"),
        "ok",
        "error",
    )


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their index, and per block the rows before it in its table."""
    blocked = rows.withColumn("_block", F.floor(F.col("row_index") / F.lit(block_rows)))
    before = W.partitionBy("table_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("table_id", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    return blocked, offsets


def _ranked(blocked: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add ``_rank``: the place of a row in its table, from 0."""
    within = W.partitionBy("table_id", "_block").orderBy("row_index")
    return (
        blocked.join(offsets.drop("_n"), ["table_id", "_block"])
        .withColumn("_rank", F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_block", "_offset")
    )


def reindex_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Re-index long-form rows (table_id, row_index, ...) to 0..n-1 within each table.

    A table may be any share of the data, so it is never put into one task: rows are numbered
    within blocks of the old index, and only one count per block is summed along a table."""
    ranked = _ranked(*_blocks(rows, block_rows))
    return ranked.withColumn("row_index", F.col("_rank")).drop("_rank")


def rows_between(rows: DataFrame, offset: int, limit: int | None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows offset .. offset+limit-1 of each table in index order, whatever gaps the index has.

    Block counts tell which blocks hold them; only the rows of these blocks are ranked."""
    blocked, offsets = _blocks(rows, block_rows)
    hit = F.col("_offset") + F.col("_n") > offset
    wanted = F.col("_rank") >= offset
    if limit is not None:
        hit = hit & (F.col("_offset") < offset + limit)
        wanted = wanted & (F.col("_rank") < offset + limit)
    return _ranked(blocked, offsets.filter(hit)).filter(wanted).drop("_rank")
