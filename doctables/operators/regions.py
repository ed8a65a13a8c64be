"""Tables of a sheet wherever they stand: beside each other, below each other, in any number.

A table is a rectangle of cells. Two rectangles with filled cells are one where they overlap or touch, corners included; so
between any two tables there is a blank row or a blank column, and missing cells inside a table don't split it. The
rectangles that follow from the runs of filled cells of all rows are the same in whatever order they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explodable

BOXES = "array<struct<top:int,left:int,bottom:int,right:int>>"


def filled_runs(row: Column, i: Column) -> Column:
    """The maximal runs of filled cells of one row, as rectangles of one line."""
    at = F.when(F.size(row) > 0, F.sequence(F.lit(0), F.size(row) - 1)).otherwise(F.array().cast("array<int>"))
    filled = lambda j: F.get(row, j).isNotNull()  # noqa: E731  out of the row: null
    starts = F.filter(at, lambda j: filled(j) & ~filled(j - 1))
    ends = F.filter(at, lambda j: filled(j) & ~filled(j + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(i.alias("top"), a.alias("left"), i.alias("bottom"), b.alias("right")))


def _touch(a: Column, b: Column) -> Column:
    return ((a["top"] <= b["bottom"] + 1) & (b["top"] <= a["bottom"] + 1) & (a["left"] <= b["right"] + 1) & (b["left"] <= a["right"] + 1))


def _around(boxes: Column, box: Column) -> Column:
    def edge(name: str, least: bool) -> Column:
        of = F.concat(F.array(box[name]), F.transform(boxes, lambda b: b[name]))
        return (F.array_min(of) if least else F.array_max(of)).alias(name)

    return F.struct(edge("top", True), edge("left", True), edge("bottom", False), edge("right", False))


def _joined(boxes: Column) -> Column:
    """Boxes put together one by one: each with all earlier ones it touches."""
    return F.aggregate(
        boxes, F.array().cast(BOXES),
        lambda held, box: F.concat(F.filter(held, lambda b: ~_touch(b, box)), F.array(_around(F.filter(held, lambda b: _touch(b, box)), box))))


def regions(boxes: Column) -> Column:
    """The rectangles of ``boxes`` after all that touch are one. Grown ones can touch again, so the pass is repeated
    until it finds nothing (a pass that does makes them fewer)."""
    state = F.struct(_joined(boxes).alias("boxes"), F.lit(True).alias("open"))

    def step(s: Column, _: Column) -> Column:
        again = F.aggregate(
            F.array(_joined(s["boxes"])), s, lambda old, new: F.struct(new.alias("boxes"), (F.size(new) < F.size(old["boxes"])).alias("open")))
        return F.when(s["open"], again).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.size(boxes)), state, step, lambda s: s["boxes"])


def split_regions(grids: DataFrame) -> DataFrame:
    """The tables of every sheet, by their first line, then by their first column: each with its first line as header and
    numbered ``<stem>_table_<n>`` (the id stem is that of the file). A rectangle of one line is no table."""
    lines = F.concat(
        F.transform("header", lambda level: F.transform(level, lambda c: F.nullif(c, F.lit("")))), F.coalesce("body", F.array().cast("array<array<string>>")))
    staged = grids.withColumn("_lines", lines)
    staged = staged.withColumn("_runs", F.flatten(F.transform("_lines", filled_runs)))
    tables = F.array_sort(F.filter(regions(F.col("_runs")), lambda b: b["bottom"] > b["top"]))
    staged = staged.withColumn("_tables", tables)
    placed = staged.select(
        "doc_id", "source_file", "stem", "ok", "error", "_lines", F.size("_tables").alias("tables_found"), F.posexplode(explodable("_tables")).alias("_at", "_box"))
    block = F.transform(
        F.sequence(F.col("_box.top"), F.col("_box.bottom")),
        lambda i: F.transform(F.sequence(F.col("_box.left"), F.col("_box.right")), lambda j: F.get(F.get("_lines", i), j)))
    placed = placed.withColumn("_block", block)
    return placed.select(
        "doc_id", "source_file", (F.col("_at") + 1).alias("ordinal"), "tables_found",
        F.concat("stem", F.lit("_table_"), (F.col("_at") + 1).cast("string")).alias("table_id"), F.lit(None).cast("string").alias("html"),
        F.transform(F.slice("_block", 1, 1), lambda level: F.transform(level, lambda c: F.coalesce(c, F.lit("")))).alias("header"),
        F.slice("_block", F.lit(2), F.size("_block") - 1).alias("body"), "ok", "error")
