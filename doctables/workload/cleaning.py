"""Cleaning operators, checked cell by cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..sources.grids import explode_cells, explode_rows
from . import fixtures as fx
from .registry import query


def _cells(grids):
    named = grids.withColumn("columns", F.get("header", F.lit(0)))
    return explode_cells(named).select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        F.col("position").cast("bigint").alias("position"), "name", "value",
    )


def _sql(row="row_index", position="position", name="name", value="value", rows=False, cols=False):
    joins = ""
    if rows:
        joins += " JOIN kept_rows USING (table_id, row_index)"
        row = "new_index"
    if cols:
        joins += " JOIN kept_cols USING (table_id, position, name)"
        position = "new_position"
    return "WITH " + fx.SHEET_SQL + f"""
SELECT table_id, CAST({row} AS BIGINT) AS row_index, CAST({position} AS BIGINT) AS position,
  {name} AS name, {value} AS value FROM sheet_cells{joins}"""


@query("c1_drop_empty_rows", _sql(rows=True))
def drop_empty_rows(spark, sf):
    return _cells(clean.drop_empty_rows(fx.part_sheets(spark, sf)))


@query("c2_drop_empty_columns", _sql(cols=True))
def drop_empty_columns(spark, sf):
    return _cells(clean.drop_empty_columns(fx.part_sheets(spark, sf)))


@query("c3_reindex_rows", """
SELECT 'orders_' || o_orderstatus AS table_id,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row_index, o_orderkey
FROM orders""")
def reindex_rows(spark, sf):
    """Rows of large long-form tables (three hold all orders) numbered again from 0."""
    rows = fx.read(spark, sf, "orders").select(
        F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("table_id"),
        F.col("o_orderkey").alias("row_index"), "o_orderkey",
    )
    return clean.reindex_rows(rows, block_rows=4096).select("table_id", "row_index", "o_orderkey")


_BLANK_NAME = "CASE WHEN name = '' OR name LIKE 'Unnamed:%' THEN 'Column_' || ({p} + 1) ELSE name END"


@query("c4_name_blank_headers", _sql(name=_BLANK_NAME.format(p="position")))
def name_blank_headers(spark, sf):
    return _cells(clean.name_blank_headers(fx.part_sheets(spark, sf)))


@query("c5_fill_missing", _sql(value="coalesce(value, '')"))
def fill_missing(spark, sf):
    return _cells(clean.fill_missing(fx.part_sheets(spark, sf)))


@query("c1_c5_clean_sheet", _sql(rows=True, cols=True, name=_BLANK_NAME.format(p="new_position"), value="coalesce(value, '')"))
def clean_sheet(spark, sf):
    return _cells(clean.clean_sheet(fx.part_sheets(spark, sf)))


@query("c6_flatten_header", """
SELECT 'nation_' || n_nationkey AS table_id, CAST(position AS BIGINT) AS position, CASE position
    WHEN 0 THEN n_name WHEN 1 THEN n_name || '_b' WHEN 2 THEN 'Unnamed: 2_level_0_c' WHEN 3 THEN n_name || '_Unnamed: 3_level_1'
    WHEN 4 THEN 'col_4' WHEN 5 THEN 'x_y' END AS name
FROM nation, (VALUES (0), (1), (2), (3), (4), (5)) v(position)""")
def flatten_header(spark, sf):
    """Two header rows; blank cells, and parts that a flattened name leaves out."""
    n = fx.read(spark, sf, "nation").select(
        fx.text("n_nationkey").alias("doc_id"), F.col("n_name")
    )
    name = F.col("n_name")
    header = F.array(
        F.array(name, name, F.lit(""), name, F.lit("Unnamed"), F.lit("x")),
        F.array(F.lit("Unnamed: 0"), F.lit("b"), F.lit("c"), F.lit(""), F.lit("Unnamed: 0"), F.lit("y")),
    )
    grids = fx.grid_from_columns(
        n, F.concat(F.lit("nation_"), F.col("doc_id")), F.lit(1), header,
        F.array(F.array(*[F.lit("1")] * 6)),
    )
    return clean.name_columns(grids).select("table_id", F.posexplode("columns").alias("position", "name")).select(
        "table_id", F.col("position").cast("bigint").alias("position"), "name"
    )


@query("c7_missing_and_thousands", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, CAST(row_index AS BIGINT) AS row_index, CAST(position AS BIGINT) AS position, value FROM cells""")
def missing_and_thousands(spark, sf):
    rows = explode_rows(clean.normalize_missing(fx.customer_grids(spark, sf)))
    return rows.select("table_id", "row_index", F.posexplode("cells").alias("position", "value")).select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        F.col("position").cast("bigint").alias("position"), "value",
    )


@query("c8_unique_names", """
WITH names AS (
  SELECT p_partkey, unnest([p_name, p_type, p_name, p_name || '.1', p_name, p_type]) AS name,
    generate_subscripts([1, 2, 3, 4, 5, 6], 1) - 1 AS position FROM part),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY p_partkey, name ORDER BY position) - 1 AS earlier FROM names)
SELECT p_partkey, CAST(position AS BIGINT) AS position,
  CASE WHEN earlier = 0 THEN name
       WHEN position IN (2, 4) THEN name || '.' || (earlier + 1)
       ELSE name || '.' || earlier END AS name
FROM seen""")
def unique_names(spark, sf):
    """Each part has a header with repeated names, one of which already looks numbered."""
    header = F.array(
        "p_name", "p_type", "p_name", F.concat("p_name", F.lit(".1")), "p_name", "p_type"
    )
    p = fx.read(spark, sf, "part").select("p_partkey", header.alias("header"))
    return p.select("p_partkey", F.posexplode(clean.unique_names(F.col("header"))).alias("position", "name")).select(
        "p_partkey", F.col("position").cast("bigint").alias("position"), "name"
    )
