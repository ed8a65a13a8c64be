"""Queries over JSON rows: all orders as rows of three stored tables, events, customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonpath import field, lenient_integer, lenient_real, number
from ..operators import jsonrows as j
from . import fixtures as fx
from .registry import query

_W = "WITH " + fx.ORDER_SQL


@query("j1_tables_by_source", _W + "SELECT table_id, source_file FROM tables_ WHERE lower(source_file) LIKE '%/o.%'")
def by_source(spark, sf):
    return j.tables_by_source_term(fx.order_tables(spark, sf), "/o.").select("table_id", "source_file")


@query("j2_count_tables", _W + "SELECT count(*) AS n FROM tables_")
def count_tables(spark, sf):
    return j.count_tables(fx.order_tables(spark, sf))


@query("j2_count_rows", _W + "SELECT count(*) AS n FROM rows_ WHERE table_id = 'orders_O'")
def count_rows(spark, sf):
    return j.count_rows(fx.order_rows(spark, sf), "orders_O")


@query("j3_tables_with_more_rows", "WITH " + fx.CUSTOMER_SQL + "SELECT table_id, n_rows AS rows FROM shape WHERE n_rows > 5")
def more_rows(spark, sf):
    return j.tables_with_more_rows(fx.catalog_tables(spark, sf), 5).select("table_id", "rows")


@query("j4_text_equality", _W + "SELECT table_id, row_index FROM rows_ WHERE o_orderpriority = '1-URGENT'")
def text_equality(spark, sf):
    return j.rows_where_text(fx.order_rows(spark, sf), "Priority", "1-URGENT").select("table_id", "row_index")


@query("j5_filtered_average", _W + "SELECT round(avg(o_totalprice), 4) AS average FROM rows_ WHERE o_orderpriority = '5-LOW'")
def filtered_average(spark, sf):
    done = j.average_where(fx.order_rows(spark, sf), "Total Price", "Priority", "5-LOW")
    return done.select(F.round("average", 4).alias("average"))


@query("j6_number_range", _W + "SELECT table_id, row_index FROM rows_ WHERE o_totalprice > 100000 AND o_totalprice <= 200000.5")
def number_range(spark, sf):
    return j.rows_where_number(fx.order_rows(spark, sf), "Total Price", 100000, 200000.5).select("table_id", "row_index")


@query("j7_number_equality", _W + "SELECT table_id, row_index FROM rows_ WHERE o_custkey = 77")
def number_equality(spark, sf):
    return j.rows_where_equal(fx.order_rows(spark, sf), "Customer", 77).select("table_id", "row_index")


@query("j8_projection", _W + """
SELECT table_id, row_index, CAST(o_custkey AS VARCHAR) AS Customer, o_orderpriority AS Priority, year AS Year FROM rows_""")
def projection(spark, sf):
    return j.project_fields(fx.order_rows(spark, sf), ["Customer", "Priority", "Year"])


@query("j9_join_metadata", _W + """
SELECT source_file, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM rows_ JOIN tables_ USING (table_id) GROUP BY ALL""")
def join_metadata(spark, sf):
    """Totals per source: rows are summed per table first, then meet the metadata."""
    per_table = fx.order_rows(spark, sf).groupBy("table_id", field("Priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(number("Total Price")).alias("total")
    )
    joined = j.join_metadata(per_table, fx.order_tables(spark, sf), ["source_file"])
    return joined.groupBy("source_file", "priority").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total")
    )


@query("j9_rows_with_metadata", _W + "SELECT table_id, row_index, source_file FROM rows_ JOIN tables_ USING (table_id) WHERE o_totalprice > 400000")
def rows_with_metadata(spark, sf):
    """Every matching row with the source of its table."""
    rows = j.rows_where_number(fx.order_rows(spark, sf), "Total Price", low=400000)
    joined = j.join_metadata(rows, fx.order_tables(spark, sf), ["source_file"])
    return joined.select("table_id", "row_index", "source_file")


@query("j9_join_stored_tables", _W + """
SELECT c_mktsegment AS segment, count(*) AS n FROM rows_ JOIN customer ON o_custkey = c_custkey
WHERE (c_custkey // 20) % 4 <> 3 GROUP BY 1""")
def join_stored(spark, sf):
    """Order rows with the rows of the customer tables they point to; orders are counted per
    customer before they meet, so a customer with most of the orders is one row."""
    orders = fx.order_rows(spark, sf).groupBy(number("Customer", type_="bigint").alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    customers = fx.catalog_rows(spark, sf).select(
        number("c_custkey", type_="bigint").alias("k"), field("c_mktsegment").alias("segment")
    ).filter(~F.col("segment").isin("yes", "no"))
    return orders.join(customers, "k").groupBy("segment").agg(F.sum("n").alias("n"))


@query("j10_grouped_aggregates", _W + """
SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average,
  min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM rows_ GROUP BY 1""")
def grouped(spark, sf):
    done = j.aggregate_by_field(fx.order_rows(spark, sf), "Priority", "Total Price")
    return done.select(
        F.col("Priority").alias("priority"), "n", F.round("total", 2).alias("total"),
        F.round("average", 4).alias("average"), "lowest", "highest",
    )


@query("j10_event_props", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def event_props(spark, sf):
    k = number("k", "props", "bigint")
    done = fx.read(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("total")
    )
    return done


@query("j11_row_counts", _W + "SELECT table_id, count(*) AS n FROM rows_ GROUP BY 1")
def row_counts(spark, sf):
    return j.row_counts(fx.order_rows(spark, sf))


@query("j12_largest_table", _W + "SELECT table_id, rows FROM tables_ ORDER BY rows DESC, table_id LIMIT 1")
def largest(spark, sf):
    return j.largest_table(fx.order_tables(spark, sf))


@query("j13_tables_with_label", "WITH " + fx.CUSTOMER_SQL + "SELECT DISTINCT table_id FROM cols WHERE label = 'boolean'")
def with_label(spark, sf):
    return j.tables_with_label(fx.catalog_tables(spark, sf), ["boolean"]).select("table_id")


@query("j14_table_columns", "WITH " + fx.CUSTOMER_SQL + "SELECT table_id, position, name AS column_name FROM cols")
def columns(spark, sf):
    return j.table_columns(fx.catalog_tables(spark, sf))


@query("j15_tables_mentioning", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id FROM shape JOIN listed USING (table_id)
WHERE lower(description) LIKE '%mktsegment%' OR lower(column_names) LIKE '%mktsegment%'""")
def mentioning(spark, sf):
    return j.tables_mentioning(fx.catalog_tables(spark, sf), "MktSegment").select("table_id")


@query("j16_rows_of_described", _W + """
SELECT table_id, row_index FROM rows_ WHERE table_id IN (SELECT table_id FROM tables_ WHERE lower(description) LIKE '%status f %')""")
def described(spark, sf):
    done = j.rows_of_described(fx.order_rows(spark, sf), fx.order_tables(spark, sf), "status F ")
    return done.select("table_id", "row_index")


@query("j17_distinct_values", _W + "SELECT DISTINCT year AS value FROM rows_")
def distinct(spark, sf):
    return j.distinct_values(fx.order_rows(spark, sf), "Year")


@query("j18_heterogeneous_filter", """
SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_totalprice > 250000
UNION ALL SELECT 'parts', count(*) FROM part WHERE p_retailprice > 250000""")
def heterogeneous(spark, sf):
    """Orders, parts and events in one row store; only those with a price can match."""
    parts = fx.read(spark, sf, "part").select(
        F.lit("parts").alias("kind"), F.to_json(F.struct(F.col("p_retailprice").alias("Total Price"))).alias("row_data")
    )
    events = fx.read(spark, sf, "events").select(F.lit("events").alias("kind"), F.col("props").alias("row_data"))
    orders = fx.order_rows(spark, sf).select(F.lit("orders").alias("kind"), "row_data")
    hits = j.rows_above(orders.unionByName(parts).unionByName(events), "Total Price", 250000)
    kinds = orders.select("kind").unionByName(parts.select("kind")).distinct()
    counts = hits.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("_n", F.lit(0)).alias("n"))


@query("j19_lenient_cast", """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN o_orderpriority
    WHEN 2 THEN 'abc' WHEN 3 THEN NULL WHEN 4 THEN '  -' || o_custkey || 'x' ELSE CAST(o_totalprice AS VARCHAR) END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif(regexp_extract(ltrim(v), '^[+-]?[0-9]+'), '') AS BIGINT), 0) END AS as_integer,
  CASE WHEN v IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif(regexp_extract(ltrim(v), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'), '') AS DOUBLE), 0) END AS as_real
FROM v""")
def lenient(spark, sf):
    k = F.col("o_orderkey")
    v = (
        F.when(k % 6 == 0, F.format_number("o_totalprice", 2)).when(k % 6 == 1, F.col("o_orderpriority"))
        .when(k % 6 == 2, "abc").when(k % 6 == 3, F.lit(None))
        .when(k % 6 == 4, F.concat(F.lit("  -"), fx.text("o_custkey"), F.lit("x"))).otherwise(fx.text("o_totalprice"))
    )
    return fx.read(spark, sf, "orders").select(
        "o_orderkey", lenient_integer(v).alias("as_integer"), lenient_real(v).alias("as_real")
    )
