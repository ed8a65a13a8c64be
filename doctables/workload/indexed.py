"""Search by trigrams, summaries kept per write, totals over several groupings, unions of tables, dates of any form, counts that follow a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dates import date_columns, with_dates
from ..operators.profile import unpivot_cells
from ..operators.totals import estimate, field_totals, rollup_sets
from ..operators.trigrams import TrigramIndex
from ..operators.unions import union_tables
from ..plans.catalog import superseded_versions
from ..plans.summaries import StoredSummaries
from ..streaming.changes import current_counts, follow_counts
from . import fixtures as fx
from .catalog import shared_folder
from .registry import query
from .streams import _stream

_W = "WITH " + fx.CUSTOMER_SQL


def _catalog_index(spark, sf) -> TrigramIndex:
    index = TrigramIndex(spark, shared_folder(spark, "trigrams"), parts=8, buckets=8)
    index.add(fx.catalog_tables(spark, sf))
    return index


@query("g5_indexed_search", _W + """
SELECT table_id, source_file FROM shape WHERE table_id ILIKE '%SEGMENT_4%' OR source_file ILIKE '%SEGMENT_4%' OR description ILIKE '%SEGMENT_4%'""")
def indexed_search(spark, sf):
    """Two literal runs around a wildcard."""
    return _catalog_index(spark, sf).search("SEGMENT_4").select("table_id", "source_file")


@query("g5_indexed_fields", _W + "SELECT table_id FROM shape WHERE table_id ILIKE '%mer%_1%'")
def indexed_fields(spark, sf):
    return _catalog_index(spark, sf).search("MER%_1", ["table_id", "html_content"]).select("table_id")


@query("g5_indexed_texts", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%ent que%'")
def indexed_texts(spark, sf):
    """Whole document texts; the columns that are not searched come from a join with what was found."""
    documents = fx.read(spark, sf, "documents").select("doc_id", "lang", "text")
    index = TrigramIndex(spark, shared_folder(spark, "trigrams"), fields=("text",), parts=8, buckets=8)
    index.add(documents.select(fx.text("doc_id").alias("doc_id"), F.lit(1).alias("ordinal"), "text"))
    found = index.search("Ent Que").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return documents.select("doc_id", "lang").join(found, "doc_id", "left_semi")


_TOTALS = """
SELECT o_orderpriority AS "Priority", year AS "Year", CAST(GROUPING(o_orderpriority, year) AS BIGINT) AS level, count(*) AS n,
  round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
  count(DISTINCT o_custkey) AS n_distinct, TRUE AS close FROM rows_ GROUP BY """


def _totals(totals):
    near = F.abs(estimate() - F.col("n_distinct")) <= F.col("n_distinct") * 0.1
    return totals.withColumns({"total": F.round("total", 2), "close": near, "level": F.col("level").cast("bigint")}).drop("sketch")


@query("j10_field_cube", "WITH " + fx.ORDER_SQL + _TOTALS + "CUBE (o_orderpriority, year)")
def field_cube(spark, sf):
    return _totals(field_totals(fx.order_rows(spark, sf), ["Priority", "Year"], "Total Price", "Customer"))


@query("j10_field_rollup", "WITH " + fx.ORDER_SQL + _TOTALS + "ROLLUP (o_orderpriority, year)")
def field_rollup(spark, sf):
    by = ["Priority", "Year"]
    return _totals(field_totals(fx.order_rows(spark, sf), by, "Total Price", "Customer", rollup_sets(by)))


_UNITED = """
united AS (
  SELECT table_id AS _table_id, CAST(row_index AS BIGINT) AS _row_index,
    CAST(max(value) FILTER (WHERE name = 'c_custkey') AS BIGINT) AS c_custkey, max(value) FILTER (WHERE name = 'c_name') AS c_name,
    CAST(max(value) FILTER (WHERE name = 'c_nationkey') AS DOUBLE) AS c_nationkey,
    max(CASE WHEN storage = 'float64' THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE value END) FILTER (WHERE name = 'c_acctbal') AS c_acctbal,
    max(value) FILTER (WHERE name = 'c_mktsegment') AS c_mktsegment
  FROM cells JOIN cols USING (table_id, position, name) GROUP BY table_id, row_index)"""


def _united(tables, rows):
    return union_tables(tables, rows).withColumn("_row_index", F.col("_row_index").cast("bigint"))


@query("r3_union_tables", _W + "," + _UNITED + "SELECT * FROM united")
def union_of_tables(spark, sf):
    """All customer tables: whole numbers with and without gaps, amounts that are text in some tables."""
    return _united(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))


@query("r3_union_mixed", _W + "," + _UNITED + """,
orders_ AS (
  SELECT 'orders_' || o_orderstatus AS _table_id, o_orderkey AS _row_index, o_orderkey AS "Order Key", o_custkey AS "Customer",
    o_totalprice AS "Total Price", o_orderpriority AS "Priority", strftime(o_orderdate, '%Y') AS "Year" FROM orders)
SELECT * FROM united UNION ALL BY NAME SELECT * FROM orders_""")
def union_mixed(spark, sf):
    """Customers and orders, which have no column in common."""
    types = {"Order Key": "int64", "Customer": "int64", "Total Price": "float64", "Priority": "object", "Year": "object"}
    storage = F.create_map(*[F.lit(x) for pair in types.items() for x in pair]).alias("storage_types")
    wanted = ["table_id", "column_names", "storage_types"]
    tables = fx.catalog_tables(spark, sf).select(*wanted).unionByName(fx.order_tables(spark, sf).select("table_id", "column_names", storage))
    rows = [x.select("table_id", F.col("row_index").cast("bigint").alias("row_index"), "row_data") for x in (fx.catalog_rows(spark, sf), fx.order_rows(spark, sf))]
    return _united(tables, rows[0].unionByName(rows[1]))


#: Pattern of a date as Spark writes it, per column.
_FORMS = {"iso": "yyyy/M/d", "day": "dd.MM.yyyy", "month": "MM/dd/yyyy", "name": "d MMMM yyyy", "short": "MMM d, yy", "two": "d-M-yy"}


def _order_dates(spark, sf):
    forms = [F.date_format("o_orderdate", f).alias(n) for n, f in _FORMS.items()]
    return fx.read(spark, sf, "orders").select("o_orderkey", *forms, "o_orderpriority")


@query("t1_date_forms", f"""
SELECT o_orderkey, {", ".join(f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS {n}" for n in _FORMS)}, o_orderpriority FROM orders""")
def date_forms(spark, sf):
    """Dates written in six forms come back as the dates they are; a column of text stays."""
    dates = with_dates(_order_dates(spark, sf), [*_FORMS, "o_orderpriority"])
    return dates.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in _FORMS})


@query("t1_date_columns", """
WITH d AS (SELECT day(o_orderdate) <= 12 AS low FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE low) AS low FROM d)
SELECT name, is_date, day_first, n AS voters, CASE kind WHEN 1 THEN n ELSE 0 END AS one_way,
  CASE kind WHEN 2 THEN n WHEN 3 THEN low ELSE 0 END AS by_day, CASE kind WHEN 3 THEN n WHEN 2 THEN low ELSE 0 END AS by_month
FROM c, (VALUES ('iso', TRUE, TRUE, 1), ('day', TRUE, TRUE, 2), ('month', TRUE, FALSE, 3), ('name', TRUE, TRUE, 1), ('short', TRUE, TRUE, 1),
  ('two', TRUE, TRUE, 2), ('o_orderpriority', FALSE, TRUE, 0)) t(name, is_date, day_first, kind)""")
def date_columns_(spark, sf):
    """What each column of dates says about its order, by one aggregate over its cells."""
    dates = _order_dates(spark, sf)
    return date_columns(unpivot_cells(dates, F.lit("orders"), [*_FORMS, "o_orderpriority"]), ["name"])


@query("i3_stream_changes", """
WITH newest AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1)
SELECT event_type AS source_file, count(*) AS documents, CAST(sum(event_id % 7) AS BIGINT) AS n FROM newest JOIN events USING (event_id) GROUP BY 1""")
def stream_changes(spark, sf):
    """Every event replaces what its user did before; counts follow the newest one."""
    root = shared_folder(spark, "i3")
    versions = _stream(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("source_file"), F.col("event_id").alias("version"), (F.col("event_id") % 7).alias("n"))
    follow_counts(versions, root + "/changes", root + "/checkpoint").awaitTermination()
    return current_counts(spark, root + "/changes")


def _stored_summaries(spark, sf):
    """Two writes: all customer tables, then every third one again with its first ten rows and another source; and what
    the second has replaced."""
    summaries = StoredSummaries(spark, shared_folder(spark, "summaries"))
    tables, rows = fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf)
    again = F.col("doc_id").cast("bigint") % 3 == 0
    summaries.add(tables, rows, 0)
    summaries.add(tables.filter(again).withColumns({"source_file": F.lit("crm/again.xlsx"), "table_type": F.lit("excel")}), rows.filter(again & (F.col("row_index") < 10)), 1)
    documents = tables.select("doc_id", F.lit(0).cast("bigint").alias("ingest_seq"))
    documents = documents.unionByName(documents.filter(again).withColumn("ingest_seq", F.lit(1).cast("bigint")))
    return summaries, superseded_versions(documents)


_REPLACED = _W + """,
now AS (
  SELECT table_id, CASE WHEN blk % 3 = 0 THEN 'crm/again.xlsx' ELSE source_file END AS source_file,
    CASE WHEN blk % 3 = 0 THEN 'excel' ELSE 'html' END AS table_type, CASE WHEN blk % 3 = 0 THEN least(n_rows, 10) ELSE n_rows END AS actual_rows
  FROM shape)
"""


@query("g8_kept_types", _REPLACED + "SELECT table_type, count(*) AS n FROM now GROUP BY 1")
def kept_types(spark, sf):
    summaries, gone = _stored_summaries(spark, sf)
    return summaries.tables_by_type(gone)


@query("g9_kept_summary", _REPLACED + """
SELECT count(*) AS total_tables, CAST(sum(actual_rows) AS BIGINT) AS total_rows, count(DISTINCT source_file) AS unique_source_files FROM now""")
def kept_summary(spark, sf):
    summaries, gone = _stored_summaries(spark, sf)
    return summaries.store_summary(gone)


@query("g10_kept_rows", _REPLACED + "SELECT table_id, source_file, actual_rows FROM now")
def kept_rows(spark, sf):
    summaries, gone = _stored_summaries(spark, sf)
    return summaries.actual_rows(gone).select("table_id", "source_file", "actual_rows")


@query("g11_kept_sources", _REPLACED + """
SELECT source_file, count(*) AS tables, CAST(sum(actual_rows) AS BIGINT) AS actual_rows FROM now GROUP BY 1""")
def kept_sources(spark, sf):
    summaries, gone = _stored_summaries(spark, sf)
    return summaries.source_totals(gone)
