"""Catalog writes and reads over the customer tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import catalog as c
from ..plans.ingest import ingest, new_documents
from ..session import checkpoint_root
from . import fixtures as fx
from .registry import query

_W = "WITH " + fx.CUSTOMER_SQL


def shared_folder(spark, name: str) -> str:
    """A fresh folder for a written catalog, where all executors can reach it."""
    return f"{checkpoint_root(spark)}/doctables-{name}-{uuid.uuid4().hex}"


def seconds(column: str = "created_at"):
    return F.unix_seconds(column).alias("created_s")


def _listing(tables):
    return tables.select(
        "table_id", "source_file", "rows", "columns",
        F.array_join("column_names", ", ").alias("column_names"), "description", seconds(),
    )


_LISTING = """table_id, source_file, n_rows AS rows, n_cols AS columns, column_names, description, created_s"""


@query("k1_json_rows", _W + """
SELECT c.table_id, CAST(c.row_index AS INTEGER) AS row_index, c.name,
  CASE WHEN value IS NULL THEN 'null' WHEN storage = 'object' THEN 'string' ELSE 'number' END AS json_type,
  CASE WHEN value IS NULL THEN NULL WHEN storage = 'float64' THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE value END AS value
FROM cells c JOIN cols k USING (table_id, position)""")
def json_rows(spark, sf):
    """Every field of every stored row with its JSON type."""
    v = F.parse_json("row_data")
    parsed = fx.catalog_rows(spark, sf).select("table_id", "row_index", v.alias("v"), "row_data")

    def one(name: str):
        path = f"$.{name}"
        kind = F.schema_of_variant(F.variant_get("v", path, "variant"))
        return F.struct(
            F.lit(name).alias("name"),
            F.when(kind == "STRING", "string").when(kind == "VOID", "null").otherwise("number").alias("json_type"),
            F.get_json_object("row_data", path).alias("value"),
        )

    fields = F.explode(F.array(*[one(n) for n in fx.CUSTOMER_HEADER])).alias("f")
    return parsed.select("table_id", "row_index", fields).select("table_id", "row_index", "f.*")


@query("k2_k3_stored_tables", _W + """
SELECT blk AS doc, table_id || '_table_1' AS table_id, 'http://crm.example.com/customer_' || blk || '.html' AS source_file,
  n_rows AS rows, n_cols AS columns, typed_columns,
  CASE WHEN blk % 2 = 0 THEN 'Customers of block ' || blk ELSE 'No description available' END AS description
FROM shape JOIN listed USING (table_id)""")
def stored(spark, sf):
    """Pages extracted, described (every other one), written to a catalog and read back."""
    from ..sources.extract import extract_pages

    catalog = c.Catalog(spark, shared_folder(spark, "k2"), buckets=8)
    described = fx.customer_blocks(spark, sf).filter(F.col("blk") % 2 == 0).select(
        fx.text("blk").alias("doc_id"), F.lit(1).alias("ordinal"),
        F.concat(F.lit("Customers of block "), fx.text("blk")).alias("description"),
    )
    ingest(
        extract_pages(fx.customer_pages(spark, sf)), catalog, F.lit("2024-01-01").cast("timestamp"),
        run="k2", descriptions=described,
    )
    typed = F.transform(
        "column_names", lambda n: F.concat(n, F.lit(" ("), F.element_at("column_types", n), F.lit(")"))
    )
    return catalog.tables().select(
        F.col("doc_id").cast("bigint").alias("doc"), "table_id", "source_file", "rows", "columns",
        F.array_join(typed, ", ").alias("typed_columns"), "description",
    )


@query("k4_upsert", _W + """
SELECT table_id, CASE WHEN blk % 3 = 0 THEN 'second' ELSE 'first' END AS version, n_rows AS stored_rows FROM shape""")
def upsert(spark, sf):
    """A second write of every third table replaces its metadata and all of its rows."""
    catalog = c.Catalog(spark, shared_folder(spark, "k4"), buckets=8)
    tables, rows = fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf)
    catalog.append(tables.withColumn("description", F.lit("first")), rows, ingest_seq=0)
    again = F.split("table_id", "_")[1].cast("bigint") % 3 == 0
    catalog.append(
        tables.filter(again).withColumn("description", F.lit("second")), rows.filter(again), ingest_seq=1
    )
    counts = catalog.table_data().groupBy("table_id").agg(F.count(F.lit(1)).alias("stored_rows"))
    return catalog.tables().join(counts, "table_id").select(
        "table_id", F.col("description").alias("version"), "stored_rows"
    )


@query("k3_equal_file_names", """
WITH d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE 'first' END AS version FROM supplier)
SELECT 'shop/' || k || '/index.html' AS source_file, 'index_table_1' AS table_id, version, CAST(1 AS BIGINT) AS stored_rows FROM d""")
def equal_file_names(spark, sf):
    """Documents of one file name in many folders, every third written again; no one replaces another."""
    from ..sources.extract import extract_pages, page_documents

    catalog = c.Catalog(spark, shared_folder(spark, "k3"), buckets=8)
    stamp = F.lit("2024-01-01").cast("timestamp")
    pages = fx.read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("shop/"), fx.text("s_suppkey"), F.lit("/index.html")).alias("url"))
    for version, some in (("first", pages), ("second", pages.filter("s_suppkey % 3 = 0"))):
        html = F.lit(f"<table><tr><th>version<tr><td>{version}</table>")
        ingest(extract_pages(page_documents(some.withColumn("html", html))), catalog, stamp, run=version)
    again = c.Catalog(spark, catalog.root)  # opened without its number of buckets
    value = F.get_json_object("row_data", "$.version")
    counted = again.table_data().groupBy("doc_id", "ordinal").agg(F.count(F.lit(1)).alias("stored_rows"), F.max(value).alias("version"))
    return again.tables().join(counted, ["doc_id", "ordinal"]).select("source_file", "table_id", "version", "stored_rows")


@query("k6_document_log", """
SELECT 'p/' || page_id || '.html' AS source_file, CASE WHEN page_id % 4 = 0 THEN 'processed' ELSE 'no tables' END AS status,
  CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total_tables FROM pages""")
def documents_of_a_run(spark, sf):
    """Every document of a run is recorded, with tables or without."""
    from ..sources.extract import extract_pages, page_documents

    catalog = c.Catalog(spark, shared_folder(spark, "k6"), buckets=8)
    table = F.when(F.col("page_id") % 4 == 0, "<table><tr><th>a<tr><td>1</table>").otherwise("<p>no table</p>")
    pages = fx.read(spark, sf, "pages").select(F.concat(F.lit("p/"), fx.text("page_id"), F.lit(".html")).alias("url"), table.alias("html"))
    ingest(extract_pages(page_documents(pages)), catalog, F.lit("2024-01-01").cast("timestamp"), run="k6")
    return catalog.documents().select("source_file", "status", "total_tables")


@query("k4_upsert_frames", """
SELECT 'c' || c_custkey AS table_id, CASE WHEN c_nationkey < 5 THEN 'new' ELSE c_mktsegment END AS value FROM customer""")
def upsert_frames(spark, sf):
    old = fx.read(spark, sf, "customer").select(
        F.concat(F.lit("c"), fx.text("c_custkey")).alias("table_id"), F.col("c_mktsegment").alias("value"), "c_nationkey"
    )
    new = old.filter("c_nationkey < 5").withColumn("value", F.lit("new"))
    return c.upsert(old, new).select("table_id", "value")


@query("k5_validate_records", """
SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS valid FROM customer""")
def validate(spark, sf):
    k = F.col("c_custkey")
    records = fx.read(spark, sf, "customer").select(
        "c_custkey", fx.text("c_custkey").alias("table_id"),
        F.when(k % 5 != 0, F.lit("crm.html")).alias("source_file"),
        F.lit(1).alias("rows"), F.lit(5).alias("columns"),
        F.when(k % 7 != 0, fx.strings(fx.CUSTOMER_HEADER)).alias("column_names"), F.lit("[]").alias("row_data"),
    )
    return c.validate_records(records).select("c_custkey", "valid")


@query("k6_session_log", _W + """
SELECT 'session_' || substr(sha256(source_file || '|run-1'), 1, 16) AS session_id, source_file, count(*) AS total_tables,
  count(*) AS successful_tables FROM shape GROUP BY source_file""")
def session_log(spark, sf):
    return c.session_log(fx.customer_profiled(spark, sf), "run-1", F.lit("2024-01-01").cast("timestamp")).drop("created_at")


@query("k7_clear", "SELECT CAST(0 AS BIGINT) AS tables_left, CAST(0 AS BIGINT) AS rows_left, (SELECT count(DISTINCT c_custkey // 20) FROM customer) AS tables_before")
def clear(spark, sf):
    catalog = c.Catalog(spark, shared_folder(spark, "k7"), buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))
    before = catalog.tables().count()
    catalog.clear()
    left = catalog.all_tables().agg(F.count(F.lit(1)).alias("tables_left"))
    return left.select(
        "tables_left", catalog.all_table_data().agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_left"),
        F.lit(before).cast("bigint").alias("tables_before"),
    )


@query("k8_backup_restore", _W + "SELECT table_id, n_rows AS rows, n_rows AS stored_rows FROM shape")
def backup_restore(spark, sf):
    """A catalog backed up, overwritten by something else and restored."""
    root = shared_folder(spark, "k8")
    catalog = c.Catalog(spark, root + "/live", buckets=8)
    tables, rows = fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf)
    catalog.append(tables, rows, fx.catalog_sessions(spark, sf))
    assert catalog.backup(root + "/copy")
    catalog.append(tables.filter("rows < 0"), rows.filter("row_index < 0"))
    assert catalog.restore(root + "/copy")
    return c.tables_with_actual_rows(catalog.tables(), catalog.table_data()).select(
        "table_id", "rows", F.col("actual_rows").alias("stored_rows")
    )


@query("g1_tables_of_source", _W + f"SELECT {_LISTING} FROM shape JOIN listed USING (table_id) WHERE source_file = 'crm/segment_3.html'")
def of_source(spark, sf):
    return _listing(c.tables_of_source(fx.catalog_tables(spark, sf), "crm/segment_3.html"))


@query("g2_all_tables", _W + f"SELECT {_LISTING} FROM shape JOIN listed USING (table_id)")
def every_table(spark, sf):
    return _listing(c.all_tables(fx.catalog_tables(spark, sf)))


@query("g3_metadata", _W + f"SELECT {_LISTING} FROM shape JOIN listed USING (table_id) WHERE table_id = 'customer_1'")
def metadata(spark, sf):
    return _listing(c.metadata_of(fx.catalog_tables(spark, sf), "customer_1"))


@query("g3_metadata_many", _W + f"""
SELECT {_LISTING} FROM shape JOIN listed USING (table_id) WHERE table_id IN (SELECT 'customer_' || s_suppkey FROM supplier)""")
def metadata_many(spark, sf):
    ids = fx.read(spark, sf, "supplier").select(F.concat(F.lit("customer_"), fx.text("s_suppkey")).alias("table_id"))
    return _listing(c.metadata_of(fx.catalog_tables(spark, sf), ids))


@query("g4_existence", _W + """
SELECT 'customer_' || s_suppkey AS table_id, 'customer_' || s_suppkey IN (SELECT table_id FROM shape) AS found FROM supplier""")
def existence(spark, sf):
    ids = fx.read(spark, sf, "supplier").select(F.concat(F.lit("customer_"), fx.text("s_suppkey")).alias("table_id"))
    return c.existence(fx.catalog_tables(spark, sf), ids)


@query("g5_search", _W + """
SELECT table_id, source_file FROM shape WHERE table_id ILIKE '%SEGMENT_4%' OR source_file ILIKE '%SEGMENT_4%' OR description ILIKE '%SEGMENT_4%'""")
def search(spark, sf):
    return c.search(fx.catalog_tables(spark, sf), "SEGMENT_4").select("table_id", "source_file")


@query("g5_search_fields", _W + "SELECT table_id FROM shape WHERE table_id ILIKE '%r_1_%'")
def search_fields(spark, sf):
    """A wildcard term over one allowed field; an unknown field is ignored."""
    return c.search(fx.catalog_tables(spark, sf), "r_1_", ["table_id", "html_content"]).select("table_id")


@query("g6_table_rows", """
SELECT c_custkey % 20 AS _row_index, c_name FROM customer WHERE c_custkey // 20 = 2 AND c_custkey % 20 BETWEEN 5 AND 14""")
def table_rows(spark, sf):
    rows = c.table_rows(fx.catalog_rows(spark, sf), "customer_2", limit=10, offset=5)
    return rows.select(
        F.col("_row_index").cast("bigint").alias("_row_index"), F.col("row")["c_name"].alias("c_name")
    )


@query("g6_table_rows_large", """
SELECT o_orderkey AS _row_index, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 700 OFFSET 1200""")
def table_rows_large(spark, sf):
    """Limit and offset in a table of many rows whose index has gaps."""
    rows = c.table_rows(fx.order_rows(spark, sf), "orders_F", limit=700, offset=1200)
    return rows.select("_row_index", F.col("row")["Priority"].alias("priority"))


@query("g7_typed_table", """
SELECT c_custkey % 20 AS row_index, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey // 20 = 4""")
def typed_table(spark, sf):
    done = c.typed_table(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf), "customer_4")
    return done.withColumn("row_index", F.col("row_index").cast("bigint"))


@query("g8_pipeline_summary", _W + "SELECT count(*) AS total_tables, count(DISTINCT source_file) AS unique_sources FROM shape")
def pipeline_summary(spark, sf):
    return c.pipeline_summary(fx.catalog_tables(spark, sf))


@query("g8_tables_by_type", _W + "SELECT 'html' AS table_type, count(*) AS n FROM shape")
def by_type(spark, sf):
    return c.tables_by_type(fx.catalog_tables(spark, sf))


@query("g8_recent_sessions", _W + """
SELECT session_id, source_file, total_tables, total_tables AS successful_tables, created_s FROM sessions ORDER BY created_s DESC, session_id LIMIT 5""")
def recent_sessions(spark, sf):
    done = c.recent_sessions(fx.catalog_sessions(spark, sf))
    return done.select("session_id", "source_file", "total_tables", "successful_tables", seconds())


@query("g9_store_summary", _W + """
SELECT (SELECT count(*) FROM shape) AS total_tables, (SELECT count(*) FROM cust) AS total_rows,
  (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(DISTINCT source_file) FROM shape) AS unique_source_files""")
def store_summary(spark, sf):
    return c.store_summary(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf), fx.catalog_sessions(spark, sf))


@query("g10_actual_rows", _W + """
SELECT table_id, n_rows AS rows, CASE WHEN blk % 3 = 1 THEN 0 ELSE n_rows END AS actual_rows FROM shape""")
def actual_rows(spark, sf):
    """Row counts from the data; every third table has metadata only."""
    kept = fx.catalog_rows(spark, sf).filter(F.split("table_id", "_")[1].cast("bigint") % 3 != 1)
    return c.tables_with_actual_rows(fx.catalog_tables(spark, sf), kept).select("table_id", "rows", "actual_rows")


@query("g11_chat_summary", _W + """
SELECT count(*) AS total_tables, CAST(sum(n_rows) AS BIGINT) AS total_data_rows, count(DISTINCT source_file) AS unique_source_files FROM shape""")
def chat_summary(spark, sf):
    return c.chat_summary(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))


@query("g11_source_files", _W + "SELECT DISTINCT source_file FROM shape")
def source_files(spark, sf):
    return c.source_files(fx.catalog_tables(spark, sf))


@query("g12_table_listing", _W + f"SELECT {_LISTING}, n_rows AS actual_rows FROM shape JOIN listed USING (table_id)")
def listing(spark, sf):
    done = c.tables_with_actual_rows(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))
    return done.select(
        "table_id", "source_file", "rows", "columns", F.array_join("column_names", ", ").alias("column_names"),
        "description", seconds(), "actual_rows",
    )


@query("g13_session", _W + "SELECT session_id, source_file, total_tables FROM sessions WHERE session_id = 'session_2'")
def session(spark, sf):
    return c.session_of(fx.catalog_sessions(spark, sf), "session_2").select("session_id", "source_file", "total_tables")


@query("g14_free_sql", _W + """
SELECT v4 AS segment, count(*) AS n, round(avg(CAST(replace(v3, ',', '') AS DOUBLE)), 4) AS average
FROM cust JOIN shape USING (table_id) WHERE source_file <> 'crm/segment_0.html' AND v3 NOT IN ('', '-') GROUP BY 1""")
def free_sql(spark, sf):
    """A user's SQL over a stored catalog: join, JSON access, parameter, closing semicolon."""
    catalog = c.Catalog(spark, shared_folder(spark, "g14"), buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf), fx.catalog_sessions(spark, sf))
    return catalog.sql(
        """SELECT json_extract(d.row_data, '$."c_mktsegment"') AS segment, count(*) AS n,
             round(avg(try_cast(json_extract(d.row_data, '$."c_acctbal"') AS double)), 4) AS average
           FROM table_data d JOIN tables t ON d.table_id = t.table_id
           WHERE t.source_file <> :skipped AND try_cast(json_extract(d.row_data, '$."c_acctbal"') AS double) IS NOT NULL
           GROUP BY 1;""",
        {"skipped": "crm/segment_0.html"},
    )


@query("g15_result_metadata", _W + """
SELECT table_id, n_rows AS rows, (SELECT count(*) FROM shape WHERE n_rows > 3) AS row_count, 'table_id, rows' AS columns FROM shape WHERE n_rows > 3""")
def result_metadata(spark, sf):
    """A result as written, with its row count and columns as counted while it was written."""
    result = fx.catalog_tables(spark, sf).filter("rows > 3").select("table_id", "rows")
    observed, seen = c.with_observed_count(result)
    path = shared_folder(spark, "g15")
    observed.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("row_count", F.lit(seen.get["row_count"]).cast("bigint")).withColumn(
        "columns", F.lit(", ".join(result.columns)))


@query("g16_schema_overview", _W + """
SELECT table_id, n_rows AS rows, (SELECT count(*) FROM shape) AS total_tables, (SELECT count(*) FROM cust) AS total_rows FROM shape""")
def schema_overview(spark, sf):
    catalog = c.Catalog(spark, shared_folder(spark, "g16"), buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))
    tables, totals = catalog.schema_overview()
    return tables.select(
        "table_id", "rows", totals.select("total_tables").scalar().alias("total_tables"),
        totals.select("total_rows").scalar().alias("total_rows"),
    )


@query("i1_new_documents", """
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id AND l.quality = 1)""")
def unseen(spark, sf):
    """Pages of a scan minus those known: the ones whose id has a label of quality 1."""
    known = fx.read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    return new_documents(fx.read(spark, sf, "pages"), known, on=("page_id",)).select("page_id", "url")


@query("u3_store_format", _W + "SELECT table_id, n_rows AS rows, n_rows AS stored_rows FROM shape")
def store_format(spark, sf):
    """The catalog kept in another file format."""
    catalog = c.Catalog(spark, shared_folder(spark, "u3"), format="orc", buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))
    return c.tables_with_actual_rows(catalog.tables(), catalog.table_data()).select(
        "table_id", "rows", F.col("actual_rows").alias("stored_rows")
    )
