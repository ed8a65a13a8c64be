"""Scans, dispatch, extraction, workbooks and pipe tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import file_extension
from ..operators.clean import split_islands
from ..operators.markdown import parse_pipe_tables, pipe_table_grids, render_html, render_markdown
from ..sources.extract import (
    extract_pages,
    missing_files,
    page_documents,
    pages_to_markdown,
    route,
)
from ..sources.grids import (
    cap_tables,
    explode_rows,
    from_cell_lists,
    from_column_map,
    outcomes,
    tables,
)
from . import fixtures as fx
from .registry import query


@query("s2_page_scan", """
SELECT CAST(page_id AS VARCHAR) AS doc_id, url AS source_file, length(html) AS n_chars FROM pages""")
def page_scan(spark, sf):
    docs = page_documents(fx.read(spark, sf, "pages"), doc_id=F.col("page_id"))
    return docs.select("doc_id", "source_file", F.length("html").cast("bigint").alias("n_chars"))


@query("s2_page_extraction", """
SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(0 AS INTEGER) AS tables_found, true AS ok FROM pages
WHERE lower(html) NOT LIKE '%<table%'""")
def page_extraction(spark, sf):
    docs = page_documents(fx.read(spark, sf, "pages"), doc_id=F.col("page_id"))
    return outcomes(extract_pages(docs)).select("doc_id", "tables_found", "ok")


@query("s3_route", """
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS extension FROM pages)
SELECT page_id, extension,
  CASE WHEN extension IN ('.html', '.htm') THEN 'html' WHEN extension = '.xlsx' THEN 'excel'
       WHEN extension = '.xls' THEN 'excel_binary' END AS format,
  CASE WHEN extension NOT IN ('.html', '.htm', '.xlsx', '.xls') THEN
    'No extractor found for file: ' || url || ' (extension: ' || extension
    || '). Supported extensions: .htm, .html, .xls, .xlsx' END AS error
FROM p""")
def route_pages(spark, sf):
    pages = fx.read(spark, sf, "pages").select("page_id", F.col("url").alias("source_file"))
    return route(pages).select("page_id", "extension", "format", "error")


@query("s4_html_tables", "WITH " + fx.CUSTOMER_SQL + """
SELECT CAST(blk AS VARCHAR) AS doc_id, 'http://crm.example.com/customer_' || blk || '.html' AS source_file,
  CAST(1 AS INTEGER) AS ordinal, table_id || '_table_1' AS table_id,
  '<table><thead><tr><th>c_custkey</th><th>c_name</th><th>c_nationkey</th><th>c_acctbal</th><th>c_mktsegment</th></tr></thead><tbody>'
  || string_agg('<tr><td>' || v0 || '</td><td>' || v1 || '</td><td>' || v2 || '</td><td>' || v3 || '</td><td>' || v4 || '</td></tr>', '' ORDER BY row_index)
  || '</tbody></table>' AS html
FROM cust GROUP BY blk, table_id""")
def html_tables(spark, sf):
    found = tables(extract_pages(fx.customer_pages(spark, sf)))
    return found.select("doc_id", "source_file", "ordinal", "table_id", "html")


@query("s5_html_grid", "WITH " + fx.CUSTOMER_SQL + """
SELECT CAST(blk AS VARCHAR) AS doc_id, table_id || '_table_1' AS table_id, row_index,
  v0 AS c0, v1 AS c1, v2 AS c2, v3 AS c3, v4 AS c4 FROM cust""")
def html_grid(spark, sf):
    rows = explode_rows(tables(extract_pages(fx.customer_pages(spark, sf))))
    return rows.select(
        "doc_id", "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(5)],
    )


@query("s9_sheet_islands", "WITH " + fx.SHEET_SQL + """,
lines AS (
  SELECT blk, -1 AS row_index, ['p_partkey', 'p_name', NULL, 'Unnamed: 3', 'p_size'] AS c FROM sheet GROUP BY blk
  UNION ALL SELECT blk, row_index, [v0, v1, v2, v3, v4] FROM sheet),
marked AS (
  SELECT *, len(list_filter(c, lambda x: x IS NOT NULL)) = 0 AS blank FROM lines),
island AS (
  SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY blk ORDER BY row_index) AS g FROM marked),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY blk, g ORDER BY row_index) - 2 AS place, count(*) OVER (PARTITION BY blk, g) AS n
  FROM island WHERE NOT blank),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY blk ORDER BY g) AS t FROM sized WHERE n > 1)
SELECT 'parts_' || blk || '_table_' || t AS table_id, CAST(place AS BIGINT) AS row_index,
  c[1] AS c0, c[2] AS c1, c[3] AS c2, c[4] AS c3, c[5] AS c4
FROM ranked WHERE place >= 0""")
def sheet_islands(spark, sf):
    sheets = fx.part_sheets(spark, sf).withColumn("stem", F.col("table_id"))
    rows = explode_rows(split_islands(sheets))
    return rows.select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(5)],
    )


def _pipe_documents(spark, sf):
    """Orders as markdown: two rows a text, blank lines and rules in between, some ragged."""
    k = F.col("o_orderkey")
    return fx.read(spark, sf, "orders").select(
        k.alias("doc_id"),
        F.concat(F.lit("md/o"), k.cast("string"), F.lit(".md")).alias("source_file"),
        F.concat(
            F.lit("Order\n\n| Key | Status | Priority |\n|:---|---|--:|\n| "), k.cast("string"), F.lit(" | "),
            F.col("o_orderstatus"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |\n\n"),
            F.when(k % 5 == 0, "| short |\n").when(k % 5 == 1, "|| a | b | c | d |\n")
            .when(k % 5 == 2, "|x|y|z|\n").otherwise("text\n"),
            F.lit("| late | row | 1 |\nend\n| never | seen | 2 |"),
        ).alias("text"),
    )


_PIPE_SQL = """
WITH docs AS (
  SELECT o_orderkey AS k, unnest(
      [{'i': 0, 'r': [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]}]
      || CASE o_orderkey % 5 WHEN 0 THEN [{'i': 1, 'r': ['short', NULL, NULL]}]
           WHEN 2 THEN [{'i': 1, 'r': ['x', 'y', 'z']}] ELSE [] END
      || CASE WHEN o_orderkey % 5 IN (0, 2) THEN [{'i': 2, 'r': ['late', 'row', '1']}] ELSE [] END) AS e
  FROM orders WHERE o_orderkey % 5 <> 1)
"""


@query("s10_pipe_tables", _PIPE_SQL + """
SELECT k AS doc_id, CAST(e.i AS BIGINT) AS row_index, e.r[1] AS c0, e.r[2] AS c1, e.r[3] AS c2 FROM docs""")
def pipe_tables(spark, sf):
    parsed = parse_pipe_tables(_pipe_documents(spark, sf))
    rows = parsed.select(
        "doc_id", F.posexplode(F.slice("table_rows", F.lit(2), F.greatest(F.size("table_rows") - 1, F.lit(0)))).alias("i", "r")
    )
    return rows.select(
        "doc_id", F.col("i").cast("bigint").alias("row_index"),
        *[F.get("r", F.lit(i)).alias(f"c{i}") for i in range(3)],
    )


@query("s11_markdown_table", _PIPE_SQL + """
SELECT CAST(k AS VARCHAR) AS doc_id, 'o' || k || '_markdown_table' AS table_id, count(*) AS n_rows,
  'Key, Status, Priority' AS column_names,
  string_agg(coalesce(e.r[3], ''), '/' ORDER BY e.i) AS last_column
FROM docs GROUP BY k""")
def markdown_table(spark, sf):
    from ..operators.clean import clean_sheet

    grids = clean_sheet(pipe_table_grids(_pipe_documents(spark, sf)))
    return grids.select(
        "doc_id", "table_id", F.size("body").cast("bigint").alias("n_rows"),
        F.array_join(F.get("header", F.lit(0)), ", ").alias("column_names"),
        F.array_join(F.transform("body", lambda r: F.get(r, F.lit(2))), "/").alias("last_column"),
    )


@query("s12_cell_lists", """
SELECT 'supplier_' || s_suppkey AS table_id, CAST(0 AS BIGINT) AS row_index, '0, 1, 2' AS column_names,
  CAST(s_suppkey AS VARCHAR) AS c0, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS c1,
  CAST(s_nationkey AS VARCHAR) AS c2 FROM supplier
UNION ALL
SELECT 'supplier_' || s_suppkey, 1, '0, 1, 2', 'second', '', 'row' FROM supplier""")
def cell_lists(spark, sf):
    none = F.lit(None).cast("string")
    given = fx.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.concat(F.lit("supplier_"), fx.text("s_suppkey")).alias("table_id"),
        F.lit(1).alias("ordinal"),
        F.array(
            F.array(fx.text("s_suppkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")), fx.text("s_nationkey")),
            F.array(F.lit("second"), none, F.lit("row")),
        ).alias("given"),
    )
    rows = explode_rows(from_cell_lists(given, "given"), "header")
    return rows.select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        F.array_join(F.get("header", F.lit(0)), ", ").alias("column_names"),
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)],
    )


@query("s12_cell_map", """
SELECT 'supplier_' || s_suppkey AS table_id, CAST(i AS BIGINT) AS row_index, 'key, name' AS column_names,
  CASE i WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'more' END AS c0, CASE i WHEN 0 THEN s_name ELSE '' END AS c1
FROM supplier, (VALUES (0), (1)) v(i)""")
def cell_map(spark, sf):
    given = fx.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.concat(F.lit("supplier_"), fx.text("s_suppkey")).alias("table_id"),
        F.lit(1).alias("ordinal"),
        F.create_map(
            F.lit("key"), F.array(fx.text("s_suppkey"), F.lit("more")),
            F.lit("name"), F.array(F.col("s_name")),
        ).alias("given"),
    )
    rows = explode_rows(from_column_map(given, "given"), "header")
    return rows.select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"),
        F.array_join(F.get("header", F.lit(0)), ", ").alias("column_names"),
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(2)],
    )


def _many_tables(spark, sf):
    """A page per customer block with one small table per customer."""
    return fx.customer_blocks(spark, sf).select(
        fx.text("blk").alias("doc_id"),
        F.concat(F.lit("crm/many_"), fx.text("blk"), F.lit(".html")).alias("source_file"),
        F.array_join(
            F.transform(
                "body",
                lambda r: F.concat(
                    F.lit("<p>Next<TABLE border=1><tr><th>key<th>name<tr><td>"), F.get(r, F.lit(0)),
                    F.lit("<td>"), F.get(r, F.lit(1)), F.lit("</TABLE>"),
                ),
            ),
            "\n",
        ).alias("html"),
    )


@query("s13_table_cap", "WITH " + fx.CUSTOMER_SQL + """
SELECT CAST(blk AS VARCHAR) AS doc_id, 'many_' || blk || '_table_' || (row_index + 1) AS table_id,
  v0 AS key, v1 AS name FROM cust WHERE row_index < 8""")
def table_cap(spark, sf):
    kept = cap_tables(tables(extract_pages(_many_tables(spark, sf))), 8)
    return kept.select(
        "doc_id", "table_id",
        F.get(F.get("body", F.lit(0)), F.lit(0)).alias("key"),
        F.get(F.get("body", F.lit(0)), F.lit(1)).alias("name"),
    )


@query("s14_fault_isolation", "WITH " + fx.CUSTOMER_SQL + """
SELECT CAST(blk AS VARCHAR) AS doc_id,
  CASE blk % 3 WHEN 0 THEN CAST(count(*) AS INTEGER) ELSE 0 END AS tables_found, blk % 3 <> 2 AS ok,
  CASE blk % 3 WHEN 2 THEN 'No extractor found for file: crm/many_' || blk || '.pdf (extension: .pdf). Supported extensions: .htm, .html, .xls, .xlsx' END AS error
FROM cust GROUP BY blk""")
def fault_isolation(spark, sf):
    """Good pages, pages without tables and files of no known format in one extraction."""
    from ..sources.extract import extract_files

    blk = F.col("doc_id").cast("bigint")
    files = _many_tables(spark, sf).select(
        "doc_id",
        F.when(blk % 3 == 2, F.replace("source_file", F.lit(".html"), F.lit(".pdf")))
        .otherwise(F.col("source_file")).alias("source_file"),
        F.when(blk % 3 == 0, F.col("html")).otherwise("<p>none</p>").cast("binary").alias("content"),
    )
    return outcomes(extract_files(files)).select("doc_id", "tables_found", "ok", "error")


@query("s15_missing_files", """
SELECT 'docs/d' || doc_id || '.html' AS path, 'File not found: docs/d' || doc_id || '.html' AS error
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def missing_manifest_files(spark, sf):
    """A manifest (all documents) against what a scan saw (the labelled ones)."""
    def paths(name):
        return fx.read(spark, sf, name).select(
            F.concat(F.lit("docs/d"), fx.text("doc_id"), F.lit(".html")).alias("path")
        )

    return missing_files(paths("documents"), paths("labels").distinct())


@query("s15_supported_files", """
SELECT count(*) AS files, count(*) FILTER (WHERE lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) IN ('.html', '.htm', '.xls', '.xlsx')) AS supported
FROM pages""")
def supported_files(spark, sf):
    from ..sources.extract import DEFAULT_FORMATS

    known = file_extension(F.col("url")).isin(DEFAULT_FORMATS.extensions())
    return fx.read(spark, sf, "pages").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(known).alias("supported")
    )


@query("s16_page_markdown")
def page_markdown(spark, sf):
    docs = page_documents(fx.read(spark, sf, "pages"), doc_id=F.col("page_id"))
    return pages_to_markdown(docs)


@query("s17_render_html", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id,
  '<table><thead><tr><th>c_custkey</th><th>c_name</th><th>c_nationkey</th><th>c_acctbal</th><th>c_mktsegment</th></tr></thead><tbody>'
  || string_agg('<tr><td>' || v0 || '</td><td>' || v1 || '</td><td>' || v2 || '</td><td>' || v3 || '</td><td>' || v4 || '</td></tr>', '' ORDER BY row_index)
  || '</tbody></table>' AS html
FROM cust GROUP BY table_id""")
def rendered_html(spark, sf):
    return fx.customer_grids(spark, sf).select(
        "table_id", render_html(F.get("header", F.lit(0)), F.col("body")).alias("html")
    )


@query("s17_render_markdown", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, '| c_custkey | c_name | c_nationkey | c_acctbal | c_mktsegment |' || chr(10) || '|---|---|---|---|---|' || chr(10)
  || string_agg('| ' || v0 || ' | ' || v1 || ' | ' || v2 || ' | ' || v3 || ' | ' || v4 || ' |', chr(10) ORDER BY row_index) AS markdown
FROM cust GROUP BY table_id""")
def rendered_markdown(spark, sf):
    return fx.customer_grids(spark, sf).select(
        "table_id", render_markdown(F.get("header", F.lit(0)), F.col("body")).alias("markdown")
    )


@query("extract_nations_per_region", """
SELECT r_name, count(*) AS n_nations, CAST(sum(n_nationkey) AS BIGINT) AS key_sum
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nations_per_region(spark, sf):
    """Nations written as a page each, their tables extracted, stored as JSON rows, aggregated."""
    from ..functions.jsonpath import field, number
    from ..operators.clean import name_columns, normalize_missing
    from ..operators.profile import profile_grids
    from ..plans.ingest import stored_rows

    n = fx.read(spark, sf, "nation").join(
        fx.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    pages = n.select(
        fx.text("n_nationkey").alias("doc_id"),
        F.concat(F.lit("atlas/"), F.col("n_name"), F.lit(".html")).alias("source_file"),
        F.concat(
            F.lit("<h1>Atlas</h1>"),
            render_html(
                fx.strings(["key", "nation", "region"]),
                F.array(F.array(fx.text("n_nationkey"), F.col("n_name"), F.col("r_name"))),
            ),
        ).alias("html"),
    )
    profiled = profile_grids(name_columns(normalize_missing(tables(extract_pages(pages)))))
    rows = stored_rows(profiled, F.lit(None).cast("timestamp"))
    return rows.groupBy(field("region").alias("r_name")).agg(
        F.count(F.lit(1)).alias("n_nations"),
        F.sum(number("key", type_="bigint")).alias("key_sum"),
    )


@query("s1_directory_scan", "WITH " + fx.CUSTOMER_SQL + "SELECT v0 AS c0, v1 AS c1, v2 AS c2, v3 AS c3, v4 AS c4 FROM cust")
def directory_scan(spark, sf):
    """The pages written to files (several pages a file), the folder scanned and extracted."""
    from ..sources.extract import extract_files, file_documents, scan_directory
    from .catalog import shared_folder

    folder = shared_folder(spark, "s1")
    (
        fx.customer_pages(spark, sf).select("html").write.option("maxRecordsPerFile", 50)
        .option("extension", "htm").option("quote", "").option("escape", "").option("sep", "\x01").csv(folder)
    )
    found = tables(extract_files(file_documents(scan_directory(spark, folder))))
    return explode_rows(found).select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(5)])


@query("s6_workbook_sheets", "WITH " + fx.CUSTOMER_SQL + """
SELECT 'customers_' || blk || '_Customers' AS table_id, CAST(row_index AS BIGINT) AS row_index, v0 AS c0, v1 AS c1, nullif(v3, '') AS c2
FROM (SELECT blk, row_index, v0, v1, CASE WHEN v3 = '' THEN '' ELSE v3 END AS v3 FROM cust)
UNION ALL SELECT 'customers_' || blk || '_Balances', row_index, v0, NULL, nullif(v3, '') FROM cust""")
def workbook_sheets(spark, sf):
    """Every sheet with data of every workbook; missing cells are NULL."""
    from ..sources.extract import extract_files

    found = tables(extract_files(fx.customer_workbooks(spark, sf)))
    rows = explode_rows(found, "ordinal")
    at = F.when(F.col("ordinal") == 1, 3).otherwise(2)
    return rows.select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"), F.get("cells", F.lit(0)).alias("c0"),
        F.get("cells", F.lit(1)).alias("c1"), F.nullif(F.get("cells", at), F.lit("")).alias("c2"),
    )


@query("s7_sheet_names", """
SELECT 'crm/customers_' || blk || '.XLSX' AS source_file, CAST(p AS BIGINT) AS sheet_pos, n AS sheet_name
FROM (SELECT DISTINCT c_custkey // 20 AS blk FROM customer), (VALUES (0, 'Customers'), (1, 'Empty'), (2, 'Balances')) v(p, n)""")
def sheet_names(spark, sf):
    from ..sources.extract import list_sheets

    return list_sheets(fx.customer_workbooks(spark, sf))


@query("s8_one_sheet", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id AS block, 'key, Column_2, balance' AS column_names, CAST(row_index AS BIGINT) AS row_index, v0 AS key, nullif(v3, '') AS balance FROM cust""")
def one_sheet(spark, sf):
    from ..operators.clean import name_blank_headers
    from ..sources.extract import extract_sheet

    found = name_blank_headers(tables(extract_sheet(fx.customer_workbooks(spark, sf), "Balances")))
    return explode_rows(found, "header").select(
        F.concat(F.lit("customer_"), F.col("doc_id")).alias("block"),
        F.array_join(F.get("header", F.lit(0)), ", ").alias("column_names"),
        F.col("row_index").cast("bigint").alias("row_index"), F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(2)).alias("balance"),
    )


@query("s16_built_pages", """
SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'Segment ' || c_mktsegment || ' & more' || chr(10) || chr(10) || '- nation ' || c_nationkey || chr(10)
  || '- key ' || c_custkey || chr(10) || chr(10) || '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| nation | ' || c_nationkey || ' |' || chr(10) || chr(10)
  || '## End' || chr(10) || chr(10) || 'Bye.' AS text FROM customer""")
def built_pages(spark, sf):
    """The whole markdown of pages with headings, paragraphs, a list, a table, scripts and hidden parts."""
    page = F.concat(
        F.lit("<html><head><title>x</title><script>'<p>no</p>'</script></head><body><h1>"), "c_name", F.lit("</h1><p>Segment\n <b>"), "c_mktsegment",
        F.lit("</b> &amp; more</p><ul><li>nation "), fx.text("c_nationkey"), F.lit("</li><li>key "), fx.text("c_custkey"),
        F.lit("</ul><table data-x=a<b><tr><th>k</th><th>v</th></tr><tr><td width=5\">nation</td><td><div style='display:none'><div>x</div>y</div>"),
        fx.text("c_nationkey"), F.lit("</td></tr></table><h2>End</h2><p>Bye.</body></html>"))
    documents = fx.spread(fx.read(spark, sf, "customer"), "c_custkey").select(fx.text("c_custkey").alias("doc_id"), F.lit("built.html").alias("source_file"), page.alias("html"))
    return pages_to_markdown(documents).select(F.col("doc_id").cast("bigint").alias("c_custkey"), "text")


@query("s4_odd_markup", """
SELECT s_suppkey, 'k' || s_suppkey AS a, s_name AS b, CAST(s_nationkey AS VARCHAR) AS c FROM supplier""")
def odd_markup(spark, sf):
    """Cells behind stray quotes, apostrophes, angle brackets in values, hidden and unclosed elements."""
    page = F.concat(
        F.lit("<table data-x=a<b><tr><td width=5\">k"), fx.text("s_suppkey"), F.lit("<td title=it's>"), "s_name",
        F.lit("<td><div style=\"display:none\"><div>x</div>y</div>"), fx.text("s_nationkey"))
    documents = fx.spread(fx.read(spark, sf, "supplier"), "s_suppkey").select(fx.text("s_suppkey").alias("doc_id"), F.lit("odd.html").alias("source_file"), page.alias("html"))
    row = F.get("body", F.lit(0))
    return extract_pages(documents).select(
        F.col("doc_id").cast("bigint").alias("s_suppkey"), *[F.get(row, F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("s16_markdown_counts", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<h1')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(html, '<li')) AS INTEGER) AS items,
  false AS scripts FROM pages""")
def markdown_counts(spark, sf):
    """Headings and list items of each page found again in its markdown, and no script."""
    done = page_markdown(spark, sf)
    lines = F.split("text", "\n")
    return done.select(
        F.col("doc_id").cast("bigint").alias("page_id"),
        F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("# ")))).alias("headings"),
        F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("- ")))).alias("items"),
        F.contains("text", F.lit("track(")).alias("scripts"),
    )


@query("u1_registered_format", """
SELECT 'note_' || s_suppkey || '_pairs' AS table_id, CAST(i AS BIGINT) AS row_index, CASE i WHEN 0 THEN 'name' ELSE 'nation' END AS key,
  CASE i WHEN 0 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS value
FROM supplier, (VALUES (0), (1)) v(i)""")
def registered_format(spark, sf):
    """A user's parser for files of ``key=value`` lines, beside the formats that are there."""
    from ..sources.extract import DEFAULT_FORMATS, extract_files
    from ..sources.html_tables import ParsedTable

    def parse(content):
        lines = content.decode().splitlines()
        return [ParsedTable("pairs", None, [["key", "value"]], [x.split("=", 1) for x in lines])]

    files = fx.spread(fx.read(spark, sf, "supplier"), "s_suppkey").select(
        fx.text("s_suppkey").alias("doc_id"),
        F.concat(F.lit("notes/note_"), fx.text("s_suppkey"), F.lit(".kv")).alias("source_file"),
        F.concat(F.lit("name="), F.col("s_name"), F.lit("\nnation="), fx.text("s_nationkey")).cast("binary").alias("content"),
    )
    found = tables(extract_files(files, DEFAULT_FORMATS.register("pairs", [".kv"], parse)))
    return explode_rows(found).select(
        "table_id", F.col("row_index").cast("bigint").alias("row_index"), F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("value")
    )
