"""Documents, grids, markdown texts and catalogs made from the test tables, and the same things
in SQL. Everything derives from whole tables and grows with them. Rows are grouped into one
document only by ranges of a unique key, so a document is small at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators.clean import name_columns, normalize_missing
from ..operators.markdown import render_html
from ..operators.profile import profile_grids, schema_records
from ..plans.ingest import stored_rows, stored_tables
from ..sources.grids import grid_from_columns

CUSTOMERS_PER_TABLE = 20
PARTS_PER_SHEET = 25
#: So many tasks a core, so that a slow one holds up little.
SPREAD_TASKS = 3

CUSTOMER_HEADER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SHEET_HEADER = ["p_partkey", "p_name", "", "Unnamed: 3", "p_size"]



def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a unique key, where Python works on each far longer than it takes to read it: a narrow
    table is few splits however many rows it has."""
    return df.repartition(SPREAD_TASKS * df.sparkSession.sparkContext.defaultParallelism, key)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text(c: str) -> Column:
    return F.col(c).cast("string")


# ------------------------------------------------------------------ customer tables


def customer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per 20 consecutive customer keys: its cells, some missing or of other types."""
    k = F.col("c_custkey")
    blk = F.floor(k / CUSTOMERS_PER_TABLE)
    cells = F.array(
        text("c_custkey"),
        F.col("c_name"),
        F.when((blk % 4 == 2) & (k % 5 == 0), "n/a").otherwise(text("c_nationkey")),
        F.when((blk % 4 == 0) & (k % 5 == 0), "")
        .when((blk % 4 == 1) & (k % 3 == 0), "-")
        .otherwise(F.format_number("c_acctbal", 2)),
        F.when(blk % 4 == 3, F.when(k % 2 == 0, "yes").otherwise("no")).otherwise(F.col("c_mktsegment")),
    )
    return (
        read(spark, sf, "customer")
        .select(blk.alias("blk"), F.struct(k.alias("k"), cells.alias("cells")).alias("r"))
        .groupBy("blk")
        .agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("body"))
    )


def customer_source(blk: Column) -> Column:
    return F.concat(F.lit("crm/segment_"), (blk % 7).cast("string"), F.lit(".html"))


def customer_grids(spark: SparkSession, sf: str) -> DataFrame:
    blocks = customer_blocks(spark, sf).withColumn("doc_id", text("blk"))
    return grid_from_columns(
        blocks,
        F.concat(F.lit("customer_"), text("blk")),
        F.lit(1),
        F.array(strings(CUSTOMER_HEADER)),
        F.col("body"),
        source_file=customer_source(F.col("blk")),
    )


def customer_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same tables inside HTML pages with prose, script and style around them."""
    return customer_blocks(spark, sf).select(
        text("blk").alias("doc_id"),
        F.concat(F.lit("http://crm.example.com/customer_"), text("blk"), F.lit(".html")).alias("source_file"),
        F.concat(
            F.lit("<!DOCTYPE html><html><head><style>td{margin:0}</style>"
                  "<script>var t='<table><tr><td>no</td></tr></table>';</script></head><body><h1>Block "),
            text("blk"), F.lit("</h1><p>Customers & balances<!-- <table> -->"),
            render_html(strings(CUSTOMER_HEADER), F.col("body")),
            F.lit("<p>End of the block</body></html>"),
        ).alias("html"),
    )


def customer_profiled(spark: SparkSession, sf: str) -> DataFrame:
    return profile_grids(name_columns(normalize_missing(customer_grids(spark, sf))))


def customer_records(spark: SparkSession, sf: str) -> DataFrame:
    return schema_records(customer_profiled(spark, sf))


def created_at(doc_id: str = "doc_id") -> Column:
    """A fixed start plus one minute per block."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col(doc_id).cast("bigint") * 60)


def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    session = F.concat(F.lit("session_"), (F.col("doc_id").cast("bigint") % 7).cast("string"))
    return stored_tables(customer_records(spark, sf), None, created_at(), session)


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored_rows(customer_profiled(spark, sf), created_at())


def catalog_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One session per source of the customer tables."""
    return (
        read(spark, sf, "customer")
        .select(F.floor(F.col("c_custkey") / CUSTOMERS_PER_TABLE).alias("blk"))
        .distinct()
        .groupBy((F.col("blk") % 7).alias("g"))
        .agg(F.count(F.lit(1)).alias("total_tables"))
        .select(
            F.concat(F.lit("session_"), text("g")).alias("session_id"),
            customer_source(F.col("g")).alias("source_file"),
            "total_tables",
            F.col("total_tables").alias("successful_tables"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("g") * 3600).alias("created_at"),
        )
    )


CUSTOMER_SQL = """
cust AS (
  SELECT c_custkey AS k, c_custkey // 20 AS blk, 'customer_' || (c_custkey // 20) AS table_id,
    row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS row_index,
    CAST(c_custkey AS VARCHAR) AS v0, c_name AS v1,
    CASE WHEN (c_custkey // 20) % 4 = 2 AND c_custkey % 5 = 0 THEN 'n/a'
         ELSE CAST(c_nationkey AS VARCHAR) END AS v2,
    CASE WHEN (c_custkey // 20) % 4 = 0 AND c_custkey % 5 = 0 THEN ''
         WHEN (c_custkey // 20) % 4 = 1 AND c_custkey % 3 = 0 THEN '-'
         ELSE format('{:,.2f}', c_acctbal) END AS v3,
    CASE WHEN (c_custkey // 20) % 4 = 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END
         ELSE c_mktsegment END AS v4
  FROM customer),
raw_cells AS (
  SELECT blk, table_id, row_index, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS position,
    unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name,
    unnest([v0, v1, v2, v3, v4]) AS value
  FROM cust),
cells AS (
  SELECT blk, table_id, row_index, position, name,
    CASE WHEN value IN ('', 'n/a') THEN NULL
         WHEN regexp_full_match(value, '[-+]?\\d{1,3}(,\\d{3})*(\\.\\d+)?') THEN replace(value, ',', '')
         ELSE value END AS value
  FROM raw_cells),
votes AS (
  SELECT blk, table_id, position, name, count(*) AS n, count(*) - count(value) AS n_missing,
    count(*) FILTER (WHERE value = '-') AS n_dash,
    count(*) FILTER (WHERE regexp_full_match(value, '[-+]?\\d+')) AS n_int,
    count(*) FILTER (WHERE regexp_full_match(value, '[-+]?\\d+(\\.\\d+)?')) AS n_num,
    count(*) FILTER (WHERE lower(value) IN ('true','false','yes','no','on','off','1','0')) AS n_bool
  FROM cells GROUP BY ALL),
cols AS (
  SELECT *, CASE WHEN storage = 'int64' THEN 'integer' WHEN storage = 'float64' THEN 'float'
      WHEN n = n_dash THEN 'string'
      WHEN n_int > 0.8 * (n - n_dash) THEN 'integer'
      WHEN n_num + n_missing > 0.8 * (n - n_dash) THEN 'float'
      WHEN n_bool > 0.8 * (n - n_dash) THEN 'boolean' ELSE 'string' END AS label
  FROM (SELECT *, CASE WHEN n_int = n THEN 'int64' WHEN n_num + n_missing = n THEN 'float64'
                  ELSE 'object' END AS storage FROM votes)),
shape AS (
  SELECT blk, table_id, CAST(blk AS VARCHAR) AS doc_id, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols,
    'crm/segment_' || (blk % 7) || '.html' AS source_file,
    epoch_us(TIMESTAMP '2024-01-01') // 1000000 + blk * 60 AS created_s,
    'Table with ' || count(*) || ' rows and 5 columns. Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment.' AS description
  FROM cust GROUP BY blk, table_id),
listed AS (
  SELECT table_id, string_agg(name, ', ' ORDER BY position) AS column_names,
    string_agg(label, ', ' ORDER BY position) AS labels,
    string_agg(name || ' (' || label || ')', ', ' ORDER BY position) AS typed_columns,
    string_agg('    - ' || name || ' (' || label || ')' || chr(10), '' ORDER BY position) AS summary_lines,
    string_agg('- ' || name || ': ' || label || chr(10), '' ORDER BY position) AS type_lines
  FROM cols GROUP BY table_id),
sessions AS (
  SELECT 'session_' || (blk % 7) AS session_id, source_file, count(*) AS total_tables,
    epoch_us(TIMESTAMP '2024-01-01') // 1000000 + (blk % 7) * 3600 AS created_s
  FROM shape GROUP BY blk % 7, source_file)
"""

# ------------------------------------------------------------------ sheets of parts


def part_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of 25 parts with blank rows, a blank column in every other sheet, blank names."""
    k = F.col("p_partkey")
    blk = F.floor(k / PARTS_PER_SHEET)
    nothing = F.lit(None).cast("string")
    cells = F.when(
        k % 7 != 3,
        F.array(
            text("p_partkey"), F.col("p_name"), F.col("p_brand"),
            F.when(blk % 2 == 1, F.concat(F.lit("note "), (k % 3).cast("string"))),
            F.when(k % 4 != 1, text("p_size")),
        ),
    ).otherwise(F.array(*[nothing] * 5))
    sheets = (
        read(spark, sf, "part")
        .select(blk.alias("blk"), F.struct(k.alias("k"), cells.alias("cells")).alias("r"))
        .groupBy("blk")
        .agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("body"))
        .withColumn("doc_id", text("blk"))
    )
    return grid_from_columns(
        sheets,
        F.concat(F.lit("parts_"), text("blk")),
        F.lit(1),
        F.array(strings(SHEET_HEADER)),
        F.col("body"),
        source_file=F.concat(F.lit("parts_"), text("blk"), F.lit(".xlsx")),
    )


SHEET_SQL = """
sheet AS (
  SELECT p_partkey AS k, p_partkey // 25 AS blk, 'parts_' || (p_partkey // 25) AS table_id,
    row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey) - 1 AS row_index,
    CASE WHEN p_partkey % 7 <> 3 THEN CAST(p_partkey AS VARCHAR) END AS v0,
    CASE WHEN p_partkey % 7 <> 3 THEN p_name END AS v1,
    CASE WHEN p_partkey % 7 <> 3 THEN p_brand END AS v2,
    CASE WHEN p_partkey % 7 <> 3 AND (p_partkey // 25) % 2 = 1 THEN 'note ' || (p_partkey % 3) END AS v3,
    CASE WHEN p_partkey % 7 <> 3 AND p_partkey % 4 <> 1 THEN CAST(p_size AS VARCHAR) END AS v4
  FROM part),
sheet_cells AS (
  SELECT blk, table_id, row_index, unnest([0, 1, 2, 3, 4]) AS position,
    unnest(['p_partkey', 'p_name', '', 'Unnamed: 3', 'p_size']) AS name,
    unnest([v0, v1, v2, v3, v4]) AS value
  FROM sheet),
kept_rows AS (
  SELECT table_id, row_index, row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS new_index
  FROM (SELECT table_id, row_index FROM sheet_cells GROUP BY ALL HAVING count(value) > 0)),
kept_cols AS (
  SELECT table_id, position, name,
    row_number() OVER (PARTITION BY table_id ORDER BY position) - 1 AS new_position
  FROM (SELECT table_id, position, name FROM sheet_cells GROUP BY ALL HAVING count(value) > 0))
"""

# ------------------------------------------------------------------ markdown documents


def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document text with one pipe table after it, every other one with a second table."""
    d = F.col("doc_id")
    one = F.concat(
        F.lit("| lang | source | chars |\n|---|---|---|\n| "), F.col("lang"), F.lit(" | "),
        F.col("source"), F.lit(" | "), text("n_chars"), F.lit(" |"),
        F.when(d % 3 == 0, F.lit("\n  | total | | 1 |  \n---\n| end | x | 2 |")).otherwise(""),
    )
    two = F.concat(F.lit("\nBetween two tables.\n| id |\n|:-:|\n| "), text("doc_id"), F.lit(" |"))
    return read(spark, sf, "documents").select(
        text("doc_id").alias("doc_id"),
        F.concat(F.lit("docs/d"), text("doc_id"), F.lit(".html")).alias("source_file"),
        F.concat(
            F.col("text"), F.lit("\n\n"), one, F.when(d % 2 == 0, two).otherwise(""),
            F.lit("\n\nLast words of "), text("doc_id"), F.lit(".\n---\n"),
        ).alias("text"),
    )


def markdown_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """A description of table 1 of every document and of table 2 of every other; every fifth failed."""
    d = F.col("doc_id")
    ordinals = F.when(d % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read(spark, sf, "documents").select("doc_id", F.explode(ordinals).alias("ordinal")).select(
        text("doc_id").alias("doc_id"),
        "ordinal",
        F.concat(F.lit("  Facts "), text("ordinal"), F.lit(" of document "), text("doc_id"), F.lit(". ")).alias("description"),
        F.when((d + F.col("ordinal")) % 5 == 0, "error").otherwise("success").alias("status"),
    )


_W = WHITESPACE
MARKDOWN_SQL = f"""
md AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS d,
    text || chr(10) || chr(10) || '| lang | source | chars |' || chr(10) || '|---|---|---|' || chr(10)
      || '| ' || lang || ' | ' || source || ' | ' || n_chars || ' |'
      || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  | total | | 1 |  ' || chr(10) || '---' || chr(10) || '| end | x | 2 |' ELSE '' END
      || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Between two tables.' || chr(10) || '| id |' || chr(10) || '|:-:|' || chr(10) || '| ' || doc_id || ' |' ELSE '' END
      || chr(10) || chr(10) || 'Last words of ' || doc_id || '.' || chr(10) || '---' || chr(10) AS text
  FROM documents),
line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM md),
flagged AS (
  SELECT doc_id, i, line, trim(line, '{_W}') AS bare,
    starts_with(bare, '|') AND ends_with(bare, '|') AND length(bare) >= 2 AS tl,
    bare <> '' AND translate(bare, '|-:' || '{_W}', '') = '' AS sep
  FROM line),
state AS (
  SELECT *, coalesce(last_value(CASE WHEN tl OR NOT sep THEN tl END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY i), false) AS in_table
  FROM flagged),
numbered AS (
  SELECT *, sum(CASE WHEN in_table IS DISTINCT FROM before THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS chunk
  FROM (SELECT *, lag(in_table) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM state)),
grouped AS (
  SELECT doc_id, chunk, trim(string_agg(line, chr(10) ORDER BY i), '{_W}') AS text
  FROM numbered GROUP BY doc_id, chunk),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INTEGER) AS pos, text
  FROM grouped WHERE text <> ''),
majority AS (
  SELECT doc_id, pos, text,
    len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x, '{_W}'), '|')
        AND ends_with(trim(x, '{_W}'), '|') AND length(trim(x, '{_W}')) >= 2))
      > 0.5 * len(string_split(text, chr(10))) AS is_table
  FROM chunks),
placed AS (
  SELECT *, CASE WHEN is_table THEN row_number() OVER (PARTITION BY doc_id, is_table ORDER BY pos) END AS ordinal
  FROM majority),
described AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, o AS ordinal,
    'Facts ' || o || ' of document ' || doc_id || '.' AS description
  FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS o FROM documents)
  WHERE (doc_id + o) % 5 <> 0),
swapped AS (
  SELECT p.doc_id, p.pos, p.is_table, p.ordinal, p.text AS old_text,
    '**Table ' || p.ordinal || ' Summary:** ' || t.description AS replacement,
    coalesce(replacement, p.text) AS text
  FROM placed p LEFT JOIN described t ON p.doc_id = t.doc_id AND p.ordinal = t.ordinal),
final AS (
  SELECT doc_id, '<!-- This document has been processed with table descriptions -->' || chr(10) || chr(10)
      || string_agg(text, chr(10) || chr(10) ORDER BY pos) AS processed
  FROM swapped GROUP BY doc_id)
"""

# ------------------------------------------------------------------ order rows


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as JSON rows of three stored tables, one per status."""
    return read(spark, sf, "orders").select(
        F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("table_id"),
        F.col("o_orderkey").alias("row_index"),
        F.to_json(
            F.struct(
                F.col("o_orderkey").alias("Order Key"),
                F.col("o_custkey").alias("Customer"),
                F.col("o_totalprice").alias("Total Price"),
                F.col("o_orderpriority").alias("Priority"),
                F.date_format("o_orderdate", "yyyy").alias("Year"),
            )
        ).alias("row_data"),
    )


def order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of these three tables."""
    return (
        read(spark, sf, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("table_id"),
            F.concat(F.lit("shop/"), F.col("o_orderstatus"), F.lit(".html")).alias("source_file"),
            "rows",
            F.lit(5).cast("bigint").alias("columns"),
            strings(["Order Key", "Customer", "Total Price", "Priority", "Year"]).alias("column_names"),
            F.concat(F.lit("Orders with status "), F.col("o_orderstatus"), F.lit(" of the shop")).alias("description"),
        )
    )


ORDER_SQL = """
rows_ AS (
  SELECT 'orders_' || o_orderstatus AS table_id, o_orderkey AS row_index, o_orderkey, o_custkey,
    o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y') AS year, o_orderstatus
  FROM orders),
tables_ AS (
  SELECT 'orders_' || o_orderstatus AS table_id, 'shop/' || o_orderstatus || '.html' AS source_file,
    count(*) AS rows, 'Orders with status ' || o_orderstatus || ' of the shop' AS description
  FROM orders GROUP BY o_orderstatus)
"""

# ------------------------------------------------------------------ replies


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model-like replies made from events: fenced JSON, bare JSON, prose, fenced SQL."""
    e = F.col("event_id")
    return read(spark, sf, "events").select("event_id", "event_type", "value").withColumn(
        "reply",
        F.when(
            e % 4 == 0,
            F.concat(
                F.lit('```json\n{"is_fulfillable": true, "confidence": '), F.round(F.col("value") / 1000, 3).cast("decimal(10,3)").cast("string"),
                F.lit(', "reasoning": "about '), F.col("event_type"), F.lit('", "required_tables": ["t'), (e % 3).cast("string"), F.lit('", "t9"]}\n```'),
            ),
        )
        .when(e % 4 == 1, F.concat(F.lit('  {"is_fulfillable": false, "suggested_approach": "ask '), F.col("event_type"), F.lit('"} ')))
        .when(e % 4 == 2, F.concat(F.lit("Yes, this can be done for "), F.col("event_type")))
        .otherwise(F.concat(F.lit("It is not possible, "), F.col("event_type"), F.lit(" cannot be found"))),
    )


REPLY_SQL = """
r AS (
  SELECT event_id, event_type, value, event_id % 4 AS m FROM events)
"""

# ------------------------------------------------------------------ workbooks

_SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A minimal .xlsx: inline strings, numbers as they are, None left out."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def cell(column: int, row: int, value) -> str:
        at = f'r="{chr(65 + column)}{row}"'
        if isinstance(value, (int, float)):
            return f"<c {at}><v>{value}</v></c>"
        return f'<c {at} t="inlineStr"><is><t>{escape(value)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for n, (_, rows) in enumerate(sheets, 1):
            lines = "".join(
                f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {_SHEET_NS}><sheetData>{lines}</sheetData></worksheet>")
        names = "".join(
            f'<sheet name="{name}" sheetId="{n}" xmlns:r="{_REL_NS}" r:id="r{n}"/>' for n, (name, _) in enumerate(sheets, 1)
        )
        book.writestr("xl/workbook.xml", f"<workbook {_SHEET_NS}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
    return out.getvalue()


def customer_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook per customer block: all its customers, an empty sheet, balances alone."""
    import pyarrow as pa

    def write(batches):
        for batch in batches:
            books = []
            for body in batch.column(1).to_pylist():
                customers = [CUSTOMER_HEADER] + [[int(r[0]), *r[1:]] for r in body]
                balances = [["key", None, "balance"]] + [[int(r[0]), None, r[3] or None] for r in body]
                books.append(_workbook_bytes([("Customers", customers), ("Empty", []), ("Balances", balances)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books, pa.binary())], names=["blk", "content"])

    made = customer_blocks(spark, sf).mapInArrow(write, "blk bigint, content binary")
    return made.select(
        text("blk").alias("doc_id"),
        F.concat(F.lit("crm/customers_"), text("blk"), F.lit(".XLSX")).alias("source_file"),
        "content",
    )
