"""Type votes, shapes, schema records and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import types
from ..operators import describe, profile
from ..sources.grids import explode_rows
from . import fixtures as fx
from .registry import query


@query("p1_predicates", """
WITH v AS (
  SELECT event_id, unnest([CAST(value AS VARCHAR), CAST(event_id AS VARCHAR), ' +' || event_id || ' ', event_id || '_000',
    event_id || 'e3', event_type, CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'oFF' END, CAST(event_id % 3 AS VARCHAR), '.' || event_id, '-inf', '1__0']) AS v,
    generate_subscripts([1,2,3,4,5,6,7,8,9,10,11], 1) AS i FROM events)
SELECT event_id, CAST(i - 1 AS INTEGER) AS i, regexp_full_match(v, '\\s*[+-]?[0-9]+(_[0-9]+)*\\s*') AS is_integer,
  regexp_full_match(lower(v), '\\s*[+-]?(([0-9]+(\\.[0-9]*)?|\\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\\s*') AS is_float,
  lower(v) IN ('true','false','yes','no','on','off','1','0') AS is_boolean
FROM v""")
def predicates(spark, sf):
    e = fx.read(spark, sf, "events")
    k = F.col("event_id")
    s = fx.text("event_id")
    values = F.array(
        fx.text("value"), s, F.concat(F.lit(" +"), s, F.lit(" ")), F.concat(s, F.lit("_000")),
        F.concat(s, F.lit("e3")), F.col("event_type"), F.when(k % 2 == 0, "Yes").otherwise("oFF"),
        (k % 3).cast("string"), F.concat(F.lit("."), s), F.lit("-inf"), F.lit("1__0"),
    )
    v = F.col("v")
    return e.select("event_id", F.posexplode(values).alias("i", "v")).select(
        "event_id", "i", types.is_integer(v).alias("is_integer"),
        types.is_float(v).alias("is_float"), types.is_boolean(v).alias("is_boolean"),
    )


@query("p2_p3_column_types", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, CAST(position AS INTEGER) AS position, name, storage, label FROM cols""")
def column_types(spark, sf):
    profiled = fx.customer_profiled(spark, sf)
    return profiled.select(
        "table_id", F.posexplode(F.arrays_zip("columns", "storage", "labels")).alias("position", "c")
    ).select(
        "table_id", "position", F.col("c.columns").alias("name"), F.col("c.storage").alias("storage"),
        F.col("c.labels").alias("label"),
    )


_EVENT_CELLS = """
WITH c AS (
  SELECT event_type AS table_id, unnest(['id', 'user', 'value', 'props', 'mostly', 'flag', 'dash', 'gap']) AS name,
    unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), CAST(value AS VARCHAR), props,
      CASE WHEN event_id % 10 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END,
      CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'Off' END, '-',
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END]) AS value
  FROM events),
v AS (
  SELECT table_id, name, count(*) AS n_cells, count(*) - count(value) AS miss,
    count(*) FILTER (WHERE value = '-') AS dash,
    count(*) FILTER (WHERE regexp_full_match(value, '[0-9]+')) AS ints,
    count(*) FILTER (WHERE regexp_full_match(value, '[0-9]+(\\.[0-9]+)?')) AS nums,
    count(*) FILTER (WHERE lower(value) IN ('true','false','yes','no','on','off','1','0')) AS bools
  FROM c GROUP BY ALL)
"""


@query("p2_column_types_large", _EVENT_CELLS + """
SELECT table_id, name, n_cells,
  CASE WHEN ints = n_cells THEN 'int64' WHEN nums + miss = n_cells THEN 'float64' ELSE 'object' END AS storage,
  CASE WHEN ints = n_cells THEN 'integer' WHEN nums + miss = n_cells THEN 'float' WHEN dash = n_cells THEN 'string'
    WHEN ints > 0.8 * (n_cells - dash) THEN 'integer' WHEN nums + miss > 0.8 * (n_cells - dash) THEN 'float'
    WHEN bools > 0.8 * (n_cells - dash) THEN 'boolean' ELSE 'string' END AS label
FROM v""")
def column_types_large(spark, sf):
    """Few tables that hold all events: one aggregation over the cells, combined map-side."""
    return profile.profile_cells(_event_cells(spark, sf), ["table_id", "name"])


@query("p2_missing_not_float", _EVENT_CELLS + """
SELECT table_id, name, CASE WHEN n_cells = dash + miss THEN 'string'
    WHEN nums + miss = n_cells AND nums > ints THEN 'float'
    WHEN ints > 0.8 * (n_cells - dash - miss) THEN 'integer' WHEN nums > 0.8 * (n_cells - dash - miss) THEN 'float'
    WHEN bools > 0.8 * (n_cells - dash - miss) THEN 'boolean' ELSE 'string' END AS label
FROM v""")
def missing_not_float(spark, sf):
    done = profile.profile_cells(
        _event_cells(spark, sf), ["table_id", "name"], missing_counts_as_float=False
    )
    return done.select("table_id", "name", "label")


def _event_cells(spark, sf):
    k = F.col("event_id")
    e = fx.read(spark, sf, "events").select(
        "event_type", k.alias("id"), F.col("user_id").alias("user"), "value", "props",
        F.when(k % 10 == 0, "x").otherwise(k.cast("string")).alias("mostly"),
        F.when(k % 2 == 0, "on").otherwise("Off").alias("flag"), F.lit("-").alias("dash"),
        F.when(k % 4 != 0, fx.text("user_id")).alias("gap"),
    )
    names = ["id", "user", "value", "props", "mostly", "flag", "dash", "gap"]
    return profile.unpivot_cells(e, F.col("event_type"), names)


@query("p2_lineitem_types", """
WITH c AS (
  SELECT unnest(['l_orderkey', 'l_quantity', 'l_discount', 'l_returnflag', 'l_shipdate']) AS name,
    unnest([CAST(l_orderkey AS VARCHAR), CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), l_returnflag,
      CAST(l_shipdate AS VARCHAR)]) AS value FROM lineitem),
v AS (
  SELECT name, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(value, '-?[0-9]+')) AS ints,
    count(*) FILTER (WHERE regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?')) AS nums
  FROM c GROUP BY name)
SELECT name, CASE WHEN ints = n THEN 'integer' WHEN nums = n THEN 'float' WHEN ints > 0.8 * n THEN 'integer'
  WHEN nums > 0.8 * n THEN 'float' ELSE 'string' END AS label FROM v""")
def lineitem_types(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    names = ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"]
    cells = profile.unpivot_cells(li, F.lit("lineitem"), names)
    return profile.profile_cells(cells, ["name"]).select("name", "label")


@query("p4_shapes", "WITH " + fx.CUSTOMER_SQL + "SELECT table_id, n_rows, n_cols FROM shape")
def shapes(spark, sf):
    return profile.table_shapes(explode_rows(fx.customer_grids(spark, sf)))


@query("p5_schema_records", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, n_rows, n_cols, false AS has_multi_index, column_names, labels, true AS ok
FROM shape JOIN listed USING (table_id)""")
def schema_records(spark, sf):
    return fx.customer_records(spark, sf).select(
        "table_id", "n_rows", "n_cols", "has_multi_index",
        F.array_join("columns", ", ").alias("column_names"),
        F.array_join(F.transform("columns", lambda c: F.element_at("dtypes", c)), ", ").alias("labels"),
        "ok",
    )


@query("p6_schema_counts", """
SELECT CAST(c_custkey // 20 AS VARCHAR) AS doc_id, count(*) AS total_schemas, count(*) AS successful_schemas
FROM customer GROUP BY 1""")
def schema_counts(spark, sf):
    """Schemas of pages with one table per customer."""
    from ..operators.clean import name_columns, normalize_missing
    from ..sources.extract import extract_pages
    from ..sources.grids import tables
    from .sources import _many_tables

    found = tables(extract_pages(_many_tables(spark, sf)))
    profiled = profile.profile_grids(name_columns(normalize_missing(found)))
    return profile.schema_counts(profile.schema_records(profiled)).drop("source_file")


@query("p7_sample_rows", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, CAST(row_index AS INTEGER) AS row_index, v0, v1, v2, v3, v4 FROM cust WHERE row_index < 5""")
def sample_rows(spark, sf):
    return profile.sample_rows(fx.customer_grids(spark, sf)).select(
        "table_id", "row_index", *[F.get("cells", F.lit(i)).alias(f"v{i}") for i in range(5)]
    )


@query("p8_schema_summary", "WITH " + fx.CUSTOMER_SQL + """
SELECT doc_id, table_id, CAST(1 AS INTEGER) AS ordinal, 'Table 1:' || chr(10) || '  Shape: ' || n_rows || ' rows × 5 columns' || chr(10)
  || '  Columns:' || chr(10) || summary_lines AS summary
FROM shape JOIN listed USING (table_id)""")
def schema_summary(spark, sf):
    return profile.schema_summary(fx.customer_records(spark, sf))


_SAMPLE_SQL = """,
literal AS (
  SELECT c.table_id, c.row_index, string_agg('"' || c.name || '": ' ||
      CASE WHEN c.value IS NULL THEN 'null' WHEN k.storage = 'int64' THEN CAST(CAST(c.value AS BIGINT) AS VARCHAR)
           WHEN k.storage = 'float64' THEN CAST(CAST(c.value AS DOUBLE) AS VARCHAR)
           ELSE '"' || c.value || '"' END, ', ' ORDER BY c.position) AS fields
  FROM cells c JOIN cols k USING (table_id, position) GROUP BY ALL)
"""


@query("d1_description_prompts", "WITH " + fx.CUSTOMER_SQL + _SAMPLE_SQL + """,
samples AS (
  SELECT table_id, string_agg('Row ' || (row_index + 1) || ': {' || fields || '}' || chr(10), '' ORDER BY row_index) AS lines
  FROM literal WHERE row_index < 3 GROUP BY table_id)
SELECT doc_id, table_id,
  'Describe in two to four sentences what this table holds and what it is for. It was found in a customer document.' || chr(10) || chr(10)
  || 'Table ID: 1' || chr(10) || 'Dimensions: ' || n_rows || ' rows × ' || n_cols || ' columns' || chr(10)
  || 'Column Names: ' || column_names || chr(10) || 'Column Types:' || chr(10) || type_lines
  || 'Sample Data (first few rows):' || chr(10) || lines || chr(10) || 'Description:' AS prompt
FROM shape JOIN listed USING (table_id) JOIN samples USING (table_id)""")
def description_prompts(spark, sf):
    return describe.description_prompts(fx.customer_records(spark, sf), "customer").select(
        "doc_id", "table_id", "prompt"
    )


@query("d1_prompts_all_rows", "WITH " + fx.CUSTOMER_SQL + _SAMPLE_SQL + """,
samples AS (
  SELECT table_id, string_agg('Row ' || (row_index + 1) || ': {' || fields || '}' || chr(10), '' ORDER BY row_index) AS lines
  FROM literal GROUP BY table_id)
SELECT doc_id, table_id,
  'Describe in two to four sentences what this table holds and what it is for.' || chr(10) || chr(10)
  || 'Table ID: 1' || chr(10) || 'Dimensions: ' || n_rows || ' rows × ' || n_cols || ' columns' || chr(10)
  || 'Column Names: ' || column_names || chr(10) || 'Column Types:' || chr(10) || type_lines
  || 'Sample Data (first few rows):' || chr(10) || lines || chr(10) || 'Description:' AS prompt
FROM shape JOIN listed USING (table_id) JOIN samples USING (table_id)""")
def prompts_all_rows(spark, sf):
    """Prompts that show every row of their table."""
    records = profile.schema_records(fx.customer_profiled(spark, sf), sample_rows=None)
    return describe.description_prompts(records, sample_rows=None).select("doc_id", "table_id", "prompt")


def _echo(prompts):
    """A deterministic generator: some replies are blank and one batch entry raises."""
    out = []
    for p in prompts:
        rows = int(p.split("Dimensions: ")[1].split(" ")[0])
        key = p.split('"c_custkey": ')[1].split(",")[0]
        out.append(" " if int(key) % 3 == 0 else f" {rows} customers from key {key} ")
    return out


@query("d2_describe", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, CASE WHEN (blk * 20) % 3 = 0 THEN 'Failed to generate description: Empty response'
    ELSE n_rows || ' customers from key ' || (blk * 20) END AS description,
  CASE WHEN (blk * 20) % 3 = 0 THEN 'error' ELSE 'success' END AS status
FROM shape""")
def describe_tables(spark, sf):
    prompts = describe.description_prompts(fx.customer_records(spark, sf))
    return describe.describe_with(prompts, _echo).select("table_id", "description", "status")


@query("d3_template_descriptions", "WITH " + fx.CUSTOMER_SQL + """
SELECT doc_id, source_file, CAST(1 AS INTEGER) AS ordinal, table_id, description, 'success' AS status FROM shape""")
def template_descriptions(spark, sf):
    return describe.template_descriptions(fx.customer_records(spark, sf))


@query("d3_template_names", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, 'Table with ' || n_rows || ' rows and 5 columns. Columns: c_custkey, c_name....' AS two,
  'Table with ' || n_rows || ' rows and 5 columns. Columns: ' || column_names || '.' AS every FROM shape JOIN listed USING (table_id)""")
def template_names(spark, sf):
    """Template descriptions with two names, and with all."""
    records = fx.customer_records(spark, sf)
    return records.select("table_id", describe.template_text(2).alias("two"), describe.template_text(None).alias("every"))


@query("d4_failed_descriptions", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, CASE WHEN (blk * 20) % 3 = 0 THEN 'Table 1: A table with ' || n_rows || ' rows and 5 columns. Failed to generate detailed description.'
    ELSE n_rows || ' customers from key ' || (blk * 20) END AS description
FROM shape""")
def failed_descriptions(spark, sf):
    prompts = describe.description_prompts(fx.customer_records(spark, sf))
    done = describe.describe_with(prompts, _echo)
    return describe.fill_failed_descriptions(done).select("table_id", "description")


@query("d5_description_report", "WITH " + fx.CUSTOMER_SQL + """
SELECT source_file, CAST(0 AS INTEGER) AS block, '' AS table_id, 'TABLE SUMMARY REPORT' || chr(10) || repeat('=', 50) || chr(10) || chr(10)
  || 'Total Tables: ' || count(*) || chr(10) || 'Successfully Described: ' || count(*) || chr(10) || 'Failed: 0' || chr(10) AS text
FROM shape GROUP BY source_file
UNION ALL
SELECT source_file, 1, table_id, 'TABLE 1 (SUCCESS)' || chr(10) || repeat('-', 30) || chr(10) || description || chr(10) FROM shape""")
def description_report(spark, sf):
    done = describe.template_descriptions(fx.customer_records(spark, sf))
    return describe.description_report(done)


@query("t1_date_label", """
WITH c AS (
  SELECT unnest(['o_orderkey', 'o_orderdate', 'o_orderpriority']) AS name,
    unnest([CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y/%m/%d'), o_orderpriority]) AS value FROM orders)
SELECT name, CASE WHEN count(*) FILTER (WHERE regexp_full_match(value, '[0-9]+')) > 0.8 * count(*) THEN 'integer'
  WHEN count(TRY_CAST(replace(value, '/', '-') AS DATE)) > 0.8 * count(*) THEN 'date' ELSE 'string' END AS label
FROM c GROUP BY name""")
def date_label(spark, sf):
    o = fx.read(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("o_orderdate"), "o_orderpriority"
    )
    cells = profile.unpivot_cells(o, F.lit("orders"), o.columns)
    return profile.profile_cells(cells, ["name"], dates=True).select("name", "label")
