"""Question batches over the catalog of customer tables; replies made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as a
from . import fixtures as fx
from .registry import query

_BLOCK = """'- Table: ' || table_id || chr(10) || '  Source: ' || source_file || chr(10) || '  Rows: ' || n_rows || ', Columns: ' || n_cols
  || chr(10) || '  Columns: ' || column_names || chr(10) || '  Description: ' || description"""


def _questions(spark, sf):
    """One question per supplier."""
    return fx.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("question_id"),
        F.concat(F.lit("How many rows mention "), F.col("s_name"), F.lit("?")).alias("question"),
    )


@query("n1_table_context", "WITH " + fx.CUSTOMER_SQL + f"SELECT table_id, {_BLOCK} AS text FROM shape JOIN listed USING (table_id)")
def table_context(spark, sf):
    return a.table_context(fx.catalog_tables(spark, sf)).select("table_id", "text")


@query("n1_context_header", """
SELECT 'Available tables in the database:' AS text, false AS empty UNION ALL SELECT 'No tables available in the database.', true""")
def context_header(spark, sf):
    tables = fx.catalog_tables(spark, sf)
    full = a.context_header(tables).withColumn("empty", F.lit(False))
    return full.unionByName(a.context_header(tables.filter("rows < 0")).withColumn("empty", F.lit(True)))


@query("n2_analysis_prompt_parts", "WITH " + fx.CUSTOMER_SQL + f"""
SELECT CAST(NULL AS BIGINT) AS question_id, 'context' AS part, table_id, {_BLOCK} AS text FROM shape JOIN listed USING (table_id)
UNION ALL SELECT NULL, 'opening', NULL, 'Decide whether the question below can be answered from the stored tables.' || chr(10) || chr(10) || 'Available tables in the database:'
UNION ALL SELECT s_suppkey, 'question', NULL, 'User Query: "How many rows mention ' || s_name || '?"' || chr(10) || chr(10)
  || 'Return only a JSON object with the keys is_fulfillable (true/false), confidence (0.0-1.0), reasoning, suggested_approach, required_tables (list of ids).' FROM supplier""")
def analysis_prompts(spark, sf):
    return a.analysis_prompt_parts(_questions(spark, sf), fx.catalog_tables(spark, sf))


@query("n3_sql_prompts", "WITH " + fx.CUSTOMER_SQL + """,
newest AS (SELECT * FROM shape JOIN listed USING (table_id) ORDER BY created_s DESC, table_id LIMIT 5),
ctx AS (
  SELECT string_agg('- table_id: ''' || table_id || '''' || chr(10) || '  source_file: ''' || source_file || '''' || chr(10)
    || '  rows: ' || n_rows || ', columns: ' || n_cols || chr(10) || '  columns: ' || typed_columns, chr(10) ORDER BY created_s DESC) AS t
  FROM newest)
SELECT s_suppkey AS question_id, 'Write one SQL query that answers the question.' || chr(10) || chr(10) || '""" + a.STORED_SCHEMA_TEXT + """'
  || chr(10) || chr(10) || 'Newest tables:' || chr(10) || t || chr(10) || chr(10) || 'User Question: "How many rows mention ' || s_name || '?"' || chr(10)
  || 'Attempt 2: the earlier queries failed. Check table and column names, quoting and letter case.' || chr(10)
  || 'Read fields of row_data as JSON, cast numbers, and return only the query.' AS prompt
FROM supplier, ctx""")
def sql_prompts(spark, sf):
    return a.sql_prompts(_questions(spark, sf), fx.catalog_tables(spark, sf), attempt=2)


@query("n3_sql_prompt_parts", "WITH " + fx.CUSTOMER_SQL + """
SELECT NULL::BIGINT AS question_id, 'opening' AS part, NULL::VARCHAR AS table_id, 'Write one SQL query that answers the question.' || chr(10) || chr(10) || '""" + a.STORED_SCHEMA_TEXT + """'
  || chr(10) || chr(10) || 'Tables:' AS text
UNION ALL SELECT NULL, 'context', table_id, '- table_id: ''' || table_id || '''' || chr(10) || '  source_file: ''' || source_file || '''' || chr(10)
  || '  rows: ' || n_rows || ', columns: ' || n_cols || chr(10) || '  columns: ' || typed_columns FROM shape JOIN listed USING (table_id)
UNION ALL SELECT s_suppkey, 'question', NULL, 'User Question: "How many rows mention ' || s_name || '?"' || chr(10)
  || 'Read fields of row_data as JSON, cast numbers, and return only the query.' FROM supplier""")
def sql_prompt_parts(spark, sf):
    """With all tables of the catalog, whatever their number: each stands once, for all questions."""
    return a.sql_prompts(_questions(spark, sf), fx.catalog_tables(spark, sf), most_tables=None)


@query("n4_parse_analysis", """
SELECT event_id, event_id % 4 < 2 AS from_json, event_id % 4 IN (0, 2) AS is_fulfillable,
  CASE event_id % 4 WHEN 0 THEN CAST(CAST(round(value / 1000, 3) AS DECIMAL(10, 3)) AS DOUBLE) WHEN 1 THEN 0.0 ELSE 0.3 END AS confidence,
  CASE event_id % 4 WHEN 0 THEN 'about ' || event_type WHEN 1 THEN 'No reasoning provided'
    WHEN 2 THEN 'Fallback analysis based on response keywords. Raw response: Yes, this can be done for ' || event_type || '...'
    ELSE 'Fallback analysis based on response keywords. Raw response: It is not possible, ' || event_type || ' cannot be found...' END AS reasoning,
  CASE event_id % 4 WHEN 0 THEN 'No suggestions provided' WHEN 1 THEN 'ask ' || event_type
    ELSE 'Please try rephrasing your query for better analysis.' END AS suggested_approach,
  CASE event_id % 4 WHEN 0 THEN 't' || (event_id % 3) || ',t9' ELSE '' END AS required_tables
FROM events""")
def parse_analysis(spark, sf):
    done = a.parse_analysis(fx.replies(spark, sf))
    return done.select(
        "event_id", "from_json", "is_fulfillable", "confidence", "reasoning", "suggested_approach",
        F.array_join("required_tables", ",").alias("required_tables"),
    )


def _hits(words):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


@query("n5_keyword_analysis", f"""
WITH h AS (SELECT conv_id, turn, {_hits(a.POSITIVE_KEYWORDS)} AS p, {_hits(a.NEGATIVE_KEYWORDS)} AS n, text FROM conversations)
SELECT conv_id, turn, p > n AS is_fulfillable, CASE WHEN p + n > 0 THEN 0.3 ELSE 0.1 END::DOUBLE AS confidence,
  'Fallback analysis based on response keywords. Raw response: ' || substr(text, 1, 200) || '...' AS reasoning FROM h""")
def keyword_analysis(spark, sf):
    done = a.keyword_analysis(fx.read(spark, sf, "conversations"), "text")
    return done.select("conv_id", "turn", "is_fulfillable", "confidence", "reasoning")


@query("n5_whole_replies", f"""
WITH h AS (SELECT doc_id, {_hits(a.POSITIVE_KEYWORDS)} AS p, {_hits(a.NEGATIVE_KEYWORDS)} AS n, text FROM documents)
SELECT doc_id, p > n AS is_fulfillable, 'Fallback analysis based on response keywords. Raw response: ' || text AS reasoning FROM h""")
def whole_replies(spark, sf):
    """Long texts as replies, quoted in full."""
    done = a.keyword_analysis(fx.read(spark, sf, "documents"), "text", quoted=None)
    return done.select("doc_id", "is_fulfillable", "reasoning")


@query("n4_whole_replies", """
SELECT doc_id, false AS from_json, 'Fallback analysis based on response keywords. Raw response: On ' || text || ' end' AS reasoning FROM documents""")
def parsed_whole_replies(spark, sf):
    replies = fx.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("On "), "text", F.lit(" end")).alias("reply"))
    return a.parse_analysis(replies, quoted=None).select("doc_id", "from_json", "reasoning")


@query("n6_extract_sql", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SELECT ' || event_id || ';' WHEN 1 THEN 'select * from t where x = ''' || event_type || ''';'
  WHEN 2 THEN 'WITH a AS (SELECT 1)' || chr(10) || 'SELECT * FROM a;' WHEN 3 THEN NULL ELSE 'SELECTED ' || event_type || ';' END AS sql_query
FROM events""")
def extract_sql(spark, sf):
    k = F.col("event_id")
    replies = fx.read(spark, sf, "events").select(
        "event_id",
        F.when(k % 5 == 0, F.concat(F.lit("```sql\nSELECT "), fx.text("event_id"), F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("select * from t where x = '"), F.col("event_type"), F.lit("';  ")))
        .when(k % 5 == 2, "```\nWITH a AS (SELECT 1)\nSELECT * FROM a;```")
        .when(k % 5 == 3, F.concat(F.lit("I cannot answer for "), F.col("event_type")))
        .otherwise(F.concat(F.lit("\n SELECTED "), F.col("event_type"))).alias("reply"),
    )
    return a.extract_sql(replies).select("event_id", "sql_query")
