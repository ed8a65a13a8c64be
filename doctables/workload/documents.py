"""Splitting, replacing and putting together markdown documents; statistics over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explodable
from ..operators import documents as docs
from ..operators import stats
from . import fixtures as fx
from .registry import query


def _split(spark, sf):
    return docs.split_markdown(fx.markdown_documents(spark, sf))


def _replaced(spark, sf):
    return docs.replace_tables(_split(spark, sf), fx.markdown_descriptions(spark, sf))


def _assembled(spark, sf):
    return docs.assemble(_replaced(spark, sf))


@query("w1_w2_chunks", "WITH " + fx.MARKDOWN_SQL + "SELECT doc_id, pos, text, is_table FROM majority")
def chunks(spark, sf):
    return docs.chunk_rows(_split(spark, sf))


@query("w2_table_positions", "WITH " + fx.MARKDOWN_SQL + """
SELECT doc_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE is_table), '') AS positions
FROM majority GROUP BY doc_id""")
def table_positions(spark, sf):
    return _split(spark, sf).select("doc_id", F.array_join("table_positions", ",").alias("positions"))


@query("w3_w4_replaced_chunks", "WITH " + fx.MARKDOWN_SQL + "SELECT doc_id, pos, text FROM swapped")
def replaced_chunks(spark, sf):
    return _replaced(spark, sf).select("doc_id", F.posexplode(explodable("new_chunks")).alias("pos", "text"))


@query("w5_processed_documents", "WITH " + fx.MARKDOWN_SQL + "SELECT doc_id, processed FROM final")
def processed_documents(spark, sf):
    return _assembled(spark, sf).select("doc_id", "processed")


@query("w6_replacement_totals", "WITH " + fx.MARKDOWN_SQL + """
SELECT doc_id, count(replacement) AS total_replacements, count(replacement) AS successful_replacements,
  count(*) FILTER (WHERE is_table) - count(replacement) AS failed_replacements
FROM swapped GROUP BY doc_id""")
def replacement_totals(spark, sf):
    return docs.replacement_totals(_replaced(spark, sf))


@query("w6_replacement_details", "WITH " + fx.MARKDOWN_SQL + """
SELECT doc_id, pos AS position, CAST(ordinal AS INTEGER) AS table_id, CAST(length(old_text) AS INTEGER) AS original_length,
  CAST(length(replacement) AS INTEGER) AS new_length, 'success' AS status
FROM swapped WHERE replacement IS NOT NULL""")
def replacement_details(spark, sf):
    return docs.replacement_details(_replaced(spark, sf))


@query("w7_replacement_reports", "WITH " + fx.MARKDOWN_SQL + """
SELECT doc_id, 'TABLE REPLACEMENT REPORT' || chr(10) || repeat('=', 40) || chr(10) || chr(10)
  || 'Total Replacements Attempted: ' || count(replacement) || chr(10) || 'Successful Replacements: ' || count(replacement) || chr(10)
  || 'Failed Replacements: ' || (count(*) FILTER (WHERE is_table) - count(replacement)) || chr(10) || chr(10)
  || CASE WHEN count(replacement) > 0 THEN 'REPLACEMENT DETAILS:' || chr(10) || repeat('-', 20) || chr(10)
       || string_agg('Position ' || pos || ' (Table ' || ordinal || '):' || chr(10) || '  Status: success' || chr(10)
            || '  Size change: ' || length(old_text) || ' -> ' || length(replacement) || ' characters' || chr(10)
            || '  Reduction: ' || (length(old_text) - length(replacement)) || ' characters' || chr(10) || chr(10), '' ORDER BY pos)
            FILTER (WHERE replacement IS NOT NULL)
     ELSE '' END AS report
FROM swapped GROUP BY doc_id""")
def replacement_reports(spark, sf):
    return docs.replacement_report(_replaced(spark, sf))


@query("w8_table_references", "WITH " + fx.MARKDOWN_SQL + """,
place AS (
  SELECT doc_id, replacement, ordinal, pos,
    length('<!-- This document has been processed with table descriptions -->') + 2
      + sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - 2 AS start_position
  FROM swapped)
SELECT doc_id, ordinal AS table_id, 'Facts ' || ordinal || ' of document ' || doc_id || '.' AS description,
  CAST(start_position AS BIGINT) AS start_position, CAST(start_position + length(replacement) AS BIGINT) AS end_position,
  CAST(length('Facts ' || ordinal || ' of document ' || doc_id || '.') AS INTEGER) AS length
FROM place WHERE replacement IS NOT NULL""")
def table_references(spark, sf):
    return docs.table_references(_assembled(spark, sf))


@query("st1_document_statistics", "WITH " + fx.MARKDOWN_SQL + """,
s AS (
  SELECT doc_id, count(*) AS chunks, count(replacement) AS done FROM swapped GROUP BY doc_id)
SELECT md.doc_id, CAST(CASE WHEN d % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS html_tables, s.chunks AS markdown_chunks,
  length(md.text) AS markdown_length, CAST(CASE WHEN d % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS total_descriptions,
  (SELECT count(*) FROM described t WHERE t.doc_id = md.doc_id) AS successful_descriptions,
  s.done AS table_replacements, length(final.processed) - length(md.text) AS content_size_change,
  round(100.0 * (SELECT count(*) FROM described t WHERE t.doc_id = md.doc_id) / (CASE WHEN d % 2 = 0 THEN 2 ELSE 1 END), 4) AS description_success_rate,
  CAST(0 AS DOUBLE) AS schema_success_rate
FROM md JOIN s USING (doc_id) JOIN final USING (doc_id)""")
def document_statistics(spark, sf):
    split = _split(spark, sf)
    found = split.select(
        "doc_id", "source_file", F.size("table_positions").alias("tables_found"),
        F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"),
    )
    no_schemas = found.select("doc_id", "source_file", F.lit(0).alias("total_schemas"), F.lit(0).alias("successful_schemas"))
    done = stats.document_statistics(
        _assembled(spark, sf), found, no_schemas, fx.markdown_descriptions(spark, sf)
    )
    return done.select(
        "doc_id", "html_tables", "markdown_chunks", "markdown_length", "total_descriptions",
        "successful_descriptions", "table_replacements", "content_size_change",
        F.round("description_success_rate", 4).alias("description_success_rate"), "schema_success_rate",
    )


@query("st2_batch_statistics", """
WITH b AS (SELECT DISTINCT c_custkey // 20 AS blk FROM customer)
SELECT count(*) AS total_documents, count(*) FILTER (WHERE blk % 3 <> 2) AS successful_documents,
  count(*) FILTER (WHERE blk % 3 = 2) AS failed_documents, round(100.0 * count(*) FILTER (WHERE blk % 3 <> 2) / count(*), 4) AS success_rate
FROM b""")
def batch_statistics(spark, sf):
    from .sources import fault_isolation

    done = stats.batch_statistics(fault_isolation(spark, sf))
    return done.withColumn("success_rate", F.round("success_rate", 4))
