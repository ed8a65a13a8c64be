"""Statistics of a run, per document and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def document_statistics(processed: DataFrame, outcomes: DataFrame, schema_counts: DataFrame,
                        descriptions: DataFrame) -> DataFrame:
    """Per document: tables, chunks, lengths, success rates in %, replacements, size change.

    Every input is first brought to one row per document, so the joins meet on unique keys."""
    described = descriptions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_descriptions"),
        F.count_if(F.col("status") == "success").alias("successful_descriptions"),
    )
    texts = processed.select(
        "doc_id",
        F.size("chunks").cast("bigint").alias("markdown_chunks"),
        F.length("text").cast("bigint").alias("markdown_length"),
        F.size("replacements").cast("bigint").alias("table_replacements"),
        F.length("processed").cast("bigint").alias("processed_content_length"),
    )
    joined = (
        outcomes.select("doc_id", F.col("tables_found").cast("bigint").alias("html_tables"))
        .join(texts, "doc_id", "left")
        .join(schema_counts.drop("source_file"), "doc_id", "left")
        .join(described, "doc_id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    counts = [
        "html_tables", "markdown_chunks", "markdown_length", "total_schemas",
        "successful_schemas", "total_descriptions", "successful_descriptions",
        "table_replacements", "processed_content_length",
    ]
    return joined.select("doc_id", *[zero(c).alias(c) for c in counts]).select(
        "*",
        _rate(F.col("successful_schemas"), F.col("total_schemas")).alias("schema_success_rate"),
        _rate(F.col("successful_descriptions"), F.col("total_descriptions")).alias("description_success_rate"),
        F.col("successful_schemas").alias("stored_tables"),
        (F.col("processed_content_length") - F.col("markdown_length")).alias("content_size_change"),
    )


def batch_statistics(outcomes: DataFrame) -> DataFrame:
    """Documents of a batch: all, successful, failed, rate in %."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if("ok").alias("successful_documents")
    ).select(
        "*",
        (F.col("total_documents") - F.col("successful_documents")).alias("failed_documents"),
        _rate(F.col("successful_documents"), F.col("total_documents")).alias("success_rate"),
    )
