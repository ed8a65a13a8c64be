"""Streaming ingest and counts over whole tables; the result must equal that of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.markdown import render_html
from ..plans.catalog import Catalog, tables_with_actual_rows
from ..sources.extract import extract_pages
from ..streaming.ingest import count_stream, ingest_stream, stream_parquet
from . import fixtures as fx
from .catalog import shared_folder
from .registry import query


def _supplier_pages(suppliers):
    return suppliers.select(
        fx.text("s_suppkey").alias("doc_id"),
        F.concat(F.lit("shop/supplier_"), fx.text("s_suppkey"), F.lit(".html")).alias("source_file"),
        F.concat(
            F.lit("<p>Supplier</p>"),
            render_html(
                fx.strings(["key", "name", "balance"]),
                F.array(F.array(fx.text("s_suppkey"), F.col("s_name"), fx.text("s_acctbal"))),
            ),
        ).alias("html"),
    )


def _stream(spark, sf, name):
    return stream_parquet(spark, f"{sf}/{name}.parquet*", fx.read(spark, sf, name).schema)


@query("i2_stream_ingest", """
SELECT 'supplier_' || s_suppkey || '_table_1' AS table_id, 'shop/supplier_' || s_suppkey || '.html' AS source_file,
  CAST(1 AS BIGINT) AS actual_rows, 'integer, string, float' AS labels FROM supplier
WHERE s_acctbal <> floor(s_acctbal) OR CAST(s_acctbal AS VARCHAR) LIKE '%.0'""")
def stream_ingest(spark, sf):
    """A page per supplier arrives as a stream and is stored by micro-batches."""
    root = shared_folder(spark, "i2")
    catalog = Catalog(spark, root + "/catalog", buckets=8)
    ingest_stream(
        _stream(spark, sf, "supplier"), catalog, root + "/checkpoint",
        extract=lambda batch: extract_pages(_supplier_pages(batch)),
        created_at=F.lit("2024-01-01").cast("timestamp"),
    ).awaitTermination()
    done = tables_with_actual_rows(catalog.tables(), catalog.table_data())
    labels = F.transform("column_names", lambda c: F.element_at("column_types", c))
    return done.select("table_id", "source_file", "actual_rows", F.array_join(labels, ", ").alias("labels"))


@query("i3_stream_counts", "SELECT source AS source_file, count(*) AS n FROM documents GROUP BY 1")
def stream_counts(spark, sf):
    root = shared_folder(spark, "i3")
    tables = _stream(spark, sf, "documents").withColumn("source_file", F.col("source"))
    count_stream(tables, root + "/counts", root + "/checkpoint").awaitTermination()
    return spark.read.parquet(root + "/counts")
