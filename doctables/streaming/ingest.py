"""Continuous ingest with Structured Streaming; a micro-batch is a batch ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.catalog import Catalog
from ..plans.ingest import ingest
from ..sources.extract import (
    DEFAULT_FORMATS,
    Formats,
    extract_pages,
    file_glob,
    page_documents,
)

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, directory: str, max_files_per_batch: int = 10_000,
                 formats: Formats = DEFAULT_FORMATS) -> DataFrame:
    """New files of a directory as they arrive."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", file_glob(formats))
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_batch)
        .load(directory)
    )


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """New rows of a Parquet table (a folder, or a glob of files)."""
    return spark.readStream.schema(schema).parquet(path)


def ingest_stream(
    documents: DataFrame,
    catalog: Catalog,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame] = lambda d: extract_pages(page_documents(d)),
    created_at: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Documents to catalog, one write per micro-batch. Its number is claimed for (stream, batch), so a
    batch that is run again after a failure replaces its own folders and no other write, and every
    document is stored exactly once."""
    stamp = created_at if created_at is not None else F.current_timestamp()

    def store(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]  # its lasting id
        ingest(extract(batch), catalog, stamp, run=f"{stream}/{batch_id}", ingest_seq=catalog.claim(f"{stream}/{batch_id}"))

    return (
        documents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def count_stream(tables: DataFrame, target: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Tables per source, kept up to date in a Parquet folder (complete mode)."""
    counts = tables.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return (
        counts.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
