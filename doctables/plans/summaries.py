"""Summaries of the catalog from partial aggregates that each write stores.

Per write there are a row per table with its number of stored rows, and totals per source and type of the file. Sums are
added over writes, and what later writes have replaced is taken off again, so a summary reads a few rows per write and
the tables of replaced documents, never the stored rows.

Layout: ``<folder>/{tables,totals}/ingest_seq=<n>``, totals last. A repeated write replaces its own folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, without_versions

TABLES_SCHEMA = "doc_id string, ordinal int, table_id string, source_file string, table_type string, actual_rows bigint, ingest_seq bigint"
TOTALS_SCHEMA = "source_file string, table_type string, tables bigint, actual_rows bigint, ingest_seq bigint"
_BY = ["source_file", "table_type"]


def _totals(tables: DataFrame) -> DataFrame:
    return tables.groupBy(*_BY).agg(F.count(F.lit(1)).alias("tables"), F.sum("actual_rows").alias("actual_rows"))


class StoredSummaries:
    """The aggregates under one folder. Versions (doc_id, ingest_seq) that later writes replaced are given to each read, as
    ``catalog.superseded_versions`` lists them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, dataset: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{dataset}"
        if not Catalog(self.spark, self.folder)._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def add(self, tables: DataFrame, table_data: DataFrame, ingest_seq: int) -> None:
        """Aggregate one write, by its own rows: combined map-side, so a table of most rows gathers nowhere."""
        at = f"ingest_seq={ingest_seq}"
        counts = table_data.groupBy("doc_id", "ordinal").agg(F.count(F.lit(1)).alias("_n"))
        per_table = tables.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "table_id", "source_file", "table_type").join(
            counts, ["doc_id", "ordinal"], "left").withColumn("actual_rows", F.coalesce("_n", F.lit(0).cast("bigint"))).drop("_n")
        per_table.write.mode("overwrite").parquet(f"{self.folder}/tables/{at}")
        stored = self._read("tables", TABLES_SCHEMA).filter(F.col("ingest_seq") == ingest_seq)
        _totals(stored).write.mode("overwrite").parquet(f"{self.folder}/totals/{at}")

    def totals(self, superseded: DataFrame) -> DataFrame:
        """Current tables and stored rows per source and type."""
        gone = _totals(self._read("tables", TABLES_SCHEMA).join(superseded, ["doc_id", "ingest_seq"], "left_semi"))
        less = gone.select(*_BY, (-F.col("tables")).alias("tables"), (-F.col("actual_rows")).alias("actual_rows"))
        summed = self._read("totals", TOTALS_SCHEMA).drop("ingest_seq").unionByName(less).groupBy(*_BY).agg(
            F.sum("tables").alias("tables"), F.sum("actual_rows").alias("actual_rows"))
        return summed.filter("tables > 0")

    def tables_by_type(self, superseded: DataFrame) -> DataFrame:
        return self.totals(superseded).groupBy("table_type").agg(F.sum("tables").alias("n"))

    def store_summary(self, superseded: DataFrame) -> DataFrame:
        """Tables, stored rows and distinct sources: one row. A null source is none, as in a distinct count."""
        nothing = F.lit(0).cast("bigint")
        return self.totals(superseded).agg(
            F.coalesce(F.sum("tables"), nothing).alias("total_tables"), F.coalesce(F.sum("actual_rows"), nothing).alias("total_rows"),
            F.count_distinct("source_file").alias("unique_source_files"))

    def source_totals(self, superseded: DataFrame) -> DataFrame:
        return self.totals(superseded).groupBy("source_file").agg(F.sum("tables").alias("tables"), F.sum("actual_rows").alias("actual_rows"))

    def actual_rows(self, superseded: DataFrame) -> DataFrame:
        """Every current table with the number of its stored rows."""
        return without_versions(superseded, self._read("tables", TABLES_SCHEMA))
