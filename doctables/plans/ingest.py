"""From documents to a catalog: parse once, then projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import keep_rows
from ..operators.clean import name_columns, normalize_missing
from ..operators.describe import template_text
from ..operators.profile import json_keys, profile_grids, row_objects, schema_records
from ..sources.grids import tables
from .catalog import Catalog, document_log, session_log

NO_DESCRIPTION = "No description available"


def profiled_tables(extracted: DataFrame, **options) -> DataFrame:
    """Named, normalised and profiled tables of an extraction: one Python pass, no shuffle."""
    return profile_grids(name_columns(normalize_missing(tables(extracted))), **options)


def stored_tables(records: DataFrame, descriptions: DataFrame | None, created_at: Column,
                  session_id: Column | None = None, table_type: Column | str | None = None) -> DataFrame:
    """Catalog metadata of good schema records; without descriptions, the template texts. The type of a
    table is that of its file unless ``table_type`` says otherwise."""
    if table_type is None:
        is_sheet = F.lower("source_file").rlike(r"\.xlsx?$")
        table_type = F.when(is_sheet, "excel").otherwise("html")
    good = keep_rows(records, F.col("ok"))
    if descriptions is None:
        described = good.withColumn("description", template_text())
    else:
        texts = descriptions.select("doc_id", "ordinal", "description")
        described = good.join(texts, ["doc_id", "ordinal"], "left")
    return described.select(
        "table_id",
        "doc_id",
        "ordinal",
        "source_file",
        (F.lit(table_type) if isinstance(table_type, str) else table_type).alias("table_type"),
        F.col("n_rows").alias("rows"),
        F.col("n_cols").alias("columns"),
        F.col("columns").alias("column_names"),
        F.col("dtypes").alias("column_types"),
        "storage_types",
        F.col("html").alias("html_content"),
        F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("description"),
        (session_id if session_id is not None else F.lit(None).cast("string")).alias("session_id"),
        created_at.alias("created_at"),
    )


def stored_rows(profiled: DataFrame, created_at: Column) -> DataFrame:
    """Catalog rows (one JSON object per body row) of good tables."""
    good = keep_rows(profiled, F.col("ok")).withColumn("_keys", json_keys())
    return good.select(
        "table_id",
        "doc_id",
        "ordinal",
        F.posexplode(row_objects(F.col("body"), F.col("_keys"))).alias("row_index", "row_data"),
        created_at.alias("created_at"),
    )


def ingest(extracted: DataFrame, catalog: Catalog, created_at: Column, run: str,
           ingest_seq: int | None = None, descriptions: DataFrame | None = None, scanned: DataFrame | None = None) -> int:
    """Store all tables of an extraction, and the outcome and session of every document of it.

    What was parsed is written once (under the catalog root) and read back for the outputs, so documents
    are not parsed again for each of them; it is deleted when all are stored."""
    seq = catalog.claim() if ingest_seq is None else ingest_seq
    raw, staged = (f"{catalog.root}/extracted/{kind}-{seq}" for kind in ("raw", "profiled"))
    read = catalog.spark.read.parquet
    extracted.write.mode("overwrite").parquet(raw)
    profiled_tables(read(raw)).write.mode("overwrite").parquet(staged)
    profiled = read(staged)
    outcomes = document_log(read(raw), created_at, scanned)
    catalog.append(
        stored_tables(schema_records(profiled), descriptions, created_at),
        stored_rows(profiled, created_at),
        session_log(outcomes, run, created_at),
        ingest_seq=seq, documents=outcomes,
    )
    catalog._delete("extracted")
    return seq


def new_documents(scanned: DataFrame, known: DataFrame,
                  on: tuple[str, ...] = ("path", "modificationTime")) -> DataFrame:
    """Documents of a scan which the catalog (``Catalog.documents``, or any frame with the columns ``on``)
    has not seen in this version."""
    if "path" in on and "path" not in known.columns:
        known = known.withColumnsRenamed({"source_file": "path", "modification_time": "modificationTime"})
    return scanned.join(known.select(*on), list(on), "left_anti")
