"""Counts per source that follow replaced and removed documents, as a stream.

A document's newest version is kept as state under its id. A newer one takes the old one's tables back from the source
that had them; a version that was seen before, or an older one that comes late, changes nothing. What a micro-batch changes is
summed per source and written as one folder of that batch, so a batch that is run again replaces its own folder, and
earlier counts are never rewritten. The counts are the sums of all changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.catalog import Catalog

CHANGES_SCHEMA = "source_file string, documents bigint, n bigint"
_STATE = "source_file string, version bigint, n bigint"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = tuple(state.get) if state.exists else None
    newest = before
    for frame in frames:
        for source, version, n in zip(frame["source_file"], frame["version"], frame["n"], strict=True):
            if newest is None or int(version) > newest[1]:
                newest = (None if pd.isna(source) else str(source), int(version), -1 if pd.isna(n) else int(n))
    if newest is None or newest == before:
        return
    state.update(newest)
    changes = [(x[0], sign, sign * x[2]) for x, sign in ((before, -1), (newest, 1)) if x is not None and x[2] >= 0]
    if changes:
        yield pd.DataFrame(changes, columns=["source_file", "documents", "n"])


def document_changes(versions: DataFrame) -> DataFrame:
    """What each new version (doc_id, source_file, version bigint, n bigint; n is null for a document that was removed) adds to
    a source and takes from one. Versions without id or number are left out; the greater number is the newer version, and of
    equal numbers the one that came first counts."""
    usable = versions.select("doc_id", F.col("source_file").cast("string").alias("source_file"), F.col("version").cast("bigint").alias("version"), F.col("n").cast("bigint").alias("n"))
    return usable.filter("doc_id IS NOT NULL AND version IS NOT NULL").groupBy("doc_id").applyInPandasWithState(
        _step, CHANGES_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def follow_counts(versions: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the changes of a stream of versions, one folder per micro-batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy("source_file").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        document_changes(versions).writeStream.outputMode("append").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def current_counts(spark: SparkSession, target: str) -> DataFrame:
    """Documents and tables per source now; sources that have no document any more are left out."""
    schema = CHANGES_SCHEMA + ", batch bigint"
    changes = spark.read.schema(schema).parquet(target) if Catalog(spark, target)._exists(target) else spark.createDataFrame([], schema)
    summed = changes.groupBy("source_file").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    return summed.filter("documents > 0")
