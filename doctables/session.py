"""Session settings the operators are tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Documents are large cells: bound what one Arrow batch holds by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # No Python call site per Column operation: plans with many expressions build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app_name: str = "doctables") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for written intermediate results: the one the cluster names, else one set before.
    Where neither is, a run on one machine (``local[..]``) gets a fresh temporary folder; others fail."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="doctables-checkpoint-"))
    return (named or context.getCheckpointDir()).rstrip("/")
