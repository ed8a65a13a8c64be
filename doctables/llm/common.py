"""What several operators share: words, stored intermediate tables, worker-wide caches, crc."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: A word: a run of anything but the six ASCII white space characters. ``bytes.split()`` on UTF-8
#: text splits at just those, so both give the same words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one call's intermediate tables, where every executor can read and write."""
    return f"{checkpoint_root(spark)}/doctables-llm/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again: later steps, and tasks that
    run again after an executor is lost, read the files and not the lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker and so serves all tasks it runs.

    For caches only: a task that finds it empty gives the same result."""
    module = sys.modules.setdefault("_doctables_worker_store", types.ModuleType("_doctables_worker_store"))
    return module.__dict__.setdefault(name, {})


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with signs behind it until none of ``columns`` is called so, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
