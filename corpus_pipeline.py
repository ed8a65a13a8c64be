"""From raw documents to packed token sequences: five stages, each by one operator of ``doctables.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's documents. All but the last return the columns of their input, whatever these are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from doctables.llm import langid, minhash, mixing, outliers, packing
from doctables.llm.common import shared_folder, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A verdict depends on text, language and source only; it is brought back to the rows by two 64-bit
    hashes of these, so repeated rows and null ids need no key."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "lang", "source")]
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*names).alias("_h"), F.xxhash64(F.lit(1), *names).alias("_i"))
    rows = marked.select("_h", "_i", "_row.text", "_row.lang", "_row.source")
    rejected = outliers.judged(rows, keep=["_h", "_i"]).where(~F.col("kept")).select("_h", "_i").distinct()
    return marked.join(rejected, ["_h", "_i"], "left_anti").select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with more than a narrow margin, by dictionaries of the labelled ones."""
    model = langid.train(docs)
    told = langid.identify(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text")), model, keep=["_row"])
    return told.where(~F.col("lang_rejected")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null last), of each group linked by 5-word shingles at 0.8 or more.

    A document is an id with a text: rows that share an id with other texts are documents of their own, rows
    equal in both are one. The window keeps one row per document before it deals them out."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit(""))).alias("hash"))
    found = minhash.near_duplicates(docs.select(key.alias("key"), F.col("text").alias("body")), shingle=5, percent=80, text="body", doc_id="key")
    keepers = found.where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("held"), key.alias("key"))
    one = held.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("held.source")))).where("nth = 1")
    return one.join(keepers, F.col("key") == F.col("kept_key"), "left_semi").select("held.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (twice at most)."""
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Iterated estimates, compression and tokenizers are no SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
