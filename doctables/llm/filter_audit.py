"""Filter interaction audit: what each of five filters removes, alone and behind the others, in every order.

Word statistics come from a sparse document-term matrix. Documents are taken in shards of bounded bytes; a shard
is a CSR matrix (row ends, column indices, counts) over a dictionary of its own, stored with that dictionary.
All shards' dictionaries together are encoded globally: words are dealt into hash buckets and numbered within
a bucket by their order, so a word has the same term number everywhere; a shard sends each of its words
once, however often it holds it. The numbers go back to their shards, whose columns become global ones. Row
sums (words) and nonzero counts (distinct words) of a shard decide the filters on length and on variety.

The other flags are joined by id and by digest, then documents are only counted: by part, failed filters and
labels, at most 32 * 4 rows a part. All orders of the filters are worked out on these counts."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .blocks import by_bytes, one_array, row_sums, words_of
from .common import shared_folder, table, written
from .registry import query

SHARD_BYTES = 16 << 20
BUCKETS = 4096
BUCKET_BITS = 40
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The filters' thresholds and characters.
LEAST_WORDS = 200
LEAST_VARIETY = 50
MOST_CAPITALS = 2
SIGNS = "[#$%&*|]"


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def csr(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary, row ends, column indices (rising in a row) and counts of the document-term matrix of ``texts``."""
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    wide = max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends))
    cells, counts = np.unique(rows * wide + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, np.searchsorted(cells, np.arange(len(texts) + 1, dtype=np.int64) * wide), cells % wide, counts


def local_shards(docs: DataFrame, keep: list[str], folder: str, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards with columns of their own, stored: shard, row_ends, columns, counts, words and the
    ``keep`` columns of the shard's rows as a list."""
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("row_ends", T.BinaryType()), T.StructField("columns", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("kept", T.ArrayType(T.StructType([docs.schema[c] for c in keep]))),
    ])

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        for rows in by_bytes(batches, "_text", shard_bytes):
            words, ends, columns, counts = csr(one_array(rows.column("_text")))
            kept = pa.StructArray.from_arrays([one_array(rows.column(c)) for c in keep], names=keep)
            one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                pa.array([packed(np.diff(columns, prepend=0))], pa.binary()), pa.array([packed(counts)], pa.binary()),
                one(words), one(kept),
            ], names=schema.names)
            number += 1

    shards = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep).mapInArrow(build, schema)
    return written(shards, folder, "shards")


def global_terms(shards: DataFrame) -> DataFrame:
    """shard, column, word and its term: the same number for a word in every shard, numbered by order within one
    of ``BUCKETS`` hash buckets. A word counts once per shard, so no word is a hot key."""
    words = shards.select("shard", F.posexplode("words").alias("column", "word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    numbered = words.withColumn("bucket", bucket).withColumn("place", F.dense_rank().over(W.partitionBy("bucket").orderBy("word")))
    return numbered.select("shard", "column", "word", (F.shiftleft("bucket", BUCKET_BITS) + F.col("place")).alias("term"))


def per_shard(shards: DataFrame, schema: T.StructType, work) -> DataFrame:
    """``work(kept, row_ends, terms, counts)`` of every shard with its columns as global terms."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        terms = np.zeros(right.num_rows, dtype=np.int64)
        terms[right.column("column").to_numpy()] = right.column("term").to_numpy()
        ends = np.frombuffer(left.column("row_ends")[0].as_py(), dtype="<i8")
        size = int(ends[-1])
        columns = np.cumsum(unpacked(left.column("columns")[0].as_py(), size), dtype=np.uint32)
        return work(one_array(one_array(left.column("kept")).flatten()), ends, terms[columns], unpacked(left.column("counts")[0].as_py(), size))

    terms = global_terms(shards).select("shard", "column", "term")
    return shards.drop("words").groupBy("shard").cogroup(terms.groupBy("shard")).applyInArrow(join, schema)


def document_term_matrix(docs: DataFrame, keep: list[str], text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The matrix as CSR shards: kept (the rows' ``keep`` columns), row_ends, terms and counts (64-bit numbers).

    Null texts count as empty; a row without a word is an empty row of the matrix."""
    schema = T.StructType([
        T.StructField("kept", T.ArrayType(T.StructType([docs.schema[c] for c in keep]))), T.StructField("row_ends", T.BinaryType()),
        T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def work(kept: pa.Array, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> pa.Table:
        return pa.table([
            pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([ends.tobytes()], pa.binary()),
            pa.array([terms.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=schema.names)

    return per_shard(local_shards(docs, keep, shared_folder(docs.sparkSession), text, shard_bytes), schema, work)


def word_totals(docs: DataFrame, keep: list[str], folder: str, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keep`` columns, n_words (row sum) and n_distinct (nonzeros) of every row of ``docs``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def work(kept: pa.Array, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> pa.Table:
        return pa.table([*kept.flatten(), pa.array(row_sums(counts, ends)), pa.array(row_sums(terms > 0, ends))], names=schema.names)

    return per_shard(local_shards(docs, keep, folder, text, shard_bytes), schema, work)


def failures(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, part and a boolean for each filter (true: fails) of every row of ``docs``.

    Null texts count as empty and a null source as the empty one. A row without an id is no copy of any other and none
    of it; rows that share id and text are no copies of each other. An empty table gives no row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), whole.alias("text"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        (100 * F.regexp_count(whole, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(whole)).alias("C"), whole.rlike(SIGNS).alias("D"))
    rows = written(word_totals(facts, ["doc_id", "part", "digest", "C", "D"], folder), folder, "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "digest").select(
        "doc_id", "part", (F.col("n_words") < LEAST_WORDS).alias("A"), (100 * F.col("n_distinct") < LEAST_VARIETY * F.col("n_words")).alias("B"),
        "C", "D", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Labels of one id are taken together (good or toxic if any of them says so); ids without one are neither."""
    folder = shared_folder(docs.sparkSession)
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    rows = failures(docs, folder)
    failed = F.concat(*[F.when(F.col(x), F.lit(x)).otherwise(F.lit("")) for x in FILTERS])
    counts = rows.join(marks, F.col("doc_id") == F.col("_id"), "left").groupBy("part", failed.alias("failed")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    steps = written(counts, folder, "counts").select(
        "*", F.explode(F.array(*[F.lit(x) for x in ORDERS])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumns({"letter": F.expr("substr(filter_order, step, 1)"), "before": F.expr("substr(filter_order, 1, step - 1)")})
    gone = F.expr("translate(failed, before, '') <> failed")
    fails = F.contains("failed", "letter")
    removed = fails & ~gone

    def total(value, when):
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")

    share = F.expr(f"n * {len(ORDERS)} div greatest(length(failed), 1)")  # of all orders, each failed filter comes first equally often
    return steps.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(F.col("n"), ~gone & ~fails).alias("kept"), total(F.col("n"), removed).alias("removed"), total(F.col("n"), fails & gone).alias("redundant"),
        total(F.col("n"), F.col("failed") == F.col("letter")).alias("unique_fails"), total(F.col("good"), removed).alias("good_lost"),
        total(F.col("bad"), removed).alias("toxic_lost"), total(share, fails).alias("shapley"))


@query("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (
  SELECT part, filter_order, step, n, good, bad, failed, substr(filter_order, step, 1) AS letter,
         contains(failed, substr(filter_order, step, 1)) AS fails,
         translate(failed, substr(filter_order, 1, step - 1), '') <> failed AS gone
  FROM c, o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(length(failed), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM s GROUP BY part, filter_order, step""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
