"""Target-distribution importance resampling.

Each word run is a feature that falls into one of a fixed number of buckets. The bucket counts of the corpus and of the
target give every bucket a gain, a document's weight is the mean of its features' gains, and adding Gumbel
noise that depends on its id alone makes a draw without replacement of the top of the noisy weights.

A document's buckets are kept as one array of 16- or 32-bit numbers, from which both the counts and the weights come; the
texts are read once. The cutoff is found without sorting the scores: quantile sketches bracket it, exact
counts above and below the bracket confirm it or take a wider one, and only the bracket's rows are sorted."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import by_bytes, one_array, row_sums, translated, words_of
from .common import shared_folder, table, written
from .ranking import ranked
from .registry import query

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
BLOCK_BYTES = 8 << 20
ACCURACY = 10_000
#: Half-widths of the brackets that are tried, as shares of the rows; the last one holds all rows.
MARGINS = (3 / ACCURACY, 30 / ACCURACY, 300 / ACCURACY, 1.0)
#: A-Z become a-z, what stands between words (ASCII but letters and digits) a space; all else stays.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def feature_buckets(docs: DataFrame, keep: list[str], text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``keep`` columns, n_words and the buckets of all features of each text, as an array of numbers in bytes
    (16-bit up to 65,536 buckets, else 32-bit, little-endian). Null texts have none."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("codes", T.BinaryType())])
    kind = code_type(buckets)

    def coded(words: pa.Array) -> np.ndarray:
        found = words.dictionary_encode()
        table_ = np.fromiter((zlib.crc32(w.encode()) % buckets for w in found.dictionary.to_pylist()), dtype=kind, count=len(found.dictionary))
        return table_[found.indices.to_numpy()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, "_text", BLOCK_BYTES):
            words, ends = words_of(translated(one_array(rows.column("_text")), WORD_BYTES))
            codes, at = [coded(words)], [ends]
            runs, owner = words, np.repeat(np.arange(rows.num_rows), np.diff(ends))
            for k in range(2, longest + 1):
                runs = pc.binary_join_element_wise(runs.slice(0, max(0, len(runs) - 1)), words.slice(k - 1), " ")
                inside = owner[k - 1:] == owner[:max(0, len(owner) - k + 1)]
                codes.append(coded(runs.filter(pa.array(inside))))
                at.append(np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - k + 1, 0))]))
            data = [b"".join(c[a[i]:a[i + 1]].tobytes() for c, a in zip(codes, at, strict=True)) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [one_array(rows.column(c)) for c in keep] + [pa.array(np.diff(ends)), pa.array(data, pa.binary())], names=schema.names)

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep).mapInArrow(work, schema)


def code_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def arrays(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and where each row's begin and end."""
    width = np.dtype(kind).itemsize
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind), np.cumsum([0] + [len(v) // width for v in values])


def bucket_counts(coded: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: counted per task, summed, one number a bucket on the driver."""
    kind = code_type(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(arrays(batch.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in coded.select("codes").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of smoothed shares)) of every bucket."""
    size, many, few = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.asarray([math.floor(1000 * math.log((t + 1) * many / ((s + 1) * few))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64).reshape(size)


def noise(doc_id: object, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone (null: the empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(coded: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``feature_buckets(docs, ["doc_id"])``."""
    kind = code_type(len(gain))
    schema = T.StructType([coded.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = arrays(batch.column("codes"), kind)
            n = np.diff(ends)
            weight = np.where(n > 0, row_sums(gain[codes], ends) // np.maximum(n, 1), 0)
            extra = np.fromiter((noise(x, seed) for x in batch.column("doc_id").to_pylist()), dtype=np.int64, count=len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight), pa.array(weight + extra)], names=schema.names)

    return coded.select("doc_id", "n_words", "codes").mapInArrow(work, schema)


def bracket(scores: DataFrame, take: int, rows: int, column: str = "score") -> tuple[int, int, int]:
    """(low, high, above): fewer than ``take`` rows score over ``high``, namely ``above``, and at least ``take`` score ``low``
    or more. One pass sketches the quantiles of all margins, one exact count for each margin tried decides."""
    share = 1 - take / rows
    wanted = [min(1.0, max(0.0, share + sign * m)) for m in MARGINS for sign in (-1, 1)]
    found = scores.agg(F.percentile_approx(column, wanted, ACCURACY)).first()[0]
    for low, high in zip(found[::2], found[1::2], strict=True):
        above, least = scores.agg(F.count(F.when(F.col(column) > high, 1)), F.count(F.when(F.col(column) >= low, 1))).first()
        if above < take <= least:
            return low, high, above
    raise AssertionError("the widest bracket holds all rows")


def at_or_before(cutoff: tuple[int, object], doc_id: str = "doc_id") -> Column:
    """Rows that stand at the cutoff or before it: higher scores, then smaller ids, null last."""
    score, last = cutoff
    tie = F.lit(True) if last is None else F.coalesce(F.col(doc_id) <= F.lit(last), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & tie)


def draw(scores: DataFrame, folder: str, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` (stored) with rank: 1, 2, 3, ... for the drawn ``percent`` of the rows of at least ``least_words`` words, by score, then by
    smaller id (null last), null for all others. Rows equal in both take any of their ranks, never more than there are."""
    able = F.col("n_words") >= least_words
    enough = scores.where(able)
    rows = enough.count()
    take = percent * rows // 100
    none = F.lit(None).cast("long").alias("rank")
    if not take:
        return scores.select("*", none)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    low, high, above = bracket(enough, take, rows)
    inside = ranked(enough.where(F.col("score").between(low, high)).select("doc_id", "score"), order, folder, "bracket")
    last = inside.where(F.col("rank") == take - above).first()
    drawn = able & at_or_before((last["score"], last["doc_id"]))
    top = ranked(scores.where(drawn), order, folder, "drawn")
    top = top.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return top.unionByName(scores.where(~drawn).select("*", none))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS,
             longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``, drawn towards the words of ``target``.

    Null and empty texts have no feature and the weight 0; a null id gets the noise of the empty text; rows that share id and score take
    any of their ranks; an empty target gives all documents gains from the corpus alone; an empty table gives no row."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = written(feature_buckets(rows, ["doc_id"], "text", buckets, longest), folder, "coded")
    wanted = bucket_counts(feature_buckets(target.select(F.col(target_text).alias("text")), [], "text", buckets, longest), buckets)
    scores = written(scored(coded, gains(bucket_counts(coded, buckets), wanted), seed), folder, "scores")
    return draw(scores, folder, percent, least_words)


@query("op12_importance_resampling", r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, 0 AS target, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT row_number() OVER (), NULL, 1, coalesce(text, '') FROM benchmark),
w AS (SELECT row, doc_id, target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
u AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
b AS (
  SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 1 + 2 * i::BIGINT, 2))::BIGINT),
                               lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM u, crc),
n AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM w JOIN b USING (word) GROUP BY bucket),
z AS (SELECT count(*) FILTER (target = 0) AS ss, count(*) FILTER (target = 1) AS tt FROM w),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS gain FROM n, z),
f AS (SELECT row, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE target = 0 GROUP BY row),
a AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN f USING (row) WHERE d.target = 0),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS score FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM r""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
