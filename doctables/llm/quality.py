"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a short vector of statistics: shares through the arc sine of their root, counts and lengths through
logarithms, so that they are roughly normal within a class. Each class gets a mean and a covariance from the labelled
vectors; the covariance is shrunk towards its diagonal and that towards the classes' pooled one, which keeps
it regular where a class has few rows or constant statistics. A text's score is the class probability that follows from the
difference of the two log densities: Mahalanobis distances through Cholesky factors, taken once and kept."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import by_bytes
from .common import crc_of_id, shared_folder, table, written
from .registry import query

BLOCK_BYTES = 4 << 20
#: Shares of the covariance that go to its diagonal, and of the diagonal to the pooled one.
SHRINK = 0.05
POOL = 0.05
#: A statistic's least standard deviation.
LEAST_SPREAD = 0.02
THRESHOLD = 0.3
#: Characters counted as symbols, as capitals, as digits, as signs of sentences.
SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\"
CAPITALS = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
STOPS = b".,;:"
CALLS = b"!?"
NAMES = ("words", "word_length", "symbols", "capitals", "digits", "stops", "calls", "lone_signs", "distinct_words", "neighbours", "pairs", "lines", "line_words")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``; all 0 for a text without a word."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))

    def angle(part: float, whole: float) -> float:
        return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0

    def signs(those: bytes) -> float:
        return angle(len(data) - len(data.translate(None, those)), size)

    return [
        math.log1p(n), math.log(size / n), signs(SYMBOLS), signs(CAPITALS), signs(DIGITS), signs(STOPS), signs(CALLS),
        angle(sum(len(w) == 1 and not w.isalnum() for w in words), n), angle(n - len(set(words)), n),
        angle(sum(a == b for a, b in zip(words, words[1:])), n - 1), angle(n - 1 - pairs, n - 1),
        angle(len(lines) - len(set(lines)), len(lines)), math.log(n / len(lines)),
    ]


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the statistics of the whole text (null: of the empty one)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, "_text", BLOCK_BYTES):
            x = [statistics(t.as_py()) for t in rows.column("_text")]
            yield from pa.table([rows.column(c) for c in keep] + [pa.array(x, pa.list_(pa.float64()))], names=schema.names).to_batches()

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep).mapInArrow(work, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log density constants of class 0 and 1; a class without rows has none, and ``prior`` holds."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1 against class 0, for the rows of ``x``."""
        if not self.means:
            return np.full(len(x), math.log(self.prior / (1 - self.prior)))
        log_density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return log_density[1] - log_density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def moments(labelled: DataFrame, d: int) -> dict[int, np.ndarray]:
    """Per class the sums of the outer products of (1, x): summed in each task, then over tasks; (d + 1)^2 numbers a class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), np.asarray(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, d)])
            y = batch.column("y").to_numpy()
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        flat = total.reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], flat.shape[1])), pa.array(np.tile(np.arange(flat.shape[1]), 2)), pa.array(flat.ravel())], names=["y", "k", "v"])

    out = {0: np.zeros((d + 1) ** 2), 1: np.zeros((d + 1) ** 2)}
    for y, k, v in labelled.select("x", "y").mapInArrow(add, "y long, k long, v double").groupBy("y", "k").agg(F.sum("v")).collect():
        out[y][k] = v
    return {y: m.reshape(d + 1, d + 1) for y, m in out.items()}


def fitted(sums: dict[int, np.ndarray], shrink: float = SHRINK, pool: float = POOL, least_spread: float = LEAST_SPREAD) -> Discriminant:
    """The discriminant of two classes from their moments. Where a class has no row, the other's share alone counts, smoothed."""
    n = [float(sums[k][0, 0]) for k in (0, 1)]
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if not min(n):
        return Discriminant(prior)
    means = [sums[k][0, 1:] / n[k] for k in (0, 1)]
    covariances = [sums[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    diagonals = [np.maximum(np.diag(c), 0) for c in covariances]
    pooled = (n[0] * diagonals[0] + n[1] * diagonals[1]) / (n[0] + n[1])
    factors, constants = [], []
    for k in (0, 1):
        diagonal = (1 - pool) * diagonals[k] + pool * pooled + least_spread ** 2
        shrunk = (1 - shrink) * (covariances[k] - np.diag(np.diag(covariances[k]))) + np.diag(diagonal)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(prior if k else 1 - prior) - float(np.log(np.diag(lower)).sum()))
    return Discriminant(prior, tuple(means), tuple(factors), tuple(constants))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant from ``stats`` (doc_id, x) and ``labels`` (doc_id, quality): rows without an id or with a label other
    than 0 and 1 teach nothing; each label of an id counts."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("long").alias("y"))
    return fitted(moments(stats.join(known, F.col("doc_id") == F.col("_id")), len(NAMES)))


def scores(stats: DataFrame, model: Discriminant, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score (probability of class 1) and predicted (1 from ``threshold`` on)."""
    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(np.asarray(batch.column("x").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return stats.select(*keep, "x").mapInArrow(work, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; rows whose id's crc32 modulo 5 is 0 are held out of training.

    Null and empty texts are scored as texts without a word, repeated rows each; without labels of both classes every score is
    the smoothed share of class 1 (0.5 without any); an empty table gives no row."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("held_out", crc_of_id() % 5 == 0)
    stats = written(document_statistics(rows, ["doc_id", "held_out"]), folder, "statistics")
    model = train(stats.where(~F.col("held_out")), labels.select("doc_id", "quality"))
    return scores(stats, model, ["doc_id", "held_out"], threshold)


@query("op13_quadratic_quality")
def op13_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
