"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary of bounded size, a sample of its training texts.
A text is lower-cased and stripped of all but letters and single spaces, cut into chunks of whole words, and
each chunk is compressed with every dictionary; chunks keep what a long text repeats itself from hiding
what the dictionary knows. The language with the smallest sum wins; a narrow margin is rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import crc_of_id, fresh, table, worker_store
from .registry import query

UNKNOWN = "und"
LEVEL = 9
#: The bounded sample: at most so many training texts per language, and of each as many bytes as give DICTIONARY together.
SAMPLE_TEXTS = 400
DICTIONARY = 1 << 16
CHUNK = 2048
#: Bytes by which the second language is behind, over bytes of the text: less is a narrow margin.
MARGIN = 0.004
#: Bytes of difference that make a language e times as likely in ``score``.
SCALE = 3.0
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """The text's words of letters, lower-cased, one space between."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``data`` in chunks of about ``size`` bytes, cut at spaces."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id",
          sample_texts: int = SAMPLE_TEXTS, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for every non-null language of ``labelled``, which holds training rows only.

    Takes per language the ``sample_texts`` rows with the least hash of ``order`` and the text (a filter on the hash
    by the language's count comes before the ranking, so no language meets in one task), and from each a
    passage from its middle. The bound is languages times ``dictionary`` bytes, on the driver too."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(order).alias("id"))
    counts = rows.groupBy("lang").count().collect()  # a row per language, as the model has
    if not counts:
        return {}
    passage = dictionary // sample_texts
    share = F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(1.0, 2.0 * sample_texts / n))])
    near = rows.withColumn("hash", F.xxhash64("id", F.length("text"))).where(F.pmod("hash", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - 4 * passage) / 2).cast("int"))
    near = near.select("lang", "hash", F.substring("text", middle, F.lit(4 * passage)).alias("part"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("hash", "part"))).where(F.col("rank") <= sample_texts)
    parts: dict[str, list[bytes]] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        data = letters(row["part"]).encode()[:passage]
        if data:
            parts.setdefault(row["lang"], []).append(data)
    out = {}
    for name, pieces in sorted(parts.items()):
        # A language with few texts fills its dictionary by repeating them, so that all have one size.
        whole = b" ".join(pieces)
        out[name] = b" ".join([whole] * (dictionary // (len(whole) + 1) + 1))[:dictionary]
    return out


def dictionaries(model: dict[str, bytes], level: int) -> list:
    """Compressors of this worker, built once per model."""
    import zstandard

    store = worker_store("language_compressors")
    key = (hash(tuple(sorted(model.items()))), level)
    if key not in store:
        store.clear()
        made = []
        for name in sorted(model):
            held = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            made.append((name, zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))
        store[key] = made
    return store[key]


def judge(text: str | None, compressors: list, margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    data = letters(text).encode() if text else b""
    if not data or not compressors:
        return UNKNOWN, 0.0, True
    sums = np.zeros(len(compressors))
    for chunk in chunks(data):
        for k, (_, compressor) in enumerate(compressors):
            sums[k] += len(compressor.compress(chunk))
    best = int(sums.argmin())
    score = float(1 / np.exp(np.minimum(-(sums - sums[best]) / SCALE, 0)).sum())
    behind = np.delete(sums, best).min() - sums[best] if len(sums) > 1 else np.inf
    return compressors[best][0], score, bool(behind <= margin * len(data))


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = MARGIN, level: int = LEVEL,
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) of ``docs`` with lang_pred, score (0 to 1) and lang_rejected (narrow margin, or no letter).

    ``und`` with score 0 where the text is null or has no letter; ties go to the first language by name. Columns of
    ``docs`` with these names are replaced. One narrow pass; the model is bounded and goes with the tasks."""
    results = ["lang_pred", "score", "lang_rejected"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = fresh("_text", kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = dictionaries(shared.value, level)
        for batch in batches:
            found = [judge(x.as_py(), compressors, margin) for x in batch.column(whole)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.bool_()),
            ], names=schema.names)

    return docs.select(*kept, F.col(text).cast("string").alias(whole)).mapInArrow(work, schema)


@query("op10_compression_language")
def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id() % 5 == 0
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")
