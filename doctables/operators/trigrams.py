"""Substring search over stored texts by an index of trigrams.

Texts are numbered within blocks, which tasks make. Every run of three characters of a lower-cased field is a posting: (gram, field,
block) with the numbers of the texts that have it; a block's own row has its documents and ordinals. A term's rarest grams
are looked up, texts that have all of them are candidates, and only these are compared with the term, as the scan
does. A term without three literal characters in a row has no gram and is searched by the scan.

Layout: ``<folder>/{postings,counts,texts}/ingest_seq=<n>``, written in this order, so that a text counts once its postings
are there. Postings are also by ``part``, a hash of the gram (-1 for the rows of blocks), and sorted by gram; texts by ``bucket``, a hash of the
document. A repeated write replaces its own folders. Parts and buckets that a search does not need are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import SEARCH_FIELDS, Catalog, bucket_of, without_versions

LENGTH = 3
#: So many grams of a term are intersected, the rarest ones.
RAREST = 4
#: So many grams of a term at most are looked up at all: any of them give candidates, the comparison decides.
MOST_GRAMS = 256
#: Bytes of text of a block, whose postings are made at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
BLOCK_SCHEMA = "gram string, field string, block bigint, numbers array<int>, docs array<struct<doc_id: string, ordinal: int>>"
#: The part of the rows of blocks.
BLOCKS = -1
POSTINGS_SCHEMA = BLOCK_SCHEMA + ", ingest_seq bigint, part int"
COUNTS_SCHEMA = "gram string, n bigint, ingest_seq bigint"
#: Code points have so many bits.
POINT_BITS = 21


def block_postings(block: pa.RecordBatch, number: int) -> pa.RecordBatch | None:
    """The postings of texts (doc_id, ordinal, field, text): each gram of a field once, with the rows that have it; last
    the row of the block."""
    texts = [x.decode("utf-8", "replace") for x in block.column("text").cast(pa.binary()).to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    whole = row[LENGTH - 1:] == row[:-(LENGTH - 1)]
    if not whole.any():
        return None
    grams = pa.array(((points[:-2] << 2 * POINT_BITS) | (points[1:-1] << POINT_BITS) | points[2:])[whole]).dictionary_encode()
    fields = block.column("field").dictionary_encode()
    group = grams.indices.to_numpy().astype(np.int64) * len(fields.dictionary) + fields.indices.to_numpy()[row[:-2][whole]]
    found = np.sort(pc.unique(pa.array(group * len(texts) + row[:-2][whole])).to_numpy())
    group, row = np.divmod(found, len(texts))
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    gram, field = np.divmod(group[starts], len(fields.dictionary))
    key = grams.dictionary.to_numpy()[gram]
    mask = (1 << POINT_BITS) - 1
    letters = np.stack([key >> 2 * POINT_BITS, (key >> POINT_BITS) & mask, key & mask], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.append(starts, len(found))
    docs = pa.StructArray.from_arrays([block.column("doc_id"), block.column("ordinal")], names=["doc_id", "ordinal"])
    numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(row.astype(np.int32)))
    last = lambda values, end: pa.concat_arrays([values, end])
    return pa.RecordBatch.from_arrays([
        pa.array([letters[i:i + LENGTH] for i in range(0, len(letters), LENGTH)] + [""], pa.string()),
        last(fields.dictionary.take(pa.array(field)), pa.nulls(1, fields.dictionary.type)), pa.array([number] * (len(starts) + 1), pa.int64()),
        last(numbers, pa.nulls(1, numbers.type)),
        last(pa.nulls(len(starts), pa.list_(docs.type)), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)),
    ], names=["gram", "field", "block", "numbers", "docs"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")), start + 1)
            made = block_postings(batch.slice(start, stop - start), number)
            if made is not None:
                yield made
            start, number = stop, number + 1


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards, without escapes."""
    runs, escaped = [""], False
    for ch in pattern:
        if escaped or ch not in "\\%_":
            runs[-1] += ch
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            runs.append("")
    return runs


def term_grams(pattern: str) -> list[str]:
    return sorted({run[i:i + LENGTH] for run in literal_runs(pattern) for i in range(len(run) - LENGTH + 1)})[:MOST_GRAMS]


class TrigramIndex:
    """The index under one folder. ``fields`` are the text columns that can be searched, beside doc_id and ordinal."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = tuple(SEARCH_FIELDS), parts: int = 256, buckets: int = 256):
        self.spark, self.folder, self.fields, self.parts, self.buckets = spark, folder.rstrip("/"), fields, parts, buckets

    def _read(self, dataset: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{dataset}"
        if not Catalog(self.spark, self.folder)._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _bucket(self) -> Column:
        return F.coalesce(bucket_of(F.col("doc_id"), self.buckets), F.lit(0)).alias("bucket")

    def _texts_schema(self) -> str:
        return "doc_id string, ordinal int, " + "".join(f"`{f}` string, " for f in self.fields) + "ingest_seq bigint, bucket int"

    def add(self, tables: DataFrame, ingest_seq: int = 0) -> None:
        """Index one write: a row per (doc_id, ordinal) with the searchable fields."""
        at = f"ingest_seq={ingest_seq}"
        texts = tables.select(
            "doc_id", F.col("ordinal").cast("int").alias("ordinal"), *[F.col(f).cast("string").alias(f) for f in self.fields],
            self._bucket())
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in self.fields])
        searched = texts.select("doc_id", "ordinal", F.inline(fields)).filter(F.length("text") >= LENGTH)
        postings = searched.mapInArrow(_postings, BLOCK_SCHEMA)
        part = F.when(F.col("gram") == "", BLOCKS).otherwise(F.pmod(F.xxhash64("gram"), F.lit(self.parts)))
        postings = postings.withColumn("part", part.cast("int"))
        (
            # sized at run time: a gram that most texts have is split over tasks and files
            postings.hint("rebalance", "part").sortWithinPartitions("part", "gram")
            .write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings/{at}")
        )
        counts = self._read("postings", POSTINGS_SCHEMA).filter((F.col("ingest_seq") == ingest_seq) & (F.col("part") != BLOCKS))
        counts = counts.groupBy("gram").agg(F.sum(F.size("numbers")).alias("n"))
        counts.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.folder}/counts/{at}")
        (
            texts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id", "ordinal")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/texts/{at}")
        )

    def candidates(self, grams: list[str], fields: list[str]) -> DataFrame | None:
        """(doc_id, ordinal, ingest_seq, bucket) of the texts with a field that has the rarest of these grams; None
        where some gram is in no text."""
        counts = self._read("counts", COUNTS_SCHEMA).filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
        # one row per gram of the term
        found = counts.agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("found")).first()[0]
        if len(found) < len(grams):
            return None
        rarest = [x["gram"] for x in found[:RAREST]]
        numbers = [F.pmod(F.xxhash64(F.lit(g)), F.lit(self.parts)).cast("int").alias(str(i)) for i, g in enumerate(rarest)]
        parts = sorted(set(self.spark.range(1).select(*numbers).first()))
        stored, text = self._read("postings", POSTINGS_SCHEMA), ["ingest_seq", "block", "number"]
        postings = stored.filter(F.col("part").isin(parts) & F.col("gram").isin(rarest) & F.col("field").isin(fields)).select(
            "ingest_seq", "block", "field", F.explode("numbers").alias("number"))
        together = postings.groupBy(*text, "field").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest))
        docs = stored.filter(F.col("part") == BLOCKS).select("ingest_seq", "block", F.posexplode("docs").alias("number", "doc"))
        found = docs.join(together, text, "left_semi").select("ingest_seq", "doc.doc_id", "doc.ordinal")
        return found.select("ingest_seq", self._bucket(), "doc_id", "ordinal").distinct()

    def search(self, term: str, fields: list[str] | None = None, literal: bool = False, superseded: DataFrame | None = None) -> DataFrame:
        """The rows of ``add`` with the term in some field, in the same way as ``catalog.search`` finds them: letters of
        either case, ``%`` and ``_`` as wildcards unless ``literal``. ``superseded`` lists versions (doc_id, ingest_seq) to leave out.

        The driver gets the counts of the term's grams and the numbers of the buckets with candidates."""
        fields = [f for f in (self.fields if fields is None else fields) if f in self.fields]
        texts = self._read("texts", self._texts_schema())
        if literal:
            for special in ("\\", "%", "_"):
                term = term.replace(special, "\\" + special)
        pattern = f"%{term}%"
        grams = term_grams(self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0])
        if not fields:
            texts = texts.limit(0)
        elif grams:
            found = self.candidates(grams, fields)
            buckets = found.agg(F.collect_set("bucket")).first()[0] if found is not None else []
            if not buckets:
                return texts.limit(0).drop("bucket")
            keys = ["ingest_seq", "bucket", "doc_id", "ordinal"]
            texts = texts.filter(F.col("bucket").isin(sorted(buckets))).join(found, keys, "left_semi")
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.ilike(F.col(f), F.lit(pattern)), F.lit(False))
        texts = texts.filter(hit).drop("bucket")
        return texts if superseded is None else without_versions(superseded, texts)
