"""Language-model scoring with a log-frequency Bloom filter.

The filter (after Talbot and Osborne, "Smoothed Bloom filter language models", 2007) holds for every bigram the
quantised logarithm of its training count: levels 1, 2, .. up to its own are each inserted as (bigram, level). A
query probes level after level until one is missing, so it never gets less than the true level. Every bigram of the
training texts is in it, also one seen once, and it grows with them. Ranges are taken by a hash of the whole bigram, so a
frequent word's bigrams are spread over all of them.

Texts are read once, in chunks of documents. A chunk sends each range, by a shuffle, the different bigrams and words it has
and how often its training documents have them; the range adds these counts, builds its own part of the model (a part of the
filter and the counts of its words), and answers each chunk with levels and counts. So the same block of keys is a
contribution to the model and a question to it, and no task holds the model. The number of ranges follows the number of
tokens. This is the same at every size.

The model is a bigram with Dirichlet smoothing over add-one unigrams,
p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU), with c(v, w) from the filter. Counts of words are exact; every word
is followed by one other or the end of its text, so c(v) is also the sum of c(v, w) over w."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import by_bytes, one_array
from .common import crc_of_id, shared_folder, table, worker_store, written
from .filter_audit import packed, unpacked
from .minhash import MIX, hash_word, mix
from .registry import query

#: Bits of the filter per inserted (n-gram, level), and hash functions.
BITS, HASHES = 9, 4
#: Least count of each level; a level stands for the middle of its counts.
LEVELS = np.asarray(sorted({math.ceil(1.5 ** k) for k in range(64)} | {1, 2, 3, 4}), dtype=np.int64)
LEVEL_VALUES = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0)), [float(LEVELS[-1])]])
MU = 1000.0
CACHED_WORDS = 600_000
END_HASH = 1  # no hash of a word, those are over 2**63
#: Tokens of a chunk of documents, and of all documents for each range.
CHUNK_TOKENS, RANGE_TOKENS = 1_000_000, 2_000_000
#: Bytes of text that are split into words at a time.
BATCH_BYTES = 4 << 20


def halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a word of each hash brings into a bigram as its history (40 bits) and as its word (24 bits)."""
    return mix(hashes * MIX + np.uint64(3)) >> np.uint64(24), mix(hashes + np.uint64(5)) >> np.uint64(40)


class Words:
    """The words a Python worker has met, numbered, with arrays of what is known of each. Bounded: it
    starts again when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.add([END_HASH])

    def full(self) -> bool:
        """Whether the next call of ``numbers`` starts again."""
        return len(self.number) > CACHED_WORDS

    def add(self, hashes: list[int]) -> None:
        h = np.asarray(hashes, dtype=np.uint64)
        arrays = [h, *halves(h)]
        # Number 0 is the end of a text; it has no entry in ``number``.
        self.arrays = arrays if not self.number else [np.concatenate([x, y]) for x, y in zip(self.arrays, arrays)]

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, each ended by 0; tokens per text)."""
        if self.full():
            self.clear()
        split = [t.lower().split() for t in texts]
        new = list(set().union(*split).difference(self.number)) if split else []
        if new:
            first = len(self.arrays[0])
            hashes = [hash_word(w) | 1 << 63 for w in new]
            if not self.number:
                self.number[b""] = 0  # marks that the arrays are begun
            self.add(hashes)
            self.number.update(zip(new, range(first, first + len(new))))
        lengths = np.asarray([len(w) + 1 for w in split], dtype=np.int64)
        out = np.zeros(int(lengths.sum()), dtype=np.int32)
        at, number = 0, self.number
        for words in split:
            n = len(words)
            out[at:at + n] = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=n)
            at += n + 1
        return out, lengths


def before(numbers: np.ndarray) -> np.ndarray:
    """The number before each token; before the first token of a text stands the end of a text."""
    return np.concatenate([np.zeros(1, dtype=numbers.dtype), numbers[:-1]]) if len(numbers) else numbers


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bigrams: 40 bits of the history and 24 of the word."""
    return (history << np.uint64(24)) | word


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(11)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right").astype(np.int64)


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(keys ^ mix(np.full(1, level, dtype=np.uint64) * MIX))
    return a, mix(a) | np.uint64(1)


def place(a: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    """A bit number under ``size`` (below 2**32) from the upper half of a hash."""
    return ((a >> np.uint64(32)) * size) >> np.uint64(32)


def filter_part(keys: np.ndarray, counts: np.ndarray) -> bytes:
    level = levels_of(counts)
    size = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    out = np.zeros(size, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        a, b = probes(keys[level >= j], j)
        for _ in range(HASHES):
            out[place(a, np.uint64(size)).astype(np.int64)] = True
            a = a + b
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """A filter of the parts of all ranges, or of the part of one."""

    def __init__(self, parts: list[bytes] | bytes, sizes: list[int] | None = None):
        """From the parts, or from all of them in one piece and their lengths in bytes."""
        lengths = [len(p) for p in parts] if sizes is None else sizes
        self.range_bits = len(lengths).bit_length() - 1
        self.sizes = np.asarray(lengths, dtype=np.uint64) * np.uint64(8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = np.frombuffer(b"".join(parts) if sizes is None else parts, dtype=np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle count of each key's level; 0 for none."""
        return LEVEL_VALUES[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, by probing level after level; 0 for none."""
        found = np.zeros(len(keys), dtype=np.int64)
        part = range_of(keys, self.range_bits)
        alive = np.flatnonzero(self.sizes[part] > 0)
        for j in range(1, len(LEVELS) + 1):
            if not len(alive):
                break
            start, size = self.starts[part[alive]], self.sizes[part[alive]]
            a, b = probes(keys[alive], j)
            hit = np.arange(len(alive))
            for _ in range(HASHES):
                at = start[hit] + place(a[hit], size[hit])
                bit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                hit = hit[bit.astype(bool)]
                a = a + b
            alive = alive[hit]
            found[alive] = j
        return found


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, binary text, scored, trains) in chunks of about CHUNK_TOKENS tokens: a number, ids, lengths and marks of
    the documents, the hashes of the chunk's words (the end of a text first) and its tokens as numbers of these."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("lengths", T.BinaryType()),
        T.StructField("scored", T.BinaryType()), T.StructField("trains", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
        T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = worker_store("lm_words").setdefault("met", Words())
        made = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not ids:
                return
            whole = np.concatenate(numbers)
            used = np.bincount(whole, minlength=len(met.arrays[0])) > 0
            used[0] = True
            place = (np.cumsum(used) - 1).astype("<u4")
            held = pa.concat_arrays(ids)
            one = lambda data: pa.array([data], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), one(np.concatenate(lengths).astype("<i8").tobytes()),
                *[one(np.concatenate(x).astype(np.uint8).tobytes()) for x in zip(*marks)],
                one(met.arrays[0][used].astype("<u8").tobytes()), one(packed(place[whole])), pa.array([len(whole)], pa.int64())], names=schema.names)
            made += 1
            for held in (ids, lengths, numbers, marks):
                held.clear()

        for rows in by_bytes(batches, "_text", BATCH_BYTES):
            if met.full():  # numbers of words hold until then
                yield from flush()
            number, length = met.numbers([x.as_py() for x in rows.column("_text")])
            ids.append(one_array(rows.column("doc_id")))
            lengths.append(length)
            numbers.append(number)
            marks.append(tuple(one_array(rows.column(c)).to_numpy(zero_copy_only=False) for c in ("scored", "trains")))
            if sum(map(len, numbers)) >= CHUNK_TOKENS:
                yield from flush()
        yield from flush()

    return docs.select("doc_id", "_text", "scored", "trains").mapInArrow(work, schema)


def wanted(hashes: np.ndarray, codes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the words and of the bigrams of a chunk: (keys, their order by range, the ranges that have some, their first places in
    that order and the end).

    A bigram's code is the number of its history times the number of words, plus that of its word."""
    history, word = halves(hashes)
    out = []
    for keys in (hashes, pair_keys(history[codes // len(hashes)], word[codes % len(hashes)])):
        part = range_of(keys, bits)
        order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
        some, first = np.unique(part[order], return_index=True)
        out.append((keys, order, some, np.append(first, len(keys))))
    return out


def small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as all of them need: 1, 4 or 8."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unsmall(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n if n else 1}").astype(np.int64)


def blocks(held: DataFrame, bits: int) -> DataFrame:
    """(range, chunk, words, word_counts, pairs, pair_counts): the keys of each chunk that a range has, and how often the chunk's training
    documents have them. Rows of a chunk: one per range that has a key of it, so never more than keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, hashes, trains = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in (("lengths", "<i8"), ("hashes", "<u8"), ("trains", np.uint8)))
                tokens = unpacked(batch.column("tokens")[i].as_py(), int(lengths.sum()))
                learnt = np.repeat(trains, lengths).astype(bool)
                codes, place = np.unique(codes_of(tokens, len(hashes)), return_inverse=True)
                counts = np.bincount(tokens[learnt], minlength=len(hashes)), np.bincount(place[learnt], minlength=len(codes))
                sent: dict[int, list[bytes]] = {}
                for k, ((keys, order, some, edges), count) in enumerate(zip(wanted(hashes, codes, bits), counts)):
                    keys, count = keys[order], count[order]
                    for r, a, b in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                        sent.setdefault(r, [b"", b"", b"", b""])[2 * k:2 * k + 2] = keys[a:b].tobytes(), small(count[a:b])
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(sent), pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(sent), pa.int64()),
                    *[pa.array([x[k] for x in sent.values()], pa.binary()) for k in range(4)]], names=["range", "chunk", "words", "word_counts", "pairs", "pair_counts"])

    return held.select("chunk", "lengths", "hashes", "trains", "tokens").mapInArrow(
        work, "range int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary")


def range_model(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of all blocks of a range: the trained words, their counts, and the filter of its trained bigrams."""
    out = []
    for kind in ("word", "pair"):
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for data, count in zip(rows.column(f"{kind}s"), rows.column(f"{kind}_counts"), strict=True):
            k = np.frombuffer(data.as_py(), dtype="<u8")
            n = unsmall(count.as_py(), len(k))
            keys.append(k[n > 0])
            counts.append(n[n > 0])
        out.append(summed(np.concatenate(keys), np.concatenate(counts)))
    return *out[0], filter_part(*out[1])


def range_bits(held: DataFrame) -> int:
    tokens = held.agg(F.sum("n_tokens")).first()[0] or 0
    return max(6, math.ceil(math.log2(max(1, tokens / RANGE_TOKENS))))


def train(texts: DataFrame, folder: str) -> tuple[DataFrame, int, int, int]:
    """(the model, N, V, bits of a range) from one binary column of texts. The model has a row per range: its number, hashes
    and counts of its words as one block, and the part of the filter with all of its bigrams."""
    docs = texts.select(F.lit(0).cast("long").alias("doc_id"), F.col(texts.columns[0]).alias("_text"), F.lit(False).alias("scored"), F.lit(True).alias("trains"))
    held = written(chunks(docs), folder, "chunks")
    bits = range_bits(held)

    def add(key, rows):
        words, counts, bloom = range_model(rows)
        return pa.table({
            "range": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes() + counts.astype("<u8").tobytes()], pa.binary()),
            "filter": pa.array([bloom], pa.binary()), "n_words": pa.array([len(words)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64())})

    schema = "range int, words binary, filter binary, n_words long, n_tokens long"
    model = written(blocks(held, bits).groupBy("range").applyInArrow(add, schema), folder, "model")
    total, vocabulary = model.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    return model.select("range", "words", "filter"), int(total or 0), int(vocabulary or 0), bits


def codes_of(tokens: np.ndarray, n_words: int) -> np.ndarray:
    return before(tokens).astype(np.int64) * n_words + tokens


def answered(key, rows):
    """(chunk, range, counts of words, levels of bigrams) by the part of the model of one range, for every chunk that asks; on one row
    also how many words and tokens the range has learnt."""
    worker_store("lm_words").clear()  # texts are read by now
    known, c, bloom = range_model(rows)
    part = Filter([bloom])
    counts, levels = [], []
    for words, pairs in zip(rows.column("words"), rows.column("pairs"), strict=True):
        keys = np.frombuffer(words.as_py(), dtype="<u8")
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        found = np.where(known[at] == keys, c[at], 0) if len(known) else np.zeros(len(keys), dtype=np.int64)
        counts.append(small(found))
        levels.append(part.levels(np.frombuffer(pairs.as_py(), dtype="<u8")).astype(np.uint8).tobytes())
    n, first = rows.num_rows, np.arange(rows.num_rows) == 0
    return pa.table({
        "chunk": rows.column("chunk"), "range": pa.array([key[0].as_py()] * n, pa.int32()), "words": pa.array(counts, pa.binary()),
        "asked": pa.array([len(w.as_py()) // 8 for w in rows.column("words")], pa.int64()), "pairs": pa.array(levels, pa.binary()),
        "n_words": pa.array(first * len(known), pa.int64()), "n_tokens": pa.array(first * int(c.sum()), pa.int64())})


def scores(docs: DataFrame, training: DataFrame, text: str = "text", doc_id: str = "doc_id", mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text of ``docs``, by a model of
    the texts of ``training`` (null texts count as empty: one end token).

    base_score sums log10 of add-one unigram probabilities, score those of the smoothed bigrams. Repeated rows are
    scored each; with no training rows, every token has count 0. Words are told apart by 64-bit hashes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("scored"), F.lit(False).alias("trains"))
    learnt = training.select(F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("scored"), F.lit(True).alias("trains"))
    return scored_chunks(rows.unionByName(learnt), mu)


def scored_chunks(rows: DataFrame, mu: float = MU) -> DataFrame:
    """``scores`` of the rows (doc_id, text, scored, trains) that are marked as scored, by a model of those that train; a row can be both."""
    folder = shared_folder(rows.sparkSession)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    held = written(chunks(rows.select("doc_id", body.alias("_text"), "scored", "trains")), folder, "chunks")
    bits = range_bits(held)
    answers = written(blocks(held, bits).groupBy("range").applyInArrow(
        answered, "chunk long, range int, words binary, asked long, pairs binary, n_words long, n_tokens long"), folder, "answers")
    total, vocabulary = (int(x or 0) for x in answers.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    denominator = float(total + vocabulary + 1)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(key, chunk: pa.Table, found: pa.Table) -> pa.Table:
        lengths, hashes, scored = (np.frombuffer(chunk.column(c)[0].as_py(), dtype=t) for c, t in (("lengths", "<i8"), ("hashes", "<u8"), ("scored", np.uint8)))
        tokens = unpacked(chunk.column("tokens")[0].as_py(), int(lengths.sum()))
        codes, place = np.unique(codes_of(tokens, len(hashes)), return_inverse=True)
        found = found.sort_by("range")
        count, level = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(codes), dtype=np.uint8)
        (_, by_word, _, _), (_, by_pair, _, _) = wanted(hashes, codes, bits)
        count[by_word] = np.concatenate([unsmall(x.as_py(), n.as_py()) for x, n in zip(found.column("words"), found.column("asked"), strict=True)])
        level[by_pair] = np.frombuffer(b"".join(found.column("pairs").to_pylist()), dtype=np.uint8)
        v, w = codes // len(hashes), codes % len(hashes)
        # A bigram is seen at most as often as either word.
        pair = np.minimum(LEVEL_VALUES[level], np.minimum(count[v], count[w]))
        unigram = (count + 1) / denominator
        smooth = np.log10((pair + mu * unigram[w]) / (count[v] + mu))
        begins = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, begins) for x in ((count > 0).astype(np.int64)[tokens], np.log10(unigram)[tokens], smooth[place])]
        result = pa.Table.from_arrays([chunk.column("ids").combine_chunks().flatten(), pa.array(lengths), *map(pa.array, sums)], names=schema.names)
        return result.filter(pa.array(scored.astype(bool)))

    out = held.select("chunk", "ids", "lengths", "scored", "hashes", "tokens").groupBy("chunk").cogroup(
        answers.select("chunk", "range", "words", "asked", "pairs").groupBy("chunk")).applyInArrow(finish, schema)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@query("op8_bloom_lm")
def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id() % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_chunks(docs.select("*", F.lit(True).alias("scored"), (~held_out).alias("trains"))).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
