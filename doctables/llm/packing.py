"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token sequences; longer ones than a sequence are cut, so that only the first
piece is shorter. The histogram of piece lengths (as many numbers as a sequence has tokens, whatever
the corpus) goes to the driver. There all patterns of up to three pieces that fill a
sequence are enumerated, their repeat counts fitted to the histogram by non-negative least
squares, rounded, and what they leave is packed best-fit. The plan is a list of (pattern,
repeats), so its size depends on the sequence length only. Pieces are numbered within their
length as they are written, and each finds its place in the plan by that number."""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .blocks import by_bytes, one_array, row_sums
from .common import shared_folder, table, worker_store, written
from .registry import query

CAPACITY = 2048
END_ID = 0
BLOCK_BYTES = 4 << 20
KNOWN_WORDS = 250_000
KNOWN_CHARS = 40
CALL_TEXTS = 8192
CALL_CHARS = 1 << 18
NNLS_STEPS = 60
#: Unicode's white space, and ASCII signs that a byte-level pre-tokenizer splits from a letter before them.
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
TAIL = ".,;:!?#$%&*()"
#: Fixed value: how a byte-level model writes a space.
SPACE_SIGN = "\u0120"


#: Fixed value: below it, every letter is in Unicode since its version 7.
OLD_LETTERS = "\u0530"


def byte_signs() -> dict[int, int]:
    """How a byte-level model writes each byte: printable ones as they are, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class IdCoder:
    """Token ids of whole texts with a byte-level BPE tokenizer, as little-endian 32-bit numbers.

    Such a tokenizer starts a token at a single space before a word, and around a line feed between
    words; so texts are cut there, a block's different words are looked up, and only those not yet known are
    encoded. A text with longer white space between words, or with a special string, is encoded as it is.

    Words up to ``KNOWN_CHARS`` long stay known. After ``KNOWN_WORDS`` a new generation of them begins, which takes from the one
    before what is met again; older ones are forgotten."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are busy with other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.markers = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # A word of letters is one piece for the model, which is asked directly where nothing else changes it.
        bare = self.tokenizer.normalizer is None and [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" Ab")] == [SPACE_SIGN + "Ab"]
        self.model = self.tokenizer.model if bare else None
        # Letters of old alphabets are letters to everyone, so a word of them is one piece: its bytes as signs.
        signs = byte_signs()
        probe = "".join(map(chr, filter(lambda c: chr(c).isalpha(), range(ord(OLD_LETTERS)))))
        as_signs = SPACE_SIGN + probe.encode().decode("latin-1").translate(signs)
        self.signs = signs if bare and [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" " + probe)] == [as_signs] else None
        self.known: dict[str, bytes | None] = {}  # what follows a space, with that space; None where it can't stand alone
        self.before: dict[str, bytes | None] = {}

    def of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters behind a space."""
        if self.model is None:
            return self.encode([" " + w for w in words])
        tokenize, cut, signs = self.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.signs
        return [array("I", [t.id for t in tokenize(SPACE_SIGN + w)] if w.isascii() else
                      [t.id for t in tokenize(SPACE_SIGN + w.encode().decode("latin-1").translate(signs))] if signs and max(w) < OLD_LETTERS else
                      [t.id for piece, _ in cut(" " + w) for t in tokenize(piece)]).tobytes() for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for some in by_chars(texts) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Add ``words``. Signs behind a letter make tokens of their own: words that differ in these only are encoded once."""
        known = self.known
        made: list[tuple[str, str, str]] = []  # word, the letters in it, signs behind them
        letters: dict[str, None] = {}
        bare: dict[str, bytes] = {"": b"", "\n": b""}  # texts as such
        for word in words:
            if word.isalpha():
                letters[word] = None
                continue
            stem = word.rstrip(TAIL)
            core = stem[1:] if stem[:1] == "\n" else stem
            if core.isalpha() and len(core) <= KNOWN_CHARS:
                signs = word[len(stem):]
                made.append((word, core, signs))
                bare[signs] = b""
                letters[core] = None
            elif stands_not_alone(word):
                known[word] = None
            else:
                bare[word if word[0] == "\n" else " " + word] = b""
                made.append((word, "", ""))
        new = [w for w in letters if w not in known]
        known.update(zip(new, self.of_letters(new), strict=True))
        for word, core, signs in made:
            if core and word[0] == "\n":
                bare[core] = b""
        bare = dict(zip(bare, self.encode(list(bare)), strict=True))
        for word, core, signs in made:
            if not core:
                known[word] = bare[word if word[0] == "\n" else " " + word]
            elif word[0] == "\n":
                known[word] = bare["\n"] + bare[core] + bare[signs]
            else:
                known[word] = known[core] + bare[signs]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a block."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten()
        first = words.take(pa.array(starts[:-1]))
        inner = np.ones(len(words), dtype=bool)
        inner[starts[:-1]] = False
        coded = words.filter(pa.array(inner)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = [known.get(w, False) for w in different]
        at = [i for i, x in enumerate(found) if x is False]
        missed = [different[i] for i in at]
        if before:
            known.update((w, before[w]) for w in missed if w in before)
            self.learn([w for w in missed if w not in known])
        else:
            self.learn(missed)
        for i, w in zip(at, missed, strict=True):
            found[i] = known[w]
            if len(w) > KNOWN_CHARS:
                del known[w]
        odd = np.asarray([x is None for x in found], dtype=bool)
        place = coded.indices.to_numpy()
        ends = starts - np.arange(len(starts))  # each text's first word stands apart
        whole = row_sums(odd[place], ends) > 0
        for marker in (" \n", *self.markers):
            whole |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
        # ids of all words one behind the other
        joined = pa.array([x or b"" for x in found], pa.large_binary()).take(coded.indices)
        data = memoryview(joined.buffers()[2] or b"")
        bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[ends].tolist() if len(joined) else [0] * len(starts)
        out = [start + data[a:b] for start, a, b in zip(self.encode(first.to_pylist()), bounds[:-1], bounds[1:], strict=True)]
        rest = np.flatnonzero(whole)
        for i, ids in zip(rest.tolist(), self.encode(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[i] = ids
        return out


def stands_not_alone(word: str) -> bool:
    """Nothing, or more white space, follows the space or line feed."""
    line = word[1:] if word[:1] == "\n" else word
    return not line or line[0] in SPACES


def by_chars(texts: list[str]) -> Iterator[list[str]]:
    """Lists of at most ``CALL_TEXTS`` texts and about ``CALL_CHARS`` characters: an encoding takes many times the room of its text."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CALL_CHARS or len(some) >= CALL_TEXTS:
            yield some
            some, size = [], 0
    if some:
        yield some


def worker_coder(path: str) -> IdCoder:
    store = worker_store("id_coders")
    if path not in store:
        store[path] = IdCoder(path)
    return store[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones behind a first of what remains."""
    first = length - (-(-length // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids on request), and the place of
    each among the pieces of its length that its task makes: part (the task) and nth, from 0.

    A null or empty text is just the end id; with ``end_id=None`` it has no piece."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()),
    ] + ([T.StructField("ids", T.BinaryType())] if keep_ids else []))
    end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = worker_coder(tokenizer), TaskContext.get().partitionId()
        made = [0] * (capacity + 1)
        for block in by_bytes(batches, "_text", BLOCK_BYTES):
            rows, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for i, found in enumerate(coder.ids(one_array(block.column("_text")))):
                ids = found + end
                for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity) if ids else []):
                    data = ids[4 * s:4 * (s + n)]
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data))
                    nth.append(made[n])
                    made[n] += 1
                    if keep_ids:
                        kept.append(data)
            yield pa.RecordBatch.from_arrays([
                one_array(block.column("doc_id")).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(nth, pa.int64()),
                *([pa.array(kept, pa.binary())] if keep_ids else []),
            ], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(cut, schema)


def fitted_patterns(counts: np.ndarray, steps: int = NNLS_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of three lengths, 0 for none) that fill a sequence, and their fitted counts.

    ``counts[n]``: how many pieces have length n; the last index is the sequence length. Solves
    min |A x - counts|, x >= 0 by multiplicative updates, which keep x non-negative."""
    capacity = len(counts) - 1
    have = np.flatnonzero(counts[:capacity])
    a, b = np.meshgrid(have, have, indexing="ij")
    c = capacity - a - b
    triple = (a <= b) & (b <= c)
    triple[triple] = counts[c[triple]] > 0
    pair = have[(2 * have <= capacity) & (counts[capacity - have] > 0)]
    patterns = np.concatenate([
        np.stack([a[triple], b[triple], c[triple]], axis=1), np.stack([np.zeros_like(pair), pair, capacity - pair], axis=1),
    ]).astype(np.int64)
    if not len(patterns):
        return patterns, np.zeros(0)
    flat, wanted = patterns.ravel(), counts.astype(np.float64).copy()
    wanted[0] = 0
    filled = lambda x: np.bincount(flat, np.repeat(x, 3), minlength=capacity + 1) * (np.arange(capacity + 1) > 0)
    over = lambda y: y[patterns].sum(axis=1)
    goal = over(wanted)
    x = np.full(len(patterns), wanted.sum() / (3 * len(patterns)))
    for _ in range(steps):
        x *= goal / np.maximum(over(filled(x)), 1e-12)
    return patterns, x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): sequences that hold every piece of the histogram once."""
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns, x = fitted_patterns(left)
    # Rounding carries the rest of one pattern to the next, which has mostly the same lengths; rich ones go first.
    order = np.lexsort((patterns[:, 0], patterns[:, 1], patterns[:, 2]))[::-1] if len(patterns) else []
    carried, rest, rows, amounts = 0.0, left.tolist(), patterns.tolist(), x.tolist()
    for p in order:
        carried += amounts[p]
        want = int(carried + 0.5)
        if want <= 0:
            continue
        pattern = tuple(n for n in rows[p] if n)
        repeats = min([want, *(rest[n] // pattern.count(n) for n in pattern)])
        carried = carried - want if repeats == want else 0.0
        if repeats:
            for n in pattern:
                rest[n] -= repeats
            made.append((pattern, repeats))
    return made + best_fit(np.asarray(rest, dtype=np.int64))


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: bins with equal contents are one group."""
    capacity = len(left) - 1
    groups: dict[int, list[list]] = {}  # free tokens: [contents, bins]
    free: list[int] = []  # sorted keys of groups

    def add(room: int, contents: tuple[int, ...], bins: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(free, room)
        groups[room].append([contents, bins])

    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    add(capacity - each * n, (n,) * each, full)
                if rest:
                    add(capacity - rest * n, (n,) * rest, 1)
                count = 0
                continue
            room = free[at]
            contents, bins = groups[room].pop()
            if not groups[room]:
                del groups[room]
                free.pop(at)
            each = min(room // n, -(-count // bins))
            used = min(bins, count // each)
            add(room - each * n, contents + (n,) * each, used)
            if bins > used:
                add(room, contents, bins - used)
            count -= used * each
    return [(contents, bins) for same in groups.values() for contents, bins in same]


def slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan as intervals: pieces of length n with numbers from ``first`` on go to sequences from
    ``sequence`` on, one each, at ``offset``. Sorted by n * 2**40 + first, the key."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    keys, first, sequences, offsets = [], [], [], []
    sequence = 0
    for pattern, repeats in made:
        offset = 0
        for n in pattern:
            keys.append((n << 40) + int(used[n]))
            first.append(int(used[n]))
            sequences.append(sequence)
            offsets.append(offset)
            used[n] += repeats
            offset += n
        sequence += repeats
    order = np.argsort(np.asarray(keys, dtype=np.int64), kind="stable")
    return tuple(np.asarray(x, dtype=np.int64)[order] for x in (keys, first, sequences, offsets))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``, stored so that a rerun reads the same) with the sequence_id and offset of each.

    The driver holds the histogram and the plan, whose size depends on the capacity only. A piece's number among all of its
    length is its place in its part and the pieces of that length in the parts before: one small row per length and part, summed
    along the parts of a length and joined back. Equal rows take any of their places."""
    spark = pieces.sparkSession
    runs = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, count in runs.groupBy("length").agg(F.sum("n")).collect():
        counts[n] = count
    place = spark.sparkContext.broadcast(slots(plan(counts), capacity))
    before = runs.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    numbered = pieces.join(before, ["length", "part"]).select(*kept, (F.col("before") + F.col("nth")).alias("number"))
    schema = T.StructType([pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequences, offsets = place.value
        for batch in batches:
            number, length = batch.column("number").to_numpy(), batch.column("length").to_numpy()
            found = np.searchsorted(keys, (length << 40) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sequences[found] + number - first[found]), pa.array(offsets[found])],
                names=schema.names)

    return numbered.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``keep_ids`` the ids as little-endian 32-bit words.

    Null texts count as empty, repeated rows are packed each, an empty table gives no row."""
    folder = shared_folder(docs.sparkSession)
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), folder, "pieces"), capacity)


@query("op6_pattern_packing")
def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
