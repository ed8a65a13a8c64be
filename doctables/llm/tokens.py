"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at ASCII white space. No token of a tokenizer that drops white space crosses such a
place, nor do its normalisation and its special strings, so the counts of the pieces add up to
the count of the whole text, however long. Pieces are gathered into batches of about equal bytes,
each distinct piece of a batch is encoded once, and its count is kept for later batches of the
same Python worker in a cache of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, worker_store
from .registry import query

BATCH_BYTES = 1 << 21
CACHED_PIECES = 600_000
#: Longer pieces are encoded whenever they occur, so that the cache is bounded in bytes too.
CACHED_PIECE_BYTES = 48
#: ASCII signs that end a piece and are tokens of their own after a letter.
TAIL = b".,;:!?#$%&*()"


def special_markers(tokenizer) -> tuple[bytes, ...]:
    """The special strings the tokenizer looks for inside texts."""
    return tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())


class PieceCounter:
    """Counts tokens of pieces without white space, with a ``tokenizers`` tokenizer that lower-cases
    and drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.markers = special_markers(self.tokenizer)
        self.known: dict[bytes, int] = {}

    def encode(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        for piece, encoding in zip(pieces, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.known[piece] = len(encoding)

    def learn(self, pieces: set[bytes]) -> None:
        """Know the count of each of ``pieces``. Signs behind an ASCII letter are counted apart:
        words of letters and runs of signs are never one token of such a tokenizer."""
        known, parts, whole = self.known, {}, []
        for piece in pieces:
            stem = piece.rstrip(TAIL)
            if len(stem) < len(piece) and stem[-1:].isalpha() and not any(m in piece for m in self.markers):
                parts[piece] = (stem, piece[len(stem):])
            else:
                whole.append(piece)
        self.encode([p for p in {x for both in parts.values() for x in both} | set(whole) if p not in known])
        for piece, (stem, tail) in parts.items():
            known[piece] = known[stem] + known[tail]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Token counts of a batch of whole texts."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        markers = self.markers
        # Lower-casing ASCII first only saves cache entries, unless it makes a special string.
        split = [(t if any(m in t.lower() for m in markers) else t.lower()).split() for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        known = self.known
        out = [sum(map(known.__getitem__, pieces)) for pieces in split]
        for piece in [p for p in new if len(p) > CACHED_PIECE_BYTES]:
            del known[piece]
        return out


def safe_parts(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut only at ASCII white space."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def by_bytes(texts: Iterable[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """(text number, part) in batches of about ``size`` bytes."""
    batch: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for part in safe_parts(text, size):
            batch.append((i, part))
            held += len(part)
            if held >= size:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def worker_counter(path: str) -> PieceCounter:
    store = worker_store("piece_counters")
    if path not in store:
        store[path] = PieceCounter(path)
    return store[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without its text, and n_bytes, n_tokens, over_limit of every whole text.

    ``tokenizer``: a file of the ``tokenizers`` library whose pre-tokenizer drops white space, with
    the same path on all workers. A null text counts as empty; repeated rows are counted each. One
    narrow pass without a shuffle: only the numbers leave the Python workers. Columns of ``docs``
    that have the names of results are replaced."""
    results = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c != text and c not in results]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = T.StructType([source.schema[c] for c in kept] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            totals = [0] * batch.num_rows
            for part in by_bytes((x.as_py() for x in column), batch_bytes):
                for (i, _), n in zip(part, counter.counts([x for _, x in part]), strict=True):
                    totals[i] += n
            tokens = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pc.binary_length(column).cast(pa.int64()), tokens, pc.greater(tokens, limit)],
                names=schema.names,
            )

    return source.mapInArrow(count, schema)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
