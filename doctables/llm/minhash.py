"""MinHash near-dedup with fast similarity sketches.

A set's sketch has T coordinates (Dahlgaard, Knudsen, Thorup: "Fast Similarity Sketching", 2017). In
rounds 0..T-1 every element is hashed to one coordinate, in rounds T..2T-1 all elements to the
coordinate numbered by the round; a coordinate keeps the least (round, hash). So after 2T
rounds each coordinate is filled, for any non-empty set, and the share of equal coordinates is
concentrated around the Jaccard similarity as for T independent permutations; a set of n elements is done
after about T log(T) / n rounds. Sketches are banded; documents that share a band are
candidates, and all links among them are confirmed on the full sets. The buckets of one band key that
have the same least member form a group around it, so whoever shares a bucket is compared, and
chains of weakly similar documents from bucket to bucket are not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, table, worker_store, written
from .components import components
from .registry import query

#: At similarity 0.8, one of 32 bands of 5 rows meets with probability 1 - 3e-6; at 0.4 with 0.28, at 0.2 with 0.01.
BANDS, ROWS = 32, 5
#: Members of one candidate group that are compared with each other in one task, and the bytes of their texts (a longer
#: text is alone with the pivots).
BLOCK, BLOCK_BYTES = 256, 1 << 25
PIVOTS = 16
CACHED_WORDS = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


hash_word = xxhash.xxh3_64_intdigest


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of ``size`` words; the whole sequence is
    one shingle where it is shorter; none for no word."""
    known = worker_store("word_hashes")
    if len(known) > CACHED_WORDS:
        known.clear()
    split = [(t or b"").lower().split() for t in texts]
    new = set().union(*split).difference(known) if split else set()
    known.update((w, hash_word(w)) for w in new)
    out = []
    for words in split:
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(len(h) - size + 1, 1) if len(h) else 0
        width = min(size, len(h))
        # The length starts the chain, so that a short sequence is no shingle of another length.
        s = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            s = mix((s * MIX) ^ h[k:k + n])
        out.append(np.unique(s))
    for word in [w for w in new if len(w) > 40]:
        del known[word]
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates (unsigned 64-bit) per non-empty set."""
    n, t = len(sets), np.uint64(size)
    best = np.full((n, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    lengths = np.asarray([len(s) for s in sets], dtype=np.int64)
    elements, owner = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n), lengths)
    flat = best.ravel()
    low = np.uint64((1 << 52) - 1)
    for i in range(2 * size):
        if not len(elements):
            break
        h = mix(elements ^ mix(np.full(1, i + 1, dtype=np.uint64) * MIX))
        at = (h % t).astype(np.int64) if i < size else np.full(len(h), i - size)
        value = (np.uint64(i) << np.uint64(52)) | ((h >> np.uint64(8)) & low)  # the round first
        np.minimum.at(flat, owner * size + at, value)
        open_sets = (best == np.iinfo(np.uint64).max).any(axis=1)
        if not open_sets.all():
            keep = open_sets[owner]
            elements, owner = elements[keep], owner[keep]
    return best


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, which names the band too."""
    out = np.empty((len(sketch), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix((key * MIX) ^ sketch[:, b * rows + r])
        out[:, b] = key
    return out


def sketched(docs: DataFrame, shingle: int, bands: int, rows: int, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_shingles, set_id (a 128-bit digest of the shingle set, null for an empty
    one) and its band keys, for every row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = shingle_sets([x.as_py() for x in batch.column(len(keep))], shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in some], bands * rows), bands, rows).view(np.int64)
                ids: list[bytes | None] = [None] * len(sets)
                lists: list[np.ndarray | None] = [None] * len(sets)
                for k, i in enumerate(some):
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    lists[i] = keys[k]
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                ], names=schema.names)

    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(work, schema)


def linked_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, where 100 * intersection >= percent * union links two.

    Counts common elements of all pairs of these few sets by products of incidence matrices."""
    n = len(sets)
    root = np.arange(n)
    if n < 2:
        return root
    lengths = np.asarray([len(s) for s in sets], dtype=np.int64)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    starts = np.flatnonzero(np.r_[True, elements[1:] != elements[:-1]])
    counts = np.diff(np.r_[starts, len(elements)])
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)  # elements of one set only can't be common
    shared = np.repeat(counts > 1, counts)
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), dtype=np.float64)
    step = 16_384
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        width = int(column[hi - 1]) - first + 1 if hi > lo else 0
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - first] = 1
        common += block @ block.T
    union = lengths[:, None] + lengths[None, :] - common
    link = 100 * common >= percent * union
    seen = np.zeros(n, dtype=bool)
    for i in range(n):
        if seen[i]:
            continue
        reached = np.zeros(n, dtype=bool)
        new = np.zeros(n, dtype=bool)
        new[i] = True
        while new.any():
            reached |= new
            new = link[new].any(axis=0) & ~reached
        seen |= reached
        root[reached] = i
    return root


def group_links(members: DataFrame, keys: list[str], shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the components among the members (set_id, text) of each group."""

    def work(batch: pa.Table) -> pa.Table:
        ids, texts = batch.column("set_id").to_pylist(), batch.column("text")
        found: dict[bytes, np.ndarray] = {}
        for at in range(0, len(ids), 64):
            for name, s in zip(ids[at:at + 64], shingle_sets([x.as_py() for x in texts.slice(at, 64)], shingle), strict=True):
                # An id that several rows have may bring the text of another set along.
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == name:
                    found[name] = s
        names = sorted(found)
        sets = [found[x] for x in names]
        root = linked_roots(sets, percent)
        ends = [(names[i], names[r]) for i, r in enumerate(root) if r != i]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.binary()), "b": pa.array([x for _, x in ends], pa.binary())})

    return members.groupBy(*keys).applyInArrow(work, "a binary, b binary")


def candidate_groups(node_bands: DataFrame) -> DataFrame:
    """(set_id, group) of the sets (set_id, key) that share a band key with another: a set is in
    the group of the least set_id of each of its buckets, so two that share a bucket share a group."""
    shared = node_bands.groupBy("key").agg(F.min("set_id").alias("group"), F.count("*").alias("n")).where("n > 1").select("key", "group")
    return node_bands.join(shared, "key").select("set_id", "group").distinct()


def blocks_for(n: Column, n_bytes: Column) -> Column:
    """How many blocks hold ``n`` members with ``n_bytes`` of text."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(n_bytes / BLOCK_BYTES))


def confirmed_links(groups: DataFrame, texts: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """Edges that span the true components of the members of each candidate group (set_id, group, n_bytes);
    a set may be in several groups.

    A group is dealt into blocks of about BLOCK members or BLOCK_BYTES, and every block is compared in full, together
    with a few pivots of its group. That settles groups of one block. Of a larger one, members outside
    its largest component so far meet all members, block by block, so no link between different
    components is lost; members of one component need no further comparison with each other."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), blocks_for(F.count("*"), F.sum("n_bytes")).alias("blocks"))
    blocked = groups.join(sizes, "group").select(
        "set_id", "group", "n_bytes", "blocks", F.pmod(F.xxhash64("set_id", F.lit(7)), "blocks").alias("block"),
        (F.pmod(F.xxhash64("set_id", F.lit(11)), F.col("n")) < PIVOTS).alias("is_pivot"))
    blocked = written(blocked.join(texts, "set_id"), folder, "members")
    large = blocked.where("blocks > 1")
    pivots = large.where("is_pivot").select("set_id", "group", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("block").alias("home")).where("block <> home").drop("home")
    first = written(group_links(blocked.select("set_id", "group", "text", "block").unionByName(pivots), ["group", "block"], shingle, percent), folder, "links-1")
    # Larger groups: who is still outside the group's largest component meets every block.
    roots = components(first, folder, "first").withColumnsRenamed({"node": "set_id"})
    placed = written(
        large.select("set_id", "group", "n_bytes", "blocks", "block").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), folder, "placed")
    by_root = placed.groupBy("group", "root").count()
    main = by_root.groupBy("group").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    outside = placed.join(main, "group").where("root <> main").select("set_id", "group", "n_bytes", "blocks", "block")
    n_out = outside.groupBy("group").agg(blocks_for(F.count("*"), F.sum("n_bytes")).alias("outs"))
    dealt = outside.join(n_out, "group").withColumn("out", F.pmod(F.xxhash64("set_id", F.lit(13)), F.col("outs")))
    everywhere = dealt.select("set_id", "group", "out", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = placed.join(n_out, "group").select("set_id", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1)).alias("out"), "block")
    meeting = everywhere.unionByName(met).join(large.select("set_id", "group", "text"), ["set_id", "group"])
    return roots.select(F.col("set_id").alias("a"), F.col("root").alias("b")).unionByName(group_links(meeting, ["group", "out", "block"], shingle, percent))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two rows link where 100 * intersection >= percent * union of their sets of word shingles (words
    with A-Z lower-cased, split at ASCII white space). component_id is the smallest id reachable over
    links, kept says whether that is the row's own. Null and empty texts have no shingle and link with
    nothing. Rows with a null id take no part (their component is null and they are kept); rows that
    repeat an id share its component. Texts with equal sets are one node with any number of rows."""
    folder = shared_folder(docs.sparkSession)
    body = F.col(text).cast("binary")
    ids = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"))
    rows_ = written(sketched(ids, shingle, bands, rows, "text", ["doc_id", "text_hash", "n_bytes"]), folder, "sketches")
    usable = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    # One node per shingle set with one of its texts; the bands are the same for all its rows.
    one = F.min(F.struct("doc_id", "text_hash", "n_bytes")).alias("one")
    classes = written(rows_.where(usable).groupBy("set_id").agg(one, F.any_value("bands").alias("bands")).select("set_id", "one.*", "bands"), folder, "classes")
    node_bands = classes.select("set_id", F.explode("bands").alias("key"))
    groups = written(candidate_groups(node_bands), folder, "groups")
    one_text = classes.drop("bands").join(groups.select("set_id").distinct(), "set_id", "left_semi").join(
        ids.where("doc_id is not null").select("doc_id", "text_hash", "text"), ["doc_id", "text_hash"]).select("set_id", "text")
    links = confirmed_links(groups.join(classes.select("set_id", "n_bytes"), "set_id"), one_text, folder, shingle, percent)
    roots = components(links, folder, "linked").withColumnsRenamed({"node": "set_id"})
    placed = classes.select("set_id", "doc_id").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = placed.join(least, "root").select("set_id", "component_id")
    return rows_.select("doc_id", "n_shingles", F.when(usable, F.col("set_id")).alias("set_id")).join(component, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


@query("op5_fast_sketches", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op5_fast_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
