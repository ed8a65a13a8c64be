"""Embedding near-dedup with spherical-cap filters.

The filters are directions of random product codes (Becker, Ducas, Gama, Laarhoven, "New directions in nearest
neighbor searching", 2016): a vector is rotated and split into parts, each part has a random code, and
every combination of one code word per part is a filter. A vector belongs to each filter whose cap it lies in
(inner product at least THRESHOLD / sqrt(dimension)); list decoding finds them part by part without going through the
millions of filters. Vectors that share a filter are compared in double precision.

Equal vectors are one node with a count. A filter with many vectors is dealt into blocks and compared block by
block; a pair that shares several filters counts in the one with the least number only, so links are counted without being listed, and
only the edges that span what a block links leave it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, table, worker_store, written
from .components import components
from .registry import query

#: Independent codes, parts of each, code words of a part: 2 million filters.
TABLES, PARTS, CODE = 32, 2, 256
#: In standard deviations of a random inner product. A vector lies in 23 caps on average, and two of cosine 0.95
#: share one with probability over 0.995; two unrelated ones with probability 0.0002. With many more
#: vectors, more code words and a higher threshold keep the caps as full as they are.
THRESHOLD = 4.0
#: Caps must find this share of the links at the least cosine. Where they do not (on SAMPLE drawn pairs of that cosine), the threshold is
#: lowered by STEP; where a vector would lie in more than MOST_CAPS then, or has under LEAST_DIMENSION components, all are compared.
RECALL, SAMPLE, STEP, MOST_CAPS, LEAST_DIMENSION = 0.99, 4000, 0.25, 400, 16
MEMBERS = 256
#: Rows of small filters that one task compares at a time, and pairs of them at once.
TOGETHER, PAIRS = 2048, 200_000
SEED = 20_160_401


def code(dimension: int, tables: int, parts: int, words: int) -> list[list[np.ndarray]]:
    """Per table and part the code words as columns, turned back into the space of the vectors, of a fixed seed; filters have norm 1."""
    store = worker_store("cap_codes")
    key = (dimension, tables, parts, words)
    if key not in store:
        edges = np.linspace(0, dimension, parts + 1).round().astype(int)
        made = []
        for number in range(tables):
            random = np.random.default_rng([SEED, dimension, number])
            rotation, _ = np.linalg.qr(random.standard_normal((dimension, dimension)))
            columns = []
            for a, b in zip(edges, edges[1:]):
                words_ = random.standard_normal((words, b - a))
                words_ *= np.sqrt((b - a) / dimension) / np.maximum(np.linalg.norm(words_, axis=1, keepdims=True), 1e-300)
                columns.append(rotation[:, a:b] @ words_.T)
            made.append(columns)
        store[key] = made
    return store[key]


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: (group, place in the group) of every member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def caps(units: np.ndarray, tables: int, parts: int, words: int, threshold: float) -> list[np.ndarray]:
    """The sorted filters of each row of ``units`` (unit vectors of one dimension): those with an inner product of at
    least threshold / sqrt(dimension). Decodes all rows at once, part by part; a partial sum goes on only
    where the best of the parts to come can still lift it over the threshold."""
    n, dimension = units.shape
    least = threshold / np.sqrt(dimension)
    rows, names = [], []
    for number, columns in enumerate(code(dimension, tables, parts, words)):
        scores = [units @ c for c in columns]
        best = np.stack([s.max(axis=1) for s in scores])
        row, total, name = np.arange(n), np.zeros(n), np.full(n, number, dtype=np.int64)
        reach = np.zeros(n)  # the best partial sum of each row
        for k in range(parts):
            after = best[k + 1:].sum(axis=0)
            able_row, able = np.nonzero(scores[k] >= (least - after - reach)[:, None])
            counts = np.bincount(able_row, minlength=n)
            first = np.cumsum(counts) - counts
            entry, place = expanded(counts[row])
            word = able[first[row[entry]] + place]
            grown = total[entry] + scores[k][row[entry], word]
            keep = grown >= (least - after)[row[entry]]
            row, total, name = row[entry][keep], grown[keep], name[entry][keep] * words + word[keep]
            reach = reach + best[k]
        rows.append(row)
        names.append(name)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return np.split(name[order], np.cumsum(np.bincount(row, minlength=n))[:-1])


def threshold_for(dimension: int, cosine: float, tables: int, parts: int, words: int, most: float) -> float | None:
    """The highest threshold from ``most`` down whose caps find RECALL of the pairs of this cosine, measured on drawn ones of a fixed
    seed; None where all vectors of the dimension are to be compared."""
    store = worker_store("cap_thresholds")
    key = (dimension, cosine, tables, parts, words, most)
    if key not in store:
        store[key] = None
        threshold = most
        random = np.random.default_rng([SEED, dimension])
        x, y = random.standard_normal((2, SAMPLE, dimension))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        while dimension >= max(LEAST_DIMENSION, 2 * parts) and threshold > 0:
            few = caps(x[:200], tables, parts, words, threshold)
            if np.mean([len(f) for f in few]) > MOST_CAPS:
                break
            found = [caps(z, tables, parts, words, threshold) for z in (x, y)]
            if np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(*found)]) >= RECALL:
                store[key] = threshold
                break
            threshold -= STEP
    return store[key]


def filtered(vectors: DataFrame, cosine: float, tables: int, parts: int, words: int, threshold: float) -> DataFrame:
    """vec_id, key (a digest of the vector; null where it takes no part), dimension, filters, embedding."""
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("key", T.BinaryType()), T.StructField("dimension", T.IntegerType()),
        T.StructField("filters", T.ArrayType(T.LongType())), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n = batch.num_rows
                column = batch.column(1)
                keys: list[bytes | None] = [None] * n
                filters: list[np.ndarray | None] = [None] * n
                dimensions = [0] * n
                by_dimension: dict[int, list[tuple[int, np.ndarray]]] = {}
                for i in range(n):
                    value = column[i].values
                    if value is None or not len(value) or value.null_count or batch.column(0)[i].as_py() is None:
                        continue
                    v = value.to_numpy(zero_copy_only=False).astype(np.float64)
                    scale = np.abs(v).max()
                    if not np.isfinite(scale) or scale == 0:
                        continue
                    keys[i] = hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest()
                    dimensions[i] = len(v)
                    v = v / scale
                    by_dimension.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
                for dimension, some in by_dimension.items():
                    least = threshold_for(dimension, cosine, tables, parts, words, threshold)
                    if least is None:  # one filter for all of them
                        for i, _ in some:
                            filters[i] = np.zeros(1, dtype=np.int64)
                        continue
                    for (i, _), found in zip(some, caps(np.stack([u for _, u in some]), tables, parts, words, least), strict=True):
                        filters[i] = found
                embedding = pa.array([x.as_py() if k is not None else None for x, k in zip(column, keys)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(keys, pa.binary()), pa.array(dimensions, pa.int32()), pa.array(filters, pa.list_(pa.int64())), embedding,
                ], names=schema.names)

    return vectors.mapInArrow(work, schema)


def compared(cosine: float):
    """Function of the rows of many filters, or of one pair of blocks of a large one: (key, null, links to
    count) and (key, key, 0) for the edges that span what is linked."""

    def work(rows: pa.Table) -> pa.Table:
        names, key = np.unique(np.asarray(rows.column("key").to_pylist(), dtype=object), return_inverse=True)
        part = {c: rows.column(c).to_numpy() for c in ("filter", "left", "right", "block", "dimension", "n")}
        order = np.lexsort((part["right"], part["left"], part["filter"], part["dimension"]))
        key, part = key[order], {c: x[order] for c, x in part.items()}
        x = padded([rows.column("embedding")[int(i)].values for i in order], np.float64, 0.0)
        x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        lists = padded([rows.column("filters")[int(i)].values for i in order], np.int64, -1)
        begins = np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in (part["dimension"], part["filter"], part["left"], part["right"])], axis=0)])
        sizes = np.diff(np.append(begins, len(key)))
        later = np.repeat(begins + sizes, sizes) - np.arange(len(key)) - 1  # rows of the same unit behind each
        links = np.zeros(len(names), dtype=np.int64)
        root = list(range(len(names)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges: list[tuple[int, int]] = []
        done = np.cumsum(later)
        start = 0
        while start < len(key):  # some hundred thousand pairs at a time
            stop = max(start + 1, int(np.searchsorted(done, done[start] - later[start] + PAIRS, side="right")))
            a, place = expanded(later[start:stop])
            a = a + start
            b = a + 1 + place
            apart = (part["left"][a] == part["right"][a]) | (part["block"][a] != part["block"][b])
            a, b = a[apart], b[apart]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[near], b[near]
            for at in range(0, len(a), 4096):
                p, q = a[at:at + 4096], b[at:at + 4096]
                # A pair counts here only if no filter with a smaller number has both.
                met = np.zeros(len(p), dtype=bool)
                for column in range(lists.shape[1]):
                    f = lists[p, column]
                    met |= (f >= 0) & (f < part["filter"][p]) & (lists[q] == f[:, None]).any(axis=1)
                p, q = p[~met], q[~met]
                np.add.at(links, key[p], part["n"][q])
                np.add.at(links, key[q], part["n"][p])
                for u, v in zip(key[p].tolist(), key[q].tolist()):
                    i, j = find(u), find(v)
                    if i != j:
                        root[max(i, j)] = min(i, j)
                        edges.append((u, v))
            start = stop
        some = np.flatnonzero(links).tolist()
        return pa.table({
            "a": pa.array([names[k] for k in some] + [names[u] for u, _ in edges], pa.binary()),
            "b": pa.array([None] * len(some) + [names[v] for _, v in edges], pa.binary()),
            "n": pa.array([int(links[k]) for k in some] + [0] * len(edges), pa.int64())})

    return work


def padded(lists: list, kind: type, fill: float) -> np.ndarray:
    """Lists as the rows of a matrix."""
    arrays = [v.to_numpy(zero_copy_only=False) for v in lists]
    out = np.full((len(arrays), max(map(len, arrays), default=0)), fill, dtype=kind)
    for i, v in enumerate(arrays):
        out[i, :len(v)] = v
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.95, tables: int = TABLES, parts: int = PARTS, words: int = CODE, threshold: float = THRESHOLD,
                 vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Links are pairs of rows with cosine >= ``cosine`` that share a filter; ``threshold`` is lowered for dimensions where its caps
    would find under RECALL of them, and vectors of a dimension too small for caps are all compared. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, link with nothing; vectors of different dimensions never link. Equal vectors link with each other. n_links counts
    rows, component_id is the smallest id reachable over links."""
    folder = shared_folder(vectors.sparkSession)
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = written(filtered(named, cosine, tables, parts, words, threshold), folder, "filtered")
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), folder, "classes")
    nodes = written(
        rows.join(classes, ["key", "vec_id"]).dropDuplicates(["key"]).select("key", "n", "dimension", "filters", "embedding"), folder, "nodes")
    members = nodes.select("key", "dimension", F.explode("filters").alias("filter"))
    sizes = written(members.groupBy("dimension", "filter").agg(F.count("*").alias("members")).where("members > 1"), folder, "sizes")
    together = -(-(sizes.agg(F.sum("members")).first()[0] or 1) // TOGETHER)
    dealt = members.join(sizes, ["dimension", "filter"]).withColumn("blocks", F.ceil(F.col("members") / MEMBERS)).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    # Filters of one block are dealt together by a hash; a pair of blocks of a larger one is a group of its own.
    small = F.col("blocks") == 1
    meeting = dealt.select("*", other).select(
        "key", "dimension", "filter", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        F.when(small, F.pmod(F.xxhash64("dimension", "filter"), F.lit(together))).otherwise(-1 - F.col("filter")).alias("group"))
    full = meeting.join(nodes.drop("dimension"), "key")
    found = written(full.groupBy("group", "left", "right").applyInArrow(compared(cosine), "a binary, b binary, n long"), folder, "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), folder)
    placed = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    facts = placed.join(least, "root").join(links.withColumnRenamed("a", "key"), "key", "left").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return rows.select("vec_id", "key").join(facts, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


@query("op1_spherical_caps", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.s * y.s) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)""")
def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
