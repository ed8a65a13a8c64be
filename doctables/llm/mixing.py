"""Mixing sources to target weights by the cube method.

A document of a source whose target is r times its size is taken floor(r) times, and once more with
probability r - floor(r). These last inclusions are drawn by the cube method (Deville and Tille
2004, in the fast form of Chauvet and Tille 2006): the vector of inclusion probabilities moves
through the null-space of the balancing constraints, here the totals of tokens and of documents, until
every probability but a few is 0 or 1; so both totals are met nearly exactly whatever is drawn.

The flight runs in parallel over blocks of a source's documents. Each block leaves at most two
open documents; these meet in blocks again, level after level, until one block per source is left with
a landing problem of two documents at most, solved by the choice that is nearest to the token total.
Each level has a small share of the rows of the level before, and no source is ever in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, shared_folder, table, written
from .registry import query

#: Weights of the sources by code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 1024
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Words of the whole text (null: 0): places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_no, source, source_size, target of every source.

    Sources take the weights in turn in code point order, null last, and share ``share`` times all sizes
    by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight among the rest until none is above. Sources are numbered by a range sort and one offset per
    partition; the level of the shares is found from sums over all sources, one row a round."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = written(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id()), folder, "sources")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    offsets = counts.select("part", "first", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ordered.withColumn("part", part).join(offsets, "part").select(
        "source", "source_size", (F.col("_at") - F.col("first") + F.col("offset")).alias("rank"),
    ).withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = written(weighed, folder, "weights")
    cap = F.col("source_size") * most
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, F.lit(False)
    while True:
        row = weighed.agg(F.sum(F.when(stopped, cap)).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
                          F.count(F.when(stopped, 1)).alias("n")).first()
        if level is not None and row["n"] == n_stopped or not row["weight"]:
            break
        n_stopped = row["n"]
        level = (total - (row["held"] or 0.0)) / row["weight"]
        # As the level rises from round to round, a source that stopped stays so.
        stopped = F.col("weight") * level > cap
    target = cap if level is None or not row["weight"] else F.when(stopped, cap).otherwise(F.col("weight") * level)
    return weighed.select(F.col("rank").alias("source_no"), "source", "source_size", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 with sum(p * size) and sum(p) kept, until two at most are open.

    Three open documents always have a direction that changes neither total; a random one of its two
    ends is taken, such that each probability stays right in expectation."""
    p = p.tolist()
    s = size.tolist()
    random = np.random.default_rng(len(p)).random(4 * len(p) + 4).tolist()
    open_ = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # u.(1,1,1) = 0 and u.(sizes) = 0
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up, down = math.inf, math.inf
        for x, i in zip(u, open_):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        move = up if random[k] * (up + down) < down else -down
        still = []
        for x, i in zip(u, open_):
            p[i] += move * x
            if EPS < p[i] < 1 - EPS:
                still.append(i)
            else:
                p[i] = float(round(p[i]))
        open_ = still
    return np.asarray(p)


def land(p: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The landing in the last block of a source: of the open documents (two at most) the choice nearest to
    their expected tokens, then a few exchanges of a taken document for another of the block (both
    with ``start`` between 0 and 1), each the one that brings the block's tokens nearest to their expectation."""
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    goal = sum(p[i] * size[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - goal), m))
    out = p.copy()
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    free = (start > EPS) & (start < 1 - EPS)
    for _ in range(8):
        excess = float(out @ size - start @ size)
        taken, others = np.flatnonzero(free & (out > 0.5)), np.flatnonzero(free & (out < 0.5))
        if not len(taken) or not len(others):
            break
        others = others[np.argsort(size[others], kind="stable")]
        wanted = size[taken] - excess
        at = np.searchsorted(size[others], wanted)
        near = [np.clip(at + d, 0, len(others) - 1) for d in (-1, 0)]
        miss = np.stack([np.abs(size[others[x]] - wanted) for x in near])
        k, i = np.unravel_index(int(miss.argmin()), miss.shape)
        if miss[k, i] >= abs(excess):
            break
        out[taken[i]], out[others[near[k][i]]] = 0.0, 1.0
    return out


def draw(units: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """``extra`` (0 or 1) for every unit (source_no, unit, size, p), balanced within each source.

    ``unit`` orders the units of a source at random but always alike. Equal units are interchangeable."""
    spark = units.sparkSession
    columns = ["source_no", "unit", "doc_id", "content", "copy", "size", "p"]
    schema = "source_no long, unit long, doc_id {}, content long, copy long, size long, p double".format(units.schema["doc_id"].dataType.simpleString())

    def flight(last: bool):
        def work(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([(c, "ascending") for c in ("unit", "doc_id", "content", "copy", "size")])
            size = rows.column("size").to_numpy().astype(np.float64)
            start = rows.column("p").to_numpy()
            p = fly(start, size)
            if last:
                p = land(p, size, start)
            return rows.set_column(rows.column_names.index("p"), "p", pa.array(p)).select(columns)
        return work

    level, done, units = 0, [], units.select(columns)
    while True:
        counts = units.groupBy("source_no").agg(F.ceil(F.count("*") / block).alias("blocks"))
        most = counts.agg(F.max("blocks")).first()[0] or 1
        blocked = units.join(counts, "source_no").withColumn("block", F.pmod(F.xxhash64("unit", F.lit(level)), F.col("blocks")))
        flown = written(
            blocked.repartition("source_no", "block").groupBy("source_no", "block").applyInArrow(flight(most == 1), schema),
            folder, f"flight-{level}")
        is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.where(~is_open))
        if most == 1:
            break
        units, level = flown.where(is_open), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("extra", F.round("p").cast("long"))


def content_of(text: Column, source: Column) -> Column:
    """A hash of text and source, with null and empty told apart."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")), source.isNull(), F.coalesce(source, F.lit("")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
        text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, content, copy, source, size, source_size, target, times, taken for every row of ``docs``.

    ``size`` counts words, ``times`` how often the mix takes the document (at most ``most``), taken =
    times * size. The draw depends on ids, texts and sizes only, so reruns agree. ``content`` (a hash of text and source) and
    ``copy`` (1, 2, ...) tell rows that share an id or have none: equal rows are counted, then numbered. Null texts and texts
    without a word have size 0, a null source is a source of its own, an empty table gives no row."""
    folder = shared_folder(docs.sparkSession)
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        content_of(F.col(text), F.col(source).cast("string")).alias("content"))
    counted = measured.groupBy("doc_id", "content", "source", "size").agg(F.count("*").alias("rows"))
    sizes = written(counted.select("doc_id", "content", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy")), folder, "sizes")
    targets = source_targets(sizes, folder, weights, share, most)
    targets = written(
        targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), folder, "targets")
    rated = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor(F.col("rate") + 1e-12)
    unit = F.when(F.col("doc_id").isNull(), F.xxhash64("content", "copy")).otherwise(F.xxhash64("doc_id", "copy"))
    drawn = draw(rated.select("source_no", unit.alias("unit"), "doc_id", "content", "copy", "size", (F.col("rate") - whole).alias("p")), folder, block)
    times = F.floor(F.col("rate") + 1e-12) + F.col("extra")
    return drawn.join(targets, "source_no").select(
        "doc_id", "content", "copy", "source", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as its ``times`` says, with all columns, whatever their names.

    Rows are numbered among those with the same id, text and source only."""
    taken = mix(docs, weights, share, most).where("times > 0").select(F.struct("doc_id", "content", "copy").alias("unit"), "times")
    content = content_of(F.col("text"), F.col("source").cast("string"))
    held = docs.select(F.struct(*docs.columns).alias("held"), F.col("doc_id").alias("id"), content.alias("content"))
    held = held.withColumn("copy", F.row_number().over(W.partitionBy("id", "content").orderBy("content")).cast("long"))
    held = held.select("held", F.struct(F.col("id").alias("doc_id"), "content", "copy").alias("unit"))
    return held.join(taken, "unit").select("held", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("held.*")


@query("op4_cube_mixing")
def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")
