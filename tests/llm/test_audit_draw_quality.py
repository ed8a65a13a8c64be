"""Filter audit, importance resampling and quality classifier against plain Python, with odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.llm import filter_audit, quality, resampling
from doctables.llm.common import shared_folder

SCHEMA = "doc_id long, text string, source string, kept string, score double, step string"
WORDS = " ".join(f"w{i % 150}" for i in range(260))
LONG = " ".join(f"x{i}" for i in range(40_000)) + " " + "Y" * 200_000
ROWS = [
    (1, WORDS, "a"), (2, WORDS, "a"), (2, WORDS, "b"), (3, None, None), (4, "", "a"), (5, " \t\n ", ""), (6, "AB $ c", "a"), (7, LONG, "b"), (None, WORDS, "a"),
    (None, None, "b"), (8, "same " * 300, "b"), (9, "à l'été  \x1c \xa0x\x0by | Ü", "a"), (10, WORDS + " more", "a"), (6, "AB $ c", "a"), (11, "The Cat the cat 9", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, None), (7, 0, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1), (8, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 0.5, "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def failed(rows):
    out = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        first = min((j for j, t, _ in rows if (t or "") == text and j is not None), default=None)
        flags = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 bool(re.search("[#$%&*|]", text)), i is not None and i > first)
        out.append((i, source or "", "".join(x for x, y in zip("ABCDE", flags) if y)))
    return out


def test_failures(spark, docs):
    got = filter_audit.failures(docs, shared_folder(spark)).collect()
    assert sorted(((r.doc_id, r.part, "".join(x for x in "ABCDE" if r[x])) for r in got), key=repr) == sorted(failed(ROWS), key=repr)


def test_audit_by_force(spark, docs, labels):
    good, bad = {i for i, q, _ in LABELS if q == 1 and i}, {i for i, _, t in LABELS if t == 1 and i}
    rows, wanted = failed(ROWS), {}
    for part in {p for _, p, _ in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                redundant = sum(x in f for _, f in gone)
                left, gone = [r for r in left if x not in r[1]], gone + removed
                shapley[x] += len(removed)
                unique = sum(f == x for _, p, f in rows if p == part)
                wanted[part, "".join(order), step] = [
                    len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in bad for i, _ in removed), x]
        for key in wanted:
            if key[0] == part:
                wanted[key][-1] = shapley[wanted[key][-1]]
    got = filter_audit.audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == wanted and len(got) == len(wanted)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 24])
def test_matrix_has_one_number_a_word(spark, docs, shard_bytes):
    shards = filter_audit.local_shards(docs, ["doc_id"], shared_folder(spark), shard_bytes=shard_bytes)
    terms = filter_audit.global_terms(shards).select("word", "term").distinct().collect()
    number = {r.word: r.term for r in terms}
    assert len(number) == len({*number.values()}) == len(terms)
    rows = []
    for r in filter_audit.document_term_matrix(docs, ["doc_id"], shard_bytes=shard_bytes).collect():
        ends, cells, counts = (np.frombuffer(x, dtype="<i8") for x in (r.row_ends, r.terms, r.counts))
        rows += [(k.doc_id, sorted(zip(cells[a:b].tolist(), counts[a:b].tolist()))) for k, a, b in zip(r.kept, ends[:-1], ends[1:], strict=True)]
    wanted = [(i, sorted((number[w], n) for w, n in Counter(re.findall("[^\x20\x09-\x0d]+", t or "")).items())) for i, t, _ in ROWS]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    totals = filter_audit.word_totals(docs, ["doc_id"], shared_folder(spark), shard_bytes=shard_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_distinct) for r in totals), key=repr) == sorted(((i, sum(n for _, n in c), len(c)) for i, c in wanted), key=repr)


def drawn_by_force(rows, target, buckets, longest, percent, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    s, t = (Counter(x for text in texts for x in features(text)[1]) for texts in ([r[1] for r in rows], target))
    size, other = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (other + buckets)))) for b in range(buckets)}
    out = []
    for i, text, _ in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[:percent * len(able) // 100], 1)}
    return [(r[0], *r[2:], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("buckets, longest, percent, least", [(10_000, 1, 50, 3), (70_000, 3, 30, 0), (7, 2, 100, 2), (100, 1, 0, 1)])
def test_draw_by_force(spark, docs, buckets, longest, percent, least):
    target = ["W1 w2 w3 the cat", None, "x5 é"]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), buckets=buckets, longest=longest, percent=percent, least_words=least)
    mine = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr)
    assert mine == sorted(drawn_by_force(ROWS, target, buckets, longest, percent, least), key=repr)


def test_draw_with_ties_and_nothing(spark, docs):
    """Three scores for 20,000 rows: the bracket holds one score, and ids decide."""
    scores = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(20).alias("n_words"), F.lit(1).alias("n_features"), F.lit(0).alias("weight"), (F.col("id") % 3).alias("score"))
    got = resampling.draw(scores, shared_folder(spark)).where("rank is not null").orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(k, 3 * k - 1) for k in range(1, 2001)]
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, none).count() == len(ROWS)


def test_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MARGINS", (0.0, 0.0, 1.0))
    scores = spark.range(1000).select(F.floor(F.col("id") / 100).alias("score"))
    for take in (1, 99, 100, 101, 999, 1000):
        low, high, above = resampling.bracket(scores, take, 1000)
        assert scores.where(f"score > {high}").count() == above < take <= scores.where(f"score >= {low}").count()


def test_discriminant_against_numpy():
    rng = np.random.default_rng(3)
    d = len(quality.NAMES)
    mix = [rng.normal(size=(d, d)) for _ in range(2)]
    x = [rng.normal(size=(400 + 200 * k, d)) @ mix[k] + k for k in range(2)]
    sums = {k: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for k, v in enumerate(x)}
    model = quality.fitted(sums, shrink=0.0, pool=0.0, least_spread=0.0)
    some = np.concatenate([v[:50] for v in x])
    density = []
    for k, v in enumerate(x):
        c = np.cov(v.T, bias=True)
        z = some - v.mean(axis=0)
        density.append(math.log((len(v) + 1) / 1002) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(model.log_odds(some), density[1] - density[0])
    flat = {k: s * 0 for k, s in sums.items()}
    for k in (0, 1):
        flat[k][0, 0] = 3  # constant statistics
    assert np.isfinite(quality.fitted(flat).log_odds(np.zeros((2, d)))).all()


def test_quality(spark, docs, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    known = [i for i, _, _ in ROWS if i and zlib.crc32(str(i).encode()) % 5]
    ones = spark.createDataFrame([(i, 1) for i in set(known)], "doc_id long, quality int")
    assert {round(r.score, 9) for r in quality.classify(docs, ones).collect()} == {round((len(known) + 1) / (len(known) + 2), 9)}


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), marks).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
