"""Every registered query of the subpackage on the small test tables, and its SQL where there is one."""

import zlib

import numpy as np
import pytest

from compare import connect, rows_of
from doctables.llm.queries import ORACLES, QUERIES

RESULTS = {
    "op1": {"vec_id", "n_links", "component_id", "kept"},
    "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op4": {"doc_id", "size", "source_size", "target", "taken"},
    "op5": {"doc_id", "n_shingles", "component_id", "kept"},
    "op6": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9": {"page_id", "url", "text", "n_chars"},
    "op10": {"doc_id", "held_out", "lang_pred", "score"},
    "op11": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op12": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.fixture(scope="module")
def results(spark, sf):
    held = {}

    def get(op):
        if op not in held:
            name = next(n for n in QUERIES if n.startswith(op + "_"))
            held[op] = QUERIES[name](spark, sf).toPandas()
        return held[op]

    return get


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")


@pytest.mark.parametrize("op", RESULTS)
def test_columns_and_rows(results, op, spark, sf):
    got = results(op)
    assert RESULTS[op] <= set(got.columns)
    source = {"op1": "embeddings", "op3": "pages", "op9": "pages"}.get(op, "documents")
    if op == "op11":
        assert len(got) == 600 * got.part.nunique()
    elif op != "op6":
        assert len(got) == spark.read.parquet(f"{sf}/{source}.parquet").count()


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    found = connect(sf).execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


def test_token_counts(results, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in results("op7").itertuples():
        text = documents.text[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False)))
        assert row.over_limit == (row.n_tokens > 2048)


def test_packing_is_a_round_trip(results, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = results("op6")
    for doc_id, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = np.asarray(tokenizer.encode(documents.text[doc_id] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.length[1:] == 2048).all() and (len(pieces) == 1) == (len(ids) <= 2048)
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(pieces.start, pieces.length)] == list(pieces.ids_crc32)
    assert set(got.doc_id) == set(documents.index)
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert list(places.offset) == [0, *np.cumsum(places.length)[:-1]] and places.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048)


def links_by_force(texts, shingle, percent=80):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


def test_near_dedup_by_force(results, documents):
    sets, root = links_by_force(dict(documents.text), 2)
    for row in results("op5").itertuples():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), root[row.doc_id], root[row.doc_id] == row.doc_id)


def test_mixing_meets_targets(results, documents):
    got = results("op4").join(documents[["source", "text"]], on="doc_id")
    assert (got["size"] == [len((t or "").encode().split()) for t in got.text]).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(set(got.source), key=lambda s: (s is None, s)))}
    sizes = got.groupby("source")["size"].sum()
    left, rest, target = 1.5 * sizes.sum(), set(sizes.index), {}
    while rest:
        over = {s for s in rest if left * weights[s] / sum(weights[x] for x in rest) > 2 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        rest -= over
    for source, rows in got.groupby("source"):
        assert rows.source_size.iloc[0] == sizes[source] and abs(rows.target.iloc[0] - target[source]) < 1e-6
        assert abs(rows.taken.sum() - target[source]) <= max(0.02 * target[source], rows["size"].max() / 2)


def test_base_statistics_of_outliers(results, documents):
    import re

    for row in results("op2").itertuples():
        text = documents.text[row.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i:i + 3]), []).append(i)
        repeated = len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})
        wanted = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        assert wanted == (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert row.base_failed == (len(words) < 50 or 100 * repeated > 50 * len(words)) and not (row.kept and row.base_failed)


def test_outliers_follow_the_labels(results, spark, sf):
    got = results("op2").merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.all()
    assert passed[passed.quality == 0].kept.mean() <= 0.2


def test_language_model_by_force(results, documents):
    import math
    from collections import Counter

    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in documents.text.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    got = results("op8")
    for row in got.itertuples():
        t = tokens[row.doc_id]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (out[row.doc_id], len(t), total)
        assert row.n_known == sum(counts[w] > 0 for w in t)
        assert math.isclose(row.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_held_out_languages(results, documents):
    got = results("op10").join(documents[["lang", "text"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out & (got.text.str.len() > 300)]
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_main_text_of_articles(results, spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id").html
    for row in results("op9").itertuples():
        article = re.search("<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_embedding_links_by_force(results, spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().set_index("vec_id").embedding
    x = np.stack(table.to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    got = results("op1").set_index("vec_id").loc[table.index]
    assert (got.n_links == near.sum(axis=1) - 1).all()


def test_pipeline_by_force(spark, sf, documents):
    """Each stage's rows against plain Python, and the whole against its stages."""
    import corpus_pipeline
    from doctables.llm.common import shared_folder, table, written

    docs, folder, kept = table(spark, sf, "documents"), shared_folder(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = written(stage(spark, docs, sf), folder, name)
        kept[name] = (before, docs.toPandas())
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["quality_rules"]
    verdict = corpus_pipeline.outliers.judged(table(spark, sf, "documents")).toPandas()
    assert set(after.doc_id) == set(verdict[verdict.kept].doc_id)
    before, after = kept["near_dedup"]
    _, root = links_by_force(dict(zip(before.doc_id, before.text)), 5)
    assert sorted(after.doc_id) == sorted(set(root.values()))
    before, after = kept["mix_sources"]
    assert set(after.doc_id.value_counts()) <= {1, 2} and set(after.doc_id) <= set(before.doc_id)
    words = lambda t: sum(len(x.split()) for x in t)
    assert abs(words(after.text) - 1.5 * words(before.text)) <= 0.05 * words(before.text)
    before, after = kept["best_fit_packing"]
    assert set(after.doc_id) == set(before.doc_id)
    assert sorted(corpus_pipeline.run(spark, sf).toPandas().doc_id) == sorted(after.doc_id)
