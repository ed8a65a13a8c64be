"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from doctables.llm import caps, html_main, langid, lm, minhash, mixing, outliers, packing, tokens, warc
from doctables.llm.common import crc_of_id, shared_folder
from doctables.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, kept string"
PROSE = " ".join(f"word{i} and then some more of it," for i in range(40))
LONG = " ".join(f"w{i}" for i in range(60_000)) + " " + "x" * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "en", "b"),
        (6, "One", "xx", "a"), (7, LONG, "en", "c"), (None, PROSE, None, None), (None, "  two   words \n\n\n here ", "en", "a"), (8, PROSE.upper(), "fr", "a"),
        (9, "à la carte <|endoftext|> ça\r\nva 中文 \x1c \xa0 x", "fr", "a"), (10, "***", "en", "a"), (11, PROSE + " end", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs, path, batch_bytes=1000)
    assert got.columns.count("n_tokens") == 1 and "score" in got.columns
    wanted = [(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()]
    assert as_rows(got, "doc_id", "n_bytes", "n_tokens") == sorted(wanted, key=repr)
    assert tokens.count_tokens(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, keep_ids=True).toPandas()
    whole = {}
    for r in docs.collect():
        whole.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for xs in whole.values() for x in xs)
    assert got.length.sum() == total
    for doc_id, pieces in got[got.doc_id.isin([3, 4, 5, 6, 7, 9])].sort_values("piece").groupby("doc_id"):
        assert np.frombuffer(b"".join(pieces.ids), dtype="<u4").tolist() == whole[doc_id][0]
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert list(places.offset) == [0, *np.cumsum(places.length)[:-1]] and places.length.sum() <= 2048
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    random = np.random.default_rng(seed)
    capacity = int(random.integers(4, 200))
    counts = np.append(0, random.integers(0, 50, capacity) * (random.random(capacity) < random.random()))
    made = packing.plan(counts)
    held = np.bincount([n for pattern, _ in made for n in pattern], [r for pattern, r in made for _ in pattern], minlength=capacity + 1)
    assert (held == counts).all() and all(sum(pattern) <= capacity and r > 0 for pattern, r in made)


def test_near_dedup(docs, empty):
    got = minhash.near_duplicates(docs, shingle=2)
    n = len(set(zip(PROSE.split(), PROSE.split()[1:])))
    assert as_rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted([
        (1, n, 1, True), (2, n, 1, False), (2, n, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True),
        (7, 60_000, 7, True), (None, n, None, True), (None, 2, None, True), (8, n, 1, False), (9, got.where("doc_id = 9").first()[1], 9, True),
        (10, 1, 10, True), (11, n + 1, 1, False)], key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_group_of_many_near_copies(spark):
    """A group over several blocks, with members that link with a few others only."""
    random = np.random.default_rng(5)
    texts = []
    for i in range(700):
        words = [f"t{k}" for k in range(120)]
        for k in random.choice(120, int(random.integers(0, 22)), replace=False):
            words[k] = f"n{i}x{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = minhash.shingle_sets([t.encode() for t in texts], 2)
    wanted = minhash.linked_roots(sets, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert [got[i] for i in range(700)] == wanted.tolist() and 1 < len(set(wanted)) < 600


def test_chains_of_weak_pairs_are_not_compared_whole(spark):
    """Texts of which only neighbours resemble each other, at one half: whoever is compared shares a bucket."""
    def compared(n):
        df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 31))) for i in range(n)], "doc_id long, text string")
        bands = minhash.sketched(df, 2, minhash.BANDS, minhash.ROWS, "text", ["doc_id"])
        nodes = bands.select("set_id", F.explode("bands").alias("key"))
        groups = minhash.candidate_groups(nodes).groupBy("group").count()
        return groups.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]

    few, many = compared(500), compared(1000)
    assert 0 < many < 8 * 1000 and many < 2.5 * few


def test_blocks_of_long_texts(spark, monkeypatch):
    """Groups that bytes cut into several blocks give the same components."""
    near = [(i, " ".join(f"v{k}" for k in range(200)) + f" end{i} of it" * (i % 3)) for i in range(40)]
    far = [(100 + i, " ".join(f"v{k}" for k in range(120 + 3 * i))) for i in range(20)]
    df = spark.createDataFrame(near + far, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    got = as_rows(minhash.near_duplicates(df, shingle=2), "doc_id", "component_id")
    ids = [i for i, _ in near + far]
    root = minhash.linked_roots(minhash.shingle_sets([t.encode() for _, t in near + far], 2), 80)
    assert got == sorted(zip(ids, (ids[r] for r in root)), key=repr)



def test_sketches_fill_and_estimate():
    random = np.random.default_rng(1)
    for n in (1, 3, 50, 4000):
        a = random.integers(0, 2 ** 63, n).astype(np.uint64)
        b = np.where(random.random(n) < 0.9, a, a + np.uint64(1))
        sketch = minhash.sketches([a, b], 160)
        assert not (sketch == np.iinfo(np.uint64).max).any()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sketch[0] == sketch[1]).mean() - truth) < 0.16


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 3), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark)).collect()
    assert {r.node: r.root for r in got} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "a long, b long"), shared_folder(spark)).count() == 0


def test_mixing(docs, empty):
    first, again = (as_rows(mixing.mix(docs, block=4), "doc_id", "copy", "source", "size", "source_size", "target", "taken") for _ in range(2))
    assert first == again and len(first) == docs.count()
    assert all(r[6] in (0, r[3], 2 * r[3]) for r in first)
    assert {r[2] for r in first} == {"a", "b", "c", None}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


def test_flight_keeps_totals():
    random = np.random.default_rng(2)
    size = random.lognormal(5, 1.5, 3000).round()
    p = random.random(3000)
    out = mixing.fly(p, size)
    open_ = (out > 1e-9) & (out < 1 - 1e-9)
    assert open_.sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3
    landed = mixing.land(out, size, p)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - p @ size) < 2


def test_outliers(docs, empty):
    got = outliers.judged(docs, keep=["doc_id"])
    short = {3: 0, 4: 0, 5: 0, 6: 1, 10: 1}
    for r in got.where(F.col("doc_id").isin(list(short))).collect():
        assert r.n_words == short[r.doc_id] and r.base_failed and not r.kept
    assert got.count() == docs.count() and got.where("doc_id = 7").first().n_words == 60_001
    assert outliers.judged(empty).count() == 0


def test_one_bad_feature_is_enough(spark):
    random = np.random.default_rng(7)
    word = lambda: "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    words = lambda n: [word() for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[k:k + 10]) for k in range(0, len(w), 10))
    clean = [lines(words(int(random.integers(80, 140)))) for _ in range(300)]
    same = words(22)
    bad = {
        "lines": "\n".join(f"{' '.join(words(6))}\n{x}" for x in ["okokok\nsososo"] * 12),
        "words": lines([*words(10), *same, *words(20), *same, *words(20)]), "symbols": lines([w if k % 4 else "$" + w[1:] for k, w in enumerate(words(100))]).replace("$", "$$"),
        "upper": lines([w.upper() if k % 2 else w for k, w in enumerate(words(100))]), "length": lines(words(20_000)), "word length": lines([w * 3 for w in words(100)])}
    rows = [(str(i), t, "en", "a") for i, t in enumerate(clean)] + [(k, t, "en", "a") for k, t in bad.items()]
    got = {r.doc_id: r for r in outliers.judged(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    assert all(got[str(i)].kept for i in range(300))
    assert not any(got[k].base_failed for k in bad) and [k for k in bad if got[k].kept] == []
    assert got["lines"].n_repeat_words == got["words"].n_dup_lines == 0


def test_mcd_against_numpy(spark):
    """Planted outliers are far, the rest is as near as numpy's distances to the clean rows say."""
    random = np.random.default_rng(4)
    names = list(outliers.FEATURES)
    x = random.standard_normal((600, len(names))) * 0.3
    x[:90] += 4
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, " + ", ".join(f"{n} double" for n in names))
    found = outliers.with_distance(rows, outliers.mcd(rows, shared_folder(spark), names), names).collect()
    d = {tuple(r[1:-1]): r.d2 for r in found}
    got = np.asarray([d[tuple(map(float, r))] for r in x])
    clean = x[90:]
    scatter = np.cov(clean.T) + np.diag([outliers.FEATURES[n] ** 2 for n in names])
    wanted = np.einsum("ij,jk,ik->i", x - clean.mean(0), np.linalg.inv(scatter), x - clean.mean(0))
    assert got[:90].min() > outliers.chi2_quantile(1 - 1e-9, len(names)) > np.quantile(got[90:], 0.99)
    assert np.corrcoef(got[90:], wanted[90:])[0, 1] > 0.95 and abs(np.median(got[90:] / wanted[90:]) - 1) < 0.2
    assert math.isclose(outliers.chi2_quantile(0.95, 2), -2 * math.log(0.05), rel_tol=1e-9)


def test_language_model(docs, empty):
    got = lm.scores(docs, docs.where(crc_of_id() % 7 != 2))
    texts = sorted(((r.doc_id, len((r.text or "").encode().lower().split()) + 1) for r in docs.collect()), key=repr)
    assert as_rows(got, "doc_id", "n_tokens") == texts
    assert all(r.score < 0 and r.base_score < 0 for r in got.collect())
    none = lm.scores(docs, empty)
    assert none.where("train_tokens <> 0 or n_known <> 0 or base_score <> 0").count() == 0
    assert lm.scores(empty, docs).count() == 0


def test_filter_never_gives_less():
    random = np.random.default_rng(3)
    keys = random.integers(0, 2 ** 63, 20_000).astype(np.uint64)
    counts = random.zipf(1.6, 20_000).clip(1, 10 ** 6)
    part = lm.range_of(keys, 2)
    bloom = lm.Filter([lm.filter_part(keys[part == r], counts[part == r]) for r in range(4)])
    level = lm.levels_of(counts)
    assert (bloom.counts(keys) >= lm.LEVEL_VALUES[level] - 1e-9).all()
    assert (bloom.counts(random.integers(0, 2 ** 63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_language_model_keeps_every_bigram(spark):
    """Scores by exact counts, with most bigrams seen once; the filter grows with them."""
    random = np.random.default_rng(6)
    texts = [[f"w{k}" for k in random.integers(0, 150, 60)] for _ in range(150)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    words, pairs = {}, {}
    for t in texts:
        for v, w in zip([None, *t], [*t, None]):
            words[w] = words.get(w, 0) + 1
            pairs[v, w] = pairs.get((v, w), 0) + 1
    assert np.mean([n == 1 for n in pairs.values()]) > 0.7
    p = {w: (n + 1) / (sum(words.values()) + len(words) + 1) for w, n in words.items()}
    for r in lm.scores(df, df, mu=2.0).collect():
        t = texts[r.doc_id]
        exact = sum(math.log10((pairs[v, w] + 2 * p[w]) / (words[v] + 2)) for v, w in zip([None, *t], [*t, None]))
        assert math.isclose(r.score, exact, rel_tol=0.02)
    bits = [8 * sum(len(x["filter"]) for x in lm.train(df.limit(n).select(F.col("text").cast("binary")), shared_folder(spark))[0].collect()) for n in (20, 150)]
    assert bits[1] >= lm.BITS * len(pairs) and bits[1] > 3 * bits[0]


def test_languages(docs, empty):
    model = langid.train(docs)
    assert set(model) == {"en", "fr", "xx"} and len({len(x) for x in model.values()}) == 1
    got = langid.identify(docs, model)
    for r in got.collect():
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    assert got.columns.count("score") == 1
    assert langid.train(empty) == {} and langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


PAGES = [
    (1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "é" * 3), (None, "u", "<p>a</p>"),
    (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, text string")


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, pages, least):
    folder = warc.archive(pages, shared_folder(spark), min_bytes=least)
    got = warc.records(spark, folder).withColumn("kind", warc.field("WARC-Type")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got if r.page_id) == sorted((i, (h or "").encode()) for i, _, h in PAGES if i)
    kinds = sorted((r.page_id or 0, r.kind) for r in got)
    three = [(3, "revisit" if least == 0 else "response"), (4, "response")]
    assert kinds == [(0, "revisit"), (1, "revisit"), (2, "response"), (2, "revisit"), *three, (5, "response"), (6, "response")]
    assert all(r.payload_digest == warc.sha1_base32(bytes(r.payload)) for r in got)
    assert len({r.record_id for r in got}) == len(got)
    assert spark.read.parquet(f"{folder}/payloads").select("payload_key").distinct().count() == 4
    files = f"{shared_folder(spark)}/warc"
    warc.write_warc(spark, folder, files)
    back = sorted((bytes(r.header), bytes(r.payload)) for r in warc.read_warc(spark, files).collect())
    assert back == sorted((bytes(r.header), b"" if r.kind == "revisit" else bytes(r.payload)) for r in got)


def test_archive_finds_damage(spark, pages):
    folder = warc.archive(pages, shared_folder(spark))
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad.write.parquet(f"{folder}-bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-bad/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.records(spark, f"{folder}-bad").collect()
    assert warc.records(spark, warc.archive(pages.limit(0), shared_folder(spark))).count() == 0


def test_main_text(pages):
    assert html_main.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert html_main.extract(pages.limit(0)).count() == 0
    tree = html_main.train()
    say = lambda page: html_main.main_text(page, tree)
    story = "<article><h1>Head &amp; tail</h1><p>First   line<br>goes on.<p>Second &lt;p&gt; &#233;&nbsp;x"
    text = "Head & tail\nFirst line goes on.\nSecond <p> é x"
    assert say(story) == text
    assert say(f"<header>Site</header><nav><p>Menu</p></nav>{story}</article><aside>Side</aside><footer>Foot</footer>") == text
    assert say(f"<div class=\"cookie-notice\"><p>We use cookies here.</p></div>{story}<div class='comments'><p>Nice!</p></div></article>") == text
    assert say(f"<form><p>Mail us your whole story today please</p></form>{story}<script>x = '</p>' < 3</script><style>p{{}}</style><!-- <p>no</p> --></article>") == text
    assert say(f"<div id=content class='post with-sidebar'><div class=sidebar>Side</div>{story}</article></div><div class='comment'>Nice</div>") == text
    assert say(None) == say("") == say("<p></p>") == ""
    assert say("<article><p>a <b title='x>y'>b</b></p><div style='display:none'>z<div>y</div></div><p>c") == "a b\nc"


@pytest.mark.parametrize("head, title, middle", [
    ("<link id='main-css' rel=stylesheet>", "<h1>", ""), ("<script id='main-js'>x</script>", "<h1>", ""), ("", "<h1 class='entry-title'>", ""),
    ("", "<h1>", "<div class='text-center'><p>Not one of the boats that lay at the quay was lost.</p></div>"),
    ("", "<h1>", "<p><span class='post-date'>Printed on the second day of May in the old hall.</span></p>"), ("<div class=content hidden>x y</div>", "<h1>", ""),
])
def test_names_beside_unmarked_text(head, title, middle):
    """Parts of names on a page whose paragraphs nothing marks: all paragraphs stay, and links around go."""
    import re

    paragraphs = [" ".join(f"The {n} boat came home with {k} nets full of herring." for k in range(9)) for n in ("first", "second", "third")]
    story = f"<div>{''.join(f'<p>{x}</p>' for x in paragraphs[:2])}{middle}<p>{paragraphs[2]}</p></div>"
    page = f"<html><head></head><body>{head}<div><a href=/>Home</a> <a href=/n>News</a></div>{title}Boats</h1>{story}<div><a href=/i>Imprint</a></div></body></html>"
    between = [re.sub("<[^>]*>", "", middle)] if middle else []
    assert html_main.main_text(page, html_main.train()) == "\n".join(["Boats", *paragraphs[:2], *between, paragraphs[2]])


def test_tree_splits_on_neighbours():
    def features(tree):
        return set() if len(tree) == 1 else {html_main.FEATURES[tree[0]]} | features(tree[2]) | features(tree[3])

    used = features(html_main.train())
    assert used & {"words_before", "words_after", "link_density_before", "link_density_after"} and {"words", "link_density"} <= used


@pytest.mark.parametrize("tag", ["p", "div"])
def test_unmarked_pages_keep_their_text(tag):
    """No name, article or frame: paragraphs of all lengths, list items and sentences with links stay, blocks of links go."""
    lost = total = 0
    for lengths in ((70, 20, 110), (25, 5, 40, 17), (13, 22, 10, 31, 19), (55, 2, 90, 28)):
        story = [" ".join(f"ship{k}of{n}" for k in range(n)) for n in lengths]
        story[2:2] = ["Ropes", "Sails and oars of oak", "See the list of harbours for it"]
        marked = [f"<{tag}>{x}</{tag}>" for x in story]
        marked[2:5] = ["<ul><li>Ropes</li><li>Sails and oars of oak</li></ul>", "", f"<{tag}>See <a href=/h>the list of harbours</a> for it</{tag}>"]
        page = f"""<html><body><div><a href=/>Home</a></div><ul><li><a href=/1>Weather</a></li><li><a href=/2>Tide tables of the week</a></li></ul><h1>Boats</h1>
        <div>{''.join(marked)}</div><div><a href=/i>Imprint and terms</a></div><ul><li><a href=/3>More boats</a></li></ul></body></html>"""
        got = html_main.main_text(page, html_main.train()).split("\n")
        total += sum(len(x.split()) for x in story)
        lost += sum(len(x.split()) for x in story if x not in got)
        assert set(got) <= {"Boats", *story}
    assert lost < 0.05 * total


def test_given_pages_without_names(spark, sf):
    """The given pages with all names, articles and frames taken out lose under 5 % of their articles' words."""
    import html
    import re

    tree, lost, total = html_main.train(), 0, 0
    for (page,) in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        bare = re.sub(' (class|id)="[^"]*"', "", re.sub("<(/?)(?:article|nav|footer)>", r"<\1div>", page))
        got = set(html_main.main_text(bare, tree).split("\n"))
        total += sum(len(b.split()) for b in want)
        lost += sum(len(b.split()) for b in want if b not in got)
    assert lost < 0.05 * total


def test_pages_are_scanned_in_linear_time():
    import time

    for page in ("<a href=x y=" * 40_000, "<p>x<b>" * 40_000, "<div>x" * 40_000, "<!--" * 40_000, "<td>" * 40_000 + "<li>" * 40_000, "&" * 200_000):
        began = time.time()
        html_main.blocks_of(page)
        assert time.time() - began < 8


def test_embeddings(spark):
    random = np.random.default_rng(0)
    x = random.standard_normal(64).tolist()
    y = (np.asarray(x) + 0.05 * random.standard_normal(64)).tolist()
    rows = [
        (1, x), (2, x), (2, x), (3, [2 * v for v in x]), (4, y), (5, None), (6, [0.0] * 64), (7, [float("nan")] * 64), (8, [*x[:63], None]), (9, []),
        (10, [-v for v in x]), (11, [float("inf"), *x[:63]]), (None, x), (12, x[:32]), (13, [1.0]), (14, [3.0]), (15, random.standard_normal(64).tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, kept int")
    got = as_rows(caps.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    alone = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12, 15)]
    assert got == sorted([
        (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), *alone, (None, 0, None, True)] + [
        r for r in got if r[0] in (13, 14)], key=repr)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_planted_links_are_found(spark):
    """Recall against brute force over many pairs near the threshold, and a group over several blocks."""
    random = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(random.standard_normal((400, 64)))
    side = random.standard_normal((400, 64))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.955 * a + np.sqrt(1 - 0.955 ** 2) * side
    centre = unit(random.standard_normal(64))
    group = unit(centre + 0.018 * random.standard_normal((1100, 64)))
    x = np.concatenate([a, b, group]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y = unit(x.astype(np.float64))
    wanted = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = np.asarray([r.n_links for r in caps.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= wanted).all() and got[:800].sum() >= 0.97 * wanted[:800].sum() and got[800:].sum() >= 0.99 * wanted[800:].sum()


@pytest.mark.parametrize("dimension", [1, 2, 8, 16, 24, 32, 48, 64])
def test_links_at_the_least_cosine(spark, dimension):
    random = np.random.default_rng(dimension)
    n = 300 if dimension > 8 else 30
    x, y = random.standard_normal((2, n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y = x * 3 if dimension == 1 else 0.950001 * x + math.sqrt(1 - 0.950001 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, y])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum() - 2 * n
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = caps.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.97 * wanted <= found <= wanted and (dimension > 8 or found == wanted)


def test_pipeline_stages_take_odd_rows(spark, docs, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        assert got.count() >= 0
        if name != "best_fit_packing":
            assert got.columns == docs.columns
        assert stage(spark, empty, "").count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, "").toPandas()
    assert sorted(kept.doc_id.dropna()) == [1, 3, 4, 5, 6, 7, 9, 10]
    assert sorted(kept[kept.doc_id.isna()].text) == ["  two   words \n\n\n here "]


def test_pipeline_stages_take_any_names(spark, docs):
    import corpus_pipeline

    names = ["times", "copy", "_copy", "_text", "_row", "held", "unit", "content", "key", "nth", "hash", "kept_key", "_h", "label"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, "")
        assert got.columns == wide.columns, name
        assert all(row[n] == f"{n}{'' if row.doc_id is None else row.doc_id}" for row in got.collect() for n in names), name
    assert corpus_pipeline.best_fit_packing(spark, wide, "").count() > 0


def test_rows_that_share_an_id_stay_apart(spark):
    import corpus_pipeline

    texts = [" ".join(f"{a}{i}" for i in range(60)) for a in "abcdef"]
    rows = [(k // 2 if k < 4 else None, text, "en", "s", 0) for k, text in enumerate(texts)] + [(None, texts[4], "en", "s", 0), (9, texts[5], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.text for r in got) == sorted(texts) and {r.doc_id for r in got if r.text == texts[5]} == {9}
    mixed = corpus_pipeline.mix_sources(spark, docs, "").groupBy("text").count().collect()
    assert len(mixed) == 6 and sum(r["count"] for r in mixed) == 12


def test_words_of_old_letters_are_coded_by_their_bytes():
    """Without the pre-tokenizer, and with the ids of whole texts."""
    import public_tokenizers
    import pyarrow as pa

    from doctables.llm.packing import IdCoder

    coder = IdCoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.signs is not None
    words = ["stra\u00dfe", "na\u00efve", "\u00c5\u00bc\u00aa\u00ba", "\u0395\u03bb\u03bb\u03ac\u03c2", "\u043f\u0440\u0438\u0432\u0435\u0442", "\u052f", "\u05d0\u05d1", "\u65e5\u672c", "a\u0300b", "caf\u00e9.", "\u0119\n\u0142a"]
    texts = ["x " + w + " y " + v for w in words for v in words] + ["", " ", words[0]]
    assert coder.ids(pa.array(texts)) == coder.encode(texts)
    assert coder.of_letters(words[:8]) == coder.encode([" " + w for w in words[:8]])
