"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is scanned once into flat text blocks. Each block is described by its word count and link density,
by those of the blocks before and after it, and by a few marks of the markup around it; a decision tree
trained here on a small labelled table (``BLOCK_PAGES``) says whether it belongs to the article. The
kept blocks, joined in page order, are the text (after Kohlschuetter, Fankhauser, Nejdl:
"Boilerplate Detection using Shallow Text Features", 2010)."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .html_labels import BLOCK_PAGES
from .registry import query

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: A start tag of one of these ends an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HIDDEN_TAGS = frozenset("script style head title template noscript iframe object svg canvas select option textarea button datalist noembed noframes xmp math".split())
FRAME_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
#: Names of a class, id or role that mark what is around an article, and what is one.
FRAME_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside related recommended recommendations popular trending share sharing social follow comment comments commentlist reply replies "
    "discussion disqus respond cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "login footer footnav header masthead topbar toolbar pagination pager copyright legal widget tags skip contentinfo complementary search form feedback paywall".split())
MAIN_NAMES = frozenset("article main content post entry story body text".split())

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?\]\]>|<(/?)([A-Za-z][^\s/>]*+)"
    r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+)|[\"'])*+)>|<[!?/][^>]*>", re.S)
UNENDED = re.compile(r"<[A-Za-z/!?]")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z]+")
#: Says what an element goes with or lacks, not what it is.
BESIDE = frozenset("with no not has is without".split())
COMMENT_NAMES = frozenset("comment comments reply ad ads advert promo sponsored related".split())
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WHITE = re.compile(r"\s+")

#: Share of a page's words, without links and what stands around an article, that its marked main parts must have to be
#: one: of those marked by an element or a whole name, and of those marked by a part of a name only.
WHOLE_SHARE, PART_SHARE = 0.1, 0.4
#: place: 0 in what stands around an article, 2 in a marked main part, 1 in neither. page_marked: whether the page has a marked one.
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "place", "in_text_tag", "in_list", "in_table", "page_marked")


class Element:
    __slots__ = ("tag", "frame", "main", "hidden", "text", "list", "table", "link")

    def __init__(self, tag: str, up: Element | None, attributes: str):
        self.tag = tag
        hidden = False
        tokens: set[str] = set()
        if attributes and ("=" in attributes or "hidden" in attributes):
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id", "role"):
                    tokens.update(value.split())
                elif name == "style":
                    hidden = hidden or bool(HIDES.search(value))
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
        parts = [p for t in tokens if (p := NAME_PART.findall(t)) and p[0] not in BESIDE]
        # A name as a whole says more than a part of one.
        whole = main = not MAIN_NAMES.isdisjoint(tokens)
        frame = not FRAME_NAMES.isdisjoint(tokens) or not main and any(not FRAME_NAMES.isdisjoint(p) for p in parts)
        main = not frame and (main or any(not MAIN_NAMES.isdisjoint(p) for p in parts))
        if tag in ("body", "html"):  # their names say nothing of a part of the page
            frame = main = False
        if tag in ("article", "main"):
            frame = not COMMENT_NAMES.isdisjoint(tokens)
            whole = main = not frame
        frame = frame or tag in FRAME_TAGS or tag == "header" and not (up and up.main)
        self.frame = frame or bool(up and up.frame)
        # 2 by an element or a whole name, 1 by a part of a name.
        self.main = max((2 if whole else 1) if main and not self.frame else 0, up.main if up else 0)
        self.hidden = hidden or tag in HIDDEN_TAGS or bool(up and up.hidden)
        self.text = tag in TEXT_TAGS or bool(up and up.text and tag not in ("li", "td", "div"))
        self.list = tag == "li" or bool(up and up.list)
        self.table = tag in ("td", "th") or bool(up and up.table)
        self.link = tag == "a" or bool(up and up.link)


def ends_in_value(attributes: str) -> bool:
    """Whether the slash at the end belongs to a value without quotes, as in ``href=/``."""
    return "=" in attributes[max(map(attributes.rfind, " \t\n\f\r\"'")) + 1:]


def blocks_of(page: str) -> tuple[list[str], list[list[float]]]:
    """The flat text blocks of a page and their features, without hidden parts. Linear in the page."""
    texts: list[str] = []
    rows: list[list[float]] = []
    parts: list[str] = []
    linked = 0
    holder: Element | None = None
    marks: list[int] = []
    stack: list[Element] = [Element("html", None, "")]
    open_tags: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, holder
        if parts:
            text = WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            if text and holder is not None:
                words = text.count(" ") + 1
                texts.append(text)
                rows.append([words, min(1.0, linked / words), 0, 0, 0, 0, 0 if holder.frame else 1, holder.text, holder.list, holder.table, False])
                marks.append(0 if holder.frame else holder.main)
            parts.clear()
        linked, holder = 0, None

    def put(text: str) -> None:
        nonlocal linked, holder
        top = stack[-1]
        if top.hidden or not text:
            return
        parts.append(text)
        if not text.isspace():
            holder = holder or top
            if top.link:
                linked += len(text.split())

    def close(tag: str) -> None:
        if not open_tags.get(tag):
            return
        while True:
            done = stack.pop()
            open_tags[done.tag] -= 1
            if done.tag in BLOCKS:
                flush()
            if done.tag == tag:
                return

    at, last = 0, page.rfind(">")
    search = TAG.search
    while True:
        found = search(page, at) if at <= last else None
        if found is None:  # what may start a tag that never ends is no text
            unended = UNENDED.search(page, at)
            put(page[at:unended.start() if unended else len(page)])
            break
        put(page[at:found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if tag in ("br", "p") and not open_tags.get(tag):
                flush()
            elif tag in ("body", "html"):
                flush()
            else:
                close(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            put(" ")
        if tag in ENDS_P and open_tags.get("p"):
            close("p")
        for other in SAME_ENDS.get(tag, ()):
            if stack[-1].tag == other or other in ("td", "th", "li") and stack[-1].tag not in ("ul", "ol", "table", "tbody", "menu", "tr") and open_tags.get(other):
                close(other)
        if tag == "body":  # ends an open head
            close("head")
        element = Element(tag, stack[-1], found[3])
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS and not ends_in_value(found[3]):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append(element)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    words = [0.0, 0.0, 0.0]  # by mark, without links
    for row, mark in zip(rows, marks):
        if row[6]:
            words[mark] += row[0] * (1 - row[1])
    # A name such as text-center or post-date somewhere on a page marks no main part.
    least = 1 if words[1] + words[2] >= PART_SHARE * sum(words) else 2 if words[2] >= WHOLE_SHARE * sum(words) else 3
    page_marked = any(mark >= least for mark in marks)
    for i, (row, mark) in enumerate(zip(rows, marks)):
        if mark >= least:
            row[6] = 2
        row[10] = page_marked
        if i:
            row[2], row[3] = rows[i - 1][0], rows[i - 1][1]
        if i + 1 < len(rows):
            row[4], row[5] = rows[i + 1][0], rows[i + 1][1]
    return texts, rows


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left, right) or (label,). The first of
    equally good splits is taken, so training is the same everywhere."""
    label = bool(2 * y.sum() >= len(y))
    if depth == 0 or y.all() or not y.any() or len(y) < 2 * least:
        return (label,)
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < cut
            n, m = int(left.sum()), int((~left).sum())
            if min(n, m) < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = 2 * n * p * (1 - p) + 2 * m * q * (1 - q)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best[1] is None:
        return (label,)
    left = x[:, best[1]] < best[2]
    return (best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def says(tree: tuple, row: list[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


def labelled_blocks(pages: tuple[str, ...] = BLOCK_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages, in which a main block starts with ``@@``."""
    rows, labels = [], []
    for page in pages:
        texts, features = blocks_of(page)
        rows += features
        labels += [t.startswith("@@") for t in texts]
    return np.asarray(rows, dtype=np.float64), np.asarray(labels, dtype=bool)


def train(depth: int = 10, least: int = 1) -> tuple:
    return grow(*labelled_blocks(), depth, least)


def main_text(page: str | None, tree: tuple) -> str:
    if not page:
        return ""
    texts, rows = blocks_of(page)
    return "\n".join([t for t, row in zip(texts, rows, strict=True) if says(tree, row)])


def extract(pages: DataFrame, html: str = "html", tree: tuple | None = None) -> DataFrame:
    """``pages`` without its html, and the main text and its length n_chars of every whole page.

    Null and empty pages have an empty text; rows that repeat give a row each; columns of ``pages`` with these names
    are replaced. One narrow pass without a shuffle; the tree has a few nodes and goes with the tasks."""
    tree = train() if tree is None else tree
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [main_text(x.as_py(), tree) for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    return pages.select(*kept, F.col(html).cast("string").alias("_html")).mapInArrow(work, schema)


@query("op9_block_tree")
def op9_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
