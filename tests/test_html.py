"""HTML tables: grids of awkward pages, and header and type rules against pandas' own reader."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sample import SAMPLE_PAGE

from doctables.sources.extract import _markdown_batches
from doctables.sources.html_tables import page_to_markdown, parse_html


def grids(page):
    return [(t.header, t.body) for t in parse_html(page)]


def test_sample_page():
    first, second = grids(SAMPLE_PAGE)
    assert first[0] == [["Light", "Year", "Steps", "Visitors", "Range km", "Open"]]
    assert first[1][2] == ["Tern Rock", "1861", "305", "120,900", "42.25", "yes"]
    assert len(second[1]) == 3


@pytest.mark.parametrize(
    "page, header, body",
    [
        # leading rows of th cells are the header; without any, there is none
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", [["a", "b"]], [["1", "2"]]),
        ("<table><tr><td>a<td>b<tr><td>1<td>2</table>", [], [["a", "b"], ["1", "2"]]),
        # spans repeat the text, also past the last row
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", [], [["x", "1"], ["x", "2"]]),
        ("<table><tr><td colspan='2'>x<td>1<tr><td>2<td>3<td>4</table>", [], [["x", "x", "1"], ["2", "3", "4"]]),
        ("<table><tr><td>a<td rowspan=3>b<tr><td>c</table>", [], [["a", "b"], ["c", "b"], ["b", ""]]),
        # two header rows
        ("<table><thead><tr><th colspan=2>g<tr><th>x<th>y</thead><tr><td>1<td>2</table>", [["g", "g"], ["x", "y"]], [["1", "2"]]),
        # an empty header row among several is left out
        ("<table><thead><tr><th><th><tr><th>x<th>y</thead><tr><td>1<td>2</table>", [["x", "y"]], [["1", "2"]]),
        # ragged rows are filled, hidden ones skipped, footers come last
        ("<table><tfoot><tr><td>f</tfoot><tr><td>1<td>2<tr style='display: none'><td>no<td>no<tr><td>3</table>", [], [["1", "2"], ["3", ""], ["f", ""]]),
        # text: entities, breaks, collapsed white space, comments, script
        ("<table><tr><td> a&amp;b <br> c\n\n d <td><b>e</b><!-- <td>x --><script>'<td>'</script></table>", [], [["a&b c  d", "e"]]),
        # never closed; upper case
        ("<p>x<TABLE><TR><TD>1<TD>2", [], [["1", "2"]]),
        # attribute values may hold angle brackets
        ("<table data-x='a>b'><tr><td title=\"</td>\">1<td>2</table>", [], [["1", "2"]]),
        # quotes count only behind "="; unquoted values run to a blank or ">"
        ("<table data-x=a<b><tr><td width=5\">A</td><td width=\"6\">B</td><tr><td title=it's>C</td><td>D</table>", [], [["A", "B"], ["C", "D"]]),
        # hidden elements end at the closing tag of their depth
        ("<table><tr><td><div style='display:none'><div>x</div>y</div>z<td>2</table>", [], [["z", "2"]]),
        # a very wide span keeps all rows
        ("<table><tr><td colspan=2000000000>a<tr><td>b</table>", [], [["a"] * 1000, ["b"] + [""] * 999]),
        # blank rows of a one-column table are skipped
        ("<table><tr><th>a<tr><td>1<tr><td> <tr><td>2</table>", [["a"]], [["1"], ["2"]]),
    ],
)
def test_grid(page, header, body):
    assert grids(page) == [(header, body)]


def test_nested_table_is_its_own_table():
    page = "<table><tr><td>out<table><tr><td>in<td>side</table><td>2</table>"
    outer, inner = grids(page)
    assert outer == ([], [["outinside", "2"]])
    assert inner == ([], [["in", "side"]])
    sources = [t.html for t in parse_html(page)]
    assert sources[0] == page and sources[1] == "<table><tr><td>in<td>side</table>"


def test_bad_tables_are_error_records():
    page = "<table></table><table><tr><td colspan=99999999 rowspan=9>x</table><table><tr><td>1<td>2</table>"
    first, second, third = parse_html(page)
    assert "No tables found" in first.error and second.error is None
    assert len(second.body) == 9 and {len(r) for r in second.body} == {1000}
    assert third.error is None and third.name == "table_3"


def test_no_table():
    assert grids("<p>nothing</p><!-- <table><tr><td>1</table> -->") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/tabletrdh ='\"!-&x\n", max_size=120))
def test_any_text_is_parsed(text):
    for t in parse_html(text):
        assert t.error or all(len(r) == len((t.header + t.body)[0]) for r in t.header + t.body)
    page_to_markdown(text)


def test_markdown():
    text = page_to_markdown(SAMPLE_PAGE)
    assert text.startswith("# Harbour guide\n\nAll lights north of the bay.\n\n| Light | Year |")
    assert "\n|---|---|---|---|---|---|\n| Grey Point | 1874 |" in text
    page = "<ul><li>one<li>two</ul><h2>A<br>B</h2><style>p{}</style>tail<script>x</script>"
    assert page_to_markdown(page) == "- one\n- two\n\n## A\nB\n\ntail"


def test_markdown_of_a_batch_leaves_in_parts():
    pages = ["<p>" + "ab " * 100_000 + "</p>", None, "<h1>x</h1>"] * 8
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(24)], "source_file": ["f"] * 24, "html": pages})
    parts = list(_markdown_batches(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 1 and max(p.column(2).nbytes for p in parts) < 1_400_000
    done = pa.Table.from_batches(parts).to_pydict()
    assert done["doc_id"] == [str(i) for i in range(24)] and done["text"] == [page_to_markdown(x or "") for x in pages] and not any(done["error"])


def test_unclosed_tables_are_scanned_once():
    for n in (100, 1600):
        page = "<table><tr><td>x y" * n
        found = list(parse_html(page))
        assert len(found) == n and sum(len(t.html) for t in found) == len(page)
        assert all(t.body == [["x y"]] for t in found)
