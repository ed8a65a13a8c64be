"""HTML parsing inside a task: one document text in, its tables out.

Only the table structure is scanned; cell text is cleaned per cell. Unclosed tags end with
their parent or with the document, so a broken page still yields its tables.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Attributes as HTML reads them: a quote counts only behind "=", an unquoted value runs to a blank or ">".
_ATTRS = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?|[\"'])*+"
_OPAQUE = r"!--.*?(?:-->|\Z)|(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)"
_TOKEN = re.compile(
    rf"<(?:(/?)(table|thead|tbody|tfoot|tr|td|th)(?=[\s/>])({_ATTRS})>|{_OPAQUE})", re.I | re.S
)
_ELEMENT = re.compile(rf"<(?:{_OPAQUE}|(/?)([a-z][^\s/>]*+)({_ATTRS})>)", re.I | re.S)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BREAK = re.compile(r"<br\b[^>]*>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z!]{_ATTRS}>", re.S)
_SPACES = re.compile(r"[\r\n]+|\s{2,}")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_COLSPAN = re.compile(r"\bcolspan\s*=\s*[\"']?\s*(\d+)", re.I)
_ROWSPAN = re.compile(r"\browspan\s*=\s*[\"']?\s*(\d+)", re.I)

# Fixed values of the HTML standard: larger spans count as these.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass(slots=True)
class _Row:
    section: str
    hidden: bool
    cells: list[list] = field(default_factory=list)  # [tag, attributes, start, end]


@dataclass(slots=True)
class _Table:
    start: int
    hidden: bool
    end: int = -1
    section: str = ""
    rows: list[_Row] = field(default_factory=list)
    row: _Row | None = None
    cell: list | None = None

    def close_cell(self, at: int) -> None:
        if self.cell is not None:
            self.cell[3] = at
            self.cell = None

    def close_row(self, at: int) -> None:
        self.close_cell(at)
        self.row = None

    def open_row(self, hidden: bool) -> None:
        self.row = _Row(self.section, hidden)
        self.rows.append(self.row)


def _is_hidden(attrs: str) -> bool:
    return bool(attrs) and bool(_HIDDEN.search(attrs))


def _scan(text: str) -> list[_Table]:
    """Find tables, rows and cells by their tags; a tag left open ends with its parent."""
    found: list[_Table] = []
    stack: list[_Table] = []
    table: _Table | None = None
    # Behind the last ">" no tag can end.
    for token in _TOKEN.finditer(text, 0, text.rfind(">") + 1):
        closing, tag, attrs = token.groups()
        if tag is None:
            continue
        tag, at = tag.lower(), token.start()
        if tag == "table":
            if not closing:
                table = _Table(at, _is_hidden(attrs))
                found.append(table)
                stack.append(table)
            elif stack:
                done = stack.pop()
                done.close_row(at)
                done.end = token.end()
                table = stack[-1] if stack else None
        elif table is None:
            continue
        elif tag == "td" or tag == "th":
            table.close_cell(at)
            if not closing:
                if table.row is None:
                    table.open_row(False)
                table.cell = [tag, attrs, token.end(), -1]
                table.row.cells.append(table.cell)
        elif tag == "tr":
            table.close_row(at)
            if not closing:
                table.open_row(_is_hidden(attrs))
        else:
            table.close_row(at)
            table.section = "" if closing else tag
    # A table left open ends where the next one left open begins, so that no text is in two of them.
    for table, after in zip(stack, [*stack[1:], None]):
        table.end = after.start if after else len(text)
        table.close_row(table.end)
    return found


def _shown(fragment: str) -> str:
    """A fragment without scripts, styles, comments and hidden elements; these end with the closing tag
    of the same depth, or with the fragment."""
    parts: list[str] = []
    at, hidden, depth = 0, "", 0
    for token in _ELEMENT.finditer(fragment):
        closing, tag, attrs = token.groups()
        if hidden:
            if tag and tag.lower() == hidden:
                depth += -1 if closing else 1
                if depth == 0:
                    at, hidden = token.end(), ""
        elif tag is None:
            parts.append(fragment[at : token.start()])
            at = token.end()
        elif not closing and _is_hidden(attrs):
            parts.append(fragment[at : token.start()])
            at = token.end()
            if tag.lower() not in _VOID:
                hidden, depth = tag.lower(), 1
    if not hidden:
        parts.append(fragment[at:])
    return "".join(parts)


def cell_text(fragment: str) -> str:
    if "<" in fragment:
        fragment = _TAG.sub("", _BREAK.sub("\n", _shown(fragment)))
    if "&" in fragment:
        fragment = entities.unescape(fragment)
    return _SPACES.sub(" ", fragment.strip())


def _span(pattern: re.Pattern, attrs: str, most: int) -> int:
    value = pattern.search(attrs)
    return min(max(int(value.group(1)[:9]), 1), most) if value else 1


def _expand(text: str, rows: list[_Row]) -> list[list[str]]:
    """Repeat the text of spanned cells; a row span may run past the last row."""
    out: list[list[str]] = []
    held: dict[int, tuple[str, int]] = {}  # column -> text, rows still to fill
    for row in [*rows, None]:
        while True:
            line: list[str] = []
            kept: dict[int, tuple[str, int]] = {}

            def place(value: str, down: int) -> None:
                if down > 1:
                    kept[len(line)] = (value, down - 1)
                line.append(value)

            for _, attrs, start, end in row.cells if row else ():
                if not attrs and not held:
                    line.append(cell_text(text[start:end]))
                    continue
                if _is_hidden(attrs):
                    continue
                value, down = cell_text(text[start:end]), _span(_ROWSPAN, attrs, MOST_ROWS)
                across = _span(_COLSPAN, attrs, MOST_COLUMNS)
                for _ in range(across):
                    while len(line) in held:
                        place(*held.pop(len(line)))
                    place(value, down)
            for at in sorted(held):  # the rest, also beyond the end of a short row
                place(*held.pop(at))
            if row is None and not line:
                break
            out.append(line)
            held = kept
            if row is not None:
                break
    return out


def _grid(text: str, table: _Table) -> tuple[list[list[str]], list[list[str | None]]]:
    rows = [r for r in table.rows if not r.hidden]
    head = [r for r in rows if r.section == "thead"]
    body = [r for r in rows if r.section == "tbody"] + [r for r in rows if r.section == ""]
    foot = [r for r in rows if r.section == "tfoot"]
    if not head:
        while body and all(c[0] == "th" for c in body[0].cells):
            head.append(body.pop(0))
    head_rows = _expand(text, head)
    lines = _expand(text, body) + _expand(text, foot)
    if len(head_rows) > 1:
        last = max((i for i, r in enumerate(head_rows) if any(r)), default=-1)
        lines = head_rows[last + 1 :] + lines
        head_rows = [r for r in head_rows[: last + 1] if any(r)]
    width = max((len(r) for r in [*head_rows, *lines]), default=0)
    if width == 0 or not any(any(r) for r in [*head_rows, *lines]):
        raise ValueError("No tables found")
    pad = lambda r: r + [""] * (width - len(r))
    lines = [pad(r) for r in lines if width > 1 or (r and r[0])]
    return [pad(r) for r in head_rows], lines


@dataclass
class ParsedTable:
    name: str
    html: str | None
    header: list[list[str]]
    body: list[list[str | None]]
    error: str | None = None


def parse_html(content: bytes | str) -> Iterator[ParsedTable]:
    """All tables of a page in document order; a nested one also on its own."""
    text = content if isinstance(content, str) else content.decode("utf-8", "replace")
    for ordinal, table in enumerate(_scan(text), 1):
        source = text[table.start : table.end]
        name = f"table_{ordinal}"
        try:
            if table.hidden:
                raise ValueError("No tables found")
            header, body = _grid(text, table)
            yield ParsedTable(name, source, header, body)
        except Exception as error:  # one bad table must not lose the others
            yield ParsedTable(name, source, [], [], f"Schema extraction failed: {error}")


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items and tables of a page as markdown blocks."""

    _BLOCKS = {"p", "div", "section", "article", "nav", "ul", "ol", "header", "footer", "main",
               "blockquote", "pre", "body", "aside", "form", "figure", "dl"}
    _SKIPPED = {"script", "style", "title", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.buffer: list[str] = []
        self.prefix = ""
        self.skipping = 0

    def flush(self, prefix: str = "") -> None:
        lines = [" ".join(x.split()) for x in "".join(self.buffer).split("\n")]
        text = "\n".join(x for x in lines if x)
        if text:
            item = self.prefix == "- "
            if item and self.blocks and self.blocks[-1].startswith("- "):
                self.blocks[-1] += "\n- " + text
            else:
                self.blocks.append(self.prefix + text)
        self.buffer, self.prefix = [], prefix

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self._SKIPPED:
            self.skipping += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.flush("- ")
        elif tag == "br":
            self.buffer.append("\n")
        elif tag in self._BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "li" or tag in self._BLOCKS or re.fullmatch(r"h[1-6]", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.buffer.append(data.replace("\n", " "))


def _pipe_table(header: list[list[str]], body: list[list[str | None]]) -> str:
    rows = [[(c or "").replace("|", "\\|") for c in r] for r in [*header[:1], *header[1:], *body]]
    width = len(rows[0])
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    lines.insert(max(len(header), 1), "|" + "---|" * width)
    return "\n".join(lines)


def page_to_markdown(text: str) -> str:
    """A page as markdown text; top-level tables become pipe tables."""
    blocks: list[str] = []
    at = 0
    for table in [*_scan(text), None]:
        if table is not None and table.start < at:
            continue  # nested in the previous one
        part = _Markdown()
        part.feed(text[at : table.start if table else len(text)])
        part.close()
        part.flush()
        blocks += part.blocks
        if table is not None:
            at = table.end
            try:
                blocks.append(_pipe_table(*_grid(text, table)))
            except ValueError:
                pass  # a layout table without any text has no markdown form
    return "\n\n".join(blocks)
