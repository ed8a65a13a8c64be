"""Pipe tables of markdown texts, and grids written as HTML or markdown text.

A text is one cell, so its lines are an array in its own row: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import keep_rows
from ..functions.text import WHITESPACE, file_stem, html_escape, strip
from ..sources.grids import grid_from_columns


def _is_pipe_line(line: Column) -> Column:
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|"))


def _is_separator(line: Column) -> Column:
    return F.translate(line, "|-: ", "") == ""


def _pipe_cells(line: Column) -> Column:
    inner = strip(F.trim(line, F.lit("|")))
    return F.transform(F.split(inner, r"\|", -1), strip)


def parse_pipe_tables(texts: DataFrame, text: str = "text") -> DataFrame:
    """The first pipe table of every text, as ``table_rows`` (header first).

    It starts at the first line in pipes and goes on to the first non-blank line that does not
    start with a pipe; blank and separator lines in between are skipped. Fewer than two rows,
    or no row as wide as the header, or a wider one: no table (empty array). Short rows are
    filled with NULL."""
    lines = F.transform(F.split(F.col(text), "\n", -1), strip)
    staged = texts.withColumn("_lines", lines)
    first = F.array_position(F.transform("_lines", _is_pipe_line), F.lit(True))  # 1-based, 0 none
    staged = staged.withColumn(
        "_tail",
        F.when(first > 0, F.slice("_lines", first, F.size("_lines"))).otherwise(
            F.array().cast("array<string>")
        ),
    ).drop("_lines")
    stop = F.array_position(
        F.transform("_tail", lambda x: (x != "") & ~F.startswith(x, F.lit("|"))), F.lit(True)
    )
    inside = F.when(stop > 0, F.slice("_tail", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("_tail"))
    staged = staged.withColumn(
        "_rows",
        F.transform(
            F.filter(inside, lambda x: _is_pipe_line(x) & ~_is_separator(x)), _pipe_cells
        ),
    ).drop("_tail")
    width = F.size(F.get("_rows", F.lit(0)))
    widest = F.array_max(F.transform(F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1))), F.size))
    good = (F.size("_rows") >= 2) & (widest == width)
    padded = F.transform(
        "_rows",
        lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))),
    )
    return staged.withColumn(
        "table_rows",
        F.when(good, padded).otherwise(F.array().cast("array<array<string>>")),
    ).drop("_rows")


def pipe_table_grids(texts: DataFrame, text: str = "text") -> DataFrame:
    """One grid ``<stem>_markdown_table`` per text with a pipe table."""
    found = keep_rows(parse_pipe_tables(texts, text), F.size("table_rows") > 0)
    return grid_from_columns(
        found,
        F.concat(file_stem(F.col("source_file")), F.lit("_markdown_table")),
        F.lit(1),
        F.slice("table_rows", 1, 1),
        F.slice("table_rows", F.lit(2), F.size("table_rows") - 1),
        F.col("source_file"),
    )


def render_html(columns: Column, body: Column, escape: bool = True) -> Column:
    """A grid as HTML table text, without an index."""
    safe = html_escape if escape else (lambda c: c)

    def line(tag: str, cells: Column) -> Column:
        marked = F.transform(
            cells,
            lambda c: F.concat(F.lit(f"<{tag}>"), safe(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>")),
        )
        return F.concat(F.lit("<tr>"), F.array_join(marked, ""), F.lit("</tr>"))

    return F.concat(
        F.lit("<table><thead>"),
        line("th", columns),
        F.lit("</thead><tbody>"),
        F.array_join(F.transform(body, lambda r: line("td", r)), ""),
        F.lit("</tbody></table>"),
    )


def render_markdown(columns: Column, body: Column) -> Column:
    """A grid as a pipe table, without an index."""

    def line(cells: Column) -> Column:
        return F.concat(
            F.lit("| "),
            F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "),
            F.lit(" |"),
        )

    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda c: F.lit("---|")), ""))
    return F.array_join(
        F.concat(F.array(line(columns), rule), F.transform(body, line)), "\n"
    )


# A run of table lines: a line in pipes, then more of these or separator lines. Possessive, so
# that a table of any length is matched in one forward pass.
_BLANK = "".join(rf"\u{ord(c):04x}" for c in WHITESPACE if c != "\n")
_PIPE_LINE = rf"[{_BLANK}]*\|.*\|[{_BLANK}]*"
_SEPARATOR_LINE = rf"[|\-:{_BLANK}]*[|\-:][|\-:{_BLANK}]*"
TABLE_BLOCK = rf"(?md)^{_PIPE_LINE}$(?:\n(?:{_PIPE_LINE}|{_SEPARATOR_LINE})$)*+"
TABLE_LINE = rf"^{_PIPE_LINE}$"
