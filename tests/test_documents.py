"""Markdown documents, line by line against a plain-Python reading of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doctables.operators import documents as docs
from doctables.operators.markdown import parse_pipe_tables


def plain_split(text):
    """The chunks of a text: a chunk ends where 'inside a table' changes."""
    chunks, inside = [[]], False
    for line in text.split("\n"):
        bare = line.strip()
        pipes = len(bare) >= 2 and bare[0] == "|" and bare[-1] == "|"
        rule = bool(bare) and not re.sub(r"[|\-:\s]", "", bare)
        now = pipes or (inside and rule)
        if now != inside:
            chunks.append([])
        chunks[-1].append(line)
        inside = now
    return [c for c in ("\n".join(c).strip() for c in chunks) if c]


LINES = st.sampled_from(
    ["| a | b |", "|---|---|", "---", "", "text", "  | x |  ", "|", "||", "| open", "::", "a | b", "\t|t|\r", "\xa0|n|", "- item", " "]
)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(LINES, max_size=12), min_size=300, max_size=300))
def test_split_equals_plain_reading(spark, texts):
    texts = ["\n".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in docs.split_markdown(df).select("doc_id", "chunks", "table_positions").collect()}
    for i, text in enumerate(texts):
        chunks = plain_split(text)
        assert [c["text"] for c in got[i]["chunks"]] == chunks, repr(text)
        tables = [
            p for p, c in enumerate(chunks)
            if sum(bool(re.match(r"^(\|.*\|)$", x.strip())) for x in c.split("\n")) > len(c.split("\n")) * 0.5
        ]
        assert got[i]["table_positions"] == tables, repr(text)


def test_long_table_and_long_document(spark):
    df = spark.range(1).select(
        F.lit("d").alias("doc_id"),
        F.concat(F.lit("start\n"), F.repeat(F.lit("| a | b |\n"), 100_000), F.repeat(F.lit("word\n| t |\n"), 2_000)).alias("text"),
    )
    row = docs.split_markdown(df).select(F.size("chunks"), F.size("table_positions")).first()
    assert tuple(row) == (2 + 4_000, 1 + 2_000)


def test_replace_and_find_again(spark):
    text = "Intro\n| a |\n|---|\n| 1 |\nmiddle\n| b |\n| 2 |\nend"
    split = docs.split_markdown(spark.createDataFrame([("d", text), ("e", "no table")], "doc_id string, text string"))
    told = spark.createDataFrame(
        [("d", 1, " first\nline ", "success"), ("d", 2, "x", "error"), ("d", 3, "beyond", "success")],
        "doc_id string, ordinal int, description string, status string",
    )
    replaced = docs.assemble(docs.replace_tables(split, told))
    out = {r["doc_id"]: r for r in replaced.collect()}
    assert out["d"]["processed"] == (
        docs.PROCESSED_HEADER + "Intro\n\n**Table 1 Summary:** first\nline\n\nmiddle\n\n| b |\n| 2 |\n\nend"
    )
    assert out["e"]["processed"] == docs.PROCESSED_HEADER + "no table"
    totals = {r["doc_id"]: tuple(r)[1:] for r in docs.replacement_totals(replaced).collect()}
    assert totals == {"d": (1, 1, 1), "e": (0, 0, 0)}
    found = docs.table_references(replaced).collect()
    assert [(r["table_id"], r["description"]) for r in found] == [(1, "first\nline")]
    processed = out["d"]["processed"]
    assert processed[found[0]["start_position"] : found[0]["end_position"]] == "**Table 1 Summary:** first\nline"


def test_references_next_to_each_other(spark):
    text = "a **Table 1 Summary:** one **Table 22 Summary:** two\nmore\n\nrest **Table 3 Summary:** three"
    df = spark.createDataFrame([("d", text)], "doc_id string, processed string")
    pattern = r"\*\*Table (\d+) Summary:\*\* (.+?)(?=\n\n|\*\*Table|\Z)"
    wanted = [
        (int(m[1]), m[2].strip(), m.start(), m.end(), len(m[2].strip())) for m in re.finditer(pattern, text, re.S)
    ]
    got = sorted(tuple(r)[1:] for r in docs.table_references(df).collect())
    assert got == sorted(wanted) and len(got) == 3


def rows(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r["table_rows"] for r in parse_pipe_tables(df).orderBy("doc_id").collect()]


def test_pipe_tables(spark):
    got = rows(
        spark,
        "x\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n| 3 | 4 |\nend\n| 5 | 6 |",  # a blank line does not end it
        "| a | b |\n|---|---|",  # no rows
        "| a | b |\n| 1 |\n| 2 | 3 |",  # a short row
        "| a | b |\n| 1 |",  # no row as wide as the header
        "| a |\n| 1 | 2 |",  # a wider row
        "||| a | b ||\n|| 1 | 2 |||",  # all edge pipes go
        "no table",
        "|\n| a |\n| open\n| 1 |",  # a line that only starts with a pipe is skipped
    )
    assert got == [
        [["a", "b"], ["1", "2"], ["3", "4"]], [], [["a", "b"], ["1", None], ["2", "3"]], [], [],
        [["a", "b"], ["1", "2"]], [], [["a"], ["1"]],
    ]
