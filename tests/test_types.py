"""Labels and storage types, with pandas' text reader as the judge of the latter."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pandas.io.parsers import TextParser
from pyspark.sql import functions as F

from doctables.functions.jsonpath import field, lenient_integer
from doctables.operators.clean import name_columns, normalize_missing
from doctables.operators.profile import profile_cells, profile_grids, schema_records
from doctables.plans.ingest import stored_rows

GRID = "doc_id string, source_file string, ordinal int, table_id string, html string, header array<array<string>>, body array<array<string>>, ok boolean, error string"


def grid(spark, tables):
    """Grids from (header rows, body rows)."""
    rows = [(str(i), "f.html", 1, f"t{i}", None, h, b, True, None) for i, (h, b) in enumerate(tables)]
    return spark.createDataFrame(rows, GRID)


def profiled(spark, tables, **options):
    return profile_grids(name_columns(normalize_missing(grid(spark, tables))), **options)


def labels(spark, columns, **options):
    """Label per single-column table."""
    tables = [([["c", "pad"]], [[v, "x"] for v in c]) for c in columns]
    done = profiled(spark, tables, **options).select(F.col("doc_id").cast("int"), F.get("labels", F.lit(0)))
    return [label for _, label in sorted(tuple(r) for r in done.collect())]


def test_label_rules(spark):
    cases = [
        (["1"] * 8 + ["x"] * 2, "string"),  # exactly 80 % is not enough
        (["1"] * 9 + ["x"] * 2, "integer"),
        (["0", "1", "0"], "integer"),
        (["yes", "No", "ON"], "boolean"),
        (["True", "false"], "boolean"),
        (["-", "-"], "string"),
        (["", "NA"], "float"),  # all missing
        (["1", "2", ""], "float"),  # integers with a gap
        (["1", "-", "3"], "integer"),
        (["1", "2", "3", "4", "5", "6", "7", "8", "9", "1.5"], "float"),
        (["15,420", "8,750"], "integer"),
        (["a", "", "", "", "", "", ""], "float"),  # missing cells count as floats
        (["1_000", "+7"], "integer"),
        (["99999999999999999999", "1"], "integer"),
        (["inf", "1e5", ".5"], "float"),
        ([" - ", " - "], "string"),
        (["2024-01-02", "2024/1/3"], "string"),
        ([], "string"),
    ]
    assert labels(spark, [c for c, _ in cases]) == [label for _, label in cases]


def test_label_options(spark):
    columns = [["", "NA"], ["1", "2", ""], ["a", "", "", "", "", "", ""], ["2024-01-02", "2024/1/3", ""]]
    assert labels(spark, columns, missing_counts_as_float=False, dates=True) == ["string", "integer", "string", "date"]


def test_cells_and_grids_agree(spark):
    columns = [["1", "", "2.5"], ["yes", "no"], ["x", "-", "3"], ["7", "8"]]
    long = spark.createDataFrame(
        [(f"t{i}", v if v else None) for i, c in enumerate(columns) for v in c], "table_id string, value string"
    )
    found = {r["table_id"]: r["label"] for r in profile_cells(long, ["table_id"]).collect()}
    assert [found[f"t{i}"] for i in range(4)] == labels(spark, columns)


CELLS = st.sampled_from(
    ["", "1", "0", "-3", " 2", "1,234", "12,34.5", "1.5", "1e3", "NA", "null", "x", "-", "True", "false",
     "yes", "1_000", "00012", "n/a", "a,b", ".5", "5."]
)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(CELLS, min_size=1, max_size=6), min_size=150, max_size=150))
def test_storage_types_equal_pandas(spark, columns):
    tables = [([["c", "pad"]], [[v, "x"] for v in c]) for c in columns]
    done = profiled(spark, tables).select(F.col("doc_id").cast("int").alias("i"), F.get("storage", F.lit(0)).alias("s"))
    ours = {r["i"]: r["s"] for r in done.collect()}
    for i, c in enumerate(columns):
        theirs = str(TextParser([["c", "pad"]] + [[v, "x"] for v in c], header=0, thousands=",").read()["c"].dtype)
        assert ours[i] == theirs, (c, theirs)


@pytest.mark.parametrize(
    "header",
    [
        [["a", "a", "a.1", "a", ""]],
        [["", "", "x"]],
        [["g", "g", ""], ["x", "", "z"]],
        [["a", "b", "c"]],
        [],
    ],
)
def test_names_equal_pandas(spark, header):
    width = len(header[0]) if header else 3
    body = [[str(i) for i in range(width)], ["x"] * width]
    ours = profiled(spark, [(header, body)]).select("columns").first()[0]
    index = list(range(len(header)))
    read = TextParser(header + body, header=(index if len(index) > 1 else 0) if header else None).read()
    theirs = []
    for i, c in enumerate(read.columns):
        if isinstance(c, tuple):
            parts = [p for p in c if p not in ("", "Unnamed: 0", "Unnamed")]
            theirs.append("_".join(parts) if parts else f"col_{i}")
        else:
            theirs.append(str(c))
    assert ours == theirs


def test_meeting_joined_names_are_a_failed_schema(spark):
    header = [["a", "a"], ["b", "b"]]
    record = schema_records(profiled(spark, [(header, [["1", "2"]])])).first()
    assert not record["ok"] and "duplicate column name" in record["error"]


def test_json_rows(spark):
    header = [['he said "x"', "n", "f", "b", "t"]]
    body = [["a\\b\n", "1,000", "2.50", "True", "é"], ["", "2", "", "False", "15,x"]]
    rows = stored_rows(profiled(spark, [(header, body)]), F.lit(None).cast("timestamp")).orderBy("row_index")
    first, second = (r["row_data"] for r in rows.collect())
    assert first == '{"he said \\"x\\"": "a\\\\b\\n", "n": 1000, "f": 2.5, "b": true, "t": "é"}'
    assert second == '{"he said \\"x\\"": null, "n": 2, "f": null, "b": false, "t": "15,x"}'
    values = rows.select(field('he said "x"'), field("n")).collect()
    assert values[0][1] == "1000"


def test_lenient_integer(spark):
    v = spark.createDataFrame([("15,420",), ("abc",), ("1.9",), (None,), (" -3x",)], "v string")
    assert [r[0] for r in v.select(lenient_integer(F.col("v"))).collect()] == [15, 0, 1, None, -3]
