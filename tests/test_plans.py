"""What the physical plans must and must not hold."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from doctables.workload import QUERIES

PACKAGE = Path(__file__).parent.parent / "doctables"
PYTHON = ("s1_", "s6_", "s7_", "s8_", "u1_", "s4_", "s5_", "s2_page_extraction", "s13_", "s14_", "s16_", "d2_", "d4_", "p6_", "k2_", "i2_", "st2_", "extract_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_library_does_not_collect():
    for f in PACKAGE.rglob("*.py"):
        if "llm" in f.relative_to(PACKAGE).parts:
            continue  # judged by its own tests
        assert not re.search(r"\.(collect|toPandas|toLocalIterator|localCheckpoint|crossJoin)\(", f.read_text()), f


@pytest.mark.parametrize("name", [n for n in QUERIES if re.match(r"[a-z]+\d", n) and not n.startswith(PYTHON)])
def test_native_queries_stay_in_the_jvm(spark, sf, name):
    if name[0] in "kgxiu":  # these write and read back; their inputs are covered by the others
        return
    text = plan(QUERIES[name](spark, sf))
    assert "MapInArrow" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name", ["w1_w2_chunks", "s10_pipe_tables", "c1_c5_clean_sheet", "n4_parse_analysis", "p1_predicates"]
)
def test_row_local_operators_do_not_shuffle(spark, sf, name):
    """Beyond dealing out a small file and the making of the input, there is no exchange."""
    made = {"c1_c5_clean_sheet": 1}.get(name, 0)
    text = plan(QUERIES[name](spark, sf))
    exchanges = len(re.findall(r"\bExchange\b", text)) - len(re.findall(r"Exchange RoundRobinPartitioning", text))
    assert exchanges <= made, text


def test_columns_are_pruned(spark, sf):
    text = plan(QUERIES["j2_count_rows"](spark, sf))
    assert re.search(r"ReadSchema: struct<o_orderstatus:string>", text)
    text = plan(QUERIES["j12_largest_table"](spark, sf))
    assert re.search(r"ReadSchema: struct<o_orderstatus:string>", text) and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["s16_built_pages", "s4_odd_markup", "u1_registered_format"])
def test_narrow_tables_are_dealt_out_before_python(spark, sf, name):
    """All of such a table is one split of a scan; its rows are many tasks' work."""
    df = QUERIES[name](spark, sf)
    assert df.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    assert re.search(r"MapInArrow[\s\S]*Exchange hashpartitioning", plan(df))
