"""As-of and interval joins, regions of a sheet and shredded rows against plain loops, and their plans."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from doctables.operators.ranges import asof_join, covering_cells, interval_join
from doctables.operators.regions import split_regions
from doctables.operators.shredded import choose_columns, field_counts, read_shredded, shred, write_shredded
from doctables.workload import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3.0])
def test_asof_join(spark, forward, strict, tolerance):
    rng = random.Random(f"{forward}{strict}{tolerance}")
    some = lambda n: [(i, rng.choice("aaaaab") if rng.random() < 0.95 else None, rng.randint(-30, 30) / 2 if rng.random() < 0.95 else None) for i in range(n)]
    left, right = some(150), some(60)

    def best(key, at):
        able = [(r_at, rid) for rid, r_key, r_at in right if key is not None and at is not None and r_key == key and r_at is not None and (
            (r_at > at if strict else r_at >= at) if forward else (r_at < at if strict else r_at <= at))]
        if not able:
            return None
        place, rid = min(able, key=lambda x: (x[0], -x[1])) if forward else max(able)
        return rid if tolerance is None or abs(at - place) <= tolerance else None

    wanted = sorted((i, best(k, at)) for i, k, at in left)
    l = spark.createDataFrame(left, "id long, key string, at double")
    r = spark.createDataFrame(right, "rid long, key string, r_at double")
    for bucket in (1.0, 7.0, 1000.0):
        args = dict(bucket=bucket, ties=["rid"], strict=strict, forward=forward, tolerance=tolerance)
        got = asof_join(l, r, ["key"], "at", "r_at", ["rid"], **args)
        assert sorted((x.id, x.rid) for x in got.collect()) == wanted
    inner = asof_join(l, r, ["key"], "at", "r_at", ["rid"], how="inner", **args)
    assert sorted((x.id, x.rid) for x in inner.collect()) == [x for x in wanted if x[1] is not None]


def test_asof_join_of_nothing(spark):
    l = spark.createDataFrame([(1, "a", 1.0)], "id long, key string, at double")
    r = spark.createDataFrame([], "rid long, key string, r_at double")
    assert [tuple(x) for x in asof_join(l, r, ["key"], "at", "r_at", ["rid"], 1.0).collect()] == [(1, "a", 1.0, None)]
    assert asof_join(l.limit(0), r, ["key"], "at", "r_at", ["rid"], 1.0).count() == 0
    with pytest.raises(ValueError):
        asof_join(l, l, ["key"], "at", "at", ["id"], 1.0)


@pytest.mark.parametrize("unit", [0.25, 1.0, 8.0])
def test_interval_join(spark, unit):
    rng = random.Random(5)
    points = [(i, rng.choice("ab"), rng.randint(-400, 400) / 4 if rng.random() < 0.95 else None) for i in range(200)]
    intervals = []
    for i in range(80):
        low = rng.randint(-400, 400) / 4
        intervals.append((i, rng.choice(["a", "b", None]), low if i % 9 else None, low + rng.choice([0, 0.25, 1, 3, 40, 500, -2])))
    for on in ([], ["key"]):
        p = spark.createDataFrame(points, "id long, key string, v double")
        q = spark.createDataFrame(intervals, "iid long, key string, low double, high double")
        if not on:
            p, q = p.drop("key"), q.drop("key")
        wanted = sorted((a, b) for a, k, v in points for b, m, low, high in intervals
                        if v is not None and low is not None and low <= v < high and (not on or k == m))
        for salts in (1, 3):
            joined = interval_join(p, q, "v", "low", "high", on, unit, salts)
            assert sorted((x.id, x.iid) for x in joined.collect()) == wanted
            assert not re.search("NestedLoop|Cartesian", plan(joined))


def test_interval_join_repeats_few_rows(spark):
    """Exploded intervals are never sent whole to every task; intervals of one length look on one level."""
    points = spark.range(2000).select("id", (F.col("id") / 2).alias("v"))
    intervals = spark.range(500).select(F.col("id").alias("iid"), F.col("id").cast("double").alias("low"), (F.col("id") + 250.0).alias("high"))
    joined = interval_join(points, intervals, "v", "low", "high", salts=4)
    assert "Broadcast" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert joined.count() == 500 * 500
    assert not re.search("Broadcast(Hash|Nested)", plan(QUERIES["r2_interval_prices"](spark, "/root/testdata/sf0.001")))
    spans = spark.createDataFrame([(a, a + n - 1) for a in (-7, 0, 5, 10 ** 9) for n in (1, 4, 5, 250, 2 ** 40)] + [(-2 ** 63, 2 ** 63 - 1)], "a long, b long")
    level, cells = covering_cells(F.col("a"), F.col("b"))
    for x in spans.select("a", "b", level.alias("level"), cells.alias("cells")).collect():
        assert len(x.cells) <= 5 and x.cells[0] << x.level <= x.a and x.b < (x.cells[-1] + 1) << x.level


def test_interval_join_salts_hot_cells_only(spark, monkeypatch):
    """Only intervals in a cell with very many points are copied for salts; points outside all intervals are not shuffled."""
    rng = random.Random(8)
    points = [(i, 5.0 if i % 2 else rng.randint(0, 200_000) / 2) for i in range(2000)] + [(2000 + i, -900.0 - i) for i in range(500)]
    intervals = [(i, low, low + 250.0) for i, low in enumerate([0.0, 4.5, 5.0, 5.5] + [rng.randint(1000, 180_000) / 2 for _ in range(300)])]
    sides, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "join", lambda self, other, *a, f=kind.join, **b: sides.extend([self, other]) or f(self, other, *a, **b))
    joined = interval_join(spark.createDataFrame(points, "id long, v double"), spark.createDataFrame(intervals, "iid long, low double, high double"), "v", "low", "high", salts=4)
    wanted = sorted((a, b) for a, v in points for b, low, high in intervals if low <= v < high)
    assert sorted((x.id, x.iid) for x in joined.collect()) == wanted
    looked, cut = sides
    dealt = {x.hot: x.salts for x in looked.groupBy((F.col("cell") == 0).alias("hot")).agg(F.countDistinct("salt").alias("salts")).collect()}
    assert dealt == {True: 4, False: 1}
    assert looked.count() == sum(0 <= v < max(high for _, _, high in intervals) for _, v in points)
    assert cut.count() <= 5 * len(intervals) + 3 * 4


def test_interval_join_without_ends(spark):
    points = spark.createDataFrame([(1, -1e300), (2, 0.0), (3, float("inf")), (4, float("nan")), (5, float("-inf"))], "id long, v double")
    intervals = spark.createDataFrame(
        [(1, float("-inf"), float("inf")), (2, 0.0, float("inf")), (3, 0.0, float("nan")), (4, float("nan"), 1.0)], "iid long, low double, high double")
    joined = interval_join(points, intervals, "v", "low", "high")
    assert sorted((x.id, x.iid) for x in joined.collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 3), (5, 1)]


def boxes_by_force(lines):
    boxes = {(i, j, i, j) for i, row in enumerate(lines) for j, c in enumerate(row) if c is not None}
    while True:
        pair = next(((a, b) for a in boxes for b in boxes if a != b and a[0] <= b[2] + 1 and b[0] <= a[2] + 1 and a[1] <= b[3] + 1 and b[1] <= a[3] + 1), None)
        if pair is None:
            return sorted(b for b in boxes if b[2] > b[0])
        a, b = pair
        boxes = boxes - {a, b} | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))}


def test_regions_of_sheets(spark):
    rng = random.Random(2)
    sheets = [[[f"{i},{j}" if rng.random() < share else None for j in range(rng.randint(0, 9))] for i in range(rng.randint(0, 9))]
              for share in (0.1, 0.2, 0.3, 0.6) for _ in range(20)]
    schema = "doc_id string, source_file string, stem string, ok boolean, error string, header array<array<string>>, body array<array<string>>"
    got = {}
    for r in split_regions(spark.createDataFrame([(str(i), "f", "s", True, None, [], x) for i, x in enumerate(sheets)], schema)).collect():
        got.setdefault(int(r.doc_id), []).append((r.ordinal, [[c or None for c in line] for line in r.header + r.body]))
    for i, lines in enumerate(sheets):
        cell = lambda a, b: lines[a][b] if b < len(lines[a]) else None  # noqa: B023, E731
        wanted = [(n, [[cell(a, b) for b in range(left, right + 1)] for a in range(top, bottom + 1)])
                  for n, (top, left, bottom, right) in enumerate(boxes_by_force(lines), 1)]
        assert sorted(got.get(i, [])) == wanted


def test_shredded_rows(spark, tmp_path):
    rows = [("t", 0, '{"a": 1, "b c": "x", "d": 1.5, "e": "7"}'), ("t", 1, '{"a": 2, "b c": "y\'s", "d": "n/a", "e": null}'), ("u", 0, '{"a": 30000000000, "q\'s": 4}'),
            ("u", 1, "[1]"), ("u", 2, "broken {"), ("u", 3, "{}"), ("u", 4, None)]
    data = spark.createDataFrame(rows, "table_id string, row_index long, row_data string")
    assert choose_columns(data, least_share=0.0) == {"a": ("f0", "bigint"), "b c": ("f1", "string"), "d": ("f2", "string"), "e": ("f3", "bigint")}
    write_shredded(data, str(tmp_path), most=2, least_share=0.0)
    store = read_shredded(spark, str(tmp_path))
    assert set(store.columns) == {"a", "b c"}
    at = lambda df: sorted((r.table_id, r.row_index) for r in df.collect())
    assert at(store.rows) == [("t", 0), ("t", 1), ("u", 0), ("u", 3)]
    assert at(store.where_number("a", low=1)) == [("t", 1), ("u", 0)] and at(store.where_equal("a", 30000000000)) == [("u", 0)]
    assert at(store.where_text("a", "2")) == [("t", 1)] and at(store.where_text("b c", "y's")) == [("t", 1)]
    assert at(store.where_text("d", "n/a")) == [("t", 1)] and at(store.where_number("d", high=1.5)) == [("t", 0)]
    assert at(store.where_number("e", 6)) == [("t", 0)] and at(store.where_equal("q's", 4)) == [("u", 0)]
    assert at(store.where_text("nowhere", "x")) == []
    empty = write_shredded(data.limit(0), str(tmp_path / "none"))
    assert empty.columns == {} and empty.rows.count() == 0


def test_rows_are_parsed_once(spark):
    """Neither a filter nor a field parses a row again, and counts are of what is stored."""
    rows = [("t", i, x) for i, x in enumerate(
        ['{"a": 1, "b": "1-x", "c": 1.50, "d": {"e": [1, "x"]}, "f": true}', ' \n{"a": 2, "b": "7", "c": 3, "c2": null}', '[{"a": 1}]', '"{"', "{", "null", "", None, '{"a": 3}'])]
    data = spark.createDataFrame(rows, "table_id string, row_index long, row_data string")
    made = data.withColumn("row_data", F.concat("row_data", F.lit("")))
    for df in (field_counts(made), shred(made, {"a": ("f0", "bigint"), "b": ("f1", "string")})):
        assert len(re.findall("parseJson", plan(df))) == 1 and "SchemaOfVariant" not in plan(df)
    assert {tuple(r) for r in field_counts(made).collect()} == {("a", 3, 3, 3), ("b", 2, 1, 1), ("c", 2, 1, 2), ("d", 1, 0, 0), ("f", 1, 0, 0)}
    stored = shred(made, {"c": ("f0", "double"), "d": ("f1", "string")})
    assert sorted(tuple(r) for r in stored.select("row_index", "f0", "f1").collect()) == [(0, 1.5, '{"e":[1,"x"]}'), (1, 3.0, None), (8, None, None)]


def test_texts_that_read_as_numbers(spark):
    """Telling most other texts by their letters leaves no number out."""
    texts = ["1", "+1", " 1 ", "1.0", "1e5", "0x1p3", "0x10", "NaN", "nan", "-Infinity", "inf", "+INF", "1d", "1F", "1L", "1-x", "", "0x1.8P1", "5-LOW"]
    rows = spark.createDataFrame([("t", i, json.dumps({f"k{i}": x})) for i, x in enumerate(texts)], "table_id string, row_index long, row_data string")
    plain = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        F.concat(F.lit("k"), "i"), F.lit(1), *[F.col("text").try_cast(k).isNotNull().cast("int") for k in ("bigint", "double")])
    assert {tuple(r) for r in field_counts(rows).collect()} == {tuple(r) for r in plain.collect()}
    assert plan(field_counts(rows)).count("RLIKE") == 2  # reading such a text as a number costs an exception


@pytest.mark.parametrize("name, pushed", [
    ("j4_shredded_text", r"EqualTo\(f\d,1-URGENT\)"), ("j5_shredded_average", r"EqualTo\(f\d,5-LOW\)"),
    ("j6_shredded_range", r"GreaterThan\(f\d,100000.0\), LessThanOrEqual\(f\d,200000.5\)"), ("j7_shredded_equality", r"EqualTo\(f\d,77\)")])
def test_filters_on_shredded_fields_reach_the_scan(spark, sf, name, pushed):
    text = plan(QUERIES[name](spark, sf))
    assert re.search(rf"PushedFilters: \[[^\]]*{pushed}", text), text
    assert "variant" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("r1_", "r2_"))])
def test_ordered_joins_are_equi_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search("NestedLoop|Cartesian|MapIn", text)
    assert ("Window" in text) == name.startswith("r1_")
