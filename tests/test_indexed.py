"""The trigram index against the scan, totals, unions and dates against plain loops, streamed counts against a batch."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from doctables.operators.dates import date_columns, dated_cells, with_dates
from doctables.operators.totals import cube_sets, field_totals, merge_totals
from doctables.operators.trigrams import TrigramIndex, literal_runs, term_grams
from doctables.operators.unions import common_types, union_tables
from doctables.plans.catalog import search, superseded_versions, without_versions
from doctables.plans.summaries import StoredSummaries
from doctables.streaming.changes import current_counts, follow_counts
from doctables.workload import QUERIES
from doctables.workload import fixtures as fx

TEXTS = "doc_id string, ordinal int, table_id string, source_file string, description string, created_at timestamp"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def keys(df):
    return sorted((r.doc_id, r.ordinal) for r in df.collect())


def test_terms():
    assert literal_runs(r"%a\%b_c\\%%") == ["", "a%b", "c\\", "", ""]
    assert term_grams("%ab_cd%") == [] and term_grams("%abcab%") == ["abc", "bca", "cab"]


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    letters = "aAbBcCé%_\\ß😀 \n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rows = [(f"d{i // 2}", i % 2 + 1, f"t{i}", word(8) if rng.random() < 0.9 else None, word(60) if rng.random() < 0.9 else None, None) for i in range(300)]
    rows += [("long", 1, "t", "s", "x" * 200_000 + "abcab" + "y" * 200_000, None), ("empty", 1, "", "", "", None)]
    texts = spark.createDataFrame(rows, TEXTS)
    index = TrigramIndex(spark, str(tmp_path / "index"), parts=4, buckets=4)
    assert index.search("abc").count() == 0
    index.add(texts)
    index.add(texts)  # a repeated write changes nothing
    for term in ["abc", "ABC", "xabcaby", "aB%Ca", "ca_b", "é%b", "ab", "%", "", "nowhere", "a\\%b", "😀aA"] + [rows[i][4][3:7].replace("\\", "") for i in range(0, 60, 15) if rows[i][4]]:
        assert keys(index.search(term)) == keys(search(texts, term)), term
    for term in ["a%b", "a_b", "\\"]:
        assert keys(index.search(term, ["description", "unknown"], literal=True)) == keys(search(texts, term, ["description"], literal=True))
    assert index.search("abc", ["unknown"]).count() == 0


def test_postings_are_one_row_a_block_and_gram(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"d{i}", 1, None, "".join(rng.choice("aB😀é ") for _ in range(40)), "aab" if i % 2 else None, None) for i in range(400)]
    rows += rows[:1]  # a repeated row
    index = TrigramIndex(spark, str(tmp_path / "index"), parts=2, buckets=2)
    index.add(spark.createDataFrame(rows, TEXTS).coalesce(1))
    wanted = {}
    for doc, n, _, source, description, _ in rows:
        for field, text in (("source_file", source.lower()), ("description", description or "")):
            for i in range(len(text) - 2):
                wanted.setdefault((text[i:i + 3], field), set()).add((doc, n))
    stored = spark.read.parquet(f"{index.folder}/postings").collect()
    (docs,) = [[tuple(x) for x in r.docs] for r in stored if r.gram == ""]
    assert len(stored) == len(wanted) + 1
    assert {(r.gram, r.field): {docs[i] for i in r.numbers} for r in stored if r.gram} == wanted
    assert ("d0", 1) in keys(index.search(rows[0][3][5:12].replace("%", "")))


def test_index_follows_replaced_documents(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"), parts=4, buckets=4)
    old = [("a", 1, "ta", "s", "first balance", None), ("b", 1, "tb", "s", "second balance", None)]
    index.add(spark.createDataFrame(old, TEXTS), 1)
    index.add(spark.createDataFrame([("a", 1, "ta", "s", "weights", None)], TEXTS), 2)
    gone = superseded_versions(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "doc_id string, ingest_seq long"))
    assert keys(index.search("BALANCE", superseded=gone)) == [("b", 1)] and keys(index.search("eight", superseded=gone)) == [("a", 1)]
    assert keys(index.search("balance")) == [("a", 1), ("b", 1)]


def test_index_of_names(spark, sf, tmp_path):
    """Every nation and segment name, over texts that hold them."""
    names = [r[0] for r in fx.read(spark, sf, "nation").select("n_name").collect()] + [r[0] for r in fx.read(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    nations = fx.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    texts = fx.read(spark, sf, "customer").join(nations, "c_nationkey").select(
        fx.text("c_custkey").alias("doc_id"), F.lit(1).alias("ordinal"), F.col("c_name").alias("table_id"), F.lit("crm").alias("source_file"),
        F.concat_ws(" of ", "c_mktsegment", "n_name").alias("description"), F.lit(None).cast("timestamp").alias("created_at")).cache()
    index = TrigramIndex(spark, str(tmp_path / "index"), parts=4, buckets=16)
    index.add(texts)
    known = texts.collect()
    for name in names:
        found = index.search(name.lower())
        assert keys(found) == sorted((r.doc_id, r.ordinal) for r in known if name.lower() in r.description.lower())
        # the texts are read in the buckets that have candidates, the postings in the parts that have the grams
        assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET) ", plan(found)) and re.search(r"PartitionFilters: \[part#\d+ (IN|INSET) ", plan(found))
        assert re.search(r"PushedFilters: \[(And\()?In\(gram", plan(found)), plan(found)
    texts.unpersist()


def test_union_of_tables(spark):
    tables = spark.createDataFrame([
        ("a", ["n", "x", "Name"], {"n": "int64", "x": "int64", "Name": "object"}), ("b", ["x", "n", "ok"], {"n": "float64", "x": "object", "ok": "bool"}),
        ("c", ["name", "it's"], {"name": "bool", "it's": "int64"})], "table_id string, column_names array<string>, storage_types map<string,string>")
    assert {r.name: r.type for r in common_types(tables).collect()} == {"n": "double", "x": "string", "Name": "string", "ok": "boolean", "name": "boolean", "it's": "bigint"}
    rows = spark.createDataFrame([
        ("a", 0, '{"n": 1, "x": 2, "Name": "p"}'), ("b", 0, '{"x": "q", "n": 1.5, "ok": true}'), ("c", 0, '{"name": false, "it\'s": 9}'), ("c", 1, "{broken"), ("c", 2, None), ("other", 0, "{}")],
        "table_id string, row_index long, row_data string")
    done = union_tables(tables, rows)
    assert done.columns == ["_table_id", "_row_index", "n", "name", "x", "it's", "Name_2", "ok"]
    got = {r["_table_id"]: r.asDict() for r in done.collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["n"], got["a"]["x"], got["a"]["Name_2"], got["a"]["ok"]) == (1.0, "2", "p", None)
    assert (got["b"]["n"], got["b"]["x"], got["b"]["ok"]) == (1.5, "q", True)
    assert (got["c"]["name"], got["c"]["it's"], got["c"]["n"]) == (False, 9, None)
    with pytest.raises(ValueError):
        union_tables(tables, rows, most_columns=5)
    assert union_tables(tables.limit(0), rows).columns == ["_table_id", "_row_index"] and union_tables(tables.limit(0), rows).count() == 0


def test_totals_of_fields(spark):
    rng = random.Random(4)
    data = []
    for i in range(600):
        row = {"g": rng.choice("ab"), "h": rng.choice(["x", "y", None]), "v": rng.choice([1, 2.5, "n/a", None]), "who": rng.choice([None, *range(40)])}
        data.append({k: v for k, v in row.items() if v is not None or rng.random() < 0.5})
    import json

    rows = spark.createDataFrame([("t", i, json.dumps(r)) for i, r in enumerate(data)], "table_id string, row_index long, row_data string")
    done = field_totals(rows, ["g", "h"], "v", "who")
    got = {(r.level, r.g, r.h): (r.n, r.total, r.lowest, r.highest, r.n_distinct) for r in done.collect()}
    wanted = {}
    for s in cube_sets(["g", "h"]):
        level = sum(bit for bit, f in ((2, "g"), (1, "h")) if f not in s)
        for r in data:
            wanted.setdefault((level, r.get("g") if "g" in s else None, r.get("h") if "h" in s else None), []).append(r)
    numbers = lambda rs: [r["v"] for r in rs if isinstance(r.get("v"), (int, float))]
    assert got == {k: (len(rs), sum(numbers(rs)), min(numbers(rs)), max(numbers(rs)), len({r["who"] for r in rs if r.get("who") is not None})) for k, rs in wanted.items()}
    with pytest.raises(ValueError):
        field_totals(rows, ["g"], "v", "who", [["h"]])


def test_distinct_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select(F.lit("t").alias("table_id"), F.col("id").alias("row_index"), F.to_json(F.struct(
        (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 20_011).alias("who"), F.lit(1).alias("v"))).alias("row_data"))
    parts = [field_totals(rows.filter(f"row_index % 2 = {i}"), ["g"], "v", "who", [["g"]]) for i in range(2)]
    whole = {r.g: r.n_distinct for r in field_totals(rows, ["g"], "v", "who", [["g"]]).collect()}
    merged = merge_totals(parts[0].unionByName(parts[1]), ["g"]).collect()
    assert len(merged) == 3 and sum(r.n for r in merged) == 60_000
    for r in merged:  # four standard errors
        assert abs(r.distinct_estimate - whole[r.g]) <= 4 * 1.04 / 2 ** 6 * whole[r.g]


def test_dates_of_columns(spark):
    d = dt.date
    columns = {
        "day": (["03/04/2024", "25/12/2023", "1-2-99", "-", "", None], [d(2024, 4, 3), d(2023, 12, 25), d(1999, 2, 1), None, None, None], True, True),
        "month": (["03/04/2024", "12/25/2023", " 1/2/68 ", "02/30/2024"] + ["5/6/2020"] * 5, [d(2024, 3, 4), d(2023, 12, 25), d(2068, 1, 2), None] + [d(2020, 5, 6)] * 5, True, False),
        "either": (["03/04/2024", "05.06.2024"], [d(2024, 4, 3), d(2024, 6, 5)], True, True),
        "names": (["3 March 2024", "Mar 4, 2024", "5-Sept-23", "2024.2.29", "Dec. 1 69"], [d(2024, 3, 3), d(2024, 3, 4), d(2023, 9, 5), d(2024, 2, 29), d(1969, 12, 1)], True, True),
        "few": (["2024-01-01"] * 4 + ["text"], [None] * 5, False, True),
        "none": (["1 Smarch 2024", "Ma 1 2024", "2023-02-29", "1/2", "31/31/2024", "12345", "1/2/345"], [None] * 7, False, True),
        "blank": ([None, "", "-"], [None] * 3, False, True),
    }
    cells = spark.createDataFrame([(name, i, v) for name, x in columns.items() for i, v in enumerate(x[0])], "name string, i int, value string")
    assert {r.name: (r.is_date, r.day_first) for r in date_columns(cells, ["name"]).collect()} == {n: x[2:] for n, x in columns.items()}
    assert {(r.name, r.i): r.date for r in dated_cells(cells, ["name"]).collect()} == {(n, i): v for n, x in columns.items() for i, v in enumerate(x[1])}
    assert [r.day_first for r in date_columns(cells.filter("name = 'either'"), ["name"], prefer_day=False).collect()] == [False]
    flat = spark.createDataFrame([("01/02/2024", "x", 1), ("13/02/2024", "y", 2)], "a string, b string, c int")
    done = with_dates(flat, ["a", "b", "c"])
    assert done.dtypes == [("a", "date"), ("b", "string"), ("c", "int")] and [r.a for r in done.orderBy("c").collect()] == [d(2024, 2, 1), d(2024, 2, 13)]
    assert date_columns(cells.limit(0), ["name"]).count() == 0 and with_dates(flat.limit(0), ["a"]).dtypes == flat.dtypes


def test_streamed_counts_follow_replacements(spark, tmp_path):
    schema = "doc_id string, source_file string, version long, n long"
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batches = [
        [("a", "s", 5, 2), ("b", "s", 5, 1), ("c", "t", 5, 0), (None, "s", 5, 9), ("z", "t", None, 9)],
        [("a", "s", 5, 2), ("a", "s", 3, 7)],                       # a replay, and an older version that comes late
        [("a", "t", 8, 4), ("b", "s", 6, 3), ("b", "s", 7, 1)],     # one moves to another source, one is replaced twice
        [("c", "t", 9, None), ("d", None, 1, 1)],                   # one is removed, one has no source
        [("c", "u", 10, 6)],                                        # and comes back
    ]
    seen = {}
    assert current_counts(spark, target).count() == 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        follow_counts(spark.readStream.schema(schema).parquet(source), target, checkpoint).awaitTermination()
        for doc, where, version, n in rows:
            if doc is not None and version is not None and version > seen.get(doc, ("", -1))[1]:
                seen[doc] = (where, version, n)
        wanted = {}
        for where, _, n in seen.values():
            if n is not None:
                x = wanted.setdefault(where, [0, 0])
                x[0], x[1] = x[0] + 1, x[1] + n
        assert {r.source_file: [r.documents, r.n] for r in current_counts(spark, target).collect()} == wanted


@pytest.mark.parametrize("name, aggregates", [("j10_field_cube", 1), ("j10_field_rollup", 1)])
def test_totals_expand_what_is_combined(spark, sf, name, aggregates):
    """The rows are combined below the expansion."""
    text = plan(QUERIES[name](spark, sf))
    assert text.index("Expand") < text.rindex("HashAggregate") < text.index("FileScan")


def test_summaries_after_replacements(spark, tmp_path):
    """Equal to the full scan after any writes; nothing of the stored rows is read."""
    rng = random.Random(6)
    summaries = StoredSummaries(spark, str(tmp_path))
    none = spark.createDataFrame([], "doc_id string, ingest_seq long")
    assert summaries.store_summary(none).first().asDict() == {"total_tables": 0, "total_rows": 0, "unique_source_files": 0}
    tables, rows, documents = [], [], []
    for seq in range(3):
        for doc in rng.sample("abcdefgh", 5):
            documents.append((doc, seq))
            for ordinal in range(1, rng.randint(1, 3)):
                tables.append((doc, ordinal, f"{doc}{ordinal}", rng.choice(["s", "t", None]), rng.choice(["html", "excel"]), seq))
                rows += [(doc, ordinal, i, seq) for i in range(rng.randint(0, 4))]
    t = spark.createDataFrame(tables, "doc_id string, ordinal int, table_id string, source_file string, table_type string, ingest_seq long")
    r = spark.createDataFrame(rows, "doc_id string, ordinal int, row_index long, ingest_seq long")
    for seq in (0, 1, 2, 1):  # one write is repeated
        summaries.add(t.filter(f"ingest_seq = {seq}").drop("ingest_seq"), r.filter(f"ingest_seq = {seq}").drop("ingest_seq"), seq)
    gone = superseded_versions(spark.createDataFrame(documents, "doc_id string, ingest_seq long"))
    now, kept = without_versions(gone, t).collect(), without_versions(gone, r).collect()
    assert sorted((x.doc_id, x.ordinal, x.actual_rows) for x in summaries.actual_rows(gone).collect()) == sorted(
        (x.doc_id, x.ordinal, sum((y.doc_id, y.ordinal) == (x.doc_id, x.ordinal) for y in kept)) for x in now)
    assert {x.table_type: x.n for x in summaries.tables_by_type(gone).collect()} == {k: sum(x.table_type == k for x in now) for k in {x.table_type for x in now}}
    assert {x.source_file: x.tables for x in summaries.source_totals(gone).collect()} == {k: sum(x.source_file == k for x in now) for k in {x.source_file for x in now}}
    assert tuple(summaries.store_summary(gone).first()) == (len(now), len(kept), len({x.source_file for x in now} - {None}))
    assert "row_index" not in plan(summaries.store_summary(gone))
