"""The stored catalog, exports, answers and streams on small hand-made input."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F
from sample import SAMPLE_PAGE

from doctables.operators import answers, describe, export, jsonrows
from doctables.operators.clean import reindex_rows, rows_between
from doctables.operators.profile import schema_records
from doctables.plans import catalog as c
from doctables.plans.ingest import ingest, profiled_tables
from doctables.sources.extract import extract_pages, page_documents
from doctables.streaming.ingest import ingest_stream, stream_files, stream_parquet

def stamp():
    return F.lit("2024-01-01").cast("timestamp")


def pages(spark, *names):
    return page_documents(spark.createDataFrame([(f"site/{n}.html", SAMPLE_PAGE) for n in names], "url string, html string"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    cat = c.Catalog(spark, str(tmp_path_factory.mktemp("cat")), buckets=4)
    ingest(extract_pages(pages(spark, "guide", "copy")), cat, stamp(), "run")
    return cat


def test_sample_questions(stored):
    rows = stored.table_data()
    assert jsonrows.rows_where_text(rows, "Light", "Tern Rock").count() == 2
    assert jsonrows.rows_where_number(rows, "Steps", low=100).count() == 4
    assert jsonrows.rows_where_equal(rows, "Year", 1902).count() == 4
    low = jsonrows.rows_where_number(rows.filter("table_id = 'guide_table_1'"), "Steps", high=58)
    assert [r["Range km"] for r in jsonrows.project_fields(low, ["Range km"]).collect()] == ["12.5"]
    assert jsonrows.average_where(rows, "Fare", "Route", "Inner bay").first()[0] == 825.0


def test_sql_as_written_for_a_json_store(stored):
    def ask(text, **parameters):
        return sorted(tuple(r) for r in stored.sql(text, parameters).collect())

    assert ask("SELECT count(*) FROM table_data WHERE table_id = 'guide_table_1';") == [(4,)]
    assert ask(
        """SELECT json_extract(row_data, '$."Range km"') FROM table_data
           WHERE table_id = :id AND cast_integer(json_extract(row_data, '$."Steps"')) <= 58""", id="guide_table_1"
    ) == [("12.5",)]
    assert ask("SELECT AVG(cast_real(json_extract(row_data, '$.Fare'))) FROM table_data WHERE json_extract(row_data, '$.Route') = 'Inner bay'") == [(825.0,)]
    assert ask("SELECT table_id FROM tables WHERE source_file LIKE '%guide%' AND rows > 3 ORDER BY rows LIMIT 5;") == [("guide_table_1",)]
    assert ask("WITH s AS (SELECT * FROM processing_sessions) SELECT sum(total_tables) FROM s") == [(4,)]
    for text in ("DELETE FROM tables", "drop table tables", "", "WITH a AS (SELECT 1 x) INSERT OVERWRITE DIRECTORY '/tmp/none' USING csv SELECT * FROM a"):
        with pytest.raises(ValueError):
            stored.sql(text)


def test_search(stored):
    t = stored.tables()
    assert c.search(t, "GUIDE").count() == 2
    assert c.search(t, "guide_table_", ["table_id"], literal=True).count() == 2
    assert c.search(t, "g_ide").count() == 2 and c.search(t, "g_ide", literal=True).count() == 0
    assert c.search(t, "guide", []).count() == 0 and c.search(t, "guide", ["rows"]).count() == 0


def test_rows_and_typed_table(stored):
    assert [r["_row_index"] for r in c.table_rows(stored.rows_of("guide_table_2"), "guide_table_2", 2, 1).collect()] == [1, 2]
    assert c.table_rows(stored.table_data(), "guide_table_2", offset=2).count() == 1
    bad = stored.table_data().limit(1).withColumn("row_data", F.lit("{broken"))
    assert c.table_rows(bad, bad.first()["table_id"]).count() == 0
    typed = stored.typed_table("guide_table_1")
    assert dict(typed.dtypes)["Visitors"] == "bigint"
    assert [r["Visitors"] for r in typed.orderBy("row_index").collect()] == [48310, 7045, 120900, 960]
    assert stored.typed_table("unknown").count() == 0


def test_reads_prune_to_one_bucket(stored):
    plan = stored.rows_of("guide_table_1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", plan) and "Join" not in plan
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(doc_id,", plan)


def test_versions(spark, tmp_path):
    cat = c.Catalog(spark, str(tmp_path), buckets=4)
    first = ingest(extract_pages(pages(spark, "a", "b")), cat, stamp(), "1")
    again = page_documents(spark.createDataFrame([("site/a.html", "<table><tr><th>x<th>y<tr><td>1<td>2</table>")], "url string, html string"))
    second = ingest(extract_pages(again), cat, stamp(), "2")
    assert (first, second) == (0, 1)
    counts = {r["table_id"]: r["n"] for r in cat.table_data().groupBy("table_id").agg(F.count("*").alias("n")).collect()}
    # the new version of the document has one table with one row, and replaces both old ones
    assert counts == {"a_table_1": 1, "b_table_1": 4, "b_table_2": 3}
    assert cat.rows_of("a_table_1").count() == 1
    # the same batch again changes nothing
    ingest(extract_pages(again), cat, stamp(), "2", ingest_seq=1)
    assert cat.table_data().count() == 8 and cat.tables().count() == 3
    # a batch that stopped before its metadata is not seen
    lost = cat.table_data().limit(5).select("table_id", "row_index", "row_data", "created_at").withColumn("bucket", F.lit(0))
    lost.write.partitionBy("bucket").parquet(f"{cat.root}/table_data/ingest_seq=7")
    assert cat.table_data().count() == 8
    cat.compact()
    assert cat.table_data().count() == 8 and cat._committed() == {2}
    with pytest.raises(ValueError):
        cat.backup(cat.root)


def test_equal_names_streams_and_buckets_lose_nothing(spark, tmp_path):
    cat = c.Catalog(spark, str(tmp_path / "cat"), buckets=8)
    page = "<table><tr><th>x<tr><td>{}</table>"
    frame = lambda *names: spark.createDataFrame([(n, page.format(i)) for i, n in enumerate(names)], "url string, html string")
    ingest(extract_pages(page_documents(frame("a/index.html", "b/index.html"))), cat, stamp(), "1")
    ingest(extract_pages(page_documents(frame("c/index.html"))), cat, stamp(), "2")
    for k in ("one", "two"):
        frame(f"{k}/index.html").write.parquet(str(tmp_path / k))
        ingest_stream(stream_parquet(spark, str(tmp_path / k), "url string, html string"), cat, str(tmp_path / f"ck-{k}"), created_at=stamp()).awaitTermination()
    again = c.Catalog(spark, cat.root)  # with the default number of buckets
    tables = again.tables().collect()
    assert sorted(t["source_file"] for t in tables) == sorted(f"{k}/index.html" for k in ("a", "b", "c", "one", "two"))
    assert again.table_data().count() == 5 and again.buckets == 8
    assert all(again.rows_of("index_table_1", t["doc_id"]).count() == 1 for t in tables)
    assert again.typed_table("index_table_1", tables[0]["doc_id"]).count() == 1
    with pytest.raises(ValueError):
        again.rows_of("index_table_1")


def test_every_document_is_recorded(spark, tmp_path):
    from doctables.plans.ingest import new_documents
    from doctables.sources.extract import extract_files, file_documents, scan_directory

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.html").write_text(SAMPLE_PAGE)
    (folder / "none.html").write_text("<p>no table</p>")
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    cat = c.Catalog(spark, str(tmp_path / "cat"), buckets=2)
    files = scan_directory(spark, str(folder))
    ingest(extract_files(file_documents(files)), cat, stamp(), "1", scanned=files)
    outcome = {r["source_file"].split("/")[-1]: (r["status"], r["total_tables"]) for r in cat.documents().collect()}
    assert outcome == {"good.html": ("processed", 2), "none.html": ("no tables", 0), "broken.xlsx": ("failed", 0)}
    assert cat.sessions().count() == 3 and not (tmp_path / "cat" / "extracted").exists()
    assert new_documents(scan_directory(spark, str(folder)), cat.documents()).count() == 0
    (folder / "more.html").write_text(SAMPLE_PAGE)
    assert new_documents(scan_directory(spark, str(folder)), cat.documents()).count() == 1


def test_backup_and_clear(spark, stored, tmp_path):
    assert stored.backup(str(tmp_path / "copy"))
    other = c.Catalog(spark, str(tmp_path / "other"), buckets=4)
    assert not other.restore(str(tmp_path / "missing")) and not other.backup(str(tmp_path / "none"))
    assert other.restore(str(tmp_path / "copy"))
    assert other.table_data().count() == stored.table_data().count() == 14
    other.clear()
    assert other.tables().count() == other.table_data().count() == other.sessions().count() == 0


@pytest.mark.parametrize("fmt", ["orc", "json"])
def test_other_formats(spark, tmp_path, fmt):
    cat = c.Catalog(spark, str(tmp_path), format=fmt, buckets=2)
    ingest(extract_pages(pages(spark, "x")), cat, stamp(), "1")
    assert cat.table_data().count() == 7 and cat.tables().first()["column_types"]["Steps"] == "integer"


def test_describe_keeps_going(spark):
    def generate(prompts):
        if any("Ferry" in p for p in prompts) and len(prompts) == 1:
            raise RuntimeError("no reply")
        if len(prompts) > 1:
            raise RuntimeError("one by one, please")
        return [" Lights. "]

    records = schema_records(profiled_tables(extract_pages(pages(spark, "g"))).coalesce(1))
    done = describe.describe_with(describe.description_prompts(records, "harbour"), generate)
    got = {r["ordinal"]: (r["description"], r["status"]) for r in describe.fill_failed_descriptions(done).collect()}
    assert got == {
        1: ("Lights.", "success"),
        2: ("Table 2: A table with 3 rows and 4 columns. Failed to generate detailed description.", "error"),
    }


def test_failed_schema_texts(spark):
    bad = page_documents(spark.createDataFrame([("a.html", "<table></table>")], "url string, html string"))
    records = schema_records(profiled_tables(extract_pages(bad)))
    assert describe.description_prompts(records).first()["prompt"].startswith("Unable to describe table: Schema extraction failed")
    from doctables.operators.profile import schema_counts, schema_summary

    assert schema_summary(records).first()["summary"] == "Table 1: Schema extraction failed - Schema extraction failed: No tables found"
    assert tuple(schema_counts(records).first())[2:] == (1, 0)


def test_replies(spark):
    texts = [
        '```json\n{"is_fulfillable": true, "confidence": "0.8", "required_tables": ["a"]}\n```',
        "cannot", "It is not possible", "nothing to see", "[1]", '{"confidence": 1}', "```sql\nSELECT 1\n```",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    got = [(r["from_json"], r["is_fulfillable"], r["confidence"]) for r in answers.parse_analysis(df).orderBy("i").collect()]
    assert got == [
        (True, True, 0.8), (False, False, 0.3), (False, False, 0.3), (False, False, 0.3),
        (False, False, 0.1), (True, False, 1.0), (False, False, 0.1),
    ]
    sql = [r["sql_query"] for r in answers.extract_sql(df).orderBy("i").collect()]
    assert sql == [None] * 6 + ["SELECT 1;"]


def test_exports(spark, tmp_path):
    result = spark.createDataFrame([(i, f"name {i}" * (i % 9)) for i in range(25)], "k int, text string")
    out = str(tmp_path)
    text = export.export(result, out, "TXT", "t", "SELECT 1", exported_at="now", order_by=["k"])
    lines = [r[0] for r in spark.read.text(text).withColumn("f", F.input_file_name()).orderBy("f").collect()]
    assert lines[1] == "QUERY RESULTS" and lines[3:6] == ["Query: SELECT 1", "Exported: now", "Total Rows: 25"]
    table = lines[8:]
    assert table[0] == "k  | " + "text".ljust(50) and table[1] == "-" * 55
    assert len(table) == 2 + 25 + 2 and table[12] == table[23] == "-" * 55
    assert all(len(x) == 55 for x in table)
    assert export.export(result.filter("k < 0"), out) == "" and not os.path.exists(out + "/none.csv")
    with pytest.raises(ValueError):
        export.export(result, out, "pdf")
    path = export.export(result, out, "json", "j")
    meta = json.loads(spark.read.text(path + ".metadata").first()[0])
    assert meta["total_rows"] == 25 and meta["query"] == "Not provided"


def test_run_and_save(stored, tmp_path):
    good = export.run_and_save(stored, "SELECT table_id FROM tables;", str(tmp_path), "csv", "q")
    assert good["success"] and good["export_path"].endswith("q.csv")
    assert export.run_and_save(stored, "IMPOSSIBLE", str(tmp_path))["error"] == "Query cannot be answered with available data"
    assert export.run_and_save(stored, "SELECT 1 WHERE false", str(tmp_path))["error"] == "Query executed but returned no results"
    assert export.run_and_save(stored, "SELECT nope FROM tables", str(tmp_path))["error"].startswith("Export failed")


def test_numbering_and_reindexing(spark):
    df = spark.range(10_000).select((F.col("id") * 7 % 10_007).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("table_id"))
    numbered = export.number_rows(df, ["v"])
    values = [r["v"] for r in numbered.orderBy("row_no").collect()]
    assert values == sorted(values)
    assert numbered.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first() == (1, 10_000, 10_000)
    again = reindex_rows(df.withColumnRenamed("v", "row_index").withColumn("old", F.col("row_index")), block_rows=64)
    hot = [(r["old"], r["row_index"]) for r in again.filter("table_id = 'hot'").orderBy("old").collect()]
    assert [i for _, i in hot] == list(range(3334))


def test_limit_and_offset_with_gaps(spark):
    rows = spark.range(1000).select(F.lit("t").alias("table_id"), (F.col("id") * 37).alias("row_index"))
    for offset, limit in ((0, 5), (250, 100), (990, 50), (3, None), (5000, 5)):
        got = [r["row_index"] for r in rows_between(rows, offset, limit, block_rows=100).orderBy("row_index").collect()]
        assert got == [i * 37 for i in range(1000)][offset : None if limit is None else offset + limit]


def test_stream_equals_batch(spark, tmp_path):
    source, batch, stream = tmp_path / "in", c.Catalog(spark, str(tmp_path / "b"), buckets=2), c.Catalog(spark, str(tmp_path / "s"), buckets=2)
    table = pages(spark, "p1", "p2").select(F.col("source_file").alias("url"), "html")
    for name in ("one", "two"):  # two arrivals, two runs
        table.withColumn("url", F.replace("url", F.lit("site/"), F.lit(f"site/{name}_"))).write.mode("append").parquet(str(source))
        ingest_stream(stream_parquet(spark, str(source), table.schema), stream, str(tmp_path / "ck"), created_at=stamp()).awaitTermination()
    ingest(extract_pages(page_documents(spark.read.parquet(str(source)))), batch, stamp(), "x")

    def content(cat):
        return sorted(tuple(r) for r in cat.table_data().select("table_id", "row_index", "row_data").collect())

    assert content(stream) == content(batch)
    assert {r["ingest_seq"] for r in stream.all_tables().collect()} == {0, 1}


def test_file_stream(spark, tmp_path):
    from doctables.sources.extract import extract_files, file_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.html").write_text(SAMPLE_PAGE)
    cat = c.Catalog(spark, str(tmp_path / "cat"), buckets=2)
    ingest_stream(
        stream_files(spark, str(tmp_path / "in")), cat, str(tmp_path / "ck"),
        extract=lambda b: extract_files(file_documents(b)), created_at=stamp(),
    ).awaitTermination()
    assert sorted(r["table_id"] for r in cat.tables().collect()) == ["g_table_1", "g_table_2"]


def test_a_dominating_table_is_spread_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "ROWS_PER_FILE", 1000)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        rows = spark.range(20_000).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("table_id"),
            F.col("id").alias("row_index"), F.lit('{"a": 1}').alias("row_data"), stamp().alias("created_at"),
        ).withColumn("doc_id", F.col("table_id")).withColumn("ordinal", F.lit(1))
        tables = rows.groupBy("table_id").agg(F.count("*").alias("rows")).selectExpr(
            "table_id", "table_id doc_id", "'s' source_file", "'html' table_type", "rows", "1L columns", "array('a') column_names",
            "map('a', 'integer') column_types", "map('a', 'int64') storage_types", "'' html_content", "'' description",
            "'' session_id", "timestamp'2024-01-01' created_at",
        )
        cat = c.Catalog(spark, str(tmp_path), buckets=4)
        cat.append(tables, rows)
        hot = cat.rows_of("hot")
        assert hot.count() == rows.filter("table_id = 'hot'").count()
        assert hot.select(F.input_file_name()).distinct().count() > 3
        assert cat.table_data().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_answers_on_an_empty_catalog(spark, tmp_path):
    cat = c.Catalog(spark, str(tmp_path / "nothing"))
    asked = spark.createDataFrame([(1, "What is there?")], "question_id bigint, question string")
    assert answers.sql_prompts(asked, cat.tables()).first()["prompt"].count("No tables available.") == 1
    parts = answers.analysis_prompt_parts(asked, cat.tables()).collect()
    assert [p["part"] for p in parts] == ["opening", "question"] and answers.EMPTY_CONTEXT in parts[0]["text"]
    assert c.store_summary(cat.tables(), cat.table_data(), cat.sessions()).first() == (0, 0, 0, 0)
    assert c.chat_summary(cat.tables(), cat.table_data()).first() == (0, 0, 0)
