"""Exports, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as docs
from ..operators import export as x
from ..operators.describe import template_descriptions
from . import fixtures as fx
from .catalog import shared_folder
from .registry import query


def _result(spark, sf):
    return fx.read(spark, sf, "supplier").select(
        "s_suppkey", "s_name",
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit('says "'), fx.text("s_nationkey"), F.lit(', ok"'))).alias("note"),
        F.col("s_acctbal").alias("balance"),
    )


_NOTE = """CASE WHEN s_suppkey % 4 <> 0 THEN 'says "' || s_nationkey || ', ok"' END AS note"""


@query("x1_csv", f"""
SELECT s_acctbal AS balance, {_NOTE}, s_name, s_suppkey, 'balance, note, s_name, s_suppkey' AS header, (SELECT count(*) FROM supplier) AS total_rows FROM supplier""")
def csv(spark, sf):
    path = x.export(_result(spark, sf), shared_folder(spark, "x1"), "CSV", "out", "SELECT 1")
    back = spark.read.option("header", True).option("escape", '"').schema("balance double, note string, s_name string, s_suppkey bigint").csv(path)
    raw = spark.read.option("header", True).csv(path)
    meta = spark.read.json(path + ".metadata")
    return back.withColumn("header", F.lit(", ".join(raw.columns))).withColumn(
        "total_rows", meta.select("total_rows").scalar()
    )


@query("x2_json", f"""
SELECT s_suppkey, s_name, {_NOTE}, s_acctbal AS balance, 'SELECT 1' AS query, (SELECT count(*) FROM supplier) AS total_rows FROM supplier""")
def json(spark, sf):
    path = x.export(_result(spark, sf), shared_folder(spark, "x2"), "json", "out", "SELECT 1")
    meta = spark.read.json(path + ".metadata")
    back = spark.read.schema("s_suppkey bigint, s_name string, note string, balance double").json(path)
    return back.withColumn("query", meta.select("query").scalar()).withColumn(
        "total_rows", meta.select("total_rows").scalar()
    )


@query("x3_text_lines", """
WITH d AS (
  SELECT p_partkey, p_name, p_type || ' ' || repeat('long ', CAST(p_partkey % 13 AS INTEGER)) AS remark,
    row_number() OVER (ORDER BY p_partkey) AS i FROM part),
w AS (
  SELECT least(50, greatest(9, max(length(CAST(p_partkey AS VARCHAR))))) AS w0,
    least(50, greatest(6, max(length(p_name)))) AS w1, least(50, greatest(6, max(length(remark)))) AS w2 FROM d),
body AS (
  SELECT i + 2 + (i - 1) // 10 AS line_no, i,
    substr(rpad(CAST(p_partkey AS VARCHAR), CAST(w0 AS INTEGER), ' '), 1, w0) || ' | ' || substr(rpad(p_name, CAST(w1 AS INTEGER), ' '), 1, w1)
    || ' | ' || substr(rpad(remark, CAST(w2 AS INTEGER), ' '), 1, w2) AS line
  FROM d, w)
SELECT line_no, line FROM body
UNION ALL SELECT line_no + 1, repeat('-', CAST(w0 + w1 + w2 + 6 AS INTEGER)) FROM body, w WHERE i % 10 = 0
UNION ALL SELECT 2, repeat('-', CAST(w0 + w1 + w2 + 6 AS INTEGER)) FROM w
UNION ALL SELECT 1, rpad('p_partkey', CAST(w0 AS INTEGER), ' ') || ' | ' || rpad('p_name', CAST(w1 AS INTEGER), ' ') || ' | ' || rpad('remark', CAST(w2 AS INTEGER), ' ') FROM w""")
def text_lines(spark, sf):
    result = fx.read(spark, sf, "part").select(
        "p_partkey", "p_name",
        F.concat("p_type", F.lit(" "), F.repeat(F.lit("long "), (F.col("p_partkey") % 13).cast("int"))).alias("remark"),
    )
    return x.text_lines(result, ["p_partkey"])


@query("x3_whole_cells", """
WITH d AS (
  SELECT p_partkey, p_name, p_type || ' ' || repeat('long ', CAST(p_partkey % 13 AS INTEGER)) AS remark,
    row_number() OVER (ORDER BY p_partkey) AS i FROM part),
w AS (
  SELECT greatest(9, max(length(CAST(p_partkey AS VARCHAR)))) AS w0,
    greatest(6, max(length(p_name))) AS w1, greatest(6, max(length(remark))) AS w2 FROM d),
body AS (
  SELECT i + 2 + (i - 1) // 10 AS line_no, i,
    substr(rpad(CAST(p_partkey AS VARCHAR), CAST(w0 AS INTEGER), ' '), 1, w0) || ' | ' || substr(rpad(p_name, CAST(w1 AS INTEGER), ' '), 1, w1)
    || ' | ' || substr(rpad(remark, CAST(w2 AS INTEGER), ' '), 1, w2) AS line
  FROM d, w)
SELECT line_no, line FROM body
UNION ALL SELECT line_no + 1, repeat('-', CAST(w0 + w1 + w2 + 6 AS INTEGER)) FROM body, w WHERE i % 10 = 0
UNION ALL SELECT 2, repeat('-', CAST(w0 + w1 + w2 + 6 AS INTEGER)) FROM w
UNION ALL SELECT 1, rpad('p_partkey', CAST(w0 AS INTEGER), ' ') || ' | ' || rpad('p_name', CAST(w1 AS INTEGER), ' ') || ' | ' || rpad('remark', CAST(w2 AS INTEGER), ' ') FROM w""")
def whole_cells(spark, sf):
    """The same lines with no cell cut."""
    result = fx.read(spark, sf, "part").select(
        "p_partkey", "p_name",
        F.concat("p_type", F.lit(" "), F.repeat(F.lit("long "), (F.col("p_partkey") % 13).cast("int"))).alias("remark"),
    )
    return x.text_lines(result, ["p_partkey"], max_width=None)


@query("x3_given_order", """
SELECT row_number() OVER (ORDER BY p_partkey DESC) + 2 + (row_number() OVER (ORDER BY p_partkey DESC) - 1) // 10 AS line_no, p_partkey FROM part""")
def given_order(spark, sf):
    """A text export keeps the order of an ordered result."""
    result = fx.read(spark, sf, "part").select("p_partkey", "p_name").orderBy(F.desc("p_partkey"))
    key = F.expr("try_cast(trim(split(line, ' [|] ')[0]) AS bigint)")
    return x.text_lines(result).select("line_no", key.alias("p_partkey")).filter("p_partkey IS NOT NULL")


@query("x4_export_choice", """
SELECT f AS format, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier, (VALUES ('csv'), ('json'), ('txt')) v(f) GROUP BY f""")
def export_choice(spark, sf):
    """Formats by name in any case, read back; an unknown one is refused, nothing is written for no rows."""
    folder = shared_folder(spark, "x4")
    result = _result(spark, sf)
    paths = {f: x.export(result, folder, f.upper(), "r") for f in x.FORMATS}
    assert x.export(result.filter("s_suppkey < 0"), folder, "csv", "none") == ""
    try:
        x.export(result, folder, "xml")
        raise AssertionError("an unknown format was written")
    except ValueError:
        pass
    keys = {
        "csv": spark.read.option("header", True).option("escape", '"').csv(paths["csv"]).select(F.col("s_suppkey").cast("bigint").alias("k")),
        "json": spark.read.schema("s_suppkey bigint").json(paths["json"]).select(F.col("s_suppkey").alias("k")),
        "txt": spark.read.text(paths["txt"]).select(F.expr("try_cast(trim(split(value, ' [|] ')[0]) AS bigint)").alias("k")).filter("k IS NOT NULL"),
    }
    out = [df.agg(F.count("k").alias("n"), F.sum("k").alias("keys")).select(F.lit(f).alias("format"), "n", "keys") for f, df in keys.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("x5_catalog_export", "WITH " + fx.CUSTOMER_SQL + """
SELECT table_id, '["' || array_to_string(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], '","') || '"]' AS column_names FROM shape""")
def catalog_export(spark, sf):
    """All columns of the catalog's tables as CSV; lists and maps become JSON text."""
    from ..plans.catalog import Catalog

    root = shared_folder(spark, "x5c")
    catalog = Catalog(spark, root + "/catalog", buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf))
    done = x.run_and_save(catalog, "SELECT * FROM tables", root, "csv", "all")
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(done["export_path"]).select("table_id", "column_names")


@query("x5_run_and_save", "WITH " + fx.CUSTOMER_SQL + """
SELECT source_file, count(*) AS n, sum(n_rows)::BIGINT AS total FROM shape GROUP BY source_file""")
def run_and_save(spark, sf):
    from ..plans.catalog import Catalog

    root = shared_folder(spark, "x5")
    catalog = Catalog(spark, root + "/catalog", buckets=8)
    catalog.append(fx.catalog_tables(spark, sf), fx.catalog_rows(spark, sf), fx.catalog_sessions(spark, sf))
    done = x.run_and_save(
        catalog, "SELECT source_file, count(*) AS n, sum(rows) AS total FROM tables GROUP BY source_file;", root, "json", "answer"
    )
    return spark.read.schema("source_file string, n bigint, total bigint").json(done["export_path"])


@query("x6_artifacts", "WITH " + fx.MARKDOWN_SQL + """
SELECT final.doc_id, length(final.processed) AS processed_length, length(md.text) AS original_length FROM final JOIN md USING (doc_id)""")
def artifacts(spark, sf):
    replaced = docs.replace_tables(
        docs.split_markdown(fx.markdown_documents(spark, sf)), fx.markdown_descriptions(spark, sf)
    )
    records = fx.customer_records(spark, sf)
    paths = x.save_artifacts(
        shared_folder(spark, "x6"), docs.assemble(replaced), records, template_descriptions(records),
        docs.replacement_report(replaced), run="1",
    )
    new = spark.read.parquet(paths["processed_document"])
    old = spark.read.parquet(paths["original_markdown"])
    return new.select("doc_id", F.length("content").cast("bigint").alias("processed_length")).join(
        old.select("doc_id", F.length("content").cast("bigint").alias("original_length")), "doc_id"
    )
