"""Exports of query results (CSV, JSON, text) and of per-document artifacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window as W

from ..session import checkpoint_root

MAX_TEXT_WIDTH = 50
RULE_EVERY = 10
FORMATS = ["csv", "json", "txt"]


def _write_metadata(result: DataFrame, path: str, rows: int, query: str | None,
                    exported_at: str | None) -> None:
    """Query, time and row count beside the data: comment lines would break part files."""
    result.sparkSession.range(1).select(
        F.lit(exported_at or dt.datetime.now().isoformat()).alias("exported_at"),
        F.lit(rows).cast("bigint").alias("total_rows"),
        F.lit(query or "Not provided").alias("query"),
    ).coalesce(1).write.mode("overwrite").json(path + ".metadata")


def _written(result: DataFrame, write) -> int:
    """Write and count in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    write(result.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def flat(result: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, bytes as base64: what text formats can hold."""
    def one(name: str, kind: str) -> Column:
        if kind.startswith(("array<", "map<", "struct<")):
            return F.to_json(F.col(f"`{name}`")).alias(name)
        return F.base64(F.col(f"`{name}`")).alias(name) if kind == "binary" else F.col(f"`{name}`")

    return result.select(*[one(name, kind) for name, kind in result.dtypes])


def export_csv(result: DataFrame, path: str, query: str | None = None,
               exported_at: str | None = None) -> str:
    """CSV with a header of the sorted column names."""
    ordered = flat(result).select(*sorted(result.columns))
    n = _written(
        ordered,
        lambda df: df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path),
    )
    _write_metadata(result, path, n, query, exported_at)
    return path


def export_json(result: DataFrame, path: str, query: str | None = None,
                exported_at: str | None = None) -> str:
    """JSON Lines; every key is written, missing values as null."""
    n = _written(
        result,
        lambda df: df.write.mode("overwrite").option("ignoreNullFields", False).json(path),
    )
    _write_metadata(result, path, n, query, exported_at)
    return path


def number_rows(result: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Add ``row_no`` 1..n in a total order, or in the order the result has if none is given, without
    bringing the rows into one task.

    The rows are checkpointed, which fixes their partitions; a row's number is its place
    in its partition plus a running sum of the row counts of the partitions (one row per partition)."""
    checkpoint_root(result.sparkSession)
    placed = (
        (result.orderBy(*order_by) if order_by else result).checkpoint()
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_at", 33))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (
        placed.join(offsets, "_part")
        .withColumn("row_no", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_part", "_at", "_before")
    )


def _cell_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def text_lines(result: DataFrame, order_by: list[str] | None = None,
               max_width: int | None = MAX_TEXT_WIDTH) -> DataFrame:
    """Lines of the text form as ``(line_no, line)``: header, rule, padded rows, a rule after
    every ten rows. Cells over ``max_width`` characters are cut; None cuts none. Column widths come
    from one aggregation and enter as constants. Numbering writes the result once to the
    checkpoint folder."""
    return _lines(number_rows(flat(result), order_by), result.columns, max_width)


def _lines(numbered: DataFrame, columns: list[str], max_width: int | None) -> DataFrame:
    def width(c: str) -> Column:
        longest = F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(_cell_text(c))), F.lit(0)))
        return longest if max_width is None else F.least(F.lit(max_width), longest)

    widths = numbered.agg(F.struct(*[width(c).alias(c) for c in columns]).alias("w"))
    w = widths.scalar()
    row = F.concat_ws(" | ", *[F.rpad(_cell_text(c), w[c], F.lit(" ")) for c in columns])
    header = F.concat_ws(" | ", *[F.rpad(F.lit(c), F.col("w")[c], F.lit(" ")) for c in columns])
    rule = F.repeat(F.lit("-"), F.length("line"))
    head = widths.select(header.alias("line"))
    top = head.select(F.lit(1).cast("bigint").alias("line_no"), "line").unionByName(
        head.select(F.lit(2).cast("bigint").alias("line_no"), rule.alias("line"))
    )
    rows = numbered.select("row_no", row.alias("line"))
    at = F.col("row_no") + 2 + F.floor((F.col("row_no") - 1) / RULE_EVERY)
    lines = rows.select(
        F.explode(
            F.when(
                F.col("row_no") % RULE_EVERY == 0,
                F.array(
                    F.struct(at.alias("line_no"), F.col("line").alias("line")),
                    F.struct((at + 1).alias("line_no"), rule.alias("line")),
                ),
            ).otherwise(F.array(F.struct(at.alias("line_no"), F.col("line").alias("line"))))
        ).alias("l")
    ).select("l.line_no", "l.line")
    return top.unionByName(lines)


def export_txt(result: DataFrame, path: str, query: str | None = None,
               exported_at: str | None = None, order_by: list[str] | None = None,
               max_width: int | None = MAX_TEXT_WIDTH) -> str:
    """Fixed-width text, in part files that follow each other in line order; rows keep the order of the
    result unless ``order_by`` gives another. ``max_width`` as in ``text_lines``."""
    numbered = number_rows(flat(result), order_by)  # the result is computed once
    n = numbered.count()
    rule = "=" * 60
    banner = [rule, "QUERY RESULTS", rule]
    if query:
        banner.append(f"Query: {query}")
    banner += [f"Exported: {exported_at or dt.datetime.now().isoformat()}", f"Total Rows: {n}", rule, ""]
    spark = result.sparkSession
    top = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in banner])).alias("line_no", "line")
    ).select((F.col("line_no") - len(banner)).cast("bigint").alias("line_no"), "line")
    lines = top.unionByName(_lines(numbered, result.columns, max_width))
    lines.orderBy("line_no").select("line").write.mode("overwrite").text(path)
    return path


def export(result: DataFrame, directory: str, format: str = "csv", filename: str | None = None,
           query: str | None = None, **options) -> str:
    """Write a result in a format by name; '' (and nothing written) when there are no rows."""
    format = format.lower()
    if format not in FORMATS:
        raise ValueError(f"Unsupported export format: {format}")
    if result.isEmpty():
        return ""
    filename = filename or f"query_results_{dt.datetime.now():%Y%m%d_%H%M%S}"
    path = f"{directory.rstrip('/')}/{filename}.{format}"
    writer = {"csv": export_csv, "json": export_json, "txt": export_txt}[format]
    return writer(result, path, query, **options)


def run_and_save(catalog, sql: str | None, directory: str, format: str = "csv",
                 filename: str | None = None, **options) -> dict:
    """Run SQL over the catalog and save its rows; the reason when nothing is saved. ``options`` are
    those of the format's writer."""
    if not sql or sql == "IMPOSSIBLE":
        return {"success": False, "error": "Query cannot be answered with available data"}
    out: dict = {"success": False, "sql_query": sql}
    try:
        result = catalog.sql(sql)
        path = export(result, directory, format, filename, sql, **options)
    except (AnalysisException, ValueError) as error:
        return {**out, "error": f"Export failed: {error}"}
    if not path:
        return {**out, "error": "Query executed but returned no results"}
    return {"success": True, "sql_query": sql, "export_path": path, "format": format.lower()}


def save_artifacts(directory: str, processed: DataFrame, records: DataFrame,
                   descriptions: DataFrame, reports: DataFrame, run: str) -> dict[str, str]:
    """One dataset per kind of artifact, partitioned by run, instead of five files a document."""
    frames = {
        "processed_document": processed.select("doc_id", F.col("processed").alias("content")),
        "original_markdown": processed.select("doc_id", F.col("text").alias("content")),
        "schemas": records,
        "descriptions": descriptions,
        "replacement_report": reports,
    }
    paths = {}
    for kind, frame in frames.items():
        paths[kind] = f"{directory.rstrip('/')}/{kind}/run={run}"
        frame.write.mode("overwrite").parquet(paths[kind])
    return paths
