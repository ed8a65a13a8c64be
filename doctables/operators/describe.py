"""Descriptions of tables: prompts, template texts, a pluggable generator and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_SAMPLE_ROWS = 3
TEMPLATE_COLUMNS = 5


def _shape(before: str, middle: str, after: str) -> Column:
    return F.concat(
        F.lit(before), F.col("n_rows").cast("string"), F.lit(middle),
        F.col("n_cols").cast("string"), F.lit(after),
    )


def description_prompts(records: DataFrame, context_hint: str | None = None,
                        sample_rows: int | None = PROMPT_SAMPLE_ROWS) -> DataFrame:
    """A prompt per schema record: id, dimensions, names, types and up to ``sample_rows`` of the rows
    that the record holds as a sample (None: all of these, see ``schema_records``)."""
    hint = f" It was found in a {context_hint} document." if context_hint else ""
    types = F.transform(
        F.arrays_zip("columns", "labels"),
        lambda s: F.concat(F.lit("- "), s["columns"], F.lit(": "), s["labels"], F.lit("\n")),
    )
    samples = F.transform(
        F.col("sample") if sample_rows is None else F.slice("sample", 1, sample_rows),
        lambda row, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), row, F.lit("\n")),
    )
    text = F.concat(
        F.lit(f"Describe in two to four sentences what this table holds and what it is for.{hint}\n\n"),
        F.lit("Table ID: "), F.col("ordinal").cast("string"),
        _shape("\nDimensions: ", " rows × ", " columns\n"),
        F.lit("Column Names: "), F.array_join("columns", ", "), F.lit("\nColumn Types:\n"),
        F.array_join(types, ""),
        F.when(
            F.size("sample") > 0,
            F.concat(F.lit("Sample Data (first few rows):\n"), F.array_join(samples, "")),
        ).otherwise(""),
        F.lit("\nDescription:"),
    )
    failed = F.concat(
        F.lit("Unable to describe table: "),
        F.coalesce("error", F.lit("Schema extraction failed")),
    )
    return records.select(
        "doc_id", "source_file", "ordinal", "table_id", "n_rows", "n_cols",
        F.when(F.col("ok"), text).otherwise(failed).alias("prompt"),
    )


def describe_with(prompts: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Descriptions from a user's batch function ``list of prompts -> list of replies``.

    If a batch fails it is tried prompt by prompt; an empty reply or an exception becomes an
    error record and the others go on."""
    fields = ["doc_id", "source_file", "ordinal", "table_id", "n_rows", "n_cols"]
    schema = pa.schema([
        ("doc_id", pa.string()), ("source_file", pa.string()), ("ordinal", pa.int32()),
        ("table_id", pa.string()), ("n_rows", pa.int64()), ("n_cols", pa.int64()),
        ("description", pa.string()), ("status", pa.string()),
    ])

    def one(prompt: str) -> tuple[str, str]:
        try:
            return judge(generate([prompt])[0])
        except Exception as failure:
            return f"Error generating description: {failure}", "error"

    def judge(reply: str | None) -> tuple[str, str]:
        if reply is not None and reply.strip():
            return reply.strip(), "success"
        return "Failed to generate description: Empty response", "error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts_ = batch.column(len(fields)).to_pylist()
            try:
                replies = generate(prompts_)
                if len(replies) != len(prompts_):
                    raise ValueError("one reply per prompt expected")
                done = [judge(r) for r in replies]
            except Exception:
                done = [one(p) for p in prompts_]
            texts, states = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(fields))]
                + [pa.array(texts, pa.string()), pa.array(states, pa.string())],
                schema=schema,
            )

    return prompts.select(*fields, "prompt").mapInArrow(
        run,
        "doc_id string, source_file string, ordinal int, table_id string, n_rows bigint, "
        "n_cols bigint, description string, status string",
    )


def template_text(most_columns: int | None = TEMPLATE_COLUMNS) -> Column:
    """A description without a generator: shape and the first ``most_columns`` column names (None: all)."""
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    return F.concat(
        F.lit("Table with "), F.coalesce("n_rows", F.lit(0)).cast("string"), F.lit(" rows and "),
        F.size(columns).cast("string"), F.lit(" columns. Columns: "),
        F.array_join(columns if most_columns is None else F.slice(columns, 1, most_columns), ", "),
        F.lit("") if most_columns is None else F.when(F.size(columns) > most_columns, "...").otherwise(""),
        F.lit("."),
    )


def template_descriptions(records: DataFrame, most_columns: int | None = TEMPLATE_COLUMNS) -> DataFrame:
    return records.select(
        "doc_id", "source_file", "ordinal", "table_id",
        template_text(most_columns).alias("description"), F.lit("success").alias("status"),
    )


def fill_failed_descriptions(descriptions: DataFrame) -> DataFrame:
    """Give failed generations a description from the shape of their table."""
    return descriptions.withColumn(
        "description",
        F.when(
            F.col("status") == "error",
            F.concat(
                F.lit("Table "), F.col("ordinal").cast("string"), F.lit(": A table with "),
                F.col("n_rows").cast("string"), F.lit(" rows and "), F.col("n_cols").cast("string"),
                F.lit(" columns. Failed to generate detailed description."),
            ),
        ).otherwise(F.col("description")),
    )


def description_report(descriptions: DataFrame) -> DataFrame:
    """Report blocks per source file: block 0 has the totals, then one block per table.

    A source may own any share of the tables, so its report stays a set of ordered rows
    (``sort by source_file, block`` and ``write.text`` give the file)."""
    totals = descriptions.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("status") == "success").alias("_good")
    )
    head = totals.select(
        "source_file",
        F.lit(0).alias("block"),
        F.lit("").alias("table_id"),
        F.concat(
            F.lit("TABLE SUMMARY REPORT\n" + "=" * 50 + "\n\nTotal Tables: "),
            F.col("_all").cast("string"), F.lit("\nSuccessfully Described: "),
            F.col("_good").cast("string"), F.lit("\nFailed: "),
            (F.col("_all") - F.col("_good")).cast("string"), F.lit("\n"),
        ).alias("text"),
    )
    blocks = descriptions.select(
        "source_file",
        F.col("ordinal").alias("block"),
        "table_id",
        F.concat(
            F.lit("TABLE "), F.col("ordinal").cast("string"), F.lit(" ("), F.upper("status"),
            F.lit(")\n" + "-" * 30 + "\n"), F.col("description"), F.lit("\n"),
        ).alias("text"),
    )
    return head.unionByName(blocks)
