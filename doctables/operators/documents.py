"""Markdown documents: split at tables, replace tables by descriptions, put together again.

Chunks stay an array in the row of their document. Splitting shuffles nothing; replacing
shuffles each document once, to meet its descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import explodable
from ..functions.text import strip
from .markdown import TABLE_BLOCK, TABLE_LINE

PROCESSED_HEADER = "<!-- This document has been processed with table descriptions -->\n\n"
REFERENCE_PATTERN = r"(?s)\*\*Table (\d+) Summary:\*\* (.+?)(?=\n\n|\*\*Table|\z)"
_REFERENCE_HEAD = r"(?s)^\*\*Table (\d+) Summary:\*\* (.+)$"


def split_markdown(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``chunks`` (array of text and is_table) and ``table_positions``.

    A table chunk is a run of table lines; it counts as a table when more than half of its
    lines are lines in pipes. Chunks are stripped and empty ones dropped."""
    staged = documents.withColumn(
        "_between", F.split(F.col(text), TABLE_BLOCK, -1)
    ).withColumn("_blocks", F.regexp_extract_all(F.col(text), F.lit(TABLE_BLOCK), F.lit(0)))

    def is_table(block: Column) -> Column:
        lines = F.split(block, "\n", -1)
        return F.size(F.filter(lines, lambda x: x.rlike(TABLE_LINE))) > F.size(lines) * 0.5

    def chunk(body: Column, table: Column) -> Column:
        return F.struct(body.alias("text"), table.alias("is_table"))

    pieces = F.flatten(
        F.zip_with(
            "_between",
            F.concat("_blocks", F.array(F.lit(""))),  # one more text than blocks
            lambda text, block: F.array(
                chunk(strip(text), F.lit(False)), chunk(strip(block), is_table(strip(block)))
            ),
        )
    )
    return (
        staged.withColumn("chunks", F.filter(pieces, lambda c: c["text"] != ""))
        .drop("_between", "_blocks")
        .withColumn(
            "table_positions",
            F.filter(
                F.transform("chunks", lambda c, i: F.when(c["is_table"], i)),
                lambda i: i.isNotNull(),
            ),
        )
    )


def chunk_rows(split: DataFrame) -> DataFrame:
    """Long form: one row per chunk."""
    return split.select("doc_id", F.posexplode(explodable("chunks")).alias("pos", "c")).select(
        "doc_id", "pos", F.col("c.text").alias("text"), F.col("c.is_table").alias("is_table")
    )


def format_description(ordinal: Column, description: Column) -> Column:
    return F.concat(
        F.lit("**Table "), ordinal.cast("string"), F.lit(" Summary:** "), strip(description)
    )


def replace_tables(split: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Put the i-th description (if it succeeded) in place of the i-th table chunk.

    ``descriptions`` has (doc_id, ordinal, description, status); those of one document are as
    many as the tables of that one text. Alignment is by position, not by content."""
    per_document = (
        descriptions.filter(F.col("status") == "success")
        .groupBy("doc_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("ordinal", "description"))).alias("_by_ordinal")
        )
    )
    joined = split.join(per_document, "doc_id", "left")

    def details(position: Column, i: Column) -> Column:
        text = F.element_at("_by_ordinal", i + 1)
        return F.struct(
            position.alias("position"),
            (i + 1).alias("table_id"),
            F.length(F.get("chunks", position)["text"]).alias("original_length"),
            format_description(i + 1, text).alias("replacement"),
        )

    replaced = F.filter(
        F.transform("table_positions", details), lambda d: d["replacement"].isNotNull()
    )
    ordinal = lambda i: F.array_position("table_positions", i)
    new_chunks = F.transform(
        "chunks",
        lambda c, i: F.when(
            c["is_table"],
            F.coalesce(
                format_description(ordinal(i), F.element_at("_by_ordinal", ordinal(i).cast("int"))),
                c["text"],
            ),
        ).otherwise(c["text"]),
    )
    return (
        joined.withColumn("replacements", replaced)
        .withColumn("new_chunks", new_chunks)
        .drop("_by_ordinal")
    )


def assemble(replaced: DataFrame) -> DataFrame:
    """Add ``processed``: the chunks joined by blank lines below the fixed header."""
    return replaced.withColumn(
        "processed", F.concat(F.lit(PROCESSED_HEADER), F.array_join("new_chunks", "\n\n"))
    )


def replacement_totals(replaced: DataFrame) -> DataFrame:
    done = F.size("replacements").cast("bigint")
    return replaced.select(
        "doc_id",
        done.alias("total_replacements"),
        done.alias("successful_replacements"),
        (F.size("table_positions") - done).alias("failed_replacements"),
    )


def replacement_details(replaced: DataFrame) -> DataFrame:
    return replaced.select("doc_id", F.explode(explodable("replacements")).alias("d")).select(
        "doc_id",
        "d.position",
        "d.table_id",
        "d.original_length",
        F.length("d.replacement").alias("new_length"),
        F.lit("success").alias("status"),
    )


def replacement_report(replaced: DataFrame) -> DataFrame:
    """The report text of every document."""
    def one(d: Column) -> Column:
        old, new = d["original_length"], F.length(d["replacement"])
        return F.concat(
            F.lit("Position "), d["position"].cast("string"), F.lit(" (Table "),
            d["table_id"].cast("string"), F.lit("):\n  Status: success\n  Size change: "),
            old.cast("string"), F.lit(" -> "), new.cast("string"),
            F.lit(" characters\n  Reduction: "), (old - new).cast("string"),
            F.lit(" characters\n\n"),
        )

    done = F.size("replacements")
    text = F.concat(
        F.lit("TABLE REPLACEMENT REPORT\n" + "=" * 40 + "\n\nTotal Replacements Attempted: "),
        done.cast("string"), F.lit("\nSuccessful Replacements: "), done.cast("string"),
        F.lit("\nFailed Replacements: "), (F.size("table_positions") - done).cast("string"),
        F.lit("\n\n"),
        F.when(
            done > 0,
            F.concat(
                F.lit("REPLACEMENT DETAILS:\n" + "-" * 20 + "\n"),
                F.array_join(F.transform("replacements", one), ""),
            ),
        ).otherwise(""),
    )
    return replaced.select("doc_id", text.alias("report"))


def table_references(processed: DataFrame, text: str = "processed") -> DataFrame:
    """Descriptions found in processed texts, with their place: id, text, start, end, length.

    Only the references and the lengths of the text between them are shuffled."""
    pieces = processed.select(
        "doc_id",
        F.transform(F.split(F.col(text), REFERENCE_PATTERN, -1), F.length).alias("_gaps"),
        F.regexp_extract_all(F.col(text), F.lit(REFERENCE_PATTERN), F.lit(0)).alias("_found"),
    )
    parts = pieces.select("doc_id", "_gaps", F.posexplode(explodable("_found")).alias("_k", "_match")).select(
        "doc_id", "_k", F.get("_gaps", F.col("_k")).alias("_gap"), "_match"
    )
    so_far = W.partitionBy("doc_id").orderBy("_k")
    end = F.sum(F.col("_gap") + F.length("_match")).over(so_far)
    description = strip(F.regexp_extract("_match", _REFERENCE_HEAD, 2))
    return parts.select(
        "doc_id",
        F.regexp_extract("_match", _REFERENCE_HEAD, 1).cast("bigint").alias("table_id"),
        description.alias("description"),
        (end - F.length("_match")).alias("start_position"),
        end.alias("end_position"),
        F.length(description).alias("length"),
    )
