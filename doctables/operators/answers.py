"""Question batches: the text a model is asked with, and the reading of its replies.

The catalog has no bound, so its context is a set of ordered parts, stored once for all
questions instead of once per question; only the newest tables, five unless told otherwise, go into
a prompt as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

EMPTY_CONTEXT = "No tables available in the database."
CONTEXT_HEADER = "Available tables in the database:"
CONTEXT_TABLES = 5
QUOTED_CHARACTERS = 200

# Words that decide a reply which is not JSON.
POSITIVE_KEYWORDS = ["yes", "true", "fulfillable", "can be", "possible"]
NEGATIVE_KEYWORDS = ["no", "false", "impossible", "cannot", "not possible"]

# How a reply with SQL has to begin.
SQL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "WITH"]

REPLY_SCHEMA = (
    "is_fulfillable boolean, confidence string, reasoning string, "
    "suggested_approach string, required_tables array<string>"
)

STORED_SCHEMA_TEXT = """Stored data:
- tables: table_id, source_file, rows, columns, column_names (array), column_types (map), description, created_at
- table_data: table_id, row_index, row_data (a JSON object per row), created_at
- processing_sessions: session_id, source_file, total_tables, successful_tables, created_at"""


def table_context(tables: DataFrame) -> DataFrame:
    """One context block per table: id, source, shape, columns, description."""
    block = F.concat(
        F.lit("- Table: "), F.coalesce("table_id", F.lit("Unknown")),
        F.lit("\n  Source: "), F.coalesce("source_file", F.lit("Unknown")),
        F.lit("\n  Rows: "), F.coalesce("rows", F.lit(0)).cast("string"),
        F.lit(", Columns: "), F.coalesce("columns", F.lit(0)).cast("string"),
        F.when(
            F.size("column_names") > 0,
            F.concat(F.lit("\n  Columns: "), F.array_join("column_names", ", ")),
        ).otherwise(""),
        F.when(
            F.length("description") > 0, F.concat(F.lit("\n  Description: "), F.col("description"))
        ).otherwise(""),
    )
    return tables.select("table_id", "created_at", block.alias("text"))


def context_header(tables: DataFrame) -> DataFrame:
    """The line above the context blocks, or the sentence for an empty catalog."""
    return tables.limit(1).agg(F.count(F.lit(1)).alias("_n")).select(
        F.when(F.col("_n") == 0, EMPTY_CONTEXT).otherwise(CONTEXT_HEADER).alias("text")
    )


def analysis_prompt_parts(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Feasibility prompts in parts ``(question_id, part, table_id, text)``.

    A prompt is: its ``opening``, all ``context`` parts (question_id NULL, newest table first,
    shared by every question), its ``question``. Nothing is repeated per question."""
    none = F.lit(None).cast("bigint")
    nothing = F.lit(None).cast("string")
    opening = context_header(tables).select(
        none.alias("question_id"), F.lit("opening").alias("part"), nothing.alias("table_id"),
        F.concat(
            F.lit("Decide whether the question below can be answered from the stored tables.\n\n"),
            F.col("text"),
        ).alias("text"),
    )
    context = table_context(tables).select(
        none.alias("question_id"), F.lit("context").alias("part"), "table_id", "text"
    )
    asked = questions.select(
        F.col("question_id").cast("bigint").alias("question_id"),
        F.lit("question").alias("part"),
        nothing.alias("table_id"),
        F.concat(
            F.lit('User Query: "'), F.col("question"),
            F.lit(
                '"\n\nReturn only a JSON object with the keys is_fulfillable (true/false), '
                "confidence (0.0-1.0), reasoning, suggested_approach, required_tables (list of ids)."
            ),
        ).alias("text"),
    )
    return opening.unionByName(context).unionByName(asked)


def _typed_block() -> Column:
    columns = F.transform(
        "column_names",
        lambda c: F.concat(
            c, F.lit(" ("), F.coalesce(F.element_at("column_types", c), F.lit("string")), F.lit(")")
        ),
    )
    return F.concat(
        F.lit("- table_id: '"), F.col("table_id"), F.lit("'\n  source_file: '"),
        F.col("source_file"), F.lit("'\n  rows: "), F.col("rows").cast("string"),
        F.lit(", columns: "), F.col("columns").cast("string"),
        F.lit("\n  columns: "), F.array_join(columns, ", "),
    )


def newest_tables_text(tables: DataFrame, most: int = CONTEXT_TABLES) -> DataFrame:
    """One row: the ``most`` newest tables with typed columns, for a prompt."""
    newest = tables.orderBy(F.desc("created_at"), "table_id").limit(most)
    ranked = newest.select(
        F.struct(
            (-F.unix_micros("created_at")).alias("age"), F.col("table_id"), _typed_block().alias("text")
        ).alias("t")
    )
    texts = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"])
    return ranked.agg(
        F.when(F.count(F.lit(1)) == 0, "No tables available.")
        .otherwise(F.concat(F.lit(STORED_SCHEMA_TEXT + "\n\nNewest tables:\n"), F.array_join(texts, "\n")))
        .alias("context")
    )


def _asked_for_sql(attempt: int) -> Column:
    retry = (
        f"Attempt {attempt}: the earlier queries failed. Check table and column names, quoting "
        "and letter case.\n"
        if attempt > 1
        else ""
    )
    return F.concat(
        F.lit('User Question: "'), F.col("question"),
        F.lit(f'"\n{retry}Read fields of row_data as JSON, cast numbers, and return only the query.'),
    )


def sql_prompts(questions: DataFrame, tables: DataFrame, attempt: int = 1,
                most_tables: int | None = CONTEXT_TABLES) -> DataFrame:
    """A prompt per question that asks for one SQL query; later attempts carry guidance.

    ``most_tables`` of the newest tables are in it as text. None is for all tables: as there can be any number
    of them, the result is then in parts ``(question_id, part, table_id, text)`` as that of
    ``analysis_prompt_parts``: an opening, a context part per table (both for all questions), a question."""
    if most_tables is None:
        none, nothing = F.lit(None).cast("bigint"), F.lit(None).cast("string")
        opening = tables.limit(1).agg(F.count(F.lit(1)).alias("_n")).select(
            none.alias("question_id"), F.lit("opening").alias("part"), nothing.alias("table_id"),
            F.concat(
                F.lit("Write one SQL query that answers the question.\n\n"),
                F.when(F.col("_n") == 0, "No tables available.").otherwise(STORED_SCHEMA_TEXT + "\n\nTables:"),
            ).alias("text"),
        )
        context = tables.select(
            none.alias("question_id"), F.lit("context").alias("part"), "table_id", _typed_block().alias("text")
        )
        asked = questions.select(
            F.col("question_id").cast("bigint").alias("question_id"), F.lit("question").alias("part"),
            nothing.alias("table_id"), _asked_for_sql(attempt).alias("text"),
        )
        return opening.unionByName(context).unionByName(asked)
    return questions.select(
        "question_id",
        F.concat(
            F.lit("Write one SQL query that answers the question.\n\n"),
            newest_tables_text(tables, most_tables).scalar(),
            F.lit("\n\n"), _asked_for_sql(attempt),
        ).alias("prompt"),
    )


def _unfence(reply: Column, opening: str) -> Column:
    """Strip, then take off a code fence at the start and one at the end."""
    body = F.regexp_replace(strip(reply), opening, "")
    return F.regexp_replace(body, r"```\z", "")


def _keyword_reading(reply: Column) -> tuple[Column, Column]:
    lower = F.lower(reply)

    def hits(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.contains(lower, F.lit(w)).cast("int")
        return total

    positive, negative = hits(POSITIVE_KEYWORDS), hits(NEGATIVE_KEYWORDS)
    return positive > negative, F.when(positive + negative > 0, 0.3).otherwise(0.1)


def _fallback_reason(reply: Column, quoted: int | None) -> Column:
    return F.concat(
        F.lit("Fallback analysis based on response keywords. Raw response: "),
        reply if quoted is None else F.concat(F.substring(reply, 1, quoted), F.lit("...")),
    )


def keyword_analysis(replies: DataFrame, reply: str = "reply",
                     quoted: int | None = QUOTED_CHARACTERS) -> DataFrame:
    """Verdict by keywords contained in the reply (as substrings). The reason quotes the first ``quoted``
    characters of the reply, or with None all of it."""
    verdict, confidence = _keyword_reading(F.col(reply))
    return replies.select(
        "*",
        verdict.alias("is_fulfillable"),
        confidence.alias("confidence"),
        _fallback_reason(F.col(reply), quoted).alias("reasoning"),
        F.lit("Please try rephrasing your query for better analysis.").alias("suggested_approach"),
    )


def parse_analysis(replies: DataFrame, reply: str = "reply",
                   quoted: int | None = QUOTED_CHARACTERS) -> DataFrame:
    """Feasibility replies as columns: JSON (fenced or not) with defaults, else by keywords, with ``quoted``
    characters of the reply (None: all) as the reason."""
    body = _unfence(F.col(reply), r"\A```json")
    staged = replies.withColumn("_body", body).withColumn(
        "_json", F.from_json("_body", REPLY_SCHEMA)
    )
    is_json = F.try_parse_json(F.col("_body")).isNotNull() & F.startswith(strip(F.col("_body")), F.lit("{"))
    verdict, confidence = _keyword_reading(F.col("_body"))
    j = F.col("_json")
    return staged.withColumn("_ok", is_json).select(
        *replies.columns,
        F.col("_ok").alias("from_json"),
        F.when(F.col("_ok"), F.coalesce(j["is_fulfillable"], F.lit(False))).otherwise(verdict).alias("is_fulfillable"),
        F.when(F.col("_ok"), F.coalesce(j["confidence"].try_cast("double"), F.lit(0.0))).otherwise(confidence).alias("confidence"),
        F.when(F.col("_ok"), F.coalesce(j["reasoning"], F.lit("No reasoning provided")))
        .otherwise(_fallback_reason(F.col("_body"), quoted)).alias("reasoning"),
        F.when(F.col("_ok"), F.coalesce(j["suggested_approach"], F.lit("No suggestions provided")))
        .otherwise(F.lit("Please try rephrasing your query for better analysis."))
        .alias("suggested_approach"),
        F.when(F.col("_ok"), F.coalesce(j["required_tables"], F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("required_tables"),
    )


def extract_sql(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """SQL out of replies: no fence, a known first keyword, a closing semicolon; else NULL."""
    body = strip(_unfence(F.col(reply), r"\A```(sql)?"))
    begins = F.lit(False)
    for k in SQL_KEYWORDS:
        begins = begins | F.startswith(F.upper(F.col("_body")), F.lit(k))
    closed = F.when(F.endswith(F.col("_body"), F.lit(";")), F.col("_body")).otherwise(
        F.concat("_body", F.lit(";"))
    )
    return (
        replies.withColumn("_body", body)
        .withColumn("sql_query", F.when(begins, closed))
        .drop("_body")
    )
