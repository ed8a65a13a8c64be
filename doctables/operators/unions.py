"""Stored tables of different columns as one typed frame.

A column gets the narrowest type that holds it in every table that has it, by the order integer < float < text; truth values
stay such where no other type meets them. The types come from one aggregate over the metadata, the rows from one
projection, whatever the number of tables: no table is read for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many columns at most; more are an error, none is left out.
MOST_COLUMNS = 2_000


def common_types(tables: DataFrame) -> DataFrame:
    """(name, type, position) of every column name of any table; position is the first one it has anywhere."""
    columns = tables.select(F.posexplode("column_names").alias("position", "name"), "storage_types").select(
        "position", "name", F.element_at("storage_types", F.col("name")).alias("storage"))
    merged = columns.groupBy("name").agg(
        F.min("position").alias("position"), F.bool_and(F.coalesce(F.col("storage") == "bool", F.lit(False))).alias("all_bool"),
        F.bool_and(F.coalesce(F.col("storage") == "int64", F.lit(False))).alias("all_int"),
        F.bool_and(F.coalesce(F.col("storage").isin("int64", "float64"), F.lit(False))).alias("all_numbers"))
    type_ = F.when(F.col("all_bool"), "boolean").when(F.col("all_int"), "bigint").when(F.col("all_numbers"), "double").otherwise("string")
    return merged.select("name", type_.alias("type"), "position")


def union_tables(tables: DataFrame, table_data: DataFrame, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """All rows of these tables as ``_table_id``, ``_row_index`` and every column name of any of them; missing where a table
    has no such column. Rows that are no JSON object are left out, as reads of a table do. Names that are equal but
    for their letters' case get a number behind the later one. The driver gets the names and types."""
    known = common_types(tables).orderBy("position", "name").limit(most_columns + 1)
    columns = known.agg(F.array_sort(F.collect_list(F.struct("position", "name", "type")))).first()[0]
    if len(columns) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    used, chosen = {"_table_id", "_row_index"}, []
    for c in columns:
        name, n = c["name"], 1
        while name.lower() in used:
            n += 1
            name = f"{c['name']}_{n}"
        used.add(name.lower())
        chosen.append((c["name"], name, c["type"]))
    rows = table_data.join(tables.select("table_id").distinct(), "table_id", "left_semi")
    parsed = rows.select("table_id", "row_index", F.when(F.try_parse_json("row_data").isNotNull(), F.from_json("row_data", "map<string,string>")).alias("row"))
    cell = lambda name, type_: F.col("row").getItem(name) if type_ == "string" else F.col("row").getItem(name).try_cast(type_)
    return parsed.filter(F.col("row").isNotNull()).select(
        F.col("table_id").alias("_table_id"), F.col("row_index").alias("_row_index"), *[cell(name, type_).alias(alias) for name, alias, type_ in chosen])
