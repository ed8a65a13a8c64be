"""JSON rows as VARIANT, with their most frequent fields as typed columns of their own.

A filter on a field of a JSON text reads and parses every row. Here a field that many rows have is a plain Parquet
column, so a filter on it is pushed into the scan, its statistics leave out row groups, and the rest of the row is not read. All other
fields stay in the VARIANT. ``Shredded`` gives the column of a field where there is one and the path into the VARIANT elsewhere; both
give the same values."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import keep_rows

#: So many fields at most get columns, and only those that this share of the rows has.
MOST_FIELDS = 16
LEAST_SHARE = 0.05
#: Letters that no number holds, be it hexadecimal, infinite or none.
NO_NUMBER = "ghjklmoqrsuvwz"
#: What may stand before the brace of a JSON object.
BEFORE_OBJECT = " \t\n\r\ufeff"


def _text(name: str) -> Column:
    if "'" in name:
        # such a name fits no path: the object as a map
        return F.try_variant_get("row", "$", "map<string,string>").getItem(name)
    return F.try_variant_get("row", f"$['{name}']", "string")


@dataclass(frozen=True)
class Shredded:
    """A stored table of rows and which fields have columns: name -> (column, type)."""

    rows: DataFrame
    columns: dict[str, tuple[str, str]]

    def field(self, name: str) -> Column:
        """A field as text; null where absent."""
        column, kind = self.columns.get(name, ("", ""))
        return F.col(column) if kind == "string" else _text(name)

    def number(self, name: str, type_: str = "double") -> Column:
        """A field as a number; null where it does not read as one. A field stored as whole numbers keeps that type."""
        column, kind = self.columns.get(name, ("", ""))
        if kind == "bigint" or kind == type_:
            return F.col(column)
        return self.field(name).try_cast(type_)

    def where_text(self, name: str, value: str) -> DataFrame:
        return self.rows.filter(self.field(name) == value)

    def where_number(self, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
        """Rows whose field reads as a number in (low, high]."""
        rows, value = self.rows, self.number(name)
        if low is not None:
            rows = rows.filter(value > low)
        return rows if high is None else rows.filter(value <= high)

    def where_equal(self, name: str, value: int) -> DataFrame:
        return self.rows.filter(self.number(name, "bigint") == value)

    def average_where(self, name: str, where: str, value: str) -> DataFrame:
        return self.where_text(where, value).agg(F.avg(self.number(name)).alias("average"))

    def above(self, name: str, low: float) -> DataFrame:
        """Rows of any table that have the field and exceed a value in it."""
        return self.rows.filter(self.field(name).isNotNull() & (self.number(name) > low))


def _object(row_data: str) -> Column:
    """A JSON object as VARIANT; null for everything else."""
    return F.when(F.startswith(F.ltrim(row_data, F.lit(BEFORE_OBJECT)), F.lit("{")), F.try_parse_json(row_data))


def parsed(table_data: DataFrame) -> DataFrame:
    """table_id, row_index and the row as VARIANT; rows that are no JSON object are left out, as reads of a table do."""
    return keep_rows(table_data.select("table_id", "row_index", _object("row_data").alias("row")), F.col("row").isNotNull())


def field_counts(table_data: DataFrame) -> DataFrame:
    """How often each field occurs with a value, and how often that reads as a whole number and as a number, over the rows that are
    stored. Every row is parsed once."""
    fields = table_data.select(F.explode(F.try_variant_get(_object("row_data"), "$", "map<string,string>")).alias("name", "text"))
    # a text that is no number takes long to read as one: most are told by their letters
    whole = ~F.rlike("text", F.lit("[A-Za-z.]")) & F.col("text").try_cast("bigint").isNotNull()
    number = ~F.rlike("text", F.lit(f"(?i)[{NO_NUMBER}]")) & F.col("text").try_cast("double").isNotNull()
    counted = fields.filter(F.col("text").isNotNull()).withColumn("bigint", whole).withColumn("double", F.when(F.col("bigint"), True).otherwise(number))
    return counted.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in ("bigint", "double")])


def choose_columns(table_data: DataFrame, most: int = MOST_FIELDS, least_share: float = LEAST_SHARE) -> dict[str, tuple[str, str]]:
    """The most frequent fields and the narrowest type that all their values read as. The driver gets ``most`` rows at most."""
    counts = field_counts(table_data)
    total = table_data.agg(F.count(F.lit(1)).alias("rows")).scalar()
    frequent = counts.filter((F.col("n") >= total * least_share) & (F.col("n") > 0) & ~F.contains("name", F.lit("'"))).orderBy(F.desc("n"), "name").limit(most)
    kind = F.when(F.col("bigint") == F.col("n"), "bigint").when(F.col("double") == F.col("n"), "double").otherwise("string")
    chosen = frequent.agg(F.array_sort(F.collect_list(F.struct("name", kind.alias("kind"))))).first()[0]
    return {x["name"]: (f"f{i}", x["kind"]) for i, x in enumerate(chosen)}


def shred(table_data: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    rows = parsed(table_data)
    return rows.select("*", *[(_text(name) if kind == "string" else _text(name).try_cast(kind)).alias(column) for name, (column, kind) in columns.items()])


def write_shredded(table_data: DataFrame, folder: str, order_by: tuple[str, ...] = (), most: int = MOST_FIELDS, least_share: float = LEAST_SHARE) -> Shredded:
    """Store rows (table_id, row_index, row_data) with columns for their frequent fields, each file sorted by those of ``order_by``
    (fields with columns), so that statistics leave out most of it; then by table and index."""
    columns = choose_columns(table_data, most, least_share)
    order = [columns[name][0] for name in order_by if name in columns]
    spark = table_data.sparkSession
    shred(table_data, columns).sortWithinPartitions(*order, "table_id", "row_index").write.mode("overwrite").parquet(f"{folder}/rows")
    spark.range(1).select(F.lit(json.dumps(columns)).alias("columns")).write.mode("overwrite").json(f"{folder}/columns")
    return read_shredded(spark, folder)


def read_shredded(spark: SparkSession, folder: str) -> Shredded:
    """A stored table, with nothing but its folder."""
    columns = json.loads(spark.read.schema("columns string").json(f"{folder}/columns").first()[0])
    return Shredded(spark.read.parquet(f"{folder}/rows"), {name: tuple(x) for name, x in columns.items()})
