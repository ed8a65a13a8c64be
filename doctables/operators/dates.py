"""Dates in many forms, read by what a whole column says.

``03/04/2024`` alone may be two days. Every column counts the values that read as day first and as month first; values with a
13 to 31 in one place read in one order only and so decide for the others of their column. Year first and names of months
read in one way. Two digits of a year are 1969 to 2068."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.types import VOTE_THRESHOLD

# Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: A month by its name or the start of it, of three letters at least.
MONTH = "(?:" + "|".join(name[:3] + "".join(f"(?:{letter}" for letter in name[3:]) + ")?" * len(name[3:]) for name in MONTHS) + ")"
# Year first, two places that may be day or month, a month by name in second or in first place.
SHAPE = (r"(?i)^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|(?:\d{1,2}[-/.]\d{1,2}[-/.]|\d{1,2}[- ]" + MONTH + r"\.?,?[- ]|" + MONTH + r"\.?[- ]\d{1,2},?[- ])"
         r"(?:\d{4}|\d{2}))$")
PIVOT = "69"


def _year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.when(y < PIVOT, "20").otherwise("19"), y)).otherwise(y)


def _month(word: Column) -> Column:
    """The number of a month that has the shape of one; null for digits."""
    at = F.instr(F.lit("".join(name[:3] for name in MONTHS)), F.substring(F.lower(word), 1, 3))
    return F.when(at > 0, F.floor((at + 2) / 3)).cast("string")


def readings(c: Column) -> Column:
    """A cell as the dates it may be: ``one_way`` if it reads in one way only, ``by_day`` and ``by_month`` else."""
    text = strip(c)
    date = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")

    def read(p: Column) -> Column:
        x, y, z = p[0], p[1], p[2]
        one = F.coalesce(F.when(F.length(x) == 4, date(x, y, z)), date(_year(z), _month(y), x), date(_year(z), _month(x), y))
        return F.struct(one.alias("one_way"), date(_year(z), y, x).alias("by_day"), date(_year(z), x, y).alias("by_month"))

    # The parts are bound by the array of one element, so that they are cut once.
    return F.transform(F.array(F.when(text.rlike(SHAPE), F.split(text, "[-/., ]+"))), read)[0]


def _chosen(read: Column, by_day: Column) -> Column:
    return F.coalesce(read["one_way"], F.when(by_day, read["by_day"]).otherwise(read["by_month"]))


def read_date(c: Column, by_day: Column) -> Column:
    """A cell as a date, null where it is none, by the order its column has."""
    return _chosen(readings(c), by_day)


def _votes(value: Column, read: Column) -> list[Column]:
    return [F.count_if(value.isNotNull() & ~strip(value).isin("", "-")).alias("voters"),
            *[F.count_if(read[n].isNotNull()).alias(n) for n in ("one_way", "by_day", "by_month")]]


def _decided(votes: Column | None = None, prefer_day: bool = True) -> tuple[Column, Column]:
    """Whether the day comes first, and whether strictly more than 80 % of the cells that have a value are dates."""
    at = (lambda n: votes[n]) if votes is not None else F.col
    first = at("by_day") >= at("by_month") if prefer_day else at("by_day") > at("by_month")
    return first, at("one_way") + F.greatest(at("by_day"), at("by_month")) > at("voters") * VOTE_THRESHOLD


def date_columns(cells: DataFrame, keys: list[str], value: str = "value", prefer_day: bool = True) -> DataFrame:
    """Per column of long-form cells: the votes, ``is_date`` and ``day_first``. One aggregate for all tables, combined
    map-side. ``prefer_day`` decides a column whose values all read in both orders, or equally many in either."""
    first, is_date = _decided(prefer_day=prefer_day)
    read = cells.select(*keys, F.col(value).alias("_value"), readings(F.col(value)).alias("_read"))
    return read.groupBy(*keys).agg(*_votes(F.col("_value"), F.col("_read"))).select("*", is_date.alias("is_date"), first.alias("day_first"))


def dated_cells(cells: DataFrame, keys: list[str], value: str = "value", prefer_day: bool = True) -> DataFrame:
    """Cells of columns of dates with ``date``; null for a cell that is none, and in other columns."""
    decided = date_columns(cells, keys, value, prefer_day).select(*keys, "is_date", "day_first")
    return cells.join(decided, keys).withColumn("date", F.when(F.col("is_date"), read_date(F.col(value), F.col("day_first")))).drop("is_date", "day_first")


def with_dates(df: DataFrame, columns: list[str], prefer_day: bool = True) -> DataFrame:
    """A flat frame whose columns of dates, among ``columns``, become dates; the others stay. The driver gets one row of votes."""
    read = df.select(*[F.struct(F.col(c).cast("string").alias("value"), readings(F.col(c).cast("string")).alias("read")).alias(f"_{i}") for i, c in enumerate(columns)])
    counts = read.agg(*[F.struct(*_votes(F.col(f"_{i}.value"), F.col(f"_{i}.read"))).alias(f"_{i}") for i in range(len(columns))])
    decided = counts.select(*[F.struct(*[x.alias(n) for n, x in zip(("day", "is_date"), _decided(F.col(f"_{i}"), prefer_day), strict=True)]).alias(f"_{i}")
                              for i in range(len(columns))]).first()
    return df.withColumns({c: read_date(F.col(c).cast("string"), F.lit(decided[i]["day"])) for i, c in enumerate(columns) if decided[i]["is_date"]})
