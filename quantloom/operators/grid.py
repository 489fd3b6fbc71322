"""As-of alignment, lookups and outer alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(c: str, keys: list[str], order: str = "date") -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def fill_by_ticker(dense: DataFrame, columns: list[str]) -> DataFrame:
    return dense.withColumns({f"{c}_ffill": forward_fill(c, ["ticker"]) for c in columns})


def lookup(rows: DataFrame, names: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    return rows.drop(value).join(names.select(key, value).dropDuplicates([key]), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def as_of_calendar(calendar: DataFrame, series: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    """A date series on the calendar: the last known value, the default before the first. One row a date, so one partition is enough."""
    both = calendar.select("date").distinct().join(series.select("date", value), "date", "left")
    return both.select("date", F.coalesce(F.last(value, ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)).alias(value))


def as_of_expand(days: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that hold from their date until the key's next one, on every day between."""
    until = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    spans = rows.withColumn("until", until).withColumnRenamed("date", "since")
    d = days.select("date").distinct()
    return spans.join(F.broadcast(d), (F.col("date") >= F.col("since")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))).drop("since", "until")


def outer_align(series: list[DataFrame], key: str = "date") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), series)
