"""The ordered quality chain, thin dates and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityRules:
    jump: float = 1.0
    jumps: int = 3
    min_price: float = 1.0
    min_history: int = 200
    max_assets: int | None = None


def quality_filter(panel: DataFrame, rules: QualityRules = QualityRules()) -> tuple[DataFrame, DataFrame]:
    """(kept panel, counters): close above 0; tickers with ``jumps`` or more returns beyond ``jump`` go, then those of low median price, of short history, and all but the ``max_assets`` of largest median dollar volume."""
    clean = panel.where("close > 0").withColumn("dollar_volume", F.col("close") * F.col("volume"))
    change = F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1
    facts = clean.withColumn("change", change).groupBy("ticker").agg(
        F.count_if(F.abs("change") > rules.jump).alias("jumps"), F.median("close").alias("price"), F.count("*").alias("days"), F.median("dollar_volume").alias("dv")
    )
    reason = F.when(F.col("jumps") >= rules.jumps, "jumps").when(F.col("price") < rules.min_price, "price").when(F.col("days") < rules.min_history, "history").otherwise("kept")
    facts = facts.withColumn("reason", reason)
    if rules.max_assets is not None:
        place = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("dv"), "ticker"))
        facts = facts.withColumn("place", place).withColumn("reason", F.when((F.col("reason") == "kept") & (F.col("place") > rules.max_assets), "rank").otherwise(F.col("reason")))
    counters = facts.groupBy("reason").agg(F.count("*").alias("tickers"))
    return clean.join(facts.where("reason = 'kept'").select("ticker"), "ticker", "left_semi"), counters


def thin_dates(panel: DataFrame, min_names: int) -> DataFrame:
    """Rows of dates with at least so many names."""
    return panel.withColumn("names", F.count("*").over(Window.partitionBy("date"))).where(F.col("names") >= min_names).drop("names")


def thick_dates(panel: DataFrame, min_names: int) -> DataFrame:
    """The dates with at least so many names."""
    return panel.groupBy("date").count().where(F.col("count") >= min_names).select("date")


def names_mask(rows: DataFrame, column: str, least: int) -> DataFrame:
    """date and enough: whether so many names have a value of the column."""
    return rows.groupBy("date").agg((F.count(column) >= least).alias("enough"))


def feature_summary(rows: DataFrame, features: list[str]) -> DataFrame:
    """n_rows, n_features, tickers, first, last, mean_names: one row."""
    size = rows.groupBy("date").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_names"))
    return rows.agg(F.count("*").alias("n_rows"), F.lit(len(features)).alias("n_features"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last")).crossJoin(size)  # one row each


def features_known(features: list[str], share: float = 0.8, more: int = 0) -> Column:
    """Whether a row has so many of the features, and so many more."""
    return sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0)) >= int(share * len(features)) + more


def feature_mask(rows: DataFrame, features: list[str], target: str = "target", share: float = 0.8) -> DataFrame:
    """Rows with a target and enough features, the missing ones then 0."""
    return rows.where(F.col(target).isNotNull() & features_known(features, share)).na.fill(0.0, features)


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"), F.countDistinct("sector").alias("sectors"))


def between_dates(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct().orderBy("date")


def cross_section_size(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_names"), F.count("*").alias("dates"))
