"""Screens and batch scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def screen(predictions: DataFrame, score: str, n: int = 10) -> DataFrame:
    """Best and worst n names of the latest date; both ends are top-k sorts."""
    if not 1 <= n <= 100:
        raise ValueError("n must be 1 to 100")
    last = predictions.agg(F.max("date")).first()[0]
    day = predictions.where((F.col("date") == F.lit(last)) & F.col(score).isNotNull()).select("date", "ticker", F.col(score).alias("score"))
    best = day.orderBy(F.desc("score"), "ticker").limit(n).withColumn("side", F.lit("long"))
    worst = day.orderBy("score", "ticker").limit(n).withColumn("side", F.lit("short"))
    return best.union(worst)


def batch_score(observations: DataFrame, coef: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """(request, ticker, features map) to score, missing (how many features), rank and percentile within the request."""
    value = lambda f: F.coalesce(F.try_element_at("features", F.lit(f)), F.lit(0.0))
    rows = observations.withColumns({"score": sum((value(f) * w for f, w in coef.items()), F.lit(float(intercept))), "missing": sum((F.try_element_at("features", F.lit(f)).isNull().cast("int") for f in coef), F.lit(0))})
    w = Window.partitionBy("request")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "ticker")))
    return rows.withColumn("percentile", 1 - (F.col("rank") - 0.5) / F.count("*").over(w)).drop("features")


#: Warnings that a request gets.
WARNINGS = 3


def score_warnings(scored: DataFrame, n_features: int) -> DataFrame:
    """request and warning: the first rows (by ticker) with missing features, and that a single score says nothing."""
    some = scored.where("missing > 0").withColumn("_k", F.row_number().over(Window.partitionBy("request").orderBy("ticker"))).where(F.col("_k") <= WARNINGS)
    lacking = some.select("request", F.format_string(f"%s: %d of {n_features} features missing, filled with 0", F.col("ticker").cast("string"), F.col("missing")).alias("warning"))
    alone = scored.groupBy("request").count().where("count = 1").select("request", F.lit("a single score has no rank: the model orders names of a date").alias("warning"))
    return lacking.union(alone)
