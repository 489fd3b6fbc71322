"""Purged temporal splits. Folds are a few rows over positions in the calendar, joined as ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk_forward(n: int, folds: int, test: int, train: int, horizon: int, expanding: bool = False, embargo: int = 0, least: int = 60) -> list[dict]:
    """Train and test position ranges of an n-date calendar; training ends horizon + 1 dates before the test."""
    if n - folds * test - horizon - 1 < train and not expanding:
        train = n - folds * test - horizon - 1
        if train < least:
            raise ValueError("the history is too short for these folds")
    out = []
    for k in range(folds):
        test_end = n - (folds - 1 - k) * test - 1
        test_start = test_end - test + 1
        train_end = test_start - horizon - 2
        train_start = 0 if expanding else max(0, train_end - train + 1)
        if test_start <= 0 or train_end - train_start + 1 < least:
            continue
        out.append({"fold": k, "train_lo": train_start, "train_hi": train_end, "test_lo": test_start, "test_hi": test_end, "n_purged": horizon + 1 + embargo})
    if not out:
        raise ValueError("no folds")
    return out


def purged_kfold(n: int, folds: int, horizon: int, embargo: int = 0) -> list[dict]:
    """Contiguous test blocks; training leaves out horizon + 1 dates before and horizon + 1 + embargo after."""
    edge = [round(n * k / folds) for k in range(folds + 1)]
    return [{"fold": k, "test_lo": a, "test_hi": b - 1, "gap_lo": max(0, a - horizon - 1), "gap_hi": min(n - 1, b - 1 + horizon + 1 + embargo)} for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]


def positions(rows: DataFrame) -> DataFrame:
    """date and pos: a calendar of one row a date, numbered."""
    return rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def fold_roles(rows: DataFrame, folds: list[dict]) -> DataFrame:
    """fold and role (train or test) of each date that has one."""
    spark = rows.sparkSession
    ranges = [(f["fold"], "test", f["test_lo"], f["test_hi"]) for f in folds]
    if "train_lo" in folds[0]:
        ranges += [(f["fold"], "train", f["train_lo"], f["train_hi"]) for f in folds]
    else:
        ranges += [(f["fold"], "train", lo, hi) for f in folds for lo, hi in ((0, f["gap_lo"] - 1), (f["gap_hi"] + 1, 1 << 30))]
    table = spark.createDataFrame(ranges, "fold int, role string, lo int, hi int")
    return positions(rows).join(F.broadcast(table), F.col("pos").between(F.col("lo"), F.col("hi"))).select("date", "pos", "fold", "role")
