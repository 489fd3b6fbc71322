"""Weights per (model, date). Windows for the closed forms; dense algebra only where a date's matrix is needed."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

DATE = ("date",)
#: Buckets of names whose best scores bound those of a date's best names.
BUCKETS = 32


def rank_long_short(rows: DataFrame, score: str, n_long: int, n_short: int, gross: float = 1.0, cap: float | None = None, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Equal weights of half the gross on the best and the worst names; thin dates use a quarter of their names, under four none."""
    live = rows.where(F.col(score).isNotNull())
    w = Window.partitionBy(*keys)
    live = live.withColumns({"_n": F.count("*").over(w), "_top": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "_low": F.row_number().over(w.orderBy(F.asc(score), F.desc("ticker")))})
    thin = F.col("_n") < max(n_long + n_short, 10)
    few = F.greatest(F.floor(F.col("_n") / 4), F.lit(1))
    nl, ns = F.when(thin, few).otherwise(n_long), F.when(thin, few).otherwise(n_short)
    weight = F.when(F.col("_n") < 4, 0.0).when(F.col("_top") <= nl, gross / 2 / nl).when(F.col("_low") <= ns, -gross / 2 / ns).otherwise(0.0)
    if cap is not None:
        weight = F.greatest(F.least(weight, F.lit(cap)), F.lit(-cap))
    return live.withColumn("weight", weight).drop("_n", "_top", "_low")


def extremes(rows: DataFrame, scores: list[str], n: int, keys: tuple[str, ...] = DATE, means: tuple[str, ...] = ()) -> DataFrame:
    """The keys with n_<score> (rows that have it), top_<score> and low_<score>, which the n best and the n worst reach or pass, and means; from one pass, kept, as it has a row a date.

    Names are dealt into buckets: the n-th of the buckets' best scores is passed or reached by n names. It is missing, so that all names count, where under n buckets have a score.
    """
    each = rows.groupBy(*keys, F.pmod(F.hash("ticker"), F.lit(BUCKETS)).alias("_bucket")).agg(
        *[f(c).alias(f"{what}_{c}") for c in scores for what, f in (("n", F.count), ("top", F.max), ("low", F.min))], *[f(c).alias(f"{what}_{c}") for c in means for what, f in (("n", F.count), ("sum", F.sum))]
    )
    nth = lambda c, up: F.get(F.sort_array(F.collect_list(c), up), F.lit(n - 1)).alias(c)
    total = lambda c: F.sum(f"n_{c}").alias(f"n_{c}")
    return cut(each.groupBy(*keys).agg(
        *[x for c in scores for x in (total(c), nth(f"top_{c}", False), nth(f"low_{c}", True))], *[F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(c) for c in means]
    ))


def held_books(rows: DataFrame, scores: list[str], n_long: int, n_short: int, gross: float = 1.0, keys: tuple[str, ...] = DATE, means: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(book, a score's name, and the rows of its ``rank_long_short`` whose weight is not 0; keys, n_<score> and means of all rows): one pass finds what the best and worst names of a date reach, one takes these, and only these are ranked."""
    least = max(n_long + n_short, 10)
    most = max(n_long, n_short, (least - 1) // 4, 1)
    found = extremes(rows, scores, most, keys, means)
    bounds = found.select(*keys, *[f"{what}_{c}" for c in scores for what in ("n", "top", "low")])
    reaches = {c: F.col(c).isNotNull() & (F.coalesce(F.col(c) >= F.col(f"top_{c}"), F.lit(True)) | F.coalesce(F.col(c) <= F.col(f"low_{c}"), F.lit(True))) for c in scores}
    near = rows.join(F.broadcast(bounds), list(keys)).where(reduce(or_, reaches.values()))  # the bounds have a row a date
    books = F.array(*[F.when(reaches[c], F.struct(F.lit(c).alias("book"), F.col(c).alias("_score"), F.col(f"n_{c}").alias("_n"))) for c in scores])
    near = cut(near.withColumn("_book", F.explode(books)).where("_book is not null").select("_book.*", *rows.columns).repartition(*keys))

    def side(order: list, n: int, sign: int) -> DataFrame:
        best = near.withColumn("_place", F.row_number().over(Window.partitionBy("book", *keys).orderBy(*order))).where(F.col("_place") <= most)
        size = F.when(F.col("_n") < least, F.greatest(F.floor(F.col("_n") / 4), F.lit(1))).otherwise(n)
        return best.where((F.col("_n") >= 4) & (F.col("_place") <= size)).withColumn("weight", sign * gross / 2 / size).drop("_place", "_n", "_score")

    held = side([F.desc("_score"), "ticker"], n_long, 1).union(side([F.asc("_score"), F.desc("ticker")], n_short, -1))
    return held, found.drop(*[f"{what}_{c}" for c in scores for what in ("top", "low")])


def held_long_short(rows: DataFrame, score: str, n_long: int, n_short: int, gross: float = 1.0, keys: tuple[str, ...] = DATE) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``rank_long_short`` whose weight is not 0, the keys of all its rows): ``held_books`` of one score."""
    held, found = held_books(rows, [score], n_long, n_short, gross, keys)
    return held.drop("book"), found.where(F.col(f"n_{score}") > 0).select(*keys)


def score_weighted(rows: DataFrame, score: str, gross: float = 1.0, cap: float | None = None, keys: tuple[str, ...] = DATE) -> DataFrame:
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_z", (F.col(score) - F.avg(score).over(w)) / F.nullif(F.stddev_pop(score).over(w), F.lit(0.0)))
    weight = F.coalesce(F.col("_z") / F.nullif(F.sum(F.abs("_z")).over(w), F.lit(0.0)) * gross, F.lit(0.0))
    if cap is not None:
        weight = F.greatest(F.least(weight, F.lit(cap)), F.lit(-cap))
    return rows.withColumn("weight", weight).drop("_z")


def inverse_vol(rows: DataFrame, vol: str, gross: float = 1.0, cap: float | None = None, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Scale the weights by 1/vol and each side back to half the gross."""
    rows = rows.withColumn("_raw", F.col("weight") / F.nullif(F.col(vol), F.lit(0.0)))
    side = Window.partitionBy(*keys, F.signum("weight"))
    weight = F.when(F.col("weight") == 0, 0.0).otherwise(F.coalesce(F.col("_raw") / F.nullif(F.sum(F.abs("_raw")).over(side), F.lit(0.0)) * gross / 2, F.lit(0.0)))
    if cap is not None:
        weight = F.greatest(F.least(weight, F.lit(cap)), F.lit(-cap))
    return rows.withColumn("weight", weight).drop("_raw")


def beta_neutral(rows: DataFrame, beta: str, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Take out the held names' projection on beta; with under four held names unchanged."""
    w = Window.partitionBy(*keys)
    held = F.col("weight") != 0
    b = F.when(held, F.coalesce(F.col(beta), F.lit(1.0)))
    share = F.sum(b * F.col("weight")).over(w) / F.nullif(F.sum(b * b).over(w), F.lit(0.0))
    return rows.withColumn("weight", F.when(held & (F.count_if(held).over(w) >= 4), F.col("weight") - F.coalesce(share, F.lit(0.0)) * b).otherwise(F.col("weight")))


def sector_neutral(rows: DataFrame, keys: tuple[str, ...] = DATE) -> DataFrame:
    return rows.withColumn("weight", F.col("weight") - F.avg("weight").over(Window.partitionBy(*keys, "sector")))


def dollar_beta_neutral(rows: DataFrame, beta: str, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Residual of the held weights on a constant and beta, from window sums."""
    w = Window.partitionBy(*keys)
    held = F.col("weight") != 0
    b, x = F.when(held, F.coalesce(F.col(beta), F.lit(1.0))), F.when(held, F.col("weight"))
    cov, var = F.covar_pop(b, x).over(w), F.var_pop(b).over(w)
    slope = F.when(var > 1e-12, cov / var).otherwise(0.0)
    return rows.withColumn("weight", F.when(held, x - F.avg(x).over(w) - slope * (b - F.avg(b).over(w))).otherwise(0.0))


def neutral_residual(weights: np.ndarray, exposures: np.ndarray) -> np.ndarray:
    """Least-squares residual of held weights; empty exposures are left out."""
    held = weights != 0
    if held.sum() < 4:
        return weights
    x = exposures[held]
    x = x[:, (np.abs(x.mean(axis=0)) > 1e-12) | (x.std(axis=0) > 1e-12)]
    out = weights.copy()
    out[held] -= x @ np.linalg.lstsq(x, weights[held], rcond=None)[0]
    return out


def joint_neutral(rows: DataFrame, beta: str, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Residual on a constant, beta and sector dummies: a least-squares fit a date, whose names are a bounded cross-section."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(g)), g[beta].fillna(1.0), pd.get_dummies(g["sector"]).to_numpy(float)])
        return g.assign(weight=neutral_residual(g["weight"].to_numpy(float), x))

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def rescaled(rows: DataFrame, gross: float, keys: tuple[str, ...] = DATE) -> DataFrame:
    total = F.sum(F.abs("weight")).over(Window.partitionBy(*keys))
    return rows.withColumn("weight", F.coalesce(F.col("weight") / F.nullif(total, F.lit(0.0)) * gross, F.lit(0.0)))


def shrunk_covariance(returns: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage to a scaled identity; the sample covariance for under 30 rows or 2 columns."""
    n, p = returns.shape
    x = returns - returns.mean(axis=0)
    if n < 30 or p < 2:
        return np.atleast_2d(np.cov(returns, rowvar=False))
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((x**2).T @ (x**2) / n - s**2).sum() / p / n, delta)
    return (beta / delta if delta else 0.0) * mu * np.eye(p) + (1 - (beta / delta if delta else 0.0)) * s


def mean_variance(scores: np.ndarray, returns: np.ndarray, gross: float = 1.0, cap: float | None = None, aversion: float = 1.0) -> np.ndarray:
    """Solve the risk-scaled covariance for standardised scores, de-mean, scale to the gross and clip; under five names nothing."""
    if len(scores) < 5 or np.std(scores) == 0:
        return np.zeros(len(scores))
    cov = shrunk_covariance(returns)
    mu = (scores - scores.mean()) / scores.std() * np.sqrt(np.diag(cov)).mean()
    w = np.linalg.solve(aversion * cov + 1e-10 * np.eye(len(mu)), mu)
    w -= w.mean()
    w *= gross / (np.abs(w).sum() or 1.0)
    return np.clip(w, -cap, cap) if cap else w


def mean_variance_by_date(scores: DataFrame, history: DataFrame, score: str, gross: float = 1.0, cap: float | None = None, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Weights per date from scores and ``history`` (the date's keys, ticker, returns: an array of the trailing returns, of equal lengths): one dense solve a date, whose names are a bounded cross-section."""
    rows = scores.where(F.col(score).isNotNull()).join(history, [*keys, "ticker"])
    schema = ", ".join([*(f"{k} {dict(scores.dtypes)[k]}" for k in keys), f"ticker {dict(scores.dtypes)['ticker']}", "weight double"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ticker")
        w = mean_variance(g[score].to_numpy(float), np.column_stack([np.asarray(r, float) for r in g["returns"]]), gross, cap)
        return g[[*keys, "ticker"]].assign(weight=w)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def volatility_scalar(returns: np.ndarray, target: float, lookback: int, cap: float) -> float:
    recent = np.asarray(returns)[-lookback:]
    if len(recent) < lookback // 2 or len(recent) < 2 or recent.std(ddof=1) == 0:
        return 1.0
    return float(np.clip(target / (recent.std(ddof=1) * np.sqrt(252)), 1 / cap, cap))


def build_weights(rows: DataFrame, score: str, method: str = "rank", n_long: int = 20, n_short: int = 20, gross: float = 1.0, cap: float | None = None, vol: str | None = None, beta: str | None = None, sectors: bool = False, keys: tuple[str, ...] = DATE, history: DataFrame | None = None) -> DataFrame:
    """Method, clip, constraints, then the gross; the clip comes before the constraints, so it may be exceeded."""
    if method == "rank":
        rows = rank_long_short(rows, score, n_long, n_short, gross, cap, keys)
    elif method == "score":
        rows = score_weighted(rows, score, gross, cap, keys)
    elif method == "risk_parity":
        rows = inverse_vol(rank_long_short(rows, score, n_long, n_short, gross, None, keys), vol, gross, cap, keys)
    elif method == "mean_variance":
        rows = rows.join(mean_variance_by_date(rows, history, score, gross, cap, keys), [*keys, "ticker"])
    else:
        raise ValueError(f"unknown method {method!r}")
    if beta and sectors:
        rows = rescaled(joint_neutral(rows, beta, keys), gross, keys)
    elif beta:
        rows = rescaled(dollar_beta_neutral(rows, beta, keys), gross, keys)
    return rows
