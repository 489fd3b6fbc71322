"""Forward-looking labels on a dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_ticker


def forward_return(horizon: int, lag: int = 1, close: str = "close") -> Column:
    """close[t+lag+h] / close[t+lag] - 1."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return F.try_divide(F.lead(close, lag + horizon).over(by_ticker()), F.lead(close, lag).over(by_ticker())) - 1


def demean(c: str, min_names: int = 10) -> Column:
    w = Window.partitionBy("date")
    return F.when(F.count(c).over(w) >= min_names, F.col(c) - F.avg(c).over(w))


def forward_market(market: DataFrame, horizon: int, lag: int = 1) -> DataFrame:
    """date and fwd_mkt: the market compounded over t+lag+1 .. t+lag+h, where all of them are known."""
    w = Window.orderBy("date").rowsBetween(lag + 1, lag + horizon)
    return market.select("date", F.when(F.count("mkt_return").over(w) == horizon, F.product(1 + F.col("mkt_return")).over(w) - 1).alias("fwd_mkt"))


def forward_markets(market: DataFrame, horizons: tuple[int, ...], lag: int = 1) -> DataFrame:
    """date, mkt_return and fwd_mkt_h of each horizon, from one pass over the market."""
    ahead = {h: Window.orderBy("date").rowsBetween(lag + 1, lag + h) for h in horizons}
    return market.select("date", "mkt_return", *[F.when(F.count("mkt_return").over(w) == h, F.product(1 + F.col("mkt_return")).over(w) - 1).alias(f"fwd_mkt_{h}") for h, w in ahead.items()])


def beta_adjusted(fwd: str, fwd_mkt: str, beta: str) -> Column:
    return F.col(fwd) - F.col(beta) * F.col(fwd_mkt)


def vol_scaled(fwd: str, vol: str) -> Column:
    v = F.nullif(F.col(vol), F.lit(0.0))
    return F.when(v.isNotNull(), F.col(fwd) / F.greatest(v, F.lit(1e-4)))


def triple_barrier(sigma: str, up: float = 2.0, down: float = 2.0, hold: int = 10, lag: int = 1, close: str = "close") -> Column:
    """1 or -1 for the barrier touched first on the path t+lag .. t+lag+hold-1, 0 for none or both on one day; missing without an entry."""
    entry = F.lead(close, lag).over(by_ticker())
    path = F.array(*[F.lead(close, k).over(by_ticker()) for k in range(lag, lag + hold)])
    width = F.col(sigma) * F.sqrt(F.lit(float(hold)))
    first = lambda test: F.array_position(F.transform(path, lambda x: F.coalesce(test(x), F.lit(False))), True)
    high, low = first(lambda x: x >= entry * F.exp(width * up)), first(lambda x: x <= entry * F.exp(-width * down))
    never = F.lit(hold + 1)
    high, low = F.when(high > 0, high).otherwise(never), F.when(low > 0, low).otherwise(never)
    return F.when(entry.isNotNull(), F.when(high < low, 1.0).when(low < high, -1.0).otherwise(0.0))


def build_labels(
    rows: DataFrame, method: str = "forward_excess_return", horizon: int = 21, lag: int = 1, min_names: int = 10, sigma: str = "vol_21", vol: str | None = None, beta: str | None = None, market: DataFrame | None = None,
    up: float = 2.0, down: float = 2.0, hold: int | None = None,
) -> DataFrame:
    """fwd_return and target of a dense panel.

    Returns are divided by the volatility column ``vol`` if one is named; with ``beta`` and ``market`` (date, mkt_return) an excess return is
    less the beta times the market's return over the same rows, before it is demeaned.  Barriers are ``up`` and ``down`` times sigma over
    ``hold`` rows (else the horizon).
    """
    rows = rows.withColumn("fwd_return", forward_return(horizon, lag))
    scaled = vol_scaled("fwd_return", vol) if vol else F.col("fwd_return")
    if method == "forward_return":
        return rows.withColumn("target", scaled)
    if method == "forward_excess_return":
        rows = rows.withColumn("target", scaled)
        if beta and market is not None:
            ahead = F.broadcast(forward_market(market, horizon, lag))  # a row a date
            rows = rows.join(ahead, "date", "left").withColumn("target", beta_adjusted("target", "fwd_mkt", beta)).drop("fwd_mkt")
        return rows.withColumn("target", demean("target", min_names))
    if method == "triple_barrier":
        return rows.withColumn("target", triple_barrier(sigma, up, down, hold or horizon, lag))
    raise ValueError(f"unknown label {method!r}")
