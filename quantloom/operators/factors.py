"""The rolling factor library on a dense panel: windows of one ticker partitioning, in three levels, and exponential means."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sliding import Kernel, by_frames, exponential, frame_ends, frame_sums
from ..functions.windows import by_ticker, trailing, with_least


@dataclass(frozen=True)
class FactorWindows:
    """Window lengths in calendar rows; the defaults are for daily panels."""

    returns: tuple[int, ...] = (1, 5, 10, 21, 63, 126, 252)
    vols: tuple[int, ...] = (10, 21, 63)
    means: tuple[int, ...] = (10, 21, 50, 200)
    short: int = 5
    long: int = 63
    band: int = 21
    year: int = 252
    year_least: int = 60
    skip: int = 21
    half: int = 126
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)

    @property
    def least(self) -> int:
        return max(3, self.long // 2)


WEEKLY = FactorWindows((1, 4, 13, 26, 52), (4, 13, 26), (4, 13, 26), 4, 26, 13, 52, 13, 4, 26, 14, (12, 26, 9))


def log_returns(dense: DataFrame) -> DataFrame:
    """lr (gap rows and those after them missing) and cum, its running total where lr is there."""
    rows = dense.withColumn("lr", F.ln("close") - F.ln(F.lag("close").over(by_ticker())))
    total = F.sum("lr").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cum", F.when(F.col("lr").isNotNull(), total))


def momentum(rows: DataFrame, w: FactorWindows) -> DataFrame:
    lag = lambda n: F.lag("cum", n).over(by_ticker())
    out = {f"ret_{n}": F.col("cum") - lag(n) for n in w.returns}
    if {w.skip, w.year} <= set(w.returns):
        out["mom_12_1"] = lag(w.skip) - lag(w.year)
    if {w.skip, w.half} <= set(w.returns):
        out["mom_6_1"] = lag(w.skip) - lag(w.half)
    return rows.withColumns(out)


def moments_kernel(w: FactorWindows) -> Kernel:
    n, least = w.long, w.least

    def kernel(place, values):
        k, _, m2, m3, m4 = frame_sums(place, n, values["lr"], powers=4)
        varied = (k >= least) & (np.sqrt(m2 / k) > 1e-14)
        skew = np.sqrt(k) * m3 / m2**1.5 * np.sqrt(k * (k - 1)) / (k - 2)
        kurt = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (k * m4 / m2**2 - 3) + 6)
        return {"ret_skew": np.where(varied & (k > 2), skew, np.nan), "ret_kurt": np.where(varied & (k > 3), kurt, np.nan)}

    return kernel


def higher_moments(rows: DataFrame, w: FactorWindows) -> DataFrame:
    """ret_skew and ret_kurt: bias-corrected skewness and excess kurtosis; missing for constant values."""
    return by_frames(rows, ["lr"], ["ret_skew", "ret_kurt"], w.long - 1, moments_kernel(w))


def volatility(rows: DataFrame, w: FactorWindows, moments: bool = True) -> DataFrame:
    """``moments`` adds skewness and kurtosis, which cost a pass of their own, whether they are selected later or not."""
    if moments:
        rows = higher_moments(rows, w)
    frame, least, lr = trailing(w.long), w.least, F.col("lr")
    spread = F.pow(F.ln(F.try_divide("high", "low")), F.lit(2))
    down = F.when(lr < 0, lr)
    rows = rows.withColumns(
        {f"vol_{n}": with_least(F.stddev_samp(lr), lr, trailing(n), max(3, n // 2)) for n in w.vols}
        | {
            "parkinson_vol": F.sqrt(with_least(F.avg(spread), spread, frame, least) / (4 * math.log(2))),
            "downside_vol": with_least(F.stddev_samp(down), down, frame, least),
        }
    )
    return rows.withColumn("vol_ratio", F.try_divide(F.col(f"vol_{w.vols[0]}"), F.col(f"vol_{w.vols[-1]}"))) if len(w.vols) > 1 else rows


def volatility_kernel(w: FactorWindows) -> Kernel:
    """The columns of ``volatility``, as arrays."""

    def kernel(place, values):
        def deviation(x: np.ndarray, n: int, least: int) -> np.ndarray:
            k, centre, squares = frame_sums(place, n, x)
            return np.where((k >= least) & (k > 1), np.where(np.sqrt(squares / k) > 1e-14 * np.abs(centre), np.sqrt(squares / (k - 1)), 0.0), np.nan)

        lr = _last(values, "lr", w.long, place)
        k, spread = frame_sums(place, w.long, np.log(_last(values, "high", w.long, place) / _nonzero(_last(values, "low", w.long, place))) ** 2, powers=1)
        out = {f"vol_{n}": deviation(_last(values, "lr", n, place), n, max(3, n // 2)) for n in w.vols}
        out |= {"parkinson_vol": np.where(k >= w.least, np.sqrt(spread / (4 * math.log(2))), np.nan), "downside_vol": deviation(np.where(lr < 0, lr, np.nan), w.long, w.least)}
        return out | ({"vol_ratio": out[f"vol_{w.vols[0]}"] / _nonzero(out[f"vol_{w.vols[-1]}"])} if len(w.vols) > 1 else {})

    return kernel


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.nan, x)


def _last(values: dict[str, np.ndarray], c: str, n: int, place: np.ndarray) -> np.ndarray:
    """The column with n - 1 rows in front."""
    return values[c][len(values[c]) - len(place) - n + 1 :]


def trend_names(w: FactorWindows) -> list[str]:
    return [*[f"px_to_ma_{n}" for n in w.means], "ma_cross", "dist_52w_high", "dist_52w_low", "bollinger_z"]


def trend_kernel(w: FactorWindows) -> Kernel:
    def kernel(place, values):
        close = _last(values, "close", 1, place)

        def mean(n: int) -> np.ndarray:
            k, total = frame_sums(place, n, _last(values, "close", n, place), powers=1)
            return np.where(k >= max(3, n // 2), total, np.nan)

        means = {n: mean(n) for n in w.means}
        k, low, high = frame_ends(place, w.year, _last(values, "close", w.year, place))
        some, centre, squares = frame_sums(place, w.band, _last(values, "close", w.band, place))
        deviation = np.where((some >= max(3, w.band // 2)) & (np.sqrt(squares / some) > 1e-14 * np.abs(centre)), np.sqrt(squares / (some - 1)), np.nan)
        out = {f"px_to_ma_{n}": close / _nonzero(v) - 1 for n, v in means.items()}
        out["ma_cross"] = means[w.means[0]] / _nonzero(means[w.means[-1]]) - 1
        out |= {name: np.where(k >= w.year_least, close / _nonzero(edge) - 1, np.nan) for name, edge in (("dist_52w_high", high), ("dist_52w_low", low))}
        return out | {"bollinger_z": (close - centre) / deviation}

    return kernel


def trend(rows: DataFrame, w: FactorWindows) -> DataFrame:
    return by_frames(rows, ["close"], trend_names(w), max(w.year, w.band, *w.means) - 1, trend_kernel(w))


LIQUIDITY = ["log_dollar_volume", "dv_trend", "volume_ratio", "amihud_illiq"]


def liquidity_kernel(w: FactorWindows) -> Kernel:
    def kernel(place, values):
        def mean(x: np.ndarray, n: int, least: int) -> np.ndarray:
            k, total = frame_sums(place, n, x, powers=1)
            return np.where(k >= least, total, np.nan)

        n = max(w.long, w.short)
        traded, volume, lr = (_last(values, c, n, place) for c in ("dollar_volume", "volume", "lr"))
        logs, illiq = np.log1p(traded), np.abs(lr) / _nonzero(traded) * 1e9
        return {
            "log_dollar_volume": logs[n - 1 :],
            "dv_trend": mean(logs[n - w.short :], w.short, max(3, w.short // 2)) - mean(logs[n - w.long :], w.long, w.least),
            "volume_ratio": volume[n - 1 :] / _nonzero(mean(volume[n - w.long :], w.long, w.least)),
            "amihud_illiq": np.log1p(mean(illiq[n - w.long :], w.long, w.least)),
        }

    return kernel


def liquidity(rows: DataFrame, w: FactorWindows) -> DataFrame:
    return by_frames(rows, ["dollar_volume", "volume", "lr"], LIQUIDITY, max(w.long, w.short) - 1, liquidity_kernel(w))


def market_names(w: FactorWindows) -> list[str]:
    return [f"{c}_{w.long}" for c in ("beta", "alpha", "corr_mkt", "idio_vol")]


def market_kernel(w: FactorWindows) -> Kernel:
    n, least = w.long, max(w.long // 2, min(20, w.long))

    def kernel(place, values):
        lr, m = values["lr"], values["mkt_lr"]
        both, _, _, products = frame_sums(place, n, lr, m)
        some, mean_i, own = frame_sums(place, n, lr)
        days, mean_m, market = frame_sums(place, n, m)
        enough = lambda x, k: np.where((k >= least) & (k > 1), x / (k - 1), np.nan)
        cov, var, std = enough(products, both), enough(market, days), np.sqrt(enough(own, some))
        beta = cov / np.where(var == 0, np.nan, var)
        alpha = np.where(some >= least, mean_i, np.nan) - beta * np.where(days >= least, mean_m, np.nan)
        scale = std * np.sqrt(var)
        e = lr[n - 1 :] - beta * m[n - 1 :] - alpha
        k, _, spread = frame_sums(place, n, np.concatenate([values["_residual"], e]))
        return {f"beta_{n}": beta, f"alpha_{n}": alpha, f"corr_mkt_{n}": cov / np.where(scale == 0, np.nan, scale), f"idio_vol_{n}": np.sqrt(enough(spread, k)), "_residual": e}

    return kernel


def market_relative(rows: DataFrame, w: FactorWindows) -> DataFrame:
    """Needs mkt_lr. Covariance over joint rows, the market's variance over all of its rows."""
    return by_frames(rows, ["lr", "mkt_lr"], market_names(w), w.long - 1, market_kernel(w), ("_residual",))


OSCILLATORS = ["rsi_14", "macd_norm", "macd_hist"]
#: The state of its means: mean, weight and number of values each.
_MEANS = tuple(f"_{what}_{c}" for what in ("mean", "weight", "count") for c in ("up", "down", "fast", "slow", "line"))


def oscillators_kernel(w: FactorWindows) -> Kernel:
    fast, slow, signal = w.macd
    alpha = np.array([1 / w.rsi, 1 / w.rsi, 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)])
    least = np.array([w.rsi, w.rsi, fast, slow, signal])[:, None]

    def kernel(place, values):
        state = np.array([values[c][-1] for c in _MEANS]).reshape(3, 5)
        before, close = _last(values, "close", 2, place)[:-1], _last(values, "close", 1, place)
        change = np.where(place > 0, close - before, np.nan)
        first = exponential(place, np.array([np.maximum(change, 0.0), np.maximum(-change, 0.0), close, close]), alpha[:4], state[:, :4])
        up, down, quick, late = np.where(first[2] >= least[:4], first[0], np.nan)
        macd = quick - late
        second = exponential(place, macd[None], alpha[4:], state[:, 4:])
        line = np.where(second[2] >= least[4:], second[0], np.nan)[0]
        out = {"rsi_14": (100 - 100 / (1 + up / _nonzero(down))) / 100 - 0.5, "macd_norm": macd / _nonzero(close), "macd_hist": (macd - line) / _nonzero(close)}
        return out | dict(zip(_MEANS, np.concatenate([first, second], axis=1).reshape(15, -1), strict=True))

    return kernel


def oscillators(rows: DataFrame, w: FactorWindows) -> DataFrame:
    """rsi_14, macd_norm and macd_hist: exponential means of gains, losses and closes, then of the difference of two of them."""
    return by_frames(rows, ["close"], OSCILLATORS, 1, oscillators_kernel(w), _MEANS)


def factor_names(w: FactorWindows) -> list[str]:
    n = w.long
    names = [f"ret_{k}" for k in w.returns] + [f"vol_{k}" for k in w.vols] + [f"px_to_ma_{k}" for k in w.means]
    names += ["mom_12_1"] * ({w.skip, w.year} <= set(w.returns)) + ["mom_6_1"] * ({w.skip, w.half} <= set(w.returns)) + ["vol_ratio"] * (len(w.vols) > 1)
    names += ["parkinson_vol", "downside_vol", "ret_skew", "ret_kurt", "ma_cross", "dist_52w_high", "dist_52w_low", "bollinger_z", "rsi_14", "macd_norm", "macd_hist"]
    return names + ["log_dollar_volume", "dv_trend", "volume_ratio", "amihud_illiq", f"beta_{n}", f"alpha_{n}", f"idio_vol_{n}", f"corr_mkt_{n}"]


def factor_table(dense: DataFrame, market: DataFrame, w: FactorWindows = FactorWindows()) -> DataFrame:
    """All factors of a dense panel; ``market`` has one row a date."""
    rows = dense.join(F.broadcast(market.select("date", F.log1p("mkt_return").alias("mkt_lr"))), "date", "left")
    rows = momentum(log_returns(rows), w)
    # The array kernels come last and share a pass: windows need no shuffle before them, but would after.
    kernels = [f(w) for f in (volatility_kernel, oscillators_kernel, trend_kernel, liquidity_kernel)]
    moments, relative, reach = moments_kernel(w), market_kernel(w), max(w.year, w.band, w.long, *w.means, *w.vols) - 1

    def kernel(place, values):
        near = {c: v[reach - w.long + 1 :] for c, v in values.items()}
        return {k: v for made in (*[f(place, values) for f in kernels], moments(place, near), relative(place, near)) for k, v in made.items()}

    vols = [*[f"vol_{n}" for n in w.vols], "parkinson_vol", "downside_vol", *["vol_ratio"] * (len(w.vols) > 1)]
    made = [*vols, *OSCILLATORS, *trend_names(w), *LIQUIDITY, "ret_skew", "ret_kurt", *market_names(w)]
    return by_frames(rows.drop("cum"), ["high", "low", "close", "volume", "dollar_volume", "lr", "mkt_lr"], made, reach, kernel, ("_residual", *_MEANS))
