"""Variance forecasts of names and their losses.

HAR is windows and expressions: running cross moments, a factorisation a refit, nothing fitted from raw rows twice.  GARCH is
fitted by maximum likelihood a name (its series is a group: a row a date): analytic scores, and quasi-Newton steps for all refits at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.windows import by_ticker, exponential_means

FLOOR = 1e-12
#: The spans of the lagged mean variances.
SPANS = (1, 5, 22)
#: Decay and rows of the variance that a likelihood starts from, least degrees of freedom.
BACKCAST, BACKCAST_ROWS, LEAST_DF = 0.94, 75, 2.05


def ewma(rows: DataFrame, r: str = "ret", lam: float = 0.94) -> DataFrame:
    """ticker, date, realised and ewma: the exponential mean of the squared returns before a row; a missing return is 0."""
    x = F.coalesce(F.col(r), F.lit(0.0))
    data = rows.select("ticker", "date", (x * x).alias("realised"))
    data = exponential_means(data, {"_v": (F.col("realised"), 1 - lam, 1)})
    return data.select("ticker", "date", "realised", F.lag("_v").over(by_ticker()).alias("ewma"))


# --- HAR -----------------------------------------------------------------------------------------


def har(rows: DataFrame, r: str = "ret", least: int = 252, refit: int = 21) -> DataFrame:
    """ticker, date, realised and har: least squares of the squared return on its lagged day, 5-day and 22-day means.

    Coefficients are those of all rows before every ``refit``-th one, first after ``least`` rows; a missing return is 0; a name
    with under ``least`` + 20 rows that have all means gets no forecast.  A mean that the others explain gets no coefficient.
    """
    own, whole = by_ticker(), Window.partitionBy("ticker")
    x2 = F.coalesce(F.col(r), F.lit(0.0))
    data = rows.select("ticker", "date", (x2 * x2).alias("realised")).withColumn("k", F.row_number().over(own) - 1 - max(SPANS))
    lagged = {f"x{i}": F.avg("realised").over(own.rowsBetween(-n, -1)) for i, n in enumerate(SPANS, 1)}
    data = data.withColumns(lagged | {"n": F.max("k").over(whole) + 1})
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, len(SPANS) + 1)]]
    data = linear.cross_moments(data, x, F.col("realised"), own.rowsBetween(Window.unboundedPreceding, -1), F.col("k") >= 0)
    data = linear.solved(data, len(x))
    due = (F.col("k") >= least) & ((F.col("k") - least) % refit == 0)
    last = {f"b{i}": F.last(F.when(due, F.col(f"b{i}")), True).over(own.rowsBetween(Window.unboundedPreceding, 0)) for i in range(len(x))}
    forecast = F.greatest(linear.predicted(x, [F.col(f"b{i}") for i in range(len(x))]), F.lit(FLOOR))
    return data.withColumns(last).select("ticker", "date", "realised", F.when((F.col("k") >= least) & (F.col("n") >= least + 20), forecast).alias("har"))


def har_sql(source: str, least: int, refit: int) -> str:
    """Common tables up to ``har_f`` (ticker, k, v, f) from ``source`` (ticker, k from 1, v): moments of every refit by a join with the rows before it."""
    size, n = max(SPANS), len(SPANS) + 1
    means = ", ".join(f"avg(v) OVER (PARTITION BY ticker ORDER BY k ROWS BETWEEN {m} PRECEDING AND 1 PRECEDING) AS x{i}" for i, m in enumerate(SPANS, 1))
    sums = ", ".join([f"sum(d.x{i} * d.x{j}) AS g{i}_{j}" for i in range(n) for j in range(i, n)] + [f"sum(d.x{i} * d.v) AS h{i}" for i in range(n)])
    return f"""har_d AS (SELECT ticker, k - 1 - {size} AS j, v, 1.0::DOUBLE AS x0, {means}, count(*) OVER (PARTITION BY ticker) - {size} AS n FROM {source}),
har_g AS (SELECT d.ticker, b.j AS block, {sums} FROM har_d d JOIN (SELECT ticker, j FROM har_d WHERE j >= {least} AND (j - {least}) % {refit} = 0) b ON b.ticker = d.ticker AND d.j < b.j WHERE d.j >= 0 GROUP BY ALL),
{linear.elimination_sql('har_g', n, 'ticker, block')},
har_f AS (SELECT d.ticker, d.j + 1 + {size} AS k, v, CASE WHEN j >= {least} AND n >= {least + 20} THEN greatest({' + '.join(f'h{i} * x{i}' for i in range(n))}, {FLOOR}::DOUBLE) END AS f FROM har_d d LEFT JOIN e{n} ON e{n}.ticker = d.ticker AND block = {least} + (j - {least}) // {refit} * {refit})"""


# --- GARCH ---------------------------------------------------------------------------------------


def _filtered(u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y[t] = u[t] + b y[t-1] along the last axis, by doubling: logarithmically many whole-array steps."""
    y, step, power = u.copy(), 1, b[:, None]
    while step < y.shape[1] and np.abs(power).max() > 1e-300:
        y[:, step:] += power * y[:, :-step].copy()
        power, step = power * power, step * 2
    return y


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = sum(1 / (x + k) for k in range(8))
    y = x + 8
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - shift


_lgamma = np.vectorize(math.lgamma)


def backcast(r: np.ndarray) -> float:
    """The variance before the first row: decaying weights on the first squared deviations from the mean."""
    e = (r - r.mean())[:BACKCAST_ROWS] ** 2
    w = BACKCAST ** np.arange(len(e))
    return float(w @ e / w.sum())


def garch_variance(r: np.ndarray, theta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Conditional variances of every parameter row (mean, omega, alpha, beta, df) over the series; ``start`` is the variance before it."""
    mu, omega, a, b = (theta[:, k : k + 1] for k in range(4))
    e2 = (r - mu) ** 2
    u = omega + a * np.column_stack([start, e2[:, :-1]])
    u[:, 0] += b[:, 0] * start
    return _filtered(u, theta[:, 3])


def garch_loss(r: np.ndarray, theta: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(negative log likelihood, its gradient) of parameter row i on the first sizes[i] rows: a GARCH(1,1) with a constant mean and Student-t errors of unit variance."""
    mu, omega, a, b, nu = (theta[:, k : k + 1] for k in range(5))
    live = np.arange(len(r)) < sizes[:, None]
    e = r - mu
    h = garch_variance(r, theta, start)
    q = e**2 / (h * (nu - 2))
    c = _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(np.pi * (nu - 2))
    ll = c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(q)
    dh = -0.5 / h + (nu + 1) / 2 * q / (1 + q) / h
    de = -(nu + 1) * e / (h * (nu - 2)) / (1 + q)
    before = lambda x, first: np.column_stack([first, x[:, :-1]])
    zero, beta = np.zeros(len(theta)), theta[:, 3]
    h_mu = _filtered(before(-2 * a * e, zero), beta)
    h_omega = _filtered(np.ones_like(h), beta)
    h_a = _filtered(before(e**2, start), beta)
    h_b = _filtered(before(h, start), beta)
    d_nu = 0.5 * (_digamma((nu + 1) / 2) - _digamma(nu / 2)) - 0.5 / (nu - 2) - 0.5 * np.log1p(q) + (nu + 1) / 2 * q / (1 + q) / (nu - 2)
    parts = [dh * h_mu - de, dh * h_omega, dh * h_a, dh * h_b, d_nu]
    return -np.where(live, ll, 0).sum(axis=1), -np.column_stack([np.where(live, p, 0).sum(axis=1) for p in parts])


def _natural(z: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, their Jacobian) of free numbers: omega, alpha, beta and df stay positive, alpha + beta below 1."""
    ea, eb = np.exp(np.clip(z[:, 2], -30, 30)), np.exp(np.clip(z[:, 3], -30, 30))
    total = 1 + ea + eb
    omega, nu = scale * np.exp(np.clip(z[:, 1], -30, 10)), LEAST_DF + np.exp(np.clip(z[:, 4], -15, 6.2))
    theta = np.column_stack([math.sqrt(scale) * z[:, 0], omega, ea / total, eb / total, nu])
    jacobian = np.zeros((len(z), 5, 5))
    jacobian[:, 0, 0], jacobian[:, 1, 1], jacobian[:, 4, 4] = math.sqrt(scale), omega, nu - LEAST_DF
    a, b = theta[:, 2], theta[:, 3]
    jacobian[:, 2, 2], jacobian[:, 3, 3], jacobian[:, 2, 3], jacobian[:, 3, 2] = a * (1 - a), b * (1 - b), -a * b, -a * b
    return theta, jacobian


def garch_fits(r: np.ndarray, sizes: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Parameter rows (mean, omega, alpha, beta, df) that maximise the likelihood of the first sizes[i] rows; all fits take their quasi-Newton steps together."""
    scale = float(np.var(r[: sizes.max()])) or 1.0
    start = np.array([backcast(r[:n]) for n in sizes])

    def value(z: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        theta, jacobian = _natural(z, scale)
        loss, slope = garch_loss(r, theta, start[which], sizes[which])
        return loss / sizes[which], np.einsum("ri,rij->rj", slope, jacobian) / sizes[which, None]

    every = np.arange(len(sizes))
    grid = [(p, s) for p in (0.03, 0.1, 0.2) for s in (0.5, 0.9, 0.97) if p < s]
    starts = [np.column_stack([np.full(len(sizes), v) for v in (r[: sizes.max()].mean() / math.sqrt(scale), math.log(1 - s), math.log(p / (1 - s)), math.log((s - p) / (1 - s)), math.log(6.0))]) for p, s in grid]
    first = np.array([value(z, every)[0] for z in starts])
    z = np.array([starts[k][i] for i, k in enumerate(first.argmin(axis=0))])
    loss, slope = value(z, every)
    inverse = np.tile(np.eye(5), (len(z), 1, 1))
    open_ = np.ones(len(z), bool)
    for _ in range(rounds):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        step = -np.einsum("rij,rj->ri", inverse[at], slope[at])
        down = (step * slope[at]).sum(axis=1)
        bad = down >= 0
        step[bad], inverse[at[bad]] = -slope[at[bad]], np.eye(5)
        down = (step * slope[at]).sum(axis=1)
        step *= np.minimum(1, 2 / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
        length, todo, taken = np.ones(len(at)), np.ones(len(at), bool), np.zeros(len(at), bool)
        for _ in range(30):
            k = np.flatnonzero(todo)
            if not len(k):
                break
            new_loss, new_slope = value(z[at[k]] + length[k, None] * step[k], at[k])
            good = np.isfinite(new_loss) & (new_loss <= loss[at[k]] + 1e-4 * length[k] * down[k])
            for i in np.flatnonzero(good):
                row, s = at[k[i]], length[k[i]] * step[k[i]]
                y = new_slope[i] - slope[row]
                if (sy := s @ y) > 1e-14:
                    u = np.eye(5) - np.outer(s, y) / sy
                    inverse[row] = u @ inverse[row] @ u.T + np.outer(s, s) / sy
                z[row], loss[row], slope[row] = z[row] + s, new_loss[i], new_slope[i]
            todo[k[good]], taken[k[good]] = False, True
            length[todo] /= 3
        open_[at[~taken]] = False
        open_ &= np.abs(slope).max(axis=1) > 1e-7
    return _natural(z, scale)[0]


def garch_forecast(r: np.ndarray, refit: int = 63, least: int = 500) -> np.ndarray:
    """One-step variances from row ``least`` on, with parameters of all rows before every ``refit``-th one; in between the recursion goes on.

    Missing returns are left out, so their rows get no forecast; nor do series of under ``least`` + ``refit`` returns or without any variance.
    """
    out, there = np.full(len(r), np.nan), np.flatnonzero(~np.isnan(r))
    x = r[there] * 100.0
    if len(x) < least + refit or not np.var(x[:least]):
        return out
    sizes = np.arange(least, len(x), refit)
    theta = garch_fits(x, sizes)
    h = garch_variance(x, theta, np.array([backcast(x[:n]) for n in sizes]))
    for row, n in enumerate(sizes):
        out[there[n : n + refit]] = h[row, n : n + refit] / 1e4
    return out


def garch(rows: DataFrame, r: str = "ret", **options) -> DataFrame:
    """ticker, date, realised and garch; a ticker's series is a group."""
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date", kind="stable")
        x = g["_x"].to_numpy(float)
        found = pd.Series(garch_forecast(x, **options), g.index)
        return pd.DataFrame({"ticker": g["ticker"], "date": g["date"], "realised": x**2, "garch": found.astype(object).where(found.notna(), None)})

    data = rows.select("ticker", "date", F.coalesce(F.col(r), F.lit(0.0)).alias("_x"))
    return data.groupBy("ticker").applyInPandas(run, f"ticker {kinds['ticker']}, date {kinds['date']}, realised double, garch double")


def forecasts(rows: DataFrame, r: str = "ret", models: tuple[str, ...] = ("ewma", "har"), **options) -> DataFrame:
    """ticker, date, realised (squared return) and one forecast a model; a row without a return counts as one of 0, so forecasts decay over gaps."""
    makers, found = {"ewma": ewma, "har": har, "garch": garch}, None
    for m in models:
        one = makers[m](rows, r, **options.get(m, {}))
        found = one if found is None else found.join(one.drop("realised"), ["ticker", "date"])
    return found


def qlike_term(realised: Column, forecast: Column) -> Column:
    return realised / forecast - F.log(F.greatest(realised, F.lit(1e-16)) / forecast) - 1


def losses(found: DataFrame, model: str, by: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """QLIKE and mean squared error; missing under ten forecasts."""
    live = found.where(F.col(model).isNotNull() & F.col("realised").isNotNull() & (F.col(model) > 0))
    e = F.col("realised") - F.col(model)
    return live.groupBy(*by).agg(F.when(F.count("*") >= least, F.avg(qlike_term(F.col("realised"), F.col(model)))).alias("qlike"), F.avg(e * e).alias("mse"), F.count("*").alias("n"))


def diebold_mariano(a: np.ndarray, b: np.ndarray, h: int = 1) -> tuple[float, float]:
    """(statistic, two-sided normal p) of the difference of two loss series; nan under 20 rows or without a positive variance."""
    d = np.asarray(a) - np.asarray(b)
    d = d[~np.isnan(d)]
    n = len(d)
    if n < 20:
        return math.nan, math.nan
    c = d - d.mean()
    var = c @ c / n + 2 * sum((1 - k / h) * (c[k:] @ c[:-k]) / n for k in range(1, h))
    if var <= 0:
        return math.nan, math.nan
    stat = d.mean() / math.sqrt(var / n)
    return float(stat), math.erfc(abs(stat) / math.sqrt(2))


def loss_difference(found: DataFrame, a: str, b: str, by: tuple[str, ...] = ("ticker",), lags: int = 1) -> DataFrame:
    """by, statistic, p and n of the Diebold-Mariano test of two forecasts' QLIKE losses, a's less b's, as aggregates; missing under 20 rows or without a positive variance."""
    live = found.where((F.col(a) > 0) & (F.col(b) > 0) & F.col("realised").isNotNull())
    own = Window.partitionBy(*by)
    d = live.withColumn("_d", qlike_term(F.col("realised"), F.col(a)) - qlike_term(F.col("realised"), F.col(b)))
    d = d.withColumn("_c", F.col("_d") - F.avg("_d").over(own))
    d = d.withColumns({f"_l{k}": F.lag("_c", k).over(own.orderBy("date")) for k in range(1, lags)})
    n = F.count("*")
    var = sum((2 * (1 - k / lags) * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) / n for k in range(1, lags)), F.sum(F.col("_c") * F.col("_c")) / n)
    out = d.groupBy(*by).agg(n.alias("n"), F.avg("_d").alias("_m"), var.alias("_v"))
    stat = F.when((F.col("n") >= 20) & (F.col("_v") > 0), F.col("_m") / F.sqrt(F.col("_v") / F.col("n")))
    return out.select(*by, "n", stat.alias("statistic")).withColumn("p", 2 * (1 - normal_cdf(F.abs("statistic"))))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function of x >= 0 by a published approximation (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * x)
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tail


def most_volatile(rows: DataFrame, n: int, r: str = "ret", least: int = 800) -> DataFrame:
    """The n names of largest deviation, of those with ``least`` returns; their number is the limit of the report."""
    stats = rows.groupBy("ticker").agg(F.stddev_samp(r).alias("sd"), F.count(r).alias("n")).where(F.col("n") >= least)
    return stats.orderBy(F.desc("sd"), "ticker").limit(n).select("ticker")


def compared(rows: DataFrame, r: str = "ret", names: int = 40, least: int = 800, models: tuple[str, ...] = ("ewma", "har", "garch"), **options) -> DataFrame:
    """A row for each of the most volatile names: qlike_ and mse_ of each model on its returns, missing ones left out; mse is missing up to ten forecasts."""
    live = rows.where(F.col(r).isNotNull())
    live = live.join(most_volatile(live, names, r, least), "ticker", "left_semi")
    found = forecasts(live, r, models, **options)
    cells = []
    for m in models:
        ok, e = F.col(m).isNotNull(), F.col("realised") - F.col(m)
        good = ok & (F.col(m) > 0)
        cells += [F.when(F.count_if(good) >= 10, F.avg(F.when(good, qlike_term(F.col("realised"), F.col(m))))).alias(f"qlike_{m}"), F.when(F.count_if(ok) > 10, F.avg(F.when(ok, e * e))).alias(f"mse_{m}")]
    return found.groupBy("ticker").agg(*cells)
