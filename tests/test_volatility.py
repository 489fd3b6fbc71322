"""HAR, rolling exposures and GARCH against refits from raw rows, finite differences and plain recursions."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import evaluation, volatility

DAY = datetime.date(2015, 1, 5)


def series(n, seed, df=6.0, mu=0.05, omega=0.08, a=0.1, b=0.85):
    rng = np.random.default_rng(seed)
    out, h = np.empty(n), omega / (1 - a - b)
    for t in range(n):
        e = math.sqrt(h) * rng.standard_t(df) * math.sqrt((df - 2) / df)
        out[t], h = mu + e, omega + a * e * e + b * h
    return out


def table(spark, **names):
    rows = [(name, DAY + datetime.timedelta(days=i), None if math.isnan(v) else float(v)) for name, x in names.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(3)


def test_har_equals_refits(spark):
    x, gaps = series(230, 1) / 100, series(180, 2) / 100
    gaps[[3, 50, 51, 120]] = np.nan
    got = volatility.har(table(spark, a=x, b=gaps, c=x[:90], d=np.zeros(200)), least=60, refit=21).toPandas().sort_values(["ticker", "date"])
    for name, r in (("a", x), ("b", np.nan_to_num(gaps))):
        v = pd.Series(r**2)
        data = pd.concat([v, v.shift(1), v.rolling(5).mean().shift(1), v.rolling(22).mean().shift(1)], axis=1).dropna()
        design, y, want = np.column_stack([np.ones(len(data)), data.iloc[:, 1:]]), data.iloc[:, 0].to_numpy(), np.full(len(r), np.nan)
        for start in range(60, len(data), 21):
            coef = np.linalg.lstsq(design[:start], y[:start], rcond=None)[0]
            want[data.index[start : start + 21]] = np.maximum(design[start : start + 21] @ coef, 1e-12)
        own = got[got["ticker"] == name]
        np.testing.assert_allclose(own["har"].to_numpy(float), want, rtol=1e-6, atol=1e-15)
        np.testing.assert_allclose(own["realised"], r**2)
    assert got[got["ticker"] == "c"]["har"].isna().all()
    assert set(got[got["ticker"] == "d"]["har"].dropna()) == {1e-12}


def test_rolling_exposures_equal_refits(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(size=(150, 3))
    f[:, 2] = 0.9 * f[:, 1] + 0.1 * f[:, 2]
    y = f @ [1.0, -0.5, 0.25] + rng.normal(size=150) * 0.1
    days = [DAY + datetime.timedelta(days=i) for i in range(150)]
    returns = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y, strict=True)], "date date, net double")
    factors = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days, f, strict=True)], "date date, mkt double, smb double, hml double")
    got = evaluation.rolling_exposure(returns, factors, ["mkt", "smb", "hml"], window=60, step=21).orderBy("date").toPandas()
    ends = list(range(60, 150, 21))
    assert list(got["date"]) == [days[e - 1] for e in ends]
    for row, end in zip(got.itertuples(), ends, strict=True):
        want = np.linalg.lstsq(np.column_stack([np.ones(60), f[end - 60 : end]]), y[end - 60 : end], rcond=None)[0]
        np.testing.assert_allclose([row.alpha, row.mkt, row.smb, row.hml], want, rtol=1e-8)
    assert evaluation.rolling_exposure(returns.limit(70), factors, ["mkt"], window=60).count() == 0


def test_garch_likelihood_and_scores():
    r, sizes = series(300, 3), np.array([300, 211])
    theta = np.array([[0.05, 0.08, 0.1, 0.85, 6.0], [-0.1, 0.3, 0.2, 0.5, 12.0]])
    start = np.array([volatility.backcast(r[:n]) for n in sizes])
    loss, slope = volatility.garch_loss(r, theta, start, sizes)
    for k, (mu, omega, a, b, nu) in enumerate(theta):
        h, last, total = start[k], start[k], 0.0
        for x in r[: sizes[k]]:
            h = omega + a * last + b * h
            last = (x - mu) ** 2
            total += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2) * h) - (nu + 1) / 2 * math.log1p(last / h / (nu - 2))
        assert math.isclose(loss[k], -total, rel_tol=1e-10)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        numeric = (volatility.garch_loss(r, theta + step, start, sizes)[0] - volatility.garch_loss(r, theta - step, start, sizes)[0]) / 2e-6
        np.testing.assert_allclose(slope[:, k], numeric, rtol=1e-4, atol=1e-4)


def test_garch_fit_is_a_maximum_and_finds_the_parameters():
    r, sizes = series(4000, 7), np.array([4000, 1500])
    theta = volatility.garch_fits(r, sizes)
    start = np.array([volatility.backcast(r[:n]) for n in sizes])
    best, slope = volatility.garch_loss(r, theta, start, sizes)
    assert np.abs(slope[0] * np.array([1, 0.08, 0.1, 0.1, 1])).max() < 0.05
    rng = np.random.default_rng(0)
    for _ in range(60):
        other = theta * (1 + rng.normal(size=theta.shape) * 0.03)
        other[:, 2:4] *= np.minimum(1, 0.999 / other[:, 2:4].sum(axis=1))[:, None]
        assert (volatility.garch_loss(r, other, start, sizes)[0] >= best - 1e-6).all()
    assert (np.abs(theta[0] - [0.05, 0.08, 0.1, 0.85, 6.0]) < [0.05, 0.06, 0.05, 0.08, 2.0]).all(), theta
    assert (theta[:, 2] + theta[:, 3] < 1).all() and (theta[:, 1:] > 0).all()


def test_garch_forecasts_go_on_between_refits():
    r = series(420, 4) / 100
    r[[10, 300]] = np.nan
    got = volatility.garch_forecast(r, refit=50, least=250)
    x = r[~np.isnan(r)] * 100
    want = []
    for start in range(250, len(x), 50):
        mu, omega, a, b, _ = volatility.garch_fits(x, np.arange(250, len(x), 50))[(start - 250) // 50]
        h = last = volatility.backcast(x[:start])
        for t in range(min(start + 50, len(x))):
            h, last = omega + a * last + b * h, (x[t] - mu) ** 2
            want += [h / 1e4] if t >= start else []
    np.testing.assert_allclose(got[~np.isnan(got)], want, rtol=1e-9)
    assert np.isnan(got[300]) and np.isnan(got[:251]).all() and np.isnan(volatility.garch_forecast(r[:290], refit=50, least=250)).all()
    assert np.isnan(volatility.garch_forecast(np.zeros(400), refit=50, least=250)).all()


def test_comparison(spark):
    rows = table(spark, a=series(260, 1) / 100, b=series(260, 2) / 50, c=series(260, 3) / 200, short=series(120, 4) / 10)
    got = volatility.compared(rows, names=2, least=200, har={"least": 60}, garch={"least": 150, "refit": 60}).toPandas().set_index("ticker")
    assert sorted(got.index) == ["a", "b"]
    r = series(260, 2) / 50
    level, before = r[0] ** 2, [math.nan]
    for v in r[:-1]:
        level = 0.94 * level + 0.06 * v**2 if len(before) > 1 else v**2
        before.append(level)
    own = {"ewma": np.array(before), "garch": volatility.garch_forecast(r, 60, 150)}
    for m, f in own.items():
        ok = ~np.isnan(f)
        assert math.isclose(got.loc["b", f"mse_{m}"], np.mean((r[ok] ** 2 - f[ok]) ** 2), rel_tol=1e-9)
        assert math.isclose(got.loc["b", f"qlike_{m}"], np.mean(r[ok] ** 2 / f[ok] - np.log(r[ok] ** 2 / f[ok]) - 1), rel_tol=1e-6)
    assert got.notna().all().all()


@pytest.mark.parametrize("lags", [1, 3])
def test_loss_differences(spark, lags):
    rng = np.random.default_rng(2)
    rows = [(name, DAY + datetime.timedelta(days=i), *map(float, rng.uniform(0.5, 2, 3))) for name, n in (("x", 60), ("y", 15)) for i in range(n)]
    found = spark.createDataFrame(rows, "ticker string, date date, realised double, a double, b double")
    got = {r["ticker"]: r for r in volatility.loss_difference(found, "a", "b", lags=lags).collect()}
    v = np.array([r[2:] for r in rows[:60]])
    term = lambda k: v[:, 0] / v[:, k] - np.log(v[:, 0] / v[:, k]) - 1
    stat, p = volatility.diebold_mariano(term(1), term(2), lags)
    assert math.isclose(got["x"]["statistic"], stat, rel_tol=1e-9) and abs(got["x"]["p"] - p) < 1e-6
    assert got["y"]["statistic"] is None and math.isnan(volatility.diebold_mariano(term(1)[:15], term(2)[:15])[0])
