"""The trainer against separate fits on the raw rows, with models that fail; permutations and bootstrap by key."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import hashing
from quantloom.operators import boosting, evaluation, models, splits, training


def rows(n_days=200, n_names=12, seed=6):
    rng = np.random.default_rng(seed)
    days = [datetime.date(2020, 1, 6) + datetime.timedelta(weeks=i) for i in range(n_days)]
    frame = pd.DataFrame([(d, f"T{k:02d}") for d in days for k in range(n_names)], columns=["date", "ticker"])
    frame["a"], frame["b"] = rng.normal(size=len(frame)), rng.normal(size=len(frame))
    frame.loc[rng.random(len(frame)) < 0.05, "a"] = np.nan
    frame["target"] = 0.3 * frame["a"].fillna(0) - 0.2 * frame["b"] + rng.normal(size=len(frame))
    frame["fwd_return"] = frame["target"] / 100
    frame.loc[rng.random(len(frame)) < 0.03, "target"] = np.nan
    return frame


class Broken:
    features = ["a"]

    def fit(self, rows, target):
        raise RuntimeError("out of luck")

    def importance(self):
        return {}


class LateOnly(models.Ridge):
    """Fails where the first fold's moments come."""

    seen = 0

    def fit_moments(self, xx, xy, yy):
        LateOnly.seen += 1
        if LateOnly.seen == 1:
            raise ValueError("the first one")
        return super().fit_moments(xx, xy, yy)


def test_walk_forward(spark):
    frame = rows()
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "date date, ticker string, a double, b double, target double, fwd_return double").repartition(4).cache()
    folds = splits.walk_forward(200, 2, 40, 100, 4)
    LateOnly.seen = 0
    candidates = {"ridge": models.Ridge(["b", "a"], 5.0), "net": models.ElasticNet(["a", "b"]), "late": LateOnly(["a"]), "broken": Broken(), "trees": boosting.LeafTrees(["a", "b"], rounds=3, rate=0.5, depth=2, least=30)}
    got = training.walk_forward(df, candidates, folds, horizon=4, ensemble=["ridge", "net", "broken"])
    assert {(f["fold"], f["model"]) for f in got.failures} == {(0, "late"), (0, "broken"), (1, "broken")} and "out of luck" in got.failures[-1]["error"]
    predictions = got.predictions.toPandas()
    assert len(predictions) == 2 * 40 * 12 and "pred_broken" not in predictions and predictions["pred_late"].isna().sum() == 480
    days = sorted(frame["date"].unique())
    for f in folds:
        train = frame[frame["date"].isin(days[f["train_lo"] : f["train_hi"] + 1]) & frame["target"].notna()]
        x = train[["b", "a"]].fillna(0).to_numpy()
        centred = x - x.mean(axis=0)
        coef = np.linalg.solve(centred.T @ centred + 5 * np.eye(2), centred.T @ train["target"])
        own = predictions[predictions["fold"] == f["fold"]]
        want = train["target"].mean() + (own[["b", "a"]].fillna(0).to_numpy() - x.mean(axis=0)) @ coef
        np.testing.assert_allclose(own["pred_ridge"], want, rtol=1e-8)
        trees = boosting.LeafTrees(["a", "b"], rounds=3, rate=0.5, depth=2, least=30).fit(spark.createDataFrame(train), "target")
        alone = trees.predict(spark.createDataFrame(own[["date", "ticker", "a", "b"]]), "p").toPandas().merge(own, on=["date", "ticker"])
        np.testing.assert_allclose(alone["p"], alone["pred_trees"])
        spec = got.folds[f["fold"]]
        assert (spec["train_start"], spec["test_end"]) == (days[f["train_lo"]], days[f["test_hi"]])
    table = got.fold_metrics.toPandas().set_index(["fold", "model"])
    assert set(table.index) == {(f, m) for f in (0, 1) for m in ("ridge", "net", "late", "trees", "ensemble")} - {(0, "late")}
    own = predictions[predictions["fold"] == 1].dropna(subset=["target"])
    ics = own.groupby("date")[["pred_ridge", "target"]].apply(lambda g: g["pred_ridge"].rank().corr(g["target"].rank()))
    assert math.isclose(table.loc[(1, "ridge"), "mean_ic"], ics.mean(), rel_tol=1e-9)
    d, n = ics - ics.mean(), len(ics)
    var = d @ d + sum(2 * (1 - j / 9) * (d[j:].to_numpy() @ d[:-j].to_numpy()) for j in range(1, 9))
    assert math.isclose(table.loc[(1, "ridge"), "t_hac"], ics.mean() / math.sqrt(var) * n, rel_tol=1e-9)
    e = own["target"] - own["pred_ridge"]
    assert math.isclose(table.loc[(1, "ridge"), "oos_r2"], 1 - (e @ e) / ((own["target"] - own["target"].mean()) ** 2).sum(), rel_tol=1e-9)
    assert set(got.metrics.toPandas()["model"]) == {"ridge", "net", "late", "trees", "ensemble"}
    assert set(got.importances) == {"ridge", "net", "late", "trees"} and got.importances["ridge"]["a"] > 0


@pytest.mark.parametrize("size", [1, 2, 5, 16, 17, 300])
def test_keyed_permutations(size):
    keys = hashing.mix32_of(np.arange(40)[None, :, None] * 977 + np.arange(4)[:, None, None])
    got = hashing.permuted(np.arange(size)[None, :], size, keys)
    assert got.shape == (40, size) and (np.sort(got, axis=1) == np.arange(size)).all()
    if size > 4:
        assert len({tuple(r) for r in got}) > (25 if size == 5 else 38)
    if size == 300:
        first = got[:, 0]
        assert abs(first.mean() - 149.5) < 60 and len(set(first.tolist())) > 30


def test_mixing_is_the_same_everywhere(spark):
    import duckdb
    from pyspark.sql import functions as F

    values = [0, 1, 2, 2**31, 2**32 - 1, 123456789012, 7919]
    want = hashing.mix32_of(np.array(values)).tolist()
    assert [r["m"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long").select("i", hashing.mix32(F.col("v")).alias("m")).orderBy("i").collect()] == want
    con = duckdb.connect()
    assert [con.execute(f"select m from (select {hashing.mix32_sql('v', 'm')} from (select {v}::bigint as v))").fetchone()[0] for v in values] == want


def test_permutations_and_bootstrap_are_what_they_say(spark):
    frame = rows(60, 9).dropna()
    df = spark.createDataFrame(frame)
    got = sorted(tuple(r) for r in evaluation.randomisation(df, "a", "target", 6, 3).collect())
    want = np.zeros(6)
    for day, g in frame.sort_values("ticker").groupby("date"):
        p, t = g["a"].rank().to_numpy(), g["target"].rank().to_numpy()
        number = (day - datetime.date(1970, 1, 1)).days
        for rep in range(6):
            keys = hashing.mix32_of(rep * 1000003 + number * 8191 + np.arange(4) * 131 + 3)[:, None]
            want[rep] += np.corrcoef(p[hashing.permuted(np.arange(len(p)), len(p), keys)], t)[0, 1]
    np.testing.assert_allclose([v for _, v in got], want / frame["date"].nunique())
    rng = np.random.default_rng(1)
    x = rng.normal(0.001, 0.01, 150)
    series = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, net double")
    boot = {r["replicate"]: r["sharpe"] for r in evaluation.bootstrap_sharpe(series, n_boot=30, block=10.0, seed=5).collect()}
    for rep in range(30):
        key = hashing.mix32_of(rep * 7919 + 5)
        draws, at = [], 0
        for k in range(150):
            at = int(hashing.mix32_of(key + 2 * k + 1) % 150) if k == 0 or hashing.mix32_of(key + 2 * k) < int(2**32 / 10) else (at + 1) % 150
            draws.append(x[at])
        assert math.isclose(boot[rep], np.mean(draws) / np.std(draws, ddof=1) * math.sqrt(252), rel_tol=1e-9)


def test_attribution_and_diagnostics_helpers(spark):
    rng = np.random.default_rng(3)
    n = 140
    f = rng.normal(size=(n, 2))
    y = 0.001 + f @ [0.5, -0.2] + rng.normal(size=n) * 0.3
    days = [datetime.date(2021, 1, 1) + datetime.timedelta(days=i) for i in range(n)]
    returns = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y, strict=True)], "date date, net double")
    factors = spark.createDataFrame([(d, float(a), float(b), 0.0001) for d, (a, b) in zip(days, f, strict=True)], "date date, mkt double, smb double, rf double")
    got = evaluation.factor_regression(returns, factors, ["mkt", "smb"], lags=4)
    x, r = np.column_stack([np.ones(n), f]), y - 0.0001
    b = np.linalg.lstsq(x, r, rcond=None)[0]
    e = r - x @ b
    g = x * e[:, None]
    meat = g.T @ g
    for j in range(1, 5):
        part = g[j:].T @ g[:-j]
        meat += (1 - j / 5) * (part + part.T)
    inv = np.linalg.inv(x.T @ x)
    t = b / np.sqrt(np.diag(inv @ meat @ inv))
    r2 = 1 - e @ e / ((r - r.mean()) ** 2).sum()
    assert math.isclose(got["fit"]["r_squared"], r2, rel_tol=1e-9) and math.isclose(got["fit"]["adj_r_squared"], 1 - (1 - r2) * (n - 1) / (n - 3), rel_tol=1e-9)
    for k, c in enumerate(("alpha", "mkt", "smb")):
        assert math.isclose(got[c]["t"], t[k], rel_tol=1e-8) and math.isclose(got[c]["coef"], b[k] * (252 if c == "alpha" else 1), rel_tol=1e-9)
    assert "error" in evaluation.factor_regression(returns.limit(50), factors, ["mkt"])
    sweep = spark.createDataFrame([(1, "x", f"f{k}", 0.01 * k, float(v)) for k, v in enumerate([1, -9, 5, 3.5, -3.5, 0.5])], "horizon int, target string, feature string, mean_ic double, t double")
    assert [r["feature"] for r in evaluation.strongest(sweep, 4).orderBy("place").collect()] == ["f1", "f2", "f3", "f4"]
    assert evaluation.sweep_summary(sweep).first()["n_sig"] == 4
    many = evaluation.deflated(returns, "net", 50).first()
    few = evaluation.deflated(returns, "net", 1).first()
    assert few["threshold"] == 0 and many["deflated"] < few["deflated"] and evaluation.deflated(returns.limit(59), "net", 5).first()["deflated"] is None
