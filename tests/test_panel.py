"""Differential tests against pandas on small frames with gaps, ties and short groups."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import windows
from quantloom.functions.windows import percent_rank
from quantloom.operators import backtest, evaluation, factors, labels, models, portfolio, quality, serving, splits, xsec
from quantloom.sources import panel
from quantloom.sources.simulator import simulate


def frame(n_days=80, n_names=6, seed=3):
    rng = np.random.default_rng(seed)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(n_days)]
    rows = []
    for k in range(n_names):
        price = 50.0
        for i, d in enumerate(days):
            price *= math.exp(rng.normal(0, 0.03))
            if (k == 1 and i in (20, 21, 22)) or (k == 2 and i < 15) or (k == 3 and i == 40):
                continue
            rows.append((f"T{k}", d, f"S{k % 2}", price, price * 1.01, price * 0.99, price, 0.0 if i == 7 else 1000.0 + k, price * (0.0 if i == 7 else 1000.0 + k)))
    return pd.DataFrame(rows, columns=["ticker", "date", "sector", "open", "high", "low", "close", "volume", "dollar_volume"])


@pytest.fixture(scope="module")
def wide():
    return frame().pivot(index="date", columns="ticker", values="close").sort_index()


@pytest.fixture(scope="module")
def dense(spark):
    return panel.dense(spark.createDataFrame(frame())).cache()


def collected(df, value):
    return df.select("date", "ticker", value).toPandas().pivot(index="date", columns="ticker", values=value).sort_index().astype(float)


def test_momentum_and_volatility_count_calendar_rows(dense, wide):
    w = factors.FactorWindows((1, 5, 10), (5, 10), (5, 10), 3, 20, 10, 30, 10, 5, 10)
    out = factors.volatility(factors.momentum(factors.log_returns(dense), w), w).cache()
    lr = np.log(wide).diff()
    cum = lr.cumsum()
    pd.testing.assert_frame_equal(collected(out, "ret_5"), cum - cum.shift(5), check_names=False)
    pd.testing.assert_frame_equal(collected(out, "vol_10"), lr.rolling(10, min_periods=5).std(), check_names=False)
    pd.testing.assert_frame_equal(collected(out, "ret_skew"), lr.rolling(20, min_periods=10).skew(), check_names=False, rtol=1e-6)
    pd.testing.assert_frame_equal(collected(out, "ret_kurt"), lr.rolling(20, min_periods=10).kurt(), check_names=False, rtol=1e-6)


@pytest.mark.parametrize("decay", [300.0, 20.0])
def test_exponential_means_decay_across_gaps(spark, monkeypatch, decay):
    """Against the recursion itself, with gaps longer than a block, over one block and many."""
    monkeypatch.setattr(windows, "DECAY", decay)
    monkeypatch.setattr(windows, "REACH", 5 * decay)
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=150), "b": np.abs(rng.normal(size=90)), "c": np.full(30, np.nan), "d": np.array([np.nan, 1, np.nan, 2, 3, np.nan, np.nan, 5.0])}
    series["a"][[0, 1, 30, 31]] = np.nan
    series["a"][60:110] = np.nan
    series["b"][20:] = 0.0
    rows = [(n, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), None if math.isnan(v) else float(v)) for n, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double").repartition(3)
    got = windows.exponential_means(df, {"fast": (F.col("x"), 0.5, 1), "slow": (F.col("x"), 0.03, 3)}).orderBy("ticker", "date").toPandas()
    for name, x in series.items():
        own = got[got["ticker"] == name]
        for column, alpha, least in (("fast", 0.5, 1), ("slow", 0.03, 3)):
            level, seen, gap, want = math.nan, 0, 0, []
            for v in x:
                gap += 1
                if not math.isnan(v):
                    old = (1 - alpha) ** gap
                    level = v if not seen else (old * level + alpha * v) / (old + alpha)
                    seen, gap = seen + 1, 0
                want.append(level if seen >= least else math.nan)
            np.testing.assert_allclose(own[column].to_numpy(float), want, rtol=1e-11)


def test_cross_section(spark):
    rows = [("d", f"T{i}", v) for i, v in enumerate([1.0, 2.0, 2.0, None, 10.0, -4.0])]
    df = spark.createDataFrame(rows, "date string, ticker string, x double")
    x = pd.Series([r[2] for r in rows], dtype=float)
    rank = {r["ticker"]: r["p"] for r in df.withColumn("p", percent_rank("x", ["date"])).collect()}
    for i, want in enumerate(x.rank(pct=True) - 0.5):
        assert (rank[f"T{i}"] is None) == math.isnan(want) and (math.isnan(want) or abs(rank[f"T{i}"] - want) < 1e-12)
    clip = x.clip(x.quantile(0.1), x.quantile(0.9))
    z = {r["ticker"]: r["x"] for r in xsec.normalise(df, ["x"], q=0.1).collect()}
    want = (clip - clip.mean()) / clip.std()
    assert all(abs(z[f"T{i}"] - v) < 1e-12 for i, v in enumerate(want) if not math.isnan(v))
    assert {r["x"] for r in xsec.normalise(df.withColumn("x", F.lit(1.0)), ["x"]).collect()} == {None}


def test_features_do_not_look_ahead(spark, dense):
    w = factors.FactorWindows((1, 5), (5, 10), (5, 10), 3, 10, 10, 20, 10, 5, 10)
    market = panel.market_returns(dense)
    cut = datetime.date(2020, 3, 1)
    late = lambda c, k: F.when(F.col("date") >= F.lit(cut), F.col(c) * k).otherwise(F.col(c))
    bad = dense.withColumns({c: late(c, 3.0) for c in ("open", "high", "low", "close")}).withColumn("volume", late("volume", 5.0))
    names = factors.factor_names(w)
    one = factors.factor_table(dense, market, w).where(F.col("date") < F.lit(cut)).select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"])
    two = factors.factor_table(bad, panel.market_returns(bad), w).where(F.col("date") < F.lit(cut)).select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"])
    pd.testing.assert_frame_equal(one[names].reset_index(drop=True), two[names].reset_index(drop=True), atol=1e-9)


def test_labels(dense, wide):
    out = dense.withColumn("f", labels.forward_return(5))
    pd.testing.assert_frame_equal(collected(out, "f"), wide.shift(-6) / wide.shift(-1) - 1, check_names=False)
    with pytest.raises(ValueError):
        labels.forward_return(0)


@pytest.mark.parametrize("horizon", [1, 5, 21])
def test_folds_are_purged(horizon):
    folds = splits.walk_forward(600, 3, 60, 200, horizon)
    assert [f["test_hi"] for f in folds] == [479, 539, 599]
    assert all(f["test_lo"] - f["train_hi"] >= horizon + 1 and f["train_lo"] >= 0 for f in folds)
    with pytest.raises(ValueError):
        splits.walk_forward(100, 3, 60, 200, horizon)


def test_ridge_and_elastic_net(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"]))
    got = models.Ridge(["a", "b", "c"], 10.0).fit(df, "y")
    centred = x - x.mean(axis=0)
    np.testing.assert_allclose([got.coef[k] for k in "abc"], np.linalg.solve(centred.T @ centred + 10 * np.eye(3), centred.T @ (y - y.mean())), rtol=1e-8)
    net = models.ElasticNet(["a", "b", "c"], 0.01).fit(df, "y")
    assert abs(net.coef["a"] - 1) < 0.1 and abs(net.coef["b"] + 2) < 0.1 and abs(net.coef["c"]) < 0.02
    assert models.build("ridge", ["a"]).features == ["a"]
    with pytest.raises(ValueError):
        models.build("oracle", ["a"])


def test_weights(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"date": "d", "ticker": [f"N{i}" for i in range(84)], "sector": [f"S{i % 7}" for i in range(84)], "s": rng.uniform(-3, 3, 84), "beta": rng.gamma(4, 0.25, 84)}))
    out = portfolio.rank_long_short(df, "s", 12, 12).toPandas()
    assert abs(out.weight.sum()) < 1e-12 and abs(out.weight.abs().sum() - 1) < 1e-12
    assert set(out[out.weight > 0].ticker) == set(out.nlargest(12, "s").ticker)
    hedged = portfolio.dollar_beta_neutral(portfolio.rank_long_short(df, "s", 12, 12), "beta").toPandas()
    assert abs((hedged.weight * hedged.beta).sum()) < 1e-10 and abs(hedged.weight.sum()) < 1e-10
    joint = portfolio.joint_neutral(portfolio.rank_long_short(df, "s", 12, 12), "beta").toPandas()
    assert abs((joint.weight * joint.beta).sum()) < 1e-10 and joint.groupby("sector").weight.sum().abs().max() < 1e-10
    assert portfolio.rank_long_short(df.limit(3), "s", 12, 12).agg(F.sum(F.abs("weight"))).first()[0] == 0
    history = spark.createDataFrame([("d", f"N{i}", rng.normal(size=80).tolist()) for i in range(84)], "date string, ticker string, returns array<double>")
    solved = portfolio.mean_variance_by_date(df, history, "s").toPandas()
    assert len(solved) == 84 and abs(solved.weight.sum()) < 1e-9 and abs(solved.weight.abs().sum() - 1) < 1e-9
    cov = portfolio.shrunk_covariance(rng.normal(size=(50, 20)))
    assert np.linalg.eigvalsh(cov).min() > 0


def test_backtest_book(spark):
    rng = np.random.default_rng(2)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(60)]
    names = [f"T{i}" for i in range(12)]
    rets = pd.DataFrame([(d, t, rng.normal(0.002 * i, 0.01)) for d in days for i, t in enumerate(names)], columns=["date", "ticker", "ret"])
    score = spark.createDataFrame(pd.DataFrame([(d, t, float(i)) for d in days for i, t in enumerate(names)], columns=["date", "ticker", "p"]))
    dates = backtest.rebalance_dates(score, 10)
    targets = portfolio.rank_long_short(score.join(dates, "date", "left_semi"), "p", 3, 3).select(F.lit("m").alias("model"), "date", "ticker", "weight")
    out = backtest.book(targets, spark.createDataFrame(rets), backtest.Rules(10)).toPandas().sort_values("date")
    wide = rets.pivot(index="date", columns="ticker", values="ret")
    want = wide[["T9", "T10", "T11"]].sum(axis=1) / 6 - wide[["T0", "T1", "T2"]].sum(axis=1) / 6
    np.testing.assert_allclose(out.gross, want.iloc[1:], atol=1e-12)
    assert (out.net <= out.gross).all() and abs(out.turnover.sum() - 1) < 1e-12
    capped = backtest.book(targets, spark.createDataFrame(rets), backtest.Rules(10, turnover_cap=0.05)).toPandas()
    assert capped.turnover.max() <= 0.5 + 1e-12


def test_evaluation(spark):
    rng = np.random.default_rng(4)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(120)]
    rows = pd.DataFrame([(d, f"T{k}", rng.normal()) for d in days for k in range(20)], columns=["date", "ticker", "p"])
    rows["t"] = rows.p
    df = spark.createDataFrame(rows)
    assert evaluation.daily_ic(df, "p", "t").agg(F.min("ic")).first()[0] > 1 - 1e-9
    shuffled = evaluation.randomisation(df, "p", "t", 5).toPandas()
    assert len(shuffled) == 5 and shuffled.mean_ic.abs().max() < 0.1
    r = pd.DataFrame({"date": days, "net": rng.standard_t(5, 120) / 150 + 0.001, "turnover": 0.1})
    s = spark.createDataFrame(r)
    stats = evaluation.performance(s).first()
    assert abs(stats["sharpe"] - r.net.mean() / r.net.std() * math.sqrt(252)) < 1e-9
    curve = (1 + r.net).cumprod()
    assert abs(evaluation.equity(s).agg(F.min("drawdown")).first()[0] - (curve / curve.cummax() - 1).min()) < 1e-9
    x = r.net - r.net.mean()
    var = (x @ x + sum(2 * (1 - k / 4) * (x[k:].to_numpy() @ x[:-k].to_numpy()) for k in (1, 2, 3))) / 120
    assert abs(evaluation.newey_west(s, "net", 3).first()["t"] - r.net.mean() / math.sqrt(var / 120)) < 1e-9
    assert evaluation.deflated_sharpe(s, "net", 100, 0.01)["dsr"] < evaluation.deflated_sharpe(s, "net", 2, 0.01)["dsr"]
    boot = evaluation.bootstrap_sharpe(s, n_boot=50).toPandas()
    assert len(boot) == 50 and boot.sharpe.min() < stats["sharpe"] < boot.sharpe.max()
    long = [days[0] + datetime.timedelta(days=i) for i in range(173)]
    noise = pd.concat([pd.DataFrame({"model": f"m{k}", "date": long, "net": rng.standard_t(6, 173) / 90}) for k in range(4)])
    pbo = evaluation.overfit_probability(spark.createDataFrame(noise)).first()
    wide = noise.pivot(index="date", columns="model", values="net")
    parts, over = np.array_split(np.arange(173), 8), []
    for inside in itertools.combinations(range(8), 4):
        sharpe = [wide.iloc[np.concatenate([parts[b] for b in range(8) if (b in inside) == own])].apply(lambda x: x.mean() / x.std()) for own in (True, False)]
        over.append(sharpe[1].rank(pct=True)[sharpe[0].idxmax()] <= 0.5)
    assert pbo["n_splits"] == 70 and abs(pbo["pbo"] - np.mean(over)) < 1e-12
    assert evaluation.overfit_probability(spark.createDataFrame(noise[noise.date < long[150]])).first()["pbo"] is None


def test_sources(spark, tmp_path):
    panel_, market = simulate(spark, 5, "2019-01-01", "2019-06-30")
    assert panel_.where("high < greatest(open, close) or low > least(open, close) or volume <= 0").count() == 0 and market.count() > 100
    (tmp_path / "u.txt").write_text("# comment\n brk.b \n\nAAPL # x\n")
    assert {r[0] for r in panel.universe_file(spark, str(tmp_path / "u.txt")).collect()} == {"BRK-B", "AAPL"}
    (tmp_path / "f.csv").write_text("preamble\n\n20200102, 1.5, -0.5\n20200103, 0.0, 2.0\nAnnual\n2020, 1, 2\n")
    assert [tuple(r)[1:] for r in panel.factor_file(spark, str(tmp_path / "f.csv"), ["a", "b"]).collect()] == [(0.015, -0.005), (0.0, 0.02)]
    current = spark.createDataFrame([("A",), ("B",)], "ticker string")
    changes = spark.createDataFrame([("2020-03-10", "B", "C")], "date string, added string, removed string")
    snaps = spark.createDataFrame([("2020-02-01",), ("2020-04-01",)], "date string")
    assert {tuple(r) for r in panel.membership(current, changes, snaps).collect()} == {("2020-02-01", "A"), ("2020-02-01", "C"), ("2020-04-01", "A"), ("2020-04-01", "B")}
    kept, counts = quality.quality_filter(panel_, quality.QualityRules(min_history=50, max_assets=3))
    assert kept.select("ticker").distinct().count() == 3 and {r[0] for r in counts.collect()} <= {"kept", "rank", "history", "jumps", "price"}
    obs = spark.createDataFrame([("r", "A", {"x": 1.0}), ("r", "B", {"y": 2.0})], "request string, ticker string, features map<string,double>")
    assert [(r["ticker"], r["rank"], r["missing"]) for r in serving.batch_score(obs, {"x": 2.0}).orderBy("rank").collect()] == [("A", 1, 0), ("B", 2, 1)]


def test_mean_variance_by_the_dispatcher(spark):
    rng = np.random.default_rng(12)
    names, paths = [f"m{i}" for i in range(9)], rng.normal(0, 0.02, (9, 50))
    scores = rng.normal(0, 1, 9)
    rows = spark.createDataFrame([(d, n, float(s) if n != "m8" else None) for d in (1, 2) for n, s in zip(names, scores)], "date int, ticker string, score double")
    history = spark.createDataFrame([(d, n, p.tolist()) for d in (1, 2) for n, p in zip(names, paths)], "date int, ticker string, returns array<double>")
    got = {(r["date"], r["ticker"]): r["weight"] for r in portfolio.build_weights(rows, "score", "mean_variance", history=history).collect()}
    want = portfolio.mean_variance(scores[:8], paths[:8].T)
    assert len(got) == 16 and all(abs(got[d, n] - w) < 1e-9 for d in (1, 2) for n, w in zip(names, want))
    assert abs(sum(map(abs, want)) - 1) < 1e-9 and abs(sum(want)) < 1e-9


def plain_book(targets, rets, rules, costs):
    """The book of one model, date by date, with whole weight vectors."""
    dates, names = sorted(rets["date"].unique()), sorted(rets["ticker"].unique())
    wide = rets.pivot(index="date", columns="ticker", values="ret").reindex(columns=names).fillna(0.0).to_numpy()
    marks = {d: g.set_index("ticker").reindex(names).fillna({"weight": 0.0, "beta": 1.0}) for d, g in targets.groupby("date")}
    prev, current, past, out, waiting = np.zeros(len(names)), None, [], [], []
    for i, d in enumerate(dates):
        turned = 0.0
        if waiting and waiting[0][0] == i:
            _, current, turned, scalar, beta = waiting.pop(0)
        if current is not None:
            pnl, short = wide[i] @ current, -current[current < 0].sum()
            cost = turned * (costs.cost_bps + costs.slippage_bps) / 1e4 + short * costs.borrow_bps / 1e4 / 252
            past.append(pnl)
            out.append((d, pnl, pnl - cost, cost, turned, np.abs(current).sum(), current.sum(), (current > 1e-9).sum(), (current < -1e-9).sum(), scalar, current @ beta))
        if d in marks:
            scalar_now = portfolio.volatility_scalar(np.array(past), rules.vol_target, rules.vol_lookback, rules.vol_cap) if rules.vol_target else 1.0
            move = marks[d]["weight"].to_numpy() * scalar_now - prev
            total = np.abs(move).sum()
            share = min(1.0, rules.turnover_cap * rules.horizon / total) if rules.turnover_cap and total else 1.0
            prev = prev + share * move
            waiting.append((i + rules.pnl_lag, prev, share * total, scalar_now, marks[d]["beta"].to_numpy()))
    return np.array([r[1:] for r in out], float), [r[0] for r in out]


@pytest.mark.parametrize(("rules", "binds"), [(backtest.Rules(6), False), (backtest.Rules(6, 2, 0.1, 10), False), (backtest.Rules(6, 1, 0.1, 12, 3.0, 9.0), False), (backtest.Rules(6, 1, 0.1, 12, 3.0, 0.12), True), (backtest.Rules(6, 2, None, 63, 2.0, 0.05), True)])
def test_books_equal_a_plain_one(spark, rules, binds):
    rng = np.random.default_rng(8)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(70)]
    names = [f"T{i}" for i in range(9)]
    rets = pd.DataFrame([(d, t, rng.normal(0.001, 0.02)) for d in days for t in names], columns=["date", "ticker", "ret"])
    rets.loc[rng.random(len(rets)) < 0.05, "ret"] = np.nan
    targets = pd.DataFrame([(m, d, t, w, b) for m in ("x", "y") for d in days[3::6] for t, w, b in zip(names, np.r_[rng.choice([0.2, 0.1, 0.0], 4), 0.0, rng.choice([-0.2, -0.1, 0.0], 4)], rng.normal(1, 0.3, 9), strict=True)], columns=["model", "date", "ticker", "weight", "beta"])
    if binds:
        targets["beta"] = targets.groupby("ticker")["beta"].transform("first")
    clean = lambda frame: frame.astype(object).where(frame.notna(), None)
    got = backtest.book(spark.createDataFrame(targets), spark.createDataFrame(clean(rets), "date date, ticker string, ret double"), rules).toPandas().sort_values(["model", "date"])
    for m in ("x", "y"):
        want, dates = plain_book(targets[targets["model"] == m], rets, rules, backtest.Costs())
        own = got[got["model"] == m]
        assert list(own["date"]) == dates
        columns = ["gross", "net", "cost", "turnover", "gross_exposure", "net_exposure", "n_long", "n_short", "scalar", "net_beta"]
        np.testing.assert_allclose(own[columns].to_numpy(float), want, atol=1e-12)
    if binds:
        assert got["turnover"].max() <= rules.turnover_cap * rules.horizon + 1e-9


def test_books_check_their_input(spark):
    day = datetime.date(2020, 1, 1)
    targets = spark.createDataFrame([("m", day, "A", 0.5)], "model string, date date, ticker string, weight double")
    rets = spark.createDataFrame([(day + datetime.timedelta(days=i), "A", 0.01) for i in range(3)], "date date, ticker string, ret double")
    assert [round(r["gross"], 6) for r in backtest.book(targets, rets).orderBy("date").collect()] == [0.005, 0.005]
    assert {r["net_beta"] for r in backtest.book(targets, rets).collect()} == {None}
    for bad, words in ((lambda: backtest.book(targets.union(targets), rets), "two targets"), (lambda: backtest.book(targets.drop("weight"), rets), "targets.weight"), (lambda: backtest.book(targets, rets, backtest.Rules(0)), "horizon"), (lambda: backtest.run_backtest(targets, rets, [], None), "no model")):
        with pytest.raises(ValueError, match=words):
            bad()
    assert backtest.book(targets.limit(0), rets).count() == 0
    scores = spark.createDataFrame([(day, "A", 1.0), (day, "A", 3.0), (day, "B", 2.5)], "date date, ticker string, s double")
    top = lambda due, name: due.withColumn("weight", F.when(F.col(name) > 2.2, 1.0).otherwise(0.0))
    assert [r["n_long"] for r in backtest.run_backtest(scores, rets, ["s"], top).collect()] == [1, 1]  # A's mean is 2


def test_date_stats_are_exact_and_shuffle_tails(spark, monkeypatch):
    """Against numpy: ties at the bounds, constant, missing and tiny dates, names dealt by value, many chunks; rows are not copied by column."""
    rng = np.random.default_rng(12)
    found = []
    for i, n in enumerate((1, 2, 5, 40, 700)):
        a, b = np.sort(rng.normal(size=n)), np.minimum(rng.normal(size=n), 0.3)  # b: many ties at its highest value
        found += [(datetime.date(2021, 1, 4 + i), k, float(a[k]), float(b[k]), 0.1, float(rng.integers(0, 3)) if i != 2 else None, float(k) if k % 3 else None) for k in range(n)]
    rows = spark.createDataFrame(found, "date date, k int, a double, b double, c double, d double, e double").repartitionByRange(6, "k")
    frame = pd.DataFrame(found, columns=["date", "k", "a", "b", "c", "d", "e"])
    for chunk, q in ((1 << 26, 0.01), (1, 0.05), (1 << 26, 0.3), (1 << 26, 0.0)):
        monkeypatch.setattr(xsec, "CHUNK", chunk)
        got = {r["date"]: r for r in xsec.date_stats(rows, ["a", "b", "c", "d"], q, ("e",)).collect()}
        assert got.keys() == set(frame["date"])
        for day, g in frame.groupby("date"):
            for k, c in enumerate("abcde"):
                x, r = g[c].dropna().to_numpy(float), got[day]
                assert r["n"][k] == len(x)
                if not len(x):
                    assert r["mean"][k] is None and r["deviation"][k] is None
                    continue
                if q and c != "e":
                    np.testing.assert_allclose([r["low"][k], r["high"][k]], np.quantile(x, [q, 1 - q]), rtol=1e-13, atol=1e-15)
                    x = np.clip(x, r["low"][k], r["high"][k])
                np.testing.assert_allclose(r["mean"][k], x.mean(), rtol=1e-12, atol=1e-15)
                if len(x) > 1:
                    np.testing.assert_allclose(r["deviation"][k], x.std(ddof=1), rtol=1e-11, atol=1e-15)
                    assert c != "c" or r["deviation"][k] == 0
                else:
                    assert r["deviation"][k] is None
    plan = xsec.normalise(rows, list("abcd"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
