"""Frames by array kernels against pandas: batches that end within a frame, gaps, constant stretches, names shorter than a frame."""

import datetime
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions import sliding
from quantloom.functions.windows import by_ticker, exponential_means
from quantloom.operators import backtest, evaluation, factors, portfolio
from quantloom.plans import catalog
from quantloom.session import cut
from quantloom.sources import panel


def test_moments_and_market_over_batches(spark):
    rng, w = np.random.default_rng(4), factors.WEEKLY
    frame = pd.DataFrame([(t, datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * i)) for t, n in (("a", 90), ("b", 11), ("c", 70)) for i in range(n)], columns=["ticker", "date"])
    market = pd.Series(rng.normal(size=90), index=sorted(frame["date"].unique()))
    frame["mkt_lr"] = frame["date"].map(market)
    frame["lr"] = 0.7 * frame["mkt_lr"] + rng.normal(size=len(frame))
    frame.loc[rng.random(len(frame)) < 0.2, "lr"] = np.nan
    frame.loc[(frame["ticker"] == "c") & (frame["date"] >= frame["date"].unique()[30]), "lr"] = 0.125
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "ticker string, date date, mkt_lr double, lr double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = factors.market_relative(factors.higher_moments(rows, w), w)
        assert "skewness" not in made._jdf.queryExecution().toString()  # no sliding frame of aggregates
        got = made.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(frame)
    for _, own in frame.groupby("ticker"):
        out, x, m = got.loc[own.index], own["lr"], own["mkt_lr"]
        roll = lambda v, least: v.rolling(w.long, min_periods=least)
        skew, kurt = roll(x, w.least).skew(), roll(x, w.least).kurt()
        constant = roll(x, 1).max() == roll(x, 1).min()
        np.testing.assert_allclose(out["ret_skew"], skew.mask(constant), rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(out["ret_kurt"], kurt.mask(constant), rtol=1e-6, atol=1e-9)
        cov = roll(x, 20).cov(m)
        beta = cov / roll(m, 20).var()
        alpha = roll(x, 20).mean() - beta * roll(m, 20).mean()
        e = x - beta * m - alpha
        for name, want in (("beta_26", beta), ("alpha_26", alpha), ("idio_vol_26", roll(e, 20).std())):
            np.testing.assert_allclose(out[name], want, rtol=1e-6, atol=1e-7, err_msg=name)


def test_partitions_follow_the_bytes(spark, tmp_path):
    """What a task sorts is bounded by the panel's partitions, whatever number of shuffle partitions the session has."""
    names = spark.range(200).selectExpr("id as ticker", "'s' as sector", "date'2021-01-04' as date", "1.0 as close")
    assert panel.dense(names, 37).rdd.getNumPartitions() == 37
    spark.range(3 << 17).selectExpr("uuid() as x").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    few, many = (panel.parts(spark, str(tmp_path), size=n) for n in (8 << 20, 1 << 20))
    assert many > few >= 1
    assert catalog.QUERIES["rank_ensemble"](spark, "/root/testdata/sf0.001").count() > 0


def test_dense_has_every_cell_and_moves_rows_once(spark):
    """Leading, inner and trailing gaps, a row twice, a row without a date, a name of one row; against a cross join."""
    d = [datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * i) for i in range(8)]
    cells = [("a", 0), ("a", 3), ("a", 4), ("b", 2), ("b", 2), ("b", 7), ("c", 5), ("d", 1), ("d", 6)]
    found = [(t, d[i], "x" if n % 2 else None, float(n)) for n, (t, i) in enumerate(cells)] + [("a", None, None, 99.0)]
    rows = spark.createDataFrame(found, "ticker string, date date, sector string, close double")
    names, days = rows.groupBy("ticker").agg({"sector": "max"}).toDF("ticker", "sector"), rows.select("date").distinct()
    want = names.crossJoin(days).join(rows.drop("sector"), ["ticker", "date"], "left").select("ticker", "date", "sector", "close")
    for made in (panel.dense(rows), panel.dense(rows, 3), panel.dense(rows, dates=days)):
        assert made.columns == want.columns
        assert sorted(made.collect(), key=str) == sorted(want.collect(), key=str)
    data = "/root/testdata/sf0.001"
    plan = panel.dense(panel.bars(spark, data, 5, sectors=False), dates=panel.weeks(spark, data))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and "SortMergeJoin" not in plan


def test_held_names_equal_the_weights_that_are_not_zero(spark):
    """Dates of 1, 3, 4, 7, 19, 20 and 60 names, tied and missing scores; full rows are not shuffled for it."""
    rng = np.random.default_rng(2)
    frame = [(datetime.date(2021, 1, 4 + i), t, None if t % 11 == 10 else float(rng.integers(0, 9)), float(t)) for i, n in enumerate((1, 3, 4, 7, 19, 20, 60)) for t in range(n)]
    rows = spark.createDataFrame(frame, "date date, ticker int, score double, ret double").repartition(3)
    for n_long, n_short in ((10, 10), (1, 9), (3, 2)):
        every = portfolio.rank_long_short(rows, "score", n_long, n_short).select("date", "ticker", "weight", "ret")
        held, dates = portfolio.held_long_short(rows, "score", n_long, n_short)
        assert sorted(held.select(*every.columns).collect()) == sorted(every.where("weight <> 0").collect())
        assert sorted(dates.collect()) == sorted(every.select("date").distinct().collect())
        want = {r["date"]: r["gross"] for r in backtest.simple_pnl(every.drop("ret"), rows.drop("score")).collect()}
        got = {r["date"]: r["gross"] for r in backtest.held_pnl(held, dates).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
        moved, moves = (dict(map(tuple, x.collect())) for x in (backtest.turnover(held, dates), backtest.turnover(every)))
        assert moved.keys() == moves.keys() and np.allclose([moved[k] for k in moves], list(moves.values()))
        assert "WindowGroupLimit" in held._jdf.queryExecution().executedPlan().toString()


def test_books_of_several_scores_from_few_names(spark):
    """Three scores, one with ties and one that most names lack: the books are those of each score alone, means are over all rows, and few names reach the bounds."""
    rng = np.random.default_rng(5)
    frame = [
        (datetime.date(2021, 1, 4 + i), t, float(rng.normal()), float(rng.integers(0, 4)), float(rng.normal()) if t % 9 == 0 else None, float(t), float(rng.normal()) if t % 3 else None)
        for i, n in enumerate((1, 4, 15, 400)) for t in range(n)
    ]
    rows = spark.createDataFrame(frame, "date date, ticker int, a double, b double, c double, ret double, r double").repartition(3)
    for n_long, n_short in ((10, 10), (2, 12)):
        held, days = portfolio.held_books(rows, ["a", "b", "c"], n_long, n_short, means=("r",))
        for score in "abc":
            every = portfolio.rank_long_short(rows, score, n_long, n_short).select("date", "ticker", "weight", "ret")
            assert sorted(held.where(f"book = '{score}'").select(*every.columns).collect()) == sorted(every.where("weight <> 0").collect())
            assert sorted(days.where(f"n_{score} > 0").select("date", f"n_{score}").collect()) == sorted(every.groupBy("date").count().collect())
        want = dict(map(tuple, rows.groupBy("date").agg({"r": "avg"}).collect()))
        got = {d["date"]: d["r"] for d in days.collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    near = rows.join(portfolio.extremes(rows, ["a"], 10), "date").where("n_a = 400").selectExpr("count_if(a >= top_a)", "count_if(a <= low_a)").first()
    assert all(10 <= n <= 25 for n in near)


def test_attribution_reads_the_panel_twice(spark, monkeypatch):
    """Once for the bounds, sizes and the market, once for the names within the bounds; it was thirteen times."""
    rng = np.random.default_rng(6)
    frame = [(datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * i), t, *map(float, rng.normal(size=5))) for i in range(110) for t in range(60)]
    rows = spark.createDataFrame(frame, "date date, ticker int, mom double, rev double, vol double, ret double, r double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(catalog, "book_panel", lambda *a, **k: rows.mapInArrow(counted, rows.schema))
    found = catalog.factor_attribution(spark, "").first()
    assert found["n"] == 110 and all(math.isfinite(v) for v in found)
    assert seen.value == 2 * len(frame)


def test_filled_returns_take_one_window(spark):
    """Leading and inner gaps, a price of 0, a name of one row; against a forward fill."""
    closes = {"a": [None, 2.0, None, None, 3.0, 6.0], "b": [4.0, 0.0, None, 5.0], "c": [7.0], "d": [None, None]}
    frame = [(t, datetime.date(2021, 1, 4 + i), c) for t, v in closes.items() for i, c in enumerate(v)]
    found = panel.filled_returns(spark.createDataFrame(frame, "ticker string, date date, close double"))
    got = {(x["ticker"], x["date"]): x["r"] for x in found.collect()}
    for t, v in closes.items():
        filled = pd.Series(v, dtype=float).ffill()
        want = (filled / filled.shift().replace(0.0, np.nan) - 1).tolist()
        assert all((g is None and math.isnan(w)) or g == w for g, w in zip([got[t, datetime.date(2021, 1, 4 + i)] for i in range(len(v))], want, strict=True))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_pairs_share_one_shuffle_by_date(spark):
    """Ties, missing values, a constant column and small dates: the ICs of all pairs are those of each alone, and rows are not copied by pair and shuffled by rank."""
    rng = np.random.default_rng(8)
    gap = lambda v, share: None if rng.random() < share else float(v)
    frame = [(datetime.date(2021, 1, 4 + i), gap(rng.integers(0, 5), 0.2), gap(rng.normal(), 0.1), 2.0, gap(rng.normal(), 0.3), gap(rng.integers(0, 3), 0.0)) for i, n in enumerate((3, 5, 8, 60, 200)) for _ in range(n)]
    rows = spark.createDataFrame(frame, "date date, a double, b double, c double, y double, z double").repartition(3)
    found = evaluation.rank_ics(rows, ["a", "b", "c"], ["y", "z"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(date") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    got = {(r["target"], r["feature"], r["date"]): (r["names"], r["ic"]) for r in found.collect()}
    want = {(t, f, r["date"]): (r["names"], r["ic"]) for t in "yz" for f in "abc" for r in evaluation.daily_ic(rows, f, t).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


def test_diagnostics_move_rows_by_name_and_by_date(spark, monkeypatch):
    """Two shuffles of rows for all horizons, targets and signals, checkpoints have a row a date and pair."""
    kept = []
    monkeypatch.setattr(panel, "parts", lambda *a, **k: 5)
    monkeypatch.setattr(evaluation, "cut", lambda df: kept.append(df) or cut(df))
    monkeypatch.setattr(catalog, "cut", lambda df: kept.append(df) or cut(df))
    catalog.factor_diagnostics(spark, "/root/testdata/sf0.001")
    (ic,) = kept
    plan = ic._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert sum("(ticker" in line for line in made) == 1 and "Expand" not in plan  # the market reuses it
    assert sum("(date" in line for line in made) == len(made) - 1 <= 3  # of the calendar, of the market's sums, of the rows
    assert ic.columns == ["date", "target", "feature", "names", "ic"] and ic.count() <= 357 * 18


def test_frames_leave_rows_that_are_dealt_by_name(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(f"T{t}", datetime.date(2021, 1, 4) + datetime.timedelta(days=i), float(rng.normal())) for t in range(7) for i in range(50)], "ticker string, date date, lr double").repartition(4)
    own = rows.withColumn("before", F.lag("lr").over(by_ticker()))
    made = factors.higher_moments(own, factors.WEEKLY)
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    want = {(r["ticker"], r["date"]): r["ret_skew"] for r in factors.higher_moments(rows, factors.WEEKLY).collect()}
    got = {(r["ticker"], r["date"]): r["ret_skew"] for r in made.collect()}
    assert got == want and sum(v is not None for v in got.values()) > 200


def test_oscillators_over_batches_equal_the_windows(spark):
    """Means carried on over batches that end within a name, with gaps, against the windows of ``exponential_means``."""
    rng, w = np.random.default_rng(11), factors.WEEKLY
    frame = [(t, datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * i), None if rng.random() < 0.2 else float(np.exp(rng.normal() / 9))) for t, n in (("a", 90), ("b", 3), ("c", 70), ("d", 41)) for i in range(n)]
    rows = spark.createDataFrame(frame, "ticker string, date date, close double").repartition(2)
    change = F.col("close") - F.lag("close").over(by_ticker())
    gain, loss = (F.when(F.col("change").isNotNull(), F.greatest(F.col("change") * s, F.lit(0.0))) for s in (1, -1))
    want = exponential_means(rows.withColumn("change", change), {"up": (gain, 1 / 14, 14), "down": (loss, 1 / 14, 14), "fast": (F.col("close"), 2 / 13, 12), "slow": (F.col("close"), 2 / 27, 26)})
    want = exponential_means(want.withColumn("macd", F.col("fast") - F.col("slow")), {"line": (F.col("macd"), 2 / 10, 9)})
    want = want.select("ticker", "date", ((100 - 100 / (1 + F.col("up") / F.col("down"))) / 100 - 0.5).alias("rsi"), (F.col("macd") / F.col("close")).alias("norm"), ((F.col("macd") - F.col("line")) / F.col("close")).alias("hist"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = factors.oscillators(rows, w).select("ticker", "date", *factors.OSCILLATORS).toPandas().sort_values(["ticker", "date"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = want.toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(got.iloc[:, 2:].to_numpy(float), want.iloc[:, 2:].to_numpy(float), rtol=1e-9, atol=1e-12)
    assert got["rsi_14"].notna().sum() > 60 and got["macd_hist"].notna().sum() > 20


def test_stored_bars_stay_dealt_by_name(spark):
    """The factors are computed more than once from stored bars; no pass over them moves rows by name."""
    data = "/root/testdata/sf0.001"
    stored = cut(panel.bars(spark, data, 5).drop("open"), dealt=True)
    assert stored.rdd.getNumPartitions() == 5 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    dense = panel.dense(stored, dates=panel.weeks(spark, data))
    made = factors.factor_table(dense, cut(panel.market_returns(dense)), factors.WEEKLY)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(ticker" not in plan and "SortMergeJoin" not in plan and plan.count("MapInArrow") == 1


def test_volatilities_of_the_table_equal_the_windows(spark):
    """Gaps, a low of 0 and a stretch of equal returns, which have no deviation."""
    rng, w = np.random.default_rng(13), factors.WEEKLY
    gap = lambda v: None if rng.random() < 0.15 else float(v)
    frame = [(t, datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * i), gap(2 + rng.random()), gap(0 if i == 9 else 1 + rng.random()), 0.125 if t == "b" and i > 30 else gap(rng.normal())) for t in "ab" for i in range(80)]
    rows = spark.createDataFrame(frame, "ticker string, date date, high double, low double, lr double")
    names = [*[f"vol_{n}" for n in w.vols], "parkinson_vol", "downside_vol", "vol_ratio"]
    want = factors.volatility(rows, w, moments=False).select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"])
    made = sliding.by_frames(rows, ["high", "low", "lr"], names, max(w.long, *w.vols) - 1, factors.volatility_kernel(w))
    got = made.select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(got.iloc[:, 2:].to_numpy(float), want.iloc[:, 2:].to_numpy(float), rtol=1e-9, atol=1e-12)
