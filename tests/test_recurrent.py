"""Recurrent rankers: gradients against finite differences, sums over tasks, restarts, and learning what only a sequence tells."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import models, recurrent


@pytest.mark.parametrize("kind", ["gru", "lstm"])
def test_gradient(kind):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5, 4, 3)), rng.normal(size=5) * 2
    shape = recurrent.shapes(kind, 3, 6)
    flat = recurrent.started(kind, 3, 6, 1)
    loss = lambda v: (lambda e: np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5).sum())(recurrent.forward(kind, recurrent.split(v, shape), x)[0] - y)
    p = recurrent.split(flat, shape)
    out, state = recurrent.forward(kind, p, x)
    got = recurrent.backward(kind, p, x, state, np.clip(out - y, -1, 1))
    for k in range(0, len(flat), 7):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert math.isclose(got[k], (loss(flat + step) - loss(flat - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-7), k
    short = recurrent.backward(kind, p, x, state, np.clip(out - y, -1, 1), 1)
    assert not np.allclose(short, got) and np.allclose(short[-20:], got[-20:])


def panel(n_days=150, n_names=30):
    """The target is the sum of the feature of this and the two rows before; one name has gaps."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(n_days, n_names))
    y = a.copy()
    y[1:] += a[:-1]
    y[2:] += a[:-2]
    days = [datetime.date(2021, 1, 4) + datetime.timedelta(days=i) for i in range(n_days)]
    frame = pd.DataFrame([(d, f"T{k:02d}", a[i, k], y[i, k]) for i, d in enumerate(days) for k in range(n_names)], columns=["date", "ticker", "a", "y"])
    return frame[~((frame["ticker"] == "T03") & (frame["date"].isin(days[40:60])))]


def test_fit_predict_and_restart(spark, tmp_path):
    frame = panel()
    rows = spark.createDataFrame(frame).repartition(4).cache()
    build = lambda **more: models.build("gru", ["a"], length=3, hidden=6, batch=1000, rate=0.05, patience=9, **more)
    whole = build(epochs=4, folder=str(tmp_path / "one")).fit(rows, "y")
    assert whole.losses[-1] < 0.5 * frame["y"].var() / whole.scale**2 and min(whole.losses) == whole.losses[int(np.argmin(whole.losses))]
    again = build(epochs=4, folder=str(tmp_path / "one"))
    again.fit(rows, "y")  # all epochs are there: nothing is trained
    assert np.array_equal(again.weights, whole.weights) and again.losses == whole.losses
    import shutil

    shutil.rmtree(tmp_path / "one" / "epoch-0004")
    shutil.rmtree(tmp_path / "one" / "epoch-0003")
    resumed = build(epochs=4, folder=str(tmp_path / "one")).fit(rows, "y")
    assert np.allclose(resumed.weights, whole.weights, atol=1e-9) and np.allclose(resumed.losses, whole.losses)
    got = whole.predict(rows, "p").toPandas().sort_values(["date", "ticker"])
    assert len(got) == len(frame) and np.corrcoef(got["p"], got["y"])[0, 1] > 0.8
    wide = frame.pivot(index="date", columns="ticker", values="a").fillna(0.0)
    shape = recurrent.shapes("gru", 1, 6)
    for i in (0, 1, 60, 100):
        day = wide.index[i]
        own = got[got["date"] == day].set_index("ticker")
        x = np.array([[[wide[t].iloc[max(0, i - 2 + k)]] for k in range(3)] for t in own.index])
        np.testing.assert_allclose(own["p"], recurrent.forward("gru", recurrent.split(whole.weights, shape), x)[0] * whole.scale, rtol=1e-9)
    late = rows.where(rows["date"] >= frame["date"].max())
    attached = build(panel=rows)
    attached.weights, attached.scale = whole.weights, whole.scale
    np.testing.assert_allclose(attached.predict(late, "p").orderBy("ticker").toPandas()["p"], got[got["date"] == frame["date"].max()]["p"])


def test_gradients_of_tasks_add_up(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 4, 2)), rng.normal(size=60)
    data = spark.createDataFrame([(bytearray(np.asarray(v, "<f8").tobytes()), float(w)) for v, w in zip(x, y, strict=True)], "x binary, y double").repartition(5)
    model = recurrent.Recurrent(["a", "b"], kind="lstm", length=4, hidden=3)
    flat = recurrent.started("lstm", 2, 3, 0)
    got, loss, n = model._gradient(data, flat)
    p = recurrent.split(flat, recurrent.shapes("lstm", 2, 3))
    out, state = recurrent.forward("lstm", p, x)
    np.testing.assert_allclose(got, recurrent.backward("lstm", p, x, state, np.clip(out - y, -1, 1)), rtol=1e-9)
    assert n == 60 and math.isclose(model._gradient(data, flat, True)[1], ((out - y) ** 2).sum(), rel_tol=1e-9) and loss > 0
    assert [round(recurrent.cycle(s, 10), 3) for s in (0, 2, 9)] == [0.04, 1.0, 0.0]


def test_jobs_grow_with_bytes_not_with_steps(spark, monkeypatch):
    """400 steps of small batches: a group of steps is one job, and the weights are those of a job a step."""
    rows = spark.createDataFrame(panel(60)).repartition(4).cache()
    build = lambda: models.build("gru", ["a"], length=3, hidden=6, batch=8, epochs=2, rate=0.05, patience=9)
    spark.sparkContext.setJobGroup("chained", "")
    whole = build().fit(rows, "y")
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chained")) < 60
    small = lambda: models.build("gru", ["a"], length=3, hidden=6, batch=200, epochs=2, rate=0.05, patience=9)
    alone = small().fit(rows, "y")
    monkeypatch.setattr(recurrent, "ALONE", 0)
    monkeypatch.setattr(recurrent, "GROUP", 10000)
    summed = small().fit(rows, "y")
    assert np.allclose(alone.weights, summed.weights, atol=1e-9) and len(whole.weights) == len(alone.weights)


def test_sequences_take_one_shuffle_by_name(spark):
    """Rows and their source meet in one shuffle by name: no grid of all cells, no join of sequences back to the rows; days before those reached back to stay out."""
    frame = panel(60)
    rows = spark.createDataFrame(frame).repartition(4).cache()
    days = sorted(frame["date"].unique())
    wide = frame.pivot(index="date", columns="ticker", values="a").fillna(0.0)
    model = models.build("gru", ["a"], length=4, panel=rows)
    for first in (0, 50):
        got = model.with_sequences(rows.where(rows["date"] >= days[first]).select("y", "date", "ticker"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Window" not in plan
        assert got.columns == ["y", "date", "ticker", "x"]
        found = got.toPandas()
        assert len(found) == (frame["date"] >= days[first]).sum()
        for r in found.itertuples():
            at = days.index(r.date)
            assert np.array_equal(np.frombuffer(r.x), [wide[r.ticker].iloc[max(0, at - 3 + k)] for k in range(4)])


def test_names_run_on_over_batches(spark):
    """A name's rows may come in many Arrow batches."""
    rows = spark.createDataFrame(panel(60, 4)).cache()
    model = models.build("gru", ["a"], length=3, panel=rows)
    take = lambda: {(r["date"], r["ticker"]): bytes(r["x"]) for r in model.with_sequences(rows.select("date", "ticker")).collect()}
    whole, before = take(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert take() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
