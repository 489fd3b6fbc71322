"""Leaf-wise trees against a plain version of their own, attributions against Shapley's formula over all sets."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import boosting

NAMES = ["a", "b", "c", "d"]


def panel(n=2600, seed=4):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * np.where(x[:, 1] > -0.2, 1.2, 0.1) + 0.6 * (x[:, 2] > 0.9) + rnd.standard_t(3, n) * 0.4
    frame = pd.DataFrame(x, columns=NAMES)
    frame.insert(0, "date", pd.Timestamp("2020-01-06") + pd.to_timedelta(np.arange(n) // 25 * 7, "D"))
    frame.insert(1, "ticker", np.arange(n) % 25)
    frame["y"] = y
    return frame


def plain(model, x, y, hold):
    """The same boosting on arrays: splits one by one from a queue, histograms by loops over bins of single nodes."""
    ids, size = np.arange(len(y)), max(map(len, model.edges)) + 1
    bins = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(model.edges)])
    score, out, losses = np.full(len(y), y[~hold].mean()), [], []
    for r in range(model.rounds):
        losses.append(((score - y)[hold] ** 2).mean() if hold.any() else math.nan)
        if hold.any() and r - int(np.argmin(losses)) >= model.patience:
            break
        use = ~hold & boosting.kept_rows(ids, r + 1 + model.seed * 100003, model.row_share)
        g = np.clip(score - y, -model.delta, model.delta)

        def best(members):
            found = (boosting.GAIN, None)
            for f in model.chosen(r):  # noqa: B023
                for b in range(size - 1):
                    left = members & (bins[:, f] <= b)
                    n, m = left.sum(), members.sum() - left.sum()
                    if min(n, m) >= model.least:
                        gl, gr = g[left].sum(), g[members & ~left].sum()  # noqa: B023
                        gain = gl**2 / (n + model.l2) + gr**2 / (m + model.l2) - (gl + gr) ** 2 / (n + m + model.l2)
                        if gain > found[0] * (1 + 1e-12):
                            found = (gain, (f, b))
            return found

        leaves = {1: (use, *best(use))}
        while len(leaves) < model.leaves:
            open_ = {k: v for k, v in leaves.items() if v[2]}
            if not open_:
                break
            node = min(open_, key=lambda k: (-open_[k][1], k))
            members, _, (f, b) = leaves.pop(node)
            for child, side in ((2 * node, bins[:, f] <= b), (2 * node + 1, bins[:, f] > b)):
                own = members & side
                leaves[child] = (own, *(best(own) if child < 1 << model.depth else (0, None)))
            score_rule = out[-1][1] if out and out[-1][0] == r else None
            if score_rule is None:
                out.append((r, {}))
            out[-1][1][node] = (f, b)
        tree = out[-1][1]
        at = np.ones(len(y), int)
        for _ in range(model.depth):
            at = np.array([2 * k + (bins[i, tree[k][0]] > tree[k][1]) if k in tree else k for i, k in enumerate(at)])
        value = {k: -model.rate * g[m].sum() / (m.sum() + model.l2) for k, (m, _, _) in leaves.items()}
        score = score + np.array([value[k] for k in at])
    return [t for _, t in out], score, losses


@pytest.mark.parametrize(("stop_share", "leaves"), [(0.15, 6), (0.0, 4)])
def test_same_trees_as_plain(spark, stop_share, leaves):
    frame = panel()
    model = boosting.LeafTrees(NAMES, rounds=4, rate=0.3, leaves=leaves, depth=3, least=60, bins=12, stop_share=stop_share, feature_share=0.75)
    model.fit(spark.createDataFrame(frame).repartition(5), "y")
    x, y = frame[NAMES].to_numpy(), frame["y"].to_numpy()
    hold = np.arange(len(y)) >= math.floor(len(y) * 0.85) if stop_share else np.zeros(len(y), bool)
    trees, score, losses = plain(model, x, y, hold)
    assert [{k: (int(t.feature[k]), int(t.bin[k])) for k in range(len(t.feature)) if t.feature[k] >= 0} for t in model.trees] == trees[: len(model.trees)]
    assert len(model.trees) == 4 or stop_share
    assert np.allclose(model.losses[: len(losses)], losses, equal_nan=True)
    got = model.predict(spark.createDataFrame(frame), "p").orderBy("date", "ticker").toPandas()["p"].to_numpy()
    if len(model.trees) == 4:
        assert np.allclose(got, score, atol=1e-9)
    assert np.isclose(sum(model.importance().values()), 1) and model.importance()["a"] > model.importance()["d"]


def test_stops_early_and_learns(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 3)
    frame = panel()
    rnd = np.random.default_rng(1)
    late = frame["date"] > frame["date"].quantile(0.7)
    frame.loc[late, "y"] = rnd.normal(size=late.sum())
    model = boosting.LeafTrees(NAMES, rounds=30, rate=0.4, leaves=5, depth=3, least=40, bins=16, patience=3).fit(spark.createDataFrame(frame), "y")
    best = int(np.argmin(model.losses))
    assert len(model.trees) == best and len(model.losses) == best + 4 < 30
    good = boosting.LeafTrees(NAMES, rounds=8, rate=0.5, leaves=6, depth=3, least=30, bins=16).fit(spark.createDataFrame(panel()), "y")
    assert good.losses[-1] < 0.7 * good.losses[0]
    error = panel(800, 9)
    got = good.predict(spark.createDataFrame(error), "p").toPandas()
    assert ((got["p"] - got["y"]) ** 2).mean() < 0.75 * got["y"].var()


def test_odd_rows(spark):
    schema = "date date, ticker int, a double, y double"
    empty = boosting.LeafTrees(["a"], rounds=2).fit(spark.createDataFrame([], schema), "y")
    assert empty.trees == [] and empty.predict(spark.createDataFrame([], schema), "p").count() == 0
    import datetime

    few = spark.createDataFrame([(datetime.date(2020, 1, 1), k, None if k % 3 else float("nan"), None if k == 5 else 2.0) for k in range(9)], schema)
    model = boosting.LeafTrees(["a"], rounds=3, least=1).fit(few, "y")
    assert model.trees == [] and {r["p"] for r in model.predict(few, "p").collect()} == {2.0}


def shapley(tree, x, n):
    def expect(node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in known:
            return expect(2 * node + (x[f] > tree.bound[node]), known)
        return sum(tree.cover[c] / tree.cover[node] * expect(c, known) for c in (2 * node, 2 * node + 1))

    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            phi[i] += sum(w * (expect(1, {*s, i}) - expect(1, set(s))) for s in itertools.combinations(others, k))
    return phi, expect(1, set())


def test_attributions(spark):
    frame = panel()
    rows = spark.createDataFrame(frame)
    model = boosting.LeafTrees(NAMES, rounds=5, rate=0.4, leaves=12, depth=5, least=20, bins=16, feature_share=1.0, stop_share=0.0).fit(rows, "y")
    assert any(len(set(t.feature[t.feature >= 0])) < (t.feature >= 0).sum() for t in model.trees)
    got = model.attributions(rows).orderBy("date", "ticker").toPandas()
    phi = got[[f"phi_{c}" for c in NAMES]].to_numpy()
    p = model.predict(rows, "p").orderBy("date", "ticker").toPandas()["p"].to_numpy()
    assert np.abs(phi.sum(axis=1) + got["expected"] - p).max() < 1e-9
    x = frame[NAMES].to_numpy()
    for i in range(0, len(x), 400):
        parts = [shapley(t, x[i], 4) for t in model.trees]
        assert np.allclose(phi[i], sum(v for v, _ in parts), atol=1e-12) and np.isclose(got["expected"][0], model.base + sum(e for _, e in parts))
    table = boosting.attribution_summary(model.attributions(rows), NAMES).toPandas().set_index("feature")
    assert np.allclose(table["mean_abs"], np.abs(phi).mean(axis=0)) and np.allclose(table["std"], phi.std(axis=0)) and np.isclose(table["share"].sum(), 1)


@pytest.mark.parametrize("depth", [1, 4, 6, 8])
def test_leaves_by_bits_equal_the_walk(depth):
    """Over 64 leaves (depth 8) there are no bits: the tree is walked."""
    rng = np.random.default_rng(depth)
    size = 2 << depth
    feature = np.where((np.arange(size) >= 1) & (np.arange(size) < 1 << depth) & (rng.random(size) < 0.9), rng.integers(0, 5, size), -1)
    feature[1] = 2
    tree = boosting.Tree(feature, rng.integers(0, 63, size), *(np.zeros(size) for _ in range(4)))
    bins = rng.integers(0, 64, (5, 4000)).astype(np.uint8)
    assert (boosting.Leaves(tree, 256).of(bins) == tree.leaf(bins.T, tree.bin)).all()
    stump = boosting.Tree(np.full(size, -1), *(np.zeros(size) for _ in range(5)))
    assert (boosting.Leaves(stump, 256).of(bins) == 1).all()


def test_passes_read_blocks(spark, monkeypatch):
    """What the passes of a fit read has a row for a batch of rows, not one a row."""
    kept, cut = [], boosting.cut
    monkeypatch.setattr(boosting, "cut", lambda rows: kept.append(cut(rows)) or kept[-1])
    monkeypatch.setattr(boosting, "CUT", 2)
    frame = panel()
    model = boosting.LeafTrees(NAMES, rounds=4, rate=0.3, leaves=4, depth=2, least=60, bins=12).fit(spark.createDataFrame(frame).repartition(3), "y")
    blocks = [rows for rows in kept if "bins" in rows.columns]
    assert len(model.trees) == 4 and len(blocks) == 3
    for rows in blocks:
        assert rows.count() <= rows.rdd.getNumPartitions() <= 4
        assert sum(len(r["bins"]) for r in rows.collect()) == 4 * len(frame)
