"""Ranking models over a feature table: composite, Gram-matrix linear models, trees, ensembles and the walk-forward trainer."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import percent_rank
from .boosting import LeafTrees

#: The signs of the composite.
COMPOSITE = {"mom_12_1": 1.0, "ret_21": -1.0, "vol_63": -1.0, "beta_63": -1.0, "amihud_illiq": 1.0}


class Model(Protocol):
    features: list[str]

    def fit(self, rows: DataFrame, target: str) -> Model: ...

    def predict(self, rows: DataFrame, name: str) -> DataFrame: ...

    def importance(self) -> dict[str, float]: ...


def weighted(weights: dict[str, float], intercept: float = 0.0) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(float(intercept)))


@dataclass
class Composite:
    features: list[str]
    weights: dict[str, float] | None = None

    def fit(self, rows: DataFrame, target: str) -> Composite:
        return self

    def used(self) -> dict[str, float]:
        return {c: w for c, w in (self.weights or COMPOSITE).items() if c in self.features}

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, weighted(*self.linear()))

    def linear(self) -> tuple[dict[str, float], float]:
        used = self.used()
        total = sum(map(abs, used.values())) or 1.0
        return {c: w / total for c, w in used.items()}, 0.0

    def importance(self) -> dict[str, float]:
        return {c: abs(w) for c, w in self.used().items()}


def gram(rows: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, n) with a leading column of ones and y'y as the last entry of X'y: one aggregate, combined before the shuffle; its result has one row."""
    names = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in features], F.col(target)]
    rows = rows.where(F.col(target).isNotNull())
    k = len(names)
    sums = rows.agg(*[F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    full = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            full[i, j] = full[j, i] = sums[f"s{i}_{j}"] or 0.0
    return full[:-1, :-1], full[:-1, -1], full[-1, -1]


@dataclass
class Ridge:
    """L2-penalised least squares with a free intercept, solved from centred moments."""

    features: list[str]
    alpha: float = 10.0
    coef: dict[str, float] | None = None
    intercept: float = 0.0

    def fit(self, rows: DataFrame, target: str) -> Ridge:
        return self.fit_moments(*gram(rows, self.features, target))

    def fit_moments(self, xx: np.ndarray, xy: np.ndarray, yy: float) -> Ridge:
        """From cross moments with a leading column of ones."""
        n = max(xx[0, 0], 1.0)
        mean, y = xx[0, 1:] / n, xy[0] / n
        centred = xx[1:, 1:] - n * np.outer(mean, mean)
        b = np.linalg.solve(centred + self.alpha * np.eye(len(mean)), xy[1:] - n * mean * y)
        self.coef, self.intercept = dict(zip(self.features, b.tolist(), strict=True)), float(y - mean @ b)
        return self

    def linear(self) -> tuple[dict[str, float], float]:
        return self.coef, self.intercept

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, weighted(*self.linear()))

    def importance(self) -> dict[str, float]:
        return {c: abs(v) for c, v in self.coef.items()}

    def contributions(self, rows: DataFrame) -> DataFrame:
        """Exact additive attributions of a linear model: coef * (x - mean)."""
        means = rows.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in self.features]).first()
        return rows.withColumns({f"phi_{c}": self.coef[c] * (F.coalesce(F.col(c), F.lit(0.0)) - F.lit(means[c] or 0.0)) for c in self.features})


@dataclass
class ElasticNet(Ridge):
    """Coordinate descent on the Gram matrix; y is scaled by its population deviation."""

    alpha: float = 1e-3
    l1: float = 0.5
    rounds: int = 5000

    def fit_moments(self, xx: np.ndarray, xy: np.ndarray, yy: float) -> ElasticNet:
        n = max(xx[0, 0], 1.0)
        mean, y = xx[0, 1:] / n, xy[0] / n
        scale = math.sqrt(max(yy / n - y * y, 0.0)) or 1.0
        a, c = (xx[1:, 1:] - n * np.outer(mean, mean)) / n, (xy[1:] - n * mean * y) / n / scale
        b = np.zeros(len(mean))
        for _ in range(self.rounds):
            before = b.copy()
            for j in range(len(b)):
                r = c[j] - a[j] @ b + a[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - self.alpha * self.l1, 0.0) / (a[j, j] + self.alpha * (1 - self.l1) or 1.0)
            if np.abs(b - before).max() < 1e-10:
                break
        b *= scale
        self.coef, self.intercept = dict(zip(self.features, b.tolist(), strict=True)), float(y - mean @ b)
        return self


def _recurrent(features: list[str], **params) -> Model:
    from .recurrent import Recurrent

    return Recurrent(features, **params)


REGISTRY = {"gru": _recurrent, "lstm": lambda features, **params: _recurrent(features, **{"kind": "lstm"} | params), "factor_composite": Composite, "ridge": Ridge, "elasticnet": ElasticNet, "trees": LeafTrees}


def build(name: str, features: list[str], **params) -> Model:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](features, **params)


def rank_average(rows: DataFrame, members: list[str], name: str = "pred_ensemble", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Mean of the members' per-date percentile ranks; at least two members."""
    if len(members) < 2:
        raise ValueError("an ensemble needs two members")
    rows = rows.withColumns({f"_r_{m}": percent_rank(m, list(keys)) for m in members})
    return rows.withColumn(name, sum((F.col(f"_r_{m}") for m in members), F.lit(0.0)) / len(members)).drop(*[f"_r_{m}" for m in members])


def stacked(rows: DataFrame, members: list[str], target: str, alphas=tuple(10.0 ** np.arange(-3, 3.5, 0.5))) -> Ridge:
    """A ridge over member scores; alpha by generalised cross-validation from the Gram matrix."""
    xx, xy, yy = gram(rows, members, target)
    n, best = max(xx[0, 0], 1.0), None
    mean, y = xx[0, 1:] / n, xy[0] / n
    a, c, total = xx[1:, 1:] - n * np.outer(mean, mean), xy[1:] - n * mean * y, yy - n * y * y
    values, vectors = np.linalg.eigh(a)
    for alpha in alphas:
        b = vectors @ ((vectors.T @ c) / (values + alpha))
        loss = (total - 2 * b @ c + b @ a @ b) / n / (1 - (values / (values + alpha)).sum() / n) ** 2
        if best is None or loss < best[0]:
            best = loss, alpha, b
    return Ridge(members, best[1], dict(zip(members, best[2].tolist(), strict=True)), float(y - mean @ best[2]))


def mean_importance(folds: list[dict[str, float]]) -> dict[str, float]:
    """The mean over the folds that have a feature, largest first."""
    names = {n for f in folds for n in f}
    mean = {n: float(np.mean([f[n] for f in folds if n in f])) for n in names}
    return dict(sorted(mean.items(), key=lambda x: (-x[1], x[0])))


def importance_stability(folds: list[dict[str, float]], top: int = 5) -> tuple[float, float]:
    """(mean pairwise rank correlation, mean share of common top features) over pairs of folds."""
    rho, common = [], []
    for i, a in enumerate(folds):
        for b in folds[:i]:
            names = sorted(set(a) & set(b))
            ranks = [np.argsort(np.argsort([f[n] for n in names])) for f in (a, b)]
            rho.append(float(np.corrcoef(*ranks)[0, 1]))
            tops = [set(sorted(f, key=f.get, reverse=True)[:top]) for f in (a, b)]
            common.append(len(tops[0] & tops[1]) / top)
    return (float(np.mean(rho)), float(np.mean(common))) if rho else (math.nan, math.nan)


def save_linear(model: Ridge, path: str) -> None:
    with open(path, "w") as out:
        json.dump({"features": model.features, "coef": model.coef, "intercept": model.intercept}, out)


def load_linear(path: str) -> Ridge:
    with open(path) as source:
        found = json.load(source)
    if set(found) != {"features", "coef", "intercept"}:
        raise ValueError("not a linear model of this package")
    return Ridge(found["features"], coef=found["coef"], intercept=found["intercept"])


def production_fit(rows: DataFrame, model: Model, train_days: int, target: str = "target") -> Model:
    """A fit on the last so many dates."""
    from ..sources.panel import tail_dates

    return model.fit(tail_dates(rows, train_days), target)


def sequences(dense: DataFrame, features: list[str], length: int) -> DataFrame:
    """A column ``sequence`` of the last ``length`` feature rows, padded at the start with the first."""
    from pyspark.sql import Window

    step = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in features])
    own = Window.partitionBy("ticker").orderBy("date")
    rows = dense.withColumn("_step", step)
    got = F.collect_list("_step").over(own.rowsBetween(-(length - 1), 0))
    first = F.first("_step").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_got": got, "_first": first}).withColumn("sequence", F.concat(F.array_repeat("_first", F.lit(length) - F.size("_got")), F.col("_got"))).drop("_step", "_got", "_first")
