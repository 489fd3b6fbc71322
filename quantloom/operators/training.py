"""Walk-forward training: every fold's models, their out-of-sample predictions, metrics by fold and overall, importances and failures.

Cross moments are summed once, by date, and a fold's are sums of its dates' rows; linear models are solved from them and predict
all folds in one pass over the test rows.  Other models are fitted fold by fold.  A model that fails on a fold is recorded and left out there.
"""

from __future__ import annotations

import copy
import math
import time
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import evaluation, models
from .splits import fold_roles, positions


@dataclass
class Training:
    #: The test rows with fold and a pred_ column a model.
    predictions: DataFrame
    #: A row a fold and model, and a row a model.
    fold_metrics: DataFrame
    metrics: DataFrame
    importances: dict[str, dict[str, float]]
    #: Ranges of the folds, as positions and dates.
    folds: list[dict]
    #: fold, model and error of the fits that failed.
    failures: list[dict] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


def fold_moments(rows: DataFrame, features: list[str], target: str, roles: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(X'X, X'y, y'y) of every fold's training rows, with a leading column of ones: one aggregate of the rows by date, then one of the dates by fold."""
    x = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in features], F.col(target)]
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    days = rows.where(F.col(target).isNotNull()).groupBy("date").agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    sums = days.join(roles.where("role = 'train'").select("date", "fold"), "date").groupBy("fold").agg(*[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs])
    out = {}
    for r in sums.collect():  # a row a fold
        full = np.zeros((len(x), len(x)))
        for i, j in pairs:
            full[i, j] = full[j, i] = r[f"s{i}_{j}"]
        out[r["fold"]] = full[:-1, :-1], full[:-1, -1], float(full[-1, -1])
    return out


def described(rows: DataFrame, folds: list[dict]) -> list[dict]:
    """The folds with the dates of their ends."""
    ends = {f[k] for f in folds for k in ("train_lo", "train_hi", "test_lo", "test_hi")}
    dates = {r["pos"]: r["date"] for r in positions(rows).where(F.col("pos").isin(sorted(ends))).collect()}
    return [f | {k.replace("_lo", "_start").replace("_hi", "_end"): dates.get(f[k]) for k in ("train_lo", "train_hi", "test_lo", "test_hi")} for f in folds]


def metrics(predictions: DataFrame, names: list[str], target: str, fwd: str, by: tuple[str, ...] = (), horizon: int = 5, q: int = 5) -> DataFrame:
    """by, model, mean_ic, std_ic, icir, t_eff, hit_rate, n_dates, t_hac, pearson_ic, rmse, oos_r2, spread, monotonicity and n of every model's predictions.

    All models go through one plan, unpivoted.  t_hac has lags of twice the horizon (missing under 10 dates), oos_r2 is against the target's mean,
    spread and monotonicity are of forward returns by predicted quantile; missing where there is nothing to compute them from.
    """
    keys = (*by, "model")
    long = predictions.unpivot([*by, "date", "ticker", target, fwd], [f"pred_{m}" for m in names], "model", "p").withColumn("model", F.expr("substr(model, 6)")).where("p is not null")
    ic = evaluation.daily_ic(long, "p", target, (*keys, "date"))
    out = evaluation.ic_summary(ic, horizon, keys)
    live = long.where(F.col(target).isNotNull())
    e = F.col(target) - F.col("p")
    error = live.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.nullif(F.var_pop(target), F.lit(0.0))).alias("oos_r2"), F.count("*").alias("n"))
    pearson = evaluation.daily_ic(long, "p", target, (*keys, "date"), "pearson").groupBy(*keys).agg(F.avg("ic").alias("pearson_ic"))
    ladder = evaluation.quantile_ladder(long, "p", fwd, q, 2 * q, keys).withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy("mean_fwd")))
    at = lambda k: F.max(F.when(F.col("bucket") == k, F.col("mean_fwd")))
    steps = ladder.groupBy(*keys).agg((at(q) - at(1)).alias("spread"), F.corr("bucket", "rank").alias("monotonicity"))
    for one in (evaluation.hac_by(ic, "ic", keys, 2 * horizon), pearson, steps):
        error = error.join(one, list(keys), "left")
    return error.join(out, list(keys), "left")


def walk_forward(rows: DataFrame, candidates: dict[str, models.Model], folds: list[dict], target: str = "target", fwd: str = "fwd_return", horizon: int = 5, ensemble: list[str] | None = None, digits: int | None = None) -> Training:
    """Fits every candidate on every fold's training dates and predicts the fold's test dates; ``ensemble`` names members whose ranks are averaged;
    predictions are rounded to ``digits`` if given, so that ranks do not hang on the order of sums.

    ``rows`` (date, ticker, features, target, fwd) are read several times: pass a stored table.
    """
    roles = cut(fold_roles(rows, folds))
    features = sorted({c for m in candidates.values() for c in m.features})
    moments = fold_moments(rows, features, target, roles)
    place = {c: i + 1 for i, c in enumerate(features)}
    seconds: dict[str, float] = dict.fromkeys(candidates, 0.0)
    failures, importances, linear, others = [], {}, {}, {}
    for f in folds:
        for name, model in candidates.items():
            began, one = time.time(), copy.deepcopy(model)
            try:
                if hasattr(one, "fit_moments"):
                    if f["fold"] not in moments:
                        raise ValueError("no training rows")
                    at = [0, *[place[c] for c in one.features]]
                    xx, xy, yy = moments[f["fold"]]
                    one.fit_moments(xx[np.ix_(at, at)], xy[at], yy)
                else:
                    one.fit(_role(rows, roles, f["fold"], "train"), target)
                if hasattr(one, "linear"):
                    weights, intercept = one.linear()
                    if not all(map(math.isfinite, [*weights.values(), intercept])):
                        raise ValueError("coefficients that are not finite")
                    linear[f["fold"], name] = weights, intercept
                else:
                    others[f["fold"], name] = one
                importances.setdefault(name, []).append(one.importance())
            except Exception as error:  # recorded; the fold goes on without the model
                failures.append({"fold": f["fold"], "model": name, "error": f"{type(error).__name__}: {error}"})
            seconds[name] += time.time() - began
    out = _linear_predictions(rows, roles, features, folds, [m for m in candidates if any(k[1] == m for k in linear)], linear)
    if others:
        out = cut(out)
        parts = []
        for f in folds:
            part = out.where(F.col("fold") == f["fold"])
            for name in candidates:
                if (f["fold"], name) in others:
                    part = others[f["fold"], name].predict(part, f"pred_{name}")
            parts.append(part)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
    names = [m for m in candidates if f"pred_{m}" in out.columns]
    if digits is not None:
        out = out.withColumns({f"pred_{m}": F.round(f"pred_{m}", digits) for m in names})
    if ensemble and len(members := [m for m in ensemble if m in names]) >= 2:
        out, names = models.rank_average(out, [f"pred_{m}" for m in members], "pred_ensemble", ("fold", "date")), [*names, "ensemble"]
        out = out if digits is None else out.withColumn("pred_ensemble", F.round("pred_ensemble", digits))
    out = cut(out)
    tables = [metrics(out, names, target, fwd, by, horizon) for by in (("fold",), ())]
    return Training(out, *tables, {m: models.mean_importance(v) for m, v in importances.items()}, described(rows, folds), failures, seconds)


def _role(rows: DataFrame, roles: DataFrame, fold: int, role: str) -> DataFrame:
    return rows.join(F.broadcast(roles.where((F.col("fold") == fold) & (F.col("role") == role)).select("date")), "date", "left_semi")


def _linear_predictions(rows: DataFrame, roles: DataFrame, features: list[str], folds: list[dict], names: list[str], fitted: dict) -> DataFrame:
    """The test rows with their fold and linear predictions: coefficients (a row a fold) are broadcast, as are the roles (a row a date and fold)."""
    schema = T.StructType([T.StructField("fold", T.IntegerType()), *[T.StructField(f"_w{i}", T.ArrayType(T.DoubleType())) for i in range(len(names))]])
    table = []
    for f in folds:
        cells = []
        for m in names:
            found = fitted.get((f["fold"], m))
            cells.append([found[1], *[float(found[0].get(c, 0.0)) for c in features]] if found else None)
        table.append((f["fold"], *cells))
    test = rows.join(F.broadcast(roles.where("role = 'test'").select("date", "fold")), "date")
    test = test.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "fold")
    x = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in features]]
    predicted = {f"pred_{m}": F.when(F.col(f"_w{i}").isNotNull(), sum((v * F.col(f"_w{i}")[k] for k, v in enumerate(x)), F.lit(0.0))) for i, m in enumerate(names)}
    return test.withColumns(predicted).drop(*[f"_w{i}" for i in range(len(names))])
