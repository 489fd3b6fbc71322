"""Daily mark-to-market of rebalanced books.

Everything is joins and aggregates over (model, rebalance, name): profit of the unscaled targets by period, turnover, exposures.  What is
sequential, the volatility target, is a fold over a model's periods that carries one number and the last returns.  Only a model whose
turnover cap binds needs its weights carried from one rebalance to the next; such models, and no others, are groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .portfolio import volatility_scalar


@dataclass(frozen=True)
class Costs:
    cost_bps: float = 5.0
    slippage_bps: float = 2.0
    borrow_bps: float = 50.0


@dataclass(frozen=True)
class Rules:
    horizon: int = 21
    #: 1: weights decided at a close earn the next row's return; 2: from the row after.
    pnl_lag: int = 1
    vol_target: float | None = None
    vol_lookback: int = 63
    vol_cap: float = 2.0
    turnover_cap: float | None = None


def rebalance_dates(scores: DataFrame, horizon: int) -> DataFrame:
    """date and step of every horizon-th date."""
    days = scores.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return days.where(F.col("pos") % horizon == 0).select("date", (F.col("pos") / horizon).cast("int").alias("step"))


_BOOK = "model string, date date, gross double, net double, cost double, turnover double, gross_exposure double, net_exposure double, n_long long, n_short long, scalar double, net_beta double"


def book(targets: DataFrame, returns: DataFrame, rules: Rules = Rules(), costs: Costs = Costs()) -> DataFrame:
    """Daily rows of each model from its first entry: gross and net return, cost, turnover, exposures, scalar, net beta.

    ``targets`` has model, date, ticker, weight at rebalances, and may have beta (missing ones count as 1; without the column net_beta is
    missing); ``returns`` has date, ticker, ret (missing: 0) and gives the calendar.  Weights decided on a date earn from the
    ``pnl_lag``-th date after it until the next ones do; trading costs fall on the first of these dates, borrowing costs on every one.  A
    rebalance that no date follows is not traded.
    """
    if rules.horizon < 1 or rules.pnl_lag < 1:
        raise ValueError("horizon and pnl_lag must be at least 1")
    lacking = [f"targets.{c}" for c in ("model", "date", "ticker", "weight") if c not in targets.columns] + [f"returns.{c}" for c in ("date", "ticker", "ret") if c not in returns.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    beta = F.coalesce(F.col("beta"), F.lit(1.0)) if "beta" in targets.columns else F.lit(None)
    targets = cut(targets.select("model", "date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"), beta.cast("double").alias("beta")))
    if not targets.groupBy("model", "date", "ticker").count().where("count > 1").isEmpty():
        raise ValueError("a model has two targets for one date and ticker")
    days = cut(returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1))
    steps = targets.select("model", "date").distinct().join(F.broadcast(days), "date")  # calendars have a row a date
    steps = cut(steps.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy("pos"))))
    held = cut(targets.where("weight <> 0").join(steps, ["model", "date"]).select("model", "k", "ticker", "weight", "beta"))
    active = cut(_active(steps, days, rules.pnl_lag))
    unit = active.join(held, ["model", "k"]).join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left")
    unit = unit.groupBy("model", "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("unit"))
    path = cut(active.join(unit, ["model", "date"], "left").withColumn("unit", F.coalesce("unit", F.lit(0.0))))
    scalars = cut(_scalars(path, steps, rules))
    moves = held.join(scalars, ["model", "k"]).select("model", "k", "ticker", (F.col("weight") * F.col("scalar")).alias("w"))
    moves = moves.union(moves.select("model", F.col("k") + 1, "ticker", -F.col("w"))).groupBy("model", "k", "ticker").agg(F.sum("w").alias("w"))
    turned = moves.groupBy("model", "k").agg(F.sum(F.abs("w")).alias("turnover"))
    book_ = cut(_priced(path, held, scalars, turned, costs))
    if rules.turnover_cap is None:
        return book_
    bound = turned.join(steps.select("model", "k"), ["model", "k"], "left_semi").where(F.col("turnover") > rules.turnover_cap * rules.horizon).select("model").distinct()
    bound = cut(bound)
    if bound.isEmpty():
        return book_
    return book_.join(bound, "model", "left_anti").unionByName(_carried(held.join(bound, "model", "left_semi"), steps, days, returns, rules, costs))


def _active(steps: DataFrame, days: DataFrame, lag: int) -> DataFrame:
    """model, date, pos, k and first: the rebalance whose weights a model holds on each date from its first entry, and whether they enter on it."""
    grid = steps.select("model").distinct().crossJoin(F.broadcast(days))
    entries = steps.select("model", (F.col("pos") + lag).alias("pos"), F.col("k").alias("_entry"))
    rows = grid.join(entries, ["model", "pos"], "left")
    k = F.last("_entry", True).over(Window.partitionBy("model").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("k", k).where("k is not null").select("model", "date", "pos", "k", F.col("_entry").isNotNull().alias("first"))


def _scalars(path: DataFrame, steps: DataFrame, rules: Rules) -> DataFrame:
    """model, k and scalar: by a fold over a model's periods, each a short array of unit returns, if there is a volatility target."""
    if not rules.vol_target:
        return path.select("model", "k").distinct().withColumn("scalar", F.lit(1.0))
    # A period's returns up to the next decision count for it, later ones (with a lag above 1) for the one after.
    ahead = steps.select("model", "k", F.lead("pos").over(Window.partitionBy("model").orderBy("pos")).alias("next"))
    known = F.coalesce(F.col("pos") <= F.col("next"), F.lit(True))
    part = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "unit")))), lambda x: x["unit"])
    periods = path.join(ahead, ["model", "k"]).groupBy("model", "k").agg(part(known).alias("early"), part(~known).alias("late"))
    periods = periods.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("k", "early", "late"))).alias("periods"))
    n, years = rules.vol_lookback, float(np.sqrt(252))

    def scalar(past):
        mean = F.aggregate(past, F.lit(0.0), lambda a, v: a + v) / F.size(past)
        var = F.aggregate(past, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (F.size(past) - 1)
        free = F.greatest(F.least(F.try_divide(F.lit(rules.vol_target), F.sqrt(var) * years), F.lit(float(rules.vol_cap))), F.lit(1 / rules.vol_cap))
        return F.when((F.size(past) < max(n // 2, 2)) | (var == 0), 1.0).otherwise(free)

    def step(state, period):
        s = scalar(state["past"])
        scaled = lambda part: F.transform(period[part], lambda v: v * s)
        past = F.concat(state["past"], state["late"], scaled("early"))
        past = F.when(F.size(past) > n, F.slice(past, -n, n)).otherwise(past)
        return F.struct(past.alias("past"), scaled("late").alias("late"), F.concat(state["out"], F.array(F.struct(period["k"].alias("k"), s.alias("scalar")))).alias("out"))

    none = F.array().cast("array<double>")
    start = F.struct(none.alias("past"), none.alias("late"), F.array().cast("array<struct<k:int,scalar:double>>").alias("out"))
    folded = periods.select("model", F.aggregate("periods", start, step).getField("out").alias("out"))
    return folded.select("model", F.explode("out").alias("x")).select("model", "x.k", "x.scalar")


def _priced(path: DataFrame, held: DataFrame, scalars: DataFrame, turned: DataFrame, costs: Costs) -> DataFrame:
    weight = F.col("weight") * F.col("scalar")
    sides = held.join(scalars, ["model", "k"]).groupBy("model", "k").agg(
        F.sum(F.abs(weight)).alias("gross_exposure"), F.sum(weight).alias("net_exposure"), F.count_if(weight > 1e-9).alias("n_long"), F.count_if(weight < -1e-9).alias("n_short"),
        F.sum(F.when(weight < 0, -weight).otherwise(0.0)).alias("short"), F.sum(weight * F.col("beta")).alias("net_beta"),
    )
    rows = path.join(scalars, ["model", "k"]).join(sides, ["model", "k"], "left").join(turned, ["model", "k"], "left")
    zero = F.lit(0.0)
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("gross_exposure", "net_exposure", "short")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_long", "n_short")} | {"turnover": F.when(F.col("first"), F.coalesce("turnover", zero)).otherwise(0.0)})
    cost = F.col("turnover") * ((costs.cost_bps + costs.slippage_bps) / 1e4) + F.col("short") * (costs.borrow_bps / 1e4 / 252)
    gross = F.col("unit") * F.col("scalar")
    return rows.select("model", "date", gross.alias("gross"), (gross - cost).alias("net"), cost.alias("cost"), "turnover", "gross_exposure", "net_exposure", "n_long", "n_short", "scalar", "net_beta")


def _carried(held: DataFrame, steps: DataFrame, days: DataFrame, returns: DataFrame, rules: Rules, costs: Costs) -> DataFrame:
    """The book of models whose turnover cap binds: a group has a model's nonzero targets and, by date, the returns of the names that it ever holds."""
    names = held.select("model", "ticker").distinct()
    rets = returns.select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret")).join(names, "ticker")
    rets = rets.groupBy("model", "date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "ret"))).alias("rets"))
    marks = held.groupBy("model", "k").agg(F.map_from_entries(F.collect_list(F.struct("ticker", F.struct("weight", "beta")))).alias("weights"))
    mine = steps.join(held.select("model").distinct(), "model", "left_semi").join(marks, ["model", "k"], "left").select("model", "date", F.coalesce("weights", F.create_map().cast("map<string,struct<weight:double,beta:double>>") if dict(held.dtypes)["ticker"] == "string" else F.col("weights")).alias("weights"), F.lit(True).alias("due"))
    rows = mine.select("model").distinct().crossJoin(F.broadcast(days)).join(rets, ["model", "date"], "left").join(mine, ["model", "date"], "left").select("model", "date", "rets", "weights", "due")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        prev: dict = {}
        betas: dict = {}
        waiting: list[tuple] = []
        current = None
        past: list[float] = []
        out = []
        for i, (date, rets, weights, due) in enumerate(g.sort_values("date", kind="stable")[["date", "rets", "weights", "due"]].itertuples(index=False)):
            turned = 0.0
            if waiting and waiting[0][0] == i:
                _, current, turned, scalar, beta = waiting.pop(0)
            if current is not None:
                rets = dict(rets) if rets is not None else {}
                pnl = sum(w * rets.get(t, 0.0) for t, w in current.items())
                short = -sum(w for w in current.values() if w < 0)
                cost = turned * (costs.cost_bps + costs.slippage_bps) / 1e4 + short * costs.borrow_bps / 1e4 / 252
                past.append(pnl)
                out.append((date, pnl, pnl - cost, cost, turned, sum(map(abs, current.values())), sum(current.values()), sum(w > 1e-9 for w in current.values()), sum(w < -1e-9 for w in current.values()), scalar, beta))
            if due is True:
                cells = dict(weights) if weights is not None else {}
                target = {t: v["weight"] for t, v in cells.items()}
                betas |= {t: v["beta"] for t, v in cells.items()}
                scale = volatility_scalar(np.array(past), rules.vol_target, rules.vol_lookback, rules.vol_cap) if rules.vol_target else 1.0
                keys = target.keys() | prev.keys()
                move = {t: target.get(t, 0.0) * scale - prev.get(t, 0.0) for t in keys}
                total = sum(map(abs, move.values()))
                share = min(1.0, rules.turnover_cap * rules.horizon / total) if total else 1.0
                prev = {t: w for t in keys if (w := prev.get(t, 0.0) + share * move[t])}
                known = [betas[t] for t in prev]
                beta_now = None if any(b is None for b in known) else float(sum(w * betas[t] for t, w in prev.items()))
                waiting.append((i + rules.pnl_lag, prev, share * total, scale, beta_now))
        frame = pd.DataFrame(out, columns=["date", "gross", "net", "cost", "turnover", "gross_exposure", "net_exposure", "n_long", "n_short", "scalar", "net_beta"])
        return frame.assign(model=g["model"].iloc[0])[["model", *frame.columns]]

    return rows.groupBy("model").applyInPandas(run, _BOOK)


def run_backtest(scores: DataFrame, returns: DataFrame, models: list[str], weigh: Callable[[DataFrame, str], DataFrame], rules: Rules = Rules(), costs: Costs = Costs()) -> DataFrame:
    """Books of several models from their scores (date, ticker and a column a model): duplicate scores are averaged, every ``horizon``-th date with scores is a rebalance, ``weigh`` makes its weights."""
    out = None
    for name in models:
        own = [c for c in scores.columns if c not in models]
        mean = scores.select(*own, name).where(F.col(name).isNotNull()).groupBy("date", "ticker").agg(F.avg(name).alias(name), *[F.max(c).alias(c) for c in own if c not in ("date", "ticker")])
        due = mean.join(F.broadcast(rebalance_dates(mean, rules.horizon).select("date")), "date", "left_semi")
        one = weigh(due, name)
        one = one.select(F.lit(name).alias("model"), "date", "ticker", "weight", *[c for c in ("beta",) if c in one.columns])
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no model")
    return book(out, returns, rules, costs)


def mean_scores(scores: DataFrame, score: str) -> DataFrame:
    """One row a name and date: the mean of duplicate scores, without missing ones."""
    return scores.where(F.col(score).isNotNull()).groupBy("date", "ticker").agg(F.avg(score).alias(score))


def aligned_benchmark(returns: DataFrame, benchmark: DataFrame, b: str = "mkt_return") -> DataFrame:
    """The benchmark on the dates of the book, 0 where it has none."""
    return returns.select("date").join(benchmark.select("date", b), "date", "left").select("date", F.coalesce(b, F.lit(0.0)).alias(b))


def simple_pnl(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """date, gross: sum of weight times return on the same (date, ticker)."""
    return weights.join(returns, ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))


def held_pnl(held: DataFrame, dates: DataFrame) -> DataFrame:
    """date and gross of ``simple_pnl``, from the held names alone, which carry their return (ret), and the dates of the book."""
    found = held.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    return dates.join(found, "date", "left").select("date", F.coalesce("gross", F.lit(0.0)).alias("gross"))


def turnover(weights: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """date and sum of absolute changes of weight from one rebalance to the next; ``dates`` are the rebalances, else those of the weights."""
    dates = (weights if dates is None else dates).select("date").distinct().withColumn("step", F.row_number().over(Window.orderBy("date")))
    rows = weights.where("weight <> 0").join(F.broadcast(dates), "date").select("step", "ticker", "weight")
    moves = rows.union(rows.select(F.col("step") + 1, "ticker", -F.col("weight"))).groupBy("step", "ticker").agg(F.sum("weight").alias("change"))
    return moves.groupBy("step").agg(F.sum(F.abs("change")).alias("turnover")).join(dates, "step").select("date", "turnover")
