"""A whole run: features, walk-forward training, books, statistics and significance, kept in the run store; and reports from the store."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, evaluation, factors, grid, models, portfolio, splits, training
from ..session import cut
from ..sources.runs import RunStore
from ..sources.sinks import markdown
from . import catalog

INPUTS = ("lineitem", "supplier", "nation", "region")


def _candidates(config: dict, features: list[str]) -> dict[str, models.Model]:
    out, own = {}, config["models"]
    for name in own["enabled"]:
        if name != "ensemble":
            used = [c for c in features if c in models.COMPOSITE] if name == "factor_composite" else features
            out[name] = models.build(name, used or features, **own.get(name, {}))
    return out


def _folds(config: dict, n: int) -> list[dict]:
    v = config["validation"]
    return splits.walk_forward(n, v["n_splits"], v["test_window_days"], v["train_window_days"], config["label"]["horizon"], v["expanding"], v["embargo_days"])


def run(spark: SparkSession, sf_dir: str, config: dict, store: RunStore, year: int = 52) -> str:
    """The key of the run; it is computed only if the store has none of this configuration and these tables.

    Tables: predictions, fold_metrics, metrics, importances, books, performance, significance.
    """

    def build() -> tuple[dict[str, DataFrame], dict]:
        features = factors.factor_names(catalog.W)
        rows = cut(catalog.model_table(spark, sf_dir))
        horizon = config["label"]["horizon"]
        folds = _folds(config, rows.select("date").distinct().count())
        members = [m for m in config["models"]["enabled"] if m != "ensemble"]
        found = training.walk_forward(rows, _candidates(config, features), folds, horizon=horizon, ensemble=members if "ensemble" in config["models"]["enabled"] else None)
        names = [c[5:] for c in found.predictions.columns if c.startswith("pred_")]
        scores = found.predictions.select("date", "ticker", "sector", F.col("beta_raw").alias("beta"), *[F.col(f"pred_{m}").alias(m) for m in names])
        dense = grid.fill_by_ticker(catalog.dense_bars(spark, sf_dir), ["close"])
        gaps = Window.partitionBy("ticker").orderBy("date")
        first = found.predictions.agg(F.min("date")).first()[0]
        returns = dense.select("date", "ticker", (F.try_divide("close_ffill", F.lag("close_ffill").over(gaps)) - 1).alias("ret")).where(F.col("date") >= F.lit(first))
        p, b = config["portfolio"], config["backtest"]
        weigh = lambda due, name: portfolio.rank_long_short(due, name, p["n_long"], p["n_short"], cap=p["max_weight"])
        rules = backtest.Rules(horizon, vol_target=p["vol_target"], turnover_cap=b["turnover_cap"])
        books = cut(backtest.run_backtest(scores, cut(returns), names, weigh, rules, backtest.Costs(b["cost_bps"], b["slippage_bps"], b["borrow_bps"])))
        # A book that has lost everything stays there.
        books = books.withColumn("net", F.greatest("net", F.lit(-0.9999)))
        performance = cut(evaluation.performance(books, by=("model",), year=year))
        best = evaluation.best_model(performance).first()["model"]
        own = cut(books.where(F.col("model") == best))
        e = config["evaluation"]
        chance = evaluation.deflated(own, "net", e["trials"], year=year).select(F.lit(best).alias("model"), "deflated", "threshold_annual")
        pbo = evaluation.overfit_probability(books, "net", e["pbo_splits"]).select("pbo")
        boot = evaluation.bootstrap_summary(evaluation.bootstrap_sharpe(own, "net", e["bootstrap_samples"], seed=config["run"]["seed"], year=year)).select("low", "high", "p_not_positive")
        significance = chance.crossJoin(pbo).crossJoin(boot)  # one row each
        importances = spark.createDataFrame([(m, c, float(v)) for m, cells in found.importances.items() for c, v in cells.items()], "model string, feature string, importance double")
        tables = {"predictions": found.predictions, "fold_metrics": found.fold_metrics, "metrics": found.metrics, "importances": importances, "books": books, "performance": performance, "significance": significance}
        facts = {"folds": found.folds, "failures": found.failures, "fit_seconds": found.seconds, "best": best, "models": names, "features": features}
        return tables, facts

    return store.run(config, [f"{sf_dir}/{t}.parquet" for t in INPUTS], build)


def bundle(store: RunStore, key: str) -> dict:
    """The small tables of a run as plain rows, with its manifest: what a client shows of a run."""
    rows = lambda name: [r.asDict() for r in store.table(key, name).collect()]  # noqa: E731  a row a model
    return {"run": store.manifest(key)} | {name: rows(name) for name in ("metrics", "performance", "significance")}


def report(store: RunStore, key: str, top: int = 10) -> str:
    """A markdown report of a stored run; nothing is computed but small aggregates of its tables."""
    found = bundle(store, key)
    manifest, config = found["run"], found["run"]["config"]
    facts = manifest["facts"]
    pick = lambda rows, columns: [{c: math.nan if r[c] is None else r[c] for c in columns} for r in rows]
    span = store.table(key, "predictions").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("dates"), F.countDistinct("ticker").alias("names"), F.count("*").alias("rows")).first()
    strongest = store.table(key, "importances").withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))).where(F.col("place") <= top).orderBy("model", "place")
    trading = evaluation.trading_costs(store.table(key, "books").where(F.col("model") == facts["best"]), year=52).first().asDict()
    judged = store.table(key, "significance").join(store.table(key, "performance").select("model", "sharpe"), "model").select(evaluation.verdict("deflated").alias("verdict")).first()["verdict"]
    out = [
        f"# Run {manifest['name']} ({key})", "",
        f"Out of sample {span['first']} to {span['last']}: {span['rows']} rows, {span['dates']} dates, {span['names']} names; {len(facts['features'])} features, label {config['label']['type']} over {config['label']['horizon']} rows.",
        "", "## Forecasts", "", markdown(pick(found["metrics"], ["model", "mean_ic", "icir", "t_hac", "hit_rate", "spread", "oos_r2"])),
        "", "## Books after costs", "", markdown(pick(found["performance"], ["model", "ann_return", "ann_vol", "sharpe", "sortino", "var5", "hit_rate"])),
        "", f"Best: {facts['best']}. " + ", ".join(f"{k.replace('_', ' ')} {v:.4f}" for k, v in trading.items() if v is not None) + ".",
        "", "## Significance", "", markdown(pick(found["significance"], ["model", "deflated", "threshold_annual", "pbo", "low", "high", "p_not_positive"])), "", f"Verdict: {judged}.",
        "", "## Features", "", markdown([r.asDict() for r in strongest.collect()]),
        "", "## Folds", "", markdown([{k: f[k] for k in ("fold", "train_start", "train_end", "test_start", "test_end", "n_purged")} for f in facts["folds"]]),
    ]
    if facts["failures"]:
        out += ["", "## Failed fits", "", markdown(facts["failures"])]
    return "\n".join(out) + "\n"
