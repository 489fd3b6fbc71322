"""Information coefficients, ladders, return statistics and significance."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import linear
from ..functions.hashing import mix32, mix32_of, permuted
from ..functions.windows import average_rank
from ..session import cut
from . import labels
from .volatility import normal_cdf

EULER = 0.5772156649015329


def _line():
    """The rows of a series of one row a date, in order; such a series is small, so one partition is enough."""
    return Window.orderBy("date")


def daily_ic(rows: DataFrame, score: str, target: str, keys: tuple[str, ...] = ("date",), method: str = "spearman", least: int = 5) -> DataFrame:
    """keys and ic: correlation of the joint values of a group, average ranks for spearman; small and constant groups are left out."""
    joint = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    if method == "spearman":
        joint = joint.withColumns({"_p": average_rank(score, list(keys)), "_t": average_rank(target, list(keys))})
    else:
        joint = joint.withColumns({"_p": F.col(score), "_t": F.col(target)})
    out = joint.groupBy(*keys).agg(F.count("*").alias("names"), F.stddev_pop("_p").alias("_sp"), F.stddev_pop("_t").alias("_st"), F.covar_pop("_p", "_t").alias("_c"))
    return out.where((F.col("names") >= least) & (F.col("_sp") > 1e-12) & (F.col("_st") > 1e-12)).select(*keys, "names", (F.col("_c") / (F.col("_sp") * F.col("_st"))).alias("ic"))


def ic_summary(ic: DataFrame, horizon: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.count("ic")
    sd = F.stddev_samp("ic")
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), (F.avg("ic") / F.nullif(sd, F.lit(0.0)) * math.sqrt(252)).alias("icir"),
        (F.avg("ic") / F.nullif(sd, F.lit(0.0)) * F.sqrt(n / horizon)).alias("t_eff"), (F.count_if(F.round("ic", 12) > 0) / n).alias("hit_rate"), n.alias("n_dates"),
    )


def quantile_ladder(rows: DataFrame, score: str, fwd: str, q: int = 5, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bucket, mean, std and count of forward returns by per-date quantile of score."""
    live = rows.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    w = Window.partitionBy(*by, "date")
    live = live.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(score, "ticker"))}).where(F.col("_n") >= least)
    bucket = F.greatest(F.ceil((F.col("_k") - 1) * q / (F.col("_n") - 1)), F.lit(1)).cast("int")
    return live.groupBy(*by, bucket.alias("bucket")).agg(F.avg(fwd).alias("mean_fwd"), F.stddev_samp(fwd).alias("std_fwd"), F.count("*").alias("n"))


def monotonicity(ladder: DataFrame) -> DataFrame:
    return ladder.agg(F.corr("bucket", "rank").alias("monotonicity")) if "rank" in ladder.columns else ladder.withColumn("rank", F.rank().over(Window.orderBy("mean_fwd"))).agg(F.corr("bucket", "rank").alias("monotonicity"))


def prediction_error(rows: DataFrame, score: str, target: str) -> DataFrame:
    e = F.col(target) - F.col(score)
    live = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return live.agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.sum(F.col(target) * F.col(target)), F.lit(0.0))).alias("oos_r2"), F.count("*").alias("n"))


def prediction_metrics(rows: DataFrame, score: str, target: str, q: int = 5) -> DataFrame:
    """One row: mean rank and linear correlation a date, error against the target, top minus bottom bucket and rank correlation of the buckets' means with their order."""
    means = [daily_ic(rows, score, target, method=m).agg(F.avg("ic").alias(name)) for m, name in (("spearman", "mean_ic"), ("pearson", "mean_pearson"))]
    ladder = quantile_ladder(rows, score, target, q)
    spread = ladder.agg((F.max(F.when(F.col("bucket") == q, F.col("mean_fwd"))) - F.max(F.when(F.col("bucket") == 1, F.col("mean_fwd")))).alias("spread"))
    out = prediction_error(rows, score, target)
    for one in (*means, spread, monotonicity(ladder)):
        out = out.crossJoin(one)  # one row each
    return out


def by_model(rows: DataFrame, key: str, value: str, models: list[str]) -> DataFrame:
    """A row a key (bucket, fold), a column a model: the mean value."""
    return rows.groupBy(key).pivot("model", models).agg(F.avg(value))


def hac_ic(ic: DataFrame, horizon: int = 5) -> DataFrame:
    """mean, t and n of the ic with lags of twice the horizon, over which labels overlap."""
    return newey_west(ic, "ic", 2 * horizon)


def joint_correlation(rows: DataFrame, a: str, b: str, by: tuple[str, ...], method: str = "spearman", least: int = 3) -> DataFrame:
    """Correlation of the joint values of each group; groups under ``least`` rows and constant ones have none."""
    joint = rows.select(*by).distinct()
    return joint.join(daily_ic(rows, a, b, by, method, least), list(by), "left").withColumnRenamed("ic", "corr")


def trading_costs(returns: DataFrame, gross: str = "gross", cost: str = "cost", year: int = 252) -> DataFrame:
    """Mean turnover of the rows that trade, arithmetic annual return before costs and what costs take of it."""
    return returns.agg(F.avg(F.nullif(F.col("turnover"), F.lit(0.0))).alias("mean_turnover"), (F.avg(gross) * year).alias("gross_return"), (F.avg(cost) * year).alias("cost_drag"))


def mean_losses(losses: DataFrame, columns: list[str]) -> DataFrame:
    """model, mean, median and count over names of each loss column; missing losses are left out."""
    return losses.unpivot([], columns, "model", "loss").where("loss is not null").groupBy("model").agg(F.avg("loss").alias("mean_loss"), F.percentile("loss", F.lit(0.5)).alias("median_loss"), F.count("*").alias("n"))


def equity(returns: DataFrame, r: str = "net", by: tuple[str, ...] = ()) -> DataFrame:
    """equity and drawdown along each series."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w)))
    return rows.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def longest_drawdown(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Length of the longest run of rows below the peak."""
    w = Window.partitionBy(*by).orderBy("date")
    under = F.round("drawdown", 9) < 0
    rows = curve.withColumns({"_under": under, "_all": F.row_number().over(w)}).withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_under").orderBy("date")))
    runs = rows.where("_under").groupBy(*by, (F.col("_all") - F.col("_own")).alias("_run")).agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def performance(returns: DataFrame, r: str = "net", by: tuple[str, ...] = (), year: int = 252) -> DataFrame:
    """Return statistics of each series: annual return and volatility, sharpe, sortino, moments, tails, hit rate."""
    x = F.col(r)
    down = F.when(x < 0, x)
    sd, n = F.stddev_samp(x), F.count(x)
    tail = returns.groupBy(*by).agg(F.percentile(r, F.lit(0.05)).alias("var5")) if by else returns.agg(F.percentile(r, F.lit(0.05)).alias("var5"))
    rows = returns.join(F.broadcast(tail), list(by)) if by else returns.crossJoin(F.broadcast(tail))
    return rows.groupBy(*by).agg(
        n.alias("n"), (F.exp(F.sum(F.log1p(x)) * (float(year) / n)) - 1).alias("ann_return"), (sd * math.sqrt(year)).alias("ann_vol"),
        (F.avg(x) / F.nullif(sd, F.lit(0.0)) * math.sqrt(year)).alias("sharpe"),
        F.when(F.count(down) > 5, F.avg(x) / F.nullif(F.stddev_samp(down), F.lit(0.0)) * math.sqrt(year)).alias("sortino"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.first("var5").alias("var5"), F.avg(F.when(x <= F.col("var5"), x)).alias("cvar5"),
        F.max(x).alias("best"), F.min(x).alias("worst"), (F.count_if(x > 0) / n).alias("hit_rate"),
    )


def against_benchmark(returns: DataFrame, benchmark: DataFrame, r: str = "net", b: str = "mkt_return", year: int = 252) -> DataFrame:
    # The benchmark earns 0 on dates of the book that it has no return for.
    rows = returns.join(benchmark.select("date", b), "date", "left").withColumn(b, F.coalesce(b, F.lit(0.0))).where(F.col(r).isNotNull())
    beta = F.covar_samp(r, b) / F.nullif(F.var_pop(b), F.lit(0.0))
    d = F.col(r) - F.col(b)
    return rows.agg(beta.alias("beta"), ((F.avg(r) - beta * F.avg(b)) * year).alias("alpha"), F.corr(r, b).alias("corr"), (F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * math.sqrt(year)).alias("info_ratio"))


def monthly(returns: DataFrame, r: str = "net") -> DataFrame:
    return returns.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg((F.exp(F.sum(F.log1p(r))) - 1).alias("ret"))


#: Names of the months' columns.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def monthly_table(returns: DataFrame, r: str = "net") -> DataFrame:
    """A row a year, a column a month and one for the whole year."""
    of = lambda x: F.exp(F.sum(x)) - 1
    rows = returns.where(F.col(r).isNotNull()).select(F.year("date").alias("year"), F.month("date").alias("month"), F.log1p(r).alias("g"))
    return rows.groupBy("year").agg(*[of(F.when(F.col("month") == k, F.col("g"))).alias(name) for k, name in enumerate(MONTHS, 1)], of(F.col("g")).alias("whole_year"))


def rolling_sharpe(returns: DataFrame, r: str = "net", window: int = 252, year: int = 252) -> DataFrame:
    w = _line().rowsBetween(-(window - 1), 0)
    return returns.withColumn("rolling_sharpe", F.when(F.count(r).over(w) == window, F.avg(r).over(w) / F.nullif(F.stddev_samp(r).over(w), F.lit(0.0)) * math.sqrt(year)))


def rolling_ic(ic: DataFrame, window: int = 63) -> DataFrame:
    w = _line().rowsBetween(-(window - 1), 0)
    return ic.withColumn("rolling_ic", F.when(F.count("ic").over(w) == window, F.avg("ic").over(w)))


def newey_west(series: DataFrame, x: str, lags: int | None = None) -> DataFrame:
    """mean, t and n with Bartlett weights; series of one row a date. Default lags floor(4 (n/100)^(2/9))."""
    live = series.where(F.col(x).isNotNull()).select("date", F.col(x).alias("x"))
    n = live.count()
    if n < 10:
        return live.agg(F.avg("x").alias("mean"), F.lit(None).cast("double").alias("t"), F.count("x").alias("n"))
    k = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    k = max(0, min(k, n - 1))
    mean = live.agg(F.avg("x").alias("_m"))
    d = live.crossJoin(F.broadcast(mean)).withColumn("d", F.col("x") - F.col("_m"))
    d = d.withColumns({f"l{j}": F.lag("d", j).over(_line()) for j in range(1, k + 1)})
    var = F.sum(F.col("d") * F.col("d")) / n
    for j in range(1, k + 1):
        var = var + 2 * (1 - j / (k + 1)) * F.coalesce(F.sum(F.col("d") * F.col(f"l{j}")), F.lit(0.0)) / n
    return d.agg(F.avg("x").alias("mean"), (F.avg("x") / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0)) / n), F.lit(0.0))).alias("t"), F.count("x").alias("n"))


def hac_by(series: DataFrame, x: str, by: tuple[str, ...], lags: int) -> DataFrame:
    """by and t_hac of the mean of each series, with Bartlett weights on up to ``lags`` lags; missing under 10 rows."""
    own = Window.partitionBy(*by)
    d = series.where(F.col(x).isNotNull()).withColumns({"_d": F.col(x) - F.avg(x).over(own), "_n": F.count(x).over(own)})
    d = d.withColumns({f"_l{j}": F.lag("_d", j).over(own.orderBy("date")) for j in range(1, lags + 1)})
    most = F.least(F.lit(lags), F.first("_n") - 1)
    var = F.sum(F.col("_d") * F.col("_d"))
    for j in range(1, lags + 1):
        var = var + F.when(most >= j, 2 * (1 - j / (most + 1)) * F.coalesce(F.sum(F.col("_d") * F.col(f"_l{j}")), F.lit(0.0))).otherwise(0.0)
    n = F.count("*")
    return d.groupBy(*by).agg(F.when(n >= 10, F.avg(x) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))) / n, F.lit(0.0))).alias("t_hac"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Expected maximum of so many Sharpe ratios of zero mean."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(max(variance, 0.0)) * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def deflated(returns: DataFrame, r: str = "net", trials: int = 1, variance: float | None = None, year: int = 252) -> DataFrame:
    """One row: sharpe and threshold (per period and annual), deflated (probability that the Sharpe ratio beats the expected maximum of the trials), skew, kurtosis and n; missing under 60 rows.

    Without a variance of the trials' ratios it is that of the estimate itself.
    """
    x = F.col(r)
    s = returns.where(x.isNotNull()).agg(F.count(x).alias("n"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"))
    s = s.withColumn("_w", 1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    own = F.lit(float(variance)) if variance is not None else F.col("_w") / (F.col("n") - 1)
    s = s.withColumn("threshold", F.sqrt(F.greatest(own, F.lit(0.0))) * expected_max_sharpe(trials, 1.0))
    z = (F.col("sharpe") - F.col("threshold")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(F.col("_w"), F.lit(1e-12)))
    chance = F.when(z >= 0, normal_cdf(F.abs(z))).otherwise(1 - normal_cdf(F.abs(z)))
    enough = lambda c: F.when(F.col("n") >= 60, c)
    a = math.sqrt(year)
    return s.select("n", *[enough(c).alias(name) for name, c in (("sharpe", F.col("sharpe")), ("sharpe_annual", F.col("sharpe") * a), ("threshold", F.col("threshold")), ("threshold_annual", F.col("threshold") * a), ("deflated", chance), ("skew", F.col("skew")), ("kurtosis", F.col("kurtosis")))])


def deflated_sharpe(returns: DataFrame, r: str, trials: int, variance: float | None = None) -> dict[str, float]:
    """The same as numbers (nan where missing)."""
    row = deflated(returns, r, trials, variance).first()
    return {k: math.nan if row[c] is None else row[c] for k, c in (("dsr", "deflated"), ("sr", "sharpe"), ("sr_star", "threshold"))}


def overfit_probability(returns: DataFrame, r: str = "net", blocks: int = 8) -> DataFrame:
    """pbo and n_splits by combinatorial cross-validation: block moments of each model, then every choice of half the blocks.

    The best model inside (of equal ones the first by name) counts as overfit where its average rank outside, over the number of ranked models, is at most a half.
    Dates on which no model has a return are left out; a model without one on others earns 0. Missing with one model, or under 20 dates a block.
    """
    spark = returns.sparkSession
    blocks -= blocks % 2
    returns = returns.where(F.col(r).isNotNull())
    dates = returns.select("date").distinct().withColumn("_k", F.row_number().over(_line()) - 1)
    names = returns.select("model").distinct()
    n = dates.count()
    if names.count() < 2 or n < 20 * blocks:
        return spark.createDataFrame([(None, 0)], "pbo double, n_splits long")
    long, extra = divmod(n, blocks)
    edge = long + 1
    block = F.when(F.col("_k") < edge * extra, F.floor(F.col("_k") / edge)).otherwise(F.lit(extra) + F.floor((F.col("_k") - edge * extra) / max(long, 1)))
    days = dates.withColumn("block", block.cast("int"))
    full = names.crossJoin(F.broadcast(days)).join(returns.select("model", "date", F.col(r).alias("r")), ["model", "date"], "left").na.fill(0.0, ["r"])
    moments = full.groupBy("model", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    chosen = [(k, list(c)) for k, c in enumerate(itertools.combinations(range(blocks), blocks // 2))]
    masks = spark.createDataFrame(chosen, "split int, inside array<int>")
    both = moments.crossJoin(F.broadcast(masks)).withColumn("own", F.array_contains("inside", F.col("block")))
    sums = both.groupBy("split", "own", "model").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sharpe = mean / F.nullif(F.sqrt(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / (F.col("n") - 1)), F.lit(0.0))
    wide = sums.withColumn("sharpe", F.round(sharpe, 9)).groupBy("split", "model").agg(F.max(F.when(F.col("own"), F.col("sharpe"))).alias("ins"), F.max(F.when(~F.col("own"), F.col("sharpe"))).alias("oos"))
    wide = wide.withColumns({"rank": average_rank("oos", ["split"]), "m": F.count("oos").over(Window.partitionBy("split"))})
    best = wide.where("ins is not null").groupBy("split").agg(F.min_by(F.struct("rank", "m"), F.struct(-F.col("ins"), "model")).alias("b")).where("b.rank is not null")
    return best.agg(F.avg((F.col("b.rank") / F.col("b.m") <= 0.5).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def risk_summary(returns: DataFrame, r: str = "net", year: int = 252) -> DataFrame:
    """Drawdown and calendar statistics of one series: max_drawdown, calmar (annual return over it), longest run below the peak, arithmetic annual return, best, worst and mean month and the share of positive ones."""
    rows = returns.where(F.col(r).isNotNull()).select("date", F.col(r).alias("x"))
    curve = equity(rows, "x")
    down = curve.agg(F.min("drawdown").alias("max_drawdown"), F.count("*").alias("n"), (F.avg("x") * year).alias("arithmetic_return"), (F.exp(F.sum(F.log1p("x")) * (float(year) / F.count("*"))) - 1).alias("_ann"))
    months = monthly(rows, "x").agg(F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"), F.avg("ret").alias("mean_month"), (F.count_if(F.col("ret") > 0) / F.count("*")).alias("positive_months"))
    longest = longest_drawdown(curve).select(F.coalesce("longest", F.lit(0)).alias("longest_drawdown"))
    out = down.crossJoin(months).crossJoin(longest)
    return out.withColumn("calmar", F.col("_ann") / F.abs(F.nullif(F.col("max_drawdown"), F.lit(0.0)))).drop("_ann")


def bootstrap_summary(replicates: DataFrame) -> DataFrame:
    """The 95 % interval, the mean and the share at or below 0 of bootstrapped Sharpe ratios; missing ones are left out."""
    at = F.percentile("sharpe", F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.where("sharpe is not null").agg(at[0].alias("low"), at[1].alias("high"), F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_not_positive"), F.count("*").alias("n"))


def permutation_summary(replicates: DataFrame, observed: DataFrame) -> DataFrame:
    """The observed mean ic (one row, mean_ic) among the shuffled ones: their mean and deviation, and the share, the observed included, at least as large."""
    both = replicates.select(F.col("mean_ic").alias("ic")).crossJoin(observed.select(F.col("mean_ic").alias("observed")))
    return both.agg(F.first("observed").alias("observed"), F.avg("ic").alias("null_mean"), F.stddev_samp("ic").alias("null_std"), ((F.count_if(F.col("ic") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n"))


def bootstrap_sharpe(returns: DataFrame, r: str = "net", n_boot: int = 1000, block: float = 20.0, seed: int = 7, year: int = 252) -> DataFrame:
    """replicate and sharpe by stationary bootstrap with wraparound; missing returns are left out.

    Whether a block begins at a place, and where it starts, are hashes of (seed, replicate, place); the series (one row a date) is joined
    by its place, so nothing passes the driver.
    """
    series = returns.where(F.col(r).isNotNull()).select((F.row_number().over(_line()) - 1).alias("k"), F.col(r).alias("x"))
    series = series.withColumn("n", F.count("*").over(Window.partitionBy()))
    key = mix32(F.col("replicate") * 7919 + seed)
    cells = returns.sparkSession.range(n_boot).withColumnRenamed("id", "replicate").withColumn("key", key).crossJoin(F.broadcast(series.select("k", "n")))
    new = (F.col("k") == 0) | (mix32(F.col("key") + F.col("k") * 2) < int(2**32 / max(block, 1.0)))
    cells = cells.withColumn("start", F.when(new, F.struct(F.col("k").alias("at"), (mix32(F.col("key") + F.col("k") * 2 + 1) % F.col("n")).alias("first"))))
    begun = F.last("start", True).over(Window.partitionBy("replicate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("start", begun).select("replicate", ((F.col("start.first") + F.col("k") - F.col("start.at")) % F.col("n")).alias("k"))
    drawn = cells.join(series.select("k", "x"), "k").groupBy("replicate")
    return drawn.agg((F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * math.sqrt(year)).alias("sharpe"))


#: Rounds of the permutation of a date's names.
ROUNDS = 4


def randomisation(rows: DataFrame, score: str, target: str, n: int = 100, seed: int = 7) -> DataFrame:
    """replicate and mean ic after shuffling the scores among the names of each date.

    A date's ranks are one row (as long as a cross section); its names, ordered by ticker, change places by a keyed permutation in each
    replicate, so rows are neither multiplied nor sorted again.  Dates under five names and constant ones are left out.
    """
    live = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    live = live.select("date", "ticker", average_rank(score, ["date"]).alias("p"), average_rank(target, ["date"]).alias("t"))
    days = live.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "p", "t"))).alias("x")).where(F.size("x") >= 5)
    days = days.select(F.unix_date("date").alias("day"), F.col("x.p").alias("p"), F.col("x.t").alias("t"))

    def run(batches):
        total, dates = np.zeros(n), 0
        for batch in batches:
            for day, p, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                p, t = (np.asarray(v.values, float) for v in (p, t))
                p, t = p - p.mean(), t - t.mean()
                spread = math.sqrt((p @ p) * (t @ t))
                if spread > 1e-12:
                    keys = mix32_of(np.arange(n)[None, :, None] * 1000003 + day * 8191 + np.arange(ROUNDS)[:, None, None] * 131 + seed)
                    total += p[permuted(np.arange(len(p))[None, :], len(p), keys)] @ t / spread
                    dates += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, dates))], names=["replicate", "total", "dates"])

    sums = days.mapInArrow(run, "replicate long, total double, dates long").groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("dates").alias("dates"))
    return sums.select("replicate", (F.col("total") / F.nullif("dates", F.lit(0))).alias("mean_ic"))


def capacity(returns: DataFrame, grid: list[float], r: str = "net", year: int = 252) -> DataFrame:
    """Statistics after an additional cost a unit of turnover, for each level of the grid."""
    levels = returns.sparkSession.createDataFrame([(float(g),) for g in grid], "cost_bps double")
    x = F.col(r) - F.coalesce("turnover", F.lit(0.0)) * F.col("cost_bps") / 1e4
    many = returns.crossJoin(F.broadcast(levels)).withColumn("x", x)
    return many.groupBy("cost_bps").agg((F.avg("x") * year).alias("ann_return"), (F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * math.sqrt(year)).alias("sharpe"))


def factor_regression(returns: DataFrame, factors: DataFrame, names: list[str], r: str = "net", rf: str | None = "rf", lags: int = 10, year: int = 252) -> dict[str, dict[str, float]]:
    """OLS with Bartlett HAC errors of the excess return on the factors: coefficients (the alpha annual), and under ``fit`` n and R squared; series of one row a date, aggregated in Spark but for the small solve."""
    rows = returns.select("date", r).join(factors, "date").na.drop()
    y = F.col(r) - (F.col(rf) if rf and rf in factors.columns else F.lit(0.0))
    rows = rows.select("date", y.alias("_y"), F.lit(1.0).alias("alpha"), *names)
    n = rows.count()
    if n < 100:
        return {"error": {"n": float(n)}}
    cols = ["alpha", *names]
    k = len(cols)
    s = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)], *[F.sum(F.col(a) * F.col("_y")).alias(f"y{i}") for i, a in enumerate(cols)]).first()
    xx = np.array([[s[f"x{i}_{j}"] for j in range(k)] for i in range(k)])
    b = np.linalg.solve(xx, np.array([s[f"y{i}"] for i in range(k)]))
    e = F.col("_y") - sum((F.col(c) * float(v) for c, v in zip(cols, b, strict=True)), F.lit(0.0))
    g = rows.withColumns({f"g{i}": F.col(c) * e for i, c in enumerate(cols)})
    g = g.withColumns({f"g{i}_{j}": F.lag(f"g{i}", j).over(_line()) for i in range(k) for j in range(1, lags + 1)})
    m = g.agg(*[F.sum(F.col(f"g{a}") * F.col(f"g{c}" + (f"_{j}" if j else ""))).alias(f"m{a}_{c}_{j}") for a in range(k) for c in range(k) for j in range(lags + 1)]).first()
    meat = np.zeros((k, k))
    for j in range(lags + 1):
        part = np.array([[m[f"m{a}_{c}_{j}"] or 0.0 for c in range(k)] for a in range(k)])
        meat += part if j == 0 else (1 - j / (lags + 1)) * (part + part.T)
    inv = np.linalg.inv(xx)
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    fit = rows.agg(F.sum(e * e).alias("sse"), (F.var_pop("_y") * F.count("*")).alias("sst")).first()
    r2 = 1 - fit["sse"] / fit["sst"] if fit["sst"] else math.nan
    return {"fit": {"n": float(n), "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / (n - k)}} | {c: {"coef": float(v) * (year if c == "alpha" else 1), "t": float(v / t) if t else math.nan, "p": math.erfc(abs(v / t) / math.sqrt(2)) if t else math.nan} for c, v, t in zip(cols, b, se, strict=True)}


def rolling_exposure(returns: DataFrame, factors: DataFrame, names: list[str], r: str = "net", window: int = 252, step: int = 21, spare: int = 20) -> DataFrame:
    """date, alpha and a coefficient a factor, on the ``window`` rows up to every ``step``-th row that has another behind it; none with under ``window`` + ``spare`` rows.

    Cross moments run in one window and only every ``step``-th row is solved.
    """
    rows = returns.select("date", F.col(r).alias("_y")).join(factors.select("date", *names), "date").na.drop()
    rows = rows.withColumns({"_k": F.row_number().over(_line()), "_n": F.count("*").over(Window.partitionBy())})
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    rows = linear.cross_moments(rows, x, F.col("_y"), _line().rowsBetween(-(window - 1), 0), F.lit(True))
    ends = rows.where((F.col("_n") >= window + spare) & (F.col("_k") >= window) & (F.col("_k") < F.col("_n")) & ((F.col("_k") - window) % step == 0))
    return linear.solved(ends, len(x)).select("date", *[F.col(f"b{i}").alias(c) for i, c in enumerate(["alpha", *names])])


def rank_ics(rows: DataFrame, features: list[str], targets: list[str], least: int = 5) -> DataFrame:
    """date, target, feature, names and ic: ``daily_ic`` of every pair.  Rows move once, by date, as wide as they are.

    A date's columns are ordered once each; a pair takes the joint rows of both orders.  A task holds a date's columns, 8 bytes a name and column.
    """
    columns = [*features, *targets]

    def ranks(order: np.ndarray, x: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Average ranks of the joint rows, from the order of all."""
        order = order[joint[order]]
        starts = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
        sizes = np.diff(np.append(starts, len(order)))
        out = np.empty(len(x))
        out[order] = np.repeat(starts + (sizes + 1) / 2, sizes)
        return out[joint]

    def run(table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy().astype(float) for c in columns}
        order = {c: np.argsort(x[c]) for c in columns}
        known = {c: ~np.isnan(x[c]) for c in columns}
        found: list[tuple] = []
        for t, f in itertools.product(targets, features):
            joint = known[t] & known[f]
            if joint.sum() >= least:
                p, y = ranks(order[f], x[f], joint), ranks(order[t], x[t], joint)
                sp, sy = p.std(), y.std()
                if sp > 1e-12 and sy > 1e-12:
                    found.append((t, f, len(p), float(((p - p.mean()) * (y - y.mean())).mean() / (sp * sy))))
        made = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))]
        day = pa.array([table.column("date")[0].as_py()] * len(found), table.schema.field("date").type)
        return pa.Table.from_arrays([day, *made], names=["date", "target", "feature", "names", "ic"])

    fields = StructType([rows.schema["date"], StructField("target", StringType()), StructField("feature", StringType()), StructField("names", LongType()), StructField("ic", DoubleType())])
    return rows.select("date", *columns).groupBy("date").applyInArrow(run, fields)


def swept(ic: DataFrame, lags: int | None = None, least_dates: int = 1) -> DataFrame:
    """target, feature, mean_ic, icir, t, hit_rate and dates of ``rank_ics``."""
    sd = F.nullif(F.stddev_samp("ic"), F.lit(0.0))
    out = ic.groupBy("target", "feature").agg(F.avg("ic").alias("mean_ic"), (F.avg("ic") / sd * math.sqrt(252)).alias("icir"), (F.avg("ic") / sd * F.sqrt(F.count("ic"))).alias("t"), (F.count_if(F.round("ic", 12) > 0) / F.count("ic")).alias("hit_rate"), F.count("ic").alias("dates"))
    if lags is not None:
        out = out.drop("t").join(hac_by(ic, "ic", ("target", "feature"), lags).withColumnRenamed("t_hac", "t"), ["target", "feature"])
    return out.where(F.col("dates") >= least_dates)


def factor_sweep(rows: DataFrame, features: list[str], targets: list[str], lags: int | None = None, least_dates: int = 1) -> DataFrame:
    """target, feature, mean_ic, icir, t, hit_rate and dates, ranked by (target, feature, date).

    t is that of the mean, with Bartlett weights if ``lags`` is given; pairs with under ``least_dates`` dates are left out.
    """
    ic = rank_ics(rows, features, targets)
    return swept(cut(ic) if lags is not None else ic, lags, least_dates)


def with_ahead(rows: DataFrame, market: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The rows of a dense panel with mkt_return and, for each horizon, fwd_h and fwd_mkt_h."""
    ahead = F.broadcast(labels.forward_markets(market, horizons))  # a row a date
    return rows.withColumns({f"fwd_{h}": labels.forward_return(h) for h in horizons}).join(ahead, "date", "left")


def diagnostics(rows: DataFrame, features: list[str], market: DataFrame | None, horizons: tuple[int, ...] = (1, 5, 10, 21, 63), vol: str = "vol_63", beta: str = "beta_63", least_dates: int = 200, min_names: int = 10) -> DataFrame:
    """horizon, target, feature and the sweep's columns for excess, vol_scaled and beta_neutral returns over every horizon; t has lags of twice the horizon.

    Without a market the rows have the columns of ``with_ahead`` already.  All horizons share one shuffle by date.
    """
    rows = rows if market is None else with_ahead(rows, market, horizons)
    kinds = {}
    for h in horizons:
        ahead = F.col(f"fwd_{h}")
        # Unlike a label's, the volatility has no floor here.
        scaled = F.try_divide(ahead, F.nullif(F.col(vol), F.lit(0.0)))
        kinds |= {f"excess {h}": ahead, f"vol_scaled {h}": scaled, f"beta_neutral {h}": labels.beta_adjusted(f"fwd_{h}", f"fwd_mkt_{h}", beta)}
    own = rows.select("date", *features, *[c.alias(k) for k, c in kinds.items()]).where(F.coalesce(*kinds).isNotNull())
    own = own.select("date", *features, *[labels.demean(k, min_names).alias(k) for k in kinds])
    ic = cut(rank_ics(own, features, list(kinds)))  # a row a date and pair
    out = None
    for h in horizons:
        one = ic.where(F.col("target").endswith(f" {h}")).withColumn("target", F.split("target", " ")[0])
        one = swept(one, 2 * h, least_dates).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def strongest(sweep: DataFrame, n: int = 8) -> DataFrame:
    """The n features of largest absolute t for each horizon and target (the report's limit), with their place; ties by name."""
    place = F.row_number().over(Window.partitionBy("horizon", "target").orderBy(F.desc(F.abs("t")), "feature"))
    return sweep.where("t is not null").withColumn("place", place).where(F.col("place") <= n)


def sweep_summary(sweep: DataFrame, significant: float = 3.0) -> DataFrame:
    """horizon, target, mean and largest absolute ic, number of features with an absolute t above ``significant``."""
    return sweep.groupBy("horizon", "target").agg(F.avg(F.abs("mean_ic")).alias("mean_abs_ic"), F.max(F.abs("mean_ic")).alias("max_abs_ic"), F.count_if(F.abs("t") > significant).alias("n_sig"))


def best_model(stats: DataFrame, without: str = "benchmark") -> DataFrame:
    return stats.where(F.col("model") != without).agg(F.max_by("model", "sharpe").alias("model"), F.max("sharpe").alias("sharpe"))


def verdict(dsr: str = "dsr", sharpe: str = "sharpe") -> F.Column:
    return F.when((F.col(dsr) > 0.95) & (F.col(sharpe) > 0), "clears").when(F.col(sharpe) > 0.5, "promising").otherwise("none")
