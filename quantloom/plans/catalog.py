"""The registered panel queries and, formulated on their own, DuckDB SQL for them.

Computed values are rounded on both sides, since sums of doubles depend on their order.  The panel is
the weekly supplier panel; windows count weeks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix32_sql
from ..functions.linear import elimination_sql
from ..functions.windows import percent_rank
from ..operators import backtest, boosting, evaluation, factors, grid, labels, models, portfolio, quality, serving, splits, training, volatility, xsec
from ..session import cut, shared_folder
from ..sources import panel, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W = factors.WEEKLY

# SQL that the oracles share: bars, the dense grid, log returns, the market.
_BARS = """line AS (SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_quantity AS q, l_extendedprice AS x, l_extendedprice / l_quantity AS price, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
bars AS (SELECT ticker, date, r_name AS sector, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low, sum(x) / sum(q) AS close, sum(q) AS volume, sum(x) / sum(q) * sum(q) AS dollar_volume
 FROM line JOIN supplier ON ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ticker, date, r_name)"""
_DENSE = _BARS + """,
dense AS (SELECT t.ticker, d.date, t.sector, b.open, b.high, b.low, b.close, b.volume, b.dollar_volume FROM (SELECT DISTINCT ticker, sector FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date)"""
_LR = _DENSE + """,
lr0 AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM dense),
lr AS (SELECT *, CASE WHEN lr IS NOT NULL THEN sum(lr) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS cum FROM lr0)"""
_MARKET = _LR + """,
filled AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM dense),
simple AS (SELECT ticker, date, c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM filled),
market AS (SELECT date, avg(r) AS mkt_return FROM simple GROUP BY date)"""


def _win(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def dense_bars(spark: SparkSession, sf_dir: str, sectors: bool = True) -> DataFrame:
    return panel.dense(panel.bars(spark, sf_dir, panel.parts(spark, sf_dir), sectors), dates=panel.weeks(spark, sf_dir))


def returns_panel(spark: SparkSession, sf_dir: str, sectors: bool = True) -> DataFrame:
    return factors.log_returns(dense_bars(spark, sf_dir, sectors))


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_bars(spark, sf_dir)
    return factors.log_returns(rows.join(F.broadcast(panel.market_returns(rows).select("date", "mkt_return", F.log1p("mkt_return").alias("mkt_lr"))), "date", "left"))


#: Prices are quotients by small whole numbers and often halfway between two roundings; this settles which.
NUDGE = 3.1e-8


def rounded(rows: DataFrame, columns: list[str], digits: int = 6, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    return rows.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) for c in columns])


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def _least(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_win(n)} >= {least} THEN {agg} OVER {_win(n)} END"


# --- sources, cleaning, alignment -------------------------------------------------------------


@register("bars", f"WITH {_BARS} SELECT ticker, date, sector, {', '.join(_r(f'{c} + {NUDGE}', c) for c in ('open', 'high', 'low', 'close'))}, volume FROM bars")
def bars(spark, sf_dir):
    prices = [F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("open", "high", "low", "close")]
    return panel.bars(spark, sf_dir).select("ticker", "date", "sector", *prices, "volume")


@register("daily_brand", f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, {_r(f'sum(l_extendedprice) / sum(l_quantity) + {NUDGE}', 'close')}, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def daily_brand(spark, sf_dir):
    return panel.daily_brand(spark, sf_dir).select("ticker", "date", F.round(F.col("close") + NUDGE, 6).alias("close"), "volume")


@register("panel_summary", f"WITH {_BARS} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS tickers, min(date) AS first, max(date) AS last, count(DISTINCT date) AS days, count(DISTINCT sector) AS sectors FROM bars")
def panel_summary(spark, sf_dir):
    return quality.panel_summary(panel.bars(spark, sf_dir))


_QUALITY = f"""WITH {_BARS}, ch AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars WHERE close > 0),
facts AS (SELECT ticker, count(*) FILTER (abs(r) > 0.3) AS jumps, median(close) AS price, count(*) AS days, median(close * volume) AS dv FROM ch GROUP BY ticker),
why AS (SELECT *, CASE WHEN jumps >= 12 THEN 'jumps' WHEN price < 1 THEN 'price' WHEN days < 250 THEN 'history' ELSE 'kept' END AS r0 FROM facts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r0 ORDER BY dv DESC, ticker) AS place FROM why)
SELECT CASE WHEN r0 = 'kept' AND place > 30 THEN 'rank' ELSE r0 END AS reason, count(*) AS tickers FROM ranked GROUP BY 1"""


@register("quality_counts", _QUALITY)
def quality_counts(spark, sf_dir):
    return quality.quality_filter(panel.bars(spark, sf_dir), quality.QualityRules(0.3, 12, 1.0, 250, 30))[1]


@register("thin_dates", f"WITH {_BARS} SELECT ticker, date FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM bars) WHERE n >= 80")
def thin_dates(spark, sf_dir):
    return quality.thin_dates(panel.bars(spark, sf_dir), 80).select("ticker", "date")


@register("calendar", f"WITH {_BARS} SELECT DISTINCT date FROM bars")
def calendar(spark, sf_dir):
    return quality.calendar(panel.bars(spark, sf_dir))


@register("tail_dates", f"WITH {_BARS} SELECT ticker, date, volume FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 10)")
def tail_dates(spark, sf_dir):
    return panel.tail_dates(panel.bars(spark, sf_dir), 10).select("ticker", "date", "volume")


@register("densify_ffill", f"WITH {_DENSE} SELECT ticker, date, {_r(f'last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) + {NUDGE}', 'close_ffill')}, close IS NULL AS missing FROM dense")
def densify_ffill(spark, sf_dir):
    rows = grid.fill_by_ticker(dense_bars(spark, sf_dir), ["close"])
    return rows.select("ticker", "date", F.round(F.col("close_ffill") + NUDGE, 6).alias("close_ffill"), F.col("close").isNull().alias("missing"))


@register("market_return", f"WITH {_MARKET} SELECT date, {_r('mkt_return', 'mkt_return', 9)} FROM market")
def market_return(spark, sf_dir):
    return panel.market_returns(dense_bars(spark, sf_dir)).select("date", F.round("mkt_return", 9).alias("mkt_return"))


@register("as_of_market", f"WITH {_MARKET}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events UNION SELECT date FROM market) SELECT d.date, {_r('coalesce((SELECT max_by(m.mkt_return, m.date) FROM market m WHERE m.date <= d.date AND m.mkt_return IS NOT NULL), 0)', 'mkt_return', 9)} FROM days d")
def as_of_market(spark, sf_dir):
    market = panel.market_returns(dense_bars(spark, sf_dir))
    days = panel.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).union(market.select("date"))
    return grid.as_of_calendar(days, market, "mkt_return").select("date", F.round("mkt_return", 9).alias("mkt_return"))


# --- rolling factors ---------------------------------------------------------------------------

_RET = ", ".join(_r(f"cum - lag(cum, {n}) OVER (PARTITION BY ticker ORDER BY date)", f"ret_{n}") for n in W.returns)


@register("ret_w", f"WITH {_LR} SELECT ticker, date, {_RET} FROM lr")
def ret_w(spark, sf_dir):
    return rounded(factors.momentum(returns_panel(spark, sf_dir), W), [f"ret_{n}" for n in W.returns])


@register("mom_skip", f"WITH {_LR} SELECT ticker, date, {_r(f'lag(cum, {W.skip}) OVER w - lag(cum, {W.year}) OVER w', 'mom_12_1')}, {_r(f'lag(cum, {W.skip}) OVER w - lag(cum, {W.half}) OVER w', 'mom_6_1')} FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def mom_skip(spark, sf_dir):
    return rounded(factors.momentum(returns_panel(spark, sf_dir), W), ["mom_12_1", "mom_6_1"])


_VOL = ", ".join(_r(_least("stddev_samp(lr)", "lr", n, max(3, n // 2)), f"vol_{n}") for n in W.vols)
_DOWN = _least("stddev_samp(CASE WHEN lr < 0 THEN lr END)", "CASE WHEN lr < 0 THEN lr END", W.long, W.least)
_PARK = f"sqrt({_least('avg(pow(ln(high / low), 2))', 'high', W.long, W.least)} / (4 * ln(2)))"


@register("rolling_vol", f"WITH {_LR} SELECT ticker, date, {_VOL}, {_r(_DOWN, 'downside_vol')}, {_r(_PARK, 'parkinson_vol')} FROM lr")
def rolling_vol(spark, sf_dir):
    return rounded(factors.volatility(returns_panel(spark, sf_dir), W, moments=False), [f"vol_{n}" for n in W.vols] + ["downside_vol", "parkinson_vol"])


_SK = f"CASE WHEN count(lr) OVER {_win(W.long)} >= {W.least} THEN skewness(lr) OVER {_win(W.long)} END"
_KU = f"CASE WHEN count(lr) OVER {_win(W.long)} >= {W.least} THEN kurtosis(lr) OVER {_win(W.long)} END"


@register("rolling_skew_kurt", f"WITH {_LR} SELECT ticker, date, {_r(_SK, 'ret_skew', 4)}, {_r(_KU, 'ret_kurt', 4)} FROM lr")
def rolling_skew_kurt(spark, sf_dir):
    return rounded(factors.higher_moments(returns_panel(spark, sf_dir).select("ticker", "date", "lr"), W), ["ret_skew", "ret_kurt"], 4)


_MA = {n: _least("avg(close)", "close", n, max(3, n // 2)) for n in W.means}
_TREND = ", ".join([_r(f"close / ({_MA[n]}) - 1", f"px_to_ma_{n}") for n in W.means] + [_r(f"({_MA[W.means[0]]}) / ({_MA[W.means[-1]]}) - 1", "ma_cross"), _r(f"close / ({_least('max(close)', 'close', W.year, W.year_least)}) - 1", "dist_52w_high"), _r(f"close / ({_least('min(close)', 'close', W.year, W.year_least)}) - 1", "dist_52w_low"), _r(f"(close - ({_least('avg(close)', 'close', W.band, max(3, W.band // 2))})) / nullif({_least('stddev_samp(close)', 'close', W.band, max(3, W.band // 2))}, 0)", "bollinger_z")])


@register("trend", f"WITH {_DENSE} SELECT ticker, date, {_TREND} FROM dense")
def trend(spark, sf_dir):
    return rounded(factors.trend(dense_bars(spark, sf_dir), W), [f"px_to_ma_{n}" for n in W.means] + ["ma_cross", "dist_52w_high", "dist_52w_low", "bollinger_z"])


_ILLIQ = "abs(lr) / nullif(dollar_volume, 0) * 1e9"
_LIQ = f"{_r('ln(1 + dollar_volume)', 'log_dollar_volume')}, {_r('(' + _least('avg(ln(1 + dollar_volume))', 'dollar_volume', W.short, 3) + ') - (' + _least('avg(ln(1 + dollar_volume))', 'dollar_volume', W.long, W.least) + ')', 'dv_trend')}, {_r('volume / (' + _least('avg(volume)', 'volume', W.long, W.least) + ')', 'volume_ratio')}, {_r('ln(1 + (' + _least(f'avg({_ILLIQ})', _ILLIQ, W.long, W.least) + '))', 'amihud_illiq')}"


@register("liquidity", f"WITH {_LR} SELECT ticker, date, {_LIQ} FROM lr")
def liquidity(spark, sf_dir):
    return rounded(factors.liquidity(returns_panel(spark, sf_dir), W), ["log_dollar_volume", "dv_trend", "volume_ratio", "amihud_illiq"])


_B_LEAST = max(W.long // 2, min(20, W.long))
_JOINT = "CASE WHEN m.mkt_return IS NOT NULL THEN lr END"
_BETA = _MARKET + f""",
mk AS (SELECT lr.*, ln(1 + m.mkt_return) AS ml FROM lr LEFT JOIN market m USING (date)),
mo AS (SELECT *, {_least('covar_samp(lr, ml)', 'CASE WHEN ml IS NOT NULL THEN lr END', W.long, _B_LEAST)} AS cov, {_least('var_samp(ml)', 'ml', W.long, _B_LEAST)} AS var, {_least('stddev_samp(lr)', 'lr', W.long, _B_LEAST)} AS sd, {_least('avg(lr)', 'lr', W.long, _B_LEAST)} AS mi, {_least('avg(ml)', 'ml', W.long, _B_LEAST)} AS mm FROM mk),
be AS (SELECT *, cov / nullif(var, 0) AS beta, mi - cov / nullif(var, 0) * mm AS alpha, cov / nullif(sd * sqrt(var), 0) AS corr FROM mo),
re AS (SELECT *, lr - beta * ml - alpha AS e FROM be)"""


@register("beta_alpha_corr", f"WITH {_BETA} SELECT ticker, date, {_r('beta', 'beta_26', 5)}, {_r('alpha', 'alpha_26', 6)}, {_r('corr', 'corr_mkt_26', 5)}, {_r(_least('stddev_samp(e)', 'e', W.long, _B_LEAST), 'idio_vol_26', 6)} FROM re")
def beta_alpha_corr(spark, sf_dir):
    rows = factors.market_relative(market_panel(spark, sf_dir).select("ticker", "date", "lr", "mkt_lr"), W)
    return rows.select("ticker", "date", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("beta_26", 5), ("alpha_26", 6), ("corr_mkt_26", 5), ("idio_vol_26", 6))])


def _ewm_sql(name: str, source: str, x: str, alpha: str, least: int) -> str:
    """Recursive exponential mean of x over the rows k of a ticker; v holds its last value where ``least`` rows were there."""
    return f"""{name}_o AS (SELECT ticker, k, {x} AS x, row_number() OVER (PARTITION BY ticker ORDER BY k) AS j, k - lag(k) OVER (PARTITION BY ticker ORDER BY k) AS gap FROM {source} WHERE {x} IS NOT NULL),
{name}_r AS (SELECT ticker, k, j, CAST(x AS DOUBLE) AS level FROM {name}_o WHERE j = 1 UNION ALL SELECT o.ticker, o.k, o.j, (pow(1 - {alpha}, o.gap) * r.level + {alpha} * o.x) / (pow(1 - {alpha}, o.gap) + {alpha}) FROM {name}_r r JOIN {name}_o o ON o.ticker = r.ticker AND o.j = r.j + 1),
{name} AS (SELECT s.ticker, s.k, CASE WHEN count(r.level) OVER w >= {least} THEN last_value(r.level IGNORE NULLS) OVER w END AS v FROM {source} s LEFT JOIN {name}_r r ON r.ticker = s.ticker AND r.k = s.k WINDOW w AS (PARTITION BY s.ticker ORDER BY s.k ROWS UNBOUNDED PRECEDING))"""


_OSC = f"""steps AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS change FROM dense),
{_ewm_sql('up', 'steps', 'CASE WHEN change IS NOT NULL THEN greatest(change, 0) END', '(1 / 14.0::DOUBLE)', 14)}, {_ewm_sql('down', 'steps', 'CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END', '(1 / 14.0::DOUBLE)', 14)},
{_ewm_sql('fast', 'steps', 'close', '(2 / 13.0::DOUBLE)', 12)}, {_ewm_sql('slow', 'steps', 'close', '(2 / 27.0::DOUBLE)', 26)},
gapline AS (SELECT ticker, k, f.v - s.v AS m FROM fast f JOIN slow s USING (ticker, k)), {_ewm_sql('sig', 'gapline', 'm', '(2 / 10.0::DOUBLE)', 9)},
osc AS (SELECT t.ticker, t.date, CASE WHEN d.v <> 0 THEN (100 - 100 / (1 + u.v / d.v)) / 100 - 0.5::DOUBLE END AS rsi_14, m / close AS macd_norm, (m - g.v) / close AS macd_hist FROM steps t JOIN up u USING (ticker, k) JOIN down d USING (ticker, k) JOIN gapline USING (ticker, k) JOIN sig g USING (ticker, k))"""


@register("oscillators", f"WITH RECURSIVE {_DENSE}, {_OSC} SELECT ticker, date, {_r('rsi_14', 'rsi_14')}, {_r('macd_norm', 'macd_norm')}, {_r('macd_hist', 'macd_hist')} FROM osc")
def oscillators(spark, sf_dir):
    return rounded(factors.oscillators(dense_bars(spark, sf_dir), W), ["rsi_14", "macd_norm", "macd_hist"])


def _lagged(n: int) -> str:
    return f"lag(cum, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def _feature_sql() -> str:
    """All factors, normalised per date, with labels."""
    v = {n: _least("stddev_samp(lr)", "lr", n, max(3, n // 2)) for n in W.vols}
    band = {f: _least(f"{f}(close)", "close", W.band, max(3, W.band // 2)) for f in ("avg", "stddev_samp")}
    exprs = {f"ret_{n}": f"cum - {_lagged(n)}" for n in W.returns} | {f"vol_{n}": v[n] for n in W.vols} | {f"px_to_ma_{n}": f"close / nullif({_MA[n]}, 0) - 1" for n in W.means}
    exprs |= {"mom_12_1": f"{_lagged(W.skip)} - {_lagged(W.year)}", "mom_6_1": f"{_lagged(W.skip)} - {_lagged(W.half)}", "vol_ratio": f"({v[W.vols[0]]}) / nullif({v[W.vols[-1]]}, 0)", "parkinson_vol": _PARK, "downside_vol": _DOWN, "ret_skew": _SK, "ret_kurt": _KU}
    exprs |= {"ma_cross": f"({_MA[W.means[0]]}) / nullif({_MA[W.means[-1]]}, 0) - 1", "dist_52w_high": f"close / nullif({_least('max(close)', 'close', W.year, W.year_least)}, 0) - 1", "dist_52w_low": f"close / nullif({_least('min(close)', 'close', W.year, W.year_least)}, 0) - 1", "bollinger_z": f"(close - ({band['avg']})) / nullif({band['stddev_samp']}, 0)"}
    exprs |= {"log_dollar_volume": "ln(1 + dollar_volume)", "dv_trend": f"({_least('avg(ln(1 + dollar_volume))', 'dollar_volume', W.short, 3)}) - ({_least('avg(ln(1 + dollar_volume))', 'dollar_volume', W.long, W.least)})", "volume_ratio": f"volume / nullif({_least('avg(volume)', 'volume', W.long, W.least)}, 0)", "amihud_illiq": f"ln(1 + ({_least(f'avg({_ILLIQ})', _ILLIQ, W.long, W.least)}))"}
    exprs |= {"beta_26": "beta", "alpha_26": "alpha", "corr_mkt_26": "corr", "idio_vol_26": _least("stddev_samp(e)", "e", W.long, _B_LEAST)}
    names = factors.factor_names(W)
    own = [n for n in names if n in exprs]
    z = {n: f"CASE WHEN {n} IS NOT NULL AND {n}_s > 0 THEN greatest(least((greatest(least({n}, {n}_hi), {n}_lo) - {n}_m) / {n}_s, 5), -5) END" for n in names}
    have = " + ".join(f"CAST({z[n]} IS NOT NULL AS INTEGER)" for n in names)
    return f"""WITH RECURSIVE {_BETA}, {_OSC},
raw0 AS (SELECT ticker, date, sector, close, dollar_volume, {', '.join(f'{exprs[n]} AS {n}' for n in own)}, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) - 1 AS fwd_return FROM re),
raw AS (SELECT raw0.*, rsi_14, macd_norm, macd_hist, CASE WHEN count(fwd_return) OVER (PARTITION BY date) >= 5 THEN fwd_return - avg(fwd_return) OVER (PARTITION BY date) END AS target FROM raw0 JOIN osc USING (ticker, date)),
edges AS (SELECT date, {', '.join(f'quantile_cont({n}, 0.01) AS {n}_lo, quantile_cont({n}, 0.99) AS {n}_hi' for n in names)} FROM raw GROUP BY date),
sums AS (SELECT date, {', '.join(f'avg(CASE WHEN {n} IS NOT NULL THEN greatest(least({n}, {n}_hi), {n}_lo) END) AS {n}_m, stddev_samp(CASE WHEN {n} IS NOT NULL THEN greatest(least({n}, {n}_hi), {n}_lo) END) AS {n}_s' for n in names)} FROM raw JOIN edges USING (date) GROUP BY date),
scaled AS (SELECT ticker, date, sector, target, fwd_return, close, dollar_volume, beta_26 AS beta_raw, vol_26 AS vol_raw, {have} AS have, {', '.join(f'{z[n]} AS z_{n}' for n in names)} FROM raw JOIN edges USING (date) JOIN sums USING (date)),
masked AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM scaled WHERE target IS NOT NULL AND have >= {int(0.8 * len(names))})
SELECT ticker, date, sector, {_r('target', 'target', 4)}, {_r('beta_raw', 'beta_raw', 4)}, {_r('vol_raw', 'vol_raw', 4)}, {', '.join(_r(f'coalesce(z_{n}, 0)', n, 3) for n in names)} FROM masked WHERE n >= 5"""


@register("feature_table", _feature_sql())
def feature_table(spark, sf_dir):
    names = factors.factor_names(W)
    rows = model_table(spark, sf_dir)
    return rows.select("ticker", "date", "sector", *[(F.round(c, 4) + 0.0).alias(c) for c in ("target", "beta_raw", "vol_raw")], *[(F.round(c, 3) + 0.0).alias(c) for c in names])


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors, normalised per date, with labels: the table that models are fitted on."""
    names, least, spare = factors.factor_names(W), 5, 4
    # Bars are stored, dealt by name; all factors would take ten times their room, so these are computed anew for the bounds, for the moments and for the result.
    days = cut(panel.weeks(spark, sf_dir))
    dense = panel.dense(cut(panel.bars(spark, sf_dir, panel.parts(spark, sf_dir)).drop("open"), dealt=True), dates=days).withColumn("fwd_return", labels.forward_return(4))
    market = cut(panel.market_returns(dense))

    def table(dense: DataFrame) -> DataFrame:
        return factors.factor_table(dense, market, W).select("date", "ticker", "sector", "fwd_return", "close", "dollar_volume", *names)

    full, ample = (F.col("fwd_return").isNotNull() & quality.features_known(names, more=k) for k in (0, spare))
    stats = xsec.date_stats(table(dense).withColumns({"full": F.when(full, 1.0), "ample": F.when(ample, 1.0)}), names, plain=("fwd_return", "full", "ample"))
    n = lambda k: F.col("n")[len(names) + k]
    ahead = stats.select("date", F.when(n(0) >= least, F.col("mean")[len(names)]).alias("_ahead"))

    def masked(rows: DataFrame) -> DataFrame:
        rows = rows.where(full).withColumns({"beta_raw": F.col(f"beta_{W.long}"), "vol_raw": F.col(f"vol_{W.vols[-1]}")})
        rows = xsec.scale(rows, names, stats).join(F.broadcast(ahead), "date").withColumn("target", F.col("fwd_return") - F.col("_ahead"))
        return quality.feature_mask(rows, names)

    # A date's rows are those that are full, unless features with values have no deviation, so that they are missing once scaled: then at least those with so many features to spare.
    own = F.arrays_zip(F.slice("n", 1, len(names)).alias("n"), F.slice("deviation", 1, len(names)).alias("deviation"))
    flat = F.size(F.filter(own, lambda x: (x["n"] > 0) & ~F.coalesce(x["deviation"] > 0, F.lit(False))))
    dates = stats.where(n(1) >= least).select("date", ((flat == 0) | ((flat <= spare) & (n(2) >= least))).alias("sure"))
    kept, unsure = dates.where("sure").select("date"), dates.where("not sure").select("date")
    last = unsure.agg(F.max("date")).first()[0]
    if last is not None:  # early dates, as a rule: factors look back only, so the panel up to these is enough to count their rows
        early = dense.join(F.broadcast(days.where(F.col("date") <= F.lit(last))), "date", "left_semi")
        kept = kept.union(cut(quality.thick_dates(masked(table(early)).join(F.broadcast(unsure), "date", "left_semi"), least)))
    rows = masked(table(dense)).join(F.broadcast(kept), "date", "left_semi")
    return rows.select("date", "ticker", "sector", "target", "fwd_return", "close", "dollar_volume", "beta_raw", "vol_raw", *names)


# --- cross sections and labels ------------------------------------------------------------------

_MOM = _LR + ", mom AS (SELECT ticker, date, sector, cum - lag(cum, 13) OVER (PARTITION BY ticker ORDER BY date) AS m FROM lr)"


def momentum_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns_panel(spark, sf_dir)
    return rows.select("ticker", "date", "sector", "close", "lr", (F.col("cum") - F.lag("cum", 13).over(Window.partitionBy("ticker").orderBy("date"))).alias("m"))


@register("winsor_z", f"WITH {_MOM}, q AS (SELECT date, quantile_cont(m, 0.01) AS lo, quantile_cont(m, 0.99) AS hi FROM mom GROUP BY date), c AS (SELECT ticker, date, greatest(least(m, hi), lo) AS m FROM mom JOIN q USING (date) WHERE m IS NOT NULL), s AS (SELECT date, avg(m) AS a, stddev_samp(m) AS sd FROM c GROUP BY date) SELECT ticker, date, {_r('CASE WHEN sd > 0 THEN greatest(least((m - a) / sd, 5), -5) END', 'z')} FROM c JOIN s USING (date)")
def winsor_z(spark, sf_dir):
    rows = cut(momentum_panel(spark, sf_dir).where("m is not null").select("ticker", "date", F.col("m").alias("z")))
    return rounded(xsec.normalise(rows, ["z"]), ["z"])


@register("pct_rank", f"WITH {_MOM}, v AS (SELECT ticker, date, round(m, 10) AS m FROM mom WHERE m IS NOT NULL) SELECT a.ticker, a.date, {_r('(count(*) FILTER (b.m < a.m) + (count(*) FILTER (b.m = a.m) + 1) / 2.0::DOUBLE) / count(*) - 0.5::DOUBLE', 'pr')} FROM v a JOIN v b ON a.date = b.date GROUP BY a.ticker, a.date, a.m")
def pct_rank(spark, sf_dir):
    rows = momentum_panel(spark, sf_dir).withColumn("m", F.round("m", 10))
    return rows.withColumn("pr", percent_rank("m", ["date"])).where("m is not null").select("ticker", "date", (F.round("pr", 6) + 0.0).alias("pr"))


@register("sector_neutral", f"WITH {_MOM} SELECT ticker, date, {_r('m - avg(m) OVER (PARTITION BY date, sector)', 'm')} FROM mom")
def sector_neutral(spark, sf_dir):
    return rounded(xsec.neutralise(momentum_panel(spark, sf_dir), ["m"]), ["m"])


_FWD = _DENSE + ", fwd AS (SELECT ticker, date, sector, close, lead(close, 5) OVER w / lead(close, 1) OVER w - 1 AS f FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@register("fwd_return", f"WITH {_FWD} SELECT ticker, date, {_r('f', 'fwd')}, {_r('CASE WHEN count(f) OVER (PARTITION BY date) >= 5 THEN f - avg(f) OVER (PARTITION BY date) END', 'excess')} FROM fwd")
def fwd_return(spark, sf_dir):
    rows = dense_bars(spark, sf_dir).withColumn("fwd", labels.forward_return(4)).withColumn("excess", labels.demean("fwd", 5))
    return rounded(rows, ["fwd", "excess"])


@register("fwd_market", f"WITH {_MARKET} SELECT date, {_r('CASE WHEN count(mkt_return) OVER w = 4 THEN product(1 + mkt_return) OVER w - 1 END', 'fwd_mkt', 8)} FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)")
def fwd_market(spark, sf_dir):
    return rounded(labels.forward_market(panel.market_returns(dense_bars(spark, sf_dir)), 4), ["fwd_mkt"], 8, ("date",))


@register("vol_scaled_label", f"WITH {_LR}, v AS (SELECT ticker, date, {_least('stddev_samp(lr)', 'lr', 13, 6)} AS v, lead(close, 5) OVER w / lead(close, 1) OVER w - 1 AS f FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, {_r('CASE WHEN nullif(v, 0) IS NOT NULL THEN f / greatest(v, 0.0001::DOUBLE) END', 'scaled', 5)} FROM v")
def vol_scaled_label(spark, sf_dir):
    rows = factors.volatility(returns_panel(spark, sf_dir), W, moments=False).withColumn("fwd", labels.forward_return(4))
    return rounded(rows.withColumn("scaled", labels.vol_scaled("fwd", "vol_13")), ["scaled"], 5)


_TB = f"""WITH {_LR}, s AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, close, {_least('stddev_samp(lr)', 'lr', 13, 6)} AS v FROM lr),
e AS (SELECT s.ticker, s.date, s.k, n.close AS entry, n.close * exp(2 * s.v * sqrt(10)) AS hi, n.close * exp(-2 * s.v * sqrt(10)) AS lo FROM s LEFT JOIN s n ON n.ticker = s.ticker AND n.k = s.k + 1),
p AS (SELECT e.ticker, e.date, min(e.entry) AS entry, min(x.k) FILTER (x.close >= e.hi) AS up, min(x.k) FILTER (x.close <= e.lo) AS down FROM e LEFT JOIN s x ON x.ticker = e.ticker AND x.k BETWEEN e.k + 1 AND e.k + 10 GROUP BY e.ticker, e.date)
SELECT ticker, date, CASE WHEN entry IS NOT NULL THEN CASE WHEN coalesce(up, 1000000) < coalesce(down, 1000000) THEN 1.0::DOUBLE WHEN coalesce(down, 1000000) < coalesce(up, 1000000) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label FROM p"""


@register("triple_barrier", _TB)
def triple_barrier(spark, sf_dir):
    rows = factors.volatility(returns_panel(spark, sf_dir), W, moments=False)
    return rows.select("ticker", "date", labels.triple_barrier("vol_13", hold=10).alias("label"))


# --- splits and models ---------------------------------------------------------------------------

_FOLDS = "folds AS (SELECT k AS fold, n - (2 - k) * 40 - 1 - 39 AS test_lo, n - (2 - k) * 40 - 1 AS test_hi FROM (SELECT count(DISTINCT date) AS n FROM bars), (SELECT unnest([0, 1, 2]) AS k)), pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars))"


@register("walk_forward_folds", f"WITH {_BARS}, {_FOLDS} SELECT date, CAST(pos AS INTEGER) AS pos, CAST(fold AS INTEGER) AS fold, CASE WHEN pos >= test_lo THEN 'test' ELSE 'train' END AS role FROM pos, folds WHERE pos BETWEEN test_lo AND test_hi OR pos BETWEEN test_lo - 6 - 119 AND test_lo - 6")
def walk_forward_folds(spark, sf_dir):
    rows = panel.bars(spark, sf_dir)
    n = rows.select("date").distinct().count()
    return splits.fold_roles(rows, splits.walk_forward(n, 3, 40, 120, 4)).select("date", "pos", "fold", "role")


@register("purged_kfold", f"WITH {_BARS}, n AS (SELECT count(DISTINCT date) AS n FROM bars), b AS (SELECT CAST(k AS INTEGER) AS fold, CAST(round_even(n * k / 4.0, 0) AS BIGINT) AS lo, CAST(round_even(n * (k + 1) / 4.0, 0) AS BIGINT) - 1 AS hi FROM n, (SELECT unnest([0, 1, 2, 3]) AS k)), pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)) SELECT fold, count(*) FILTER (pos BETWEEN lo AND hi) AS n_test, count(*) FILTER (pos < lo - 5 OR pos > hi + 5 + 2) AS n_train FROM pos, b GROUP BY fold")
def purged_kfold(spark, sf_dir):
    rows = panel.bars(spark, sf_dir)
    roles = splits.fold_roles(rows, splits.purged_kfold(rows.select("date").distinct().count(), 4, 4, 2))
    return roles.groupBy("fold").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))


def scored_panel(spark: SparkSession, sf_dir: str, sectors: bool = True) -> DataFrame:
    """Momentum (rounded, so that ranks don't hang on summation order), short reversal, volatility and forward returns."""
    rows = returns_panel(spark, sf_dir, sectors)
    own = Window.partitionBy("ticker").orderBy("date")
    rows = rows.withColumns({"mom": F.round(F.col("cum") - F.lag("cum", 13).over(own), 9), "rev": F.round(F.col("cum") - F.lag("cum", 4).over(own), 9)})
    rows = factors.volatility(rows, W, moments=False).withColumn("fwd", F.round(labels.forward_return(4), 9))
    return rows.select("ticker", "date", "sector", "close", "mom", "rev", F.round("vol_13", 9).alias("vol"), "fwd", "lr")


_SCORED = _LR + f", scored AS (SELECT ticker, date, sector, close, lr, round(cum - lag(cum, 13) OVER w, 9) AS mom, round(cum - lag(cum, 4) OVER w, 9) AS rev, round({_least('stddev_samp(lr)', 'lr', 13, 6)}, 9) AS vol, round(lead(close, 5) OVER w / lead(close, 1) OVER w - 1, 9) AS fwd FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@register("composite_score", f"WITH {_SCORED} SELECT ticker, date, {_r('(coalesce(mom, 0) - coalesce(rev, 0) - coalesce(vol, 0)) / 3', 'score', 12)} FROM scored")
def composite_score(spark, sf_dir):
    model = models.Composite(["mom", "rev", "vol"], {"mom": 1.0, "rev": -1.0, "vol": -1.0})
    return rounded(model.predict(scored_panel(spark, sf_dir), "score"), ["score"], 12)


_RANKED = _SCORED + ", ens AS (SELECT ticker, date, CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY date, mom IS NULL ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0::DOUBLE) / count(mom) OVER (PARTITION BY date) - 0.5::DOUBLE END AS a, CASE WHEN rev IS NOT NULL THEN (rank() OVER (PARTITION BY date, rev IS NULL ORDER BY rev) + (count(*) OVER (PARTITION BY date, rev) - 1) / 2.0::DOUBLE) / count(rev) OVER (PARTITION BY date) - 0.5::DOUBLE END AS b FROM scored)"


@register("rank_ensemble", f"WITH {_RANKED} SELECT ticker, date, {_r('(a + b) / 2', 'ensemble')} FROM ens")
def rank_ensemble(spark, sf_dir):
    return rounded(models.rank_average(scored_panel(spark, sf_dir).select("ticker", "date", "mom", "rev").repartition(panel.parts(spark, sf_dir), "date"), ["mom", "rev"], "ensemble"), ["ensemble"])


#: Features of the walk-forward queries, the ridge penalty and the digits that predictions are rounded to, so that ranks don't hang on the order of sums.
_X, _PENALTY, _DIGITS = ("mom", "rev", "vol"), 10.0, 10
_TERMS = ["1.0::DOUBLE", *[f"coalesce({c}, 0)" for c in _X]]
_SUMS = ", ".join([f"sum({_TERMS[i]} * {_TERMS[j]}) AS g{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"sum({t} * fwd) AS h{i}" for i, t in enumerate(_TERMS)])
_WALK = f"""{_SCORED}, live AS (SELECT * FROM scored WHERE fwd IS NOT NULL),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM live)),
folds AS (SELECT k AS fold, n - (2 - k) * 40 - 40 AS test_lo FROM (SELECT DISTINCT n FROM days), (SELECT unnest([0, 1, 2]) AS k)),
fits AS (SELECT fold, {_SUMS} FROM live JOIN days USING (date) JOIN folds ON pos BETWEEN test_lo - 6 - 119 AND test_lo - 6 GROUP BY fold),
{elimination_sql('fits', 4, 'fold', [0.0, _PENALTY, _PENALTY, _PENALTY])},
preds AS (SELECT ticker, date, fold, fwd, round(h0 + h1 * coalesce(mom, 0) + h2 * coalesce(rev, 0) + h3 * coalesce(vol, 0), {_DIGITS}) AS ridge, round((coalesce(mom, 0) - coalesce(rev, 0) - coalesce(vol, 0)) / 3, {_DIGITS}) AS composite FROM live JOIN days USING (date) JOIN folds ON pos BETWEEN test_lo AND test_lo + 39 JOIN e4 USING (fold)),
ranked AS (SELECT *, {', '.join(f"(rank() OVER (PARTITION BY fold, date ORDER BY {m}) + (count(*) OVER (PARTITION BY fold, date, {m}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY fold, date) - 0.5::DOUBLE AS r_{m}" for m in ('ridge', 'composite'))} FROM preds),
walked AS (SELECT *, round((r_ridge + r_composite) / 2, {_DIGITS}) AS ensemble FROM ranked)"""


def walked(spark: SparkSession, sf_dir: str) -> training.Training:
    """Ridge and composite over three folds of 40 weeks, each after 120 weeks of training."""
    rows = cut(scored_panel(spark, sf_dir).where("fwd is not null"))
    folds = splits.walk_forward(rows.select("date").distinct().count(), 3, 40, 120, 4)
    candidates = {"ridge": models.Ridge(list(_X), _PENALTY), "composite": models.Composite(list(_X), {"mom": 1.0, "rev": -1.0, "vol": -1.0})}
    return training.walk_forward(rows, candidates, folds, "fwd", "fwd", 4, ["ridge", "composite"], digits=_DIGITS)


@register("ridge_walk_forward", f"WITH {_WALK} SELECT ticker, date, CAST(fold AS INTEGER) AS fold, {_r('fwd', 'fwd')}, {_r('ridge', 'pred_ridge')}, {_r('composite', 'pred_composite')}, {_r('ensemble', 'pred_ensemble')} FROM walked")
def ridge_walk_forward(spark, sf_dir):
    return rounded(walked(spark, sf_dir).predictions, ["fwd", "pred_ridge", "pred_composite", "pred_ensemble"], 6, ("ticker", "date", "fold"))


_WALK_METRICS = f"""WITH {_WALK}, long AS ({' UNION ALL '.join(f"SELECT fold, '{m}' AS model, ticker, date, fwd, {m} AS p FROM walked" for m in ('ridge', 'composite', 'ensemble'))}),
r AS (SELECT *, rank() OVER (PARTITION BY model, fold, date ORDER BY p) + (count(*) OVER (PARTITION BY model, fold, date, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY model, fold, date ORDER BY fwd) + (count(*) OVER (PARTITION BY model, fold, date, fwd) - 1) / 2.0::DOUBLE AS rt FROM long),
ics AS (SELECT fold, model, date, corr(rp, rt) AS ic, corr(p, fwd) AS c, stddev_pop(p) AS sp FROM r GROUP BY fold, model, date HAVING count(*) >= 5 AND stddev_pop(rp) > 1e-12 AND stddev_pop(rt) > 1e-12),
sums AS (SELECT fold, model, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(c) FILTER (sp > 1e-12) AS pearson_ic, count(*) FILTER (round(ic, 12) > 0) / count(*) AS hit_rate, count(*) AS n_dates FROM ics GROUP BY fold, model),
d AS (SELECT fold, model, row_number() OVER (PARTITION BY fold, model ORDER BY date) AS k, ic - avg(ic) OVER (PARTITION BY fold, model) AS d FROM ics),
g AS (SELECT a.fold, a.model, sum(CASE WHEN b.k = a.k THEN 1 ELSE 2 * (1 - (b.k - a.k) / 9.0::DOUBLE) END * a.d * b.d) AS v FROM d a JOIN d b ON a.fold = b.fold AND a.model = b.model AND b.k - a.k BETWEEN 0 AND 8 GROUP BY 1, 2),
err AS (SELECT fold, model, sqrt(avg((fwd - p) * (fwd - p))) AS rmse, 1 - avg((fwd - p) * (fwd - p)) / var_pop(fwd) AS oos_r2, count(*) AS n FROM long GROUP BY 1, 2),
k AS (SELECT *, count(*) OVER (PARTITION BY fold, model, date) AS n, row_number() OVER (PARTITION BY fold, model, date ORDER BY p, ticker) AS k FROM long),
ladder AS (SELECT fold, model, greatest(ceil((k - 1) * 5 / (n - 1)), 1) AS bucket, avg(fwd) AS m FROM k WHERE n >= 10 GROUP BY 1, 2, 3),
o AS (SELECT fold, model, max(m) FILTER (bucket = 5) - max(m) FILTER (bucket = 1) AS spread, corr(bucket, place) AS monotonicity FROM (SELECT *, rank() OVER (PARTITION BY fold, model ORDER BY m) AS place FROM ladder) GROUP BY 1, 2)
SELECT CAST(s.fold AS INTEGER) AS fold, s.model, {_r('mean_ic', 'mean_ic')}, {_r('std_ic', 'std_ic')}, {_r('mean_ic / std_ic * sqrt(n_dates / 4)', 't_eff', 5)}, {_r('mean_ic / sqrt(v) * n_dates', 't_hac', 5)}, {_r('pearson_ic', 'pearson_ic')}, {_r('hit_rate', 'hit_rate')}, n_dates, {_r('rmse', 'rmse', 5)}, {_r('oos_r2', 'oos_r2', 5)}, {_r('spread', 'spread', 5)}, {_r('monotonicity', 'monotonicity')}, err.n AS n
FROM sums s JOIN g ON g.fold = s.fold AND g.model = s.model JOIN err ON err.fold = s.fold AND err.model = s.model LEFT JOIN o ON o.fold = s.fold AND o.model = s.model"""


@register("walk_forward_metrics", _WALK_METRICS)
def walk_forward_metrics(spark, sf_dir):
    digits = {"t_eff": 5, "t_hac": 5, "rmse": 5, "oos_r2": 5, "spread": 5}
    found = walked(spark, sf_dir).fold_metrics
    return found.select("fold", "model", "n_dates", "n", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("mean_ic", "std_ic", "t_eff", "t_hac", "pearson_ic", "hit_rate", "rmse", "oos_r2", "spread", "monotonicity")])


_BOUNDS = [round(-1.5 + 0.1 * k, 1) for k in range(31)]


@register("split_gains", f"""WITH {_SCORED}, base AS (SELECT avg(fwd) AS base FROM scored), g AS (SELECT mom, rev, vol, greatest(least(base - fwd, 0.9::DOUBLE), -0.9::DOUBLE) AS g FROM scored, base WHERE fwd IS NOT NULL),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, coalesce({c}, 0) AS x, g FROM g" for c in _X)}),
v AS (SELECT feature, bound, count(*) FILTER (x <= bound) AS n_left, sum(g) FILTER (x <= bound) AS gl, count(*) AS n, sum(g) AS ga, count(*) FILTER (x <= bound AND x > prior) AS own FROM u, (SELECT bound, lag(bound, 1, -1e300::DOUBLE) OVER (ORDER BY bound) AS prior FROM (SELECT unnest({_BOUNDS})::DOUBLE AS bound)) GROUP BY feature, bound)
SELECT feature, bound, n_left, {_r('gl * gl / (n_left + 5) + (ga - gl) * (ga - gl) / (n - n_left + 5) - ga * ga / (n + 5)', 'gain', 4)} FROM v WHERE own > 0""")
def split_gains(spark, sf_dir):
    found = boosting.split_gains(cut(scored_panel(spark, sf_dir)), list(_X), "fwd", _BOUNDS)
    return found.withColumn("gain", F.round("gain", 4) + 0.0)


def boosted(spark: SparkSession, sf_dir: str) -> tuple[boosting.LeafTrees, DataFrame]:
    """Boosted trees for the rank of the next week's return, fitted up to 45 weeks before the end, and the last 40 weeks."""
    ahead = F.try_divide(F.lead("close").over(Window.partitionBy("ticker").orderBy("date")), F.col("close"))
    rows = scored_panel(spark, sf_dir, sectors=False).select("ticker", "date", *_X, F.round(ahead, 9).alias("ahead")).where("ahead is not null")
    rows = rows.repartition(panel.parts(spark, sf_dir), "date").withColumn("target", percent_rank("ahead", ["date"]))
    rows = cut(rows.select("ticker", "date", *_X, "target"))
    fold = splits.walk_forward(rows.select("date").distinct().count(), 1, 40, 400, 4, expanding=True)
    roles = F.broadcast(splits.fold_roles(rows, fold).select("date", "role"))
    own = rows.join(roles, "date")
    model = boosting.LeafTrees(list(_X), rounds=10, rate=0.2, leaves=8, depth=4, delta=0.3, patience=5)
    return model.fit(own.where("role = 'train'"), "target"), own.where("role = 'test'").drop("role")


@register("boosted_trees")
def boosted_trees(spark, sf_dir):
    model, test = boosted(spark, sf_dir)
    return model.predict(test.select("ticker", "date", "target", *_X), "pred_trees")


@register("tree_attributions")
def tree_attributions(spark, sf_dir):
    model, test = boosted(spark, sf_dir)
    return boosting.attribution_summary(model.attributions(test), list(_X))


_GRAM_RIDGE = f"""WITH {_SCORED}, g AS (SELECT count(*) AS n, avg(mom) AS mx, avg(fwd) AS my, sum(mom * mom) AS xx, sum(mom * fwd) AS xy FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL)
SELECT {_r('(xy - n * mx * my) / (xx - n * mx * mx + 10)', 'coef', 8)}, {_r('my - mx * (xy - n * mx * my) / (xx - n * mx * mx + 10)', 'intercept', 8)} FROM g"""


@register("ridge_one", _GRAM_RIDGE)
def ridge_one(spark, sf_dir):
    fitted = models.Ridge(["mom"]).fit(scored_panel(spark, sf_dir).where("mom is not null"), "fwd")
    return spark.createDataFrame([(round(fitted.coef["mom"], 8), round(fitted.intercept, 8))], "coef double, intercept double")


# --- portfolios -----------------------------------------------------------------------------------

_LS = _SCORED + """, live AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS top, row_number() OVER (PARTITION BY date ORDER BY mom ASC, ticker DESC) AS low FROM scored WHERE mom IS NOT NULL),
sized AS (SELECT *, CASE WHEN n < 20 THEN greatest(n // 4, 1) ELSE 10 END AS k FROM live),
ls AS (SELECT ticker, date, sector, vol, mom, CASE WHEN n < 4 THEN 0.0::DOUBLE WHEN top <= k THEN 0.5::DOUBLE / k WHEN low <= k THEN -0.5::DOUBLE / k ELSE 0.0::DOUBLE END AS w FROM sized)"""


def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.rank_long_short(scored_panel(spark, sf_dir), "mom", 10, 10)


@register("rank_ls_weights", f"WITH {_LS} SELECT ticker, date, {_r('w', 'weight')} FROM ls")
def rank_ls_weights(spark, sf_dir):
    return rounded(long_short(spark, sf_dir), ["weight"])


@register("score_weights", f"WITH {_SCORED}, z AS (SELECT ticker, date, coalesce((mom - avg(mom) OVER (PARTITION BY date)) / nullif(stddev_pop(mom) OVER (PARTITION BY date), 0), 0) AS z FROM scored) SELECT ticker, date, {_r('least(greatest(coalesce(z / nullif(sum(abs(z)) OVER (PARTITION BY date), 0), 0), -0.05::DOUBLE), 0.05::DOUBLE)', 'weight')} FROM z")
def score_weights(spark, sf_dir):
    return rounded(portfolio.score_weighted(scored_panel(spark, sf_dir), "mom", 1.0, 0.05), ["weight"])


@register("inverse_vol_weights", f"WITH {_LS}, v AS (SELECT ticker, date, w, w / nullif(vol, 0) AS raw FROM ls) SELECT ticker, date, {_r('CASE WHEN w = 0 THEN 0 ELSE coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY date, sign(w)), 0) / 2, 0) END', 'weight')} FROM v")
def inverse_vol_weights(spark, sf_dir):
    return rounded(portfolio.inverse_vol(long_short(spark, sf_dir), "vol"), ["weight"])


@register("beta_neutral_weights", f"WITH {_LS}, b AS (SELECT ticker, date, w, coalesce(vol, 1) AS b FROM ls), s AS (SELECT date, sum(b * w) FILTER (w <> 0) / nullif(sum(b * b) FILTER (w <> 0), 0) AS k, count(*) FILTER (w <> 0) AS n FROM b GROUP BY date) SELECT ticker, b.date, {_r('CASE WHEN w <> 0 AND n >= 4 THEN w - coalesce(k, 0) * b ELSE w END', 'weight')} FROM b JOIN s ON b.date = s.date")
def beta_neutral_weights(spark, sf_dir):
    return rounded(portfolio.beta_neutral(long_short(spark, sf_dir), "vol"), ["weight"])


@register("sector_neutral_weights", f"WITH {_LS} SELECT ticker, date, {_r('w - avg(w) OVER (PARTITION BY date, sector)', 'weight')} FROM ls")
def sector_neutral_weights(spark, sf_dir):
    return rounded(portfolio.sector_neutral(long_short(spark, sf_dir)), ["weight"])


@register("joint_neutral_weights", f"WITH {_LS}, h AS (SELECT ticker, date, w, CASE WHEN w <> 0 THEN coalesce(vol, 1) END AS b FROM ls), m AS (SELECT date, avg(b) AS mb, avg(w) FILTER (w <> 0) AS mw, covar_pop(b, CASE WHEN w <> 0 THEN w END) AS c, var_pop(b) AS v FROM h GROUP BY date) SELECT ticker, h.date, {_r('CASE WHEN w <> 0 THEN w - mw - CASE WHEN v > 1e-12 THEN c / v ELSE 0 END * (b - mb) ELSE 0 END', 'weight')} FROM h JOIN m ON h.date = m.date")
def joint_neutral_weights(spark, sf_dir):
    return rounded(portfolio.dollar_beta_neutral(long_short(spark, sf_dir), "vol"), ["weight"])


# --- backtests ------------------------------------------------------------------------------------


def book_panel(spark: SparkSession, sf_dir: str, scores: tuple[str, ...], market: bool = False) -> DataFrame:
    """ticker, date, the scores and ret, the next week's return; with ``market`` r, this week's. One pass over the names, kept."""
    ahead = F.try_divide(F.lead("close").over(Window.partitionBy("ticker").orderBy("date")), F.col("close")) - 1
    rows = scored_panel(spark, sf_dir, sectors=False).withColumn("ret", ahead)
    rows = panel.filled_returns(rows) if market else rows
    return cut(rows.select("ticker", "date", *scores, "ret", *["r"] * market))


def strategy(spark: SparkSession, sf_dir: str, book: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """date, net, turnover of weekly rebalanced momentum weights that earn the next week's return; ``book`` is what it holds and its dates, if they are there.

    The synthetic prices jump by multiples, so the book takes a fiftieth of its capital and can lose 99 % at most.
    """
    held, dates = portfolio.held_long_short(book_panel(spark, sf_dir, ("mom",)), "mom", 10, 10) if book is None else book
    held, dates = cut(held), cut(dates)
    return backtest.held_pnl(held, dates).join(backtest.turnover(held, dates), "date").select("date", F.greatest(F.round(F.col("gross") * 0.02, 12), F.lit(-0.99)).alias("net"), F.round("turnover", 9).alias("turnover"))


_STRAT = _LS + """, ahead AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS ret FROM dense),
pnl AS (SELECT date, greatest(round(sum(w * coalesce(ret, 0)) * 0.02::DOUBLE, 12), -0.99::DOUBLE) AS net FROM ls JOIN ahead USING (ticker, date) GROUP BY date),
steps AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM ls)),
held AS (SELECT k, ticker, w FROM ls JOIN steps USING (date) WHERE w <> 0),
moves AS (SELECT coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover FROM held a FULL JOIN held b ON a.ticker = b.ticker AND a.k = b.k + 1 GROUP BY 1),
strat AS (SELECT date, net, round(turnover, 9) AS turnover FROM pnl JOIN steps USING (date) JOIN moves USING (k))"""


@register("strategy_pnl", f"WITH {_STRAT} SELECT date, {_r('net', 'net', 9)}, {_r('turnover', 'turnover')} FROM strat")
def strategy_pnl(spark, sf_dir):
    return strategy(spark, sf_dir).select("date", (F.round("net", 9) + 0.0).alias("net"), F.round("turnover", 6).alias("turnover"))


_CURVE = _STRAT + ", eq AS (SELECT date, net, exp(sum(ln(1 + net)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM strat), dd AS (SELECT date, equity, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"


@register("equity_curve", f"WITH {_CURVE} SELECT date, {_r('equity', 'equity')}, {_r('drawdown', 'drawdown')} FROM dd")
def equity_curve(spark, sf_dir):
    return rounded(evaluation.equity(strategy(spark, sf_dir)), ["equity", "drawdown"], 6, ("date",))


@register("longest_drawdown", f"WITH {_CURVE}, g AS (SELECT round(drawdown, 9) < 0 AS u, count(*) FILTER (round(drawdown, 9) >= 0) OVER (ORDER BY date) AS island FROM dd) SELECT max(n) AS longest FROM (SELECT island, count(*) AS n FROM g WHERE u GROUP BY island)")
def longest_drawdown(spark, sf_dir):
    return evaluation.longest_drawdown(evaluation.equity(strategy(spark, sf_dir)))


@register("monthly_returns", f"WITH {_STRAT} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {_r('exp(sum(ln(1 + net))) - 1', 'ret')} FROM strat GROUP BY 1, 2")
def monthly_returns(spark, sf_dir):
    return rounded(evaluation.monthly(strategy(spark, sf_dir)), ["ret"], 6, ("year", "month"))


_PERF = f"""WITH {_STRAT}, q AS (SELECT quantile_cont(net, 0.05) AS v FROM strat), s AS (SELECT count(*) AS n, exp(sum(ln(1 + net)) * 52 / count(*)) - 1 AS ar, stddev_samp(net) * sqrt(52) AS av, avg(net) / stddev_samp(net) * sqrt(52) AS sh, avg(net) / stddev_samp(net) FILTER (net < 0) * sqrt(52) AS so, avg(net) FILTER (net <= v) AS cv, any_value(v) AS v, max(net) AS best, min(net) AS worst, count(*) FILTER (net > 0) / count(*) AS hit FROM strat, q)
SELECT n, {_r('ar', 'ann_return')}, {_r('av', 'ann_vol')}, {_r('sh', 'sharpe')}, {_r('so', 'sortino')}, {_r('v', 'var5')}, {_r('cv', 'cvar5')}, {_r('best', 'best')}, {_r('worst', 'worst')}, {_r('hit', 'hit_rate')} FROM s"""


@register("perf_stats", _PERF)
def perf_stats(spark, sf_dir):
    return rounded(evaluation.performance(strategy(spark, sf_dir), year=52), ["ann_return", "ann_vol", "sharpe", "sortino", "var5", "cvar5", "best", "worst", "hit_rate"], 6, ("n",))


@register("benchmark_stats", f"WITH {_STRAT}, mk AS (WITH f AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM dense), s AS (SELECT date, c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM f) SELECT date, avg(r) AS m FROM s GROUP BY date), j AS (SELECT net, coalesce(m, 0) AS m FROM strat LEFT JOIN mk USING (date)) SELECT {_r('covar_samp(net, m) / var_pop(m)', 'beta')}, {_r('corr(net, m)', 'corr')}, {_r('avg(net - m) / stddev_samp(net - m) * sqrt(52)', 'info_ratio')} FROM j")
def benchmark_stats(spark, sf_dir):
    market = panel.market_returns(dense_bars(spark, sf_dir))
    return rounded(evaluation.against_benchmark(strategy(spark, sf_dir), market, year=52), ["beta", "corr", "info_ratio"], 6, ())


_NW = f"""WITH {_STRAT}, d AS (SELECT row_number() OVER (ORDER BY date) AS k, net - avg(net) OVER () AS d FROM strat), n AS (SELECT count(*) AS n FROM d), g AS (SELECT b.k - a.k AS lag, sum(a.d * b.d) AS c FROM d a JOIN d b ON b.k - a.k BETWEEN 0 AND 4 GROUP BY 1)
SELECT {_r('(SELECT avg(net) FROM strat)', 'mean', 9)}, {_r('(SELECT avg(net) FROM strat) / sqrt((SELECT sum(CASE WHEN lag = 0 THEN c ELSE 2 * (1 - lag / 5.0::DOUBLE) * c END) FROM g) / n / n)', 't')}, n FROM n"""


@register("newey_west", _NW)
def newey_west(spark, sf_dir):
    return evaluation.newey_west(strategy(spark, sf_dir), "net", 4).select((F.round("mean", 9) + 0.0).alias("mean"), (F.round("t", 6) + 0.0).alias("t"), "n")


@register("capacity_grid", f"WITH {_STRAT}, g AS (SELECT unnest([0, 2, 5, 10, 20, 50])::DOUBLE AS cost_bps) SELECT cost_bps, {_r('avg(net - turnover * cost_bps / 1e4) * 52', 'ann_return')}, {_r('avg(net - turnover * cost_bps / 1e4) / stddev_samp(net - turnover * cost_bps / 1e4) * sqrt(52)', 'sharpe')} FROM strat, g GROUP BY cost_bps")
def capacity_grid(spark, sf_dir):
    return rounded(evaluation.capacity(strategy(spark, sf_dir), [0, 2, 5, 10, 20, 50], year=52), ["ann_return", "sharpe"], 6, ("cost_bps",))


@register("rolling_sharpe", f"WITH {_STRAT} SELECT date, {_r('CASE WHEN count(net) OVER w = 52 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(52) END', 'rolling_sharpe', 5)} FROM strat WINDOW w AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark, sf_dir):
    return rounded(evaluation.rolling_sharpe(strategy(spark, sf_dir), window=52, year=52), ["rolling_sharpe"], 5, ("date",))


def books(spark: SparkSession, sf_dir: str, rules: backtest.Rules) -> DataFrame:
    """Books of momentum and reversal, with volatility standing in for beta."""
    rows = cut(scored_panel(spark, sf_dir))
    gaps = Window.partitionBy("ticker").orderBy("date")
    filled = grid.fill_by_ticker(dense_bars(spark, sf_dir), ["close"])
    rets = cut(filled.select("date", "ticker", (F.try_divide("close_ffill", F.lag("close_ffill").over(gaps)) - 1).alias("ret")))
    weigh = lambda due, name: portfolio.rank_long_short(due, name, 10, 10).withColumnRenamed("vol", "beta")
    return backtest.run_backtest(rows.select("date", "ticker", "vol", "mom", "rev"), rets, ["mom", "rev"], weigh, rules)


_BOOK = f"""WITH {_SCORED}, simple AS (SELECT ticker, date, c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM dense)),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM dense)),
s AS (SELECT 'mom' AS model, ticker, date, mom AS v, coalesce(vol, 1) AS beta FROM scored WHERE mom IS NOT NULL UNION ALL SELECT 'rev', ticker, date, rev, coalesce(vol, 1) FROM scored WHERE rev IS NOT NULL),
due AS (SELECT model, date, k // 4 + 1 AS k FROM (SELECT model, date, row_number() OVER (PARTITION BY model ORDER BY date) - 1 AS k FROM (SELECT DISTINCT model, date FROM s)) WHERE k % 4 = 0),
live AS (SELECT s.*, k, count(*) OVER (PARTITION BY s.model, s.date) AS n, row_number() OVER (PARTITION BY s.model, s.date ORDER BY v DESC, ticker) AS top, row_number() OVER (PARTITION BY s.model, s.date ORDER BY v, ticker DESC) AS low FROM s JOIN due ON due.model = s.model AND due.date = s.date),
held AS (SELECT model, k, ticker, beta, CASE WHEN top <= size THEN 0.5::DOUBLE / size ELSE -0.5::DOUBLE / size END AS w FROM (SELECT *, CASE WHEN n < 20 THEN greatest(n // 4, 1) ELSE 10 END AS size FROM live) WHERE n >= 4 AND (top <= size OR low <= size)),
held_on AS (SELECT d.model, x.date, x.pos, max(d.k) AS k, max(e.pos) + 1 = x.pos AS first FROM due d JOIN days e ON e.date = d.date JOIN days x ON x.pos >= e.pos + 1 GROUP BY d.model, x.date, x.pos),
pnl AS (SELECT o.model, o.date, sum(w * coalesce(ret, 0)) AS gross FROM held_on o JOIN held h ON h.model = o.model AND h.k = o.k LEFT JOIN simple r ON r.date = o.date AND r.ticker = h.ticker GROUP BY 1, 2),
sides AS (SELECT model, k, sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, count(*) FILTER (w > 0) AS n_long, count(*) FILTER (w < 0) AS n_short, coalesce(sum(-w) FILTER (w < 0), 0) AS short, sum(w * beta) AS net_beta FROM held GROUP BY 1, 2),
turn AS (SELECT model, k, sum(abs(w)) AS turnover FROM (SELECT model, k, ticker, sum(w) AS w FROM (SELECT model, k, ticker, w FROM held UNION ALL SELECT model, k + 1, ticker, -w FROM held) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book AS (SELECT o.model, o.date, coalesce(gross, 0) AS gross, CASE WHEN first THEN coalesce(t.turnover, 0) ELSE 0 END AS turnover, coalesce(gross_exposure, 0) AS gross_exposure, coalesce(net_exposure, 0) AS net_exposure, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short, coalesce(short, 0) AS short, net_beta
 FROM held_on o LEFT JOIN pnl USING (model, date) LEFT JOIN sides s ON s.model = o.model AND s.k = o.k LEFT JOIN turn t ON t.model = o.model AND t.k = o.k)
SELECT model, date, {_r('gross', 'gross')}, {_r('gross - turnover * 7 / 1e4 - short * 50 / 1e4 / 252', 'net')}, {_r('turnover * 7 / 1e4 + short * 50 / 1e4 / 252', 'cost', 9)}, {_r('turnover', 'turnover')}, {_r('gross_exposure', 'gross_exposure')}, {_r('net_exposure', 'net_exposure')}, n_long, n_short, 1.0::DOUBLE AS scalar, {_r('net_beta', 'net_beta', 5)} FROM book"""


def _book_rows(rows: DataFrame) -> DataFrame:
    digits = {"cost": 9, "net_beta": 5}
    return rows.select("model", "date", "n_long", "n_short", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("gross", "net", "cost", "turnover", "gross_exposure", "net_exposure", "scalar", "net_beta")])


@register("backtest_book", _BOOK)
def backtest_book(spark, sf_dir):
    return _book_rows(books(spark, sf_dir, backtest.Rules(horizon=4)))


@register("backtest_book_scaled")
def backtest_book_scaled(spark, sf_dir):
    """With a volatility target and a cap on turnover that binds."""
    return _book_rows(books(spark, sf_dir, backtest.Rules(horizon=4, turnover_cap=0.4, vol_target=0.1)))


@register("recurrent_ranker")
def recurrent_ranker(spark, sf_dir):
    """A GRU over six weeks of signals for the rank of the next week's return, on the last 40 weeks."""
    ahead = F.try_divide(F.lead("close").over(Window.partitionBy("ticker").orderBy("date")), F.col("close"))
    rows = scored_panel(spark, sf_dir, sectors=False).select("ticker", "date", *_X, F.round(ahead, 9).alias("ahead")).where("ahead is not null")
    rows = rows.repartition(panel.parts(spark, sf_dir), "date").withColumn("target", percent_rank("ahead", ["date"]))
    rows = cut(rows.select("date", "ticker", "target", *_X))
    fold = splits.walk_forward(rows.select("date").distinct().count(), 1, 40, 400, 4, expanding=True)
    own = rows.join(F.broadcast(splits.fold_roles(rows, fold).select("date", "role")), "date")
    model = models.build("gru", list(_X), length=6, hidden=8, batch=8192, epochs=2, rate=0.02, panel=rows)
    model.fit(own.where("role = 'train'").drop("role"), "target")
    return model.predict(own.where("role = 'test'").drop("role"), "pred_gru")


_STORED = _WALK_METRICS.replace("SELECT fold, '", "SELECT 0 AS fold, '").replace("SELECT CAST(s.fold AS INTEGER) AS fold, s.model,", "SELECT s.model,")


@register("stored_run_metrics", _STORED)
def stored_run_metrics(spark, sf_dir):
    """Metrics of all folds together, from predictions that the run store holds; a second run reads them and fits nothing."""
    store = runs.RunStore(spark, f"{shared_folder(spark)}/runs")
    config = runs.merged(runs.DEFAULTS, {"run": {"name": "walk"}, "label": {"horizon": 4}, "validation": {"n_splits": 3, "train_window_days": 120, "test_window_days": 40}, "models": {"enabled": ["ridge", "factor_composite"], "ridge": {"alpha": _PENALTY}}})

    def build():
        found = walked(spark, sf_dir)
        return {"predictions": found.predictions, "fold_metrics": found.fold_metrics}, {"importances": found.importances, "folds": found.folds, "failures": found.failures}

    key = store.run(config, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")], build)
    found = store.reevaluated(key, lambda rows: training.metrics(rows, ["ridge", "composite", "ensemble"], "fwd", "fwd", (), 4))
    digits = {"t_eff": 5, "t_hac": 5, "rmse": 5, "oos_r2": 5, "spread": 5}
    return found.select("model", "n_dates", "n", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("mean_ic", "std_ic", "t_eff", "t_hac", "pearson_ic", "hit_rate", "rmse", "oos_r2", "spread", "monotonicity")])


# --- evaluation -----------------------------------------------------------------------------------

_IC = _SCORED + """, j AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0::DOUBLE AS t FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, count(*) AS names, corr(p, t) AS ic FROM j GROUP BY date HAVING count(*) >= 5 AND stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12)"""


def momentum_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.daily_ic(scored_panel(spark, sf_dir), "mom", "fwd")


@register("daily_ic", f"WITH {_IC} SELECT date, names, {_r('ic', 'ic', 8)} FROM ic")
def daily_ic(spark, sf_dir):
    return momentum_ic(spark, sf_dir).select("date", "names", (F.round("ic", 8) + 0.0).alias("ic"))


@register("ic_momentum", f"WITH {_IC} SELECT {_r('avg(ic)', 'mean_ic', 8)}, {_r('stddev_samp(ic)', 'std_ic', 8)}, {_r('avg(ic) / stddev_samp(ic) * sqrt(252)', 'icir')}, {_r('count(*) FILTER (round(ic, 12) > 0) / count(*)', 'hit_rate')}, count(*) AS n_dates FROM ic")
def ic_momentum(spark, sf_dir):
    """The flagship: mean weekly rank IC of 13-week momentum against the 4-week forward return (which demeaning per date does not change)."""
    out = evaluation.ic_summary(momentum_ic(spark, sf_dir))
    return out.select((F.round("mean_ic", 8) + 0.0).alias("mean_ic"), (F.round("std_ic", 8) + 0.0).alias("std_ic"), (F.round("icir", 6) + 0.0).alias("icir"), (F.round("hit_rate", 6) + 0.0).alias("hit_rate"), "n_dates")


@register("rolling_ic", f"WITH {_IC} SELECT date, {_r('CASE WHEN count(ic) OVER w = 13 THEN avg(ic) OVER w END', 'rolling_ic', 8)} FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")
def rolling_ic(spark, sf_dir):
    return rounded(evaluation.rolling_ic(momentum_ic(spark, sf_dir), 13), ["rolling_ic"], 8, ("date",))


@register("quantile_spread", f"WITH {_SCORED}, k AS (SELECT date, fwd, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY mom, ticker) AS k FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT CAST(greatest(ceil((k - 1) * 5 / (n - 1)), 1) AS INTEGER) AS bucket, {_r('avg(fwd)', 'mean_fwd', 8)}, {_r('stddev_samp(fwd)', 'std_fwd', 8)}, count(*) AS n FROM k WHERE n >= 10 GROUP BY 1")
def quantile_spread(spark, sf_dir):
    return evaluation.quantile_ladder(scored_panel(spark, sf_dir), "mom", "fwd").select("bucket", (F.round("mean_fwd", 8) + 0.0).alias("mean_fwd"), (F.round("std_fwd", 8) + 0.0).alias("std_fwd"), "n")


@register("prediction_error", f"WITH {_SCORED} SELECT {_r('sqrt(avg((fwd - mom) * (fwd - mom)))', 'rmse')}, {_r('1 - sum((fwd - mom) * (fwd - mom)) / sum(fwd * fwd)', 'oos_r2')}, count(*) AS n FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL")
def prediction_error(spark, sf_dir):
    return evaluation.prediction_error(scored_panel(spark, sf_dir), "mom", "fwd").select((F.round("rmse", 6) + 0.0).alias("rmse"), (F.round("oos_r2", 6) + 0.0).alias("oos_r2"), "n")


_SWEEP = f"""WITH {_SCORED}, u AS (SELECT date, 'mom' AS feature, mom AS v, fwd FROM scored UNION ALL SELECT date, 'rev', rev, fwd FROM scored UNION ALL SELECT date, 'vol', vol, fwd FROM scored),
j AS (SELECT feature, date, rank() OVER (PARTITION BY feature, date ORDER BY v) + (count(*) OVER (PARTITION BY feature, date, v) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY feature, date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, date, fwd) - 1) / 2.0::DOUBLE AS t FROM u WHERE v IS NOT NULL AND fwd IS NOT NULL),
i AS (SELECT feature, date, corr(p, t) AS ic FROM j GROUP BY feature, date HAVING count(*) >= 5 AND stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12)
SELECT 'fwd' AS target, feature, {_r('avg(ic)', 'mean_ic', 8)}, {_r('avg(ic) / stddev_samp(ic) * sqrt(count(*))', 't')}, count(*) AS dates FROM i GROUP BY feature"""


@register("factor_sweep", _SWEEP)
def factor_sweep(spark, sf_dir):
    return evaluation.factor_sweep(scored_panel(spark, sf_dir), ["mom", "rev", "vol"], ["fwd"]).select("target", "feature", (F.round("mean_ic", 8) + 0.0).alias("mean_ic"), (F.round("t", 6) + 0.0).alias("t"), "dates")


@register("screen_topk", f"WITH {_SCORED}, d AS (SELECT * FROM scored WHERE date = (SELECT max(date) FROM scored) AND vol IS NOT NULL) SELECT date, ticker, {_r('vol', 'score')}, 'long' AS side FROM (SELECT * FROM d ORDER BY vol DESC, ticker LIMIT 10) UNION ALL SELECT date, ticker, {_r('vol', 'score')}, 'short' FROM (SELECT * FROM d ORDER BY vol, ticker LIMIT 10)")
def screen_topk(spark, sf_dir):
    return serving.screen(scored_panel(spark, sf_dir), "vol").select("date", "ticker", F.round("score", 6).alias("score"), "side")


_BOOT = f"""{_STRAT}, ser AS (SELECT row_number() OVER (ORDER BY date) - 1 AS k, net AS x, count(*) OVER () AS n FROM strat),
reps AS (SELECT rep, {mix32_sql('rep * 7919 + 7', 'key')} FROM (SELECT unnest(range(1000)) AS rep)),
cells AS (SELECT rep, k, n, {mix32_sql('key + k * 2', 'u')}, {mix32_sql('key + k * 2 + 1', 's')} FROM reps, ser),
begun AS (SELECT rep, k, n, last_value(CASE WHEN k = 0 OR u < {2**32 // 20} THEN k END IGNORE NULLS) OVER w AS at, last_value(CASE WHEN k = 0 OR u < {2**32 // 20} THEN s % n END IGNORE NULLS) OVER w AS first FROM cells WINDOW w AS (PARTITION BY rep ORDER BY k ROWS UNBOUNDED PRECEDING)),
boot AS (SELECT rep AS replicate, avg(x) / nullif(stddev_samp(x), 0) * sqrt(52) AS sharpe FROM begun b JOIN ser ON ser.k = (b.first + b.k - b.at) % b.n GROUP BY rep)"""


@register("bootstrap_sharpe", f"WITH {_BOOT} SELECT replicate, {_r('sharpe', 'sharpe')} FROM boot")
def bootstrap_sharpe(spark, sf_dir):
    return rounded(evaluation.bootstrap_sharpe(cut(strategy(spark, sf_dir)), n_boot=1000, year=52), ["sharpe"], 6, ("replicate",))


_KEYS = ", ".join(mix32_sql(f"rep * 1000003 + day * 8191 + {131 * j} + 7", f"key{j}") for j in range(evaluation.ROUNDS))
_ROUND = ", ".join(f"a{j + 1} AS b{j}, {mix32_sql(f'a{j + 1} + key{j}', f'f{j}')}, xor(a{j}, f{j} & ((1 << h) - 1)) AS a{j + 2}" for j in range(evaluation.ROUNDS))
_PERM = f"""{_SCORED}, live AS (SELECT date, date_diff('day', DATE '1970-01-01', date) AS day, ticker, rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0::DOUBLE AS t, row_number() OVER (PARTITION BY date ORDER BY ticker) - 1 AS k, count(*) OVER (PARTITION BY date) AS m FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL),
big AS (SELECT *, greatest(1, (length(bin(m - 1)) + 1) // 2) AS h FROM live WHERE m >= 5),
keyed AS (SELECT rep, day, {_KEYS} FROM (SELECT DISTINCT day FROM big), (SELECT unnest(range(50)) AS rep)),
walk AS (SELECT rep, day, k, m, h, k AS x, 0 AS step FROM big JOIN keyed USING (day)
 UNION ALL SELECT rep, day, k, m, h, (a{evaluation.ROUNDS} << h) | a{evaluation.ROUNDS + 1} AS x, step + 1 FROM (SELECT w.*, x >> h AS a0, x & ((1 << h) - 1) AS a1, {_ROUND} FROM walk w JOIN keyed USING (rep, day) WHERE step = 0 OR x >= m)),
place AS (SELECT rep, day, k, x FROM walk WHERE step > 0 AND x < m),
shuffled AS (SELECT rep AS replicate, avg(ic) AS mean_ic FROM (SELECT rep, t.day, corr(s.p, t.t) AS ic FROM place JOIN big t ON t.day = place.day AND t.k = place.k JOIN big s ON s.day = place.day AND s.k = place.x GROUP BY rep, t.day HAVING stddev_pop(s.p) > 1e-12 AND stddev_pop(t.t) > 1e-12) GROUP BY rep)"""


@register("randomisation_test", f"WITH RECURSIVE {_PERM} SELECT replicate, {_r('mean_ic', 'mean_ic', 8)} FROM shuffled")
def randomisation_test(spark, sf_dir):
    return rounded(evaluation.randomisation(cut(scored_panel(spark, sf_dir)), "mom", "fwd", 50), ["mean_ic"], 8, ("replicate",))


def _model_pnl(name: str) -> str:
    """SQL of the model's daily return without costs, ls_{name} its weights."""
    return f"""live_{name} AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY {name} DESC, ticker) AS top, row_number() OVER (PARTITION BY date ORDER BY {name} ASC, ticker DESC) AS low FROM scored WHERE {name} IS NOT NULL),
ls_{name} AS (SELECT ticker, date, CASE WHEN n < 4 THEN 0.0::DOUBLE WHEN top <= k THEN 0.5::DOUBLE / k WHEN low <= k THEN -0.5::DOUBLE / k ELSE 0.0::DOUBLE END AS w FROM (SELECT *, CASE WHEN n < 20 THEN greatest(n // 4, 1) ELSE 10 END AS k FROM live_{name})),
pnl_{name} AS (SELECT '{name}' AS model, date, sum(w * coalesce(ret, 0)) AS r FROM ls_{name} JOIN ahead USING (ticker, date) GROUP BY date)"""


_PBO = f"""WITH {_SCORED}, ahead AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS ret FROM dense), {_model_pnl('mom')}, {_model_pnl('rev')}, {_model_pnl('vol')},
every AS (SELECT * FROM pnl_mom UNION ALL SELECT * FROM pnl_rev UNION ALL SELECT * FROM pnl_vol),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM every)),
cells AS (SELECT m.model, CASE WHEN k < (n // 8 + 1) * (n % 8) THEN k // (n // 8 + 1) ELSE n % 8 + (k - (n // 8 + 1) * (n % 8)) // (n // 8) END AS block, coalesce(e.r, 0) AS r FROM days d CROSS JOIN (SELECT DISTINCT model FROM every) m LEFT JOIN every e ON e.model = m.model AND e.date = d.date),
masks AS (SELECT mask FROM (SELECT unnest(range(256)) AS mask) WHERE bit_count(CAST(mask AS UTINYINT)) = 4),
sharpes AS (SELECT mask, model, (mask >> CAST(block AS INTEGER)) & 1 = 1 AS own, round(avg(r) / nullif(stddev_samp(r), 0), 9) AS sr FROM masks, cells GROUP BY mask, model, own),
wide AS (SELECT mask, model, max(sr) FILTER (own) AS ins, max(sr) FILTER (NOT own) AS oos FROM sharpes GROUP BY mask, model),
ranked AS (SELECT *, CASE WHEN oos IS NOT NULL THEN (rank() OVER (PARTITION BY mask, oos IS NULL ORDER BY oos) + (count(*) OVER (PARTITION BY mask, oos) - 1) / 2.0::DOUBLE) / count(oos) OVER (PARTITION BY mask) END AS place, row_number() OVER (PARTITION BY mask ORDER BY ins DESC NULLS LAST, model) AS turn FROM wide)
SELECT avg(CASE WHEN place <= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pbo, count(*) AS n_splits FROM ranked WHERE turn = 1 AND place IS NOT NULL"""


@register("overfit_probability", _PBO)
def overfit_probability(spark, sf_dir):
    rows, own = cut(scored_panel(spark, sf_dir)), Window.partitionBy("ticker").orderBy("date")
    ahead = cut(rows.select("ticker", "date", (F.try_divide(F.lead("close").over(own), F.col("close")) - 1).alias("ret")))
    out = None
    for name in ("mom", "rev", "vol"):
        one = backtest.simple_pnl(portfolio.rank_long_short(rows, name, 10, 10).select("ticker", "date", "weight"), ahead).select(F.lit(name).alias("model"), "date", F.col("gross").alias("net"))
        out = one if out is None else out.union(one)
    return evaluation.overfit_probability(cut(out))


_EXPO_X = ["1.0::DOUBLE", "mkt", "rev", "vol"]
_EXPO = f"""WITH {_STRAT}, {_model_pnl('rev')}, {_model_pnl('vol')},
mk AS (WITH f AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM dense), s AS (SELECT date, c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM f) SELECT date, avg(r) AS mkt FROM s GROUP BY date),
j AS (SELECT date, net, mkt, pnl_rev.r AS rev, pnl_vol.r AS vol, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM strat JOIN mk USING (date) JOIN pnl_rev USING (date) JOIN pnl_vol USING (date) WHERE mkt IS NOT NULL),
ends AS (SELECT date AS last, k AS e FROM j WHERE k >= 104 AND k < n AND (k - 104) % 13 = 0 AND n >= 124),
expo AS (SELECT last, {', '.join([f"sum({_EXPO_X[a]} * {_EXPO_X[b]}) AS g{a}_{b}" for a in range(4) for b in range(a, 4)] + [f"sum({x} * net) AS h{a}" for a, x in enumerate(_EXPO_X)])} FROM j JOIN ends ON k > e - 104 AND k <= e GROUP BY last),
{elimination_sql('expo', 4, 'last')}
SELECT last AS date, {_r('h0', 'alpha')}, {_r('h1', 'mkt', 5)}, {_r('h2', 'rev', 5)}, {_r('h3', 'vol', 5)} FROM e4"""


def strategy_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the strategy; date, mkt, rev and vol: the market and two long-short portfolios), all from one choice of held names; kept, as they have a row a date."""
    held, days = portfolio.held_books(book_panel(spark, sf_dir, _X, market=True), list(_X), 10, 10, means=("r",))
    held = cut(held.select("book", "ticker", "date", "weight", "ret"))
    book = {name: (held.where(F.col("book") == name).drop("book"), days.where(F.col(f"n_{name}") > 0).select("date")) for name in _X}
    returns = days.select("date", F.col("r").alias("mkt")).where("mkt is not null")
    for name in ("rev", "vol"):
        returns = returns.join(backtest.held_pnl(*book[name]).withColumnRenamed("gross", name), "date")
    return cut(strategy(spark, sf_dir, book["mom"])), cut(returns)


@register("rolling_exposures", _EXPO)
def rolling_exposures(spark, sf_dir):
    found = evaluation.rolling_exposure(*strategy_factors(spark, sf_dir), ["mkt", "rev", "vol"], window=104, step=13)
    return found.select("date", (F.round("alpha", 6) + 0.0).alias("alpha"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("mkt", "rev", "vol")])


_RISK = f"""WITH {_CURVE}, g AS (SELECT round(drawdown, 9) < 0 AS u, count(*) FILTER (round(drawdown, 9) >= 0) OVER (ORDER BY date) AS island FROM dd),
mo AS (SELECT exp(sum(ln(1 + net))) - 1 AS ret FROM strat GROUP BY year(date), month(date)),
a AS (SELECT (SELECT min(drawdown) FROM dd) AS md, count(*) AS n, avg(net) * 52 AS ar, exp(sum(ln(1 + net)) * 52 / count(*)) - 1 AS ann FROM strat)
SELECT n, {_r('md', 'max_drawdown')}, {_r('ann / abs(nullif(md, 0))', 'calmar')}, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM g WHERE u GROUP BY island)), 0) AS longest_drawdown, {_r('ar', 'arithmetic_return')}, {_r('(SELECT max(ret) FROM mo)', 'best_month')}, {_r('(SELECT min(ret) FROM mo)', 'worst_month')}, {_r('(SELECT avg(ret) FROM mo)', 'mean_month')}, {_r('(SELECT count(*) FILTER (ret > 0) / count(*) FROM mo)', 'positive_months')} FROM a"""


@register("risk_summary", _RISK)
def risk_summary(spark, sf_dir):
    return rounded(evaluation.risk_summary(cut(strategy(spark, sf_dir)), year=52), ["max_drawdown", "calmar", "arithmetic_return", "best_month", "worst_month", "mean_month", "positive_months"], 6, ("n", "longest_drawdown"))


@register("bootstrap_summary", f"WITH {_BOOT} SELECT {_r('quantile_cont(sharpe, 0.025)', 'low', 5)}, {_r('quantile_cont(sharpe, 0.975)', 'high', 5)}, {_r('avg(sharpe)', 'mean_sharpe', 5)}, {_r('avg((sharpe <= 0)::INTEGER)', 'p_not_positive')}, count(*) AS n FROM boot WHERE sharpe IS NOT NULL")
def bootstrap_summary(spark, sf_dir):
    found = evaluation.bootstrap_summary(evaluation.bootstrap_sharpe(cut(strategy(spark, sf_dir)), n_boot=1000, year=52))
    return found.select("n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("low", 5), ("high", 5), ("mean_sharpe", 5), ("p_not_positive", 6))])


@register("permutation_summary", f"""WITH RECURSIVE {_PERM}, actual AS (SELECT avg(ic) AS observed FROM (SELECT corr(p, t) AS ic FROM big GROUP BY day HAVING stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12))
SELECT {_r('any_value(observed)', 'observed', 8)}, {_r('avg(mean_ic)', 'null_mean', 8)}, {_r('stddev_samp(mean_ic)', 'null_std', 8)}, {_r('(count(*) FILTER (mean_ic >= observed) + 1) / (count(*) + 1)', 'p_value')}, count(*) AS n FROM shuffled, actual""")
def permutation_summary(spark, sf_dir):
    rows = cut(scored_panel(spark, sf_dir))
    observed = evaluation.daily_ic(rows, "mom", "fwd").agg(F.avg("ic").alias("mean_ic"))
    found = evaluation.permutation_summary(evaluation.randomisation(rows, "mom", "fwd", 50), observed)
    return found.select("n", (F.round("p_value", 6) + 0.0).alias("p_value"), *[(F.round(c, 8) + 0.0).alias(c) for c in ("observed", "null_mean", "null_std")])


_HAR = f"""{_LR}, sq AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, coalesce(lr * lr, 0) AS v FROM lr), {volatility.har_sql('sq', 60, 21)}"""


@register("har_forecasts", f"WITH {_HAR}, d AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM lr) SELECT ticker, date, {_r('v', 'realised', 8)}, {_r('f', 'har', 8)} FROM d JOIN har_f USING (ticker, k)")
def har_forecasts(spark, sf_dir):
    return rounded(volatility.har(returns_panel(spark, sf_dir), "lr", 60, 21), ["realised", "har"], 8)


@register("variance_losses", f"""WITH RECURSIVE {_HAR}, ew AS (SELECT ticker, k, v, v AS s, CAST(NULL AS DOUBLE) AS f FROM sq WHERE k = 1 UNION ALL SELECT q.ticker, q.k, q.v, 0.94::DOUBLE * e.s + 0.06::DOUBLE * q.v, e.s FROM ew e JOIN sq q ON q.ticker = e.ticker AND q.k = e.k + 1),
both_f AS (SELECT 'ewma' AS model, v, f FROM ew UNION ALL SELECT 'har', v, f FROM har_f)
SELECT model, {_r('ln(1 + avg(v / f - ln(greatest(v, 1e-16) / f) - 1))', 'log_qlike')}, {_r('avg((v - f) * (v - f))', 'mse')}, count(*) AS n FROM both_f WHERE f > 0 GROUP BY model""")
def variance_losses(spark, sf_dir):
    found = cut(volatility.forecasts(cut(returns_panel(spark, sf_dir).select("ticker", "date", "lr")), "lr", ("ewma", "har"), har={"least": 60}))
    both = volatility.losses(found, "ewma").withColumn("model", F.lit("ewma")).union(volatility.losses(found, "har").withColumn("model", F.lit("har")))
    return both.select("model", "n", (F.round(F.log1p("qlike"), 6) + 0.0).alias("log_qlike"), (F.round("mse", 6) + 0.0).alias("mse"))


@register("volatility_comparison")
def volatility_comparison(spark, sf_dir):
    rows = cut(returns_panel(spark, sf_dir).select("ticker", "date", "lr"))
    return volatility.compared(rows, "lr", 12, 100, har={"least": 40}, garch={"least": 80, "refit": 40})


@register("qlike_ewma", f"""WITH RECURSIVE {_LR}, x AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, coalesce(lr * lr, 0) AS v FROM lr),
e AS (SELECT ticker, k, v, v AS s, CAST(NULL AS DOUBLE) AS f FROM x WHERE k = 1 UNION ALL SELECT x.ticker, x.k, x.v, 0.94::DOUBLE * e.s + 0.06::DOUBLE * x.v, e.s FROM e JOIN x ON x.ticker = e.ticker AND x.k = e.k + 1)
SELECT ticker, {_r('avg(v / f - ln(greatest(v, 1e-16) / f) - 1)', 'qlike', 4)}, count(*) AS n FROM e WHERE f IS NOT NULL AND f > 0 GROUP BY ticker""")
def qlike_ewma(spark, sf_dir):
    rows = returns_panel(spark, sf_dir).select("ticker", "date", "lr")
    return volatility.losses(volatility.forecasts(rows, "lr", ("ewma",)), "ewma", ("ticker",)).select("ticker", F.round("qlike", 4).alias("qlike"), "n")


# --- tables of an evaluation ----------------------------------------------------------------------

_MODELS = ("mom", "rev", "vol")
_EACH = ", u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, ticker, date, {m} AS v, fwd FROM scored WHERE {m} IS NOT NULL AND fwd IS NOT NULL" for m in _MODELS) + ")"
_ICS = _EACH + """, r AS (SELECT model, date, rank() OVER (PARTITION BY model, date ORDER BY v) + (count(*) OVER (PARTITION BY model, date, v) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY model, date ORDER BY fwd) + (count(*) OVER (PARTITION BY model, date, fwd) - 1) / 2.0::DOUBLE AS t FROM u),
ics AS (SELECT model, date, corr(p, t) AS ic FROM r GROUP BY model, date HAVING count(*) >= 5 AND stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12)"""
_BUCKETS = """k AS (SELECT model, fwd, count(*) OVER (PARTITION BY model, date) AS n, row_number() OVER (PARTITION BY model, date ORDER BY v, ticker) AS k FROM u),
ladder AS (SELECT model, CAST(greatest(ceil((k - 1) * 5 / (n - 1)), 1) AS INTEGER) AS bucket, avg(fwd) AS m FROM k WHERE n >= 10 GROUP BY 1, 2)"""


def _each_model(query: Callable[[DataFrame, str], DataFrame], rows: DataFrame) -> DataFrame:
    """The query's rows of each model, with its name."""
    out = None
    for name in _MODELS:
        one = query(rows, name).withColumn("model", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def _columns(value: str) -> str:
    return ", ".join(_r(f"avg({value}) FILTER (model = '{m}')", m, 8) for m in _MODELS)


@register("ladder_table", f"WITH {_SCORED}{_EACH}, {_BUCKETS} SELECT bucket, {_columns('m')} FROM ladder GROUP BY bucket")
def ladder_table(spark, sf_dir):
    ladders = _each_model(lambda rows, name: evaluation.quantile_ladder(rows, name, "fwd"), cut(scored_panel(spark, sf_dir)))
    return rounded(evaluation.by_model(ladders, "bucket", "mean_fwd", list(_MODELS)), list(_MODELS), 8, ("bucket",))


@register("fold_ic", f"""WITH {_SCORED}{_ICS}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scored)), folds AS (SELECT k AS fold, n - (2 - k) * 40 - 40 AS test_lo FROM (SELECT DISTINCT n FROM days), (SELECT unnest([0, 1, 2]) AS k))
SELECT CAST(fold AS INTEGER) AS fold, {_columns('ic')} FROM ics JOIN days USING (date) JOIN folds ON pos BETWEEN test_lo AND test_lo + 39 GROUP BY fold""")
def fold_ic(spark, sf_dir):
    rows = cut(scored_panel(spark, sf_dir))
    roles = splits.fold_roles(rows, splits.walk_forward(rows.select("date").distinct().count(), 3, 40, 120, 4)).where("role = 'test'").select("date", "fold")
    ics = _each_model(lambda rows, name: evaluation.daily_ic(rows, name, "fwd"), rows).join(F.broadcast(roles), "date")
    return rounded(evaluation.by_model(ics, "fold", "ic", list(_MODELS)), list(_MODELS), 8, ("fold",))


@register("prediction_metrics", f"""WITH {_SCORED}{_ICS}, {_BUCKETS}, o AS (SELECT bucket, m, rank() OVER (ORDER BY m) AS place FROM ladder WHERE model = 'mom'),
pe AS (SELECT date, corr(v, fwd) AS c FROM u WHERE model = 'mom' GROUP BY date HAVING count(*) >= 5 AND stddev_pop(v) > 1e-12 AND stddev_pop(fwd) > 1e-12)
SELECT {_r("(SELECT avg(ic) FROM ics WHERE model = 'mom')", 'mean_ic')}, {_r('(SELECT avg(c) FROM pe)', 'mean_pearson')}, {_r('sqrt(avg((fwd - v) * (fwd - v)))', 'rmse')}, {_r('1 - sum((fwd - v) * (fwd - v)) / sum(fwd * fwd)', 'oos_r2')}, {_r('(SELECT max(m) FILTER (bucket = 5) - max(m) FILTER (bucket = 1) FROM o)', 'spread')}, {_r('(SELECT corr(bucket, place) FROM o)', 'monotonicity')}, count(*) AS n FROM u WHERE model = 'mom'""")
def prediction_metrics(spark, sf_dir):
    return rounded(evaluation.prediction_metrics(cut(scored_panel(spark, sf_dir)), "mom", "fwd"), ["mean_ic", "mean_pearson", "rmse", "oos_r2", "spread", "monotonicity"], 6, ("n",))


@register("ic_hac", f"""WITH {_IC}, d AS (SELECT row_number() OVER (ORDER BY date) AS k, ic - avg(ic) OVER () AS d FROM ic), n AS (SELECT count(*) AS n FROM d), g AS (SELECT b.k - a.k AS lag, sum(a.d * b.d) AS c FROM d a JOIN d b ON b.k - a.k BETWEEN 0 AND 8 GROUP BY 1)
SELECT {_r('(SELECT avg(ic) FROM ic)', 'mean', 8)}, {_r('(SELECT avg(ic) FROM ic) / sqrt((SELECT sum(CASE WHEN lag = 0 THEN c ELSE 2 * (1 - lag / 9.0::DOUBLE) * c END) FROM g) / n / n)', 't')}, n FROM n""")
def ic_hac(spark, sf_dir):
    return rounded(evaluation.hac_ic(cut(momentum_ic(spark, sf_dir)), 4), ["t"], 6, ("mean", "n")).withColumn("mean", F.round("mean", 8) + 0.0)


@register("name_correlation", f"""WITH {_SCORED}, j AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker ORDER BY mom) + (count(*) OVER (PARTITION BY ticker, mom) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY ticker ORDER BY fwd) + (count(*) OVER (PARTITION BY ticker, fwd) - 1) / 2.0::DOUBLE AS t FROM scored WHERE mom IS NOT NULL AND fwd IS NOT NULL),
c AS (SELECT ticker, count(*) AS names, corr(p, t) AS c FROM j GROUP BY ticker HAVING count(*) >= 3 AND stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12)
SELECT d.ticker, names, {_r('c', 'corr', 8)} FROM (SELECT DISTINCT ticker FROM scored) d LEFT JOIN c ON c.ticker = d.ticker""")
def name_correlation(spark, sf_dir):
    return rounded(evaluation.joint_correlation(cut(scored_panel(spark, sf_dir)), "mom", "fwd", ("ticker",)), ["corr"], 8, ("ticker", "names"))


@register("trading_costs", f"WITH {_STRAT} SELECT {_r('avg(nullif(turnover, 0))', 'mean_turnover')}, {_r('avg(net) * 52', 'gross_return')}, {_r('avg(turnover * 7 / 1e4) * 52', 'cost_drag')} FROM strat")
def trading_costs(spark, sf_dir):
    costs = backtest.Costs()
    rows = strategy(spark, sf_dir).select("turnover", F.col("net").alias("gross"), (F.col("turnover") * ((costs.cost_bps + costs.slippage_bps) / 1e4)).alias("cost"))
    return evaluation.trading_costs(rows, year=52).select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_turnover", "gross_return", "cost_drag")])


_PER_NAME = ORACLES["qlike_ewma"].rpartition("SELECT ticker, round(")


@register("mean_losses", f"{_PER_NAME[0]}, each AS ({_PER_NAME[1]}{_PER_NAME[2]}) SELECT 'qlike' AS model, {_r('avg(qlike)', 'mean_loss', 3)}, {_r('median(qlike)', 'median_loss', 3)}, count(*) AS n FROM each WHERE n >= 10")
def mean_losses(spark, sf_dir):
    return rounded(evaluation.mean_losses(qlike_ewma(spark, sf_dir).where("n >= 10"), ["qlike"]), ["mean_loss", "median_loss"], 3, ("model", "n"))


@register("signal_zscore", f"WITH {_MOM}, s AS (SELECT date, count(m) AS n, avg(m) AS a, stddev_pop(m) AS sd FROM mom GROUP BY date) SELECT ticker, date, {_r('CASE WHEN n >= 5 AND m IS NOT NULL AND sd > 0 THEN greatest(least((m - a) / sd, 3), -3) ELSE 0 END', 'z')} FROM mom JOIN s USING (date)")
def signal_zscore(spark, sf_dir):
    return rounded(xsec.signal_zscore(momentum_panel(spark, sf_dir), ["m"]).withColumnRenamed("m", "z"), ["z"])


@register("mean_scores", f"SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, {_r('avg(CAST(l_extendedprice AS DOUBLE))', 'score', 4)} FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2")
def mean_scores(spark, sf_dir):
    rows = panel.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast("double").alias("score"))
    return rounded(backtest.mean_scores(rows, "score"), ["score"], 4)


@register("aligned_benchmark", f"WITH {_MARKET}, days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT d.date, {_r('coalesce(mkt_return, 0)', 'mkt_return', 9)} FROM days d LEFT JOIN market m ON m.date = d.date")
def aligned_benchmark(spark, sf_dir):
    days = panel.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return rounded(backtest.aligned_benchmark(days, panel.market_returns(dense_bars(spark, sf_dir))), ["mkt_return"], 9, ("date",))


# --- labels, diagnostics, attribution --------------------------------------------------------------

_MKT_AHEAD = "fm AS (SELECT date, CASE WHEN count(mkt_return) OVER w = 4 THEN product(1 + mkt_return) OVER w - 1 END AS fwd_mkt FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING))"
_LABELLED = _BETA + f""", {_MKT_AHEAD}, lab AS (SELECT re.ticker, re.date, beta, {_least('stddev_samp(lr)', 'lr', 13, 6)} AS v, lead(close, 5) OVER (PARTITION BY ticker ORDER BY re.date) / lead(close, 1) OVER (PARTITION BY ticker ORDER BY re.date) - 1 AS f, fwd_mkt FROM re LEFT JOIN fm USING (date)),
vs AS (SELECT *, CASE WHEN nullif(v, 0) IS NOT NULL THEN f / greatest(v, 0.0001::DOUBLE) END AS s FROM lab), vb AS (SELECT *, s - beta * fwd_mkt AS sb FROM vs)"""


@register("label_variants", f"WITH {_LABELLED} SELECT ticker, date, {_r('f', 'fwd_return')}, {_r('CASE WHEN count(sb) OVER (PARTITION BY date) >= 5 THEN sb - avg(sb) OVER (PARTITION BY date) END', 'target', 4)} FROM vb")
def label_variants(spark, sf_dir):
    """Excess returns scaled by volatility and less their beta's share of the market."""
    rows = factors.volatility(market_panel(spark, sf_dir), W, moments=False).select("ticker", "date", "close", "lr", "mkt_lr", "vol_13")
    rows = factors.market_relative(rows, W)
    found = labels.build_labels(rows, "forward_excess_return", 4, 1, 5, vol="vol_13", beta=f"beta_{W.long}", market=panel.market_returns(dense_bars(spark, sf_dir)))
    return found.select("ticker", "date", (F.round("fwd_return", 6) + 0.0).alias("fwd_return"), (F.round("target", 4) + 0.0).alias("target"))


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of three signals over two horizons."""
    rows, horizons = dense_bars(spark, sf_dir, sectors=False), (1, 4)
    rows = evaluation.with_ahead(rows, panel.market_returns(rows), horizons).withColumn("mkt_lr", F.log1p("mkt_return"))
    rows = factors.volatility(factors.log_returns(rows), W, moments=False)
    own = Window.partitionBy("ticker").orderBy("date")
    lag = lambda n: F.round(F.col("cum") - F.lag("cum", n).over(own), 9)
    ahead = [f"{c}_{h}" for c in ("fwd", "fwd_mkt") for h in horizons]
    rows = rows.withColumns({"mom": lag(13), "rev": lag(4), "vol": F.round("vol_13", 9)}).select("ticker", "date", "lr", "mkt_lr", "mom", "rev", "vol", "vol_13", *ahead)
    return evaluation.diagnostics(factors.market_relative(rows, W), ["mom", "rev", "vol"], None, horizons, "vol_13", f"beta_{W.long}", 100, 10)


def _diagnosed(h: int) -> str:
    demeaned = lambda c: f"CASE WHEN count({c}) OVER (PARTITION BY date) >= 10 THEN {c} - avg({c}) OVER (PARTITION BY date) END"
    pairs = " UNION ALL ".join(f"SELECT '{t}' AS target, '{f}' AS feature, date, {f} AS v, {t} AS y FROM y{h}" for t in ("excess", "vol_scaled", "beta_neutral") for f in ("mom", "rev", "vol"))
    return f"""fm{h} AS (SELECT date, CASE WHEN count(mkt_return) OVER w = {h} THEN product(1 + mkt_return) OVER w - 1 END AS fwd_mkt FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 2 FOLLOWING AND {h + 1} FOLLOWING)),
f{h} AS (SELECT s.*, fwd_mkt, lead(close, {h + 1}) OVER w / lead(close, 1) OVER w - 1 AS f FROM sig s LEFT JOIN fm{h} USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY s.date)),
k{h} AS (SELECT *, f / nullif(v13, 0) AS fv, f - beta * fwd_mkt AS fb FROM f{h}),
y{h} AS (SELECT date, mom, rev, vol, {demeaned('f')} AS excess, {demeaned('fv')} AS vol_scaled, {demeaned('fb')} AS beta_neutral FROM k{h}),
u{h} AS ({pairs}),
r{h} AS (SELECT target, feature, date, rank() OVER (PARTITION BY target, feature, date ORDER BY v) + (count(*) OVER (PARTITION BY target, feature, date, v) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY target, feature, date ORDER BY y) + (count(*) OVER (PARTITION BY target, feature, date, y) - 1) / 2.0::DOUBLE AS t FROM u{h} WHERE v IS NOT NULL AND y IS NOT NULL),
i{h} AS (SELECT target, feature, date, corr(p, t) AS ic FROM r{h} GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND stddev_pop(p) > 1e-12 AND stddev_pop(t) > 1e-12),
d{h} AS (SELECT target, feature, row_number() OVER (PARTITION BY target, feature ORDER BY date) AS k, ic - avg(ic) OVER (PARTITION BY target, feature) AS d FROM i{h}),
g{h} AS (SELECT a.target, a.feature, sum(CASE WHEN b.k = a.k THEN 1 ELSE 2 * (1 - (b.k - a.k) / {2 * h + 1}.0::DOUBLE) END * a.d * b.d) AS q FROM d{h} a JOIN d{h} b ON a.target = b.target AND a.feature = b.feature AND b.k - a.k BETWEEN 0 AND {2 * h} GROUP BY 1, 2),
s{h} AS (SELECT {h} AS horizon, target, feature, avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) * sqrt(252) AS icir, avg(ic) / sqrt(any_value(q)) * count(*) AS t, count(*) FILTER (round(ic, 12) > 0) / count(*) AS hit_rate, count(*) AS dates FROM i{h} JOIN g{h} USING (target, feature) GROUP BY 1, 2, 3 HAVING count(*) >= 100)"""


_SIGNALS = _BETA + f""", sig AS (SELECT ticker, date, close, beta, {_least('stddev_samp(lr)', 'lr', 13, 6)} AS v13, round(cum - lag(cum, 13) OVER w, 9) AS mom, round(cum - lag(cum, 4) OVER w, 9) AS rev, round({_least('stddev_samp(lr)', 'lr', 13, 6)}, 9) AS vol FROM re WINDOW w AS (PARTITION BY ticker ORDER BY date)),
{_diagnosed(1)}, {_diagnosed(4)}, sweep AS (SELECT * FROM s1 UNION ALL SELECT * FROM s4)"""


@register("factor_diagnostics", f"WITH {_SIGNALS} SELECT CAST(horizon AS INTEGER) AS horizon, target, feature, {_r('mean_ic', 'mean_ic', 7)}, {_r('icir', 'icir', 5)}, {_r('t', 't', 5)}, {_r('hit_rate', 'hit_rate')}, dates FROM sweep")
def factor_diagnostics(spark, sf_dir):
    return swept(spark, sf_dir).select("horizon", "target", "feature", "dates", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("mean_ic", 7), ("icir", 5), ("t", 5), ("hit_rate", 6))])


@register("diagnostics_summary", f"WITH {_SIGNALS} SELECT CAST(horizon AS INTEGER) AS horizon, target, {_r('avg(abs(mean_ic))', 'mean_abs_ic')}, {_r('max(abs(mean_ic))', 'max_abs_ic')}, count(*) FILTER (abs(t) > 3) AS n_sig FROM sweep GROUP BY horizon, target")
def diagnostics_summary(spark, sf_dir):
    return evaluation.sweep_summary(swept(spark, sf_dir)).select("horizon", "target", "n_sig", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_abs_ic", "max_abs_ic")])


@register("monthly_table", f"WITH {_STRAT} SELECT CAST(year(date) AS INTEGER) AS year, {', '.join(_r(f'exp(sum(ln(1 + net)) FILTER (month(date) = {k})) - 1', name) for k, name in enumerate(evaluation.MONTHS, 1))}, {_r('exp(sum(ln(1 + net))) - 1', 'whole_year')} FROM strat GROUP BY 1")
def monthly_table(spark, sf_dir):
    return rounded(evaluation.monthly_table(strategy(spark, sf_dir)), [*evaluation.MONTHS, "whole_year"], 6, ("year",))


_TAIL = "(0.319381530::DOUBLE * u + -0.356563782::DOUBLE * pow(u, 2) + 1.781477937::DOUBLE * pow(u, 3) + -1.821255978::DOUBLE * pow(u, 4) + 1.330274429::DOUBLE * pow(u, 5))"
_DSR = f"""WITH {_STRAT}, c AS (SELECT count(*) AS n, avg(net) AS m, avg(net) / stddev_samp(net) AS s FROM strat),
o AS (SELECT n, s, (SELECT avg(pow(net - m, 3)) / pow(avg(pow(net - m, 2)), 1.5) FROM strat) AS sk, (SELECT avg(pow(net - m, 4)) / pow(avg(pow(net - m, 2)), 2) FROM strat) AS ku FROM c),
w AS (SELECT *, 1 - sk * s + (ku - 1) / 4 * s * s AS w FROM o), t AS (SELECT *, sqrt(greatest(w / (n - 1), 0)) * {evaluation.expected_max_sharpe(20, 1.0)!r}::DOUBLE AS thr FROM w),
z AS (SELECT *, (s - thr) * sqrt(n - 1) / sqrt(greatest(w, 1e-12)) AS z FROM t), y AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS u FROM z), x AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * {_TAIL} AS tail FROM y)
SELECT n, {_r('s', 'sharpe')}, {_r('s * sqrt(52)', 'sharpe_annual')}, {_r('thr', 'threshold')}, {_r('thr * sqrt(52)', 'threshold_annual')}, {_r('CASE WHEN z >= 0 THEN 1 - tail ELSE tail END', 'deflated')}, {_r('sk', 'skew', 5)}, {_r('ku', 'kurtosis', 4)} FROM x"""


@register("deflated_sharpe", _DSR)
def deflated_sharpe(spark, sf_dir):
    found = evaluation.deflated(cut(strategy(spark, sf_dir)), "net", 20, year=52)
    digits = {"skew": 5, "kurtosis": 4}
    return found.select("n", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("sharpe", "sharpe_annual", "threshold", "threshold_annual", "deflated", "skew", "kurtosis")])


_RF = "rates AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(avg(l_tax) / 1000, 9) AS rf FROM lineitem WHERE month(l_shipdate) % 2 = 0 GROUP BY 1)"


@register("market_risk_free", f"WITH {_MARKET}, {_RF} SELECT date, {_r('mkt_return', 'mkt_return', 9)}, {_r('coalesce(last_value(rf IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0)', 'rf_rate', 9)} FROM market LEFT JOIN rates USING (date)")
def market_risk_free(spark, sf_dir):
    """The mean tax of the weeks in every other month stands in for a rate with gaps."""
    rates = panel.table(spark, sf_dir, "lineitem").where(F.month("l_shipdate") % 2 == 0).groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(F.round(F.avg("l_tax") / 1000, 9).alias("rf"))
    return rounded(panel.with_risk_free(panel.market_returns(dense_bars(spark, sf_dir)), rates), ["mkt_return", "rf_rate"], 9, ("date",))


_ATTR = _EXPO[: _EXPO.index("ends AS (")] + f"""gr AS (SELECT 1 AS one, {', '.join([f"sum({_EXPO_X[a]} * {_EXPO_X[b]}) AS g{a}_{b}" for a in range(4) for b in range(a, 4)] + [f"sum({x} * net) AS h{a}" for a, x in enumerate(_EXPO_X)])} FROM j),
{elimination_sql('gr', 4, 'one')}, er AS (SELECT net, net - h0 - h1 * mkt - h2 * rev - h3 * vol AS e FROM j, e4)
SELECT {_r('any_value(h0) * 52', 'alpha', 5)}, {_r('any_value(h1)', 'mkt', 5)}, {_r('any_value(h2)', 'rev', 5)}, {_r('any_value(h3)', 'vol', 5)}, (SELECT round(1 - sum(e * e) / (var_pop(net) * count(*)), 6) FROM er) AS r_squared, (SELECT count(*)::DOUBLE FROM j) AS n FROM e4"""


@register("factor_attribution", _ATTR)
def factor_attribution(spark, sf_dir):
    found = evaluation.factor_regression(*strategy_factors(spark, sf_dir), ["mkt", "rev", "vol"], rf=None, year=52)
    row = [round(found[c]["coef"], 5) + 0.0 for c in ("alpha", "mkt", "rev", "vol")] + [round(found["fit"]["r_squared"], 6), found["fit"]["n"]]
    return spark.range(1, numPartitions=1).select(*[F.lit(v).alias(c) for c, v in zip(("alpha", "mkt", "rev", "vol", "r_squared", "n"), row, strict=True)])
