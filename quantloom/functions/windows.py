"""Window helpers: minimum counts, bias-corrected moments, exponential weights, runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Powers of e by which a mean decays within a block, and beyond which older values count for nothing.
DECAY, REACH = 300.0, 120.0
#: Speeds of the means that share their blocks: up to so many times the slowest.
SPREAD = 4.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def trailing(n: int) -> WindowSpec:
    """The last n calendar rows of the ticker, this one included."""
    return by_ticker().rowsBetween(-(n - 1), 0)


def with_least(value: Column, over: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` over the frame where at least so many rows of ``over`` are there."""
    return F.when(F.count(over).over(frame) >= least, value.over(frame))


def exponential_means(rows: DataFrame, means: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """Columns of recursive exponential means (value, alpha, least number of values) of each ticker's rows; those of similar speeds share five windows.

    The first value starts a mean; one that is g rows behind its predecessor weighs it by (1 - alpha)**g against alpha; a row without
    a value carries the mean on.  These steps are affine maps, so a mean is a sum of values scaled by a running product.  To keep the
    products in range they are taken within blocks of rows (of ``DECAY`` powers of e at the fastest mean), and the sums of the blocks
    before are added, as far as their weight is above e**-``REACH``.
    """
    slowest = min(alpha for _, alpha, _ in means.values())
    quick = {n: m for n, m in means.items() if math.log1p(-m[1]) < SPREAD * math.log1p(-slowest)}
    if quick:  # means of very unlike speeds need blocks of their own
        rows = exponential_means(rows, quick)
        made = exponential_means(rows, {n: m for n, m in means.items() if n not in quick})
        return made.select(*[c for c in rows.columns if c not in quick], *means)
    own, past, upto = by_ticker(), by_ticker().rowsBetween(Window.unboundedPreceding, -1), by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    speed = {n: -math.log1p(-alpha) for n, (_, alpha, _) in means.items()}
    size = max(1, int(DECAY / max(speed.values())))
    back = range(1, 2 + int(REACH / (size * min(speed.values()))))
    names, kept = list(means), rows.columns
    v = lambda n, what: F.col(f"_{what}_{n}")

    rows = rows.withColumns({f"_x_{n}": x.cast("double") for n, (x, _, _) in means.items()} | {"_k": F.row_number().over(own)})
    rows = rows.withColumns({f"_gap_{n}": F.col("_k") - F.last(F.when(v(n, "x").isNotNull(), F.col("_k")), True).over(past) for n in names} | {"_block": F.expr(f"_k div {size}")})
    step = {}
    for n, (_, alpha, _) in means.items():
        old = F.exp(v(n, "gap") * -speed[n])
        step[f"_log_{n}"] = F.when(v(n, "x").isNotNull() & v(n, "gap").isNotNull(), v(n, "gap") * -speed[n] - F.log(old + alpha)).otherwise(0.0)
        step[f"_add_{n}"] = F.when(v(n, "gap").isNull(), v(n, "x")).otherwise(v(n, "x") * alpha / (old + alpha))
    rows = rows.withColumns(step).withColumns({f"_sum_{n}": F.sum(v(n, "log")).over(upto) for n in names} | {f"_n_{n}": F.count(v(n, "x")).over(upto) for n in names})
    block = Window.partitionBy("ticker", "_block").orderBy("date")
    rows = rows.withColumns({f"_ref_{n}": F.first(F.when(v(n, "x").isNotNull(), v(n, "sum")), True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for n in names})
    rows = rows.withColumns({f"_u_{n}": v(n, "add") * F.exp(v(n, "ref") - v(n, "sum")) for n in names})
    rows = rows.withColumns({f"_in_{n}": F.sum(v(n, "u")).over(block.rowsBetween(Window.unboundedPreceding, 0)) for n in names})
    earlier = {j: Window.partitionBy("ticker").orderBy("_block").rangeBetween(-j, -j) for j in back}
    rows = rows.withColumns({f"_t{j}_{n}": F.sum(v(n, "u")).over(w) for n in names for j, w in earlier.items()} | {f"_r{j}_{n}": F.max(v(n, "ref")).over(w) for n in names for j, w in earlier.items()})
    out = {}
    for n, (_, _, least) in means.items():
        total = F.coalesce(v(n, "in") * F.exp(v(n, "sum") - v(n, "ref")), F.lit(0.0))
        for j in back:
            total = total + F.coalesce(v(n, f"t{j}") * F.exp(v(n, "sum") - v(n, f"r{j}")), F.lit(0.0))
        out[n] = F.when(v(n, "n") >= max(least, 1), total)
    return rows.select(*kept, *[c.alias(n) for n, c in out.items()])


def average_rank(c: str, keys: list[str]) -> Column:
    """Rank among the non-missing values of the keys' group, ties sharing their average."""
    own = Window.partitionBy(*keys, F.col(c).isNull())
    rank = F.rank().over(own.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, F.col(c).isNull(), c)) - 1) / 2
    return F.when(F.col(c).isNotNull(), rank)


def percent_rank(c: str, keys: list[str]) -> Column:
    """Average-tie rank over the number of values, minus a half."""
    return average_rank(c, keys) / F.count(c).over(Window.partitionBy(*keys)) - 0.5
