"""Panels: rows of (ticker, date) with open, high, low, close, volume, dollar_volume and sector.

Missing values are NULL, never NaN.  ``dense`` adds the absent (date, ticker) cells, so that row-based
windows count calendar rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICE_COLUMNS = ("open", "high", "low", "close", "volume", "dollar_volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem", size: int = 4 << 20) -> int:
    """Partitions that a panel of a table is dealt into: one for ``size`` bytes of its files, so that what a task sorts does not grow with the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(1, -(-found // size), spark.sparkContext.defaultParallelism if found > 1 << 20 else 1)


def week() -> Column:
    return F.trunc(F.to_date("l_shipdate"), "week").alias("date")


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the bars."""
    return table(spark, sf_dir, "lineitem").select(week()).distinct()


def bars(spark: SparkSession, sf_dir: str, parts: int | None = None, sectors: bool = True) -> DataFrame:
    """Weekly supplier bars from line items; close is the volume-weighted price. One shuffle, on (supplier, week).

    With ``parts`` it deals suppliers into so many partitions, which whatever goes on by ticker keeps.  Without ``sectors`` these are missing.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), week(), "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    if parts:
        line = line.repartition(parts, "ticker")
    line = line.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))  # after the shuffle, which needn't carry it
    agg = line.groupBy("ticker", "date").agg(
        F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price")).getField("price").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    if not sectors:
        return agg.withColumns({"sector": F.lit(None).cast("string"), "dollar_volume": F.col("close") * F.col("volume")})
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))
    return agg.join(place, "ticker", "left").withColumn("dollar_volume", F.col("close") * F.col("volume"))


def daily_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily brand bars: a sparse panel of few tickers."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")), "l_partkey")
    line = line.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    agg = line.groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "price")).getField("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return agg.withColumns({"sector": F.lit("all"), "dollar_volume": F.col("close") * F.col("volume")})


def normalise_vendor(raw: DataFrame, ticker: str | None = None, arrival: str | None = None) -> DataFrame:
    """Vendor rows to panel rows: lower-case names with underscores, adj_close where close is missing, one row a day (the last by ``arrival``), close above 0, volume at least 0."""
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    if "close" not in raw.columns and "adj_close" in raw.columns:
        raw = raw.withColumnRenamed("adj_close", "close")
    lacking = {"date", "open", "high", "low", "close", "volume"} - set(raw.columns)
    if lacking:
        raise ValueError(f"missing columns: {sorted(lacking)}")
    if ticker is not None:
        raw = raw.withColumn("ticker", F.lit(ticker))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    order = F.col(arrival).desc() if arrival else F.monotonically_increasing_id().desc()
    rows = raw.withColumn("turn", F.row_number().over(Window.partitionBy("ticker", F.to_date("date")).orderBy(order))).where("turn = 1")
    rows = rows.select("ticker", F.to_date("date").alias("date"), *[number(c) for c in ("open", "high", "low", "close", "volume")])
    return rows.where("close > 0 and volume >= 0")


def clean_ticker(c: str) -> F.Column:
    """Trimmed, upper case, without white space, dots as hyphens."""
    return F.translate(F.upper(F.regexp_replace(F.trim(F.col(c)), r"\s+", "")), ".", "-")


def valid_ticker(c: str) -> F.Column:
    return F.col(c).rlike("^[A-Z][A-Z0-9-]{0,5}$")


def membership(current: DataFrame, changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(date, ticker) members at each snapshot: today's state, with all changes after the snapshot undone.

    ``changes`` has date, added, removed. A ticker's state at a snapshot is the opposite of the first change after it, and today's state where there is none.
    """
    events = changes.select("date", F.explode(F.array(F.struct(F.col("added").alias("ticker"), F.lit(False).alias("before")), F.struct(F.col("removed").alias("ticker"), F.lit(True).alias("before")))).alias("e")).select("date", "e.*").where("ticker is not null")
    names = current.select("ticker").union(events.select("ticker")).distinct()
    grid = names.crossJoin(F.broadcast(snapshots.select(F.col("date").alias("snapshot")).distinct()))
    later = grid.join(events.withColumnRenamed("ticker", "t"), (F.col("ticker") == F.col("t")) & (F.col("date") > F.col("snapshot")), "left")
    state = later.groupBy("snapshot", "ticker").agg(F.min_by("before", F.struct("date", "before")).alias("before"))
    state = state.join(current.select("ticker", F.lit(True).alias("today")), "ticker", "left")
    return state.where(F.coalesce("before", "today", F.lit(False))).select(F.col("snapshot").alias("date"), "ticker")


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file; comments and blank lines are left out."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("raw")).where("raw <> ''")
    return rows.select(clean_ticker("raw").alias("ticker")).distinct()


def resolve_universe(kind: str, file: DataFrame | None = None, current: DataFrame | None = None, changes: DataFrame | None = None, snapshots: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(tickers, membership by date): of a ticker file, of an index's members today, or of all its members at the snapshots."""
    if kind == "file" and file is not None:
        return file.select("ticker").distinct(), None
    if kind == "index" and current is not None:
        return current.select("ticker").distinct(), None
    if kind == "index_pit" and current is not None and changes is not None and snapshots is not None:
        members = membership(current, changes, snapshots)
        return members.select("ticker").distinct(), members
    raise ValueError(f"unknown universe {kind!r}, or its tables are missing")


def factor_file(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Factor returns of a text file with a preamble: rows that start with eight digits, in percent."""
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d{8}\s*,"))
    parts = F.split(F.trim("value"), r"\s*,\s*")
    return rows.select(F.to_date(parts[0], "yyyyMMdd").alias("date"), *[(parts[i + 1].cast("double") / 100).alias(n) for i, n in enumerate(names)])


def factor_returns(factors: DataFrame, momentum: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily factor returns with the momentum factor (date, mom) beside them where it has the date, within a range of dates."""
    rows = factors if momentum is None else factors.join(momentum.select("date", "mom"), "date", "left")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows


def with_risk_free(market: DataFrame, factors: DataFrame | None = None, rf: str = "rf", flat: float = 0.02 / 252) -> DataFrame:
    """The market with rf_rate: the factors' on its dates, the last known one after gaps, 0 before the first; the flat rate without factors. A row a date."""
    if factors is None:
        return market.withColumn("rf_rate", F.lit(flat))
    rows = market.join(factors.select("date", F.col(rf).alias("_rf")), "date", "left")
    known = F.last("_rf", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("rf_rate", F.coalesce(known, F.lit(0.0))).drop("_rf")


def trading_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Business days without the holidays (column date)."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval 1 day)) as date").where(F.dayofweek("date").between(2, 6))
    return days.join(holidays, "date", "left_anti") if holidays is not None else days


def benchmark_returns(prices: DataFrame) -> DataFrame:
    """date and simple return of one symbol's closes, without the first."""
    close = F.col("close")
    return prices.select("date", (F.try_divide(close, F.lag(close).over(Window.orderBy("date"))) - 1).alias("mkt_return")).na.drop()


def dense(panel: DataFrame, parts: int | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Every (date, ticker) cell; absent ones have NULL prices. With ``parts`` names are dealt into so many partitions; ``dates`` is the calendar, if it is known.

    A row stands for the absent dates up to the name's next row (the first also for those before it), so rows move once, by name, and nothing
    is joined but the calendar, which is broadcast: it has one row a date.
    """
    days = (panel.select("date").distinct() if dates is None else dates).select(F.col("date").alias("_date"))
    days = days.select("_date", F.row_number().over(Window.orderBy("_date")).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_days"))
    rows = panel.repartition(parts, "ticker") if parts else panel
    rows = rows.join(F.broadcast(days), F.col("date").eqNullSafe(F.col("_date")))
    own = Window.partitionBy("ticker").orderBy("_k")
    rows = rows.withColumns({
        "_from": F.when(F.lag("_k").over(own).isNull(), 1).otherwise(F.col("_k")),
        "_to": F.greatest(F.coalesce(F.lead("_k").over(own) - 1, F.col("_days").cast("int")), "_k"),
        "sector": F.max("sector").over(Window.partitionBy("ticker")),
    })
    rows = rows.drop("_date", "_days").withColumn("_at", F.explode(F.sequence("_from", "_to")))
    here = (F.col("_at") == F.col("_k")) & F.col("date").isNotNull() & F.col("ticker").isNotNull()
    cells = rows.join(F.broadcast(days.select("_date", F.col("_k").alias("_at"))), "_at")
    return cells.select("ticker", F.col("_date").alias("date"), "sector", *[F.when(here, F.col(c)).alias(c) for c in panel.columns if c not in ("ticker", "date", "sector")])


def tail_dates(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the last n distinct dates; the cutoff is a literal, so parquet readers get it pushed down."""
    first = rows.select("date").distinct().orderBy(F.desc("date")).limit(n).agg(F.min("date")).first()[0]
    return rows.where(F.col("date") >= F.lit(first)) if first is not None else rows.limit(0)


def market_returns(panel_dense: DataFrame) -> DataFrame:
    """date and mkt_return: the mean over tickers of the gap-filled simple return."""
    return filled_returns(panel_dense.select("ticker", "date", "close")).groupBy("date").agg(F.avg("r").alias("mkt_return"))


def filled_returns(panel_dense: DataFrame) -> DataFrame:
    """The rows with r, the simple return of the gap-filled close."""
    last = lambda upto: F.last("close", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, upto))
    return panel_dense.withColumn("r", F.try_divide(last(0), last(-1)) - 1)
