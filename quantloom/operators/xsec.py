"""Per-date normalisation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..functions.windows import percent_rank
from ..session import cut

#: Bytes of rows that a task orders by date at a time.
CHUNK = 1 << 26


def winsorize(rows: DataFrame, columns: list[str], q: float = 0.01, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Clip to the linear quantiles q and 1-q of the group."""
    if q <= 0:
        return rows
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.percentile(c, F.lit(1 - q)).over(w)), F.percentile(c, F.lit(q)).over(w))) for c in columns})


def zscore(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("date",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)) for c in columns})


def signal_zscore(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("date",), clip: float = 3.0, least: int = 5) -> DataFrame:
    """Scale by the population deviation and clip; missing values, constant groups and those under ``least`` values are 0."""
    w = Window.partitionBy(*keys)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    return rows.withColumns({c: F.coalesce(F.when(F.count(c).over(w) >= least, F.when(z(c).isNotNull(), F.greatest(F.least(z(c), F.lit(clip)), F.lit(-clip)))), F.lit(0.0)) for c in columns})


def rank(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("date",)) -> DataFrame:
    return rows.withColumns({c: percent_rank(c, list(keys)) for c in columns})


def normalise(rows: DataFrame, columns: list[str], method: str = "zscore", q: float = 0.01) -> DataFrame:
    """none, rank, or zscore (winsorised, scaled and clipped to 5)."""
    if method == "none":
        return rows
    if method == "rank":
        return rank(rows, columns)
    if method != "zscore":
        raise ValueError(f"unknown method {method!r}")
    return scale(rows, columns, date_stats(rows, columns, q))


def scale(rows: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """The columns clipped to their date's bounds, scaled and clipped to 5; ``stats`` has them first."""

    def scaled(k: int, c: str):
        low, high, mean, deviation = (F.col(f"_{name}")[k] for name in ("low", "high", "mean", "deviation"))
        return F.when(F.col(c).isNotNull() & (deviation > 0), F.greatest(F.least((F.greatest(F.least(F.col(c), high), low) - mean) / deviation, F.lit(5.0)), F.lit(-5.0))).alias(c)

    kept = [c for c in rows.columns if c not in columns]
    return rows.join(F.broadcast(stats.toDF("date", *[f"_{c}" for c in stats.columns[1:]])), "date").select(*kept, *[scaled(k, c) for k, c in enumerate(columns)])


def date_stats(rows: DataFrame, columns: list[str], q: float = 0.01, plain: tuple[str, ...] = ()) -> DataFrame:
    """Of each date, arrays over the columns and then the plain ones: number of values, linear quantiles q and 1 - q, mean and sample deviation of the values clipped to them.

    Plain columns are not clipped.  The quantiles are exact, and only tails are shuffled: every task sends the lowest and highest values of its rows, as many as their share of the tails
    and some; the last of them that the quantiles need is a bound beyond which no more are needed.  A second pass sends all values outside these bounds, ties as counts, and the moments of those between.
    The rows are read twice.
    """
    spark, names = rows.sparkSession, [*columns, *plain]
    values, n_columns = rows.select("date", *[F.col(c).cast("double").alias(c) for c in names]).where("date is not null"), len(columns)
    day = rows.schema["date"]
    bounds: dict = {}
    if q > 0 and columns:
        fields = StructType([day, StructField("n", BinaryType()), StructField("low", BinaryType()), StructField("high", BinaryType())])
        tails = values.select("date", *columns).mapInArrow(lambda batches: _tails(batches, q), fields)
        found = tails.groupBy("date").applyInArrow(lambda table: _bounds(table, n_columns, q), StructType([day, StructField("bounds", BinaryType())])).collect()  # a row a date
        bounds = {r["date"]: np.frombuffer(r["bounds"]).reshape(2, -1) for r in found}
    held = spark.sparkContext.broadcast(bounds)
    fields = StructType([day, *[StructField(c, BinaryType()) for c in ("middle", "sizes", "values", "counts")]])
    outer = values.mapInArrow(lambda batches: _outside(batches, held.value, n_columns), fields)
    arrays = StructType([day, *[StructField(c, ArrayType(LongType() if c == "n" else DoubleType())) for c in ("n", "low", "high", "mean", "deviation")]])
    return cut(outer.groupBy("date").applyInArrow(lambda table: _moments(table, len(names), n_columns if bounds else 0, q), arrays))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """(dates, each row's number among them, its values by column), ordered by date, of some megabytes of rows at a time."""

    def made(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        days = rows.column(0).dictionary_encode()
        codes = days.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        return days.dictionary, codes[order], [c.to_numpy(zero_copy_only=False).astype(float)[order] for c in rows.columns[1:]]

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > CHUNK:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _share(n: int, q: float) -> int:
    """How many of n values a task sends from a tail."""
    return min(n, math.ceil(q * n) + 3)


def _tails(batches: Iterator[pa.RecordBatch], q: float) -> Iterator[pa.RecordBatch]:
    for days, codes, columns in _chunks(batches):
        n = np.zeros((len(days), len(columns)), np.int64)
        low: list[list] = [[] for _ in days]
        high: list[list] = [[] for _ in days]
        for k, x in enumerate(columns):
            known = ~np.isnan(x)
            own, x = codes[known], x[known]
            n[:, k] = np.bincount(own, minlength=len(days))
            ends = np.append(0, np.cumsum(n[:, k]))
            for d in np.flatnonzero(n[:, k]):
                v, m = x[ends[d] : ends[d + 1]], _share(int(n[d, k]), q)
                if m < len(v):
                    v = np.partition(v, (m - 1, len(v) - m))
                low[d].append(v[:m])
                high[d].append(v[len(v) - m :])
        join = lambda parts: (np.concatenate(parts) if parts else np.zeros(0)).tobytes()
        yield pa.RecordBatch.from_arrays([days, pa.array([row.tobytes() for row in n], pa.binary()), *[pa.array([join(p) for p in side], pa.binary()) for side in (low, high)]], names=["date", "n", "low", "high"])


def _bounds(table: pa.Table, n_columns: int, q: float) -> pa.Table:
    """The bound of each column's lower and upper tail: as many values lie beyond as its quantile needs, or more."""
    sent: dict[str, list[list]] = {"low": [[] for _ in range(n_columns)], "high": [[] for _ in range(n_columns)]}
    total = np.zeros(n_columns, np.int64)
    for row in table.select(["n", "low", "high"]).to_pylist():
        n = np.frombuffer(row["n"], np.int64)
        ends = np.cumsum([_share(int(m), q) if m else 0 for m in n])[:-1]
        for side, columns in sent.items():
            for k, part in enumerate(np.split(np.frombuffer(row[side]), ends)):
                columns[k].append(part)
        total += n
    out = np.array([np.full(n_columns, -np.inf), np.full(n_columns, np.inf)])
    for k, n in enumerate(total.tolist()):
        if n:
            low, high = (np.concatenate(sent[side][k]) for side in ("low", "high"))
            below, above = min(n, math.floor((n - 1) * q) + 2), min(n, n - math.floor((n - 1) * (1 - q)))
            out[:, k] = np.partition(low, below - 1)[below - 1], np.partition(high, len(high) - above)[len(high) - above]
    return pa.table({"date": table.column("date").slice(0, 1), "bounds": pa.array([out.tobytes()], pa.binary())})


def _outside(batches: Iterator[pa.RecordBatch], bounds: dict, n_columns: int) -> Iterator[pa.RecordBatch]:
    """By date: number, mean and squares of the values between the bounds, number of those up to the lower one; the distinct values beyond and their counts."""
    for days, codes, columns in _chunks(batches):
        size = len(days)
        edges = [bounds.get(d) for d in days.to_pylist()]
        middle, sizes = np.zeros((size, len(columns), 4)), np.zeros((size, len(columns)), np.int32)
        values: list[list] = [[] for _ in days]
        counts: list[list] = [[] for _ in days]
        for k, x in enumerate(columns):
            known = ~np.isnan(x)
            own, x = codes[known], x[known]
            if k < n_columns and bounds:
                low, high = (np.array([e[side, k] for e in edges])[own] for side in (0, 1))
                out = (x <= low) | (x >= high)
                middle[:, k, 3] = np.bincount(own, x <= low, size)
                beyond, at = x[out], own[out]
                order = np.lexsort((beyond, at))
                beyond, at = beyond[order], at[order]
                first = np.flatnonzero(np.append(len(at) > 0, (beyond[1:] != beyond[:-1]) | (at[1:] != at[:-1]))[: len(at)])
                times, beyond, at = np.diff(np.append(first, len(at))), beyond[first], at[first]
                sizes[:, k] = np.bincount(at, minlength=size)
                ends = np.append(0, np.cumsum(sizes[:, k]))
                for d in np.flatnonzero(sizes[:, k]):
                    values[d].append(beyond[ends[d] : ends[d + 1]])
                    counts[d].append(times[ends[d] : ends[d + 1]])
                own, x = own[~out], x[~out]
            n = np.bincount(own, minlength=size)
            near = np.zeros(size)
            near[own] = x  # some value of the date, so that equal ones have no deviation
            mean = near + np.bincount(own, x - near[own], size) / np.maximum(n, 1)
            middle[:, k, :3] = np.column_stack([n, mean, np.bincount(own, (x - mean[own]) ** 2, size)])
        join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()
        packed = [[m.tobytes() for m in middle], [s.tobytes() for s in sizes], [join(v, "<f8") for v in values], [join(c, "<i8") for c in counts]]
        yield pa.RecordBatch.from_arrays([days, *[pa.array(p, pa.binary()) for p in packed]], names=["date", "middle", "sizes", "values", "counts"])


def _moments(table: pa.Table, n_all: int, n_columns: int, q: float) -> pa.Table:
    parts = [(np.frombuffer(r["middle"]).reshape(n_all, 4), np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["values"]), np.frombuffer(r["counts"], np.int64)) for r in table.select(["middle", "sizes", "values", "counts"]).to_pylist()]
    cuts = [np.cumsum(p[1])[:-1] for p in parts]
    split = [(np.split(p[2], c), np.split(p[3], c)) for p, c in zip(parts, cuts, strict=True)]
    middles = np.stack([p[0] for p in parts])
    out: dict[str, list] = {"n": [], "low": [], "high": [], "mean": [], "deviation": []}
    for k in range(n_all):
        n, mean, squares, lower = middles[:, k].T
        between = int(n.sum())
        x, times = np.concatenate([s[0][k] for s in split]), np.concatenate([s[1][k] for s in split])
        order = np.argsort(x)
        x, times = x[order], times[order]
        total = between + int(times.sum())
        low, high = -math.inf, math.inf
        if k < n_columns and total:
            upto, below = np.cumsum(times), int(lower.sum())  # the values between come after so many

            def nth(j: int) -> float:
                return float(x[np.searchsorted(upto, j if not between or j < below else j - between, side="right")])

            def quantile(share: float) -> float:
                at = (total - 1) * share
                j = math.floor(at)
                first, second = nth(j), nth(min(j + 1, total - 1))
                return first + (at - j) * (second - first)

            low, high = quantile(q), quantile(1 - q)
        # Sums of differences from a value in between, so that equal values have no deviation.
        x = np.maximum(np.minimum(x, high), low)
        near = float(x[0]) if len(x) else float(mean[n > 0][0]) if between else 0.0
        centre = near + (float((n * (mean - near))[n > 0].sum()) + float((times * (x - near)).sum())) / max(total, 1)
        spread = float((squares + n * (mean - centre) ** 2)[n > 0].sum()) + float((times * (x - centre) ** 2).sum())
        out["n"].append(total)
        out["low"].append(low if total else None)
        out["high"].append(high if total else None)
        out["mean"].append(centre if total else None)
        out["deviation"].append(math.sqrt(spread / (total - 1)) if total > 1 else None)
    kind = {"n": pa.int64()}
    return pa.table({"date": table.column("date").slice(0, 1)} | {c: pa.array([v], pa.list_(kind.get(c, pa.float64()))) for c, v in out.items()})


def neutralise(rows: DataFrame, columns: list[str], group: str = "sector") -> DataFrame:
    w = Window.partitionBy("date", group)
    return rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
