"""Moments over the last rows of a name, by array kernels: rows come ordered by name and date, in batches, and the rows a frame reaches back to are carried on.

Spark's sliding frames add every row of a frame to every aggregate anew, a call each; here a frame of n rows is n sums of whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .windows import by_ticker

#: (a row's number in its name, values by column) to values by column.
Kernel = Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def frame_sums(place: np.ndarray, n: int, x: np.ndarray, y: np.ndarray | None = None, powers: int = 2) -> tuple[np.ndarray, ...]:
    """Of each row's frame (the last n rows of its name; NaN is missing): the number of values, their mean, and sums of powers 2.. of the differences from it.

    ``x`` has n - 1 rows more in front.  With ``y`` rows need both: number, both means and the sum of products.
    """
    m = len(place)
    known = ~np.isnan(x) if y is None else ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(known, x, 0.0), None if y is None else np.where(known, y, 0.0)
    parts = [(slice(n - 1 - k, n - 1 - k + m), place >= k) for k in range(n)]
    count, sums = np.zeros(m), [np.zeros(m) for v in (x, y) if v is not None]
    for at, own in parts:
        count += known[at] & own
        for total, v in zip(sums, (x, y), strict=False):
            total += v[at] * own
    means = [total / np.maximum(count, 1) for total in sums]
    if powers < 2:
        return (count, *means)
    moments = [np.zeros(m) for _ in range(1 if y is not None else powers - 1)]
    for at, own in parts:
        d = (x[at] - means[0]) * (known[at] & own)
        power = d
        for k, total in enumerate(moments):
            power = power * (d if y is None else y[at] - means[1])
            moments[k] = total + power
    return (count, *means, *moments)


def frame_ends(place: np.ndarray, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's frame as in ``frame_sums``: the number of values, the lowest and the highest; NaN where there is none."""
    m = len(place)
    count, low, high = np.zeros(m), np.full(m, np.nan), np.full(m, np.nan)
    for k in range(n):
        v = np.where(place >= k, x[n - 1 - k : n - 1 - k + m], np.nan)
        count += ~np.isnan(v)
        low, high = np.fmin(low, v), np.fmax(high, v)
    return count, low, high


def exponential(place: np.ndarray, x: np.ndarray, alpha: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The means of ``windows.exponential_means`` of some series (a row each): (mean, weight, number of values) of each row, by its number in its name.

    ``state`` is that of the row before the first.  The rows of all names are taken together, one place after the other.
    """
    m = len(place)
    out, alpha = np.empty((3, len(x), m)), alpha[:, None]
    starts = np.flatnonzero((place == 0) | (np.arange(m) == 0))
    lengths = np.diff(np.append(starts, m))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    mean, weight, count = np.zeros((3, len(x), len(starts)))
    if place[0] > 0:
        own = int(np.flatnonzero(starts == 0)[0])
        mean[:, own], weight[:, own], count[:, own] = state
    for j in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -j, side="left"))  # names with more rows than j
        at = starts[:live] + j
        v, old = x[:, at], weight[:, :live] * (1 - alpha)
        known = ~np.isnan(v)
        blend = np.where(count[:, :live] > 0, (old * mean[:, :live] + alpha * v) / (old + alpha), v)
        mean[:, :live] = np.where(known, blend, mean[:, :live])
        weight[:, :live] = np.where(known, 1.0, old)
        count[:, :live] += known
        out[:, :, at] = mean[:, :live], weight[:, :live], count[:, :live]
    return out


def by_frames(rows: DataFrame, inputs: list[str], outputs: list[str], reach: int, kernel: Kernel, kept: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``outputs``: ``kernel(place, values)`` of each batch.

    ``place`` is a row's number in its name, from 0; ``values`` are the inputs, NaN where missing, with the ``reach`` rows before in front, and so the
    outputs named in ``kept``, of which only the rows before are known.  Rows that are dealt and ordered by name already stay where they are.
    """
    fields = StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in outputs]])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {c: np.full(reach, np.nan) for c in (*inputs, *kept)}
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            place = batch.column(len(names)).to_numpy() - 1
            values = {c: np.concatenate([before[c], batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float)]) for c in inputs}
            with np.errstate(all="ignore"):
                made = kernel(place, values | {c: before[c] for c in kept})
            for c in before:
                before[c] = (values[c] if c in values else np.concatenate([before[c], made[c]]))[m:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(made[c], pa.float64(), mask=np.isnan(made[c])) for c in outputs]], names=fields.names)

    # The window deals and orders rows by name where they aren't yet; a repartition would move them in any case.
    return rows.withColumn("_row", F.row_number().over(by_ticker())).mapInArrow(run, fields)
