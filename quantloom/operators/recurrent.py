"""Recurrent rankers: a GRU or LSTM over the last rows of a name, trained by gradients that tasks compute in numpy and Spark sums.

The rows get their sequences in one shuffle by name and are written once, in slices (batches) by a hash of (date, ticker).  An epoch lays them out in the order of its steps, in
groups of some megabytes.  Steps follow on each other, so a group of cheap steps (``ALONE``) is one task that hands its state on by the
driver; where a step is dear, every task runs its rows of it forward and back through time and returns one gradient, and an aggregate by parameter adds
these up.  Either way the driver gets as many numbers as the model has, whatever the rows.  Batches, their order and the start
values follow from the seed.  With a ``folder`` the state is written after each epoch, and a fit that is started again goes on from there.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..session import cut, shared_folder

GATES = {"gru": 3, "lstm": 4}
#: Part of the steps that the rate rises, its first and last value as parts of the highest, decay of Adam's moments.
RISE, FIRST, LAST, BETA1, BETA2 = 0.3, 1 / 25, 1 / 250000, 0.9, 0.999
#: Products with a weight by step up to which steps are taken in one task (some hundredths of a second), and bytes of sequences in a group of steps.
ALONE, GROUP = 2e8, 1 << 27
#: Sequences that are taken forward and back at a time: what they need stays in a core's cache.
TOGETHER = 512


def shapes(kind: str, inputs: int, hidden: int) -> dict[str, tuple[int, ...]]:
    g, half = GATES[kind] * hidden, max(1, hidden // 2)
    return {"wx": (inputs, g), "wh": (hidden, g), "bx": (g,), "bh": (g,), "scale": (hidden,), "shift": (hidden,), "w1": (hidden, half), "b1": (half,), "w2": (half, 1), "b2": (1,)}


def split(flat: np.ndarray, shape: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, s in shape.items():
        n = math.prod(s)
        out[name], at = flat[at : at + n].reshape(s), at + n
    return out


def started(kind: str, inputs: int, hidden: int, seed: int) -> np.ndarray:
    rng, shape, out = np.random.default_rng(seed), shapes(kind, inputs, hidden), []
    for name, s in shape.items():
        bound = 1 / math.sqrt(hidden if name in ("wx", "wh", "bx", "bh", "w1", "b1") else max(1, hidden // 2))
        out.append(np.ones(s).ravel() if name == "scale" else np.zeros(s).ravel() if name == "shift" else rng.uniform(-bound, bound, math.prod(s)))
    return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tanh form of the Gaussian error unit, and its slope."""
    c = math.sqrt(2 / math.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)


def _gru_weights(p: dict[str, np.ndarray]) -> np.ndarray:
    """One matrix for (inputs, 1, state): rows of the gates r and z, of the new state's part from the inputs, of its part from the state."""
    size, inputs = len(p["wh"]), len(p["wx"])
    two = 2 * size
    out = np.zeros((4 * size, inputs + 1 + size))
    out[: 3 * size, :inputs] = p["wx"].T
    out[: 3 * size, inputs] = p["bx"]
    out[:two, inputs] += p["bh"][:two]
    out[3 * size :, inputs] = p["bh"][two:]
    out[:two, inputs + 1 :], out[3 * size :, inputs + 1 :] = p["wh"][:, :two].T, p["wh"][:, two:].T
    return out


def forward(kind: str, p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Outputs of sequences x (rows, steps, inputs) and what ``backward`` needs.  Rows are the last axis within, so that numpy's inner loops are long."""
    n, steps, inputs = x.shape
    size, kept = len(p["wh"]), []
    if kind == "gru":
        weights, given = _gru_weights(p), np.empty((steps + 1, inputs + 1 + size, n))  # inputs, 1 and state of a step
        given[:steps, :inputs], given[:, inputs], given[0, inputs + 1 :] = x.transpose(1, 2, 0), 1, 0
        for t in range(steps):
            at = weights @ given[t]
            gates, m, b = at[: 2 * size], at[2 * size : 3 * size], at[3 * size :]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            m += gates[:size] * b
            np.tanh(m, out=m)
            off = given[t, inputs + 1 :] - m
            h = given[t + 1, inputs + 1 :]
            np.multiply(gates[size:], off, out=h)
            h += m
            kept.append((at, off))
        x = given
    else:
        x = np.ascontiguousarray(x.transpose(1, 2, 0))
        bx, bh = p["bx"][:, None], p["bh"][:, None]
        h, c = np.zeros((size, n)), np.zeros((size, n))
        for t in range(steps):
            a, b = p["wx"].T @ x[t] + bx, p["wh"].T @ h + bh
            i, f, o = (_sigmoid((a + b)[k * size : (k + 1) * size]) for k in (0, 1, 3))
            g = np.tanh((a + b)[2 * size : 3 * size])
            new = f * c + i * g
            kept.append((h, c, i, f, g, o, np.tanh(new)))
            c, h = new, o * np.tanh(new)
    centred = h - h.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0) + 1e-5)
    unit = centred / spread
    normed = unit * p["scale"][:, None] + p["shift"][:, None]
    act, slope = _gelu(p["w1"].T @ normed + p["b1"][:, None])
    return (p["w2"].T @ act + p["b2"][:, None])[0], (x, kept, unit, spread, normed, act, slope)


def backward(kind: str, p: dict[str, np.ndarray], x: np.ndarray, state: tuple, d_out: np.ndarray, truncate: int | None = None) -> np.ndarray:
    """The gradient, flat, for slopes ``d_out`` of the loss by the outputs; back through ``truncate`` steps at most."""
    x, kept, unit, spread, normed, act, slope = state
    size = len(p["wh"])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = d_out[None, :]
    g["w2"], g["b2"] = act @ d.T, d.sum(axis=1)
    d = p["w2"] @ d * slope
    g["w1"], g["b1"] = normed @ d.T, d.sum(axis=1)
    d = p["w1"] @ d
    g["scale"], g["shift"] = (d * unit).sum(axis=1), d.sum(axis=1)
    d = d * p["scale"][:, None]
    dh = (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0)) / spread
    dc = np.zeros_like(dh)
    back = reversed(range(max(0, len(kept) - (truncate or len(kept))), len(kept)))
    if kind == "gru":
        inputs, two = len(p["wx"]), 2 * size
        by_state = np.ascontiguousarray(_gru_weights(p)[:, inputs + 1 :].T)
        total, slopes = np.zeros((4 * size, inputs + 1 + size)), np.empty((4 * size, dh.shape[1]))
        for t in back:
            at, off = kept[t]
            gates, m, b = at[:two], at[two : 3 * size], at[3 * size :]
            r, z = gates[:size], gates[size:]
            curve = 1 - gates
            dm = slopes[two : 3 * size]
            np.multiply(m, m, out=dm)
            np.subtract(1, dm, out=dm)
            dm *= curve[size:]
            dm *= dh
            curve *= gates
            np.multiply(dm, r, out=slopes[3 * size :])
            np.multiply(dm, b, out=slopes[:size])
            np.multiply(dh, off, out=slopes[size:two])
            slopes[:two] *= curve
            total += slopes @ x[t].T
            dh = dh * z
            dh += by_state @ slopes
        g["wx"][:], g["bx"][:] = total[: 3 * size, :inputs].T, total[: 3 * size, inputs]
        for name, columns in (("bh", inputs), ("wh", slice(inputs + 1, None))):
            g[name][..., :two], g[name][..., two:] = total[:two, columns].T, total[3 * size :, columns].T
        return np.concatenate([v.ravel() for v in g.values()])
    for t in back:
        h, c, i, f, o_g, o, tc = kept[t]
        dc = dc + dh * o * (1 - tc * tc)
        da = db = np.concatenate([dc * o_g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - o_g * o_g), dh * tc * o * (1 - o)])
        dc, dh = dc * f, p["wh"] @ db
        g["wx"] += x[t] @ da.T
        g["bx"] += da.sum(axis=1)
        g["wh"] += h @ db.T
        g["bh"] += db.sum(axis=1)
    return np.concatenate([v.ravel() for v in g.values()])


def _arrays(batch: pa.RecordBatch, length: int, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(batch.column(0), length, inputs), batch.column(1).to_numpy()


def _unpacked(column: pa.Array, length: int, inputs: int) -> np.ndarray:
    """The sequences of a column of packed ones, without a copy."""
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, "<f8", len(column) * length * inputs, first).reshape(-1, length, inputs)


def _sequenced(batches: Iterator[pa.RecordBatch], kept: int, length: int, first: int, days: int) -> Iterator[pa.RecordBatch]:
    """Of rows by name (kept columns, name, day, whether wanted, features): the wanted rows' kept columns and the packed cells of their last ``length`` days.

    Days begin at ``first`` and there are so many.  Absent cells are 0, and days before the first have its cells.
    """

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        name, day, wanted = (rows.column(kept + k).to_numpy(zero_copy_only=False) for k in range(3))
        block = np.cumsum(np.append(False, name[1:] != name[:-1]))
        given = np.flatnonzero(~wanted)
        cells = np.zeros((block[-1] + 1, length - 1 + days, rows.num_columns - kept - 3))
        known = np.zeros(block[-1] + 1, bool)
        known[block[given]] = True
        for k in range(cells.shape[2]):
            cells[block[given], length - 1 + day[given] - first, k] = rows.column(kept + 3 + k).to_numpy(zero_copy_only=False)[given]
        cells[:, : length - 1] = cells[:, length - 1 : length]
        taken = np.flatnonzero(wanted & known[block])
        flat = np.ascontiguousarray(sliding_window_view(cells, length, axis=1)[block[taken], day[taken] - first].transpose(0, 2, 1), "<f8")
        ends = np.arange(len(taken) + 1, dtype=np.int32) * (flat.nbytes // max(1, len(taken)))
        packed = pa.Array.from_buffers(pa.binary(), len(taken), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([*[rows.column(k).take(pa.array(taken)) for k in range(kept)], packed], names=[*rows.schema.names[:kept], "x"])

    held: list[pa.RecordBatch] = []  # of the last name
    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column(kept).to_numpy(zero_copy_only=False)
        if held and held[-1].column(kept)[-1].as_py() != batch.column(kept)[0].as_py():
            yield made(held)
            held = []
        last = int(np.flatnonzero(np.append(True, name[1:] != name[:-1]))[-1])
        if last:
            yield made([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield made(held)


def stepped(step: int, gradient: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray], rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, first, second moment) after a step of Adam along a mean gradient, which is clipped to length 1."""
    flat, first, second = state
    gradient = gradient * min(1.0, 1.0 / (np.linalg.norm(gradient) + 1e-6))
    first, second = BETA1 * first + (1 - BETA1) * gradient, BETA2 * second + (1 - BETA2) * gradient**2
    return flat * (1 - rate * decay) - rate * (first / (1 - BETA1 ** (step + 1))) / (np.sqrt(second / (1 - BETA2 ** (step + 1))) + 1e-8), first, second


@dataclass
class Recurrent:
    """A GRU or LSTM with a small head on its last state; targets are scaled by their deviation, the loss is Huber's.

    The last ``stop_share`` of rows in time decides when to stop, where it has 500 rows.  ``panel`` holds the rows that sequences are taken from
    (else those given to ``fit`` and ``predict``): missing cells are 0, and a sequence that begins before the calendar repeats its first row.
    """

    features: list[str]
    kind: str = "gru"
    length: int = 40
    hidden: int = 64
    batch: int = 1024
    epochs: int = 6
    rate: float = 1e-3
    decay: float = 1e-5
    patience: int = 2
    stop_share: float = 0.12
    truncate: int | None = None
    seed: int = 0
    folder: str | None = None
    panel: DataFrame | None = None
    weights: np.ndarray | None = None
    scale: float = 1.0
    losses: list[float] = field(default_factory=list)

    def __deepcopy__(self, memo: dict) -> Recurrent:
        return copy.copy(self)

    def with_sequences(self, rows: DataFrame) -> DataFrame:
        """The rows with x, the packed cells of their sequences.  One shuffle, by name, of these rows and of the source's from the first day that they reach back to."""
        source = (self.panel if self.panel is not None else rows).select("date", "ticker", *self.features)
        field = source.schema["date"]
        days = sorted(r[0] for r in source.select("date").distinct().collect() if r[0] is not None)  # the calendar has a row a date
        calendar = rows.sparkSession.createDataFrame(list(zip(days, range(len(days)), strict=True)), StructType([StructField("date", field.dataType), StructField("_day", IntegerType())]))
        earliest = rows.join(F.broadcast(calendar), "date").agg(F.min("_day")).first()[0]
        first, length, columns = max(0, (earliest or 0) - self.length + 1), self.length, rows.columns
        name = F.col("ticker").alias("_name")
        given = source.na.fill(0.0, self.features).join(F.broadcast(calendar.where(F.col("_day") >= first)), "date").where("ticker is not null")
        given = given.select(*[F.lit(None).cast(f.dataType).alias(f"_{k}") for k, f in enumerate(rows.schema.fields)], name, "_day", F.lit(False).alias("_wanted"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(self.features)])
        wanted = rows.join(F.broadcast(calendar), "date").where("ticker is not null")
        wanted = wanted.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)], name, "_day", F.lit(True).alias("_wanted"), *[F.lit(0.0).alias(f"_x{k}") for k in range(len(self.features))])
        kept, span = len(columns), len(days) - first
        fields = StructType([*[StructField(f"_{k}", f.dataType) for k, f in enumerate(rows.schema.fields)], StructField("x", BinaryType())])
        both = given.union(wanted).repartition("_name").sortWithinPartitions("_name")
        return both.mapInArrow(lambda batches: _sequenced(batches, kept, length, first, span), fields).toDF(*columns, "x")

    def fit(self, rows: DataFrame, target: str) -> Recurrent:
        spark = rows.sparkSession
        live = cut(rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select("date", "ticker", F.col(target).cast("double").alias("y")))
        days = live.where("date is not null").groupBy("date").count().orderBy("date").collect()  # a row a date
        held, hold = self._held(live, days)
        stats = live.withColumn("hold", hold)
        known = stats.where("not hold").agg(F.stddev_pop("y").alias("sd"), F.count("*").alias("n")).first()
        if not known["n"]:
            raise ValueError("no training rows")
        self.scale = known["sd"] or 1.0
        batches = max(1, known["n"] // self.batch)
        own = self if self.panel is not None else copy.copy(self)
        own.panel = self.panel if self.panel is not None else rows
        slice_ = F.when(F.col("hold"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("date", "ticker", F.lit(self.seed)), F.lit(batches)).cast("int"))
        data = own.with_sequences(stats.select("date", "ticker", (F.col("y") / self.scale).alias("y"), slice_.alias("slice"))).select("x", "y", "slice")
        path = f"{shared_folder(spark)}/sequences-{uuid4()}"
        data.withColumn("hold", F.col("slice") < 0).write.partitionBy("hold").parquet(f"{path}/rows")
        data = spark.read.schema("x binary, y double, slice int, hold boolean").parquet(f"{path}/rows")
        together = max(1, GROUP // (8 * self.batch * self.length * len(self.features)))
        alone = self.batch * self.length * sum(math.prod(shapes(self.kind, len(self.features), self.hidden)[k]) for k in ("wx", "wh")) <= ALONE
        size = len(started(self.kind, len(self.features), self.hidden, self.seed))
        flat, first, second = started(self.kind, len(self.features), self.hidden, self.seed), np.zeros(size), np.zeros(size)
        best, best_loss, bad, epoch = flat, math.inf, 0, 0
        self.losses = []
        if self.folder and (found := self._state(spark)):
            flat, first, second, best = (np.array(found[k]) for k in ("flat", "first", "second", "best"))
            best_loss, bad, epoch, self.losses = found["best_loss"], found["bad"], found["epoch"], list(found["losses"])
        while epoch < self.epochs and bad < self.patience:
            self._ordered(data, batches, epoch, together, f"{path}/epoch-{epoch}")
            rates = [self.rate * cycle(step, batches * self.epochs) for step in range(epoch * batches, (epoch + 1) * batches)]
            for at in range(0, batches, together):
                steps = range(at, min(at + together, batches))
                folder = f"{path}/epoch-{epoch}/group={at // together}"
                if not self._exists(spark, folder):  # no slice of these has rows
                    continue
                group = spark.read.schema("x binary, y double, step int").parquet(folder)
                if alone:
                    flat, first, second = self._chained(group, (flat, first, second), epoch * batches, {k: rates[k] for k in steps})
                    continue
                for k in steps:
                    gradient, _, n = self._gradient(group.where(F.col("step") == k), flat)
                    if n:
                        flat, first, second = stepped(epoch * batches + k, gradient / n, (flat, first, second), rates[k], self.decay)
            self._delete(spark, f"{path}/epoch-{epoch}")
            epoch += 1
            if held:
                _, loss, n = self._gradient(data.where("hold"), flat, loss_only=True)
                self.losses.append(loss / n)
                if self.losses[-1] < best_loss - 1e-7:
                    best, best_loss, bad = flat, self.losses[-1], 0
                else:
                    bad += 1
            else:
                best = flat
            if self.folder:
                row = [(epoch, bad, float(best_loss), flat.tolist(), first.tolist(), second.tolist(), best.tolist(), self.losses)]
                spark.createDataFrame(row, "epoch int, bad int, best_loss double, flat array<double>, first array<double>, second array<double>, best array<double>, losses array<double>").write.mode("overwrite").parquet(f"{self.folder}/epoch-{epoch:04d}")
        self.weights = best
        self._delete(spark, path)
        return self

    def _held(self, live: DataFrame, days: list) -> tuple[int, Column]:
        """The number of rows that decide when to stop, and their condition: the last in time, and by name on the first of their dates."""
        total = sum(d["count"] for d in days)
        edge = math.floor(total * (1 - self.stop_share))
        if total - edge < 500:
            return 0, F.lit(False)
        before = 0
        for day in days:
            if before + day["count"] > edge:
                break
            before += day["count"]
        place = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
        name = live.where(F.col("date") == F.lit(day["date"])).withColumn("place", place).where(F.col("place") == edge - before + 1).first()["ticker"]
        return total - edge, (F.col("date") > F.lit(day["date"])) | ((F.col("date") == F.lit(day["date"])) & (F.col("ticker") >= F.lit(name)))

    def _delete(self, spark, path: str) -> None:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)

    def _exists(self, spark, path: str) -> bool:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)

    def _ordered(self, data: DataFrame, batches: int, epoch: int, together: int, path: str) -> None:
        """Writes the training rows in the order of the epoch's steps, a folder for every ``together`` of them."""
        order = np.random.default_rng([self.seed, epoch]).permutation(batches).astype(np.int32)
        steps = data.sparkSession.createDataFrame(pa.table({"slice": order, "step": np.arange(batches, dtype=np.int32)}))
        rows = data.where("not hold").join(F.broadcast(steps), "slice").select("x", "y", "step", F.expr(f"step div {together}").cast("int").alias("group"))
        groups = -(-batches // together)
        rows.repartitionById(groups, "group").sortWithinPartitions("group", "step").write.partitionBy("group").parquet(path)

    def _chained(self, group: DataFrame, state: tuple[np.ndarray, np.ndarray, np.ndarray], before: int, rates: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state after a group's steps, taken one after the other in one task, which holds one step's rows."""
        held = group.sparkSession.sparkContext.broadcast((np.stack(state), rates))
        kind, shape, length, inputs, truncate, decay = self.kind, shapes(self.kind, len(self.features), self.hidden), self.length, len(self.features), self.truncate, self.decay

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rates = held.value
            now, step, parts = tuple(now), None, []

            def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                p, total, n = split(now[0], shape), 0.0, 0
                rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
                for at in range(0, len(rows[1]), TOGETHER):
                    x, y = rows[0][at : at + TOGETHER], rows[1][at : at + TOGETHER]
                    out, kept = forward(kind, p, x)
                    total, n = total + backward(kind, p, x, kept, np.clip(out - y, -1, 1), truncate), n + len(y)
                return stepped(before + step, total / n, now, rates[step], decay)

            for batch in batches:
                x, y = _arrays(batch, length, inputs)
                steps = batch.column(2).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(steps)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if parts and steps[a] != step:
                        now, parts = taken(), []
                    step = int(steps[a])
                    parts.append((x[a:b], y[a:b]))
            if parts:
                now = taken()
            yield pa.RecordBatch.from_arrays([pa.array([np.stack(now).tobytes()], pa.binary())], names=["state"])

        found = np.frombuffer(group.select("x", "y", "step").coalesce(1).sortWithinPartitions("step").mapInArrow(run, "state binary").first()["state"]).reshape(3, -1)
        held.unpersist()
        return found[0], found[1], found[2]

    def _state(self, spark) -> dict | None:
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for epoch in range(self.epochs, 0, -1):
            if files.exists(path(f"{self.folder}/epoch-{epoch:04d}/_SUCCESS")):
                return spark.read.parquet(f"{self.folder}/epoch-{epoch:04d}").first().asDict()
        return None

    def _gradient(self, data: DataFrame, flat: np.ndarray, loss_only: bool = False) -> tuple[np.ndarray, float, int]:
        """(sum of the rows' gradients, of their losses, number of rows); with ``loss_only`` losses are squared errors and there is no gradient."""
        held = data.sparkSession.sparkContext.broadcast(flat)
        kind, shape, length, inputs, truncate = self.kind, shapes(self.kind, len(self.features), self.hidden), self.length, len(self.features), self.truncate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, total, loss, n = split(held.value, shape), np.zeros(0 if loss_only else len(held.value)), 0.0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    x, y = _arrays(batch.slice(at, TOGETHER), length, inputs)
                    out, state = forward(kind, p, x)
                    e = out - y
                    n += len(y)
                    if loss_only:
                        loss += float((e**2).sum())
                    else:
                        loss += float(np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5).sum())
                        total += backward(kind, p, x, state, np.clip(e, -1, 1), truncate)
            values = np.concatenate([total, [loss, n]])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) - len(total), pa.int32()), pa.array(values)], names=["place", "value"])

        sums = data.select("x", "y").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        held.unpersist()
        size = 0 if loss_only else len(flat)
        out = np.zeros(size + 2)
        out[sums.column("place").to_numpy() + size] = sums.column("value").to_numpy()
        return out[:size], float(out[-2]), int(out[-1])

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows with the model's output as a column."""
        rows = rows.drop(name)
        held = rows.sparkSession.sparkContext.broadcast(self.weights)
        kind, shape, length, inputs, scale = self.kind, shapes(self.kind, len(self.features), self.hidden), self.length, len(self.features), self.scale
        columns = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = split(held.value, shape)
            for batch in batches:
                packed = batch.column(len(columns))
                for at in range(0, batch.num_rows, TOGETHER):
                    out = pa.array(forward(kind, p, _unpacked(packed.slice(at, TOGETHER), length, inputs))[0] * scale)
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, TOGETHER) for c in batch.columns[:-1]], out], names=[*columns, name])

        return self.with_sequences(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))

    def importance(self) -> dict[str, float]:
        """A recurrent model has no importances of its own."""
        return {}


def cycle(step: int, steps: int) -> float:
    """The rate of a step as a part of the highest: up for ``RISE`` of the steps, then down, both along half a cosine."""
    top = max(RISE * steps - 1, 0)
    part = step / top if step <= top and top else min(1.0, (step - top) / max(steps - 1 - top, 1e-9))
    low, high = (FIRST, 1.0) if step <= top and top else (1.0, LAST)
    return high + (low - high) * (1 + math.cos(math.pi * part)) / 2
