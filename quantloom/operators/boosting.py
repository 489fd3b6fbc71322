"""Leaf-wise boosted trees with Huber loss and early stopping, and exact Shapley attributions of their predictions.

A fit bins the features once and keeps rows in blocks (a row of Spark's for some thousand of them, their columns as bytes), since the
passes over single rows cost more than the work on them.  Each level of a tree is one aggregate: tasks add up gradients and counts by
(node, feature, bin) in numpy and Spark sums these small tables.  Whether a node's best split is taken does not
depend on the order of splitting, so all levels are made first and a best-first queue then takes the splits with the highest gains.
Rows carry their score as of the last checkpoint and tasks add the trees since, so a fit is as many small jobs as levels,
whatever the number of rows.  The driver holds histograms of at most 2 ** depth x features x bins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut

#: Trees between two checkpoints of the scores.
CUT = 20
#: A split must gain more.
GAIN = 1e-12


@dataclass
class Tree:
    """Arrays by heap index (root 1, children 2i and 2i + 1): feature (-1: a leaf), bin and value bound of the left side, output, rows, gain."""

    feature: np.ndarray
    bin: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf(self, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (rows by features); ``by`` is ``bin`` or ``bound``."""
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature))) - 1):
            f = self.feature[node]
            node = np.where(f < 0, node, 2 * node + (x[rows, f] > by[node]))
        return node


def huber_gradient(error: np.ndarray, delta: float) -> np.ndarray:
    return np.clip(error, -delta, delta)


def kept_rows(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether a tree uses a row: a hash of its position, the same on every task and retry."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2.0**53 < share


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns as a matrix of doubles; a missing value is 0."""
    return np.nan_to_num(np.column_stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in names]), nan=0.0)


#: A block: its columns' bytes, bins feature by feature.
BLOCK = {"id": np.dtype(np.int64), "y": np.dtype(np.float64), "hold": np.dtype(np.bool_), "bins": np.dtype(np.uint8), "score": np.dtype(np.float64)}


class Leaves:
    """The leaf of each row of a tree, from a table a feature: the leaves (bits) that a bin leaves open; the lowest open one of all features is the row's.

    A row that goes right at a node closes the leaves on its left.  Trees of over 64 leaves are walked node by node.
    """

    def __init__(self, tree: Tree, size: int):
        self.tree, order, stack = tree, [], [1]
        below: dict[int, int] = {}
        while stack:  # leaves from left to right
            node = stack.pop()
            if tree.feature[node] < 0:
                order.append(node)
            else:
                stack += [2 * node + 1, 2 * node]
        self.nodes, self.tables = np.array(order), None
        if len(order) > 64:
            return
        for k, leaf in enumerate(order):
            node = leaf
            while node:
                below[node] = below.get(node, 0) | 1 << k
                node //= 2
        every = (1 << len(order)) - 1
        self.tables = {}
        for node in below:
            f = int(tree.feature[node])
            if f >= 0:
                table = self.tables.setdefault(f, np.full(size, every, np.uint64))
                table[tree.bin[node] + 1 :] &= np.uint64(every & ~below[2 * node])

    def of(self, bins: np.ndarray) -> np.ndarray:
        """Nodes of the rows of ``bins`` (features by rows)."""
        if self.tables is None:
            return self.tree.leaf(bins.T, self.tree.bin)
        if not self.tables:
            return np.full(bins.shape[1], self.nodes[0])
        left = None
        for f, table in self.tables.items():
            own = table[bins[f]]
            left = own if left is None else left & own
        lowest = left & (~left + np.uint64(1))
        return self.nodes[(lowest.astype(float).view(np.int64) >> 52) - 1023]


def _binned(batches: Iterator[pa.RecordBatch], features: list[str], edges: list[np.ndarray], base: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch, features)
            bins = np.stack([np.searchsorted(e, x[:, k], "left").astype(np.uint8) for k, e in enumerate(edges)])
            ids, y, hold = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            yield _block([ids, y, hold, bins, np.full(len(x), base)])


def _block(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.astype(t, copy=False).tobytes()], pa.binary()) for c, t in zip(columns, BLOCK.values(), strict=True)], names=list(BLOCK))


def _unpacked(batches: Iterator[pa.RecordBatch], n: int, trees: list[Tree]) -> Iterator[list[np.ndarray]]:
    """Columns of each block, bins as features by rows, the score with the trees' outputs."""
    known = [(tree.value, Leaves(tree, 256)) for tree in trees]
    for batch in batches:
        for i in range(batch.num_rows):
            ids, y, hold, bins, score = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(BLOCK.values()))
            bins = bins.reshape(n, -1)
            for value, leaves in known:
                score = score + value[leaves.of(bins)]
            yield [ids, y, hold, bins, score]


def _scored(batches: Iterator[pa.RecordBatch], n: int, trees: Broadcast) -> Iterator[pa.RecordBatch]:
    yield from map(_block, _unpacked(batches, n, trees.value))


def histogram(ids: np.ndarray, y: np.ndarray, hold: np.ndarray, bins: np.ndarray, score: np.ndarray, grown: Leaves, level: int, chosen: list[int], size: int, seed: int, share: float, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows by (node of the level, chosen feature, bin); bins are features by rows."""
    node = grown.of(bins) - (1 << level)
    live = np.flatnonzero(~hold & kept_rows(ids, seed, share) & (node >= 0))
    at, g = node[live] * size, huber_gradient((score - y)[live], delta)
    shape = (1 << level, len(chosen), size)
    sums, counts = np.zeros(shape), np.zeros(shape, np.int64)
    for k, f in enumerate(chosen):
        cell = at + bins[f][live]
        sums[:, k] = np.bincount(cell, g, shape[0] * size).reshape(shape[0], size)
        counts[:, k] = np.bincount(cell, minlength=shape[0] * size).reshape(shape[0], size)
    return sums, counts


def _histograms(batches: Iterator[pa.RecordBatch], n: int, state: Broadcast) -> Iterator[pa.RecordBatch]:
    """(node, feature, bin, g, n) of a task's rows; node -1: squared error and number of the rows that are held out."""
    since, grown, level, chosen, size, seed, share, delta = state.value
    total, error, held, leaves = None, 0.0, 0, Leaves(grown, 256)
    for ids, y, hold, bins, score in _unpacked(batches, n, since):
        own = histogram(ids, y, hold, bins, score, leaves, level, chosen, size, seed, share, delta)
        total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
        error, held = error + float(((score - y)[hold] ** 2).sum()), held + int(hold.sum())
    if total is None:
        return
    node, k, b = np.nonzero(total[1])
    columns = [np.append(node, -1), np.append(k, 0), np.append(b, 0), np.append(total[0][node, k, b], error), np.append(total[1][node, k, b], held)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=["node", "feature", "bin", "g", "n"])


def best_split(sums: np.ndarray, counts: np.ndarray, least: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of one node's best split, of equal ones the first; no gain where none is allowed."""
    g, n = sums.cumsum(axis=1), counts.cumsum(axis=1)
    all_g, all_n = g[:, -1:], n[:, -1:]
    gain = g**2 / (n + l2) + (all_g - g) ** 2 / (all_n - n + l2) - all_g**2 / (all_n + l2)
    gain[(n < least) | (all_n - n < least)] = -np.inf
    k, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[k, b]), int(k), int(b)


@dataclass
class LeafTrees:
    """Gradient boosting by leaf-wise trees; the last ``stop_share`` of rows in time decides when to stop.

    Rows without a target are left out; missing features are 0.  With too few rows for a held-out part (1,000 before
    it, 200 in it) all rounds are kept.  Ties of gains go to the first feature and bin.
    """

    features: list[str]
    rounds: int = 400
    rate: float = 0.03
    leaves: int = 31
    depth: int = 6
    least: int = 200
    row_share: float = 0.8
    feature_share: float = 0.7
    l2: float = 5.0
    delta: float = 0.9
    patience: int = 40
    stop_share: float = 0.15
    bins: int = 64
    seed: int = 0
    order: tuple[str, str] = ("date", "ticker")
    edges: list[np.ndarray] | None = None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def chosen(self, round_no: int) -> list[int]:
        """The features that a tree may split on."""
        k = max(1, round(len(self.features) * self.feature_share))
        return sorted(np.random.default_rng([self.seed, round_no]).choice(len(self.features), k, replace=False).tolist())

    def prepared(self, rows: DataFrame, target: str) -> DataFrame:
        """(id, y, hold, features): rows numbered by the order columns."""
        x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in self.features]
        rows = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(*self.order, F.col(target).cast("double").alias("y"), *x)
        first, second = self.order
        days = rows.groupBy(first).agg(F.count("*").alias("n"))
        days = days.select(first, (F.sum("n").over(Window.orderBy(first)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
        place = F.row_number().over(Window.partitionBy(first).orderBy(second, "y"))
        rows = rows.withColumn("place", place).join(days, first)
        split = F.floor(F.col("all") * (1 - self.stop_share))
        hold = (split > 1000) & (F.col("all") - split > 200) & (F.col("id") >= split)
        return rows.withColumn("id", F.col("before") + F.col("place") - 1).select("id", "y", hold.alias("hold"), *self.features)

    def fit(self, rows: DataFrame, target: str) -> LeafTrees:
        rows = cut(self.prepared(rows, target))
        context, n, inner = rows.sparkSession.sparkContext, len(self.features), rows.where("not hold")
        known = inner.agg(F.avg("y").alias("base"), F.count("*").alias("rows"), *([] if self.edges else [F.percentile_approx(c, [k / self.bins for k in range(1, self.bins)], 10000).alias(f"e{i}") for i, c in enumerate(self.features)])).first()
        self.base, self.trees, self.losses = known["base"] or 0.0, [], []
        if not known["rows"]:
            self.edges = self.edges or [np.zeros(1)] * n
            return self
        self.edges = self.edges or [np.unique(np.asarray(known[f"e{i}"], float)) for i in range(n)]
        names, edges, base = self.features, self.edges, self.base
        data = cut(rows.mapInArrow(lambda it: _binned(it, names, edges, base), ", ".join(f"{c} binary" for c in BLOCK)))
        since: list[Tree] = []
        best = 0
        for round_no in range(self.rounds + 1):
            tree, loss = self._grown(data, since, round_no)
            self.losses.append(loss)
            if loss == loss and loss < self.losses[best]:
                best = round_no
            if round_no == self.rounds or round_no - best >= self.patience and loss == loss or tree is None:
                break
            self.trees.append(tree)
            since.append(tree)
            if len(since) == CUT:
                held = context.broadcast(since)
                data = cut(data.mapInArrow(lambda it: _scored(it, n, held), data.schema))  # noqa: B023
                since = []
        if self.losses[0] == self.losses[0]:
            self.trees = self.trees[:best]
        return self

    def _grown(self, data: DataFrame, since: list[Tree], round_no: int) -> tuple[Tree | None, float]:
        """One more tree (none if its root can't be split) and the mean squared error of the held-out rows before it (nan without any)."""
        size, chosen, n = max(len(e) for e in self.edges) + 1, self.chosen(round_no), len(self.features)
        empty = np.zeros(2 << self.depth)
        grown = Tree(np.full(2 << self.depth, -1), np.zeros(2 << self.depth, np.int64), empty.copy(), empty.copy(), empty.copy(), np.full(2 << self.depth, -np.inf))
        loss = math.nan
        for level in range(self.depth if round_no < self.rounds else 1):
            state = data.sparkSession.sparkContext.broadcast((since, grown, level, chosen, size, round_no + 1 + self.seed * 100003, self.row_share, self.delta))
            found = data.mapInArrow(lambda it: _histograms(it, n, state), "node int, feature int, bin int, g double, n long")  # noqa: B023
            table = found.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
            state.unpersist()
            node, k, b, g, count = (table[c].to_numpy() for c in ("node", "feature", "bin", "g", "n"))
            if level == 0 and (held := count[node < 0].sum()):
                loss = float(g[node < 0].sum() / held)
            live = node >= 0
            sums, counts = np.zeros((1 << level, len(chosen), size)), np.zeros((1 << level, len(chosen), size), np.int64)
            sums[node[live], k[live], b[live]], counts[node[live], k[live], b[live]] = g[live], count[live]
            if not self.split_level(grown, level, chosen, sums, counts):
                break
        return (self.finished(grown) if grown.feature[1] >= 0 else None), loss

    def split_level(self, grown: Tree, level: int, chosen: list[int], sums: np.ndarray, counts: np.ndarray) -> bool:
        """Notes the best splits of a level's nodes in ``grown``; whether there are any."""
        any_split = False
        for i in range(1 << level):
            node, total = (1 << level) + i, counts[i, 0].sum()
            if not total:
                continue
            grown.cover[node], grown.value[node] = total, -self.rate * sums[i, 0].sum() / (total + self.l2)
            gain, k, b = best_split(sums[i], counts[i], self.least, self.l2)
            if gain > GAIN:
                f = chosen[k]
                grown.feature[node], grown.bin[node], grown.bound[node], grown.gain[node] = f, b, self.edges[f][b], gain
                left = sums[i, k, : b + 1].sum(), counts[i, k, : b + 1].sum()
                for child, (g, n) in ((2 * node, left), (2 * node + 1, (sums[i, k].sum() - left[0], total - left[1]))):
                    grown.cover[child], grown.value[child] = n, -self.rate * g / (n + self.l2)
                any_split = True
        return any_split

    def finished(self, grown: Tree) -> Tree:
        """The tree of the splits that a best-first queue takes until there are ``leaves`` leaves."""
        queue, taken = [(-grown.gain[1], 1)], set()
        while queue and len(taken) < self.leaves - 1:
            _, node = heapq.heappop(queue)
            taken.add(node)
            for child in (2 * node, 2 * node + 1):
                if child < len(grown.feature) and grown.feature[child] >= 0:
                    heapq.heappush(queue, (-grown.gain[child], child))
        leaf = np.array([k not in taken for k in range(len(grown.feature))])
        return Tree(np.where(leaf, -1, grown.feature), grown.bin, grown.bound, grown.value, grown.cover, np.where(leaf, 0.0, grown.gain))

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows with the model's output as a column."""
        held = rows.sparkSession.sparkContext.broadcast((self.features, self.base, self.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, base, trees = held.value
            for batch in batches:
                x = matrix(batch, features)
                out = np.full(len(x), base)
                for tree in trees:
                    out += tree.value[tree.leaf(x, tree.bound)]
                yield batch.append_column(name, pa.array(out))

        rows = rows.drop(name)
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))

    def importance(self) -> dict[str, float]:
        """Each feature's share of all gains."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(total, tree.feature[split], tree.gain[split])
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist(), strict=True))

    def attributions(self, rows: DataFrame, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
        """keys, expected and phi_<feature>: exact path-dependent Shapley values; their sum with ``expected`` is the prediction."""
        held = rows.sparkSession.sparkContext.broadcast((self.features, self.base, [leaf_tables(t) for t in self.trees]))
        schema = ", ".join([*[f"`{k}` {dict(rows.dtypes)[k]}" for k in keys], "expected double", *[f"`phi_{c}` double" for c in self.features]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, base, trees = held.value
            expected = base + sum(t[0] for t in trees)
            for batch in batches:
                x = matrix(batch, features)
                phi = np.zeros(x.shape)
                for _, leaves in trees:
                    for names, low, high, table in leaves:
                        inside = (x[:, names] > low) & (x[:, names] <= high)
                        phi[:, names] += table[inside @ (1 << np.arange(len(names)))]
                columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), expected)), *map(pa.array, phi.T.copy())], names=[*keys, "expected", *[f"phi_{c}" for c in features]])

        return rows.mapInArrow(run, schema)


def leaf_tables(tree: Tree) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Expected output of a tree and, of each leaf, its features, their bounds and the Shapley values for every set of features whose bounds a row meets.

    A leaf's output with a set S known is its value, times 0 or 1 for each feature in S, times the share of rows that go
    its way for each other one: a product, so its Shapley values are sums over coefficients of a polynomial of degree below the path's length.
    """
    leaves, expected = [], 0.0
    stack = [(1, {}, 1.0)]
    while stack:
        node, path, share = stack.pop()
        if tree.feature[node] >= 0:
            f, total = int(tree.feature[node]), tree.cover[node]
            low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((2 * node, (low, min(high, tree.bound[node]))), (2 * node + 1, (max(low, tree.bound[node]), high))):
                part = tree.cover[child] / total
                stack.append((child, path | {f: (*bounds, z * part)}, share * part))
            continue
        expected += tree.value[node] * share
        d = len(path)
        if not d:
            continue
        low, high, z = map(np.array, zip(*path.values(), strict=True))
        weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
        met = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        table = np.zeros((1 << d, d))
        for i in range(d):
            # Coefficient k: the outputs of all sets of k of the other features, added up.
            poly = np.zeros((1 << d, d))
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    poly[:, 1:], poly[:, 0] = poly[:, 1:] * z[j] + poly[:, :-1] * met[:, j : j + 1], poly[:, 0] * z[j]
            table[:, i] = tree.value[node] * (met[:, i] - z[i]) * (poly @ weight)
        leaves.append((np.array(list(path)), low, high, table))
    return expected, leaves


def attribution_summary(found: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs, mean, std (population) and share of all mean absolute attributions; one aggregate over the rows."""
    stats = found.agg(*[f(F.col(f"phi_{c}")).alias(f"{name}{i}") for i, c in enumerate(features) for name, f in (("a", lambda x: F.avg(F.abs(x))), ("m", F.avg), ("s", F.stddev_pop))])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(features)])).alias("r")).select("r.*")
    return rows.withColumn("share", F.try_divide("mean_abs", F.sum("mean_abs").over(Window.partitionBy())))


def split_gains(rows: DataFrame, features: list[str], target: str, edges: list[float], delta: float = 0.9, l2: float = 5.0) -> DataFrame:
    """(feature, bound, n_left, gain) of every split of the first tree's root at given bounds: one aggregate by (feature, bin), then running sums."""
    rows = rows.where(F.col(target).isNotNull())
    mean = rows.agg(F.avg(target).alias("base"))
    one = rows.join(F.broadcast(mean)).withColumn("g", F.greatest(F.least(F.col("base") - F.col(target), F.lit(delta)), F.lit(-delta)))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("x")) for c in features])).alias("v")
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("x")))
    sums = one.select("g", values).select("g", "v.*").groupBy("feature", at.alias("bin")).agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    run = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    sums = sums.select("feature", "bin", F.sum("g").over(run).alias("g"), F.sum("n").over(run).alias("n_left"), F.sum("g").over(whole).alias("all_g"), F.sum("n").over(whole).alias("all_n"))
    rest_g, rest_n = F.col("all_g") - F.col("g"), F.col("all_n") - F.col("n_left")
    gain = F.col("g") ** 2 / (F.col("n_left") + l2) + rest_g**2 / (rest_n + l2) - F.col("all_g") ** 2 / (F.col("all_n") + l2)
    return sums.where(F.col("bin") < len(edges)).select("feature", F.element_at(F.array(*map(F.lit, edges)), F.col("bin") + 1).alias("bound"), "n_left", gain.alias("gain"))
