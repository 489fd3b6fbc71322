"""Session and table helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Edges that one task holds, about.
EDGES = 1 << 17


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of a sorted stream of batches, each as one batch (or, with ``most``, in parts of so many rows); memory holds one input batch and one run or part."""
    run: list[pa.RecordBatch] = []
    held = 0

    def same(one: pa.RecordBatch, two: pa.RecordBatch) -> bool:
        return all(one.column(k)[one.num_rows - 1].as_py() == two.column(k)[0].as_py() for k in keys)

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(run).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            if column.null_count:
                column = column.fill_null(0)
            values = column.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if run and not same(run[-1], batch):
            yield whole()
            run, held = [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and run:
                yield whole()
                run, held = [], 0
            while most and held + b - a >= most:
                run.append(batch.slice(a, most - held))
                a += most - held
                yield whole()
                run, held = [], 0
            if a < b:
                run.append(batch.slice(a, b - a))
                held += b - a
    if run:
        yield whole()


def apart(rows: DataFrame, key: str, node: str, size: Column, small: int, large: int) -> DataFrame:
    """Members of groups that hold several components, dealt so that any two in different ones meet.

    ``rows`` has ``key``, ``node`` and ``component``; ``size`` is what a row counts.  Of a group's members only
    those outside its largest component (the left side) are compared with all its members (the right side).
    Both sides come in blocks of about ``small`` and ``large``: a row for each pair of blocks (i, j) it is in, with
    ``left``.  ``minor`` marks rows outside.  So a group of n members of which k are outside is dealt n * ceil(k / small) +
    k * ceil(n / large) rows, and no task need hold more than a pair of blocks.
    """
    parts = rows.groupBy(key, "component").agg(F.sum(size).alias("n"))
    groups = parts.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("kinds")).where("kinds > 1")
    groups = groups.select(key, "main", F.ceil((F.col("total") - F.col("most")) / small).cast("int").alias("lefts"), F.ceil(F.col("total") / large).cast("int").alias("rights"))
    both = rows.join(groups, key)
    place = lambda n, seed: F.pmod(F.xxhash64(node, F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.where(F.col("component") != F.col("main")).withColumns({"i": place("lefts", 1), "left": F.lit(True)}).withColumn("j", every("rights"))
    right = both.withColumns({"j": place("rights", 2), "left": F.lit(False)}).withColumn("i", every("lefts")).select(left.columns)
    return left.union(right).withColumn("minor", F.col("component") != F.col("main")).drop("main", "lefts", "rights")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the smallest node that it reaches within the partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(root, x) for x in parent if (root := find(x)) != x]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node that can be reached.

    Nodes without an edge are not returned; null ends are ignored.  Every round first deals the edges at random to as
    many tasks as there are ``EDGES`` of them, which turns each task's edges into stars, then hooks each node to its neighbour of lowest rank (or itself) and
    contracts the edges.  Ranks are the ids and, every other round, hashes of them, so that no order of
    ids keeps the number of rounds from being logarithmic.  Edges and labels stay distributed; each
    round is cut by a checkpoint.
    """
    edges = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = cut(edges)
    labels = None
    round_no = 0
    while (n := edges.count()) > 0:
        edges = cut(edges.repartition(-(-n // EDGES)).mapInArrow(_forest, "a long, b long"))
        rank = (lambda c: F.xxhash64(c, F.lit(round_no))) if round_no % 2 else F.col  # noqa: B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("low"), F.min_by("b", rank("b")).alias("b"))
        hook = cut(hook.select(F.col("a").alias("node"), F.when(F.col("low") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")))
        if labels is None:
            labels = hook.select("node", F.col("to").alias("root"))
        else:
            labels = cut(labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        step = hook.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        edges = edges.join(step, "a").join(step.select(F.col("a").alias("b"), F.col("a2").alias("b2")), "b").where("a2 <> b2")
        edges = edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = cut(edges)
        round_no += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(lowest, "root").select("node", "component")
