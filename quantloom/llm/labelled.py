"""Bounded samples of labelled rows, and one-variable calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus`` (null for a null doc_id)."""
    return (F.crc32(F.col("doc_id").cast("string")) % modulus).cast("int")


def sampled(rows: DataFrame, limit: int) -> list[int]:
    """At most ``limit`` distinct doc_ids, those of lowest hash: a sample that no order or partitioning of the rows changes."""
    ids = rows.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def texts_of(docs: DataFrame, labels: dict[int, int]) -> DataFrame:
    """doc_id, text and label of the documents with these ids, one row an id; the ids are broadcast, for their number is bounded by the sample."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())])
    wanted = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in labels.items()], schema)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id")
    # Of texts that share an id the one of least hash, whatever the partitioning.
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def within(docs: DataFrame, ids: list[int], most_bytes: int) -> list[int]:
    """The ids, in their order, as long as their texts come to at most ``most_bytes`` together; ids without a document are left out."""
    sizes = {r[0]: r[1] or 0 for r in texts_of(docs, dict.fromkeys(ids, 0)).select("doc_id", F.octet_length("text")).collect()}
    out, total = [], 0
    for i in ids:
        if i in sizes and total + sizes[i] <= most_bytes:
            total += sizes[i]
            out.append(i)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression of y on x by Newton's method, with a weak prior that keeps separable data finite."""
    scale = float(np.std(x)) or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        grad = z.T @ (p - y) + np.array([1e-2, 0]) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])
