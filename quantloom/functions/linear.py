"""Least squares from cross moments, as expressions: running moments in one window, then a small factorisation a row."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: A pivot below this share of its moment is that of a column that the others explain: it gets no coefficient.
SINGULAR = 1e-11


def cross_moments(rows: DataFrame, x: list[Column], y: Column, frame: WindowSpec, live: Column) -> DataFrame:
    """The rows with g<i>_<j> (sums of products of x) and h<i> (with y) over a frame's live rows."""
    k = len(x)
    total = lambda a, b: F.sum(F.when(live, a * b)).over(frame)
    return rows.withColumns({f"g{i}_{j}": total(x[i], x[j]) for i, j in combinations_with_replacement(range(k), 2)} | {f"h{i}": total(x[i], y) for i in range(k)})


def solved(rows: DataFrame, k: int, ridge: list[float] | None = None) -> DataFrame:
    """The rows with b<i>, the solution of (G + diag(ridge)) b = h, in place of g and h: a factorisation into L D L' whose steps are columns."""
    g = lambda i, j: F.col(f"g{min(i, j)}_{max(i, j)}") + (ridge[i] if ridge and i == j else 0.0)
    dot = lambda terms: sum(terms, F.lit(0.0))
    for j in range(k):
        rows = rows.withColumn(f"d{j}", g(j, j) - dot(F.col(f"l{j}_{m}") * F.col(f"l{j}_{m}") * F.col(f"d{m}") for m in range(j)))
        rows = rows.withColumn(f"v{j}", F.when(F.col(f"d{j}") > g(j, j) * SINGULAR, 1 / F.col(f"d{j}")).when(F.col(f"d{j}").isNotNull(), 0.0))
        lower = {f"l{i}_{j}": (g(i, j) - dot(F.col(f"l{i}_{m}") * F.col(f"l{j}_{m}") * F.col(f"d{m}") for m in range(j))) * F.col(f"v{j}") for i in range(j + 1, k)}
        rows = rows.withColumns(lower | {f"z{j}": F.col(f"h{j}") - dot(F.col(f"l{j}_{m}") * F.col(f"z{m}") for m in range(j))})
    for i in reversed(range(k)):
        rows = rows.withColumn(f"b{i}", F.col(f"z{i}") * F.col(f"v{i}") - dot(F.col(f"l{m}_{i}") * F.col(f"b{m}") for m in range(i + 1, k)))
    return rows.drop(*[f"{c}{i}" for c in "dvzh" for i in range(k)], *[f"{c}{i}_{j}" for c in "gl" for i in range(k) for j in range(k)])


def predicted(x: list[Column], b: list[Column]) -> Column:
    return sum((u * v for u, v in zip(x, b, strict=True)), F.lit(0.0))


def elimination_sql(source: str, k: int, keys: str, ridge: list[float] | None = None) -> str:
    """The same solution for DuckDB, written as Gauss-Jordan elimination: common tables e0 (from ``source`` with keys, g<i>_<j>, h<i>) to e<k>, whose h<i> are the coefficients."""
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}" + (f" + {ridge[i]}::DOUBLE" if ridge and i == j and ridge[i] else "")
    out = [f"e0 AS (SELECT {keys}, " + ", ".join(f"{cell(i, j)} AS a{i}_{j}" for i in range(k) for j in range(k)) + ", " + ", ".join(f"h{i}" for i in range(k)) + f" FROM {source})"]
    for p in range(k):
        cells = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" for j in range(k)] + [f"h{p} / a{p}_{p} AS h{p}"]
        for i in range(k):
            if i != p:
                cells += [f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for j in range(k)] + [f"h{i} - a{i}_{p} * h{p} / a{p}_{p} AS h{i}"]
        out.append(f"e{p + 1} AS (SELECT {keys}, {', '.join(cells)} FROM e{p})")
    return ",\n".join(out)
