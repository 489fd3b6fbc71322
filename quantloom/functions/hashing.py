"""A 32-bit mixing function that Spark, numpy and SQL compute alike, so that random numbers and permutations by key can be checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts and odd multipliers below 2**31, so that products stay within 63 bits.
STEPS = ((15, 1540483477), (13, 1274126177))
LAST = 16
WORD = 1 << 32


def mix32(v: Column) -> Column:
    v = F.pmod(v, F.lit(WORD))
    for shift, factor in STEPS:
        v = (v.bitwiseXOR(F.shiftright(v, shift)) * F.lit(factor).cast("long")) % F.lit(WORD)
    return v.bitwiseXOR(F.shiftright(v, LAST))


def mix32_of(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64) % WORD
    for shift, factor in STEPS:
        v = (v ^ (v >> shift)) * factor % WORD
    return v ^ (v >> LAST)


def mix32_sql(v: str, name: str) -> str:
    """Columns of a DuckDB select whose last one, ``name``, is the mix of v; each uses the one before."""
    out = [f"({v}) % {WORD} AS {name}_0"]
    for k, (shift, factor) in enumerate(STEPS):
        out.append(f"xor({name}_{k}, {name}_{k} >> {shift}) * {factor} % {WORD} AS {name}_{k + 1}")
    return ", ".join([*out, f"xor({name}_{len(STEPS)}, {name}_{len(STEPS)} >> {LAST}) AS {name}"])


def permuted(x: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Places below ``size`` by a keyed permutation: a Feistel network (a key a round, first axis) over the next power of four, walked until the place is below ``size``."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    x = np.broadcast_to(np.asarray(x, np.int64), np.broadcast_shapes(np.shape(x), keys.shape[1:])).copy()
    keys = np.broadcast_to(keys, (len(keys), *x.shape))
    todo = np.ones(x.shape, bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for key in keys[:, todo]:
            left, right = right, left ^ (mix32_of(right + key) & mask)
        x[todo] = left << half | right
        todo &= x >= size
    return x
