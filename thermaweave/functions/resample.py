"""Redrawing rows of a unit many times, vectorised on Arrow batches.

A row of the input holds one unit's values (arrays of equal length), and a block of replicates as two lists of numbers. All draws of
the block are an integer hash of (seed, the two numbers, draw), made as a matrix of (replicates x draws) in slices that fit a cache; only the
sums of each replicate leave the task. The hash is that of :func:`thermaweave.functions.exprs.stir`, to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .exprs import PRIME, STREAMS

#: Draws of one slice.
SLICE = 1 << 16


def _reduced(v: np.ndarray) -> np.ndarray:
    """``v`` modulo ``PRIME`` (2**31 - 1), for 0 <= v < 2**63, by folding high bits onto low ones."""
    v = (v & PRIME) + (v >> 31)
    v = (v & PRIME) + (v >> 31)
    return v - PRIME * (v >= PRIME)


def stirred(state: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One step of the hash, for non-negative states and parts below ``PRIME``."""
    x = _reduced(state * 48_271 + part + 11)
    return _reduced(_reduced(x * (x + 12_345)) * 69_621 + 7)


def streams(seed: int, *parts: np.ndarray) -> list[np.ndarray]:
    """The two starting states of every replicate."""
    out = []
    for start in STREAMS:
        x = np.full(len(parts[0]), start + seed, np.int64)
        for p in parts:
            x = stirred(x, p % PRIME)
        out.append(x)
    return out


def redrawn_sums(values: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
    """Per replicate, the sums of each value array over as many draws (with replacement) as it is long."""
    n, x, y = len(values[0]), *starts
    out = [np.empty(len(x)) for _ in values]
    draws = np.arange(1, n + 1, dtype=np.int64)
    step = max(1, SLICE // max(n, 1))
    for at in range(0, len(x), step):
        to = slice(at, at + step)
        total = [np.zeros(len(x[to])) for _ in values]
        for low in range(0, n, SLICE):
            j = draws[low : low + SLICE]
            pick = (stirred(x[to, None], j) * PRIME + stirred(y[to, None], j)) % n
            for k, v in enumerate(values):
                total[k] += v[pick].sum(axis=1)
        for k, t in enumerate(total):
            out[k][to] = t
    return out


def redraw(units: DataFrame, unit: str, values: list[str], seed: int, block: str = "b", part: str = "part") -> DataFrame:
    """Rows (replicate, unit, n_rows, sum and sum of squares of each value) for the blocks of every row of ``units``.

    ``block`` and ``part`` are lists of equal length: the replicate, and the second number of its hash.
    """
    names = [f"{kind}_{v}" for v in values for kind in ("s", "q")]
    schema = StructType([StructField("b", LongType()), StructField(unit, units.schema[unit].dataType), StructField("n_rows", LongType()), *[StructField(c, DoubleType()) for c in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = [batch.column(v)[i].values.to_numpy(zero_copy_only=False).astype(float) for v in values]
                b, p = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (block, part))
                sums = redrawn_sums([x for v in own for x in (v, v * v)], streams(seed, b, p))
                columns = [b, pa.array([batch.column(unit)[i].as_py()] * len(b), arrow.field(unit).type), np.full(len(b), len(own[0]), np.int64), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) if isinstance(c, np.ndarray) else c for c, f in zip(columns, arrow)], schema=arrow)

    return units.select(unit, *values, block, part).mapInArrow(run, schema)
