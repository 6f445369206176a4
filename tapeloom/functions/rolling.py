"""Rolling statistics over rows that Spark has dealt out and sorted by series: one pass per task, a few rows of memory.

A task reads its sorted rows batch by batch and keeps only the rows the next windows look back on, so no series and no
partition is held. The sums follow Spark's own order of arithmetic, so results equal those of its window aggregates.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


def _back(values, k):
    """``values`` k rows earlier; NaN before the first row."""
    return values if k == 0 else np.concatenate([np.full(min(k, len(values)), np.nan), values[:-k]])


def lagged(values, place, n):
    """``values`` n rows earlier in the same series; NaN in its first n rows."""
    return np.where(place > n, _back(values, n), np.nan)


def quotient(values, base):
    """``values / base``, NaN on a zero base."""
    return np.where(base == 0.0, np.nan, values / base)


def relative(values, base):
    return quotient(values, base) - 1.0


def rolling_mean(values, n):
    total = np.zeros(len(values))
    for k in range(n - 1, -1, -1):
        total = total + _back(values, k)
    return total / n


def rolling_std(values, n):
    """Sample deviation of the last ``n`` values, by Welford's updates from the oldest on."""
    mean, m2 = np.zeros(len(values)), np.zeros(len(values))
    for i in range(n):
        delta = _back(values, n - 1 - i) - mean
        part = delta / (i + 1.0)
        mean, m2 = mean + part, m2 + delta * (delta - part)
    return np.sqrt(m2 / (n - 1.0))


def rolling_cov(x, y, n):
    """Sample covariance of the last ``n`` pairs."""
    mx, my, ck = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for i in range(n):
        xs, ys = _back(x, n - 1 - i), _back(y, n - 1 - i)
        dx = xs - mx
        mx, my = mx + dx / (i + 1.0), my + (ys - my) / (i + 1.0)
        ck = ck + dx * (ys - my)
    return ck / (n - 1.0)


def rolling_median(values, place, n, least):
    """Median of the known ones of the last ``n`` values of a series; NaN if fewer than ``least`` are known."""
    padded = np.concatenate([np.full(n - 1, np.nan), values])
    cells = np.lib.stride_tricks.sliding_window_view(padded, n).copy()
    cells[np.arange(n - 1, -1, -1)[None, :] >= place[:, None]] = np.nan
    cells.sort(axis=1)
    known = (~np.isnan(cells)).sum(axis=1)
    rows = np.arange(len(values))
    middle = (cells[rows, np.maximum(known - 1, 0) // 2] + cells[rows, np.minimum(known // 2, n - 1)]) / 2.0
    return np.where(known >= least, middle, np.nan)


def with_rolling(df, inputs, place, names, look_back, make):
    """Add double columns ``names`` that ``make(inputs as arrays, place)`` works out; NaN becomes NULL.

    ``df`` comes out of a window over its series that gave ``place``, the row number from 1. A row's values may depend on
    up to ``look_back`` rows of its series before it. Rows out of this order end the job.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    inputs = list(inputs)

    def run(batches):
        held = {c: np.empty(0) for c in [*inputs, place]}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            here = {c: np.concatenate([held[c], rows[c].cast(pa.float64()).to_numpy()]) for c in held}
            first = len(held[place])
            at = here[place]
            follows = at == np.concatenate([[0.0], at[:-1]]) + 1.0
            if not (follows | (at == 1.0))[first:].all():
                raise ValueError("rows are not sorted by series")
            with np.errstate(all="ignore"):
                made = make({c: here[c] for c in inputs}, at)
            new = [pa.array(made[n][first:], pa.float64(), from_pandas=True) for n in names]
            out = [*batch.columns, *new]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *names])
            held = {c: v[-look_back:] for c, v in here.items()}

    return df.mapInArrow(run, schema)
