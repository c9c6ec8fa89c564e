"""Sums of series per group: whole vectors are added inside the tasks, so a task sends one row per group.

``vector_sums``  count, sum and centred second moment per position, as arrays
``position_sums``  the same in long form, one row per (group, position)
``gram_sums``  cross-products X'X and sums per group, merged row block by row block

Groups with very many rows cost a task one row; groups without end are sent on whenever a task holds ``HELD_VALUES`` numbers.
Null elements are left out, NaN is a value like any other; series of different length are added position by position.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.series import _by_width

HELD_VALUES = 1 << 22
GRAM_ROWS = 64  # rows of X'X that travel together


def _merge(a: tuple, b: tuple) -> tuple:
    """Two (count, sum, centred square sum) vectors into one."""
    width = max(len(a[0]), len(b[0]))
    (na, sa, qa), (nb, sb, qb) = ([np.pad(v, (0, width - len(v))) for v in t] for t in (a, b))
    n = na + nb
    both = (na > 0) & (nb > 0)
    gap = np.where(both, sa / np.maximum(na, 1) - sb / np.maximum(nb, 1), 0.0)
    return n, sa + sb, qa + qb + gap * gap * na * nb / np.maximum(n, 1)


def _batch_sums(ids: np.ndarray, column: pa.Array):
    """(group, (count, sum, centred square sum)) of one Arrow batch."""
    valid = np.asarray(column.flatten().is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    start = np.cumsum(lengths) - lengths
    for rows, x in _by_width(column):
        order = np.argsort(ids[rows], kind="stable")
        g, x, rows = ids[rows][order], x[order], rows[order]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        of = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        ok = valid[start[rows][:, None] + np.arange(x.shape[1])] if not valid.all() else np.ones(x.shape, bool)
        x = np.where(ok, x, 0.0)
        n = np.add.reduceat(ok.astype(np.int64), at, axis=0)
        s = np.add.reduceat(x, at, axis=0)
        gap = np.where(ok, x - (s / np.maximum(n, 1))[of], 0.0)
        yield from zip(g[at].tolist(), zip(n, s, np.add.reduceat(gap * gap, at, axis=0), strict=True), strict=True)


def vector_sums(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """One row per key with ``n`` (array of long), ``s`` and ``m2`` (arrays of double): count, sum and centred square sum by position."""
    keys = list(keys)
    arrays = [T.StructField("n", T.ArrayType(T.LongType())), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("m2", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[df.schema[k] for k in keys], *arrays])

    def record(held: dict, kinds: list) -> pa.RecordBatch:
        names = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
        sums = [pa.array([v[i].tolist() for v in held.values()], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*names, *sums], names=[*keys, "n", "s", "m2"])

    def partial(batches):
        held: dict[tuple, tuple] = {}
        kinds: list = []
        for b in batches:
            kinds = [b.column(i).type for i in range(len(keys))]
            rows = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * b.num_rows
            seen: dict[tuple, int] = {}
            ids = np.fromiter((seen.setdefault(k, len(seen)) for k in rows), np.int64, len(rows))
            named = list(seen)
            for g, sums in _batch_sums(ids, b.column(len(keys))):
                held[named[g]] = _merge(held[named[g]], sums) if named[g] in held else sums
            if sum(len(v[0]) for v in held.values()) > HELD_VALUES:
                yield record(held, kinds)
                held = {}
        if held:
            yield record(held, kinds)

    def merge(batches):
        last, sums, kinds = None, None, []
        for b in batches:
            kinds = [b.column(i).type for i in range(len(keys))]
            done = {}
            rows = zip(*[b.column(i).to_pylist() for i in range(len(keys))], strict=True) if keys else [()] * b.num_rows
            for r, k in enumerate(rows):
                v = tuple(b.column(len(keys) + i)[r].values.to_numpy() for i in range(3))
                if k == last:
                    sums = _merge(sums, v)
                    continue
                if last is not None:
                    done[last] = sums
                last, sums = k, v
            if done:
                yield record(done, kinds)
        if last is not None:
            yield record({last: sums}, kinds)

    parts = df.select(*keys, y).mapInArrow(partial, schema)
    met = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    return met.mapInArrow(merge, schema)


def position_sums(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, pos, n, s, m2) for every position that holds a value."""
    z = vector_sums(df, keys, y).select(*keys, F.posexplode(F.arrays_zip("n", "s", "m2")).alias("pos", "z"))
    return z.where("z.n > 0").select(*keys, "pos", F.col("z.n").alias("n"), F.col("z.s").alias("s"), F.col("z.m2").alias("m2"))


def gram_sums(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, block, rows, n): X'X of the complete series of each key in blocks of ``GRAM_ROWS`` rows, flattened; ``n`` series.

    Meant for keys of a small vocabulary (folds): a task holds one B x B matrix per key.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("block", T.IntegerType()), T.StructField("rows", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def record(held, kinds):
        out = [(k, i, m[i * GRAM_ROWS : (i + 1) * GRAM_ROWS].ravel(), n) for k, (m, n) in held.items() for i in range(-(-len(m) // GRAM_ROWS))]
        names = [pa.array([o[0][j] for o in out], kind) for j, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*names, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64())), pa.array([o[3] for o in out], pa.int64())], names=[*keys, "block", "rows", "n"])

    def partial(batches):
        held: dict[tuple, tuple] = {}
        kinds: list = []
        for b in batches:
            kinds = [b.column(i).type for i in range(len(keys))]
            rows = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * b.num_rows
            seen: dict[tuple, int] = {}
            ids = np.fromiter((seen.setdefault(k, len(seen)) for k in rows), np.int64, len(rows))
            for at, x in _by_width(b.column(len(keys))):
                for k, g in seen.items():
                    mine = x[ids[at] == g]
                    if len(mine):
                        m, n = held.get(k, (0.0, 0))
                        held[k] = (m + mine.T @ mine, n + len(mine))
        if held:
            yield record(held, kinds)

    def merge(t: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in t["rows"]], axis=0)
        head = t.slice(0, 1)
        return head.set_column(head.schema.get_field_index("rows"), "rows", pa.array([total], pa.list_(pa.float64()))).set_column(head.schema.get_field_index("n"), "n", pa.array([int(np.sum(t["n"].to_numpy()))], pa.int64()))

    return df.select(*keys, y).mapInArrow(partial, schema).groupBy(*keys, "block").applyInArrow(merge, schema)
