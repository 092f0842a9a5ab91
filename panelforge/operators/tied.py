"""Tie-averaged ranks of many columns, made by numpy over the Arrow batches of rows whose groups already lie together.

Ranked one by one, each column needs its own sort of all rows. Here a task sorts plain arrays of its own groups; a group is held whole, so it has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that are ranked at a time, about (one larger group still comes whole).
_ROWS_AT_ONCE = 50_000


def _ranked(group: np.ndarray, sizes: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, counts of known values by row) of rows of groups 0, 1, ...; NaN is the largest value and equals itself, as in SQL."""
    rows = np.flatnonzero(known)
    order = rows[np.lexsort((values[rows], group[rows]))]
    v, g = values[order], group[order]
    count = np.bincount(g, minlength=len(sizes))
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))]) if len(v) else np.empty(0, int)
    tied = np.diff(np.r_[first, len(v)])
    rank = np.zeros(len(values))
    # Places of the first and of the last of the ties, from 1 in the group.
    rank[order] = np.repeat(first + (tied + 1) / 2.0, tied) - (np.cumsum(count) - count)[g]
    return rank, np.repeat(count, sizes)


def ranks(place: Column, columns: Sequence[Column]) -> Column:
    """A struct ``r0``, ``n0``, ``r1``, ... of each column's rank in its group (null for null) and the number of its known values there.

    ``place`` is a row's number from 1 in its group, a window's, so that the rows of a group lie together.
    """
    fields = [f for i in range(len(columns)) for f in (T.StructField(f"r{i}", T.DoubleType()), T.StructField(f"n{i}", T.LongType()))]

    def made(held: list[tuple[pa.Array, ...]]) -> pa.Array:
        places, *arrays = (pa.concat_arrays(parts) for parts in zip(*held))
        first = np.flatnonzero(places.to_numpy(zero_copy_only=False) == 1)
        sizes = np.diff(np.r_[first, len(places)])
        group, out = np.repeat(np.arange(len(sizes)), sizes), []
        for a in arrays:
            known = ~a.is_null().to_numpy(zero_copy_only=False)
            rank, count = _ranked(group, sizes, a.to_numpy(zero_copy_only=False), known)
            out += [pa.array(rank, mask=~known), pa.array(count)]
        return pa.StructArray.from_arrays(out, [f.name for f in fields])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[tuple[pa.Array, ...]] = []
        for batch in batches:
            starts = np.flatnonzero(batch[0].to_numpy(zero_copy_only=False) == 1)
            # The last group of the batch may go on in the next one.
            if held and len(starts) and sum(len(b[0]) for b in held) + starts[-1] >= _ROWS_AT_ONCE:
                cut = int(starts[-1])
                yield made([*held, tuple(a.slice(0, cut) for a in batch)])
                held, batch = [], tuple(a.slice(cut) for a in batch)
            held.append(batch)
        if held:
            yield made(held)

    # Not called deterministic, so that no filter gets between the window that orders the rows and this.
    return F.arrow_udf(run, T.StructType(fields)).asNondeterministic()(place, *columns)
