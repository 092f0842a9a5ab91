"""Aggregates over sliding row frames, made by numpy over the Arrow batches of rows that already lie in order.

A window evaluates a sliding frame anew for every row, so its work is rows times the frame's length. Here a frame is put together from frames of
1, 2, 4, ... rows, each made from two of the next shorter ones: work is rows times the logarithm of the length, and no value outside a frame touches it.
A task holds a batch and the rows before it that a frame can reach, however long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("count", "sum", "avg", "std", "max", "min")
#: Largest values that ``top`` adds up.
TOP = 5


def _joined_moments(late: np.ndarray, early: np.ndarray) -> np.ndarray:
    """(count, mean, sum of squared distances to it) of two stretches together; equal values have no distance."""
    (n, mean, square), (m, other, more) = late, early
    total = n + m
    share, gap = m / np.maximum(total, 1.0), other - mean
    # An empty stretch has no mean that could be far off or unknown.
    none = (n == 0) | (m == 0)
    gap[none] = 0.0
    return np.stack([total, np.where(n == 0, other, mean + gap * share), square + more + gap * gap * (n * share)])


# What is joined of two neighbouring stretches, and what an empty one counts as. A maximum is unknown where a value is, a minimum only where all are, as in SQL.
_JOINS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], float]] = {
    "sum": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.fmin, np.nan), "std": (_joined_moments, 0.0),
}


class _Stretch:
    """Rows in order, each with its place (from 1) in its series."""

    def __init__(self, place: np.ndarray, values: Sequence[np.ndarray], known: Sequence[np.ndarray]):
        self.place, self.values, self.known = place, values, known
        self._early: dict[int, np.ndarray] = {}
        self._doubled: dict[tuple[str, int], list[np.ndarray]] = {}

    def back(self, values: np.ndarray, rows: int, empty: float) -> np.ndarray:
        """The values ``rows`` rows earlier, ``empty`` where the series has no such row."""
        if not rows:
            return values
        if rows not in self._early:
            self._early[rows] = np.flatnonzero(self.place <= rows)
        out = np.empty_like(values)
        out[..., :rows] = empty
        out[..., rows:] = values[..., : max(values.shape[-1] - rows, 0)]
        out[..., self._early[rows]] = empty
        return out

    def doubled(self, kind: str, at: int, level: int) -> np.ndarray:
        """The aggregate over 2**level rows of column ``at``."""
        join, empty = _JOINS[kind]
        made = self._doubled.setdefault((kind, at), [])
        if not made:
            values, known = self.values[at], self.known[at]
            one = np.where(known, values, empty)
            made.append(np.stack([known.astype(float), one, np.where(known, values - values, 0.0)]) if kind == "std" else one)
        while len(made) <= level:
            made.append(join(made[-1], self.back(made[-1], 1 << (len(made) - 1), empty)))
        return made[level]

    def over(self, kind: str, at: int, rows: int) -> np.ndarray:
        join, empty = _JOINS[kind]
        made, passed = None, 0
        for level in range(rows.bit_length()):
            if rows >> level & 1:
                part = self.back(self.doubled(kind, at, level), passed, empty)
                made = part if made is None else join(made, part)
                passed += 1 << level
        return made

    @cached_property
    def _seen(self) -> list[np.ndarray]:
        return [np.concatenate([[0], np.cumsum(k)]) for k in self.known]

    def count(self, at: int, rows: int) -> np.ndarray:
        here = np.arange(1, len(self.place) + 1)
        return self._seen[at][here] - self._seen[at][np.maximum(here - np.minimum(self.place, rows), 0)]

    def decayed(self, at: int, levels: int, factor: float) -> np.ndarray:
        """The sum over 2**levels rows, each row back counting ``factor`` times the one after it. A row without value passes nothing on."""
        known = self.known[at]
        value = np.where(known, self.values[at], 0.0)
        for level in range(levels):
            value = np.where(known, value + self.back(value, 1 << level, 0.0) * factor ** (1 << level), 0.0)
        return value

    def top(self, at: int, rows: int) -> np.ndarray:
        """The mean of the ``TOP`` largest values."""
        ahead = np.concatenate([np.full(rows - 1, -np.inf), np.where(self.known[at], self.values[at], -np.inf)])
        seen = np.lib.stride_tricks.sliding_window_view(ahead, rows).copy()
        early = np.flatnonzero(self.place < rows)
        seen[early] = np.where(np.arange(rows) >= rows - self.place[early, None], seen[early], -np.inf)
        best = np.sort(seen, axis=1)[:, : -TOP - 1 : -1]
        return np.add.accumulate(np.where(np.isneginf(best), 0.0, best), axis=1)[:, -1] / TOP

    def made(self, kind: str, at: int, rows: int, end: int | float) -> tuple[np.ndarray, np.ndarray | None]:
        """(values, which of them are null)."""
        if kind == "lag":
            return self.back(self.values[at], rows, 0.0), ~self.back(self.known[at], rows, False)
        if kind == "decay":
            return self.decayed(at, rows, end), ~self.known[at]
        if kind == "top":
            return self.top(at, rows), None
        n = self.back(self.count(at, rows), end, 0)
        if kind == "count":
            return n, None
        value = self.back(self.over("sum" if kind == "avg" else kind, at, rows), end, 0.0)
        if kind == "avg":
            return value / np.maximum(n, 1), n == 0
        if kind == "std":
            return np.sqrt(value[2] / np.maximum(n - 1, 1)), n < 2
        return value, n == 0


def frames(place: Column, columns: Sequence[Column], wanted: Sequence[tuple[str, int, int, int | float]]) -> Column:
    """A struct ``f0``, ``f1``, ... of (kind, number of the column, rows, rows between the frame and this one), nulls left out as in SQL.

    ``("lag", at, rows, 0)`` is the value ``rows`` earlier, ``("top", at, rows, 0)`` the mean of the largest values of the frame, and
    ``("decay", at, levels, factor)`` the sum over 2**levels rows that fades by ``factor`` a row. Rows must lie in the order of ``place``, their number from 1 in their series: it is a window's, so they do, and every batch is checked.
    """
    reach = max({"lag": rows, "decay": 2**rows - 1 if kind == "decay" else 0}.get(kind, rows - 1 + end) for kind, _, rows, end in wanted)
    fields = [T.StructField(f"f{i}", T.LongType() if kind == "count" else T.DoubleType()) for i, (kind, *_) in enumerate(wanted)]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kept: list[np.ndarray] = []
        for places, *arrays in batches:
            known = [~a.is_null().to_numpy(zero_copy_only=False) for a in arrays]
            now = [places.to_numpy(zero_copy_only=False), *known, *[a.to_numpy(zero_copy_only=False) for a in arrays]]
            now = [np.concatenate(pair) for pair in zip(kept, now)] if kept else now
            place, new = now[0], len(places)
            if not np.all((np.diff(place) == 1) | (place[1:] == 1)):
                raise RuntimeError("rows of a series came out of order")
            rows = _Stretch(place, now[1 + len(arrays):], now[1:1 + len(arrays)])
            with np.errstate(all="ignore"):
                made = [rows.made(*w) for w in wanted]
            out = [pa.array(v[len(v) - new:], mask=None if none is None else none[len(v) - new:]) for v, none in made]
            yield pa.StructArray.from_arrays(out, [f.name for f in fields])
            kept = [x[max(len(x) - reach, 0):] for x in now]

    # Not called deterministic, so that no filter gets between the window that orders the rows and this.
    return F.arrow_udf(run, T.StructType(fields)).asNondeterministic()(place, *columns)
