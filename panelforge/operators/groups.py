"""Named feature groups evaluated together over each ticker's history."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import pct
from panelforge.operators.ordered import Frames, Stage, over_series


@dataclass(frozen=True)
class Group:
    """Stages run in turn; later ones read earlier columns. Series shorter than ``min_rows`` get nulls."""

    name: str
    stages: tuple[Stage, ...]
    outputs: tuple[str, ...]
    lookback: int
    min_rows: int = 1


def returns_stage(w: Frames) -> dict[str, Column]:
    return {"_ret": pct("Close", 1, w)}


def apply_groups(df: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """All groups in one pass: stage k of every group shares one select, and all share one sort."""

    def merged(k: int) -> Stage:
        def stage(w: Frames) -> dict[str, Column]:
            made: dict[str, Column] = {}
            for g in groups:
                if k < len(g.stages):
                    made.update(g.stages[k](w))
            return made
        return stage

    def guard(_: Frames) -> dict[str, Column]:
        return {c: F.when(F.col("_size") >= g.min_rows, F.col(c)) for g in groups if g.min_rows > 1 for c in g.outputs}

    depth = max(len(g.stages) for g in groups)
    return over_series(df, [merged(k) for k in range(depth)] + [guard], max(g.lookback for g in groups))


def outputs(groups: Iterable[Group]) -> list[str]:
    return list(dict.fromkeys(c for g in groups for c in g.outputs))


def _levels(q: float) -> int:
    """Doublings after which the left-out weights are below double precision."""
    level = 0
    while q ** (2**level) > 1e-17:
        level += 1
    return level


def ewm_mean_stages(series: dict[str, tuple[str, int]]) -> tuple[list[Stage], int]:
    """Exponential means seeded with the first value: y0 = x0, y = a*x + (1-a)*y_before, a = 2/(span+1).

    A geometric sum over 2m rows is the sum over m rows plus its m-row lag times
    q^m, so log2 steps replace a fold over the history. Input must be null-free.
    Returns the stages and the rows of history they read.
    """
    q = {n: 1 - 2 / (span + 1) for n, (_, span) in series.items()}
    depth = max(_levels(v) for v in q.values())

    def seed(_: Frames) -> dict[str, Column]:
        return {f"_seed_{n}": F.when(F.col("_pos") == 0, F.col(x)).otherwise(F.col(x) * F.lit(1 - q[n])).cast("double") for n, (x, _s) in series.items()}

    return [seed, lambda w: {n: w.decayed(f"_seed_{n}", q[n], depth) for n in series}], 2**depth


def ewm_std_stages(x: str, out: str, span: int, min_periods: int) -> tuple[list[Stage], int]:
    """Bias-corrected exponentially weighted deviation; weights q^age, nulls left out."""
    q = 1 - 2 / (span + 1)
    depth = _levels(q)
    parts = {f"_{out}_w": q, f"_{out}_ww": q * q, f"_{out}_x": q, f"_{out}_xx": q}

    def seed(_: Frames) -> dict[str, Column]:
        here = F.col(x).isNotNull().cast("double")
        value = F.coalesce(F.col(x), F.lit(0.0))
        return {f"_{out}_w": here, f"_{out}_ww": here, f"_{out}_x": value, f"_{out}_xx": value * value}

    def finish(w: Frames) -> dict[str, Column]:
        sw, sww, sx, sxx = (w.decayed(n, d, depth) for n, d in parts.items())
        mean = F.try_divide(sx, sw)
        variance = F.greatest(F.try_divide(sxx, sw) - mean * mean, F.lit(0.0))
        corrected = variance * F.try_divide(sw * sw, sw * sw - sww)
        seen = w.agg("count", x, 2**depth)
        return {out: F.when((seen >= min_periods) & F.col(x).isNotNull(), F.sqrt(corrected))}

    return [seed, finish], 2**depth
