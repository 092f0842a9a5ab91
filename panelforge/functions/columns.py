"""Column expressions with the null, ratio and minimum-period rules the features share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
DAY_MS = 86_400_000
# Says which of repeated observations came last.
INGEST_ORDER = "ingest_order"


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def pct(x: str, n: int, w) -> Column:
    """Relative change against ``n`` rows earlier; ``w`` is the series' ``Frames``."""
    before = w.lag(x, n)
    return F.try_divide(F.col(x) - before, before)


def rolled(kind: str, x: str, n: int, w, min_periods: int | None = None) -> Column:
    """Aggregate of the last ``n`` rows, null until ``min_periods`` (default ``n``) non-null values exist."""
    need = n if min_periods is None else min_periods
    return F.when(w.agg("count", x, n) >= need, w.agg(kind, x, n))


def rmean(x, n, w, min_periods=None) -> Column:
    return rolled("avg", x, n, w, min_periods)


def rstd(x, n, w, min_periods=None) -> Column:
    return rolled("std", x, n, w, min_periods)


def rsum(x, n, w, min_periods=None) -> Column:
    return rolled("sum", x, n, w, min_periods)


def rmax(x, n, w, min_periods=None) -> Column:
    return rolled("max", x, n, w, min_periods)


def rmin(x, n, w, min_periods=None) -> Column:
    return rolled("min", x, n, w, min_periods)


def powers(x: str, upto: int) -> dict[str, Column]:
    """Columns ``x2`` .. ``x<upto>``: inputs of the power-sum forms below.

    A sliding frame evaluates its aggregates once per row and frame position;
    plain sums are many times cheaper there than the moment aggregates.
    """
    out, c = {}, F.col(x)
    for k in range(2, upto + 1):
        c = c * F.col(x)
        out[f"{x}{k}"] = c
    return out


def _sums(x: str, n: int, w, upto: int) -> list[Column]:
    return [w.agg("sum", x if k == 1 else f"{x}{k}", n) for k in range(1, upto + 1)]


def _full(x: str, n: int, w) -> Column:
    return w.agg("count", x, n) >= n


def pstd(x: str, n: int, w) -> Column:
    """Sample deviation of the last ``n`` values from power sums (needs ``powers(x, 2)``)."""
    s1, s2 = _sums(x, n, w, 2)
    return F.when(_full(x, n, w), F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1)))


def pskew(x: str, n: int, w) -> Column:
    """Bias-corrected skewness of the last ``n`` values (needs ``powers(x, 3)``)."""
    s1, s2, s3 = _sums(x, n, w, 3)
    mean = s1 / n
    m2, m3 = s2 / n - mean * mean, s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    factor = (n * (n - 1)) ** 0.5 / (n - 2)
    return F.when(_full(x, n, w) & (m2 > 1e-14 * s2 / n), m3 / F.pow(m2, 1.5) * F.lit(factor))


def pkurt(x: str, n: int, w) -> Column:
    """Bias-corrected excess kurtosis of the last ``n`` values (needs ``powers(x, 4)``)."""
    s1, s2, s3, s4 = _sums(x, n, w, 4)
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    excess = m4 / (m2 * m2) - 3
    value = F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(float(n + 1)) * excess + 6)
    return F.when(_full(x, n, w) & (m2 > 1e-14 * s2 / n), value)


def pcorr(x: str, y: str, n: int, w) -> Column:
    """Pearson correlation over the last ``n`` rows from sums over complete pairs (needs ``pair_terms``)."""
    p = f"_{x}_{y}"
    k = w.agg("count", f"{p}_xy", n)
    sx, sy, sxx, syy, sxy = (w.agg("sum", f"{p}_{t}", n) for t in ("x", "y", "xx", "yy", "xy"))
    vx, vy = sxx - sx * sx / k, syy - sy * sy / k
    return F.when((k >= 2) & (vx > 1e-14 * sxx) & (vy > 1e-14 * syy), clip((sxy - sx * sy / k) / F.sqrt(vx * vy), -1.0, 1.0))


def pair_terms(x: str, y: str) -> dict[str, Column]:
    p = f"_{x}_{y}"
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return {f"{p}_x": a, f"{p}_y": b, f"{p}_xx": a * a, f"{p}_yy": b * b, f"{p}_xy": a * b}


def skew_sample(x: str, n: Column) -> Column:
    """Bias-corrected skewness as a group aggregate; ``n`` is the non-null count."""
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2))


def kurt_sample(x: str, n: Column) -> Column:
    safe = F.when(n >= 4, n)
    return (safe - 1) / ((safe - 2) * (safe - 3)) * ((safe + 1) * F.kurtosis(x) + 6)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation of complete pairs as a group aggregate; null without spread (the built-in divides by zero there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return clip(value, -1.0, 1.0)


def ratio(x: Column, y: Column) -> Column:
    """x / (y + eps)."""
    return F.try_divide(x, y + EPS)


def safe_divide(x: Column, y: Column, low: float = -1e6, high: float = 1e6) -> Column:
    """Division by y, or by eps where y is nearer to zero than eps; clipped, infinities null."""
    kept = F.when(F.abs(y) < EPS, F.lit(EPS)).otherwise(y)
    return clip(finite(F.try_divide(x, kept)), low, high)


def safe_pct(x: str, n: int, w) -> Column:
    before = w.lag(x, n)
    return safe_divide(F.col(x) - before, before)


def first_existing(columns: list[str], *names: str) -> str | None:
    return next((n for n in names if n in columns), None)


def row_mean(*cols: Column) -> Column:
    """Mean of the non-null arguments."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, n)
