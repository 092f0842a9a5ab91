"""Quality of ranked scores: information coefficients, quantile returns, hit rates, stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import pearson
from panelforge.operators.labels import quantile_bins
from panelforge.operators.ordered import average_ranks, lookup, number_rows, over_series
from panelforge.session import stored

SCORE, ACTUAL = "predicted_score", "actual_return"


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("timestamp", "ticker", F.col(SCORE).cast("double").alias(SCORE), F.col(ACTUAL).cast("double").alias(ACTUAL))


def _guarded_corr(x: str, y: str) -> Column:
    """Correlation of complete pairs; null under three pairs or without spread."""
    pairs = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.when(pairs >= 3, pearson(x, y))


def ic_by_date(df: DataFrame, min_stocks: int = 5) -> DataFrame:
    """(timestamp, ic, n) for dates with at least ``min_stocks`` rows."""
    out = _pairs(df).groupBy("timestamp").agg(_guarded_corr(SCORE, ACTUAL).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_stocks)


def rank_ic_by_date(df: DataFrame, min_stocks: int = 5) -> DataFrame:
    """(timestamp, rank_ic, n): correlation of tie-averaged ranks of complete pairs."""
    rows = _pairs(df)
    complete = rows.filter(f"{SCORE} is not null and {ACTUAL} is not null")
    ranked = average_ranks(complete, [SCORE, ACTUAL], ["timestamp"]).select(
        "timestamp", F.col(f"_rank_{SCORE}").alias("a"), F.col(f"_rank_{ACTUAL}").alias("b"))
    out = ranked.groupBy("timestamp").agg(_guarded_corr("a", "b").alias("rank_ic"))
    sizes = rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_stocks)
    return lookup(sizes, out, ["timestamp"]).select("timestamp", "rank_ic", "n")


def icir(series: DataFrame, value: str = "ic", horizon_days: int | None = None) -> DataFrame:
    """One row: mean, deviation, mean/deviation and its annualised form sqrt(252/horizon)."""
    m, s = F.avg(value), F.stddev_samp(value)
    raw = F.when((F.count(value) >= 2) & (s > 0), m / s)
    factor = math.sqrt(252 / horizon_days) if horizon_days else 1.0
    return series.agg(m.alias("mean_ic"), s.alias("std_ic"), raw.alias("raw_icir"), (raw * F.lit(factor)).alias("icir"))


def quantile_returns(df: DataFrame, n: int = 5) -> DataFrame:
    """(bin 1..n, mean return, rows) over all rows pooled."""
    binned = quantile_bins(_pairs(df), SCORE, n, (), "bin").filter("bin is not null")
    return binned.groupBy((F.col("bin") + 1).alias("bin")).agg(F.avg(ACTUAL).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def quantile_returns_by_date(df: DataFrame, n: int = 5, min_rows: int | None = None) -> DataFrame:
    """timestamp, Q1..Qn: mean return per score bin of each date with enough rows (default n)."""
    need = n if min_rows is None else min_rows
    rows = _pairs(df)
    binned = quantile_bins(rows, SCORE, n, ("timestamp",), "bin")
    out = binned.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(F.when(F.col("bin") == i, F.col(ACTUAL))).alias(f"Q{i + 1}") for i in range(n)]
    )
    return out.filter(F.col("rows") >= need).drop("rows")


def spread(bins: DataFrame, n: int = 5) -> DataFrame:
    """One row: mean return of the top bin less the bottom bin."""
    top, low = (F.max(F.when(F.col("bin") == b, F.col("mean_return"))) for b in (n, 1))
    return bins.agg((top - low).alias("spread"))


def monotonicity(bins: DataFrame) -> DataFrame:
    """One row: how often a bin does not beat the one below. ``bins`` has one row per bin."""
    up = over_series(bins.select("bin", "mean_return"), [lambda w: {"nxt": w.lead("mean_return")}], 0, (), ("bin",), 1)
    bad = F.count_if(F.col("nxt") <= F.col("mean_return"))
    n = F.count(F.lit(1))
    return up.agg(
        ((bad == 0) & (n >= 2)).alias("is_monotonic"), F.when(n >= 2, bad).otherwise(0).alias("violations"),
        F.when(n >= 2, 1.0 - bad / F.when(n >= 2, n - 1)).otherwise(0.0).alias("monotonicity_score"),
    )


def quintiles_by_year(df: DataFrame) -> DataFrame:
    """year, Q1..Q5, Q5-Q4 gap and order flag; bins from first-come ranks of each date."""
    placed = number_rows(_pairs(df).filter(f"{SCORE} is not null"), ["timestamp"], [SCORE, "ticker"])
    span = F.col("_size") - 1
    # Place p of n falls in bin ceil(5p / (n-1)), the lowest place in bin 1.
    q = F.greatest(F.expr("(5 * _pos + _size - 2) div (_size - 1)"), F.lit(1))
    rows = placed.filter(span >= 1).select(F.year(F.timestamp_millis("timestamp")).alias("year"), q.alias("q"), ACTUAL)
    out = rows.groupBy("year").agg(*[F.avg(F.when(F.col("q") == i, F.col(ACTUAL))).alias(f"Q{i}") for i in range(1, 6)])
    seen = F.array_compact(F.array(*[f"Q{i}" for i in range(1, 6)]))
    return out.withColumns({
        "Q5_minus_Q4": F.col("Q5") - F.col("Q4"),
        "is_monotonic": (F.size(seen) > 1) & (F.sort_array(seen) == seen),
    })


def top_n(df: DataFrame, n: int, keys: Sequence[str] = ("timestamp",), score: str = SCORE, ascending: bool = False) -> DataFrame:
    """The n best rows per group; each task keeps only its own n before the shuffle."""
    from pyspark.sql import Window

    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col("ticker")))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def hit_rate_by_date(df: DataFrame, n: int = 10) -> DataFrame:
    """(timestamp, hit_rate): share of the n best-scored rows with a positive return; dates with n rows or more."""
    rows = _pairs(df)
    hits = top_n(rows, n).groupBy("timestamp").agg(
        F.avg((F.coalesce(F.col(ACTUAL), F.lit(0.0)) > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("_n"))
    return hits.filter(F.col("_n") == n).drop("_n")


def hit_rate(df: DataFrame, n: int = 10) -> DataFrame:
    return hit_rate_by_date(df, n).agg(F.avg("hit_rate").alias("hit_rate"))


def coverage(df: DataFrame, min_stocks: int = 5) -> DataFrame:
    sizes = df.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_stocks)
    return sizes.agg(F.count(F.lit(1)).alias("num_timestamps"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_stocks"))


def autocorrelation(series: DataFrame, value: str = "ic", max_lag: int = 10) -> DataFrame:
    """(lag, autocorr) of a date series; empty when it is shorter than ``max_lag + 5``."""
    clean = series.filter(F.col(value).isNotNull()).select("timestamp", F.col(value).alias("x"))
    lagged = over_series(clean, [lambda w: {f"l{k}": w.lag("x", k) for k in range(1, max_lag + 1)}], max_lag, ())
    row = lagged.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(pearson("x", f"l{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(1, max_lag + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("autocorr")) for k in range(1, max_lag + 1)])
    return row.filter(F.col("n") >= max_lag + 5).select(F.inline(pairs))


def stability(series: DataFrame, value: str = "ic") -> DataFrame:
    """Share positive, population skewness and excess kurtosis, share x mean/deviation; null under five dates."""
    x, n = F.col(value), F.count(value)
    share = F.avg((x > 0).cast("double"))
    enough = F.count(F.lit(1)) >= 5
    s = F.stddev_samp(x)
    score = F.when(s > 0, share * F.avg(x) / F.when(s > 0, s)).when(F.avg(x) > 0, share).otherwise(-share)
    spread_ok = F.stddev_pop(x) > 0
    return series.agg(
        F.when(enough, share).alias("ic_positive_rate"), F.when(enough & spread_ok, F.skewness(x)).alias("ic_skewness"),
        F.when(enough & spread_ok, F.kurtosis(x)).alias("ic_kurtosis"), F.when(enough, score).alias("ic_stability_score"),
        n.alias("n"),
    )


_STEPS = 4000


def student_p(t: Column, v: Column) -> Column:
    """Two-sided tail probability of Student's t with v degrees of freedom.

    With t = sqrt(v) tan(a) the density is proportional to cos(a)^(v-1); the tail
    and whole integrals are taken by Simpson's rule up to where it vanishes.
    """
    top = F.least(F.lit(math.pi / 2), F.lit(40.0) / F.sqrt(v))
    start = F.least(F.atan(F.abs(t) / F.sqrt(v)), top)

    def integral(low: Column) -> Column:
        step = (top - low) / _STEPS
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(_STEPS)), F.lit(0.0),
            lambda acc, i: acc + F.when((i == 0) | (i == _STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.greatest(F.cos(low + step * i), F.lit(0.0)), v - 1),
        ) * step / 3

    return integral(start) / integral(F.lit(0.0))


def t_test(series: DataFrame, value: str) -> DataFrame:
    """One row: n, t statistic against zero and its two-sided p-value (null under three values)."""
    stats = series.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    ok = (F.col("n") > 2) & (F.col("s") > 0)
    t = F.when(ok, F.col("m") / (F.col("s") / F.sqrt("n")))
    stats = stats.select("n", t.alias("t_stat"), F.when(ok, F.col("n") - 1.0).alias("v"))
    return stats.select("n", "t_stat", F.when(F.col("v").isNotNull(), student_p(F.col("t_stat"), F.col("v"))).alias("p_value"))


def tall(row: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row frame as (metric, value) rows, so that records are unions and not joins."""
    pairs = [F.struct(F.lit(prefix + c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def ranking_metrics(df: DataFrame, min_stocks: int = 5, n_hits: int = 10, horizon_days: int = 30) -> DataFrame:
    """The whole record as (metric, value) rows."""
    df = stored(_pairs(df))
    bins = stored(quantile_returns(df))
    parts = [
        tall(icir(ic_by_date(df, min_stocks), "ic", horizon_days)),
        tall(icir(rank_ic_by_date(df, min_stocks), "rank_ic", horizon_days), "rank_"),
        tall(hit_rate(df, n_hits)), tall(spread(bins), "quintile_"), tall(coverage(df, min_stocks)),
        bins.select(F.concat(F.lit("quintile_"), F.col("bin").cast("string")).alias("metric"), F.col("mean_return").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
