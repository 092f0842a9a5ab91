"""Statistics of a return series (timestamp, ret); every function also works per group through ``keys``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import DAY_MS, pearson, rmean, rstd
from panelforge.operators.metrics import stability, t_test, tall
from panelforge.operators.ordered import group_quantiles, over_series, running
from panelforge.session import stored

INF = float("inf")


def cumulative(series: DataFrame, keys: Sequence[str] = (), value: str = "ret") -> DataFrame:
    """Add ``cumulative``: product(1 + ret) - 1 so far."""
    out = running(series, {"_wealth": ("product", 1 + F.col(value))}, keys, ["timestamp"])
    return out.withColumn("cumulative", F.col("_wealth") - 1).drop("_wealth")


def drawdowns(series: DataFrame, keys: Sequence[str] = (), value: str = "ret") -> DataFrame:
    """Add ``cumulative`` and ``drawdown`` = (running peak of wealth - wealth) / peak."""
    wealth = cumulative(series, keys, value)
    out = running(wealth, {"_peak": ("max", 1 + F.col("cumulative"))}, keys, ["timestamp"])
    return out.withColumn("drawdown", F.try_divide(F.col("_peak") - 1 - F.col("cumulative"), F.col("_peak"))).drop("_peak")


def max_drawdown(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    return drawdowns(series, keys).groupBy(*keys).agg(F.when(n >= 2, F.max("drawdown")).otherwise(0.0).alias("max_drawdown"))


def sharpe_value(mean: Column, std: Column, periods: Column) -> Column:
    """mean/std*sqrt(periods); without spread the sign of the mean times infinity, or zero."""
    flat = F.when(mean > 0, F.lit(INF)).when(mean < 0, F.lit(-INF)).otherwise(0.0)
    return F.when(std.isNull() | (std == 0), flat).otherwise(mean / F.when(std != 0, std) * F.sqrt(periods))


def sharpe(series: DataFrame, periods_per_year: float, risk_free: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    m, s, n = F.avg("ret") - risk_free / periods_per_year, F.stddev_samp("ret"), F.count("ret")
    return series.groupBy(*keys).agg(F.when(n >= 2, sharpe_value(m, s, F.lit(float(periods_per_year)))).alias("sharpe"))


def periods_per_year(series: DataFrame) -> DataFrame:
    """One row: annualisation factor guessed from the median spacing of the timestamps."""
    gaps = over_series(series.select("timestamp"), [lambda w: {"gap": (F.col("timestamp") - w.lag("timestamp")) / float(DAY_MS)}], 1, ())
    median = group_quantiles(gaps, [], "gap", [0.5]).select(F.col("edges")[0].alias("d"))
    guess = F.when(F.col("d") < 3, 252).when(F.col("d") < 8, 52).when(F.col("d") < 25, 12).otherwise(
        F.greatest(F.lit(1), F.floor(365 / F.col("d")).cast("int")))
    return median.agg(F.coalesce(F.max(guess), F.lit(252)).alias("periods_per_year"))


def sharpe_inferred(series: DataFrame, risk_free: float = 0.0) -> DataFrame:
    return sharpe(series, periods_per_year(series).first()[0], risk_free)


def sharpe_from_span(series: DataFrame, risk_free: float = 0.0, keys: Sequence[str] = (), value: str = "ret", name: str = "sharpe") -> DataFrame:
    """Annualised by observations per 365-day year of the covered span."""
    n = F.count(value)
    years = (F.max("timestamp") - F.min("timestamp")) / float(DAY_MS) / 365.0
    per_year = n / F.when(years > 0, years)
    mean = F.avg(value) - F.when(per_year > 0, F.lit(risk_free) / per_year).otherwise(0.0)
    return series.groupBy(*keys).agg(F.when((n >= 2) & (years > 0), sharpe_value(mean, F.stddev_samp(value), per_year)).alias(name))


def sortino(series: DataFrame, target: float = 0.0, periods: int = 252) -> DataFrame:
    x = F.col("ret") - target / periods
    low = F.when(x < 0, x)
    rms = F.sqrt(F.avg(low * low))
    usable = (F.count("ret") >= 10) & (F.count(low) >= 3) & (rms >= 1e-10)
    return series.agg(F.when(usable, F.avg(x) / rms * math.sqrt(periods)).alias("sortino"))


def calmar(series: DataFrame, periods: int = 252) -> DataFrame:
    """Annualised return over maximum drawdown; null when the drawdown is under 0.1 %."""
    row = drawdowns(series).agg(F.product(1 + F.col("ret")).alias("total"), F.count("ret").alias("n"), F.max("drawdown").alias("dd"))
    yearly = F.pow(F.col("total"), F.lit(float(periods)) / F.col("n")) - 1
    return row.select(F.when((F.col("n") >= 2) & (F.col("dd") >= 0.001), yearly / F.when(F.col("dd") > 0, F.col("dd"))).alias("calmar"))


def tail_ratio(series: DataFrame, percentile: float = 95) -> DataFrame:
    n = series.agg(F.count("ret").alias("n")).first()["n"]
    edges = group_quantiles(series, [], "ret", [percentile / 100, 1 - percentile / 100])
    right, left = F.abs(F.col("edges")[0]), F.abs(F.col("edges")[1])
    return edges.agg(F.max(F.when((F.lit(n) >= 10) & (left >= 1e-10), F.try_divide(right, left))).alias("tail_ratio"))


def omega(series: DataFrame, threshold: float = 0.0) -> DataFrame:
    x = F.col("ret") - threshold
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x <= 0, -x)), F.lit(0.0))
    value = F.when(losses < 1e-10, F.when(gains > 1e-10, F.lit(None)).otherwise(1.0)).otherwise(F.try_divide(gains, losses))
    return series.agg(F.when(F.count("ret") >= 2, value).alias("omega"))


def streaks(series: DataFrame) -> DataFrame:
    """One row: longest run of positive and of non-positive returns."""
    def runs(positive: bool, name: str) -> DataFrame:
        # The run a row is in is named by the last row of the other sign before it.
        other = F.when((F.col("ret") > 0) != positive, F.col("timestamp"))
        marked = running(series.select("timestamp", "ret"), {"_since": ("max", other)}, [], ["timestamp"])
        sizes = marked.filter((F.col("ret") > 0) == positive).groupBy("_since").agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.lit(name).alias("metric"), F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("value"))

    both = runs(True, "max_consecutive_wins").unionByName(runs(False, "max_consecutive_losses"))
    return wide(both, ["max_consecutive_wins", "max_consecutive_losses"])


def wide(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, value) rows as one row."""
    return rows.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def win_loss(series: DataFrame) -> DataFrame:
    r = F.col("ret")
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    n, zero = F.count("ret"), F.lit(0.0)
    rate_w, rate_l = F.count(win) / n, F.count(loss) / n
    avg_w, avg_l = F.coalesce(F.avg(win), zero), F.coalesce(F.avg(loss), zero)
    sum_w, sum_l = F.coalesce(F.sum(win), zero), F.abs(F.coalesce(F.sum(loss), zero))
    enough = n >= 2
    return series.agg(
        F.when(enough, rate_w).alias("win_rate"), F.when(enough, rate_l).alias("loss_rate"), F.when(enough, avg_w).alias("avg_win"),
        F.when(enough, avg_l).alias("avg_loss"),
        F.when(enough & (F.abs(avg_l) > 1e-10), F.abs(F.try_divide(avg_w, avg_l))).alias("win_loss_ratio"),
        F.when(enough & (sum_l > 1e-10), F.try_divide(sum_w, sum_l)).alias("profit_factor"),
        F.when(enough, rate_w * avg_w + rate_l * avg_l).alias("expectancy"),
    )


def annual_statistics(series: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """One row over calendar years with 200 returns or more; empty without 252 returns and two such years."""
    yearly = series.groupBy(F.year(F.timestamp_millis("timestamp")).alias("year")).agg(
        (F.product(1 + F.col("ret")) - 1).alias("annual"), F.count("ret").alias("days"),
        (F.avg("ret") - risk_free / 252).alias("m"), F.stddev_samp("ret").alias("s"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )
    full = F.col("days") >= 200
    a = F.when(full, F.col("annual"))
    years = F.count(a)
    one_sharpe = F.when(full & (F.col("s") > 0), F.col("m") / F.when(F.col("s") > 0, F.col("s")) * math.sqrt(252))
    quant = F.percentile(a, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))  # one value per calendar year
    row = yearly.agg(
        F.sum("days").alias("days"), F.avg(a).alias("mean_annual_return"), quant.alias("q"), F.stddev_samp(a).alias("std_annual_return"),
        F.min(a).alias("min_annual_return"), F.max(a).alias("max_annual_return"),
        F.avg((a > 0).cast("double")).alias("pct_positive_years"),
        F.coalesce(F.avg(F.when(a > 0, a)), F.lit(0.0)).alias("avg_positive_year"),
        F.coalesce(F.avg(F.when(a <= 0, a)), F.lit(0.0)).alias("avg_negative_year"),
        F.skewness(a).alias("skewness_annual"), F.kurtosis(a).alias("kurtosis_annual"),
        F.avg(one_sharpe).alias("sharpe_annual_avg"), years.alias("num_years"),
        (F.floor((F.max("last") - F.min("first")) / DAY_MS) / 365.0).alias("years_sampled"),
    )
    names = ("pct_5_annual_return", "pct_25_annual_return", "median_annual_return", "pct_75_annual_return", "pct_95_annual_return")
    return row.filter((F.col("days") >= 252) & (F.col("num_years") >= 2)).select(
        "*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q", "days")


def monthly_matrix(series: DataFrame) -> DataFrame:
    """year x month compounded returns."""
    t = F.timestamp_millis("timestamp")
    monthly = series.groupBy(F.year(t).alias("year"), F.month(t).alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    return monthly.groupBy("year").agg(*[F.max(F.when(F.col("month") == m, F.col("r"))).alias(f"m{m:02d}") for m in range(1, 13)])


def rolling_sharpe(series: DataFrame, windows: Sequence[int] = (20, 60, 120)) -> DataFrame:
    """timestamp, sharpe_<n>: rolling mean over deviation, annualised by 252."""
    return over_series(series.select("timestamp", "ret"), [lambda w: {
        f"sharpe_{n}": F.try_divide(rmean("ret", n, w), rstd("ret", n, w)) * math.sqrt(252) for n in windows
    }], max(windows), ()).drop("ret")


def rolling_level(series: DataFrame, value: str, windows: Sequence[int]) -> DataFrame:
    """timestamp, mean_<n>, std_<n> with short starts allowed."""
    return over_series(series.select("timestamp", value), [lambda w: {
        **{f"mean_{n}": rmean(value, n, w, 1) for n in windows}, **{f"std_{n}": rstd(value, n, w, 1) for n in windows}
    }], max(windows), ()).drop(value)


def cumulative_spread(by_date: DataFrame, n: int = 5) -> DataFrame:
    """timestamp, spread, cumulative: compounding of the top-less-bottom bin returns."""
    rows = by_date.select("timestamp", (F.col(f"Q{n}") - F.col("Q1")).alias("ret")).filter("ret is not null")
    return cumulative(rows).withColumnRenamed("ret", "spread")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin 0.., low, high, n): equal-width bins between the smallest and largest value; empty bins left out."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, width = float(ends["lo"]), (float(ends["hi"]) - float(ends["lo"])) / bins
    place = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    out = df.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def fit_line(df: DataFrame, x: str = "predicted_score", y: str = "actual_return") -> DataFrame:
    """Least-squares line and correlation over all rows."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), pearson(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def comprehensive(series: DataFrame, ic: DataFrame, horizon_days: int = 30) -> DataFrame:
    """(metric, value) rows of return, streak, stability and significance measures."""
    periods = max(1, 252 // horizon_days)
    series, ic = stored(series), stored(ic)
    parts = [
        tall(sortino(series, periods=periods)), tall(calmar(series, periods)), tall(tail_ratio(series)), tall(omega(series)),
        tall(win_loss(series)), tall(streaks(series)), tall(stability(ic).drop("n")),
        tall(t_test(ic, "ic").select("p_value"), "ic_ttest_"), tall(t_test(series, "ret").select("p_value"), "returns_ttest_"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
