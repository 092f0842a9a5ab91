"""Stability of returns over windows, composite scores, sweeps and comparison of stored runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.metrics import ic_by_date, icir
from panelforge.operators.portfolio import PortfolioConfig, backtest_periods, summarize
from panelforge.session import stored


def window_returns(series: DataFrame, windows: Sequence[tuple[int, int]], risk_free: float = 0.0) -> DataFrame:
    """(window_id, total_return, sharpe) of windows [start, end] with five returns or more."""
    member = F.array_compact(F.array(*[
        F.when((F.col("timestamp") >= a) & (F.col("timestamp") <= b), F.lit(i)) for i, (a, b) in enumerate(windows)
    ]))
    rows = series.select("timestamp", "ret", F.explode(member).alias("window_id"))
    s = F.stddev_samp("ret")
    return rows.groupBy("window_id").agg(
        (F.product(1 + F.col("ret")) - 1).alias("total_return"),
        F.when(s > 0, (F.avg("ret") - risk_free / 252) / F.when(s > 0, s) * math.sqrt(252)).otherwise(0.0).alias("sharpe"),
        F.count("ret").alias("n"),
    ).filter(F.col("n") >= 5).drop("n")


def window_statistics(per_window: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.avg((F.col(c) > 0).cast("double")), F.lit(0.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return per_window.agg(
        share("sharpe").alias("pct_positive_sharpe"), share("total_return").alias("pct_positive_return"),
        zero(F.avg("sharpe")).alias("mean_sharpe"), zero(F.stddev_pop("sharpe")).alias("std_sharpe"),
        zero(F.avg("total_return")).alias("mean_return"), zero(F.stddev_pop("total_return")).alias("std_return"),
        zero(F.min("total_return")).alias("worst_return"), zero(F.max("total_return")).alias("best_return"),
    )


# Weights of the composite score (fixed values).
WEIGHTS = {"sharpe": 0.30, "icir": 0.25, "consistency": 0.25, "drawdown_penalty": 0.10, "volatility_penalty": 0.10}


def robustness_score(sharpe: Column, icir_value: Column, drawdown: Column, positive: Column, sharpe_std: Column,
                     weights: dict[str, float] = WEIGHTS) -> Column:
    """Capped return and signal terms plus consistency, less drawdown and instability penalties."""
    fall = F.least(F.greatest((drawdown - 0.15) / 0.25, F.lit(0.0)), F.lit(1.0))
    return (
        F.least(sharpe, F.lit(1.5)) * weights["sharpe"] + F.least(icir_value, F.lit(1.5)) * weights["icir"]
        + positive * weights["consistency"] - fall * weights["drawdown_penalty"]
        - F.least(sharpe_std, F.lit(1.0)) * weights["volatility_penalty"]
    )


def robustness(series: DataFrame, windows: Sequence[tuple[int, int]], sharpe: float, icir_value: float, drawdown: float) -> DataFrame:
    """One row: window statistics and the composite score of given headline figures."""
    stats = window_statistics(window_returns(series, windows))
    score = robustness_score(F.lit(sharpe), F.lit(icir_value), F.lit(drawdown), F.col("pct_positive_sharpe"), F.col("std_sharpe"))
    return stats.withColumn("robustness_score", score)


def config_sweep(df: DataFrame, configs: Sequence[PortfolioConfig], horizon_days: int) -> DataFrame:
    """Configurations with their backtest record and rank, all computed in one grouped job."""
    from pyspark.sql import Window

    df = stored(df)
    records = summarize(backtest_periods(df, configs, horizon_days))
    signal = icir(ic_by_date(df), "ic", horizon_days).first()["icir"] or 0.0
    score = robustness_score(F.col("sharpe"), F.lit(float(signal)), F.col("max_drawdown"), F.lit(0.5), F.lit(0.5))
    scored = records.select("config_id", "sharpe", "max_drawdown", "total_return", score.alias("robustness_score"))
    # One row per configuration, a list given by the caller.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("robustness_score").desc(), "config_id")))


def read_runs(spark, path: str) -> DataFrame:
    """Stored metric files (run, metric, value), one JSON object per line."""
    return spark.read.schema("run string, metric string, value double").json(path)


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, a, b, diff) of metrics that differ; a metric missing on one side counts as zero."""
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    both = runs.filter(F.col("run").isin(a, b)).groupBy("metric").agg(F.coalesce(pick(a), F.lit(0.0)).alias("a"), F.coalesce(pick(b), F.lit(0.0)).alias("b"))
    return both.filter("a != b").withColumn("diff", F.col("b") - F.col("a"))


def best_run(runs: DataFrame, metric: str = "sharpe_ratio", higher_is_better: bool = True) -> DataFrame:
    """One row: the run with the best value of a metric; equal values go to the first name."""
    rows = runs.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    key = F.struct(F.col("value") if not higher_is_better else -F.col("value"), F.col("run"))
    return rows.agg(F.min_by("run", key).alias("run"), F.min_by("value", key).alias("value")).filter("run is not null")
