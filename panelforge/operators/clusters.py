"""Ticker characteristics, clusters of them, and cluster-relative features and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import clip, finite, kurt_sample, pearson, rstd, skew_sample
from panelforge.operators.ordered import average_ranks, lookup, number_rows, over_series, running
from panelforge.operators.panel import LOCAL_SUFFIX
from panelforge.session import stored

YEAR = math.sqrt(252)
FULL_FEATURES = ("volatility", "mean_return", "skewness", "kurtosis", "autocorr", "pos_days_pct", "max_drawdown")
FAST_FEATURES = ("volatility", "mean_return", "skewness", "kurtosis", "autocorr", "pos_days_pct", "vol_of_vol")


def recent(panel: DataFrame, timestamps: int, suffix: str = LOCAL_SUFFIX) -> DataFrame:
    """Local tickers' rows on the last N distinct timestamps."""
    local = panel.filter(F.col("ticker").endswith(suffix)).select("timestamp", "ticker", F.col("Close").cast("double").alias("Close"))
    last = local.select("timestamp").distinct().orderBy(F.col("timestamp").desc()).limit(timestamps)
    start = last.agg(F.min("timestamp")).first()[0]
    return local.filter(F.col("timestamp") >= F.lit(start))


def ticker_characteristics(panel: DataFrame, lookback: int = 500, min_obs: int = 100, limit: float = 1.0) -> DataFrame:
    """Risk and return figures per ticker over the last ``lookback`` timestamps; daily returns clipped."""
    rows = recent(panel, lookback)
    rows = over_series(rows, [lambda w: {"ret": finite(F.try_divide(F.col("Close") - w.lag("Close"), w.lag("Close")))}], 1)
    rows = running(rows, {"peak": ("max", F.col("Close"))}, ["ticker"], ["timestamp"])
    rows = rows.withColumn("fall", F.try_divide(F.col("Close") - F.col("peak"), F.col("peak")))
    falls = rows.groupBy("ticker").agg(F.min("fall").alias("max_drawdown"), F.count("Close").alias("n_prices"))
    kept = rows.filter("ret is not null").withColumn("x", clip(F.col("ret"), -limit, limit))
    kept = over_series(kept, [lambda w: {"before": w.lag("x")}], 1)
    n = F.count("x")
    stats = kept.groupBy("ticker").agg(
        (F.stddev_pop("x") * YEAR).alias("volatility"), (F.avg("x") * 252).alias("mean_return"),
        skew_sample("x", n).alias("skewness"), kurt_sample("x", n).alias("kurtosis"),
        F.when(n > 10, pearson("x", "before")).otherwise(0.0).alias("autocorr"),
        F.avg((F.col("x") > 0).cast("double")).alias("pos_days_pct"), n.alias("n_obs"),
        F.avg((F.abs("ret") > limit).cast("double")).alias("anomaly_rate"),
    )
    return lookup(stats, falls, ["ticker"]).filter((F.col("n_prices") >= min_obs) & (F.col("n_obs") >= min_obs)).drop("n_prices")


def grid_returns(panel: DataFrame, lookback: int = 500, limit: float = 1.0) -> DataFrame:
    """(timestamp, ticker, x): returns between neighbouring timestamps of the common grid, none across gaps."""
    rows = recent(panel, lookback)
    grid = number_rows(rows.select("timestamp").distinct(), [], ["timestamp"]).select("timestamp", F.col("_pos").alias("place"))
    placed = lookup(rows, stored(grid), ["timestamp"])
    back = over_series(placed, [lambda w: {"ret": F.when(
        w.lag("place") == F.col("place") - 1, finite(F.try_divide(F.col("Close") - w.lag("Close"), w.lag("Close"))))}], 1)
    return back.filter("ret is not null").select("timestamp", "ticker", clip(F.col("ret"), -limit, limit).alias("x"))


def fast_characteristics(panel: DataFrame, lookback: int = 500, min_obs: int = 100, limit: float = 1.0) -> DataFrame:
    """Seven figures per ticker from grid returns; all zero under fifty returns."""
    rows = grid_returns(panel, lookback, limit)
    rows = over_series(rows, [lambda w: {"before": w.lag("x"), "std20": rstd("x", 20, w)}], 20)
    n = F.count("x")
    figures = {
        "volatility": F.stddev_samp("x") * YEAR, "mean_return": F.avg("x") * 252, "skewness": skew_sample("x", n),
        "kurtosis": kurt_sample("x", n), "autocorr": pearson("x", "before"),
        "pos_days_pct": F.avg((F.col("x") > 0).cast("double")), "vol_of_vol": F.stddev_samp("std20") * YEAR,
    }
    stats = rows.groupBy("ticker").agg(n.alias("n_obs"), *[F.when(n >= 50, e).otherwise(0.0).alias(c) for c, e in figures.items()])
    return stats.filter(F.col("n_obs") >= min_obs)


def z_scores(stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing and infinite figures become zero, then (x - mean) / population deviation."""
    clean = stats.select("ticker", *[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in features])
    row = clean.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]).first()
    return clean.select("ticker", *[((F.col(c) - F.lit(row[c]["m"])) / F.lit(row[c]["s"] or 1.0)).alias(c) for c in features])


def assign_clusters(
    stats: DataFrame, features: Sequence[str] = FULL_FEATURES, k: int = 6, divisor: int = 5, seed: int = 42, starts: int = 10, rounds: int = 20
) -> DataFrame:
    """(ticker, cluster): k-means on standardised figures, the cheapest of several starts; fewer clusters for few tickers.

    All starts run side by side. A start draws its centres by hash, each with a chance in proportion to the squared distance from those it has, and
    moves them ``rounds`` times; a centre that lost all its tickers stays where it was. The same figures always give the same clusters.
    """
    n = stats.count()
    if n < 2:
        return stats.select("ticker", F.lit(0).alias("cluster"))
    if n < k:
        k = max(2, n // divisor)
    names = list(features)
    points = stored(z_scores(stats, names).select("ticker", F.array(*names).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")))
    centers: dict[tuple[int, int], list[float]] = {}
    for turn in range(k):
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("start").cast("string"), F.lit(str(turn)), F.col("ticker")))
        chance = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(16.0**13)
        away = _nearest(points, centers) if centers else points.withColumn("cost", F.lit(1.0))
        # The first of exponential arrivals, at rates in proportion to the costs.
        drawn = away.filter("cost > 0").groupBy("start").agg(F.min_by("x", F.struct((-F.log(chance) / F.col("cost")).alias("wait"), F.col("ticker"))).alias("x"))
        centers |= {(r["start"], turn): r["x"] for r in drawn.collect()}  # one row per start
    for _ in range(rounds):
        means = _nearest(points, centers).groupBy("start", "cluster").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(len(names))]).alias("x"))
        centers |= {(r["start"], r["cluster"]): r["x"] for r in means.collect()}  # one row per start and cluster
    last = stored(_nearest(points, centers))
    # Starts that end alike differ in the last digits only.
    cost = F.floor(F.sum("cost") * F.lit(1e6) + F.lit(0.5)).alias("cost")
    best = last.groupBy("start").agg(cost).orderBy("cost", "start").first()["start"]
    kept = last.filter(F.col("start") == best).select("ticker", "cluster")
    # Numbered by their first ticker, since two starts may find the same clusters in another order.
    firsts = kept.groupBy("cluster").agg(F.min("ticker").alias("first"))
    numbers = firsts.select("cluster", (F.row_number().over(Window.orderBy("first")) - 1).alias("number"))  # k rows
    return kept.join(F.broadcast(numbers), "cluster").select("ticker", F.col("number").cast("int").alias("cluster"))


def _nearest(points: DataFrame, centers: dict[tuple[int, int], list[float]]) -> DataFrame:
    """Add the ``cluster`` of each point among the centres of its start, the smaller number where two are as near, and its ``cost``."""
    spark = points.sparkSession
    rows = [(s, k, [float(v) for v in x]) for (s, k), x in sorted(centers.items())]
    table = spark.createDataFrame(rows, "start int, cluster int, c array<double>").groupBy("start").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("_centers"))  # starts times clusters rows

    def cost(c: Column) -> Column:
        return F.aggregate(F.zip_with("x", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    best = F.array_min(F.transform("_centers", lambda c: F.struct(cost(c).alias("cost"), c["cluster"].alias("cluster"))))
    return points.join(F.broadcast(table), "start").withColumn("_best", best).select("ticker", "x", "start", "_best.cluster", "_best.cost")


def rolling_clusters(panel: DataFrame, train_end: int, k: int = 10, lookback: int = 500, min_obs: int = 100) -> DataFrame:
    """Clusters from rows up to the end of training only."""
    stats = stored(fast_characteristics(panel.filter(F.col("timestamp") <= train_end), lookback, min_obs))
    return assign_clusters(stats, FAST_FEATURES, k, 3)


def with_cluster(df: DataFrame, clusters: DataFrame) -> DataFrame:
    joined = lookup(df, clusters.select("ticker", F.col("cluster").cast("int").alias("Cluster")), ["ticker"])
    return joined.withColumn("Cluster", F.coalesce("Cluster", F.lit(-1)))


def add_cluster_features(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster, its size and mean on the date, and the price's percentile inside it."""
    keys = ["timestamp", "Cluster"]
    rows = with_cluster(df, clusters)
    ranked = average_ranks(rows, ["Close"], keys)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("Cluster_Size"), F.avg("Close").alias("_mean"))
    joined = lookup(ranked, totals, keys)
    pct = F.try_divide(F.col("_rank_Close"), F.col("_count_Close"))
    return joined.select(
        *df.columns, "Cluster", "Cluster_Size", pct.alias("Rank_Close_InCluster"),
        F.try_divide(F.col("Close") - F.col("_mean"), F.col("_mean")).alias("Dist_Cluster_Mean_Close"),
        F.coalesce(pct, F.lit(0.5)).alias("Rank_InCluster"),
    )


def cluster_label(volatility: Column, mean_return: Column) -> Column:
    """Name by volatility band and sign of the return."""
    up = mean_return > 0
    return (
        F.when(volatility < 0.25, F.when(up, "Defensive/Quality").otherwise("Value/Turnaround"))
        .when(volatility < 0.50, F.when(up, "Growth").otherwise("Cyclical/Challenged"))
        .otherwise(F.when(up, "Speculative/Momentum").otherwise("Distressed"))
    )


def cluster_summary(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: size, mean figures and label."""
    joined = lookup(stats, clusters.select("ticker", "cluster"), ["ticker"], "inner")
    out = joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        *[F.avg(c).alias(c) for c in ("volatility", "mean_return", "skewness", "kurtosis", "max_drawdown", "pos_days_pct")])
    return out.withColumn("label", cluster_label(F.coalesce("volatility", F.lit(0.3)), F.coalesce("mean_return", F.lit(0.0))))


def cluster_members(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ticker, cluster, label): one row per member instead of a collected list."""
    labels = cluster_summary(stats, clusters).select("cluster", "label")
    return lookup(clusters.select("ticker", "cluster"), labels, ["cluster"])


def describe_clusters(panel: DataFrame, clusters: DataFrame, lookback: int = 250, min_obs: int = 50) -> DataFrame:
    """Per cluster: size, mean volatility and return, and a plain description with its own thresholds."""
    stats = ticker_characteristics(panel, lookback, min_obs).select("ticker", "volatility", "mean_return")
    joined = lookup(stats, clusters.select("ticker", "cluster"), ["ticker"], "inner")
    out = joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_stocks"), F.avg("volatility").alias("avg_vol"), F.avg("mean_return").alias("avg_ret"))
    vol = F.when(F.col("avg_vol") < 0.25, "Low-vol").when(F.col("avg_vol") < 0.45, "Mid-vol").otherwise("High-vol")
    ret = F.when(F.col("avg_ret") > 0.15, "growth").when(F.col("avg_ret") > -0.05, "stable").otherwise("declining")
    return out.withColumn("interpretation", F.concat_ws(" ", vol, ret))


def performance_by_cluster(predictions: DataFrame, clusters: DataFrame, min_rows: int = 5) -> DataFrame:
    """Per cluster with enough rows: counts, Pearson and rank correlation, hit rate, mean and deviation of returns."""
    rows = with_cluster(predictions, clusters).withColumnRenamed("Cluster", "cluster")
    ranked = average_ranks(rows, ["predicted_score", "actual_return"], ["cluster"])
    return ranked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.count_distinct("ticker").alias("n_unique_tickers"),
        pearson("predicted_score", "actual_return").alias("pearson_ic"),
        pearson("_rank_predicted_score", "_rank_actual_return").alias("rank_ic"),
        F.avg((F.col("actual_return") > 0).cast("double")).alias("hit_rate"), F.avg("actual_return").alias("avg_return"),
        F.stddev_samp("actual_return").alias("return_std"),
    ).filter(F.col("n_predictions") >= min_rows)


def pair_correlations(returns: DataFrame, pairs: DataFrame, min_common: int = 50) -> DataFrame:
    """(a, b, correlation, distance = 1 - correlation) of listed ticker pairs; zero correlation under ``min_common`` common dates.

    Only the listed pairs are formed: each return goes to the pairs its ticker is in.
    """
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("ticker"), "a", "b", F.lit(True).alias("first")),
        F.struct(F.col("b").alias("ticker"), "a", "b", F.lit(False).alias("first")),
    )).alias("s")).select("s.*")
    rows = lookup(returns, sides, ["ticker"], "inner", one_per_key=False).groupBy("a", "b", "timestamp").agg(
        F.max(F.when(F.col("first"), F.col("x"))).alias("x"), F.max(F.when(~F.col("first"), F.col("x"))).alias("y"),
    ).filter("x is not null and y is not null")
    found = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("c"))
    joined = pairs.select("a", "b").join(found, ["a", "b"], "left")
    value = F.coalesce(F.when(F.col("n") >= min_common, F.col("c")), F.lit(0.0))
    return joined.select("a", "b", value.alias("correlation"), clip(1 - value, 0.0, 2.0).alias("distance"))


#: Tickers in a block of ``nearest_tickers``, the rows that are multiplied at a time.
BLOCK_TICKERS = 256
#: Groups of tickers that ``nearest_tickers`` makes at least, for its tasks to be many, and the bytes of returns that a group holds at most.
NEAREST_GROUPS = 16
NEAREST_BYTES = 64_000_000


def nearest_tickers(
    returns: DataFrame, k: int = 10, min_common: int = 50, block_tickers: int = BLOCK_TICKERS, group_bytes: int = NEAREST_BYTES
) -> DataFrame:
    """(ticker, place, other, correlation, distance): each ticker's ``k`` most correlated others, best first, ties by name.

    Correlations are taken over the dates common to both; under ``min_common`` of them, or without spread, they are zero. Tickers are dealt to
    groups by hash, every two groups meet in one task, which multiplies them as matrices, ``block_tickers`` rows at a time, and passes on ``k`` rows per
    ticker; the whole matrix is never formed. A series is sent once per group, and the number of groups does not grow before a group's grid of returns
    reaches ``group_bytes``. A task holds two groups and a few arrays of ``block_tickers`` rows by the tickers of a group.
    """
    rows = returns.filter("ticker is not null and x is not null")
    series = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("timestamp", "x"))).alias("_rows"))
    series = stored(series.select("ticker", F.col("_rows.timestamp").alias("at"), F.col("_rows.x").alias("x")))
    tickers, dates = series.count(), series.select(F.explode("at").alias("at")).distinct().count()
    groups = _groups_to_meet(tickers, dates, block_tickers, group_bytes)
    own = F.pmod(F.xxhash64("ticker"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = series.withColumn("own", own).withColumn("other", other).select(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "ticker", "at", "x")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker", ignore_index=True)
        first, second = (rows[rows["own"] == rows[side].iloc[0]] for side in ("a", "b"))
        found = _best_others(first, second, k, min_common, block_tickers)
        if rows["a"].iloc[0] != rows["b"].iloc[0]:
            found += _best_others(second, first, k, min_common, block_tickers)
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"ticker": [], "other": [], "correlation": []})

    met = dealt.groupBy("a", "b").applyInPandas(meet, "ticker string, other string, correlation double")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("correlation").desc(), "other"))
    best = met.withColumn("place", place).filter(F.col("place") <= k)
    return best.select("ticker", "place", "other", "correlation", clip(1 - F.col("correlation"), 0.0, 2.0).alias("distance"))


def _groups_to_meet(tickers: int, dates: int, block: int, group_bytes: int) -> int:
    """Copies that are sent of a series: enough for many tasks, more only where a group's values and marks would not fit."""
    return max(1, min(NEAREST_GROUPS, math.ceil(tickers / block)), math.ceil(tickers * dates * 16 / group_bytes))


def _best_others(rows: pd.DataFrame, others: pd.DataFrame, k: int, min_common: int, block: int) -> list[pd.DataFrame]:
    """The ``k`` best of ``others`` for each of ``rows``, ``block`` rows at a time."""
    return [_best_of(part, others, r, k) for part, r in _correlations(rows, others, min_common, block)]


def _correlations(first: pd.DataFrame, second: pd.DataFrame, min_common: int, block: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Blocks of ``first`` with the correlation of each of their rows with every row of ``second``, over their common dates."""
    if not len(first) or not len(second):
        return
    dates = np.unique(np.concatenate([*first["at"], *second["at"]]))

    def grid(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        value, known = np.zeros((len(rows), len(dates))), np.zeros((len(rows), len(dates)))
        for i, (at, x) in enumerate(zip(rows["at"], rows["x"])):
            place = np.searchsorted(dates, at)
            value[i, place], known[i, place] = x, 1.0
        return value, known

    y, q = grid(second)
    yy = y * y
    for begin in range(0, len(first), block):
        part = first.iloc[begin:begin + block]
        x, p = grid(part)
        n = p @ q.T
        with np.errstate(divide="ignore", invalid="ignore"):
            mx, my = x @ q.T / n, p @ y.T / n
            cov, vx, vy = x @ y.T / n - mx * my, (x * x) @ q.T / n - mx * mx, p @ yy.T / n - my * my
            r = np.clip(cov / np.sqrt(vx * vy), -1.0, 1.0)
        spread = (vx > 1e-14 * (mx * mx + vx)) & (vy > 1e-14 * (my * my + vy))
        # The last digits depend on how the products are blocked, and must not part equal correlations.
        yield part, np.round(np.where((n >= min_common) & spread & np.isfinite(r), r, 0.0), 12) + 0.0


def _best_of(rows: pd.DataFrame, others: pd.DataFrame, r: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best columns of each row; columns are sorted by name, which settles ties."""
    names, mine = others["ticker"].to_numpy(), rows["ticker"].to_numpy()
    # Names are sorted on both sides, so a row's own columns are one run.
    left, right = np.searchsorted(names, mine, side="left"), np.searchsorted(names, mine, side="right")
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        r[i, a:b] = -np.inf
    k = min(k, r.shape[1])
    least = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k]
    row, column = np.nonzero((r >= least[:, None]) & np.isfinite(r))  # in order of rows and columns
    order = np.lexsort((column, -r[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return pd.DataFrame({"ticker": mine[row], "other": names[column], "correlation": r[row, column]})


def pair_agreement(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per group of listed pairs (group, a, b): share whose two tickers are in one cluster, of pairs with both known."""
    side = lambda c: clusters.select(F.col("ticker").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    both = lookup(lookup(pairs, side("a"), ["a"], "inner"), side("b"), ["b"], "inner")
    return both.groupBy("group").agg(
        F.avg((F.col("a_cluster") == F.col("b_cluster")).cast("double")).alias("share_together"), F.count(F.lit(1)).alias("n_pairs"))
