"""Top/bottom-N portfolios: positions, period and daily returns, turnover, costs, backtest records.

Every step is grouped by a ``config_id`` (and optional further keys), so a single
backtest, a parameter sweep and a permutation baseline are the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import DAY_MS
from panelforge.operators.labels import rebalance_dates
from panelforge.operators.ordered import fill_last, lookup, number_rows, over_series, running
from panelforge.operators.returns import cumulative, max_drawdown, sharpe_from_span
from panelforge.session import stored


@dataclass(frozen=True)
class PortfolioConfig:
    top_n: int = 10
    bottom_n: int = 10
    cost_bps: float = 10.0
    slippage_bps: float = 0.0
    long_only: bool = False

    def __post_init__(self):
        if self.top_n <= 0:
            raise ValueError("top_n must be positive")
        if self.bottom_n < 0:
            raise ValueError("bottom_n must not be negative")

    @property
    def total_cost_bps(self) -> float:
        return self.cost_bps + self.slippage_bps


def _config_rows(configs: Sequence[PortfolioConfig]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("config_id"), F.lit(c.top_n).alias("top_n"), F.lit(c.bottom_n).alias("bottom_n"),
                 F.lit(0 if c.long_only else c.bottom_n).alias("shorts"), F.lit(c.total_cost_bps).alias("bps"))
        for i, c in enumerate(configs)
    ])


def positions(
    df: DataFrame, configs: Sequence[PortfolioConfig], keys: Sequence[str] = (), score: str = "predicted_score"
) -> DataFrame:
    """keys, config_id, timestamp, ticker, side, weight, actual_return, bps of dates with enough rows.

    Only the best and worst N rows of a date leave each task (top-k pushdown), whatever the date's size.
    """
    scope = [*keys, "config_id", "timestamp"]
    rows = df.select(*keys, "timestamp", "ticker", F.col(score).alias("_score"), "actual_return")
    sizes = rows.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("_rows"))
    enough = sizes.withColumn("_c", F.explode(_config_rows(configs))).select("*", "_c.*").filter(
        F.col("_rows") >= F.col("top_n") + F.col("bottom_n")).select(*scope, "top_n", "shorts", "bps")

    def side(best: bool, limit: int, sign: int) -> DataFrame:
        order = F.col("_score").desc_nulls_last() if best else F.col("_score").asc_nulls_last()
        place = F.row_number().over(Window.partitionBy(*keys, "timestamp").orderBy(order, F.col("ticker")))
        return rows.withColumn("_place", place).filter(F.col("_place") <= limit).withColumn("side", F.lit(sign))

    # Rows are ranked once, for the largest N; the configurations multiply only what was picked.
    picked = side(True, max(c.top_n for c in configs), 1)
    shorts = max(0 if c.long_only else c.bottom_n for c in configs)
    if shorts:
        picked = picked.unionByName(side(False, shorts, -1))
    count = F.when(F.col("side") == 1, F.col("top_n")).otherwise(F.col("shorts"))
    # Both sides hold at most N rows per date, so this joins small tables.
    return picked.join(enough, [*keys, "timestamp"]).filter(F.col("_place") <= count).select(
        *scope, "ticker", "side", (F.col("side") / count).alias("weight"), "actual_return", "bps")


def period_returns(pos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, config_id, timestamp, gross: mean long less mean short return."""
    long, short = F.when(F.col("side") == 1, F.col("actual_return")), F.when(F.col("side") == -1, F.col("actual_return"))
    return pos.groupBy(*keys, "config_id", "timestamp").agg(
        (F.coalesce(F.avg(long), F.lit(0.0)) - F.coalesce(F.avg(short), F.lit(0.0))).alias("gross"), F.max("bps").alias("bps"))


def weighted_period_returns(pos: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same with explicit positive weights: weighted long sum less weighted short sum."""
    if weight not in pos.columns:
        raise ValueError(f"weights {weight!r} required for non-equal weighting")
    signed = F.col("side") * F.col(weight) * F.col("actual_return")
    return pos.groupBy(*keys, "config_id", "timestamp").agg(F.coalesce(F.sum(signed), F.lit(0.0)).alias("gross"))


def turnover(pos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, config_id, timestamp, turnover: half the absolute weight change against the period before (first: empty).

    Each holding counts +w in its period and -w in the next, so no join of neighbouring periods is needed.
    """
    group = [*keys, "config_id"]
    periods = pos.select(*group, "timestamp").distinct()
    ahead = over_series(periods, [lambda w: {"next_ts": w.lead("timestamp")}], 0, group, lookahead=1)
    held = lookup(pos.select(*group, "timestamp", "ticker", "weight"), ahead, [*group, "timestamp"])
    moves = held.select(*group, "ticker", F.explode(F.array(
        F.struct("timestamp", F.col("weight").alias("w")), F.struct(F.col("next_ts").alias("timestamp"), (-F.col("weight")).alias("w")),
    )).alias("m")).select(*group, "ticker", "m.*").filter("timestamp is not null")
    net = moves.groupBy(*group, "timestamp", "ticker").agg(F.sum("w").alias("w"))
    return net.groupBy(*group, "timestamp").agg((F.sum(F.abs("w")) / 2).alias("turnover"))


def net_returns(pos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, config_id, timestamp, gross, turnover, net. Reads the positions several times: store them first."""
    scope = [*keys, "config_id", "timestamp"]
    joined = period_returns(pos, keys).join(turnover(pos, keys), scope)
    return joined.select(*scope, "gross", "turnover", (F.col("gross") - F.col("turnover") * F.col("bps") / 10_000).alias("net"))


def daily_returns(
    holdings: DataFrame, prices: DataFrame, cost_bps: float = 0.0, suspect: float | None = 0.5, split_threshold: float = 0.40
) -> DataFrame:
    """(timestamp, ret) of the held portfolio on every price day from the first rebalance on.

    A day uses the holdings of the latest rebalance reached (at most one new one a
    day), leaves out jump-and-reverse ticker-days, counts suspect moves as flat,
    skips days with prices for under half the weight and scales up the rest. The
    cost falls on the first recorded day after a rebalance.
    """
    rebalances = number_rows(holdings.select("timestamp").distinct(), [], ["timestamp"]).select("timestamp", (F.col("_pos") + 1).alias("k"))
    first = rebalances.agg(F.min("timestamp")).first()[0]
    if first is None:
        return holdings.select("timestamp", F.lit(0.0).alias("ret")).limit(0)
    grid = prices.filter(F.col("timestamp") >= first).select("timestamp").distinct()
    reached = fill_last(
        grid.withColumn("day", F.lit(1)).unionByName(rebalances.withColumn("day", F.lit(0)), allowMissingColumns=True),
        ["k"], [], ["timestamp", "day"],
    ).filter("day = 1").select("timestamp", "k")
    # The holding pointer p moves up one rebalance a day at most: p = i + min(1, min over earlier days of (k - i)).
    days = number_rows(reached, [], ["timestamp"]).select("timestamp", "k", F.col("_pos").alias("i"))
    days = running(days, {"low": ("min", F.col("k") - F.col("i"))}, [], ["timestamp"])
    days = over_series(days, [lambda w: {"prev_ts": w.lag("timestamp")}], 1, ())
    days = stored(days.filter("i > 0").select("timestamp", "prev_ts", (F.col("i") + F.least(F.lit(1), F.col("low"))).alias("k")))

    book = lookup(holdings, rebalances, ["timestamp"]).select("k", "ticker", "weight")
    totals = book.groupBy("k").agg(F.sum(F.abs("weight")).alias("total"))
    wanted = lookup(days, totals, ["k"]).join(book, "k")

    price = F.col("Close")

    def moves(w) -> dict[str, Column]:
        before, after = w.lag("Close"), w.lead("Close")
        r = F.try_divide(price - before, before)
        hit = (F.abs(r) > split_threshold) & (r * F.try_divide(after - price, price) < -(split_threshold**2))
        return {"r": F.when(before > 0, r), "before_ts": w.lag("timestamp"), "hit": F.coalesce(hit, F.lit(False))}

    def spreads(name: str, source: str):
        return lambda w: {name: F.col(source) | F.coalesce(w.lag(source), F.lit(False))}

    quotes = over_series(prices.filter("Close is not null").select("timestamp", "ticker", "Close"),
                         [moves, spreads("excluded", "hit"), spreads("skip", "excluded")], 4, lookahead=1)
    quotes = quotes.filter("not skip and r is not null").select("timestamp", "ticker", "r", F.col("before_ts").alias("prev_ts"))
    move = F.col("r") if suspect is None else F.when(F.abs("r") > suspect, 0.0).otherwise(F.col("r"))
    daily = wanted.join(quotes, ["timestamp", "ticker", "prev_ts"], "left").groupBy("timestamp", "k", "total").agg(
        F.coalesce(F.sum(F.col("weight") * move), F.lit(0.0)).alias("x"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.abs("weight"))), F.lit(0.0)).alias("covered"),
    ).filter(F.col("covered") >= F.col("total") * 0.5)
    scaled = F.when((F.col("covered") > 0) & (F.col("covered") < F.col("total")), F.col("x") * F.col("total") / F.col("covered")).otherwise(F.col("x"))
    out = over_series(daily, [lambda w: {"charge": (w.lag("k").isNull() | (w.lag("k") != F.col("k"))).cast("double")}], 1, ())
    return out.select("timestamp", (scaled - F.col("charge") * F.lit(cost_bps / 10_000)).alias("ret"))


def backtest_periods(
    df: DataFrame, configs: Sequence[PortfolioConfig], horizon_days: int = 1, keys: Sequence[str] = (), score: str = "predicted_score"
) -> DataFrame:
    """Net period returns on non-overlapping dates, stored: one small row per date and group."""
    return stored(net_returns(stored(positions(on_dates(df, horizon_days), configs, keys, score)), keys))


def on_dates(df: DataFrame, horizon_days: int) -> DataFrame:
    """Rows of the non-overlapping rebalance dates."""
    if horizon_days <= 1:
        return df
    return lookup(df, stored(rebalance_dates(df, horizon_days)), ["timestamp"], "left_semi")


def summarize(periods: DataFrame, keys: Sequence[str] = (), drawdown: DataFrame | None = None) -> DataFrame:
    """One record per group from its net period returns (timestamp, gross, turnover, net)."""
    group = [*keys, "config_id"]
    n = F.count(F.lit(1))
    years = F.greatest((F.max("timestamp") - F.min("timestamp")) / float(DAY_MS) / 365.0, F.lit(0.01))
    base = periods.groupBy(*group).agg(
        n.alias("num_rebalances"), years.alias("years"), (F.product(1 + F.col("net")) - 1).alias("total_return"),
        (F.product(1 + F.col("gross")) - 1).alias("pre_fee_total_return"), F.avg("turnover").alias("avg_turnover"),
        F.stddev_samp("net").alias("std"), F.sum(F.col("gross") - F.col("net")).alias("impact"),
    )
    net = periods.select(*group, "timestamp", F.col("net").alias("ret"))
    dd = max_drawdown(net, group) if drawdown is None else drawdown
    sharpes = sharpe_from_span(net, keys=group).join(
        sharpe_from_span(periods, keys=group, value="gross", name="pre_fee_sharpe"), group)
    row = base.join(dd, group).join(sharpes, group)
    many = F.col("num_rebalances") >= 2
    rate = lambda c: F.when(many & (F.col(c) > -1), F.pow(1 + F.col(c), 1 / F.col("years")) - 1)
    return row.select(
        *group, "num_rebalances", "total_return", "pre_fee_total_return", "avg_turnover", "sharpe", "pre_fee_sharpe", "max_drawdown",
        rate("total_return").alias("annualized_return"), rate("pre_fee_total_return").alias("pre_fee_annualized_return"),
        F.when(many, F.col("std") * F.sqrt(F.col("num_rebalances") / F.col("years"))).alias("annualized_volatility"),
        F.when(many & (F.col("pre_fee_total_return") > 0), F.try_divide(-F.col("impact"), 1 + F.col("pre_fee_total_return"))).alias("cost_drag"),
        F.when(many, F.col("impact") / F.col("num_rebalances")).alias("avg_cost_per_rebalance"),
        F.when(many, F.col("years") / F.col("num_rebalances")).alias("avg_holding_years"),
        F.when(many & (F.col("avg_turnover") > 0), F.try_divide(F.col("total_return"), F.col("avg_turnover"))).alias("return_per_turnover"),
        F.when(F.col("max_drawdown") > 1e-4, F.try_divide(rate("total_return"), F.col("max_drawdown"))).alias("calmar"),
    )


def backtest(df: DataFrame, config: PortfolioConfig, horizon_days: int = 1, prices: DataFrame | None = None) -> DataFrame:
    """One-row record. With prices, drawdown and volatility come from the daily path when it has over ten days."""
    held = stored(positions(on_dates(df, horizon_days), [config]))
    periods = stored(net_returns(held))
    if prices is None:
        return summarize(periods).drop("config_id")
    daily = stored(daily_returns(held.select("timestamp", "ticker", "weight"), prices, config.total_cost_bps))
    stats = daily.agg(F.count("ret").alias("n"), (F.stddev_samp("ret") * (252**0.5)).alias("daily_vol")).withColumn("config_id", F.lit(0))
    path = max_drawdown(daily.withColumn("config_id", F.lit(0)), ["config_id"]).withColumnRenamed("max_drawdown", "daily_dd")
    row = summarize(periods).join(stats, "config_id", "left").join(path, "config_id", "left")
    use = F.col("n") > 10
    dd = F.when(use, F.col("daily_dd")).otherwise(F.col("max_drawdown"))
    return row.withColumns({
        "max_drawdown": dd, "annualized_volatility": F.when(use, F.col("daily_vol")).otherwise(F.col("annualized_volatility")),
        "calmar": F.when(dd > 1e-4, F.try_divide(F.col("annualized_return"), dd)), "daily_points": F.col("n"),
    }).drop("n", "daily_vol", "daily_dd", "config_id")


def _extreme_orders(rows: DataFrame, wanted: int, n_trials: int, seed: int) -> DataFrame:
    """timestamp, ticker, actual_return, trial, order: of each date and trial a few more than the ``wanted`` rows at either end of a random order.

    The order is a hash, so an end is the rows beyond a threshold, set by the date's size to pass a little more than needed. Where
    it passes fewer, all rows of that date and trial are taken.
    """
    rows = stored(rows.select("timestamp", "ticker", "actual_return"))
    sizes = stored(rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n")))
    share = (wanted + 4 * wanted**0.5 + 4) / F.col("_n")
    sizes = sizes.withColumn("_share", F.when(share > 0.5, F.lit(1.0)).otherwise(share))
    trials = F.sequence(F.lit(0), F.lit(n_trials - 1))

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.col("timestamp").cast("string"), F.col("ticker"))))

    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(16.0**8)
    drawn = ordered(lookup(rows, sizes, ["timestamp"]).withColumn("trial", F.explode(trials))).withColumn("_place", place)
    low, high = F.col("_place") < F.col("_share"), F.col("_place") >= 1 - F.col("_share")
    passed = stored(drawn.filter(low | high))
    enough = passed.groupBy("timestamp", "trial").agg(F.count_if(low).alias("_low"), F.count_if(high).alias("_high"), F.max("_share").alias("_of"))
    full = enough.filter((F.col("_of") >= 1) | ((F.col("_low") >= wanted) & (F.col("_high") >= wanted))).select("timestamp", "trial")
    short = stored(sizes.select("timestamp", F.explode(trials).alias("trial")).join(full, ["timestamp", "trial"], "left_anti"))
    names = ["timestamp", "ticker", "actual_return", "trial", "order"]
    # Both sides are rare, so they are joined by date without a look at sizes.
    whole = ordered(rows.join(short, "timestamp"))
    return passed.join(short, ["timestamp", "trial"], "left_anti").select(*names).unionByName(whole.select(*names))


def random_baseline(
    df: DataFrame, config: PortfolioConfig, horizon_days: int, n_trials: int = 100, model_sharpe: float | None = None, seed: int = 42
) -> DataFrame:
    """One row over ``n_trials`` hash-ordered portfolios: Sharpe and return moments, percentile of the model."""
    scored = _extreme_orders(on_dates(df, horizon_days), max(config.top_n, 0 if config.long_only else config.bottom_n), n_trials, seed)
    held = stored(positions(scored, [config], ["trial"], "order"))
    runs = trial_records(stored(net_returns(held, ["trial"])))
    ok = runs.filter("sharpe is not null and not isnan(sharpe)")
    share = F.avg((F.col("sharpe") <= F.lit(model_sharpe)).cast("double")) * 100 if model_sharpe is not None else F.lit(None).cast("double")
    return ok.agg(
        F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.avg("pre_fee_sharpe").alias("mean_pre_fee_sharpe"),
        F.stddev_pop("pre_fee_sharpe").alias("std_pre_fee_sharpe"), F.avg("total_return").alias("mean_total_return"),
        F.stddev_pop("total_return").alias("std_total_return"), F.count(F.lit(1)).alias("n_trials"), share.alias("percentile_of_model"))


def trial_records(periods: DataFrame) -> DataFrame:
    """(trial, sharpe, pre_fee_sharpe, total_return) without the parts a baseline does not use."""
    a = sharpe_from_span(periods, keys=["trial"], value="net")
    b = sharpe_from_span(periods, keys=["trial"], value="gross", name="pre_fee_sharpe")
    c = periods.groupBy("trial").agg((F.product(1 + F.col("net")) - 1).alias("total_return"))
    return a.join(b, "trial").join(c, "trial")


def equity_curve(periods: DataFrame) -> DataFrame:
    """config_id, timestamp, net, cumulative."""
    return cumulative(periods.select("config_id", "timestamp", F.col("net").alias("ret")), ["config_id"])
