"""Forward-return labels, ranks and grades per date, train/test windows, robust scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.columns import DAY_MS, clip
from panelforge.operators.ordered import (
    average_ranks, bounded_by, fill_last, fits_one_task, group_quantiles, group_sizes, lookup, number_rows,
)
from panelforge.operators.quantiles import exact_quantiles
from panelforge.session import stored, written

YEAR_DAYS = 365.25


def forward_return(
    df: DataFrame, days: int, return_type: str = "simple", winsorize: tuple[float, float] | None = None,
    drop_na: bool = False, tolerance_days: int | None = None, price: str | None = None,
    prices: DataFrame | None = None,
) -> DataFrame:
    """Add ``forward_return``: change to the ticker's first price in [t + days, t + days + tolerance].

    Every row asks at t + days and every price row answers at t; one ordered
    pass per ticker carries the next answer back to the question.
    """
    if return_type not in ("simple", "log"):
        raise ValueError(f"return_type must be 'simple' or 'log', got {return_type!r}")
    if price is None:
        price = "AdjClose" if "AdjClose" in df.columns else "Close"
    reach = days * DAY_MS
    tolerance = int((days // 2 + 5 if tolerance_days is None else tolerance_days) * DAY_MS)
    asks = F.struct(
        (F.col("timestamp") + reach).alias("at"), F.lit(0).alias("kind"), F.struct(*df.columns).alias("row"),
        F.lit(None).cast("struct<at:bigint,price:double>").alias("quote"),
    )
    row_type = df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType
    answers = F.struct(
        F.col("timestamp").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(row_type).alias("row"),
        F.struct(F.col("timestamp").alias("at"), F.col(price).cast("double").alias("price")).alias("quote"),
    )
    if prices is None:
        events = df.select("ticker", F.explode(F.array(asks, answers)).alias("e"))
    else:
        events = df.select("ticker", asks.alias("e")).unionByName(prices.select("ticker", answers.alias("e")))
    events = events.select("ticker", "e.*")
    met = fill_last(events, ["quote"], ["ticker"], ["at", "kind"], backward=True).filter("kind = 0")
    found = F.when(F.col("quote.at") <= F.col("at") + tolerance, F.col("quote.price"))
    now = F.col(f"row.{price}")
    out = F.try_divide(found - now, now) if return_type == "simple" else F.ln(F.try_divide(found, now))
    if winsorize is not None:
        out = clip(out, *winsorize)
    result = met.select("row.*", out.alias("forward_return"))
    return result.filter("forward_return is not null") if drop_na else result


def max_labelable_ts(max_ts: Column | int, days: int):
    return max_ts - days * DAY_MS


def date_ranks(df: DataFrame, score: str, ascending: bool = False, name: str = "rank") -> DataFrame:
    """Tie-averaged rank of the score per timestamp."""
    ranked = average_ranks(df, [score], ["timestamp"])
    up = F.col(f"_rank_{score}")
    value = up if ascending else F.col(f"_count_{score}") + 1 - up
    return ranked.withColumn(name, value).select(*df.columns, name)


def bin_of(x: Column, edges: Column) -> Column:
    """0-based interval of x among sorted edges: (lo, hi], the first one closed below. One edge gives null."""
    unique = F.array_distinct(edges)
    below = F.size(F.filter(unique, lambda e: e < x))
    return F.when(x.isNotNull() & (F.size(unique) >= 2), F.greatest(below, F.lit(1)) - 1)


def quantile_bins(df: DataFrame, value: str, n: int, keys: Sequence[str] = ("timestamp",), name: str = "bin") -> DataFrame:
    """Quantile bin 0..n-1 of each value in its group; edges interpolated, repeated edges merged."""
    probs = [i / n for i in range(n + 1)]
    rows = df.withColumn("_x", F.col(value).cast("double"))
    if keys and fits_one_task(df, list(keys)):
        found = F.percentile("_x", F.array(*[F.lit(p) for p in probs])).over(Window.partitionBy(*keys))
        joined = rows.withColumn("edges", found)
    elif keys:
        joined = lookup(rows, group_quantiles(df, list(keys), value, probs), list(keys))
    else:  # n + 1 numbers, put into the plan
        row = group_quantiles(df, [], value, probs).first()
        joined = rows.withColumn("edges", F.lit(row["edges"] if row and row["edges"] else []).cast("array<double>"))
    return joined.withColumn(name, bin_of(F.col("_x"), F.col("edges")).cast("int")).drop("edges", "_x")


def relevance_grades(df: DataFrame, target: str, n: int = 5, name: str = "relevance") -> DataFrame:
    """Quantile grades 0..n-1 per timestamp; a constant date is graded by row order in equal-width bins."""
    binned = quantile_bins(df, target, n, ("timestamp",), "_bin")
    flat = binned.filter(F.col("_bin").isNull())
    # Equal-width bins over places 1..m, as an equal-width cut with the first interval closed below.
    numbered = number_rows(flat, ["timestamp"], ["ticker"])
    share = (F.col("_pos") * n) / F.greatest(F.col("_size") - 1, F.lit(1))
    graded = numbered.withColumn("_bin", F.when(
        F.col("_size") > 1, F.least(F.greatest(F.ceil(share) - 1, F.lit(0)), F.lit(n - 1))
    ).otherwise(F.lit((n - 1) // 2)).cast("int"))
    both = binned.filter(F.col("_bin").isNotNull()).unionByName(graded.select(*binned.columns))
    return both.withColumnRenamed("_bin", name)


def rolling_windows(max_ts: int, n: int, move_years: float, lookahead_days: int, test_years: float) -> list[tuple[int, int, int]]:
    """(window, train_end, test_end), newest first; plain parameters for filters and one small table."""
    move, test = int(move_years * YEAR_DAYS * DAY_MS), int(test_years * YEAR_DAYS * DAY_MS)
    last = max_ts - lookahead_days * DAY_MS
    return [(i, last - i * move - test, last - i * move) for i in range(n)]


def windows_frame(df: DataFrame, n: int, move_years: float, lookahead_days: int, test_years: float) -> DataFrame:
    """The same windows from the newest timestamp of a table."""
    move, test = int(move_years * YEAR_DAYS * DAY_MS), int(test_years * YEAR_DAYS * DAY_MS)
    top = df.agg((F.max("timestamp") - lookahead_days * DAY_MS).alias("last"))
    return top.select("last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window_id")).select(
        "window_id", (F.col("last") - F.col("window_id") * move - test).alias("train_end_ts"),
        (F.col("last") - F.col("window_id") * move).alias("test_end_ts"),
    )


def split(df: DataFrame, train_end: int, test_end: int, embargo_days: int = 0) -> tuple[DataFrame, DataFrame]:
    train = df.filter(F.col("timestamp") < train_end - embargo_days * DAY_MS)
    return train, df.filter((F.col("timestamp") >= train_end) & (F.col("timestamp") < test_end))


def assign_windows(df: DataFrame, windows: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Rows with every (window_id, role) they belong to; the window list is a plan literal, so nothing is joined."""
    options = [
        F.when(F.col("timestamp") < train_end, F.struct(F.lit(i).alias("window_id"), F.lit("train").alias("role")))
        .when(F.col("timestamp") < test_end, F.struct(F.lit(i).alias("window_id"), F.lit("test").alias("role")))
        for i, train_end, test_end in windows
    ]
    return df.select("*", F.explode(F.array_compact(F.array(*options))).alias("_w")).select("*", "_w.*").drop("_w")


def temporal_validation(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Add ``is_validation``: the last ``fraction`` of the distinct timestamps."""
    dates = number_rows(df.select("timestamp").distinct(), [], ["timestamp"])
    marked = dates.select("timestamp", (F.col("_pos") >= F.floor(F.col("_size") * (1 - fraction))).alias("is_validation"))
    return lookup(df, marked, ["timestamp"])


# Dates of a block, whose jumps are followed inside one row.
BLOCK_DATES = 4096


def rebalance_dates(df: DataFrame, horizon_days: int) -> DataFrame:
    """Greedy non-overlapping dates: the first timestamp, then each next one at least a horizon later. Null timestamps are ignored.

    Every date points to the next one a horizon later. Inside blocks of ``BLOCK_DATES`` dates the pointers are doubled in arrays, which tells for
    each date the block may be entered at where the block is left to; these hops are doubled over the blocks (no rounds for one block).
    Each block then follows its pointers from its own entry.
    """
    size, horizon = BLOCK_DATES, horizon_days * DAY_MS
    dates = stored(df.select("timestamp").distinct().filter("timestamp is not null"))
    counted = group_sizes(dates, [])
    n_blocks = -(-counted.total // size)
    with bounded_by(lambda: {(): counted}, growth=2.0):  # each date asks and answers
        blocks = _date_blocks(dates, horizon, size)
    if n_blocks > 1:
        blocks = stored(blocks)
        entered = lookup(blocks, stored(_block_entries(blocks, n_blocks, size)), ["block"], "inner")
    else:
        entered = blocks.withColumn("at", F.lit(0))
    rounds = F.sequence(F.lit(1), F.lit(size.bit_length()))
    start = F.struct(F.col("jumps"), F.array("at").alias("kept"))
    orbit = F.aggregate(rounds, start, lambda s, _: F.struct(
        _doubled(s["jumps"]).alias("jumps"), F.array_distinct(F.concat(s["kept"], F.transform(s["kept"], lambda i: F.get(s["jumps"], i)))).alias("kept")))
    walked = entered.select("dates", orbit["kept"].alias("kept"))
    return walked.select(F.explode(F.transform("kept", lambda i: F.get("dates", i))).alias("timestamp"))


def _doubled(jumps: Column) -> Column:
    return F.transform(jumps, lambda i: F.get(jumps, i))


def _date_blocks(dates: DataFrame, horizon: int, size: int) -> DataFrame:
    """(block, dates, jumps, out): in order of time, each date's place in the block of the date it points to (its own where that is outside), and the place over all of the latter."""
    none = F.lit(None).cast("bigint")
    placed = number_rows(dates, [], ["timestamp"]).select("timestamp", F.col("_pos").cast("bigint").alias("pos"))
    asked = placed.select((F.col("timestamp") + horizon).alias("at"), F.lit(0).alias("known"), "timestamp", "pos", none.alias("next"))
    known = placed.select(F.col("timestamp").alias("at"), F.lit(1).alias("known"), none.alias("timestamp"), none.alias("pos"), F.col("pos").alias("next"))
    pointing = fill_last(asked.unionByName(known), ["next"], [], ["at", "known"], backward=True).filter("known = 0")
    inside = F.col("next") < (F.col("block") + 1) * size
    each = pointing.withColumn("block", F.floor(F.col("pos") / size)).select(
        "block", "timestamp", (F.col("pos") % size).cast("int").alias("at"),
        F.when(inside, F.col("next") % size).otherwise(F.col("pos") % size).cast("int").alias("jump"), F.when(~inside, F.col("next")).alias("out"))
    rows = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "timestamp", "jump", "out"))).alias("all"))
    return rows.select("block", F.col("all.timestamp").alias("dates"), F.col("all.jump").alias("jumps"), F.col("all.out").alias("out"))


def _block_entries(blocks: DataFrame, n_blocks: int, size: int) -> DataFrame:
    """(block, at): the place at which the first date's orbit enters each block it reaches."""
    last = F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length())), F.col("jumps"), lambda j, _: _doubled(j))
    exits = blocks.select("block", "out", F.posexplode(last).alias("at", "end"))
    hops = stored(exits.select((F.col("block") * size + F.col("at")).alias("pos"), F.get("out", F.col("end")).alias("next")).filter("next is not null"))
    # Only the first date and places that some block is left to can be entered at: a few per block.
    entered = hops.select(F.col("next").alias("pos")).distinct()
    jump = stored(hops.filter("pos = 0").union(hops.join(entered, "pos", "left_semi")))
    kept = blocks.filter("block = 0").select(F.lit(0).cast("bigint").alias("pos"))
    for _ in range((n_blocks - 1).bit_length()):
        kept = stored(kept.union(kept.join(jump, "pos").select(F.col("next").alias("pos"))))
        jump = stored(jump.join(jump.select(F.col("pos").alias("next"), F.col("next").alias("far")), "next").select("pos", F.col("far").alias("next")))
    return kept.select(F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).cast("int").alias("at"))


@dataclass(frozen=True)
class Scaler:
    """Median and interquartile range per scaled column; binary columns are left alone."""

    center: dict[str, float]
    scale: dict[str, float]
    binary: tuple[str, ...]


def robust_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, q25, median, q75, is_binary) over all rows: exact quantiles, no sample."""
    columns = list(columns)
    spark = df.sparkSession
    whole = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "columns")
    ends = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"e{i}") for i, c in enumerate(columns)]
    row = whole.agg(*ends).first()
    edges = exact_quantiles(whole, columns, [0.25, 0.5, 0.75])
    bounds = {c: row[f"e{i}"] for i, c in enumerate(columns)}
    # Binary <=> nothing strictly between the smallest and largest value. A quartile in between
    # settles most columns; the rest are counted in one more pass.
    inside = lambda c, x: x is not None and bounds[c]["lo"] < x < bounds[c]["hi"]
    open_columns = [c for c in columns if not any(inside(c, x) for x in (edges.get(c) or []))]
    between: dict[str, int] = {}
    if open_columns:
        counts = whole.agg(*[
            F.count_if((F.col(c) > F.lit(bounds[c]["lo"])) & (F.col(c) < F.lit(bounds[c]["hi"]))).alias(f"n{i}") for i, c in enumerate(open_columns)
        ]).first()
        between = {c: counts[f"n{i}"] for i, c in enumerate(open_columns)}
    rows = [(c, *(edges.get(c) or (None, None, None)), c in between and not between[c]) for c in columns]
    return spark.createDataFrame(rows, "feature string, q25 double, median double, q75 double, is_binary boolean")


def fit_scaler(df: DataFrame, columns: Sequence[str] | None = None, target: str = "target") -> Scaler:
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
                   and f.name not in ("timestamp", "ticker", target)]
    rows = robust_stats(df, columns).collect()
    scaled = [r for r in rows if not r["is_binary"] and r["median"] is not None]
    return Scaler(
        {r["feature"]: r["median"] for r in scaled},
        {r["feature"]: (r["q75"] - r["q25"]) or 1.0 for r in scaled},
        tuple(sorted(r["feature"] for r in rows if r["is_binary"])),
    )


def apply_scaler(df: DataFrame, scaler: Scaler, strict: bool = True) -> DataFrame:
    missing = [c for c in scaler.center if c not in df.columns]
    if missing and strict:
        raise ValueError(f"columns missing for scaling: {missing}")
    return df.select(*[
        ((F.col(c) - F.lit(scaler.center[c])) / F.lit(scaler.scale[c])).alias(c) if c in scaler.center else F.col(c)
        for c in df.columns
    ])
