"""Long observations to a wide point-in-time panel, and the panel's quality trimming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.columns import DAY_MS, INGEST_ORDER, clip, finite
from panelforge.operators.ordered import fill_last, lookup, over_series
from panelforge.session import stored

EXACT = ("Close", "Open", "High", "Low", "Volume", "AdjClose", "Dividend", "Split")
LOCAL_SUFFIX = ".NZ"
MACRO_PREFIX = "MACRO_"
KEYS = ("timestamp", "ticker")
# Up to this many features a reshape is one conditional aggregate.
WIDE_PIVOT = 50
# Columns that are never model inputs.
NOT_FEATURES = (
    "timestamp", "ticker", "forward_return", "target", "relevance", "Open", "High", "Low", "Close", "Volume",
    "AdjClose", "Dividend", "Split", "Cluster", "Rank_InCluster",
)


def decoded(ticker: Column) -> Column:
    """Undo %xx escapes; a literal plus stays a plus."""
    plain = F.url_decode(F.replace(ticker, F.lit("+"), F.lit("%2B")))
    # Few names have an escape, and a filter on the name decodes it once more.
    return F.when(ticker.contains("%"), plain).otherwise(ticker)


def classify_tickers(long: DataFrame, suffix: str = LOCAL_SUFFIX) -> DataFrame:
    """Observations of foreign tickers become market-wide features named ``ticker_feature``."""
    name = F.coalesce(decoded(F.col("ticker")), F.lit(""))
    foreign = (name != "") & ~name.endswith(suffix)
    return long.withColumns({
        "feature": F.when(foreign, F.concat_ws("_", name, F.col("feature"))).otherwise(F.col("feature")),
        "ticker": F.when(foreign, F.lit("")).otherwise(name),
    })


def add_macro_prefix(long: DataFrame) -> DataFrame:
    market = F.col("ticker").isNull() | (F.col("ticker") == "")
    return long.withColumn(
        "feature", F.when(market, F.concat(F.lit(MACRO_PREFIX), "feature")).otherwise(F.col("feature"))
    )


def anchors(long: DataFrame) -> DataFrame:
    """Ticker-days that have a closing price."""
    return long.filter((F.col("feature") == "Close") & (F.col("ticker") != "")).select(*KEYS).distinct()


def _spread_features(long: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A column per feature: the last of repeated observations by ``ingest_order``, or the largest where the rows carry no order."""
    ordered = INGEST_ORDER in long.columns
    if len(features) > WIDE_PIVOT:
        value = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(INGEST_ORDER, "value"))) if ordered else F.max("value")
        return long.groupBy(*keys).pivot("feature", list(features)).agg(value)

    def one(f: str) -> Column:
        mine = F.col("feature") == f
        if not ordered:
            return F.max(F.when(mine, F.col("value")))
        return F.max_by("value", F.when(mine & F.col("value").isNotNull(), F.struct(INGEST_ORDER, "value")))

    # One shuffle instead of the pivot's two.
    return long.groupBy(*keys).agg(*[one(f).alias(f) for f in features])


def exact_pivot(long: DataFrame, features: Sequence[str] = EXACT) -> DataFrame:
    """One row per anchor with the features observed at exactly that ticker-day."""
    wanted = list(dict.fromkeys(["Close", *features]))
    rows = long.filter((F.col("ticker") != "") & F.col("feature").isin(wanted))
    return _spread_features(rows, KEYS, wanted).filter(F.col("Close").isNotNull())


def ticker_asof(long: DataFrame, features: Sequence[str], exact: Sequence[str] = ("Close",)) -> DataFrame:
    """Anchors with, per feature, the ticker's latest value at or before the anchor."""
    exact = list(dict.fromkeys(["Close", *exact]))
    rows = long.filter((F.col("ticker") != "") & F.col("feature").isin([*exact, *features]))
    wide = _spread_features(rows, KEYS, [*exact, *features])
    return fill_last(wide, features, ["ticker"], ["timestamp"]).filter(F.col("Close").isNotNull())


def macro_table(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Market-wide features, one row per timestamp at which any was observed."""
    return _spread_features(long.filter((F.col("ticker") == "") & F.col("feature").isin(list(features))),
                            ["timestamp"], features)


def macro_on_grid(dates: DataFrame, macro: DataFrame) -> DataFrame:
    """The latest market-wide values known at each distinct timestamp of ``dates``; never a later one."""
    features = [c for c in macro.columns if c != "timestamp"]
    grid = dates.select("timestamp").distinct().withColumn("_anchor", F.lit(True))
    both = macro.unionByName(grid, allowMissingColumns=True)
    merged = both.groupBy("timestamp").agg(*[F.max(c).alias(c) for c in [*features, "_anchor"]])
    return fill_last(merged, features, [], ["timestamp"]).filter("_anchor").drop("_anchor")


def macro_asof(panel: DataFrame, macro: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Attach them to the panel; ``dates`` may name a cheaper frame with the panel's timestamps."""
    return lookup(panel, macro_on_grid(panel if dates is None else dates, macro), ["timestamp"])


def long_to_wide(
    long: DataFrame, ticker_features: Sequence[str] | None = None, macro_features: Sequence[str] | None = None,
    exact: Sequence[str] = EXACT,
) -> DataFrame:
    """The whole reshape: classify, prefix, anchor, exact pivot, as-of fills.

    Without lists every other feature of the tickers and every market-wide series is found and filled.
    """
    rows = add_macro_prefix(classify_tickers(long))
    if ticker_features is None or macro_features is None:
        rows = stored(rows)  # the names are read before the values
    if ticker_features is None:
        ticker_features = [f for f in feature_names(rows.filter(F.col("ticker") != "")) if f not in {"Close", *exact}]
    if macro_features is None:
        macro_features = feature_names(rows.filter(F.col("ticker") == ""))
    wide = ticker_asof(rows, ticker_features, exact) if ticker_features else exact_pivot(rows, exact)
    if macro_features:
        wide = macro_asof(wide, macro_table(rows, macro_features), rows.filter((F.col("feature") == "Close") & (F.col("ticker") != "")))
    return wide


def feature_names(long: DataFrame, limit: int = 10_000) -> list[str]:
    """Distinct feature names, for ``pivot``; more than ``limit`` is an error, not a truncation."""
    names = [r[0] for r in long.select("feature").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} features; pass an explicit list")
    return sorted(names)


def null_fractions(df: DataFrame) -> DataFrame:
    """(column, null_fraction) in one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_fraction")) for c in df.columns])
    return row.select(F.inline(pairs))


def drop_sparse(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Keep columns whose share of nulls is below the threshold."""
    kept = {r["column"] for r in null_fractions(df).collect() if (r["null_fraction"] or 0.0) < threshold}
    return df.select(*[c for c in df.columns if c in kept])


def daily_returns(panel: DataFrame, price: str = "Close", name: str = "daily_return") -> DataFrame:
    def stage(w):
        before = w.lag(price)
        return {name: F.try_divide(F.col(price) - before, before)}

    return over_series(panel, [stage], 1)


def detect_anomalies(panel: DataFrame, threshold: float = 2.0, price: str = "Close") -> DataFrame:
    """Add ``daily_return``, ``is_anomaly`` and ``first_anomaly_ts`` (first jump of the ticker)."""
    flagged = daily_returns(panel, price).withColumn(
        "is_anomaly", F.coalesce(F.abs("daily_return") > threshold, F.lit(False))
    )
    # The table holds one row per ticker that ever jumped.
    first = flagged.filter("is_anomaly").groupBy("ticker").agg(F.min("timestamp").alias("first_anomaly_ts"))
    return lookup(flagged, first, ["ticker"])


def trim_anomalies(panel: DataFrame, threshold: float = 2.0, trim_before: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Drops everything before a ticker's first jump, or only the jump rows."""
    flagged = detect_anomalies(panel, threshold)
    keep = (
        F.col("first_anomaly_ts").isNull() | (F.col("timestamp") >= F.col("first_anomaly_ts"))
        if trim_before else ~F.col("is_anomaly")
    )
    return flagged.filter(keep).select(*panel.columns), flagged.filter(~keep).select(*panel.columns)


def anomaly_summary(panel: DataFrame, threshold: float = 2.0) -> DataFrame:
    flagged = detect_anomalies(panel, threshold)
    before = F.col("timestamp") < F.col("first_anomaly_ts")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_anomaly").alias("anomaly_rows"),
        F.count_if(before).alias("rows_to_trim"),
        (F.count_if(before) * 100.0 / F.count(F.lit(1))).alias("trim_percent"),
        F.count_distinct(F.when(F.col("is_anomaly"), F.col("ticker"))).alias("affected_tickers"),
        F.max(F.when(F.col("is_anomaly"), F.col("daily_return"))).alias("max_return"),
        F.min(F.when(F.col("is_anomaly"), F.col("daily_return"))).alias("min_return"),
    )


def extreme_moves(panel: DataFrame, threshold: float = 2.0, price: str = "Close") -> DataFrame:
    return daily_returns(panel, price).filter(F.abs("daily_return") > threshold).select(
        "timestamp", "ticker", F.col(price).alias("price"), "daily_return"
    )


def suspicious_splits(
    panel: DataFrame, splits: DataFrame, threshold: float = 2.0, within_days: int = 5
) -> DataFrame:
    """Splits other than 1.0 with an extreme move of the ticker less than ``within_days`` away (the earliest one)."""
    reach = within_days * DAY_MS
    moves = extreme_moves(panel, threshold)
    quotes = moves.select(
        "ticker", F.col("timestamp").alias("at"), F.lit(1).alias("kind"),
        F.struct("timestamp", "daily_return").alias("move"),
    )
    probes = splits.filter(F.col("value") != 1.0).select(
        "ticker", (F.col("timestamp") - reach + 1).alias("at"), F.lit(0).alias("kind"),
        F.col("timestamp").alias("split_ts"), F.col("value").alias("split_ratio"),
    )
    met = fill_last(probes.unionByName(quotes, allowMissingColumns=True), ["move"], ["ticker"], ["at", "kind"], backward=True)
    return met.filter((F.col("kind") == 0) & (F.col("move.timestamp") < F.col("split_ts") + reach)).select(
        "ticker", "split_ts", "split_ratio", F.col("move.daily_return").alias("extreme_return")
    )


def split_reversal_days(panel: DataFrame, threshold: float = 0.40, price: str = "Close") -> DataFrame:
    """Ticker-days to exclude: a jump undone the next day, and that next day."""
    def stage(w):
        p, before, after = F.col(price), w.lag(price), w.lead(price)
        r, nxt = F.try_divide(p - before, before), F.try_divide(after - p, p)
        return {"hit": (F.abs(r) > threshold) & (r * nxt < -(threshold * threshold)),
                "next_ts": w.lead("timestamp")}

    hits = over_series(panel, [stage], 1, lookahead=1).filter("hit")
    return hits.select(F.explode(F.array("timestamp", "next_ts")).alias("timestamp"), "ticker").filter(
        "timestamp is not null"
    ).distinct()


def preprocess(panel: DataFrame, add_missing_flags: bool = True, target: str = "target") -> DataFrame:
    """Booleans to int, infinities to null, presence flags, forward fill per ticker, zero for the rest."""
    excluded = {"timestamp", "ticker", target}
    fields = [f for f in panel.schema.fields if not f.name.startswith("Unnamed")]
    numeric = [f.name for f in fields if f.name not in excluded
               and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    types = {f.name: f.dataType for f in fields}

    def clean(c: str) -> Column:
        if isinstance(types[c], T.BooleanType):
            return F.col(c).cast("int").alias(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            return finite(F.col(c)).alias(c)
        return F.col(c)

    cleaned = panel.select(*[clean(f.name) if f.name in numeric else F.col(f.name) for f in fields])
    if add_missing_flags:
        cleaned = cleaned.select("*", *[F.col(c).isNotNull().cast("int").alias(f"MissingFlag_{c}") for c in numeric])
    if "ticker" in panel.columns:
        cleaned = fill_last(cleaned, numeric, ["ticker"], ["timestamp"])
    else:
        cleaned = fill_last(cleaned, numeric, [], ["timestamp"])
    return cleaned.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(cleaned.schema[c].dataType)) for c in numeric})


def clip_extremes(df: DataFrame, threshold: float = 10.0, target: str = "target") -> DataFrame:
    excluded = {"timestamp", "ticker", target}
    return df.select(*[
        clip(F.col(f.name), -threshold, threshold).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded and "MissingFlag" not in f.name
        else F.col(f.name)
        for f in df.schema.fields
    ])


def feature_columns(df: DataFrame, extra_excluded: Sequence[str] = ()) -> list[str]:
    """Numeric columns that may be model inputs."""
    out = {*NOT_FEATURES, *extra_excluded}
    return [f.name for f in df.schema.fields if f.name not in out and not f.name.startswith("MissingFlag_")
            and isinstance(f.dataType, T.NumericType)]


def min_group_size(df: DataFrame, n: int) -> DataFrame:
    """Rows of timestamps that have at least ``n`` rows."""
    big = df.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("timestamp")
    return lookup(df, big, ["timestamp"], "left_semi")


# Up to this many tickers are binary columns of their own; more of them are one sparse vector.
WIDE_ONE_HOT = 2_000
ONE_HOT = "Ticker_"


def known_tickers(*frames: DataFrame, limit: int = 5_000_000) -> list[str]:
    """Tickers of all frames together, so that train and test get the same columns; too many names for the driver is an error."""
    union = reduce(DataFrame.unionByName, [f.select("ticker") for f in frames]).distinct()
    names = [r[0] for r in union.limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} tickers; encode them as an index instead")
    return sorted(names)


def one_hot_tickers(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Binary ``Ticker_x`` columns for a known list (the union over train and test).

    Beyond ``WIDE_ONE_HOT`` names the binary columns are the elements of one sparse vector ``Ticker_``, in the order of the list, which its metadata holds:
    a plan of that many columns cannot be made, and a row has one element that is not 0. Other tickers have none, and where the ticker is null so is the vector.
    """
    if len(tickers) <= WIDE_ONE_HOT:
        return df.select("*", *[(F.col("ticker") == t).cast("int").alias(f"Ticker_{t}") for t in tickers])
    places = StringIndexerModel.from_labels(list(tickers), inputCol="ticker", outputCol="_place", handleInvalid="keep").transform(df)
    # The place behind the last name is that of all other tickers, and has no element.
    coded = OneHotEncoder(inputCol="_place", outputCol="_hot", dropLast=True).fit(places).transform(places)
    return coded.select(*df.columns, F.when(F.col("ticker").isNotNull(), F.col("_hot")).alias(ONE_HOT, metadata={"tickers": list(tickers)}))


def undo_one_hot(df: DataFrame) -> DataFrame:
    if "tickers" in (df.schema[ONE_HOT].metadata if ONE_HOT in df.columns else {}):
        names = df.schema[ONE_HOT].metadata["tickers"]
        # A row without a mark is at the place behind the last name.
        placed = df.withColumn("_place", F.coalesce(F.get(F.unwrap_udt(ONE_HOT)["indices"], F.lit(0)), F.lit(len(names))).cast("double"))
        found = IndexToString(inputCol="_place", outputCol="_name", labels=[*names, ""]).transform(placed)
        return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ONE_HOT, "ticker")], F.when(F.col("_place") < len(names), F.col("_name")).alias("ticker"))
    names = [c for c in df.columns if c.startswith("Ticker_")]
    # Two arrays instead of a case per column: the plan of a thousand tickers stays small on the driver.
    place = F.array_position(F.array(*[F.col(f"`{c}`") == 1 for c in names]), F.lit(True))
    hit = F.when(place > 0, F.element_at(F.array(*[F.lit(c[len("Ticker_"):]) for c in names]), place.cast("int")))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names and c != "ticker"], hit.alias("ticker"))


def sliced(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows with start <= timestamp < end; plain comparisons, so they reach the scan."""
    out = df
    if start is not None:
        out = out.filter(F.col("timestamp") >= start)
    if end is not None:
        out = out.filter(F.col("timestamp") < end)
    return out


def previous_row(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Attach each ticker's previous value under a new name."""
    return over_series(df, [lambda w: {new: w.lag(c) for new, c in columns.items()}], 1)
