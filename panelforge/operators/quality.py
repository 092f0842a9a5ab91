"""Data-quality checks as rows or one-row records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityError(ValueError):
    pass


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {missing}")


def validate_wide(df: DataFrame) -> DataFrame:
    """(check, rows) counts of negative and null timestamps, unusable prices and rows with a repeated key."""
    require_columns(df, ["timestamp", "ticker"])
    checks = {"negative_timestamp": F.count_if(F.col("timestamp") < 0), "null_timestamp": F.count_if(F.col("timestamp").isNull())}
    if "Close" in df.columns:
        checks["invalid_close"] = F.count_if(F.col("Close").isNull() | F.isnan("Close") | (F.col("Close") <= 0))
    row = df.agg(*[c.alias(n) for n, c in checks.items()])
    counted = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks])))
    repeated = df.groupBy("timestamp", "ticker").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.unionByName(repeated.agg(F.lit("duplicate_key").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))


def duplicate_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """A few repeated keys, for the error message."""
    return df.groupBy("timestamp", "ticker").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("timestamp", "ticker").limit(n)


def assert_valid_wide(df: DataFrame) -> None:
    bad = [f"{r['check']}: {r['rows']}" for r in validate_wide(df).collect() if r["rows"] and r["check"] != "invalid_close"]
    if bad:
        raise QualityError("; ".join(bad))


def no_lookahead(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: last training and first test timestamp, and whether they are in order."""
    ends = train.select(F.col("timestamp").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(
        test.select(F.lit(None).cast("bigint").alias("a"), F.col("timestamp").alias("b")))
    return ends.agg(F.max("a").alias("train_max"), F.min("b").alias("test_min"), (F.max("a") < F.min("b")).alias("ok"))


def assert_no_lookahead(train: DataFrame, test: DataFrame) -> None:
    row = no_lookahead(train, test).first()
    if row["ok"] is False:
        raise QualityError(f"training reaches {row['train_max']}, test starts {row['test_min']}")


def check_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, non_null, spread, status): missing, all_null, zero_variance or ok; one pass over present columns."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(*[F.struct(F.count(f"`{c}`").alias("n"), F.stddev_samp(f"`{c}`").alias("s")).alias(f"s{i}") for i, c in enumerate(present)])
    known = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}.n").alias("non_null"), F.col(f"s{i}.s").alias("spread")) for i, c in enumerate(present)])
    status = F.when(F.col("non_null") == 0, "all_null").when(F.col("spread") == 0, "zero_variance").otherwise("ok")
    found = row.select(F.inline(known)).withColumn("status", status)
    absent = [c for c in columns if c not in df.columns]
    if not absent:
        return found
    extra = df.sparkSession.createDataFrame([(c, 0, None, "missing") for c in absent], "feature string, non_null bigint, spread double, status string")
    return found.unionByName(extra)


def usable_features(df: DataFrame, columns: Sequence[str], allow_missing: bool = False) -> list[str]:
    """Present columns with any value; a missing one is an error unless allowed."""
    if not allow_missing:
        require_columns(df, columns)
    rows = check_features(df, columns).filter("status in ('ok', 'zero_variance')").collect()
    good = {r["feature"] for r in rows}
    return [c for c in columns if c in good]


def quality_report(df: DataFrame) -> DataFrame:
    """(metric, value) rows: size, null-heavy columns, infinities, time range, distinct keys."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    # Distinct keys come from their own grouped counts, so no task holds a key set.
    nulls = {c: F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns}
    infinite = reduce(lambda a, b: a + b, [F.count_if(F.abs(f"`{c}`") == float("inf")) for c in floats], F.lit(0).cast("long"))
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*nulls.values()).alias("nulls"), infinite.alias("infinite"),
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    share = lambda limit: F.size(F.filter("nulls", lambda x: x > limit))
    values = {
        "n_rows": F.col("n_rows"), "n_columns": F.lit(len(df.columns)), "n_numeric_columns": F.lit(len(numeric)),
        "columns_with_missing": share(0.0), "high_missing_columns": share(0.5), "infinite_values": F.col("infinite"),
        "timestamp_min": F.col("t0"), "timestamp_max": F.col("t1"),
    }
    rows = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])))
    for c, name in (("timestamp", "n_unique_timestamps"), ("ticker", "n_unique_tickers")):
        rows = rows.unionByName(df.select(c).distinct().agg(F.lit(name).alias("metric"), F.count(c).cast("double").alias("value")))
    return rows


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)])))


def assert_frame(df: DataFrame, columns: Sequence[str] = (), no_nulls: Sequence[str] = (), unique: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Check a frame and hand it on."""
    require_columns(df, [*columns, *no_nulls, *unique])
    if no_nulls:
        bad = [f"{r['column']}: {r['nulls']}" for r in null_counts(df, no_nulls).collect() if r["nulls"]]
        if bad:
            raise QualityError("nulls in " + ", ".join(bad))
    if unique and not df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise QualityError(f"repeated {list(unique)}")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise QualityError(f"fewer than {min_rows} rows")
    return df


def config_findings(panel: DataFrame, horizon_days: int, top_n: int, bottom_n: int, min_stocks: int) -> DataFrame:
    """(check, level, value) of a run's settings: ``ok``, ``warning`` or ``error``, with the value that decides.

    The last check asks the panel itself: how many dates have fewer rows than a portfolio needs.
    """
    settings = [
        ("horizon_positive", "error" if horizon_days <= 0 else "ok", horizon_days), ("horizon_within_a_year", "warning" if horizon_days > 365 else "ok", horizon_days),
        ("top_positive", "error" if top_n <= 0 else "ok", top_n), ("bottom_not_negative", "error" if bottom_n < 0 else "ok", bottom_n),
        ("min_stocks_fill_a_portfolio", "warning" if min_stocks < top_n + bottom_n else "ok", min_stocks),
    ]
    thin = panel.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") < top_n + bottom_n).alias("value"))
    found = thin.select(F.lit("dates_fill_a_portfolio").alias("check"), F.when(F.col("value") > 0, "warning").otherwise("ok").alias("level"), F.col("value"))
    return panel.sparkSession.createDataFrame(settings, "check string, level string, value bigint").unionByName(found)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """One row: row count and a sum of row hashes, whatever the row order. ``portable`` uses md5 instead of xxhash64."""
    chosen = list(columns or df.columns)
    if portable:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in chosen])
        value = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    else:
        value = F.xxhash64(*chosen).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("fingerprint"))


def source_difference(a: DataFrame, b: DataFrame, tolerance_percent: float = 1.0) -> DataFrame:
    """Prices of two sources per key: difference in percent of the second, and match, mismatch or the side that lacks it."""
    both = a.select("timestamp", "ticker", F.col("price").alias("price_a")).join(
        b.select("timestamp", "ticker", F.col("price").alias("price_b")), ["timestamp", "ticker"], "full_outer")
    diff = F.try_divide(F.abs(F.col("price_a") - F.col("price_b")), F.col("price_b")) * 100
    status = F.when(F.col("price_a").isNull(), "only_b").when(F.col("price_b").isNull(), "only_a").when(
        diff < tolerance_percent, "match").otherwise("mismatch")
    return both.withColumns({"diff_percent": diff, "status": status})
