import math

import numpy as np
import pandas as pd
import pytest
from data import DAY, frame, walk
from pyspark.sql import functions as F

from panelforge.operators import labels as L
from panelforge.operators import panel as P


@pytest.fixture(params=["plain", "hot"])
def layout(request):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


def long(spark, rows):
    return spark.createDataFrame(rows, "timestamp bigint, ticker string, feature string, value double")


def test_classify_and_prefix(spark):
    rows = [(1, "AIR.NZ", "Close", 1.0), (1, "NZDUSD=X", "Close", 2.0), (1, "%5ETNX", "Close", 3.0), (1, "A+B", "Close", 4.0), (1, None, "rate", 5.0), (1, "", "gdp", 6.0)]
    got = {r["value"]: (r["ticker"], r["feature"]) for r in P.add_macro_prefix(P.classify_tickers(long(spark, rows))).collect()}
    assert got == {1.0: ("AIR.NZ", "Close"), 2.0: ("", "MACRO_NZDUSD=X_Close"), 3.0: ("", "MACRO_^TNX_Close"), 4.0: ("", "MACRO_A+B_Close"),
                   5.0: ("", "MACRO_rate"), 6.0: ("", "MACRO_gdp")}


def test_long_to_wide_fills_only_backwards(spark, layout):
    rows = [(10, "A.NZ", "Close", 1.0), (20, "A.NZ", "Close", 2.0), (30, "A.NZ", "Close", 3.0), (15, "A.NZ", "eps", 7.0), (30, "A.NZ", "eps", 8.0),
            (25, "A.NZ", "Volume", 9.0), (20, "B.NZ", "Close", 4.0), (12, None, "rate", 0.5), (30, None, "other", 1.5)]
    got = P.long_to_wide(long(spark, rows), ["eps"], ["MACRO_rate", "MACRO_other"], ["Close", "Volume"]).toPandas().sort_values(["ticker", "timestamp"])
    assert got["timestamp"].tolist() == [10, 20, 30, 20]
    assert got["eps"].fillna(-1).tolist() == [-1, 7, 8, -1]
    assert got["MACRO_rate"].fillna(-1).tolist() == [-1, 0.5, 0.5, 0.5] and got["MACRO_other"].fillna(-1).tolist() == [-1, -1, 1.5, -1]
    assert got["Volume"].isna().all()  # exact features need the anchor's own timestamp


def prices(spark, ticker_prices):
    return spark.createDataFrame([(i * DAY, t, float(p)) for t, ps in ticker_prices.items() for i, p in enumerate(ps)], "timestamp bigint, ticker string, Close double")


def test_anomalies(spark):
    df = prices(spark, {"A": [1, 1.1, 4, 4.1], "B": [1, 1, 1]})
    kept, removed = P.trim_anomalies(df)
    assert sorted((r["ticker"], r["Close"]) for r in removed.collect()) == [("A", 1.0), ("A", 1.1)]
    assert kept.count() == 5 and P.trim_anomalies(df, trim_before=False)[1].count() == 1
    s = P.anomaly_summary(df).first()
    assert (s["total_rows"], s["anomaly_rows"], s["rows_to_trim"], s["affected_tickers"]) == (7, 1, 2, 1)


def test_split_reversal_and_suspicious(spark, layout):
    df = prices(spark, {"A": [10, 10, 5, 10, 10], "B": [10, 31, 31, 31, 31]})
    assert sorted(r["timestamp"] // DAY for r in P.split_reversal_days(df).collect()) == [2, 3]
    splits = spark.createDataFrame([(3 * DAY, "B", 2.0), (6 * DAY, "B", 2.0), (0, "B", 1.0), (2 * DAY, "A", 3.0)], "timestamp bigint, ticker string, value double")
    got = P.suspicious_splits(df, splits).collect()
    assert [(r["ticker"], r["split_ts"] // DAY) for r in got] == [("B", 3)] and got[0]["extreme_return"] == pytest.approx(2.1)


def test_preprocess_flags_before_fill(spark, layout):
    pdf = pd.DataFrame({"timestamp": [1, 2, 3, 1], "ticker": ["A", "A", "A", "B"], "x": [1.0, np.nan, np.inf, np.nan], "f": [True, False, True, True]})
    got = P.preprocess(frame(spark, pdf)).toPandas().sort_values(["ticker", "timestamp"])
    assert got["x"].tolist() == [1, 1, 1, 0] and got["MissingFlag_x"].tolist() == [1, 0, 0, 0] and got["f"].tolist() == [1, 0, 1, 1]
    assert P.feature_columns(P.preprocess(frame(spark, pdf))) == ["x", "f"]


def test_sparse_clip_group_onehot(spark):
    df = spark.createDataFrame([(1, "a", 50.0, None), (1, "b", -50.0, None), (2, "a", 1.0, 3.0)], "timestamp bigint, ticker string, x double, y double")
    assert P.drop_sparse(df, 0.6).columns == ["timestamp", "ticker", "x"]
    assert sorted(r["x"] for r in P.clip_extremes(df).collect()) == [-10, 1, 10]
    assert P.min_group_size(df, 2).count() == 2
    hot = P.one_hot_tickers(df.select("timestamp", "ticker"), ["a", "b"])
    assert [r["ticker"] for r in P.undo_one_hot(hot).orderBy("timestamp", "ticker").collect()] == ["a", "b", "a"]


def test_forward_return_cases(spark, layout):
    df = spark.createDataFrame([(0, "A", 100.0), (5 * DAY, "A", 110.0), (6 * DAY, "A", 120.0), (40 * DAY, "A", 1.0), (5 * DAY, "B", 7.0)], "timestamp bigint, ticker string, Close double")
    got = {(r["ticker"], r["timestamp"] // DAY): r["forward_return"] for r in L.forward_return(df, 5, tolerance_days=7).collect()}
    assert got[("A", 0)] == pytest.approx(0.1) and got[("A", 5)] is None and got[("B", 5)] is None
    log = L.forward_return(df, 5, "log", (-0.05, 0.05), True).collect()
    assert [r["forward_return"] for r in log] == [0.05]
    with pytest.raises(ValueError):
        L.forward_return(df, 5, "other")


def test_forward_return_equals_merge_asof(spark, layout):
    pdf = walk(3, 120)
    rng = np.random.default_rng(3)
    pdf = pdf[rng.uniform(size=len(pdf)) < 0.6].reset_index(drop=True)
    got = L.forward_return(frame(spark, pdf), 10, tolerance_days=3).toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    want = []
    for t, d in pdf.sort_values(["ticker", "timestamp"]).groupby("ticker"):
        m = pd.merge_asof(d.assign(at=d.timestamp + 10 * DAY), d[["timestamp", "AdjClose"]].rename(columns={"timestamp": "at", "AdjClose": "f"}), on="at", direction="forward", tolerance=3 * DAY)
        want += list((m["f"] - m["AdjClose"]) / m["AdjClose"])
    assert np.allclose(got["forward_return"].astype(float), want, equal_nan=True)


def test_windows_and_split(spark):
    windows = L.rolling_windows(1000 * DAY, 2, 0.5, 30, 1.0)
    assert windows[0] == (0, 970 * DAY - int(365.25 * DAY), 970 * DAY)
    df = spark.range(0, 1000).select((F.col("id") * DAY).alias("timestamp"), F.lit("A").alias("ticker"))
    assert [tuple(r) for r in L.windows_frame(df, 2, 0.5, 30, 1.0).collect()][0][0] == 0
    got = L.assign_windows(df, windows).groupBy("window_id", "role").count().collect()
    for i, a, b in windows:
        train, test = L.split(df, a, b)
        assert {(r["window_id"], r["role"]): r["count"] for r in got}[(i, "train")] == train.count()
        assert {(r["window_id"], r["role"]): r["count"] for r in got}[(i, "test")] == test.count()


def test_rebalance_dates_greedy(spark, layout):
    days = [0, 3, 10, 11, 19, 21, 22, 40, 55]
    df = spark.createDataFrame([(d * DAY,) for d in days * 6], "timestamp bigint")
    assert sorted(r[0] // DAY for r in L.rebalance_dates(df, 10).collect()) == [0, 10, 21, 40, 55]


def test_rebalance_dates_jumps_when_dates_are_many(spark, hot):
    df = spark.range(0, 200).select((F.col("id") * DAY).alias("timestamp"))
    assert sorted(r[0] // DAY for r in L.rebalance_dates(df, 30).collect()) == list(range(0, 200, 30))


@pytest.mark.parametrize("size, horizon", [(4, 3), (4, 40), (16, 1), (64, 7), (4096, 3)])
def test_rebalance_dates_over_blocks(spark, monkeypatch, size, horizon):
    monkeypatch.setattr(L, "BLOCK_DATES", size)
    rng = np.random.default_rng(size + horizon)
    # Runs of hours with gaps of weeks, so that a jump stays in its block, leaves it, or passes several.
    steps = np.where(rng.uniform(size=260) < 0.05, rng.integers(20, 90, 260) * 24, rng.integers(1, 30, 260))
    times = [int(t) * DAY // 24 for t in np.cumsum(steps)]
    want = []
    for t in times:
        if not want or t - want[-1] >= horizon * DAY:
            want.append(t)
    df = spark.createDataFrame([(t,) for t in times + times[:50]] + [(None,)], "timestamp bigint")
    assert sorted(r[0] for r in L.rebalance_dates(df, horizon).collect()) == want
    assert L.rebalance_dates(df.limit(0), horizon).count() == 0


def test_bins_equal_qcut(spark, layout):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"timestamp": np.repeat(np.arange(6), 60), "ticker": [f"t{i}" for i in range(60)] * 6, "x": np.round(rng.normal(size=360), 1)})
    pdf.loc[pdf.timestamp == 5, "x"] = np.where(rng.uniform(size=60) < 0.5, 0.0, pdf.loc[pdf.timestamp == 5, "x"])
    got = L.quantile_bins(frame(spark, pdf), "x", 5).toPandas().sort_values(["timestamp", "ticker"]).reset_index(drop=True)
    srt = pdf.sort_values(["timestamp", "ticker"]).reset_index(drop=True)
    want = srt.groupby("timestamp")["x"].transform(lambda s: pd.qcut(s, 5, labels=False, duplicates="drop"))
    assert (got["bin"] == want).all()


def test_grades_of_a_constant_date(spark):
    df = spark.createDataFrame([(1, f"t{i}", 2.0) for i in range(10)], "timestamp bigint, ticker string, y double")
    got = [r["relevance"] for r in L.relevance_grades(df, "y").orderBy("ticker").collect()]
    assert got == pd.cut(pd.Series(range(1, 11)), 5, labels=False).tolist()


def test_scaler(spark, layout):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"timestamp": range(101), "ticker": "A", "x": rng.normal(size=101), "b": np.arange(101) % 2.0, "c": 3.0, "m": np.where(np.arange(101) < 90, 1.0, np.arange(101))})
    s = L.fit_scaler(frame(spark, pdf))
    assert s.binary == ("b", "c") and set(s.center) == {"x", "m"}
    q = np.percentile(pdf.x, [25, 50, 75])
    assert s.center["x"] == pytest.approx(q[1]) and s.scale["x"] == pytest.approx(q[2] - q[0]) and s.scale["m"] == 1.0
    out = L.apply_scaler(frame(spark, pdf), s).toPandas()
    assert np.allclose(out["x"], (pdf.x - q[1]) / (q[2] - q[0])) and (out["b"] == pdf.b).all()
    with pytest.raises(ValueError):
        L.apply_scaler(frame(spark, pdf[["timestamp", "ticker", "b"]]), s)
    assert math.isclose(L.max_labelable_ts(10 * DAY, 3), 7 * DAY)


def test_validation_share(spark, layout):
    df = spark.range(0, 50).select(F.col("id").alias("timestamp"))
    assert L.temporal_validation(df).filter("is_validation").count() == 10
