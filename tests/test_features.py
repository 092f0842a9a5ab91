"""Features against pandas on random walks, and no value depends on later rows."""

import numpy as np
import pandas as pd
import pytest
from data import DAY, frame, walk
from pyspark.sql import functions as F

from panelforge.operators import alpha, lagma, ratios, technical
from panelforge.operators.groups import apply_groups, outputs

EPS = 1e-6


@pytest.fixture(scope="module")
def panel():
    return walk(3, 330)


@pytest.fixture(scope="module")
def computed(spark, panel):
    groups = [*technical.TECHNICAL, *alpha.ALPHA, alpha.RISK_ADJUSTED, alpha.VALUE]
    return apply_groups(frame(spark, panel), groups).toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True)


def per(panel, fn):
    return panel.sort_values(["ticker", "timestamp"]).groupby("ticker", group_keys=False).apply(fn, include_groups=False).reset_index(drop=True)


def roll(x, n):
    return x.rolling(n)


CASES = {
    "Vol_20": lambda d: d.Close.pct_change().rolling(20).std(),
    "Vol_252": lambda d: d.Close.pct_change().rolling(252).std(),
    "BB_Width_20": lambda d: 4 * d.Close.rolling(20).std() / (d.Close.rolling(20).mean() + EPS),
    "ROC_10": lambda d: d.Close.pct_change(10) * 100,
    "Pos_52w_Range": lambda d: (d.Close - d.Low.rolling(252).min()) / (d.High.rolling(252).max() - d.Low.rolling(252).min() + EPS),
    "MACD_Line": lambda d: d.Close.ewm(span=12, adjust=False).mean() - d.Close.ewm(span=26, adjust=False).mean(),
    "Skew_60d": lambda d: d.Close.pct_change().rolling(60).skew(),
    "Kurt_126d": lambda d: d.Close.pct_change().rolling(126).kurt(),
    "VolRetCorr_60d": lambda d: d.Close.pct_change().rolling(60).corr(d.Volume),
    "IdioVol_60": lambda d: (d.Close.pct_change() - d.Close.pct_change().rolling(60).mean()).rolling(60).std(),
    "Amihud_63d": lambda d: (d.Close.pct_change().abs() / (d.Volume * d.Close + EPS)).rolling(63).mean(),
    "MAX5_21d": lambda d: d.Close.pct_change().rolling(21).apply(lambda x: np.sort(x)[-5:].mean(), raw=True),
    "InfoDisc_63": lambda d: np.sign(d.Close.pct_change().rolling(63).sum()) * d.Close.pct_change().rolling(63).apply(lambda x: (x > 0).sum() - (x < 0).sum(), raw=True) / 63,
    "TrendPersist_252d": lambda d: d.Close.pct_change().rolling(21).sum().rolling(252).apply(lambda x: pd.Series(x).autocorr(1), raw=True),
    "Risk_Adj_ROC_126": lambda d: d.Close.pct_change().rolling(126).mean() / (d.Close.pct_change().rolling(126).std() + EPS),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(panel, computed, name):
    want = per(panel, lambda d: CASES[name](d))
    assert np.allclose(computed[name].astype(float), want.astype(float), rtol=1e-7, atol=1e-10, equal_nan=True)


def test_trend_r_squared(panel, computed):
    one = panel[panel.ticker == "STOCK00.NZ"].Close.to_numpy()
    got = computed[computed.ticker == "STOCK00.NZ"]["Trend_RSq_60"].to_numpy(dtype=float)
    assert np.isnan(got[58]) and got[200] == pytest.approx(np.corrcoef(np.arange(60), one[141:201])[0, 1] ** 2, rel=1e-6)


def test_short_series_get_nulls(spark):
    out = technical.add_technical(frame(spark, walk(1, 49))).select("RSI_14", "ATR_14").toPandas()
    assert out.isna().all().all()
    assert technical.add_technical(frame(spark, walk(1, 50))).select("RSI_14").toPandas().notna().all().all()


def test_features_do_not_see_later_rows(spark, panel):
    groups = [*technical.TECHNICAL, *[g for g in alpha.ALPHA]]
    cut = panel["timestamp"].min() + 300 * DAY
    whole = apply_groups(frame(spark, panel), groups).filter(F.col("timestamp") <= cut)
    prefix = apply_groups(frame(spark, panel[panel["timestamp"] <= cut]), groups)
    a, b = (d.select("timestamp", "ticker", *outputs(groups)).toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True) for d in (whole, prefix))
    for c in outputs(groups):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_market_changes_are_between_dates(spark):
    macro = pd.DataFrame({"timestamp": [1, 2, 3], "MACRO_NZDUSD=X_Close": [1.0, 1.1, 1.21]})
    rows = pd.DataFrame({"timestamp": [1, 1, 2, 2, 3, 3], "ticker": list("ABABAB"), "Close": [10.0, 20, 11, 22, 12.1, 24.2]})
    got = ratios.add_relative_returns(frame(spark, rows), frame(spark, macro)).toPandas()
    assert np.allclose(got[got.timestamp > 1]["FX_Adjusted_Return"].astype(float), 0.2)


def test_fear_ratio_uses_no_later_values(spark):
    macro = pd.DataFrame({"timestamp": [1, 2, 3], "MACRO_Recession_Wiki_Views": [2.0, 4.0, 12.0]})
    first = ratios.fear_ratio(frame(spark, macro.head(2))).toPandas()
    full = ratios.fear_ratio(frame(spark, macro)).toPandas().sort_values("timestamp")
    assert np.allclose(full["FearRatio"], [1.0, 4 / 3, 2.0]) and np.allclose(first.sort_values("timestamp")["FearRatio"], [1.0, 4 / 3])


@pytest.mark.parametrize("lengths", [[63, 126, 252], [21, 63, 126, 252, 504, 1008], [63, 126, 252, 504, 1004], [5, 20, 300], [252], [1], [2, 1000], [7, 64, 65]])
def test_frames_are_put_together_from_few_shorter_ones(lengths):
    chain = lagma.frame_parts(lengths)
    assert set(lengths) <= set(chain) and min(chain) <= lagma.SHORT_FRAME
    rows = {}
    for n, parts in chain.items():
        rows[n] = [passed + i for m, passed in parts for i in (rows[m] if m < n and m in rows else range(m))]
        assert sorted(rows[n]) == list(range(n)) and all(m in rows or m <= lagma.SHORT_FRAME for m, _ in parts)
        assert len(parts) <= 2 * lagma.MOST_PARTS


def test_moving_means_sort_and_slide_little(spark, panel):
    """The plan has no frame longer than a short one and a window step for each length, not for each power of two."""
    out = lagma.add_lag_features(frame(spark, panel).select("timestamp", "ticker", F.col("Close").alias("DollarVolume")), lagma.TICKER_CONFIGS[:1], "ticker")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("specifiedwindowframe(RowFrame, -125") == 0 and sum(line.lstrip(" +-:").startswith("Window [") for line in plan.splitlines()) <= 11


def test_lag_names_and_values(spark):
    pdf = walk(2, 60)[["timestamp", "ticker", "Close", "Volume"]]
    one = lagma.LagConfig(r"^close$", "Px", (7,), (14,), (7,), ((0, 14), (5, 14)), spike=True, volatility=True)
    got = lagma.add_lag_features(frame(spark, pdf), [one], "ticker").toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    g = pdf.sort_values(["ticker", "timestamp"]).reset_index(drop=True).groupby("ticker")["Close"]
    ma = g.transform(lambda x: x.rolling(14, min_periods=7).mean())
    assert np.allclose(got["Px_MA_14"].astype(float), ma, equal_nan=True)
    assert np.allclose(got["Px_Lag_7"].astype(float), g.shift(7), equal_nan=True)
    assert np.allclose(got["Px_Spike"].astype(float), pdf.sort_values(["ticker", "timestamp"]).reset_index(drop=True)["Close"] / ma, equal_nan=True)
    assert {"Px_Mom_7", "Px_Diff_0_14", "Px_Diff_5_14", "Px_Vol_14"} <= set(got.columns)
    two = lagma.LagConfig("Close|Volume", "Both", (1,))
    assert lagma.generated(["Close", "Volume"], [two]) == ["Both_Close_Lag_1", "Both_Volume_Lag_1"]


def test_feature_sets():
    sets = alpha.FeatureSets(["alpha_reversal", "alpha_volume", "value_features"])
    sets.disable("value_features")
    assert sets.enabled() == ["alpha_reversal", "alpha_volume"]
    with pytest.raises(ValueError):
        sets.enable("nothing")


def test_date_percentiles(spark):
    pdf = pd.DataFrame({"timestamp": [1] * 4, "ticker": list("abcd"), "RSI_14": [1.0, 2.0, 2.0, np.nan]})
    got = ratios.add_date_percentiles(frame(spark, pdf)).toPandas().sort_values("ticker")
    assert np.allclose(got["Rank_RSI_14"], [1 / 3, 2.5 / 3, 2.5 / 3, 0.5])


def test_long_means_forget_an_infinity(spark):
    pdf = walk(1, 700)
    pdf.loc[5, "Close"] = np.inf
    one = lagma.LagConfig(r"^Close$", "Px", mas=(251, 252, 300))
    got = lagma.add_lag_features(frame(spark, pdf), [one], "ticker").toPandas().sort_values("timestamp").reset_index(drop=True)
    close = pdf.sort_values("timestamp").reset_index(drop=True)["Close"]
    for n in (251, 252, 300):
        tail = got[f"Px_MA_{n}"][5 + n:]
        assert np.allclose(tail, close[6:].rolling(n).mean()[n - 1:], rtol=1e-12)


def test_the_whole_chain_stores_no_wide_rows(spark, monkeypatch):
    """Rows with all features are moved by the ranks' shuffle alone: only the narrow frame before them and the market's series are written."""
    from panelforge.plans import evaluation as E

    kept = []
    for name in ("stored", "written"):
        monkeypatch.setattr(E, name, lambda df, *a, f=getattr(E, name): (kept.append(len(df.columns)), f(df, *a))[1])
    rows = [(t * DAY, f"T{j}.NZ", *[10.0 + j + t % 7 + k for k in range(4)], 5.0 + t % 3) for t in range(30) for j in range(3)]
    panel = spark.createDataFrame(rows, "timestamp long, ticker string, Open double, High double, Low double, Close double, Volume double")
    macro = spark.createDataFrame([(t * DAY, 3.0 + t % 4) for t in range(30)], ["timestamp", "MACRO_Long-term interest rates"])
    out = E.add_all_features(panel, macro, lags=False)
    assert max(kept) < 20 < len(out.columns)
    got = {(r["ticker"], r["timestamp"] // DAY): r["IR_Change"] for r in out.select("ticker", "timestamp", "IR_Change").collect()}
    assert len(got) == 90 and all(v == (0.0 if t == 0 else float(t % 4 - (t - 1) % 4)) for (_, t), v in got.items())
