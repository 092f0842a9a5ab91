"""Technical indicators per ticker (Close, Open, High, Low, Volume)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import EPS, clip, pct, powers, pstd, ratio, rmax, rmean, rmin, rstd
from panelforge.operators.groups import Group, apply_groups, ewm_mean_stages, returns_stage

MIN_ROWS = 50
ATR_WINDOWS = (14, 63, 126, 252)


def _rsi_0(w):
    step = F.col("Close") - w.lag("Close")
    return {"_gain": F.when(step > 0, step).otherwise(0.0), "_loss": F.when(step < 0, -step).otherwise(0.0)}


def _rsi_1(w, n=14):
    rs = ratio(rmean("_gain", n, w), rmean("_loss", n, w))
    return {f"RSI_{n}": F.coalesce(100 - 100 / (1 + rs), F.lit(50.0))}


RSI = Group("rsi", (_rsi_0, _rsi_1), ("RSI_14",), 15, MIN_ROWS)

_fast_slow, _span1 = ewm_mean_stages({"_ema12": ("Close", 12), "_ema26": ("Close", 26)})
_signal, _span2 = ewm_mean_stages({"MACD_Signal": ("MACD_Line", 9)})
MACD = Group(
    "macd",
    (*_fast_slow, lambda w: {"MACD_Line": F.col("_ema12") - F.col("_ema26")}, *_signal,
     lambda w: {"MACD_Hist": F.col("MACD_Line") - F.col("MACD_Signal")}),
    ("MACD_Line", "MACD_Signal", "MACD_Hist"), _span1 + _span2, MIN_ROWS,
)

ROC = Group("roc", (lambda w: {f"ROC_{n}": pct("Close", n, w) * 100 for n in (10, 252)},), ("ROC_10", "ROC_252"), 252, MIN_ROWS)


def _true_range(w):
    before = w.lag("Close")
    return {"_tr": F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - before), F.abs(F.col("Low") - before))}


def _atr(w):
    made = {f"ATR_{n}": rmean("_tr", n, w) for n in ATR_WINDOWS}
    return {**made, **{f"NATR_{n}": ratio(made[f"ATR_{n}"], F.col("Close")) * 100 for n in ATR_WINDOWS}}


ATR = Group("atr", (_true_range, _atr), tuple(f"{p}_{n}" for n in ATR_WINDOWS for p in ("ATR", "NATR")), 253, MIN_ROWS)


def _bollinger(w, n=20, k=2):
    mean, std = rmean("Close", n, w), rstd("Close", n, w)
    return {f"BB_Width_{n}": ratio(std * (2 * k), mean), f"Dist_SMA_{n}": ratio(F.col("Close") - mean, mean)}


BOLLINGER = Group("bollinger", (_bollinger,), ("BB_Width_20", "Dist_SMA_20"), 20, MIN_ROWS)


def _distance(w):
    return {f"Dist_MA_{n}": ratio(F.col("Close") - rmean("Close", n, w), rmean("Close", n, w)) for n in (20, 50, 200)}


MA_DISTANCE = Group("ma_distance", (_distance,), ("Dist_MA_20", "Dist_MA_50", "Dist_MA_200"), 200, MIN_ROWS)
VOLATILITY = Group("volatility", (returns_stage, lambda w: powers("_ret", 2), lambda w: {"Vol_20": rstd("_ret", 20, w), "Vol_252": pstd("_ret", 252, w)}),
                   ("Vol_20", "Vol_252"), 253, MIN_ROWS)


def _year_range(w):
    high, low = rmax("High", 252, w), rmin("Low", 252, w)
    return {"Pos_52w_Range": ratio(F.col("Close") - low, high - low), "Dist_52w_High": ratio(F.col("Close") - high, high)}


YEAR_RANGE = Group("year_range", (_year_range,), ("Pos_52w_Range", "Dist_52w_High"), 252, MIN_ROWS)
LAGGED = Group("lagged_returns", (returns_stage, lambda w: {f"Ret_Lag_{n}": w.lag("_ret", n) for n in (1, 2, 3, 5)}),
               tuple(f"Ret_Lag_{n}" for n in (1, 2, 3, 5)), 6, MIN_ROWS)


def _gk_0(w):
    hl = F.ln(clip(ratio(F.col("High"), F.col("Low")), low=1.0))
    co = F.ln(clip(ratio(F.col("Close"), F.col("Open")), low=EPS))
    return {"_gk": clip(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, low=0.0)}


GARMAN_KLASS = Group("garman_klass", (_gk_0, lambda w: {"Vol_GK_20": F.sqrt(rmean("_gk", 20, w))}), ("Vol_GK_20",), 20, MIN_ROWS)


def _combined(w):
    return {"RSI_div_Vol": ratio(F.col("RSI_14"), F.col("Vol_20")), "Trend_x_Vol": F.col("Dist_MA_50") * F.col("BB_Width_20")}


COMBINED = Group("combined", (lambda w: {}, lambda w: {}, lambda w: {}, _combined), ("RSI_div_Vol", "Trend_x_Vol"), 60, MIN_ROWS)

TECHNICAL = (RSI, MACD, ROC, ATR, BOLLINGER, MA_DISTANCE, VOLATILITY, YEAR_RANGE, LAGGED, GARMAN_KLASS, COMBINED)


def add_technical(df: DataFrame) -> DataFrame:
    return apply_groups(df, TECHNICAL)
