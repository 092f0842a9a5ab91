"""Return-distribution, momentum and liquidity factors per ticker; calendar columns; the feature-set registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import (
    EPS, clip, pair_terms, pcorr, pct, pkurt, powers, pskew, pstd, ratio, rmax, rmean, rmin, row_mean, rstd, rsum,
)
from panelforge.operators.groups import Group, apply_groups, ewm_std_stages, returns_stage

MIN_ROWS = 260


def _reversal(w):
    return {"Rev_5d": pct("Close", 5, w), "Rev_10d": pct("Close", 10, w), "Rev_5d_Skip1": pct("_close_1", 5, w)}


REVERSAL = Group("reversal", (lambda w: {"_close_1": w.lag("Close")}, _reversal),
                 ("Rev_5d", "Rev_10d", "Rev_5d_Skip1"), 10, MIN_ROWS)


def _trend_terms(w):
    y, x = F.col("Close"), w.place()
    return {"_y2": y * y, "_xy": y * x, "_x": x}


def _trend(w):
    made: dict[str, Column] = {}
    for n in (20, 60, 120):
        sy, syy, sxy = w.agg("sum", "Close", n), w.agg("sum", "_y2", n), w.agg("sum", "_xy", n)
        # Rows are evenly spaced, so the sums over x are constants of the window length.
        ss_xx = n * (n * n - 1) / 12.0
        ss_xy = sxy - (F.col("_x") - (n - 1) / 2.0) * sy
        scale = ss_xx * (syy - sy * sy / n)
        fit = F.when(scale > EPS, ss_xy * ss_xy / (scale + EPS)).otherwise(0.0)
        made[f"Trend_RSq_{n}"] = F.when(w.agg("count", "Close", n) >= n, clip(fit, 0.0, 1.0))
        made[f"QualMom_{n}"] = pct("Close", n, w) * made[f"Trend_RSq_{n}"]
    return made


TREND = Group("trend_quality", (_trend_terms, _trend), tuple(f"{p}_{n}" for n in (20, 60, 120) for p in ("Trend_RSq", "QualMom")), 120, MIN_ROWS)

IDIO = Group(
    "idio_vol",
    (returns_stage,
     lambda w: {**{f"_res{n}": F.col("_ret") - rmean("_ret", n, w) for n in (20, 60)}, "_std20": rstd("_ret", 20, w)},
     lambda w: {**powers("_res60", 2), **powers("_std20", 2)},
     lambda w: {"IdioVol_20": rstd("_res20", 20, w), "IdioVol_60": pstd("_res60", 60, w), "VolOfVol_60": pstd("_std20", 60, w)}),
    ("IdioVol_20", "IdioVol_60", "VolOfVol_60"), 121, MIN_ROWS,
)


def _discreteness(w):
    made = {}
    for n in (21, 63, 126):
        made[f"InfoDisc_{n}"] = F.signum(rsum("_ret", n, w)) * w.agg("sum", "_sign", n) / F.lit(float(n))
    return made


DISCRETENESS = Group("info_discreteness", (returns_stage, lambda w: {"_sign": F.signum("_ret")}, _discreteness), tuple(f"InfoDisc_{n}" for n in (21, 63, 126)), 127, MIN_ROWS)


def _extremes(w):
    mean5 = w.top_mean("_ret", 21)
    high, low = rmax("_ret", 21, w), rmin("_ret", 21, w)
    full = w.agg("count", "_ret", 21) >= 21
    return {"MAX_21d": high, "MIN_21d": low, "MAX5_21d": F.when(full, mean5), "MaxMinSpread_21d": high - low}


EXTREMES = Group("max_effect", (returns_stage, _extremes), ("MAX_21d", "MIN_21d", "MAX5_21d", "MaxMinSpread_21d"), 22, MIN_ROWS)


def _moment_terms(w):
    zero = F.when(F.col("_ret").isNotNull(), F.lit(0.0))
    down, up = F.least(F.col("_ret"), zero), F.greatest(F.col("_ret"), zero)
    return {**powers("_ret", 4), "_down2": down * down, "_up2": up * up}


def _moments(w):
    made = {f"Skew_{n}d": pskew("_ret", n, w) for n in (60, 126)}
    made |= {f"Kurt_{n}d": pkurt("_ret", n, w) for n in (60, 126)}
    made["DownVol_60d"] = F.sqrt(rmean("_down2", 60, w))
    made["UpDownRatio_60d"] = ratio(F.sqrt(rmean("_up2", 60, w) + EPS), made["DownVol_60d"])
    return made


MOMENTS = Group("higher_moments", (returns_stage, _moment_terms, _moments),
                ("Skew_60d", "Skew_126d", "Kurt_60d", "Kurt_126d", "DownVol_60d", "UpDownRatio_60d"), 127, MIN_ROWS)


def _illiquidity(w):
    return {**returns_stage(w), "_illiq": ratio(F.abs(pct("Close", 1, w)), F.col("Volume") * F.col("Close")),
            "_absret": F.abs(pct("Close", 1, w)), "_vol_ma20": rmean("Volume", 20, w)}


VOLUME = Group(
    "volume",
    (_illiquidity, lambda w: {**pair_terms("_ret", "Volume"), **pair_terms("_absret", "Volume")}, lambda w: {
        "RelVol_20d": ratio(F.col("Volume"), F.col("_vol_ma20")), "RelVol_60d": ratio(F.col("Volume"), rmean("Volume", 60, w)),
        "VolMom_20d": pct("_vol_ma20", 20, w),
        **{f"Amihud_{n}{s}": rmean("_illiq", n, w) for n, s in ((21, "d"), (63, "d"), (20, ""))},
        "VolRetCorr_60d": F.when(w.agg("count", "_ret", 60) >= 60, pcorr("_ret", "Volume", 60, w)),
        "AbsVolRetCorr_60d": F.when(w.agg("count", "_ret", 60) >= 60, pcorr("_absret", "Volume", 60, w)),
    }),
    ("RelVol_20d", "RelVol_60d", "VolMom_20d", "Amihud_21d", "Amihud_63d", "Amihud_20", "VolRetCorr_60d", "AbsVolRetCorr_60d"),
    64, MIN_ROWS,
)


def _acceleration(w):
    m = {n: pct("Close", n, w) for n in (21, 63, 126)}
    first, second = w.agg("sum", "_ret", 15, 15), w.agg("sum", "_ret", 15)
    return {
        "MomAccel_21_63": m[21] - m[63] / 3, "MomAccel_63_126": m[63] - m[126] / 2,
        "MomConsist_60d": F.when(w.agg("count", "_ret", 30) >= 30, first * second),
        "Near52wHigh": ratio(F.col("Close"), rmax("High", 252, w)),
    }


ACCELERATION = Group("momentum_accel", (returns_stage, _acceleration),
                     ("MomAccel_21_63", "MomAccel_63_126", "MomConsist_60d", "Near52wHigh"), 252, MIN_ROWS)


def _quarters(w):
    def back(offset: int) -> Column:
        return F.when(w.agg("count", "_ret", 63, offset) >= 63, w.agg("sum", "_ret", 63, offset))

    return {**{f"_q{k}": back(63 * k) for k in range(4)}, "_month": rsum("_ret", 21, w)}


def _long_consistency(w):
    q = [F.col(f"_q{k}") for k in range(4)]
    n = sum((x.isNotNull().cast("int") for x in q[1:]), q[0].isNotNull().cast("int"))
    mean = row_mean(*q)
    squares = [F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in q]
    spread = F.when(n >= 2, F.sqrt(sum(squares[1:], squares[0]) / F.when(n >= 2, n - 1)))
    positive = [F.coalesce((x > 0).cast("int"), F.lit(0)) for x in q]
    return {
        "PosQuarters_252d": sum(positive[1:], positive[0]), "AvgQuarterRet_252d": (q[0] + q[1] + q[2] + q[3]) / 4,
        "MomConsist_252d": spread, "MomQuality_252d": ratio(pct("Close", 252, w), spread),
        "TrendPersist_252d": F.when(w.agg("count", "_month", 252) >= 252, pcorr("_month", "_month_1", 251, w)),
        "MomDivergence_126_252": pct("Close", 126, w) - pct("Close", 252, w) / 2,
    }


CONSISTENCY = Group(
    "long_consistency",
    (returns_stage, _quarters, lambda w: {"_month_1": w.lag("_month")}, lambda w: pair_terms("_month", "_month_1"),
     _long_consistency),
    ("PosQuarters_252d", "AvgQuarterRet_252d", "MomConsist_252d", "MomQuality_252d", "TrendPersist_252d", "MomDivergence_126_252"),
    280, MIN_ROWS,
)

ALPHA = (REVERSAL, TREND, IDIO, DISCRETENESS, EXTREMES, MOMENTS, VOLUME, ACCELERATION, CONSISTENCY)

_ewm_std, _ewm_rows = ewm_std_stages("_ret", "Vol_20d", 20, 10)


def _fast(w):
    peak = rmax("Close", 252, w, 60)
    high, low = rmax("_ret", 21, w, 10), rmin("_ret", 21, w, 10)
    return {
        **{f"Rev_{n}d": pct("Close", n, w) for n in (5, 10, 21)}, "MAX_21d": high, "MIN_21d": low,
        "MaxMinSpread_21d": high - low, "MomAccel_21_63": pct("Close", 21, w) - pct("Close", 63, w) / 3,
        "Near52wHigh": F.try_divide(F.col("Close"), F.coalesce(F.when(peak != 0, peak), F.lit(1.0))),
    }


FAST = Group(
    "alpha_fast", (returns_stage, _fast, *_ewm_std),
    ("Rev_5d", "Rev_10d", "Rev_21d", "Vol_20d", "MAX_21d", "MIN_21d", "MaxMinSpread_21d", "MomAccel_21_63", "Near52wHigh"),
    max(252, _ewm_rows + 1),
)

EXTENDED_MOMENTUM = Group("extended_momentum", (lambda w: {f"ROC_{n}": pct("Close", n, w) * 100 for n in (126, 252, 378)},),
                          ("ROC_126", "ROC_252", "ROC_378"), 378, 380)


def _risk_adjusted(w):
    base = {n: ratio(rmean("_ret", n, w), pstd("_ret", n, w)) for n in (63, 126, 252)}
    return {**{f"Risk_Adj_ROC_{n}": x for n, x in base.items()},
            **{f"Momentum_Sharpe_{n}": x * F.lit(252**0.5) for n, x in base.items()}}


RISK_ADJUSTED = Group("volatility_adjusted_momentum", (returns_stage, lambda w: powers("_ret", 2), _risk_adjusted),
                      tuple(f"{p}_{n}" for n in (63, 126, 252) for p in ("Risk_Adj_ROC", "Momentum_Sharpe")), 253, MIN_ROWS)


def _value(w):
    high, low = rmax("High", 252, w), rmin("Low", 252, w)
    return {"Dist_52w_Mid": ratio(F.col("Close") - (high + low) / 2, high - low),
            "Reversion_Score": -pct("Close", 252, w) * pstd("_ret", 252, w)}


VALUE = Group("value_features", (returns_stage, lambda w: powers("_ret", 2), _value), ("Dist_52w_Mid", "Reversion_Score"), 253, MIN_ROWS)


def add_alpha(df: DataFrame) -> DataFrame:
    return apply_groups(df, ALPHA)


def add_alpha_fast(df: DataFrame) -> DataFrame:
    return apply_groups(df, [FAST])


def add_interaction_terms(df: DataFrame) -> DataFrame:
    """Products of features that are present."""
    pairs = {"Mom_x_Vol": ("ROC_252", "Vol_252"), "RSI_x_Pos52w": ("RSI_14", "Pos_52w_Range"),
             "MA_Trend_Strength": ("Dist_MA_50", "Dist_MA_200")}
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def add_calendar(df: DataFrame) -> DataFrame:
    d = F.to_date(F.timestamp_millis("timestamp"))
    day, weekday = F.dayofmonth(d), F.weekday(d)
    return df.withColumns({
        "Month": F.month(d), "DayOfMonth": day, "IsMonthEnd": (d == F.last_day(d)).cast("int"),
        "IsMonthStart": (day == 1).cast("int"), "TurnOfMonth": ((day <= 3) | (day >= 28)).cast("int"),
        "Quarter": F.quarter(d), "DayOfWeek": weekday, "IsMonday": (weekday == 0).cast("int"),
        "IsFriday": (weekday == 4).cast("int"),
    })


_OPTIONAL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "extended_momentum": lambda df: apply_groups(df, [EXTENDED_MOMENTUM]),
    "volatility_adjusted_momentum": lambda df: apply_groups(df, [RISK_ADJUSTED]),
    "value_features": lambda df: apply_groups(df, [VALUE]),
    "interaction_features": add_interaction_terms,
    "alpha_fast": add_alpha_fast,
    "alpha_seasonality": add_calendar,
    **dict.fromkeys(("alpha_reversal", "alpha_momentum_quality", "alpha_idio_vol", "alpha_info_disc", "alpha_max_effect",
                     "alpha_higher_moments", "alpha_volume", "alpha_momentum_accel"), add_alpha),
}


class FeatureSets:
    """Optional feature sets that can be switched on and off by name."""

    def __init__(self, enabled: Sequence[str] = ()):
        self._on: list[str] = []
        for name in enabled:
            self.enable(name)

    @staticmethod
    def names() -> list[str]:
        return list(_OPTIONAL)

    def enabled(self) -> list[str]:
        return list(self._on)

    def enable(self, name: str) -> None:
        if name not in _OPTIONAL:
            raise ValueError(f"unknown feature set {name!r}")
        if name not in self._on:
            self._on.append(name)

    def disable(self, name: str) -> None:
        if name not in _OPTIONAL:
            raise ValueError(f"unknown feature set {name!r}")
        self._on = [n for n in self._on if n != name]

    def apply(self, df: DataFrame) -> DataFrame:
        """Apply each distinct function of the enabled sets once, in order."""
        for step in dict.fromkeys(_OPTIONAL[n] for n in self._on):
            df = df.transform(step)
        return df
