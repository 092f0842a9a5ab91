"""Technical indicators and alpha factors."""

from __future__ import annotations

import math


from panelforge.catalog.base import PANEL, W, Inputs, change, keyed, lag, query, roll, rounded
from panelforge.operators import alpha as A
from panelforge.operators import technical as T
from panelforge.operators.groups import apply_groups, outputs

E = "1e-6"


def fr(n: int, to: int = 0) -> str:
    end = "CURRENT ROW" if to == 0 else f"{to} PRECEDING"
    return f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND {end})"


F0 = PANEL + f""",
f0 AS (SELECT *, {change('c', 1)} AS ret, c - {lag('c')} AS step, {lag('c')} AS c1, row_number() OVER ({W}) AS rn,
  count(*) OVER (PARTITION BY ticker) AS n FROM panel),
f1 AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0.0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0.0 END AS loss,
  CASE WHEN c1 IS NULL THEN h - l ELSE greatest(h - l, abs(h - c1), abs(l - c1)) END AS tr,
  greatest(0.5 * ln(greatest(h / (l + {E}), 1.0)) ^ 2 - {2 * math.log(2) - 1!r} * ln(greatest(c / (o + {E}), {E})) ^ 2, 0.0) AS gk,
  abs(ret) / (v * c + {E}) AS illiq, {roll('avg', 'ret', 20)} AS rm20, {roll('avg', 'ret', 60)} AS rm60, {roll('stddev_samp', 'ret', 20)} AS rs20,
  {roll('avg', 'v', 20)} AS vm20, {roll('sum', 'ret', 21)} AS mon,
  {', '.join(f"CASE WHEN count(ret) {fr(63 * k + 62, 63 * k)} >= 63 THEN sum(ret) {fr(63 * k + 62, 63 * k)} END AS q{k}" for k in range(4))} FROM f0),
f2 AS (SELECT *, ret - rm20 AS res20, ret - rm60 AS res60, {lag('mon')} AS mon1 FROM f1)"""


def per_ticker(name: str, groups, columns: dict[str, str], need: int, digits: int = 6, extra: str = "", source: str = "f2") -> None:
    guarded = {k: (f"CASE WHEN n >= {need} THEN {v} END" if need > 1 else v) for k, v in columns.items()}
    query(name, lambda i: rounded(apply_groups(i.panel, groups), digits, ["timestamp", "ticker", *outputs(groups)]),
          f"WITH RECURSIVE {F0}{extra} {keyed(guarded, source, digits)}" if "RECURSIVE" in extra.upper() or source != "f2" else f"WITH {F0}{extra} {keyed(guarded, source, digits)}")


RSI = f"coalesce(100 - 100 / (1 + {roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + {E})), 50.0)"
SMA, STD = roll("avg", "c", 20), roll("stddev_samp", "c", 20)
dist = lambda n: f"(c - {roll('avg', 'c', n)}) / ({roll('avg', 'c', n)} + {E})"
TEC = {
    "RSI_14": RSI, "ROC_10": f"{change('c', 10)} * 100", "ROC_252": f"{change('c', 252)} * 100",
    **{f"ATR_{n}": roll("avg", "tr", n) for n in (14, 63, 126, 252)},
    **{f"NATR_{n}": f"{roll('avg', 'tr', n)} / (c + {E}) * 100" for n in (14, 63, 126, 252)},
    "BB_Width_20": f"{STD} * 4 / ({SMA} + {E})", "Dist_SMA_20": f"(c - {SMA}) / ({SMA} + {E})",
    **{f"Dist_MA_{n}": dist(n) for n in (20, 50, 200)}, **{f"Vol_{n}": roll("stddev_samp", "ret", n) for n in (20, 252)},
    "Pos_52w_Range": f"(c - {roll('min', 'l', 252)}) / ({roll('max', 'h', 252)} - {roll('min', 'l', 252)} + {E})",
    "Dist_52w_High": f"(c - {roll('max', 'h', 252)}) / ({roll('max', 'h', 252)} + {E})",
    **{f"Ret_Lag_{n}": lag("ret", n) for n in (1, 2, 3, 5)}, "Vol_GK_20": f"sqrt({roll('avg', 'gk', 20)})",
    "RSI_div_Vol": f"{RSI} / ({roll('stddev_samp', 'ret', 20)} + {E})", "Trend_x_Vol": f"{dist(50)} * ({STD} * 4 / ({SMA} + {E}))",
}


def tec(name: str, group, digits: int = 6) -> None:
    per_ticker(name, [group], {c: TEC[c] for c in group.outputs}, 50, digits)


def ema(out: str, source: str, x: str, spans: dict[str, int], extra: str = "") -> str:
    """Recursive twin of the seeded exponential mean."""
    seed = ", ".join(f"{x} AS {n}" for n in spans)
    step = ", ".join(f"{2 / (s + 1)!r} * t.{x} + {1 - 2 / (s + 1)!r} * e.{n}" for n, s in spans.items())
    return f""",
{out} AS (SELECT ts, ticker, rn, n, c{extra}, {seed} FROM {source} WHERE rn = 1 UNION ALL
  SELECT t.ts, t.ticker, t.rn, t.n, t.c{extra.replace(', ', ', t.')}, {step} FROM {out} e JOIN {source} t ON t.ticker = e.ticker AND t.rn = e.rn + 1)"""


tec("tec01_rsi", T.RSI)
per_ticker("tec02_macd", [T.MACD], {"MACD_Line": "line", "MACD_Signal": "sig", "MACD_Hist": "line - sig"}, 50, 5,
           ema("em", "f0", "c", {"e12": 12, "e26": 26}) + ",\nln AS (SELECT *, e12 - e26 AS line FROM em)" + ema("sg", "ln", "line", {"sig": 9}, ", line"), "sg")
tec("tec03_roc", T.ROC)
tec("tec04_atr", T.ATR)
tec("tec05_bollinger", T.BOLLINGER)
tec("tec06_ma_distance", T.MA_DISTANCE)
tec("tec07_volatility", T.VOLATILITY)
tec("tec08_year_range", T.YEAR_RANGE)
tec("tec09_lagged_returns", T.LAGGED)
tec("tec10_garman_klass", T.GARMAN_KLASS)
query("tec11_combined", lambda i: rounded(apply_groups(i.panel, [T.RSI, T.VOLATILITY, T.MA_DISTANCE, T.BOLLINGER, T.COMBINED]), 6,
                                          ["timestamp", "ticker", "RSI_div_Vol", "Trend_x_Vol"]),
      f"WITH {F0} " + keyed({c: f"CASE WHEN n >= 50 THEN {TEC[c]} END" for c in ("RSI_div_Vol", "Trend_x_Vol")}, "f2"))
query("ewm01_generic", lambda i: rounded(_ewm(i), 5),
      f"WITH RECURSIVE {F0}{ema('em', 'f0', 'c', {'e5': 5, 'e20': 20})} {keyed({'EWM_5': 'e5', 'EWM_20': 'e20'}, 'em', 5)}")


def _ewm(i: Inputs):
    from panelforge.operators.groups import ewm_mean_stages
    from panelforge.operators.ordered import over_series

    stages, rows = ewm_mean_stages({"EWM_5": ("Close", 5), "EWM_20": ("Close", 20)})
    return over_series(i.panel.select("timestamp", "ticker", "Close"), stages, rows).drop("Close")


# Weighted deviation by definition: explicit weights over all earlier returns of the ticker.
Q20 = 1 - 2 / 21
EWSTD = f""",
ew AS (SELECT a.ticker, a.rn, sum({Q20!r} ^ (a.rn - b.rn)) AS sw, sum({Q20!r} ^ (2 * (a.rn - b.rn))) AS sww,
  sum({Q20!r} ^ (a.rn - b.rn) * b.ret) AS sx, sum({Q20!r} ^ (a.rn - b.rn) * b.ret * b.ret) AS sxx, count(*) AS k
  FROM f0 a JOIN f0 b ON a.ticker = b.ticker AND b.rn <= a.rn AND b.ret IS NOT NULL GROUP BY 1, 2),
fz AS (SELECT f2.*, CASE WHEN k >= 10 AND ret IS NOT NULL THEN sqrt((sxx / sw - (sx / sw) ^ 2) * sw * sw / (sw * sw - sww)) END AS ewstd
  FROM f2 LEFT JOIN ew USING (ticker, rn))"""


def rsq(n: int) -> str:
    over = fr(n - 1)
    sxx, syy, sxy = (f"regr_{p}(c, rn) {over}" for p in ("sxx", "syy", "sxy"))
    return f"(CASE WHEN count(c) {over} >= {n} THEN CASE WHEN {sxx} * {syy} > {E} THEN least(({sxy}) ^ 2 / ({sxx} * {syy} + {E}), 1.0) ELSE 0.0 END END)"


def disc(n: int) -> str:
    return f"sign({roll('sum', 'ret', n)}) * (count(*) FILTER (ret > 0) {fr(n - 1)} - count(*) FILTER (ret < 0) {fr(n - 1)}) / {float(n)}"


def pair_corr(x: str, y: str, n: int) -> str:
    return f"CASE WHEN count({x}) {fr(n - 1)} >= {n} THEN corr({x}, {y}) {fr(n - 1)} END"


down = f"sqrt({roll('avg', 'least(ret, 0.0) ^ 2', 60)})".replace("count(least(ret, 0.0) ^ 2)", "count(ret)").replace("avg(least(ret, 0.0) ^ 2)", "avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0.0) ^ 2 END)")
up = f"sqrt({roll('avg', 'ret', 60)} + {E})".replace("avg(ret)", "avg(CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) ^ 2 END)")
QM = "list_avg(list_filter([q0, q1, q2, q3], lambda x: x IS NOT NULL))"
QSTD = "CASE WHEN len(list_filter([q0, q1, q2, q3], lambda x: x IS NOT NULL)) >= 2 THEN list_stddev_samp([q0, q1, q2, q3]) END"
ALP = {
    "Rev_5d": change("c", 5), "Rev_10d": change("c", 10), "Rev_5d_Skip1": f"({lag('c', 1)} - {lag('c', 6)}) / {lag('c', 6)}",
    **{f"Trend_RSq_{n}": rsq(n) for n in (20, 60, 120)}, **{f"QualMom_{n}": f"{change('c', n)} * {rsq(n)}" for n in (20, 60, 120)},
    "IdioVol_20": roll("stddev_samp", "res20", 20), "IdioVol_60": roll("stddev_samp", "res60", 60), "VolOfVol_60": roll("stddev_samp", "rs20", 60),
    **{f"InfoDisc_{n}": disc(n) for n in (21, 63, 126)},
    "MAX_21d": roll("max", "ret", 21), "MIN_21d": roll("min", "ret", 21), "MaxMinSpread_21d": f"{roll('max', 'ret', 21)} - {roll('min', 'ret', 21)}",
    "MAX5_21d": f"CASE WHEN count(ret) {fr(20)} >= 21 THEN list_avg(list_reverse_sort(list(ret) {fr(20)})[1:5]) END",
    **{f"Skew_{n}d": roll("skewness", "ret", n) for n in (60, 126)}, **{f"Kurt_{n}d": roll("kurtosis", "ret", n) for n in (60, 126)},
    "DownVol_60d": down, "UpDownRatio_60d": f"{up} / ({down} + {E})",
    "RelVol_20d": f"v / (vm20 + {E})", "RelVol_60d": f"v / ({roll('avg', 'v', 60)} + {E})", "VolMom_20d": change("vm20", 20),
    **{f"Amihud_{n}{s}": roll("avg", "illiq", n) for n, s in ((21, "d"), (63, "d"), (20, ""))},
    "VolRetCorr_60d": pair_corr("ret", "v", 60), "AbsVolRetCorr_60d": pair_corr("abs(ret)", "v", 60),
    "MomAccel_21_63": f"{change('c', 21)} - {change('c', 63)} / 3", "MomAccel_63_126": f"{change('c', 63)} - {change('c', 126)} / 2",
    "MomConsist_60d": f"CASE WHEN count(ret) {fr(29)} >= 30 THEN (sum(ret) {fr(29, 15)}) * (sum(ret) {fr(14)}) END",
    "Near52wHigh": f"c / ({roll('max', 'h', 252)} + {E})",
    "PosQuarters_252d": " + ".join(f"coalesce(CAST(q{k} > 0 AS INT), 0)" for k in range(4)),
    "AvgQuarterRet_252d": "(q0 + q1 + q2 + q3) / 4", "MomConsist_252d": QSTD, "MomQuality_252d": f"{change('c', 252)} / ({QSTD} + {E})",
    "TrendPersist_252d": f"CASE WHEN count(mon) {fr(251)} >= 252 THEN corr(mon, mon1) {fr(250)} END",
    "MomDivergence_126_252": f"{change('c', 126)} - {change('c', 252)} / 2",
}


def alp(name: str, group, columns=None, digits: int = 6, source_group=None) -> None:
    picked = columns or group.outputs
    sql = {c: f"CASE WHEN n >= 260 THEN {ALP[c]} END" for c in picked}
    ints = [c for c in picked if c == "PosQuarters_252d"]
    body = keyed({c: e for c, e in sql.items() if c not in ints}, "f2", digits, 'ts AS "timestamp", ticker' + "".join(f", {sql[c]} AS \"{c}\"" for c in ints))
    query(name, lambda i: rounded(apply_groups(i.panel, [group]), digits, ["timestamp", "ticker", *picked]), f"WITH {F0} {body}")


alp("alp01_reversal", A.REVERSAL)
alp("alp02_trend_quality", A.TREND)
alp("alp03_idio_vol", A.IDIO)
alp("alp04_info_discreteness", A.DISCRETENESS)
alp("alp05_max_effect", A.EXTREMES)
alp("alp06_skew_kurt", A.MOMENTS, ("Skew_60d", "Skew_126d", "Kurt_60d", "Kurt_126d"))
alp("alp07_downside", A.MOMENTS, ("DownVol_60d", "UpDownRatio_60d"))
alp("alp08_relative_volume", A.VOLUME, ("RelVol_20d", "RelVol_60d", "VolMom_20d"))
alp("alp09_amihud", A.VOLUME, ("Amihud_21d", "Amihud_63d", "Amihud_20"), 9)
alp("alp10_volume_return_corr", A.VOLUME, ("VolRetCorr_60d", "AbsVolRetCorr_60d"))
alp("alp11_momentum_accel", A.ACCELERATION, ("MomAccel_21_63", "MomAccel_63_126"))
alp("alp12_momentum_consistency", A.ACCELERATION, ("MomConsist_60d",))
alp("alp13_near_high", A.ACCELERATION, ("Near52wHigh",))
alp("alp14_quarters", A.CONSISTENCY, ("PosQuarters_252d", "AvgQuarterRet_252d", "MomConsist_252d", "MomQuality_252d"))
alp("alp15_trend_persistence", A.CONSISTENCY, ("TrendPersist_252d",))
alp("alp16_divergence", A.CONSISTENCY, ("MomDivergence_126_252",))
CAL = {"Month": "month(d)", "DayOfMonth": "day(d)", "IsMonthEnd": "CAST(d = last_day(d) AS INT)", "IsMonthStart": "CAST(day(d) = 1 AS INT)",
       "TurnOfMonth": "CAST(day(d) <= 3 OR day(d) >= 28 AS INT)", "Quarter": "quarter(d)", "DayOfWeek": "isodow(d) - 1",
       "IsMonday": "CAST(isodow(d) = 1 AS INT)", "IsFriday": "CAST(isodow(d) = 5 AS INT)"}
query("alp17_calendar", lambda i: A.add_calendar(i.panel.select("timestamp", "ticker")),
      f"WITH {PANEL}, dd AS (SELECT *, CAST(make_timestamp(ts * 1000) AS DATE) AS d FROM panel) SELECT ts AS \"timestamp\", ticker, "
      + ", ".join(f"CAST({e} AS INT) AS \"{n}\"" for n, e in CAL.items()) + " FROM dd")
PEAK = roll("max", "c", 252, 60)
FAST_SQL = {
    "Rev_5d": change("c", 5), "Rev_10d": change("c", 10), "Rev_21d": change("c", 21), "Vol_20d": "ewstd", "MAX_21d": roll("max", "ret", 21, 10),
    "MIN_21d": roll("min", "ret", 21, 10), "MaxMinSpread_21d": f"{roll('max', 'ret', 21, 10)} - {roll('min', 'ret', 21, 10)}",
    "MomAccel_21_63": ALP["MomAccel_21_63"], "Near52wHigh": f"c / coalesce(nullif({PEAK}, 0), 1)",
}
query("alp18_fast_set", lambda i: rounded(apply_groups(i.panel, [A.FAST]), 6, ["timestamp", "ticker", *A.FAST.outputs]),
      f"WITH {F0}{EWSTD} {keyed(FAST_SQL, 'fz')}")
query("ewm02_std", lambda i: rounded(apply_groups(i.panel, [A.FAST]), 6, ["timestamp", "ticker", "Vol_20d"]),
      f"WITH {F0}{EWSTD} {keyed({'Vol_20d': 'ewstd'}, 'fz')}")
per_ticker("alp19_extended_momentum", [A.EXTENDED_MOMENTUM], {f"ROC_{n}": f"{change('c', n)} * 100" for n in (126, 252, 378)}, 380)
RAR = {n: f"{roll('avg', 'ret', n)} / ({roll('stddev_samp', 'ret', n)} + {E})" for n in (63, 126, 252)}
per_ticker("alp20_risk_adjusted", [A.RISK_ADJUSTED], {**{f"Risk_Adj_ROC_{n}": e for n, e in RAR.items()},
           **{f"Momentum_Sharpe_{n}": f"{e} * {252**0.5!r}" for n, e in RAR.items()}}, 260)
HI, LO = roll("max", "h", 252), roll("min", "l", 252)
per_ticker("alp21_value", [A.VALUE], {"Dist_52w_Mid": f"(c - ({HI} + {LO}) / 2) / ({HI} - {LO} + {E})",
           "Reversion_Score": f"-{change('c', 252)} * {roll('stddev_samp', 'ret', 252)}"}, 260)
query("alp22_products", lambda i: rounded(A.add_interaction_terms(apply_groups(i.panel, [T.ROC, T.VOLATILITY, T.RSI, T.YEAR_RANGE, T.MA_DISTANCE])), 4,
                                          ["timestamp", "ticker", "Mom_x_Vol", "RSI_x_Pos52w", "MA_Trend_Strength"]),
      f"WITH {F0} " + keyed({"Mom_x_Vol": f"{TEC['ROC_252']} * {TEC['Vol_252']}", "RSI_x_Pos52w": f"{TEC['RSI_14']} * {TEC['Pos_52w_Range']}",
                             "MA_Trend_Strength": f"({TEC['Dist_MA_50']}) * ({TEC['Dist_MA_200']})"}, "f2", 4))
query("alp23_feature_sets", lambda i: rounded(A.FeatureSets(["value_features", "extended_momentum", "alpha_seasonality"]).apply(i.panel), 6,
                                              ["timestamp", "ticker", "Dist_52w_Mid", "ROC_378", "Month"]),
      f"WITH {F0} " + keyed({"Dist_52w_Mid": f"CASE WHEN n >= 260 THEN (c - ({HI} + {LO}) / 2) / ({HI} - {LO} + {E}) END",
                             "ROC_378": f"CASE WHEN n >= 380 THEN {change('c', 378)} * 100 END"}, "f2", 6,
                            'ts AS "timestamp", ticker, CAST(month(make_timestamp(ts * 1000)) AS INT) AS "Month"'))
