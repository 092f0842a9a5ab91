"""Ratios, macro, interactions, attention, generated lags, cross-sectional ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.b_features import ALP, E, F0, TEC
from panelforge.catalog.base import MACRO, PANEL, W, Inputs, change, keyed, lag, query, r, roll, rounded
from panelforge.operators import alpha as A
from panelforge.operators import lagma as L
from panelforge.operators import ratios as R
from panelforge.operators import technical as T
from panelforge.operators.groups import apply_groups
from panelforge.operators.ordered import average_ranks
from panelforge.operators.panel import macro_asof
from panelforge.session import stored

KEY = ["timestamp", "ticker"]


def q(name: str, build, columns: dict[str, str], sql_from: str, digits: int = 6, keys=KEY, sql_keys: str = 'ts AS "timestamp", ticker') -> None:
    query(name, lambda i: rounded(build(i), digits, [*keys, *columns]), f"WITH {sql_from.split('@@')[0]} " + keyed(columns, sql_from.split("@@")[1], digits, sql_keys))


def safe(x: str, y: str, lo: float, hi: float) -> str:
    s = f"(({x}) / CASE WHEN abs({y}) < {E} THEN {E} ELSE {y} END)"
    return f"CASE WHEN {s} IS NOT NULL THEN least(greatest(least(greatest({s}, -1e6), 1e6), {lo}), {hi}) END"


def clipped(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


q("rat01_candles", lambda i: R.add_candle_ratios(i.panel), {
    "DailyRange_Pct": f"(h - l) / (o + {E})", "ClosePosition": f"CASE WHEN h - l > {E} THEN (c - l) / (h - l) ELSE 0.5 END",
    "UpperShadow_Pct": f"(h - greatest(o, c)) / (h - l + {E})", "LowerShadow_Pct": f"(least(o, c) - l) / (h - l + {E})",
    "BodySize_Pct": f"abs(c - o) / (h - l + {E})", "Open_Close_Ratio": f"o / (c + {E})", "HL_Close_Ratio": f"(h - l) / (c + {E})",
}, f"{PANEL}@@panel")
q("rat02_dollar_volume", lambda i: R.add_dollar_volume(i.panel), {"DollarVolume": "v * c"}, f"{PANEL}@@panel", 3)
MK = 'ts AS "timestamp"'
q("rat03_rate_gaps", lambda i: R.add_rate_gaps(i.macro), {"ImmediateInterestVolatility": "lr - im", "ShortTermInterestVolatility": "lr - sr"},
  f"{MACRO}@@macro", 6, ["timestamp"], MK)
DY = f"sum(coalesce(dv, 0.0)) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) / (c + {E})"
q("rat04_dividend_yield", lambda i: R.add_dividend_yield(i.panel), {"TrailingDivYield_252d": DY}, f"{PANEL}@@panel")


def funds(i: Inputs):
    """Fundamental columns stood in for by panel columns."""
    p = i.panel
    return p.select("timestamp", "ticker", (F.col("Close") - F.col("Open")).alias(R.NET_INCOME), F.col("Volume").alias(R.SHARES),
                    F.col("High").alias(R.REVENUE), F.col("Low").alias(R.SGA), F.col("Open").alias(R.DEPRECIATION), F.col("Close").alias(R.FEES),
                    F.col("Dividend").alias(R.INTEREST_EXPENSE), F.col("AdjClose").alias(R.EBITDA), F.col("Low").alias("annualOperatingCashFlow"))


q("rat05_fundamentals", lambda i: R.add_fundamental_ratios(funds(i)), {
    "EPS_Basic": f"(c - o) / (v + {E})", "NetProfitMargin": f"(c - o) / (h + {E})", "SGA_Ratio": f"l / (h + {E})",
    "DepreciationRatio": f"o / (h + {E})", "CommissionEfficiency": f"c / (h + {E})"}, f"{PANEL}@@panel")


def _safe(i: Inputs):
    from panelforge.functions.columns import first_existing, safe_divide, safe_pct
    from panelforge.operators.ordered import over_series

    gap = F.col("Close") - F.col("Open")
    p = i.panel.withColumn("safe", safe_divide(F.col("High"), F.when(gap == 0, F.lit(-1e-9)).otherwise(gap)))
    p = over_series(p, [lambda w: {"safe_pct": safe_pct("Close", 3, w)}], 3)
    return p.withColumn("picked", F.col(first_existing(p.columns, "Missing", "Low", "High")))


GAP = "(CASE WHEN c = o THEN -1e-9 ELSE c - o END)"
q("rat06_safe_ratios", _safe, {"safe": safe("h", GAP, -1e6, 1e6), "safe_pct": safe(f"c - {lag('c', 3)}", lag("c", 3), -1e6, 1e6), "picked": "l"},
  f"{PANEL}@@panel", 4)
q("rat07_yield_curve", lambda i: R.add_yield_curve_spread(i.macro), {"YieldCurveSpread": clipped("lr - sr", -10, 10)}, f"{MACRO}@@macro", 6, ["timestamp"], MK)
q("rat08_vol_term", lambda i: R.add_vol_term_structure(apply_groups(i.panel, [T.VOLATILITY])),
  {"VolTermStructure": f"CASE WHEN n >= 50 THEN {safe(TEC['Vol_20'], TEC['Vol_252'], 0.1, 10)} END"}, f"{F0}@@f2")
q("rat09_gold_oil", lambda i: R.add_gold_oil_ratio(i.macro), {"GoldOilRatio": safe("gold", "oil", 5, 100)}, f"{MACRO}@@macro", 6, ["timestamp"], MK)
GRID = f"""{PANEL},{MACRO},
fxs AS (SELECT ts, fx FROM macro WHERE fx IS NOT NULL), mks AS (SELECT ts, ftse FROM macro WHERE ftse IS NOT NULL),
grid AS (SELECT g.ts, fx, ftse FROM (SELECT DISTINCT ts FROM panel) g ASOF LEFT JOIN fxs ON g.ts >= fxs.ts ASOF LEFT JOIN mks ON g.ts >= mks.ts),
chg AS (SELECT ts, {change('fx', 1, 'ORDER BY ts')} AS fx_ret, {change('ftse', 1, 'ORDER BY ts')} AS mk_ret FROM grid),
own AS (SELECT ts, ticker, {change('c', 1)} AS ret FROM panel), rel AS (SELECT own.*, fx_ret, mk_ret FROM own JOIN chg USING (ts))"""
q("rat10_fx_adjusted", lambda i: R.add_relative_returns(i.panel, i.macro), {"FX_Adjusted_Return": clipped("ret + fx_ret", -0.5, 0.5)}, f"{GRID}@@rel")
q("rat11_relative_to_market", lambda i: R.add_relative_returns(i.panel, i.macro), {"RelativeToMarket": clipped("ret - mk_ret", -0.5, 0.5)}, f"{GRID}@@rel")
q("rat12_market_share", lambda i: R.add_market_share(R.add_dollar_volume(i.panel)),
  {"DollarVolMarketShare": safe("dvol", "tot", 0, 1)}, f"{PANEL}, sh AS (SELECT *, v * c AS dvol, sum(v * c) OVER (PARTITION BY ts) AS tot FROM panel)@@sh")


def fear(i: Inputs):
    """Hourly page-view style series from the event stream."""
    hour = F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp"))
    return i.table("events").groupBy(hour.alias("timestamp")).agg(
        F.sum((F.col("event_type") == "error").cast("double")).alias("MACRO_Recession_Wiki_Views"),
        F.sum(F.when(F.col("event_type") == "view", 1.0)).alias("MACRO_Inflation_Wiki_Views"),
        F.sum(F.when(F.col("event_type") == "click", 1.0)).alias("MACRO_Bank_run_Wiki_Views"),
    )


FEAR = """fear AS (SELECT epoch_ms(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS ts, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE AS a,
  sum(CASE WHEN event_type = 'view' THEN 1.0 END)::DOUBLE AS b, sum(CASE WHEN event_type = 'click' THEN 1.0 END)::DOUBLE AS c FROM events GROUP BY 1)"""
norm = lambda x: f"CASE WHEN avg({x}) OVER (ORDER BY ts) > {E} THEN {x} / avg({x}) OVER (ORDER BY ts) END"
q("rat13_fear_ratio", lambda i: R.fear_ratio(fear(i)), {"FearRatio": clipped("list_avg([x, y, z])", 0, 10)},
  f"{FEAR}, nf AS (SELECT ts, {norm('a')} AS x, {norm('b')} AS y, {norm('c')} AS z FROM fear)@@nf", 6, ["timestamp"], MK)
q("rat14_earnings_quality", lambda i: R.add_earnings_quality(funds(i)), {"EarningsQuality": safe("l", "(c - o)", -5, 5)}, f"{PANEL}@@panel")
q("rat15_aquaculture", lambda i: R.aquaculture_trend(i.macro, "MACRO_OECD_Consumer"),
  {"AquacultureTrend": clipped(change("consumer", 252, "ORDER BY ts"), -1, 1)}, f"{MACRO}@@macro", 6, ["timestamp"], MK)

# --- interactions ---------------------------------------------------------
WITH_RATE = f"""{PANEL},{MACRO}, pm AS (SELECT p.*, m.lr, m.sr, m.im FROM panel p ASOF LEFT JOIN macro m ON p.ts >= m.ts)"""
BURDEN = f"CASE WHEN true THEN least(abs(coalesce(dv, 0.0)) / (abs(coalesce(h, 0.0)) + {E}), 0.5) END"
COVER = f"1.0 / least(greatest(coalesce(ac, 0.0) / (abs(coalesce(dv, 0.0)) + {E}), 0.1), 20)"
RATES = lambda i: i.macro.select("timestamp", *[F.col(f"`{c}`") for c in (R.LONG_RATE, R.SHORT_RATE, R.IMMEDIATE_RATE)])
q("int01_debt_proxies", lambda i: R.add_debt_proxies(macro_asof(funds(i), RATES(i))), {
    "InterestBurden": BURDEN, "InterestCoverageInv": COVER, "IR_x_DebtBurden": f"coalesce(lr, 0.0) * ({BURDEN})",
    "IR_x_LowCoverage": f"coalesce(lr, 0.0) * ({COVER})"}, f"{WITH_RATE}@@pm")
F2R = f"""{F0},{MACRO}, tecs AS (SELECT ts, ticker, {', '.join(f"CASE WHEN n >= 50 THEN {TEC[c]} END AS {c}" for c in ('ROC_252', 'ROC_10', 'Vol_20', 'Vol_252', 'RSI_14', 'Dist_MA_200'))} FROM f2),
tm AS (SELECT t.*, m.lr, m.sr, m.im FROM tecs t ASOF LEFT JOIN macro m ON t.ts >= m.ts),
ti AS (SELECT *, coalesce(lr - {lag('lr')}, 0.0) AS chg FROM tm)"""
RATE_IN = lambda i: macro_asof(apply_groups(i.panel, [T.ROC, T.VOLATILITY, T.RSI, T.MA_DISTANCE]), RATES(i))
IRX = {"IR_x_Mom252": "coalesce(lr, 0.0) * ROC_252", "IR_x_Mom10": "coalesce(lr, 0.0) * ROC_10", "IR_x_Vol20": "coalesce(lr, 0.0) * Vol_20",
       "IR_x_Vol252": "coalesce(lr, 0.0) * Vol_252", "IR_x_RSI": "coalesce(lr, 0.0) * RSI_14", "IR_x_Trend": "coalesce(lr, 0.0) * Dist_MA_200",
       "IR_Change": "chg", "IR_Change_x_Mom252": "chg * ROC_252"}
q("int02_rate_interactions", lambda i: R.add_rate_interactions(RATE_IN(i)), IRX, f"{F2R}@@ti", 4)
CROSS = {"YieldCurveSlope": "coalesce(lr, 0.0) - coalesce(sr, 0.0)", "YieldSlope_x_Mom252": "(coalesce(lr, 0.0) - coalesce(sr, 0.0)) * ROC_252",
         "LT_IM_Spread": "coalesce(lr, 0.0) - coalesce(im, 0.0)"}
q("int03_cross_macro", lambda i: R.add_cross_macro(RATE_IN(i)), CROSS, f"{F2R}@@ti", 4)
q("int04_all_interactions", lambda i: R.add_all_interactions(RATE_IN(i)), {**IRX, **CROSS}, f"{F2R}@@ti", 4)


# --- attention ------------------------------------------------------------
def attention(i: Inputs):
    """Page-view style counts per user and day."""
    day = F.unix_millis(F.date_trunc("day", "ts").cast("timestamp"))
    count = lambda t: F.sum((F.col("event_type") == t).cast("double"))
    return i.table("events").groupBy(day.alias("timestamp"), F.col("user_id").cast("string").alias("ticker")).agg(
        count("view").alias("Wiki_Views_Desktop"), count("click").alias("Wiki_Views_Mobile"))


ATT = """att AS (SELECT epoch_ms(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS ts, CAST(user_id AS VARCHAR) AS ticker,
  CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS d, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS m FROM events GROUP BY 1, 2),
ar AS (SELECT *, m / (d + m + 1e-6) AS mr FROM att)"""
q("att01_mobile_ratio", lambda i: R.add_mobile_ratio(attention(i)), {"Attn_Mobile_Ratio": "mr", "Attn_Mobile_Ratio_Change_14": f"mr - {lag('mr', 14)}"}, f"{ATT}@@ar")
OT = "ORDER BY ts"
q("att02_fear_attention", lambda i: R.fear_attention(fear(i)), {
    "Attn_Fear_Total": "t", "Attn_Fear_Mean": "list_avg([a, b, c])", "Attn_Fear_Mom_7": change("t", 7, OT), "Attn_Fear_Mom_14": change("t", 14, OT),
    "Attn_Fear_Spike": f"t / ({roll('avg', 't', 28, 7, OT)} + {E})"},
  f"{FEAR}, ft AS (SELECT *, coalesce(a, 0.0) + coalesce(b, 0.0) + coalesce(c, 0.0) AS t FROM fear)@@ft", 6, ["timestamp"], MK)

# --- cross-sectional ranks ------------------------------------------------
RANKS = R.RANKED


def rank_sql(x: str) -> str:
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY ts) END, 0.5)"


def ranked_features(i: Inputs):
    # Rounded first: neighbouring values must not change places through summation order.
    feats = apply_groups(i.panel, [*T.TECHNICAL, *A.ALPHA])
    return R.add_date_percentiles(rounded(feats, 6, [*KEY, *RANKS]), RANKS)


q("xsf01_date_percentiles", ranked_features, {f"Rank_{c}": rank_sql(c) for c in RANKS},
  f"""{F0}, base AS (SELECT ts, ticker, {', '.join(f"{r(f'CASE WHEN n >= {50 if c in TEC else 260} THEN {TEC.get(c) or ALP[c]} END', c)}" for c in RANKS)} FROM f2)@@base""")


def _repeated(i: Inputs):
    """Rows that repeat, rows without a ticker, and rows without a day."""
    rows = i.panel.select("timestamp", "ticker", "Close", F.col("Volume").cast("bigint").alias("Volume"))
    twice = rows.filter("Volume > 30").withColumn("ticker", F.lit(None).cast("string"))
    return rows.union(rows.filter("Volume > 20")).union(twice).union(twice.withColumn("timestamp", F.lit(None).cast("bigint")))


def _tied(c: str) -> str:
    by = f"OVER (PARTITION BY ts ORDER BY {c}"
    return f"(rank() {by}) + count(*) {by} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"


query("xsf01_repeated_keys", lambda i: rounded(average_ranks(_repeated(i), ["Close", "Volume"], ["timestamp"]), 4),
      f"""WITH {PANEL}, own AS (SELECT ts, ticker, c, v FROM panel), few AS (SELECT ts, NULL AS ticker, c, v FROM panel WHERE v > 30),
      rep AS (SELECT * FROM own UNION ALL SELECT * FROM own WHERE v > 20 UNION ALL SELECT * FROM few UNION ALL SELECT NULL, ticker, c, v FROM few)
      SELECT ts AS "timestamp", ticker, {r('c', 'Close', 4)}, CAST(v AS BIGINT) AS "Volume", {r(_tied('c'), '_rank_Close', 4)}, {r(_tied('v'), '_rank_Volume', 4)},
      count(c) OVER (PARTITION BY ts) AS "_count_Close", count(v) OVER (PARTITION BY ts) AS "_count_Volume" FROM rep""")


# --- generated lags -------------------------------------------------------
def lag_sql(configs, scope: str, columns: dict[str, str]) -> dict[str, str]:
    """Twin of the generated columns for sources given as {name: SQL column}."""
    by = W if scope == "ticker" else OT
    out: dict[str, str] = {}
    for config in configs:
        sources = L.matching(list(columns), config.pattern)
        for s in sources:
            x, several = columns[s], len(sources) > 1
            mean = lambda n: roll("avg", x, n, max(1, int(n * 0.5)), by)
            for name, (kind, *n) in L._plan(config, s, several).items():
                out[name] = {
                    "lag": lambda: lag(x, n[0], by), "ma": lambda: mean(n[0]), "mom": lambda: change(x, n[0], by),
                    "diff": lambda: f"{x if n[0] == 0 else mean(n[0])} - {mean(n[1])}",
                    "spike": lambda: f"{x} / nullif({mean(n[0])}, 0)",
                    "vol": lambda: roll("stddev_samp", f"{x}_pct", n[0], max(1, n[0] // 2), by),
                }[kind]()
    return out


DOLVOL = [L.TICKER_CONFIGS[0]]
q("lag01_ticker", lambda i: L.add_lag_features(R.add_dollar_volume(i.panel).select(*KEY, "DollarVolume"), DOLVOL, "ticker"),
  lag_sql(DOLVOL, "ticker", {"DollarVolume": "x"}),
  f"{PANEL}, x0 AS (SELECT ts, ticker, v * c AS x FROM panel), x1 AS (SELECT *, {change('x', 1)} AS x_pct FROM x0)@@x1", 3)

def declared(config: L.LagConfig) -> None:
    """An entry for one declaration over all of its source columns, rounded first as for the ranks."""
    names = L.matching([*TEC, *ALP], config.pattern)
    q(f"lag01_{config.prefix.lower()}", lambda i: L.add_lag_features(stored(rounded(apply_groups(i.panel, [*T.TECHNICAL, *A.ALPHA]), 6, [*KEY, *names])), [config], "ticker"),
      lag_sql([config], "ticker", {c: f'"{c}"' for c in names}),
      f"""{F0}, base AS (SELECT ts, ticker, {', '.join(r(f'CASE WHEN n >= {50 if c in TEC else 260} THEN {TEC.get(c) or ALP[c]} END', c) for c in names)} FROM f2)@@base""", 3)


for _config in L.TICKER_CONFIGS:
    if L.matching([*TEC, *ALP], _config.pattern):
        declared(_config)
YIELD = [c for c in L.TICKER_CONFIGS if L.matching(["TrailingDivYield_252d"], c.pattern)]
q("lag01_divyld", lambda i: L.add_lag_features(stored(rounded(R.add_dividend_yield(i.panel), 6, [*KEY, "TrailingDivYield_252d"])), YIELD, "ticker"),
  lag_sql(YIELD, "ticker", {"TrailingDivYield_252d": "x"}), f"{PANEL}, base AS (SELECT ts, ticker, {r(DY, 'x')} FROM panel)@@base", 3)
MACRO_SOURCES = {"MACRO_OECD_Consumer": "consumer", R.LONG_RATE: "lr", R.SHORT_RATE: "sr", "MACRO_GC=F_Close": "gold", "MACRO_^FTSE_Close": "ftse"}
q("lag02_macro", lambda i: L.add_all_macro_lags(i.macro.select("timestamp", *[F.col(f"`{c}`") for c in MACRO_SOURCES])),
  lag_sql(L.MACRO_CONFIGS, "global", MACRO_SOURCES), f"{MACRO}@@macro", 4, ["timestamp"], MK)
CUSTOM = [L.LagConfig(r"^Close$", "Px", (1, 5), (5, 300), (5,), ((0, 20), (5, 20)), spike=True, volatility=True),
          L.LagConfig(r"^Volume$|^High$", "Two", (2,), (3,))]
q("lag03_custom_config", lambda i: L.add_lag_features(i.panel.select(*KEY, "Close", "Volume", "High"), CUSTOM, "ticker"),
  lag_sql(CUSTOM, "ticker", {"Close": "c", "Volume": "v", "High": "h"}),
  f"{PANEL}, cp AS (SELECT *, {change('c', 1)} AS c_pct FROM panel)@@cp", 4)
