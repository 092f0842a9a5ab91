"""Candle, fundamental, macro and attention ratios, and their interactions.

Market-wide changes are taken between distinct timestamps, never between rows of
the ticker-by-day panel, where neighbouring rows belong to different tickers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import EPS, clip, first_existing, pct, ratio, rmean, row_mean, rsum, safe_divide
from panelforge.operators.groups import Group, apply_groups
from panelforge.operators.ordered import average_ranks, lookup, over_series, running
from panelforge.operators.panel import macro_on_grid

# Column names of the market-wide series, first choice first (fixed names of the data).
LONG_RATE = "MACRO_Long-term interest rates"
SHORT_RATE = "MACRO_Short-term interest rates"
IMMEDIATE_RATE = "MACRO_Immediate interest rates- call money- interbank rate"
LONG_RATES = ("MACRO_^TNX_AdjClose", LONG_RATE)
SHORT_RATES = (SHORT_RATE, IMMEDIATE_RATE)
GOLD = ("MACRO_GC=F_AdjClose", "MACRO_GC=F_Close")
OIL = ("MACRO_CL=F_AdjClose", "MACRO_CL=F_Close")
FX = ("MACRO_NZDUSD=X_AdjClose", "MACRO_NZDUSD=X_Close")
MARKET = ("MACRO_^NZSE_AdjClose", "MACRO_^NZSE_Close", "MACRO_^FTSE_Close")
AQUACULTURE = ("MACRO_NZ_aquaculture", "MACRO_NZ_Aquaculture_Production", "MACRO_Aquaculture_NZ")
FEAR_TERMS = ("Recession", "Unemployment", "Inflation", "Bank_run", "Financial_crisis", "Stock_market_crash", "Bankruptcy")
FEAR_PATTERNS = ("Recession", "Financial_crisis", "Stock_market_crash", "Credit_crunch", "Economic_bubble", "Bank_run",
                 "Inflation", "Unemployment", "Debt_crisis")
NET_INCOME, SHARES, REVENUE = "annualNetIncome", "annualBasicAverageShares", "annualTotalRevenue"
SGA = "annualSellingGeneralAndAdministration"
DEPRECIATION = "annualDepreciationAmortizationDepletionIncomeStatement"
FEES = "trailingFeesandCommissionExpense"
INTEREST_EXPENSE, EBITDA = "annualInterestExpense", "annualEBITDA"
# Features ranked per timestamp.
RANKED = (
    "RSI_14", "ROC_252", "Vol_252", "Dist_MA_200", "Pos_52w_Range", "NATR_14", "BB_Width_20", "Rev_5d", "Rev_10d",
    "Trend_RSq_60", "QualMom_60", "IdioVol_20", "IdioVol_60", "InfoDisc_21", "InfoDisc_63", "MAX_21d",
    "MaxMinSpread_21d", "Skew_60d", "Kurt_60d", "DownVol_60d", "RelVol_20d", "Amihud_21d", "MomAccel_21_63", "Near52wHigh",
)


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _with(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    return df.withColumns(made) if made else df


def add_candle_ratios(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("Open", "High", "Low", "Close"))  # noqa: E741
    span = h - l
    return df.withColumns({
        "DailyRange_Pct": ratio(span, o),
        "ClosePosition": F.when(span > EPS, F.try_divide(c - l, span)).otherwise(0.5),
        "UpperShadow_Pct": ratio(h - F.greatest(o, c), span), "LowerShadow_Pct": ratio(F.least(o, c) - l, span),
        "BodySize_Pct": ratio(F.abs(c - o), span), "Open_Close_Ratio": ratio(o, c), "HL_Close_Ratio": ratio(span, c),
    })


def add_dollar_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("DollarVolume", F.col("Volume") * F.col("Close"))


def add_rate_gaps(df: DataFrame) -> DataFrame:
    made = {}
    if _has(df, LONG_RATE, IMMEDIATE_RATE):
        made["ImmediateInterestVolatility"] = F.col(LONG_RATE) - F.col(IMMEDIATE_RATE)
    if _has(df, LONG_RATE, SHORT_RATE):
        made["ShortTermInterestVolatility"] = F.col(LONG_RATE) - F.col(SHORT_RATE)
    return _with(df, made)


DIVIDEND_YIELD = Group(
    "dividend_yield",
    (lambda w: {"_dividend": F.coalesce(F.col("Dividend"), F.lit(0.0))},
     lambda w: {"TrailingDivYield_252d": ratio(rsum("_dividend", 252, w, 1), F.col("Close"))}),
    ("TrailingDivYield_252d",), 252,
)


def add_dividend_yield(df: DataFrame) -> DataFrame:
    return apply_groups(df, [DIVIDEND_YIELD])


def add_fundamental_ratios(df: DataFrame) -> DataFrame:
    pairs = {
        "EPS_Basic": (NET_INCOME, SHARES), "NetProfitMargin": (NET_INCOME, REVENUE), "SGA_Ratio": (SGA, REVENUE),
        "DepreciationRatio": (DEPRECIATION, REVENUE), "CommissionEfficiency": (FEES, REVENUE),
    }
    return _with(df, {n: ratio(F.col(a), F.col(b)) for n, (a, b) in pairs.items() if _has(df, a, b)})


def add_yield_curve_spread(df: DataFrame) -> DataFrame:
    long, short = first_existing(df.columns, *LONG_RATES), first_existing(df.columns, *SHORT_RATES)
    return _with(df, {"YieldCurveSpread": clip(F.col(long) - F.col(short), -10, 10)} if long and short else {})


def add_vol_term_structure(df: DataFrame) -> DataFrame:
    """Needs the volatility columns, so it runs after the technical features."""
    a, b = first_existing(df.columns, "Vol_20", "Vol_20d"), first_existing(df.columns, "Vol_252", "Vol_252d")
    return _with(df, {"VolTermStructure": clip(safe_divide(F.col(a), F.col(b)), 0.1, 10)} if a and b else {})


def add_gold_oil_ratio(df: DataFrame) -> DataFrame:
    gold, oil = first_existing(df.columns, *GOLD), first_existing(df.columns, *OIL)
    return _with(df, {"GoldOilRatio": clip(safe_divide(F.col(gold), F.col(oil)), 5, 100)} if gold and oil else {})


def market_changes(macro: DataFrame, columns: dict[str, str], n: int = 1) -> DataFrame:
    """(timestamp, new columns): change of market-wide series over ``n`` timestamps."""
    changed = over_series(macro.select("timestamp", *[F.col(f"`{c}`").alias(f"s_{o}") for o, c in columns.items()]),
                          [lambda w: {o: pct(f"s_{o}", n, w) for o in columns}], n, keys=())
    return changed.select("timestamp", *columns)


def add_relative_returns(panel: DataFrame, macro: DataFrame, fx: str | None = None, market: str | None = None) -> DataFrame:
    """``FX_Adjusted_Return`` = stock + currency return, ``RelativeToMarket`` = stock - index return; clipped at one half."""
    fx = fx or first_existing(macro.columns, *FX)
    market = market or first_existing(macro.columns, *MARKET)
    wanted = {n: c for n, c in (("fx_ret", fx), ("market_ret", market)) if c}
    if not wanted:
        return panel
    grid = macro_on_grid(panel, macro.select("timestamp", *[F.col(f"`{c}`").alias(n) for n, c in wanted.items()]))
    own = over_series(panel, [lambda w: {"stock_ret": pct("Close", 1, w)}], 1)
    out = lookup(own, market_changes(grid, {n: n for n in wanted}), ["timestamp"])
    made = {}
    if fx:
        made["FX_Adjusted_Return"] = clip(F.col("stock_ret") + F.col("fx_ret"), -0.5, 0.5)
    if market:
        made["RelativeToMarket"] = clip(F.col("stock_ret") - F.col("market_ret"), -0.5, 0.5)
    return out.withColumns(made).drop("stock_ret", "fx_ret", "market_ret")


def add_market_share(df: DataFrame) -> DataFrame:
    totals = df.groupBy("timestamp").agg(F.coalesce(F.sum("DollarVolume"), F.lit(0.0)).alias("_total"))
    joined = lookup(df, totals, ["timestamp"])
    return joined.withColumn("DollarVolMarketShare", clip(safe_divide(F.col("DollarVolume"), F.col("_total")), 0, 1)).drop("_total")


def fear_ratio(macro: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(timestamp, FearRatio): mean of the series, each over its own mean so far (no later values)."""
    if columns is None:
        columns = [c for t in FEAR_TERMS if (c := first_existing(macro.columns, f"MACRO_{t}_Wiki_Views", f"MACRO_{t}_wiki_views"))]
    rows = macro.select("timestamp", *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    totals = {f"s{i}": ("sum", F.col(f"f{i}")) for i in range(len(columns))}
    totals |= {f"n{i}": ("sum", F.col(f"f{i}").isNotNull().cast("long")) for i in range(len(columns))}
    so_far = running(rows, totals, [], ["timestamp"])
    means = [F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")) for i in range(len(columns))]
    parts = [F.when(m > EPS, F.try_divide(F.col(f"f{i}"), m)) for i, m in enumerate(means)]
    return so_far.select("timestamp", clip(row_mean(*parts), 0, 10).alias("FearRatio"))


def add_earnings_quality(df: DataFrame) -> DataFrame:
    cash = first_existing(df.columns, "trailingOperatingCashFlow", "annualOperatingCashFlow",
                          "trailingCashFlowFromContinuingOperatingActivities")
    income = first_existing(df.columns, "trailingNetIncome", NET_INCOME)
    return _with(df, {"EarningsQuality": clip(safe_divide(F.col(cash), F.col(income)), -5, 5)} if cash and income else {})


def aquaculture_trend(macro: DataFrame, column: str | None = None, n: int = 252) -> DataFrame:
    column = column or first_existing(macro.columns, *AQUACULTURE)
    change = market_changes(macro, {"AquacultureTrend": column}, n)
    return change.withColumn("AquacultureTrend", clip(F.col("AquacultureTrend"), -1, 1))


def add_debt_proxies(df: DataFrame) -> DataFrame:
    made: dict[str, Column] = {}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if _has(df, INTEREST_EXPENSE, REVENUE):
        made["InterestBurden"] = clip(ratio(F.abs(zero(INTEREST_EXPENSE)), F.abs(zero(REVENUE))), high=0.5)
    if _has(df, INTEREST_EXPENSE, EBITDA):
        made["InterestCoverageInv"] = F.lit(1.0) / clip(ratio(zero(EBITDA), F.abs(zero(INTEREST_EXPENSE))), 0.1, 20)
    rate = first_existing(df.columns, LONG_RATE, SHORT_RATE)
    if rate:
        for name, base in (("IR_x_DebtBurden", "InterestBurden"), ("IR_x_LowCoverage", "InterestCoverageInv")):
            if base in made:
                made[name] = zero(rate) * made[base]
    return _with(df, made)


def rate_change(columns: Sequence[str]) -> Group | None:
    """``IR_Change``: change of the first available interest rate from a ticker's row to its next."""
    rate = first_existing(columns, LONG_RATE, SHORT_RATE, IMMEDIATE_RATE)
    if rate is None:
        return None
    return Group("rate_change", (lambda w: {"IR_Change": F.coalesce(F.col(rate) - w.lag(rate), F.lit(0.0))},), ("IR_Change",), 1)


def add_rate_interactions(df: DataFrame, changed: bool = False) -> DataFrame:
    """Products of the first available interest rate with momentum, volatility and trend features; ``changed`` says that ``rate_change`` was made with those."""
    rate = first_existing(df.columns, LONG_RATE, SHORT_RATE, IMMEDIATE_RATE)
    if rate is None:
        return df
    level = F.coalesce(F.col(rate), F.lit(0.0))
    pairs = {"IR_x_Mom252": "ROC_252", "IR_x_Mom10": "ROC_10", "IR_x_Vol20": "Vol_20", "IR_x_Vol252": "Vol_252",
             "IR_x_RSI": "RSI_14", "IR_x_Trend": "Dist_MA_200"}
    made = {n: level * F.col(c) for n, c in pairs.items() if c in df.columns}
    if changed:
        out = _with(df, made).select(*[c for c in df.columns if c != "IR_Change"], *made, "IR_Change")
    else:
        out = over_series(_with(df, made), list(rate_change(df.columns).stages), 1)
    return _with(out, {"IR_Change_x_Mom252": F.col("IR_Change") * F.col("ROC_252")} if "ROC_252" in df.columns else {})


def add_cross_macro(df: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made: dict[str, Column] = {}
    if _has(df, LONG_RATE, SHORT_RATE):
        made["YieldCurveSlope"] = zero(LONG_RATE) - zero(SHORT_RATE)
        if "ROC_252" in df.columns:
            made["YieldSlope_x_Mom252"] = made["YieldCurveSlope"] * F.col("ROC_252")
    if _has(df, LONG_RATE, IMMEDIATE_RATE):
        made["LT_IM_Spread"] = zero(LONG_RATE) - zero(IMMEDIATE_RATE)
    return _with(df, made)


def add_all_interactions(df: DataFrame, changed: bool = False) -> DataFrame:
    return add_rate_interactions(add_debt_proxies(df), changed).transform(add_cross_macro)


def add_mobile_ratio(df: DataFrame) -> DataFrame:
    d, m = F.col("Wiki_Views_Desktop"), F.col("Wiki_Views_Mobile")
    with_ratio = df.withColumn("Attn_Mobile_Ratio", ratio(m, d + m))
    return over_series(with_ratio, [
        lambda w: {"Attn_Mobile_Ratio_Change_14": F.col("Attn_Mobile_Ratio") - w.lag("Attn_Mobile_Ratio", 14)}
    ], 14)


def fear_attention(macro: DataFrame) -> DataFrame:
    """(timestamp, Attn_Fear_*): level, momentum and spike of all fear-related page views."""
    columns = [c for c in macro.columns if "Wiki_Views" in c and any(p.lower() in c.lower() for p in FEAR_PATTERNS)]
    parts = [F.col(f"`{c}`").cast("double") for c in columns]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    levels = macro.select("timestamp", total.alias("Attn_Fear_Total"), row_mean(*parts).alias("Attn_Fear_Mean"))
    return over_series(levels, [lambda w: {
        "Attn_Fear_Mom_7": pct("Attn_Fear_Total", 7, w), "Attn_Fear_Mom_14": pct("Attn_Fear_Total", 14, w),
        "Attn_Fear_Spike": ratio(F.col("Attn_Fear_Total"), rmean("Attn_Fear_Total", 28, w, 7)),
    }], 28, keys=())


def add_date_percentiles(df: DataFrame, columns: tuple[str, ...] = RANKED) -> DataFrame:
    """``Rank_<c>``: tie-averaged rank over the non-null count of the timestamp; one half where null."""
    present = [c for c in columns if c in df.columns]
    ranked = average_ranks(df, present, ["timestamp"])
    return ranked.select(*df.columns, *[
        F.coalesce(F.try_divide(F.col(f"_rank_{c}"), F.col(f"_count_{c}")), F.lit(0.5)).alias(f"Rank_{c}") for c in present
    ])
