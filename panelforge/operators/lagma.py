"""Lag, moving-average, momentum, spread, spike and volatility columns generated from declarations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import pct, rstd
from panelforge.operators.ordered import over_series

# Name parts that mark a column as generated.
GENERATED = ("_Lag_", "_MA_", "_Mom_", "_Spike", "_Vol_")
# Longest frame that is added up row by row, and most shorter frames that a longer one is put together from.
SHORT_FRAME = 63
MOST_PARTS = 8


@dataclass(frozen=True)
class LagConfig:
    pattern: str
    prefix: str | None = None
    lags: tuple[int, ...] = ()
    mas: tuple[int, ...] = ()
    momentum: tuple[int, ...] = ()
    diffs: tuple[tuple[int, int], ...] = ()
    scope: str = "ticker"
    spike: bool = False
    volatility: bool = False
    volatility_window: int = 14
    min_periods_ratio: float = 0.5
    enabled: bool = True


def _trend(pattern: str) -> LagConfig:
    """The declaration shared by the monthly market-wide series."""
    return LagConfig(pattern, None, (), (63, 126, 252, 1200), (63, 126, 365), ((0, 126), (0, 252)), "global", True, True, 63)


# Fixed declarations: which columns get which generated features.
TICKER_CONFIGS = (
    LagConfig(r"^DollarVolume$", "DolVol", (63, 126), (21, 63, 126, 252, 504, 1008), (63, 126), ((0, 126),), "ticker", True, True, 21),
    LagConfig(r"^Amihud_21d$|^Amihud_63d$", "Illiq", (21, 63), (21, 63, 252, 504, 1008), (63, 252), ((0, 63),), "ticker", True),
    LagConfig(r"^Vol_252$|^Vol_20$", "VolDyn", (126,), (63, 126, 252), (63, 126), ((0, 252),)),
    LagConfig(r"^TrendPersist_252d$|^Trend_RSq_", "Trend", (63,), (63, 126, 252, 504, 1004), (63,), ((0, 126),)),
    LagConfig(r"^Skew_126d$|^Kurt_126d$|^Skew_60d$|^Kurt_60d$", "Moment", (63,), (63, 252, 504, 1008), (63,), ((0, 126),)),
    LagConfig(r"^TrailingDivYield_252d$", "DivYld", (252,), (63, 126, 252, 504, 1008), (1008,), ((0, 252), (0, 1008))),
    LagConfig(r"^ATR_|^NATR_", "ATR", (63, 126), (63, 126, 252), (63, 126), ((0, 126), (0, 252)), "ticker", True),
)
MACRO_CONFIGS = (
    LagConfig(r"^MACRO_OECD_", None, (126, 252), (126, 252), (126,), ((0, 252),), "global", True),
    LagConfig(r"interest rate", None, (126, 252), (126, 252), (126,), ((0, 252),), "global", True, True, 63),
    LagConfig(r"^MACRO_BOP", None, (126, 252), (126, 252), (126,), (), "global"),
    LagConfig(r"^(MACRO_)?\^FTSE|^(MACRO_)?000001\.SS|^(MACRO_)?\^TNX", None, (63, 126), (63, 126, 252), (63,), ((0, 252),), "global", True, True, 63),
    LagConfig(r"=F_", None, (63, 126), (63, 126), (63,), ((0, 126),), "global", True),
    LagConfig(r"^MACRO_NZD.*=X_", None, (63, 126), (63, 126), (63,), (), "global", False, True, 63),
    LagConfig(r"^MACRO_NZL_", None, (126, 252), (126, 252), (126,), (), "global"),
    LagConfig(r"^MACRO_FAO_", None, (63, 126, 252), (63, 126, 252, 1200), (63, 126, 365), ((0, 126), (0, 252)), "global", True, True, 63),
    _trend("MACRO_nz_road_fatalities_monthly"),
    _trend("MACRO_New Registrations - Goods road motor vehicles"),
    *[_trend(f"MACRO_FAO_{f}PriceIndex") for f in ("Dairy", "Sugar", "Oils", "Meat", "Cereals")],
)


def matching(columns: Sequence[str], pattern: str) -> list[str]:
    found = re.compile(pattern, re.IGNORECASE)
    return [c for c in columns if found.search(c) and not any(g in c for g in GENERATED)]


def _name(config: LagConfig, source: str, several: bool, kind: str, *numbers: int) -> str:
    if config.scope == "global":
        joined = {"Lag": "L", "MA": "MA", "Mom": "Mom"}.get(kind)
        tail = f"{joined}{numbers[0]}" if joined else "_".join([kind, *map(str, numbers)])
        return f"{source}_{tail}"
    base = config.prefix or source
    if config.prefix and several:  # one prefix, several sources: keep them apart
        base = f"{config.prefix}_{source}"
    return "_".join([base, kind, *map(str, numbers)])


def generated(columns: Sequence[str], configs: Sequence[LagConfig]) -> list[str]:
    """Names the configs produce for these columns."""
    return [n for c in configs if c.enabled for s in matching(columns, c.pattern)
            for n in _plan(c, s, len(matching(columns, c.pattern)) > 1)]


def _plan(config: LagConfig, source: str, several: bool) -> dict[str, tuple]:
    """{output: recipe} of one source column."""
    name = lambda kind, *n: _name(config, source, several, kind, *n)
    plan: dict[str, tuple] = {name("Lag", n): ("lag", n) for n in config.lags}
    plan |= {name("MA", n): ("ma", n) for n in config.mas}
    plan |= {name("Mom", n): ("mom", n) for n in config.momentum}
    plan |= {name("Diff", a, b): ("diff", a, b) for a, b in config.diffs}
    if config.spike and config.mas:
        plan[name("Spike")] = ("spike", max(config.mas))
    if config.volatility and config.scope == "ticker":
        plan[name("Vol", config.volatility_window)] = ("vol", config.volatility_window)
    return plan


def frame_parts(lengths: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """{frame length: [(length of a part, rows between it and the frame's end)]}, shortest first, so that parts come before what is made of them.

    Parts cover a frame's rows once each and nothing else. The shortest frame is its own part; a part that is no key is a shorter rest.
    """
    wanted = set(lengths)
    while min(wanted) > SHORT_FRAME:
        wanted.add(min(wanted) // 2)
    made: dict[int, list[tuple[int, int]]] = {}
    for n in sorted(wanted):
        while made and n // max(made) > MOST_PARTS:
            m = max(made)
            made[2 * m] = [(m, 0), (m, m)]
        if n not in made:
            parts, passed = [], 0
            while passed < n:
                parts.append((max((m for m in made if m <= n - passed), default=n - passed), passed))
                passed += parts[-1][0]
            made[n] = parts
    return made


def add_lag_features(df: DataFrame, configs: Sequence[LagConfig], scope: str) -> DataFrame:
    """All generated columns of one scope in one ordered pass.

    ``ticker`` works per ticker history; ``global`` expects one row per timestamp.
    """
    jobs: list[tuple[str, str, LagConfig, dict[str, tuple]]] = []
    for config in configs:
        if config.enabled and config.scope == scope:
            sources = matching(df.columns, config.pattern)
            jobs += [(s, f"_src{df.columns.index(s)}", config, _plan(config, s, len(sources) > 1)) for s in sources]
    if not jobs:
        return df
    windows = [n for *_, plan in jobs for recipe in plan.values() for n in recipe[1:]]

    def sources(w) -> dict[str, Column]:
        made = {}
        for s, x, *_ in jobs:
            made[x] = F.col(f"`{s}`").cast("double")
        return made

    means = {x: [n for kind, *ns in plan.values() if kind in ("ma", "diff", "spike") for n in ns if n] for _, x, _c, plan in jobs}
    chains = {x: frame_parts(lengths) for x, lengths in means.items() if lengths}

    def framed(level: int):
        """Sums and counts over each source's next longer frame, put together from shorter ones, so nothing outside a frame touches it."""
        def part(x: str, kind: str, n: int, m: int, passed: int, w) -> Column:
            if m == n or m not in chains[x]:
                return F.coalesce(w.agg(kind, x, m, passed), F.lit(0))
            name = f"{x}_{kind}{m}"
            return F.coalesce(w.lag(name, passed), F.lit(0)) if passed else F.col(name)

        def stage(w) -> dict[str, Column]:
            made = {}
            for x, chain in chains.items():
                for n, parts in list(chain.items())[level:level + 1]:
                    for kind in ("sum", "count"):
                        made[f"{x}_{kind}{n}"] = sum((part(x, kind, n, *p, w) for p in parts[1:]), part(x, kind, n, *parts[0], w))
            return made
        return stage

    def changes(w) -> dict[str, Column]:
        return {f"{x}_pct": pct(x, 1, w) for _, x, _c, plan in jobs if any(r[0] == "vol" for r in plan.values())}

    def mean(x: str, n: int, config: LagConfig) -> Column:
        count = F.col(f"{x}_count{n}")
        return F.when(count >= max(1, int(n * config.min_periods_ratio)), F.col(f"{x}_sum{n}") / F.when(count > 0, count))

    def finish(w) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for _, x, config, plan in jobs:
            now = F.col(x)
            for out, (kind, *n) in plan.items():
                if kind == "lag":
                    made[out] = w.lag(x, n[0])
                elif kind == "ma":
                    made[out] = mean(x, n[0], config)
                elif kind == "mom":
                    made[out] = pct(x, n[0], w)
                elif kind == "diff":
                    made[out] = (now if n[0] == 0 else mean(x, n[0], config)) - mean(x, n[1], config)
                elif kind == "spike":
                    made[out] = F.try_divide(now, mean(x, n[0], config))
                else:
                    made[out] = rstd(f"{x}_pct", n[0], w, max(1, n[0] // 2))
        return made

    keys = ("ticker",) if scope == "ticker" else ()
    depth = max((len(c) for c in chains.values()), default=0)
    return over_series(df, [sources, changes, *[framed(k) for k in range(depth)], finish], max(windows) + 1, keys=keys, long_apart=False)


def add_all_ticker_lags(df: DataFrame) -> DataFrame:
    return add_lag_features(df, TICKER_CONFIGS, "ticker")


def add_all_macro_lags(macro: DataFrame) -> DataFrame:
    return add_lag_features(macro, MACRO_CONFIGS, "global")
