"""Portfolios, backtests, robustness."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelforge.catalog.base import DAY, Inputs, query, r, rounded
from panelforge.catalog.d_labels_metrics import IC, P, REBAL, S, TS, series, tall_sql
from panelforge.operators import portfolio as B
from panelforge.operators import robustness as X
from panelforge.operators.metrics import tall, top_n
from panelforge.session import stored

CFG = B.PortfolioConfig(5, 5, 10.0, 5.0)
RP = P.replace("WITH", "WITH RECURSIVE", 1)


def hold(n: int, m: int, source: str = "pred", score: str = "s", by: str = "ts") -> str:
    """CTEs pos (holdings), per (gross) for one configuration."""
    return f"""cnt AS (SELECT {by}, count(*) AS k FROM {source} GROUP BY {by} HAVING count(*) >= {n + m}),
rkd AS (SELECT p.*, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, ticker) AS hi, row_number() OVER (PARTITION BY {by} ORDER BY {score}, ticker) AS lo FROM {source} p),
pos AS (SELECT {by}, ticker, r, CASE WHEN hi <= {n} THEN 1.0 / {n} ELSE -1.0 / {m} END AS w FROM rkd JOIN cnt USING ({by}) WHERE hi <= {n} OR lo <= {m}),
per AS (SELECT {by}, avg(r) FILTER (w > 0) - avg(r) FILTER (w < 0) AS gross FROM pos GROUP BY {by})"""


def nets(bps: float, extra: str = "") -> str:
    """CTEs trn (turnover), net; ``extra`` names further grouping columns as 'trial, '."""
    on = " AND ".join(f"h.{c} = q.{c}" for c in extra.replace(" ", "").split(",") if c)
    on = f" AND {on}" if on else ""
    part = f"PARTITION BY {extra.rstrip(', ')} " if extra else ""
    return f"""nx AS (SELECT {extra}ts, lead(ts) OVER ({part}ORDER BY ts) AS nts FROM per),
mv AS (SELECT {extra}ts, ticker, w FROM pos UNION ALL SELECT {', '.join('h.' + c for c in extra.replace(' ', '').split(',') if c) + (', ' if extra else '')}q.nts, ticker, -w FROM pos h JOIN nx q ON h.ts = q.ts{on} WHERE nts IS NOT NULL),
trn AS (SELECT {extra}ts, sum(abs(w)) / 2 AS turnover FROM (SELECT {extra}ts, ticker, sum(w) AS w FROM mv GROUP BY ALL) GROUP BY ALL),
net AS (SELECT *, gross - turnover * {bps} / 10000 AS net FROM per JOIN trn USING ({extra}ts))"""


query("prt01_top_n", lambda i: top_n(i.predictions, 5).select("timestamp", "ticker"),
      f"{P} SELECT {TS}, ticker FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s DESC, ticker) AS p FROM pred) WHERE p <= 5")
query("prt01_bottom_n", lambda i: top_n(i.predictions, 5, ascending=True).select("timestamp", "ticker"),
      f"{P} SELECT {TS}, ticker FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s, ticker) AS p FROM pred) WHERE p <= 5")
query("prt02_holdings", lambda i: rounded(B.positions(i.stored_predictions, [CFG]).select("timestamp", "ticker", "weight")),
      f"{P}, {hold(5, 5)} SELECT {TS}, ticker, {r('w', 'weight')} FROM pos")
query("prt03_period_return", lambda i: rounded(B.period_returns(B.positions(i.stored_predictions, [CFG])).select("timestamp", "gross")),
      f"{P}, {hold(5, 5)} SELECT {TS}, {r('gross', 'gross')} FROM per")
query("prt03_weighted_return", lambda i: rounded(B.weighted_period_returns(
          B.positions(i.stored_predictions, [CFG]).withColumn("size", F.abs("weight") * F.lit(2.0)), "size").select("timestamp", "gross")),
      f"{P}, {hold(5, 5)} SELECT {TS}, {r('2 * sum(w * r)', 'gross')} FROM pos GROUP BY ts")
query("prt04_turnover", lambda i: rounded(B.turnover(stored(B.positions(i.stored_predictions, [CFG]))).select("timestamp", "turnover")),
      f"{P}, {hold(5, 5)}, {nets(15.0)} SELECT {TS}, {r('turnover', 'turnover')} FROM trn")
query("prt05_net_returns", lambda i: rounded(B.net_returns(stored(B.positions(i.stored_predictions, [CFG]))).select("timestamp", "gross", "turnover", "net")),
      f"{P}, {hold(5, 5)}, {nets(15.0)} SELECT {TS}, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('net', 'net')} FROM net")
DATED = REBAL.format(h=30 * DAY) + ", sub AS (SELECT p.* FROM pred p JOIN rebal USING (ts))"
COARSE = f"coarse AS (SELECT ts // {20 * DAY} * {20 * DAY} AS ts, ticker, 100 + arg_max(c, ts) / 1000 AS c FROM panel GROUP BY 1, 2)"
DAILY = f"""{COARSE}, rb2 AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM pos)),
gd AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS pts FROM (SELECT DISTINCT ts FROM coarse WHERE ts >= (SELECT min(ts) FROM rb2))),
gk AS (SELECT gd.ts, gd.pts, rb2.k, rb2.ts AS rts FROM gd ASOF JOIN rb2 ON gd.ts >= rb2.ts WHERE pts IS NOT NULL),
mvd AS (SELECT ts, ticker, c, lag(c) OVER w AS c0, lead(c) OVER w AS c2, lag(ts) OVER w AS t0 FROM coarse WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
ht AS (SELECT *, (c - c0) / c0 AS rr, coalesce(abs((c - c0) / c0) > 0.4 AND (c - c0) / c0 * ((c2 - c) / c) < -0.16000000000000003, false) AS hit FROM mvd),
ex AS (SELECT *, hit OR coalesce(lag(hit) OVER (PARTITION BY ticker ORDER BY ts), false) AS x1 FROM ht),
sk AS (SELECT *, x1 OR coalesce(lag(x1) OVER (PARTITION BY ticker ORDER BY ts), false) AS x2 FROM ex),
hd AS (SELECT gk.ts, gk.k, sum(abs(p.w)) AS total, coalesce(sum(p.w * CASE WHEN abs(q.rr) > 0.5 THEN 0.0 ELSE q.rr END), 0.0) AS x, coalesce(sum(abs(p.w)) FILTER (q.rr IS NOT NULL), 0.0) AS cov
  FROM gk JOIN pos p ON p.ts = gk.rts LEFT JOIN (SELECT * FROM sk WHERE NOT x2 AND rr IS NOT NULL) q ON q.ts = gk.ts AND q.ticker = p.ticker AND q.t0 = gk.pts GROUP BY gk.ts, gk.k),
dl AS (SELECT ts, k, CASE WHEN cov < total THEN x * total / cov ELSE x END AS x FROM hd WHERE cov >= total * 0.5),
drt AS (SELECT ts, x - CASE WHEN lag(k) OVER (ORDER BY ts) IS DISTINCT FROM k THEN 0.0015 ELSE 0.0 END AS ret FROM dl)"""


def coarse(i: Inputs):
    """Price per ticker and 20-day step: suppliers trade too rarely for a daily path."""
    step = F.expr(f"timestamp div {20 * DAY} * {20 * DAY}")
    return i.panel.groupBy(step.alias("ts"), "ticker").agg((F.lit(100) + F.max_by("Close", "timestamp") / 1000).alias("Close")).withColumnRenamed("ts", "timestamp")


def _daily(i: Inputs):
    held = stored(B.positions(B.on_dates(i.stored_predictions, 30), [CFG]).select("timestamp", "ticker", "weight"))
    return rounded(B.daily_returns(held, coarse(i), CFG.total_cost_bps))


query("prt06_daily_returns", _daily, f"{RP}, {DATED}, {hold(5, 5, 'sub')}, {DAILY} SELECT {TS}, {r('ret', 'ret')} FROM drt")
YEARS_SQL = f"greatest((max(ts) - min(ts)) / {DAY}.0 / 365.0, 0.01)"
SPAN = f"((max(ts) - min(ts)) / {DAY}.0 / 365.0)"
# Period returns of the sample data are huge, so records are compared on a damped copy.
DAMP = 0.02


def damped(i: Inputs):
    return i.stored_predictions.withColumn("actual_return", F.greatest(F.least("actual_return", F.lit(1.0)), F.lit(-1.0)) * DAMP)


DP = f"{RP}, dpred AS (SELECT ts, ticker, s, least(greatest(r, -1.0), 1.0) * {DAMP} AS r FROM pred), {REBAL.format(h=30 * DAY)}, sub AS (SELECT p.* FROM dpred p JOIN rebal USING (ts))"
RECORD = f"""bt AS (SELECT count(*) AS n, {YEARS_SQL} AS y, product(1 + net) - 1 AS tr, product(1 + gross) - 1 AS gtr, avg(turnover) AS tov, stddev_samp(net) AS sd, sum(gross - net) AS im,
  avg(net) / stddev_samp(net) * sqrt(count(*) / {SPAN}) AS sh, avg(gross) / stddev_samp(gross) * sqrt(count(*) / {SPAN}) AS gsh FROM net),
wl AS (SELECT ts, product(1 + net) OVER (ORDER BY ts) AS w FROM net), md AS (SELECT max((m - w) / m) AS dd FROM (SELECT w, max(w) OVER (ORDER BY ts) AS m FROM wl))"""
REC = {"num_rebalances": "n", "total_return": "tr", "pre_fee_total_return": "gtr", "avg_turnover": "tov", "sharpe": "sh", "pre_fee_sharpe": "gsh", "max_drawdown": "dd",
       "annualized_return": "(1 + tr) ^ (1 / y) - 1", "pre_fee_annualized_return": "(1 + gtr) ^ (1 / y) - 1", "annualized_volatility": "sd * sqrt(n / y)",
       "cost_drag": "CASE WHEN gtr > 0 THEN -im / (1 + gtr) END", "avg_cost_per_rebalance": "im / n", "avg_holding_years": "y / n",
       "return_per_turnover": "tr / tov", "calmar": "CASE WHEN dd > 1e-4 THEN ((1 + tr) ^ (1 / y) - 1) / dd END"}
query("prt07_backtest", lambda i: rounded(tall(B.backtest(damped(i), CFG, 30))), f"{DP}, {hold(5, 5, 'sub')}, {nets(15.0)}, {RECORD} {tall_sql(REC, 'bt, md WHERE n > 0')}")
DREC = {**REC, "max_drawdown": "ddd", "annualized_volatility": "dv", "calmar": "CASE WHEN ddd > 1e-4 THEN ((1 + tr) ^ (1 / y) - 1) / ddd END", "daily_points": "dn"}
query("prt07_backtest_daily", lambda i: rounded(tall(B.backtest(damped(i), CFG, 30, coarse(i))), 5),
      f"""{DP}, {hold(5, 5, 'sub')}, {nets(15.0)}, {RECORD}, {DAILY}, dst AS (SELECT count(*) AS dn, stddev_samp(ret) * {math.sqrt(252)!r} AS dv FROM drt),
      dw AS (SELECT ts, product(1 + ret) OVER (ORDER BY ts) AS w FROM drt), dmd AS (SELECT max((m - w) / m) AS ddd FROM (SELECT w, max(w) OVER (ORDER BY ts) AS m FROM dw)) {tall_sql(DREC, 'bt, md, dst, dmd WHERE n > 0', 5)}""")
TRIALS = 100
query("prt08_random_baseline", lambda i: rounded(tall(B.random_baseline(damped(i), CFG, 30, TRIALS, 0.5))),
      f"""{DP}, sco AS (SELECT CAST(t AS INT) AS trial, ts, ticker, r, md5('42|' || t || '|' || ts || '|' || ticker) AS s FROM sub, range({TRIALS}) AS x(t)),
      {hold(5, 5, 'sco', 's', 'trial, ts')}, {nets(15.0, 'trial, ')},
      rec AS (SELECT trial, avg(net) / stddev_samp(net) * sqrt(count(*) / {SPAN}) AS sh, avg(gross) / stddev_samp(gross) * sqrt(count(*) / {SPAN}) AS gsh, product(1 + net) - 1 AS tr FROM net GROUP BY trial)
      {tall_sql({'mean_sharpe': 'avg(sh)', 'std_sharpe': 'stddev_pop(sh)', 'mean_pre_fee_sharpe': 'avg(gsh)', 'std_pre_fee_sharpe': 'stddev_pop(gsh)', 'mean_total_return': 'avg(tr)',
                 'std_total_return': 'stddev_pop(tr)', 'n_trials': 'count(*)', 'percentile_of_model': 'avg(CASE WHEN sh <= 0.5 THEN 1.0 ELSE 0.0 END) * 100'}, 'rec')}""")
query("prt_equity_curve", lambda i: rounded(B.equity_curve(B.backtest_periods(damped(i), [CFG], 30)).drop("config_id")),
      f"{DP}, {hold(5, 5, 'sub')}, {nets(15.0)} SELECT {TS}, {r('net', 'ret')}, {r('product(1 + net) OVER (ORDER BY ts) - 1', 'cumulative')} FROM net")

# --- robustness -----------------------------------------------------------
YEAR = 365 * DAY
WINDOWS = [(788918400000 + k * YEAR // 2, 788918400000 + k * YEAR // 2 + YEAR) for k in range(12)]
WIN = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(WINDOWS))
PERW = f"""wd(window_id, a, b) AS (VALUES {WIN}), pw AS (SELECT window_id, product(1 + ret) - 1 AS tr, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * {math.sqrt(252)!r}, 0.0) AS sh
  FROM ser JOIN wd ON ts >= a AND ts <= b GROUP BY window_id HAVING count(*) >= 5)"""
query("rob01_window_returns", lambda i: rounded(X.window_returns(series(i), WINDOWS)),
      f"{S}, {PERW} SELECT CAST(window_id AS INT) AS window_id, {r('tr', 'total_return')}, {r('sh', 'sharpe')} FROM pw")
WSTAT = {"pct_positive_sharpe": "avg(CASE WHEN sh > 0 THEN 1.0 ELSE 0.0 END)", "pct_positive_return": "avg(CASE WHEN tr > 0 THEN 1.0 ELSE 0.0 END)", "mean_sharpe": "avg(sh)",
         "std_sharpe": "stddev_pop(sh)", "mean_return": "avg(tr)", "std_return": "stddev_pop(tr)", "worst_return": "min(tr)", "best_return": "max(tr)"}
query("rob01_window_statistics", lambda i: rounded(X.window_statistics(X.window_returns(series(i), WINDOWS))),
      f"{S}, {PERW} SELECT {', '.join(r(e, n) for n, e in WSTAT.items())} FROM pw")
SCORE = "least({sh}, 1.5) * 0.3 + least({ic}, 1.5) * 0.25 + {pos} * 0.25 - least(greatest(({dd} - 0.15) / 0.25, 0.0), 1.0) * 0.1 - least({sd}, 1.0) * 0.1"
query("rob02_robustness_score", lambda i: rounded(X.robustness(series(i), WINDOWS, 0.8, 1.7, 0.22).select("robustness_score")),
      f"{S}, {PERW}, q AS (SELECT {WSTAT['pct_positive_sharpe']} AS p, stddev_pop(sh) AS sd FROM pw) SELECT {r(SCORE.format(sh='0.8', ic='1.7', pos='p', dd='0.22', sd='sd'), 'robustness_score')} FROM q")
SWEEP = [B.PortfolioConfig(n, n, 10.0) for n in (2, 3, 5, 8)]


def sweep_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {k} AS config_id, sh, dd, tr FROM (WITH {hold(c.top_n, c.bottom_n, 'sub')}, {nets(10.0)}, {RECORD} SELECT sh, dd, tr FROM bt, md WHERE n > 0)"
        for k, c in enumerate(SWEEP))


query("rob03_config_sweep", lambda i: rounded(X.config_sweep(damped(i), SWEEP, 30)),
      f"""{DP}, {IC.replace('FROM pred', 'FROM dpred')}, sg AS (SELECT avg(ic) / stddev_samp(ic) * {math.sqrt(252 / 30)!r} AS ic FROM ics), sw AS ({sweep_sql()}),
      sc AS (SELECT config_id, sh, dd, tr, {SCORE.format(sh='sh', ic='ic', pos='0.5', dd='dd', sd='0.5')} AS score FROM sw, sg)
      SELECT config_id, {r('sh', 'sharpe')}, {r('dd', 'max_drawdown')}, {r('tr', 'total_return')}, {r('score', 'robustness_score')}, CAST(row_number() OVER (ORDER BY score DESC, config_id) AS INT) AS rank FROM sc""")


def runs(i: Inputs):
    """Order statistics per priority, in the shape of stored metric rows."""
    o = i.table("orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        (F.max("o_totalprice") / 1000).alias("sharpe_ratio"), F.min("o_totalprice").alias("max_drawdown"),
        F.count(F.lit(1)).cast("double").alias("num_rebalances"))
    return o.select("run", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("sharpe_ratio", "max_drawdown", "num_rebalances")])))


RUNS = """WITH o AS (SELECT o_orderpriority AS run, max(o_totalprice) / 1000 AS a, min(o_totalprice) AS b, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1),
runs AS (SELECT run, 'sharpe_ratio' AS metric, a AS value FROM o UNION ALL SELECT run, 'max_drawdown', b FROM o UNION ALL SELECT run, 'num_rebalances', c FROM o)"""
query("rob04_compare_runs", lambda i: rounded(X.compare_runs(runs(i), "1-URGENT", "5-LOW")),
      f"{RUNS}, p AS (SELECT metric, coalesce(max(value) FILTER (run = '1-URGENT'), 0) AS a, coalesce(max(value) FILTER (run = '5-LOW'), 0) AS b FROM runs GROUP BY metric) SELECT metric, {r('a', 'a')}, {r('b', 'b')}, {r('b - a', 'diff')} FROM p WHERE a <> b")
query("rob04_best_run", lambda i: rounded(X.best_run(runs(i))),
      f"{RUNS} SELECT run, {r('value', 'value')} FROM runs WHERE metric = 'sharpe_ratio' ORDER BY runs.value DESC, run LIMIT 1")
