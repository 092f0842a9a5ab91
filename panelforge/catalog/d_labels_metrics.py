"""Labels, splits, scaling, ranking metrics, return statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    DAY, PANEL, PREDICTIONS, Inputs, keyed, labelled_cte, query, r, roll, rounded,
)
from panelforge.operators import labels as L
from panelforge.operators import metrics as M
from panelforge.operators import returns as R

P = f"WITH {PREDICTIONS}"
TS = 'ts AS "timestamp"'


# --- labels ---------------------------------------------------------------
def _forward(i: Inputs, **kw):
    return rounded(L.forward_return(i.panel.select("timestamp", "ticker", "Close", "AdjClose"), **kw), 6, ["timestamp", "ticker", "forward_return"])


query("lbl01_forward_return", lambda i: _forward(i, days=30, tolerance_days=20, price="Close"),
      f"WITH {PANEL},{labelled_cte()} {keyed({'forward_return': 'forward_return'}, 'labelled')}")
query("lbl01_log_winsorized", lambda i: _forward(i, days=10, return_type="log", winsorize=(-0.5, 0.5), drop_na=True),
      f"""WITH {PANEL}, ff AS (SELECT p.ts, p.ticker, CASE WHEN f.ts <= p.want + {10 * DAY} THEN least(greatest(ln(f.ac / p.ac), -0.5), 0.5) END AS fr
      FROM (SELECT *, ts + {10 * DAY} AS want FROM panel) p ASOF LEFT JOIN panel f ON p.ticker = f.ticker AND p.want <= f.ts)
      {keyed({'forward_return': 'fr'}, 'ff WHERE fr IS NOT NULL')}""")


def _separate(i: Inputs):
    even = i.panel.select("timestamp", "ticker", "Close")
    prices = even.filter((F.col("timestamp") / DAY).cast("long") % 2 == 0)
    return rounded(L.forward_return(even, 30, tolerance_days=20, price="Close", prices=prices), 6, ["timestamp", "ticker", "forward_return"])


query("lbl01_separate_prices", _separate,
      f"""WITH {PANEL}, ev AS (SELECT * FROM panel WHERE (ts // {DAY}) % 2 = 0), ff AS (SELECT p.ts, p.ticker,
      CASE WHEN f.ts <= p.want + {20 * DAY} THEN (f.c - p.c) / p.c END AS fr
      FROM (SELECT *, ts + {30 * DAY} AS want FROM panel) p ASOF LEFT JOIN ev f ON p.ticker = f.ticker AND p.want <= f.ts) {keyed({'forward_return': 'fr'}, 'ff')}""")
query("lbl02_labelable", lambda i: i.panel.agg(F.max("timestamp").alias("m")).select(L.max_labelable_ts(F.col("m"), 30).alias("max_ts")),
      f"WITH {PANEL} SELECT max(ts) - {30 * DAY} AS max_ts FROM panel")
query("lbl03_date_ranks", lambda i: L.date_ranks(i.predictions, "predicted_score").select("timestamp", "ticker", "rank"),
      f"{P} SELECT {TS}, ticker, CAST(rank() OVER (PARTITION BY ts ORDER BY s DESC) + (count(*) OVER (PARTITION BY ts, s) - 1) / 2.0 AS DOUBLE) AS rank FROM pred")


def edges_sql(value: str, n: int, keys: str, source: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    probs = ", ".join(repr(i / n) for i in range(n + 1))
    return f"(SELECT {lead}list_sort(list_distinct(quantile_cont({value}, [{probs}]))) AS e FROM {source} {by})"


BIN = "CASE WHEN len(e) >= 2 THEN greatest(len(list_filter(e, lambda x: x < {v})), 1) - 1 END"
GRADED = f"""eg AS {edges_sql('r', 5, 'ts', 'pred')}, gb AS (SELECT p.*, {BIN.format(v='r')} AS b, row_number() OVER (PARTITION BY p.ts ORDER BY ticker) - 1 AS pos,
  count(*) OVER (PARTITION BY p.ts) AS size FROM pred p JOIN eg USING (ts)),
  graded AS (SELECT ts, ticker, s, r, CAST(coalesce(b, CASE WHEN size > 1 THEN least(greatest(ceil(pos * 5.0 / (size - 1)) - 1, 0), 4) ELSE 2 END) AS INT) AS relevance FROM gb)"""
query("lbl04_relevance_grades", lambda i: L.relevance_grades(i.stored_predictions, "actual_return").select("timestamp", "ticker", "relevance"),
      f"{P}, {GRADED} SELECT {TS}, ticker, relevance FROM graded")
query("spl01_windows", lambda i: L.windows_frame(i.panel, 6, 0.5, 30, 1.0),
      f"""WITH {PANEL}, t AS (SELECT max(ts) - {30 * DAY} AS m FROM panel) SELECT CAST(i AS INT) AS window_id, m - i * {int(0.5 * 365.25 * DAY)} - {int(365.25 * DAY)} AS train_end_ts,
      m - i * {int(0.5 * 365.25 * DAY)} AS test_end_ts FROM t, range(6) AS x(i)""")


def _assigned(i: Inputs):
    top = i.panel.agg(F.max("timestamp")).first()[0]
    return L.assign_windows(i.panel.select("timestamp", "ticker"), L.rolling_windows(top, 4, 0.5, 30, 1.0))


query("spl02_assign_windows", _assigned,
      f"""WITH {PANEL}, t AS (SELECT max(ts) - {30 * DAY} AS m FROM panel), w AS (SELECT CAST(i AS INT) AS window_id, m - i * {int(0.5 * 365.25 * DAY)} - {int(365.25 * DAY)} AS tr,
      m - i * {int(0.5 * 365.25 * DAY)} AS te FROM t, range(4) AS x(i)) SELECT p.{TS}, ticker, window_id, CASE WHEN p.ts < tr THEN 'train' ELSE 'test' END AS role
      FROM panel p JOIN w ON p.ts < te""")
query("spl02_split_sides", lambda i: (lambda s: s[0].select("timestamp", "ticker", F.lit("train").alias("role")).unionByName(
          s[1].select("timestamp", "ticker", F.lit("test").alias("role"))))(L.split(i.panel, 946684800000, 978307200000, 10)),
      f"""WITH {PANEL} SELECT {TS}, ticker, 'train' AS role FROM panel WHERE ts < {946684800000 - 10 * DAY} UNION ALL
      SELECT ts, ticker, 'test' FROM panel WHERE ts >= 946684800000 AND ts < 978307200000""")
query("spl03_validation", lambda i: L.temporal_validation(i.panel.select("timestamp", "ticker")),
      f"""WITH {PANEL}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel))
      SELECT {TS}, ticker, p >= floor(n * (1 - 0.2)) AS is_validation FROM panel JOIN d USING (ts)""")
REBAL = """dd AS (SELECT DISTINCT ts FROM pred), rb AS (SELECT min(ts) AS ts FROM dd UNION ALL
  SELECT (SELECT min(d.ts) FROM dd d WHERE d.ts >= rb.ts + {h}) FROM rb WHERE rb.ts IS NOT NULL), rebal AS (SELECT ts FROM rb WHERE ts IS NOT NULL)"""
query("spl04_rebalance_dates", lambda i: L.rebalance_dates(i.predictions, 30),
      f"{P.replace('WITH', 'WITH RECURSIVE', 1)}, {REBAL.format(h=30 * DAY)} SELECT {TS} FROM rebal")
query("spl04_daily_dates", lambda i: L.rebalance_dates(i.predictions, 1),
      f"{P.replace('WITH', 'WITH RECURSIVE', 1)}, {REBAL.format(h=DAY)} SELECT {TS} FROM rebal")

SCALED = ("Close", "Volume", "Flag")


def _scalable(i: Inputs):
    return i.panel.select("timestamp", "ticker", "Close", "Volume", (F.col("Dividend").isNotNull()).cast("double").alias("Flag"))


SC = f"{PANEL}, sc AS (SELECT ts, ticker, c, v, CASE WHEN dv IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS f FROM panel)"
query("scl01_robust_stats", lambda i: rounded(L.robust_stats(_scalable(i), SCALED), 5),
      f"WITH {SC} " + " UNION ALL ".join(
          f"SELECT '{n}' AS feature, {r(f'quantile_cont({c}, 0.25)', 'q25', 5)}, {r(f'quantile_cont({c}, 0.5)', 'median', 5)}, {r(f'quantile_cont({c}, 0.75)', 'q75', 5)}, count(DISTINCT {c}) <= 2 AS is_binary FROM sc"
          for n, c in zip(SCALED, "cvf")))
query("scl02_scaled", lambda i: (lambda d: rounded(L.apply_scaler(d, L.fit_scaler(d, SCALED)), 5))(_scalable(i)),
      f"""WITH {SC}, q AS (SELECT quantile_cont(c, [0.25, 0.5, 0.75]) AS qc, quantile_cont(v, [0.25, 0.5, 0.75]) AS qv FROM sc)
      {keyed({'Close': '(c - qc[2]) / (qc[3] - qc[1])', 'Volume': '(v - qv[2]) / (qv[3] - qv[1])', 'Flag': 'f'}, 'sc, q', 5)}""")

# --- information coefficients --------------------------------------------
IC = """ics AS (SELECT ts, CASE WHEN count(*) >= 3 AND stddev_samp(s) > 0 AND stddev_samp(r) > 0 THEN corr(s, r) END AS ic, count(*) AS n FROM pred GROUP BY ts HAVING count(*) >= 5)"""
RIC = """rk AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY s) + (count(*) OVER (PARTITION BY ts, s) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY ts ORDER BY r) + (count(*) OVER (PARTITION BY ts, r) - 1) / 2.0 AS b FROM pred),
rics AS (SELECT ts, CASE WHEN count(*) >= 3 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN corr(a, b) END AS ic, count(*) AS n FROM rk GROUP BY ts HAVING count(*) >= 5)"""
query("mean_ic", lambda i: rounded(M.icir(M.ic_by_date(i.predictions, 5), "ic", 30), 9),
      f"{P}, {IC} SELECT {r('avg(ic)', 'mean_ic', 9)}, {r('stddev_samp(ic)', 'std_ic', 9)}, {r('avg(ic) / stddev_samp(ic)', 'raw_icir', 9)}, {r(f'avg(ic) / stddev_samp(ic) * {math.sqrt(252 / 30)!r}', 'icir', 9)} FROM ics")
query("met01_ic", lambda i: rounded(M.ic_by_date(i.predictions)), f"{P}, {IC} SELECT {TS}, {r('ic', 'ic')}, n FROM ics")
query("met02_rank_ic", lambda i: rounded(M.rank_ic_by_date(i.stored_predictions)), f"{P}, {RIC} SELECT {TS}, {r('ic', 'rank_ic')}, n FROM rics")
query("met03_icir", lambda i: rounded(M.icir(M.rank_ic_by_date(i.stored_predictions), "rank_ic", 30)),
      f"{P}, {RIC} SELECT {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'std_ic')}, {r('avg(ic) / stddev_samp(ic)', 'raw_icir')}, {r(f'avg(ic) / stddev_samp(ic) * {math.sqrt(252 / 30)!r}', 'icir')} FROM rics")

# --- quantiles ------------------------------------------------------------
BYDATE = f"""eg AS {edges_sql('s', 5, 'ts', 'pred')}, qb AS (SELECT p.*, {BIN.format(v='s')} AS b FROM pred p JOIN eg USING (ts)),
qd AS (SELECT ts, count(*) AS n, {', '.join(f'avg(r) FILTER (b = {k}) AS q{k + 1}' for k in range(5))} FROM qb GROUP BY ts)"""


def pooled(n: int) -> str:
    return f"eg AS {edges_sql('s', n, '', 'pred')}, qb AS (SELECT p.*, {BIN.format(v='s')} AS b FROM pred p, eg), qr AS (SELECT CAST(b + 1 AS INT) AS bin, avg(r) AS m, count(*) AS n FROM qb WHERE b IS NOT NULL GROUP BY b)"


query("qnt01_bins", lambda i: L.quantile_bins(i.predictions, "predicted_score", 5).select("timestamp", "ticker", "bin"),
      f"{P}, {BYDATE} SELECT {TS}, ticker, CAST(b AS INT) AS bin FROM qb")
for _n, _name in ((5, "qnt02_quintiles_pooled"), (10, "qnt02_deciles_pooled")):
    query(_name, lambda i, n=_n: rounded(M.quantile_returns(i.stored_predictions, n)), f"{P}, {pooled(_n)} SELECT bin, {r('m', 'mean_return')}, n FROM qr")
query("qnt03_quintiles_by_date", lambda i: rounded(M.quantile_returns_by_date(i.predictions, 5, 10)),
      f"{P}, {BYDATE} SELECT {TS}, {', '.join(r(f'q{k}', f'Q{k}') for k in range(1, 6))} FROM qd WHERE n >= 10")
query("qnt04_spread", lambda i: rounded(M.spread(M.quantile_returns(i.stored_predictions, 10), 10)),
      f"{P}, {pooled(10)} SELECT {r('max(m) FILTER (bin = 10) - max(m) FILTER (bin = 1)', 'spread')} FROM qr")
query("qnt05_monotonicity", lambda i: rounded(M.monotonicity(M.quantile_returns(i.stored_predictions, 10))),
      f"""{P}, {pooled(10)}, up AS (SELECT m, lead(m) OVER (ORDER BY bin) AS nx FROM qr) SELECT count(*) FILTER (nx <= m) = 0 AS is_monotonic,
      count(*) FILTER (nx <= m) AS violations, {r('1.0 - count(*) FILTER (nx <= m) / (count(*) - 1.0)', 'monotonicity_score')} FROM up""")
query("qnt06_quintiles_by_year", lambda i: rounded(M.quintiles_by_year(i.predictions)),
      f"""{P}, pl AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s, ticker) - 1 AS p, count(*) OVER (PARTITION BY ts) AS n FROM pred),
      yy AS (SELECT CAST(year(make_timestamp(ts * 1000)) AS INT) AS year, greatest((5 * p + n - 2) // (n - 1), 1) AS q, r FROM pl WHERE n >= 2),
      yq AS (SELECT year, {', '.join(f'avg(r) FILTER (q = {k}) AS q{k}' for k in range(1, 6))} FROM yy GROUP BY year)
      SELECT year, {', '.join(r(f'q{k}', f'Q{k}') for k in range(1, 6))}, {r('q5 - q4', 'Q5_minus_Q4')}, q1 <= q2 AND q2 <= q3 AND q3 <= q4 AND q4 <= q5 AS is_monotonic FROM yq""")
HITS = "hp AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s DESC, ticker) AS p FROM pred), hr AS (SELECT ts, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS h FROM hp WHERE p <= 10 GROUP BY ts HAVING count(*) = 10)"
query("met04_hit_rate", lambda i: rounded(M.hit_rate(i.stored_predictions, 10)), f"{P}, {HITS} SELECT {r('avg(h)', 'hit_rate')} FROM hr")
query("met05_coverage", lambda i: rounded(M.coverage(i.predictions, 5)),
      f"{P}, n AS (SELECT count(*) AS n FROM pred GROUP BY ts HAVING count(*) >= 5) SELECT count(*) AS num_timestamps, {r('avg(n)', 'avg_stocks')} FROM n")


# --- a return series from the orders table -------------------------------
def series(i: Inputs):
    return i.table("orders").groupBy(F.unix_millis(F.date_trunc("day", "o_orderdate").cast("timestamp")).alias("timestamp")).agg(
        ((F.max("o_totalprice") / 430000 - 1) / 10).alias("ret"))


S = "WITH ser AS (SELECT epoch_ms(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS ts, (max(o_totalprice) / 430000 - 1) / 10 AS ret FROM orders GROUP BY 1)"
DD = "cw AS (SELECT ts, ret, product(1 + ret) OVER (ORDER BY ts) AS w FROM ser), ddn AS (SELECT *, (max(w) OVER (ORDER BY ts) - w) / max(w) OVER (ORDER BY ts) AS dd FROM cw)"
query("met06_sortino", lambda i: rounded(R.sortino(series(i))),
      f"{S} SELECT {r(f'avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * {math.sqrt(252)!r}', 'sortino')} FROM ser")
query("met07_calmar", lambda i: rounded(R.calmar(series(i)), 5),
      f"{S}, {DD} SELECT {r('(product(1 + ret) ^ (252.0 / count(*)) - 1) / max(dd)', 'calmar', 5)} FROM ddn")
query("met08_tail_ratio", lambda i: rounded(R.tail_ratio(series(i))),
      f"{S} SELECT {r('abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))', 'tail_ratio')} FROM ser")
query("met09_omega", lambda i: rounded(R.omega(series(i))), f"{S} SELECT {r('sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret <= 0)', 'omega')} FROM ser")
query("met10_win_loss", lambda i: rounded(R.win_loss(series(i))),
      f"""{S}, a AS (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wr, avg(CASE WHEN ret <= 0 THEN 1.0 ELSE 0.0 END) AS lr, avg(ret) FILTER (ret > 0) AS aw,
      avg(ret) FILTER (ret <= 0) AS al, sum(ret) FILTER (ret > 0) AS sw, abs(sum(ret) FILTER (ret <= 0)) AS sl FROM ser)
      SELECT {r('wr', 'win_rate')}, {r('lr', 'loss_rate')}, {r('aw', 'avg_win')}, {r('al', 'avg_loss')}, {r('abs(aw / al)', 'win_loss_ratio')},
      {r('sw / sl', 'profit_factor')}, {r('wr * aw + lr * al', 'expectancy')} FROM a""")
STREAK = """st AS (SELECT ret > 0 AS up, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY ret > 0 ORDER BY ts) AS g FROM ser),
  sn AS (SELECT up, count(*) AS n FROM st GROUP BY up, g)"""
query("met11_streaks", lambda i: R.streaks(series(i)),
      f"{S}, {STREAK} SELECT CAST(max(n) FILTER (up) AS DOUBLE) AS max_consecutive_wins, CAST(max(n) FILTER (NOT up) AS DOUBLE) AS max_consecutive_losses FROM sn")
query("met12_ic_autocorrelation", lambda i: rounded(M.autocorrelation(M.ic_by_date(i.predictions))),
      f"{P}, {IC}, lg AS (SELECT ic, {', '.join(f'lag(ic, {k}) OVER (ORDER BY ts) AS l{k}' for k in range(1, 11))} FROM ics WHERE ic IS NOT NULL) "
      + " UNION ALL ".join(f"SELECT {k} AS lag, {r(f'corr(ic, l{k})', 'autocorr')} FROM lg" for k in range(1, 11)))
STAB = """mm AS (SELECT avg(ic) AS m FROM ics), ms AS (SELECT avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS p, avg(ic) AS m, stddev_samp(ic) AS sd,
  avg((ic - mm.m) ^ 3) / (avg((ic - mm.m) ^ 2) ^ 1.5) AS sk, kurtosis_pop(ic) AS ku, count(ic) AS n FROM ics, mm)"""
query("met13_ic_stability", lambda i: rounded(M.stability(M.ic_by_date(i.predictions))),
      f"{P}, {IC}, {STAB} SELECT {r('p', 'ic_positive_rate')}, {r('sk', 'ic_skewness')}, {r('ku', 'ic_kurtosis')}, {r('p * m / sd', 'ic_stability_score')}, n FROM ms")


def p_sql(t: str, v: str) -> str:
    top = f"least({math.pi / 2!r}, 40.0 / sqrt({v}))"
    area = lambda lo: f"(list_sum(list_transform(range(4001), lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * greatest(cos({lo} + ({top} - {lo}) / 4000 * i), 0.0) ^ ({v} - 1))) * ({top} - {lo}) / 4000 / 3)"
    return f"{area(f'least(atan(abs({t}) / sqrt({v})), {top})')} / {area('0.0')}"


query("met14_t_test", lambda i: rounded(M.t_test(M.ic_by_date(i.predictions), "ic")),
      f"{P}, {IC}, tt AS (SELECT count(ic) AS n, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t, count(ic) - 1.0 AS v FROM ics) SELECT n, {r('t', 't_stat')}, {r(p_sql('t', 'v'), 'p_value')} FROM tt")


def tall_sql(columns: dict[str, str], source: str, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {r(f'CAST({e} AS DOUBLE)', 'value', digits)} FROM {source}" for n, e in columns.items())


Z = math.sqrt(252 / 30)
query("met15_ranking_record", lambda i: rounded(M.ranking_metrics(i.predictions)),
      f"{P}, {IC}, {RIC}, {pooled(5)}, {HITS}, cv AS (SELECT count(*) AS k, avg(n) AS a FROM ics) "
      + tall_sql({"mean_ic": "avg(ic)", "std_ic": "stddev_samp(ic)", "raw_icir": "avg(ic) / stddev_samp(ic)", "icir": f"avg(ic) / stddev_samp(ic) * {Z!r}"}, "ics") + " UNION ALL "
      + tall_sql({"rank_mean_ic": "avg(ic)", "rank_std_ic": "stddev_samp(ic)", "rank_raw_icir": "avg(ic) / stddev_samp(ic)", "rank_icir": f"avg(ic) / stddev_samp(ic) * {Z!r}"}, "rics") + " UNION ALL "
      + tall_sql({"hit_rate": "avg(h)"}, "hr") + " UNION ALL " + tall_sql({"quintile_spread": "max(m) FILTER (bin = 5) - max(m) FILTER (bin = 1)"}, "qr") + " UNION ALL "
      + tall_sql({"num_timestamps": "k", "avg_stocks": "a"}, "cv") + f" UNION ALL SELECT 'quintile_' || bin, {r('m', 'value')} FROM qr")
query("met15_comprehensive_record", lambda i: rounded(R.comprehensive(series(i), M.ic_by_date(i.predictions)), 5),
      f"{P}, {IC}, {STAB}, {S[5:]}, {DD}, {STREAK}, tt AS (SELECT avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t, count(ic) - 1.0 AS v FROM ics), tr AS (SELECT avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t, count(ret) - 1.0 AS v FROM ser), "
      + """a AS (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wr, avg(CASE WHEN ret <= 0 THEN 1.0 ELSE 0.0 END) AS lr, avg(ret) FILTER (ret > 0) AS aw,
      avg(ret) FILTER (ret <= 0) AS al, sum(ret) FILTER (ret > 0) AS sw, abs(sum(ret) FILTER (ret <= 0)) AS sl FROM ser) """
      + tall_sql({"sortino": f"avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * {math.sqrt(8)!r}", "tail_ratio": "abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))",
                  "omega": "sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret <= 0)"}, "ser", 5) + " UNION ALL "
      + tall_sql({"calmar": "(product(1 + ret) ^ (8.0 / count(*)) - 1) / max(dd)"}, "ddn", 5) + " UNION ALL "
      + tall_sql({"win_rate": "wr", "loss_rate": "lr", "avg_win": "aw", "avg_loss": "al", "win_loss_ratio": "abs(aw / al)", "profit_factor": "sw / sl", "expectancy": "wr * aw + lr * al"}, "a", 5) + " UNION ALL "
      + tall_sql({"max_consecutive_wins": "max(n) FILTER (up)", "max_consecutive_losses": "max(n) FILTER (NOT up)"}, "sn", 5) + " UNION ALL "
      + tall_sql({"ic_positive_rate": "p", "ic_skewness": "sk", "ic_kurtosis": "ku", "ic_stability_score": "p * m / sd"}, "ms", 5) + " UNION ALL "
      + tall_sql({"ic_ttest_p_value": p_sql("t", "v")}, "tt", 5) + " UNION ALL " + tall_sql({"returns_ttest_p_value": p_sql("t", "v")}, "tr", 5))

# --- return statistics ----------------------------------------------------
query("ret01_cumulative", lambda i: rounded(R.cumulative(series(i))), f"{S}, {DD} SELECT {TS}, {r('ret', 'ret')}, {r('w - 1', 'cumulative')} FROM cw")
query("ret02_sharpe_inferred", lambda i: rounded(R.sharpe_inferred(series(i), 0.02)),
      f"""{S}, g AS (SELECT (ts - lag(ts) OVER (ORDER BY ts)) / {DAY}.0 AS d FROM ser), m AS (SELECT quantile_cont(d, 0.5) AS d FROM g),
      k AS (SELECT CASE WHEN d < 3 THEN 252.0 WHEN d < 8 THEN 52.0 WHEN d < 25 THEN 12.0 ELSE greatest(1.0, floor(365 / d)) END AS p FROM m)
      SELECT {r('(avg(ret) - 0.02 / max(p)) / stddev_samp(ret) * sqrt(max(p))', 'sharpe')} FROM ser, k""")
query("ret02_sharpe_from_span", lambda i: rounded(R.sharpe_from_span(series(i))),
      f"{S} SELECT {r(f'avg(ret) / stddev_samp(ret) * sqrt(count(*) / ((max(ts) - min(ts)) / {DAY}.0 / 365.0))', 'sharpe')} FROM ser")
query("ret03_max_drawdown", lambda i: rounded(R.max_drawdown(series(i))), f"{S}, {DD} SELECT {r('max(dd)', 'max_drawdown')} FROM ddn")
YEARS = """yr AS (SELECT year(make_timestamp(ts * 1000)) AS y, product(1 + ret) - 1 AS a, count(*) AS d, avg(ret) AS m, stddev_samp(ret) AS s, min(ts) AS t0, max(ts) AS t1 FROM ser GROUP BY 1),
  fy AS (SELECT *, avg(a) OVER () AS mu FROM yr WHERE d >= 200)"""
ANNUAL = {"mean_annual_return": "avg(a)", "std_annual_return": "stddev_samp(a)", "min_annual_return": "min(a)", "max_annual_return": "max(a)",
          "pct_positive_years": "avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END)", "avg_positive_year": "coalesce(avg(a) FILTER (a > 0), 0.0)",
          "avg_negative_year": "coalesce(avg(a) FILTER (a <= 0), 0.0)", "skewness_annual": "avg((a - mu) ^ 3) / avg((a - mu) ^ 2) ^ 1.5",
          "kurtosis_annual": "avg((a - mu) ^ 4) / avg((a - mu) ^ 2) ^ 2 - 3", "sharpe_annual_avg": f"avg(m / s * {math.sqrt(252)!r})",
          **{n: f"quantile_cont(a, {p})" for n, p in (("pct_5_annual_return", 0.05), ("pct_25_annual_return", 0.25), ("median_annual_return", 0.5), ("pct_75_annual_return", 0.75), ("pct_95_annual_return", 0.95))},
          "years_sampled": f"(SELECT floor((max(t1) - min(t0)) / {DAY}.0) / 365.0 FROM yr)"}
query("ret04_annual_statistics", lambda i: rounded(R.annual_statistics(series(i)), 5),
      f"{S}, {YEARS} SELECT {', '.join(r(e, n, 5) for n, e in ANNUAL.items())}, count(*) AS num_years FROM fy HAVING count(*) >= 2 AND (SELECT count(*) FROM ser) >= 252")
query("ret05_monthly_matrix", lambda i: rounded(R.monthly_matrix(series(i))),
      f"""{S}, mo AS (SELECT CAST(year(make_timestamp(ts * 1000)) AS INT) AS year, month(make_timestamp(ts * 1000)) AS mth, product(1 + ret) - 1 AS x FROM ser GROUP BY 1, 2)
      SELECT year, {', '.join(r(f'max(x) FILTER (mth = {m})', f'm{m:02d}') for m in range(1, 13))} FROM mo GROUP BY year""")
O = "ORDER BY ts"
query("ret06_rolling_sharpe", lambda i: rounded(R.rolling_sharpe(series(i))),
      f"{S} SELECT {TS}, {', '.join(r('%s / %s * %r' % (roll('avg', 'ret', n, n, O), roll('stddev_samp', 'ret', n, n, O), math.sqrt(252)), f'sharpe_{n}') for n in (20, 60, 120))} FROM ser")
query("ret06_rolling_ic", lambda i: rounded(R.rolling_level(M.ic_by_date(i.predictions), "ic", (20, 60))),
      f"{P}, {IC} SELECT {TS}, " + ", ".join(r(roll(fn, "ic", n, 1, O), f"{p}_{n}") for p, fn in (("mean", "avg"), ("std", "stddev_samp")) for n in (20, 60)) + " FROM ics")
query("ret06_rolling_hit_rate", lambda i: rounded(R.rolling_level(M.hit_rate_by_date(i.predictions, 10), "hit_rate", (20,)).select("timestamp", "mean_20")),
      f"{P}, {HITS} SELECT {TS}, {r(roll('avg', 'h', 20, 1, O), 'mean_20')} FROM hr")


def _damped(i: Inputs):
    by_date = M.quantile_returns_by_date(i.predictions, 5, 10)
    return R.cumulative_spread(by_date.select("timestamp", *[(F.greatest(F.least(f"Q{k}", F.lit(1.0)), F.lit(-1.0)) / 100).alias(f"Q{k}") for k in range(1, 6)]))


query("ret06_cumulative_spread", lambda i: rounded(_damped(i), 5),
      f"""{P}, {BYDATE}, sp AS (SELECT ts, least(greatest(q5, -1.0), 1.0) / 100 - least(greatest(q1, -1.0), 1.0) / 100 AS x FROM qd WHERE n >= 10),
      sx AS (SELECT * FROM sp WHERE x IS NOT NULL) SELECT {TS}, {r('x', 'spread', 5)}, {r('product(1 + x) OVER (ORDER BY ts) - 1', 'cumulative', 5)} FROM sx""")


def hist_sql(source: str, x: str, n: int) -> str:
    return f"""hb AS (SELECT min({x}) AS lo, (max({x}) - min({x})) / {n} AS w FROM {source}),
    hh AS (SELECT CAST(least(floor(({x} - lo) / w), {n - 1}) AS INT) AS bin, lo, w FROM {source}, hb WHERE {x} IS NOT NULL)
    SELECT bin, {r('lo + bin * w', 'low')}, {r('lo + (bin + 1) * w', 'high')}, count(*) AS n FROM hh GROUP BY bin, lo, w"""


query("ret07_histogram_returns", lambda i: rounded(R.histogram(series(i), "ret", 30)), f"{S}, {hist_sql('ser', 'ret', 30)}")
query("ret07_histogram_scores", lambda i: rounded(R.histogram(i.stored_predictions, "predicted_score", 50)), f"{P}, {hist_sql('pred', 's', 50)}")
query("ret07_drawdown_series", lambda i: rounded(R.drawdowns(series(i))), f"{S}, {DD} SELECT {TS}, {r('ret', 'ret')}, {r('w - 1', 'cumulative')}, {r('dd', 'drawdown')} FROM ddn")
query("ret08_fit_line", lambda i: rounded(R.fit_line(i.predictions)),
      f"{P} SELECT {r('regr_slope(r, s)', 'slope')}, {r('regr_intercept(r, s)', 'intercept')}, {r('corr(s, r)', 'r')}, count(*) AS n FROM pred")
