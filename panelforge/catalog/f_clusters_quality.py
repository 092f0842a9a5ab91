"""Clusters and data-quality checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelforge.catalog.base import DAY, PANEL, Inputs, query, r, rounded
from panelforge.catalog.d_labels_metrics import P, TS, tall_sql
from panelforge.catalog.e_portfolio import COARSE, coarse
from panelforge.operators import clusters as C
from panelforge.operators import quality as Q

Y = repr(math.sqrt(252))


def chars_sql(source: str, price: str, lookback: int, out: str = "ch", min_obs: int = 100) -> str:
    """Twin of the characteristics over the last timestamps."""
    return f"""c_ts AS (SELECT min(ts) AS t FROM (SELECT DISTINCT ts FROM {source} ORDER BY ts DESC LIMIT {lookback})),
c_r AS (SELECT ts, ticker, {price} AS c, ({price} - lag({price}) OVER w) / lag({price}) OVER w AS ret, max({price}) OVER w AS peak FROM {source} WHERE ts >= (SELECT t FROM c_ts) WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
c_f AS (SELECT ticker, min((c - peak) / peak) AS max_drawdown, count(*) AS np FROM c_r GROUP BY ticker),
c_x AS (SELECT *, least(greatest(ret, -1.0), 1.0) AS x FROM c_r WHERE ret IS NOT NULL),
c_y AS (SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY ts) AS b FROM c_x),
c_s AS (SELECT ticker, stddev_pop(x) * {Y} AS volatility, avg(x) * 252 AS mean_return, skewness(x) AS skewness, kurtosis(x) AS kurtosis, CASE WHEN count(*) > 10 THEN corr(x, b) ELSE 0.0 END AS autocorr,
  avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS pos_days_pct, count(*) AS n_obs, avg(CASE WHEN abs(ret) > 1.0 THEN 1.0 ELSE 0.0 END) AS anomaly_rate FROM c_y GROUP BY ticker),
{out} AS (SELECT c_s.*, max_drawdown FROM c_s JOIN c_f USING (ticker) WHERE np >= {min_obs} AND n_obs >= {min_obs})"""


FIGS = ("volatility", "mean_return", "skewness", "kurtosis", "autocorr", "pos_days_pct", "max_drawdown", "anomaly_rate")
query("clu01_characteristics", lambda i: rounded(C.ticker_characteristics(i.panel, 1500), 6, ["ticker", *FIGS, "n_obs"]),
      f"WITH {PANEL}, {chars_sql('panel', 'c', 1500)} SELECT ticker, {', '.join(r(c, c) for c in FIGS)}, n_obs FROM ch")
FAST = f"""g_ts AS (SELECT ts, row_number() OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM coarse)),
g_r AS (SELECT ts, ticker, CASE WHEN p - lag(p) OVER w = 1 THEN (c - lag(c) OVER w) / lag(c) OVER w END AS ret FROM coarse JOIN g_ts USING (ts) WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
g_x AS (SELECT ts, ticker, least(greatest(ret, -1.0), 1.0) AS x FROM g_r WHERE ret IS NOT NULL),
g_y AS (SELECT *, lag(x) OVER w AS b, CASE WHEN count(x) OVER f >= 20 THEN stddev_samp(x) OVER f END AS s20 FROM g_x WINDOW w AS (PARTITION BY ticker ORDER BY ts), f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fc AS (SELECT ticker, count(*) AS n_obs, stddev_samp(x) * {Y} AS volatility, avg(x) * 252 AS mean_return, skewness(x) AS skewness, kurtosis(x) AS kurtosis, corr(x, b) AS autocorr,
  avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS pos_days_pct, stddev_samp(s20) * {Y} AS vol_of_vol FROM g_y GROUP BY ticker HAVING count(*) >= 60)"""
query("clu02_fast_characteristics", lambda i: rounded(C.fast_characteristics(coarse(i), 500, 60), 6),
      f"WITH {PANEL}, {COARSE}, {FAST} SELECT ticker, n_obs, {', '.join(r(c, c) for c in C.FAST_FEATURES)} FROM fc")


def kmeans_sql(source: str, features, k: int, divisor: int, starts: int = 10, rounds: int = 20, seed: int = 42) -> str:
    """Twin of the clusters: every start's centres drawn by hash, moved a fixed number of times, the cheapest start kept."""
    cost = f"list_sum(list_transform(range(1, {len(features) + 1}), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    clean = ", ".join(f"coalesce(CASE WHEN isfinite({f}) THEN {f} END, 0.0) AS {f}" for f in features)
    scales = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    x = ", ".join(f"({f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1.0)" for f in features)
    means = ", ".join(f"avg(x[{i + 1}])" for i in range(len(features)))

    def drawn(turn: int, away: str) -> str:
        chance = f"(('0x' || substr(md5('{seed}|' || start || '|{turn}|' || ticker), 1, 13))::BIGINT + 0.5) / {16**13}"
        return f"""SELECT start, {turn} AS cluster, x FROM {away}, km_k WHERE cost > 0 AND {turn} < k
          QUALIFY row_number() OVER (PARTITION BY start ORDER BY -ln({chance}) / cost, ticker) = 1"""

    def nearest(centers: str) -> str:
        return f"""SELECT p.start, p.ticker, p.x, c.cluster, {cost} AS cost FROM km_p p JOIN {centers} c USING (start)
          QUALIFY row_number() OVER (PARTITION BY p.start, p.ticker ORDER BY {cost}, c.cluster) = 1"""

    parts = [f"km_f AS (SELECT ticker, {clean} FROM {source})", f"km_m AS (SELECT {scales} FROM km_f)",
             f"km_k AS (SELECT CASE WHEN count(*) < {k} THEN greatest(2, count(*) // {divisor}) ELSE {k} END AS k FROM km_f)",
             f"km_p AS MATERIALIZED (SELECT ticker, [{x}] AS x, CAST(s AS INT) AS start FROM km_f, km_m, range({starts}) AS t(s))",
             "km_0 AS (SELECT *, 1.0 AS cost FROM km_p)", f"km_c0 AS MATERIALIZED ({drawn(0, 'km_0')})"]
    for j in range(1, k):
        parts += [f"km_{j} AS (SELECT p.start, p.ticker, p.x, min({cost}) AS cost FROM km_p p JOIN km_c{j - 1} c USING (start) GROUP BY ALL)",
                  f"km_c{j} AS MATERIALIZED (SELECT * FROM km_c{j - 1} UNION ALL {drawn(j, f'km_{j}')})"]
    last = f"km_c{k - 1}"
    for j in range(rounds):
        parts += [f"km_a{j} AS MATERIALIZED ({nearest(last)})", f"km_m{j} AS (SELECT start, cluster, [{means}] AS x FROM km_a{j} GROUP BY start, cluster)",
                  f"km_r{j} AS MATERIALIZED (SELECT o.start, o.cluster, coalesce(m.x, o.x) AS x FROM {last} o LEFT JOIN km_m{j} m USING (start, cluster))"]
        last = f"km_r{j}"
    parts += [f"km_l AS MATERIALIZED ({nearest(last)})",
              "km_b AS (SELECT start FROM (SELECT start, floor(sum(cost) * 1e6 + 0.5) AS cost FROM km_l GROUP BY start) ORDER BY cost, start LIMIT 1)",
              "km_n AS (SELECT cluster, row_number() OVER (ORDER BY min(ticker)) - 1 AS number FROM km_l JOIN km_b USING (start) GROUP BY cluster)",
              "km AS (SELECT ticker, CAST(number AS INT) AS cluster FROM km_l JOIN km_b USING (start) JOIN km_n USING (cluster))"]
    return ", ".join(parts)


query("clu03_assign_clusters", lambda i: C.assign_clusters(C.stored(C.ticker_characteristics(i.panel, 1500))),
      f"WITH {PANEL}, {chars_sql('panel', 'c', 1500)}, {kmeans_sql('ch', C.FULL_FEATURES, 6, 5)} SELECT ticker, cluster FROM km")
CUT = 946684800000 + 400 * DAY
query("clu04_rolling_clusters", lambda i: C.rolling_clusters(coarse(i), CUT, 5, 500, 60),
      f"WITH {PANEL}, {COARSE.replace('coarse AS', 'coarse_all AS', 1)}, coarse AS (SELECT * FROM coarse_all WHERE ts <= {CUT}), {FAST}, {kmeans_sql('fc', C.FAST_FEATURES, 5, 3)} SELECT ticker, cluster FROM km")


def cluster_map(i: Inputs):
    """A fixed grouping of suppliers by nation, some unknown."""
    return i.table("supplier").filter("s_suppkey % 10 != 0").select(
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string"), F.lit(".NZ")).alias("ticker"), (F.col("s_nationkey") % 4).cast("int").alias("cluster"))


MAP = "cm AS (SELECT 'T' || s_suppkey || '.NZ' AS ticker, CAST(s_nationkey % 4 AS INT) AS cluster FROM supplier WHERE s_suppkey % 10 <> 0)"
query("clu05_cluster_features", lambda i: rounded(C.add_cluster_features(i.panel.select("timestamp", "ticker", "Close"), cluster_map(i)).drop("Close")),
      f"""WITH {PANEL}, {MAP}, pc AS (SELECT ts, ticker, c, coalesce(cluster, -1) AS k FROM panel LEFT JOIN cm USING (ticker)),
      pr AS (SELECT *, count(*) OVER g AS n, (rank() OVER (PARTITION BY ts, k ORDER BY c) + (count(*) OVER (PARTITION BY ts, k, c) - 1) / 2.0) / count(*) OVER g AS rk, avg(c) OVER g AS m FROM pc WINDOW g AS (PARTITION BY ts, k))
      SELECT {TS}, ticker, k AS "Cluster", n AS "Cluster_Size", {r('rk', 'Rank_Close_InCluster')}, {r('(c - m) / m', 'Dist_Cluster_Mean_Close')}, {r('rk', 'Rank_InCluster')} FROM pr""")
LABEL = """CASE WHEN volatility < 0.25 THEN CASE WHEN mean_return > 0 THEN 'Defensive/Quality' ELSE 'Value/Turnaround' END
  WHEN volatility < 0.5 THEN CASE WHEN mean_return > 0 THEN 'Growth' ELSE 'Cyclical/Challenged' END ELSE CASE WHEN mean_return > 0 THEN 'Speculative/Momentum' ELSE 'Distressed' END END"""
SIX = ("volatility", "mean_return", "skewness", "kurtosis", "max_drawdown", "pos_days_pct")
CSUM = f"cs AS (SELECT cluster, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in SIX)} FROM ch JOIN cm USING (ticker) GROUP BY cluster)"
query("clu06_summary", lambda i: rounded(C.cluster_summary(C.ticker_characteristics(coarse(i), 500, 60), cluster_map(i))),
      f"WITH {PANEL}, {COARSE}, {chars_sql('coarse', 'c', 500, min_obs=60)}, {MAP}, {CSUM} SELECT cluster, n AS n_stocks, {', '.join(r(c, c) for c in SIX)}, {LABEL} AS label FROM cs")
query("clu06_members", lambda i: C.cluster_members(C.ticker_characteristics(coarse(i), 500, 60), cluster_map(i)),
      f"WITH {PANEL}, {COARSE}, {chars_sql('coarse', 'c', 500, min_obs=60)}, {MAP}, {CSUM} SELECT ticker, cluster, {LABEL} AS label FROM cm LEFT JOIN cs USING (cluster)")
query("clu06_describe", lambda i: rounded(C.describe_clusters(coarse(i), cluster_map(i))),
      f"""WITH {PANEL}, {COARSE}, {chars_sql('coarse', 'c', 250, min_obs=50)}, {MAP}, d AS (SELECT cluster, count(*) AS n, avg(volatility) AS v, avg(mean_return) AS m FROM ch JOIN cm USING (ticker) GROUP BY cluster)
      SELECT cluster, n AS n_stocks, {r('v', 'avg_vol')}, {r('m', 'avg_ret')}, CASE WHEN v < 0.25 THEN 'Low-vol' WHEN v < 0.45 THEN 'Mid-vol' ELSE 'High-vol' END || ' ' ||
      CASE WHEN m > 0.15 THEN 'growth' WHEN m > -0.05 THEN 'stable' ELSE 'declining' END AS interpretation FROM d""")
query("clu07_performance", lambda i: rounded(C.performance_by_cluster(i.predictions, cluster_map(i))),
      f"""{P}, {MAP}, pc AS (SELECT p.*, coalesce(cluster, -1) AS k FROM pred p LEFT JOIN cm USING (ticker)),
      pr AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY r) + (count(*) OVER (PARTITION BY k, r) - 1) / 2.0 AS b FROM pc)
      SELECT k AS cluster, count(*) AS n_predictions, count(DISTINCT ticker) AS n_unique_tickers, {r('corr(s, r)', 'pearson_ic')}, {r('corr(a, b)', 'rank_ic')},
      {r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')}, {r('avg(r)', 'avg_return')}, {r('stddev_samp(r)', 'return_std')} FROM pr GROUP BY k HAVING count(*) >= 5""")


def pairs(i: Inputs):
    """Suppliers with neighbouring numbers, grouped by nation."""
    name = lambda x: F.concat(F.lit("T"), x.cast("string"), F.lit(".NZ"))
    return i.table("supplier").select(
        F.concat(F.lit("g"), (F.col("s_nationkey") % 3).cast("string")).alias("group"), name(F.col("s_suppkey")).alias("a"), name(F.col("s_suppkey") + 1).alias("b"))


PAIRS = "pa AS (SELECT 'g' || (s_nationkey % 3) AS grp, 'T' || s_suppkey || '.NZ' AS a, 'T' || (s_suppkey + 1) || '.NZ' AS b FROM supplier)"
query("clu08_pair_correlations", lambda i: rounded(C.pair_correlations(C.grid_returns(coarse(i)), pairs(i), 40)),
      f"""WITH {PANEL}, {COARSE}, {FAST}, {PAIRS}, pcn AS (SELECT a, b, corr(x.x, y.x) AS c, count(*) AS n FROM pa JOIN g_x x ON x.ticker = a JOIN g_x y ON y.ticker = b AND y.ts = x.ts GROUP BY a, b),
      v AS (SELECT pa.a, pa.b, coalesce(CASE WHEN n >= 40 THEN c END, 0.0) AS c FROM pa LEFT JOIN pcn USING (a, b)) SELECT a, b, {r('c', 'correlation')}, {r('least(greatest(1 - c, 0.0), 2.0)', 'distance')} FROM v""")
query("clu08_nearest_tickers", lambda i: rounded(C.nearest_tickers(C.grid_returns(coarse(i)), 10, 40, 32)),
      f"""WITH {PANEL}, {COARSE}, {FAST}, tks AS (SELECT DISTINCT ticker FROM g_x),
      prs AS (SELECT x.ticker AS a, y.ticker AS b, corr(x.x, y.x) AS c, count(*) AS n FROM g_x x JOIN g_x y ON y.ts = x.ts AND y.ticker <> x.ticker GROUP BY x.ticker, y.ticker),
      v AS (SELECT t.ticker AS a, o.ticker AS b, coalesce(CASE WHEN n >= 40 AND isfinite(c) THEN c END, 0.0) AS c FROM tks t JOIN tks o ON o.ticker <> t.ticker LEFT JOIN prs ON prs.a = t.ticker AND prs.b = o.ticker),
      w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS p FROM v)
      SELECT a AS ticker, CAST(p AS INT) AS place, b AS other, {r('c', 'correlation')}, {r('least(greatest(1 - c, 0.0), 2.0)', 'distance')} FROM w WHERE p <= 10""")
query("clu09_pair_agreement", lambda i: rounded(C.pair_agreement(pairs(i), cluster_map(i))),
      f"""WITH {MAP}, {PAIRS} SELECT grp AS "group", {r('avg(CASE WHEN x.cluster = y.cluster THEN 1.0 ELSE 0.0 END)', 'share_together')}, count(*) AS n_pairs
      FROM pa JOIN cm x ON x.ticker = a JOIN cm y ON y.ticker = b GROUP BY grp""")

# --- quality --------------------------------------------------------------


def dirty(i: Inputs):
    """Supplier-day prices of both halves of the discount range, so some keys repeat and some prices are unusable."""
    line = i.table("lineitem")
    return line.groupBy(
        F.unix_millis(F.date_trunc("day", "l_shipdate").cast("timestamp")).alias("timestamp"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
        (F.col("l_discount") > 0.05).alias("half"),
    ).agg(F.max(F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") - 2000)).alias("Close")).select(
        F.when(F.col("timestamp") % (7 * DAY) == 0, -F.col("timestamp")).otherwise(F.col("timestamp")).alias("timestamp"), "ticker", "Close")


DIRTY = f"""dt AS (SELECT CASE WHEN t % {7 * DAY} = 0 THEN -t ELSE t END AS ts, ticker, c FROM (SELECT epoch_ms(CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)) AS t, 'T' || l_suppkey AS ticker, l_discount > 0.05 AS half,
  max(CASE WHEN l_tax > 0.01 THEN l_extendedprice - 2000 END) AS c FROM lineitem GROUP BY 1, 2, 3))"""
query("dq01_validate_wide", lambda i: Q.validate_wide(dirty(i)),
      f"""WITH {DIRTY} SELECT 'negative_timestamp' AS "check", count(*) FILTER (ts < 0) AS "rows" FROM dt UNION ALL SELECT 'null_timestamp', count(*) FILTER (ts IS NULL) FROM dt
      UNION ALL SELECT 'invalid_close', count(*) FILTER (c IS NULL OR c <= 0) FROM dt UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM dt GROUP BY ts, ticker HAVING count(*) > 1)""")
query("dq01_duplicate_samples", lambda i: Q.duplicate_samples(dirty(i)),
      f"WITH {DIRTY} SELECT {TS}, ticker, count(*) AS n FROM dt GROUP BY ts, ticker HAVING count(*) > 1 ORDER BY ts, ticker LIMIT 3")
query("dq02_no_lookahead", lambda i: Q.no_lookahead(i.panel.filter("timestamp < 946684800000"), i.panel.filter("timestamp >= 946684800000")),
      f"""WITH {PANEL} SELECT max(ts) FILTER (ts < 946684800000) AS train_max, min(ts) FILTER (ts >= 946684800000) AS test_min,
      max(ts) FILTER (ts < 946684800000) < min(ts) FILTER (ts >= 946684800000) AS ok FROM panel""")
query("dq03_check_features", lambda i: rounded(Q.check_features(i.panel.withColumns({"Flat": F.lit(2.0), "Void": F.lit(None).cast("double")}), ["Volume", "Dividend", "Flat", "Void", "Gone"])),
      f"""WITH {PANEL} SELECT 'Volume' AS feature, count(v) AS non_null, {r('stddev_samp(v)', 'spread')}, 'ok' AS status FROM panel UNION ALL
      SELECT 'Dividend', count(dv), {r('stddev_samp(dv)', 'spread')}, 'ok' FROM panel UNION ALL SELECT 'Flat', count(*), 0.0, 'zero_variance' FROM panel
      UNION ALL SELECT 'Void', 0, NULL, 'all_null' UNION ALL SELECT 'Gone', 0, NULL, 'missing'""")
query("dq04_quality_report", lambda i: rounded(Q.quality_report(i.panel), 3),
      f"WITH {PANEL} " + tall_sql({"n_rows": "count(*)", "n_columns": "max(9)", "n_numeric_columns": "max(8)", "columns_with_missing": "CAST(count(dv) < count(*) AS INT)",
      "high_missing_columns": "CAST(count(dv) < 0.5 * count(*) AS INT)", "infinite_values": "max(0)", "timestamp_min": "min(ts)", "timestamp_max": "max(ts)",
      "n_unique_timestamps": "count(DISTINCT ts)", "n_unique_tickers": "count(DISTINCT ticker)"}, "panel", 3))
query("dq05_null_counts", lambda i: Q.null_counts(Q.assert_frame(i.panel, ["Close"], ["Close"], ["timestamp", "ticker"], 10), ["Close", "Dividend"]),
      f"""WITH {PANEL} SELECT 'Close' AS "column", count(*) FILTER (c IS NULL) AS nulls FROM panel UNION ALL SELECT 'Dividend', count(*) FILTER (dv IS NULL) FROM panel""")
query("dq06_fingerprint_portable", lambda i: Q.fingerprint(i.table("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"], True),
      """SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_returnflag), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM lineitem""")
query("dq06_fingerprint", lambda i: Q.fingerprint(i.panel))
for _name, _set in (("dq07_config_findings", (30, 5, 5, 5)), ("dq07_bad_config", (400, 0, -1, 20))):
    query(_name, lambda i, s=_set: Q.config_findings(i.panel, *s),
          f"""WITH {PANEL}, s AS (SELECT {_set[0]} AS h, {_set[1]} AS t, {_set[2]} AS b, {_set[3]} AS m), d AS (SELECT count(*) AS n FROM panel GROUP BY ts)
          SELECT 'horizon_positive' AS "check", CASE WHEN h <= 0 THEN 'error' ELSE 'ok' END AS level, CAST(h AS BIGINT) AS value FROM s
          UNION ALL SELECT 'horizon_within_a_year', CASE WHEN h > 365 THEN 'warning' ELSE 'ok' END, h FROM s UNION ALL SELECT 'top_positive', CASE WHEN t <= 0 THEN 'error' ELSE 'ok' END, t FROM s
          UNION ALL SELECT 'bottom_not_negative', CASE WHEN b < 0 THEN 'error' ELSE 'ok' END, b FROM s
          UNION ALL SELECT 'min_stocks_fill_a_portfolio', CASE WHEN m < t + b THEN 'warning' ELSE 'ok' END, m FROM s
          UNION ALL SELECT 'dates_fill_a_portfolio', CASE WHEN count(*) FILTER (n < t + b) > 0 THEN 'warning' ELSE 'ok' END, count(*) FILTER (n < t + b) FROM s, d""")


def _sources(i: Inputs):
    a = i.panel.filter("Volume > 5").select("timestamp", "ticker", F.col("Close").alias("price"))
    b = i.panel.filter("Volume < 60").select("timestamp", "ticker", F.col("AdjClose").alias("price"))
    return rounded(Q.source_difference(a, b), 4)


query("dq08_source_difference", _sources,
      f"""WITH {PANEL}, j AS (SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.ticker, b.ticker) AS ticker, a.c AS pa, b.ac AS pb, abs(a.c - b.ac) / nullif(b.ac, 0) * 100 AS d
      FROM (SELECT * FROM panel WHERE v > 5) a FULL JOIN (SELECT * FROM panel WHERE v < 60) b ON a.ts = b.ts AND a.ticker = b.ticker)
      SELECT {TS}, ticker, {r('pa', 'price_a', 4)}, {r('pb', 'price_b', 4)}, {r('d', 'diff_percent', 4)}, CASE WHEN pa IS NULL THEN 'only_b' WHEN pb IS NULL THEN 'only_a' WHEN d < 1.0 THEN 'match' ELSE 'mismatch' END AS status FROM j""")
