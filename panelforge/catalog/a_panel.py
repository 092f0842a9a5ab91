"""Sources, reshape, as-of fills, trimming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.catalog.base import DAY, MACRO, PANEL, PREDICTIONS, Inputs, keyed, lag, query, r, roll, rounded
from panelforge.operators import panel as P
from panelforge.operators.groups import apply_groups
from panelforge.operators.technical import MA_DISTANCE
from panelforge.session import shared_folder
from panelforge.sources import longtable as S
from panelforge.sources import panelstore

# The mixed long table used by the reshape queries.
LONG = PANEL + """,
ord AS (SELECT epoch_ms(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS ts, o_orderpriority[1] AS prio, o_totalprice AS x FROM orders),
long AS (
  SELECT ts, ticker, 'Close' AS feature, c AS value FROM panel UNION ALL SELECT ts, ticker, 'High', h FROM panel
  UNION ALL SELECT ts, ticker, 'Low', l FROM panel UNION ALL SELECT ts, ticker, 'Volume', v FROM panel
  UNION ALL SELECT ts, ticker, 'LastDiv', dv FROM panel WHERE dv IS NOT NULL
  UNION ALL SELECT ts, CASE WHEN prio = '1' THEN '%5EIDX' ELSE 'AUD+X' END, 'Close', max(x) FROM ord WHERE prio IN ('1', '2') GROUP BY ts, prio
  UNION ALL SELECT ts, NULL, 'rate', max(x) FROM ord WHERE prio = '3' GROUP BY ts),
dec AS (SELECT ts, value, feature AS f0, replace(coalesce(ticker, ''), '%5E', '^') AS t0 FROM long),
cls AS (SELECT ts, value, CASE WHEN t0 <> '' AND t0 NOT LIKE '%.NZ' THEN t0 || '_' || f0 ELSE f0 END AS feature,
  CASE WHEN t0 LIKE '%.NZ' THEN t0 ELSE '' END AS ticker FROM dec),
named AS (SELECT ts, ticker, CASE WHEN ticker = '' THEN 'MACRO_' || feature ELSE feature END AS feature, value FROM cls)"""

MS = 'epoch_us(ts) // 1000'

query("src01_load_long", lambda i: rounded(S.tidy(i.events_long)),
      f"SELECT {MS} AS \"timestamp\", CAST(user_id AS VARCHAR) AS ticker, event_type AS feature, {r('value', 'value')} FROM events")


def _broken(i: Inputs):
    v = F.col("l_discount")
    x = F.when(v == 0, F.lit(float("inf"))).when(v == 0.01, F.lit(float("-inf"))).when(v == 0.02, F.lit(float("nan"))).otherwise(v)
    return i.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"))


query("src02_null_normalisation", lambda i: rounded(S.normalise_nulls(_broken(i))),
      f"SELECT l_orderkey, l_linenumber, l_partkey, {r('CASE WHEN l_discount IN (0, 0.01, 0.02) THEN NULL ELSE l_discount END', 'x')} FROM lineitem")
query("src03_year_2000_cut", lambda i: rounded(S.since_2000(i.panel).select("timestamp", "ticker", "Close")),
      f"WITH {PANEL} {keyed({'Close': 'c'}, 'panel WHERE ts >= 946684800000')}")
query("src04_union_observations",
      lambda i: rounded(S.union_observations([i.events_long, i.events_long.filter("feature = 'view'"),
                                              i.events_long.withColumn("value", F.lit(None).cast("double"))])),
      f"SELECT DISTINCT {MS} AS \"timestamp\", CAST(user_id AS VARCHAR) AS ticker, event_type AS feature, {r('value', 'value')} FROM events WHERE value IS NOT NULL")
query("snk01_long_text", lambda i: rounded(S.text_rows(i.long.withColumn("feature", F.concat("feature", F.lit(",a\nb")))), 3),
      f"WITH {LONG} SELECT ts AS \"timestamp\", coalesce(ticker, 'null') AS ticker, feature || '-a-b' AS feature, {r('value', 'value', 3)} FROM long")



def _stored_panel(i: Inputs):
    """Write the panel partitioned by year, read back the part since 2000."""
    path = shared_folder(i.spark, "panel")
    S.write_table(i.panel.withColumn("year", F.year(F.timestamp_millis("timestamp"))), path, ["year"])
    return rounded(S.since_2000(i.spark.read.parquet(path).filter("year >= 2000")), 4, ["timestamp", "ticker", "Close"])


def _bucketed_panel(i: Inputs):
    """Write the panel in buckets by ticker, find it again by its path, and roll over it without a shuffle."""
    path = shared_folder(i.spark, "buckets")
    name = f"panel_{uuid.uuid4().hex}"
    panelstore.write_panel(i.panel.select("timestamp", "ticker", "Close"), path, name)
    store = panelstore.read_panel(i.spark, path)
    with store.known():
        return rounded(apply_groups(store.table(i.spark, name), [MA_DISTANCE]), 6, ["timestamp", "ticker", *MA_DISTANCE.outputs])


def _stored_csv(i: Inputs):
    path = shared_folder(i.spark, "long")
    S.write_csv(i.events_long, path)
    return rounded(S.read_csv(i.spark, path).drop(S.INGEST_ORDER))


def _repeated_file(i: Inputs):
    """Closing prices written twice to one file, the second time as they were corrected: the last of each counts, whichever is larger."""
    path = shared_folder(i.spark, "repeated")
    close = i.panel.select("timestamp", "ticker", F.lit("Close").alias("feature"), F.col("Close").alias("value"))
    later = close.withColumn("value", F.when(F.col("value") > 1500, F.col("value") - 100).otherwise(F.col("value") + 1))
    both = close.withColumn("turn", F.lit(0)).union(later.withColumn("turn", F.lit(1)))
    both.repartitionByRange("ticker").sortWithinPartitions("ticker", "turn", "timestamp").drop("turn").write.option("header", True).csv(path)
    return rounded(P.exact_pivot(S.read_csv(i.spark, path), ("Close",)), 4)


def _stored_results(i: Inputs):
    path = shared_folder(i.spark, "results")
    S.write_results(i.predictions, path, "json")
    return rounded(i.spark.read.schema(i.predictions.schema).json(path))


query("src01_last_observation", _repeated_file, f"WITH {PANEL} {keyed({'Close': 'CASE WHEN c > 1500 THEN c - 100 ELSE c + 1 END'}, 'panel', 4)}")
query("snk01_csv_round_trip", _stored_csv,
      f"SELECT {MS} AS \"timestamp\", CAST(user_id AS VARCHAR) AS ticker, event_type AS feature, {r('value', 'value')} FROM events")
query("snk02_stored_panel", _stored_panel, f"WITH {PANEL} {keyed({'Close': 'c'}, 'panel WHERE ts >= 946684800000', 4)}")
MEANS = {f"Dist_MA_{n}": f"CASE WHEN count(*) OVER (PARTITION BY ticker) >= 50 THEN (c - {roll('avg', 'c', n)}) / ({roll('avg', 'c', n)} + 1e-6) END" for n in (20, 50, 200)}
query("snk02_bucketed_panel", _bucketed_panel, f"WITH {PANEL} {keyed(MEANS, 'panel')}")
query("snk03_stored_results", _stored_results,
      f"WITH {PREDICTIONS} {keyed({'predicted_score': 's', 'actual_return': 'r'}, 'pred')}")
query("pnl01_classify_tickers", lambda i: rounded(P.classify_tickers(i.long), 4).select("timestamp", "ticker", "feature", "value"),
      f"WITH {LONG} SELECT ts AS \"timestamp\", ticker, feature, {r('value', 'value', 4)} FROM cls")
query("pnl02_macro_prefix", lambda i: rounded(P.add_macro_prefix(P.classify_tickers(i.long)), 4).select("timestamp", "ticker", "feature", "value"),
      f"WITH {LONG} SELECT ts AS \"timestamp\", ticker, feature, {r('value', 'value', 4)} FROM named")
query("pnl03_anchors", lambda i: P.anchors(P.classify_tickers(i.long)),
      f"WITH {LONG} SELECT DISTINCT ts AS \"timestamp\", ticker FROM named WHERE feature = 'Close' AND ticker <> ''")
query("pnl04_exact_pivot", lambda i: rounded(P.exact_pivot(P.classify_tickers(i.long), ("Close", "High", "Low", "Volume")), 4),
      f"WITH {PANEL} {keyed({'Close': 'c', 'High': 'h', 'Low': 'l', 'Volume': 'v'}, 'panel', 4)}")
ASOF = """,
lastdiv AS (SELECT ts, ticker, value FROM named WHERE feature = 'LastDiv'),
filled AS (SELECT p.ts, p.ticker, p.c, d.value AS div FROM panel p ASOF LEFT JOIN lastdiv d ON p.ticker = d.ticker AND p.ts >= d.ts)"""
query("pnl05_ticker_asof", lambda i: rounded(P.ticker_asof(P.classify_tickers(i.long), ["LastDiv"])),
      f"WITH {LONG}{ASOF} {keyed({'Close': 'c', 'LastDiv': 'div'}, 'filled')}")
MACRO_ASOF = ASOF + """,
ma AS (SELECT ts, value FROM named WHERE feature = 'MACRO_^IDX_Close'), mb AS (SELECT ts, value FROM named WHERE feature = 'MACRO_AUD+X_Close'),
mc AS (SELECT ts, value FROM named WHERE feature = 'MACRO_rate'),
full_panel AS (SELECT f.*, ma.value AS idx, mb.value AS aud, mc.value AS rate FROM filled f ASOF LEFT JOIN ma ON f.ts >= ma.ts
  ASOF LEFT JOIN mb ON f.ts >= mb.ts ASOF LEFT JOIN mc ON f.ts >= mc.ts)"""
query("pnl06_macro_asof", lambda i: rounded(P.long_to_wide(i.long, ["LastDiv"], ["MACRO_^IDX_Close", "MACRO_AUD+X_Close", "MACRO_rate"], ("Close",)), 4),
      f"WITH {LONG}{MACRO_ASOF} " + keyed({"Close": "c", "LastDiv": "div", "MACRO_^IDX_Close": "idx", "MACRO_AUD+X_Close": "aud", "MACRO_rate": "rate"}, "full_panel", 4))


def _corrected(i: Inputs):
    """The long table as delivered second, after a wrong first delivery and before corrected closing prices."""
    # Both deliveries come from one pass over the long table.
    twice = F.inline(F.array(*[F.struct(v.alias("value"), F.lit(k).alias(P.INGEST_ORDER)) for k, v in enumerate((F.col("value") * 2, F.col("value")))]))
    third = i.panel.filter("Volume > 30").select("timestamp", "ticker", F.lit("Close").alias("feature"), (F.col("Close") * 0.5).alias("value"), F.lit(2).alias(P.INGEST_ORDER))
    return i.long.select("timestamp", "ticker", "feature", twice).unionByName(third)


query("pnl04_last_observation", lambda i: rounded(P.exact_pivot(P.classify_tickers(_corrected(i)), ("Close", "High", "Low", "Volume")), 4),
      f"WITH {PANEL} {keyed({'Close': 'CASE WHEN v > 30 THEN c * 0.5 ELSE c END', 'High': 'h', 'Low': 'l', 'Volume': 'v'}, 'panel', 4)}")
query("pnl06_found_columns", lambda i: rounded(P.long_to_wide(i.long, exact=("Close", "High", "Low", "Volume")), 4),
      f"WITH {LONG}{MACRO_ASOF}, every AS (SELECT f.*, p.h, p.l, p.v FROM full_panel f JOIN panel p USING (ts, ticker)) " + keyed({
          "Close": "c", "High": "h", "Low": "l", "Volume": "v", "LastDiv": "div", "MACRO_^IDX_Close": "idx", "MACRO_AUD+X_Close": "aud", "MACRO_rate": "rate"}, "every", 4))
query("pnl07_drop_sparse", lambda i: rounded(P.drop_sparse(i.panel.select("timestamp", "ticker", "Close", "Dividend"), 0.5), 4),
      f"WITH {PANEL} {keyed({'Close': 'c'}, 'panel', 4)}")
query("pnl07_null_fractions", lambda i: rounded(P.null_fractions(i.panel.select("timestamp", "Close", "Dividend"))),
      f"""WITH {PANEL} SELECT 'timestamp' AS "column", 0.0 AS null_fraction UNION ALL SELECT 'Close', 0.0
      UNION ALL SELECT 'Dividend', {r('avg(CASE WHEN dv IS NULL THEN 1 ELSE 0 END)', 'null_fraction')} FROM panel""")
RET = f"ret AS (SELECT *, {'(c - ' + lag('c') + ') / nullif(' + lag('c') + ', 0)'} AS ret FROM panel)"
ANOM = RET + """, flg AS (SELECT *, coalesce(abs(ret) > 2.0, false) AS bad FROM ret),
anom AS (SELECT *, min(CASE WHEN bad THEN ts END) OVER (PARTITION BY ticker) AS first_ts FROM flg)"""
query("pnl08_detect_anomalies", lambda i: rounded(P.detect_anomalies(i.panel).select("timestamp", "ticker", "daily_return", "is_anomaly", "first_anomaly_ts")),
      f"WITH {PANEL}, {ANOM} SELECT ts AS \"timestamp\", ticker, {r('ret', 'daily_return')}, bad AS is_anomaly, first_ts AS first_anomaly_ts FROM anom")
query("pnl09_trim_kept", lambda i: P.trim_anomalies(i.panel)[0].select("timestamp", "ticker"),
      f"WITH {PANEL}, {ANOM} SELECT ts AS \"timestamp\", ticker FROM anom WHERE first_ts IS NULL OR ts >= first_ts")
query("pnl09_trim_removed", lambda i: P.trim_anomalies(i.panel)[1].select("timestamp", "ticker"),
      f"WITH {PANEL}, {ANOM} SELECT ts AS \"timestamp\", ticker FROM anom WHERE ts < first_ts")
query("pnl10_anomaly_summary", lambda i: rounded(P.anomaly_summary(i.panel)),
      f"""WITH {PANEL}, {ANOM} SELECT count(*) AS total_rows, count(*) FILTER (bad) AS anomaly_rows, count(*) FILTER (ts < first_ts) AS rows_to_trim,
      {r('count(*) FILTER (ts < first_ts) * 100.0 / count(*)', 'trim_percent')}, count(DISTINCT ticker) FILTER (bad) AS affected_tickers,
      {r('max(ret) FILTER (bad)', 'max_return')}, {r('min(ret) FILTER (bad)', 'min_return')} FROM anom""")


def _splits(i: Inputs):
    return i.table("lineitem").filter("l_tax = 0.08").groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string"), F.lit(".NZ")).alias("ticker"),
        F.unix_millis(F.date_trunc("day", "l_shipdate").cast("timestamp")).alias("timestamp"),
    ).agg(F.max("l_linenumber").cast("double").alias("value"))


query("pnl11_extreme_moves", lambda i: rounded(P.extreme_moves(i.panel), 4),
      f"WITH {PANEL}, {RET} {keyed({'price': 'c', 'daily_return': 'ret'}, 'ret WHERE abs(ret) > 2.0', 4)}")
query("pnl11_suspicious_splits", lambda i: rounded(P.suspicious_splits(i.panel, _splits(i))),
      f"""WITH {PANEL}, {RET}, sp AS (SELECT 'T' || l_suppkey || '.NZ' AS ticker, epoch_ms(CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)) AS ts,
      CAST(max(l_linenumber) AS DOUBLE) AS value FROM lineitem WHERE l_tax = 0.08 GROUP BY 1, 2),
      near AS (SELECT s.ticker, s.ts, s.value, arg_min(m.ret, m.ts) AS x FROM sp s JOIN ret m ON m.ticker = s.ticker AND abs(m.ret) > 2.0
        AND abs(m.ts - s.ts) < {5 * DAY} WHERE s.value <> 1.0 GROUP BY 1, 2, 3)
      SELECT ticker, ts AS split_ts, value AS split_ratio, {r('x', 'extreme_return')} FROM near""")
REV = f"""rev AS (SELECT *, {lag('c')} AS p0, lead(c) OVER (PARTITION BY ticker ORDER BY ts) AS p2, lead(ts) OVER (PARTITION BY ticker ORDER BY ts) AS nts FROM panel),
hits AS (SELECT * FROM rev WHERE abs((c - p0) / p0) > 0.4 AND (c - p0) / p0 * ((p2 - c) / c) < -(0.4 * 0.4)),
excluded AS (SELECT ts, ticker FROM hits UNION SELECT nts, ticker FROM hits WHERE nts IS NOT NULL)"""
query("pnl12_split_reversal_days", lambda i: P.split_reversal_days(i.panel),
      f"WITH {PANEL}, {REV} SELECT ts AS \"timestamp\", ticker FROM excluded")
query("pnl13_preprocess", lambda i: rounded(P.preprocess(i.panel.select("timestamp", "ticker", "Close", "Dividend")), 4),
      f"""WITH {PANEL} SELECT ts AS "timestamp", ticker, {r('c', 'Close', 4)}, 1 AS "MissingFlag_Close", CASE WHEN dv IS NULL THEN 0 ELSE 1 END AS "MissingFlag_Dividend",
      {r('coalesce(last_value(dv IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts), 0.0)', 'Dividend', 4)} FROM panel""")
query("pnl14_clip", lambda i: rounded(P.clip_extremes(P.daily_returns(i.panel).select("timestamp", "ticker", "daily_return"), 0.5)),
      f"WITH {PANEL}, {RET} {keyed({'daily_return': 'CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.5), 0.5) END'}, 'ret')}")
query("pnl15_feature_columns", lambda i: (lambda d: rounded(d.select("timestamp", "ticker", *P.feature_columns(d))))(
          P.daily_returns(i.panel).withColumn("Cluster", F.lit(1)).withColumn("MissingFlag_x", F.lit(1)).withColumn("note", F.lit("n"))),
      f"WITH {PANEL}, {RET} {keyed({'daily_return': 'ret'}, 'ret')}")
query("pnl16_min_group_size", lambda i: P.min_group_size(i.panel, 25).select("timestamp", "ticker"),
      f"WITH {PANEL}, n AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM panel) SELECT ts AS \"timestamp\", ticker FROM n WHERE n >= 25")
HOT = ["T1.NZ", "T2.NZ", "T3.NZ"]
query("pnl17_one_hot", lambda i: P.one_hot_tickers(i.panel.select("timestamp", "ticker"), HOT),
      f"WITH {PANEL} SELECT ts AS \"timestamp\", ticker, " + ", ".join(f"CAST(ticker = '{t}' AS INT) AS \"Ticker_{t}\"" for t in HOT) + " FROM panel")
query("pnl17_undo_one_hot", lambda i: P.undo_one_hot(P.one_hot_tickers(i.panel.select("timestamp", "ticker"), HOT)),
      f"WITH {PANEL} SELECT ts AS \"timestamp\", CASE WHEN ticker IN ('T1.NZ', 'T2.NZ', 'T3.NZ') THEN ticker END AS ticker FROM panel")


def _known(i: Inputs):
    """Train and test get a column for every ticker of either, so the columns tell every row's ticker."""
    cut = i.panel.select("timestamp", "ticker")
    train, test = cut.filter("timestamp < 946684800000"), cut.filter("timestamp >= 946684800000 and ticker not like '%3.NZ'")
    known = P.known_tickers(train, test)
    coded = [P.one_hot_tickers(x, known) for x in (train, test)]
    assert coded[0].columns == coded[1].columns
    return P.undo_one_hot(coded[1])


query("pnl17_known_tickers", _known, f"WITH {PANEL} SELECT ts AS \"timestamp\", ticker FROM panel WHERE ts >= 946684800000 AND ticker NOT LIKE '%3.NZ'")
query("panel_ohlcv", lambda i: rounded(i.panel, 4),
      f"WITH {PANEL} {keyed({'Open': 'o', 'High': 'h', 'Low': 'l', 'Close': 'c', 'AdjClose': 'ac', 'Volume': 'v', 'Dividend': 'dv'}, 'panel', 4)}")
query("macro_series", lambda i: rounded(i.macro, 4),
      f"WITH {MACRO} " + keyed({"MACRO_Long-term interest rates": "lr", "MACRO_Short-term interest rates": "sr",
      "MACRO_Immediate interest rates- call money- interbank rate": "im", "MACRO_GC=F_Close": "gold", "MACRO_CL=F_Close": "oil",
      "MACRO_^FTSE_Close": "ftse", "MACRO_NZDUSD=X_Close": "fx", "MACRO_OECD_Consumer": "consumer"}, "macro", 4, 'ts AS "timestamp"'))
