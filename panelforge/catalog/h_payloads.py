"""Payload parsers over documents that Spark derives from the tables, one small document per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import Inputs, query, r, rounded
from panelforge.sources import payloads as S

KEYS = 'ts AS "timestamp", ticker, feature'
O = "WITH o AS (SELECT *, epoch_ms(o_orderdate) AS ms, o_totalprice AS x, 'C' || o_custkey AS sym FROM orders)"


def orders(i: Inputs):
    t = F.col("o_orderdate").cast("timestamp")
    return i.table("orders").select("*", F.unix_seconds(t).alias("s"), F.col("o_totalprice").alias("x"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sym"), t.alias("t"))


def chart(i: Inputs):
    """Two points per order, the second without a close; urgent orders carry a dividend, low ones a split."""
    o = orders(i)
    none = F.lit(None).cast("double")
    result = F.struct(
        F.struct(F.col("sym").alias("symbol")).alias("meta"), F.array(F.col("s"), F.col("s") + 86400).alias("timestamp"),
        F.struct(
            F.array(F.struct(F.array(F.col("x"), none).alias("close"), F.array(F.col("x") + 1, F.col("x") + 2).alias("open"), F.array(F.col("x")).alias("high"),
                             F.array(F.col("o_orderkey").cast("double"), F.lit(0.0)).alias("volume"))).alias("quote"),
            F.array(F.struct(F.array(F.col("x") / 2, F.col("x") / 4).alias("adjclose"))).alias("adjclose"),
        ).alias("indicators"),
        F.struct(
            F.when(F.col("o_orderpriority").startswith("1"), F.create_map(F.col("s").cast("string"), F.struct(F.col("s").alias("date"), (F.col("x") / 8).alias("amount")))).alias("dividends"),
            F.when(F.col("o_orderpriority").startswith("5"), F.create_map(F.col("s").cast("string"), F.struct(F.col("s").alias("date"), F.lit(4.0).alias("numerator"), F.lit(2.0).alias("denominator")))).alias("splits"),
        ).alias("events"),
    )
    return o.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


query("src05_chart_json", lambda i: rounded(S.chart_json(chart(i)), 4),
      f"""{O}, u AS (SELECT ms AS ts, sym AS ticker, 'Close' AS feature, x AS v FROM o UNION ALL SELECT ms, sym, 'Open', x + 1 FROM o UNION ALL SELECT ms + 86400000, sym, 'Open', x + 2 FROM o
      UNION ALL SELECT ms, sym, 'High', x FROM o UNION ALL SELECT ms, sym, 'Volume', CAST(o_orderkey AS DOUBLE) FROM o UNION ALL SELECT ms + 86400000, sym, 'Volume', 0.0 FROM o
      UNION ALL SELECT ms, sym, 'AdjClose', x / 2 FROM o UNION ALL SELECT ms + 86400000, sym, 'AdjClose', x / 4 FROM o
      UNION ALL SELECT ms, sym, 'Dividend', x / 8 FROM o WHERE o_orderpriority LIKE '1%' UNION ALL SELECT ms, sym, 'Split', 2.0 FROM o WHERE o_orderpriority LIKE '5%')
      SELECT {KEYS}, {r('v', 'value', 4)} FROM u""")


def fundamentals(i: Inputs):
    """The status names the reported figure; a null row and a row without a value come along."""
    o = orders(i)
    kind = F.when(F.col("o_orderstatus") == "F", "annualNetIncome").when(F.col("o_orderstatus") == "O", "annualEBITDA").otherwise("annualTotalRevenue")
    rows = F.concat(F.lit('[null,{"asOfDate":"'), F.date_format("t", "yyyy-MM-dd"), F.lit('","reportedValue":{"raw":'), F.col("x").cast("decimal(18,2)").cast("string"),
                    F.lit('}},{"asOfDate":"2020-01-01","reportedValue":null}]'))
    return o.select(F.concat(F.lit('{"timeseries":{"result":[{"meta":{"type":["'), kind, F.lit('"],"symbol":["'), F.col("sym"), F.lit('"]},"timestamp":[1],"'), kind,
                             F.lit('":'), rows, F.lit('},{"meta":{"symbol":["x"]}}]}}')).alias("payload"))


query("src06_fundamentals_json", lambda i: rounded(S.fundamentals_json(fundamentals(i)), 4),
      f"""{O}, u AS (SELECT epoch_ms(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS ts, sym AS ticker, CASE o_orderstatus WHEN 'F' THEN 'annualNetIncome' WHEN 'O' THEN 'annualEBITDA' ELSE 'annualTotalRevenue' END AS feature, x AS v FROM o)
      SELECT {KEYS}, {r('v', 'value', 4)} FROM u""")


def sdmx(i: Inputs, wrapped: bool):
    """Three observations per order: a plain one, one dated by its period id, one without a value."""
    o = orders(i)
    dims = F.concat(
        F.lit('{"dimensions":{"observation":[{"id":"REF","values":[{"id":"NZ","name":"NZ"}]},{"id":"MEASURE","values":[{"id":"a","name":"Rate '), F.col("o_orderstatus"),
        F.lit('"},{"id":"b","name":"Index"}]},{"id":"TIME_PERIOD","values":[{"id":"x","start":"'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"},{"id":"'),
        F.date_format("t", "yyyy-MM"), F.lit('"},{"id":"'), F.concat(F.year("t").cast("string"), F.lit("-Q"), F.quarter("t").cast("string")), F.lit('"}]}]}}'))
    sets = F.concat(F.lit('[{"observations":{"0:0:0":['), F.col("x").cast("decimal(18,2)").cast("string"), F.lit(',0],"0:1:1":['), F.col("o_orderkey").cast("string"),
                    F.lit('],"0:1:2":[0.0],"0:0:1":[null],"0:9:0":[1.0]}}]'))
    body = F.concat(F.lit('{"dataSets":'), sets, F.lit(',"structures":[' if wrapped else ',"structure":'), dims, F.lit("]}" if wrapped else "}"))
    return o.select((F.concat(F.lit('{"data":'), body, F.lit("}")) if wrapped else body).alias("payload"))


DAY0 = "epoch_ms(CAST(date_trunc('{p}', o_orderdate) AS TIMESTAMP))"
SDMX = f"""{O}, u AS (SELECT ms AS ts, CAST(NULL AS VARCHAR) AS ticker, 'Rate ' || o_orderstatus AS feature, x AS v FROM o
  UNION ALL SELECT {DAY0.format(p='month')}, NULL, 'Index', CAST(o_orderkey AS DOUBLE) FROM o UNION ALL SELECT {DAY0.format(p='quarter')}, NULL, 'Index', 0.0 FROM o)"""
query("src07_sdmx_json", lambda i: rounded(S.sdmx_json(sdmx(i, True), [1], 2), 4), f"{SDMX} SELECT {KEYS}, {r('v', 'value', 4)} FROM u")
query("src07_sdmx_json_skip_zero", lambda i: rounded(S.sdmx_json(sdmx(i, False), [0, 1], 2, "P_", "_", True), 4),
      f"{SDMX} SELECT ts AS \"timestamp\", ticker, 'P_NZ_' || feature AS feature, {r('v', 'value', 4)} FROM u WHERE v <> 0")


def sdmx_series(i: Inputs):
    o = orders(i)
    dims = F.concat(F.lit('{"dimensions":{"series":[{"id":"T","values":[{"id":"c","name":"Cars"},{"id":"t","name":"Trucks '), F.col("o_orderstatus"),
                    F.lit('"}]}],"observation":[{"id":"TIME_PERIOD","values":[{"id":"'), F.date_format("t", "yyyy-MM"), F.lit('"},{"id":"'), F.date_format("t", "yyyy"), F.lit('"}]}]}}'))
    sets = F.concat(F.lit('[{"series":{"0":{"observations":{"0":['), F.col("o_orderkey").cast("string"), F.lit('],"1":[null]}},"1":{"observations":{"1":['),
                    F.col("x").cast("decimal(18,2)").cast("string"), F.lit(']}}}}]'))
    return o.select(F.concat(F.lit('{"dataSets":'), sets, F.lit(',"structure":'), dims, F.lit("}")).alias("payload"))


query("src08_sdmx_series_json", lambda i: rounded(S.sdmx_series_json(sdmx_series(i), [0], "New "), 4),
      f"""{O}, u AS (SELECT {DAY0.format(p='month')} AS ts, CAST(NULL AS VARCHAR) AS ticker, 'New Cars' AS feature, CAST(o_orderkey AS DOUBLE) AS v FROM o
      UNION ALL SELECT {DAY0.format(p='year')}, NULL, 'New Trucks ' || o_orderstatus, x FROM o) SELECT {KEYS}, {r('v', 'value', 4)} FROM u""")


def xml(i: Inputs):
    o = orders(i)
    period = F.concat(F.year("t").cast("string"), F.lit("-Q"), F.quarter("t").cast("string"))
    return o.select(F.concat(
        F.lit('<generic:Obs xmlns:generic="urn:g"><generic:ObsKey><generic:Value id="TIME_PERIOD" value="'), period, F.lit('"/><generic:Value id="SECTOR" value="S'), F.col("o_orderstatus"),
        F.lit('"/><generic:Value id="TRANSACTION" value="B1"/></generic:ObsKey><generic:ObsValue value="'), F.col("x").cast("decimal(18,2)").cast("string"),
        F.lit('"/><generic:Attributes><generic:Value id="UNIT_MULT" value="3"/></generic:Attributes></generic:Obs>')).alias("payload"))


query("src09_sdmx_xml", lambda i: rounded(S.sdmx_xml(S.xml_observations(xml(i)), ["SECTOR", "TRANSACTION"], "NZL_", "_MillionsNZD", {"SF": "Firms"}, True), 2),
      f"""{O} SELECT {DAY0.format(p='quarter')} AS "timestamp", CAST(NULL AS VARCHAR) AS ticker, 'NZL_' || CASE WHEN o_orderstatus = 'F' THEN 'Firms' ELSE 'S' || o_orderstatus END || '_B1_MillionsNZD' AS feature, {r('x * 1000.0', 'value', 2)} FROM o""")


def lines(i: Inputs):
    """One CSV line per order; some are headers, short, badly dated or have blank and unreadable fields."""
    o = orders(i)
    x = F.col("x").cast("decimal(18,2)").cast("string")
    full = F.concat_ws(",", F.date_format("t", "yyyy-MM"), x, F.lit(" 1.5 "), F.lit(""), F.lit("n/a"), F.col("o_orderkey").cast("string"), F.lit("2"), F.lit(""))
    kind = F.col("o_orderkey") % 5
    return o.select(F.when(kind == 0, F.concat(F.lit("FAO,"), full)).when(kind == 1, F.lit("1999-01,1,2")).when(kind == 2, F.concat(F.lit("1999/"), full)).otherwise(full).alias("payload"))


query("src10_monthly_csv", lambda i: rounded(S.monthly_csv(lines(i)), 4),
      f"""{O}, k AS (SELECT {DAY0.format(p='month')} AS ts, CAST(NULL AS VARCHAR) AS ticker, * FROM o WHERE o_orderkey % 5 > 2),
      u AS (SELECT ts, ticker, 'FAO_FoodPriceIndex' AS feature, x AS v FROM k UNION ALL SELECT ts, ticker, 'FAO_MeatPriceIndex', 1.5 FROM k
      UNION ALL SELECT ts, ticker, 'FAO_OilsPriceIndex', CAST(o_orderkey AS DOUBLE) FROM k UNION ALL SELECT ts, ticker, 'FAO_SugarPriceIndex', 2.0 FROM k) SELECT {KEYS}, {r('v', 'value', 4)} FROM u""")
ACCESS = {"view": "all-access", "click": "desktop", "purchase": "mobile-web", "error": "mobile-app"}


def views(i: Inputs):
    """One item per event; the event type is the access kind, the user the page."""
    e = i.table("events")
    kind = F.coalesce(*[F.when(F.col("event_type") == t, a) for t, a in ACCESS.items()], F.lit("spider"))
    item = F.struct(F.concat(F.lit("Page"), F.col("user_id").cast("string")).alias("article"), F.date_format("ts", "yyyyMMdd00").alias("timestamp"), kind.alias("access"), F.floor("value").cast("bigint").alias("views"))
    return e.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


def pages(i: Inputs):
    users = i.table("events").select("user_id").distinct().filter("user_id % 7 != 0")
    return users.select(F.concat(F.lit("Page"), F.col("user_id").cast("string")).alias("page"),
                        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("T"), F.col("user_id").cast("string"), F.lit(".NZ"))).otherwise("").alias("ticker"))


query("src11_pageviews_json", lambda i: rounded(S.pageviews_json(views(i), pages(i)), 4),
      f"""WITH d AS (SELECT user_id AS u, epoch_ms(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS ts, sum(floor(value)) FILTER (event_type = 'view') AS a, sum(floor(value)) FILTER (event_type = 'click') AS b,
      sum(floor(value)) FILTER (event_type IN ('purchase', 'error')) AS c FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2),
      t AS (SELECT u, ts, 'Wiki_Views' AS f, a AS v FROM d UNION ALL SELECT u, ts, 'Wiki_Views_Desktop', b FROM d UNION ALL SELECT u, ts, 'Wiki_Views_Mobile', c FROM d)
      SELECT ts AS "timestamp", CASE WHEN u % 2 = 0 THEN 'T' || u || '.NZ' END AS ticker, CASE WHEN u % 2 = 0 THEN f ELSE 'Page' || u || '_' || f END AS feature, {r('v', 'value', 4)} FROM t WHERE v IS NOT NULL""")
