"""The mixed long table reads the panel once, and names without an escape are not decoded."""

import datetime

from pyspark.sql import functions as F

from panelforge.catalog import a_panel, base
from panelforge.operators import panel as P


def tables(spark, folder):
    day = lambda n: datetime.datetime(2001, 1, 1) + datetime.timedelta(days=n)
    lines = [(k, k % 3, k, 1, float(1 + k % 40), 100.0 + k, 0.05, "R" if k < 30 and k % 8 == 0 else "N", day(k % 5)) for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_returnflag string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k, 10.0 * k, f"{1 + k % 4}-X", day(k % 5)) for k in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    return base.Inputs(spark, str(folder))


def test_one_pass_over_the_panel(spark, tmp_path):
    i = tables(spark, tmp_path)
    scanned = lambda df: sum("Scan parquet" in x and "l_suppkey" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert scanned(i.long) == 1 and scanned(a_panel._corrected(i)) == 2
    rare = {(r["timestamp"], r["ticker"], r["value"]) for r in i.long.filter("feature = 'LastDiv'").collect()}
    want = {(r["timestamp"], r["ticker"], r["Dividend"]) for r in i.panel.filter("Dividend is not null").collect()}
    assert rare == want and 0 < len(rare) < i.panel.count()
    assert i.long.filter("feature = 'Close' and ticker like 'T%'").count() == i.panel.count()
    both = a_panel._corrected(i)
    assert both.filter(f"{P.INGEST_ORDER} = 0").agg(F.sum("value")).first()[0] == 2 * both.filter(f"{P.INGEST_ORDER} = 1").agg(F.sum("value")).first()[0]


def test_names_without_escape_stay(spark):
    rows = spark.createDataFrame([("a+b",), ("%5Ex+y",), ("T1.NZ",), ("",), (None,)], "ticker string")
    assert [r[0] for r in rows.select(P.decoded(F.col("ticker"))).collect()] == ["a+b", "^x+y", "T1.NZ", "", None]
