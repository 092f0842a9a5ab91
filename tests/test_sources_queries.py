"""Sources and sinks, and every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from check import TABLES, compare
from panelforge.catalog import registry
from panelforge.sources import longtable as S
from panelforge.sources import payloads as P

TINY = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "long")
    rows = [(1, "A,B", "x\ny", 1.5), (2, None, "f", 2.0), (None, "C", "g", float("nan"))]
    S.write_csv(spark.createDataFrame(rows, S.SCHEMA), path)
    got = sorted((r["timestamp"], r["ticker"], r["feature"], r["value"]) for r in S.read_csv(spark, path).collect())
    assert got == [(-1, "C", "g", None), (1, "A-B", "x-y", 1.5), (2, "", "f", 2.0)]


def test_files_of_each_payload_kind(spark, tmp_path):
    (tmp_path / "chart.json").write_text('{"chart":{"result":[{"meta":{"symbol":"A.NZ"},"timestamp":[1,2],"indicators":{"quote":[{"close":[5.0,null]}]}}]}}')
    got = P.chart_json(P.read_documents(spark, str(tmp_path / "chart.json"))).collect()
    assert [tuple(r) for r in got] == [(1000, "A.NZ", "Close", 5.0)]
    (tmp_path / "gdp.xml").write_text(
        '<m xmlns:generic="u"><generic:Obs><generic:ObsKey><generic:Value id="TIME_PERIOD" value="2001-02"/><generic:Value id="MEASURE" value="BCICP"/></generic:ObsKey>'
        '<generic:ObsValue value="99.5"/></generic:Obs></m>')
    got = P.sdmx_xml(P.read_sdmx_xml(spark, str(tmp_path / "gdp.xml")), ["MEASURE"], "OECD_").collect()
    assert [tuple(r) for r in got] == [(980985600000, None, "OECD_BCICP", 99.5)]
    (tmp_path / "food.csv").write_text("FAO Food Price Index\n2014-2016=100\nDate,a,b\n1990-01,64.4,73.2,53.5,64.1,44.6,87.9,\n\n1990-02,1\n")
    assert P.monthly_csv(P.read_lines(spark, str(tmp_path / "food.csv"))).count() == 6


def test_every_query_has_its_names():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(TINY), reason="tables not present")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, TINY).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    assert compare(got, con.execute(SQL[name]).fetchdf()) == ""
