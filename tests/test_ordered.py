"""Block layouts give the same rows as pandas on a table whose hot key holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from data import frame, skewed
from pyspark.sql import functions as F

from panelforge.operators import ordered as O
from panelforge.operators.groups import ewm_mean_stages, ewm_std_stages



@pytest.fixture(params=["plain", "hot"])
def layout(request):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


def by_key(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_layout_switch(spark, hot):
    df = frame(spark, skewed())
    assert not O.fits_one_task(df, ["k"])
    with O.bounded_by(lambda: {("k",): O.Sizes(9, 90, 10)}):
        assert O.fits_one_task(df, ["k"]) and O.fits_one_task(df, ["k", "t"])


def test_number_rows(spark, layout):
    pdf = skewed()
    got = by_key(O.number_rows(frame(spark, pdf), ["k"], ["t"]), "k", "t")
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    assert (got["_pos"] == want.groupby("k").cumcount()).all()
    assert (got["_size"] == want.groupby("k")["t"].transform("size")).all()


def test_blocks_bound_the_rows_of_a_task(spark, hot):
    parts = O._tagged(frame(spark, skewed()), ["k"], ["t"])
    assert parts.groupBy("k", "_part").count().agg(F.max("count")).first()[0] <= 80


def test_over_series(spark, layout):
    pdf = skewed()
    df = frame(spark, pdf)
    got = by_key(O.over_series(df, [
        lambda w: {"_d": F.col("v") - w.lag("v")},
        lambda w: {"m": w.agg("avg", "_d", 7), "n": w.agg("count", "s", 5, 2), "up": w.lead("v", 2), "p": F.col("_pos")},
    ], 9, ["k"], ["t"], lookahead=2), "k", "t")
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"]
    assert np.allclose(got["m"], want.groupby("k")["v"].transform(lambda x: x.diff().rolling(7, min_periods=1).mean()), equal_nan=True)
    assert np.allclose(got["up"].astype(float), g.shift(-2), equal_nan=True)
    assert (got["n"] == want.groupby("k")["s"].transform(lambda x: x.shift(2).rolling(5, min_periods=0).count())).all()
    assert (got["p"] == want.groupby("k").cumcount()).all()
    assert not [c for c in got.columns if c.startswith("_")]


@pytest.mark.parametrize("backward", [False, True])
def test_fill_last(spark, layout, backward):
    pdf = skewed()
    got = by_key(O.fill_last(frame(spark, pdf), ["s"], ["k"], ["t"], backward), "k", "t")
    g = pdf.sort_values(["k", "t"]).reset_index(drop=True).groupby("k")["s"]
    assert np.allclose(got["s"].astype(float), g.bfill() if backward else g.ffill(), equal_nan=True)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running(spark, layout, keys):
    pdf = skewed()
    got = by_key(O.running(frame(spark, pdf), {
        "a": ("sum", F.col("v")), "b": ("max", F.col("v")), "c": ("min", F.col("v")), "d": ("product", 1 + F.col("v") / 100), "e": ("sum", F.col("s")),
    }, keys, ["t"]), *keys, "t")
    want = pdf.sort_values([*keys, "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"] if keys else want["v"]
    assert np.allclose(got["a"], g.cumsum()) and np.allclose(got["b"], g.cummax()) and np.allclose(got["c"], g.cummin())
    p = (1 + want["v"] / 100)
    assert np.allclose(got["d"], p.groupby(want["k"]).cumprod() if keys else p.cumprod())


def test_average_ranks(spark, layout):
    pdf = skewed()
    pdf["z"] = pdf["s"]
    got = by_key(O.average_ranks(frame(spark, pdf), ["v", "z"], ["k"]), "k", "t")
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    for c in ("v", "z"):
        assert np.allclose(got[f"_rank_{c}"].astype(float), want.groupby("k")[c].rank(), equal_nan=True)
        assert (got[f"_count_{c}"] == want.groupby("k")[c].transform("count")).all()


def test_ranks_of_many_columns(spark, layout):
    pdf = skewed()
    names = [f"c{i}" for i in range(6)]
    for i, c in enumerate(names):
        pdf[c] = pdf["s"] if i == 0 else np.round(pdf["v"] * (i + 1), 1)
    got = by_key(O.average_ranks(frame(spark, pdf), names, ["k"]), "k", "t")
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    assert got.columns[: len(pdf.columns)].tolist() == pdf.columns.tolist() and len(got) == len(pdf)
    for c in [*names, "v"]:
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True)
    for c in names:
        assert np.allclose(got[f"_rank_{c}"].astype(float), want.groupby("k")[c].rank(), equal_nan=True)
        assert (got[f"_count_{c}"] == want.groupby("k")[c].transform("count")).all()


@pytest.mark.parametrize("keys", [["k"], []])
def test_group_quantiles(spark, layout, keys):
    pdf, probs = skewed(), [0, 0.2, 0.25, 0.5, 0.77, 1.0]
    got = O.group_quantiles(frame(spark, pdf), keys, "v", probs).toPandas()
    groups = pdf.groupby("k")["v"] if keys else [("", pdf["v"])]
    for k, x in groups:
        edges = got[got["k"] == k]["edges"].iloc[0] if keys else got["edges"].iloc[0]
        assert np.allclose(edges, np.quantile(x, probs))


def test_lookup_keeps_every_row(spark, layout):
    pdf = skewed()
    table = pd.DataFrame({"k": [f"k{i}" for i in range(6)] + ["hot"], "x": range(7)})
    got = O.lookup(frame(spark, pdf), frame(spark, table), ["k"]).toPandas()
    want = pdf.merge(table, on="k", how="left")
    assert len(got) == len(want) and got["x"].sum() == want["x"].sum()
    assert O.lookup(frame(spark, pdf), frame(spark, table), ["k"], "left_semi").count() == want["x"].notna().sum()


def test_ewm_equals_pandas(spark, layout):
    n = 900
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ticker": "A", "timestamp": np.arange(n), "x": 50 + rng.normal(size=n).cumsum()})
    pdf["r"] = pdf["x"].pct_change()
    mean, back1 = ewm_mean_stages({"e12": ("x", 12), "e26": ("x", 26)})
    std, back2 = ewm_std_stages("r", "es", 20, 10)
    got = by_key(O.over_series(frame(spark, pdf), [*mean, *std], max(back1, back2) + 1), "timestamp")
    for span in (12, 26):
        assert np.allclose(got[f"e{span}"], pdf["x"].ewm(span=span, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(got["es"].astype(float), pdf["r"].ewm(span=20, min_periods=10).std(), rtol=1e-9, equal_nan=True)


def test_null_keys_and_repeated_rows_stay(spark, layout):
    pdf = skewed()
    df = frame(spark, pdf).withColumn("k", F.when(F.col("t") % 3 == 0, F.lit(None)).otherwise(F.col("k").cast("string")))
    df = df.withColumn("big", F.col("t").cast("long") % 2 + 9007199254740992).union(df.withColumn("big", F.lit(9007199254740993)).limit(60))
    n = df.count()
    assert O.number_rows(df, ["k"], ["t"]).count() == n
    assert O.fill_last(df, ["s"], ["k"], ["t"]).count() == n
    assert O.running(df, {"a": ("sum", F.col("v"))}, ["k"], ["t"]).count() == n
    got = O.average_ranks(df, ["big", "v"], ["k"]).toPandas()
    assert len(got) == n and got["big"].max() == 9007199254740993
    want = df.toPandas()
    by = lambda d: d.sort_values(["t", "big", "v"], na_position="first").reset_index(drop=True)
    want["r"] = (want["big"] - 9007199254740992).groupby(want["k"].fillna("none")).rank()
    assert np.allclose(by(got)["_rank_big"], by(want)["r"])


def test_only_hot_keys_are_salted(spark, hot):
    rows = [(1, i) for i in range(200)] + [(k, 0) for k in range(2, 12)] + [(None, 5)]
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 9)], "k int, x int")
    got = O.lookup(spark.createDataFrame(rows, "k int, v int"), table, ["k"]).collect()
    assert sorted((r["k"] or 0, r["v"], r["x"] or 0) for r in got) == sorted((k or 0, v, k * 10 if k and k < 9 else 0) for k, v in rows)
