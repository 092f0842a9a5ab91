"""Sliding frames made over batches against pandas: nulls, infinities, series that begin and end inside a batch, frames longer than it."""

import numpy as np
import pandas as pd
import pytest
from data import frame, walk
from pyspark.sql import functions as F

from panelforge.operators import alpha, technical
from panelforge.operators import ordered as O
from panelforge.operators.groups import apply_groups

KINDS = {"count": "count", "sum": "sum", "avg": "mean", "std": "std", "max": "max", "min": "min"}


@pytest.fixture(params=["plain", "hot"])
def layout(request):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")
    yield
    spark.conf.set(key, before)


def series(sizes=(1, 2, 30, 9, 200, 45), seed=3):
    rng = np.random.default_rng(seed)
    return pd.concat([pd.DataFrame({
        "ticker": f"T{i}", "timestamp": np.arange(n), "x": np.round(rng.normal(size=n), 3) * 10.0 ** rng.integers(0, 6),
        "gaps": np.where(rng.uniform(size=n) < 0.6, np.nan, rng.normal(size=n)), "flat": 0.1 * (i + 1),
    }) for i, n in enumerate(sizes)], ignore_index=True)


@pytest.mark.parametrize("kind", KINDS)
def test_frames_against_pandas(spark, layout, small_batches, kind):
    pdf = series()
    frames = [(c, n, end) for c in ("x", "gaps", "flat") for n, end in ((8, 0), (13, 4), (64, 0), (100, 21))]
    got = O.over_series(frame(spark, pdf), [lambda w: {f"{c}_{n}_{end}": w.agg(kind, c, n, end) for c, n, end in frames}], 121).toPandas()
    got = got.sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    want = pdf.sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    for c, n, end in frames:
        def one(x, n=n, end=end):
            made = [x.iloc[max(i - end - n + 1, 0):max(i - end + 1, 0)].dropna() for i in range(len(x))]
            least = {"count": 0, "std": 2}.get(kind, 1)
            return pd.Series([getattr(v, KINDS[kind])() if len(v) >= least else np.nan for v in made], index=x.index)
        assert np.allclose(got[f"{c}_{n}_{end}"].astype(float), want.groupby("ticker", group_keys=False)[c].apply(one), rtol=1e-10, atol=1e-12, equal_nan=True), (c, n, end)
    if kind == "std":
        assert got["flat_64_0"].dropna().eq(0.0).all()


def test_unknown_and_infinite_values_as_in_windows(spark, small_batches):
    """NaN, infinities and nulls give what a window gives, and leave no trace beyond the frame."""
    values = [1.0, float("nan"), None, 3.0, *[float(i) for i in range(20)], float("inf"), 5.0, float("-inf"), *[0.25 * i for i in range(40)], None, None]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "timestamp long, ticker string, x double")
    made = lambda w: {f"{k}{n}": w.agg(k, "x", n) for k in KINDS for n in (8, 11)}
    got = O.over_series(df, [made], 11).orderBy("timestamp").collect()
    spec = O.Window.partitionBy("ticker").orderBy("timestamp")
    want = df.withColumns({f"{k}{n}": O._AGGREGATES[k]("x").over(spec.rowsBetween(1 - n, 0)) for k in KINDS for n in (8, 11)}).orderBy("timestamp").collect()
    for a, b in zip(got, want):
        for c in a.asDict():
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == b[c] or c != "ticker" and np.isclose(a[c], b[c], equal_nan=True)), (c, a, b)


def test_long_frames_are_not_evaluated_row_by_row(spark):
    """No window slides over a long frame of numbers: its work would be rows times the frame's length."""
    groups = [*technical.TECHNICAL, *alpha.ALPHA]
    plan = apply_groups(frame(spark, walk(1, 30)), groups)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -13" not in plan and "specifiedwindowframe(RowFrame, -251" not in plan
    assert "ArrowEvalPython" in plan and "collect_list" not in plan


def test_long_frames_cost_no_further_shuffle(spark):
    """Lags that follow a long frame are taken with it: all groups of a ticker still share one shuffle and one sort."""
    plan = apply_groups(frame(spark, walk(1, 30)), [*technical.TECHNICAL, *alpha.ALPHA])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_lags_and_means_of_the_largest(spark, layout, small_batches):
    pdf = series()
    got = O.over_series(frame(spark, pdf), [
        lambda w: {"m": w.agg("avg", "x", 9), "before": w.lag("gaps", 17), "top": w.top_mean("x", 21)}, lambda w: {"last": w.lag("m", 3)}], 30).toPandas()
    got = got.sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    want = pdf.sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    by = want.groupby("ticker")
    means = by["x"].transform(lambda x: x.rolling(9, min_periods=1).mean())
    assert np.allclose(got["last"].astype(float), means.groupby(want["ticker"]).shift(3), equal_nan=True, atol=1e-9)
    assert np.allclose(got["before"].astype(float), by["gaps"].shift(17), equal_nan=True)
    assert np.allclose(got["top"].astype(float), by["x"].transform(lambda x: x.rolling(21, min_periods=1).apply(lambda v: np.sort(v)[-5:].sum() / 5, raw=True)))


def test_filters_stay_above_the_frames(spark):
    """A filter on the order would take rows from the frames if it got beneath them."""
    df = frame(spark, series((50,)))
    got = O.over_series(df, [lambda w: {"n": w.agg("count", "x", 20)}], 20).filter((F.col("timestamp") >= 30) & (F.col("timestamp") % 2 == 0))
    assert {r["n"] for r in got.collect()} == {20}
