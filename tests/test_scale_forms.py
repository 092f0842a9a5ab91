"""Forms made for large groups against plain ones: ranks of many columns, quantiles by narrowing, nearest tickers, random orders, clusters."""

import numpy as np
import pandas as pd
import pytest
from data import DAY, frame, walk
from pyspark.sql import functions as F

from panelforge.operators import clusters as C
from panelforge.operators import portfolio as B
from panelforge.operators import quantiles as Q
from panelforge.operators.ordered import average_ranks


@pytest.fixture(params=["plain", "hot"])
def layout(request):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


def wide(rows=300, columns=6, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f"c{i}": rng.choice([np.nan, 1.0, 2.0, 2.5, rng.normal(), -0.0], rows) for i in range(columns)})
    pdf["c0"] = np.nan
    pdf.insert(0, "timestamp", rng.integers(0, 4, rows))
    pdf.insert(1, "ticker", [f"T{i}" for i in range(rows)])
    return pdf


def test_ranks_of_many_columns(spark, layout):
    pdf = wide()
    columns = [c for c in pdf.columns if c.startswith("c")]
    df = frame(spark, pdf).withColumn("timestamp", F.when(F.col("timestamp") > 0, F.col("timestamp"))).checkpoint()
    got = average_ranks(df, columns, ["timestamp"]).toPandas().sort_values("ticker").reset_index(drop=True)
    want = pdf.sort_values("ticker").reset_index(drop=True)
    assert list(got.columns) == [*pdf.columns, *[f"_{p}_{c}" for c in columns for p in ("rank", "count")]]
    for c in columns:
        assert np.allclose(got[f"_rank_{c}"].astype(float), want.groupby("timestamp")[c].rank(), equal_nan=True)
        assert (got[f"_count_{c}"] == want.groupby("timestamp")[c].transform("count")).all()
    assert np.allclose(got[columns].astype(float), want[columns], equal_nan=True)


def test_many_ranks_move_the_rows_once(spark):
    df = frame(spark, wide()).checkpoint()
    average_ranks(df, ["c1", "c2", "c3"], ["timestamp"]).count()  # sizes are known now
    plan = average_ranks(df, [f"c{i}" for i in range(6)], ["timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") <= 3  # one for all columns' values, one to put the rows together


@pytest.mark.parametrize("few, accuracy", [(2_000, 10_000), (3, 25)])
def test_quantiles_by_narrowing(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(few)
    n = 4000
    data = {
        "normal": rng.normal(size=n), "tails": rng.standard_cauchy(n) ** 3, "ties": rng.integers(0, 5, n).astype(float), "hot": np.where(rng.uniform(size=n) < 0.9, 7.0, rng.normal(size=n)),
        "flat": np.full(n, 3.0), "some": np.where(rng.uniform(size=n) < 0.99, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan), "two": np.r_[np.full(n // 2, 1.0), np.full(n // 2, 2.0)],
        "big": rng.normal(size=n) * 1e300, "near": 1e15 + rng.integers(0, 1000, n),
    }
    pdf = pd.DataFrame(data)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(frame(spark, pdf).checkpoint(), list(data), probs)
    for c in data:
        x = pdf[c].dropna()
        assert got[c] is None if not len(x) else np.allclose(got[c], np.quantile(x, probs), rtol=1e-12), c
    assert Q.exact_quantiles(frame(spark, pdf).limit(0).checkpoint(), ["flat"], probs) == {"flat": None}


def test_nearest_tickers_in_blocks(spark):
    pdf = walk(23, 90)
    pdf = pdf[np.random.default_rng(0).uniform(size=len(pdf)) < 0.9].sort_values(["ticker", "timestamp"])
    pdf["x"] = pdf.groupby("ticker")["Close"].pct_change()
    pdf.loc[pdf.ticker == "STOCK05.NZ", "x"] = 0.01  # no spread
    pdf = pd.concat([pdf, pd.DataFrame({"timestamp": [1, 2, 3], "ticker": "NEW.NZ", "x": [0.1, 0.2, 0.1]})])[["timestamp", "ticker", "x"]].dropna()
    table = pdf.pivot(index="timestamp", columns="ticker", values="x")
    want = table.corr(min_periods=60).fillna(0.0)
    for block in (5, 256):
        got = C.nearest_tickers(frame(spark, pdf), 4, 60, block).toPandas().sort_values(["ticker", "place"])
        assert len(got) == 24 * 4
        for ticker, own in got.groupby("ticker"):
            best = sorted((-round(v, 12), k) for k, v in want[ticker].items() if k != ticker)[:4]
            assert own["other"].tolist() == [k for _, k in best]
            assert np.allclose(own["correlation"], [-v for v, _ in best]) and np.allclose(own["distance"], 1 - own["correlation"])
    assert C.nearest_tickers(frame(spark, pdf).limit(0)).count() == 0


def test_random_orders_hold_all_ends(spark, layout):
    rng = np.random.default_rng(3)
    sizes = [3, 9, 12, 40, 41, 130, 400]
    pdf = pd.DataFrame([(t * DAY, f"T{j:03d}", float(rng.normal())) for t, n in enumerate(sizes) for j in range(n)], columns=["timestamp", "ticker", "actual_return"])
    rows = frame(spark, pdf).checkpoint()
    config = B.PortfolioConfig(5, 4)
    few = B._extreme_orders(rows, 5, 60, 42).checkpoint()
    every = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn(
        "order", F.md5(F.concat_ws("|", F.lit("42"), F.col("trial").cast("string"), F.col("timestamp").cast("string"), F.col("ticker"))))
    held = [sorted(map(tuple, B.positions(x, [config], ["trial"], "order").select("trial", "timestamp", "ticker", "weight").collect())) for x in (few, every)]
    assert held[0] == held[1] and len(held[0]) == 60 * 6 * 9
    assert few.filter(f"timestamp = {6 * DAY}").count() < 60 * 400 * 0.2


def test_clusters_repeat_and_cost_no_more_than_lloyd_restarts(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 4, (6, 7))
    pdf = pd.DataFrame(np.vstack([c + rng.normal(0, 1, (20, 7)) for c in centers]), columns=C.FULL_FEATURES)
    pdf.insert(0, "ticker", [f"T{i:03d}" for i in rng.permutation(len(pdf))])
    stats = frame(spark, pdf).checkpoint()
    got = C.assign_clusters(stats).toPandas().set_index("ticker")["cluster"]
    again = C.assign_clusters(stats.repartition(7)).toPandas().set_index("ticker")["cluster"]
    assert got.sort_index().equals(again.sort_index())
    assert got.loc[sorted(got.index)].drop_duplicates().tolist() == list(range(6))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    z = C.z_scores(stats, C.FULL_FEATURES).toPandas().set_index("ticker")
    own = sum(((z[got.reindex(z.index) == k] - z[got.reindex(z.index) == k].mean()) ** 2).to_numpy().sum() for k in range(6))
    points = VectorAssembler(inputCols=list(C.FULL_FEATURES), outputCol="features").transform(C.z_scores(stats, C.FULL_FEATURES))
    other = min(KMeans(k=6, seed=s, maxIter=100).fit(points).summary.trainingCost for s in range(3))
    assert own <= other * 1.001
    # Fewer different points than clusters, and tickers without figures.
    same = stats.limit(9).withColumns({c: F.lit(1.0) for c in C.FULL_FEATURES})
    assert {r["cluster"] for r in C.assign_clusters(same, k=3).collect()} == {0}


def test_features_over_a_stored_panel_need_no_exchange(spark, tmp_path):
    from panelforge.operators.groups import apply_groups
    from panelforge.operators.ordered import Sizes, forget_sizes
    from panelforge.operators.technical import TECHNICAL
    from panelforge.sources import panelstore

    pdf = walk(7, 70)
    path = str(tmp_path / "panel")
    panelstore.write_panel(frame(spark, pdf), path, "stored_walk", 100)
    store = panelstore.read_panel(spark, path)
    assert store.buckets == 5 and store.sizes == {("ticker",): Sizes(70, 490, 7), ("timestamp",): Sizes(7, 490, 70), (): Sizes(490, 490, 1)}
    spark.sql("DROP TABLE stored_walk")  # another session finds the files by their path
    rows = store.table(spark, "stored_again")
    forget_sizes()
    with store.known():
        made = apply_groups(rows, TECHNICAL)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    got, want = (x.toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True) for x in (made, apply_groups(frame(spark, pdf), TECHNICAL)))
    pd.testing.assert_frame_equal(got[want.columns], want)
    spark.sql("DROP TABLE stored_again")


def test_nearest_tickers_send_few_copies(spark):
    """A series is sent once per group, not once per block; more groups, where their grids would not fit, change no row."""
    assert C._groups_to_meet(60_000, 120, 32, C.NEAREST_BYTES) == C.NEAREST_GROUPS
    assert C._groups_to_meet(360_000, 500, 32, C.NEAREST_BYTES) == 45 and C._groups_to_meet(0, 0, 32, C.NEAREST_BYTES) == 1
    rng = np.random.default_rng(8)
    rows = [(d, f"T{t:03d}", float(x)) for t in range(50) for d, x in enumerate(rng.normal(size=90)) if rng.random() < 0.9]
    rows += [(d, "T900", x) for d, t, x in rows if t == "T007"] + [(0, "T950", 1.0), (None, None, 2.0)]
    returns = spark.createDataFrame(rows, "timestamp long, ticker string, x double")
    plain = C.nearest_tickers(returns, 4, 60, 256).orderBy("ticker", "place").toPandas()
    apart = C.nearest_tickers(returns, 4, 60, 3, group_bytes=3 * 90 * 16).orderBy("ticker", "place").toPandas()
    assert (plain["other"] == apart["other"]).all() and np.allclose(plain["correlation"], apart["correlation"], atol=1e-12)
    assert len(plain) == 52 * 4 and plain[(plain["ticker"] == "T900") & (plain["place"] == 1)]["other"].item() == "T007"


def test_ranks_of_groups_cut_by_batches(spark, monkeypatch):
    """Groups cut by Arrow batches are ranked whole; NaN is the largest value and ties with itself, signs of zero tie, unknown keys are one group."""
    from panelforge.operators import tied

    monkeypatch.setattr(tied, "_ROWS_AT_ONCE", 20)
    rng = np.random.default_rng(5)
    rows = [(int(k) if k else None, i, *[None if x == 3 else (float("nan"), 0.0, -0.0)[int(x)] if x < 3 else float(x) for x in rng.integers(0, 9, 3)])
            for i, k in enumerate(rng.integers(0, 9, 300) // 2)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double, c double").checkpoint()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["i"]: r for r in average_ranks(df, ["a", "b", "c"], ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300
    for at, c in enumerate("abc", 2):
        for k in {r[0] for r in rows}:
            mine = [(r[1], np.inf if r[at] != r[at] else r[at]) for r in rows if r[0] == k and r[at] is not None]
            for i, x in mine:
                low, same = sum(y < x for _, y in mine), sum(y == x for _, y in mine)
                assert got[i][f"_rank_{c}"] == low + (same + 1) / 2 and got[i][f"_count_{c}"] == len(mine)
        assert all(got[r[1]][f"_rank_{c}"] is None for r in rows if r[at] is None)


def test_many_ranks_take_no_row_apart(spark):
    """Rows are not multiplied by their columns to be ranked, nor gathered again."""
    df = frame(spark, wide()).checkpoint()
    plan = average_ranks(df, [f"c{i}" for i in range(6)], ["timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan and plan.count("Exchange") == 1
