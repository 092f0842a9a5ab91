import math

import numpy as np
import pandas as pd
import pytest
from data import DAY, frame, walk
from pyspark.sql import functions as F

from panelforge.operators import clusters as C
from panelforge.operators import metrics as M
from panelforge.operators import model, quality as Q
from panelforge.operators import portfolio as B
from panelforge.operators import returns as R
from panelforge.operators import robustness as X
from panelforge.operators.labels import forward_return
from panelforge.plans import evaluation as E


@pytest.fixture(params=["plain", "hot"])
def layout(request):
    if request.param == "hot":
        request.getfixturevalue("hot")
    return request.param


def predictions(sign=1.0, dates=10, tickers=20):
    return pd.DataFrame([(t * DAY, f"T{s:02d}", s / tickers, sign * 0.1 * s / tickers) for t in range(dates) for s in range(tickers)],
                        columns=["timestamp", "ticker", "predicted_score", "actual_return"])


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_planted_ic(spark, sign):
    df = frame(spark, predictions(sign))
    assert np.allclose([r["ic"] for r in M.ic_by_date(df).collect()], sign)
    assert np.allclose([r["rank_ic"] for r in M.rank_ic_by_date(df).collect()], sign)
    assert M.hit_rate(df, 5).first()[0] == (1.0 if sign > 0 else 0.0)


def test_ic_edge_cases(spark):
    flat = pd.DataFrame({"timestamp": [1] * 5 + [2] * 2, "ticker": list("abcdeab"), "predicted_score": [1.0] * 5 + [1.0, 2.0], "actual_return": [1.0, 2, 3, 4, 5, 1, 2]})
    got = M.ic_by_date(frame(spark, flat), 2).toPandas()
    assert got["ic"].isna().all()
    assert M.ic_by_date(frame(spark, flat), 3).count() == 1


def test_icir_and_stability(spark):
    s = frame(spark, pd.DataFrame({"timestamp": range(5), "ic": [0.04, 0.05, 0.06, 0.05, 0.05]}))
    r = M.icir(s, "ic", 21).first()
    assert r["raw_icir"] == pytest.approx(0.05 / 0.0070711, rel=1e-4) and r["icir"] == pytest.approx(r["raw_icir"] * math.sqrt(12))
    assert M.stability(s).first()["ic_positive_rate"] == 1.0
    assert M.autocorrelation(s).count() == 0


def test_t_test_matches_table_values(spark):
    # Two-sided 5 % points of Student's t.
    rows = spark.createDataFrame([(12.706, 1.0), (2.228, 10.0), (1.984, 100.0), (1.96, 1e6), (0.0, 7.0)], "t double, v double")
    got = [r[0] for r in rows.select(M.student_p(F.col("t"), F.col("v"))).collect()]
    assert np.allclose(got, [0.05, 0.05, 0.05, 0.05, 1.0], atol=2e-4)


def test_quintiles(spark, layout):
    pdf = pd.DataFrame({"timestamp": 1, "ticker": [f"t{i:02d}" for i in range(50)], "predicted_score": np.arange(50.0), "actual_return": np.repeat([-0.10, -0.05, 0, 0.05, 0.10], 10)})
    df = frame(spark, pdf)
    row = M.quantile_returns_by_date(df).first()
    assert np.allclose([row[f"Q{i}"] for i in range(1, 6)], [-0.10, -0.05, 0, 0.05, 0.10])
    bins = M.quantile_returns(df)
    assert M.spread(bins).first()[0] == pytest.approx(0.2) and M.monotonicity(bins).first()["is_monotonic"]
    swapped = spark.createDataFrame([(1, 0.2), (2, 0.1), (3, 0.3)], "bin int, mean_return double")
    assert M.monotonicity(swapped).first()["monotonicity_score"] == 0.5


def series(values, step=1):
    return pd.DataFrame({"timestamp": [i * step * DAY for i in range(len(values))], "ret": values})


def test_returns(spark, layout):
    rng = np.random.default_rng(4)
    r = rng.normal(0.001, 0.02, 800)
    df = frame(spark, series(r))
    w = np.cumprod(1 + r)
    dd = ((np.maximum.accumulate(w) - w) / np.maximum.accumulate(w)).max()
    assert R.max_drawdown(df).first()["max_drawdown"] == pytest.approx(dd)
    got = R.cumulative(df).toPandas().sort_values("timestamp")
    assert np.allclose(got["cumulative"], w - 1)
    sharpe = r.mean() / r.std(ddof=1) * math.sqrt(252)
    assert R.sharpe_inferred(df).first()["sharpe"] == pytest.approx(sharpe)
    assert R.omega(df).first()[0] == pytest.approx(r[r > 0].sum() / -r[r <= 0].sum())
    assert R.sortino(df).first()[0] == pytest.approx(r.mean() / math.sqrt((r[r < 0] ** 2).mean()) * math.sqrt(252))
    assert R.tail_ratio(df).first()[0] == pytest.approx(abs(np.percentile(r, 95)) / abs(np.percentile(r, 5)))
    best = {True: 0, False: 0}
    run, last = 0, None
    for x in r > 0:
        run = run + 1 if x == last else 1
        last, best[x] = x, max(best[x], run)
    s = R.streaks(df).first()
    assert (s["max_consecutive_wins"], s["max_consecutive_losses"]) == (best[True], best[False])


def test_return_edge_cases(spark):
    assert R.sharpe(frame(spark, series([0.01] * 5)), 252).first()[0] == math.inf
    assert R.sharpe(frame(spark, series([-0.01] * 5)), 252).first()[0] == -math.inf
    assert R.sharpe(frame(spark, series([0.01])), 252).first()[0] is None
    assert R.periods_per_year(frame(spark, series([0.0] * 9, 7))).first()[0] == 52
    assert R.periods_per_year(frame(spark, series([0.0] * 9, 73))).first()[0] == 5
    assert R.calmar(frame(spark, series([0.01] * 20))).first()[0] is None
    assert R.sortino(frame(spark, series([0.01] * 20))).first()[0] is None
    assert R.annual_statistics(frame(spark, series([0.01] * 100))).count() == 0


def test_annual_statistics(spark):
    rng = np.random.default_rng(1)
    pdf = series(rng.normal(0.0004, 0.01, 1200))
    row = R.annual_statistics(frame(spark, pdf)).first()
    years = pd.to_datetime(pdf.timestamp, unit="ms").dt.year
    yearly = (1 + pdf.ret).groupby(years).prod()[pdf.groupby(years).size() >= 200] - 1
    assert row["mean_annual_return"] == pytest.approx(yearly.mean()) and row["pct_95_annual_return"] == pytest.approx(np.percentile(yearly, 95))


def test_top_bottom(spark):
    pdf = pd.DataFrame({"timestamp": 1, "ticker": list("ABCDE"), "predicted_score": [0.1, 0.5, 0.3, 0.8, 0.2], "actual_return": [1.0, 2, 3, 4, 5]})
    got = {r["ticker"]: r["weight"] for r in B.positions(frame(spark, pdf), [B.PortfolioConfig(2, 2)]).collect()}
    assert got == {"D": 0.5, "B": 0.5, "A": -0.5, "E": -0.5}
    assert B.positions(frame(spark, pdf), [B.PortfolioConfig(3, 3)]).count() == 0
    long_only = B.positions(frame(spark, pdf), [B.PortfolioConfig(2, 2, long_only=True)])
    assert B.period_returns(long_only).first()["gross"] == 3.0
    with pytest.raises(ValueError):
        B.PortfolioConfig(0)


def test_top_k_is_pushed_below_the_shuffle(spark, capsys):
    B.positions(frame(spark, predictions()), [B.PortfolioConfig(2, 2)]).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_turnover(spark, layout):
    rows = [(1, "A", 0.5), (1, "B", 0.5), (2, "B", 0.5), (2, "C", 0.5), (3, "B", 0.5), (3, "C", 0.5)]
    pos = spark.createDataFrame([(0, t, k, w) for t, k, w in rows], "config_id int, timestamp bigint, ticker string, weight double")
    assert {r["timestamp"]: r["turnover"] for r in B.turnover(pos).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}


def daily_by_hand(holdings, prices, cost, suspect=0.5):
    """Day-by-day bookkeeping in plain Python."""
    bad = set()
    for t, d in prices.sort_values("timestamp").groupby("ticker"):
        p, ts = d.Close.to_numpy(), d.timestamp.to_numpy()
        for i in range(1, len(p) - 1):
            a, b = p[i] / p[i - 1] - 1, p[i + 1] / p[i] - 1
            if abs(a) > 0.4 and a * b < -0.16:
                bad |= {(ts[i], t), (ts[i + 1], t)}
    look = {(r.timestamp, r.ticker): r.Close for r in prices.itertuples()}
    marks = sorted(holdings.timestamp.unique())
    days = [d for d in sorted(prices.timestamp.unique()) if d >= marks[0]]
    out, book, k, owed = [], {}, 0, False
    for i, day in enumerate(days):
        if k < len(marks) and day >= marks[k]:
            book = {r.ticker: r.weight for r in holdings[holdings.timestamp == marks[k]].itertuples()}
            k, owed = k + 1, True
        if i == 0:
            continue
        seen = x = 0.0
        for t, w in book.items():
            if (day, t) in bad or (days[i - 1], t) in bad or (day, t) not in look or (days[i - 1], t) not in look:
                continue
            r = look[(day, t)] / look[(days[i - 1], t)] - 1
            x += w * (0.0 if abs(r) > suspect else r)
            seen += abs(w)
        total = sum(map(abs, book.values()))
        if seen < total * 0.5:
            continue
        x = x * total / seen if 0 < seen < total else x
        out.append((day, x - (cost / 1e4 if owed else 0.0)))
        owed = False
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_daily_returns_equal_bookkeeping(spark, layout, seed):
    rng = np.random.default_rng(seed)
    pdf = walk(8, 90, seed)[["timestamp", "ticker", "Close"]]
    pdf["Close"] *= np.where(rng.uniform(size=len(pdf)) < 0.03, 2.0, 1.0)
    pdf = pdf[rng.uniform(size=len(pdf)) < 0.85]
    start = pdf.timestamp.min()
    marks = [start + int(d * DAY) for d in (2, 2.2, 2.4, 20, 45.5, 46, 80)]  # some closer together than the price days
    names = sorted(pdf.ticker.unique())
    holdings = pd.DataFrame([(m, t, (0.5 if j < 2 else -0.5)) for m in marks for j, t in enumerate(rng.choice(names, 4, replace=False))], columns=["timestamp", "ticker", "weight"])
    got = B.daily_returns(frame(spark, holdings), frame(spark, pdf), 15.0).toPandas().sort_values("timestamp")
    want = daily_by_hand(holdings, pdf, 15.0)
    assert got["timestamp"].tolist() == [int(t) for t, _ in want]
    assert np.allclose(got["ret"], [x for _, x in want])


def test_robustness(spark):
    r = frame(spark, series([0.01, -0.005] * 60))
    per = X.window_returns(r, [(0, 50 * DAY), (40 * DAY, 119 * DAY), (500 * DAY, 600 * DAY)])
    assert per.count() == 2
    score = X.robustness(r, [(0, 50 * DAY)], 2.0, 2.0, 0.5).first()["robustness_score"]
    assert score == pytest.approx(0.45 + 0.375 + 0.25 - 0.10)


def test_clusters(spark):
    calm, wild = walk(6, 200, 1), walk(6, 200, 2)
    wild["Close"] = wild.groupby("ticker")["Close"].transform(lambda x: x.iloc[0] * np.exp((np.log(x / x.iloc[0])) * 4))
    wild["ticker"] = "W" + wild["ticker"]
    pdf = pd.concat([calm, wild])
    stats = C.stored(C.ticker_characteristics(frame(spark, pdf), 500, 100))
    one = calm[calm.ticker == "STOCK00.NZ"].Close.pct_change().dropna()
    row = stats.filter("ticker = 'STOCK00.NZ'").first()
    assert row["volatility"] == pytest.approx(one.std(ddof=0) * math.sqrt(252)) and row["skewness"] == pytest.approx(one.skew())
    got = C.assign_clusters(stats, ("volatility",), 2, starts=2).toPandas()
    groups = got.groupby(got.ticker.str.startswith("W"))["cluster"].nunique()
    assert (groups == 1).all() and got["cluster"].nunique() == 2
    assert C.assign_clusters(stats.limit(1)).first()["cluster"] == 0


def test_cluster_prefix_invariance(spark):
    pdf = walk(4, 260)
    cut = pdf.timestamp.min() + 200 * DAY
    a = C.fast_characteristics(frame(spark, pdf).filter(F.col("timestamp") <= cut)).toPandas().sort_values("ticker")
    b = C.fast_characteristics(frame(spark, pdf[pdf.timestamp <= cut])).toPandas().sort_values("ticker")
    assert np.allclose(a.drop(columns="ticker").astype(float), b.drop(columns="ticker").astype(float))


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (-5, "b", None), (2, "c", -1.0)], "timestamp bigint, ticker string, Close double")
    got = {r["check"]: r["rows"] for r in Q.validate_wide(df).collect()}
    assert got == {"negative_timestamp": 1, "null_timestamp": 0, "invalid_close": 2, "duplicate_key": 2}
    with pytest.raises(Q.QualityError):
        Q.assert_valid_wide(df)
    with pytest.raises(Q.QualityError):
        Q.assert_frame(df, no_nulls=["Close"])
    with pytest.raises(Q.QualityError):
        Q.assert_frame(df, unique=["ticker"])
    with pytest.raises(Q.QualityError):
        Q.assert_no_lookahead(df, df)
    with pytest.raises(Q.QualityError):
        Q.usable_features(df, ["Gone"])
    assert Q.usable_features(df.withColumn("void", F.lit(None).cast("double")), ["Close", "void", "Gone"], True) == ["Close"]
    assert Q.fingerprint(df).first() == Q.fingerprint(df.orderBy(F.desc("ticker")).repartition(3)).first()
    assert Q.fingerprint(df).first()[1] != Q.fingerprint(df.limit(3)).first()[1]
    with pytest.raises(ValueError):
        E.EvaluationConfig(horizon_days=0)
    with pytest.warns(UserWarning):
        E.EvaluationConfig(horizon_days=400)


@pytest.fixture(scope="module")
def planted(spark):
    """A feature that is the forward return with noise."""
    labelled = forward_return(frame(spark, walk(12, 260)), 5, tolerance_days=3)
    return labelled.select("timestamp", "ticker", "Close", "forward_return", F.coalesce(F.col("forward_return"), F.lit(0.0)).alias("signal"),
                           (F.pmod(F.xxhash64("timestamp", "ticker"), F.lit(1000)) / 1000).alias("noise")).checkpoint()


CONFIG = dict(horizon_days=5, n_windows=2, move_years=0.1, test_years=0.2, ranker=model.RankerConfig(rounds=4))


def test_rolling_run_finds_the_signal(spark, planted):
    spark.sparkContext.setLogLevel("ERROR")
    scored, weights = E.rolling_predictions(planted, ["signal", "noise"], E.EvaluationConfig(**CONFIG))
    assert {r["window_id"] for r in scored.select("window_id").distinct().collect()} == {0, 1}
    assert M.icir(M.ic_by_date(scored)).first()["mean_ic"] > 0.6
    top = model.average_importance(weights).orderBy(F.desc("importance")).first()
    assert top["feature"] == "signal" and top["windows"] == 2
    record = {r["metric"]: r["value"] for r in E.evaluate(scored.filter("window_id = 0"), planted, E.EvaluationConfig(**CONFIG, portfolio=B.PortfolioConfig(3, 3))).collect()}
    assert record["quintile_spread"] > 0 and record["portfolio_sharpe"] > 0


def test_future_rows_do_not_change_predictions(spark, planted):
    cfg = E.EvaluationConfig(**CONFIG)
    newest = planted.agg(F.max("timestamp")).first()[0]
    train_end, test_end = newest - 80 * DAY, newest - 60 * DAY
    a, _ = E.run_window(planted, train_end, test_end, ["signal", "noise"], cfg)
    b, _ = E.run_window(planted.filter(F.col("timestamp") < test_end), train_end, test_end, ["signal", "noise"], cfg)
    a, b = (x.toPandas().sort_values(["timestamp", "ticker"])["predicted_score"].to_numpy() for x in (a, b))
    assert np.allclose(a, b)


def test_train_save_and_rank(spark, planted, tmp_path):
    path = str(tmp_path / "model")
    ranked = E.train_and_rank(planted, ["signal", "noise"], E.EvaluationConfig(**CONFIG), path)
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 13)) and rows[0]["predicted_score"] >= rows[-1]["predicted_score"]
    again = E.rank_with_saved(path, planted).orderBy("rank").collect()
    assert [r["ticker"] for r in again] == [r["ticker"] for r in rows]
    with pytest.warns(UserWarning):
        E.rank_with_saved(path, planted.drop("noise")).count()
    assert model.picks(ranked, 2).count() == 4 and model.ticker_row(ranked, "STOCK03.NZ").count() == 1
