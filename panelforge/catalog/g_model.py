"""Model and end-to-end runs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from panelforge.catalog.a_panel import LONG, MACRO_ASOF
from panelforge.catalog.b_features import ALP, F0, TEC
from panelforge.catalog.base import DAY, PANEL, Inputs, keyed, labelled_cte, lag, query, r, rounded
from panelforge.catalog.d_labels_metrics import GRADED, P, TS
from panelforge.operators import alpha as A
from panelforge.operators import listwise as N
from panelforge.operators import model as M
from panelforge.operators import technical as T
from panelforge.operators.groups import apply_groups
from panelforge.operators.labels import forward_return, relevance_grades
from panelforge.plans import evaluation as E
from panelforge.session import stored

COLUMNS = ["Rev_5d", "Rev_10d", "RSI_14", "Dist_MA_20", "BB_Width_20", "MAX_21d", "InfoDisc_21"]


def labelled_features(i: Inputs):
    feats = apply_groups(i.panel, [A.REVERSAL, T.RSI, T.MA_DISTANCE, T.BOLLINGER, A.EXTREMES, A.DISCRETENESS])
    return forward_return(feats.select("timestamp", "ticker", "Close", *COLUMNS), 30, tolerance_days=20, price="Close")


query("mdl01_ranking_dataset", lambda i: rounded(M.ranking_dataset(i.labelled, ["predicted_score"])),
      f"WITH {PANEL},{labelled_cte()} {keyed({'predicted_score': 'predicted_score', 'forward_return': 'forward_return'}, 'labelled WHERE forward_return IS NOT NULL')}")
query("mdl01_group_sizes", lambda i: M.group_sizes_by_date(M.ranking_dataset(i.labelled, ["predicted_score"])),
      f"WITH {PANEL},{labelled_cte()} SELECT {TS}, count(*) AS group_size FROM labelled WHERE forward_return IS NOT NULL GROUP BY ts")
# The fit over all rows takes the default rounds; each of the five other fits takes fewer, since a round is some ten small jobs (README has figures).
FEWER = M.RankerConfig(rounds=6)
CONFIG = E.EvaluationConfig(ranker=FEWER)
CLUSTERED = E.EvaluationConfig(ranker=FEWER, n_clusters=4)


@lru_cache(maxsize=8)
def _once(application: str, folder: str, what: str):
    """Fits that several entries report on, done once for the tables of a folder."""
    return {}


def shared(i: Inputs, what: str, make):
    found = _once(i.spark.sparkContext.applicationId, i.folder, what)
    if "made" not in found:
        found["made"] = make()
    return found["made"]


def _fit(i: Inputs):
    """(prepared rows, model, NDCG by round) with the default rounds and depth."""
    def make():
        rows = E.prepare(labelled_features(i), COLUMNS)
        return rows, *M.fit_with_history(rows, COLUMNS)
    return shared(i, "fit", make)


def _rolled(i: Inputs, name: str = "plain", config: E.EvaluationConfig = CONFIG):
    return shared(i, f"rolled {name}", lambda: E.rolling_predictions(labelled_features(i), COLUMNS, config))


def graded(i: Inputs):
    return stored(relevance_grades(i.stored_predictions, "actual_return").select("timestamp", "ticker", "predicted_score", "relevance"))


# Order of equal scores, as in the operator; places among the best five of a date.
ORDERED = """og AS (SELECT ts, ticker, s, pow(2, relevance) - 1 AS gain, row_number() OVER (PARTITION BY ts ORDER BY s DESC, md5(ts || '|' || ticker)) AS p,
  row_number() OVER (PARTITION BY ts ORDER BY relevance DESC, md5(ts || '|' || ticker)) AS ip FROM graded),
idl AS (SELECT ts, sum(gain / log2(ip + 1)) AS ideal FROM og WHERE ip <= 5 GROUP BY ts)"""
query("mdl02_ndcg", lambda i: rounded(N.ndcg_by_date(graded(i), 5)),
      f"{P}, {GRADED}, {ORDERED}, fnd AS (SELECT ts, sum(gain / log2(p + 1)) AS found FROM og WHERE p <= 5 GROUP BY ts) SELECT {TS}, {r('found / nullif(ideal, 0)', 'ndcg')} FROM fnd JOIN idl USING (ts)")
query("mdl02_lambda_gradients", lambda i: rounded(N.lambda_gradients(graded(i), 5).select("timestamp", "ticker", "lambda", "curvature")),
      f"""{P}, {GRADED}, {ORDERED},
      prs AS (SELECT t.ts, t.ticker AS up, d.ticker AS down, sign(t.gain - d.gain) AS sd, abs(t.gain - d.gain) * (1 / log2(t.p + 1) - CASE WHEN d.p <= 5 THEN 1 / log2(d.p + 1) ELSE 0 END) / ideal AS sw,
        1 / (exp(sign(t.gain - d.gain) * (t.s - d.s)) + 1) AS wr FROM og t JOIN og d ON d.ts = t.ts AND t.p <= 5 AND t.p < d.p JOIN idl ON idl.ts = t.ts WHERE t.gain <> d.gain AND ideal > 0),
      lam AS (SELECT ts, up AS ticker, sd * sw * wr AS l, sw * wr * (1 - wr) AS c FROM prs UNION ALL SELECT ts, down, -sd * sw * wr, sw * wr * (1 - wr) FROM prs),
      tot AS (SELECT ts, ticker, sum(l) AS l, sum(c) AS c FROM lam GROUP BY ts, ticker)
      SELECT {TS}, ticker, {r('coalesce(l, 0.0)', 'lambda')}, {r('coalesce(c, 0.0)', 'curvature')} FROM og LEFT JOIN tot USING (ts, ticker)""")
query("mdl02_03_fit_and_score", lambda i: (lambda f: M.score(f[1], f[0]).select("timestamp", "ticker", "predicted_score"))(_fit(i)))
query("mdl02_ndcg_by_round", lambda i: M.ndcg_history(_fit(i)[2], i.spark))
query("mdl04_feature_importance", lambda i: M.feature_importance(_fit(i)[1], i.spark))
query("mdl05_rolling_predictions", lambda i: _rolled(i)[0])
query("mdl05_with_clusters", lambda i: _rolled(i, "clustered", CLUSTERED)[0])
query("mdl04_average_importance", lambda i: M.average_importance(_rolled(i)[1]))
query("mdl06_train_and_rank_latest", lambda i: E.train_and_rank(labelled_features(i), COLUMNS, CONFIG).select("timestamp", "ticker", "predicted_score", "rank"))
query("mdl06_rank_latest", lambda i: rounded(M.rank_latest(i.stored_predictions).select("timestamp", "ticker", "predicted_score", "rank")),
      f"{P}, l AS (SELECT * FROM pred WHERE ts = (SELECT max(ts) FROM pred)) SELECT {TS}, ticker, {r('s', 'predicted_score')}, row_number() OVER (ORDER BY s DESC, ticker) AS rank FROM l")
query("mdl06_picks", lambda i: M.picks(M.rank_latest(i.stored_predictions), 3).select("ticker", "rank", "pick"),
      f"""{P}, l AS (SELECT * FROM pred WHERE ts = (SELECT max(ts) FROM pred)), k AS (SELECT ticker, row_number() OVER (ORDER BY s DESC, ticker) AS rank, count(*) OVER () AS n FROM l)
      SELECT ticker, rank, CASE WHEN rank <= 3 THEN 'top' ELSE 'bottom' END AS pick FROM k WHERE rank <= 3 OR rank > n - 3""")
query("mdl07_latest_rows", lambda i: rounded(M.latest_rows(i.panel.select("timestamp", "ticker", "Close"), 7), 4),
      f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS p, max(ts) OVER () AS m FROM panel)
      {keyed({'Close': 'c'}, f'x WHERE p = 1 AND ts >= m - {7 * DAY}', 4)}""")
query("run_evaluation", lambda i: E.evaluate(_rolled(i)[0].drop("window_id").withColumn(
    "actual_return", F.greatest(F.least("actual_return", F.lit(1.0)), F.lit(-1.0)) * 0.02), None, E.EvaluationConfig(portfolio=E.portfolio.PortfolioConfig(3, 3))))
WIDE = ("RSI_14", "ROC_10", "NATR_14", "BB_Width_20", "Dist_MA_50", "Vol_20", "Vol_GK_20", "Ret_Lag_1")
DEEP = ("Rev_5d", "Trend_RSq_60", "IdioVol_20", "InfoDisc_63", "MAX_21d", "RelVol_20d", "MomAccel_21_63", "Near52wHigh")
query("all_features", lambda i: rounded(E.add_features(i.panel), 6, ["timestamp", "ticker", *WIDE, *DEEP]),
      f"WITH {F0} " + keyed({**{c: f"CASE WHEN n >= 50 THEN {TEC[c]} END" for c in WIDE}, **{c: f"CASE WHEN n >= 260 THEN {ALP[c]} END" for c in DEEP}}, "f2"))
# Generated lags have entries of their own; with them one run of the chain spends most of its time on compiling 395 columns.
query("feature_chain_without_lags", lambda i: E.add_all_features(i.panel, i.macro, lags=False))
query("plan_build_panel", lambda i: rounded(E.build_panel(i.long).select("timestamp", "ticker", "Close", "MACRO_rate"), 4),
      f"""WITH {LONG}{MACRO_ASOF}, rets AS (SELECT ts, ticker, c, rate, c / nullif({lag('c')}, 0) - 1 AS ret FROM full_panel WHERE ts >= 946684800000),
      trimmed AS (SELECT *, min(CASE WHEN abs(ret) > 2.0 THEN ts END) OVER (PARTITION BY ticker) AS first_ts FROM rets)
      {keyed({'Close': 'c', 'MACRO_rate': 'rate'}, 'trimmed WHERE first_ts IS NULL OR ts >= first_ts', 4)}""")
