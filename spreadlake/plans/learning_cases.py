"""Cases: multi-timeframe combination, features, labels, models, data quality, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import crossfit as CV
from spreadlake.operators import features as E
from spreadlake.operators import hedge as H
from spreadlake.operators import metrics as M
from spreadlake.operators import models as L
from spreadlake.operators import multiframe as T
from spreadlake.operators import quality as V
from spreadlake.operators import risk as K
from spreadlake.operators import signals as S
from spreadlake.plans import inputs as I
from spreadlake.plans import strategy_sql as Q
from spreadlake.plans.registry import CALENDAR, HOURLY, PAIRS, case, fold_sql, full, shared, spread_sql, w
from spreadlake.plans.research_cases import BREACHES, RISK, backtested
from spreadlake.plans.strategy_cases import DAY, H1, HPAIRS, RULES, seg, zbars
from spreadlake.series import join_small, position, segment, trim
from spreadlake.session import ensure_checkpoint_dir, stage
from spreadlake.sources import calendar as Cal
from spreadlake.streaming import live

# --- multi-timeframe ------------------------------------------------------------------------------
# Fast side: hourly pairs of events.  Slow side: the same pairs by day.


def daily_event_pairs(s: SparkSession, d: str) -> DataFrame:
    last = I.hourly_pairs(s, d).withColumn("day", F.date_trunc("day", "ts"))
    return last.groupBy("pair", "day").agg(F.max_by("fx_price", "ts").alias("fx_price"), F.max_by("comd_price", "ts").alias("comd_price")).withColumnRenamed("day", "ts")


def _fast(s, d):
    return trim(S.bounded_hold_signals(I.hourly_pairs(s, d), H1, 24, any_gate=True))


def _slow(s, d):
    """Short daily series: windowed regression is too long for it, so the recursive estimate over ten bars."""
    rules = S.Rules(beta_window=10, z_window=5, corr_window=5, entry_z=1.0, adf_p=0.99)
    return trim(S.bounded_hold_signals(daily_event_pairs(s, d), rules, 60, any_gate=True))


FAST = f"""{HPAIRS}, {spread_sql()}, {Q.GATE}, {Q.adf_sql('sp')}, gt AS (SELECT gate.*, corr_ok OR coalesce(adf_p <= 0.15, false) AS ok FROM gate JOIN adf USING (pair)),
 {Q.flags_sql('gt', '1.5', '0.5', '3.5', 'ok')}, {fold_sql('coded', max_bars=24)}, fast AS (SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn))"""


def _rename(sql: str, names: dict[str, str]) -> str:
    import re

    for a, b in names.items():
        sql = re.sub(rf"\b{a}\b", b, sql)
    return sql


_DAYP = "dpairs AS (SELECT pair, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(fx_price, ts) AS fx_price, arg_max(comd_price, ts) AS comd_price FROM pairs GROUP BY 1, 2)"
_GATE5 = f"gate AS (SELECT *, coalesce(abs({full('corr(fx_price, comd_price)', 'fx_price', 5)}) >= 0.15, false) AS corr_ok FROM zs)"
_SLOWSQL = f"""{spread_sql(src='dpairs', z=5)}, {_GATE5}, {Q.adf_sql('sp')}, gt AS (SELECT gate.*, corr_ok OR coalesce(adf_p <= 0.99, false) AS ok FROM gate JOIN adf USING (pair)),
 {Q.flags_sql('gt', '1.0', '0.5', '3.5', 'ok')}, {fold_sql('coded', max_bars=60)}, slow AS (SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn))"""
_NAMES = ["num", "sums", "mom", "hedge", "sp", "zs", "gate", "gt", "flags", "coded", "src", "fold", "adf"] + [f"adf{i}" for i in range(8)]
TWO = f"WITH RECURSIVE {FAST}, {_DAYP}, {_rename(_SLOWSQL, {n: 'd_' + n for n in _NAMES})}"
COMBINED = f"""{TWO}, al AS (SELECT f.pair, f.ts, f.signal AS h1_signal, f.spread_z AS h1_z, f.fx_price AS h1_price, s.signal AS d1_signal, s.spread_z AS d1_z, s.ok AS good_regime
  FROM fast f ASOF LEFT JOIN slow s ON f.pair = s.pair AND f.ts >= s.ts),
 c0 AS (SELECT *, CASE WHEN count(h1_signal) {w(4)} >= 4 THEN greatest(sum((h1_signal = 1)::INT) {w(4)}, sum((h1_signal = 0)::INT) {w(4)}, sum((h1_signal = -1)::INT) {w(4)}) / 4 END AS stay, h1_price / lag(h1_price) {Q.Q} - 1 AS hr FROM al),
 c1 AS (SELECT *, 0.5 + 0.3 * abs(h1_z) / 2 + 0.2 * stay AS hc, 0.7 + 0.2 * abs(d1_z) / 3 + 0.1 * good_regime::INT AS dc FROM c0),
 c2 AS (SELECT *, CASE WHEN hc IS NOT NULL THEN greatest(0, least(1, hc)) END AS h1_confidence, CASE WHEN dc IS NOT NULL THEN greatest(0, least(1, dc)) END AS d1_confidence FROM c1),
 c3 AS (SELECT *, CASE WHEN coalesce(h1_confidence >= 0.7, false) AND coalesce(d1_confidence >= 0.8, false) THEN 0.6 * h1_signal + 0.4 * d1_signal WHEN coalesce(h1_confidence >= 0.7, false) THEN h1_signal * 0.9
  WHEN coalesce(d1_confidence >= 0.8, false) THEN d1_signal * 0.6 ELSE 0 END AS combined_signal, coalesce(1 / (1 + {full('stddev_samp(hr)', 'hr', 24)}), 0.5) AS volatility_factor FROM c2),
 c4 AS (SELECT *, 0.1 * volatility_factor * abs(combined_signal) AS position_size FROM c3),
 c5 AS (SELECT *, least(CASE WHEN coalesce(abs(h1_signal) > 0, false) THEN position_size ELSE 0 END, 0.3) AS h1_exposure, least(CASE WHEN coalesce(abs(d1_signal) > 0, false) THEN position_size ELSE 0 END, 0.7) AS d1_exposure FROM c4),
 cm AS (SELECT *, least(h1_exposure + d1_exposure, 1.0) AS total_exposure, least(h1_exposure + d1_exposure, 1.0) * sign(combined_signal) AS final_position FROM c5)"""
HOUR = dict(strs=["pair"], second="ts")


def fast(s, d):
    return shared(s, d, "fast", _fast)


def slow(s, d):
    return shared(s, d, "slow", _slow)


def combined(s, d):
    return shared(s, d, "combined", lambda a, b: T.combine_timeframes(fast(a, b), slow(a, b)))


case("t1_align_timeframes", lambda s, d: T.align(fast(s, d), slow(s, d)), COMBINED, "SELECT * FROM al", **HOUR, ints=["h1_signal"], floats=["d1_signal", "h1_z", "d1_z"])
case("t2_t3_confidence", combined, COMBINED, "SELECT * FROM cm", **HOUR, floats=["h1_confidence", "d1_confidence"])
case("t4_t5_combine_and_size", combined, COMBINED, "SELECT * FROM cm", **HOUR, floats=["combined_signal", "h1_exposure", "d1_exposure", "total_exposure", "final_position"])


def _fallback(s, d):
    return T.with_fallback(fast(s, d), slow(s, d).filter(F.col("pair") == "click_view"))


case(
    "t6_single_timeframe", _fallback, TWO,
    "SELECT pair, ts, signal * 0.6 AS combined_signal, 'h1_only' AS signal_source FROM fast WHERE pair NOT IN (SELECT pair FROM slow WHERE pair = 'click_view')",
    strs=["pair", "signal_source"], second="ts", floats=["combined_signal"],
)
case(
    "t7_signal_statistics", lambda s, d: T.statistics(combined(s, d)), COMBINED,
    "SELECT pair, count(*) AS total_signals, count(*) FILTER (WHERE combined_signal <> 0) AS active_signals, avg(abs(final_position)) AS avg_position_size, max(total_exposure) AS max_exposure FROM cm GROUP BY pair",
    strs=["pair"], ints=["total_signals", "active_signals"], floats=["avg_position_size", "max_exposure"],
)
case("t8_hourly_end_to_end", _fast, TWO, "SELECT * FROM fast", **HOUR, ints=["signal"], floats=["spread_z"])
case("t9_daily_end_to_end", _slow, TWO, "SELECT * FROM slow", strs=["pair"], day="ts", ints=["signal"], floats=["spread_z"])

# --- features and labels --------------------------------------------------------------------------


def spread_table(s, d):
    return shared(s, d, "spreads", lambda a, b: trim(zbars(a, b)))


def spread_seg(s, d, n):
    return segment(spread_table(s, d), n)


def _feature_sql(windows) -> str:
    cols = [f"{full(f'stddev_samp({r})', r, n)} AS {leg}_vol_{n}, {full(f'avg({leg}_price)', f'{leg}_price', n)} AS {leg}_ma_{n}" for n in windows for leg, r in (("fx", "rf"), ("comd", "rc"))]
    return ", ".join(cols)


ZR = f"""WITH {Q.SPREAD}, zr AS (SELECT *, fx_price / lag(fx_price) {Q.Q} - 1 AS rf, comd_price / lag(comd_price) {Q.Q} - 1 AS rc FROM zs)"""


def _logged(df: DataFrame) -> DataFrame:
    """Price means as logarithms: the means themselves end on rounding ties."""
    return df.withColumns({c: F.ln(c) for c in df.columns if "_ma_" in c})


for _v, _ws in E.WINDOW_SETS.items():
    _names = [f"{leg}_{k}_{n}" for n in _ws for leg in ("fx", "comd") for k in ("vol", "ma")]
    case(
        f"m1_strategy_features_{_v}", lambda s, d, ws=_ws: _logged(trim(E.strategy_features(spread_seg(s, d, max(ws) + 1), ws))), ZR,
        f"SELECT * REPLACE ({', '.join(f'ln({n}) AS {n}' for n in _names if '_ma_' in n)}) FROM (SELECT *, {_feature_sql(_ws)} FROM zr) WHERE spread_z IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in _names)}", **DAY, floats=_names,
    )
FEATS = [f"z_lag_{k}" for k in (1, 2, 3, 5)] + [f"spread_{k}_{n}" for n in (5, 10, 20) for k in ("mean", "std")] + ["fx_returns", "comd_returns", "fx_volatility", "comd_volatility"]
FSQL = f"""{ZR}, ff AS (SELECT *, {', '.join(f'lag(spread_z, {k}) {Q.Q} AS z_lag_{k}' for k in (1, 2, 3, 5))}, {', '.join(f"{full('avg(spread)', 'spread', n)} AS spread_mean_{n}, {full('stddev_samp(spread)', 'spread', n)} AS spread_std_{n}" for n in (5, 10, 20))},
 isodow(ts) - 1 AS day_of_week, month(ts) AS month, rf AS fx_returns, rc AS comd_returns, {full('stddev_samp(rf)', 'rf', 20)} AS fx_volatility, {full('stddev_samp(rc)', 'rc', 20)} AS comd_volatility FROM zr),
 ft AS (SELECT * FROM ff WHERE spread_z IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in FEATS)})"""


def filter_table(s, d):
    return shared(s, d, "filter_features", lambda a, b: trim(E.filter_features(spread_seg(a, b, 26))))


case("m2_filter_features", lambda s, d: trim(E.filter_features(spread_seg(s, d, 26))), FSQL, "SELECT * FROM ft", **DAY, ints=["day_of_week", "month"], floats=FEATS)
LSQL = f"lf AS (SELECT pair, ts, lead(spread, 5) {Q.Q} / nullif(spread, 0) - 1 AS fr, lead(ts, 5) {Q.Q} AS nts FROM zs)"


def labels(s, d):
    return E.forward_labels(spread_seg(s, d, 7)).filter("own").drop("seg", "own")


case(
    "m3_forward_labels", lambda s, d: labels(s, d).filter("label IS NOT NULL"), f"WITH {Q.SPREAD}, {LSQL}",
    "SELECT pair, ts AS label_ts, CASE WHEN fr > 0 THEN 1 ELSE 0 END AS label FROM lf WHERE fr IS NOT NULL", strs=["pair"], day="label_ts", ints=["label"],
)
case(
    "m4_trade_labels", lambda s, d: E.trade_labels(B.trades(backtested(s, d))), Q.TRADES,
    'SELECT pair, trade_id, exit_date AS ts, CASE WHEN "return" > 0 THEN 1 ELSE 0 END AS label, "return" * sign(direction) AS signed_return FROM trades',
    strs=["pair"], day="ts", ints=["trade_id", "label"], floats=["signed_return"],
)

# --- models ---------------------------------------------------------------------------------------
XS = ["z_lag_1", "spread_mean_5", "spread_std_20", "fx_volatility", "comd_volatility"]


def training(s, d):
    def build(a, b):
        y = labels(a, b).select("pair", F.col("label_ts").alias("ts"), "label_end", F.col("label").cast("double").alias("label"), F.col("forward_change").alias("target"))
        # the target is a difference, defined for every bar with a future, also where the spread is near zero
        t = filter_table(a, b).join(y, ["pair", "ts"]).filter("label IS NOT NULL")
        return t.withColumn("row_id", F.xxhash64("pair", "ts")).withColumn("signal", F.when(F.col("spread_z") < 0, 1).otherwise(-1))

    return shared(s, d, "training", build)


def _filtered(s, d):
    """Every signal is filtered by a model of other times."""
    out, _ = CV.cross_fit(training(s, d), lambda t: L.fit_filter(t, XS), L.apply_filter)
    return out.groupBy("pair", "filtered_signal").agg(F.count(F.lit(1)).alias("n"), F.avg("p_win").alias("p_win"))


case("m5_signal_filter", _filtered, strs=["pair"], ints=["filtered_signal", "n"], floats=["p_win"], dec=4)


OLS_WINDOW = 90


def placed(s, d, lookback: int = 1):
    """Training rows in segments, with their place in the series."""
    off, row = position()
    return segment(training(s, d), lookback).withColumn("rn", off + row)


def _ols_fit(s, d):
    return L.two_factor_ols(L.last_rows(trim(placed(s, d)), "rn", OLS_WINDOW), "target", "z_lag_1", "spread_std_20")


MT = f"{FSQL}, {LSQL}, lc5 AS (SELECT pair, ts, lead(spread, 5) {Q.Q} - spread AS target FROM zs), tr AS (SELECT ft.*, target FROM ft JOIN lf USING (pair, ts) JOIN lc5 USING (pair, ts) WHERE fr IS NOT NULL)"
case(
    "m6_linear_model", _ols_fit,
    f"""{MT}, lastw AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) <= 90),
 mo AS (SELECT pair, count(*) AS n, covar_pop(target, z_lag_1) AS y1, covar_pop(target, spread_std_20) AS y2, var_pop(z_lag_1) AS s11, var_pop(spread_std_20) AS s22, covar_pop(z_lag_1, spread_std_20) AS s12 FROM lastw GROUP BY pair)""",
    "SELECT pair, n, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b_z_lag_1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b_spread_std_20 FROM mo", strs=["pair"], ints=["n"], floats=["b_z_lag_1", "b_spread_std_20"],
)


def _last_state(s, d):
    """Final recursive estimate and final rolling correlation of each pair, used as predictors."""
    df = trim(segment(spread_table(s, d), 21).withColumn("c", R.corr(F.col("fx_price"), F.col("comd_price"), 20)))
    last = df.groupBy("pair").agg(F.max_by("c", "ts").alias("last_corr"), F.max_by("alpha", "ts").alias("alpha"), F.max_by("beta", "ts").alias("beta"), F.max_by("comd_price", "ts").alias("x"))
    return last.withColumns({"corr_pred": F.col("last_corr") * F.col("x"), "kalman_pred": F.ln("alpha") + F.col("beta") * F.ln("x")})


case(
    "m7_kalman_and_corr_models", _last_state, f"WITH {Q.SPREAD}, lc AS (SELECT *, {full('corr(fx_price, comd_price)', 'fx_price', 20)} AS c FROM zs)",
    "SELECT pair, arg_max(c, ts) * arg_max(comd_price, ts) AS corr_pred, ln(arg_max(alpha, ts)) + arg_max(beta, ts) * ln(arg_max(comd_price, ts)) AS kalman_pred FROM lc GROUP BY pair",
    strs=["pair"], floats=["corr_pred", "kalman_pred"],
)


#: Equal weights, as the reference configures them; the sequence model is not built.
ENSEMBLE = {"ols_pred": 0.2, "kalman_pred": 0.2, "corr_pred": 0.2, "gbt_pred": 0.2}


def simple_predictions(s, d):
    """The three models with closed forms: last-window least squares, recursive estimate and last correlation on the first feature."""

    def build(a, b):
        df = placed(a, b, H.rls_lookback(0.995) + 20)
        df = H.rls(df, F.col("target"), F.col(XS[0]), 0.995, 100.0, alpha="ka", beta="kb").withColumn("kc", R.corr(F.col(XS[0]), F.col("target"), 20))
        t = trim(df)
        state = t.groupBy("pair").agg(*[F.max_by(c, "ts").alias(f"last_{c}") for c in ("ka", "kb", "kc")])
        coef = L.last_window_ols(t, XS, "target", OLS_WINDOW, "rn")
        out = join_small(t.drop("ka", "kb", "kc", "rn"), state.join(coef.drop("n"), "pair"), ["pair"])
        ols = sum((F.col("coef")[i + 1] * F.col(x) for i, x in enumerate(XS)), F.col("coef")[0])
        return out.withColumns({"ols_pred": ols, "kalman_pred": F.col("last_ka") + F.col("last_kb") * F.col(XS[0]), "corr_pred": F.coalesce("last_kc", F.lit(0.0)) * F.col(XS[0])}).drop("coef", "last_ka", "last_kb", "last_kc")

    return shared(s, d, "simple_predictions", build)


def cross_fitted(s, d, name, fit):
    """Out-of-fold predictions ``pair, ts, <name>`` and the mean importances of the folds' models, fitted once per session."""

    def build(a, b):
        out, models = CV.cross_fit(training(a, b), lambda t: fit(t, XS, "target"), lambda m, t: m.transform(t).drop("features"))
        told = L.mean_importance(models, XS, out, name.removesuffix("_pred"))
        return out.select("pair", "ts", name).withColumn("_importance", F.lit(None).cast("map<string,double>")).unionByName(
            told.select(F.lit(None).cast("string").alias("pair"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias(name), F.create_map("feature", "importance").alias("_importance"))
        )

    rows = shared(s, d, f"cross_fitted_{name}", build)
    told = rows.filter("_importance IS NOT NULL").select(F.explode("_importance").alias("feature", "importance"))
    return rows.filter("_importance IS NULL").drop("_importance"), told


def predictions(s, d):
    """Predictions of all models; those of the boosted trees and of the linear model over all rows are out of fold."""

    def build(a, b):
        trees, _ = cross_fitted(a, b, "gbt_pred", L.fit_boosted)
        return simple_predictions(a, b).join(trees, ["pair", "ts"]).withColumn("ensemble_pred", L.weighted(ENSEMBLE))

    return shared(s, d, "predictions", build)


def _scores(pred):
    return lambda s, d: L.regression_scores(predictions(s, d), "target", pred, ("pair",))


case("m7b_boosted_trees", _scores("gbt_pred"), strs=["pair"], ints=["n"], floats=["mse", "mae", "r2"], dec=4)
case("m8_g13_ensemble", _scores("ensemble_pred"), strs=["pair"], ints=["n"], floats=["mse", "mae", "r2"], dec=4)


def _signals_with_ensemble(s, d):
    """Signals of the plan with the ensemble's prediction for their bar; bars without one count as zero."""
    sig = S.signals_table(I.pair_bars(s, d), RULES)
    both = sig.join(predictions(s, d).select("pair", "ts", "ensemble_pred"), ["pair", "ts"], "left").withColumn("ensemble_pred", F.coalesce("ensemble_pred", F.lit(0.0)))
    return both.groupBy("pair", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("ensemble_pred").alias("mean_pred"), F.count_if(F.col("signal") * F.col("ensemble_pred") > 0).alias("agreeing"))


case("g13_signals_with_ensemble", _signals_with_ensemble, strs=["pair"], ints=["signal", "n", "agreeing"], floats=["mean_pred"], dec=4)
RUNQ = "OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)"
case(
    "m8_kalman_and_corr_on_features", lambda s, d: simple_predictions(s, d).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg("kalman_pred").alias("kalman_pred"), F.avg("corr_pred").alias("corr_pred")),
    f"""{MT}, kn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM tr), ks AS (SELECT *, sum(pow(0.995, -i)) {RUNQ} AS a0, sum(pow(0.995, -i) * z_lag_1) {RUNQ} AS a1, sum(pow(0.995, -i) * z_lag_1 * z_lag_1) {RUNQ} AS a2,
  sum(pow(0.995, -i) * target) {RUNQ} AS b0, sum(pow(0.995, -i) * z_lag_1 * target) {RUNQ} AS b1, corr(z_lag_1, target) OVER (PARTITION BY pair ORDER BY ts ROWS 19 PRECEDING) AS c FROM kn),
 km AS (SELECT *, pow(0.995, i) * (a0 + 0.01) AS s0, pow(0.995, i) * a1 AS s1, pow(0.995, i) * (a2 + 0.01) AS s2, pow(0.995, i) * b0 AS r0, pow(0.995, i) * b1 AS r1 FROM ks),
 kl AS (SELECT pair, (r0 * s2 - s1 * r1) / (s0 * s2 - s1 * s1) AS ka, (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS kb, c FROM km QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) = 1)""",
    "SELECT pair, count(*) AS n, avg(ka + kb * z_lag_1) AS kalman_pred, avg(c * z_lag_1) AS corr_pred FROM tr JOIN kl USING (pair) GROUP BY pair", strs=["pair"], ints=["n"], floats=["kalman_pred", "corr_pred"],
)


def _importance(s, d):
    t = training(s, d)
    lin, gbt = L.fit_linear(t, XS, "target"), L.fit_boosted(t, XS, "target")
    return L.importance(lin, XS, t, "ols").unionByName(L.importance(gbt, XS, t, "gbt"))


case("m9_feature_importance", _importance, strs=["model", "feature"], floats=["importance"], dec=4)
case(
    "m10_regression_scores", lambda s, d: L.regression_scores(training(s, d).withColumn("guess", F.col("z_lag_1") / 10), "target", "guess", ("pair",)), MT,
    "SELECT pair, count(*) AS n, avg((target - z_lag_1 / 10) ** 2) AS mse, avg(abs(target - z_lag_1 / 10)) AS mae, 1 - avg((target - z_lag_1 / 10) ** 2) / var_pop(target) AS r2 FROM tr GROUP BY pair",
    strs=["pair"], ints=["n"], floats=["mse", "mae", "r2"],
)


def _permuted(s, d):
    t = training(s, d)
    return L.permutation_importance(L.fit_linear(t, XS, "target"), t, XS, "target", "ols_pred", "row_id")


case("m11_permutation_importance", _permuted, strs=["feature"], floats=["importance"], dec=4)


def _model_report(s, d):
    """Scores of every model and, where it has any, its importances: a row per pair, model and feature."""
    linear, linear_told = cross_fitted(s, d, "linear_pred", lambda t, x, y: L.fit_linear(t, x, y, "linear_pred"))
    _, trees_told = cross_fitted(s, d, "gbt_pred", L.fit_boosted)
    told = linear_told.withColumn("model", F.lit("linear_pred")).unionByName(trees_told.withColumn("model", F.lit("gbt_pred")))
    p = predictions(s, d).join(linear, ["pair", "ts"])
    return L.report(p, "target", [*ENSEMBLE, "linear_pred", "ensemble_pred"], told)


case("m12_diagnostics_report", _model_report, strs=["pair", "model", "feature"], ints=["n"], floats=["mse", "mae", "r2", "importance"], dec=4)

# --- quality --------------------------------------------------------------------------------------
case(
    "v1_series_validation", lambda s, d: V.series_report(spread_table(s, d), "spread_z", 30), f"WITH {Q.SPREAD}",
    "SELECT pair, count(*) AS n, count(*) FILTER (WHERE spread_z IS NULL) AS n_null, 0 AS n_not_finite, count(*) FILTER (WHERE spread_z <= 0) AS n_not_positive, min(spread_z) AS min_value, max(spread_z) AS max_value, count(*) >= 30 AND count(spread_z) = count(*) AS valid FROM zs GROUP BY pair",
    strs=["pair"], ints=["n", "n_null", "n_not_finite", "n_not_positive", "valid"], floats=["min_value", "max_value"],
)
case(
    "v2_range_checks", lambda s, d: V.range_report(I.ticks(s, d), "price", 0.5, 200.0),
    "", "SELECT event_type AS pair, count(*) FILTER (WHERE value < 0.5 OR value > 200) AS out_of_range, count(*) FILTER (WHERE value BETWEEN 0 AND 1) AS probability_like FROM events GROUP BY 1",
    strs=["pair"], ints=["out_of_range", "probability_like"],
)


def data_params(s, d):
    """Parameter rows whose values come from the data: windows from bar counts, thresholds from quantiles."""
    t = I.ticks(s, d)
    b = t.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).join(M.quantiles(t, "price", {"q": 0.9, "lo": 0.2}), "pair")
    return b.select(
        "pair", F.floor(F.col("n") / 20).cast("int").alias("beta_window"), F.floor(F.col("n") / 100).cast("int").alias("z_window"), F.lit(20).alias("corr_window"),
        (F.col("q") / 20).alias("entry_z"), (F.col("lo") / 10).alias("exit_z"), F.lit(3.5).alias("stop_z"), F.lit(0.15).alias("min_abs_corr"),
    )


PRM = """prm AS (SELECT event_type AS pair, floor(count(*) / 20)::INT AS beta_window, floor(count(*) / 100)::INT AS z_window, 20 AS corr_window, quantile_cont(value, 0.9) / 20 AS entry_z, quantile_cont(value, 0.2) / 10 AS exit_z, 3.5::DOUBLE AS stop_z, 0.15::DOUBLE AS min_abs_corr FROM events GROUP BY 1)"""
_HAVE = ["beta_window", "z_window", "corr_window", "entry_z", "exit_z", "stop_z", "min_abs_corr"]
# the registry's ranges as the reference states them, typed here once more
_RULES = """('signal_generation', 'entry_z', 0.1, 5.0), ('signal_generation', 'exit_z', 0.0, 2.0), ('signal_generation', 'stop_z', 1.0, 10.0),
 ('signal_generation', 'beta_window', 10.0, 500.0), ('signal_generation', 'z_window', 5.0, 200.0), ('backtest', 'entry_z', 0.1, 5.0), ('backtest', 'exit_z', 0.0, 2.0),
 ('backtest', 'stop_z', 1.0, 10.0), ('feature_calculation', 'corr_window', 5.0, 500.0), ('feature_calculation', 'min_abs_corr', 0.0, 1.0)"""
_LONG = " UNION ALL ".join(f"SELECT pair, '{c}' AS param, {c}::DOUBLE AS value FROM prm" for c in _HAVE)
case(
    "v3_v4_parameter_rules", lambda s, d: V.params_report(data_params(s, d), V.rule_table(s)), f"WITH {PRM}, rules(module, param, lo, hi) AS (VALUES {_RULES})",
    f"SELECT pair, module, param, value, value BETWEEN lo AND hi AS valid FROM ({_LONG}) JOIN rules USING (param)", strs=["pair", "module", "param"], ints=["valid"], floats=["value"],
)
case("v3_threshold_order", lambda s, d: V.threshold_order(data_params(s, d)), f"WITH {PRM}", "SELECT pair, stop_z > entry_z AND entry_z > exit_z AS ordered FROM prm", strs=["pair"], ints=["ordered"])
case(
    "v5_alignment", lambda s, d: V.alignment_report(
        I.daily_bars(s, d).filter("symbol = 'A'").select(F.lit("A_orders").alias("pair"), "ts"), I.daily_orders(s, d).select(F.lit("A_orders").alias("pair"), "ts")),
    f"WITH {PAIRS}, o AS (SELECT DISTINCT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts FROM orders), j AS (SELECT b.ts AS x, o.ts AS y FROM (SELECT * FROM bars WHERE symbol = 'A') b FULL JOIN o ON b.ts = o.ts)",
    "SELECT 'A_orders' AS pair, count(x) AS n_a, count(y) AS n_b, count(*) FILTER (WHERE x = y) AS n_common, count(*) FILTER (WHERE x = y) / least(count(x), count(y)) AS overlap, abs(count(x) - count(y)) <= greatest(10, greatest(count(x), count(y)) * 0.01) AND count(*) FILTER (WHERE x = y) / least(count(x), count(y)) >= 0.8 AS aligned FROM j",
    strs=["pair"], ints=["n_a", "n_b", "n_common", "aligned"], floats=["overlap"],
)


def _nested(s, d):
    """A nested column read by path with defaults."""
    t = I.table(s, d, "events").select(F.from_json("props", "k int, opts struct<depth:int>").alias("p"), "event_type")
    return t.groupBy(F.col("event_type").alias("pair")).agg(F.sum(F.coalesce("p.k", F.lit(0))).alias("k"), F.sum(F.coalesce("p.opts.depth", F.lit(3))).alias("depth"))


case("v6_path_with_default", _nested, "", "SELECT event_type AS pair, sum(coalesce((props->>'$.k')::INT, 0)) AS k, sum(coalesce((props->>'$.opts.depth')::INT, 3)) AS depth FROM events GROUP BY 1", strs=["pair"], ints=["k", "depth"])
case(
    "v7_index_and_frequency", lambda s, d: V.spacing_report(seg(s, d, 2)), f"WITH {PAIRS}, g AS (SELECT pair, date_diff('day', lag(ts) {Q.Q}, ts) AS gap FROM pairs)",
    "SELECT pair, max(gap) AS max_gap_days, count(*) FILTER (WHERE gap = 0) AS duplicate_ts, avg((gap = 1)::INT) AS daily_share FROM g GROUP BY pair", strs=["pair"], ints=["duplicate_ts"], floats=["max_gap_days", "daily_share"],
)


def _scaled(s, d):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    t = L.assembled(filter_table(s, d).select("pair", "ts", *XS), XS)
    sc = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(t).transform(t)
    return sc.withColumn("a", vector_to_array("scaled")).select("pair", "ts", *[F.col("a")[i].alias(c) for i, c in enumerate(XS)])


case(
    "v8_scaling", _scaled, FSQL, "SELECT pair, ts, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in XS) + " FROM ft", **DAY, floats=XS,
)
case(
    "v9_feature_correlations", lambda s, d: V.correlations(filter_table(s, d), XS), FSQL,
    " UNION ALL ".join(f"SELECT pair, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM ft GROUP BY pair" for i, a in enumerate(XS) for b in XS[i:]), strs=["pair", "a", "b"], floats=["corr"],
)

# --- streams --------------------------------------------------------------------------------------


def run_stream(s: SparkSession, build, df: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """Drive a stream over ``df`` landed in time order, and read what it wrote.

    Each slice of time is landed as its tasks write it and the stream is run to
    the end of what is there, as a feed that is picked up from time to time; the
    state goes on from one run to the next.
    """
    ensure_checkpoint_dir(s)
    base = f"{s.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    us = F.unix_micros(order)
    df = stage(df)
    cuts = df.select(us.cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.001)
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):  # oldest first
        part = df if lo is None else df.filter(us >= lo)
        part = part if hi is None else part.filter(us < hi)
        part.write.mode("append").parquet(f"{base}/in")
        out = build(s.readStream.schema(df.schema).parquet(f"{base}/in")).writeStream.format("parquet")
        out = out.option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append")
        out.trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


def _live_bars(s, d):
    return run_stream(s, live.live_bars, I.tick_bars(s, d), "ts")


LIVE = f"{HOURLY}, mx AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)"
case(
    "z1_streaming_bars", _live_bars, f"WITH {LIVE}", "SELECT h.* FROM hourly h, mx WHERE h.ts + INTERVAL 1 HOUR <= mx.wm",
    strs=["symbol"], second="ts", ints=["volume"], floats=["open", "high", "low", "close"],
)
case(
    "z2_streaming_sliding_stats",
    lambda s, d: run_stream(s, live.live_stats, I.tick_bars(s, d), "ts").withColumn("mean", F.ln("mean")),
    "WITH mx AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events), ends AS (SELECT event_type AS symbol, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS ts, value FROM events)",
    "SELECT symbol, ts, count(*) AS n, ln(avg(value)) AS mean, stddev_samp(value) AS std FROM ends WHERE ts <= (SELECT wm FROM mx) GROUP BY 1, 2", strs=["symbol"], second="ts", ints=["n"], floats=["mean", "std"],
)


def _live_tags(s, d):
    b = I.pair_bars(s, d)
    days = Cal.blackout_days(I.event_calendar(s, d))
    return run_stream(s, lambda t: live.tag_live(t, days), b, "ts")


case(
    "z5_streaming_blackouts", _live_tags, f"WITH {PAIRS}, {CALENDAR}",
    "SELECT p.*, EXISTS (SELECT 1 FROM calendar c WHERE CAST(p.ts AS DATE) >= c.event_date AND CAST(p.ts AS DATE) < c.event_date + c.impact_days) AS is_blackout FROM pairs p", strs=["pair"], day="ts", ints=["is_blackout"],
)
STATE_CONF = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _with_state_store(s, run):
    old = s.conf.get(STATE_CONF[0], None)
    s.conf.set(*STATE_CONF)
    try:
        return run()
    finally:
        s.conf.unset(STATE_CONF[0]) if old is None else s.conf.set(STATE_CONF[0], old)


def _live_signals(s, d):
    b = I.pair_bars(s, d)
    return _with_state_store(s, lambda: run_stream(s, live.live_signals, b, "ts", 2))


FREE = f"WITH RECURSIVE {Q.SPREAD}, {Q.flags_sql('zs', '1.5', '0.5', '3.5', 'true')}, {fold_sql('coded')}"
case("z3_streaming_signals", _live_signals, FREE, "SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn)", **DAY, ints=["signal"], floats=["spread", "spread_z"])


def _live_risk(s, d):
    p = backtested(s, d).select("pair", "ts", "pnl")
    return _with_state_store(s, lambda: run_stream(s, live.live_risk, p, "ts", 2))


case(
    "z4_streaming_risk", _live_risk, f"{Q.BACKTEST}, rk AS (SELECT pair, ts, pnl AS daily_pnl, sum(pnl) OVER (PARTITION BY pair, date_trunc('week', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS weekly_pnl FROM bt)",
    "SELECT *, daily_pnl < -0.02 AS daily_breach, weekly_pnl < -0.05 AS weekly_breach FROM rk", **DAY, ints=["daily_breach", "weekly_breach"], floats=["daily_pnl", "weekly_pnl"],
)


# --- streams whose rows come out of order ---------------------------------------------------------
LATE_DAYS = 30


def _disordered(df: DataFrame) -> DataFrame:
    """Rows with the time at which they arrive: up to three weeks after their own."""
    lag = F.pmod(F.xxhash64("pair", "ts"), F.lit(21 * 24)) * F.expr("INTERVAL 1 HOUR")
    return df.withColumn("arrives", F.col("ts") + lag)


def _live_disordered(s, d):
    bars = _disordered(I.pair_bars(s, d))
    return _with_state_store(s, lambda: run_stream(s, lambda t: live.live_signals(t.drop("arrives"), late=f"{LATE_DAYS} days"), bars, "arrives", 3))


case(
    "z3_disordered_signals", _live_disordered, f"{FREE}, mx AS (SELECT max(ts) - INTERVAL {LATE_DAYS} DAY AS wm FROM pairs)",
    "SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn), mx WHERE coded.ts <= wm", **DAY, ints=["signal"], floats=["spread", "spread_z"],
)
STAKE = 5.0


def _live_account(s, d):
    rows = _disordered(backtested(s, d).select("pair", "ts", "pnl", "equity", "fx_position", "comd_position", "fx_price", "comd_price").withColumn("account", F.lit("main")))
    limits = K.Limits(cooldown_days=2)
    return _with_state_store(s, lambda: run_stream(s, lambda t: live.live_account_risk(t, limits, STAKE, f"{LATE_DAYS} days"), rows, "arrives", 3))


_FLAGS = [*BREACHES, "breaker_active", "exposure_breach", "can_trade"]
case(
    "z4_account_risk", _live_account,
    f"""{RISK}, mx AS (SELECT max(ts) - INTERVAL {LATE_DAYS} DAY AS wm FROM bt), ex AS (SELECT ts, sum(abs(fx_position * fx_price) + abs(comd_position * comd_price)) / {STAKE} AS e FROM bt GROUP BY ts),
     rt AS (SELECT rc.*, coalesce(e, 0) AS exposure, coalesce(e > 0.5, false) AS exposure_breach, NOT (breaker_active OR drawdown_breach OR daily_breach OR weekly_breach OR account_daily_breach OR account_weekly_breach) AS can_trade FROM rc JOIN ex USING (ts))""",
    "SELECT rt.* FROM rt, mx WHERE ts <= wm", **DAY, ints=_FLAGS, floats=["daily_pnl", "weekly_pnl", "account_daily", "account_weekly", "exposure"],
)
