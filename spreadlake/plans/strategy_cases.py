"""Cases: hedge ratios, structure, regimes, signals, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import configured as CF
from spreadlake.operators import hedge as H
from spreadlake.operators import hidden_states
from spreadlake.operators import regime as G
from spreadlake.operators import signals as S
from spreadlake.operators import structure as C
from spreadlake.operators.asof import asof_join
from spreadlake.plans import inputs as I
from spreadlake.plans import strategy_sql as Q
from spreadlake.plans.registry import HOURLY, PAIRS, RETURNS, TICKS, VIX, case, fold_sql, full, spread_sql, w
from spreadlake.series import PAIR, Frame, segment, trim
from spreadlake.sources import config as X

SYM = Frame(keys=("symbol", "seg"))
RULES = S.Rules()
DAY = dict(strs=["pair"], day="ts")
WP = f"WITH {PAIRS}"
WS = f"WITH {Q.SPREAD}"


def seg(s: SparkSession, d: str, n: int) -> DataFrame:
    return segment(I.pair_bars(s, d), n, reuse=True)


def spreads(s: SparkSession, d: str) -> DataFrame:
    return H.with_spread(seg(s, d, RULES.lookback))


def zbars(s: SparkSession, d: str) -> DataFrame:
    return S.spread_and_z(seg(s, d, RULES.lookback), RULES)


# --- hedge ----------------------------------------------------------------------------------------
LNS = "lns AS (SELECT *, ln(fx_price) AS ly, ln(comd_price) AS lx FROM pairs)"
case(
    "h1_rolling_ols", lambda s, d: trim(H.rolling_ols(seg(s, d, 61), F.ln("fx_price"), F.ln("comd_price"), 60)),
    f"{WP}, {LNS}", f"SELECT pair, ts, {full('regr_intercept(ly, lx)', 'ly', 60)} AS alpha, {full('regr_slope(ly, lx)', 'ly', 60)} AS beta FROM lns",
    **DAY, floats=["alpha", "beta"],
)
case(
    "h2_recursive_ls", lambda s, d: trim(H.rls(seg(s, d, H.rls_lookback(0.99)), F.ln("fx_price"), F.ln("comd_price"))),
    f"{WP}, {spread_sql(0.99, 1000.0)}", "SELECT pair, ts, la AS alpha, lb AS beta FROM hedge", **DAY, floats=["alpha", "beta"],
)
TICKF = Frame(order=("ts", "event_id"))


def _tick_rls(s, d):
    """Each tick on the one before it, with a short memory: as many bars as there are events."""
    df = segment(I.ticks(s, d), H.rls_lookback(0.99) + 1, grain_days=1)
    before = F.coalesce(F.lag("price").over(TICKF.ordered()), F.col("price"))
    return trim(H.rls(df.withColumn("before", before), F.col("price"), F.col("before"), 0.99, 1000.0, TICKF))


TO = "OVER (PARTITION BY pair ORDER BY ts, event_id)"
case(
    "h2_recursive_ls_ticks", _tick_rls,
    f"WITH {TICKS}, tx AS (SELECT pair, event_id, ts, price AS fx, coalesce(lag(price) {TO}, price) AS comd FROM ticks), num AS (SELECT *, row_number() {TO} AS i FROM tx), "
    f"sums AS (SELECT *, sum(pow(0.99, -i)) {TO} AS a0, sum(pow(0.99, -i) * comd) {TO} AS a1, sum(pow(0.99, -i) * comd * comd) {TO} AS a2, sum(pow(0.99, -i) * fx) {TO} AS b0, sum(pow(0.99, -i) * comd * fx) {TO} AS b1 FROM num), "
    "mom AS (SELECT *, pow(0.99, i) * (a0 + 0.001) AS s0, pow(0.99, i) * a1 AS s1, pow(0.99, i) * (a2 + 0.001) AS s2, pow(0.99, i) * b0 AS r0, pow(0.99, i) * b1 AS r1 FROM sums)",
    "SELECT pair, event_id, (r0 * s2 - s1 * r1) / (s0 * s2 - s1 * s1) AS alpha, (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS beta FROM mom",
    strs=["pair"], ints=["event_id"], floats=["alpha", "beta"],
)
case("h3_spread", lambda s, d: trim(spreads(s, d)), WS, "SELECT * FROM sp", **DAY, floats=["alpha", "beta", "spread"])
case(
    "h3_spread_ols", lambda s, d: trim(H.with_spread(seg(s, d, 62), 60, use_rls=False)),
    f"{WP}, {LNS}, o AS (SELECT *, greatest(exp({full('regr_intercept(ly, lx)', 'ly', 60)}), 1e-8) AS alpha, greatest(-10, least(10, {full('regr_slope(ly, lx)', 'ly', 60)})) AS b, count(ly) {w(60)} AS n FROM lns)",
    "SELECT pair, ts, CASE WHEN n >= 60 THEN alpha END AS alpha, CASE WHEN n >= 60 THEN b END AS beta, CASE WHEN n >= 60 THEN fx_price - alpha * pow(comd_price, b) END AS spread FROM o",
    **DAY, floats=["alpha", "beta", "spread"],
)
case(
    "h4_residuals", lambda s, d: trim(H.with_residuals(spreads(s, d))),
    f"""{WS}, r0 AS (SELECT *, spread - {full('avg(spread)', 'spread', 20)} AS residual FROM sp),
     r1 AS (SELECT *, count(residual) {w(20)} AS n, median(residual) {w(20)} AS med, mad(residual) {w(20)} AS md, {full('stddev_samp(residual)', 'residual', 20)} AS vol FROM r0),
     r2 AS (SELECT *, avg(vol) OVER (PARTITION BY pair) AS mv FROM r1)""",
    """SELECT pair, ts, residual, CASE WHEN n >= 20 AND md <> 0 THEN (residual - med) / (1.4826 * md + 1e-12) END AS residual_z,
       CASE WHEN vol IS NOT NULL THEN greatest(0.95, least(0.999, 0.99 - 0.1 * vol / mv)) END AS adaptive_lambda FROM r2""",
    **DAY, floats=["residual", "residual_z", "adaptive_lambda"],
)
WINDOWS = list(range(20, 121, 10))


def _search(s, d):
    f = Frame(keys=("pair", "window", "seg"))
    long = H.window_search(seg(s, d, 160), WINDOWS)
    score = C.unit_root_test(long, "spread", f).join(C.hurst(long, "spread", f, use_std=True), ["pair", "window"])
    score = score.withColumn("score", F.col("adf_p") + F.abs(F.col("hurst") - 0.5))
    return score.groupBy("pair").agg(F.min_by("window", F.struct("score", "window")).alias("window"), F.min("score").alias("score"))


_W = " UNION ALL ".join(
    f'SELECT pair, ts, {n} AS "window", fx_price - exp({full("regr_intercept(ly, lx)", "ly", n)}) * pow(comd_price, greatest(-10, least(10, {full("regr_slope(ly, lx)", "ly", n)}))) AS spread, count(ly) {w(n)} AS n_w FROM lns'
    for n in WINDOWS
)
case(
    "h5_window_search", _search,
    f"""{WP}, {LNS}, ws0 AS ({_W}), ws AS (SELECT pair, ts, "window", CASE WHEN n_w >= "window" THEN spread END AS spread FROM ws0), {Q.adf_sql("ws", 'pair, "window"')},
     {Q.hurst_sql("ws", 2.0, "stddev_pop", 'pair, "window"')}, sc AS (SELECT pair, "window", adf_p + abs(hurst - 0.5) AS score FROM adf JOIN hu USING (pair, "window"))""",
    'SELECT pair, arg_min("window", (score, "window")) AS "window", min(score) AS score FROM sc GROUP BY pair', strs=["pair"], ints=["window"], floats=["score"],
)
case(
    "h6_spread_return", lambda s, d: trim(G.spread_return(spreads(s, d))), WS,
    f"SELECT pair, ts, ln(fx_price / lag(fx_price) {Q.Q}) - beta * ln(comd_price / lag(comd_price) {Q.Q}) AS spread_ret FROM sp", **DAY, floats=["spread_ret"],
)

# --- structure ------------------------------------------------------------------------------------
case(
    "c1_unit_root_test", lambda s, d: C.unit_root_test(spreads(s, d)), f"{WS}, {Q.adf_sql('sp')}", "SELECT * FROM adf",
    strs=["pair"], ints=["n_obs", "used_lag"], floats=["adf_stat", "adf_p"],
)
case("c2_unit_root_auto_lag", lambda s, d: C.unit_root_test_auto(spreads(s, d)), strs=["pair"], ints=["n_obs", "used_lag"], floats=["adf_stat", "adf_p"])
case(
    "c3_half_life", lambda s, d: C.half_life(spreads(s, d)), f"{WS}, {Q.half_life_sql('sp', 100.0)}", "SELECT * FROM hl", strs=["pair"], floats=["half_life"],
)
case("c4_hurst", lambda s, d: C.hurst(spreads(s, d)), f"{WS}, {Q.hurst_sql('sp', 0.5, 'var_pop')}", "SELECT * FROM hu", strs=["pair"], floats=["hurst"])
case(
    "c5_hurst_std_scale", lambda s, d: C.hurst(spreads(s, d), use_std=True), f"{WS}, {Q.hurst_sql('sp', 2.0, 'stddev_pop')}", "SELECT * FROM hu",
    strs=["pair"], floats=["hurst"],
)
case(
    "c6_cointegration", lambda s, d: C.cointegration(seg(s, d, 4)),
    f"{WP}, cb AS (SELECT pair, regr_slope(fx_price, comd_price) AS b FROM pairs GROUP BY pair), cs AS (SELECT p.pair, ts, fx_price - b * comd_price AS spread, b FROM pairs p JOIN cb USING (pair)), {Q.adf_sql('cs')}",
    "SELECT pair, b AS coint_beta, n_obs, adf_stat, adf_p, adf_p < 0.05 AS is_cointegrated FROM adf JOIN cb USING (pair)",
    strs=["pair"], ints=["n_obs", "is_cointegrated"], floats=["coint_beta", "adf_stat", "adf_p"],
)
case(
    "c7_structural_flag", lambda s, d: C.structural_flag(spreads(s, d)), f"{WS}, {Q.STRUCT}", "SELECT * FROM stats",
    strs=["pair"], ints=["n_obs", "coint_ok"], floats=["adf_p", "half_life", "hurst"],
)

# --- regimes --------------------------------------------------------------------------------------
FX, CM = "fx_price", "comd_price"
case(
    "r1_correlation_gate", lambda s, d: trim(seg(s, d, 61).withColumn("ok", G.correlation_gate(F.col(FX), F.col(CM), 60, 0.15))),
    WP, f"SELECT pair, ts, coalesce(abs({full('corr(fx_price, comd_price)', FX, 60)}) >= 0.15, false) AS ok FROM pairs", **DAY, ints=["ok"],
)


def _rets(s, d, n, first_zero=False):
    return G.with_returns(seg(s, d, n + 2), {"rf": FX, "rc": CM}, first_zero=first_zero)


WR = f"{WP}, {RETURNS}"
case(
    "r2_return_correlation_gate", lambda s, d: trim(_rets(s, d, 60).withColumn("ok", G.return_correlation_gate(F.col("rf"), F.col("rc")))),
    WR, f"SELECT pair, ts, coalesce(abs({full('corr(rf, rc)', 'rf', 60)}) >= 0.15, false) AS ok FROM rets", **DAY, ints=["ok"],
)
VR = full("stddev_samp(coalesce(rf, 0))", "coalesce(rf, 0)", 20)
case(
    "r3_volatility_regime", lambda s, d: trim(_rets(s, d, 20, True).withColumn("state", G.volatility_regime(F.col("rf"), 20, 0.35, 0.25))),
    WR, f"SELECT pair, ts, CASE WHEN {VR} <= 0.25 THEN 0 WHEN {VR} >= 0.35 THEN 2 ELSE 1 END AS state FROM rets", **DAY, ints=["state"],
)
TR = full("sum(coalesce(rf, 0))", "coalesce(rf, 0)", 20)
case(
    "r4_trend_regime", lambda s, d: trim(_rets(s, d, 20, True).withColumn("state", G.trend_regime(F.col("rf"), 20, 0.9))),
    WR, f"SELECT pair, ts, CASE WHEN {TR} > 0.9 THEN 1 WHEN {TR} < -0.9 THEN -1 ELSE 0 END AS state FROM rets", **DAY, ints=["state"],
)
case(
    "r5_hidden_regime", lambda s, d: trim(hidden_states.hidden_regime(G.spread_return(spreads(s, d)), "spread_ret", window=126)).groupBy("pair", "hmm_state").agg(F.count(F.lit(1)).alias("n")),
    strs=["pair"], ints=["hmm_state", "n"],
)


def _vix(s, d):
    state = G.volatility_regime(F.col("rf"), 20, 0.35, 0.25)
    bars = trim(_rets(s, d, 20, True).withColumn("state", state)).select("pair", "ts", "state")
    vix = I.daily_orders(s, d).drop("pair")
    return bars.join(vix, "ts", "left").withColumn("shifted", G.vix_shift(F.col("state"), F.col("vix")))


case(
    "r6_vix_shift", _vix,
    f"{WR}, {VIX}, st AS (SELECT pair, ts, CASE WHEN {VR} <= 0.25 THEN 0 WHEN {VR} >= 0.35 THEN 2 ELSE 1 END AS state FROM rets)",
    "SELECT st.pair, st.ts, state, CASE WHEN coalesce(greatest(0, (vix - 20) / 10 * 0.2) > 0.3, false) THEN least(state + 1, 2) ELSE state END AS shifted FROM st LEFT JOIN vix ON vix.ts = st.ts",
    **DAY, ints=["state", "shifted"],
)
VC = full("stddev_samp(coalesce(rc, 0))", "coalesce(rc, 0)", 20)
case(
    "r7_combined_gate", lambda s, d: trim(G.combined_gate(seg(s, d, 64), corr_window=60, vol=(20, 0.35, 0.25), trend=(20, 0.9))),
    WR, f"""SELECT pair, ts, coalesce(abs({full('corr(fx_price, comd_price)', FX, 60)}) >= 0.15, false) AND coalesce({VR} < 0.35, true) AND coalesce({VC} < 0.35, true) AS regime_ok FROM rets""",
    **DAY, ints=["regime_ok"],
)


def with_vix(s, d):
    """Pair bars with the volatility index of their day."""
    return I.pair_bars(s, d).join(I.daily_orders(s, d).drop("pair"), "ts", "left")


def _state_gate(s, d):
    bars = G.with_returns(segment(with_vix(s, d), 64, reuse=True), {"rf": FX}, first_zero=True)
    state = G.vix_shift(G.volatility_regime(F.col("rf"), 20, 0.35, 0.25), F.col("vix"))
    return trim(G.combined_gate(bars.withColumn("state", state), corr_window=20, vol=None, state=F.col("state")))


case(
    "r7_shifted_state_gate", _state_gate,
    f"{WR}, {VIX}, st AS (SELECT *, CASE WHEN {VR} <= 0.25 THEN 0 WHEN {VR} >= 0.35 THEN 2 ELSE 1 END AS st0, coalesce(abs({full('corr(fx_price, comd_price)', FX, 20)}) >= 0.15, false) AS corr_ok FROM rets)",
    "SELECT st.pair, st.ts, CASE WHEN coalesce(greatest(0, (vix - 20) / 10 * 0.2) > 0.3, false) THEN least(st0 + 1, 2) ELSE st0 END AS state, corr_ok AND st0 = 0 AND NOT coalesce(greatest(0, (vix - 20) / 10 * 0.2) > 0.3, false) AS regime_ok FROM st LEFT JOIN vix ON vix.ts = st.ts",
    **DAY, ints=["state", "regime_ok"],
)


def _vixz(s, d):
    return trim(segment(I.daily_orders(s, d), 253).withColumn("vix_z", R.zscore(F.col("vix"), 252)))


case("r8_vix_zscore", _vixz, f"WITH {VIX}", f"SELECT ts, (vix - {full('avg(vix)', 'vix', 252)}) / nullif({full('stddev_samp(vix)', 'vix', 252)}, 0) AS vix_z FROM vix", day="ts", floats=["vix_z"])
case(
    "r9_shifted_features", lambda s, d: trim(G.shifted_features(seg(s, d, 64).withColumns({"feat_corr": R.clip(R.corr(F.col(FX), F.col(CM), 20), -0.5, 0.5), "feat_mean": R.mean(F.col(FX), 10)}), 2)),
    f"{WP}, ft AS (SELECT *, {full('corr(fx_price, comd_price)', FX, 20)} AS c, {full('avg(fx_price)', FX, 10)} AS m FROM pairs)",
    f"SELECT pair, ts, lag(CASE WHEN c IS NOT NULL THEN greatest(-0.5, least(0.5, c)) END, 2) {Q.Q} AS feat_corr, lag(m, 2) {Q.Q} AS feat_mean FROM ft", **DAY, floats=["feat_corr", "feat_mean"],
)
RV = f"{RETURNS}, rv AS (SELECT *, {full('stddev_samp(rf)', 'rf', 20)} AS v FROM rets), rq AS (SELECT *, CASE WHEN count(v) {w(120)} >= 120 THEN quantile_cont(v, 0.3333333333333333) {w(120)} END AS q1, CASE WHEN count(v) {w(120)} >= 120 THEN quantile_cont(v, 0.6666666666666666) {w(120)} END AS q2 FROM rv)"
case(
    "r9a_volatility_percentile", lambda s, d: trim(G.volatility_percentile(seg(s, d, 160), FX)), f"{WP}, {RV}",
    "SELECT pair, ts, v AS feat_volatility_value, CASE WHEN v <= q1 THEN 'low' WHEN v > q2 THEN 'high' WHEN q1 IS NOT NULL THEN 'normal' END AS feat_volatility_regime FROM rq",
    strs=["pair", "feat_volatility_regime"], day="ts", floats=["feat_volatility_value"],
)


def _cycle(s, d):
    inv = I.table(s, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("stock"))
    inv = segment(inv.withColumn("pair", F.lit("stock")), 2).withColumn("chg", R.diff(F.col("stock")).cast("double"))
    keyed = trim(inv).select("ts", "chg", F.explode(F.array(*[F.lit(p[0]) for p in I.PAIR_ROWS])).alias("pair"))
    bars = trim(seg(s, d, 22).withColumn("trend", F.col(CM) - F.lag(CM, 20).over(PAIR.ordered())))
    out = asof_join(bars.select("pair", "ts", "trend"), keyed.select("pair", "ts", "chg"))
    return out.withColumn("phase", G.cycle_phase(F.col("trend"), F.col("chg")))


case(
    "r9b_cycle_phase", _cycle,
    f"""{WP}, inv AS (SELECT ts, stock - lag(stock) OVER (ORDER BY ts) AS chg FROM (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, count(*) AS stock FROM orders GROUP BY 1)),
     tb AS (SELECT pair, ts, comd_price - lag(comd_price, 20) {Q.Q} AS trend FROM pairs), j AS (SELECT tb.*, inv.chg FROM tb ASOF LEFT JOIN inv ON tb.ts >= inv.ts)""",
    """SELECT pair, ts, CASE WHEN trend IS NULL OR chg IS NULL THEN NULL WHEN trend > 0 AND chg <= 0 THEN 'expansion' WHEN trend > 0 THEN 'peak' WHEN chg > 0 THEN 'contraction' ELSE 'trough' END AS phase FROM j""",
    strs=["pair", "phase"], day="ts",
)


def _vix_curve(s, d):
    """Volatility-index regime beside the slope between long- and short-dated means."""
    df = segment(I.daily_orders(s, d), 61)
    v = F.col("vix")
    slope = R.mean(v, 60) - R.mean(v, 10)
    return trim(df.withColumns({"feat_vix_regime": F.when(v < 20, "calm").when(v < 30, "tense").otherwise("stress"), "feat_curve_slope": slope}))


case(
    "r9c_vix_regime_slope", _vix_curve, f"WITH {VIX}",
    f"SELECT ts, CASE WHEN vix < 20 THEN 'calm' WHEN vix < 30 THEN 'tense' ELSE 'stress' END AS feat_vix_regime, {full('avg(vix)', 'vix', 60)} - {full('avg(vix)', 'vix', 10)} AS feat_curve_slope FROM vix",
    strs=["feat_vix_regime"], day="ts", floats=["feat_curve_slope"],
)
HS = dict(strs=["symbol"], second="ts")
HQ = "OVER (PARTITION BY symbol ORDER BY ts)"
hf = lambda agg, x, n: full(agg, x, n, "ts", "symbol")
HRET = f"hr AS (SELECT *, close / lag(close) {HQ} - 1 AS r, CAST(volume AS DOUBLE) AS v FROM hourly)"
case(
    "r9d_volume_price", lambda s, d: trim(G.volume_features(segment(I.hourly_bars(s, d), 23, ("symbol",)).withColumn("v", F.col("volume").cast("double")), "close", "v", 20, SYM)),
    f"WITH {HOURLY}, {HRET}, vf AS (SELECT *, {hf('sum(r * v)', 'r', 20)} / {hf('sum(CASE WHEN r IS NOT NULL THEN v END)', 'r', 20)} AS a, v / {hf('avg(v)', 'v', 20)} AS b FROM hr)",
    "SELECT symbol, ts, a AS feat_vwret, b AS feat_volume_spike, r * b AS feat_vol_adj_ret FROM vf", **HS, floats=["feat_vwret", "feat_volume_spike", "feat_vol_adj_ret"],
)
HTR = f"ht AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {HQ}), 0), coalesce(abs(low - lag(close) {HQ}), 0)) AS tr, lag(high) {HQ} AS ph, lag(low) {HQ} AS pl FROM hourly)"
case(
    "r9e_liquidity_sweep", lambda s, d: trim(G.liquidity_sweep(segment(I.hourly_bars(s, d), 17, ("symbol",)), 14, SYM)),
    f"""WITH {HOURLY}, {HTR}, hx AS (SELECT *, greatest(high - greatest(open, close), least(open, close) - low) / nullif({hf('avg(tr)', 'tr', 14)}, 0) AS wick, volume / {hf('avg(volume)', 'volume', 14)} AS spike,
      coalesce((high > ph AND close < ph) OR (low < pl AND close > pl), false) AS swept FROM ht)""",
    "SELECT symbol, ts, CASE WHEN swept THEN wick * spike WHEN wick IS NOT NULL AND spike IS NOT NULL THEN 0 END AS feat_sweep_score, coalesce(swept AND wick >= 0.5, false) AS feat_sweep FROM hx",
    **HS, ints=["feat_sweep"], floats=["feat_sweep_score"],
)
case(
    "r9f_trend_features", lambda s, d: trim(G.trend_features(seg(s, d, 62), FX)),
    f"{WP}, tn AS (SELECT *, row_number() {Q.Q} AS n FROM pairs)",
    f"SELECT pair, ts, {', '.join(full('regr_slope(fx_price, n)', FX, h) + f' AS feat_slope_{h}' for h in (10, 20, 60))}, sign({full('avg(fx_price)', FX, 10)} - {full('avg(fx_price)', FX, 50)}) AS feat_ma_cross FROM tn",
    **DAY, floats=["feat_slope_10", "feat_slope_20", "feat_slope_60", "feat_ma_cross"],
)
case(
    "r9f_directional_index", lambda s, d: trim(G.directional_index(segment(I.hourly_bars(s, d), 32, ("symbol",)), 14, SYM)),
    f"""WITH {HOURLY}, {HTR}, dm AS (SELECT *, CASE WHEN ph IS NULL THEN NULL WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm,
      CASE WHEN ph IS NULL THEN NULL WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm FROM ht),
     di AS (SELECT *, {hf('avg(pdm)', 'pdm', 14)} * 100 / {hf('avg(tr)', 'tr', 14)} AS p, {hf('avg(mdm)', 'mdm', 14)} * 100 / {hf('avg(tr)', 'tr', 14)} AS m FROM dm),
     dx AS (SELECT *, abs(p - m) * 100 / nullif(p + m, 0) AS dx FROM di)""",
    f"SELECT symbol, ts, {hf('avg(dx)', 'dx', 14)} AS feat_adx FROM dx", **HS, floats=["feat_adx"],
)
case(
    "r9g_corr_beta_std", lambda s, d: trim(spreads(s, d).withColumns({"feat_corr_rolling": R.clip(R.corr(F.col(FX), F.col(CM), 20), -1.0, 1.0), "feat_beta_std": R.std(F.col("beta"), 20)})),
    WS, f"SELECT pair, ts, {full('corr(fx_price, comd_price)', FX, 20)} AS feat_corr_rolling, {full('stddev_samp(beta)', 'beta', 20)} AS feat_beta_std FROM sp", **DAY, floats=["feat_corr_rolling", "feat_beta_std"],
)

# --- signals --------------------------------------------------------------------------------------
FLAGS = ["enter_long", "enter_short", "long_exit", "short_exit", "long_stop", "short_stop"]


def _dynamic(s, d):
    df = zbars(s, d)
    df = S.with_series_stats(df, C.structural_flag(df).select("pair", "coint_ok"))
    return trim(S.dynamic_thresholds(df, 1.5, 0.5, F.col("coint_ok")))


case("g1_dynamic_thresholds", _dynamic, f"{WS}, {Q.GATE}, {Q.STRUCT}, {Q.THRESH}", "SELECT * FROM thr", **DAY, floats=["entry_z_dyn", "exit_z_dyn"])


def _gated_flags(s, d):
    df = zbars(s, d).withColumn("ok", G.correlation_gate(F.col(FX), F.col(CM), 20, 0.15))
    return S.rule_flags(df, F.lit(1.5), F.lit(0.5), F.lit(3.5), F.col("ok"))


STATIC = f"{Q.SPREAD}, {Q.GATE}, {Q.flags_sql('gate', '1.5', '0.5', '3.5', 'corr_ok')}"
case("g2_rule_flags", lambda s, d: trim(_gated_flags(s, d)), f"WITH {STATIC}", "SELECT * FROM flags", **DAY, ints=FLAGS)
FOLDED = f"WITH RECURSIVE {STATIC}, {fold_sql('coded')}"
case("g3_position_states", lambda s, d: trim(S.positions(_gated_flags(s, d))), FOLDED, "SELECT coded.pair, coded.ts, pos AS signal FROM coded JOIN fold USING (pair, rn)", **DAY, ints=["signal"])
case(
    "g8_external_gate", lambda s, d: trim(S.positions(_gated_flags(s, d), F.col("ok"))), FOLDED,
    "SELECT coded.pair, coded.ts, CASE WHEN corr_ok THEN pos ELSE 0 END AS signal FROM coded JOIN fold USING (pair, rn)", **DAY, ints=["signal"],
)


def _held(src_gate: str, max_bars: int, reverse: bool = False, pairs: str = PAIRS) -> str:
    sp = spread_sql()
    gate = f"gt AS (SELECT gate.*, adf_p, {src_gate} AS ok FROM gate JOIN adf USING (pair))"
    return f"WITH RECURSIVE {pairs}, {sp}, {Q.GATE}, {Q.adf_sql('sp')}, {gate}, {Q.flags_sql('gt', '1.5', '0.5', '3.5', 'ok', reverse=reverse)}, {fold_sql('coded', max_bars=max_bars)}"


HELD_OUT = "SELECT coded.pair, coded.ts, pos AS signal, ok AS good_regime FROM coded JOIN fold USING (pair, rn)"
HPAIRS = HOURLY + """, plist(pair, fx, comd) AS (VALUES ('click_view', 'click', 'view'), ('purchase_signup', 'purchase', 'signup')),
 pairs AS (SELECT p.pair, f.ts, f.close AS fx_price, c.close AS comd_price FROM plist p JOIN hourly f ON f.symbol = p.fx JOIN hourly c ON c.symbol = p.comd AND c.ts = f.ts)"""
H1 = S.Rules(adf_p=0.15)
D1 = S.Rules(adf_p=0.05)
HIDDEN = S.Rules(hmm=(126, 3.0), vix=(20.0, 0.2, 1))
case(
    "g12_hidden_state_signals", lambda s, d: S.signals_table(with_vix(s, d), HIDDEN).groupBy("pair", "signal").agg(F.count(F.lit(1)).alias("n"), F.count_if("regime_ok").alias("open")),
    strs=["pair"], ints=["signal", "n", "open"],
)
case(
    "g4_hourly_signals", lambda s, d: trim(S.bounded_hold_signals(I.hourly_pairs(s, d), H1, 24, any_gate=True)),
    _held("corr_ok OR coalesce(adf_p <= 0.15, false)", 24, pairs=HPAIRS), HELD_OUT, strs=["pair"], second="ts", ints=["signal", "good_regime"],
)
case(
    "g4_reversed_stops", lambda s, d: trim(S.bounded_hold_signals(I.pair_bars(s, d), H1, 24, any_gate=True, reversed_stops=True)),
    _held("corr_ok OR coalesce(adf_p <= 0.15, false)", 24, reverse=True), HELD_OUT, **DAY, ints=["signal", "good_regime"],
)
case(
    "g5_daily_signals", lambda s, d: trim(S.bounded_hold_signals(I.pair_bars(s, d), D1, 60, any_gate=False)),
    _held("corr_ok AND coalesce(adf_p <= 0.05, false)", 60), HELD_OUT, **DAY, ints=["signal", "good_regime"],
)
ADJ = f"""{Q.SPREAD}, v0 AS (SELECT *, {full('stddev_samp(spread_z)', 'spread_z', 20)} AS sv FROM zs), v1 AS (SELECT *, 1 + (sv - avg(sv) OVER (PARTITION BY pair)) / avg(sv) OVER (PARTITION BY pair) AS adj FROM v0),
 v2 AS (SELECT *, CASE WHEN adj IS NOT NULL THEN greatest(1.5 * adj, 0.5) END AS entry_threshold, CASE WHEN adj IS NOT NULL THEN greatest(3.5 * adj, 2.0) END AS stop_threshold FROM v1),
 adjd AS (SELECT *, CASE WHEN adj IS NOT NULL THEN least(greatest(0.5 * adj, 0.2), entry_threshold * 0.8) END AS exit_threshold FROM v2)"""
case(
    "g6_enhanced_signals", lambda s, d: trim(S.enhanced_signals(I.pair_bars(s, d), RULES)),
    f"WITH RECURSIVE {ADJ}, {Q.flags_sql('adjd', 'entry_threshold', 'exit_threshold', 'stop_threshold', 'true')}, {fold_sql('coded')}",
    "SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn)", **DAY, ints=["signal"], floats=["spread_z"],
)
case(
    "g6_static_signals", lambda s, d: trim(S.enhanced_signals(I.pair_bars(s, d), RULES, vol_adjusted=False)),
    f"WITH RECURSIVE {Q.SPREAD}, {Q.flags_sql('zs', '1.5', '0.5', '3.5', 'true')}, {fold_sql('coded')}", "SELECT coded.*, pos AS signal FROM coded JOIN fold USING (pair, rn)",
    **DAY, ints=["signal"], floats=["spread_z"],
)
case(
    "g7_adjusted_thresholds", lambda s, d: trim(S.adjusted_thresholds(zbars(s, d), 1.5, 0.5, 3.5)), f"WITH {ADJ}", "SELECT * FROM adjd",
    **DAY, floats=["entry_threshold", "exit_threshold", "stop_threshold"],
)
case(
    "g9_position_sizes", lambda s, d: trim(S.sizes(seg(s, d, 22))), f"{WP}, dd AS (SELECT *, abs(fx_price - lag(fx_price) {Q.Q}) AS df, abs(comd_price - lag(comd_price) {Q.Q}) AS dc FROM pairs)",
    f"SELECT pair, ts, 0.01 / {full('avg(df)', 'df', 20)} / fx_price AS fx_size, 0.01 / {full('avg(dc)', 'dc', 20)} AS comd_size FROM dd", **DAY, floats=["fx_size", "comd_size"],
)
case(
    "g10_transition_flags", lambda s, d: trim(S.transition_flags(S.positions(_gated_flags(s, d)))), FOLDED,
    f"SELECT pair, ts, coalesce(abs(pos - lag(pos) {Q.Q}) = 1, false) AS entry, coalesce(pos - lag(pos) {Q.Q} <> 0 AND pos = 0, false) AS exit FROM (SELECT coded.pair, coded.ts, pos FROM coded JOIN fold USING (pair, rn))",
    **DAY, ints=["entry", "exit"],
)
for _n, _close in (("g11_time_stop", False), ("g11_time_stop_close_run", True)):
    case(
        _n, lambda s, d, c=_close: trim(S.time_stop(S.positions(_gated_flags(s, d), F.col("ok")), F.lit(3), c)),
        f"{FOLDED}, {Q.stopped_sql('3', _close)}", "SELECT * FROM stopped", **DAY, ints=["signal", "time_stop_exit"],
    )
case(
    "g12_signal_plan", lambda s, d: S.signals_table(I.pair_bars(s, d)), Q.SIGNALS, "SELECT * FROM sig", **DAY,
    ints=["signal", "time_stop_exit", "entry", "exit"], floats=["spread_z", "entry_z_dyn", "exit_z_dyn", "fx_position", "comd_position"],
)


def _quality(s, d):
    df = S.positions(_gated_flags(s, d))
    ret = R.diff(F.col("spread"))
    df = segment(trim(df.withColumn("sret", ret)).select("pair", "ts", "signal", "sret"), 24)
    # predictive power needs the next bar's return: computed one bar later, then labelled with its own time
    q = S.quality(df, "signal", "sret")
    o = PAIR.ordered()
    late = df.withColumn("_ls", F.lag("signal").over(o).cast("double")).withColumns({"predictive_power": R.corr(F.col("_ls"), F.col("sret"), 20), "_t": F.lag("ts").over(o)})
    late = late.filter("own AND _t IS NOT NULL").select("pair", F.col("_t").alias("ts"), "predictive_power")
    return trim(q.drop("predictive_power")).join(late, ["pair", "ts"], "left")


QS = f"{FOLDED}, qs AS (SELECT coded.pair, coded.ts, pos AS s, spread - lag(spread) OVER (PARTITION BY coded.pair ORDER BY coded.ts) AS r FROM coded JOIN fold USING (pair, rn)), q1 AS (SELECT *, lead(r) {Q.Q} AS nx, lag(s) {Q.Q} AS ls, abs(s - lag(s) {Q.Q}) AS ch, CASE WHEN s * r > 0 THEN 1 ELSE 0 END AS win FROM qs)"
nan0 = lambda e: f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"
_PP, _ST = full("corr(s, nx)", "nx", 20), f"CASE WHEN count(s) {w(20)} >= 20 THEN corr(s, ls) {w(19)} END"
case(
    "g14_signal_quality", _quality, QS,
    f"""SELECT pair, ts, {full('avg(s)', 's', 20)} / ({full('stddev_samp(s)', 's', 20)} + 1e-8) AS signal_to_noise, {nan0(_PP)} AS predictive_power, {nan0(_ST)} AS signal_stability,
        {full('avg(win)', 'win', 20)} AS win_rate, 1 - {full('avg(ch)', 'ch', 20)} AS signal_consistency FROM q1""",
    **DAY, floats=["signal_to_noise", "predictive_power", "signal_stability", "win_rate", "signal_consistency"], dec=5,
)
RUNS = f"""{FOLDED}, rs AS (SELECT coded.pair, coded.ts, pos AS s, lag(pos) OVER (PARTITION BY coded.pair ORDER BY coded.ts) AS ps FROM coded JOIN fold USING (pair, rn)),
 rr AS (SELECT *, coalesce(s <> ps, false) AS ch FROM rs), rk AS (SELECT *, sum(ch::INT) {w(None)} AS run FROM rr),
 rl AS (SELECT pair, run, sum(CASE WHEN ch OR (ps IS NOT NULL AND s <> 0) THEN 1 ELSE 0 END) AS n FROM rk GROUP BY 1, 2)"""
case(
    "g15_signal_duration", lambda s, d: S.run_lengths(S.stage(S.positions(_gated_flags(s, d)))), RUNS,
    "SELECT pair, coalesce(avg(n) FILTER (WHERE n > 0), 0) AS avg_signal_duration FROM rl GROUP BY pair", strs=["pair"], floats=["avg_signal_duration"],
)
case(
    "g16_run_diagnostics", lambda s, d: S.diagnostics(S.generate(I.pair_bars(s, d))), f"{Q.SIGNALS}, gp AS (SELECT *, abs(fx_price / lag(fx_price) {Q.Q} - 1) > 0.05 AS gap FROM sig)",
    "SELECT pair, count(*) AS observations, avg(corr_ok::INT) * 100 AS regime_pct, avg(abs(spread_z)) FILTER (WHERE entry) AS mean_abs_z_at_entry, max(adf_p) AS adf_p, count(*) FILTER (WHERE gap) AS gap_days FROM gp GROUP BY pair",
    strs=["pair"], ints=["observations", "gap_days"], floats=["regime_pct", "mean_abs_z_at_entry", "adf_p"],
)

# --- backtest -------------------------------------------------------------------------------------


def bt(s: SparkSession, d: str) -> DataFrame:
    return B.run(S.generate(I.pair_bars(s, d)))


case(
    "b2_b5_backtest", lambda s, d: bt(s, d).withColumn("delayed_signal", F.coalesce("delayed_signal", F.lit(9.0))), Q.BACKTEST,
    "SELECT * REPLACE (coalesce(delayed_signal, 9) AS delayed_signal) FROM bt", **DAY, ints=["delayed_signal", "trade_id"],
    floats=["fx_pnl", "comd_pnl", "cost", "pnl", "cumulative_pnl", "equity", "drawdown"],
)
TRADE_COLS = ["pnl", "entry_z", "exit_z", "return"]
case("b6_trades", lambda s, d: B.trades(bt(s, d)), Q.TRADES, "SELECT * FROM trades", strs=["pair"], ints=["trade_id", "direction", "duration"], floats=TRADE_COLS, fine=["fx_entry", "fx_exit", "comd_entry", "comd_exit"])
case(
    "b6_trade_stats_on_bars", lambda s, d: B.with_trade_stats(bt(s, d)), Q.TRADES,
    'SELECT bt.pair, bt.ts, coalesce(t.pnl, 0) AS trade_pnl, coalesce(t."return", 0) AS trade_return FROM bt LEFT JOIN trades t USING (pair, trade_id)', **DAY, floats=["trade_pnl", "trade_return"],
)
METRIC_COLS = ["total_pnl", "total_return", "annual_return", "max_drawdown", "volatility", "sharpe_ratio", "win_rate", "avg_win", "avg_loss", "profit_factor"]
case("b7_metrics", lambda s, d: B.metrics(bt(s, d)), Q.METRICS, "SELECT * FROM metrics", strs=["pair"], ints=["num_trades", "days_in_backtest"], floats=METRIC_COLS)
case(
    "b7_metrics_first_bar_counted", lambda s, d: B.metrics(bt(s, d), compat=True),
    f"{Q.BACKTEST}, {Q.trades_sql('delayed_signal IS NULL OR delayed_signal <> 0')}, {Q.metrics_sql()}", "SELECT * FROM metrics",
    strs=["pair"], ints=["num_trades", "days_in_backtest"], floats=METRIC_COLS,
)
case(
    "b9_backtest_from_table", lambda s, d: B.metrics(B.from_table(S.signals_table(I.pair_bars(s, d)))), Q.METRICS, "SELECT * FROM metrics",
    strs=["pair"], ints=["num_trades"], floats=METRIC_COLS,
)
case(
    "b18_min_trade_guard", lambda s, d: B.metrics(bt(s, d), min_trades=145), Q.METRICS,
    "SELECT pair, num_trades, CASE WHEN num_trades >= 145 THEN sharpe_ratio ELSE 0 END AS sharpe_ratio, CASE WHEN num_trades >= 145 THEN annual_return ELSE 0 END AS annual_return FROM metrics",
    strs=["pair"], ints=["num_trades"], floats=["sharpe_ratio", "annual_return"],
)


# --- per-pair configuration -----------------------------------------------------------------------
#: Three pairs with windows, limits, sizes and costs of their own.
CONFIGURED = {
    "A_N": {
        "fx_symbol": "A", "comd_symbol": "N", "inverse_fx_for_quote_ccy_strength": True, "min_trade_count": 12,
        "lookbacks": {"beta_window": 90, "z_window": 40, "corr_window": 20}, "thresholds": {"entry_z": 1.2, "exit_z": "3e-1", "stop_z": 3.0, "adf_p": 0.05},
        "time_stop": {"max_days": 20}, "regime": {"min_abs_corr": 0.2, "filter_extreme_vol": True, "volatility_window": 30, "high_vol_threshold": 0.25},
        "exec": {"costs": {"fx_bps": 3.0}},
    },
    "A_R": {
        "fx_symbol": "A", "comd_symbol": "R", "inverse_fx_for_quote_ccy_strength": False, "use_kalman": False, "min_trade_count": 1000,
        "lookbacks": {"beta_window": 45, "z_window": 25, "corr_window": 15}, "thresholds": {"entry_z": 1.0, "exit_z": 0.5}, "regime": {"min_abs_corr": 0.1},
        "sizing": {"atr_window": 10, "target_vol_per_leg": 0.02},
    },
    "N_R": {
        "fx_symbol": "N", "comd_symbol": "R", "lookbacks": {"beta_window": 45, "z_window": 25, "corr_window": 15}, "use_kalman": False, "sizing": {"atr_window": 10},
        "thresholds": {"entry_z": 1.7, "exit_z": 0.4, "stop_z": 2.5}, "time_stop": {"max_days": 4}, "regime": {"min_abs_corr": 0.05}, "exec": {"costs": {"comd_bps": 5}},
    },
}


def _own(section: dict) -> dict:
    return {k: X.typed(X.lookup(section, path, default), default) for k, (path, default) in X.PATHS.items()}


def _configured_bt(s, d):
    return CF.backtest(I.pair_bars(s, d), X.params_frame(s, CONFIGURED))


_each = lambda tail: " UNION ALL ".join(f"SELECT * FROM ({Q.configured_sql(p, _own(c))}{tail(_own(c))})" for p, c in CONFIGURED.items())
case(
    "g12_configured_signals", lambda s, d: trim(CF.generate(I.pair_bars(s, d), X.params_frame(s, CONFIGURED))), "",
    _each(lambda p: " SELECT pair, ts, signal, time_stop_exit, entry, exit, spread_z, entry_z_dyn, exit_z_dyn, fx_position, comd_position FROM sig"), **DAY,
    ints=["signal", "time_stop_exit", "entry", "exit"], floats=["spread_z", "entry_z_dyn", "exit_z_dyn", "fx_position", "comd_position"],
)
case(
    "s17_configured_backtest", lambda s, d: CF.metrics(_configured_bt(s, d)), "",
    _each(lambda p: f", {Q.trades_sql()}, {Q.metrics_sql()} SELECT * REPLACE (CASE WHEN num_trades >= {p['min_trade_count']} THEN annual_return ELSE 0 END AS annual_return, CASE WHEN num_trades >= {p['min_trade_count']} THEN sharpe_ratio ELSE 0 END AS sharpe_ratio) FROM metrics"),
    strs=["pair"], ints=["num_trades", "days_in_backtest"], floats=METRIC_COLS,
)
