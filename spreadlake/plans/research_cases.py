"""Cases: performance, sweeps, walk-forward, risk, costs, stress, multi-timeframe, features, models, quality, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions import costs as Z
from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import metrics as M
from spreadlake.operators import risk as K
from spreadlake.operators import signals as S
from spreadlake.operators import scan_sweep as SC
from spreadlake.operators import sweep as X
from spreadlake.plans import inputs as I
from spreadlake.plans import strategy_sql as Q
from spreadlake.plans.registry import HOURLY, PAIRS, RETURNS, case, fold_sql, full, shared, w
from spreadlake.plans.strategy_cases import DAY, HIDDEN, METRIC_COLS, bt, seg, with_vix, zbars
from spreadlake.series import join_small, trim
from spreadlake.session import stage, staging_folder
from spreadlake.sources import sinks


def backtested(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "backtest", bt)


def metrics(s, d):
    return B.metrics(backtested(s, d))


# --- performance ----------------------------------------------------------------------------------
REPORT_SQL = """SELECT pair, 'Backtest report: ' || pair || chr(10) || 'Total return (%): ' || printf('%.2f', round(total_return * 100, 2)) || chr(10) || 'Annual return (%): ' || printf('%.2f', round(annual_return * 100, 2)) || chr(10)
       || 'Sharpe ratio: ' || printf('%.2f', sharpe_ratio) || chr(10) || 'Max drawdown (%): ' || printf('%.2f', round(max_drawdown * 100, 2)) || chr(10) || 'Trades: ' || num_trades || chr(10)
       || 'Win rate (%): ' || printf('%.2f', round(win_rate * 100, 2)) || chr(10) || 'Profit factor: ' || printf('%.2f', profit_factor) || chr(10) || 'Days: ' || days_in_backtest AS report FROM metrics"""
case(
    "s15_b10_report", lambda s, d: sinks.report_text(metrics(s, d)), Q.METRICS,
    REPORT_SQL,
    strs=["pair", "report"],
)


def _written_reports(s, d):
    path = f"{staging_folder(s)}/reports-{uuid.uuid4().hex}"
    sinks.write_reports(metrics(s, d), path)
    return s.read.text(path, wholetext=True).select("pair", F.rtrim("value", F.lit("\n")).alias("report"))


case("s15_written_reports", _written_reports, Q.METRICS, REPORT_SQL, strs=["pair", "report"])
ER = f"{Q.BACKTEST}, er AS (SELECT pair, ts, equity, pnl AS ret FROM bt)"  # equal to the equity ratio less one, without its rounding noise


def ratio_sql(sd: str, n: int) -> str:
    mu = full("avg(ret)", "ret", n)
    return f"CASE WHEN {mu} IS NULL THEN NULL WHEN coalesce({sd} {w(n)}, 0) <= 1e-12 THEN 0 ELSE {mu} * 252 / ({sd} {w(n)} * sqrt(252)) END"


DD_SQL = lambda n: (
    f"CASE WHEN count(equity) {w(n)} >= {n} THEN (SELECT min((x - m) / m) FROM (SELECT unnest(l) AS x, unnest(list_transform(range(1, {n} + 1), lambda k: list_max(l[1:k]))) AS m)) END"
)
ROLL = {}
for _n in (30, 60, 90):
    ROLL[_n] = f"{ratio_sql('stddev_pop(ret)', _n)} AS sharpe_{_n}, {ratio_sql('stddev_pop(CASE WHEN ret < 0 THEN ret END)', _n)} AS sortino_{_n}"


def _rolling(s, d):
    df = M.rolling_metrics(backtested(s, d))
    return df.select("pair", "ts", *[F.col(f"{a}_{b}").alias(f"{a}_{n}") for b, n in M.WINDOWS.items() for a in ("sharpe", "sortino", "drawdown")])


FRAME_DD = ", ".join(
    f"(CASE WHEN count(equity) {w(n)} >= {n} THEN list(equity) {w(n)} END) AS l{n}" for n in (30, 60, 90)
)
DD_OF = lambda n: f"list_min(list_transform(range(1, len(l{n}) + 1), lambda k: l{n}[k] / list_max(l{n}[1:k]) - 1)) AS drawdown_{n}"
case(
    "b11_b12_rolling_metrics", _rolling, f"{ER}, el AS (SELECT *, {FRAME_DD} FROM er)",
    f"SELECT pair, ts, {', '.join(ROLL.values())}, {', '.join(DD_OF(n) for n in (30, 60, 90))} FROM el",
    **DAY, floats=[f"{a}_{n}" for n in (30, 60, 90) for a in ("sharpe", "sortino", "drawdown")],
)
case(
    "b13_rolling_calmar_win_rate", lambda s, d: trim(M.equity_frame(backtested(s, d), 60).withColumns({"calmar": M.rolling_calmar(60), "win_rate": M.rolling_win_rate(60)})),
    f"{ER}, el AS (SELECT *, {FRAME_DD} FROM er), ed AS (SELECT *, {DD_OF(60)} FROM el)",
    f"SELECT pair, ts, {full('avg(ret)', 'ret', 60)} * 252 / CASE WHEN abs(drawdown_60) > 1e-12 THEN abs(drawdown_60) END AS calmar, {full('avg((ret > 0)::INT)', 'ret', 60)} AS win_rate FROM ed",
    **DAY, floats=["calmar", "win_rate"],
)
DIST = """dm AS (SELECT pair, count(*) AS n, avg("return") AS mu, quantile_cont("return", 0.05) AS var_95, quantile_cont("return", 0.01) AS var_99 FROM trades GROUP BY pair),
 dist AS (SELECT t.pair, any_value(n) AS n, avg(("return" - mu) ** 3) / pow(avg(("return" - mu) ** 2), 1.5) AS skewness, avg(("return" - mu) ** 4) / pow(avg(("return" - mu) ** 2), 2) - 3 AS kurtosis,
  any_value(var_95) AS var_95, any_value(var_99) AS var_99, avg("return") FILTER (WHERE "return" <= var_95) AS cvar_95, avg("return") FILTER (WHERE "return" <= var_99) AS cvar_99 FROM trades t JOIN dm USING (pair) GROUP BY t.pair)"""
DIST_COLS = ["skewness", "kurtosis", "var_95", "var_99", "cvar_95", "cvar_99"]


def _dist(s, d):
    return M.distribution(B.trades(backtested(s, d)), "return")


case("b14_b15_distribution", _dist, f"{Q.TRADES}, {DIST}", "SELECT * FROM dist", strs=["pair"], ints=["n"], floats=DIST_COLS)
READING = """concat_ws('; ', CASE WHEN skewness > 0.5 THEN 'Positive skewness: More large positive returns' WHEN skewness < -0.5 THEN 'Negative skewness: More large negative returns' ELSE 'Approximately symmetric distribution' END,
 CASE WHEN kurtosis > 3 THEN 'Leptokurtic: Fat tails, more extreme values' WHEN kurtosis < 3 THEN 'Platykurtic: Thin tails, fewer extreme values' ELSE 'Mesokurtic: Normal-like tail behavior' END,
 CASE WHEN var_95 < -0.02 THEN 'High VaR at 95% confidence: Significant tail risk' END, CASE WHEN var_99 < -0.05 THEN 'High VaR at 99% confidence: Extreme tail risk' END)"""
case("b16_distribution_reading", lambda s, d: M.interpret(_dist(s, d)), f"{Q.TRADES}, {DIST}", f"SELECT *, {READING} AS distribution_interpretation FROM dist", strs=["pair", "distribution_interpretation"], floats=DIST_COLS)
MOM = lambda k: f"(avg(ret ** {k}) {w(60)})"
case(
    "b17_rolling_distribution", lambda s, d: trim(M.rolling_distribution(G_rets(s, d), "rf", 60)),
    f"WITH {PAIRS}, {RETURNS}, ml AS (SELECT pair, ts, (CASE WHEN count(rf) {w(60)} >= 60 THEN list(rf) {w(60)} END) AS l FROM rets), mm AS (SELECT *, list_avg(l) AS mu FROM ml)",
    """SELECT pair, ts, list_avg(list_transform(l, lambda v: (v - mu) ** 3)) / pow(list_avg(list_transform(l, lambda v: (v - mu) ** 2)), 1.5) AS roll_skew,
       list_avg(list_transform(l, lambda v: (v - mu) ** 4)) / pow(list_avg(list_transform(l, lambda v: (v - mu) ** 2)), 2) - 3 AS roll_kurt,
       CASE WHEN l IS NOT NULL THEN list_sort(l)[3] * 0.05 + list_sort(l)[4] * 0.95 - 0 END AS roll_var_95 FROM mm""",
    **DAY, floats=["roll_skew", "roll_kurt", "roll_var_95"],
)


def G_rets(s, d):
    from spreadlake.operators.regime import with_returns

    return with_returns(seg(s, d, 64), {"rf": "fx_price", "rc": "comd_price"})


LABEL = f"""lb0 AS (SELECT *, fx_price / lag(fx_price) {Q.Q} - 1 AS r1, fx_price / lag(fx_price, 20) {Q.Q} - 1 AS t20 FROM bt), lb1 AS (SELECT *, {full('stddev_samp(r1)', 'r1', 20)} * sqrt(252) AS v1 FROM lb0),
 lb AS (SELECT *, (year(ts) // 2 * 2)::VARCHAR || '-' || (year(ts) // 2 * 2 + 1)::VARCHAR AS years, CASE WHEN t20 > 0.02 THEN 'up' WHEN t20 < -0.02 THEN 'down' WHEN t20 IS NOT NULL THEN 'flat' ELSE 'unknown' END AS trend,
  CASE WHEN v1 < 0.05 THEN 'low' WHEN v1 < 0.10 THEN 'medium' WHEN v1 IS NOT NULL THEN 'high' ELSE 'unknown' END AS vol FROM lb1)"""
ATTR = f"""{LABEL}, attr AS (SELECT pair, CASE WHEN grouping(years) = 0 THEN 'years' WHEN grouping(trend) = 0 THEN 'trend' ELSE 'vol' END AS bucketing, coalesce(years, trend, vol) AS bucket,
 arg_max(equity, ts) / arg_min(equity, ts) - 1 AS bucket_return, count(DISTINCT CASE WHEN delayed_signal <> 0 THEN trade_id END) AS trades, count(*) AS days FROM lb GROUP BY GROUPING SETS ((pair, years), (pair, trend), (pair, vol)))"""


def _attr(s, d):
    return M.attribution(M.bucketed(backtested(s, d)))


case("b19_bucketed_attribution", _attr, f"{Q.BACKTEST}, {ATTR}", "SELECT * FROM attr", strs=["pair", "bucketing", "bucket"], ints=["trades", "days"], floats=["bucket_return"])
case(
    "b19_across_pairs", lambda s, d: M.across_pairs(_attr(s, d)), f"{Q.BACKTEST}, {ATTR}",
    "SELECT bucketing, bucket, median(bucket_return) AS median_return, avg(bucket_return) AS mean_return, sum(trades) AS trades, count(*) AS pairs FROM attr GROUP BY 1, 2",
    strs=["bucketing", "bucket"], ints=["trades", "pairs"], floats=["median_return", "mean_return"],
)


def _latest(s, d):
    b = backtested(s, d)
    runs = B.metrics(b.withColumn("run_ts", F.year("ts")), keys=("pair", "run_ts"))
    return M.latest_reports(runs.select("pair", "run_ts", "total_pnl", "max_drawdown", "sharpe_ratio"))


case(
    "b20_latest_reports", _latest, f"{Q.BACKTEST}, yr AS (SELECT pair, year(ts) AS run_ts, sum(pnl) AS total_pnl, min(drawdown) AS max_drawdown, CASE WHEN stddev_pop(pnl) <= 1e-12 THEN 0 ELSE avg(pnl) * 252 / (stddev_pop(pnl) * sqrt(252)) END AS sharpe_ratio FROM bt GROUP BY 1, 2)",
    "SELECT * FROM yr QUALIFY row_number() OVER (PARTITION BY pair ORDER BY run_ts DESC) = 1", strs=["pair"], ints=["run_ts"], floats=["total_pnl", "max_drawdown", "sharpe_ratio"],
)
case(
    "b21_failure_flags", lambda s, d: M.failure_flags(metrics(s, d).join(_dist(s, d), "pair")), f"{Q.METRICS}, {DIST}",
    """SELECT pair, (num_trades = 0)::INT + (sharpe_ratio < 0)::INT + (max_drawdown < -0.3)::INT + (win_rate < 0.4)::INT + (profit_factor < 1.1)::INT + (skewness < -1)::INT + (kurtosis > 10)::INT + (var_95 < -0.05)::INT AS n_failures,
       concat_ws(',', CASE WHEN num_trades = 0 THEN 'no_trades' END, CASE WHEN sharpe_ratio < 0 THEN 'negative_sharpe' END, CASE WHEN max_drawdown < -0.3 THEN 'deep_drawdown' END, CASE WHEN win_rate < 0.4 THEN 'low_win_rate' END,
       CASE WHEN profit_factor < 1.1 THEN 'weak_profit_factor' END, CASE WHEN skewness < -1 THEN 'left_skew' END, CASE WHEN kurtosis > 10 THEN 'fat_tails' END, CASE WHEN var_95 < -0.05 THEN 'large_var' END) AS failures
       FROM metrics JOIN dist USING (pair)""",
    strs=["pair", "failures"], ints=["n_failures"],
)

# --- sweeps ---------------------------------------------------------------------------------------


def combos(entry, exit_, stop, keep):
    import itertools

    return [(i + 1, *c) for i, c in enumerate(c for c in itertools.product(entry, exit_, stop) if keep(*c))]


FULL_GRID = combos(X.ENTRY, X.EXIT, X.STOP, lambda e, x, t: e > x and x < t)
RUN_GRID = combos(X.RUN_ENTRY, X.RUN_EXIT, X.RUN_STOP, lambda e, x, t: e > x and t > e)


def grid_sql(grid) -> str:
    rows = ", ".join(f"({i}, {e}::DOUBLE, {x}::DOUBLE, {t}::DOUBLE)" for i, e, x, t in grid)
    return f"grid(param_id, entry_z, exit_z, stop_z) AS (VALUES {rows})"


def values_sql(name: str, col: str, values) -> str:
    return f"{name}({col}) AS (VALUES {', '.join(f'({v}::DOUBLE)' for v in values)})"


def _breaches(grid):
    def build(s, d):
        rows = X.with_grid(trim(zbars(s, d)).select("pair", "spread_z"), grid)
        return rows.groupBy("pair", "entry_z", "exit_z", "stop_z").agg(F.count_if(F.abs("spread_z") >= F.col("entry_z")).alias("entries"))

    return build


for _name, _grid, _lists, _keep in (
    ("x1_threshold_grid", FULL_GRID, (X.ENTRY, X.EXIT, X.STOP), "entry_z > exit_z AND exit_z < stop_z"),
    ("x2_run_grid", RUN_GRID, (X.RUN_ENTRY, X.RUN_EXIT, X.RUN_STOP), "entry_z > exit_z AND stop_z > entry_z"),
):
    case(
        _name, _breaches(_grid), f"WITH {Q.SPREAD}, {values_sql('le', 'entry_z', _lists[0])}, {values_sql('lx', 'exit_z', _lists[1])}, {values_sql('lt', 'stop_z', _lists[2])}",
        f"SELECT pair, entry_z, exit_z, stop_z, count(*) FILTER (WHERE abs(spread_z) >= entry_z) AS entries FROM zs, le, lx, lt WHERE {_keep} GROUP BY ALL",
        strs=["pair"], ints=["entries"], floats=["entry_z", "exit_z", "stop_z"],
    )


def sweep(s, d, grid=RUN_GRID):
    return SC.table(zbars(s, d), grid)


PK = "pair, param_id"
PQ = "OVER (PARTITION BY pair, param_id ORDER BY rn)"
PU = "OVER (PARTITION BY pair, param_id ORDER BY rn ROWS UNBOUNDED PRECEDING)"
SWEEP = f"""WITH RECURSIVE {Q.SPREAD}, {grid_sql(RUN_GRID)}, gz AS (SELECT pair, param_id, i AS rn, CASE WHEN spread_z >= entry_z THEN -1 WHEN spread_z <= -entry_z THEN 1 ELSE 0 END AS raw,
 spread_z >= -exit_z OR spread_z <= -stop_z AS lo, spread_z <= exit_z OR spread_z >= stop_z AS so FROM zs, grid), {fold_sql('gz', PK)},
 s0 AS (SELECT f.pair, f.param_id, f.rn, f.pos AS s, sp.spread, sp.ts FROM fold f JOIN sp ON sp.pair = f.pair AND sp.i = f.rn),
 s1 AS (SELECT *, lag(s) {PQ} * (spread - lag(spread) {PQ}) AS r, lag(s) {PQ} AS ps FROM s0), s2 AS (SELECT *, coalesce(s <> ps, false) AS ch, product(1 + r) {PU} AS eq FROM s1),
 s3 AS (SELECT *, max(eq) {PU} AS pk, sum(ch::INT) {PU} AS run FROM s2), rl AS (SELECT {PK}, run, sum(CASE WHEN ch OR (ps IS NOT NULL AND s <> 0) THEN 1 ELSE 0 END) AS len FROM s3 GROUP BY {PK}, run),
 dur AS (SELECT {PK}, coalesce(avg(len) FILTER (WHERE len > 0), 0) AS avg_signal_duration FROM rl GROUP BY {PK}),
 sm AS (SELECT {PK}, sum(ch::INT) AS total_trades, count(*) FILTER (WHERE r > 0) AS wins, sum(r) AS total_return, sum(r) * 252 / count(*) AS annual_return, stddev_samp(r) * sqrt(252) AS annual_vol,
  min(CASE WHEN r IS NOT NULL THEN (eq - pk) / nullif(pk, 0) END) AS max_drawdown, avg((s <> 0)::INT) AS signal_activity FROM s3 GROUP BY {PK}),
 sw AS (SELECT *, CASE WHEN total_trades > 0 THEN wins / total_trades ELSE 0 END AS win_rate, CASE WHEN annual_vol > 0 THEN annual_return / annual_vol ELSE 0 END AS sharpe_ratio FROM sm JOIN dur USING (pair, param_id) JOIN grid USING (param_id))"""
SWEEP_COLS = ["entry_z", "exit_z", "stop_z", "win_rate", "total_return", "annual_return", "annual_vol", "sharpe_ratio", "max_drawdown", "signal_activity", "avg_signal_duration"]


def shared_sweep(s, d):
    return shared(s, d, "sweep", sweep)


# spread returns are not bounded by the stake, so drawdowns reach powers of ten: compared as logarithms
case("x3_x4_parameter_sweep", lambda s, d: sweep(s, d).withColumn("max_drawdown", -F.ln(1 - F.col("max_drawdown"))), SWEEP, "SELECT * REPLACE (-ln(1 - max_drawdown) AS max_drawdown) FROM sw", strs=["pair"], ints=["param_id", "total_trades"], floats=SWEEP_COLS, dec=5)
case(
    "x3_sweep_ranks", lambda s, d: X.average_rank(shared_sweep(s, d).withColumn("key", R.rounded(F.col("sharpe_ratio"), 6)), "key"), SWEEP,
    "SELECT *, rank() OVER (PARTITION BY pair ORDER BY round(sharpe_ratio, 6) DESC) + (count(*) OVER (PARTITION BY pair, round(sharpe_ratio, 6)) - 1) / 2 AS rank FROM sw",
    strs=["pair"], ints=["param_id"], floats=["rank"],
)
case(
    "x6_best_results", lambda s, d: X.best(shared_sweep(s, d).withColumn("sharpe_ratio", R.rounded(F.col("sharpe_ratio"), 6)), "sharpe_ratio", 5), SWEEP,
    "SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(sharpe_ratio, 6) DESC, param_id) AS place FROM sw WHERE sharpe_ratio IS NOT NULL QUALIFY place <= 5",
    strs=["pair"], ints=["param_id", "place"], floats=["sharpe_ratio"],
)
case(
    "x7_aggregate_results", lambda s, d: shared_sweep(s, d).groupBy("entry_z").agg(F.avg("sharpe_ratio").alias("mean_sharpe"), F.max("sharpe_ratio").alias("best_sharpe"), F.sum("total_trades").alias("trades")).orderBy(F.col("mean_sharpe").desc()),
    SWEEP, "SELECT entry_z, avg(sharpe_ratio) AS mean_sharpe, max(sharpe_ratio) AS best_sharpe, sum(total_trades) AS trades FROM sw GROUP BY 1", ints=["trades"], floats=["entry_z", "mean_sharpe", "best_sharpe"],
)


def ablated(s, d, names=("full", "no_gate", "no_time_stop")):
    """The signal plan with single parts switched off, one metrics row per variant."""
    df = stage(zbars(s, d).withColumn("ok", _gate()))
    df = S.sizes(S.rule_flags(df, F.lit(1.5), F.lit(0.5), F.lit(3.5), F.lit(True)))
    out = None
    for name in names:
        v = S.positions(df, None if name == "no_gate" else F.col("ok"))
        if name != "no_time_stop":
            v = S.time_stop(v, F.lit(3))
        m = B.metrics(B.run(S.leg_positions(v))).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def _gate():
    from spreadlake.operators.regime import correlation_gate

    return correlation_gate(F.col("fx_price"), F.col("comd_price"), 20, 0.15)


def variant_sql(name: str) -> tuple[str, str]:
    gate = "pos" if name == "no_gate" else "CASE WHEN corr_ok THEN pos ELSE 0 END"
    sig = "shown" if name == "no_time_stop" else None
    base = f"WITH RECURSIVE {Q.SPREAD}, {Q.GATE}, {Q.flags_sql('gate', '1.5', '0.5', '3.5', 'true')}, {fold_sql('coded')}"
    stop = Q.stopped_sql("3").replace("CASE WHEN corr_ok THEN pos ELSE 0 END", gate)
    if sig:
        stop = stop.replace("CASE WHEN hit THEN 0 ELSE shown END AS signal", "shown AS signal")
    return f"{base}, {stop}, {Q.SIZES}, {Q.backtest_sql()}, {Q.trades_sql()}, {Q.metrics_sql()}", f"SELECT *, '{name}' AS variant FROM metrics"


VARIANTS = ("full", "no_gate", "no_time_stop")
case(
    "x5_x11_model_comparison", ablated, "", " UNION ALL ".join(f"SELECT * FROM ({a} {b})" for a, b in map(variant_sql, VARIANTS)),
    strs=["pair", "variant"], ints=["num_trades"], floats=METRIC_COLS, dec=5,
)
FOLDS = dict(first_year=1995, train=3, test=1, step=1, count=4)
case(
    # the hidden-state fit can't be stated in SQL, as in g12_hidden_state_signals
    "x11_ablations", lambda s, d: X.compare(stage(with_vix(s, d)), X.ablations(HIDDEN), FOLDS),
    strs=["pair", "variant", "error"], ints=["folds", "num_trades"], floats=list(X.KPIS),
)
FOLD_SQL = """fd AS (SELECT p.*, k + 1 AS fold, CASE WHEN year(ts) - 1995 - k BETWEEN 0 AND 2 THEN 'train' WHEN year(ts) - 1995 - k = 3 THEN 'test' END AS part FROM {src} p, (SELECT unnest(range(0, 4)) AS k))"""
case(
    "x8_walk_forward_folds", lambda s, d: X.assign_folds(I.pair_bars(s, d), **FOLDS).groupBy("pair", "fold", "part").agg(F.count(F.lit(1)).alias("bars"), F.avg("fx_price").alias("mean_fx")),
    f"WITH {PAIRS}, {FOLD_SQL.format(src='pairs')}", "SELECT pair, fold, part, count(*) AS bars, avg(fx_price) AS mean_fx FROM fd WHERE part IS NOT NULL GROUP BY 1, 2, 3",
    strs=["pair", "part"], ints=["fold", "bars"], floats=["mean_fx"],
)


def _purged(s, d):
    from spreadlake.series import position

    off, row = position()
    df = trim(seg(s, d, 1).withColumn("rn", off + row))
    cut = df.filter(F.year("ts") < 1999).groupBy("pair").agg((F.max("rn") + 1).alias("cut"))
    return X.purge(join_small(df, cut, ["pair"]), F.col("cut"), F.col("rn"))


case(
    "x9_purge_embargo", _purged, f"WITH {PAIRS}, rn AS (SELECT *, row_number() {Q.Q} AS rn FROM pairs), cut AS (SELECT pair, max(rn) + 1 AS cut FROM rn WHERE year(ts) < 1999 GROUP BY pair)",
    "SELECT pair, ts, rn FROM rn JOIN cut USING (pair) WHERE NOT (rn - cut < 0 AND rn - cut >= -40) AND NOT (rn - cut >= 0 AND rn - cut < 20)", **DAY, ints=["rn"],
)


def _fold_scores(s, d):
    # drawdowns of spread returns reach powers of ten: kept as logarithms
    return SC.fold_table(zbars(s, d), RUN_GRID, FOLDS).withColumn("log_drawdown", -F.ln(1 - F.col("max_drawdown")))


PFP = "OVER (PARTITION BY pair, param_id, fold, part ORDER BY ts"
FSCORE = f"""{SWEEP}, {FOLD_SQL.format(src='s2')},
 pl AS (SELECT *, row_number() {PFP}) AS up, row_number() {PFP} DESC) AS down FROM fd WHERE part IS NOT NULL),
 pu AS (SELECT pair, param_id, fold, part, ts, r, ch, product(1 + coalesce(r, 0)) {PFP} ROWS UNBOUNDED PRECEDING) AS feq FROM pl WHERE (part = 'train' AND down > 40) OR (part = 'test' AND up > 20)),
 pe AS (SELECT *, max(feq) {PFP} ROWS UNBOUNDED PRECEDING) AS fpk FROM pu),
 fs AS (SELECT pair, fold, part, param_id, sum(r) AS total_return, CASE WHEN stddev_samp(r) > 0 THEN sum(r) * 252 / count(*) / (stddev_samp(r) * sqrt(252)) ELSE 0 END AS sharpe_ratio,
  coalesce(sum(r) FILTER (WHERE r > 0) / abs(sum(r) FILTER (WHERE r < 0)), 0) AS profit_factor, -ln(1 - coalesce(min((feq - fpk) / nullif(fpk, 0)), 0)) AS log_drawdown, sum(ch::INT) AS num_trades FROM pe GROUP BY ALL),
 ch AS (SELECT pair, fold, param_id FROM fs WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY pair, fold ORDER BY round(sharpe_ratio, 6) DESC, round(profit_factor, 6) DESC, round(log_drawdown, 6) DESC, param_id) = 1),
 oos AS (SELECT fs.* FROM fs JOIN ch USING (pair, fold, param_id) WHERE part = 'test')"""


def _oos(s, d):
    sc = shared(s, d, "fold_scores", _fold_scores)
    keyed = sc.filter("part = 'train'").select("pair", "param_id", "fold", R.rounded(F.col("sharpe_ratio"), 6).alias("sharpe_ratio"), R.rounded(F.col("profit_factor"), 6).alias("profit_factor"), R.rounded(F.col("log_drawdown"), 6).alias("max_drawdown"))
    return X.freeze_best(keyed, sc.filter("part = 'test'"))


case("x10_tune_then_freeze", _oos, FSCORE, "SELECT * FROM oos", strs=["pair"], ints=["fold", "param_id", "num_trades"], floats=["total_return", "sharpe_ratio", "profit_factor", "log_drawdown"], dec=5)
case(
    "x12_oos_acceptance", lambda s, d: X.accept(_oos(s, d)).withColumn("worst_dd", -F.ln(1 - F.col("worst_dd"))),
    f"{FSCORE}, ac AS (SELECT pair, median(sharpe_ratio) AS median_sharpe, median(profit_factor) AS median_pf, min(log_drawdown) AS worst_dd, min(num_trades) AS fewest_trades, max(greatest(total_return, 0)) / nullif(sum(greatest(total_return, 0)), 0) AS top_fold_share FROM oos GROUP BY pair)",
    "SELECT *, fewest_trades > 0 AND median_sharpe >= 0.2 AND median_pf >= 1.2 AND worst_dd >= -ln(1.25) AND coalesce(top_fold_share, 0) <= 0.6 AS accepted FROM ac",
    strs=["pair"], ints=["accepted", "fewest_trades"], floats=["median_sharpe", "median_pf", "worst_dd", "top_fold_share"], dec=5,
)
case("x13_bootstrap", lambda s, d: X.bootstrap(B.trades(backtested(s, d)), "return", ["trade_id"]), strs=["pair"], floats=["lo", "hi", "p_value"])

# --- risk and costs -------------------------------------------------------------------------------
BTW = "OVER (PARTITION BY pair, date_trunc('week', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)"
RISK = f"""{Q.BACKTEST}, ac AS (SELECT ts, sum(pnl) AS p FROM bt GROUP BY ts), aw AS (SELECT ts, p AS account_daily, sum(p) OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts) AS account_weekly FROM ac),
 rk AS (SELECT bt.*, pnl AS daily_pnl, sum(pnl) {BTW} AS weekly_pnl, account_daily, account_weekly FROM bt JOIN aw USING (ts)),
 rb AS (SELECT *, drawdown < -0.15 AS drawdown_breach, daily_pnl < -0.02 AS daily_breach, weekly_pnl < -0.05 AS weekly_breach, account_daily < -0.02 AS account_daily_breach, account_weekly < -0.05 AS account_weekly_breach FROM rk),
 hit AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM rb WHERE daily_breach),
 rc AS (SELECT rb.*, EXISTS (SELECT 1 FROM hit WHERE CAST(rb.ts AS DATE) >= d AND CAST(rb.ts AS DATE) < d + 2) AS breaker_active FROM rb)"""
BREACHES = ["drawdown_breach", "daily_breach", "weekly_breach", "account_daily_breach", "account_weekly_breach"]


def _limits(s, d):
    return K.loss_flags(K.period_pnl(backtested(s, d).select("pair", "ts", "pnl", "equity", "drawdown")))


case("k1_period_pnl", lambda s, d: K.period_pnl(backtested(s, d)), RISK, "SELECT * FROM rk", **DAY, floats=["daily_pnl", "weekly_pnl"])
case("k2_k3_loss_limits", _limits, RISK, "SELECT * FROM rb", **DAY, ints=BREACHES, floats=["account_daily", "account_weekly"])
case("k4_circuit_breaker", lambda s, d: K.circuit_breaker(_limits(s, d), F.col("daily_breach"), 2), RISK, "SELECT * FROM rc", **DAY, ints=["breaker_active"])
case(
    "k7_daily_drawdown", lambda s, d: K.daily_drawdown(K.period_pnl(segment_hours(s, d))),
    f"WITH {HOURLY}, eq AS (SELECT symbol AS pair, ts, close AS equity, max(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS hi FROM hourly)",
    "SELECT pair, ts, (equity - hi) / nullif(hi, 0) AS day_drawdown, coalesce((equity - hi) / nullif(hi, 0) < -0.02, false) AS day_drawdown_breach FROM eq",
    strs=["pair"], second="ts", ints=["day_drawdown_breach"], floats=["day_drawdown"],
)


def segment_hours(s, d):
    return I.hourly_bars(s, d).select(F.col("symbol").alias("pair"), "ts", F.col("close").alias("equity"), F.lit(0.0).alias("pnl"))


case(
    "k8_can_trade", lambda s, d: K.can_trade(K.daily_drawdown(K.circuit_breaker(_limits(s, d), F.col("daily_breach"), 2))), RISK,
    "SELECT pair, ts, NOT (breaker_active OR drawdown_breach OR daily_breach OR weekly_breach OR account_daily_breach OR account_weekly_breach) AS can_trade FROM rc", **DAY, ints=["can_trade"],
)


def _sized(s, d):
    df = seg(s, d, 24)
    df = df.withColumns({"df": F.abs(R.diff(F.col("fx_price"))), "dc": F.abs(R.diff(F.col("comd_price"))), "rf": R.pct_change(F.col("fx_price")), "rc": R.pct_change(F.col("comd_price"))})
    df = df.withColumns({
        "fx_atr": R.mean(F.col("df"), 14), "comd_atr": R.mean(F.col("dc"), 14), "fx_vol": R.std(F.col("rf"), 20), "comd_vol": R.std(F.col("rc"), 20),
        "signal": F.when(F.coalesce("rf", F.lit(0.0)) > 0, 1).otherwise(-1), "stop_distance": F.lit(0.05)})
    return trim(df.filter("fx_vol IS NOT NULL"))


SIZED = f"""WITH {PAIRS}, {RETURNS}, d1 AS (SELECT *, abs(fx_price - lag(fx_price) {Q.Q}) AS df, abs(comd_price - lag(comd_price) {Q.Q}) AS dc FROM rets),
 d2 AS (SELECT *, {full('avg(df)', 'df', 14)} AS fx_atr, {full('avg(dc)', 'dc', 14)} AS comd_atr, {full('stddev_samp(rf)', 'rf', 20)} AS fx_vol, {full('stddev_samp(rc)', 'rc', 20)} AS comd_vol, CASE WHEN coalesce(rf, 0) > 0 THEN 1 ELSE -1 END AS signal FROM d1),
 d3 AS (SELECT *, 0.01 / fx_atr / fx_price AS f, 0.01 / comd_atr AS c FROM d2 WHERE fx_vol IS NOT NULL), d4 AS (SELECT *, CASE WHEN greatest(fx_vol, comd_vol) > 0.01 THEN least(1, 0.01 / greatest(fx_vol, comd_vol)) ELSE 1 END AS k FROM d3),
 d5 AS (SELECT *, abs(f * k * fx_price) + abs(c * k * comd_price) AS v FROM d4), d6 AS (SELECT *, k * CASE WHEN v > 0.0001 THEN 0.0001 / v ELSE 1 END AS k2, CASE WHEN v > 0.0001 THEN 0.0001 ELSE v END * 0.05 AS r FROM d5),
 d7 AS (SELECT *, k2 * CASE WHEN r > 0.00001 THEN 0.00001 / r ELSE 1 END AS k3 FROM d6), so AS (SELECT *, f * k3 * signal AS fx_order, -c * k3 * signal AS comd_order FROM d7)"""
case("k5_position_size", lambda s, d: K.position_size(_sized(s, d), equity=0.001), SIZED, "SELECT * FROM so", **DAY, floats=["fx_order", "comd_order"], dec=9)
case(
    "k6_total_exposure", lambda s, d: K.exposure(backtested(s, d), 1.0, 0.05), f"{Q.BACKTEST}",
    "SELECT ts, sum(abs(fx_position * fx_price) + abs(comd_position * comd_price)) AS exposure, coalesce(sum(abs(fx_position * fx_price) + abs(comd_position * comd_price)) > 0.05, false) AS exposure_breach FROM bt GROUP BY ts",
    day="ts", ints=["exposure_breach"], floats=["exposure"],
)


def _costs(order):
    def build(s, d):
        t = I.table(s, d, "lineitem")
        px, q = F.col("l_extendedprice") / F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")) / 1000
        atr, vol = F.col("l_tax") * 1000, F.col("l_quantity") * 100000
        df = t.select("l_orderkey", "l_linenumber", px.alias("px"), q.alias("q"), atr.alias("atr"), vol.alias("vol"))
        slip = Z.slippage(F.col("px"), F.col("q"), Z.FX, order, F.col("atr"), F.col("vol"))
        df = df.withColumn("slip", slip).withColumns({
            "impact": Z.market_impact(F.col("q"), F.col("px"), Z.FX), "fill": Z.execution_price(F.col("px"), F.col("q"), F.col("slip")),
            "cost": Z.total_cost(F.col("px"), F.col("px") * 2, F.col("q"), -F.col("q"), order)})
        return df.groupBy("l_linenumber").agg(*[F.avg(c).alias(c) for c in ("slip", "impact", "fill", "cost")], F.max("cost").alias("max_cost"))

    return build


def cost_sql(k: float) -> str:
    imp = lambda p: f"least(0.1 * sqrt(abs(q)) * {p} + 0.001 * q * q * {p}, 0.05 * {p})"
    leg = lambda p, v, s: f"(({v} + {s} * {k}) / 10000 * {p} + {imp(p)})"
    cost = lambda p, v, s, cond, fixed: f"({leg(p, v, s)} * abs(q) + abs(q * {p}) * CASE WHEN {cond} THEN 0.00005 ELSE 0.0002 END + {fixed} + abs(q * {p}) * 0.00001)"
    return f"""WITH c0 AS (SELECT l_linenumber, l_extendedprice / l_quantity AS px, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END / 1000 AS q, l_tax * 1000 AS atr, l_quantity * 100000 AS vol FROM lineitem),
 c1 AS (SELECT *, {imp('px')} AS impact, {leg('px', 0.5, 1.0)} AS s0, {cost('px', 0.5, 1.0, 'abs(q * px) <= 1000000', 0.0001)} + {cost('(px * 2)', 1.5, 2.0, 'abs(q) <= 100', 1.0)} AS cost FROM c0),
 c2 AS (SELECT *, CASE WHEN atr > 0 THEN greatest(s0, atr * 0.5) ELSE s0 END AS s1 FROM c1), c3 AS (SELECT *, greatest(s1, s1 * greatest(0.1, least(1.0, 1000000 / vol)) * 0.3) AS slip FROM c2),
 cc AS (SELECT l_linenumber, avg(slip) AS slip, avg(impact) AS impact, avg(px + sign(q) * slip) AS fill, avg(cost) AS cost, max(cost) AS max_cost FROM c3 GROUP BY 1)"""


for _o, _k in (("limit", 0.5), ("market", 2.0)):
    case(f"k9_k12_execution_costs_{_o}", _costs(_o), cost_sql(_k), "SELECT * FROM cc", ints=["l_linenumber"], floats=["slip", "impact", "fill", "cost", "max_cost"], dec=5)
SCEN = ", ".join(f"('{n}', {dm}::DOUBLE)" for n, dm, *_ in K.DEFAULT_SCENARIOS)
SW = "OVER (PARTITION BY pair, name ORDER BY ts ROWS UNBOUNDED PRECEDING)"
STRESS = f"""{Q.BACKTEST}, scen(name, mult) AS (VALUES {SCEN}), x0 AS (SELECT pair, name, ts, equity, first_value(equity) OVER (PARTITION BY pair ORDER BY ts) AS e0, coalesce(equity / lag(equity) OVER (PARTITION BY pair, name ORDER BY ts) - 1, 0) AS r, mult FROM bt, scen),
 x1 AS (SELECT *, e0 * product(1 + CASE WHEN r < 0 AND mult > 1 THEN r * mult ELSE r END) {SW} AS stressed FROM x0), x2 AS (SELECT *, max(stressed) {SW} AS pk FROM x1), x3 AS (SELECT *, (stressed - pk) / nullif(pk, 0) AS stressed_dd FROM x2),
 res AS (SELECT pair, name, min(stressed_dd) AS max_drawdown, arg_max(stressed, ts) AS final_equity, count(*) FILTER (WHERE stressed_dd < -0.15) AS violations FROM x3 GROUP BY 1, 2)"""


def _stressed(s, d):
    return shared(s, d, "stress", lambda a, b: K.stressed(backtested(a, b)))


case("k13_stress_paths", lambda s, d: K.stressed(backtested(s, d)), STRESS, "SELECT * FROM x3", strs=["pair", "name"], day="ts", floats=["stressed", "stressed_dd"])
case("k14_stress_results", lambda s, d: K.stress_results(_stressed(s, d)), STRESS, "SELECT * FROM res", strs=["pair", "name"], ints=["violations"], floats=["max_drawdown", "final_equity"])
case(
    "k15_stress_verdict", lambda s, d: K.stress_verdict(K.stress_results(_stressed(s, d))), STRESS,
    "SELECT *, abs(max_drawdown) <= CASE WHEN name = 'Daily Drawdown Stress' THEN 0.75 ELSE 0.45 END AND violations <= CASE WHEN name = 'High Volatility Regime' THEN 5 ELSE 2 END AND final_equity >= 0.5 AS passed FROM res",
    strs=["pair", "name"], ints=["passed"],
)
case(
    "k15_stress_report", lambda s, d: K.stress_report(K.stress_results(_stressed(s, d))), STRESS,
    "SELECT pair, name, name || ' | max drawdown ' || printf('%.2f', round(max_drawdown * 100, 2)) || '% | final equity ' || printf('%.2f', round(final_equity, 2)) || ' | violations ' || violations AS line FROM res",
    strs=["pair", "name", "line"],
)
case("k13_stress_noise", lambda s, d: K.stress_results(K.stressed(backtested(s, d), noise_seed=7)), strs=["pair", "name"], ints=["violations"], floats=["max_drawdown", "final_equity"])
