"""SQL statements of the spread statistics, the signal plan and the backtest."""

from __future__ import annotations

from spreadlake.plans.registry import PAIRS, fold_sql, full, spread_sql, w

Q = "OVER (PARTITION BY pair ORDER BY ts)"
SPREAD = f"{PAIRS}, {spread_sql()}"


def phi(x: str) -> str:
    """Standard normal distribution as a series over odd powers."""
    t = f"greatest(abs({x}), 1e-300)"
    term = f"exp((2 * n + 1) * ln({t}) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))"
    up = f"(0.5 + exp(-({t}) * ({t}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 161), lambda n: {term})))"
    return f"(CASE WHEN abs({x}) > 8 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END WHEN {x} >= 0 THEN {up} ELSE 1 - {up} END)"


def adf_sql(src: str, keys: str = "pair", col: str = "spread", name: str = "adf") -> str:
    q = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    f = "FILTER (WHERE b IS NOT NULL)"
    return f"""{name}0 AS (SELECT {keys}, ts, {col} AS s, lag({col}) {q} AS a, lag({col}, 2) {q} AS a2 FROM {src} WHERE {col} IS NOT NULL),
 {name}1 AS (SELECT {keys}, s, s - a AS y, a - a2 AS b, a FROM {name}0),
 {name}2 AS (SELECT {keys}, count(s) AS n_obs, count(y) AS n0, count(b) AS n1, var_pop(a) AS aa0, var_pop(y) AS yy0, covar_pop(y, a) AS ya0,
  var_pop(a) {f} AS aa, var_pop(b) AS bb, var_pop(y) {f} AS yy, covar_pop(a, b) {f} AS ab, covar_pop(y, a) {f} AS ya, covar_pop(y, b) {f} AS yb FROM {name}1 GROUP BY {keys}),
 {name}3 AS (SELECT *, aa * bb - ab * ab AS det, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS k, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS g, ya0 / aa0 AS k0 FROM {name}2),
 {name}4 AS (SELECT *, yy - k * ya - g * yb AS r1, yy - ya * ya / aa AS rr0, yy0 - k0 * ya0 AS r00 FROM {name}3),
 {name}5 AS (SELECT *, n1 * ln(r1) + 2 < n1 * ln(rr0) AS one FROM {name}4),
 {name}6 AS (SELECT {keys}, n_obs, CASE WHEN one THEN 1 ELSE 0 END AS used_lag,
  CASE WHEN one THEN k / sqrt(r1 / (n1 - 3) * bb / det) ELSE k0 / sqrt(r00 / aa0 / (n0 - 2)) END AS adf_stat FROM {name}5),
 {name}7 AS (SELECT *, CASE WHEN adf_stat <= -1.61 THEN 2.1659 + 1.4412 * adf_stat + 0.038269 * adf_stat ** 2
  ELSE 1.7339 + 0.93202 * adf_stat - 0.12745 * adf_stat ** 2 - 0.010368 * adf_stat ** 3 END AS arg FROM {name}6),
 {name} AS (SELECT {keys}, n_obs, used_lag, adf_stat, CASE WHEN adf_stat > 2.74 THEN 1.0 WHEN adf_stat < -18.83 THEN 0.0 ELSE {phi("arg")} END AS adf_p FROM {name}7)"""


def half_life_sql(src: str, cap: float, col: str = "spread", name: str = "hl") -> str:
    return f"""{name}0 AS (SELECT pair, {col} - lag({col}) {Q} AS d, lag({col}) {Q} AS l FROM {src}),
 {name} AS (SELECT pair, CASE WHEN regr_slope(d, l) < 0 THEN least(-ln(2) / regr_slope(d, l), {cap}) ELSE {cap} END AS half_life FROM {name}0 GROUP BY pair)"""


def hurst_sql(src: str, scale: float, fn: str, keys: str = "pair", col: str = "spread", name: str = "hu") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, {k} AS k, {fn}(d) AS v, count(s) AS n FROM (SELECT {keys}, {col} AS s, {col} - lag({col}, {k}) OVER (PARTITION BY {keys} ORDER BY ts) AS d FROM {src}) GROUP BY {keys}"
        for k in range(2, 20)
    )
    return f"{name}0 AS ({parts}), {name} AS (SELECT {keys}, {scale} * regr_slope(ln(v), ln(k)) AS hurst FROM {name}0 WHERE k < floor(n / 4) AND v > 0 GROUP BY {keys})"


GATE = f"gate AS (SELECT *, coalesce(abs({full('corr(fx_price, comd_price)', 'fx_price', 20)}) >= 0.15, false) AS corr_ok FROM zs)"
STRUCT = f"""{adf_sql("sp")}, {half_life_sql("sp", 252.0)}, {hurst_sql("sp", 0.5, "var_pop")},
 stats AS (SELECT pair, n_obs, adf_p, half_life, hurst, adf_p <= 0.10 AND half_life BETWEEN 2 AND 252 AND coalesce(hurst, 0.5) < 0.6 AS coint_ok FROM adf JOIN hl USING (pair) JOIN hu USING (pair))"""
THRESH = f"""tv AS (SELECT *, {full("stddev_samp(spread)", "spread", 20)} AS v FROM gate),
 tm AS (SELECT *, CASE WHEN count(v) {w(252)} >= 20 THEN median(v) {w(252)} END AS m FROM tv),
 th AS (SELECT tm.*, adf_p, half_life, coint_ok, coalesce(CASE WHEN v / nullif(m, 0) IS NOT NULL THEN greatest(0.7, least(1.5, v / nullif(m, 0))) END, 1.0) AS vs FROM tm JOIN stats USING (pair)),
 thr AS (SELECT *, greatest(0.8, 1.5 * (CASE WHEN coint_ok THEN 0.9 ELSE 1.1 END) * vs) AS entry_z_dyn,
  least(1.25, 0.5 / (CASE WHEN coint_ok THEN 0.9 ELSE 1.1 END) * vs) AS exit_z_dyn FROM th)"""


def flags_sql(src: str, entry: str, exit_: str, stop: str, gate: str, name: str = "flags", reverse: bool = False) -> str:
    ls, ss = (f"spread_z >= -({stop})", f"spread_z <= {stop}") if reverse else (f"spread_z <= -({stop})", f"spread_z >= {stop}")
    c = lambda e: f"coalesce({e}, false)"
    return f"""{name} AS (SELECT *, i AS rn, {c(f"spread_z <= -({entry}) AND {gate}")} AS enter_long, {c(f"spread_z >= {entry} AND {gate}")} AS enter_short,
 {c(f"spread_z >= -({exit_})")} AS long_exit, {c(f"spread_z <= {exit_}")} AS short_exit, {c(ls)} AS long_stop, {c(ss)} AS short_stop FROM {src}),
 coded AS (SELECT *, CASE WHEN enter_short THEN -1 WHEN enter_long THEN 1 ELSE 0 END AS raw, long_exit OR long_stop AS lo, short_exit OR short_stop AS so FROM {name})"""


SIZES = f"""dd AS (SELECT *, abs(fx_price - lag(fx_price) {Q}) AS df, abs(comd_price - lag(comd_price) {Q}) AS dc FROM stopped),
 sized AS (SELECT *, 0.01 / {full("avg(df)", "df", 20)} / fx_price AS fx_size, 0.01 / {full("avg(dc)", "dc", 20)} AS comd_size FROM dd),
 sig AS (SELECT *, fx_size * signal AS fx_position, -comd_size * signal AS comd_position, coalesce(abs(signal - lag(signal) {Q}) = 1, false) AS entry,
  coalesce(signal - lag(signal) {Q} <> 0 AND signal = 0, false) AS exit FROM sized)"""


def stopped_sql(limit: str, close_run: bool = False) -> str:
    hit = "live AND held >= lim" if close_run else "hit"
    return f"""vis AS (SELECT coded.*, CASE WHEN corr_ok THEN pos ELSE 0 END AS shown FROM coded JOIN fold USING (pair, rn)),
 st0 AS (SELECT *, CASE WHEN shown <> 0 AND coalesce(lag(shown) {Q}, 0) = 0 THEN ts END AS t0, lag(ts) {Q} AS pts FROM vis),
 st1 AS (SELECT *, last_value(t0 IGNORE NULLS) {w(None)} AS since, {limit} AS lim FROM st0),
 st2 AS (SELECT *, shown <> 0 AND ts > since AS live, floor((epoch(ts) - epoch(since)) / 86400) AS held, floor((epoch(pts) - epoch(since)) / 86400) AS before FROM st1),
 st3 AS (SELECT *, coalesce(live AND held >= lim AND before < lim, false) AS hit FROM st2),
 stopped AS (SELECT *, hit AS time_stop_exit, CASE WHEN {hit} THEN 0 ELSE shown END AS signal FROM st3)"""


LIMIT = "greatest(2, least(CAST(round_even(3 * half_life, 0) AS INT), 10))"
SIGNALS = (
    f"WITH RECURSIVE {SPREAD}, {GATE}, {STRUCT}, {THRESH}, {flags_sql('thr', 'entry_z_dyn', 'exit_z_dyn', '3.5', 'corr_ok')}, "
    f"{fold_sql('coded')}, {stopped_sql(LIMIT)}, {SIZES}"
)


def backtest_sql(src: str = "sig") -> str:
    return f"""bt0 AS (SELECT *, lag(CAST(signal AS DOUBLE)) {Q} AS delayed_signal, lag(fx_position) {Q} AS dfx, lag(comd_position) {Q} AS dcm,
  fx_price - lag(fx_price) {Q} AS xf, comd_price - lag(comd_price) {Q} AS xc FROM {src}),
 bt1 AS (SELECT *, coalesce(abs(delayed_signal - lag(delayed_signal) {Q}) = 1, false) AS flag, dfx * xf AS fx_pnl, dcm * xc AS comd_pnl,
  CASE WHEN coalesce(delayed_signal - lag(delayed_signal) {Q} = 0, false) THEN 0 ELSE 1 END AS moved FROM bt0),
 bt2 AS (SELECT *, lag(CAST(flag AS INT)) {Q} * (1.0 / 1e4) * abs(dfx) + lag(CAST(flag AS INT)) {Q} * (2.0 / 1e4) * abs(dcm) AS cost FROM bt1),
 bt3 AS (SELECT *, coalesce(fx_pnl + comd_pnl - cost, 0) AS pnl FROM bt2),
 bt4 AS (SELECT *, sum(pnl) {w(None)} AS cumulative_pnl, product(1 + pnl) {w(None)} AS equity, sum(moved) {w(None)} AS trade_id FROM bt3),
 bt5 AS (SELECT *, max(equity) {w(None)} AS peak FROM bt4),
 bt AS (SELECT *, coalesce((equity - peak) / nullif(peak, 0), 0) AS drawdown FROM bt5)"""


def trades_sql(held: str = "delayed_signal <> 0") -> str:
    return f"""trades AS (SELECT pair, trade_id, min(ts) AS entry_date, max(ts) AS exit_date, max(delayed_signal) AS direction, count(*) AS duration, sum(pnl) AS pnl,
 arg_min(fx_price, ts) AS fx_entry, arg_max(fx_price, ts) AS fx_exit, arg_min(comd_price, ts) AS comd_entry, arg_max(comd_price, ts) AS comd_exit,
 arg_min(spread_z, ts) AS entry_z, arg_max(spread_z, ts) AS exit_z, sum(pnl) / (abs(arg_min(fx_price, ts)) + abs(arg_min(comd_price, ts))) AS "return"
 FROM bt WHERE {held} GROUP BY pair, trade_id)"""


def metrics_sql(keys: str = "pair") -> str:
    return f"""mt AS (SELECT {keys}, count(*) AS n_held, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses,
  avg(pnl) FILTER (WHERE pnl > 0) AS aw, avg(pnl) FILTER (WHERE pnl < 0) AS al, sum(pnl) FILTER (WHERE pnl > 0) AS sw, sum(pnl) FILTER (WHERE pnl < 0) AS sl FROM trades GROUP BY {keys}),
 mb AS (SELECT {keys}, sum(pnl) AS total_pnl, arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1, min(drawdown) AS max_drawdown, stddev_samp(pnl) * sqrt(252) AS volatility,
  CASE WHEN stddev_pop(pnl) <= 1e-12 THEN 0 ELSE avg(pnl) * 252 / (stddev_pop(pnl) * sqrt(252)) END AS sharpe_ratio, count(*) AS n,
  date_diff('day', min(ts), max(ts)) AS days_in_backtest, CAST(floor(sum(CAST(flag AS INT)) / 2) AS BIGINT) AS num_trades FROM bt GROUP BY {keys}),
 metrics AS (SELECT {keys}, total_pnl, e1 / e0 - 1 AS total_return, pow(e1 / e0, 252 / n) - 1 AS annual_return, max_drawdown, volatility, sharpe_ratio, num_trades,
  CASE WHEN num_trades > 0 THEN coalesce(wins / n_held, 0) ELSE 0 END AS win_rate, CASE WHEN num_trades > 0 THEN coalesce(aw, 0) ELSE 0 END AS avg_win,
  CASE WHEN num_trades > 0 THEN coalesce(al, 0) ELSE 0 END AS avg_loss,
  CASE WHEN num_trades = 0 THEN 0 WHEN losses > 0 THEN abs(coalesce(sw, 0) / sl) WHEN wins > 0 THEN 999 ELSE 0 END AS profit_factor, days_in_backtest FROM mb LEFT JOIN mt USING ({keys}))"""


BACKTEST = f"{SIGNALS}, {backtest_sql()}"
TRADES = f"{BACKTEST}, {trades_sql()}"
METRICS = f"{TRADES}, {metrics_sql()}"


def configured_sql(pair: str, p: dict) -> str:
    """One pair's backtest rows ``bt`` with its own windows, limits and costs."""
    run = spread_sql(z=p["z_window"]) if p["use_rls"] else windowed_sql(p["beta_window"], p["z_window"])
    vol = ""
    if p["filter_vol"]:
        sd = lambda x: f"coalesce({full(f'stddev_samp({x})', x, p['vol_window'])} < {p['high_vol']}, true)"
        vol = f" AND {sd('rf0')} AND {sd('rc0')}"
    zero = lambda x: f"coalesce({x} / lag({x}) {Q} - 1, 0)"
    gate = f"""g0 AS (SELECT *, {zero("fx_price")} AS rf0, {zero("comd_price")} AS rc0 FROM zs),
 gate AS (SELECT *, coalesce(abs({full("corr(fx_price, comd_price)", "fx_price", p["corr_window"])}) >= {p["min_abs_corr"]}, false){vol} AS corr_ok FROM g0)"""
    struct = STRUCT.replace("adf_p <= 0.10", f"adf_p <= {p['adf_p']}")
    thresh = THRESH.replace("greatest(0.8, 1.5 *", f"greatest(0.8, {p['entry_z']} *").replace("least(1.25, 0.5 /", f"least(1.25, {p['exit_z']} /")
    flags = flags_sql("thr", "entry_z_dyn", "exit_z_dyn", str(p["stop_z"]), "corr_ok")
    stopped = stopped_sql(LIMIT.replace(", 10))", f", {p['max_days']}))"))
    inverse = " / fx_price" if p["inverse_fx"] else ""
    sized = SIZES.replace('0.01 / {0} / fx_price'.format(full("avg(df)", "df", 20)), f"{p['target_vol_per_leg']} / {full('avg(df)', 'df', p['atr_window'])}{inverse}")
    sized = sized.replace('0.01 / {0} AS comd'.format(full("avg(dc)", "dc", 20)), f"{p['target_vol_per_leg']} / {full('avg(dc)', 'dc', p['atr_window'])} AS comd")
    bt = backtest_sql().replace("(1.0 / 1e4)", f"({p['fx_bps']} / 1e4)").replace("(2.0 / 1e4)", f"({p['comd_bps']} / 1e4)")
    only = PAIRS.replace("plist(pair, fx, comd) AS (VALUES", "plist(pair, fx, comd) AS (SELECT * FROM (VALUES") .replace("('N_R', 'N', 'R')),", f"('N_R', 'N', 'R')) AS t(a, b, c) WHERE a = '{pair}'),")
    return f"WITH RECURSIVE {only}, {run}, {gate}, {struct}, {thresh}, {flags}, {fold_sql('coded')}, {stopped}, {sized}, {bt}"


def windowed_sql(beta: int, z: int) -> str:
    """CTEs ``sp`` and ``zs`` with windowed least squares in place of recursive ones."""
    tail = spread_sql(z=z)
    zs = tail[tail.index(" zs AS (") :]
    fit = lambda e: f"CASE WHEN count(ly) {w(beta)} >= {beta} THEN {e} END"
    slope, mean = f"regr_slope(ly, lx) {w(beta)}", lambda c: f"avg({c}) {w(beta)}"
    return f"""num AS (SELECT *, ln(fx_price) AS ly, ln(comd_price) AS lx, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM pairs),
 hedge AS (SELECT *, {fit(slope)} AS lb, {fit(f"{mean('ly')} - {slope} * {mean('lx')}")} AS la FROM num),
 sp AS (SELECT pair, ts, i, fx_price, comd_price, CASE WHEN la IS NOT NULL THEN greatest(exp(la), 1e-8) END AS alpha, CASE WHEN lb IS NOT NULL THEN least(greatest(lb, -10), 10) END AS beta,
  fx_price - alpha * pow(comd_price, beta) AS spread FROM hedge),{zs}"""
