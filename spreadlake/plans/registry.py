"""Registration of queries beside the SQL that states the same result.

A case names its output columns once; both the DataFrame and the SQL select
them with the same casts and roundings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions.rolling import rounded
from spreadlake.session import release_staged, stage

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def shape(df: DataFrame, strs=(), ints=(), floats=(), fine=(), day=None, second=None, dec: int = 6) -> DataFrame:
    cols = [F.col(c).cast("string").alias(c) for c in strs]
    if day:
        cols.append(F.date_format(day, "yyyy-MM-dd").alias("day"))
    if second:
        cols.append(F.date_format(second, "yyyy-MM-dd HH:mm:ss").alias("second"))
    cols += [F.col(c).cast("bigint").alias(c) for c in ints]
    cols += [(rounded(F.col(c).cast("double"), dec) + F.lit(0.0)).alias(c) for c in floats]
    cols += [(rounded(F.col(c).cast("double"), 10) + F.lit(0.0)).alias(c) for c in fine]
    return df.select(*cols)


def shape_sql(ctes: str, src: str, strs=(), ints=(), floats=(), fine=(), day=None, second=None, dec: int = 6) -> str:
    q = lambda c: f'"{c}"'
    cols = [f"CAST({q(c)} AS VARCHAR) AS {q(c)}" for c in strs]
    if day:
        cols.append(f"strftime({day}, '%Y-%m-%d') AS day")
    if second:
        cols.append(f"strftime({second}, '%Y-%m-%d %H:%M:%S') AS second")
    cols += [f"CAST({q(c)} AS BIGINT) AS {q(c)}" for c in ints]
    cols += [f"round(CAST({q(c)} AS DOUBLE), {dec}) + 0.0 AS {q(c)}" for c in floats]
    cols += [f"round(CAST({q(c)} AS DOUBLE), 10) + 0.0 AS {q(c)}" for c in fine]
    return f"{ctes} SELECT {', '.join(cols)} FROM ({src}) AS result_rows"


_STAGED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf: str, key: str, build: Build) -> DataFrame:
    """A staged table that several cases start from (signals, backtest), written once per session."""
    at = (spark.sparkContext.applicationId, sf, key)
    if at not in _STAGED:
        _STAGED[at] = stage(build(spark, sf))
    return _STAGED[at]


def forget_shared(spark: SparkSession | None = None) -> None:
    """Forget the shared tables; given a session, delete all staged files too."""
    _STAGED.clear()
    if spark is not None:
        release_staged(spark)


def case(name: str, build: Build, ctes: str | None = None, src: str | None = None, **cols) -> None:
    QUERIES[name] = lambda spark, sf: shape(build(spark, sf), **cols)
    if src is not None:
        ORACLES[name] = shape_sql(ctes or "", src, **cols)


# --- shared SQL -----------------------------------------------------------------------------------

TICKS = "ticks AS (SELECT event_type AS pair, ts, event_id, value AS price FROM events)"
BARS = """bars AS (SELECT l_returnflag AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS close FROM lineitem GROUP BY 1, 2)"""
PAIRS = BARS + """, plist(pair, fx, comd) AS (VALUES ('A_N', 'A', 'N'), ('A_R', 'A', 'R'), ('N_R', 'N', 'R')),
 pairs AS (SELECT p.pair, f.ts, f.close / 1e4 AS fx_price, c.close / 1e3 AS comd_price
 FROM plist p JOIN bars f ON f.symbol = p.fx JOIN bars c ON c.symbol = p.comd AND c.ts = f.ts)"""
HOURLY = """hourly AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
VIX = """vix AS (SELECT 'VIX' AS pair, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e4 AS vix FROM orders GROUP BY 2)"""
CALENDAR = """calendar AS (SELECT min(CAST(o_orderdate AS DATE)) AS event_date, 'INVENTORY_REPORT' AS event_type, 3 AS impact_days
 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY date_trunc('month', o_orderdate))"""
RETURNS = """rets AS (SELECT *, fx_price / lag(fx_price) OVER (PARTITION BY pair ORDER BY ts) - 1 AS rf,
 comd_price / lag(comd_price) OVER (PARTITION BY pair ORDER BY ts) - 1 AS rc FROM pairs)"""


def w(n: int | None, order: str = "ts", keys: str = "pair") -> str:
    rows = "UNBOUNDED" if n is None else n - 1
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS {rows} PRECEDING)"


def full(agg: str, x: str, n: int, order: str = "ts", keys: str = "pair") -> str:
    win = w(n, order, keys)
    return f"(CASE WHEN count({x}) {win} >= {n} THEN {agg} {win} END)"


def spread_sql(lam: float = 0.995, delta: float = 100.0, src: str = "pairs", z: int = 20) -> str:
    """CTEs ``sp`` (alpha, beta, spread) and ``zs`` (spread_z) over a pair table."""
    run = "OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"""num AS (SELECT *, ln(fx_price) AS ly, ln(comd_price) AS lx, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM {src}),
 sums AS (SELECT *, sum(pow({lam}, -i)) {run} AS a0, sum(pow({lam}, -i) * lx) {run} AS a1, sum(pow({lam}, -i) * lx * lx) {run} AS a2,
  sum(pow({lam}, -i) * ly) {run} AS b0, sum(pow({lam}, -i) * lx * ly) {run} AS b1 FROM num),
 mom AS (SELECT *, pow({lam}, i) * (a0 + 1.0 / {delta}) AS s0, pow({lam}, i) * a1 AS s1, pow({lam}, i) * (a2 + 1.0 / {delta}) AS s2,
  pow({lam}, i) * b0 AS r0, pow({lam}, i) * b1 AS r1 FROM sums),
 hedge AS (SELECT pair, ts, fx_price, comd_price, i, (r0 * s2 - s1 * r1) / (s0 * s2 - s1 * s1) AS la,
  (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS lb FROM mom),
 sp AS (SELECT pair, ts, i, fx_price, comd_price, greatest(exp(la), 1e-8) AS alpha, least(greatest(lb, -10), 10) AS beta,
  fx_price - greatest(exp(la), 1e-8) * pow(comd_price, least(greatest(lb, -10), 10)) AS spread FROM hedge),
 zs AS (SELECT *, CASE WHEN n_z >= {z} AND mad_z <> 0 THEN (spread - med_z) / (1.4826 * mad_z + 1e-12) END AS spread_z FROM (
  SELECT *, count(spread) {w(z)} AS n_z, median(spread) {w(z)} AS med_z, mad(spread) {w(z)} AS mad_z FROM sp))"""


def fold_sql(src: str, keys: str = "pair", max_bars: int | None = None) -> str:
    """CTE ``fold``: the position automaton as a recursion over row numbers.

    ``src`` needs keys, ``rn``, ``raw``, ``lo`` (leave long) and ``so`` (leave short).
    """
    on = " AND ".join(f"b.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    over = f" OR f.held + 1 >= {max_bars}" if max_bars else ""
    step = f"CASE WHEN f.pos = 0 THEN b.raw WHEN (f.pos = 1 AND b.lo) OR (f.pos = -1 AND b.so){over} THEN 0 ELSE f.pos END"
    return f"""src AS MATERIALIZED (SELECT {keys}, rn, CAST(raw AS INT) AS raw, coalesce(lo, false) AS lo, coalesce(so, false) AS so FROM {src}),
 fold AS (SELECT {ks}, b.rn, b.raw AS pos, CASE WHEN b.raw <> 0 THEN 1 ELSE 0 END AS held FROM src b WHERE b.rn = 1
  UNION ALL SELECT {ks}, b.rn, {step},
   CASE WHEN ({step}) = 0 THEN 0 WHEN f.pos = 0 THEN 1 ELSE f.held + 1 END FROM fold f JOIN src b ON {on} AND b.rn = f.rn + 1)"""
