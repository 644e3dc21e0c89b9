"""Live forms: bars from ticks, rolling statistics, signal state, risk monitor, blackout tags."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spreadlake.operators.hedge import ALPHA_FLOOR, BETA_LIMIT, LOG_FLOOR
from spreadlake.operators.risk import Limits


def live_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end."""
    o = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(
            F.min_by("open", o).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", o).alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def live_stats(ticks: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sliding-window mean, deviation and count of the price."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width, step))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"))
        .select("symbol", F.col("window.end").alias("ts"), "n", "mean", "std")
    )


def tag_live(bars: DataFrame, blackout_days: DataFrame) -> DataFrame:
    """Stream-static join with the calendar's covered days."""
    days = blackout_days.withColumn("is_blackout", F.lit(True))
    return bars.withColumn("day", F.to_date("ts")).join(days, "day", "left").withColumn(
        "is_blackout", F.coalesce("is_blackout", F.lit(False))
    ).drop("day")


@dataclass(frozen=True)
class SpreadRule:
    """Recursive hedge ratio and position of one pair, bar by bar.

    The state is five decayed sums, the last spreads for the robust z-score and
    the position: constant size per pair.
    """

    lam: float
    delta: float
    window: int
    entry: float
    exit: float
    stop: float

    def begin(self) -> tuple:
        return [1 / self.delta, 0.0, 1 / self.delta, 0.0, 0.0], [], 0

    def step(self, state: tuple, fx: float | None, comd: float | None) -> tuple[tuple, tuple]:
        """The state after a bar and its spread, z-score and position."""
        import numpy as np

        sums, recent, pos = state
        if all(p is not None and np.isfinite(p) and p > 0 for p in (fx, comd)):
            y, x = np.log(fx), np.log(comd)
            x = x if abs(x) >= LOG_FLOOR else LOG_FLOOR
            sums = [float(self.lam * s + d) for s, d in zip(sums, (1.0, x, x * x, y, x * y))]
            s0, s1, s2, r0, r1 = sums
            det = s0 * s2 - s1 * s1
            alpha = max(np.exp((r0 * s2 - s1 * r1) / det), ALPHA_FLOOR)
            beta = min(max((s0 * r1 - s1 * r0) / det, -BETA_LIMIT), BETA_LIMIT)
            spread = float(fx - alpha * comd**beta)
        elif recent:
            spread = recent[-1]  # as in the batch: a bar without two prices takes the previous spread
        else:
            return state, (None, None, 0)
        recent = (recent + [spread])[-self.window :]
        z = None
        if len(recent) == self.window:
            med = float(np.median(recent))
            mad = float(np.median(np.abs(np.array(recent) - med)))
            z = (spread - med) / (1.4826 * mad + 1e-12) if mad else None
        if z is not None:
            if pos == 0:
                pos = 1 if z <= -self.entry else (-1 if z >= self.entry else 0)
            elif pos * z >= -self.exit or pos * z <= -self.stop:
                pos = 0
        return (sums, recent, pos), (spread, z, pos)


SPREAD_STATE_SCHEMA = "pair string, ts timestamp, spread double, spread_z double, signal int"


class SpreadState(StatefulProcessor):
    """A pair's bars as they come, sorted inside a batch only."""

    def __init__(self, rule: SpreadRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("spread", "sums array<double>, recent array<double>, position int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        state = self.rule.begin()
        if self._state.exists():
            sums, recent, pos = self._state.get()
            state = list(sums), list(recent), pos
        out = []
        bars = pd.concat(list(rows)).sort_values("ts")
        for ts, fx, comd in zip(bars["ts"], bars["fx_price"], bars["comd_price"]):
            state, said = self.rule.step(state, fx, comd)
            out.append((key[0], ts, *said))
        self._state.update(state)
        yield pd.DataFrame(out, columns=["pair", "ts", "spread", "spread_z", "signal"])

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows of a key held back until the watermark has passed them, then worked off in time order.

    The pending rows are part of the state; a timer stands at the earliest of
    them, so a key goes on with the watermark even if no row of its own comes.
    Rows below the watermark are dropped by Spark and counted in the query's
    progress (:func:`late_rows`).  Rows of one time are worked off together,
    ordered by their label and values.
    """

    #: Columns of a row: its time ``ts``, the label and the numbers.
    label: str
    numbers: tuple[str, ...]
    #: Schema of the state beside the pending rows.
    schema: str
    out: list[str]

    def begin(self) -> tuple:
        raise NotImplementedError

    def advance(self, key, state: tuple, ts: pd.Timestamp, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state after all rows of one time, each (label, *numbers), and the output rows."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("ordered", f"us array<bigint>, labels array<string>, numbers array<double>, {self.schema}")

    def _read(self) -> tuple[list[tuple], tuple]:
        if not self._state.exists():
            return [], self.begin()
        us, labels, numbers, *own = self._state.get()
        k = len(self.numbers)
        pending = [(t, x, *numbers[i * k : i * k + k]) for i, (t, x) in enumerate(zip(us, labels))]
        return pending, tuple(list(v) if isinstance(v, (list, tuple)) else v for v in own)

    def _write(self, pending: list[tuple], state: tuple) -> None:
        self._state.update(([p[0] for p in pending], [p[1] for p in pending], [v for p in pending for v in p[2:]], *state))
        if pending:
            self._handle.registerTimer(-(-min(p[0] for p in pending) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        pending, state = self._read()
        for frame in rows:
            us = frame["ts"].astype("datetime64[us]").astype("int64")
            values = [[None if v != v else float(v) for v in frame[c].astype(float)] for c in self.numbers]
            pending.extend(zip(us.tolist(), frame[self.label].tolist(), *values))
        self._write(pending, state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, state = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((p for p in pending if p[0] <= passed), key=lambda p: (p[0], str(p[1]), *[(v is None, v or 0.0) for v in p[2:]]))
        out: list[tuple] = []
        for us, group in groupby(ready, key=lambda p: p[0]):
            state, said = self.advance(key, state, pd.Timestamp(us, unit="us"), [p[1:] for p in group])
            out.extend(said)
        self._write([p for p in pending if p[0] > passed], state)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class OrderedSpread(InOrder):
    label, numbers = "pair", ("fx_price", "comd_price")
    schema = "sums array<double>, recent array<double>, position int"
    out = ["pair", "ts", "spread", "spread_z", "signal"]

    def __init__(self, rule: SpreadRule) -> None:
        self.rule = rule

    def begin(self) -> tuple:
        return self.rule.begin()

    def advance(self, key, state, ts, rows):
        out = []
        for _, fx, comd in rows:
            state, said = self.rule.step(state, fx, comd)
            out.append((key[0], ts, *said))
        return state, out


def live_signals(
    bars: DataFrame, entry: float = 1.5, exit_: float = 0.5, stop: float = 3.5, window: int = 20, lam: float = 0.995, delta: float = 100.0, late: str | None = None
) -> DataFrame:
    """Spread, z-score and position of every bar.

    By default bars are worked off as they come, ordered inside a batch.  With
    ``late`` they may come out of order by that much: a bar is worked off when
    the watermark has passed it, in time order whatever the batches are, so the
    result is that of the batch plan.
    """
    rule = SpreadRule(lam, delta, window, entry, exit_, stop)
    if late is None:
        return bars.groupBy("pair").transformWithStateInPandas(
            statefulProcessor=SpreadState(rule), outputStructType=SPREAD_STATE_SCHEMA, outputMode="Append", timeMode="None"
        )
    return bars.withWatermark("ts", late).groupBy("pair").transformWithStateInPandas(
        statefulProcessor=OrderedSpread(rule), outputStructType=SPREAD_STATE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def late_rows(query) -> int:
    """Rows of a stream that came after the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


class RiskState(StatefulProcessor):
    """Day and week profit of one pair with breach flags; resets at calendar borders."""

    def __init__(self, daily: float, weekly: float) -> None:
        self.daily, self.weekly = daily, weekly

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("risk", "day string, week string, day_pnl double, week_pnl double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        day, week, dp, wp = self._state.get() if self._state.exists() else ("", "", 0.0, 0.0)
        out = []
        for ts, pnl in pd.concat(list(rows)).sort_values("ts")[["ts", "pnl"]].itertuples(index=False):
            d, w = str(ts.date()), "%d-%02d" % ts.isocalendar()[:2]
            dp, wp = (dp if d == day else 0.0) + pnl, (wp if w == week else 0.0) + pnl
            day, week = d, w
            out.append((key[0], ts, dp, wp, dp < -self.daily, wp < -self.weekly))
        self._state.update((day, week, dp, wp))
        yield pd.DataFrame(out, columns=["pair", "ts", "daily_pnl", "weekly_pnl", "daily_breach", "weekly_breach"])

    def close(self) -> None:
        pass


RISK_STATE_SCHEMA = "pair string, ts timestamp, daily_pnl double, weekly_pnl double, daily_breach boolean, weekly_breach boolean"


def live_risk(pnl: DataFrame, daily: float = 0.02, weekly: float = 0.05) -> DataFrame:
    return pnl.groupBy("pair").transformWithStateInPandas(
        statefulProcessor=RiskState(daily, weekly), outputStructType=RISK_STATE_SCHEMA, outputMode="Append", timeMode="None"
    )


class PairRisk(InOrder):
    """Day, week and drawdown figures of one pair, in time order."""

    label, numbers = "pair", ("pnl", "equity", "gross")
    schema = "day string, week string, day_pnl double, week_pnl double, peak double, high double"
    out = ["account", "pair", "ts", "pnl", "gross", "daily_pnl", "weekly_pnl", "drawdown", "day_drawdown"]

    def begin(self) -> tuple:
        return "", "", 0.0, 0.0, None, None

    def advance(self, key, state, ts, rows):
        day, week, dp, wp, peak, high = state
        d, w = _periods(ts)
        out = []
        for pair, pnl, equity, gross in rows:
            dp, wp = (dp if d == day else 0.0) + (pnl or 0.0), (wp if w == week else 0.0) + (pnl or 0.0)
            drawdown = day_drawdown = None
            if equity is not None:
                peak = equity if peak is None else max(peak, equity)
                high = equity if d != day or high is None else max(high, equity)
                drawdown = (equity - peak) / peak if peak else 0.0
                day_drawdown = (equity - high) / high if high else None
            day, week = d, w
            out.append((key[0], pair, ts, pnl, gross, dp, wp, drawdown, day_drawdown))
        return (day, week, dp, wp, peak, high), out


def _periods(ts: pd.Timestamp) -> tuple[str, str]:
    return str(ts.date()), "%d-%02d" % ts.isocalendar()[:2]


class AccountRisk(InOrder):
    """Limits, breaker and exposure of an account: all its pairs' rows of one time together.

    A trigger halts the account from its day on; the last halted day is kept, so
    the cooldown ends with event time.
    """

    label, numbers = "pair", ("pnl", "gross", "daily_pnl", "weekly_pnl", "drawdown", "day_drawdown")
    schema = "day string, week string, day_pnl double, week_pnl double, halted_to bigint"
    out = [
        "account", "pair", "ts", "daily_pnl", "weekly_pnl", "account_daily", "account_weekly", "exposure", "drawdown_breach", "daily_breach", "weekly_breach",
        "account_daily_breach", "account_weekly_breach", "day_drawdown_breach", "exposure_breach", "breaker_active", "can_trade",
    ]

    def __init__(self, limits: Limits, stake: float) -> None:
        self.limits, self.stake = limits, stake

    def begin(self) -> tuple:
        return "", "", 0.0, 0.0, -1

    def advance(self, key, state, ts, rows):
        m = self.limits
        day, week, dp, wp, halted = state
        d, w = _periods(ts)
        total = math.fsum(r[1] or 0.0 for r in rows)
        dp, wp = (dp if d == day else 0.0) + total, (wp if w == week else 0.0) + total
        exposure = math.fsum(r[2] or 0.0 for r in rows) / self.stake
        today = ts.toordinal()
        if any(r[3] < -m.daily_loss for r in rows):
            halted = max(halted, today + m.cooldown_days - 1)
        out = []
        for pair, _, _, daily, weekly, drawdown, day_drawdown in rows:
            under = lambda x, limit: x is not None and x < -limit
            flags = [
                under(drawdown, m.max_drawdown), under(daily, m.daily_loss), under(weekly, m.weekly_loss), dp < -m.daily_loss, wp < -m.weekly_loss, under(day_drawdown, m.daily_drawdown),
            ]
            active = today <= halted
            out.append((key[0], pair, ts, daily, weekly, dp, wp, exposure, *flags, exposure > m.total_exposure, active, not (active or any(flags))))
        return (d, w, dp, wp, halted), out


PAIR_RISK_SCHEMA = "account string, pair string, ts timestamp, pnl double, gross double, daily_pnl double, weekly_pnl double, drawdown double, day_drawdown double"
ACCOUNT_RISK_SCHEMA = (
    "account string, pair string, ts timestamp, daily_pnl double, weekly_pnl double, account_daily double, account_weekly double, exposure double, "
    + ", ".join(f"{c} boolean" for c in AccountRisk.out[8:])
)


def live_account_risk(rows: DataFrame, limits: Limits = Limits(), stake: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """All risk limits of every pair and account on a stream of backtest rows.

    Takes ``account, pair, ts, pnl, equity, fx_position, comd_position, fx_price,
    comd_price``.  The pairs' state feeds the accounts' state; both hold rows
    back until the watermark has passed them, so an account sees all pairs of a
    time at once and rows may come out of order by ``late``.  The breaker halts
    from the bar of its trigger on (all bars of that time included); the batch
    form halts its whole day.
    """
    gross = F.abs(F.col("fx_position") * F.col("fx_price")) + F.abs(F.col("comd_position") * F.col("comd_price"))
    given = rows.select("account", "pair", "ts", "pnl", "equity", gross.alias("gross")).withWatermark("ts", late)
    pairs = given.groupBy("account", "pair").transformWithStateInPandas(
        statefulProcessor=PairRisk(), outputStructType=PAIR_RISK_SCHEMA, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts"
    )
    return pairs.groupBy("account").transformWithStateInPandas(
        statefulProcessor=AccountRisk(limits, stake), outputStructType=ACCOUNT_RISK_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
