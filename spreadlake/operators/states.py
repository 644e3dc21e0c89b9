"""Position state machine over segmented series.

A position depends on every earlier bar (entries are ignored while a trade is
open), which no window aggregate can express.  Each bar is one of a few input
codes, each code maps the finite set of states onto itself, and such maps
compose: a segment is summarised by where it takes each possible start state.
One row per segment is folded per series to find every segment's true start
state, and the bars are then replayed in parallel, segment by segment.  Inside a
segment the same is done again with rows of bars, so no step handles one bar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlake.functions.rolling import holds
from spreadlake.series import OWN, SEG, Frame, PAIR, position

_NO_TS = np.iinfo(np.int64).min


def transitions(max_bars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``(next_state[code, state], side[state])``.

    States: flat, then long held 1..m bars, then short held 1..m bars.  Codes:
    ``4 * (raw + 1) + 2 * long_out + short_out``.
    """
    m = 1 if max_bars is None else max(1, max_bars - 1)
    side = np.concatenate([[0], np.ones(m, int), -np.ones(m, int)])
    held = np.concatenate([[0], np.arange(1, m + 1), np.arange(1, m + 1)])
    table = np.zeros((12, len(side)), dtype=np.int16)
    for code in range(12):
        raw, out = code // 4 - 1, {1: code // 2 % 2 == 1, -1: code % 2 == 1}
        for s in range(len(side)):
            if side[s] == 0:
                nxt = 0 if raw == 0 else (1 if raw > 0 else 1 + m)
            elif out[side[s]] or (max_bars is not None and held[s] + 1 >= max_bars):
                nxt = 0
            else:
                nxt = s if max_bars is None else s + 1
            table[code, s] = nxt
    return table, side


def _columns(t: pa.Table, tail: int):
    """Row order by position and the bounds of the own and tail-extended ranges."""
    order = np.argsort(t["_pos"].to_numpy(), kind="stable")
    own = t[OWN].to_numpy(zero_copy_only=False)[order]
    first = int(np.argmax(own)) if own.any() else -1
    return order, own, first, max(0, first - tail)


class Blocks:
    """Bars ``begin..stop`` laid out as rows of about the square root of their number.

    All rows step together, so a segment of ``n`` bars takes about ``sqrt(n)``
    NumPy steps to compose and as many to chain, instead of one per bar.
    """

    def __init__(self, code: np.ndarray, gate: np.ndarray, ts: np.ndarray, begin: int, stop: int):
        n = max(0, stop - begin)
        self.n, self.width = n, max(1, int(np.sqrt(n)))
        self.rows = -(-n // self.width)
        fill = self.rows * self.width - n
        lay = lambda x: np.concatenate([x[begin:stop], np.zeros(fill, x.dtype)]).reshape(self.rows, self.width)
        self.code, self.gate, self.ts = lay(code), lay(gate), lay(ts)
        self.real = lay(np.ones(len(code), dtype=bool))
        # whether the bar before each row was open
        before = np.arange(self.rows) * self.width + begin - 1
        self.open = np.where(before >= 0, gate[np.maximum(before, 0)], False) if n else np.zeros(0, dtype=bool)

    def composed(self, table: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and start state: the state after the row, and the start of the run that is visible then.

        That start is -1 where the run was visible before the row, ``_NO_TS``
        where none is.
        """
        states = len(side)
        cur = np.broadcast_to(np.arange(states), (self.rows, states)).copy()
        since = np.full((self.rows, states), -1, dtype=np.int64)
        shown = (side[cur] != 0) & self.open[:, None]
        for i in range(self.width):
            real = self.real[:, i, None]
            cur = np.where(real, table[self.code[:, i, None], cur], cur)
            now = np.where(real, (side[cur] != 0) & self.gate[:, i, None], shown)
            since = np.where(now & ~shown, self.ts[:, i, None], np.where(now, since, _NO_TS))
            shown = now
        return cur, since

    def starts(self, cur: np.ndarray, since: np.ndarray, state: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        """State and run start before each row, from those before the first."""
        states, runs = np.empty(self.rows, dtype=np.int64), np.empty(self.rows, dtype=np.int64)
        for r in range(self.rows):
            states[r], runs[r] = state, run
            run = run if since[r, state] == -1 else int(since[r, state])
            state = int(cur[r, state])
        return states, runs

    def replayed(self, table: np.ndarray, side: np.ndarray, state: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Visible side and start of its run at every bar, all rows at once."""
        signal, since = np.zeros(self.code.shape, dtype=np.int32), np.full(self.code.shape, _NO_TS, dtype=np.int64)
        shown = (side[state] != 0) & self.open
        for i in range(self.width):
            state = table[self.code[:, i], state]
            now = (side[state] != 0) & self.gate[:, i]
            run = np.where(now, np.where(shown, run, self.ts[:, i]), _NO_TS)
            signal[:, i], since[:, i] = np.where(now, side[state], 0), run
            shown = now
        return signal.ravel()[: self.n], since.ravel()[: self.n]


def _start_map(max_bars: int | None, tail: int, keys: list[str]):
    def run(t: pa.Table) -> pa.Table:
        table, side = transitions(max_bars)
        order, own, first, begin = _columns(t, tail)
        if first < 0:
            return t.select(keys).slice(0, 0).append_column("_map", pa.array([], pa.list_(pa.int64()))).append_column(
                "_since", pa.array([], pa.list_(pa.int64()))
            )
        code = t["_code"].to_numpy()[order]
        gate = t["_gate"].to_numpy(zero_copy_only=False)[order]
        # the next segment of the series starts its replay `tail` bars before its own rows
        rows = Blocks(code, gate, t["_us"].to_numpy()[order], begin, max(begin, len(code) - tail))
        cur, since = np.arange(len(side)), np.full(len(side), -1, dtype=np.int64)  # -1: inherited from the start state
        for maps, runs in zip(*rows.composed(table, side)):
            since = np.where(runs[cur] == -1, since, runs[cur])
            cur = maps[cur]
        out = {k: pa.array([t[k][0].as_py()], t.schema.field(k).type) for k in keys}
        out["_map"] = pa.array([cur.tolist()], pa.list_(pa.int64()))
        out["_since"] = pa.array([since.tolist()], pa.list_(pa.int64()))
        return pa.table(out)

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """True start state of each segment; one row per segment, not per bar."""
    pdf = pdf.sort_values(SEG)
    state, since, starts, sinces = 0, _NO_TS, [], []
    for m, s in zip(pdf["_map"], pdf["_since"]):
        starts.append(state)
        sinces.append(since)
        since = since if s[state] == -1 else int(s[state])
        state = int(m[state])
    return pdf.drop(columns=["_map", "_since"]).assign(_start=starts, _from=sinces)


def _replay(max_bars: int | None, tail: int):
    def run(t: pa.Table) -> pa.Table:
        table, side = transitions(max_bars)
        order, own, first, begin = _columns(t, tail)
        n = len(order)
        signal, since = np.zeros(n, dtype=np.int32), np.full(n, _NO_TS, dtype=np.int64)
        if first >= 0:
            code = t["_code"].to_numpy()[order]
            gate = t["_gate"].to_numpy(zero_copy_only=False)[order]
            rows = Blocks(code, gate, t["_us"].to_numpy()[order], begin, n)
            run_from = t["_from"][0].as_py()
            before = rows.starts(*rows.composed(table, side), int(t["_start"][0].as_py() or 0), _NO_TS if run_from is None else run_from)
            signal[begin:], since[begin:] = rows.replayed(table, side, *before)
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        since = since[back]
        keep = [c for c in t.column_names if c not in ("_code", "_gate", "_us", "_pos", "_start", "_from")]
        out = t.select(keep).append_column("signal", pa.array(signal[back], pa.int32()))
        return out.append_column("_since_us", pa.array(since, pa.int64(), mask=since == _NO_TS))

    return run


def position_states(
    df: DataFrame, enter_long: Column, enter_short: Column, long_out: Column, short_out: Column,
    gate: Column | None = None, max_bars: int | None = None, tail: int = 4, f: Frame = PAIR,
) -> DataFrame:
    """Add ``signal`` (-1, 0, +1) and ``since`` (start of the visible run).

    ``gate`` hides a position without ending it, as an external filter applied
    after the state machine does.  ``tail`` halo bars before each segment's own
    rows also carry the right signal, so short lags may follow.
    """
    raw = F.when(holds(enter_short), F.lit(-1)).when(holds(enter_long), F.lit(1)).otherwise(F.lit(0))
    bit = lambda c: holds(c).cast("int")
    off, row = position(f)
    keys = list(f.keys)
    coded = df.withColumns(
        {
            "_code": (raw + 1) * 4 + bit(long_out) * 2 + bit(short_out),
            "_gate": holds(gate) if gate is not None else F.lit(True),
            "_us": F.unix_micros(F.col(f.order[0]).cast("timestamp")),
            "_pos": off + row,
        }
    )
    key_schema = [df.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    map_schema = T.StructType([*key_schema, T.StructField("_map", longs), T.StructField("_since", longs)])
    start_schema = T.StructType(
        [*key_schema, T.StructField("_start", T.LongType()), T.StructField("_from", T.LongType())]
    )
    maps = (
        coded.select(*keys, OWN, "_pos", "_code", "_gate", "_us")
        .groupBy(*keys)
        .applyInArrow(_start_map(max_bars, tail, keys), map_schema)
    )
    starts = maps.groupBy(*f.series_keys).applyInPandas(_chain, start_schema)
    joined = coded.join(starts, keys, "left")
    out_schema = T.StructType(
        [*df.schema.fields, T.StructField("signal", T.IntegerType()), T.StructField("_since_us", T.LongType())]
    )
    replayed = joined.groupBy(*keys).applyInArrow(_replay(max_bars, tail), out_schema)
    return replayed.withColumn("since", F.timestamp_micros("_since_us")).drop("_since_us")
