"""The position scan against a plain loop over bars."""

import numpy as np
import pytest

from spreadlake.operators.states import _NO_TS, Blocks, transitions


def plain(code, gate, ts, begin, stop, table, side, state, run):
    shown = bool(side[state] != 0 and begin and gate[begin - 1])
    signal, since = [], []
    for i in range(begin, stop):
        state = int(table[code[i], state])
        now = bool(side[state] != 0 and gate[i])
        run = (run if shown else int(ts[i])) if now else _NO_TS
        signal.append(int(side[state]) if now else 0)
        since.append(run)
        shown = now
    return signal, since, state, run if shown else _NO_TS


@pytest.mark.parametrize("max_bars", [None, 1, 2, 5, 24])
@pytest.mark.parametrize("n,begin,stop", [(0, 0, 0), (1, 0, 1), (7, 3, 7), (500, 4, 496), (1000, 0, 1000), (997, 1, 990)])
def test_blocks(max_bars, n, begin, stop):
    rng = np.random.default_rng(n + (max_bars or 0))
    table, side = transitions(max_bars)
    code, gate, ts = rng.choice(12, n, p=[0.02, 0.02, 0.02, 0.02, 0.4, 0.16, 0.16, 0.12, 0.02, 0.02, 0.02, 0.02]), rng.random(n) < 0.8, np.arange(n, dtype=np.int64) * 7
    rows = Blocks(code, gate, ts, begin, stop)
    cur, since = rows.composed(table, side)
    whole, runs = np.arange(len(side)), np.full(len(side), -1, dtype=np.int64)
    for m, r in zip(cur, since):
        runs = np.where(r[whole] == -1, runs, r[whole])
        whole = m[whole]
    for start in range(len(side)):
        run = 12345 if side[start] and begin and gate[begin - 1] else _NO_TS
        signal, at, end, last = plain(code, gate, ts, begin, stop, table, side, start, run)
        got = rows.replayed(table, side, *rows.starts(cur, since, start, run))
        assert got[0].tolist() == signal and got[1].tolist() == at
        assert whole[start] == end
        if stop > begin:
            assert (run if runs[start] == -1 else runs[start]) == last


def test_blocks_are_quick():
    """Ten million bars take seconds, and twice the bars about twice the time."""
    import time

    rng = np.random.default_rng(1)
    table, side = transitions(None)

    def seconds(n):
        code, gate, ts = rng.integers(0, 12, n), rng.random(n) < 0.9, np.arange(n, dtype=np.int64)
        t = time.perf_counter()
        rows = Blocks(code, gate, ts, 0, n)
        rows.replayed(table, side, *rows.starts(*rows.composed(table, side), 0, _NO_TS))
        return time.perf_counter() - t

    assert seconds(10_000_000) < 60
