"""Parameter sweeps in one copy of the bars.

Every parameter set is a state machine over the same z-scores.  A task holds the
bars of one segment once and works the sets off as arrays; what leaves it is one
row per segment, set and range: the composed state map first, then counts, sums,
product and extremes of the returns, at last the drawdown under the equity
carried in.  The summaries combine in segment order, so no bar is copied per set
and no window spans a series.

A *range* is a run of rows of a series (a fold's part, or the whole series); its
equity starts at one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlake.operators.states import _NO_TS, Blocks, transitions
from spreadlake.series import OWN, PAIR, SEG, Frame, position
from spreadlake.session import stage

Combos = list[tuple[int, float, float, float]]
#: Bars before a segment's own ones from which its replay starts.
TAIL = 4


def codes(z: np.ndarray, entry: float, exit_: float, stop: float) -> np.ndarray:
    """Input codes of the state machine; a missing z-score enters and leaves nothing."""
    raw = np.where(z >= entry, -1, np.where(z <= -entry, 1, 0))
    long_out, short_out = (z >= -exit_) | (z <= -stop), (z <= exit_) | (z >= stop)
    return (raw + 1) * 4 + long_out * 2 + short_out


class Segment:
    """The bars of one segment in order, with its own range of rows."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t["_row"].to_numpy(), kind="stable")
        self.row = t["_row"].to_numpy()[order]
        own = t[OWN].to_numpy(zero_copy_only=False)[order]
        self.first = int(np.argmax(own)) if own.any() else -1
        self.begin = max(0, self.first - TAIL)
        self.z = t["spread_z"].to_numpy(zero_copy_only=False)[order].astype(float)
        self.change = np.diff(t["spread"].to_numpy(zero_copy_only=False)[order].astype(float), prepend=np.nan)
        self.table, self.side = transitions(None)
        self.none = np.zeros(len(self.z), dtype=np.int64)
        self.open = np.ones(len(self.z), dtype=bool)

    def blocks(self, combo, stop: int) -> Blocks:
        return Blocks(codes(self.z, *combo[1:]), self.open, self.none, self.begin, stop)

    def map(self, combo) -> np.ndarray:
        """Where each start state ends, at the bar from which the next segment's replay starts."""
        cur = np.arange(len(self.side))
        for step in self.blocks(combo, max(self.begin, len(self.z) - TAIL)).composed(self.table, self.side)[0]:
            cur = step[cur]
        return cur

    def traded(self, combo, start: int):
        """Of the own bars: signal, signal before (NaN at a series' first bar) and return of the position held."""
        rows = self.blocks(combo, len(self.z))
        signal = rows.replayed(self.table, self.side, *rows.starts(*rows.composed(self.table, self.side), start, _NO_TS))[0]
        at = self.first - self.begin
        before = np.concatenate([[np.nan if at == 0 else signal[at - 1]], signal[at:-1]]).astype(float)
        return signal[at:], before, before * self.change[self.first :]


def _maps(combos: Combos, keys: list[str]):
    def run(t: pa.Table) -> pa.Table:
        s = Segment(t)
        names = [*keys, "maps", "low", "high"]
        if s.first < 0:
            return pa.table({n: pa.array([], pa.list_(pa.int64()) if n == "maps" else t.schema.field(n).type if n in keys else pa.int64()) for n in names})
        out = {k: pa.array([t[k][0].as_py()], t.schema.field(k).type) for k in keys}
        out["maps"] = pa.array([np.concatenate([s.map(c) for c in combos]).tolist()], pa.list_(pa.int64()))
        out["low"], out["high"] = pa.array([int(s.row[s.first])]), pa.array([int(s.row[-1])])
        return pa.table(out)

    return run


def _starts(n_states: int):
    def run(pdf):
        """Start state of every set before each segment of a series; one row per segment."""
        pdf = pdf.sort_values(SEG)
        state, out = None, []
        for m in pdf["maps"]:
            m = np.asarray(m).reshape(-1, n_states)
            state = np.zeros(len(m), dtype=int) if state is None else state
            out.append(state.tolist())
            state = m[np.arange(len(m)), state]
        return pdf.drop(columns=["maps"]).assign(starts=out)

    return run


SUMS = ("n", "k", "chg", "wins", "act", "inner_runs", "inner_bars", "head", "tail")
FLOATS = ("s", "q", "gain", "loss", "product", "hi", "lo")


def _equity(r: np.ndarray, fill: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bars that count for equity and their running product."""
    seen = np.ones(len(r), dtype=bool) if fill else ~np.isnan(r)
    return seen, np.cumprod(1.0 + np.nan_to_num(r[seen]))


def _figures(signal, before, r, fill: bool) -> dict:
    told = ~np.isnan(r)
    x = r[told]
    chg = (signal != before) & ~np.isnan(before)
    counted = (chg | (~np.isnan(before) & (signal != 0))).astype(np.int64)
    at = np.flatnonzero(chg)
    runs = np.add.reduceat(counted, at) if len(at) else np.zeros(0, dtype=np.int64)
    inner = runs[:-1]
    _, e = _equity(r, fill)
    return {
        "n": len(r), "k": len(x), "chg": len(at), "wins": int((x > 0).sum()), "act": int((signal != 0).sum()),
        "inner_runs": int((inner > 0).sum()), "inner_bars": int(inner.sum()), "head": int(counted[: at[0]].sum() if len(at) else counted.sum()), "tail": int(runs[-1]) if len(at) else 0,
        "s": float(x.sum()), "q": float((x * x).sum()), "gain": float(x[x > 0].sum()), "loss": float(x[x < 0].sum()),
        "product": float(e[-1]) if len(e) else 1.0, "hi": float(e.max()) if len(e) else None, "lo": float(e.min()) if len(e) else None,
    }


def _each_range(s: Segment, ranges: pa.Table):
    """For every range that meets the segment: its row in the table and the slice of own bars."""
    own = s.row[s.first :]
    for i, (low, high) in enumerate(zip(ranges["first_row"].to_pylist(), ranges["last_row"].to_pylist())):
        a, b = np.searchsorted(own, low), np.searchsorted(own, high, side="right")
        if a < b:
            yield i, slice(int(a), int(b))


def _task(combos: Combos, labels: list[str], schema: pa.Schema, fill: bool, last: bool):
    def run(t: pa.Table, ranges: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in schema.names}
        if t.num_rows and ranges.num_rows:
            s = Segment(t)
            starts = ranges["starts"][0].as_py()
            spans = list(_each_range(s, ranges))
            told = {c: ranges[c].to_pylist() for c in labels + (["cp", "cm"] if last else [])}
            for p, combo in enumerate(combos):
                signal, before, r = s.traded(combo, int(starts[p]))
                for i, span in spans:
                    for c in labels:
                        out[c].append(told[c][i])
                    out["param_id"].append(combo[0])
                    if last:
                        out["dd"].append(_drawdown(r[span], told["cp"][i][p], told["cm"][i][p], fill))
                        continue
                    for c, v in _figures(signal[span], before[span], r[span], fill).items():
                        out[c].append(v)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema}, schema=schema)

    return run


def _drawdown(r: np.ndarray, carried: float, top: float | None, fill: bool) -> float | None:
    """Deepest fall below the peak so far, with the product and peak of earlier segments."""
    _, e = _equity(r, fill)
    e = carried * e
    peak = np.maximum.accumulate(e) if top is None else np.maximum(np.maximum.accumulate(e), top)
    fall = (e - peak)[peak != 0] / peak[peak != 0]
    return float(fall.min()) if len(fall) else None


def whole(bars: DataFrame, f: Frame = PAIR) -> DataFrame:
    """One range per series: all its rows."""
    return bars.filter(OWN).select(*f.series_keys).distinct().select(*f.series_keys, F.lit(1).cast("long").alias("first_row"), F.lit((1 << 62)).cast("long").alias("last_row"))


def numbered(z_bars: DataFrame, f: Frame = PAIR) -> DataFrame:
    """The columns a sweep needs, with each bar's row number in its series, staged."""
    off, row = position(f)
    return stage(z_bars.select(*f.keys, OWN, *f.order, "spread", "spread_z", (off + row).cast("long").alias("_row")))


def scores(bars: DataFrame, combos: Combos, ranges: DataFrame, labels: list[str], fill: bool = False, f: Frame = PAIR) -> DataFrame:
    """Sums of every series, range and parameter set from :func:`numbered` bars.

    ``ranges`` has the series keys, ``labels``, ``first_row`` and ``last_row``.
    ``fill`` counts a missing return as zero in the equity.
    """
    keys, series = list(f.keys), list(f.series_keys)
    key_fields = [bars.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    lean = bars.select(*keys, OWN, "_row", "spread", "spread_z")
    map_schema = T.StructType([*key_fields, T.StructField("maps", longs), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    maps = lean.groupBy(*keys).applyInArrow(_maps(combos, keys), map_schema)
    start_schema = T.StructType([*key_fields, *map_schema.fields[-2:], T.StructField("starts", longs)])
    starts = maps.groupBy(*series).applyInPandas(_starts(len(transitions(None)[1])), start_schema)
    met = starts.join(ranges, series).filter((F.col("first_row") <= F.col("high")) & (F.col("last_row") >= F.col("low"))).drop("low", "high")
    met = stage(met)
    row_labels = keys + labels
    label_fields = [met.schema[c] for c in row_labels]

    def compare(right: DataFrame, values: list[T.StructField], last: bool) -> DataFrame:
        schema = T.StructType([*label_fields, T.StructField("param_id", T.IntegerType()), *values])
        from pyspark.sql.pandas.types import to_arrow_schema

        task = _task(combos, row_labels, to_arrow_schema(schema), fill, last)
        return lean.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: task(a, b), schema)

    right = met.select(*[F.col(c).alias(c) for c in met.columns])
    sums = stage(compare(right, [T.StructField(c, T.LongType()) for c in SUMS] + [T.StructField(c, T.DoubleType()) for c in FLOATS], False))
    group = [*series, *labels, "param_id"]
    before = Window.partitionBy(*group).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("cp", F.coalesce(F.product("product").over(before), F.lit(1.0))).withColumn("top", F.greatest(F.col("cp") * F.col("hi"), F.col("cp") * F.col("lo")))
    carry = carry.withColumns({"cm": F.max("top").over(before), "run": F.coalesce(F.sum("chg").over(before), F.lit(0))})
    carry = stage(carry.select(*keys, *labels, "param_id", "cp", "cm", "run"))
    place = F.array_position(F.array(*[F.lit(c[0]) for c in combos]), F.col("param_id"))
    lists = carry.groupBy(*keys, *labels).agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), "cp", "cm"))).alias("x"))
    second = met.join(lists.select(*keys, *labels, F.col("x.cp").alias("cp"), F.col("x.cm").alias("cm")), [*keys, *labels])
    falls = compare(second, [T.StructField("dd", T.DoubleType())], True)
    added = sums.groupBy(*group).agg(*[F.sum(c).alias(c) for c in (*SUMS, "s", "q", "gain", "loss") if c not in ("head", "tail")])
    deepest = falls.groupBy(*group).agg(F.min("dd").alias("max_drawdown"))
    # a run that spans segments is the tail of one, the heads of those after it
    ends = sums.join(carry.select(*keys, *labels, "param_id", "run"), [*keys, *labels, "param_id"])
    parts = F.array(F.struct(F.col("run").alias("run"), F.col("head").alias("len")), F.struct((F.col("run") + F.col("chg")).alias("run"), F.col("tail").alias("len")))
    open_runs = ends.select(*group, F.explode(parts).alias("p")).groupBy(*group, "p.run").agg(F.sum("p.len").alias("len"))
    lengths = open_runs.groupBy(*group).agg(F.count_if(F.col("len") > 0).alias("open_runs"), F.sum("len").alias("open_bars"))
    grid = bars.sparkSession.createDataFrame(combos, "param_id int, entry_z double, exit_z double, stop_z double")
    return added.join(deepest, group).join(lengths, group).join(grid, "param_id")


def volatility(s: str = "s", q: str = "q", k: str = "k"):
    c = F.col
    spare = F.when(c(k) > 1, (c(q) - c(s) * c(s) / c(k)) / (c(k) - 1))
    return F.sqrt(F.greatest(F.lit(0.0), spare)) * F.sqrt(F.lit(252.0))


def table(z_bars: DataFrame, combos: Combos, f: Frame = PAIR) -> DataFrame:
    """Spread-return figures of every series and parameter set."""
    c = F.col
    bars = numbered(z_bars, f)
    t = scores(bars, combos, whole(bars, f), [], f=f)
    total = F.when(c("k") > 0, c("s"))
    t = t.withColumns({"total_return": total, "annual_return": total * 252 / c("n"), "annual_vol": F.when(c("k") > 1, volatility())})
    runs = c("inner_runs") + c("open_runs")
    return t.select(
        *f.series_keys, "param_id", "entry_z", "exit_z", "stop_z", c("chg").alias("total_trades"),
        F.when(c("chg") > 0, c("wins") / c("chg")).otherwise(0.0).alias("win_rate"),
        "total_return", "annual_return", "annual_vol",
        F.when(c("annual_vol") > 0, c("annual_return") / c("annual_vol")).otherwise(0.0).alias("sharpe_ratio"),
        "max_drawdown", (c("act") / c("n")).alias("signal_activity"),
        F.when(runs > 0, (c("inner_bars") + c("open_bars")) / runs).otherwise(0.0).alias("avg_signal_duration"),
    )


def fold_ranges(bars: DataFrame, first_year: int, train: int, test: int, step: int, count: int, purge_bars: int = 40, embargo_bars: int = 20, f: Frame = PAIR) -> DataFrame:
    """Row ranges of each fold's parts, without the last training and the first test bars.

    The bars are counted by year once; folds are then put together from years.
    """
    from spreadlake.operators.sweep import assign_folds

    years = bars.filter(OWN).groupBy(*f.series_keys, F.date_trunc("year", f.order[0]).alias("ts")).agg(F.min("_row").alias("a"), F.max("_row").alias("b"))
    parts = assign_folds(years, first_year, train, test, step, count).groupBy(*f.series_keys, "fold", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    training = F.col("part") == "train"
    cut = parts.select(
        *f.series_keys, "fold", "part",
        F.when(training, F.col("a")).otherwise(F.col("a") + embargo_bars).alias("first_row"), F.when(training, F.col("b") - purge_bars).otherwise(F.col("b")).alias("last_row"),
    )
    return cut.filter("first_row <= last_row")


def fold_table(z_bars: DataFrame, combos: Combos, years: dict[str, int], f: Frame = PAIR) -> DataFrame:
    """Scores of each fold's part for every parameter set, equity from one in each."""
    c = F.col
    bars = numbered(z_bars, f)
    t = scores(bars, combos, fold_ranges(bars, **years, f=f), ["fold", "part"], fill=True, f=f)
    total = F.when(c("k") > 0, c("s"))
    t = t.withColumns({"total_return": total, "annual_return": total * 252 / c("n"), "_vol": F.when(c("k") > 1, volatility())})
    return t.select(
        *f.series_keys, "param_id", "fold", "part", "total_return", "annual_return",
        F.coalesce(F.try_divide(c("gain"), F.abs(c("loss"))), F.lit(0.0)).alias("profit_factor"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), c("chg").alias("num_trades"),
        F.when(c("_vol") > 0, c("annual_return") / c("_vol")).otherwise(0.0).alias("sharpe_ratio"),
    )
