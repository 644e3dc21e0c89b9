"""Splitting long ordered series so that no key is ever one task.

A pair can hold a third of all bars, so ``Window.partitionBy("pair")`` is not
an option.  :func:`segment` cuts every series into runs of about ``rows`` bars
and copies the ``lookback`` bars before each run into it (the *halo*).  Every
bounded-lookback expression then runs on ``(pair, seg)`` windows, which all
share one exchange and one sort; :func:`trim` drops the halo rows again.
Quantities with unbounded memory (running products, trade ids, positions) are
computed per segment and joined with a *carry*: a prefix over the one-row-per-
segment summary table, which is ``rows`` times smaller than the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spreadlake.session import stage

SEG, OWN, OFF = "seg", "own", "seg_off"
DEFAULT_ROWS = 65_536
DEFAULT_GRAIN_DAYS = 30.0
#: A bucket with more than this share of a segment's rows is cut into ``FINER`` buckets, again and again.
FULL_SHARE, FINER, LEAST_MICROS = 1 / 16, 256, 1000
_UNBOUNDED = Window.unboundedPreceding


@lru_cache(maxsize=512)
def _spec(context: SparkContext, keys: tuple[str, ...], order: tuple[str, ...], rows: tuple[int, int] | None) -> WindowSpec:
    """Window specs are made once per context: each one costs several gateway calls."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return spec if rows is None else spec.rowsBetween(*rows)


@dataclass(frozen=True)
class Frame:
    """Window factory for one ordering: keys (incl. ``seg``) and order columns."""

    keys: tuple[str, ...] = ("pair", SEG)
    order: tuple[str, ...] = ("ts",)

    @property
    def series_keys(self) -> tuple[str, ...]:
        return tuple(k for k in self.keys if k != SEG)

    def ordered(self) -> WindowSpec:
        return _spec(SparkContext._active_spark_context, self.keys, self.order, None)

    def last(self, n: int) -> WindowSpec:
        return _spec(SparkContext._active_spark_context, self.keys, self.order, (-(n - 1), 0))

    def before(self, n: int) -> WindowSpec:
        return _spec(SparkContext._active_spark_context, self.keys, self.order, (-n, -1))

    def running(self) -> WindowSpec:
        return _spec(SparkContext._active_spark_context, self.keys, self.order, (_UNBOUNDED, 0))

    @property
    def sql(self) -> str:
        """The ordering as SQL text, for expressions written as text."""
        return f"PARTITION BY {', '.join(f'`{k}`' for k in self.keys)} ORDER BY {', '.join(f'`{o}`' for o in self.order)}"

    def by(self, *extra: str) -> "Frame":
        return Frame(self.keys + extra, self.order)


PAIR = Frame()


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a derived table that is usually small.

    The table is staged, so the optimizer knows its bytes: below the broadcast
    threshold it is broadcast, above it both sides are shuffled and adaptive
    execution splits skewed keys.
    """
    return df.join(stage(small), on, how)


def segment_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spreadlake.segment.rows", str(DEFAULT_ROWS)))


def segment(
    df: DataFrame,
    lookback: int,
    keys: tuple[str, ...] = ("pair",),
    ts: str = "ts",
    rows: int | None = None,
    grain_days: float = DEFAULT_GRAIN_DAYS,
    reuse: bool = False,
) -> DataFrame:
    """Add ``seg``, ``own`` and ``seg_off`` and replicate halo rows.

    A histogram over ``(keys, time bucket)`` gives each bucket its row offset in
    the series; whole buckets go to segment ``offset // rows`` and, while they
    end less than ``lookback`` rows before a later segment starts, to that one
    too.  A bucket holds few rows: :func:`bucketed` cuts dense ones finer, so a
    segment exceeds ``rows`` by one bucket at most, and so does a halo
    ``lookback``.  The histogram is a pruned, map-side-combined aggregate that
    is staged once; its bytes decide between a broadcast and a shuffled join.

    ``reuse`` stages ``df`` first: right when it is itself a reduction of a much
    larger table, which would otherwise be read for the histogram and again for
    the bars.
    """
    if reuse:
        df = stage(df)
    rows = rows or segment_rows(df)
    width = int(grain_days * 86_400 * 1_000_000)
    tagged = df.withColumn("_bucket", _start(ts, width))
    counted = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    hist = stage(_histogram(counted, keys, lookback, rows))
    # counts are staged only where a bucket turns out too full
    if (hist.agg(F.max("_cnt")).first()[0] or 0) > FULL_SHARE * rows and width > LEAST_MICROS:
        tagged, counted = bucketed(df, keys, ts, rows, width)
        hist = stage(_histogram(counted, keys, lookback, rows))
    return (
        tagged.join(hist.drop("_cnt"), [*keys, "_bucket"])
        .withColumn(SEG, F.explode("_segs"))
        .withColumn(OWN, F.col(SEG) == F.col("_own"))
        .drop("_bucket", "_own", "_segs")
    )


def _histogram(counted: DataFrame, keys: tuple[str, ...], lookback: int, rows: int) -> DataFrame:
    """Each bucket's row offset in its series, its own segment and all segments that hold it."""
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(_UNBOUNDED, -1)
    return (
        counted.withColumn(OFF, F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
        .withColumn("_own", F.floor(F.col(OFF) / rows))
        .withColumn("_top", F.max("_own").over(Window.partitionBy(*keys)))
        .withColumn("_end", F.floor((F.col(OFF) + F.col("_cnt") + (lookback - 1)) / rows))
        .select(
            *keys,
            "_bucket",
            "_cnt",
            OFF,
            "_own",
            F.sequence("_own", F.greatest("_own", F.least("_end", "_top"))).alias("_segs"),
        )
    )


def _start(ts: str, width: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width)) * width


def bucketed(df: DataFrame, keys: tuple[str, ...], ts: str, rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with the start of each row's time bucket, and the count of each bucket.

    Buckets fuller than ``FULL_SHARE * rows`` are cut into ``FINER`` ones until
    none is, or they are as short as ``LEAST_MICROS``.  The list of full buckets
    has at most ``1 / (FULL_SHARE * rows)`` of the rows' number of entries.
    """
    tagged = df.withColumn("_bucket", _start(ts, width))
    count = lambda d: stage(d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_cnt")))
    counted = count(tagged)
    full = counted.filter(F.col("_cnt") > FULL_SHARE * rows)
    while width > LEAST_MICROS and not full.isEmpty():
        width = max(LEAST_MICROS, width // FINER)
        tagged = join_small(tagged, full.select(*keys, "_bucket", F.lit(True).alias("_full")), [*keys, "_bucket"], "left")
        # a finer bucket starts inside the one that it is cut from
        finer_start = F.greatest("_bucket", _start(ts, width))
        tagged = tagged.withColumn("_bucket", F.when(F.col("_full"), finer_start).otherwise(F.col("_bucket"))).withColumn("_cut", F.coalesce("_full", F.lit(False))).drop("_full")
        finer = count(tagged.filter("_cut"))
        counted = counted.join(full.select(*keys, "_bucket"), [*keys, "_bucket"], "left_anti").unionByName(finer)
        full = finer.filter(F.col("_cnt") > FULL_SHARE * rows)
        tagged = tagged.drop("_cut")
    return tagged, counted


def trim(df: DataFrame) -> DataFrame:
    """Keep each row once: in the segment that owns it."""
    return df.filter(OWN).drop(SEG, OWN, OFF)


def position(f: Frame = PAIR) -> tuple[Column, Column]:
    """(offset of the segment's first row, 1-based row number inside the segment)."""
    return F.first(OFF).over(f.running()), F.row_number().over(f.ordered())


def carried(df: DataFrame, summary: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Attach the per-segment carry columns of ``summary`` to the rows."""
    return df.join(summary, list(f.keys), "left")


def prefix(f: Frame = PAIR) -> WindowSpec:
    """All earlier segments of the same series, for the summary table."""
    return Window.partitionBy(*f.series_keys).orderBy(SEG).rowsBetween(_UNBOUNDED, -1)


def with_series_stats(df: DataFrame, stats: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Attach one-row-per-series statistics to the bars.

    The statistics are first spread over the (small) list of segments and then
    joined on ``(keys, seg)``.  A join on the series key alone would hash all
    bars of a series to one task, and the windows after it would stay there.
    """
    segments = df.filter(OWN).groupBy(*f.keys).agg(F.lit(1).alias("_one")).drop("_one")
    return df.join(segments.join(stats, list(f.series_keys)), list(f.keys), "left")


def forward_fill(df: DataFrame, cols: list[str], f: Frame = PAIR) -> DataFrame:
    """Last non-null value so far, also across segment borders."""
    order = F.struct(*f.order)
    summary = (
        df.filter(OWN)
        .groupBy(*f.keys)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_c_{c}") for c in cols])
        .select(*f.keys, *[F.last(f"_c_{c}", True).over(prefix(f)).alias(f"_c_{c}") for c in cols])
    )
    out = carried(df, summary, f)
    for c in cols:
        out = out.withColumn(
            c,
            F.coalesce(F.last(F.when(F.col(OWN), F.col(c)), True).over(f.running()), F.col(f"_c_{c}"), F.col(c)),
        )
    return out.drop(*[f"_c_{c}" for c in cols])


def running_sum(df: DataFrame, cols: dict[str, Column], f: Frame = PAIR) -> DataFrame:
    """Exact running sums over own rows: local running sum plus segment carry."""
    for name, expr in cols.items():
        df = df.withColumn(f"_x_{name}", F.when(F.col(OWN), expr))
    summary = (
        df.groupBy(*f.keys)
        .agg(*[F.sum(f"_x_{n}").alias(f"_c_{n}") for n in cols])
        .select(*f.keys, *[F.sum(f"_c_{n}").over(prefix(f)).alias(f"_c_{n}") for n in cols])
    )
    out = carried(df, summary, f)
    for n in cols:
        out = out.withColumn(
            n, F.coalesce(F.sum(f"_x_{n}").over(f.running()), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        )
    return out.drop(*[f"_x_{n}" for n in cols], *[f"_c_{n}" for n in cols])


def compound(df: DataFrame, growth: Column, f: Frame = PAIR, equity: str = "equity", peak: str = "peak") -> DataFrame:
    """Running product of ``growth`` and its running maximum, exact across segments.

    ``growth`` may be zero or negative (a loss above the whole stake), so the
    product is a product, not a sum of logarithms, and the segment maximum
    keeps both the largest and the smallest local product.
    """
    df = df.withColumn("_g", F.when(F.col(OWN), growth)).withColumn("_e", F.product("_g").over(f.running()))
    summary = (
        df.groupBy(*f.keys)
        .agg(F.product("_g").alias("_p"), F.max("_e").alias("_hi"), F.min("_e").alias("_lo"))
        .withColumn("_cp", F.coalesce(F.product("_p").over(prefix(f)), F.lit(1.0)))
        .withColumn("_top", F.greatest(F.col("_cp") * F.col("_hi"), F.col("_cp") * F.col("_lo")))
        .select(*f.keys, "_cp", F.max("_top").over(prefix(f)).alias("_cm"))
    )
    out = carried(df, summary, f).withColumn(equity, F.col("_e") * F.coalesce(F.col("_cp"), F.lit(1.0)))
    local = F.max(equity).over(f.running())
    return out.withColumn(peak, F.greatest(local, F.col("_cm"))).drop("_g", "_e", "_cp", "_cm")
