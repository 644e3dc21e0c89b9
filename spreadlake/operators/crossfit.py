"""Out-of-fold predictions: every row is scored by a model that has not seen it.

Rows are cut into blocks of time with about equal numbers of rows.  The model of
a block is fitted on the other blocks, without the rows whose label window
touches the block and without an embargo after it, so no label tells about a bar
that is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.session import stage


def boundaries(df: DataFrame, folds: int, ts: str = "ts") -> list[date]:
    """First day of every block but the first, from exact counts by day."""
    days = stage(df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n")))  # one row a day
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    whole = days.agg(F.sum("n")).first()[0] or 0
    block = F.floor(folds * F.coalesce(F.sum("n").over(before), F.lit(0)) / max(whole, 1))
    starts = days.withColumn("block", block).groupBy("block").agg(F.min("day").alias("day")).orderBy("block").collect()
    return [r.day for r in starts][1:]


def block_of(starts: list[date], ts: Column) -> Column:
    """Number of the block of a time, from 0."""
    day = F.to_date(ts)
    return sum((F.when(day >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0))


def training_rows(df: DataFrame, starts: list[date], k: int, ts: str = "ts", label_end: str = "label_end", embargo_days: int = 5) -> DataFrame:
    """Rows from which block ``k`` may be learnt.

    A row before the block is out if its label window reaches into it, one after
    it if it begins inside the label windows of the block or the embargo.
    """
    low = F.lit(starts[k - 1]) if k else None
    high = F.lit(starts[k]) if k < len(starts) else None
    kept = F.lit(False)
    if low is not None:
        kept = kept | (F.to_date(label_end) < low)
    if high is not None:
        last = df.filter(F.to_date(ts) < high).agg(F.max(F.to_date(label_end))).first()[0]
        free = F.greatest(high, F.date_add(F.lit(last), 1)) if last else high
        kept = kept | (F.to_date(ts) >= F.date_add(free, embargo_days))
    return df.filter(kept)


def cross_fit(
    df: DataFrame, fit: Callable[[DataFrame], PipelineModel], apply: Callable[[PipelineModel, DataFrame], DataFrame],
    folds: int = 3, ts: str = "ts", label_end: str = "label_end", embargo_days: int = 5,
) -> tuple[DataFrame, list[PipelineModel]]:
    """Each row of ``df`` once, as ``apply`` scores it with the model of its block; and the models.

    The blocks' models are fitted at the same time: a fit is many short jobs,
    and while one waits for its driver the others use the cores.  Blocks whose model has nothing to learn from are an error: there are too few
    days for so many folds.
    """
    df = stage(df)
    starts = boundaries(df, folds, ts)
    if not starts:
        raise ValueError("cross-fitting needs rows of at least two days")
    blocks = range(len(starts) + 1)

    def learn(k: int) -> PipelineModel:
        train = training_rows(df, starts, k, ts, label_end, embargo_days)
        if train.isEmpty():
            raise ValueError(f"nothing is left to learn from outside block {k} of {len(blocks)}")
        return fit(train)

    with ThreadPool(len(blocks)) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(learn), blocks, chunksize=1)
    parts = [apply(models[k], df.filter(block_of(starts, F.col(ts)) == k)).withColumn("fold", F.lit(k)) for k in blocks]
    return reduce(DataFrame.unionByName, parts), models
