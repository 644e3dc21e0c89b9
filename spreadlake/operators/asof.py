"""Backward as-of join on segmented series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.series import Frame, forward_fill, segment, trim


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("pair",), ts: str = "ts", grain_days: float = 30.0) -> DataFrame:
    """Each left row with the latest right row at or before it (NULLs when there is none).

    Both sides are stacked and the last right row is carried forward, across
    segment borders too; a series with very many rows is spread over tasks, and
    no pair of rows is ever compared.
    """
    lcols = [c for c in left.columns if c not in (*keys, ts)]
    rcols = [c for c in right.columns if c not in (*keys, ts)]
    ls = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*lcols).alias("_l") if lcols else F.lit(None).alias("_l"))
    rs = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("_rts"), *rcols).alias("_r"))
    f = Frame(keys=(*keys, "seg"), order=(ts, "_side"))
    both = segment(ls.unionByName(rs, allowMissingColumns=True), 1, keys, ts, grain_days=grain_days)
    out = trim(forward_fill(both, ["_r"], f)).filter("_side = 1")
    return out.select(*keys, ts, *[F.col(f"_l.{c}").alias(c) for c in lcols], F.col("_r._rts").alias("right_ts"), *[F.col(f"_r.{c}").alias(c) for c in rcols])
