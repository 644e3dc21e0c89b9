"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

_D, _S, _I, _L, _B, _TS = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


BARS = _schema(symbol=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_L, trades=_L)
PAIRS = _schema(pair=_S, fx_symbol=_S, comd_symbol=_S, inverse_fx=_B)
PAIR_BARS = _schema(pair=_S, ts=_TS, fx_price=_D, comd_price=_D)
EVENTS = _schema(
    event_date=T.DateType(), event_type=_S, description=_S, impact_days=_I, severity=_S, commodity=_S
)
ENERGY = _schema(date=T.DateType(), price=_D, volume=_D, change_pct=_D, commodity_type=_S)
SCENARIOS = _schema(
    name=_S, dd_mult=_D, vol_mult=_D, corr_stress=_D, duration=_I, frequency=_D
)
PARAMS = _schema(
    pair=_S, fx_symbol=_S, comd_symbol=_S, inverse_fx=_B,
    beta_window=_I, z_window=_I, corr_window=_I, use_rls=_B,
    entry_z=_D, exit_z=_D, stop_z=_D, adf_p=_D, max_days=_I,
    min_abs_corr=_D, filter_vol=_B, vol_window=_I, high_vol=_D, low_vol=_D, filter_trend=_B, trend_window=_I, trend_threshold=_D,
    enable_hmm=_B, hmm_states=_I, hmm_window=_I, hmm_df=_D, hmm_tol=_D, hmm_iter=_I,
    vix_thresh=_D, vix_boost=_D, vix_max_shift=_D, min_trade_count=_I, atr_window=_I, target_vol_per_leg=_D,
    fx_bps=_D, comd_bps=_D, windows=T.MapType(_S, _I), model_weights=T.MapType(_S, _D),
)
TRADES = _schema(
    pair=_S, trade_id=_L, entry_date=_TS, exit_date=_TS, direction=_I, duration=_L, pnl=_D,
    fx_entry=_D, fx_exit=_D, comd_entry=_D, comd_exit=_D, entry_z=_D, exit_z=_D,
).add("return", _D)

SIGNAL_INPUT = ("fx_price", "comd_price", "spread_z", "signal", "fx_position", "comd_position")


def require(df, *columns: str) -> None:
    """Raise when a frame lacks a required column (no job is started)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
