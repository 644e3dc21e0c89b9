"""Pair configuration: nested mappings to one flat parameter row per pair."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spreadlake.schemas import PARAMS

# Where each parameter sits in a nested pair section, and its default.
PATHS: dict[str, tuple[str, Any]] = {
    "beta_window": ("lookbacks.beta_window", 60),
    "z_window": ("lookbacks.z_window", 20),
    "corr_window": ("lookbacks.corr_window", 20),
    "use_rls": ("use_kalman", True),
    "entry_z": ("thresholds.entry_z", 1.0),
    "exit_z": ("thresholds.exit_z", 0.25),
    "stop_z": ("thresholds.stop_z", 3.5),
    "adf_p": ("thresholds.adf_p", 0.10),
    "max_days": ("time_stop.max_days", 10),
    "min_abs_corr": ("regime.min_abs_corr", 0.15),
    "filter_vol": ("regime.filter_extreme_vol", False),
    "vol_window": ("regime.volatility_window", 20),
    "high_vol": ("regime.high_vol_threshold", 0.03),
    "low_vol": ("regime.low_vol_threshold", 0.003),
    "filter_trend": ("regime.filter_strong_trend", False),
    "trend_window": ("regime.trend_window", 20),
    "trend_threshold": ("regime.trend_threshold", 0.015),
    "enable_hmm": ("regime.enable_hmm", False),
    "hmm_states": ("regime.hmm.n_states", 3),
    "hmm_window": ("regime.hmm.window", 126),
    "hmm_df": ("regime.hmm.df", 3.0),
    "hmm_tol": ("regime.hmm.tol", 1e-4),
    "hmm_iter": ("regime.hmm.n_iter", 100),
    "vix_thresh": ("regime.vix.thresh", 20.0),
    "vix_boost": ("regime.vix.boost_factor", 0.2),
    "vix_max_shift": ("regime.vix.max_shift", 1.0),
    "min_trade_count": ("min_trade_count", 10),
    "atr_window": ("sizing.atr_window", 20),
    "target_vol_per_leg": ("sizing.target_vol_per_leg", 0.01),
    "inverse_fx": ("inverse_fx_for_quote_ccy_strength", True),
    "fx_bps": ("exec.costs.fx_bps", 1.0),
    "comd_bps": ("exec.costs.comd_bps", 2.0),
}


def lookup(section: dict, path: str, default: Any = None) -> Any:
    """Value at a dotted path, or the default when any step is missing."""
    node: Any = section
    for step in path.split("."):
        if not isinstance(node, dict) or step not in node:
            return default
        node = node[step]
    return node


def typed(value: Any, like: Any) -> Any:
    """Exponent literals such as ``1e-3`` arrive from YAML as text; cast by the default's type."""
    if isinstance(like, bool):
        return bool(value)
    return type(like)(float(value)) if isinstance(like, int) else float(value)


def read_sections(spark: SparkSession, path: str) -> dict:
    """A JSON file, or YAML where a YAML reader is installed; any path that Spark can read."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("no YAML reader here; convert the file to JSON") from exc
    return yaml.safe_load(text)


def params_frame(spark: SparkSession, sections: dict[str, dict]) -> DataFrame:
    rows = []
    for pair, s in sections.items():
        row = {k: typed(lookup(s, p, d), d) for k, (p, d) in PATHS.items()}
        row |= {
            "pair": pair,
            "fx_symbol": lookup(s, "fx_symbol"),
            "comd_symbol": lookup(s, "comd_symbol"),
            "windows": {k: int(v) for k, v in (lookup(s, "rolling_metrics.windows", {}) or {}).items()},
            "model_weights": lookup(s, "model_diversification.model_weights", {}),
        }
        rows.append(tuple(row.get(f.name) for f in PARAMS.fields))
    return spark.createDataFrame(rows, PARAMS)


def pair_names(sections: dict[str, dict]) -> list[str]:
    return sorted(sections)


def risk_params(sections: dict[str, dict], pair: str) -> dict:
    if pair not in sections:
        raise KeyError(f"unknown pair {pair}")
    return lookup(sections[pair], "risk", {})
