"""Rolling three-state regime labels from Student-t mixtures over a Markov chain."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.series import PAIR, Frame


def _log_t(x: np.ndarray, mu: np.ndarray, scale: np.ndarray, df: float) -> np.ndarray:
    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    z = (x[:, :, None] - mu[:, None, :]) / scale[:, None, :]
    return c - np.log(scale)[:, None, :] - (df + 1) / 2 * np.log1p(z * z / df)


def _last_states(x: np.ndarray, n_states: int, df: float, iterations: int, tol: float) -> np.ndarray:
    """Last Viterbi state of each window (rows of ``x``); states ordered by scale.

    All windows of a batch are fitted side by side: every array has the window
    as its first axis, and only time is a loop.  Each window ends at its own
    convergence, so its state does not depend on the batch it came in.
    """
    n, t = x.shape
    sd = x.std(axis=1, keepdims=True)
    q = np.quantile(x, (np.arange(n_states) + 0.5) / n_states, axis=1).T
    mu, scale = q.copy(), sd * np.linspace(0.5, 1.5, n_states)[None, :]
    trans = np.full((n, n_states, n_states), 0.1 / (n_states - 1))
    trans[:, range(n_states), range(n_states)] = 0.9
    start = np.full((n, n_states), 1.0 / n_states)
    last, whole, open_ = np.full(n, -np.inf), x, np.arange(n)
    kept = {"mu": mu.copy(), "scale": scale.copy(), "trans": trans.copy(), "start": start.copy()}
    for _ in range(iterations):
        ll = _log_t(x, mu, scale, df)
        top = ll.max(axis=2, keepdims=True)
        b = np.exp(ll - top)
        a = np.empty_like(b)
        norm = np.empty((n, t))
        cur = start * b[:, 0]
        for k in range(t):
            if k:
                cur = np.einsum("ni,nij->nj", a[:, k - 1], trans) * b[:, k]
            norm[:, k] = cur.sum(axis=1) + 1e-300
            a[:, k] = cur / norm[:, k, None]
        beta = np.ones((n, n_states))
        gamma = np.empty_like(b)
        gamma[:, -1] = a[:, -1]
        counts = np.zeros_like(trans)
        for k in range(t - 2, -1, -1):
            nb = b[:, k + 1] * beta / norm[:, k + 1, None]
            counts += a[:, k, :, None] * trans * nb[:, None, :]
            beta = np.einsum("nij,nj->ni", trans, nb)
            g = a[:, k] * beta
            gamma[:, k] = g / (g.sum(axis=1, keepdims=True) + 1e-300)
        z = (x[:, :, None] - mu[:, None, :]) / scale[:, None, :]
        w = gamma * (df + 1) / (df + z * z)
        mass = gamma.sum(axis=1) + 1e-12
        mu = (w * x[:, :, None]).sum(axis=1) / (w.sum(axis=1) + 1e-12)
        scale = np.sqrt((w * (x[:, :, None] - mu[:, None, :]) ** 2).sum(axis=1) / mass) + 1e-8
        trans = (counts + 1e-6) / (counts + 1e-6).sum(axis=2, keepdims=True)
        start = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True)
        like = (np.log(norm) + top[:, :, 0]).sum(axis=1)
        kept["mu"][open_], kept["scale"][open_], kept["trans"][open_], kept["start"][open_] = mu, scale, trans, start
        more = np.abs(like - last) >= tol
        if not more.any():
            break
        # a window stops at its own convergence; the others go on without it
        open_, last = open_[more], like[more]
        x, mu, scale, trans, start = x[more], mu[more], scale[more], trans[more], start[more]
        n = len(x)
    x, n = whole, len(whole)
    mu, scale, trans, start = kept["mu"], kept["scale"], kept["trans"], kept["start"]
    ll, lt = _log_t(x, mu, scale, df), np.log(trans)
    score = np.log(start + 1e-300) + ll[:, 0]
    for k in range(1, t):
        score = (score[:, :, None] + lt).max(axis=1) + ll[:, k]
    rank = np.argsort(np.argsort(scale, axis=1), axis=1)
    return rank[np.arange(n), score.argmax(axis=1)]


def hidden_regime(
    df: DataFrame, ret: str, window: int = 126, n_states: int = 3, dof: float = 3.0, tol: float = 1e-4,
    iterations: int = 100, f: Frame = PAIR, out: str = "hmm_state",
) -> DataFrame:
    """State of each bar from the ``window`` returns before it; 0 until enough are known.

    Windows of different bars do not depend on each other, so they are fitted
    in parallel in Arrow batches; flat windows take the previous bar's state.
    """

    @F.pandas_udf("int")
    def state(values: pd.Series) -> pd.Series:
        res = pd.Series([None] * len(values), dtype="Int64")
        usable = [i for i, v in enumerate(values) if v is not None and len(v) == window and np.std(v) >= 1e-8]
        for lo in range(0, len(usable), 2048):
            part = usable[lo : lo + 2048]
            x = np.stack([np.asarray(values.iloc[i], dtype=float) for i in part])
            res.iloc[part] = _last_states(x, n_states, dof, iterations, tol)
        return res

    w = f.before(window)
    r = F.col(ret)
    df = df.withColumn("_win", F.when(F.count(r).over(w) >= window, F.collect_list(r).over(w)))
    df = df.withColumn("_st", state("_win")).drop("_win")
    return df.withColumn(out, F.coalesce(F.last("_st", True).over(f.running()), F.lit(0))).drop("_st")
