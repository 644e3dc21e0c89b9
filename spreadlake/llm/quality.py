"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Expectation
maximisation over the counts of all vote patterns estimates how often each is
right in either class, without a true label.  The posterior of each document's
pattern is the soft label that trains a hashed linear scorer, which then judges
every text by its own words and word shapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import fresh, text_bytes

BITS = 18
DIMS = 1 << BITS
#: Most documents whose features train the scorer (bound of the sample).
TRAIN_DOCS = 6000
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "variety", "runs", "bars", "word_length", "punctuation", "function_words", "lines")

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on are as with be this have from or by an at "
    "le la les de des et un une du que qui en dans pour il elle est au sur pas "
    "der die das und ist von den mit zu ein eine nicht auf für sich dem "
    "el los las del que y una por con para se su al lo como".encode().decode().split()
)
_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)

_SPACE, _UPPER, _LOWER, _SYMBOL, _DIGIT, _END = range(1, 7)
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _b = bytes([_c])
    _CLASS[_c] = _SPACE if _b.isspace() else _UPPER if _b.isupper() else _DIGIT if _b.isdigit() else _END if _b in b".,;:?'\"-()" else _LOWER if _b.islower() or _c >= 128 else _SYMBOL if 33 <= _c < 127 else 0
_POWERS = np.random.default_rng(3).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


class Look:
    """Words of a whole text as arrays: where they start and end, and the classes of its bytes."""

    def __init__(self, text: bytes):
        self.text = text
        self.bytes = np.frombuffer(text, np.uint8)
        self.kinds = _CLASS[self.bytes]
        space = np.concatenate([[True], self.kinds == _SPACE, [True]])
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = turn[::2], turn[1::2]
        self.n = len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its bytes times fixed odd numbers by place."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.bytes)))) if self.starts[0] == 0 else None
        if place is None:
            place = np.zeros(len(self.bytes), np.int64)
            place[self.starts[0] :] = np.arange(self.starts[0], len(self.bytes)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.bytes))))
        value = (self.bytes.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
        value[self.kinds == _SPACE] = 0
        return np.add.reduceat(value, self.starts)


def votes(look: Look, hashes: np.ndarray) -> bytes:
    """One byte per labeller: 0 bad, 1 good, 2 nothing.  A text of fewer than 5 words gets no vote."""
    n = look.n
    if n < 5:
        return bytes([2] * len(LABELLERS))
    count = np.bincount(look.kinds, minlength=7)
    letters = max(1, count[_UPPER] + count[_LOWER])
    first, last = look.kinds[look.starts], look.kinds[look.ends - 1]
    size = look.ends - look.starts
    words = look.text.lower().split()
    stop = sum(w in _FUNCTION for w in words) / n
    ended = float((last == _END).mean())
    lines = [x for x in look.text.split(b"\n") if x.strip()]
    by = lambda bad, good: 0 if bad else 1 if good else 2
    variety, same = len(np.unique(hashes)) / n, float((hashes[1:] == hashes[:-1]).mean())
    return bytes([
        by(count[_SYMBOL] > 0.4 * n, count[_SYMBOL] < 0.1 * n),
        by(count[_UPPER] > 0.5 * letters, count[_UPPER] < 0.2 * letters),
        by(n >= 50 and variety < 0.15, n >= 50 and variety > 0.35),
        by(n >= 20 and same > 0.2, n >= 20 and same < 0.05),
        by(((size == 1) & (first == _SYMBOL)).sum() > 0.15 * n, False),
        by(size.mean() > 20 or size.mean() < 2, 3 <= size.mean() <= 9),
        by(n >= 30 and (ended > 0.8 or ended == 0), 0.02 < ended < 0.5),
        by(n >= 30 and stop < 0.03, 0.1 < stop < 0.7),
        by(len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines), len(lines) >= 4 and len(set(lines)) > 0.9 * len(lines)),
    ])


def places(look: Look, hashes: np.ndarray) -> np.ndarray:
    """Distinct hashed features: words, and shapes of words alone and in pairs (first and last byte's class, length)."""
    if not look.n:
        return np.zeros(0, np.int64)
    shape = look.kinds[look.starts].astype(np.uint64) * np.uint64(8) + look.kinds[look.ends - 1]
    shape = shape * np.uint64(16) + np.minimum(look.ends - look.starts, 15).astype(np.uint64) + np.uint64(1)
    # words that repeat their left neighbour have a shape of their own
    shape[1:][hashes[1:] == hashes[:-1]] = np.uint64(1)
    pair = (shape[:-1] << np.uint64(16)) + shape[1:]
    # a share of the text that has a shape, in steps of an eighth, makes one place per step reached
    kinds, times = np.unique(look.kinds[look.ends - 1], return_counts=True)
    steps = np.concatenate([np.arange(1, 1 + 8 * t // look.n, dtype=np.uint64) + np.uint64(100 * int(k)) for k, t in zip(kinds, times, strict=True)]) + np.uint64(1 << 40)
    all_of = np.concatenate([hashes, shape + np.uint64(1 << 33), pair + np.uint64(1 << 34), steps])
    return np.unique((all_of * _MIX) >> _SHIFT).astype(np.int64)


# --- accuracies of the labellers --------------------------------------------------------------


def estimate(patterns: list[tuple[bytes, int]], rounds: int = 500, tolerance: float = 1e-9) -> dict[bytes, float]:
    """Posterior of "good" per vote pattern by expectation maximisation over the counts.

    ``right[c, j]`` is how often labeller j, when it votes, votes for class c in
    class c.  It starts at 0.7 and the classes at 0.8 good; a light prior keeps
    rare labellers finite.  Patterns without a vote get the share of good.
    """
    if not patterns:
        return {}
    seen = np.array([list(p) for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    good_vote, bad_vote = seen == 1, seen == 0
    right, share, before = np.full((2, seen.shape[1]), 0.7), 0.8, np.inf
    for _ in range(rounds):
        log_good = np.log(share) + good_vote @ np.log(right[1]) + bad_vote @ np.log(1 - right[1])
        log_bad = np.log(1 - share) + good_vote @ np.log(1 - right[0]) + bad_vote @ np.log(right[0])
        top = np.maximum(log_good, log_bad)
        like = top + np.log(np.exp(log_good - top) + np.exp(log_bad - top))
        p = np.exp(log_good - like)
        weight_good, weight_bad = count * p, count * (1 - p)
        voted = good_vote | bad_vote
        right[1] = (weight_good @ good_vote + 7) / (weight_good @ voted + 10)
        right[0] = (weight_bad @ bad_vote + 7) / (weight_bad @ voted + 10)
        share = (weight_good.sum() + 8) / (count.sum() + 10)
        total = float(count @ like)
        if abs(total - before) <= tolerance * abs(total):
            break
        before = total
    return {pattern: float(x) for (pattern, _), x in zip(patterns, p, strict=True)}


def fit_linear(sample: list[tuple[bytes, float]], epochs: int = 6, rate: float = 0.5) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels with a rate per coordinate; a document's places share its unit length."""
    w, g2 = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-6)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(sample)):
            raw, label = sample[i]
            at = np.append(np.frombuffer(raw, "<i4").astype(np.int64), DIMS)
            x = np.full(len(at), 4 / np.sqrt(len(at)))
            x[-1] = 1.0
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))) - label) * x
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return float(w[DIMS]), w[:DIMS].astype(np.float32)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``weak_votes``, ``weak_good``, ``quality_score`` and ``kept`` added (existing columns of those names are replaced).

    The votes of all documents are counted: there are at most 3 ** 9 patterns,
    the bound of what reaches the driver.  The scorer is fitted on about
    ``train_docs`` documents chosen by the hash of their text and judges all.
    A null text is empty; it has no vote and no words, scores by the intercept
    alone, and is kept or not like any other.  Null ids and repeated rows are
    judged by their text.  An empty table gives no rows.
    """
    raw = fresh(docs, "raw")
    base = docs.drop("weak_votes", "weak_good", "quality_score", "kept").withColumn(raw, text_bytes(text_col))
    share = _share(base.select(raw), train_docs)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, chosen in zip(pdf["raw"], pdf["chosen"], strict=True):
                look = Look(text)
                hashes = look.hashes()
                rows.append((votes(look, hashes), places(look, hashes).astype("<i4").tobytes() if chosen else None))
            yield pd.DataFrame(rows, columns=["pattern", "places"])

    seen = base.select(F.col(raw).alias("raw"), (F.pmod(F.xxhash64(raw), F.lit(1_000_000)) < share).alias("chosen")).mapInPandas(vote, "pattern binary, places binary")
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.collect_set("places").alias("sample")).collect()
    patterns = sorted((bytes(r.pattern), r.n) for r in counted)
    posterior = estimate(patterns)
    sample = sorted((bytes(x), posterior[bytes(r.pattern)]) for r in counted for x in r["sample"])
    bias, weights = fit_linear(sample)
    at = np.flatnonzero(weights).astype(np.int32)
    model = (bias, at, weights[at])
    prior = float(np.average([posterior[p] for p, _ in patterns], weights=[n for _, n in patterns])) if patterns else 0.5

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = np.zeros(DIMS, np.float32)
        table[model[1]] = model[2]
        for texts in batches:
            rows = []
            for text in texts:
                look = Look(text)
                hashes = look.hashes()
                found = places(look, hashes)
                score = model[0] + float(table[found].sum(dtype=np.float64)) * 4 / np.sqrt(len(found) + 1)
                pattern = votes(look, hashes)
                rows.append(("".join("-+."[v] for v in pattern), posterior.get(pattern, prior), 1 / (1 + np.exp(-np.clip(score, -500, 500)))))
            yield pd.DataFrame(rows, columns=["votes", "good", "score"])

    judged = F.pandas_udf(judge, "votes string, good double, score double")
    mark = fresh(base, "judged")
    out = base.withColumn(mark, judged(F.col(raw)))
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns if c != raw],
        F.col(mark)["votes"].alias("weak_votes"),
        F.col(mark)["good"].alias("weak_good"),
        F.col(mark)["score"].alias("quality_score"),
        (F.col(mark)["score"] >= threshold).alias("kept"),
    )


def _share(base: DataFrame, most: int) -> int:
    total = base.count()
    return 1_000_000 if total <= most else max(1, most * 1_000_000 // total)
