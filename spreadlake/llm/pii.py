"""Personal data: exact formats, and a skip-chain conditional random field over what looks like them.

The formats give base spans.  A token that holds a digit or ``@`` is a node of
the document's field; its labels are ``other`` and the four kinds.  Tokens next
to each other share a chain potential; distant tokens that repeat one another,
or are similar (the same last seven digits, the same address but for case and
punctuation), share a potential through a hub of their own, so that a group of
any size costs its length and not its square.  Loopy belief propagation runs a
fixed number of rounds over all nodes of a batch at once; no document influences
another.  All other tokens are ``other`` for certain, which parts the chain.
Weights are fitted by pseudo-likelihood on a bounded sample of documents, whose
labels are the base spans.  A token that the field labels, and that no base span
touches, becomes a further span: a number repeated without its prefix, say.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Most documents whose tokens the fit sees (bound of the sample), and most tokens of those.
TRAIN_DOCS, TRAIN_TOKENS = 4000, 200_000
ROUNDS = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive digits and the look-behind keep long digit runs linear; the matches are those of the plain form.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = " \t\n.,;:!?()[]{}<>\"'|#*$%&-_/\\+"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long words stay linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base span, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the field --------------------------------------------------------------------------------

N_FEATURES, FEATURES_EACH = 40, 13


def features(token: str, core: str, digits: str, before: str, after: str) -> list[int]:
    """Numbers of the features that hold for a token: its shape and its neighbours' shapes."""
    n, parts = len(digits), core.split(".")
    neighbours = lambda t: (0 if not t else 1 if "@" in t else 2 if _DIGIT.search(t) else 3)
    return [
        0,
        1 + min(n, 20) // 2,  # 1..11
        12 if "@" in core else 13,
        14 if token.startswith("+") else 15,
        16 if "(" in token or ")" in token else 17,
        18 + min(core.count("-"), 3),  # 18..21
        22 if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts) else 23,
        24 if any(c.isalpha() for c in core) else 25,
        26 if "@" in core and "." in core.rpartition("@")[2] else 27,
        28 + neighbours(before),
        32 + neighbours(after),
        36 if before.startswith("+") else 37,
        38 if 12 <= n <= 19 and luhn(digits) else 39,
    ]


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int], str]]:
    """(token number, start, end, label, features, key) of each token with a digit or ``@``.

    Equal keys make tokens similar; an empty key has no partner.
    """
    out, at = [], 0
    tokens = list(_TOKEN.finditer(text))
    for i, m in enumerate(tokens):
        token = m.group()
        if "@" not in token and not _DIGIT.search(token):
            continue
        core = token.strip(_EDGE)
        lead = len(token) - len(token.lstrip(_EDGE))
        start, end = m.start() + lead, m.start() + lead + len(core)
        digits = "".join(_DIGIT.findall(core))
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        label = next((k + 1 for a, k, b in base[at : at + 8] if a < m.end() and b > m.start()), 0)
        key = core.lower() if "@" in core or core.count(".") == 3 else digits[-7:] if len(digits) >= 4 and not any(c.isalpha() for c in core) else ""
        before = tokens[i - 1].group() if i else ""
        after = tokens[i + 1].group() if i + 1 < len(tokens) else ""
        out.append((i, start, end, label, features(token, core, digits, before, after), key))
    return out


class Field:
    """Nodes of many documents: features, chain edges and similarity groups as arrays."""

    def __init__(self, per_doc: list[list[tuple]]):
        self.x = np.zeros((sum(map(len, per_doc)), FEATURES_EACH), np.uint8)
        self.label = np.zeros(len(self.x), np.int64)
        group = np.full(len(self.x), -1, np.int64)
        left, at, hubs = [], 0, 0
        for found in per_doc:
            seen: dict[str, int] = {}
            for j, (number, _, _, label, feats, key) in enumerate(found):
                self.x[at] = feats
                self.label[at] = label
                if j and found[j - 1][0] == number - 1:
                    left.append(at - 1)
                if key:
                    group[at] = seen.setdefault(key, hubs + len(seen))
                at += 1
            hubs += len(seen)
        size = np.bincount(group[group >= 0], minlength=hubs) if hubs else np.zeros(0, np.int64)
        self.left = np.array(left, np.int64)
        self.member = np.flatnonzero((group >= 0) & (size[group] > 1)) if hubs else np.zeros(0, np.int64)
        self.hub = group[self.member]
        self.hubs = hubs

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.x), weights.shape[1]))
        for column in self.x.T:
            out += weights[column]
        return out


def fit(field: Field, steps: int = 300, rate: float = 0.1, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Pseudo-likelihood: each label given its token, its chain neighbours' and its partners' labels."""
    k, n = len(KINDS) + 1, max(len(field.x), 1)
    # the shared potential starts at its prior, to which it decays: samples with few repeats say little about it
    prior = {"x": 0.0, "chain": 0.0, "skip": 2.0}
    weights = {"x": np.zeros((N_FEATURES, k)), "chain": np.zeros((k, k)), "skip": np.full(1, prior["skip"])}
    if not len(field.x):
        return weights
    truth = np.eye(k)[field.label]
    x = np.zeros((n, N_FEATURES), np.float32)
    np.put_along_axis(x, field.x.astype(np.int64), 1, 1)
    before, after = np.zeros_like(truth), np.zeros_like(truth)
    before[field.left + 1], after[field.left] = truth[field.left], truth[field.left + 1]
    mates = np.zeros_like(truth)
    if len(field.member):
        total, count = np.zeros((field.hubs, k)), np.bincount(field.hub, minlength=field.hubs)
        np.add.at(total, field.hub, truth[field.member])
        mates[field.member] = (total[field.hub] - truth[field.member]) / (count[field.hub] - 1)[:, None]
    moment = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in weights.items()}
    for step in range(1, steps + 1):
        score = x @ weights["x"] + before @ weights["chain"] + after @ weights["chain"].T + weights["skip"] * mates
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (truth - p) / n
        grad = {"x": x.T @ miss, "chain": before.T @ miss + miss.T @ after, "skip": np.array([(mates * miss).sum()])}
        for name, w in weights.items():
            g, (m, v) = grad[name] - l2 * (w - prior[name]) / 10, moment[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def _lse(a: np.ndarray) -> np.ndarray:
    top = a.max(-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(-1, keepdims=True)))[..., 0]


def marginals(field: Field, weights: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node after ``rounds`` of parallel message passing."""
    own = field.scores(weights["x"])
    chain, skip = weights["chain"], float(weights["skip"][0])
    ahead, back, shared = np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
    i, j = field.left, field.left + 1
    agree = lambda a: np.log(np.exp(a - (top := a.max(-1, keepdims=True))).sum(-1, keepdims=True) + np.expm1(skip) * np.exp(a - top)) + top
    centre = lambda a: a - a.max(-1, keepdims=True)
    for _ in range(rounds if len(own) else 0):
        belief = own + ahead + back + shared
        new_ahead, new_back, new_shared = np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
        if len(i):
            new_ahead[j] = centre(_lse((belief[i] - back[i])[:, None, :] + chain.T[None]))
            new_back[i] = centre(_lse((belief[j] - ahead[j])[:, None, :] + chain[None]))
        if len(field.member):
            to_hub = centre(agree(belief[field.member] - shared[field.member]))
            total = np.zeros((field.hubs, own.shape[1]))
            np.add.at(total, field.hub, to_hub)
            new_shared[field.member] = centre(agree(centre(total[field.hub] - to_hub)))
        ahead, back, shared = new_ahead, new_back, new_shared
    belief = own + ahead + back + shared
    p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
    return p / p.sum(1, keepdims=True) if len(belief) else p


def added_spans(text: str, found: list[tuple], labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens with one label that touch no base span and could be of that kind."""
    out, j = [], 0
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    while j < len(found):
        k, start, end, number = int(labels[j]), found[j][1], found[j][2], found[j][0]
        j += 1
        if not k:
            continue
        while j < len(found) and found[j][0] == number + 1 and labels[j] == k:
            end, number = found[j][2], found[j][0]
            j += 1
        said = text[start:end]
        n = len(_DIGIT.findall(said))
        possible = ("@" in said, said.count(".") == 3, 12 <= n <= 19, 7 <= n <= 15)[k - 1]
        earlier = bisect_left(starts, end)
        if possible and end > start and (not earlier or reach[earlier - 1] <= start):
            out.append((start, k - 1, end))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: the id, counts of base spans, ``base`` and ``spans`` as text, ``base_sha256``.

    Every whole text is searched.  A null text is empty and has no spans; null
    ids and repeated rows are kept as they are; an empty table gives no rows.
    Offsets are code points, ends exclusive.  The field is fitted on at most
    ``train_docs`` documents chosen by the hash of their id; other columns are
    not read.
    """
    key = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    weights = _trained(picked, train_docs)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[at : at + 256] for whole in batches for at in range(0, len(whole), 256)):
            base = [base_spans(t) for t in pdf["text"]]
            found = [nodes(t, b) if "@" in t or _DIGIT.search(t) else [] for t, b in zip(pdf["text"], base, strict=True)]
            p = marginals(Field(found), weights)
            labels = np.where(p.max(1) > 0.5, p.argmax(1), 0) if len(p) else np.zeros(0, np.int64)
            more, at = [], 0
            for t, f, b in zip(pdf["text"], found, base, strict=True):
                more.append(added_spans(t, f, labels[at : at + len(f)], b))
                at += len(f)
            said = [written(b) for b in base]
            out = {"key": pdf["key"].array} | {f"n_{name}": [sum(k == i for _, k, _ in b) for b in base] for i, name in enumerate(KINDS)}
            out |= {"base_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in said], "spans": [written(sorted(b + m)) for b, m in zip(base, more, strict=True)], "base": said, "n_added": [len(m) for m in more]}
            yield pd.DataFrame(out)

    schema = f"key {key}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, base string, n_added long"
    return picked.mapInPandas(search, schema).withColumnRenamed("key", id_col)


def _trained(picked: DataFrame, train_docs: int) -> dict[str, np.ndarray]:
    """Fit on the tokens of a sample: the documents whose id hashes below the share that gives ``train_docs``."""
    total = picked.count()
    share = 1_000_000 if total <= train_docs else max(1, train_docs * 1_000_000 // total)
    sample = picked.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).filter(F.col("text").rlike("[0-9@]"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, number, label, bytes(feats), word) for k, t in enumerate(pdf["text"]) for number, _, _, label, feats, word in nodes(t, base_spans(t))]
            heads = pd.util.hash_pandas_object(pdf["text"], index=False).to_numpy()
            yield pd.DataFrame([(int(heads[r[0]]) & (2**62 - 1), *r[1:]) for r in rows], columns=["doc", "number", "label", "feats", "word"])

    tokens = sample.mapInPandas(look, "doc long, number long, label int, feats binary, word string").distinct().orderBy("doc", "number", "word", "label", "feats").limit(TRAIN_TOKENS).toPandas()
    per_doc = [[(r.number, 0, 0, r.label, list(r.feats), r.word) for r in g.itertuples()] for _, g in tokens.groupby("doc", sort=True)]
    return fit(Field(per_doc))
