"""Cost-balanced packing of tokenised documents into sequences.

A sequence costs ``linear * n + quadratic * sum(piece ** 2)``: feed-forward work
grows with its tokens, attention with the square of each piece.  Documents are
taken in descending cost and go to the lowest-cost sequence that has room; when
none has, the document is cut, filling the lowest-cost sequence first.  The room
offered is exactly the tokens at hand: full sequences, then sequences of falling
powers of two for the rest, which need no padding either.

Packing is local to a task: no token crosses a shuffle.  Each task packs groups
of about ``group_tokens`` tokens, so memory is bounded by a group and by one
document.  Reading a partition again gives the same pieces.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import fresh, text_bytes

CAPACITY = 2048
#: Words whose ids a task remembers (about 270 bytes each); of them those met in the latest half stay.
REMEMBERED = 320_000
#: Unknown words encoded in one call.
BATCH = 2000
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words, one a line: letters and a run of symbols after them (no apostrophe, which may begin a piece of letters), or any other.
_PARTS = re.compile(rb"^(?:((?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-&(-/:-@\[-`{-~]*+)|(.+))$", re.MULTILINE)
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?: [a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)*")
#: Steps before the model by which a word of letters is one piece, lower-cased and spelt in byte characters.
_STEPS = [
    ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}),
    ("pre_tokenizer", {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}),
]
#: Byte characters of the bytes that are not their own, but for the space.
_OWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)) if b != 32}
#: Byte characters of the bytes of ``_PLAIN`` texts, lower-cased: a capital's second byte is 32 below its small letter's.
_SPELT = "".join(chr(_OWN.get(small, small)) for small in (b + 32 if 0x80 <= b < 0x9F else b for b in range(256)))
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_TOKENIZERS: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of a text, by words: the tokenizer never joins what white space parts.

    Words are looked up as bytes and the unknown ones of a batch are encoded in
    one call.  Words of Latin letters alone are parted by a space: each ends
    with the only token of its own that ends a word.  Where all that the other
    steps do to them is known (``_STEPS``), they go to the model as they are, and a run of symbols
    that follows is a word of its own.  Others are parted by a
    special token, which also parts their ids, and a word that holds a special
    token's text itself is encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.part_id, part = max(added.items())
        self.part = part.content
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: No special token's text can lie inside a word of letters that ends in a mark or not.
        self.apart = not any(_LETTERS.fullmatch(t.rstrip(b".,")) for t in self.special)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        told = json.loads(self.tokenizer.to_str())
        bare = all(told.get(name) == step for name, step in _STEPS) and told["model"].get("dropout") is None
        self.model = self.tokenizer.model if bare and self.apart else None
        #: A run of symbols after letters is a piece of its own, and no special token's text can lie in the two.
        self.runs = self.model is not None and not any((m := _PARTS.fullmatch(b"a" + t)) and m[1] for t in self.special)

    def _ids(self, text: str) -> np.ndarray:
        if self.model is not None and _PLAIN.fullmatch(text):
            spelt = text if text.isascii() else codecs.charmap_decode(text.encode(), "strict", _SPELT)[0]
            tokenize = self.model.tokenize
            return np.array([token.id for word in spelt.split(" ") for token in tokenize(word)], "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _put(self, words: list[bytes], raw: bytes, starts: list[int], ends: list[int]) -> None:
        self.known.update(zip(words, (raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)), strict=True))

    def _alone(self, word: bytes) -> bytes:
        return self._ids(word.decode()).tobytes()

    def _learn(self, split: list[list[bytes]]) -> None:
        words = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        if len(self.known) + len(words) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
            words = set().union(*split)
        known, older = self.known, self.older
        met = words & older.keys()
        known.update(zip(met, map(older.__getitem__, met), strict=True))
        words -= met
        tails: list[tuple[bytes, bytes]] = []
        plain: dict[bytes, None] = {}
        other: dict[bytes, None] = {}

        def want(word: bytes, kind: dict[bytes, None]) -> None:
            if word in older:
                known[word] = older[word]
            elif word not in known:
                kind[word] = None

        for stem, run, rest in _PARTS.findall(b"\n".join(words)) if words else ():  # no word holds white space
            if stem and self.apart and not run:
                plain[stem] = None
            elif stem and (self.runs or self.apart and run in (b".", b",") and stem[-1:].isalpha()):
                tails.append((stem, run))
                want(stem, plain)
                want(run, other)
            else:
                word = rest or stem + run
                if any(s in word for s in self.special):
                    known[word] = self._alone(word)
                elif word[-1:] in b".," and word[-2:-1].isalpha():  # ends in a letter and one mark, which is a token of its own
                    tails.append((word[:-1], word[-1:]))
                    want(word[:-1], other)
                    want(word[-1:], other)
                else:
                    other[word] = None
        plain, other = list(plain), list(other)
        for at in range(0, len(plain), BATCH):
            some = plain[at : at + BATCH]
            ids = self._ids(b" ".join(some).decode())
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(some):
                self._put(some, ids.tobytes(), [0, *ends[:-1]], ends)
            else:  # a tokenizer that parts letters
                other += some
        for at in range(0, len(other), BATCH):
            some = other[at : at + BATCH]
            ids = self._ids(self.part.encode().join(some).decode())
            cuts = np.flatnonzero(ids == self.part_id)
            self._put(some, ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        for stem, run in tails:
            known[stem + run] = known[stem] + known[run]

    def forget(self) -> None:
        """Give the words' memory back: the worker goes on with other steps."""
        self.known, self.older = {}, {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.lower().split() for t in texts]  # bytes.lower() is A-Z only; the tokenizer lower-cases too
        self._learn(split)
        look = self.known.__getitem__
        return [b"".join(map(look, words)) for words in split]


def tokenizer_at(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def rooms(total: int, capacity: int) -> np.ndarray:
    """Lengths of the sequences that hold ``total`` tokens without padding."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; ties go to the earlier document and sequence."""
    room = rooms(int(lengths.sum()), capacity)
    free, cost = room.copy(), np.zeros(len(room))
    out = []
    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            fits = free >= left
            if not fits.any():
                fits = free > 0
            seq = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, int(free[seq]))
            out.append((int(doc), start, n, seq, int(room[seq] - free[seq])))
            free[seq] -= n
            cost[seq] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """Pieces of all documents: the id column and ``PIECES``; ``ids`` holds little-endian unsigned 32-bit ids.

    A document's ids are its text's ids and ``end_id``; each lies in exactly one
    piece.  Offsets in a sequence run gapless from 0.  ``sequence_id`` is unique:
    the task's number in the high bits.  Null text counts as empty and gives the
    end id alone; null ids and repeated rows are packed like any other row; a
    text longer than a sequence fills sequences of its own and only its rest is
    balanced.  An empty table gives no rows.  Other columns are not read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizer_at(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc id, ids, tokens before the rest, tokens of the document)
        held = 0

        def close() -> None:
            nonlocal held, sequence
            placed = balance(np.array([len(p[1]) // 4 for p in pool], np.int64), capacity, linear, quadratic)
            for doc, start, n, seq, offset in placed:
                key, raw, before, tokens = pool[doc]
                rows.append((key, before + start, n, raw[4 * start : 4 * (start + n)], tokens, sequence + seq, offset))
            sequence += 1 + max((p[3] for p in placed), default=-1)
            pool.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column(0).to_pylist()
                for key, raw in zip(keys, words.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    tokens = len(raw) // 4
                    whole = tokens - tokens % capacity
                    for start in range(0, whole, capacity):
                        rows.append((key, start, capacity, raw[4 * start : 4 * (start + capacity)], tokens, sequence, 0))
                        sequence += 1
                    if tokens > whole:
                        pool.append((key, raw[4 * whole :], whole, tokens))
                        held += tokens - whole
                if held >= group_tokens:
                    close()
                if sum(r[2] for r in rows) >= group_tokens // 4:
                    yield flush()
        words.forget()
        if pool:
            close()
        if rows:
            yield flush()

    key = docs.schema[id_col]
    picked = docs.select(F.col(id_col), text_bytes(text_col).alias(fresh(docs, "text_bytes")))
    schema = pa.schema([("key", _arrow(key.dataType)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return picked.mapInArrow(packed, f"key {key.dataType.simpleString()}, {PIECES}").withColumnRenamed("key", id_col)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
