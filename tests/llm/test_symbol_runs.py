"""A run of symbols after a word's letters is encoded once, not with each word that it follows."""

import random

from spreadlake.llm import packing
from spreadlake.llm.queries import tokenizer_path

RUNS = ["$$$", ".%%%", ",!!!", "&&&&", "...", "!", "<|", "|>", "_", "`~", "^", "\\", "[]", "{}", "@", "/-"]


def test_runs_are_learnt_apart(monkeypatch):
    words = packing.WordIds(tokenizer_path())
    learnt = []
    ids = words._ids
    monkeypatch.setattr(words, "_ids", lambda text: learnt.append(text) or ids(text))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCßÀÉéñÿ"
    some = ["".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(RUNS) for _ in range(500)]
    got = words.encode([" ".join(some).encode()])[0]
    assert got == b"".join(i.to_bytes(4, "little") for i in words.tokenizer.encode(" ".join(some), add_special_tokens=False).ids)
    assert not any(run in text for text in learnt for run in RUNS if text[:1].isalpha())


def test_odd_words_keep_the_tokenizers_ids():
    words = packing.WordIds(tokenizer_path())
    texts = ["don't we'll 's a's' x''", "a<|endoftext|> b<|startoftext|>. <|endoftext|>!", "a$b$$ $$a 3$ a3$ 1.5. u.s.a.", "é!! ×! ÷. İ. a̸ ≮ a≮", "", " \t\n", "a b! ßE. ÃŸ!"]
    for text in texts:
        raw = b"".join(i.to_bytes(4, "little") for i in words.tokenizer.encode(text, add_special_tokens=False).ids)
        assert words.encode([text.encode()])[0] == raw, text
