"""The words that a packing worker remembers."""

import numpy as np

from spreadlake.llm import packing
from spreadlake.llm.queries import tokenizer_path


def test_words_met_lately_stay_and_the_others_go(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    words = packing.WordIds(tokenizer_path())
    learnt = []
    ids = words._ids
    monkeypatch.setattr(words, "_ids", lambda text: learnt.append(text) or ids(text))
    texts = [f"Common day, w{chr(97 + i % 26)}{i} odd#{i} rest." for i in range(100)]
    got = [words.encode([t.encode()])[0] for t in texts]
    assert sum("common" in text for text in learnt) == 1
    assert len(words.known) + len(words.older) <= 60 + 6
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
