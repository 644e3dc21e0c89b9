"""Words of letters go to the tokenizer's model as they are, and get the whole tokenizer's ids."""

import random

import pyarrow as pa

from spreadlake.llm import packing
from spreadlake.llm.queries import tokenizer_path


def test_words_of_letters_take_the_model_alone(monkeypatch):
    words = packing.WordIds(tokenizer_path())
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    some = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000)] + list(letters) + ["the", "straße", "niño"]
    text = " ".join(some)
    want = words.tokenizer.encode(text, add_special_tokens=False).ids

    class Fails:
        def encode(self, *args, **kwargs):
            raise AssertionError("the whole tokenizer was asked")

    monkeypatch.setattr(words, "tokenizer", Fails())
    monkeypatch.setitem(words.known, b".", b"")
    monkeypatch.setitem(words.known, b",", b"")
    assert words.encode([text.encode()])[0] == b"".join(i.to_bytes(4, "little") for i in want)


def test_a_task_leaves_no_words_in_its_worker(spark, docs_of):
    path = tokenizer_path()

    def look(batches):
        for batch in batches:
            at = packing._TOKENIZERS.get(path)
            yield pa.RecordBatch.from_pydict({"held": [-1 if at is None else len(at.known) + len(at.older)] * batch.num_rows})

    assert packing.pack(docs_of([(i, f"some words of text {i}") for i in range(50)]), path).count() >= 50
    held = [r.held for r in spark.range(64).repartition(8).mapInArrow(look, "held bigint").collect()]
    assert max(held) == 0  # a worker that has packed is met again, and remembers no word
