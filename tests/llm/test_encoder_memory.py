"""What the encoder remembers, and for how long."""

import numpy as np

from vitrina.llm import encoding
from vitrina.llm.common import KEPT, slices
from vitrina.llm.encoding import TextEncoder, vocabulary


def test_a_chunk_is_encoded_once_also_over_batches(monkeypatch):
    for name, join in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder, asked = TextEncoder(vocabulary(name), join), []
        table = encoder._encode_runs
        monkeypatch.setattr(encoder, "_encode_runs", lambda runs, before: asked.extend(runs) or table(runs, before))
        texts = ["Perro, gato\nperro, año.", "x\t\ty  z Perro,"]
        first = encoder.encode_many(texts)
        del asked[:]
        assert encoder.encode_many(texts) == first
        assert asked == [] and "x\t\ty" not in encoder.known[""] and "gato\nperro," in encoder.known[" " if join else ""]


def test_full_memory_is_emptied_between_batches_only(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 3)
    for name, join in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder, plain = TextEncoder(vocabulary(name), join), TextEncoder(vocabulary(name), join).tokenizer
        for text in ("uno dos tres cuatro", "cinco\nseis, siete uno", "dos! tres\nuno", "uno", ""):
            assert np.frombuffer(encoder.encode_many([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_task_of_another_kind_gives_the_encoders_memory_back():
    own = TextEncoder.of(vocabulary("word_bpe_49k.json"), False)
    name = TextEncoder.kept_as(vocabulary("word_bpe_49k.json"), False)
    list(slices(iter(()), keeps=name))
    assert KEPT == {name: own}
    list(slices(iter(())))
    assert KEPT == {}


def test_a_stage_may_remember_less_and_gets_the_same_ids():
    name, texts = vocabulary("word_bpe_49k.json"), ["uno dos tres cuatro", "cinco\nseis, siete uno", "ocho nueve"]
    want = [TextEncoder.of(name, False).encode_many([t]) for t in texts]
    list(slices(iter(())))
    few = TextEncoder.of(name, False, 3)
    assert [few.encode_many([t]) for t in texts] == want
    assert set(few.known[""]) == {"ocho", "nueve"}
    assert TextEncoder.of(name, False) is few and few.remembered == encoding.REMEMBERED
    list(slices(iter(())))
