"""Token files and packing: exact round trips against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samples import corpus, documents, none, shipped  # noqa: F401
from vitrina.llm import packing, token_files
from vitrina.llm.encoding import TextEncoder, vocabulary

VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def plain(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,joins", VOCABULARIES)
def test_chunks_give_the_ids_of_the_whole_text(name, joins):
    texts = [
        "", " ", "  a  b", "a \n b", "\n\nX y\n\nz", " lead", "tail ", "x y z  w", "it's don't 'tis a'b", "é a ́b", "12 3a b4 c",
        "İI ß ŉ", "<|endoftext|> a<|startoftext|>b", "a\tb c\r\nd", "日本 語。\nx", "A.\nB.\n C", "a.\n\nb c", '"q" (x) [y]',
        "\x1c a\x1c b", "x" * 3000 + " y", "Word,\nNext. end!!!\n", "a b a  b",
    ]
    assert [np.frombuffer(x, "<u4").tolist() for x in TextEncoder.of(vocabulary(name), joins).encode_many(texts)] == [
        plain(name, t) for t in texts]


@pytest.mark.parametrize("name,joins", VOCABULARIES)
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aBé .,'\n\t1ß日|<")), max_size=40))
def test_any_text(name, joins, text):
    assert np.frombuffer(TextEncoder.of(vocabulary(name), joins).encode_many([text])[0], "<u4").tolist() == plain(name, text)


@pytest.mark.parametrize("percentile", [50.0, 90.0, 100.0])
def test_file_round_trip(tmp_path, percentile):
    draw = np.random.default_rng(1)
    docs = [(i, draw.choice([3, 70, 40_000, 4_000_000_000 if i % 5 == 0 else 9], size=n).astype("<u4")) for i, n in enumerate([0, 1, 1023, 1024, 1025, 300_000, 7])]
    writer = token_files.TokenFileWriter(str(tmp_path / "a.pfb"), percentile)
    for i, ids in docs:
        writer.add(None if i == 6 else i, ids.tobytes())
    writer.close()
    file = token_files.TokenFile(str(tmp_path / "a.pfb"))
    assert list(file.documents(5000)) == [(None if i == 6 else i, len(x), zlib.crc32(x.tobytes())) for i, x in docs]
    every = np.concatenate([x for _, x in docs])
    for first, n in ((0, 0), (0, 5), (1020, 10), (2048, 1024), (1, len(every) - 1), (len(every) - 1, 1)):
        assert (file.ids(first, n) == every[first:first + n]).all()


def test_token_files(spark, documents, corpus, none):
    got = [tuple(r) for r in token_files.read_documents(
        token_files.write_token_files(documents.withColumn("path", documents["lang"]), vocabulary("byte_bpe_50k.json"))).collect()]
    want, start = [], 0
    nulls = [r for r in corpus if r[0] is None]
    for doc_id, group in ((None, nulls), *((k, [r for r in corpus if r[0] == k]) for k in sorted({r[0] for r in corpus} - {None}))):
        group = [np.array([*plain("byte_bpe_50k.json", r[1]), 0], "<u4") for r in group]
        own = {(g[0], g[2], g[3]) for g in got if g[0] == doc_id}
        assert {(doc_id, len(x), zlib.crc32(x.tobytes())) for x in group} == own
        assert min(g[1] for g in got if g[0] == doc_id) == start
        start += sum(map(len, group))
        want += group
    assert len(got) == len(want) == len(corpus)
    assert token_files.read_documents(token_files.write_token_files(none, vocabulary("byte_bpe_50k.json"))).collect() == []


def test_fill_is_the_best_subset():
    draw = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(draw.choice(np.arange(1, 30), 5, replace=False), draw.integers(1, 4, 5), strict=True)}
        capacity = int(draw.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        chosen = packing.fill(dict(counts), capacity)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)
        assert all(0 < n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("pool", [4, 4096])
def test_packing(spark, documents, corpus, none, pool):
    rows = packing.pack_documents(documents, vocabulary("word_bpe_49k.json"), capacity=256, pool=pool).collect()
    ids = [tuple([*plain("word_bpe_49k.json", r[1]), 1]) for r in corpus]
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.05 * sum(map(len, ids))
    assert sorted(i for parts in docs.values() for _, x in parts for i in x) == sorted(i for x in ids for i in x)
    for (doc_id, tokens), parts in docs.items():
        same = [x for r, x in zip(corpus, ids, strict=True) if r[0] == doc_id and len(x) == tokens]
        if len(same) == 1:
            assert tuple(i for _, x in sorted(parts) for i in x) == same[0]
    assert packing.pack_documents(none, vocabulary("word_bpe_49k.json")).collect() == []
