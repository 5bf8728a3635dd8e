"""Quality classifier: word vectors against plain sums, network and temperature, held-out accuracy, edge cases."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from samples import SCHEMA, documents, corpus, none, prose, shipped  # noqa: F401
from vitrina.llm import quality

SMALL = quality.QualitySettings(buckets=500, dimensions=16, epochs=30)


def numbers(text, buckets):
    """Bucket numbers of a text's words, one by one."""
    out = []
    for word in re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or ""):
        out.append(0 if len(word) > 1 and word.isupper() else 2 + zlib.crc32(word.lower().encode()) % (buckets - 2))
    return [1 if i and a == out[i - 1] else a for i, a in enumerate(out)]


def plain_vectors(texts, settings):
    places, signs = quality.index_vectors(settings)
    index = np.zeros((settings.buckets, settings.dimensions))
    for b in range(settings.buckets):
        for p, s in zip(places[b], signs[b], strict=True):
            index[b, p] += s
    sums = np.zeros_like(index)
    for text in texts:
        words = numbers(text, settings.buckets)
        for i, w in enumerate(words):
            for near in words[max(0, i - settings.window):i + settings.window + 1]:
                sums[w] += index[near]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(length > 0, length, 1)


def test_word_vectors_and_pooling(documents, corpus, none):
    got = quality.word_vectors(documents.withColumn("low", F.lit("x")), SMALL)
    want = plain_vectors([r[1] for r in corpus], SMALL)
    assert np.allclose(got, want, atol=1e-6)
    assert not quality.word_vectors(none, SMALL).any()
    pooled = quality.pooled(documents.withColumn("n", F.monotonically_increasing_id()), "n", got, SMALL).collect()
    have = sorted(tuple(np.round(np.frombuffer(r["features"], "<f4"), 3)) for r in pooled)
    plain = []
    for _, text, *_ in corpus:
        found = want[numbers(text, SMALL.buckets)] if text else np.zeros((0, SMALL.dimensions))
        mean = found.mean(axis=0) if len(found) else np.zeros(SMALL.dimensions)
        spread = found.std(axis=0) if len(found) else mean
        plain.append(tuple(np.round(np.concatenate([mean, spread, [np.log1p(len(found))]]), 3)))
    assert np.allclose(have, sorted(plain), atol=0.004)


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(quality, "_PIECE", 40)
    text = "Some WORDS here, here !! " * 20 + "y" * 200
    found = [n for part in quality.WordReader(500).read(text.encode()) for n in part.tolist()]
    whole = numbers(text, 500)
    assert [n for n in found if n != 1][:40] == [n for n in whole if n != 1][:40] and abs(len(found) - len(whole)) <= 5


def test_temperature():
    draw = np.random.default_rng(1)
    logit = draw.normal(0, 2, 4000)
    y = (draw.random(4000) < 1 / (1 + np.exp(-logit))).astype(int)
    net = quality.Network(np.zeros(1), np.ones(1), [np.full((1, 1), 0.001), np.zeros(1), np.full((1, 1), 3000.0), np.zeros(1)])
    quality.calibrate(net, logit[:, None], y)
    assert 2.6 < net.temperature < 3.5


def junk(seed):
    kind, words = seed % 4, prose(seed, 60).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(words)
    if kind == 2:
        return " ".join(w + random.Random(seed).choice(["###", "$$$", "%%%"]) for w in words)
    return " ".join(w for w in words[:6] for _ in range(12))


def test_held_out_accuracy(spark):
    rows = [(i, prose(i, 60) if i % 3 else junk(i), "en", "s", 1) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels, train).collect()}
    assert len(got) == 600
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in got)


def test_edge_cases(spark, documents, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(documents, no_labels, settings=SMALL).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1, 0), (10, 1, None), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(documents, good, settings=SMALL).collect()} == {1.0}
    both = good.unionByName(spark.createDataFrame([(13, 0, 0), (12, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score_documents(documents.withColumn("features", F.lit(1)).withColumn("score", F.lit(2)), both, settings=SMALL).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(none, both, settings=SMALL).collect() == []


def test_one_labelled_id_in_many_rows(spark):
    """A hot labelled id is fitted once."""
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("Some text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, "BAD!! STUFF!!")], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int")
    seen = []
    whole, quality.train_network = quality.train_network, lambda x, y, s: (seen.append(len(x)), whole(x, y, s))[1]
    try:
        assert quality.score_documents(docs, labels, settings=SMALL).count() == 3001
    finally:
        quality.train_network = whole
    assert seen == [2]
