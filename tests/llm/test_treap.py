"""Ranked search against plain scoring of every document, and the treap against a plain grid."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import documents, corpus, none, prose, shipped  # noqa: F401
from vitrina.llm import treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k=10):
    docs = [(doc_id, Counter(words(text))) for doc_id, text in rows]
    docs = [(doc_id, c) for doc_id, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block_docs,block_terms,portion", [(1 << 14, 1 << 21, 100_000), (3, 1 << 21, 60), (7, 900, 200)])
def test_search(spark, corpus, documents, block_docs, block_terms, portion):
    items = [
        (1, prose(1, 30)), (2, prose(2, 40).upper()), (3, None), (4, ""), (5, "unheard-of"), (6, "ONE two, 日本語 ñandú Ünïcödé"), (None, "one"),
        (7, "words"), (7, "two the words"), (6, "x" * 700), (8, " ".join(prose(i, 30) for i in range(6)))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1))
    got = treap.ranked_search(documents.withColumn("rank", F.lit(0)), table, block_docs=block_docs, block_terms=block_terms, portion=portion)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(tuple(r) for r in got.collect()) == order(plain([r[:2] for r in corpus], items))


def test_many_documents_and_ties(spark, none):
    draw = random.Random(5)
    vocabulary = [f"w{int(draw.paretovariate(0.4)) % 3000}" for _ in range(4000)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 60)))) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(25))) for i in range(15)] + [(99, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = treap.ranked_search(docs, table, block_docs=200)
    assert order(tuple(r) for r in got.collect()) == order(plain(rows, items))
    assert treap.ranked_search(none, table).collect() == []
    assert treap.ranked_search(docs, table.limit(0)).collect() == []


def test_terms_of_long_texts(monkeypatch):
    text = ("Alpha, beta" + "é" * 40 + " gamma-1 " * 30 + "z" * 99 + "!").encode()
    for size in (1, 3, 10, 64, 1 << 20):
        monkeypatch.setattr(treap, "_PIECE", size)
        assert [t.decode() for part in treap.terms(text) for t in part] == words(text.decode()), size


def test_treap():
    draw = np.random.default_rng(3)
    for rows, columns, n in ((1, 1, 1), (5, 40, 60), (300, 17, 900), (64, 64, 4096)):
        cells = np.unique(draw.integers(0, rows * columns, n))
        r, c, v = cells // columns, cells % columns, draw.integers(1, 50, len(cells))
        grid = np.zeros((rows, columns), np.int64)
        grid[r, c] = v
        built = treap.Treap.build(r, c, v)
        again = treap.Treap.from_bytes(built.to_bytes())
        assert (again.masks == built.masks).all() and (again.tops == built.tops).all() and (again.first == built.first).all()
        for _ in range(20):
            asked = draw.choice(rows, min(rows, 4), replace=False)
            weights = draw.integers(1, 9, len(asked))
            total = weights @ grid[asked]
            found, scores = again.search(asked, weights, 1, 3)
            assert (total[found] == scores).all()
            best = np.sort(total[total > 0])[::-1]
            least = best[min(3, len(best)) - 1] if len(best) else 1
            assert sorted(found.tolist()) == np.flatnonzero(total >= least).tolist() if len(best) else len(found) == 0
