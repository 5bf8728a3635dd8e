"""Jaccard join, repeated strings and top-k search against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from samples import SCHEMA, corpus, none, prose, shipped  # noqa: F401
from vitrina.llm import jaccard_join, repeats, topk

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words):
    found = (text or "").translate(_LOWER).encode().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def groups(rows, words, percent):
    sets = [(i, r[0], shingle_set(r[1], words)) for i, r in enumerate(rows)]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a, s in sets:
        for j, b, t in sets[:i]:
            common = len(s & t)
            if (s and t and 100 * common >= percent * (len(s) + len(t) - common)) or (a is not None and a == b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, a, s in sets:
        ids = [b for j, b, t in sets if root(j) == root(i) and b is not None]
        out.append((a, len(s), min(ids) if s and ids else a))
    return sorted(out, key=repr)


def edited(seed, text, n):
    draw, words = random.Random(seed), text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows(corpus):
    base, long = prose(7, 60), prose(8, 400)
    rows = [*corpus, (100, base, "", "", 0), *((101 + i, edited(i, base, i % 4), "", "", 0) for i in range(40))]
    rows += [(200 + i, edited(i, long, i % 9), "", "", 0) for i in range(60)]
    rows += [(300 + i, prose(i, 4 + i % 20) + (" tail" if i % 2 else ""), "", "", 0) for i in range(40)]
    rows += [(400 + i, " ".join(prose(i // 2, 10 + i % 12).split()[i % 2:]).upper(), "", "", 0) for i in range(60)]
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, near_rows, none, words, percent):
    docs = spark.createDataFrame(near_rows, SCHEMA).withColumnRenamed("lang", "node")
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs, words, percent).collect()), key=repr)
    assert got == groups(near_rows, words, percent)
    assert jaccard_join.near_duplicates(none).collect() == []


def test_sketches_never_part_similar_sets():
    """The bound holds for sets of all sizes and overlaps, also where their sketches differ in width."""
    draw = np.random.default_rng(17)
    parted = 0
    for _ in range(600):
        n, keep, extra = int(draw.integers(1, 900)), draw.random() ** 0.3, int(draw.integers(0, 300))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        b = np.union1d(a[draw.random(len(a)) < keep], draw.integers(0, 1 << 63, extra, dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
        words = min(len(x), len(y)) // 8
        for percent in (50, 80, 85, 100):
            may = bool(jaccard_join.possible(
                jaccard_join.folded(x, words), len(a), jaccard_join.folded(y, words), len(b), percent))
            similar = 100 * common >= percent * (len(a) + len(b) - common)
            assert may or not similar
            parted += not may
    assert parted > 600


def test_similar_sets_share_a_key():
    draw = np.random.default_rng(3)
    for boundary in (0, 6, 13, 24):
        for percent in (80, 85):
            scheme = jaccard_join.Scheme(percent, boundary)
            for _ in range(300):
                n = int(draw.integers(1, 120))
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
                lose, add = draw.integers(0, n // 5 + 1, 2)
                b = np.unique(np.concatenate([draw.permutation(a)[lose:], draw.integers(0, 2**63, add, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and common:
                    assert len(np.intersect1d(scheme.keys(a), scheme.keys(b)))


def cut(texts, length):
    """Brute force: remaining bytes and spans of each text."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,hot", [(200, 100, 1000), (40, 20, 1000), (40, 20, 2), (30, 7, 3)])
def test_repeats(spark, near_rows, none, length, gram, hot):
    rows = near_rows[:90]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "sha")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                  for r in repeats.remove_repeats(docs, length, gram, hot).collect()), key=repr)
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0], len(t), *c) for r, t, c in zip(rows, texts, cut(texts, length), strict=True)), key=repr)
    assert got == want
    assert repeats.remove_repeats(none).collect() == []


def test_suffix_sort_survives_collisions(monkeypatch):
    """With hashes that lie the bytes decide."""
    draw = random.Random(4)
    rows = [bytes(draw.choice(b"ab") for _ in range(60)) for _ in range(40)] * 2
    args = (np.zeros(len(rows), np.int64), rows, np.full(len(rows), 20), np.zeros(len(rows), np.int64), 40, 20)
    want = [(o.tolist(), d, r.tolist()) for o, d, r, _ in repeats.equal_windows(*args)]
    assert all(all(r) for _, _, r in want)
    monkeypatch.setattr(repeats.Suffixes, "extension", lambda self, x, y: np.minimum(self.sizes[x], self.sizes[y]) // 2)
    assert [(o.tolist(), d, r.tolist()) for o, d, r, _ in repeats.equal_windows(*args)] == want


def test_top_k(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(draw.normal(size=20), 1)], i) for i in range(250)]
    rows += [(7, rows[0][1], 0), (250, rows[3][1], 0), (251, rows[3][1], 0), (300, None, 0), (301, [], 0), (302, [1.0, None], 0),
             (400, [float("nan")] * 20, 0), (401, [float("inf")] * 20, 0), (None, rows[3][1], 0), (500, [1.0, 2.0], 0), (501, [3.0, 4.0], 0),
             (600, [2e5] * 20, 0), (601, [-2e5] * 20, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v long").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(frame, k=5, every=50, group_rows=64, query_rows=2).collect())
    usable = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v, _ in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in usable if c != q and len(w) == len(v))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert topk.top_k(frame.filter("false")).collect() == []


def test_large_ids_keep_their_groups(spark):
    """Ids from 2^62 on, also beside rows without id."""
    high, text = 1 << 62, prose(41, 60)
    rows = [(high + 5, text), (high + 6, text), (None, text), ((1 << 63) - 1, prose(42, 60)), (None, prose(43, 60)), (None, prose(43, 60)), (high + 9, "")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(
        [(high + 5, high + 5), (high + 6, high + 5), (None, high + 5), ((1 << 63) - 1, (1 << 63) - 1), (None, None), (None, None), (high + 9, high + 9)], key=str)


def test_top_k_of_large_components(spark):
    """No component is too large: what 64-bit floats can't hold is computed in integers."""
    draw = random.Random(8)
    rows = [(i, [draw.choice([3e5, -2.5e5, 1.5, -0.25, 7e7, 2e9]) for _ in range(130)]) for i in range(0, 250, 5)]
    rows += [(300, [3e5] + [0.5] * 129), (301, [1e300] + [1.0] * 129), (302, [1e306] * 130), (400, [-1e200] * 130)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if all(math.isfinite(1024 * x) for x in v)}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scores = ((max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        want += [(q, rank, c, s) for rank, (s, c) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:10], 1)]
    assert sorted(got) == sorted(want)
