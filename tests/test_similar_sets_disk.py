"""What self-similarity writes to disk, and that nothing is lost by what it spares."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import text as T
from vitrina.operators import matching, simjoin


def _shuffled(spark):
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))


def test_sets_without_a_candidate_are_not_shuffled(spark):
    """Only the prefixes of sets travel where no two are similar."""
    token = lambda i: F.hex(F.xxhash64("id", i))
    rows = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(300)), token).alias("tokens"))
    before = _shuffled(spark)
    assert matching.similar_pairs_of_sets(simjoin.distinct_sets(rows, "id"), 0.8).count() == 0
    assert _shuffled(spark) - before < 3.5 * 3000 * 300 * 16


def _brute_force(rows, threshold):
    """The SQL of ``j23_similar_documents`` over ``(id, tokens)``."""
    sets = {}
    for i, tokens in rows:
        if tokens:
            sets.setdefault(frozenset(tokens), []).append(i)
    first = [(k, min((i for i in ids if i is not None), default=None), len(ids)) for k, ids in sets.items()]
    out = [(i, i, 1.0, n, n, n * (n - 1) // 2) for _, i, n in first if n > 1]
    for ka, a, na in first:
        for kb, b, nb in first:
            score = len(ka & kb) / len(ka | kb)
            if a is not None and b is not None and a < b and score >= threshold - 1e-9:
                out.append((a, b, round(score, 6), na, nb, na * nb))
    return sorted(out, key=str)


def _near_copies(rng, n, copies, changed):
    base = [f"b{n}x{i}" for i in range(n)]
    return [[t if rng.random() > changed else f"c{rng.randrange(10**9)}" for t in base] for _ in range(copies)]


def test_ids_may_repeat_or_be_missing(spark):
    """Sets that share an id are sets of their own; copies count wherever they stand."""
    rng = random.Random(5)
    sets = _near_copies(rng, 40, 12, 0.06)
    rows = [(rng.choice([1, 2, 3, 4, None]), s) for s in sets] + [(7, sets[0]), (7, sets[0]), (None, sets[1]), (8, []), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    got = matching.similar_pairs_of_sets(simjoin.distinct_sets(frame, "doc_id"), 0.8)
    assert sorted(((*r[:2], round(r[2], 6), *r[3:]) for r in got.collect()), key=str) == _brute_force(rows, 0.8)


def test_tiles_and_wide_sketches_lose_nothing(spark, monkeypatch):
    """Groups larger than a tile, sets longer than a sketch's bits, and sizes on both sides of a power of two."""
    monkeypatch.setattr(simjoin, "TILE_SETS", 3)
    rng = random.Random(7)
    sets = [s for n, copies in ((6, 5), (30, 14), (300, 10), (700, 6)) for s in _near_copies(rng, n, copies, 0.05)]
    sets += [s[: len(s) - rng.randrange(len(s) // 6)] for s in _near_copies(rng, 560, 8, 0.03)]
    sets += [[f"r{rng.randrange(3000)}" for _ in range(600)] for _ in range(6)]
    rows = [(i, sorted(set(s))) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    got = matching.similar_pairs_of_sets(simjoin.distinct_sets(frame, "doc_id"), 0.8)
    want = _brute_force(rows, 0.8)
    assert len(want) > 80
    assert sorted(((*r[:2], round(r[2], 6), *r[3:]) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("stop", [(), lx.STOP_GENERIC])
def test_one_pass_finds_the_same_words(spark, stop):
    texts = ["", " ", "a", "a b c", "Ab a cd  x1 1 22", "É è ñandú über ÇA_va a_b", "x\x0by\tzz\r\nqq aa\x0bbb", "it's l'été 5kg 2.5 kg", None,
             "İstanbul Kelvin été ﬁn 日本 go2  nb th 🐶dog", "dup dup Dup DÚP", "para de the and perro"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one, two = rows.select(T.tokenize(F.col("t"), stop), T.tokenize_normalized(T.normalize_text(F.col("t")), stop)).toPandas().T.values.tolist()
    assert [x if x is None else list(x) for x in one] == [x if x is None else list(x) for x in two]
