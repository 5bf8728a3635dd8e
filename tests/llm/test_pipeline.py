"""The pipeline's stages against plain versions, on a folder of small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from samples import SCHEMA, prose, shipped  # noqa: F401
from test_encoding_packing import plain
from test_joins import edited, groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where, draw = str(tmp_path_factory.mktemp("tables")), random.Random(9)
    rows, labels = [], []
    for i in range(240):
        text = prose(500 + i, 40 + i % 60)
        if i % 6 == 0:
            words = text.split()
            for k in range(4):
                words[draw.randrange(len(words))] = ("vile", "moron", "filth", "scum")[k]
            text = " ".join(words)
        if i % 7 == 1:
            text += f" Mail a.{i}@mail.example.com or call +1 (017) 555-{1000 + i}."
        rows.append((i, text, "en", f"s{i % 4}" if i % 11 else None, len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + i, edited(i, rows[i + 1][1], i % 5), "en", "s0", 1) for i in range(40) if (i + 1) % 6]
    rows += [(400, None, None, None, None), (401, "", "", "", 0), (402, rows[5][1], "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    every, civil, single, private, mixed, packed = seen

    kept = {r["doc_id"] for r in civil}
    assert all(r in every for r in civil)
    toxic = {r["doc_id"] for r in every if set(re.findall(r"\w+", r["text"] or "")) & {"vile", "moron", "filth", "scum"}}
    assert not kept & toxic and kept == {r["doc_id"] for r in every} - toxic

    label = {a: c for a, _, c in groups([tuple(r) for r in civil], 5, 80)}
    assert sorted(single, key=repr) == sorted((r for r in civil if label[r["doc_id"]] == r["doc_id"]), key=repr)

    before = {r["doc_id"]: r["text"] for r in single}
    assert {r["doc_id"] for r in private} == set(before)
    for r in private:
        old, new = before[r["doc_id"]], r["text"]
        if old and "@" in old:
            values = re.findall(r"\S+@\S+|\(\d{3}\) \d{3}-\d{4}", old)
            assert not any(v in new for v in values) and len(new) == len(old)
            assert new.split(" Mail ")[0] == old.split(" Mail ")[0]
        else:
            assert new == old

    count = lambda t: len((t or "").split())
    sizes, taken, words = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in private:
        sizes[r["source"]] += count(r["text"])
        words[r["doc_id"]] = count(r["text"])
    per_doc = defaultdict(int)
    for r in mixed:
        taken[r["source"]] += count(r["text"])
        per_doc[r["doc_id"]] += count(r["text"])
        full = next(p["text"] for p in private if p["doc_id"] == r["doc_id"])
        assert full.startswith(r["text"]) and r["n_chars"] == len(r["text"])
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    assert all(per_doc[d] <= 3 * words[d] for d in per_doc) and abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    open_ = [s for s in sizes if taken[s] < 3 * sizes[s]]
    levels = [taken[s] / weight[s] for s in open_]
    assert max(levels) - min(levels) <= 1

    ids = sorted(i for r in mixed for i in [*plain("word_bpe_49k.json", r["text"]), 1])
    assert sorted(i for r in packed for i in np.frombuffer(r["ids"], "<u4").tolist()) == ids
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").filter("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mix_takes_rows_without_id_and_rows_that_share_one(spark):
    rows = [(None, prose(i, 20 + i), "en", "a", 1) for i in range(6)] + [(7, prose(50 + i % 5, 30 + i % 5), "en", "b", 1) for i in range(20)]
    rows += [(100 + i, prose(90 + i, 25), "en", "c", 1) for i in range(10)]
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    per_text = defaultdict(int)
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
        per_text[max((t for _, t, *_ in rows if t.startswith(r["text"])), key=len)] += len(r["text"].split())
    level = sum(sizes.values()) / 8
    targets = {"a": 5 * level, "b": 2 * level, "c": level}
    if targets["a"] > 3 * sizes["a"]:
        level = (sum(sizes.values()) - 3 * sizes["a"]) / 3
        targets = {"a": 3 * sizes["a"], "b": 2 * level, "c": level}
    assert {s: taken[s] for s in sizes} == {s: round(t) for s, t in targets.items()}
    for text, n in per_text.items():
        assert n <= 3 * len(text.split()) * sum(r[1] == text for r in rows)


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    base, other, own = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(None, base, 0), (None, base, 1), (None, edited(1, base, 1), 2), (9, other, 3), (9, other, 4), (9, edited(2, other, 1), 5),
            (4, other, 6), (9, own, 7), (None, None, 8), (None, None, 9), (None, prose(4, 80), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    kept = sorted(r["n"] for r in left)
    assert len([n for n in kept if n < 3]) == 1 and [n for n in kept if n >= 3] == [6, 7, 8, 9, 10]
    assert all((r["doc_id"], r["text"], r["n"]) == rows[r["n"]] for r in left)
