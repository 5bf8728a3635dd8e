"""What the stages of the pipeline leave on disk and shuffle."""

import os

import pytest

import corpus_pipeline
from vitrina.llm import mixing
from vitrina.session import checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder)}


def _docs(spark):
    rows = [(i if i % 7 else None, f"w{i % 5} two three four five w{i % 3}", "en", "abc"[i % 3] if i % 11 else None, 30) for i in range(60)]
    rows += [(3, "same same", "en", "a", 9)] * 5 + [(4, None, "en", "a", 0), (5, "", "en", "b", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_near_duplicates_leave_two_tables(spark):
    before = _tables(spark)
    out = corpus_pipeline.drop_near_duplicates(spark, _docs(spark), "")
    assert len(_tables(spark) - before) == 2  # the keyed rows and the keys that go
    assert out.count() > 0


def test_mix_does_not_shuffle_texts(spark):
    plan = mixing.mix_texts(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("seed", [7, 8])
def test_mix_by_the_last_row_equals_the_mix_by_rows(spark, monkeypatch, seed):
    docs = _docs(spark).persist()
    by_cut = sorted(map(tuple, mixing.mix_texts(docs, seed).collect()), key=repr)
    monkeypatch.setattr(mixing, "CUT_SOURCES", 0)
    by_row = sorted(map(tuple, mixing.mix_texts(docs, seed).collect()), key=repr)
    assert by_cut == by_row and len(by_cut) > 60
    docs.unpersist()
