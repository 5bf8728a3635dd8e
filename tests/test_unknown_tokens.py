"""Queries that differ in tokens no entry has are one query of the join."""

import os

import pytest

from vitrina.lexicon import PROFILES
from vitrina.operators import matching, simjoin
from vitrina.plans import cascade_queries
from vitrina.plans.registry import Tables
from vitrina.session import configure

from conftest import TESTDATA


@pytest.mark.parametrize("how", ["best", "top", "near"])
def test_queries_that_no_entry_tells_apart_meet_once(spark, monkeypatch, how):
    entries = spark.createDataFrame([("a", ["dog", "duck"], 0), ("b", ["cat", "duck"], 0)], "pref string, tokens array<string>, guards int")
    rows = [(i, ["dog", "duck", f"brand{i}", f"{i}kg"], 0) for i in range(50)] + [(90, ["cat"], 0), (91, ["only", "unknown"], 0)]
    queries = spark.createDataFrame(rows, "qid long, tokens array<string>, guards int")
    seen = []

    class Index(simjoin._Index):
        def __init__(self, q, *rest):
            seen.append(q.count())
            super().__init__(q, *rest)

    monkeypatch.setattr(simjoin, "_Index", Index)
    if how == "best":
        found = simjoin.best_matches(queries, entries, 0.3)
    elif how == "top":
        found = simjoin.top_matches(queries, entries, 0.3, 1)
    else:
        found = simjoin.near_best_matches(queries, entries, 0.3, 0.05)
    got = {(r["qid"], r["pref"], round(r["score"], 6)) for r in found.collect()}
    assert got == {(i, "a", 0.5) for i in range(50)} | {(90, "b", 0.5)}
    assert seen == [2]


def test_titles_are_tokenised_once(spark):
    products = spark.createDataFrame([(i, f"Dog duck {i}kg") for i in range(5)], "product_id long, title string")
    catalog = spark.createDataFrame([("dog-duck", 1, "Dog Duck")], "handle string, ord long, name string")
    found = matching.match_best(products, catalog, PROFILES["calibra"])
    assert "title" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["handle"] for r in found.collect()} == {"dog-duck"} and found.count() == 5


@pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="test tables are not mounted")
def test_slugs_are_made_once_per_title(spark):
    t = Tables(configure(spark), f"{TESTDATA}/sf0.001")
    got = cascade_queries.slugs(t)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == t.part.count()
