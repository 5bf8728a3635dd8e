"""Work per page instead of per hit, one meeting of a product's rows: read from the plans."""

import os
import re

import pytest

from vitrina.lexicon import PROFILES
from vitrina.operators import cascade as C
from vitrina.operators import hits as H
from vitrina.operators import matching
from vitrina.plans import QUERIES, run_queries
from vitrina.plans.registry import Tables
from vitrina.session import configure

from conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _joins(df):
    """Joins of the optimized plan and what is computed above the first of them."""
    above, _, below = _plan(df).partition("Join ")
    return above, len(re.findall(r"\bJoin ", "Join " + below)) if below else 0


@tables
@pytest.mark.parametrize("name", ["j18_three_queries", "j18_hit_selection", "j15_first_confirmed", "j15_first_confirmed_image"])
def test_pages_are_read_before_their_hits(spark, name):
    """Above the join of hits and pages nothing is worked out from a page's raw name."""
    assert "p_name" not in _plan(QUERIES[name](spark, FOLDER)).rpartition("Join ")[0]


def test_selected_hits_meet_once_per_product(spark):
    rows = [(1, 1, 5, "https://a.x/1"), (1, 2, 6, "https://a.x/2"), (1, 3, 7, "https://a.x/3"), (2, 2, 1, "https://a.x/4#t")]
    frame = spark.createDataFrame(rows, "product_id long, query_rank int, rank long, url string")
    got = H.select_hits(frame, "a.x", max_urls=3, enough=(2, 2))
    assert _joins(got)[1] == 0
    assert {tuple(r) for r in got.collect()} == {(1, 1, "https://a.x/1"), (1, 2, "https://a.x/2"), (2, 1, "https://a.x/4")}


@tables
def test_marketplace_titles_are_tokenised_per_page(spark):
    plan = _plan(QUERIES["j29_marketplace_hits"](spark, FOLDER))
    assert len(re.findall(r"\bJoin ", plan)) == 2
    assert "split_part" not in plan.partition("Join ")[0]


def test_image_sources_meet_once_per_product(spark):
    rows = [(1, "override", 1, "a"), (1, "match", 2, "b"), (1, "marketplace", 3, "c"), (2, "generic", 1, "d"), (3, "match", 1, "e"),
            (3, "generic", 2, "f"), (None, "match", 1, "g")]
    got = C.combine_image_sources(spark.createDataFrame(rows, "product_id long, source string, ord long, url string"))
    assert _joins(got)[1] == 0
    assert {r["url"] for r in got.collect()} == {"a", "c", "d", "e"}


@tables
def test_candidates_travel_once_and_without_urls(spark):
    rows = run_queries.candidates(Tables(configure(spark), FOLDER))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "https" not in plan[plan.index("Exchange hashpartitioning"):]


def test_bonuses_are_given_once_per_kind_of_product(spark):
    rows = [(i, f"ALPHA SPIRIT PERRO POLLO {w}GR", "x") for i, w in enumerate([35, 99, 35, 50] * 5)]
    products = spark.createDataFrame(rows, "product_id long, title string, vendor string")
    catalog = spark.createDataFrame(
        [("dog-chicken-99gr", 1, "Dog Chicken", "x"), ("dog-chicken-35gr", 2, "Dog Chicken", "x")],
        "handle string, ord long, name string, vendor string")
    got = matching.match_blocked_bonus(products, catalog, PROFILES["alpha_spirit"], "nobody")
    assert "windowspecdefinition(qid" in _plan(got) and "windowspecdefinition(product_id" not in _plan(got)
    want = {35: "dog-chicken-35gr", 99: "dog-chicken-99gr", 50: "dog-chicken-99gr"}
    assert {r["product_id"]: r["handle"] for r in got.collect()} == {i: want[[35, 99, 35, 50][i % 4]] for i in range(20)}
