"""Ranks under any writer setting; the weight bonus of an only candidate; the gate per product."""

from pyspark.sql import functions as F

from vitrina.lexicon import PROFILES
from vitrina.operators import filters, hits, matching


def test_ranks_with_many_files_per_range(spark):
    rows = spark.range(6000).select((F.col("id") % 3).alias("key"), F.pmod(F.col("id") * 7919, F.lit(6007)).alias("at"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "200")
    try:
        got = filters.rank_within(rows, ["key"], ["at"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    for key in range(3):
        own = sorted((r["at"], r["rank"]) for r in got if r["key"] == key)
        assert [rank for _, rank in own] == list(range(1, 2001))


def _bonus(spark, entries):
    products = spark.createDataFrame([(1, "ALPHA SPIRIT PERRO POLLO 35GR", "x")], "product_id long, title string, vendor string")
    catalog = spark.createDataFrame(entries, "handle string, ord long, name string, vendor string")
    return matching.match_blocked_bonus(products, catalog, PROFILES["alpha_spirit"], "nobody").collect()


def test_an_only_candidate_gets_no_weight_bonus(spark):
    one = ("dog-chicken-35gr", 1, "Dog Chicken", "x")
    alone = _bonus(spark, [one])[0]["score"]
    twice = _bonus(spark, [one, ("dog-chicken-99gr", 2, "Dog Chicken", "x")])[0]
    assert twice["handle"] == "dog-chicken-35gr"
    assert abs(twice["score"] - min(1.0, alone + 0.005)) < 1e-9


def test_the_gate_holds_for_products_with_a_photo_only(spark):
    rows = [
        (1, 1, "u1", "", "", 0.15, True, 0.1), (1, 2, "u2", "", "", 0.12, True, 0.9),
        (2, 1, "u1", "", "", 0.15, False, None), (2, 2, "u2", "", "", 0.30, False, None),
        (3, 1, "u1", "dog", "cat", 0.90, False, None), (4, 1, "u1", "", "", 0.90, True, None),
    ]
    frame = spark.createDataFrame(
        rows, "product_id long, rank long, url string, title_species string, cand_species string, score double, gated boolean, img double")
    got = {r["product_id"]: r["url"] for r in hits.first_confirmed(frame, 0.22, 0.2, 0.10).collect()}
    assert got == {1: "u2", 2: "u2"}
