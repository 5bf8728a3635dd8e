"""Copies of a text: what follows from the text is worked out a bounded number of times."""

import os

import pytest
from pyspark.sql import functions as F

from vitrina.plans import QUERIES

from conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@tables
def test_profile_tokens_are_made_per_text(spark, tmp_path):
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    one = part.limit(1).drop("p_partkey").crossJoin(spark.range(500).select(F.col("id").cast(part.schema["p_partkey"].dataType).alias("p_partkey")))
    one.select(*part.columns).write.parquet(f"{tmp_path}/part.parquet")
    for t in os.listdir(FOLDER):
        if t != "part.parquet":
            os.symlink(f"{FOLDER}/{t}", f"{tmp_path}/{t}")
    df = QUERIES["t31_profile_tokens"](spark, str(tmp_path))
    rows = df.collect()
    assert len({(r["product_id"], r["profile"]) for r in rows}) == len(rows) == 500 * len({r["profile"] for r in rows})
    assert len({(r["profile"], r["title_tokens"], r["entry_tokens"]) for r in rows}) == len({r["profile"] for r in rows})
    # Tokens stand above the grouping by text.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan and "array_except" not in plan.partition("Aggregate")[2] and "Aggregate" in plan
