"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.  No stage can be expressed in SQL as a whole (a fitted model, an exact
tokenizer), so there is no SQL for the pipeline; its tests hold each stage against a plain
Python version.

Edge cases: null texts are no toxic documents, no near duplicates, have no personal data
and no words, and so leave with the mix, which takes words; rows without id and rows that
share an id are documents of their own in every stage; empty tables pass as empty tables; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import jaccard_join, mixing, packing, pseudonyms, toxicity
from vitrina.llm.common import cut_lineage, fresh, passing_tables, read, ship, without
from vitrina.llm.encoding import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go."""
    ship(spark)
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: that of
    the smallest id, nulls last.

    Rows are told apart by a key of their own, written once with them, as ids may be null or repeated.
    What the comparison has written is deleted once the rows that go are known.
    """
    ship(spark)
    row = fresh(docs, "near_row")
    keyed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    nodes = keyed.select(F.col(row).alias("doc_id"), "text")
    with passing_tables(spark):
        groups = cut_lineage(jaccard_join.near_duplicates(nodes, words=5, percent=80).select(F.col("doc_id").alias(row), "component_id"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("first")
        stays = groups.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
        gone = cut_lineage(groups.select(row).join(stays, row, "left_anti"), stays=True)
    return without(keyed, row, gone).drop(row)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; ``n_chars`` follows the text."""
    out = pseudonyms.pseudonymise(docs, key="corpus-key")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for; the last repetition may end early."""
    out = mixing.mix_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: pieces with their place and ids.

    Executors still hold what the stages before have touched, so encoders remember less here and see less at once.
    """
    ship(spark)
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), remembered=60_000, slice_bytes=1 << 19)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
