"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget by its weight.  A source whose share exceeds
``max_epochs`` times its size is clamped there and the excess goes to the others by
weight, again and again until no share exceeds its cap.  Of a source of size ``s`` and
target ``t`` every document is then repeated ``floor(t / s)`` times; the fraction left is
taken in an order drawn by a seeded hash, up to the word, so that the words taken of a
source are its rounded target.

DataFrame functions only.  Sizes are summed per source before the shuffle.  The order
within a source is never sorted whole: hash ranges of about ``range_rows`` documents are
summed first, and only the range in which the fraction ends is ranked.

Edge cases: a null text has size 0.  A null source is a source of its own and comes last;
the empty name is another.  Sources without words have target 0, and so has everything if
nothing has words.  Repeated rows are documents of their own; rows with the same id are
ordered by size, and equal rows are alike, so whichever is cut gives the same rows.  A null
id is hashed as the empty string.  ``mix_texts`` gives every row a key of its own, so rows
without id and rows that share one are taken as the mix says; texts are never shuffled for it
unless there are more than ``CUT_SOURCES`` sources.  An empty table gives an empty
result.  Columns of any other name pass through ``mix_texts`` and ``mixed_texts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import WORD, cut_lineage, fresh, word_count

WEIGHTS = (5, 2, 1)

#: Sources up to which the row that ends each source's fraction is broadcast.
CUT_SOURCES = 10_000


def water_level(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (``words``, ``weight``) rows: clamp, share out what is left, repeat.

    Two sums per round leave the executors.  A clamped source stays clamped, so rounds end;
    the table has a row per source and is read from storage each time.
    """
    cap = F.lit(max_epochs) * F.col("words")
    level: float | None = None
    budget = sources.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    full = F.lit(False)
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        now = (budget - row["capped"]) / row["weight"] if row["weight"] else None
        if now == level or now is None:
            break
        level = now
        full = cap < F.col("weight") * F.lit(level)
    share = cap.cast("double") if level is None else F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", share)


def source_order(sources: DataFrame) -> DataFrame:
    """Position of each source from 0, by code point, null last: ``position``.

    Ranges of sources are numbered apart and shifted by the counts of the ranges before,
    so no task sees all sources.
    """
    ranged = cut_lineage(
        sources.repartitionByRange(F.col("mix_source").asc_nulls_last())
        .withColumn("mix_range", F.spark_partition_id())
    )
    before = Window.orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("mix_range").agg(F.count("*").alias("n")).select(
        "mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_range").orderBy(F.col("mix_source").asc_nulls_last())
    return (
        ranged.withColumn("rank", F.row_number().over(inside)).join(offsets, "mix_range")
        .withColumn("position", F.col("offset") + F.col("rank") - 1).drop("mix_range", "rank", "offset")
    )


def _draw(seed: int) -> Column:
    """Seeded hash of a document's id: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7,
        range_rows: int = 1_000, key: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and how it is taken:
    ``epochs`` whole repetitions and the first ``extra`` words once more.

    Needs ``doc_id``, ``text`` and ``source``.  ``weights`` go round over the sources in order.
    ``key``: a column of ``docs`` that tells rows apart; it comes along and settles ties.
    """
    own = [key] if key else []
    sized = cut_lineage(docs.select(
        *own, "doc_id", F.col("source").alias("mix_source"), word_count().alias("size"), _draw(seed).alias("mix_draw")))
    return _mixed(sized, own, weights, max_epochs, range_rows).select(
        *own, "doc_id", "size", F.col("words").alias("source_size"), "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "epochs", "extra")


def _mixed(sized: DataFrame, own: list[str], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3,
           range_rows: int = 1_000) -> DataFrame:
    """``sized`` (``doc_id, mix_source, size, mix_draw`` and ``own``) with its source's ``words, target, epochs``, and ``extra``."""
    sums = cut_lineage(sized.groupBy("mix_source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    turn = F.col("position") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    sources = cut_lineage(source_order(sums).withColumn("weight", weight))
    targets = water_level(sources, max_epochs).select(
        "mix_source", "words", "target",
        F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0)).alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / range_rows)).alias("ranges"),
    ).withColumn("extra_words", F.greatest(
        F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("words")))
    same = sized["mix_source"].eqNullSafe(targets["mix_source"])
    # The hash range of a document grows with its hash, so ranges are taken in order too.
    upper = F.conv(F.substring("mix_draw", 1, 12), 16, 10).cast("long")
    drawn = cut_lineage(sized.join(targets, same).select(
        *own, "doc_id", sized["mix_source"].alias("mix_source"), "size", "mix_draw", "words", "target", "epochs", "extra_words",
        F.floor(upper * F.col("ranges").cast("double") / float(1 << 48)).alias("mix_range")))
    sums_before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        drawn.filter("extra_words > 0").groupBy("mix_source", "mix_range")
        .agg(F.sum("size").alias("here"), F.max("extra_words").alias("wanted"))
        .withColumn("before", F.coalesce(F.sum("here").over(sums_before), F.lit(0)))
    )
    # The range in which the fraction ends: one row per source at most.
    last = ranges.filter("before < wanted and before + here >= wanted").select(
        F.col("mix_source").alias("last_source"), F.col("mix_range").alias("last_range"), F.col("before").alias("last_before"))
    placed = drawn.join(last, drawn["mix_source"].eqNullSafe(last["last_source"]), "left").drop("last_source")
    whole = placed.filter("last_range is null or mix_range <> last_range").withColumn(
        "extra", F.when(F.col("mix_range") < F.col("last_range"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("mix_source").orderBy("mix_draw", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    ended = placed.filter("mix_range = last_range").withColumn(
        "extra", F.greatest(F.lit(0), F.least(
            F.col("size"),
            F.col("extra_words") - F.col("last_before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    return whole.unionByName(ended).select(
        *own, "doc_id", "mix_source", "mix_draw", "size", "words", "target", "epochs", F.col("extra").cast("long").alias("extra"))


def mixed_texts(docs: DataFrame, mixed: DataFrame, row: str = "doc_id") -> DataFrame:
    """The documents as often as the mix takes them; a last repetition may end after ``extra`` words.

    Documents without words are not taken.  The plan has a row per document, so it is merged, never broadcast.
    ``row`` names the column of both that tells rows apart, unique and not null; ``docs`` keeps its columns.
    """
    key, epochs, cut = (fresh(docs, f"mix_{c}") for c in ("id", "epochs", "cut"))
    plan = mixed.filter("size > 0").select(
        F.col(row).alias(key), F.col("epochs").cast("int").alias(epochs),
        F.when(F.col("extra") == F.col("size"), F.lit(-1)).otherwise(F.col("extra")).cast("long").alias(cut))
    return _repeated(docs.join(plan.hint("merge"), docs[row] == plan[key]), F.col(epochs), F.col(cut), docs.columns)


def _repeated(docs: DataFrame, epochs: Column, cut: Column, columns: list[str]) -> DataFrame:
    """Every document ``epochs`` times and once more up to ``cut`` words (all for -1, not at all for 0)."""
    words = fresh(docs, "mix_words")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), epochs),
        F.when(cut != 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    start = F.array_join(F.slice(
        F.regexp_extract_all("text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)")), F.lit(1), F.col(words).cast("int")), "")
    text = F.when(F.col(words) >= 0, start).otherwise(F.col("text")).alias("text")
    return docs.withColumn(words, F.explode(copies)).select(*(text if c == "text" else F.col(c) for c in columns))


def mix_texts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents as often as :func:`mix` takes them, row by row: ids may be null or repeated.

    Rows with their keys and sizes are written once, so that the plan and the texts see the same keys.  A source's last row
    that is taken once more tells of each of its rows how often it is taken, so a table of one row per source meets the texts.
    """
    row, size, draw = (fresh(docs, f"mix_{c}") for c in ("row", "size", "draw"))
    keyed = cut_lineage(docs.withColumns({row: F.monotonically_increasing_id(), size: word_count(), draw: _draw(seed)}))
    sized = keyed.select(
        row, "doc_id", F.col("source").alias("mix_source"), F.col(size).alias("size"), F.col(draw).alias("mix_draw"))
    mixed = cut_lineage(_mixed(sized, [row]))
    place = ("mix_draw", "doc_id", "size", row)
    cuts = cut_lineage(mixed.filter("size > 0").groupBy("mix_source").agg(
        F.max("epochs").cast("int").alias("epochs"),
        F.max(F.when(F.col("extra") > 0, F.struct(F.struct(*place).alias("place"), "extra"))).alias("last")))
    if cuts.count() > CUT_SOURCES:
        return mixed_texts(keyed.drop(size, draw), mixed, row).drop(row)
    cuts = cuts.select(F.struct("mix_source", "epochs", "last").alias(fresh(keyed, "mix_cut")))
    found = F.col(cuts.columns[0])
    placed = keyed.filter(F.col(size) > 0).join(F.broadcast(cuts), F.col("source").eqNullSafe(found["mix_source"]))
    here = F.struct(F.col(draw).alias("mix_draw"), "doc_id", F.col(size).alias("size"), row)
    last = found["last"]
    # A struct with a null in it compares by its fields, nulls first, as the order of the rows does.
    cut = (
        F.when(last.isNull() | (here > last["place"]), 0).when(here < last["place"], -1)
        .when(last["extra"] == F.col(size), -1).otherwise(last["extra"]).cast("long"))
    return _repeated(placed, found["epochs"], cut, docs.columns)
