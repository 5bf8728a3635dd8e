"""Scans, exclusion lists, ordering and caps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import cut_lineage


def by_vendor(products: DataFrame, vendor: str) -> DataFrame:
    return products.where(F.col("vendor") == vendor)


def by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products named in a table of ids."""
    return products.join(ids.select("product_id"), "product_id", "left_semi")


def parse_id_list(lists: DataFrame, column: str = "id_list") -> DataFrame:
    """Comma-separated id lists → ``product_id`` (blanks ignored, distinct)."""
    return (
        lists.select(F.explode(F.split(F.col(column), ",")).alias("s"))
        .select(F.expr("try_cast(trim(s) as bigint)").alias("product_id"))
        .where(F.col("product_id").isNotNull())
        .distinct()
    )


def title_contains(products: DataFrame, text: str) -> DataFrame:
    return products.where(F.lower("title").contains(text.lower()))


def without_images(products: DataFrame, images: DataFrame) -> DataFrame:
    return products.join(images.select("product_id"), "product_id", "left_anti")


def vendor_family(products: DataFrame, include: str, exclude: str) -> DataFrame:
    """Vendor contains ``include``; neither vendor nor title contains ``exclude``."""
    vendor, title = F.lower("vendor"), F.lower("title")
    return products.where(vendor.contains(include) & ~vendor.contains(exclude) & ~title.contains(exclude))


def excluding(products: DataFrame, skip: DataFrame) -> DataFrame:
    return products.join(skip.select("product_id"), "product_id", "left_anti")


def real_catalog(entries: DataFrame, url_contains: str | None = None) -> DataFrame:
    """Entries that are catalogue, not cached resolutions: they have a handle field (or
    their URL contains a marker)."""
    if url_contains is not None:
        return entries.where(F.coalesce("url", F.lit("")).contains(url_contains))
    return entries.where(F.coalesce("handle", F.lit("")) != "")


def first_occurrence(rows: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """First row of each key by ``order`` (a reduction, not a sort of the group)."""
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("w"))
        .select(*keys, *[F.col(f"w.{c}").alias(c) for c in (*order, *rest)])
    )


def leading(rows: DataFrame, keys: Iterable[str], order: Iterable[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def rank_within(rows: DataFrame, keys: Iterable[str], order: Iterable[str], name: str = "rank") -> DataFrame:
    """1-based rank of every row inside its key, without sorting a whole key in one task.

    Rows are range-partitioned by ``(keys, order)`` and written with the number of their
    range, so a busy key spans many ranges, in as many files as the writer likes; the rank is the number of rows in
    the key's earlier ranges plus the place inside the range.  ``order`` must be unique
    inside a key for the rank to be.
    """
    keys, order = list(keys), list(order)
    placed = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))
    chunks = placed.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        placed.withColumn("_inside", inside).join(before, [*keys, "_chunk"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("int"))
        .drop("_chunk", "_inside", "_before")
    )


def image_at(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Image at a requested position: exact position, else the n-th by sorted position.

    ``requests``: ``product_id, position``; ``images``: ``product_id, image_id,
    position``.  Returns ``product_id, position, image_id, how``.
    """
    exact = images.groupBy("product_id", "position").agg(F.min("image_id").alias("exact_id"))
    ordered = images.select("product_id", F.coalesce("position", F.lit(999)).alias("at"), F.col("image_id").alias("nth_id"))
    nth = rank_within(ordered, ["product_id"], ["at", "nth_id"], "position").drop("at")
    return (
        requests.join(exact, ["product_id", "position"], "left")
        .join(nth, ["product_id", "position"], "left")
        .select(
            "product_id", "position", F.coalesce("exact_id", "nth_id").alias("image_id"),
            F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("nth_id").isNotNull(), "nth")
            .otherwise("missing").alias("how"),
        )
    )


def by_position(images: DataFrame, default: int = 999) -> DataFrame:
    """Images with their effective position (missing sorts as ``default``)."""
    return images.withColumn("sort_position", F.coalesce("position", F.lit(default)))


def compare_sets(expected: Column, actual: Column) -> Column:
    """``struct<common, missing, extra>`` of two string arrays, sorted."""
    return F.struct(
        F.array_sort(F.array_intersect(expected, actual)).alias("common"),
        F.array_sort(F.array_except(expected, actual)).alias("missing"),
        F.array_sort(F.array_except(actual, expected)).alias("extra"),
    )
