"""Exact joins, the staged resolution cascade and catalogue assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions import text as T


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def match_barcode(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact code join: ``product_id, handle, score`` (1.0).

    ``catalog``: ``handle, ord, barcodes array, skus array``.  The first entry that
    carries the code wins; products without a barcode match nothing.
    """
    codes = (
        catalog.select("handle", "ord", F.explode(F.array_union("barcodes", "skus")).alias("code"))
        .where(~_missing(F.col("code")))
        .groupBy("code")
        .agg(F.min(F.struct("ord", "handle")).alias("first"))
        .select("code", "first.handle")
    )
    return (
        products.where(~_missing(F.col("barcode")))
        .select("product_id", F.col("barcode").alias("code"))
        .join(codes, "code")
        .select("product_id", "handle", F.lit(1.0).alias("score"))
    )


def match_title_key(products: DataFrame, cache: DataFrame, key: Column, require_url: bool = True) -> DataFrame:
    """Resolution-cache join by title key: ``product_id, title_key, url, score``.

    ``cache``: ``title_key, url``, one row per key.  An entry without URL is no hit
    unless ``require_url`` is off.
    """
    usable = cache.where(~_missing(F.col("url"))) if require_url else cache
    # A key that cannot be null spares the join a null test that would compute it twice.
    return (
        products.select("product_id", F.coalesce(key, F.lit("")).alias("title_key"))
        .join(usable.select("title_key", "url"), "title_key")
        .withColumn("score", F.lit(1.0))
    )


def match_override(products: DataFrame, overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manual overrides whose handle exists in the catalogue: ``product_id, handle, score``.

    An override naming an unknown handle is not applied; the product falls
    through to the next stage.
    """
    known = catalog.select("handle").distinct()
    return (
        products.select("product_id").join(overrides.select("product_id", "handle"), "product_id")
        .join(known, "handle", "left_semi")
        .select("product_id", "handle", F.lit(1.0).alias("score"))
    )


def match_slug(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """First slug candidate present in the catalogue: ``product_id, slug, score``.

    ``candidates``: ``product_id, slugs array<string>`` in order of preference.
    """
    return (
        candidates.select("product_id", F.posexplode("slugs").alias("pos", "slug"))
        .join(catalog.select(F.col("handle").alias("slug")).distinct(), "slug")
        .groupBy("product_id")
        .agg(F.min(F.struct("pos", "slug")).alias("w"))
        .select("product_id", "w.slug", F.lit(1.0).alias("score"))
    )


def alias_entries(resolved: DataFrame) -> DataFrame:
    """Cache rows for every alias of a resolved product.

    ``resolved``: ``slugs array<string>, slug, url``; returns ``slug, url`` distinct,
    the resolving slug included.
    """
    return resolved.select(
        F.explode(F.array_union(F.array("slug"), "slugs")).alias("slug"), "url"
    ).distinct()


def cascade(products: DataFrame, stages: Sequence[tuple[str, DataFrame]], floor: float | None = None) -> DataFrame:
    """First stage that resolves a product decides.

    Each stage is ``(method, product_id, handle?, url?, score)``; missing columns are
    null.  The result is a function of ``product_id``: ``product_id, handle, url,
    score, method``; unresolved products have ``method = 'none'`` and score 0.

    Stages are united with their rank and reduced by the product in one shuffle.
    A stage that is expensive should be given only the products earlier stages left
    open (:func:`unresolved`).
    """
    parts = []
    for rank, (method, df) in enumerate(stages):
        handle = F.col("handle") if "handle" in df.columns else F.lit(None).cast("string")
        url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
        part = df.select(
            "product_id", F.lit(rank).alias("rank"), handle.alias("handle"), url.alias("url"), "score",
            F.lit(method).alias("method"),
        )
        parts.append(part if floor is None else part.where(F.col("score") >= floor))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    best = (
        everything.groupBy("product_id")
        .agg(F.min(F.struct("rank", "handle", "url", "score", "method")).alias("w"))
        .select("product_id", "w.handle", "w.url", "w.score", "w.method")
    )
    return products.select("product_id").join(best, "product_id", "left").select(
        "product_id", "handle", "url",
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("method", F.lit("none")).alias("method"),
    )


def unresolved(products: DataFrame, *resolved: DataFrame) -> DataFrame:
    """Products none of the earlier stages resolved."""
    out = products
    for r in resolved:
        out = out.join(r.select("product_id"), "product_id", "left_anti")
    return out


def once_per_key(products: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Split for many-to-one resolution.

    Returns ``(representatives, membership)``: the first product of each key with
    its title, and ``product_id, key`` for all.  Resolve the representatives, then
    :func:`propagate`.
    """
    keyed = products.withColumn("key", key)
    reps = (
        keyed.groupBy("key")
        .agg(F.min(F.struct("product_id", "title")).alias("r"))
        .select("key", "r.product_id", "r.title")
    )
    return reps, keyed.select("product_id", "key")


def propagate(reps: DataFrame, membership: DataFrame, resolution: DataFrame) -> DataFrame:
    """Copy each representative's outcome, negative ones too, to its whole key."""
    outcome = reps.select("key", "product_id").join(resolution, "product_id", "left").drop("product_id")
    return membership.join(outcome, "key").drop("key")


def union_catalogs(catalogs: DataFrame) -> DataFrame:
    """First handle wins over sources: ``catalogs`` has ``handle, prio, ord`` and more.

    The smallest ``(prio, ord)`` of each handle is kept, all columns with it.
    """
    rest = [c for c in catalogs.columns if c not in ("handle", "prio", "ord")]
    return (
        catalogs.groupBy("handle")
        .agg(F.min(F.struct("prio", "ord", *rest)).alias("w"))
        .select("handle", "w.*")
    )


def new_per_source(united: DataFrame) -> DataFrame:
    """Entries each source contributed to the union."""
    return united.groupBy("source").agg(F.count(F.lit(1)).alias("new_entries"))


def combine_image_sources(images: DataFrame) -> DataFrame:
    """Which images of which source are used for a product.

    ``images``: ``product_id, source, ord, url`` with source ``override`` | ``match`` |
    ``marketplace`` | ``generic``.  Overrides exclude the match; the marketplace is
    added to either; the generic search is used only if nothing else gave any.
    Result keeps the order (source, ord).
    """
    source = F.col("source")
    product = Window.partitionBy("product_id")
    present = images.withColumns({
        "overridden": F.bool_or(source == "override").over(product), "specific": F.bool_or(source != "generic").over(product)})
    use = (
        F.when(source == "match", ~F.col("overridden"))
        .when(source == "generic", ~F.col("specific"))
        .otherwise(F.lit(True))
    )
    return present.where(F.col("product_id").isNotNull() & use).drop("overridden", "specific")


def cached_or_searched(cached: DataFrame, searched: DataFrame) -> DataFrame:
    """Marketplace images from the catalogue cache, else from the search.

    Both ``product_id, ord, url``; a product with cached rows ignores its search.
    """
    fresh = searched.join(cached.select("product_id").distinct(), "product_id", "left_anti")
    return cached.unionByName(fresh)


def title_keys(title: Column, profile: str) -> Column:
    """Title key of a profile (ordered, sorted or size-free form)."""
    from vitrina.lexicon import PROFILES

    if profile.startswith(("churu", "virbac")):
        return T.sorted_title_key(title, PROFILES[profile].stop)
    if profile == "farmina":
        return T.size_free_key(title)
    return T.title_key(title, units=profile.startswith("applaws"))
