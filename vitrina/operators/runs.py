"""Whole runs: the operators put together the way the shop's jobs use them.

Each function takes tables and returns plan tables; nothing is written to a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import predicates as P
from vitrina.operators import cascade, images, matching, provenance, reports
from vitrina.session import cut_lineage


def resolve_products(products: DataFrame, catalog: DataFrame, profile: lx.MatcherProfile, key: Column,
                     cache: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Source URL, cache, barcode, text: ``product_id, handle, url, score, method``.

    ``products``: ``product_id, title, barcode``; ``catalog``: ``handle, ord, name, url,
    barcodes, skus``; ``cache``: ``title_key, url``; ``overrides``: ``product_id, url``
    already stored.  The text stage sees only products no exact stage resolved.
    The catalogue and what the exact stages find are written once, as several steps read them.
    """
    catalog = cut_lineage(catalog)
    stages: list[tuple[str, DataFrame]] = []
    if overrides is not None:
        known = products.select("product_id").join(overrides.select("product_id", "url"), "product_id")
        stages.append(("override", known.withColumn("score", F.lit(1.0))))
    stages.append(("cache", cascade.match_title_key(products, cache, key)))
    stages.append(("barcode", cascade.match_barcode(products, catalog)))
    stages = [(method, cut_lineage(found)) for method, found in stages]
    still_open = cascade.unresolved(products, *[df for _, df in stages])
    stages.append(("text", matching.match_best(still_open, catalog, profile)))
    out = cascade.cascade(products, stages, lx.RESOLUTION_FLOOR)
    urls = catalog.select("handle", F.col("url").alias("entry_url"))
    return out.join(urls, "handle", "left").select(
        "product_id", "handle", F.coalesce("url", "entry_url", F.lit("")).alias("url"), "score", "method"
    )


def url_changes(products: DataFrame, resolution: DataFrame, metafields: DataFrame, url_key: str,
                clear_on_no_match: bool) -> DataFrame:
    """What a resolution run writes: ``product_id, action, url, note``.

    ``set`` when a URL was found that differs from the stored one, ``keep`` when it is the
    same, ``clear`` when nothing was found, something is stored and clearing is on, else
    ``none``.
    """
    stored = metafields.where(F.col("url_key") == url_key).select("product_id", F.col("url").alias("stored"))
    joined = products.select("product_id").join(resolution, "product_id", "left").join(stored, "product_id", "left")
    found, had = F.coalesce("url", F.lit("")), F.coalesce("stored", F.lit(""))
    action = (
        F.when((found != "") & (found != had), "set").when(found != "", "keep")
        .when((had != "") & F.lit(clear_on_no_match), "clear").otherwise("none")
    )
    return joined.select(
        "product_id", action.alias("action"), found.alias("url"),
        F.concat(F.lit("score="), F.format_number(F.coalesce("score", F.lit(0.0)), 2)).alias("note"),
    )


def image_run(products: DataFrame, matched: DataFrame, candidates: DataFrame, existing: DataFrame,
              min_dim: int = 800) -> dict[str, DataFrame]:
    """Images of a run: sources combined, small ones dropped, near-duplicates removed, layout planned.

    ``products``: ``product_id, title, slug``; ``matched``: ``product_id``; ``candidates``:
    ``product_id, source, ord, url, width, height, hash, nbytes, white_ratio, bbox_w, bbox_h``;
    ``existing``: ``product_id, image_id, position, alt``.  Returns ``chosen`` (pictures with
    their final position and layout), ``plan`` (deletes and uploads) and ``outcome`` (status
    per product).
    """
    used = cascade.combine_image_sources(candidates)
    large = used.where(P.high_res(F.col("width"), F.col("height"), min_dim))
    rank = {"override": 0, "match": 1, "marketplace": 2, "generic": 3}
    source_rank = F.element_at(F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    # One integer that orders a product's pictures by source, then by order within it.
    numbered = large.withColumn("idx", source_rank.cast("bigint") * F.lit(1 << 60) + F.col("ord"))
    kept = images.dedupe_images(
        numbered.select("product_id", "idx", "hash", "nbytes", (F.col("width") * F.col("height")).alias("area"))
    )
    pictures = kept.select("product_id", "slot", F.col("kept_idx").alias("idx"), "members").join(
        numbered, ["product_id", "idx"]
    )
    positioned = images.gallery_positions(pictures.withColumn("ord", F.col("slot")))
    layout = images.plan_layout(
        positioned.select(
            F.struct("product_id", "position").alias("image_id"), "width", "height", "white_ratio", "bbox_w", "bbox_h",
            F.lit(None).cast("boolean").alias("force_padding"),
        )
    ).select("image_id.*", "decision", "use_padding", "new_w", "new_h")
    chosen = positioned.select("product_id", "position", "url", "source", "members").join(layout, ["product_id", "position"])
    plan = provenance.replacement_plan(chosen.select("product_id", "position"), existing, products)
    n_large = large.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_large"))
    n_kept = kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_kept"))
    hit = matched.select("product_id").distinct().withColumn("hit", F.lit(True))
    zero = F.lit(0).cast("bigint")
    outcome = (
        products.select("product_id").join(hit, "product_id", "left").join(n_large, "product_id", "left")
        .join(n_kept, "product_id", "left")
        .select(
            "product_id",
            reports.status_column(F.coalesce("n_large", zero), F.coalesce("n_kept", zero), F.coalesce("hit", F.lit(False)))
            .alias("status"),
            F.coalesce("n_kept", zero).alias("n_images"),
        )
    )
    return {"chosen": chosen, "plan": plan, "outcome": outcome}


def backup_run(products: DataFrame, processed: DataFrame, backup: DataFrame) -> DataFrame:
    """Re-processing from the backup: ``product_id, status, n_images``.

    Processed products are skipped, products without backed-up images are reported.
    """
    n = backup.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_images"))
    done = processed.select("product_id").distinct().withColumn("done", F.lit(True))
    joined = products.select("product_id").join(done, "product_id", "left").join(n, "product_id", "left")
    return joined.select(
        "product_id",
        F.when(F.col("done"), "saltados").when(F.col("n_images").isNull(), "sin_backup").otherwise("ok").alias("status"),
        F.coalesce("n_images", F.lit(0).cast("bigint")).alias("n_images"),
    )
