"""Where a product's URL came from and how it changed.

``metafields``: ``product_id, url_key, url``.  ``writes``: ``product_id, seq bigint,
url, fecha, workflow, resultado``; ``seq`` is unique per product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina import schemas
from vitrina.functions import urls as U

URL_KEYS = ("url_fabricante", "url_fabricante_2")

#: Width of the sequence buckets in which a product's history is ordered.
SEQ_BUCKET = 1 << 16


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _url(key: str) -> Column:
    return F.max(F.when(F.col("url_key") == key, F.nullif("url", F.lit(""))))


def source_urls(metafields: DataFrame) -> DataFrame:
    """``product_id, urls array``: non-empty, distinct, in key order."""
    wide = metafields.groupBy("product_id").agg(*[_url(k).alias(k) for k in URL_KEYS])
    return wide.select("product_id", F.array_distinct(F.array_compact(F.array(*URL_KEYS))).alias("urls"))


def last_of_history(history: DataFrame) -> DataFrame:
    """``product_id, last_url, n_entries`` of stored JSON histories.

    ``history``: ``product_id, history_json``; anything that is not a JSON array of
    entries counts as an empty history.
    """
    parsed = F.coalesce(
        F.from_json("history_json", schemas.URL_HISTORY), F.array().cast(schemas.URL_HISTORY)
    )
    return history.select("product_id", parsed.alias("h")).select(
        "product_id", F.try_element_at("h", F.lit(-1))["url"].alias("last_url"), F.size("h").cast("bigint").alias("n_entries")
    )


def history_changes(writes: DataFrame, last: DataFrame | None = None, bucket: int = SEQ_BUCKET) -> DataFrame:
    """The writes that are appended to the history: those whose URL differs from the one before.

    ``last``: ``product_id, last_url`` already stored.  A product's writes are ordered
    inside buckets of its sequence and the buckets are chained by their last URL, so
    no task has to sort one busy product as a whole.  Empty URLs are not written.
    """
    w = writes.where(~_missing(F.col("url"))).withColumn("bucket", F.floor(F.col("seq") / bucket))
    inside = Window.partitionBy("product_id", "bucket").orderBy("seq")
    buckets = w.groupBy("product_id", "bucket").agg(F.max(F.struct("seq", "url")).alias("l"))
    before = buckets.select(
        "product_id", "bucket",
        F.lag("l.url").over(Window.partitionBy("product_id").orderBy("bucket")).alias("carried"),
    )
    if last is not None:
        before = before.join(last.select("product_id", "last_url"), "product_id", "left").withColumn(
            "carried", F.coalesce("carried", "last_url")
        ).drop("last_url")
    chained = w.withColumn("prev", F.lag("url").over(inside)).join(before, ["product_id", "bucket"])
    previous = F.coalesce("prev", "carried")
    return chained.where(previous.isNull() | (previous != F.col("url"))).drop("bucket", "prev", "carried")


def current_urls(writes: DataFrame) -> DataFrame:
    """Value after all writes: ``product_id, url_key, url`` (the latest non-empty)."""
    return (
        writes.where(~_missing(F.col("url")))
        .groupBy("product_id", "url_key")
        .agg(F.max(F.struct("seq", "url")).alias("w"))
        .select("product_id", "url_key", "w.url")
    )


def to_clear(metafields: DataFrame, resolved: DataFrame, url_key: str = URL_KEYS[0]) -> DataFrame:
    """Stored URLs of products this run could not resolve: ``product_id, url_key, url``."""
    return metafields.where((F.col("url_key") == url_key) & ~_missing(F.col("url"))).join(
        resolved.select("product_id"), "product_id", "left_anti"
    ).select("product_id", "url_key", "url")


def backfill(products: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """URLs already resolved in a cache: ``product_id, title_key, url, saved``."""
    usable = cache.where(~_missing(F.col("url"))).select("title_key", "url")
    return products.select("product_id", key.alias("title_key")).join(usable, "title_key", "left").select(
        "product_id", "title_key", F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNotNull().alias("saved")
    )


def snapshot(products: DataFrame, metafields: DataFrame) -> DataFrame:
    """``product_id, title, url_fabricante, url_fabricante_2`` (missing = empty)."""
    wide = metafields.groupBy("product_id").agg(*[_url(k).alias(k) for k in URL_KEYS])
    return products.select("product_id", "title").join(wide, "product_id", "left").select(
        "product_id", "title", *[F.coalesce(k, F.lit("")).alias(k) for k in URL_KEYS]
    )


def compare_with_snapshot(dry_run: DataFrame, snap: DataFrame, url_key: str = URL_KEYS[0]) -> DataFrame:
    """Dry-run results against verified URLs: ``product_id, want, got, category``."""
    joined = dry_run.select("product_id", F.col("url").alias("got")).join(
        snap.select("product_id", F.col(url_key).alias("want")), "product_id", "left"
    )
    want, got = U.norm_url(F.col("want")), U.norm_url(F.col("got"))
    category = (
        F.when((want != "") & (got != ""), F.when(want == got, "equal").otherwise("different"))
        .when(want != "", "would_delete")
        .when(got != "", "adds")
        .otherwise("both_empty")
    )
    return joined.select("product_id", want.alias("want"), got.alias("got"), category.alias("category"))


def precision(compared: DataFrame) -> DataFrame:
    """Counters of a comparison; precision is an integer percentage of the base."""
    n = lambda c: F.count_if(F.col("category") == c)
    base = F.count_if(F.col("want") != "")
    return compared.agg(
        base.alias("base"), n("equal").alias("equal"), n("different").alias("different"),
        n("would_delete").alias("would_delete"), n("adds").alias("adds"), n("both_empty").alias("both_empty"),
    ).withColumn("precision", F.when(F.col("base") > 0, F.expr("equal * 100 div base")))


def seed_cache(cache: DataFrame, snap: DataFrame, key: Column, url_key: str = URL_KEYS[1]) -> DataFrame:
    """Cache after seeding with verified URLs: ``title_key, url, source``.

    A filled URL sets its key (the last title of a key wins), an empty one removes
    it, keys not in the snapshot stay.
    """
    verified = (
        snap.select(key.alias("title_key"), "product_id", F.col(url_key).alias("verified"))
        .groupBy("title_key")
        .agg(F.max(F.struct("product_id", "verified")).alias("w"))
        .select("title_key", "w.verified")
    )
    merged = cache.select("title_key", "url", "source").join(
        verified.withColumn("seen", F.lit(True)), "title_key", "full"
    )
    return merged.select(
        "title_key",
        F.when(F.col("seen"), F.col("verified")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("seen"), F.lit("shopify_manual")).otherwise(F.col("source")).alias("source"),
    ).where(~_missing(F.col("url")))


def pending(products: DataFrame, processed: DataFrame) -> DataFrame:
    """Products not in the processed registry."""
    return products.join(processed.select("product_id"), "product_id", "left_anti")


def extend_registry(processed: DataFrame, done: DataFrame) -> DataFrame:
    """Registry after a run (each id once)."""
    return processed.select("product_id").unionByName(done.select("product_id")).distinct()


def cached_lookups(codes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive-only cache: ``(served, retry)``.

    ``cache``: ``ean, url, images, found, fecha``.  Only found entries are served;
    everything else is looked up again.
    """
    positive = cache.where("found")
    served = codes.join(positive, "ean")
    return served, codes.join(positive.select("ean"), "ean", "left_anti")


def merge_lookups(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after new look-ups: the new result of a code replaces the old."""
    columns = cache.columns
    return cache.join(fresh.select("ean"), "ean", "left_anti").select(*columns).unionByName(fresh.select(*columns))


def backup_plan(products: DataFrame, images: DataFrame, backed_up: DataFrame, force: bool = False) -> DataFrame:
    """``product_id, n_images, action``: new, exists, forced or no_images."""
    counts = images.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_images"))
    have = backed_up.select("product_id").distinct().withColumn("have", F.lit(True))
    joined = products.select("product_id").join(counts, "product_id", "left").join(have, "product_id", "left")
    return joined.select(
        "product_id", F.coalesce("n_images", F.lit(0)).alias("n_images"),
        F.when(F.col("n_images").isNull(), "no_images")
        .when(F.col("have"), "forced" if force else "exists").otherwise("new").alias("action"),
    )


def replacement_plan(processed: DataFrame, existing: DataFrame, products: DataFrame, keep_alt: bool = True) -> DataFrame:
    """Image replacement: every existing image is deleted, every processed one uploaded.

    ``processed``: ``product_id, position``; ``existing``: ``product_id, image_id,
    position, alt``; ``products``: ``product_id, title, slug``.  The alt text is the one
    of the old image at that position, else the title (always the title with
    ``keep_alt=False``).  Products without processed images are left alone.
    """
    todo = products.join(processed.select("product_id"), "product_id", "left_semi")
    old_alt = existing.groupBy("product_id", "position").agg(F.max_by("alt", "image_id").alias("old_alt"))
    uploads = processed.join(todo, "product_id").join(old_alt, ["product_id", "position"], "left").select(
        "product_id", F.lit("upload").alias("op"), F.lit(None).cast("bigint").alias("image_id"), "position",
        U.output_image_name(F.col("slug"), F.col("position")).alias("filename"),
        (F.coalesce(F.nullif("old_alt", F.lit("")), F.col("title")) if keep_alt else F.col("title")).alias("alt"),
    )
    removals = existing.join(todo.select("product_id"), "product_id", "left_semi").select(
        "product_id", F.lit("delete").alias("op"), "image_id", "position",
        F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("alt"),
    )
    return removals.unionByName(uploads)


def choose_source(products: DataFrame, backup: DataFrame, live: DataFrame) -> DataFrame:
    """Per (product, position): the backed-up original, else the live image."""
    b = backup.select("product_id", "position", F.struct(F.lit("backup").alias("origin"), F.col("path").alias("location")).alias("b"))
    lv = live.select("product_id", "position", F.struct(F.lit("live").alias("origin"), F.col("src").alias("location")).alias("l"))
    both = b.join(lv, ["product_id", "position"], "full")
    return both.join(products.select("product_id"), "product_id", "left_semi").withColumn(
        "s", F.coalesce("b", "l")
    ).select("product_id", "position", "s.origin", "s.location")
