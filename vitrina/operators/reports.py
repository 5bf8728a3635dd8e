"""Counters, audits and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions import text as T
from vitrina.functions import urls as U


def run_statistics(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """``status, n`` of a run."""
    return outcomes.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def audit(products: DataFrame, matches: DataFrame, threshold: float, excluded: DataFrame | None = None) -> DataFrame:
    """``product_id, handle, score, state``: OK, REVISAR, SIN_MATCH or EXCLUIDO.

    ``matches``: ``product_id, handle, score``; the score is compared after rounding
    to two places.
    """
    joined = products.select("product_id").join(matches, "product_id", "left")
    skip = F.lit(False)
    if excluded is not None:
        joined = joined.join(excluded.select("product_id").distinct().withColumn("skip", F.lit(True)), "product_id", "left")
        skip = F.coalesce("skip", F.lit(False))
    shown = F.round("score", 2)
    state = (
        F.when(skip, "EXCLUIDO").when(F.col("handle").isNull(), "SIN_MATCH")
        .when(shown >= threshold, "OK").otherwise("REVISAR")
    )
    return joined.select(
        "product_id", F.when(skip, None).otherwise(F.col("handle")).alias("handle"),
        F.when(skip, None).otherwise(shown).alias("score"), state.alias("state"),
    )


def score_bands(products: DataFrame, matches: DataFrame, high: float = 0.25) -> DataFrame:
    """Counts of products by score band: ``band, n``."""
    band = F.when(F.col("score").isNull(), "none").when(F.col("score") >= high, "high").otherwise("low")
    return (
        products.select("product_id").join(matches.select("product_id", "score"), "product_id", "left")
        .groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    )


def product_state(products: DataFrame, variants: DataFrame, images: DataFrame) -> DataFrame:
    """``product_id, n_variants, option_name, option_values, n_images, kind, base_title``."""
    v = variants.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.expr("listagg(option1, '|') within group (order by ord, variant_id)").alias("option_values"),
    )
    i = images.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_images"))
    zero = F.lit(0).cast("bigint")
    return products.join(v, "product_id", "left").join(i, "product_id", "left").select(
        "product_id", F.coalesce("n_variants", zero).alias("n_variants"), "option_name",
        F.coalesce("option_values", F.lit("")).alias("option_values"), F.coalesce("n_images", zero).alias("n_images"),
        F.when(F.coalesce("n_variants", zero) > 1, "multi").otherwise("single").alias("kind"),
        T.base_title(F.col("title")).alias("base_title"),
    )


def vendors_containing(products: DataFrame, word: str) -> DataFrame:
    """``vendor, n_products`` of vendors whose name contains ``word``."""
    return products.where(F.lower("vendor").contains(word.lower())).groupBy("vendor").agg(
        F.count(F.lit(1)).alias("n_products")
    )


def snapshot_coverage(snap: DataFrame) -> DataFrame:
    """One row: products, with first URL, with second URL."""
    return snap.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("url_fabricante") != "").alias("with_url"),
        F.count_if(F.col("url_fabricante_2") != "").alias("with_url_2"),
    )


def catalog_coverage(entries: DataFrame) -> DataFrame:
    """``source, entries, images, without_images``; ``entries``: ``source, handle, images array``."""
    n = F.coalesce(F.size("images"), F.lit(0))
    return entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(n).cast("bigint").alias("images"),
        F.count_if(n <= 0).alias("without_images"),
    )


def checklist(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Printable checklist: ``product_id, line_no, line``.

    A product line, then one line per variant (labelled when there are several).
    """
    counts = variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    title = products.select(
        "product_id", F.lit(0).alias("line_no"),
        F.format_string("- [ ] **%s** `ID: %d`", F.col("title"), F.col("product_id")).alias("line"),
    )
    price = F.coalesce(F.col("price").cast("string"), F.lit(""))
    plain = F.concat(F.lit("EAN: `"), F.coalesce("barcode", F.lit("")), F.lit("` | "), price, F.lit("€"))
    line = F.when(F.col("n") > 1, F.concat(F.lit("  - Variante: **"), F.col("option1"), F.lit("** | "), plain)).otherwise(
        F.concat(F.lit("  - "), plain)
    )
    rows = variants.join(counts, "product_id").join(products.select("product_id"), "product_id", "left_semi").select(
        "product_id", F.col("ord").cast("int").alias("line_no"), line.alias("line")
    )
    return title.unionByName(rows)


def checklist_totals(products: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: ``products, variants``."""
    p = products.agg(F.count(F.lit(1)).alias("products"))
    n = variants.join(products.select("product_id"), "product_id", "left_semi").agg(F.count(F.lit(1)).alias("variants"))
    return p.withColumn("variants", n.scalar())


def no_match_list(products: DataFrame, resolved: DataFrame, shop_domain: str) -> DataFrame:
    """Products without a URL, with their admin link: ``product_id, title, link``."""
    return products.join(resolved.select("product_id"), "product_id", "left_anti").select(
        "product_id", "title", U.admin_link(F.col("product_id"), shop_domain).alias("link")
    )


def status_column(n_images: Column, n_usable: Column, matched: Column) -> Column:
    """Outcome of one product in an image run."""
    return (
        F.when(~matched, "sin_match").when(n_images == 0, "sin_imagen").when(n_usable == 0, "errores").otherwise("ok")
    )
