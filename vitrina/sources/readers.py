"""Readers and writers: product dumps, catalogues, feeds, image backups, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina import schemas
from vitrina.functions import predicates as P
from vitrina.functions import urls as U


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- products ----------------------------------------------------------------

def read_products(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested product JSON, one row per product, declared schema."""
    return spark.read.schema(schemas.PRODUCTS).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def flatten_variants(products: DataFrame) -> DataFrame:
    """One row per product and variant (a product without variants keeps one row)."""
    return products.select(
        F.col("id").alias("product_id"), F.col("title").alias("product_title"), "vendor",
        F.posexplode_outer("variants").alias("ord", "v"),
    ).select(
        "product_id", "product_title", "vendor", "ord", F.col("v.id").alias("variant_id"), F.col("v.title").alias("title"),
        _text(F.col("v.sku")).alias("sku"), _text(F.col("v.barcode")).alias("barcode"), "v.weight", "v.weight_unit",
        F.col("v.price").try_cast("decimal(10,2)").alias("price"), "v.inventory_quantity", "v.option1", "v.option2",
        "v.option3",
    )


def flatten_images(products: DataFrame) -> DataFrame:
    """One row per product image."""
    return products.select(F.col("id").alias("product_id"), F.explode("images").alias("i")).select(
        "product_id", F.col("i.id").alias("image_id"), "i.src", "i.alt", "i.position", "i.width", "i.height"
    )


# --- catalogues --------------------------------------------------------------

def parse_catalog_map(texts: DataFrame, source: Column | str, column: str = "value") -> DataFrame:
    """``{handle: entry}`` JSON texts → rows with insertion order.

    Entries that are not objects (site markers and the like) are dropped.  ``entry_handle``
    is the entry's own ``handle`` field: null for cached resolutions.
    """
    src = F.lit(source) if isinstance(source, str) else source
    # Values are kept as text first: one non-object value must not void the document.
    raw = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    return (
        texts.select(src.alias("source_name"), F.posexplode(raw).alias("ord", "kv"))
        .where(F.ltrim("kv.value").startswith("{"))
        .select("source_name", "ord", F.col("kv.key").alias("handle"),
                F.from_json("kv.value", schemas.CATALOG_ENTRY).alias("e"))
        .select(
            "handle", F.col("ord").cast("bigint").alias("ord"), _text(F.col("e.name")).alias("name"),
            _text(F.col("e.url")).alias("url"), "e.images", F.coalesce("e.source", "source_name").alias("source"),
            _text(F.col("e.brand")).alias("brand"), "e.category", F.col("e.handle").alias("entry_handle"),
            F.coalesce("e.skus", F.array().cast("array<string>")).alias("skus"),
            F.coalesce("e.barcodes", F.array().cast("array<string>")).alias("barcodes"),
            _text(F.col("e.product_type")).alias("product_type"), "e.amazon_images", "e.img_feat",
        )
    )


def read_catalog_map(spark: SparkSession, path: str, source: str) -> DataFrame:
    return parse_catalog_map(spark.read.option("wholetext", True).text(path), source)


class StaleCatalog(ValueError):
    """The stored catalogue predates a required field and has to be rebuilt."""


def read_catalog_list(spark: SparkSession, path: str, schema: str = schemas.CATALOG_LIST_FEED,
                      required: Iterable[str] = ("image_urls",), multi_line: bool = True) -> DataFrame:
    """JSON array catalogue (one array per file, or one entry per line with
    ``multi_line=False``, which Spark can split); raises :class:`StaleCatalog` when a
    required field is absent from every entry."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    for name in required:
        if df.where(F.col(name).isNotNull()).isEmpty():
            raise StaleCatalog(f"{path}: no entry has {name!r}")
    return df


def fresh_catalog(entries: DataFrame, required: str = "image_urls") -> DataFrame:
    """Per stored catalogue: is its format current?  ``catalog_id, entries, fresh``."""
    return entries.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("entries"), (F.count(required) > 0).alias("fresh")
    )


def product_feed_to_catalog(pages: DataFrame, column: str = "body", profile: str = "applaws",
                            url_prefix: str = "") -> DataFrame:
    """Pages of a product feed (``{"products":[…]}``) → catalogue entries.

    Product images only, full size; SKUs and barcodes without blanks.  A page that is
    not such a document contributes nothing.
    """
    products = F.from_json(F.col(column), schemas.FEED_PAGE)["products"]
    empty = F.array().cast("array<string>")

    def filled(codes: Column) -> Column:
        return F.coalesce(
            F.transform(F.filter(codes, lambda x: _text(x) != ""), lambda x: F.trim(x)), empty
        )

    return (
        pages.select(F.explode(products).alias("p"))
        .where(_text(F.col("p.handle")) != "")
        .select(
            F.col("p.handle").alias("handle"), _text(F.col("p.title")).alias("name"), _text(F.col("p.vendor")).alias("vendor"),
            F.concat(F.lit(url_prefix), F.col("p.handle"), F.lit("/")).alias("url"),
            F.coalesce(
                F.transform(
                    F.filter("p.images.src", lambda s: (_text(s) != "") & P.keep_image_url(s, profile)),
                    lambda s: U.store_cdn_original(s),
                ),
                empty,
            ).alias("images"),
            filled(F.col("p.variants.sku")).alias("skus"), filled(F.col("p.variants.barcode")).alias("barcodes"),
            _text(F.col("p.product_type")).alias("product_type"),
        )
    )


def filter_feed(pages: DataFrame, vendors: Iterable[str], column: str = "body") -> DataFrame:
    """Feed entries of some vendors: first image and all images.

    First occurrence of a handle by ``(page, position)``.
    """
    names = [v.lower() for v in vendors]
    rows = (
        pages.select("page", F.posexplode(F.from_json(F.col(column), schemas.FEED_PAGE)["products"]).alias("pos", "p"))
        .where(F.lower(_text(F.col("p.vendor"))).isin(names))
        .select(
            "page", "pos", F.col("p.id").alias("id"), F.col("p.title").alias("title"), F.col("p.handle").alias("handle"),
            F.col("p.vendor").alias("vendor"), _text(F.col("p.product_type")).alias("product_type"),
            F.coalesce(F.try_element_at(F.col("p.images.src"), F.lit(1)), F.lit("")).alias("image_url"),
            F.col("p.images.src").alias("image_urls"),
        )
    )
    rest = ["id", "title", "vendor", "product_type", "image_url", "image_urls"]
    return rows.groupBy("handle").agg(F.min(F.struct("page", "pos", *rest)).alias("w")).select(
        "handle", *[f"w.{c}" for c in rest]
    )


# --- image backups -----------------------------------------------------------

_BACKUP_PATH = r"/([^/]+)/(\d+)/img_(\d+)\.(?i:(jpg|jpeg|png|webp))$"


def parse_backup_paths(files: DataFrame) -> DataFrame:
    """``path, length`` → ``vendor_slug, product_id, position, ext, length``; other files
    are ignored."""
    part = lambda i: F.regexp_extract("path", _BACKUP_PATH, i)
    return files.where(F.col("path").rlike(_BACKUP_PATH)).select(
        part(1).alias("vendor_slug"), part(2).cast("bigint").alias("product_id"), part(3).cast("int").alias("position"),
        F.lower(part(4)).alias("ext"), "length", "path",
    )


def read_backup_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Backed-up image files under ``root/<vendor>/<product>/img_NN.<ext>``.

    Only paths and lengths are selected, so file contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return parse_backup_paths(files)


def parse_backup_metadata(texts: DataFrame) -> DataFrame:
    """``path, value`` of metadata documents → ``vendor_slug, product_id, img_key, alt,
    filename, position``; unreadable documents give no rows."""
    where = r"/([^/]+)/(\d+)/metadata\.json$"
    return (
        texts.where(F.col("path").rlike(where))
        .select(
            F.regexp_extract("path", where, 1).alias("vendor_slug"),
            F.regexp_extract("path", where, 2).cast("bigint").alias("product_id"),
            F.explode(F.from_json("value", schemas.BACKUP_METADATA)).alias("img_key", "m"),
        )
        .select("vendor_slug", "product_id", "img_key", _text(F.col("m.alt")).alias("alt"), "m.filename", "m.position")
    )


def read_backup_metadata(spark: SparkSession, root: str) -> DataFrame:
    texts = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "metadata.json").text(root)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_backup_metadata(texts)


# --- writers -----------------------------------------------------------------

def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV report with header (as many files as the data has partitions)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_catalog(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Iterable[str] = ()) -> None:
    """Catalogue as Parquet, optionally partitioned (e.g. by vendor slug)."""
    writer = df.write.mode(mode)
    names = list(partition_by)
    (writer.partitionBy(*names) if names else writer).parquet(path)


def merge_catalog(old: DataFrame, new: DataFrame, key: str = "handle") -> DataFrame:
    """Catalogue after an update: new entries replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
