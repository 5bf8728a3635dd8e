"""Readers, extractors and the streaming forms.

Documents that the pages table does not contain (sitemaps, feeds, galleries) are
written out of its rows, or out of parts, one document per row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query
from vitrina.session import checkpoint_dir
from vitrina.sources import extract as X
from vitrina.sources import readers as R
from vitrina.streaming import incremental

WITH = f"WITH {B.PRODUCTS}"


def scratch(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- product dumps -----------------------------------------------------------

_NESTED = """named_struct('id', product_id, 'title', title, 'handle', handle, 'vendor', vendor, 'product_type', p_type, 'tags', '', 'status', 'active', 'options', array('Peso'),
  'variants', if(p_size > 48, cast(array() as array<struct<id:bigint,title:string,sku:string,barcode:string,weight:double,weight_unit:string,price:string,inventory_quantity:bigint,option1:string,option2:string,option3:string>>),
    transform(sequence(1, if(p_type = 'PROMO', 3, 1)), k -> named_struct('id', product_id * 10 + k, 'title', 'v' || cast(k as string), 'sku', if(k = 2, null, sku), 'barcode', barcode,
    'weight', cast(p_size as double), 'weight_unit', 'kg', 'price', cast(cast(price as decimal(10,2)) as string), 'inventory_quantity', cast(k as bigint), 'option1', cast(p_size * k as string) || 'KG', 'option2', cast(null as string), 'option3', cast(null as string)))))"""


def nested(t):
    """The product table as a store dump."""
    return B.products(t).select(F.expr(_NESTED).alias("p")).select("p.*")


def dumped(t):
    path = scratch(t, "products")
    R.write_json(nested(t), path)
    return R.read_products(t.spark, path, multi_line=False)


@query(
    "s01_read_products",
    f"{WITH} SELECT product_id AS id, title, handle, vendor, p_type AS product_type, CASE WHEN p_size > 48 THEN 0 WHEN p_type = 'PROMO' THEN 3 ELSE 1 END AS n_variants FROM products",
)
def _(t):
    return dumped(t).select("id", "title", "handle", "vendor", "product_type", F.size("variants").alias("n_variants"))


@query(
    "s02_flatten_variants",
    f"""{WITH}, k AS (SELECT *, unnest(CASE WHEN p_size > 48 THEN [NULL] WHEN p_type = 'PROMO' THEN [1, 2, 3] ELSE [1] END) AS k FROM products)
    SELECT product_id, (k - 1)::INTEGER AS ord, product_id * 10 + k AS variant_id, CASE WHEN k = 2 OR k IS NULL THEN '' ELSE sku END AS sku, CASE WHEN k IS NULL THEN '' ELSE barcode END AS barcode,
    CASE WHEN k IS NOT NULL THEN price::DECIMAL(10, 2)::VARCHAR END AS price, (p_size * k)::VARCHAR || 'KG' AS option1, k::BIGINT AS inventory_quantity FROM k""",
)
def _(t):
    v = R.flatten_variants(nested(t))
    return v.select("product_id", "ord", "variant_id", "sku", "barcode", F.col("price").cast("string").alias("price"), "option1", "inventory_quantity")


# --- catalogues --------------------------------------------------------------

_MAP_DOC = (
    "'{\"_site\":\"es\",\"' || handle || '\":{\"name\":\"' || title || '\",\"url\":\"https://m.example.com/' || handle || '\",\"handle\":\"' || handle || '\",\"barcodes\":[\"' || barcode || '\"],\"images\":[\"a.jpg\",\"b.jpg\"]},"
    "\"cached-' || sku || '\":{\"name\":\"' || title || '\",\"url\":\"https://m.example.com/c\",\"resolved\":true,\"brand\":null}}'"
)


@query(
    "s03_catalog_map",
    f"""{WITH} SELECT vendor AS source, 1::BIGINT AS ord, handle, title AS name, 'https://m.example.com/' || handle AS url, handle AS entry_handle, 2 AS n_images, barcode FROM products
    UNION ALL SELECT vendor, 2, 'cached-' || sku, title, 'https://m.example.com/c', NULL, 0, '' FROM products""",
)
def _(t):
    docs = B.products(t).select("vendor", F.expr(_MAP_DOC).alias("value"))
    c = R.parse_catalog_map(docs, F.col("vendor"))
    return c.select("source", "ord", "handle", "name", "url", "entry_handle", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"),
                    F.coalesce(F.try_element_at("barcodes", F.lit(1)), F.lit("")).alias("barcode"))


@query(
    "s04_catalog_list",
    f"{WITH} SELECT product_id AS id, title, handle, vendor, 'https://cdn.example.com/' || sku || '.jpg' AS image_url, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS n_images FROM products",
)
def _(t):
    path = scratch(t, "catalog")
    entries = B.products(t).selectExpr(
        "product_id AS id", "title", "handle", "vendor", "p_type AS product_type", "'https://cdn.example.com/' || sku || '.jpg' AS image_url",
        "if(p_size > 25, array('a', 'b'), array('a')) AS image_urls", "array(p_type) AS tags")
    R.write_json(entries, path)
    return R.read_catalog_list(t.spark, path, multi_line=False).select("id", "title", "handle", "vendor", "image_url", F.size("image_urls").alias("n_images"))


@query(
    "s04_catalog_freshness",
    "SELECT p_brand AS catalog_id, count(*) AS entries, count(*) FILTER (WHERE p_size > 48) > 0 AS fresh FROM part GROUP BY 1",
)
def _(t):
    return R.fresh_catalog(t.part.selectExpr("p_brand AS catalog_id", "if(p_size > 48, array('a'), null) AS image_urls"))


_FEED = (
    "'{\"products\":[{\"id\":' || cast(product_id as string) || ',\"handle\":\"' || handle || '-' || sku || '\",\"title\":\"' || title || '\",\"vendor\":\"' || upper(vendor) || '\",\"product_type\":\"' || p_type || "
    "'\",\"images\":[{\"src\":\"https://cdn.example.com/s/' || sku || '_600x.jpg?v=1\"},{\"src\":\"https://cdn.example.com/logo.png\"},{\"src\":\"\"}],\"variants\":[{\"sku\":\" ' || sku || ' \",\"barcode\":\"' || barcode || '\"},{\"sku\":null,\"barcode\":\"0001\"}]},"
    "{\"handle\":\"shared-' || lower(p_type) || '\",\"title\":\"Shared\",\"vendor\":\"' || vendor || '\"},{\"title\":\"no handle\"}]}'"
)


def feed(t):
    body = F.expr(f"CASE WHEN p_size = 13 THEN 'gateway timeout' ELSE {_FEED} END")
    return B.products(t).select(F.col("product_id").alias("page"), body.alias("body"))


@query(
    "s05_product_feed",
    f"""{WITH} SELECT handle || '-' || sku AS handle, title AS name, upper(vendor) AS vendor, 'https://cdn.example.com/s/' || sku || '.jpg?v=1' AS images, sku AS skus, CASE WHEN barcode = '' THEN '0001' ELSE barcode || '|0001' END AS barcodes FROM products WHERE p_size <> 13
    UNION ALL SELECT 'shared-' || lower(p_type), 'Shared', vendor, '', '', '' FROM products WHERE p_size <> 13""",
)
def _(t):
    c = R.product_feed_to_catalog(feed(t))
    return c.select("handle", "name", "vendor", *[F.array_join(n, "|").alias(n) for n in ("images", "skus", "barcodes")])


@query(
    "s06_feed_filter",
    f"""{WITH}, f AS (SELECT * FROM products WHERE p_size <> 13 AND lower(vendor) IN ('brand#1', 'brand#2', 'brand#3', 'brand#11')),
    a AS (SELECT handle || '-' || sku AS handle, product_id AS id, title, upper(vendor) AS vendor, 'https://cdn.example.com/s/' || sku || '_600x.jpg?v=1' AS image_url, 3 AS n_images FROM f),
    b AS (SELECT 'shared-' || lower(p_type) AS handle, NULL::BIGINT AS id, 'Shared' AS title, arg_min(vendor, product_id) AS vendor, '' AS image_url, 0 AS n_images FROM f GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def _(t):
    c = R.filter_feed(feed(t), ["BRAND#1", "brand#2", "Brand#3", "brand#11"])
    return c.select("handle", "id", "title", "vendor", "image_url", F.greatest(F.coalesce(F.size("image_urls"), F.lit(0)), F.lit(0)).alias("n_images"))


# --- sitemaps ----------------------------------------------------------------

_SITEMAP = (
    "'<urlset><url><LOC> ' || url || ' </LOC></url><url>' || chr(10) || '<loc>https://www.maker.example.com/es/eshop/' || cast(page_id as string) || '-page.html</loc></url><url><loc>' || chr(10) || 'x</loc></url></urlset>'"
)


@query(
    "s07_sitemap_locs",
    "SELECT url, 0 AS pos, url AS loc FROM pages UNION ALL SELECT url, 1, 'https://www.maker.example.com/es/eshop/' || page_id || '-page.html' FROM pages UNION ALL SELECT url, 2, 'x' FROM pages",
)
def _(t):
    return X.sitemap_locs(t.pages.select("url", F.expr(_SITEMAP).alias("body")))


_TITLE_TAG = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_BLOCKS = (
    f"'<url><loc>https://shop.example.com/uk/products/p-' || cast(page_id as string) || '/?a=1</loc><image:image><image:loc>https://cdn.example.com/' || cast(page_id as string) || '.jpg</image:loc>"
    f"<image:title><![CDATA[ ' || {_TITLE_TAG} || ' ]]></image:title></image:image></url><url><loc>https://shop.example.com/pages/about</loc></url><url><loc>https://shop.example.com/products/plain-' || cast(page_id as string) || '</loc></url>'"
)


@query(
    "s08_product_sitemap",
    f"SELECT url, 0 AS pos, 'p-' || page_id AS handle, trim({_TITLE_TAG}) AS title, 'https://cdn.example.com/' || page_id || '.jpg' AS image FROM pages UNION ALL SELECT url, 2, 'plain-' || page_id, '', '' FROM pages",
)
def _(t):
    return X.product_sitemap(t.pages.select("url", F.expr(_BLOCKS).alias("body")))


# Sitemap i lists the product page of page i and the sitemaps of pages 20i+1 … 20i+20.
_MAP_URL = "'https://www.farmina.com/maps/' || cast({} as string) || '_sitemap.xml'"


def sitemap_docs(t):
    parent = F.floor((F.col("page_id") - 1) / 20)
    child = t.pages.where("page_id > 0").select(parent.alias("parent"), F.expr(_MAP_URL.format("page_id")).alias("loc"))
    # At most twenty children per sitemap.
    lists = child.groupBy("parent").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<loc>"), "loc", F.lit("</loc>")))).alias("maps"))
    own = F.expr("'<loc>https://www.farmina.com/es/eshop/' || cast(page_id as string) || '-page.html?x=1</loc><loc>https://www.farmina.com/es/blog/' || cast(page_id as string) || '</loc>'")
    return t.pages.join(lists, F.col("page_id") == F.col("parent"), "left").select(
        F.expr(_MAP_URL.format("page_id")).alias("url"), F.concat(own, F.coalesce("maps", F.lit(""))).alias("body"))


@query(
    "s09_sitemap_closure",
    """WITH RECURSIVE r(page_id, depth) AS (SELECT page_id, 1 FROM pages WHERE page_id = 0 UNION ALL SELECT p.page_id, r.depth + 1 FROM r JOIN pages p ON p.page_id > 0 AND (p.page_id - 1) // 20 = r.page_id WHERE r.depth < 6)
    SELECT 'https://www.farmina.com/es/eshop/' || page_id || '-page.html' AS url, depth FROM r""",
)
def _(t):
    # The site's robots file names the first sitemap.
    robots = t.pages.where("page_id = 0").select(
        F.lit("https://www.farmina.com/robots.txt").alias("url"), F.concat(F.lit("User-agent: *\nSitemap: "), F.expr(_MAP_URL.format("page_id"))).alias("body"))
    roots = X.robots_sitemaps(robots).select(F.col("sitemap").alias("url"))
    return X.sitemap_closure(sitemap_docs(t), roots, "farmina", max_depth=6)


_ROBOTS = "'User-agent: *' || chr(10) || 'Sitemap: ' || url || chr(13) || chr(10) || 'Disallow: /x' || chr(10) || 'SITEMAP:https://maps.example.com/' || cast(page_id as string) || '.xml'"


@query("s10_robots_sitemaps", "SELECT url, 1 AS pos, url AS sitemap FROM pages UNION ALL SELECT url, 3, 'https://maps.example.com/' || page_id || '.xml' FROM pages")
def _(t):
    return X.robots_sitemaps(t.pages.select("url", F.expr(_ROBOTS).alias("body")))


# --- pages -------------------------------------------------------------------

# Some pages gain a product heading, some an og:title.
_NAMED = (
    "CASE WHEN url LIKE '%.html' THEN '<meta content=\"OG ' || cast(page_id as string) || '\" property=\"og:title\">' || html WHEN url LIKE '%/' THEN '<h1>first</h1><h1 class=\"big product_title\"> <b>Product</b> ' || cast(page_id as string) || '</h1>' || html ELSE html END"
)
_INNER = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "s11_page_name",
    f"SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'OG ' || page_id WHEN url LIKE '%/' THEN 'Product ' || page_id ELSE {_INNER} END AS name FROM pages",
)
def _(t):
    return t.pages.select("page_id", "url", F.expr(_NAMED).alias("html")).select("page_id", X.page_name(F.col("html")).alias("name"))


_N = "cast(page_id as string)"
_GALLERY = (
    f"'<head><meta property=\"og:image\" content=\"/main/' || {_N} || '.jpg\"><meta name=\"twitter:image\" content=\"https://cdn.example.com/logo.png\">"
    f"<script type=\"application/ld+json\">{{\"@graph\":[{{\"image\":[\"https://cdn.example.com/ld-' || {_N} || '.jpg\",{{\"url\":\"https://cdn.example.com/obj-' || {_N} || '.jpg\"}}]}},{{\"name\":\"x\"}}]}}</script>"
    f"<script type=\"application/ld+json\">{{\"image\":{{\"contentUrl\":\"//cdn.example.com/cu-' || {_N} || '.jpg\"}},\"thumbnail\":\"https://cdn.example.com/th-' || {_N} || '.jpg\"}}</script><script type=\"application/ld+json\">broken</script></head>' || html || "
    f"'<img srcset=\"/s/' || {_N} || '-300x300.jpg 300w, /s/' || {_N} || '-900x900.jpg 900w\" src=\"/s/' || {_N} || '.jpg\"><img data-src=\"rel/' || {_N} || '.png\" src=\"data:image/gif;base64,x\"><footer><img src=\"/foot.jpg\"></footer>'"
)
_BASE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_FOLDER = r"regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '[^/]*$', '')"


def gallery_pages(t):
    return t.pages.select("page_id", "url", F.expr(_GALLERY).alias("html"))


@query(
    "s12_page_images",
    f"""SELECT page_id, 1 AS source_rank, 0 AS pos, {_BASE} || '/main/' || page_id || '.jpg' AS image FROM pages
    UNION ALL SELECT page_id, 2, 0, 'https://cdn.example.com/ld-' || page_id || '.jpg' FROM pages UNION ALL SELECT page_id, 2, 1, 'https://cdn.example.com/obj-' || page_id || '.jpg' FROM pages
    UNION ALL SELECT page_id, 2, 2, 'https://cdn.example.com/cu-' || page_id || '.jpg' FROM pages
    UNION ALL SELECT page_id, 3, 0, {_BASE} || '/s/' || page_id || '-900x900.jpg' FROM pages
    UNION ALL SELECT page_id, 3, 2, {_FOLDER} || 'rel/' || page_id || '.png' FROM pages""",
)
def _(t):
    return X.page_images(gallery_pages(t), "beaphar")


@query(
    "s13_jsonld_images",
    """SELECT page_id, 0 AS pos, 'https://cdn.example.com/ld-' || page_id || '.jpg' AS image FROM pages UNION ALL SELECT page_id, 1, 'https://cdn.example.com/obj-' || page_id || '.jpg' FROM pages
    UNION ALL SELECT page_id, 2, '//cdn.example.com/cu-' || page_id || '.jpg' FROM pages UNION ALL SELECT page_id, 3, 'https://cdn.example.com/th-' || page_id || '.jpg' FROM pages""",
)
def _(t):
    return X.jsonld_images(gallery_pages(t), keys=("image", "thumbnail", "logo"))


_STYLED = (
    f"html || '<div style=\"background-image:url(''/bg/' || {_N} || '.jpg'')\"></div><script>var p = \"https://cdn.example.com/js-' || {_N} || '.webp?x=1\\\\\", q = ''https://cdn.example.com/' || repeat('a', cast(page_id % 150 as int)) || '.png'';</script>'"
)


@query(
    "s14_background_images",
    """WITH u AS (SELECT page_id, 0 AS k, '/bg/' || page_id || '.jpg' AS image FROM pages UNION ALL SELECT page_id, 1, 'https://cdn.example.com/js-' || page_id || '.webp?x=1' FROM pages
      UNION ALL SELECT page_id, 2, 'https://cdn.example.com/' || repeat('a', (page_id % 150)::INTEGER) || '.png' FROM pages)
    SELECT page_id, k AS pos, image FROM u WHERE length(image) < 100""",
)
def _(t):
    return t.pages.select("page_id", F.posexplode(X.background_images(F.expr(_STYLED), 100)).alias("pos", "image"))


_ZOOMED = (
    f"html || '<a HREF=\"/full/' || {_N} || '.jpg\"><img data-big=''/b/' || {_N} || '.webp?v=1'' data-zoom-image=\"/z/' || {_N} || '.png\" data-image=\"no picture\"></a>'"
)


@query(
    "s14_zoom_images",
    """SELECT page_id, 0 AS pos, '/z/' || page_id || '.png' AS image FROM pages UNION ALL SELECT page_id, 1, '/b/' || page_id || '.webp?v=1' FROM pages
    UNION ALL SELECT page_id, 2, '/full/' || page_id || '.jpg' FROM pages""",
)
def _(t):
    return t.pages.select("page_id", F.posexplode(X.zoom_images(F.expr(_ZOOMED))).alias("pos", "image"))


_BOX = (
    "'<div class=\"hoverbox\" onclick=\"location.href=''/es/' || cast(product_id as string) || '-' || handle || '.html''\"><div class=\"es-product-line-title\">' || CASE WHEN p_size > 25 THEN title ELSE '' END || "
    "'</div><img class=\"x\" src=\"' || CASE WHEN p_size > 40 THEN 'https://www.maker.example.com/icons/' WHEN p_size > 20 THEN 'https://www.maker.example.com/fotoprodotti/' ELSE '/fotoprodotti/' END || sku || '.png\"></div>"
    "<div class=\"hoverbox\" onclick=\"none\"><img src=\"/fotoprodotti/none.png\"></div><div class=\"hoverbox\" onclick=\"location.href=''/es/' || cast(product_id as string) || '-again.html''\"><img src=\"/fotoprodotti/again.png\"></div>'"
)


@query(
    "s15_category_listing",
    f"""{WITH} SELECT p_type AS species, product_id::VARCHAR AS id, handle AS slug, CASE WHEN p_size > 25 THEN title ELSE replace(handle, '-', ' ') END AS name, '/es/' || product_id || '-' || handle || '.html' AS url,
    CASE WHEN p_size > 20 THEN 'https://www.maker.example.com/fotoprodotti/' ELSE 'https://base.example.com/fotoprodotti/' END || sku || '.png' AS image_url FROM products WHERE p_size <= 40""",
)
def _(t):
    docs = B.products(t).select(F.col("p_type").alias("species"), F.col("product_id").alias("doc_order"), F.expr(_BOX).alias("body"))
    return X.category_listing(docs, "https://base.example.com")


_HREFS = "regexp_extract_all(html, '(?is)<a\\b[^>]*\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"
_LINKY = "html || '<a class=\"c\" href=\"' || url || '/deep/er/x.html?y=1\">z</a><a href=\"https://elsewhere.example.com/a/b/c.html\">e</a><a href=\"mailto:x\">m</a>'"


@query(
    "s16_harvest_links",
    f"""WITH p AS (SELECT page_id, {_BASE} AS base, {B._sql(_LINKY)} AS html FROM pages), h AS (SELECT page_id, base, unnest({_HREFS}) AS href FROM p),
    f AS (SELECT page_id, base, CASE WHEN starts_with(href, '/') THEN base || href WHEN starts_with(href, 'http') THEN href END AS u FROM h),
    k AS (SELECT page_id, split_part(u, '?', 1) AS link FROM f WHERE u IS NOT NULL AND starts_with(u, base) AND NOT contains(u, '/th') AND (contains(u, 'er') OR contains(u, 'a'))
      AND len(list_filter(string_split(split_part(regexp_replace(u, '/+$', ''), '?', 1), '/'), lambda s: s <> '')) >= 3)
    SELECT DISTINCT page_id, link FROM k""",
)
def _(t):
    pages = t.pages.select("page_id", "url", F.expr(_LINKY).alias("html"))
    return X.harvest_links(pages, must=("er", "a"), must_not=("/th",), min_segments=3)


_SEARCH = (
    "CASE WHEN p_type = 'PROMO' THEN '{\"results\":[{\"link\":\"/p?noproducto=' || sku || '#s\"},{\"url\":\"https://x.example.com/a\"},{\"link\":\"/p?noproducto=' || sku || '\"}]}' "
    "WHEN p_type = 'SMALL' THEN '{\"hits\":[{\"link\":\"\",\"href\":\"p/' || sku || '\"},{\"name\":\"no link\"}]}' WHEN p_type = 'LARGE' THEN '{\"data\":{\"results\":[{\"url\":\"//c.example.com/' || sku || '\"}]}}' "
    "WHEN p_type = 'MEDIUM' THEN '[1,2]' ELSE 'not json' END"
)


@query(
    "s17_search_result_links",
    f"""{WITH} SELECT product_id AS doc_id, 0 AS pos, CASE p_type WHEN 'PROMO' THEN 'https://shop.example.com/p?noproducto=' || sku WHEN 'SMALL' THEN 'https://shop.example.com/p/' || sku ELSE 'https://shop.example.com//c.example.com/' || sku END AS link
    FROM products WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') UNION ALL SELECT product_id, 1, 'https://x.example.com/a' FROM products WHERE p_type = 'PROMO'""",
)
def _(t):
    docs = B.products(t).select(F.col("product_id").alias("doc_id"), F.expr(_SEARCH).alias("body"))
    return X.search_result_links(docs, "https://shop.example.com/")


# --- image backups -----------------------------------------------------------

_PATH = (
    "'file:/data/backups/' || lower(replace(l_returnflag, 'A', 'acme')) || '/' || cast(l_partkey as string) || '/img_0' || cast(l_linenumber as string) || "
    "CASE WHEN l_linenumber = 1 THEN '.JPG' WHEN l_linenumber = 2 THEN '.png' WHEN l_linenumber = 3 THEN '.gif' ELSE '.webp' END"
)


@query(
    "s18_backup_inventory",
    """SELECT lower(replace(l_returnflag, 'A', 'acme')) AS vendor_slug, l_partkey AS product_id, l_linenumber AS position, CASE WHEN l_linenumber = 1 THEN 'jpg' WHEN l_linenumber = 2 THEN 'png' ELSE 'webp' END AS ext,
    (l_quantity * 1000)::BIGINT AS length FROM lineitem WHERE l_linenumber <> 3""",
)
def _(t):
    files = t.lineitem.select(F.expr(_PATH).alias("path"), F.expr("cast(l_quantity * 1000 as bigint)").alias("length"))
    return R.parse_backup_paths(files).drop("path")


_META = (
    "CASE WHEN p_size > 45 THEN '{\"img_01\":' ELSE '{\"img_01\":{\"alt\":\"' || title || '\",\"filename\":\"' || handle || '_1.webp\",\"position\":1},\"img_02\":{\"alt\":null,\"filename\":\"x.webp\",\"position\":' || cast(p_size as string) || '}}' END"
)


@query(
    "s19_backup_metadata",
    f"""{WITH} SELECT 'acme' AS vendor_slug, product_id, 'img_01' AS img_key, title AS alt, handle || '_1.webp' AS filename, 1 AS position FROM products WHERE p_size <= 45
    UNION ALL SELECT 'acme', product_id, 'img_02', '', 'x.webp', p_size FROM products WHERE p_size <= 45""",
)
def _(t):
    texts = B.products(t).select(F.expr("'s3://b/backups/acme/' || cast(product_id as string) || '/metadata.json'").alias("path"), F.expr(_META).alias("value"))
    return R.parse_backup_metadata(texts)


# --- writers -----------------------------------------------------------------

@query("s20_write_report", f"{WITH} SELECT product_id, vendor, title FROM products")
def _(t):
    path = scratch(t, "report")
    R.write_report(B.products(t).select("product_id", "vendor", "title"), path)
    return t.spark.read.option("header", True).schema("product_id bigint, vendor string, title string").csv(path)


@query(
    "s20_write_catalog",
    f"WITH {B.CATALOG} SELECT handle, name, product_type, CASE WHEN ord % 3 = 0 THEN 'https://new.example.com/' || handle ELSE url END AS url FROM catalog",
)
def _(t):
    path = scratch(t, "catalog")
    c = B.catalog(t)
    new = c.where("ord % 3 = 0").withColumn("url", F.concat(F.lit("https://new.example.com/"), "handle"))
    R.write_catalog(R.merge_catalog(c, new), path, partition_by=["product_type"])
    return t.spark.read.parquet(path).select("handle", "name", "product_type", "url")


# --- streams -----------------------------------------------------------------

@query("x01_register_products", "SELECT DISTINCT user_id AS product_id FROM events")
def _(t):
    registry, state = scratch(t, "registry"), scratch(t, "state")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parq*").selectExpr("user_id AS product_id")
    incremental.register_products(stream, registry, state).awaitTermination()
    return t.spark.read.parquet(registry).select("product_id")


@query("x01_first_seen", "SELECT DISTINCT user_id AS product_id FROM events")
def _(t):
    out, state = scratch(t, "seen"), scratch(t, "state")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parq*").selectExpr("user_id AS product_id")
    incremental.drain(incremental.first_seen_products(stream), out, state).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "x02_history_stream",
    f"WITH {B.WRITES}, p AS (SELECT *, lag(url) OVER (PARTITION BY product_id ORDER BY seq) AS prev FROM writes WHERE url <> '') SELECT product_id, seq, url FROM p WHERE prev IS NULL OR prev <> url",
)
def _(t):
    out, state = scratch(t, "history"), scratch(t, "state")
    stream = B._view(t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parq*"), B.WRITE_COLUMNS)
    incremental.drain(incremental.history_log(stream), out, state).awaitTermination()
    return incremental.history_of_log(t.spark.read.parquet(out))
