"""URL functions, predicates and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import predicates as P
from vitrina.functions import text as T
from vitrina.functions import urls as U
from vitrina.operators import filters
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query

WITH = f"WITH {B.PRODUCTS}"
WITH_IMAGES = f"WITH {B.IMAGES}"


def host(u: str) -> str:
    return f"regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://([^/?#]+)', 1)"


# Image and page URLs dressed from the part table.
PHOTO = (
    "CASE WHEN p_type = 'PROMO' THEN 'https://cdn.example.com/wp/' || handle || '-' || cast(p_size as string) || 'x300.jpg?x=1' "
    "WHEN p_type = 'SMALL' THEN 'https://shop.example.com/' || cast(p_size as string) || '-medium_default/' || handle || '.jpg' "
    "WHEN p_type = 'LARGE' THEN 'https://cdn.example.com/s/' || handle || '_1024x1024.png?v=3' "
    "WHEN p_type = 'MEDIUM' THEN 'https://m.media-amazon.com/images/I/' || handle || '._AC_SL1500_.jpg' "
    "WHEN p_size > 30 THEN 'https://www.maker.example.com/logo_' || handle || '.svg' "
    "WHEN p_size > 20 THEN 'https://video.example.com/9-abc-d_' || cast(p_size as string) || 'x90.jpg' "
    "ELSE '//www.maker.example.com/img/' || handle || '_grande.JPEG' END"
)


def _photo(t):
    return B.products(t).withColumn("photo", F.expr(PHOTO))


PHOTOS = f"{WITH}, photos AS (SELECT *, {B._sql(PHOTO)} AS photo FROM products)"
NOQ = S.no_query("photo")


@query("l01_norm_url", f"SELECT page_id, {S.norm_url('url')} AS norm FROM pages")
def _(t):
    return t.pages.select("page_id", U.norm_url(F.col("url")).alias("norm"))


@query("l02_domain", rf"SELECT page_id, regexp_replace({host('url')}, '^www\.', '') AS domain FROM pages")
def _(t):
    return t.pages.select("page_id", U.domain_of(F.col("url")).alias("domain"))


_SITES = (("host:m.", "mobile"), ("domain:spam-farm.example.org", "junk"), ("url:utm_", "tracked"), ("", "other"))
_SHOPS = "replace(replace(replace(url, 'example.com', 'inabafoods.com'), 'example.net', 'inabafoods-europe.com'), 'example.org', 'vet-es.virbac.com')"


@query(
    "l03_site_routing",
    rf"WITH h AS (SELECT page_id, url, {_SHOPS} AS shop, {host('url')} AS h FROM pages), s AS (SELECT *, {host('shop')} AS sh FROM h) SELECT page_id, CASE WHEN contains(h, 'm.') THEN 'mobile' WHEN regexp_replace(h, '^www\.', '') = 'spam-farm.example.org' THEN 'junk' "
    "WHEN contains(lower(url), 'utm_') THEN 'tracked' ELSE 'other' END AS site, CASE WHEN contains(sh, 'inabafoods-europe.com') THEN 'es' WHEN contains(sh, 'inabafoods.com') THEN 'us' ELSE 'es' END AS churu, "
    "CASE WHEN contains(sh, 'vet-es.virbac.com') THEN 'vet' ELSE 'store' END AS virbac FROM s",
)
def _(t):
    shop = F.expr(_SHOPS)
    return t.pages.select("page_id", U.route_site(F.col("url"), _SITES).alias("site"), U.route_site(shop, "churu").alias("churu"),
                          U.route_site(shop, "virbac").alias("virbac"))


@query("l04_size_suffix", f"{PHOTOS} SELECT product_id, regexp_replace({NOQ}, '-\\d+x\\d+(\\.[a-zA-Z]{{3,4}})$', '\\1') AS clean FROM photos")
def _(t):
    return _photo(t).select("product_id", U.strip_size_suffix(F.col("photo")).alias("clean"))


@query("l05_upgrade_thumbnail", rf"{PHOTOS} SELECT product_id, regexp_replace(photo, '/(\d+)-(?:cart|small|medium|home|category)_default/', '/\1-large_default/', 'g') AS big FROM photos")
def _(t):
    return _photo(t).select("product_id", U.upgrade_thumbnail(F.col("photo")).alias("big"))


@query(
    "l06_store_cdn_original",
    rf"{PHOTOS} SELECT product_id, regexp_replace(photo, '_(?:\d+x\d*|grande|large|medium|small|compact|pico|icon|thumb|original|master)(\.(?:jpg|jpeg|png|webp|gif)\b)', '\1', 'gi') AS original FROM photos",
)
def _(t):
    return _photo(t).select("product_id", U.store_cdn_original(F.col("photo")).alias("original"))


_ITEM = "'https://www.amazon.example.com/' || CASE WHEN p_size > 25 THEN 'dp/' ELSE 'gp/product/' END || 'B0' || lpad(cast(product_id as string), 8, '0') || '/ref=1'"


@query(
    "l07_marketplace_ids",
    rf"{PHOTOS} SELECT product_id, regexp_replace({NOQ}, '\._[A-Z0-9][A-Z0-9_,]*_\.', '.', 'g') AS original, "
    r"coalesce(nullif(regexp_extract(photo, '/images/I/([^./]+)', 1), ''), photo) AS image_id, "
    rf"regexp_extract({B._sql(_ITEM)}, '/(?:dp|gp/product)/([A-Z0-9]{{10}})', 1) AS item_id FROM photos",
)
def _(t):
    return _photo(t).select(
        "product_id", U.strip_size_token(F.col("photo")).alias("original"),
        U.marketplace_image_id(F.col("photo")).alias("image_id"), U.marketplace_item_id(F.expr(_ITEM)).alias("item_id"),
    )


@query(
    "l08_width_requests",
    rf"{PHOTOS}, r AS (SELECT product_id, photo, regexp_replace(photo, '_\d+x(\d*)\.', '.', 'g') AS u FROM photos) "
    rf"SELECT product_id, {NOQ} || '?sw=2000&q=100' AS scaled, CASE WHEN contains(u, 'sw=') OR contains(u, 'w=') THEN u "
    r"WHEN contains(u, '?') THEN u || '&w=2000' ELSE u || '?w=2000' END AS requested, "
    r"regexp_replace(regexp_replace(photo, '_\d+x\d*\.', '.', 'g'), '\?.*$', '') AS stripped FROM r",
)
def _(t):
    u = F.col("photo")
    return _photo(t).select(
        "product_id", U.cdn_width(u).alias("scaled"), U.request_width(u).alias("requested"), U.strip_width(u).alias("stripped")
    )


_HASH = "0123456789abcdef0123456789abcdef"
_CACHE = (
    "CASE WHEN p_type = 'PROMO' THEN 'https://shop.example.com/media/catalog/product/cache/ab12/r/i/' || handle || '.jpg?w=1' "
    "WHEN p_type = 'SMALL' THEN 'https://shop.example.com/media/catalog/product/cache/ff/' || upper(handle) || '-90x90.jpg' "
    "ELSE 'https://shop.example.com/media/wysiwyg/' || handle || '.jpg' END"
)
_CRX = r"^(https?://[^/]+/media)/catalog/product/cache/[0-9a-f]+/(?:[^/]+/[^/]+/)?([^?]+)$"


@query(
    "l09_cache_expansion",
    rf"""{WITH}, c AS (SELECT product_id, split_part(regexp_replace({B._sql(_CACHE)}, '-\d+x\d+\.', '.', 'g'), '?', 1) AS u FROM products),
    m AS (SELECT product_id, u, regexp_extract(u, '{_CRX}', 1) AS b, regexp_extract(u, '{_CRX}', 2) AS f FROM c),
    l AS (SELECT product_id, CASE WHEN b <> '' THEN [u, b || '/wysiwyg/' || f, b || '/catalog/product/cache/{_HASH}/' ||
      lower(substr(f, 1, 1)) || '/' || lower(substr(f, 2, 1)) || '/' || f] ELSE [u] END AS urls FROM m)
    SELECT product_id, unnest(range(0, len(urls)))::INTEGER AS pos, unnest(urls) AS url FROM l""",
)
def _(t):
    urls = U.expand_cache_url(F.expr(_CACHE), _HASH)
    return B.products(t).select("product_id", F.posexplode(urls).alias("pos", "url"))


_SLUG_URL = (
    "CASE WHEN p_type = 'PROMO' THEN 'https://maker.example.com/es/eshop/' || cast(p_size as string) || '-' || handle || '-%26-mini.html' "
    "WHEN p_type = 'SMALL' THEN 'https://maker.example.com/' || handle || '_x/' ELSE 'https://maker.example.com/' || handle || '?a=1' END"
)


@query(
    "l10_name_from_slug",
    rf"""{WITH}, s AS (SELECT product_id, url_decode({B._sql(_SLUG_URL)}) AS u FROM products),
    g AS (SELECT product_id, regexp_extract(split_part(regexp_replace(u, '/+$', ''), '?', 1), '([^/]*)$', 1) AS slug FROM s)
    SELECT product_id, slug, trim(regexp_replace(regexp_replace(regexp_replace(slug, '\.html?$', '', 'i'), '^\d+[-_]', ''), '[-_]+', ' ', 'g')) AS name FROM g""",
)
def _(t):
    u = F.expr(_SLUG_URL)
    return B.products(t).select("product_id", U.slug_of(u).alias("slug"), U.name_from_slug(u).alias("name"))


@query(
    "l11_handle_of_url",
    f"WITH {B.HITS}, h AS (SELECT product_id, rank, split_part(split_part(string_split(regexp_replace(url, '/+$', ''), '/products/')[-1], '/', 1), '?', 1) AS handle FROM hits) "
    r"SELECT product_id, rank, handle, regexp_replace(handle, '-\d+$', '') AS canonical, regexp_matches(handle, '-\d+$') AS has_suffix FROM h",
)
def _(t):
    h = B.hits(t).select("product_id", "rank", U.handle_of(F.col("url")).alias("handle"))
    return h.select("product_id", "rank", "handle", U.canonical_handle(F.col("handle")).alias("canonical"),
                    U.has_numeric_suffix(F.col("handle")).alias("has_suffix"))


_EXT = "lower(string_split(" + NOQ + ", '.')[-1])"


@query(
    "l12_image_extension",
    f"{PHOTOS} SELECT product_id, CASE WHEN {_EXT} IN ('jpg', 'png', 'webp') THEN {_EXT} ELSE 'jpg' END AS ext, "
    f"CASE WHEN {_EXT} IN ('jpg', 'png', 'webp', 'gif') THEN {_EXT} ELSE 'jpg' END AS ext_gif FROM photos",
)
def _(t):
    u = F.col("photo")
    return _photo(t).select("product_id", U.image_extension(u).alias("ext"), U.image_extension(u, True).alias("ext_gif"))


@query(
    "l13_supplier_images",
    f"""{WITH}, l AS (SELECT product_id, list_filter(['https://repo.example.com/p/' || lower(substr(sku, 1, 1)) || '/' || sku || '.webp',
      CASE WHEN barcode <> '' THEN 'https://repo.example.com/p/' || lower(substr(barcode, 1, 1)) || '/' || barcode || '.webp' END],
      lambda x: x IS NOT NULL) AS urls FROM products)
    SELECT product_id, unnest(range(0, len(urls)))::INTEGER AS pos, unnest(urls) AS url FROM l""",
)
def _(t):
    urls = U.supplier_image_urls(F.col("sku"), F.col("barcode"), "https://repo.example.com/p")
    return B.products(t).select("product_id", F.posexplode(urls).alias("pos", "url"))


@query("l14_admin_link", f"{WITH} SELECT product_id, 'https://admin.shopify.com/store/my-shop/products/' || product_id AS link FROM products")
def _(t):
    return B.products(t).select("product_id", U.admin_link(F.col("product_id"), "my-shop.myshopify.com").alias("link"))


_SRC = (
    "'https://cdn.example.com/' || handle || CASE WHEN p_size > 20 THEN '_01234567-89ab-cdef-0123-456789abcdef' ELSE '' END || '.jpg?v=' || cast(p_size as string)"
)


@query(
    "l15_backup_file_name",
    f"{WITH} SELECT product_id, handle || '_' || product_id || '_' || p_size || '.webp' AS filename FROM products",
)
def _(t):
    name = U.backup_file_name(F.expr(_SRC), F.col("product_id"), F.col("p_size"), T.vendor_slug(F.col("vendor")))
    return B.products(t).select("product_id", name.alias("filename"))


@query(
    "l16_output_image_name",
    f"{WITH} SELECT product_id, trim(regexp_replace({S.ascii_fold('title')}, '[^a-z0-9]+', '-', 'g'), '-') || '_' || p_size || '.webp' AS filename FROM products",
)
def _(t):
    return B.products(t).select("product_id", U.output_image_name(T.title_slug(F.col("title")), F.col("p_size")).alias("filename"))


_HREFS = "regexp_extract_all(html, '(?is)<a\\b[^>]*\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(
    "l17_absolutize",
    f"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS base, {_HREFS} AS hs FROM pages),
    h AS (SELECT page_id, url, base, unnest(range(0, len(hs)))::INTEGER AS pos, unnest(hs) AS href FROM a),
    r AS (SELECT *, CASE WHEN page_id < 0 THEN '' ELSE CASE WHEN starts_with(href, '/t') THEN substr(href, 2) WHEN starts_with(href, '/a') THEN '/' || href ELSE href END END AS raw FROM h)
    SELECT page_id, pos, CASE WHEN starts_with(raw, 'http') THEN raw WHEN starts_with(raw, '//') THEN 'https:' || raw
      WHEN starts_with(raw, '/') THEN base || raw ELSE '' END AS kept,
      CASE WHEN starts_with(raw, 'http') THEN raw WHEN starts_with(raw, '//') THEN 'https:' || raw
      WHEN starts_with(raw, '/') THEN base || raw WHEN raw = '' THEN ''
      ELSE regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '[^/]*$', '') || raw END AS resolved FROM r""",
)
def _(t):
    from vitrina.sources.extract import hrefs

    raw = F.expr(
        "CASE WHEN startswith(href, '/t') THEN substr(href, 2) WHEN startswith(href, '/a') THEN '/' || href ELSE href END"
    )
    h = t.pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href")).withColumn("raw", raw)
    base = U.base_of(F.col("url"))
    return h.select("page_id", "pos", U.absolutize(F.col("raw"), base).alias("kept"),
                    U.absolutize(F.col("raw"), base, F.col("url")).alias("resolved"))


# --- scans -------------------------------------------------------------------

_OUT = "product_id, vendor, title"


@query("p01_vendor_scan", f"{WITH} SELECT {_OUT} FROM products WHERE vendor = 'Brand#7'")
def _(t):
    return filters.by_vendor(B.products(t), "Brand#7").select("product_id", "vendor", "title")


# Every order's id list names parts; the scan keeps products named by any list.
@query(
    "p02_id_list_scan",
    f"{WITH}, ids AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_quantity > 49 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) "
    f"SELECT {_OUT} FROM products WHERE product_id IN (SELECT product_id FROM ids)",
)
def _(t):
    lists = t.lineitem.where("l_quantity > 49").selectExpr(
        "cast(l_partkey as string) || ', ' || cast(l_suppkey as string) || ',, ' AS id_list"
    )
    return filters.by_ids(B.products(t), filters.parse_id_list(lists)).select("product_id", "vendor", "title")


@query("p03_title_contains", f"{WITH} SELECT {_OUT} FROM products WHERE contains(lower(title), 'gato snacks')")
def _(t):
    return filters.title_contains(B.products(t), "GATO Snacks").select("product_id", "vendor", "title")


@query(
    "p04_without_images",
    f"{WITH}, {B.IMAGES} SELECT {_OUT} FROM products WHERE product_id NOT IN (SELECT product_id FROM images WHERE width < 100)",
)
def _(t):
    usable = B.images(t).where("width < 100")
    return filters.without_images(B.products(t), usable).select("product_id", "vendor", "title")


@query(
    "p05_vendor_family",
    f"{WITH} SELECT {_OUT} FROM products WHERE contains(lower(vendor), 'brand#1') AND NOT contains(lower(vendor), 'mini') AND NOT contains(lower(title), 'mini')",
)
def _(t):
    return filters.vendor_family(B.products(t), "brand#1", "mini").select("product_id", "vendor", "title")


@query("p06_exclusion_list", f"{WITH} SELECT {_OUT} FROM products WHERE product_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def _(t):
    skip = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 40").selectExpr("l_partkey AS product_id")
    return filters.excluding(B.products(t), skip).select("product_id", "vendor", "title")


def blacklist(u: str, words) -> str:
    return "NOT " + S.any_in(f"lower({u})", words)


@query(
    "p07_keep_image_url",
    f"{PHOTOS} SELECT product_id, {blacklist('photo', lx.IMAGE_BLACKLIST['generic_search'])} AS generic, "
    f"{blacklist('photo', lx.IMAGE_BLACKLIST['farmina'])} AS maker, {blacklist('photo', lx.IMAGE_BLACKLIST['supplier'])} AS supplier, "
    f"{blacklist('photo', lx.IMAGE_BLACKLIST['beaphar'])} AS cdn FROM photos",
)
def _(t):
    u = F.col("photo")
    return _photo(t).select(
        "product_id", P.keep_image_url(u, "generic_search").alias("generic"), P.keep_image_url(u, "farmina").alias("maker"),
        P.keep_image_url(u, "supplier").alias("supplier"), P.keep_image_url(u, "beaphar").alias("cdn"),
    )


_HEX = "CASE WHEN p_size > 45 THEN replace(photo, '.jpg', '_0123456789abcdef0123456789abcdef0123456789.jpg') ELSE photo END"


@query(
    "p08_keep_gallery_url",
    f"{PHOTOS}, x AS (SELECT product_id, {_HEX} AS u FROM photos), n AS (SELECT product_id, u, "
    r"lower(regexp_replace(regexp_extract(regexp_replace(u, '/+$', ''), '([^/]*)$', 1), '\.[^.]*$', '')) AS f FROM x) "
    f"SELECT product_id, {blacklist('u', lx.IMAGE_BLACKLIST['artero'])} AND NOT regexp_matches(f, '[0-9a-f]{{40,}}') "
    r"AND NOT regexp_matches(f, '-d_\d+x\d+$') AS keep FROM n",
)
def _(t):
    return _photo(t).select("product_id", P.keep_image_url(F.expr(_HEX), "artero").alias("keep"))


_PAGE = (
    "CASE WHEN p_type = 'PROMO' THEN 'https://www.farmina.com/es/eshop/' || cast(p_size as string) || '-' || handle || '.html' "
    "WHEN p_type = 'SMALL' THEN 'https://menforsan.com/es/' || CASE WHEN p_size > 25 THEN 'blog/' ELSE 'champu/' END || cast(p_size as string) || '-' || handle || '.html' "
    "WHEN p_type = 'LARGE' THEN 'https://inabafoods.com/' || CASE WHEN p_size > 25 THEN 'cats' ELSE 'cats/' || handle END "
    "WHEN p_type = 'MEDIUM' THEN 'https://store.es.virbac.com/' || CASE WHEN p_size > 25 THEN 'cart/x' ELSE 'perro/' || handle END "
    "WHEN p_size > 25 THEN 'https://applaws.com/uk/products/' || CASE WHEN p_size > 40 THEN 'blog/x' ELSE handle || '/' END "
    "ELSE 'https://www.mycalibra.es/' || CASE WHEN p_size > 12 THEN 'calibra-' || handle ELSE 'productos' END END"
)
_PATH = "regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_LAST = "regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1)"


@query(
    "p09_is_product_url",
    rf"""{WITH}, u AS (SELECT product_id, {B._sql(_PAGE)} AS u FROM products), p AS (SELECT product_id, u, {host('u')} AS h, {_PATH} AS path FROM u),
    l AS (SELECT *, {_LAST} AS last FROM p)
    SELECT product_id, contains(u, 'farmina.com') AND contains(path, '/es/eshop/') AND regexp_matches(last, '^\d+-.+\.html$') AS farmina,
      contains(u, 'menforsan.com') AND contains(path, '/es/') AND NOT regexp_matches(path, '/(blog|tag|cart)/') AND regexp_matches(last, '^\d+-.+\.html$') AS menforsan,
      contains(h, 'inabafoods.com') AND length(path) - length(replace(path, '/', '')) >= 2 AS churu_us,
      contains(h, 'store.es.virbac.com') AND NOT regexp_matches(path, '/cart(/|$)') AND contains(trim(path, '/'), '/') AS virbac_store,
      contains(u, 'applaws.com/uk/products/') AND NOT contains(u, '/blog') AND length(path) > 13 AS applaws_uk,
      starts_with(u, 'https://www.mycalibra.es') AND starts_with(last, 'calibra') AND regexp_matches(path, '^/[^/]+$') AS calibra FROM l""",
)
def _(t):
    u = F.col("u")
    site = {**P.PRODUCT_URL_RULES["calibra"], "base": "https://www.mycalibra.es"}
    return B.products(t).select("product_id", F.expr(_PAGE).alias("u")).select(
        "product_id", *[P.is_product_url(u, r).alias(r) for r in ("farmina", "menforsan", "churu_us", "virbac_store", "applaws_uk")],
        P.is_product_url(u, site).alias("calibra"),
    )


_CDN = "CASE WHEN p_size > 45 THEN replace(photo, '/images/I/', '/images/I/play-icon-overlay-') ELSE photo END"


@query(
    "p10_marketplace_image",
    f"{PHOTOS}, x AS (SELECT product_id, {_CDN} AS u FROM photos) SELECT product_id, contains(u, 'media-amazon.com/images/I/') OR contains(u, 'images-amazon.com/images/I/') AS is_cdn, "
    f"{S.any_in('lower(u)', lx.MARKETPLACE_SPRITES)} AS is_sprite FROM x",
)
def _(t):
    u = F.expr(_CDN)
    return _photo(t).select("product_id", P.is_marketplace_image(u).alias("is_cdn"), P.is_marketplace_sprite(u).alias("is_sprite"))


@query(
    "p11_high_res",
    f"{WITH_IMAGES} SELECT image_id, coalesce(width >= 800 AND height >= 800, false) AS web, coalesce(width >= 450 AND height >= 450, false) AS supplier FROM images",
)
def _(t):
    w, h = F.col("width"), F.col("height")
    return B.images(t).select("image_id", P.high_res(w, h).alias("web"), P.high_res(w, h, 450).alias("supplier"))


@query(
    "p12_is_optimized",
    f"{WITH_IMAGES}, s AS (SELECT image_id, lower(split_part(src, '?', 1)) AS p, width, height FROM images) SELECT image_id, ends_with(p, '.webp') AND width = 2000 AND height = 2000 AS ok, "
    "string_split(p, '.')[-1] || ' ' || width || '×' || height AS description FROM s",
)
def _(t):
    args = F.col("src"), F.col("width"), F.col("height")
    return B.images(t).select("image_id", P.is_optimized(*args).alias("ok"), P.image_description(*args).alias("description"))


def image_issue_columns() -> tuple[str, str]:
    url_jpg = "(ends_with(lower(split_part(src, '?', 1)), '.jpg') OR ends_with(lower(split_part(src, '?', 1)), '.jpeg'))"
    size = "CASE WHEN width <> 2000 OR height <> 2000 THEN width || '×' || height || ' → 2000×2000' END"
    fmt = (
        f"CASE WHEN format <> 'JPEG' OR NOT {url_jpg} THEN 'URL=' || CASE WHEN {url_jpg} THEN 'jpg' ELSE 'png' END || "
        "' contenido=' || format || ' → .jpg' END"
    )
    return size, fmt


_SIZE, _FMT = image_issue_columns()


@query("p13_image_issues", f"{WITH_IMAGES} SELECT image_id, {_SIZE} AS size_issue, {_FMT} AS format_issue FROM images")
def _(t):
    m = P.image_issues(F.col("src"), F.col("width"), F.col("height"), F.col("format"))
    return B.images(t).select("image_id", m.alias("m")).select(
        "image_id", F.col("m")["tamaño"].alias("size_issue"), F.col("m")["formato"].alias("format_issue")
    )


# Cached resolutions sit among catalogue entries: no handle field, no shop URL.
_ENTRY = {
    "entry_id": "p_partkey", "handle": f"CASE WHEN p_size > 30 THEN NULL WHEN p_size > 28 THEN '' ELSE {B.HANDLE} END",
    "url": f"CASE WHEN p_type = 'SMALL' THEN 'https://maker.example.com/blog/' ELSE {B.SITE} || {B.HANDLE} END",
}


@query(
    "p14_real_catalog",
    f"WITH e AS (SELECT {B._sql(B._select(_ENTRY))} FROM part) SELECT entry_id, 'handle' AS rule FROM e WHERE coalesce(handle, '') <> '' "
    "UNION ALL SELECT entry_id, 'url' FROM e WHERE contains(coalesce(url, ''), '/eshop/')",
)
def _(t):
    e = B._view(t.part, _ENTRY)
    return filters.real_catalog(e).select("entry_id", F.lit("handle").alias("rule")).unionByName(
        filters.real_catalog(e, "/eshop/").select("entry_id", F.lit("url").alias("rule"))
    )
