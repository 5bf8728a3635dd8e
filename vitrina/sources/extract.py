"""Extractors over fetched documents.

``docs``: ``url string, body string``; ``pages``: ``page_id, url, html``.  Each
extractor works on one document at a time with built-in expressions, so it needs
no shuffle except where a result is de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions import predicates as P
from vitrina.functions import text as T
from vitrina.functions import urls as U
from vitrina.session import cut_lineage


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# --- sitemaps ----------------------------------------------------------------

def locs(body: Column) -> Column:
    """Every ``<loc>`` of a sitemap text, trimmed."""
    return _all(body, r"(?is)<loc>\s*(.*?)\s*</loc>")


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """``url, pos, loc``."""
    return docs.select("url", F.posexplode(locs(F.col("body"))).alias("pos", "loc"))


def product_sitemap(docs: DataFrame) -> DataFrame:
    """Product blocks of store sitemaps: ``url, pos, handle, title, image``."""
    block = F.col("block")
    loc = F.trim(F.regexp_extract(block, r"(?i)<loc>\s*([^<]+?)\s*</loc>", 1))
    title = F.trim(
        F.regexp_extract(block, r"(?is)<image:title>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</image:title>", 1)
    )
    image = F.regexp_extract(block, r"(?i)<image:loc>\s*([^<]+?)\s*</image:loc>", 1)
    return (
        docs.select("url", F.posexplode(_all(F.col("body"), r"(?is)<url>(.*?)</url>")).alias("pos", "block"))
        .withColumn("loc", loc).where(F.col("loc").contains("/products/"))
        .select("url", "pos", U.handle_of(F.col("loc")).alias("handle"), title.alias("title"), image.alias("image"))
        .where(F.col("handle") != "")
    )


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """Sitemaps a robots file declares: ``url, pos, sitemap``."""
    line = F.col("line")
    return (
        docs.select("url", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
        .where(F.lower(line).startswith("sitemap:"))
        .select("url", "pos", F.trim(F.regexp_replace(line, r"(?i)^sitemap:", "")).alias("sitemap"))
    )


def sitemap_closure(docs: DataFrame, roots: DataFrame, product_rule: str | dict, max_depth: int = 3) -> DataFrame:
    """Product URLs reachable from the root sitemaps, breadth first: ``url, depth``.

    ``roots``: ``url``.  A location is another sitemap when it ends in ``.xml`` or its
    last segment mentions one; each sitemap is read once.  The frontier is cut loose
    after every level (at most ``max_depth``), so levels are not recomputed.
    """
    bodies = docs.select("url", "body")
    frontier = cut_lineage(roots.select("url").distinct())
    visited, found = frontier, None
    for depth in range(1, max_depth + 1):
        out = frontier.join(bodies, "url").select(F.explode(locs(F.col("body"))).alias("loc"))
        low = F.lower("loc")
        is_map = low.endswith(".xml") | F.substring_index(low, "/", -1).contains("sitemap")
        out = out.select("loc", is_map.alias("is_map"))
        product = out.where(~F.col("is_map")).select(U.without_query(F.col("loc")).alias("url"), F.lit(depth).alias("depth"))
        product = product.where(P.is_product_url(F.col("url"), product_rule))
        found = product if found is None else found.unionByName(product)
        if depth == max_depth:
            break
        maps = out.where("is_map").select(F.col("loc").alias("url")).distinct()
        frontier = cut_lineage(maps.join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return found.groupBy("url").agg(F.min("depth").alias("depth"))


# --- pages -------------------------------------------------------------------

def tag_attribute(tag: Column, name: str) -> Column:
    """Attribute of one HTML tag; empty when absent."""
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def meta_content(html: Column, name: str) -> Column:
    """``content`` of the first meta tag with that property or name."""
    tag = F.regexp_extract(html, rf"""(?i)<meta[^>]*(?:property|name)\s*=\s*["']{name}["'][^>]*>""", 0)
    return tag_attribute(tag, "content")


def _inner_text(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, r"<[^>]*>", ""), r"\s+", " "))


def page_name(html: Column) -> Column:
    """First non-empty of the og:title, a product heading, any first heading."""
    product_h1 = r"""(?is)<h1[^>]*class\s*=\s*["'][^"']*(?:product[_-]title|product-name|entry-title)[^"']*["'][^>]*>(.*?)</h1>"""
    return F.coalesce(
        F.nullif(F.trim(meta_content(html, "og:title")), F.lit("")),
        F.nullif(_inner_text(F.regexp_extract(html, product_h1, 1)), F.lit("")),
        F.nullif(_inner_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")),
        F.lit(""),
    )


def ld_items(script: Column) -> Column:
    """Items of a JSON-LD document (``@graph``, list or single) as ``array<variant>``."""
    v = F.try_parse_json(script)
    return F.coalesce(
        F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v)
    )


def ld_images(item: Column, key: str = "image") -> Column:
    """Image URLs of a JSON-LD item: string, list, or object with ``url``/``contentUrl``."""
    image = F.try_variant_get(item, f"$.{key}", "variant")
    many = F.coalesce(F.try_variant_get(image, "$", "array<variant>"), F.array(image))

    def one(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        named = F.coalesce(
            F.nullif(F.try_variant_get(x, "$.url", "string"), F.lit("")), F.try_variant_get(x, "$.contentUrl", "string")
        )
        return F.when(F.schema_of_variant(x) == "STRING", text).otherwise(named)

    return F.filter(F.transform(many, one), lambda u: _filled(u))


def jsonld_images(docs: DataFrame, keys: tuple[str, ...] = ("image",), column: str = "html", id_column: str = "page_id") -> DataFrame:
    """``page_id, pos, image`` in document order (``keys`` may add thumbnail and logo)."""
    scripts = _all(F.col(column), r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
    items = F.flatten(F.transform(scripts, ld_items))
    images = F.flatten(F.transform(items, lambda it: F.flatten(F.array(*[ld_images(it, k) for k in keys]))))
    return docs.select(id_column, F.posexplode(images).alias("pos", "image"))


#: Image attributes of an ``<img>`` tag after ``srcset``, in order of preference.
#: Fixed values.
IMG_ATTRIBUTES = ("data-src", "data-lazy-src", "data-large_image", "data-zoom-image", "data-full-url", "src")


def img_tag_images(html: Column) -> Column:
    """Candidate URLs of all ``<img>`` tags outside navigation, header and footer."""
    body = html
    for part in ("nav", "header", "footer"):
        body = F.regexp_replace(body, rf"(?is)<{part}\b.*?</{part}>", "")

    def one(tag: Column) -> Column:
        srcset = tag_attribute(tag, "srcset")
        last = F.substring_index(F.trim(F.regexp_extract(srcset, r"([^,\s][^,]*)[,\s]*$", 1)), " ", 1)
        return F.array(last, *[tag_attribute(tag, a) for a in IMG_ATTRIBUTES])

    return F.filter(F.flatten(F.transform(_all(body, r"(?is)<img\b[^>]*>", 0), one)), lambda u: u != "")


def page_images(pages: DataFrame, profile: str) -> DataFrame:
    """Product images of a page: ``page_id, source_rank, pos, image``.

    Precedence meta tags → JSON-LD → ``<img>``; absolute, not blacklisted, first
    occurrence of each picture (thumbnail suffix ignored).
    """
    html = F.col("html")
    metas = F.array(*[meta_content(html, m) for m in ("og:image", "og:image:secure_url", "twitter:image")])
    scripts = _all(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
    from_ld = F.flatten(F.transform(F.flatten(F.transform(scripts, ld_items)), lambda it: ld_images(it)))

    def ranked(urls: Column, rank: int) -> Column:
        return F.transform(
            urls, lambda u, i: F.struct(F.lit(rank).alias("source_rank"), i.alias("pos"), u.alias("raw"))
        )

    every = F.concat(ranked(metas, 1), ranked(from_ld, 2), ranked(img_tag_images(html), 3))
    image = U.absolutize(F.col("c.raw"), U.base_of(F.col("url")), F.col("url"))
    rows = (
        pages.select("page_id", "url", F.explode(every).alias("c"))
        .where((F.col("c.raw") != "") & ~F.col("c.raw").startswith("data:"))
        .select("page_id", "c.source_rank", "c.pos", image.alias("image"))
        .where(F.col("image").startswith("http") & P.keep_image_url(F.col("image"), profile))
    )
    return (
        rows.groupBy("page_id", U.strip_size_suffix(F.col("image")).alias("clean"))
        .agg(F.min(F.struct("source_rank", "pos", "image")).alias("w"))
        .select("page_id", "w.source_rank", "w.pos", "w.image")
    )


#: Attributes that hold the large version of a picture.
ZOOM_ATTRIBUTES = ("data-zoom-image", "data-zoom", "data-large", "data-image", "data-big", "href")


def zoom_images(html: Column) -> Column:
    """Image URLs in zoom attributes, in the order of the attributes."""
    found = [_all(html, rf"""(?i)\s{a}\s*=\s*["']([^"']+\.(?:jpg|jpeg|png|webp)[^"']*)["']""") for a in ZOOM_ATTRIBUTES]
    return F.array_distinct(F.concat(*found))


def background_images(html: Column, max_length: int | None = None) -> Column:
    """Pictures in inline ``url(…)`` styles, then raw image URLs anywhere in the text.

    ``max_length``: longer URLs are left out, as some sites' rules ask; none by default.
    """
    styled = _all(html, r"""url\(["']?([^"')\s]+)["']?\)""")
    raw = _all(html, r"""(https?://[^\s"'<>()\\]+\.(?:jpg|jpeg|png|webp)[^\s"'<>()\\]*)""")
    raw = F.transform(raw, lambda u: F.regexp_replace(u, r"[\\,;]+$", ""))
    every = F.concat(styled, raw)
    return F.array_distinct(every if max_length is None else F.filter(every, lambda u: F.length(u) < max_length))


def category_listing(docs: DataFrame, base: str, photo_marker: str = "fotoprodotti") -> DataFrame:
    """Products of a category page: ``species, id, slug, name, url, image_url``.

    ``docs``: ``species, doc_order, body``.  Boxes without product link or product
    photo are skipped; the first box of each (species, id) counts.
    """
    boxes = F.split("body", r"""(?i)<div(?=[^>]*\bclass=["']hoverbox["'])""")
    box = F.col("box")
    link = F.regexp_extract(box, r"location\.href='([^']+)'", 1)
    item, slug = F.regexp_extract(link, r"/(\d+)-([^/]+)\.html", 1), F.regexp_extract(link, r"/(\d+)-([^/]+)\.html", 2)
    name = F.trim(F.regexp_extract(box, r"""(?is)class=["']es-product-line-title["'][^>]*>(.*?)</div>""", 1))
    src = tag_attribute(F.regexp_extract(box, r"(?is)<img\b[^>]*>", 0), "src")
    image = F.when(src.startswith("http"), src).otherwise(F.concat(F.lit(base), src))
    first = (
        docs.select("species", "doc_order", F.posexplode(boxes).alias("pos", "box"))
        .where("pos > 0")
        .select("species", "doc_order", "pos", item.alias("id"), slug.alias("slug"), link.alias("url"),
                F.coalesce(F.nullif(name, F.lit("")), F.replace(slug, F.lit("-"), F.lit(" "))).alias("name"),
                image.alias("image_url"))
        .where(F.col("id") != "")
        .groupBy("species", "id")
        .agg(F.min(F.struct("doc_order", "pos", "slug", "name", "url", "image_url")).alias("w"))
    )
    return first.select("species", "id", "w.slug", "w.name", "w.url", "w.image_url").where(
        F.col("image_url").contains(photo_marker)
    )


def hrefs(html: Column) -> Column:
    return _all(html, r"""(?is)<a\b[^>]*\shref\s*=\s*["']([^"']*)["']""")


def harvest_links(pages: DataFrame, must=(), must_not=(), require_html: bool = False, min_segments: int = 3,
                  base: Column | None = None) -> DataFrame:
    """Links of a page that look like products: ``page_id, link`` distinct.

    Absolute links must stay on the page's own site (or ``base``); segments are
    counted over the whole URL, scheme and host included; the query is dropped.
    """
    site = U.base_of(F.col("url")) if base is None else base
    full = F.when(F.col("href").startswith("/"), F.concat("site", "href")).when(
        F.col("href").startswith("http"), F.col("href")
    )
    link = U.without_query(F.col("full"))
    path = U.without_query(F.regexp_replace("full", r"/+$", ""))
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    rows = (
        pages.select("page_id", site.alias("site"), F.explode(hrefs(F.col("html"))).alias("href"))
        .withColumn("full", full)
        .where(F.col("full").isNotNull() & F.col("full").startswith(F.col("site")))
        .where(segments >= min_segments)
    )
    if require_html:
        rows = rows.where(link.endswith(".html"))
    if must_not:
        rows = rows.where(~T.contains_any(F.col("full"), must_not))
    if must:
        rows = rows.where(T.contains_any(F.col("full"), must))
    return rows.select("page_id", link.alias("link")).distinct()


def search_result_links(docs: DataFrame, base: str) -> DataFrame:
    """Links of a search response: ``doc_id, pos, link``.

    Results are under ``results``, ``hits`` or ``data.results``; each names its link
    ``link``, ``url`` or ``href``.  Fragments are dropped, first occurrence kept.
    """
    v = F.try_parse_json("body")
    results = F.coalesce(
        F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$.hits", "array<variant>"),
        F.try_variant_get(v, "$.data.results", "array<variant>"),
    )
    named = F.coalesce(*[F.nullif(F.try_variant_get(F.col("r"), f"$.{k}", "string"), F.lit("")) for k in ("link", "url", "href")])
    raw = F.substring_index(named, "#", 1)
    link = (
        F.when(raw.startswith("http"), raw).when(raw.startswith("/"), F.concat(F.lit(base.rstrip("/")), raw))
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw))
    )
    return (
        docs.select("doc_id", F.posexplode(results).alias("pos", "r"))
        .select("doc_id", "pos", link.alias("link")).where(F.col("link").isNotNull())
        .groupBy("doc_id", "link").agg(F.min("pos").alias("pos"))
    )


def gallery_details(docs: DataFrame) -> DataFrame:
    """Marketplace gallery documents: ``doc_id, pos, image``.

    ``body`` holds ``{"colorImages": [{hiRes, large, mainUrl}…], "dynamic": [{url: [w, h]}…]}``:
    the best named rendition of each entry, then the largest of each size map.
    """
    parsed = F.from_json(
        "body",
        "struct<colorImages:array<struct<hiRes:string,large:string,mainUrl:string>>,dynamic:array<map<string,array<int>>>>",
    )
    named = F.transform(
        F.coalesce(parsed["colorImages"], F.array().cast("array<struct<hiRes:string,large:string,mainUrl:string>>")),
        lambda i: F.coalesce(F.nullif(i["hiRes"], F.lit("")), F.nullif(i["large"], F.lit("")), F.nullif(i["mainUrl"], F.lit(""))),
    )
    largest = F.transform(
        F.coalesce(parsed["dynamic"], F.array().cast("array<map<string,array<int>>>")),
        lambda m: F.array_max(
            F.transform(F.map_entries(m), lambda e: F.struct((e["value"][0] * e["value"][1]).alias("px"), e["key"].alias("u")))
        )["u"],
    )
    urls = F.transform(F.filter(F.concat(named, largest), lambda u: _filled(u) & P.is_marketplace_image(u) & ~P.is_marketplace_sprite(u)),
                       lambda u: U.strip_size_token(u))
    return (
        docs.select("doc_id", F.posexplode(urls).alias("pos", "image"))
        .groupBy("doc_id", U.marketplace_image_id(F.col("image")).alias("image_id"))
        .agg(F.min(F.struct("pos", "image")).alias("w"))
        .select("doc_id", "w.pos", "w.image")
    )
