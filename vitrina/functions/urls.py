"""URL functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def norm_url(url: Column) -> Column:
    """Comparison form: no scheme, ``www.``, query, fragment or trailing slash; lower case.
    Missing stays the empty string."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[#?].*$", "")
    u = F.regexp_replace(u, r"/+$", "")
    u = F.regexp_replace(u, r"(?i)^https?://", "")
    return F.lower(F.regexp_replace(u, r"(?i)^www\.", ""))


def host_of(url: Column) -> Column:
    """Network location, lower case, as written (``www.`` kept)."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)


def domain_of(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def on_domain(url: Column, domain: Column | str, strict: bool = False) -> Column:
    """Hit filter by domain: substring of the host, or (``strict``) the host itself
    or a subdomain of it."""
    host, want = host_of(url), (F.lit(domain) if isinstance(domain, str) else domain)
    if strict:
        return (domain_of(url) == want) | host.endswith(F.concat(F.lit("."), want))
    return host.contains(want)


# Which site a URL belongs to, first matching rule wins.
SITE_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "applaws": (("url:applaws.com", "uk"), ("", "es")),
    "churu": (("host:inabafoods-europe.com", "es"), ("host:inabafoods.com", "us"), ("", "es")),
    "virbac": (("host:vet-es.virbac.com", "vet"), ("", "store")),
    "calibra": (("domain:mycalibra.es", "es"), ("domain:mycalibra.eu", "eu"), ("domain:calibra.cat", "cat"), ("", "")),
}


def route_site(url: Column, rules: str | tuple[tuple[str, str], ...]) -> Column:
    """Site (profile variant) of a URL by the rules of a brand.

    A rule is ``("host:part", site)`` (host contains), ``("domain:name", site)`` (domain
    equals), ``("url:part", site)`` (URL contains) or ``("", default)``.
    """
    out = None
    for test, site in SITE_RULES[rules] if isinstance(rules, str) else rules:
        kind, _, value = test.partition(":")
        if not kind:
            return F.lit(site) if out is None else out.otherwise(site)
        hit = {
            "host": lambda: host_of(url).contains(value), "domain": lambda: domain_of(url) == value,
            "url": lambda: F.lower(url).contains(value),
        }[kind]()
        out = F.when(hit, site) if out is None else out.when(hit, site)
    return out


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(without_query(url), r"/+$", ""), "/", -1)


def strip_size_suffix(url: Column) -> Column:
    """``photo-300x300.jpg?x`` → ``photo.jpg``."""
    return F.regexp_replace(without_query(url), r"-\d+x\d+(\.[a-zA-Z]{3,4})$", "$1")


def upgrade_thumbnail(url: Column) -> Column:
    """Small shop thumbnails → the large rendition."""
    return F.regexp_replace(url, r"/(\d+)-(?:cart|small|medium|home|category)_default/", "/$1-large_default/")


def store_cdn_original(url: Column) -> Column:
    """Drop the store CDN's size suffix before the extension."""
    return F.regexp_replace(
        url,
        r"(?i)_(?:\d+x\d*|grande|large|medium|small|compact|pico|icon|thumb|original|master)"
        r"(\.(?:jpg|jpeg|png|webp|gif)\b)",
        "$1",
    )


def strip_size_token(url: Column) -> Column:
    """Marketplace size token removed → original resolution."""
    return F.regexp_replace(without_query(url), r"\._[A-Z0-9][A-Z0-9_,]*_\.", ".")


def marketplace_image_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"/images/I/([^./]+)", 1)
    return F.when(found != "", found).otherwise(url)


def marketplace_item_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/(?:dp|gp/product)/([A-Z0-9]{10})", 1)


def cdn_width(url: Column, width: int = 2000, quality: int | None = 100) -> Column:
    """Ask the image service for a width (and quality)."""
    return F.concat(without_query(url), F.lit(f"?sw={width}" + (f"&q={quality}" if quality else "")))


def request_width(url: Column, width: int = 2000) -> Column:
    """Remove ``_NNNx…`` and add ``w=`` unless the URL already carries a width."""
    u = F.regexp_replace(url, r"_\d+x(\d*)\.", ".")
    joiner = F.when(u.contains("?"), "&").otherwise("?")
    return F.when(u.contains("sw=") | u.contains("w="), u).otherwise(F.concat(u, joiner, F.lit(f"w={width}")))


def strip_width(url: Column) -> Column:
    """Remove ``_NNNx…`` and the query string."""
    return F.regexp_replace(F.regexp_replace(url, r"_\d+x\d*\.", "."), r"\?.*$", "")


_CACHE_URL = r"^(https?://[^/]+/media)/catalog/product/cache/[0-9a-f]+/(?:[^/]+/[^/]+/)?([^?]+)$"


def expand_cache_url(url: Column, full_size_hash: str) -> Column:
    """A resized cache URL → itself, the original's path, the full-size cache path.

    Returns ``array<string>`` in that order; other URLs return themselves.
    """
    clean = without_query(F.regexp_replace(url, r"-\d+x\d+\.", "."))
    base, name = F.regexp_extract(clean, _CACHE_URL, 1), F.regexp_extract(clean, _CACHE_URL, 2)
    is_cache = base != ""
    full = F.concat(
        base, F.lit(f"/catalog/product/cache/{full_size_hash}/"), F.lower(F.substring(name, 1, 1)), F.lit("/"),
        F.lower(F.substring(name, 2, 1)), F.lit("/"), name,
    )
    return F.array_distinct(
        F.array_compact(
            F.array(
                clean,
                F.when(is_cache, F.concat(base, F.lit("/wysiwyg/"), name)),
                F.when(is_cache & (F.length(name) >= 2), full),
            )
        )
    )


def slug_of(url: Column) -> Column:
    """Last path segment, percent-decoded; undecodable input is left as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return F.substring_index(without_query(F.regexp_replace(decoded, r"/+$", "")), "/", -1)


def name_from_slug(url: Column) -> Column:
    """Readable name from a product slug: ``484-pollo-lata-.html`` → ``pollo lata``."""
    seg = F.regexp_replace(slug_of(url), r"(?i)\.html?$", "")
    seg = F.regexp_replace(seg, r"^\d+[-_]", "")
    return F.trim(F.regexp_replace(seg, r"[-_]+", " "))


def handle_of(url: Column, marker: str = "/products/") -> Column:
    tail = F.substring_index(F.regexp_replace(url, r"/+$", ""), marker, -1)
    return F.substring_index(F.substring_index(tail, "/", 1), "?", 1)


def canonical_handle(handle: Column) -> Column:
    """Handle without the numeric suffix stores add to duplicates."""
    return F.regexp_replace(handle, r"-\d+$", "")


def has_numeric_suffix(handle: Column) -> Column:
    return handle.rlike(r"-\d+$")


def image_extension(url: Column, allow_gif: bool = False) -> Column:
    """``jpeg`` → ``jpg``; unknown → ``jpg``."""
    ext = F.lower(F.substring_index(without_query(url), ".", -1))
    known = ["jpg", "png", "webp"] + (["gif"] if allow_gif else [])
    return F.when(ext.isin(known), ext).otherwise("jpg")


def supplier_image_urls(reference: Column, ean: Column, base: str) -> Column:
    """Canonical supplier pictures: folder = first character, by reference then EAN."""

    def one(key: Column) -> Column:
        return F.when(
            F.coalesce(key, F.lit("")) != "",
            F.concat(F.lit(f"{base}/"), F.lower(F.substring(key, 1, 1)), F.lit("/"), key, F.lit(".webp")),
        )

    return F.array_distinct(F.array_compact(F.array(one(reference), one(ean))))


def admin_link(product_id: Column, shop_domain: str) -> Column:
    store = shop_domain.split(".")[0]
    return F.concat(F.lit(f"https://admin.shopify.com/store/{store}/products/"), product_id.cast("string"))


def backup_file_name(src: Column, product_id: Column, index: Column, vendor_slug: Column) -> Column:
    """Upload name of a backed-up image: source stem without trailing UUID, id, index."""
    leaf = F.substring_index(without_query(src), "/", -1)
    stem = F.regexp_replace(leaf, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "")
    lead = F.when(stem != "", stem).otherwise(vendor_slug)
    return F.concat(lead, F.lit("_"), product_id.cast("string"), F.lit("_"), index.cast("string"), F.lit(".webp"))


def output_image_name(title_slug: Column, position: Column) -> Column:
    return F.concat(title_slug, F.lit("_"), position.cast("string"), F.lit(".webp"))


def absolutize(href: Column, base: Column, page_url: Column | None = None) -> Column:
    """Absolute form of ``href``; other relative forms are joined to the page URL when
    one is given, else dropped (empty)."""
    rest = F.lit("")
    if page_url is not None:
        folder = F.regexp_replace(without_query(F.regexp_replace(page_url, "#.*$", "")), r"[^/]*$", "")
        rest = F.when(F.coalesce(href, F.lit("")) != "", F.concat(folder, href)).otherwise("")
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.regexp_replace(base, r"/+$", ""), href))
        .otherwise(rest)
    )


def base_of(url: Column) -> Column:
    """Scheme and host of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
