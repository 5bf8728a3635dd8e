"""Predicates on image URLs, product URLs and image facts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import urls as U


def _strip(char: str, text: Column) -> Column:
    return F.trim(text, F.lit(char))


def _any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


def keep_image_url(url: Column, profile: str) -> Column:
    """False for logos, icons, placeholders and the like."""
    keep = ~F.lower(url).rlike(_any_of(lx.IMAGE_BLACKLIST[profile]))
    if profile == "artero":
        name = F.lower(F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.[^.]*$", ""))
        keep = keep & ~name.rlike("[0-9a-f]{40,}") & ~name.rlike(r"-d_\d+x\d+$")
    return keep


# What a product page looks like, per site.
PRODUCT_URL_RULES = {
    "farmina": {"contains": "farmina.com", "path_contains": "/es/eshop/", "last": r"(?i)^\d+-.+\.html$"},
    "menforsan": {
        "contains": "menforsan.com", "path_contains": "/es/", "last": r"(?i)^\d+-.+\.html$",
        "path_not": r"(?i)/(categoria|category|tag|etiqueta|tienda|shop|cart|checkout|mi-cuenta|my-account|blog"
                    r"|noticias|contacto|contact|sobre-nosotros|quienes-somos)/",
    },
    "churu_es": {"host": "inabafoods-europe.com", "path_contains": "item.php"},
    "churu_us": {
        "host": "inabafoods.com", "min_slashes": 2,
        "path_not": r"(?i)^/(cats|dogs|contact|about|shop|cart|account|search|news|blog)?/*$",
    },
    "virbac_vet": {"host": "vet-es.virbac.com", "path_contains": "/home/productos/", "last": r"(?i)\.html$"},
    "virbac_store": {
        "host": "store.es.virbac.com", "min_inner_slashes": 1,
        "path_not": r"(?i)/(carrito|cart|checkout|mi-cuenta|my-account|tienda|shop|blog|noticias|contacto|contact"
                    r"|sobre-nosotros|legal|privacidad|cookies|producto-categoria|product-category)(/|$)",
    },
    "applaws_es": {"host_path": "applaws.pet/producto/"},
    "applaws_uk": {"host_path": "applaws.com/uk/products/"},
    "calibra": {
        "one_segment": True, "last": r"^calibra",
        "last_not": r"^(comida-para-perros|comida-para-gatos|productos|food-for-dogs|food-for-cats|products"
                    r"|product-lines|dry-food|wet-food|treats|dental|veterinary|dietas-veterinarias|our-story"
                    r"|junior|senior|news|blog|contact|donde-comprar|where-to-buy|legal|privacy|cookies)$",
    },
}
#: Fixed values.
NON_PRODUCT_UK = (
    r"/blog|/news|/pages|/page/|/cart|/checkout|/account|/category|/product-category|/brand|/where-to-buy"
    r"|/stockist|/contact|/about|/faq|/privacy|/terms|/recipes|/tag/|/collections|/collection/|/policies|/search"
)


def is_product_url(url: Column, rule: str | dict) -> Column:
    """Does the URL look like a single product page of the site ``rule`` describes?"""
    r = PRODUCT_URL_RULES[rule] if isinstance(rule, str) else rule
    path = U.path_of(url)
    trimmed = F.regexp_replace(path, r"/+$", "")
    last = F.substring_index(trimmed, "/", -1)
    tests = []
    if "base" in r:
        tests.append(url.startswith(r["base"]))
    if "contains" in r:
        tests.append(url.contains(r["contains"]))
    if "host" in r:
        tests.append(U.host_of(url).contains(r["host"]))
    if "path_contains" in r:
        tests.append(path.contains(r["path_contains"]))
    if "path_not" in r:
        tests.append(~path.rlike(r["path_not"]))
    if "min_slashes" in r:
        tests.append(F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/"), F.lit(""))) >= r["min_slashes"])
    if "min_inner_slashes" in r:
        inner = _strip("/", path)
        tests.append(F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit(""))) >= r["min_inner_slashes"])
    if r.get("one_segment"):
        tests.append(trimmed.rlike(r"^/+[^/]+$"))
    if "last" in r:
        tests.append(last.rlike(r["last"]))
    if "last_not" in r:
        tests.append(~last.rlike(r["last_not"]))
    if "host_path" in r:
        low = F.lower(url)
        tail = _strip("/", F.substring_index(low, r["host_path"], -1))
        tests += [low.contains(r["host_path"]), ~low.rlike(NON_PRODUCT_UK), F.length(tail) > 0]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def is_marketplace_image(url: Column) -> Column:
    return url.contains("media-amazon.com/images/I/") | url.contains("images-amazon.com/images/I/")


def is_marketplace_sprite(url: Column) -> Column:
    return F.lower(url).rlike(_any_of(lx.MARKETPLACE_SPRITES))


def high_res(width: Column, height: Column, min_dim: int = 800) -> Column:
    """Both sides at least ``min_dim``; unknown size is not high resolution."""
    return F.coalesce((width >= min_dim) & (height >= min_dim), F.lit(False))


def is_optimized(src: Column, width: Column, height: Column, target: int = 2000) -> Column:
    path = F.lower(U.without_query(F.coalesce(src, F.lit(""))))
    return path.endswith(".webp") & F.coalesce((width == target) & (height == target), F.lit(False))


def image_description(src: Column, width: Column, height: Column) -> Column:
    path = F.lower(U.without_query(F.coalesce(src, F.lit(""))))
    leaf = F.substring_index(path, "/", -1)
    fmt = F.when(leaf.contains("."), F.substring_index(path, ".", -1)).otherwise("?")
    zero = F.lit(0)
    return F.concat(
        fmt, F.lit(" "), F.coalesce(width, zero).cast("string"), F.lit("×"), F.coalesce(height, zero).cast("string")
    )


def image_issues(url: Column, width: Column, height: Column, fmt: Column, target: int = 2000) -> Column:
    """``map<string,string>`` of what keeps an image from the standard."""
    path = F.lower(U.without_query(url))
    url_jpg = path.endswith(".jpg") | path.endswith(".jpeg")
    is_jpeg = fmt == "JPEG"
    size_issue = F.when(
        (width != target) | (height != target),
        F.struct(
            F.lit("tamaño").alias("key"),
            F.concat(width.cast("string"), F.lit("×"), height.cast("string"), F.lit(f" → {target}×{target}")).alias("value"),
        ),
    )
    format_issue = F.when(
        ~is_jpeg | ~url_jpg,
        F.struct(
            F.lit("formato").alias("key"),
            F.concat(
                F.lit("URL="), F.when(url_jpg, "jpg").otherwise("png"), F.lit(" contenido="), fmt, F.lit(" → .jpg")
            ).alias("value"),
        ),
    )
    return F.map_from_entries(F.array_compact(F.array(size_issue, format_issue)))
