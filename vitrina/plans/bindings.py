"""Views that dress the generic test tables as catalogue data.

Each view is one set of SQL expressions valid in both engines: Spark evaluates them
with ``selectExpr``, the oracle embeds them as a CTE.  Every view is derived from
whole tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.plans.registry import Tables


def _case(x: str, words: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


ADJECTIVE = "split_part(p_name, ' ', 1)"
NOUN = "split_part(p_name, ' ', 2)"

# Shop titles are Spanish, maker catalogues English.
ADJ_ES = dict(blue="PERRO", cold="GATO", hot="DOG", large="CAT", new="CACHORRO", old="SENIOR", red="ADULTO", small="GATITO")
ADJ_EN = dict(blue="Dog", cold="Cat", hot="Canine", large="Feline", new="Puppy", old="Senior", red="Adult", small="Kitten")
NOUN_ES = dict(anvil="POLLO", bolt="SALMÓN", gear="CORDERO", gizmo="PATO", plate="ATÚN", ring="TERNERA", rod="PAVO", widget="CONEJO")
NOUN_EN = dict(anvil="Chicken", bolt="Salmon", gear="Lamb", gizmo="Duck", plate="Tuna", ring="Beef", rod="Turkey", widget="Rabbit")
TYPE_ES = dict(ECONOMY="LATA", LARGE="MAXI", MEDIUM="SNACKS", PROMO="CAJA", SMALL="MINI", STANDARD="SEMI-HÚMEDO")
TYPE_EN = dict(ECONOMY="Can", LARGE="Large", MEDIUM="Snack", PROMO="Wet Pouch", SMALL="Small", STANDARD="Semi Moist")

SIZE_LABEL = (
    "CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN '6X' || cast(p_size as string) || 'GR' "
    "WHEN p_size > 25 THEN cast(p_size as string) || ' KG' ELSE cast(p_size as string) || ',5KG' END"
)
MARK = "CASE WHEN p_size > 40 THEN ' (NDR)' WHEN p_size < 6 THEN ' *DX*' ELSE '' END"
TITLE = (
    f"upper(p_brand) || ' ' || {_case(ADJECTIVE, ADJ_ES)} || ' ' || {_case('p_type', TYPE_ES)} || ' ' || "
    f"{_case(NOUN, NOUN_ES)} || ' ' || {SIZE_LABEL} || {MARK}"
)
CATALOG_NAME = f"{_case(ADJECTIVE, ADJ_EN)} || ' ' || {_case('p_type', TYPE_EN)} || ' with ' || {_case(NOUN, NOUN_EN)}"
HANDLE = f"replace(lower({CATALOG_NAME}), ' ', '-')"
SITE = "'https://www.maker.example.com/es/eshop/'"

PRODUCT_COLUMNS = {
    "product_id": "p_partkey",
    "vendor": "p_brand",
    "title": TITLE,
    "handle": HANDLE,
    "barcode": "CASE WHEN p_size < 10 THEN '' ELSE lpad(cast(p_partkey as string), 13, '0') END",
    "sku": "'SKU' || cast(p_partkey as string)",
    "price": "p_retailprice",
    "p_size": "p_size",
    "p_name": "p_name",
    "p_type": "p_type",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _sql(text: str) -> str:
    """Spark's ``string`` type is DuckDB's ``varchar``."""
    return text.replace("as string)", "as varchar)")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


# products: one row per part
PRODUCTS = f"products AS (SELECT {_sql(_select(PRODUCT_COLUMNS))} FROM part)"


def products(t: Tables) -> DataFrame:
    return _view(t.part, PRODUCT_COLUMNS)


# catalog: one row per distinct (name, type); ord = first part
_CATALOG_OUT = {
    "handle": HANDLE, "ord": "ord", "name": CATALOG_NAME, "url": f"{SITE} || {HANDLE} || '.html'",
    "vendor": "vendor", "product_type": "p_type", "p_name": "p_name",
}
CATALOG = (
    f"catalog AS (SELECT {_sql(_select(_CATALOG_OUT))} FROM (SELECT p_name, p_type, min(p_partkey) AS ord, "
    "min(p_brand) AS vendor FROM part GROUP BY p_name, p_type) g)"
)


def catalog(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_name", "p_type").agg({"p_partkey": "min", "p_brand": "min"}).selectExpr(
        "p_name", "p_type", "`min(p_partkey)` AS ord", "`min(p_brand)` AS vendor"
    )
    return _view(g, _CATALOG_OUT)


# images: one row per line item; product = part
IMAGE_COLUMNS = {
    "product_id": "l_partkey",
    "image_id": "(l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey",
    "src": "'https://cdn.example.com/files/img_' || cast(l_orderkey as string) || '_' || cast(l_suppkey as string) || "
           "CASE WHEN l_returnflag = 'A' THEN '.webp' WHEN l_returnflag = 'N' THEN '.jpg' ELSE '.png' END || '?v=' || "
           "cast(l_linenumber as string)",
    "alt": "CASE WHEN l_linestatus = 'F' THEN '' ELSE 'foto ' || cast(l_suppkey as string) END",
    "position": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END",
    "width": "CASE WHEN l_quantity > 30 THEN 2000 ELSE cast(l_quantity * 50 as int) END",
    "height": "CASE WHEN l_quantity > 20 THEN 2000 ELSE cast(l_quantity * 60 as int) END",
    "format": "CASE WHEN l_returnflag = 'R' THEN 'PNG' ELSE 'JPEG' END",
}
IMAGES = f"images AS (SELECT {_sql(_select(IMAGE_COLUMNS))} FROM lineitem)"


def images(t: Tables) -> DataFrame:
    return _view(t.lineitem, IMAGE_COLUMNS)


# hits: a line item is a search hit for part l_partkey; the page found is part l_suppkey
def hit_url(handle: str, line: str = "l_linenumber") -> str:
    return (f"'https://www.maker.example.com/products/' || {handle} || CASE WHEN {line} = 3 THEN '-2' ELSE '' END || "
            f"CASE WHEN {line} > 5 THEN '#top' ELSE '' END")


_HIT_OUT = {
    "product_id": "l_partkey",
    "rank": "(l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey",
    "query_rank": "CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END",
    "url": hit_url(HANDLE),
    "name": CATALOG_NAME,
    "spanish": f"{_case(ADJECTIVE, ADJ_ES)} || ' ' || {_case('p_type', TYPE_ES)} || ' ' || {_case(NOUN, NOUN_ES)}",
    "host": "CASE WHEN l_linenumber = 4 THEN 'other.example.net' ELSE 'www.maker.example.com' END",
    "cand_id": "l_suppkey",
    "line": "l_linenumber",
}
HITS = f"hits AS (SELECT {_sql(_select(_HIT_OUT))} FROM lineitem JOIN part ON p_partkey = l_suppkey)"


# What a page says is worked out once per page, not for each hit of it.
_PAGE = {"page_handle": HANDLE, "page_name": CATALOG_NAME}


def hits(t: Tables) -> DataFrame:
    pages = _view(t.part, {"l_suppkey": "p_partkey", **_PAGE, "page_spanish": _HIT_OUT["spanish"]})
    of_page = {"url": hit_url("page_handle"), "name": "page_name", "spanish": "page_spanish"}
    return _view(t.lineitem.join(pages, "l_suppkey"), {**_HIT_OUT, **of_page})


def hits_of_pages(t: Tables, pages: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns computed once per page: ``pages`` is keyed ``cand_id``.

    Tokens and the like belong to the page, not to each hit of it.
    """
    pages = pages.withColumnRenamed("cand_id", "l_suppkey")
    plain = {n: e for n, e in _HIT_OUT.items() if n in ("product_id", "rank", "query_rank", "line")}
    keep = [c for c in pages.columns if c != "l_suppkey"]
    return t.lineitem.join(pages, "l_suppkey").selectExpr(
        *[f"{e} AS {n}" for n, e in plain.items()], "l_suppkey AS cand_id", *keep, *columns)


# features: embedding vectors as photos (label = catalogue/product bucket)
def vector_feature(column: str = "embedding") -> str:
    return f"named_struct('b', 'clip', 'vec', {column}, 'hash', cast(null as array<bigint>))"


# writes: an event is a write of a product's URL
WRITE_COLUMNS = {
    "product_id": "user_id",
    "seq": "event_id",
    "url": "CASE WHEN event_type = 'error' THEN '' ELSE 'https://www.maker.example.com/p/' || "
           "CASE WHEN value < 20 THEN 'a' WHEN value < 60 THEN 'b' ELSE event_type END END",
    "url_key": "CASE WHEN event_type = 'signup' THEN 'url_fabricante_2' ELSE 'url_fabricante' END",
    "workflow": "event_type",
}
WRITES = f"writes AS (SELECT {_sql(_select(WRITE_COLUMNS))} FROM events)"


def writes(t: Tables) -> DataFrame:
    return _view(t.events, WRITE_COLUMNS)


# product groups: parts of one brand and name are variants of one product
GROUPED = (
    "grouped AS (SELECT p_brand, p_name, min(p_partkey) AS product_id FROM part GROUP BY p_brand, p_name), "
    "gproducts AS (SELECT product_id, upper(p_brand || ' ' || p_name) AS title, p_brand AS vendor, "
    "'Peso' AS option_name FROM grouped), "
    "gvariants AS (SELECT g.product_id, p.p_partkey AS variant_id, cast(p.p_size as varchar) || 'KG' AS option1, "
    "cast(cast(p.p_retailprice as decimal(10,2)) as varchar) AS price, 'SKU' || cast(p.p_partkey as varchar) AS sku, "
    "lpad(cast(p.p_partkey as varchar), 13, '0') AS barcode, p.p_partkey AS ord FROM part p "
    "JOIN grouped g ON g.p_brand = p.p_brand AND g.p_name = p.p_name)"
)


def grouped_products(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand", "p_name").agg({"p_partkey": "min"}).withColumnRenamed("min(p_partkey)", "product_id")
    return g.selectExpr("product_id", "upper(p_brand || ' ' || p_name) AS title", "p_brand AS vendor", "'Peso' AS option_name",
                        "p_brand", "p_name")


def grouped_variants(t: Tables) -> DataFrame:
    g = grouped_products(t).select("product_id", "p_brand", "p_name")
    return t.part.join(g, ["p_brand", "p_name"]).selectExpr(
        "product_id", "p_partkey AS variant_id", "cast(p_size as string) || 'KG' AS option1",
        "cast(cast(p_retailprice as decimal(10,2)) as string) AS price", "'SKU' || cast(p_partkey as string) AS sku",
        "lpad(cast(p_partkey as string), 13, '0') AS barcode", "p_partkey AS ord",
        "cast(p_size as double) AS weight", "CASE WHEN p_size > 25 THEN 'kg' ELSE '' END AS weight_unit",
    )


# raw: plain names, one language; promotional entries share few distinct names
RAW_COLUMNS = {
    "product_id": "p_partkey",
    "title": "p_brand || ' ' || p_name || ' ' || lower(p_type) || ' ' || cast(p_size as string) || 'KG'",
    "vendor": "p_brand",
}
_RAW_CATALOG_OUT = {
    "handle": "replace(p_name || ' ' || lower(p_type), ' ', '-')",
    "ord": "ord",
    "name": f"CASE WHEN p_type = 'PROMO' THEN 'assorted ' || {NOUN} ELSE p_name || ' ' || lower(p_type) END",
    "brand": "CASE WHEN p_type = 'SMALL' THEN '' WHEN p_type = 'LARGE' THEN 'first' WHEN p_type = 'PROMO' THEN 'teens' ELSE 'rest' END",
}
RAW = (
    f"rawp AS (SELECT {_sql(_select(RAW_COLUMNS))} FROM part), "
    f"rawc AS (SELECT {_sql(_select(_RAW_CATALOG_OUT))} FROM (SELECT p_name, p_type, min(p_partkey) AS ord FROM part "
    "GROUP BY p_name, p_type) g)"
)


def raw_products(t: Tables) -> DataFrame:
    return _view(t.part, RAW_COLUMNS)


def raw_catalog(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_name", "p_type").agg({"p_partkey": "min"}).withColumnRenamed("min(p_partkey)", "ord")
    return _view(g, _RAW_CATALOG_OUT)


SPANISH = f"{_case(ADJECTIVE, ADJ_ES)} || ' ' || {_case('p_type', TYPE_ES)} || ' ' || {_case(NOUN, NOUN_ES)}"


# A catalogue that grows with part: one entry per part, with words of falling frequency (few parts share
# the later ones).  Store titles name the same part with one such word misread for two parts in three.
_TAIL = ("'m' || cast({k} * 7919 % 1009 % (1 + {k} % 97) as string)", "'n' || cast({k} % 4999 as string)", "'c' || cast({k} * 31 % 257 as string)")
_GROWN = {
    "handle": "'g-' || cast(p_partkey as string)", "ord": "p_partkey",
    "name": "p_name || ' ' || lower(p_type) || ' ' || " + " || ' ' || ".join(w.format(k="p_partkey") for w in _TAIL),
}
_SOLD = {
    "product_id": "p_partkey",
    "title": "lower(p_type) || ' ' || p_name || ' ' || " + " || ' ' || ".join(
        w.format(k=k) for w, k in zip(_TAIL, ("p_partkey", "(p_partkey + p_partkey % 3)", "p_partkey"), strict=True)),
}
GROWN = f"sold AS (SELECT {_sql(_select(_SOLD))} FROM part), grown AS (SELECT {_sql(_select(_GROWN))} FROM part)"


def sold_products(t: Tables) -> DataFrame:
    return _view(t.part, _SOLD)


def grown_catalog(t: Tables) -> DataFrame:
    return _view(t.part, _GROWN)
