"""Counters, audits and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.operators import matching
from vitrina.operators import reports as R
from vitrina.plans import bindings as B
from vitrina.plans.cascade_queries import CASCADE, resolve
from vitrina.plans.match_queries import _RAW_PAIRS, _RAW_SIDES, best
from vitrina.plans.provenance_queries import SNAP, snap
from vitrina.plans.registry import query
from vitrina.plans.text_queries import base_title

_MATCHED = f"WITH {B.RAW}, {_RAW_SIDES}, m AS ({best(_RAW_PAIRS, 0.20, out='product_id, handle, score')})"


def matches(t):
    return matching.match_best(B.raw_products(t), B.raw_catalog(t), lx.PROFILES["acana"], ("name",))


@query(
    "a01_run_statistics",
    f"""WITH {B.IMAGES}, g AS (SELECT product_id, count(*) AS n, count(*) FILTER (WHERE width >= 800 AND height >= 800) AS k FROM images GROUP BY 1),
    s AS (SELECT CASE WHEN p_size > 40 THEN 'sin_match' WHEN coalesce(n, 0) = 0 THEN 'sin_imagen' WHEN k = 0 THEN 'errores' ELSE 'ok' END AS status FROM part LEFT JOIN g ON product_id = p_partkey) SELECT status, count(*) AS n FROM s GROUP BY 1""",
)
def _(t):
    g = B.images(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("width >= 800 AND height >= 800")).alias("k"))
    zero = F.lit(0)
    outcome = R.status_column(F.coalesce("n", zero), F.coalesce("k", zero), F.col("p_size") <= 40)
    return R.run_statistics(B.products(t).join(g, "product_id", "left").select(outcome.alias("status")))


@query(
    "a02_audit",
    f"""{_MATCHED}, x AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08)
    SELECT p.product_id, CASE WHEN x.product_id IS NULL THEN m.handle END AS handle, CASE WHEN x.product_id IS NULL THEN round(m.score, 2)::DOUBLE END AS score,
    CASE WHEN x.product_id IS NOT NULL THEN 'EXCLUIDO' WHEN m.handle IS NULL THEN 'SIN_MATCH' WHEN round(m.score, 2) >= 0.4 THEN 'OK' ELSE 'REVISAR' END AS state
    FROM rawp p LEFT JOIN m USING (product_id) LEFT JOIN x ON x.product_id = p.product_id""",
)
def _(t):
    excluded = t.lineitem.where("l_quantity > 49 AND l_discount > 0.08").selectExpr("l_partkey AS product_id")
    return R.audit(B.raw_products(t), matches(t), 0.4, excluded)


@query(
    "a03_score_bands",
    f"{_MATCHED} SELECT CASE WHEN m.score IS NULL THEN 'none' WHEN m.score >= 0.45 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM rawp p LEFT JOIN m USING (product_id) GROUP BY 1",
)
def _(t):
    return R.score_bands(B.raw_products(t), matches(t), 0.45)


@query(
    "a05_product_state",
    f"""WITH {B.GROUPED}, {B.IMAGES}, v AS (SELECT product_id, count(*) AS n, string_agg(option1, '|' ORDER BY ord, variant_id) AS o FROM gvariants GROUP BY 1), i AS (SELECT product_id, count(*) AS n FROM images GROUP BY 1)
    SELECT p.product_id, v.n AS n_variants, option_name, v.o AS option_values, coalesce(i.n, 0) AS n_images, CASE WHEN v.n > 1 THEN 'multi' ELSE 'single' END AS kind, {base_title('title')} AS base_title
    FROM gproducts p JOIN v USING (product_id) LEFT JOIN i USING (product_id)""",
)
def _(t):
    return R.product_state(B.grouped_products(t), B.grouped_variants(t), B.images(t))


@query("a06_vendors_containing", f"WITH {B.PRODUCTS} SELECT vendor, count(*) AS n_products FROM products WHERE contains(lower(vendor), 'nd#1') GROUP BY 1")
def _(t):
    return R.vendors_containing(B.products(t), "ND#1")


@query("a07_snapshot_coverage", f"WITH {B.PRODUCTS}, {SNAP} SELECT count(*) AS products, count(*) FILTER (WHERE url_fabricante <> '') AS with_url, count(*) FILTER (WHERE url_fabricante_2 <> '') AS with_url_2 FROM snap")
def _(t):
    return R.snapshot_coverage(snap(t))


_ENTRIES = {"source": "p_brand", "handle": B.HANDLE, "images": "CASE WHEN p_size > 40 THEN cast(null as array<string>) WHEN p_size > 25 THEN array('a', 'b') ELSE array('a') END"}


@query(
    "a08_catalog_coverage",
    "SELECT p_brand AS source, count(*) AS entries, sum(CASE WHEN p_size > 40 THEN 0 WHEN p_size > 25 THEN 2 ELSE 1 END)::BIGINT AS images, count(*) FILTER (WHERE p_size > 40) AS without_images FROM part GROUP BY 1",
)
def _(t):
    return R.catalog_coverage(B._view(t.part, _ENTRIES))


def checklist_views(t):
    return B.grouped_products(t), B.grouped_variants(t)


@query(
    "a09_checklist",
    f"""WITH {B.GROUPED}, n AS (SELECT product_id, count(*) AS n FROM gvariants GROUP BY 1)
    SELECT product_id, 0 AS line_no, '- [ ] **' || title || '** `ID: ' || product_id || '`' AS line FROM gproducts
    UNION ALL SELECT product_id, ord::INTEGER + 1, CASE WHEN n > 1 THEN '  - Variante: **' || option1 || '** | ' ELSE '  - ' END || 'EAN: `' || barcode || '` | ' || price || '€' FROM gvariants JOIN n USING (product_id)""",
)
def _(t):
    p, v = checklist_views(t)
    return R.checklist(p, v.withColumn("ord", F.col("ord") + 1))


@query("a09_checklist_totals", f"WITH {B.GROUPED} SELECT (SELECT count(*) FROM gproducts) AS products, (SELECT count(*) FROM gvariants) AS variants")
def _(t):
    return R.checklist_totals(*checklist_views(t))


@query(
    "a10_no_match_list",
    f"{CASCADE} SELECT product_id, title, 'https://admin.shopify.com/store/my-shop/products/' || product_id AS link FROM products WHERE product_id NOT IN (SELECT product_id FROM res WHERE method IN ('override', 'barcode', 'cache'))",
)
def _(t):
    done = resolve(t).where("method IN ('override', 'barcode', 'cache')")
    return R.no_match_list(B.products(t), done, "my-shop.myshopify.com")
