"""Merging duplicates: propose, expand, apply, verify."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.operators import unify as Y
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.match_queries import self_tokens
from vitrina.plans.registry import query
from vitrina.plans.text_queries import base_title

# --- propose -----------------------------------------------------------------

_BASE = base_title("title")


@query("a04_duplicate_groups", f"WITH {B.PRODUCTS} SELECT {_BASE} AS base_title, min(product_id) AS first_id, count(*) AS n_products FROM products GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return Y.duplicate_groups(B.products(t))


@query(
    "a04_group_members",
    f"WITH {B.PRODUCTS}, b AS (SELECT {_BASE} AS base_title, product_id FROM products) SELECT base_title, product_id FROM b WHERE base_title IN (SELECT base_title FROM b GROUP BY 1 HAVING count(*) > 1)",
)
def _(t):
    return Y.group_members(B.products(t))


_LONG = "title || ' ' || p_name || ' ' || lower(p_type) || ' complete food'"


@query(
    "u01_propose_groups",
    f"""WITH {B.PRODUCTS}, longer AS (SELECT product_id, {_LONG} AS title FROM products),
    k AS (SELECT product_id, list_sort({self_tokens('title')}) AS k FROM longer), s AS MATERIALIZED (SELECT k, min(product_id) AS id, count(*) AS n FROM k WHERE len(k) > 0 GROUP BY k),
    near AS (SELECT 'similar' AS reason, a.id AS first_id, b.id AS other_id, a.n * b.n AS n_pairs FROM s a JOIN s b ON a.id < b.id WHERE {S.jac('a.k', 'b.k')} >= 0.8 - 1e-9),
    same AS (SELECT 'base_title' AS reason, min(product_id) AS first_id, max(product_id) AS other_id, count(*) * (count(*) - 1) // 2 AS n_pairs FROM longer GROUP BY {_BASE} HAVING count(*) > 1),
    u AS (SELECT * FROM same UNION ALL SELECT * FROM near)
    SELECT reason, first_id, other_id, n_pairs FROM (SELECT *, row_number() OVER (PARTITION BY first_id, other_id ORDER BY reason, n_pairs) AS rn FROM u) WHERE rn = 1""",
)
def _(t):
    return Y.propose_groups(B.products(t).select("product_id", F.expr(_LONG).alias("title")))


# --- a merge plan: each part keeps its product and absorbs one or two others --

_FAR = 1000000000
_ABSORB = (
    "concat(array(named_struct('product_id', p_partkey + {f}, 'variant_id', p_partkey + {f}, 'size', cast(p_size + 1 as string) || 'KG', 'price', '27.50', 'sku', 'A' || cast(p_partkey as string))), "
    "if(p_size > 25, array(named_struct('product_id', p_partkey + 2 * {f}, 'variant_id', p_partkey + 2 * {f}, 'size', cast(p_size + 2 as string) || 'KG', 'price', '31.00', 'sku', 'B' || cast(p_partkey as string)), "
    "named_struct('product_id', p_partkey + 2 * {f}, 'variant_id', p_partkey + 3 * {f}, 'size', cast(p_size + 3 as string) || 'KG', 'price', '35.00', 'sku', 'C' || cast(p_partkey as string))), "
    "cast(array() as array<struct<product_id:bigint,variant_id:bigint,size:string,price:string,sku:string>>)))"
).format(f=f"{_FAR}L")
_PLAN = {
    "`group`": "cast(p_partkey as string)", "keep_id": "p_partkey", "title": "upper(p_brand || ' ' || p_name)",
    "keep_size": "CASE WHEN p_type = 'PROMO' THEN NULL ELSE cast(p_size as string) || 'KG' END", "keep_var_id": "p_partkey",
}
PLAN = f"""pl AS (SELECT p_partkey::VARCHAR AS grp, p_partkey AS keep_id, upper(p_brand || ' ' || p_name) AS title, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_size || 'KG' END AS keep_size,
    p_partkey AS keep_var_id, p_size, p_type FROM part),
  ab AS (SELECT grp, keep_id, 0 AS i, keep_id + {_FAR}::BIGINT AS product_id, keep_id + {_FAR}::BIGINT AS variant_id, (p_size + 1) || 'KG' AS size, '27.50' AS price, 'A' || keep_id AS sku FROM pl
    UNION ALL SELECT grp, keep_id, 1, keep_id + 2 * {_FAR}::BIGINT, keep_id + 2 * {_FAR}::BIGINT, (p_size + 2) || 'KG', '31.00', 'B' || keep_id FROM pl WHERE p_size > 25
    UNION ALL SELECT grp, keep_id, 2, keep_id + 2 * {_FAR}::BIGINT, keep_id + 3 * {_FAR}::BIGINT, (p_size + 3) || 'KG', '35.00', 'C' || keep_id FROM pl WHERE p_size > 25)"""
# The shop before the merge: the kept products and the absorbed ones.
SHOP = f"""shopp AS (SELECT keep_id AS product_id, title || ' OLD' AS title, 'Title' AS option_name FROM pl UNION ALL SELECT product_id, 'ABSORBED ' || min(sku), 'Title' FROM ab GROUP BY product_id),
  shopv AS (SELECT keep_id AS product_id, keep_var_id AS variant_id, 'Default Title' AS option1, '10.00' AS price, 'K' || keep_id AS sku FROM pl UNION ALL SELECT product_id, variant_id, 'Default Title', price, sku FROM ab)"""


def plan(t):
    return t.part.selectExpr(*[f"{e} AS {n}" for n, e in _PLAN.items()], f"{_ABSORB} AS absorb")


def shop(t):
    p = plan(t)
    a = Y.absorbed_variants(p)
    ids = p.select(F.explode("absorb").alias("a"))
    products = p.selectExpr("keep_id AS product_id", "title || ' OLD' AS title", "'Title' AS option_name").unionByName(
        a.groupBy(F.col("source_id").alias("product_id")).agg(F.concat(F.lit("ABSORBED "), F.min("sku")).alias("title")).withColumn("option_name", F.lit("Title")))
    variants = p.selectExpr("keep_id AS product_id", "keep_var_id AS variant_id", "'Default Title' AS option1", "'10.00' AS price", "'K' || cast(keep_id as string) AS sku").unionByName(
        ids.selectExpr("a.product_id AS product_id", "a.variant_id AS variant_id", "'Default Title' AS option1", "a.price AS price", "a.sku AS sku"))
    return products, variants


@query(
    "u02_expand_plan",
    f"""WITH {PLAN}, o AS (SELECT grp, 0 AS k, 0 AS i, 'update_product' AS op, keep_id AS target_id, 'title' AS field, title AS value FROM pl
      UNION ALL SELECT grp, 1, 0, 'update_product', keep_id, 'option', 'Tamaño' FROM pl WHERE keep_size IS NOT NULL
      UNION ALL SELECT grp, 2, 0, 'update_variant', keep_var_id, 'option1', keep_size FROM pl WHERE keep_size IS NOT NULL
      UNION ALL SELECT grp, 3, i, 'add_variant', keep_id, 'option1', size FROM ab
      UNION ALL SELECT grp, 4, min(i), 'delete_product', product_id, 'id', product_id::VARCHAR FROM ab GROUP BY grp, product_id)
    SELECT grp AS "group", (row_number() OVER (PARTITION BY grp ORDER BY k, i) - 1)::INTEGER AS seq, op, target_id, field, value FROM o""",
)
def _(t):
    return Y.expand_plan(plan(t))


@query("u03_absorbed_variants", f"WITH {PLAN} SELECT grp AS \"group\", keep_id, product_id AS source_id, size AS option1, price, sku FROM ab")
def _(t):
    return Y.absorbed_variants(plan(t))


@query("u04_deletions", f"WITH {PLAN} SELECT DISTINCT product_id FROM ab")
def _(t):
    return Y.deletions(plan(t))


_PAYLOAD = {
    "product_id": "l_partkey", "variant_id": "l_orderkey * 10 + l_linenumber",
    "price": "CASE WHEN l_linenumber = 1 THEN NULL ELSE cast(cast(l_extendedprice as decimal(12,2)) as string) END",
    "compare_at_price": "cast(null as string)", "sku": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'S' || cast(l_suppkey as string) END",
    "weight": "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END", "weight_unit": "CASE WHEN l_linenumber = 3 THEN NULL ELSE 'g' END",
    "inventory_policy": "CASE WHEN l_linestatus = 'F' THEN 'continue' END", "requires_shipping": "CASE WHEN l_linestatus = 'F' THEN false END",
    "taxable": "CASE WHEN l_linenumber = 4 THEN false END", "label": "cast(l_linenumber as string) || 'KG'",
}


@query(
    "u05_variant_payload",
    f"""WITH v AS (SELECT {B._sql(B._select(_PAYLOAD)).replace('cast(null as string)', 'NULL::VARCHAR')} FROM lineitem)
    SELECT product_id, variant_id, label AS option1, coalesce(price, '0.00') AS price, compare_at_price, coalesce(sku, '') AS sku, coalesce(weight, 0.0)::DOUBLE AS weight, coalesce(weight_unit, 'kg') AS weight_unit,
    coalesce(inventory_policy, 'deny') AS inventory_policy, coalesce(requires_shipping, true) AS requires_shipping, coalesce(taxable, true) AS taxable FROM v""",
)
def _(t):
    return Y.variant_payload(B._view(t.lineitem, _PAYLOAD), F.col("label"))


# Configured groups: sizes of some product lines, found by words of their titles.
_FRAGMENTS = [
    ("pollo", 1, "mini pollo", "Mini"), ("pollo", 2, "maxi pollo", "Maxi"), ("pollo", 3, "xxl pollo", "XXL"),
    ("pato", 1, "mini pato", "Mini"), ("pato", 2, "gigante pato", "Gigante"), ("perro", 1, "perro lata", "Lata"),
    ("perro", 2, "PERRO  snacks", "Snack"), ("perro", 3, "erro", "never"),
]
_FRAG_SQL = "fr(grp, seq, fragment, label) AS (VALUES " + ", ".join(f"('{g}', {s}, '{f}', '{x}')" for g, s, f, x in _FRAGMENTS) + ")"
_PADDED = "' ' || trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g')) || ' '"
MEMBERS = f"""{_FRAG_SQL}, mt AS (SELECT f.grp, f.seq, f.label, min(p.product_id) AS product_id FROM products p JOIN fr f ON contains({_PADDED.format('p.title')}, {_PADDED.format('f.fragment')}) GROUP BY ALL),
  sz AS (SELECT grp, min(seq) AS base_seq FROM mt GROUP BY grp HAVING count(*) >= 2),
  mem AS (SELECT mt.grp, mt.seq, product_id, label, CASE WHEN seq = base_seq THEN 'base' ELSE 'absorb' END AS role FROM mt JOIN sz USING (grp))"""


def members(t):
    fr = t.spark.createDataFrame(_FRAGMENTS, "`group` string, seq int, fragment string, label string")
    return Y.groups_from_fragments(B.products(t), fr)


@query("u06_fragment_groups", f"WITH {B.PRODUCTS}, {MEMBERS} SELECT grp AS \"group\", seq, product_id, label, role FROM mem")
def _(t):
    return members(t)


# Every (brand, name) group: its first part is the base, the others are absorbed.
_MERGE = "gm AS (SELECT g.product_id AS base_id, p.p_partkey AS source_id, p.p_size || 'KG' AS label, CASE WHEN p.p_partkey = g.product_id THEN 'base' ELSE 'absorb' END AS role FROM part p JOIN grouped g ON g.p_brand = p.p_brand AND g.p_name = p.p_name)"


def merges(t):
    g = B.grouped_products(t).select(F.col("product_id").alias("base_id"), "p_brand", "p_name")
    return t.part.join(g, ["p_brand", "p_name"]).selectExpr(
        "base_id", "p_partkey AS source_id", "cast(p_size as string) || 'KG' AS label", "CASE WHEN p_partkey = base_id THEN 'base' ELSE 'absorb' END AS role")


_OWN = {
    "product_id": "p_partkey", "ord": "p_partkey", "variant_id": "p_partkey", "price": "cast(cast(p_retailprice as decimal(10,2)) as string)",
    "barcode": "lpad(cast(p_partkey as string), 13, '0')", "sku": "CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'SMALL' THEN NULL ELSE 'SKU' || cast(p_partkey as string) END",
    "weight": "CASE WHEN p_size > 45 THEN NULL ELSE cast(p_size as double) END", "weight_unit": "CASE WHEN p_size > 40 THEN '' ELSE 'g' END",
}


@query(
    "u07_merge_variants",
    f"""WITH {B.GROUPED}, {_MERGE}, v AS (SELECT {B._sql(B._select(_OWN))} FROM part)
    SELECT base_id, source_id, role, label AS option1, price, barcode, coalesce(nullif(sku, ''), barcode) AS sku, coalesce(weight, 0.0)::DOUBLE AS weight, coalesce(nullif(weight_unit, ''), 'kg') AS weight_unit
    FROM gm JOIN v ON v.product_id = gm.source_id""",
)
def _(t):
    return Y.merge_variants(merges(t), B._view(t.part, _OWN))


@query(
    "u07_merge_images",
    f"""WITH {B.GROUPED}, {_MERGE}, {B.IMAGES}, f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(position, 999), image_id) AS rn FROM images)
    SELECT base_id, source_id, label AS option1, 'copy' AS op, image_id, split_part(src, '?', 1) AS src, coalesce(alt, '') AS alt FROM gm JOIN images i ON i.product_id = gm.source_id WHERE role = 'absorb'
    UNION ALL SELECT base_id, source_id, label, 'assign', image_id, src, coalesce(alt, '') FROM gm JOIN f ON f.product_id = gm.source_id AND rn = 1 WHERE role = 'base'""",
)
def _(t):
    return Y.merge_images(merges(t), B.images(t))


@query(
    "u08_option_branch",
    "SELECT p_partkey AS product_id, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'convert' ELSE 'add' END AS action, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Peso' ELSE lower(p_type) END AS option_name FROM part",
)
def _(t):
    return Y.option_branch(t.part.selectExpr(
        "p_partkey AS product_id", "CASE WHEN p_type = 'PROMO' THEN 'Title' WHEN p_type = 'SMALL' THEN NULL ELSE lower(p_type) END AS option_name"))


@query(
    "u09_apply_products",
    f"WITH {PLAN} SELECT keep_id AS product_id, title, CASE WHEN keep_size IS NOT NULL THEN 'Tamaño' ELSE 'Title' END AS option_name FROM pl",
)
def _(t):
    return Y.apply_plan(*shop(t), plan(t))[0]


_AFTER_V = """SELECT keep_id AS product_id, keep_var_id AS variant_id, coalesce(keep_size, 'Default Title') AS option1, '10.00' AS price, 'K' || keep_id AS sku FROM pl
    UNION ALL SELECT keep_id, variant_id, size, price, sku FROM ab"""


@query("u09_apply_variants", f"WITH {PLAN} {_AFTER_V}")
def _(t):
    return Y.apply_plan(*shop(t), plan(t))[1]


# Verified against a shop where groups of large items were never merged.
_VERIFY = f"""WITH {PLAN}, {SHOP}, done AS (SELECT * FROM pl WHERE p_size <= 40),
  vp AS (SELECT keep_id AS product_id, title FROM done UNION ALL SELECT product_id, title FROM shopp WHERE product_id NOT IN (SELECT keep_id FROM done) AND product_id NOT IN (SELECT product_id FROM ab WHERE keep_id IN (SELECT keep_id FROM done))),
  vv AS (SELECT * FROM ({_AFTER_V}) z WHERE product_id IN (SELECT keep_id FROM done) UNION ALL SELECT * FROM shopv WHERE product_id NOT IN (SELECT keep_id FROM done)),
  sizes AS (SELECT grp, keep_id, keep_size AS size FROM pl WHERE keep_size IS NOT NULL UNION SELECT grp, keep_id, size FROM ab),
  lack AS (SELECT grp, string_agg(size, '|' ORDER BY size) AS detail FROM sizes s WHERE NOT EXISTS (SELECT 1 FROM vv WHERE vv.product_id = s.keep_id AND vv.option1 = s.size) GROUP BY grp),
  rows_ AS (SELECT grp, 'exists' AS chk, 'OK' AS status, keep_id::VARCHAR AS detail FROM pl
    UNION ALL SELECT grp, 'title', CASE WHEN vp.title = pl.title THEN 'OK' ELSE 'WARN' END, vp.title FROM pl JOIN vp ON vp.product_id = pl.keep_id
    UNION ALL SELECT pl.grp, 'sizes', CASE WHEN lack.detail IS NULL THEN 'OK' ELSE 'FAIL' END, coalesce(lack.detail, '') FROM pl LEFT JOIN lack USING (grp)
    UNION ALL SELECT a.grp, 'absorbed_gone', CASE WHEN vp.product_id IS NOT NULL THEN 'FAIL' ELSE 'OK' END, a.product_id::VARCHAR FROM (SELECT DISTINCT grp, product_id FROM ab) a LEFT JOIN vp USING (product_id))"""


def verified(t):
    p = plan(t)
    done = p.join(t.part.where("p_size <= 40").selectExpr("p_partkey AS keep_id"), "keep_id", "left_semi").select(p.columns)
    products, variants = Y.apply_plan(*shop(t), done)
    return Y.verify_plan(Y.checks_of(p), products, variants)


@query("u10_verify_plan", f"{_VERIFY} SELECT grp AS \"group\", chk AS \"check\", status, detail FROM rows_")
def _(t):
    return verified(t)


@query(
    "u10_verification_status",
    f"{_VERIFY} SELECT grp AS \"group\", CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'OK' END AS status, count(*) AS checks, count(*) FILTER (WHERE status <> 'OK') AS problems FROM rows_ GROUP BY grp",
)
def _(t):
    return Y.verification_status(verified(t))


_REASONS = [
    (1, "contains", "snacks pato", "line discontinued"), (2, "contains", "lata", "tins are delisted"),
    (3, "equals", "BRAND#7 PERRO MINI POLLO 11,5KG", "exact duplicate"), (4, "contains", "gato", "moved to another shop"),
]
_WHEN = " ".join(
    f"WHEN {'contains(lower(title), ' + S.quote(p.lower()) + ')' if k == 'contains' else 'lower(title) = ' + S.quote(p.lower())} THEN {s}" for s, k, p, _ in _REASONS)


@query(
    "u11_reasoned_deletions",
    f"WITH {B.PRODUCTS}, r AS (SELECT product_id, CASE {_WHEN} END::INTEGER AS seq FROM products) SELECT product_id, seq, {S.lst(r for *_, r in _REASONS)}[seq] AS reason FROM r WHERE seq IS NOT NULL",
)
def _(t):
    rules = t.spark.createDataFrame(_REASONS, "seq int, kind string, pattern string, reason string")
    return Y.reasoned_deletions(B.products(t), rules)


# Plan built from configured groups, then applied and verified: every check passes.
@query(
    "u12_plan_from_groups",
    f"WITH {B.PRODUCTS}, {MEMBERS} SELECT b.grp AS \"group\", b.product_id AS keep_id, b.label AS keep_size, (SELECT string_agg(a.label || '=' || a.product_id, '|' ORDER BY a.seq) FROM mem a WHERE a.grp = b.grp AND a.role = 'absorb') AS absorbs FROM mem b WHERE b.role = 'base'",
)
def _(t):
    m = members(t)
    titles = m.select("group", F.upper("group").alias("title")).distinct()
    p = Y.plan_from_groups(m, B._view(t.part, _OWN), titles)
    shown = F.array_join(F.transform("absorb", lambda a: F.concat(a["size"], F.lit("="), a["product_id"].cast("string"))), "|")
    return p.select("group", "keep_id", "keep_size", shown.alias("absorbs"))
