"""Source URLs, histories, snapshots, incremental runs and plans of change."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import text as T
from vitrina.operators import provenance as V
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.cascade_queries import CACHE, CASCADE, _KEY, cache, resolve
from vitrina.plans.registry import query

CUR = f"{B.WRITES}, cur AS (SELECT product_id, url_key, arg_max(url, seq) AS url FROM writes WHERE url <> '' GROUP BY ALL)"
WITH = f"WITH {B.PRODUCTS}, {CUR}"
WIDE = (
    "wide AS (SELECT product_id, max(CASE WHEN url_key = 'url_fabricante' THEN url END) AS u1, max(CASE WHEN url_key = 'url_fabricante_2' THEN url END) AS u2 FROM cur GROUP BY product_id)"
)


def metafields(t):
    return V.current_urls(B.writes(t))


@query(
    "v01_source_urls",
    f"{WITH}, {WIDE}, l AS (SELECT product_id, CASE WHEN u1 = u2 THEN [u1] ELSE list_filter([u1, u2], lambda u: u IS NOT NULL) END AS l FROM wide) SELECT product_id, array_to_string(l, '|') AS urls FROM l",
)
def _(t):
    return V.source_urls(metafields(t)).select("product_id", F.array_join("urls", "|").alias("urls"))


@query(
    "v02_history_changes",
    f"WITH {B.WRITES}, p AS (SELECT *, lag(url) OVER (PARTITION BY product_id ORDER BY seq) AS prev FROM writes WHERE url <> '') SELECT product_id, seq, url, url_key, workflow FROM p WHERE prev IS NULL OR prev <> url",
)
def _(t):
    return V.history_changes(B.writes(t), bucket=1000)


@query("v02_current_urls", f"WITH {CUR} SELECT product_id, url_key, url FROM cur")
def _(t):
    return metafields(t)


# Stored histories: valid JSON, a JSON object, broken text.
_HIST = (
    "CASE WHEN event_type = 'view' THEN '[{\"url\":\"https://a.example.com/x\",\"fecha\":\"2024-01-01\",\"workflow\":\"w\",\"resultado\":\"r\"},{\"url\":\"https://www.maker.example.com/p/a\",\"fecha\":\"2024-01-02\"}]' "
    "WHEN event_type = 'click' THEN '[]' WHEN event_type = 'error' THEN '[{\"url\":' ELSE 'not json' END"
)


@query(
    "v02_stored_history",
    "SELECT event_id AS product_id, CASE WHEN event_type = 'view' THEN 'https://www.maker.example.com/p/a' END AS last_url, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END::BIGINT AS n_entries FROM events",
)
def _(t):
    return V.last_of_history(t.events.selectExpr("event_id AS product_id", f"{_HIST} AS history_json"))


@query(
    "v02_append_to_history",
    f"""WITH {B.WRITES}, st AS (SELECT DISTINCT user_id AS product_id, 'https://www.maker.example.com/p/a' AS last_url FROM events WHERE event_type = 'view' AND value > 150),
    p AS (SELECT w.*, coalesce(lag(url) OVER (PARTITION BY product_id ORDER BY seq), last_url) AS prev FROM writes w LEFT JOIN st USING (product_id) WHERE url <> '')
    SELECT product_id, seq, url FROM p WHERE prev IS NULL OR prev <> url""",
)
def _(t):
    stored = t.events.where("event_type = 'view' AND value > 150").selectExpr(
        "user_id AS product_id", "'https://www.maker.example.com/p/a' AS last_url").distinct()
    return V.history_changes(B.writes(t), stored, bucket=1000).select("product_id", "seq", "url")


@query(
    "v03_clear_unresolved",
    f"{CASCADE}, cur AS (SELECT product_id, url_key, arg_max(url, seq) AS url FROM writes WHERE url <> '' GROUP BY ALL) SELECT product_id, url_key, url FROM cur WHERE url_key = 'url_fabricante' AND product_id NOT IN (SELECT product_id FROM res WHERE method IN ('barcode', 'text'))",
)
def _(t):
    return V.to_clear(metafields(t), resolve(t).where("method IN ('barcode', 'text')"))


@query(
    "v04_backfill",
    f"WITH {B.PRODUCTS}, {CACHE}, k AS (SELECT product_id, {_KEY} AS title_key FROM products) SELECT product_id, k.title_key, coalesce(nullif(c.url, ''), '') AS url, coalesce(c.url, '') <> '' AS saved FROM k LEFT JOIN cache c ON c.title_key = k.title_key",
)
def _(t):
    return V.backfill(B.products(t), cache(t), T.title_key(F.col("title")))


SNAP = f"{CUR}, {WIDE}, snap AS (SELECT p.product_id, p.title, coalesce(u1, '') AS url_fabricante, coalesce(u2, '') AS url_fabricante_2 FROM products p LEFT JOIN wide USING (product_id))"


def snap(t):
    return V.snapshot(B.products(t), metafields(t))


@query("v05_snapshot", f"WITH {B.PRODUCTS}, {SNAP} SELECT * FROM snap")
def _(t):
    return snap(t)


# A dry run: what resolution would set; half of the products get their verified URL in another spelling.
_DRY = (
    "CASE WHEN p_size > 45 THEN NULL WHEN p_size > 20 THEN 'HTTP://maker.example.com/p/a/?utm=1#x' ELSE 'https://www.maker.example.com/p/b' END"
)
COMPARED = f"""WITH {B.PRODUCTS}, {SNAP}, d AS (SELECT product_id, {_DRY} AS url FROM products),
  c AS (SELECT d.product_id, {S.norm_url('s.url_fabricante')} AS want, {S.norm_url('d.url')} AS got FROM d LEFT JOIN snap s USING (product_id)),
  k AS (SELECT *, CASE WHEN want <> '' AND got <> '' THEN CASE WHEN want = got THEN 'equal' ELSE 'different' END WHEN want <> '' THEN 'would_delete' WHEN got <> '' THEN 'adds' ELSE 'both_empty' END AS category FROM c)"""


def compared(t):
    return V.compare_with_snapshot(B.products(t).select("product_id", F.expr(_DRY).alias("url")), snap(t))


@query("v06_dry_run_comparison", f"{COMPARED} SELECT product_id, want, got, category FROM k")
def _(t):
    return compared(t)


@query(
    "a11_precision",
    f"{COMPARED}, n AS (SELECT count(*) FILTER (WHERE want <> '') AS base, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in ("equal", "different", "would_delete", "adds", "both_empty"))
    + " FROM k) SELECT *, CASE WHEN base > 0 THEN equal * 100 // base END AS precision FROM n",
)
def _(t):
    return V.precision(compared(t))


# Snapshot whose second URL is empty for larger items: their cache entries go.
_SEED = "CASE WHEN p_size > 20 THEN '' ELSE 'https://www.maker.example.com/verified/' || handle END"


@query(
    "v07_seed_cache",
    f"""WITH {B.PRODUCTS}, {CACHE}, v AS (SELECT title_key, arg_max(u, product_id) AS u FROM (SELECT {_KEY} AS title_key, product_id, {_SEED} AS u FROM products WHERE p_type IN ('SMALL', 'LARGE')) z GROUP BY 1)
    SELECT coalesce(c.title_key, v.title_key) AS title_key, CASE WHEN v.title_key IS NOT NULL THEN v.u ELSE c.url END AS url, CASE WHEN v.title_key IS NOT NULL THEN 'shopify_manual' ELSE c.source END AS source
    FROM cache c FULL JOIN v ON v.title_key = c.title_key WHERE coalesce(CASE WHEN v.title_key IS NOT NULL THEN v.u ELSE c.url END, '') <> ''""",
)
def _(t):
    s = B.products(t).where("p_type IN ('SMALL', 'LARGE')").select("product_id", "title", F.expr(_SEED).alias("url_fabricante_2"))
    return V.seed_cache(cache(t), s, T.title_key(F.col("title")))


@query("v08_pending", f"WITH {B.PRODUCTS} SELECT product_id, title FROM products WHERE product_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45)")
def _(t):
    processed = t.lineitem.where("l_linestatus = 'F' AND l_quantity > 45").selectExpr("l_partkey AS product_id")
    return V.pending(B.products(t), processed).select("product_id", "title")


@query("v08_extend_registry", "SELECT l_partkey AS product_id FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45 UNION SELECT user_id FROM events")
def _(t):
    processed = t.lineitem.where("l_linestatus = 'F' AND l_quantity > 45").selectExpr("l_partkey AS product_id").distinct()
    return V.extend_registry(processed, t.events.selectExpr("user_id AS product_id"))


# Look-ups of earlier days: found ones carry an image, the others are tried again.
_LOOK = {
    "ean": "lpad(cast(p_partkey as string), 13, '0')", "url": "CASE WHEN p_size > 30 THEN 'https://supplier.example.com/' || cast(p_partkey as string) ELSE '' END",
    "found": "p_size > 30", "fecha": "'2024-05-' || lpad(cast(p_size - 19 as string), 2, '0')",
}


@query(
    "v09_positive_cache",
    f"""WITH {B.PRODUCTS}, k AS (SELECT {B._sql(B._select(_LOOK))} FROM part WHERE p_size > 19), c AS (SELECT product_id, barcode AS ean FROM products WHERE barcode <> '')
    SELECT c.product_id, c.ean, CASE WHEN k.found THEN 'served' ELSE 'retry' END AS outcome, CASE WHEN k.found THEN k.url ELSE '' END AS url FROM c LEFT JOIN k ON k.ean = c.ean""",
)
def _(t):
    codes = B.products(t).where("barcode <> ''").selectExpr("product_id", "barcode AS ean")
    served, retry = V.cached_lookups(codes, B._view(t.part.where("p_size > 19"), _LOOK))
    return served.select("product_id", "ean", F.lit("served").alias("outcome"), "url").unionByName(
        retry.select("product_id", "ean", F.lit("retry").alias("outcome"), F.lit("").alias("url")))


@query(
    "v09_merge_lookups",
    f"""WITH k AS (SELECT {B._sql(B._select(_LOOK))} FROM part WHERE p_size > 19), f AS (SELECT lpad(l_partkey::VARCHAR, 13, '0') AS ean, 'https://supplier.example.com/new/' || l_partkey AS url, true AS found, '2024-06-01' AS fecha FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) z)
    SELECT * FROM k WHERE ean NOT IN (SELECT ean FROM f) UNION ALL SELECT * FROM f""",
)
def _(t):
    fresh = t.lineitem.where("l_quantity > 48").select("l_partkey").distinct().selectExpr(
        "lpad(cast(l_partkey as string), 13, '0') AS ean", "'https://supplier.example.com/new/' || cast(l_partkey as string) AS url", "true AS found", "'2024-06-01' AS fecha")
    return V.merge_lookups(B._view(t.part.where("p_size > 19"), _LOOK), fresh)


_PLAN10 = f"""WITH {B.IMAGES}, p AS (SELECT o_orderkey AS product_id FROM orders), n AS (SELECT product_id, count(*) AS n FROM images GROUP BY 1),
  h AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_quantity > 48)"""


@query(
    "v10_backup_plan",
    f"{_PLAN10} SELECT p.product_id, coalesce(n, 0) AS n_images, CASE WHEN n IS NULL THEN 'no_images' WHEN h.product_id IS NOT NULL THEN 'exists' ELSE 'new' END AS action FROM p LEFT JOIN n USING (product_id) LEFT JOIN h ON h.product_id = p.product_id",
)
def _(t):
    return V.backup_plan(*_backup(t))


@query(
    "v10_backup_plan_forced",
    f"{_PLAN10} SELECT p.product_id, coalesce(n, 0) AS n_images, CASE WHEN n IS NULL THEN 'no_images' WHEN h.product_id IS NOT NULL THEN 'forced' ELSE 'new' END AS action FROM p LEFT JOIN n USING (product_id) LEFT JOIN h ON h.product_id = p.product_id",
)
def _(t):
    return V.backup_plan(*_backup(t), force=True)


def _backup(t):
    # Orders outnumber parts, so part of the products have no images.
    return t.orders.selectExpr("o_orderkey AS product_id"), B.images(t), t.lineitem.where("l_quantity > 48").selectExpr("l_partkey AS product_id")


@query(
    "v11_replacement_plan",
    f"""WITH {B.PRODUCTS}, {B.IMAGES}, d AS (SELECT DISTINCT l_partkey AS product_id, l_linenumber AS position FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30),
    o AS (SELECT product_id, position, arg_max(alt, image_id) AS old_alt FROM images GROUP BY ALL)
    SELECT d.product_id, 'upload' AS op, NULL::BIGINT AS image_id, d.position, p.handle || '_' || d.position || '.webp' AS filename, coalesce(nullif(old_alt, ''), p.title) AS alt
    FROM d JOIN products p USING (product_id) LEFT JOIN o ON o.product_id = d.product_id AND o.position = d.position
    UNION ALL SELECT product_id, 'delete', image_id, position, NULL, NULL FROM images WHERE product_id IN (SELECT product_id FROM d) AND product_id IN (SELECT product_id FROM products)""",
)
def _(t):
    processed = t.lineitem.where("l_returnflag = 'A' AND l_quantity > 30").selectExpr("l_partkey AS product_id", "l_linenumber AS position").distinct()
    return V.replacement_plan(processed, B.images(t), B.products(t).select("product_id", "title", F.col("handle").alias("slug")))


@query(
    "v12_choose_source",
    f"""WITH {B.IMAGES}, b AS (SELECT l_partkey AS product_id, l_linenumber AS position, min('backups/' || l_orderkey || '.jpg') AS path FROM lineitem WHERE l_linenumber < 6 AND l_returnflag = 'R' GROUP BY ALL),
    l AS (SELECT product_id, position, min(src) AS src FROM images WHERE position IS NOT NULL GROUP BY ALL)
    SELECT coalesce(b.product_id, l.product_id) AS product_id, coalesce(b.position, l.position) AS position, CASE WHEN b.path IS NOT NULL THEN 'backup' ELSE 'live' END AS origin, coalesce(b.path, l.src) AS location
    FROM b FULL JOIN l ON l.product_id = b.product_id AND l.position = b.position WHERE coalesce(b.product_id, l.product_id) IN (SELECT p_partkey FROM part WHERE p_size < 45)""",
)
def _(t):
    backup = t.lineitem.where("l_linenumber < 6 AND l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("position")).agg(
        F.min(F.expr("'backups/' || cast(l_orderkey as string) || '.jpg'")).alias("path"))
    live = B.images(t).where("position IS NOT NULL").groupBy("product_id", "position").agg(F.min("src").alias("src"))
    return V.choose_source(B.products(t).where("p_size < 45"), backup, live)
