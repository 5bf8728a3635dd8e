"""Whole runs: resolution with its plan of changes, images of a run, work from the backup."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.operators import provenance, runs
from vitrina.plans import bindings as B
from vitrina.plans.cascade_queries import CASCADE, resolve
from vitrina.plans.registry import query

_CHANGES = f"""{CASCADE}, st AS (SELECT product_id, arg_max(url, seq) AS stored FROM writes WHERE url <> '' AND url_key = 'url_fabricante_2' GROUP BY product_id),
  j AS (SELECT p.product_id, coalesce(r.url, '') AS found, coalesce(st.stored, '') AS had, coalesce(r.score, 0.0) AS score FROM products p LEFT JOIN (SELECT * FROM res WHERE method <> 'cache') r USING (product_id) LEFT JOIN st USING (product_id))
  SELECT product_id, CASE WHEN found <> '' AND found <> had THEN 'set' WHEN found <> '' THEN 'keep' WHEN had <> '' THEN 'clear' ELSE 'none' END AS action, found AS url, 'score=' || printf('%.2f', score) AS note FROM j"""


@query("r01_resolution_changes", _CHANGES)
def _(t):
    resolution = resolve(t).where("method <> 'cache'")
    return runs.url_changes(B.products(t), resolution, provenance.current_urls(B.writes(t)), "url_fabricante_2", True)


# Candidate pictures of an order's products: few distinct hashes, so copies and near-copies occur.
_CAND = {
    "product_id": "l_orderkey",
    "source": "CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN 'override' WHEN l_linenumber <= 3 THEN 'match' WHEN l_linenumber = 4 THEN 'marketplace' ELSE 'generic' END",
    "ord": "l_partkey * 100000 + l_suppkey * 10 + l_linenumber", "url": "'https://cdn.example.com/' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '.jpg'",
    "width": "700 + cast(l_quantity * 20 as int)", "height": "650 + cast(l_quantity * 30 as int)",
    "hash": "CASE WHEN l_returnflag = 'R' THEN 255 WHEN l_returnflag = 'A' THEN 65535 ELSE l_suppkey END",
    "nbytes": "cast(l_extendedprice as bigint)", "white_ratio": "l_quantity / 50", "bbox_w": "600 + cast(l_quantity * 20 as int)",
    "bbox_h": "500 + cast(l_quantity * 30 as int)",
}
# DuckDB's cast to a whole number rounds half to even, Spark's cuts the fraction off.
_CAND_SPARK = {**_CAND, "nbytes": "cast(rint(l_extendedprice) as bigint)"}
_KEYS = ("product_id", "source", "ord", "url")
_FACTS = ("width", "height", "hash", "nbytes", "white_ratio", "bbox_w", "bbox_h")
RUN = f"""WITH RECURSIVE c0 AS (SELECT {B._sql(B._select(_CAND))} FROM lineitem),
  c AS (SELECT {', '.join(_KEYS)}, {', '.join(f'max({x}) AS {x}' for x in _FACTS)} FROM c0 GROUP BY {', '.join(_KEYS)}), f AS (SELECT product_id, bool_or(source = 'override') AS o, bool_or(source <> 'generic') AS s FROM c GROUP BY product_id),
  u AS (SELECT c.* FROM c JOIN f USING (product_id) WHERE CASE source WHEN 'match' THEN NOT o WHEN 'generic' THEN NOT s ELSE true END),
  lg AS MATERIALIZED (SELECT *, CASE source WHEN 'override' THEN 0 WHEN 'match' THEN 1 WHEN 'marketplace' THEN 2 ELSE 3 END::BIGINT * 1152921504606846976 + ord AS idx FROM u WHERE width >= 800 AND height >= 800),
  pics AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY idx) AS pos FROM lg),
  walk(product_id, pos, leaders) AS (SELECT product_id, pos, [{{'idx': idx, 'hash': hash}}] FROM pics WHERE pos = 1 UNION ALL
    SELECT w.product_id, p.pos, CASE WHEN len(list_filter(w.leaders, lambda g: bit_count(xor(g.hash, p.hash::BIGINT)) <= 8)) > 0 THEN w.leaders ELSE list_append(w.leaders, {{'idx': p.idx, 'hash': p.hash}}) END
    FROM walk w JOIN pics p ON p.product_id = w.product_id AND p.pos = w.pos + 1),
  fin AS (SELECT product_id, arg_max(leaders, pos) AS leaders FROM walk GROUP BY product_id),
  a AS (SELECT p.*, list_filter(f.leaders, lambda g: bit_count(xor(g.hash, p.hash::BIGINT)) <= 8)[1].idx AS leader FROM pics p JOIN fin f USING (product_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY product_id, leader ORDER BY nbytes DESC, width * height DESC, idx) AS rn, min(idx) OVER (PARTITION BY product_id, leader) AS slot,
    count(*) OVER (PARTITION BY product_id, leader) AS members FROM a),
  k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY slot)::INTEGER AS position FROM r WHERE rn = 1)"""


def candidates(t):
    """One row per candidate: a line that occurs twice is one picture."""
    # The URL is made of two of the numbers that tell candidates apart, so it is written out afterwards; rows travel
    # once, to their product.
    numbers = {k: _CAND[k] for k in ("product_id", "source", "ord")} | {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}
    rows = B._view(t.lineitem.repartition("l_orderkey"), {**numbers, **{k: _CAND_SPARK[k] for k in _FACTS}})
    cands = rows.groupBy(*numbers).agg(*[F.max(x).alias(x) for x in _FACTS]).withColumn("url", F.expr(_CAND["url"]))
    return cands.select(*_KEYS, *_FACTS)


def image_run(t):
    p = t.orders.selectExpr("o_orderkey AS product_id", "'order ' || cast(o_orderkey as string) AS title", "'order-' || cast(o_orderkey as string) AS slug")
    matched = t.orders.where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS product_id")
    existing = B._view(t.lineitem, {"product_id": "l_partkey", **{k: B.IMAGE_COLUMNS[k] for k in ("image_id", "position", "alt")}})
    cands = candidates(t)
    return runs.image_run(p, matched, cands, existing)


@query("r02_image_run", f"{RUN} SELECT product_id, position, url, source, members FROM k")
def _(t):
    return image_run(t)["chosen"].select("product_id", "position", "url", "source", "members")


@query(
    "r02_image_run_outcome",
    f"""{RUN}, g AS (SELECT product_id, count(*) AS n FROM k GROUP BY 1) SELECT o_orderkey AS product_id, CASE WHEN o_orderstatus = 'P' THEN 'sin_match' WHEN n IS NULL THEN 'sin_imagen' ELSE 'ok' END AS status, coalesce(n, 0) AS n_images
    FROM orders LEFT JOIN g ON g.product_id = o_orderkey""",
)
def _(t):
    return image_run(t)["outcome"]


@query(
    "r03_backup_run",
    """WITH b AS (SELECT l_partkey AS product_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20 GROUP BY 1), d AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_quantity > 48)
    SELECT o_orderkey AS product_id, CASE WHEN d.product_id IS NOT NULL THEN 'saltados' WHEN n IS NULL THEN 'sin_backup' ELSE 'ok' END AS status, coalesce(n, 0) AS n_images
    FROM orders LEFT JOIN d ON d.product_id = o_orderkey LEFT JOIN b ON b.product_id = o_orderkey""",
)
def _(t):
    return runs.backup_run(
        t.orders.selectExpr("o_orderkey AS product_id"), t.lineitem.where("l_quantity > 48").selectExpr("l_partkey AS product_id"),
        t.lineitem.where("l_returnflag = 'R' AND l_quantity > 20").selectExpr("l_partkey AS product_id"))
