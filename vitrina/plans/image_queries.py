"""Image measurements, de-duplication, layout, and the ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import image_math as IM
from vitrina.operators import filters
from vitrina.operators import images as I
from vitrina.operators import signatures
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query
from vitrina.plans.similarity_queries import HASHES
from vitrina.plans.url_queries import _FMT, _SIZE

# --- near-duplicates ---------------------------------------------------------
# Pictures of a product (= label) in order; 16 hash bits make near-duplicates common.

_BYTES = "1000 + vec_id * 7919 - 5003 * (vec_id * 7919 div 5003)"


def pictures(t):
    h = IM.average_hash(F.col("embedding")).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return t.embeddings.select(
        F.col("label").cast("bigint").alias("product_id"), F.col("vec_id").alias("idx"),
        F.when(F.col("embedding")[1] < 0.25, h).alias("hash"), F.expr(_BYTES).alias("nbytes"), (F.col("vec_id") * 3).alias("area"),
    )


_LEADERS = f"""WITH RECURSIVE {HASHES},
  pics AS MATERIALIZED (SELECT label AS product_id, vec_id AS idx, ahash & 65535 AS hash, {_BYTES.replace(' div ', ' // ')} AS nbytes, vec_id * 3 AS area,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM hashes JOIN embeddings USING (vec_id, label) WHERE embedding[2] < 0.25),
  walk(product_id, pos, leaders) AS (
    SELECT product_id, pos, [{{'idx': idx, 'hash': hash}}] FROM pics WHERE pos = 1
    UNION ALL
    SELECT w.product_id, p.pos, CASE WHEN len(list_filter(w.leaders, lambda g: bit_count(xor(g.hash, p.hash)) <= 8)) > 0 THEN w.leaders ELSE list_append(w.leaders, {{'idx': p.idx, 'hash': p.hash}}) END
    FROM walk w JOIN pics p ON p.product_id = w.product_id AND p.pos = w.pos + 1),
  fin AS (SELECT product_id, arg_max(leaders, pos) AS leaders FROM walk GROUP BY product_id),
  a AS (SELECT p.*, list_filter(f.leaders, lambda g: bit_count(xor(g.hash, p.hash)) <= 8)[1].idx AS leader FROM pics p JOIN fin f USING (product_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY product_id, leader ORDER BY nbytes DESC, area DESC, idx) AS rn, min(idx) OVER (PARTITION BY product_id, leader) AS slot,
    count(*) OVER (PARTITION BY product_id, leader) AS members FROM a)
  SELECT product_id::BIGINT AS product_id, slot, idx AS kept_idx, members FROM r WHERE rn = 1"""


@query("i04_dedupe_images", _LEADERS)
def _(t):
    return I.dedupe_images(pictures(t))


@query("i04_dedupe_large_products", _LEADERS)
def _(t):
    return I.dedupe_images(pictures(t), fold_limit=0)


# --- pixels: each of the 64 values becomes a 6x6 block of a 48x48 picture ----

_CH = "least(255, greatest(0, cast(floor({}) as int)))"
_R, _G, _BL = _CH.format("235 + v * 200"), _CH.format("235 + v * 150"), _CH.format("240 - v * 100")
PIXELS = f"""pe AS (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  pixels AS (SELECT image_id, ((i % 8) * 6 + dx)::INTEGER AS x, ((i // 8) * 6 + dy)::INTEGER AS y, {_R} AS r, {_G} AS g, {_BL} AS b, CASE WHEN v < -0.2 THEN 50 ELSE 255 END AS a
  FROM pe, (SELECT unnest(range(0, 6)) AS dx) dxs, (SELECT unnest(range(0, 6)) AS dy) dys)"""


def pixels(t):
    cells = t.embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    grid = cells.withColumn("dx", F.explode(F.expr("sequence(0, 5)"))).withColumn("dy", F.explode(F.expr("sequence(0, 5)")))
    return grid.selectExpr("image_id", "(i % 8) * 6 + dx AS x", "cast(i div 8 as int) * 6 + dy AS y", f"{_R} AS r", f"{_G} AS g", f"{_BL} AS b",
                           "CASE WHEN v < -0.2 THEN 50 ELSE 255 END AS a")


def sizes(t):
    return t.embeddings.selectExpr("vec_id AS image_id", "48 AS width", "48 AS height")


_IN = "(CASE WHEN {c} < 20 AND {c} % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN {c} >= 28 AND ({c} - 28) % 2 = 0 THEN 1 ELSE 0 END)"


@query(
    "i05_white_corners",
    f"""WITH {PIXELS}, h AS (SELECT image_id, {_IN.format(c='x')} * {_IN.format(c='y')} AS k, r >= 245 AND g >= 245 AND b >= 245 AS w FROM pixels)
    SELECT image_id, round(sum(CASE WHEN w THEN k ELSE 0 END)::DOUBLE / sum(k), 6)::DOUBLE AS white_ratio FROM h WHERE k > 0 GROUP BY image_id""",
)
def _(t):
    return I.white_corner_ratio(pixels(t), sizes(t)).withColumn("white_ratio", F.round("white_ratio", 6))


@query(
    "i06_content_box",
    f"WITH {PIXELS} SELECT image_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM pixels WHERE 255 - r >= 15 OR 255 - g >= 15 OR 255 - b >= 15 GROUP BY image_id",
)
def _(t):
    return I.content_box(pixels(t))


@query(
    "i07_transparency",
    f"WITH {PIXELS}, r AS (SELECT image_id, avg(CASE WHEN a < 128 THEN 1.0 ELSE 0.0 END)::DOUBLE AS q FROM pixels GROUP BY image_id) SELECT image_id, round(q, 6)::DOUBLE AS transparent_ratio, CASE WHEN q > 0.15 THEN 'composite' ELSE 'blur-fill' END AS treatment FROM r",
)
def _(t):
    return I.transparency(pixels(t)).withColumn("transparent_ratio", F.round("transparent_ratio", 6))


_MEASURES = {
    "image_id": "p_partkey", "width": "1000 + p_size * 20", "height": "CASE WHEN p_type = 'STANDARD' THEN 700 ELSE 1000 END + p_size * 30",
    "white_ratio": "cast(p_size as double) / 50", "force_padding": "CASE p_type WHEN 'SMALL' THEN true WHEN 'LARGE' THEN false ELSE cast(null as boolean) END",
    "bbox_w": "CASE WHEN p_type = 'MEDIUM' THEN 1000 + p_size * 20 WHEN p_size = 7 THEN NULL WHEN p_type = 'PROMO' THEN 500 ELSE 880 + p_size * 20 END",
    "bbox_h": "CASE WHEN p_type = 'MEDIUM' THEN 600 WHEN p_size = 7 THEN NULL WHEN p_size > 46 THEN CASE WHEN p_type = 'STANDARD' THEN 700 ELSE 1000 END + p_size * 30 ELSE 690 + p_size * 30 END",
}
_LAYOUT = f"""m AS (SELECT {B._sql(B._select(_MEASURES))} FROM part), f AS (SELECT *, coalesce(bbox_w, width) AS bw, coalesce(bbox_h, height) AS bh FROM m),
  g AS (SELECT *, bw / width::DOUBLE AS fw, bh / height::DOUBLE AS fh, white_ratio >= 0.6 AS wh, ((width - bw) + (height - bh)) / (width + height)::DOUBLE <= 0.03 AND white_ratio >= 0.95 AS tight FROM f),
  d AS (SELECT *, CASE WHEN force_padding THEN 'forced-padding' WHEN force_padding IS NOT NULL AND wh THEN 'forced-crop' WHEN force_padding IS NOT NULL THEN 'forced-none'
    WHEN NOT wh THEN 'no-padding' WHEN fw > 0.85 AND fh > 0.85 AND NOT tight THEN 'fills-frame' WHEN fw >= 0.98 AND NOT tight THEN 'fills-width' WHEN tight THEN 'tight-product-shot' ELSE 'padding' END AS decision FROM g),
  e AS (SELECT *, decision IN ('padding', 'tight-product-shot', 'forced-padding') AS use_padding, decision IN ('padding', 'tight-product-shot', 'forced-padding', 'fills-width', 'forced-crop') AS cropped FROM d),
  c AS (SELECT *, CASE WHEN cropped THEN bw ELSE width END AS cw, CASE WHEN cropped THEN bh ELSE height END AS ch, CASE WHEN use_padding THEN 1800.0::DOUBLE ELSE 2000.0::DOUBLE END AS box FROM e),
  n AS (SELECT *, CASE WHEN cw::DOUBLE / ch >= 1 THEN box::BIGINT ELSE floor(box * (cw::DOUBLE / ch))::BIGINT END AS new_w, CASE WHEN cw::DOUBLE / ch >= 1 THEN floor(box / (cw::DOUBLE / ch))::BIGINT ELSE box::BIGINT END AS new_h FROM c)"""


def measures(t):
    return B._view(t.part, _MEASURES)


@query("i08_layout", f"WITH {_LAYOUT} SELECT image_id, decision, use_padding, cropped FROM n")
def _(t):
    return I.plan_layout(measures(t)).select("image_id", "decision", "use_padding", "cropped")


@query("i09_canvas", f"WITH {_LAYOUT} SELECT image_id, new_w, new_h, (2000 - new_w) // 2 AS off_x, (2000 - new_h) // 2 AS off_y FROM n")
def _(t):
    return I.plan_layout(measures(t)).select("image_id", "new_w", "new_h", "off_x", "off_y")


@query(
    "i10_corner_colour",
    f"WITH {PIXELS} SELECT image_id, (sum(r) // 4)::BIGINT AS r, (sum(g) // 4)::BIGINT AS g, (sum(b) // 4)::BIGINT AS b FROM pixels WHERE x IN (0, 47) AND y IN (0, 47) GROUP BY image_id",
)
def _(t):
    return I.corner_colour(pixels(t), sizes(t))


@query(
    "i11_tile_plan",
    """WITH i AS (SELECT p_partkey AS image_id, 100 + p_size * 20 AS w, 700 + p_size AS h FROM part),
    x AS (SELECT image_id, w, h, unnest(range(0, (w + 255) // 256))::INTEGER AS tx FROM i), t AS (SELECT *, unnest(range(0, (h + 255) // 256))::INTEGER AS ty FROM x),
    c AS (SELECT *, greatest(0, tx * 256 - 16) AS x1, greatest(0, ty * 256 - 16) AS y1, least(w, (tx + 1) * 256 + 16) AS x2, least(h, (ty + 1) * 256 + 16) AS y2 FROM t)
    SELECT image_id, tx, ty, x1, y1, x2, y2, (tx * 256 - x1) * 2 AS crop_x, (ty * 256 - y1) * 2 AS crop_y, (least(w, (tx + 1) * 256) - tx * 256) * 2 AS crop_w,
    (least(h, (ty + 1) * 256) - ty * 256) * 2 AS crop_h, tx * 512 AS out_x, ty * 512 AS out_y FROM c""",
)
def _(t):
    return I.tile_plan(t.part.selectExpr("p_partkey AS image_id", "100 + p_size * 20 AS width", "700 + p_size AS height"))


@query(
    "i12_image_audit",
    f"""WITH {B.IMAGES}, j AS (SELECT product_id, position, src, {_SIZE} AS s, {_FMT} AS f FROM images),
    d AS (SELECT *, nullif(concat_ws(', ', 'tamaño=' || s, 'formato=' || f), '') AS issue FROM j),
    g AS (SELECT product_id, count(*) AS n, count(issue) AS k, string_agg(issue, '|' ORDER BY coalesce(position, 999), src) AS issues FROM d GROUP BY product_id)
    SELECT p_partkey AS product_id, coalesce(n, 0) AS n_images, CASE WHEN n IS NULL THEN 'no_image' WHEN k > 0 THEN 'needs_work' ELSE 'ok' END AS state, coalesce(issues, '') AS issues
    FROM part LEFT JOIN g ON g.product_id = p_partkey""",
)
def _(t):
    return I.audit_images(B.products(t), B.images(t))


@query(
    "i13_optimisation_scan",
    f"""WITH {B.IMAGES}, o AS (SELECT product_id, ends_with(split_part(src, '?', 1), '.webp') AND width = 2000 AND height = 2000 AS ok FROM images),
    g AS (SELECT product_id, count(*) FILTER (WHERE NOT ok) AS p, count(*) FILTER (WHERE ok) AS a FROM o GROUP BY product_id)
    SELECT o_orderkey AS product_id, coalesce(p, 0) AS to_process, coalesce(a, 0) AS already_ok, p IS NULL AS no_images FROM orders LEFT JOIN g ON g.product_id = o_orderkey""",
)
def _(t):
    # Orders outnumber parts, so part of the products have no images.
    return I.optimisation_scan(t.orders.selectExpr("o_orderkey AS product_id"), B.images(t))


@query(
    "i14_attach_feature",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
    u AS (SELECT label, min(pos)::INTEGER AS pos, arg_min(embedding[1], pos) AS first_value FROM n WHERE embedding[1] > 0.1 AND pos <= 3 GROUP BY label)
    SELECT l.label::VARCHAR AS handle, u.pos, round(u.first_value::DOUBLE, 6)::DOUBLE AS first_value FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN u USING (label)""",
)
def _(t):
    feature = F.when(F.col("embedding")[0] > 0.1, signatures.vector_feature(F.col("embedding")))
    pictures = t.embeddings.select("vec_id", F.col("label").cast("string").alias("handle"), feature.alias("feature"))
    f = filters.rank_within(pictures, ["handle"], ["vec_id"], "pos").select("handle", "pos", "feature")
    out = I.attach_feature(t.embeddings.select(F.col("label").cast("string").alias("handle")).distinct(), f, first=3)
    return out.select("handle", "pos", F.round(F.col("feature.vec")[0].cast("double"), 6).alias("first_value"))


# --- ordering ----------------------------------------------------------------

_HREFS = "regexp_extract_all(html, '(?is)<a\\b[^>]*\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(
    "w01_first_occurrence",
    f"""WITH a AS (SELECT page_id, {_HREFS} AS hs FROM pages), h AS (SELECT page_id, unnest(range(0, len(hs)))::INTEGER AS pos, unnest(hs) AS href FROM a)
    SELECT href, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn FROM h) WHERE rn = 1""",
)
def _(t):
    from vitrina.sources.extract import hrefs

    h = t.pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    return filters.first_occurrence(h, ["href"], ["page_id", "pos"])


@query(
    "w02_image_at_position",
    f"""WITH {B.IMAGES}, q AS (SELECT DISTINCT l_partkey AS product_id, l_linenumber + 3 AS position FROM lineitem),
    x AS (SELECT product_id, position, min(image_id) AS exact_id FROM images WHERE position IS NOT NULL GROUP BY ALL),
    n AS (SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(position, 999), image_id) AS position, image_id AS nth_id FROM images)
    SELECT q.product_id, q.position, coalesce(exact_id, nth_id) AS image_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN nth_id IS NOT NULL THEN 'nth' ELSE 'missing' END AS how
    FROM q LEFT JOIN x USING (product_id, position) LEFT JOIN n USING (product_id, position)""",
)
def _(t):
    requests = t.lineitem.selectExpr("l_partkey AS product_id", "l_linenumber + 3 AS position").distinct()
    return filters.image_at(requests, B.images(t))


@query("w03_sort_position", f"WITH {B.IMAGES} SELECT image_id, coalesce(position, 999) AS sort_position FROM images")
def _(t):
    return filters.by_position(B.images(t)).select("image_id", "sort_position")


@query(
    "w04_leading_rows",
    f"WITH {B.IMAGES} SELECT product_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(position, 999), image_id) AS rn FROM images) WHERE rn <= 3",
)
def _(t):
    order = [F.coalesce("position", F.lit(999)), "image_id"]
    return filters.leading(B.images(t), ["product_id"], order, 3).select("product_id", "image_id")


@query(
    "w05_compare_sets",
    f"""WITH {B.PRODUCTS}, k AS (SELECT product_id, {S.split_words(S.norm('title'))} AS a, {S.split_words(S.norm("handle || ' ' || p_name"))} || CASE WHEN p_size > 25 THEN [lower(vendor)[1:5]] ELSE [] END AS b FROM products)
    SELECT product_id, {S.joined('list_intersect(a, b)')} AS common, {S.joined('list_filter(a, lambda x: NOT list_contains(b, x))')} AS missing, {S.joined('list_filter(b, lambda x: NOT list_contains(a, x))')} AS extra FROM k""",
)
def _(t):
    from vitrina.functions import text as T

    b = F.array_union(T.words_of(T.normalize_text(F.concat_ws(" ", "handle", "p_name"))),
                      F.expr("if(p_size > 25, array(substr(lower(vendor), 1, 5)), cast(array() as array<string>))"))
    c = B.products(t).select("product_id", filters.compare_sets(T.words_of(T.normalize_text(F.col("title"))), b).alias("c"))
    return c.select("product_id", *[F.array_join(f"c.{n}", " ").alias(n) for n in ("common", "missing", "extra")])
