"""Text and image resolution: every oracle scores all pairs and picks by plain ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import text as T
from vitrina.operators import matching, signatures, simjoin
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query
from vitrina.plans.similarity_queries import cosine
from vitrina.plans.text_queries import base_title, form, grams, size_free, sub_brand
from vitrina.lexicon import SIZE_PATTERN

PR = lx.PROFILES
_RULES = (("first", ("BRAND#1 ", "BRAND#10")), ("teens", ("BRAND#1",)), ("rest", ("BRAND#2",)))
SPECIES_Q = lambda c: S.species(S.split_words(S.norm(c)), lx.DOG_MARKERS, lx.CAT_MARKERS)
SPECIES_E = lambda c: S.species(S.split_words(S.norm(c)), lx.DOG_MARKERS, lx.CAT_MARKERS_WIDE)
COMPATIBLE = "(sq = '' OR se = '' OR sq = se)"


def best(pairs: str, accept: float, order: str = "score DESC, ord", out: str = "product_id, handle, round(score, 6)::DOUBLE AS score") -> str:
    """Pick the first pair of each product."""
    return (
        f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS rn FROM ({pairs}) z) y "
        f"WHERE rn = 1 AND score >= {accept} - 1e-9"
    )


def sides(tq: str, te: str, qsrc="products", esrc="catalog", qextra="", eextra="") -> str:
    return (
        f"q AS MATERIALIZED (SELECT product_id, {tq} AS a{qextra} FROM {qsrc}), "
        f"e AS MATERIALIZED (SELECT handle, ord, {te} AS b{eextra} FROM {esrc})"
    )


# --- one profile each --------------------------------------------------------

_RAW_SIDES = sides(S.toks(S.norm("title"), lx.STOP_ACANA), S.toks(S.norm("name"), lx.STOP_ACANA), "rawp", "rawc",
                   f", {sub_brand('title', _RULES)} AS sq", ", brand AS se")
_RAW_PAIRS = f"SELECT product_id, handle, ord, sq, se, {S.jac('a', 'b')} AS score FROM q, e"


@query("j01_match_best", f"WITH {B.RAW}, {_RAW_SIDES} {best(_RAW_PAIRS, 0.20)}")
def _(t):
    m = matching.match_best(B.raw_products(t), B.raw_catalog(t), PR["acana"], ("name",))
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


CAL_Q = S.expand(S.toks(S.norm("title"), lx.STOP_CALIBRA), lx.SYN_CALIBRA)
CAL_E = S.expand(S.toks(S.norm("handle || ' ' || name"), lx.STOP_CALIBRA), lx.SYN_CALIBRA)
CAL_SIDES = sides(CAL_Q, CAL_E, qextra=f", {SPECIES_Q('title')} AS sq", eextra=f", {SPECIES_E(chr(39).join(['handle || ', ' ', ' || name']))} AS se")
CAL_PAIRS = f"SELECT product_id, handle, ord, {S.jac('a', 'b')} AS score FROM q, e WHERE {COMPATIBLE}"
CALIBRA = f"WITH {B.PRODUCTS}, {B.CATALOG}, {CAL_SIDES}"


@query("j05_species_guard", f"{CALIBRA} {best(CAL_PAIRS, 0.30)}")
def _(t):
    m = matching.match_best(B.products(t), B.catalog(t), PR["calibra"])
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


_UK_T = S.drop_numeric(S.translate(S.toks(S.norm_units("title"), lx.STOP_APPLAWS), lx.TR_APPLAWS))
_UK_N = S.toks(S.norm_units("name"), lx.STOP_APPLAWS)


def animal(k: str) -> str:
    return f"CASE WHEN {S.overlap_any(k, ['dog', 'puppy'])} THEN 'dog' WHEN {S.overlap_any(k, ['cat', 'kitten'])} THEN 'cat' ELSE '' END"


def stage(k: str) -> str:
    return (
        f"CASE WHEN {S.overlap_any(k, ['kitten', 'puppy'])} THEN 'junior' WHEN list_contains({k}, 'senior') THEN 'senior' "
        f"WHEN list_contains({k}, 'adult') THEN 'adult' ELSE '' END"
    )


UK_GUARD = "CASE WHEN aq = 'dog' THEN ae = 'dog' ELSE ae <> 'dog' END"
UK_FACTOR = (
    "CASE WHEN gq = 'junior' AND NOT list_contains(b0, 'kitten') THEN 0.5 WHEN gq <> '' AND ge <> '' AND gq <> ge THEN 0.5 ELSE 1.0 END"
)


@query(
    "j06_asymmetric_guard",
    f"""WITH {B.PRODUCTS}, {B.CATALOG}, q0 AS (SELECT product_id, {_UK_T} AS a0 FROM products), e0 AS (SELECT handle, ord, {_UK_N} AS b0 FROM catalog),
    q AS MATERIALIZED (SELECT product_id, {S.stem('a0')} AS a, {animal('a0')} AS aq, {stage('a0')} AS gq FROM q0),
    e AS MATERIALIZED (SELECT handle, ord, b0, {S.stem('b0')} AS b, {animal('b0')} AS ae, {stage('b0')} AS ge FROM e0)
    {best(f"SELECT product_id, handle, ord, {S.jac('a', 'b')} * {UK_FACTOR} AS score FROM q, e WHERE {UK_GUARD}", 0.22, "score DESC, handle DESC")}""",
)
def _(t):
    m = matching.match_best(B.products(t), B.catalog(t), PR["applaws_uk"], ("name",))
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


@query(
    "j07_sub_brand_block",
    f"WITH {B.RAW}, {_RAW_SIDES} {best(f'SELECT * FROM ({_RAW_PAIRS}) p WHERE sq = ' + chr(39) + 'unknown' + chr(39) + ' OR se = ' + chr(39) + chr(39) + ' OR sq = se', 0.20)}",
)
def _(t):
    from dataclasses import replace

    profile = replace(PR["acana"], name="acana_blocked")
    cat = B.raw_catalog(t)
    res = matching.Resolution(
        B.raw_products(t), cat, profile, ("name",), query_guards=T.sub_brand(F.col("title"), _RULES),
        entry_guards=F.coalesce("brand", F.lit("")), guard=lambda q, e: (q == "unknown") | (e == "") | (q == e),
    )
    return res.best().select("product_id", "handle", F.round("score", 6).alias("score"))


# --- blocks with fallback ----------------------------------------------------

def _entry_flags(name: str, handle: str) -> str:
    both = f"{name} || chr(10) || {handle}"
    dog, cat = S.any_in(f"lower({both})", lx.FEED_DOG_ENTRY), S.any_in(f"lower({both})", lx.FEED_CAT_ENTRY)
    return (
        f"({dog} OR NOT {cat}) AS for_dog, ({cat} OR NOT {dog}) AS for_cat, {S.any_in(f'lower({both})', lx.FEED_SNACK)} AS snack, "
        f"contains(upper({both}), 'SEMI') AS semiwet, ({S.any_in(f'upper({both})', lx.FEED_WET)} OR contains(lower({handle}), 'wet')) AS wet"
    )


_TITLE_SPECIES = (
    f"CASE WHEN {S.any_in('lower(title)', lx.FEED_DOG_TITLE)} THEN 'dog' WHEN {S.any_in('lower(title)', lx.FEED_CAT_TITLE)} THEN 'cat' ELSE '' END"
)
FEED_T = S.sep_toks(S.preprocess("title", lx.TR_FEED, False), lx.STOP_FEED)


def blocked(catalog: str, name: str) -> str:
    """CTEs ending in ``p``: the pairs left after species and form blocks with fallback."""
    tokens = S.sep_toks(S.preprocess(f"{name} || ' ' || handle", lx.TR_FEED, False), lx.STOP_FEED)
    in_species = "CASE sp WHEN 'dog' THEN for_dog WHEN 'cat' THEN for_cat ELSE true END"
    in_form = "CASE fm WHEN 'snack' THEN snack WHEN 'semiwet' THEN semiwet WHEN 'wet' THEN wet ELSE true END"
    return f"""q AS MATERIALIZED (SELECT product_id, title, {FEED_T} AS a, {_TITLE_SPECIES} AS sp, {form('title')} AS fm FROM products),
    e AS MATERIALIZED (SELECT handle, ord, vendor, {tokens} AS b, {_entry_flags(name, 'handle')} FROM {catalog}),
    cls AS (SELECT DISTINCT sp, fm FROM q),
    lv1 AS (SELECT sp, fm, bool_or({in_species}) AS has_species FROM cls, e GROUP BY sp, fm),
    lv2 AS (SELECT sp, fm, has_species, bool_or((NOT has_species OR {in_species}) AND {in_form}) AS has_form FROM lv1, e GROUP BY ALL),
    p AS (SELECT q.product_id, q.title, e.handle, e.ord, e.vendor, {S.jac('a', 'b')} AS score FROM q JOIN lv2 USING (sp, fm), e
      WHERE (NOT has_species OR {in_species}) AND (NOT has_form OR {in_form}))"""


_BISCUIT = "replace(name, 'Snack', 'Biscuit')"
_BISCUIT_CATALOG = f"biscuits AS (SELECT replace(handle, 'snack', 'biscuit') AS handle, ord, vendor, {_BISCUIT} AS name FROM catalog)"


@query("j08_block_fallback", f"WITH {B.PRODUCTS}, {B.CATALOG}, {_BISCUIT_CATALOG}, {blocked('biscuits', 'name')} {best('SELECT * FROM p', 0.10)}")
def _(t):
    cat = B.catalog(t).withColumn("handle", F.replace("handle", F.lit("snack"), F.lit("biscuit"))).withColumn(
        "name", F.expr(_BISCUIT))
    m = matching.match_blocked(B.products(t), cat, PR["alpha_spirit"])
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


_DIET_TITLE = (
    f"CASE WHEN p_size > 30 THEN 'FARMINA VET LIFE ' ELSE 'FARMINA ' END || replace({B.TITLE}, 'SNACKS', 'TREAT')"
)
_DIET_OUT = {
    "handle": f"CASE WHEN p_type = 'ECONOMY' THEN {B.HANDLE} || '-300g' ELSE {B.HANDLE} END", "ord": "ord",
    "name": f"CASE WHEN p_type = 'PROMO' THEN replace({B.CATALOG_NAME}, 'Wet Pouch', 'húmedo') WHEN p_type = 'MEDIUM' AND "
            f"{B.ADJECTIVE} <> 'large' THEN replace({B.CATALOG_NAME}, 'Snack', 'dental treat') ELSE {B.CATALOG_NAME} END",
    "species": f"CASE WHEN {B.ADJECTIVE} IN ('blue', 'hot', 'new') THEN 'dog' ELSE 'cat' END",
}
_DQ = S.sep_toks(S.preprocess("replace(replace(replace(upper(title), 'FARMINA VET LIFE ', ''), 'FARMINA VETLIFE ', ''), 'FARMINA ', '')", lx.TR_VETLIFE, True), lx.STOP_VETLIFE, False)
_DE = S.sep_toks(S.preprocess("handle || ' ' || name", lx.TR_VETLIFE, True), lx.STOP_VETLIFE, False)


@query(
    "j09_diet_blocks",
    f"""WITH dp AS (SELECT p_partkey AS product_id, {B._sql(_DIET_TITLE)} AS title FROM part),
    dcat AS (SELECT {B._sql(B._select(_DIET_OUT))} FROM (SELECT p_name, p_type, min(p_partkey) AS ord FROM part GROUP BY p_name, p_type) g),
    q AS MATERIALIZED (SELECT product_id, {_DQ} AS a, CASE WHEN {S.any_in('lower(title)', lx.VETLIFE_DOG_TITLE)} THEN 'dog' WHEN {S.any_in('lower(title)', lx.VETLIFE_CAT_TITLE)} THEN 'cat' ELSE '' END AS sp,
      contains(lower(title), 'treat') AS tr, {S.any_in('upper(title)', lx.VETLIFE_WET)} AS wt FROM dp),
    e AS MATERIALIZED (SELECT handle, ord, species, {_DE} AS b, contains(lower(name), 'treat') OR contains(lower(handle), 'treat') AS et,
      contains(lower(name), 'húmedo') OR contains(handle, '300g') OR contains(handle, '85g') AS ew FROM dcat),
    cls AS (SELECT DISTINCT sp, tr, wt FROM q),
    l1 AS (SELECT sp, tr, wt, coalesce(bool_or(tr AND et) FILTER (WHERE sp = '' OR species = sp), false) AS ht FROM cls, e GROUP BY sp, tr, wt),
    l2 AS (SELECT sp, tr, wt, ht, coalesce(bool_or(ew = wt) FILTER (WHERE (sp = '' OR species = sp) AND (NOT ht OR et)), false) AS hf FROM l1, e GROUP BY sp, tr, wt, ht),
    p AS (SELECT q.product_id, e.handle, e.ord, {S.jac('a', 'b')} AS score FROM q JOIN l2 USING (sp, tr, wt), e
      WHERE (sp = '' OR species = sp) AND (NOT ht OR et) AND (NOT hf OR ew = wt))
    {best('SELECT * FROM p', 0.10)}""",
)
def _(t):
    p = B._view(t.part, {"product_id": "p_partkey", "title": _DIET_TITLE})
    g = t.part.groupBy("p_name", "p_type").agg({"p_partkey": "min"}).withColumnRenamed("min(p_partkey)", "ord")
    m = matching.match_diet(p, B._view(g, _DIET_OUT), PR["vetlife_legacy"])
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


# Handles that carry a unit weight, so equal weights can break near-ties.
_WEIGHED_OUT = {
    "handle": "handle || '-' || cast(grams as string) || 'gr'", "ord": "ord", "name": "name", "vendor": "vendor",
}
_WEIGHED = f"""weighed AS (SELECT {B._sql(B._select(_WEIGHED_OUT))} FROM (SELECT {B._sql(B.HANDLE)} AS handle, {B._sql(B.CATALOG_NAME)} AS name,
  p_size AS grams, min(p_partkey) AS ord, min(p_brand) AS vendor FROM part GROUP BY p_name, p_type, p_size) g)"""


@query(
    "j10_bonuses",
    f"""WITH {B.PRODUCTS}, {_WEIGHED}, {blocked('weighed', 'name')},
    s AS (SELECT *, score + CASE WHEN lower(vendor) = 'brand#1' THEN 0.01 ELSE 0.0 END::DOUBLE AS s FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM p) WHERE score > 0),
    m AS (SELECT *, max(s) OVER (PARTITION BY product_id) AS top FROM s),
    w AS (SELECT product_id, handle, ord, round(s, 12) AS s, round(s + CASE WHEN abs(s - top) < 0.02 AND {grams('title')} = {grams('handle')} AND n > 1 THEN 0.005 ELSE 0.0 END::DOUBLE, 12) AS s2 FROM m),
    b AS (SELECT product_id, handle, least(1.0, s2) AS score, row_number() OVER (PARTITION BY product_id ORDER BY s2 DESC, s DESC, ord) AS rn FROM w)
    SELECT product_id, handle, round(score, 6)::DOUBLE AS score FROM b WHERE rn = 1 AND score >= 0.10 - 1e-9""",
)
def _(t):
    g = t.part.groupBy("p_name", "p_type", "p_size").agg({"p_partkey": "min", "p_brand": "min"}).selectExpr(
        f"{B.HANDLE} AS handle", f"{B.CATALOG_NAME} AS name", "p_size AS grams", "`min(p_partkey)` AS ord", "`min(p_brand)` AS vendor")
    m = matching.match_blocked_bonus(B.products(t), B._view(g, _WEIGHED_OUT), PR["alpha_spirit"], "brand#1")
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


@query(
    "j11_top_candidates",
    f"""WITH {B.RAW}, {_RAW_SIDES} SELECT product_id, handle, round(score, 6)::DOUBLE AS score, rank::INTEGER AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, ord) AS rank FROM ({_RAW_PAIRS}) z WHERE score >= 0.20 - 1e-9) y WHERE rank <= 3""",
)
def _(t):
    res = matching.Resolution(B.raw_products(t), B.raw_catalog(t), PR["acana"], ("name",))
    return res.top(3).select("product_id", "handle", F.round("score", 6).alias("score"), "rank")


# --- image confirmation ------------------------------------------------------
# Photo of a product: the vector with its id; feature of an entry: the vector of its first part.

def photos(t):
    return t.embeddings.select(F.col("vec_id").alias("product_id"), F.lit(1).alias("pos"),
                               signatures.vector_feature(F.col("embedding")).alias("feature"))


def entry_features(t):
    e = t.embeddings.select(F.col("vec_id").alias("ord"), signatures.vector_feature(F.col("embedding")).alias("feature"))
    return B.catalog(t).select("handle", "ord").join(e, "ord").select("handle", "feature")


TIES = f"""{CALIBRA}, p AS ({CAL_PAIRS}), t0 AS (SELECT *, max(score) OVER (PARTITION BY product_id) AS top FROM p),
  near AS (SELECT product_id, handle, ord, score FROM t0 WHERE top >= 0.30 - 1e-9 AND score >= top - 0.08 - 1e-9),
  sim AS (SELECT n.*, f.vec_id IS NOT NULL AS has_photo, {cosine('f.embedding', 'c.embedding')} AS img FROM near n LEFT JOIN embeddings f ON f.vec_id = n.product_id
    LEFT JOIN embeddings c ON c.vec_id = n.ord),
  pick AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN has_photo THEN coalesce(img, -1.0) ELSE 0.0 END DESC, round(score, 12) DESC, ord) AS rn
    FROM (SELECT * REPLACE (CASE WHEN has_photo THEN img END AS img) FROM sim))"""


@query(
    "j12_image_tiebreak",
    f"{TIES} SELECT product_id, handle, round(score, 6)::DOUBLE AS score, round(img, 6)::DOUBLE AS img FROM pick WHERE rn = 1 AND score >= 0.30 - 1e-9",
)
def _(t):
    m = matching.match_image_tiebreak(B.products(t), B.catalog(t), photos(t), entry_features(t), PR["calibra"])
    return m.select("product_id", "handle", F.round("score", 6).alias("score"), F.round("img", 6).alias("img"))


@query(
    "j13_image_gate",
    f"{TIES} SELECT product_id, handle, round(score, 6)::DOUBLE AS score, NOT has_photo OR coalesce(img, -1.0) >= 0.6 AS accepted FROM pick WHERE rn = 1 AND score >= 0.30 - 1e-9",
)
def _(t):
    m = matching.match_image_tiebreak(B.products(t), B.catalog(t), photos(t), entry_features(t), PR["calibra"], gate=0.60)
    return m.select("product_id", "handle", F.round("score", 6).alias("score"), "accepted")


_FQ = f"trim({S.rxi('title', r'\b\d+(?:[.,]\d+)?\s*(?:kg|g|gr|lb)\b', '')})"


@query(
    "j14_image_first",
    f"""WITH {B.PRODUCTS}, {B.CATALOG},
    q AS MATERIALIZED (SELECT product_id, {S.stem(S.expand(S.toks(S.norm(_FQ), lx.STOP_FARMINA), lx.SYN_FARMINA))} AS a, {SPECIES_Q('title')} AS sq FROM products),
    e AS MATERIALIZED (SELECT handle, ord, {S.stem(S.expand(S.toks(S.norm("handle || ' ' || name"), lx.STOP_FARMINA), lx.SYN_FARMINA))} AS b,
      coalesce(nullif(CASE WHEN contains(lower(url), 'alimento-para-perros') OR contains(lower(url), 'canine') THEN 'dog' WHEN contains(lower(url), 'alimento-para-gatos') OR contains(lower(url), 'feline') THEN 'cat' ELSE '' END, ''), {SPECIES_Q('name')}) AS se FROM catalog),
    p AS (SELECT product_id, handle, ord, {S.jac('a', 'b')} AS score FROM q, e WHERE {COMPATIBLE}),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, ord) AS rk FROM p WHERE score > 0) WHERE rk <= 8),
    s AS (SELECT k.*, f.vec_id IS NOT NULL AS active, coalesce({cosine('f.embedding', 'c.embedding')}, -1.0) AS img FROM k LEFT JOIN embeddings f ON f.vec_id = k.product_id LEFT JOIN embeddings c ON c.vec_id = k.ord),
    w AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY rk) AS rn FROM s WHERE NOT active OR (img >= 0.6 AND ord IN (SELECT vec_id FROM embeddings)))
    SELECT product_id, handle, round(score, 6)::DOUBLE AS score, CASE WHEN active THEN 'image' ELSE 'text' END AS method FROM w
    WHERE rn = 1 AND score >= CASE WHEN active THEN 0.12 ELSE 0.25 END - 1e-9""",
)
def _(t):
    m = matching.match_image_first(B.products(t), B.catalog(t), photos(t), entry_features(t), PR["farmina"])
    return m.select("product_id", "handle", F.round("score", 6).alias("score"), "method")


# --- self similarity ---------------------------------------------------------

def self_tokens(x: str) -> str:
    b = S.rx(S.rx(S.bare(x), SIZE_PATTERN, " "), r"[/\-_]+", " ")
    return (
        rf"list_filter(list_distinct(string_split_regex(trim({b}), '\s+')), lambda w: w <> '' AND NOT list_contains({S.lst(lx.STOP_SELF)}, w))"
    )


def similar_sql(source: str, tokens: str, threshold: float) -> str:
    return f"""k AS (SELECT product_id, list_sort({tokens}) AS k FROM {source}),
    s AS MATERIALIZED (SELECT k, min(product_id) AS id, count(*) AS n FROM k WHERE len(k) > 0 GROUP BY k),
    pr AS (SELECT a.id AS a, b.id AS b, {S.jac('a.k', 'b.k')} AS score, a.n AS n_a, b.n AS n_b, a.n * b.n AS n_pairs FROM s a JOIN s b ON a.id < b.id
      WHERE len(a.k) * 1.0 <= len(b.k) / {threshold} + 1e-9 AND len(b.k) * 1.0 <= len(a.k) / {threshold} + 1e-9)
    SELECT a, b, round(score, 6)::DOUBLE AS score, n_a, n_b, n_pairs FROM pr WHERE score >= {threshold} - 1e-9
    UNION ALL SELECT id, id, 1.0::DOUBLE, n, n, n * (n - 1) // 2 FROM s WHERE n > 1"""


_LONG = "title || ' ' || p_name || ' ' || lower(p_type) || ' complete food'"


@query("j23_similar_products", f"WITH {B.PRODUCTS}, longer AS (SELECT product_id, {_LONG} AS title FROM products), {similar_sql('longer', self_tokens('title'), 0.8)}")
def _(t):
    m = matching.similar_products(B.products(t).select("product_id", F.expr(_LONG).alias("title")), 0.80)
    return m.withColumn("score", F.round("score", 6))


@query(
    "j23_similar_documents",
    f"WITH docs AS (SELECT doc_id AS product_id, text FROM documents), {similar_sql('docs', S.toks(S.norm('text'), lx.STOP_GENERIC), 0.8)}",
)
def _(t):
    rows = t.documents.select("doc_id", T.tokenize(F.col("text"), lx.STOP_GENERIC).alias("tokens"))
    m = matching.similar_pairs_of_sets(simjoin.distinct_sets(rows, "doc_id"), 0.80)
    return m.withColumn("score", F.round("score", 6))


# --- a catalogue that grows with the tables: every pair that shares a word is counted ----------------------

_GROWN_PAIRS = f"""WITH {B.GROWN},
    q AS MATERIALIZED (SELECT product_id, a, len(a) AS na FROM (SELECT product_id, {S.toks(S.norm('title'), lx.STOP_ACANA)} AS a FROM sold) x),
    e AS MATERIALIZED (SELECT handle, ord, b, len(b) AS nb FROM (SELECT handle, ord, {S.toks(S.norm('name'), lx.STOP_ACANA)} AS b FROM grown) y),
    qw AS (SELECT product_id, na, unnest(a) AS w FROM q), ew AS (SELECT handle, ord, nb, unnest(b) AS w FROM e),
    pr AS (SELECT product_id, handle, ord, count(*)::DOUBLE / (na + nb - count(*)) AS score FROM qw JOIN ew USING (w)
      GROUP BY product_id, handle, ord, na, nb)"""


@query("j01_growing_catalogue", f"{_GROWN_PAIRS} {best('SELECT * FROM pr', 0.20)}")
def _(t):
    m = matching.match_best(B.sold_products(t), B.grown_catalog(t), PR["acana"], ("name",))
    return m.select("product_id", "handle", F.round("score", 6).alias("score"))


@query(
    "j11_growing_catalogue",
    f"{_GROWN_PAIRS} SELECT product_id, handle, round(score, 6)::DOUBLE AS score, rn::INTEGER AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, ord) AS rn FROM pr WHERE score >= 0.4 - 1e-9) z WHERE rn <= 3",
)
def _(t):
    m = matching.Resolution(B.sold_products(t), B.grown_catalog(t), PR["acana"], ("name",)).top(3, accept=0.4)
    return m.select("product_id", "handle", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))
