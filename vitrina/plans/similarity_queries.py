"""Similarity measures and image signatures over titles, documents and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import image_math as IM
from vitrina.functions import similarity as M
from vitrina.functions import text as T
from vitrina.operators import matching, signatures
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query

WITH = f"WITH {B.PRODUCTS}"

# Each product is compared with the page name of its hits.
PAIRS = f"WITH {B.PRODUCTS}, {B.HITS}, pr AS (SELECT h.product_id, h.rank, p.title, h.name, h.spanish FROM hits h JOIN products p USING (product_id))"


def pairs(t, title_tokens, name_tokens, column="name"):
    """Hits with both token sets; tokens are made once per product and once per page."""
    text = F.expr(B.CATALOG_NAME if column == "name" else B.SPANISH)
    pages = t.part.select(F.col("p_partkey").alias("cand_id"), name_tokens(text).alias("b"))
    titles = B.products(t).select("product_id", title_tokens(F.col("title")).alias("a"))
    return B.hits_of_pages(t, pages).select("product_id", "rank", "b").join(titles, "product_id")


def _measure(name, sql_title, sql_name, title_tokens, name_tokens, column="name"):
    @query(
        name,
        f"{PAIRS}, k AS (SELECT product_id, rank, {sql_title} AS a, {sql_name} AS b FROM pr) "
        f"SELECT product_id, rank, round({S.jac('a', 'b')}, 6)::DOUBLE AS score FROM k",
    )
    def _(t):
        k = pairs(t, title_tokens, name_tokens, column)
        return k.select("product_id", "rank", F.round(M.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


def _p(name):
    return lambda c: T.title_tokens(c, lx.PROFILES[name])


def _sq(stop, column, units=False):
    return S.toks(S.norm_units(column) if units else S.norm(column), stop)


_measure("m01_jaccard", _sq(lx.STOP_ACANA, "title"), _sq(lx.STOP_ACANA, "spanish"), _p("acana"), _p("acana"), "spanish")
_measure("m02_stemmed_jaccard", S.stem(_sq(lx.STOP_BEAPHAR, "title")), S.stem(_sq(lx.STOP_BEAPHAR, "spanish")),
         _p("beaphar"), _p("beaphar"), "spanish")
_measure("m03_expanded_jaccard", S.expand(_sq(lx.STOP_CALIBRA, "title"), lx.SYN_CALIBRA),
         S.expand(_sq(lx.STOP_CALIBRA, "name"), lx.SYN_CALIBRA), _p("calibra"), _p("calibra"))
_measure("m04_expanded_stemmed", S.stem(S.expand(_sq(lx.STOP_FARMINA, "title"), lx.SYN_FARMINA)),
         S.stem(S.expand(_sq(lx.STOP_FARMINA, "name"), lx.SYN_FARMINA)), _p("farmina"), _p("farmina"))


@query(
    "m05_enough_overlap",
    f"{PAIRS}, k AS (SELECT product_id, rank, {_sq(lx.STOP_ARTERO, 'title')} AS a, {_sq(lx.STOP_ARTERO, 'spanish')} AS b FROM pr) "
    "SELECT product_id, rank, len(a) > 0 AND len(list_intersect(a, b)) >= CASE WHEN len(a) >= 3 THEN 2 ELSE 1 END AS confirmed FROM k",
)
def _(t):
    k = pairs(t, _p("artero"), _p("artero"), "spanish")
    return k.select("product_id", "rank", M.enough_overlap(F.col("a"), F.col("b")).alias("confirmed"))


# --- signatures: 64 embedding values read as an 8x8 thumbnail ----------------

def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END)::BIGINT"


_BASIS = [[math.cos((math.pi / 8) * (x + 0.5) * u) for x in range(8)] for u in range(8)]
_BASIS_ROWS = ", ".join(f"({u}, {x}, {c!r})" for u, row in enumerate(_BASIS) for x, c in enumerate(row))
HASHES = f"""px AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
 mean AS (SELECT vec_id, sum(v) / count(*) AS m FROM px GROUP BY vec_id),
 ah AS (SELECT vec_id, {signed("sum(CASE WHEN v >= m THEN 1::HUGEINT << i ELSE 0 END)")} AS ahash FROM px JOIN mean USING (vec_id) GROUP BY vec_id),
 dh AS (SELECT a.vec_id, {signed("sum(CASE WHEN a.v > b.v THEN 1::HUGEINT << ((a.i // 8) * 7 + a.i % 8) ELSE 0 END)")} AS dhash
   FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i % 8 < 7 AND a.i < 56 GROUP BY a.vec_id),
 basis(u, x, c) AS (VALUES {_BASIS_ROWS}),
 rowfreq AS (SELECT vec_id, i // 8 AS r, b.u AS f, sum(v * b.c) AS s FROM px JOIN basis b ON b.x = i % 8 GROUP BY ALL),
 coef AS (SELECT vec_id, b.u * 8 + f AS k, sum(s * b.c) AS c FROM rowfreq JOIN basis b ON b.x = r GROUP BY ALL),
 med AS (SELECT vec_id, list_sort(list(c))[32] AS m FROM coef WHERE k > 0 GROUP BY vec_id),
 dc AS (SELECT vec_id, {signed("sum(CASE WHEN c > m THEN 1::HUGEINT << k ELSE 0 END)")} AS dct FROM coef JOIN med USING (vec_id) GROUP BY vec_id),
 hashes AS MATERIALIZED (SELECT vec_id, label, ahash, dhash, dct FROM embeddings JOIN ah USING (vec_id) JOIN dh USING (vec_id) JOIN dc USING (vec_id))"""


def hashes(t):
    px = F.col("embedding")
    return t.embeddings.select(
        "vec_id", "label", IM.average_hash(px).alias("ahash"), IM.difference_hash(px, 7).alias("dhash"),
        IM.dct_hash(px, 8).alias("dct"),
    )


@query("i01_average_hash", f"WITH {HASHES} SELECT vec_id, ahash FROM hashes")
def _(t):
    return t.embeddings.select("vec_id", IM.average_hash(F.col("embedding")).alias("ahash"))


@query("i02_difference_hash", f"WITH {HASHES} SELECT vec_id, dhash FROM hashes")
def _(t):
    return t.embeddings.select("vec_id", IM.difference_hash(F.col("embedding"), 7).alias("dhash"))


@query("i03_dct_hash", f"WITH {HASHES} SELECT vec_id, dct FROM hashes")
def _(t):
    return t.embeddings.select("vec_id", IM.dct_hash(F.col("embedding"), 8).alias("dct"))


def neighbours(h):
    """Each picture beside the next one."""
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"{c}2") for c in h.columns if c != "vec_id"])
    return h.join(other, "vec_id")


@query(
    "m06_hamming",
    f"WITH {HASHES} SELECT a.vec_id, bit_count(xor(a.ahash, b.ahash))::INTEGER AS distance FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1",
)
def _(t):
    h = t.embeddings.select("vec_id", IM.average_hash(F.col("embedding")).alias("ahash"))
    return neighbours(h).select("vec_id", M.hamming(F.col("ahash"), F.col("ahash2")).alias("distance"))


_MULTI = (
    "greatest(0.0, 1.0 - (0.2::DOUBLE * bit_count(xor(a.ahash, b.ahash)) + 0.3::DOUBLE * bit_count(xor(a.dhash, b.dhash)) "
    "+ 0.5::DOUBLE * bit_count(xor(a.dct, b.dct))) / 64.0)"
)


@query(
    "m07_multi_hash",
    f"WITH {HASHES} SELECT a.vec_id, round({_MULTI}, 8)::DOUBLE AS similarity FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1",
)
def _(t):
    h = hashes(t).select("vec_id", F.array("ahash", "dhash", "dct").alias("h"))
    return neighbours(h).select("vec_id", F.round(M.multi_hash_similarity(F.col("h"), F.col("h2")), 8).alias("similarity"))


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def cosine(a: str, b: str) -> str:
    return f"least(1.0, greatest(0.0, {dot(a, b)}))"


@query(
    "m08_cosine",
    f"SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6)::DOUBLE AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _(t):
    e = t.embeddings.select("vec_id", "embedding")
    return neighbours(e).select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("embedding2")), 6).alias("similarity"))


# Labels below 3 have hash features only, label 9 has none.
@query(
    "m09_feature_similarity",
    f"""WITH {HASHES}, f AS (SELECT h.*, e.embedding, CASE WHEN label < 3 THEN 'hash' WHEN label < 9 THEN 'clip' END AS b FROM hashes h JOIN embeddings e USING (vec_id, label))
    SELECT a.vec_id, round(CASE WHEN a.b = b.b AND a.b = 'clip' THEN {cosine('a.embedding', 'b.embedding')} WHEN a.b = b.b AND a.b = 'hash' THEN {_MULTI} ELSE 0.0 END, 8)::DOUBLE AS similarity
    FROM f a JOIN f b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    return neighbours(features(t)).select("vec_id", F.round(M.feature_similarity(F.col("feature"), F.col("feature2")), 8).alias("similarity"))


def features(t):
    """``vec_id, label, feature`` with all three kinds of missing and present features."""
    f = hashes(t).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    feature = F.when(F.col("label") < 3, signatures.hash_feature(F.col("ahash"), F.col("dhash"), F.col("dct"))).when(
        F.col("label") < 9, signatures.vector_feature(F.col("embedding"))
    )
    return f.select("vec_id", "label", feature.alias("feature"))


_PHOTOS3 = "ph AS (SELECT label, vec_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 3)"


@query(
    "m10_best_similarity",
    f"WITH {_PHOTOS3} SELECT e.vec_id, round(max({cosine('e.embedding', 'ph.embedding')}), 6)::DOUBLE AS best FROM embeddings e JOIN ph USING (label) GROUP BY e.vec_id",
)
def _(t):
    photos = t.embeddings.select(F.col("label").cast("bigint").alias("product_id"), F.col("vec_id").alias("pos"),
                                 signatures.vector_feature(F.col("embedding")).alias("feature"))
    cands = t.embeddings.select(F.col("label").cast("bigint").alias("product_id"), F.col("vec_id").cast("string").alias("handle"))
    feats = t.embeddings.select(F.col("vec_id").cast("string").alias("handle"),
                                signatures.vector_feature(F.col("embedding")).alias("feature"))
    sims = matching.image_similarity(cands, photos, feats)
    return sims.select(F.col("handle").cast("bigint").alias("vec_id"), F.round("img", 6).alias("best"))


@query(
    "m11_stage_factor",
    f"""{PAIRS}, k AS (SELECT product_id, rank, {S.translate(_sq(lx.STOP_APPLAWS, 'title', True), lx.TR_APPLAWS)} AS a, {_sq(lx.STOP_APPLAWS, 'name', True)} AS b FROM pr),
    s AS (SELECT product_id, rank, b, {{}} AS sa, {{}} AS sb FROM k)
    SELECT product_id, rank, CASE WHEN sa = 'junior' AND NOT list_contains(b, 'kitten') THEN 0.5 WHEN sa <> '' AND sb <> '' AND sa <> sb THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM s""".replace(
        "{}", "{0}", 1).replace("{}", "{1}", 1).replace("{0}", f"CASE WHEN {S.overlap_any('a', ['kitten', 'puppy'])} THEN 'junior' WHEN list_contains(a, 'senior') THEN 'senior' WHEN list_contains(a, 'adult') THEN 'adult' ELSE '' END").replace(
        "{1}", f"CASE WHEN {S.overlap_any('b', ['kitten', 'puppy'])} THEN 'junior' WHEN list_contains(b, 'senior') THEN 'senior' WHEN list_contains(b, 'adult') THEN 'adult' ELSE '' END"),
)
def _(t):
    k = pairs(
        t, lambda c: T.translate_tokens(T.tokenize(c, lx.STOP_APPLAWS, "after"), lx.TR_APPLAWS),
        lambda c: T.tokenize(c, lx.STOP_APPLAWS, "after"),
    )
    return k.select("product_id", "rank", M.stage_factor(
        T.stage_of_tokens(F.col("a")), T.stage_of_tokens(F.col("b")), F.array_contains("b", "kitten")).alias("factor"))


# Label 0 has no usable photo: its candidates score zero.
@query(
    "m12_score_candidates",
    f"WITH {_PHOTOS3} SELECT e.vec_id, round(coalesce(max(CASE WHEN ph.label > 0 THEN {cosine('e.embedding', 'ph.embedding')} END), 0.0), 6)::DOUBLE AS score FROM embeddings e JOIN ph USING (label) GROUP BY e.vec_id",
)
def _(t):
    photos = t.embeddings.where("label > 0").select(
        F.col("label").cast("bigint").alias("product_id"), F.col("vec_id").alias("pos"),
        signatures.vector_feature(F.col("embedding")).alias("feature"))
    cands = t.embeddings.select(F.col("label").cast("bigint").alias("product_id"), F.col("vec_id").cast("string").alias("handle"))
    feats = t.embeddings.select(F.col("vec_id").cast("string").alias("handle"),
                                signatures.vector_feature(F.col("embedding")).alias("feature"))
    sims = matching.image_similarity(cands, photos, feats)
    return sims.select(F.col("handle").cast("bigint").alias("vec_id"), F.round(F.coalesce("img", F.lit(0.0)), 6).alias("score"))


@query(
    "m13_similarity_band",
    f"""WITH {HASHES}, s AS (SELECT a.vec_id, CASE WHEN a.label < 3 THEN 'hash' ELSE 'clip' END AS backend, round({_MULTI}, 6) + a.label / 25.0 AS s FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN s >= CASE backend WHEN 'clip' THEN 0.82 ELSE 0.86 END THEN 'same' WHEN s <= CASE backend WHEN 'clip' THEN 0.62 ELSE 0.72 END THEN 'different' ELSE 'uncertain' END AS band FROM s""",
)
def _(t):
    h = hashes(t).select("vec_id", "label", F.array("ahash", "dhash", "dct").alias("h"))
    s = F.round(M.multi_hash_similarity(F.col("h"), F.col("h2")), 6) + F.col("label") / 25.0
    backend = F.when(F.col("label") < 3, "hash").otherwise("clip")
    return neighbours(h).select("vec_id", M.similarity_band(s, backend).alias("band"))
