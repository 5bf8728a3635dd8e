"""Text functions over titles, documents and page headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import text as T
from vitrina.plans import bindings as B
from vitrina.plans import sqltext as S
from vitrina.plans.registry import query

WITH = f"WITH {B.PRODUCTS}"
def _title():
    return F.col("title")


def _tokens(c):
    return F.array_join(F.sort_array(c), " ")


@query("t01_normalize_text", f"SELECT doc_id, md5({S.norm('text')}) AS norm_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("norm_md5"))


@query("t02_glued_units", f"{WITH} SELECT product_id, {S.norm_glued('title')} AS norm FROM products")
def _(t):
    return B.products(t).select("product_id", T.normalize_glued_units(_title()).alias("norm"))


@query("t03_unit_split", f"{WITH} SELECT product_id, {S.norm_units('title')} AS norm FROM products")
def _(t):
    return B.products(t).select("product_id", T.normalize_units(_title()).alias("norm"))


_VT = S.ascii_fold("title")
_VT = S.rx(S.rx(_VT, r"(\d)([a-z])", r"\1 \2"), r"([a-z])(\d)", r"\1 \2")
_VT = (
    f"list_filter(list_distinct(regexp_extract_all({_VT}, '[a-z0-9]+')), "
    f"lambda w: NOT list_contains({S.lst(lx.STOP_VARIANT_IMAGE)}, w))"
)


@query("t04_variant_tokens", f"{WITH} SELECT product_id, {S.joined(_VT)} AS tokens FROM products")
def _(t):
    return B.products(t).select("product_id", _tokens(T.variant_tokens(_title())).alias("tokens"))


def _unit_slug(x: str) -> str:
    n = S.rx(S.norm(S.noise(x)), r"(\d+)\s+(ml|gr|kg|g|l|oz)\b", r"\1\2")
    return S.dashed(n)


@query("t05_unit_join_slug", f"{WITH} SELECT product_id, {_unit_slug('title')} AS slug FROM products")
def _(t):
    return B.products(t).select("product_id", T.unit_join_slug(_title()).alias("slug"))


@query(
    "t06_vendor_slug",
    "SELECT p_partkey AS product_id, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
)
def _(t):
    return t.part.select(F.col("p_partkey").alias("product_id"), T.vendor_slug(F.col("p_brand")).alias("slug"))


def _tslug(x: str) -> str:
    return f"trim({S.rx(S.ascii_fold(x), '[^a-z0-9]+', '-')}, '-')"


_H1 = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query("t07_title_slug", f"SELECT page_id, {_tslug(_H1)} AS slug FROM pages")
def _(t):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return t.pages.select("page_id", T.title_slug(title).alias("slug"))


_DS = _tslug(S.noise("title", True))


@query(
    "t08_direct_slug",
    f"{WITH} SELECT product_id, CASE WHEN {_DS} <> '' AND NOT starts_with({_DS}, 'brand-1') THEN 'brand-1-' || {_DS} "
    f"ELSE {_DS} END AS slug FROM products",
)
def _(t):
    return B.products(t).select("product_id", T.direct_slug(_title(), "brand-1").alias("slug"))


@query(
    "t09_title_key",
    f"{WITH} SELECT product_id, {S.dashed(S.norm(S.noise('title', True)))} AS plain_key, "
    f"{S.dashed(S.norm_units(S.noise('title', True)))} AS unit_key FROM products",
)
def _(t):
    return B.products(t).select(
        "product_id", T.title_key(_title()).alias("plain_key"), T.title_key(_title(), units=True).alias("unit_key")
    )


_SK = S.joined(S.toks(S.norm("title"), lx.STOP_CHURU), "-")


@query(
    "t10_sorted_title_key",
    f"{WITH} SELECT product_id, CASE WHEN {_SK} <> '' THEN {_SK} ELSE trim({S.norm('title')}) END AS sorted_key FROM products",
)
def _(t):
    return B.products(t).select("product_id", T.sorted_title_key(_title(), lx.STOP_CHURU).alias("sorted_key"))


_LINE = r"^(?:FARMINA\s+)?(?:N(?:&|AND)D\s+|ND\s+|VET\s+LIFE\s+|VETLIFE\s+)"
_WEIGHT = r"\b\d+(?:[.,]\d+)?\s*(?:kg|g|gr|lb)\b"


def size_free(x: str) -> str:
    return S.dashed(S.norm(f"trim({S.rxi(f'regexp_replace(trim({x}), {S.quote(_LINE)}, {S.quote('')}, {S.quote('i')})', _WEIGHT, '')})"))


@query("t11_size_free_key", f"{WITH} SELECT product_id, {size_free('title')} AS recipe_key FROM products")
def _(t):
    return B.products(t).select("product_id", T.size_free_key(_title()).alias("recipe_key"))


@query(
    "t12_store_noise",
    f"{WITH} SELECT product_id, {S.noise('title')} AS without_marks, {S.noise('title', True)} AS without_stars, "
    f"trim({S.rx(S.rxi('title', S.NOISE_FULL, ' '), r'\s+', ' ')}) AS search_title FROM products",
)
def _(t):
    return B.products(t).select(
        "product_id", T.remove_store_noise(_title()).alias("without_marks"),
        T.remove_store_noise(_title(), stars=True).alias("without_stars"), T.search_title(_title()).alias("search_title"),
    )


def base_title(x: str) -> str:
    b = f"regexp_replace({S.bare(x)}, {S.quote(lx.VENDOR_PREFIX)}, '')"
    b = S.rx(S.rx(b, lx.SIZE_PATTERN, " "), r"[/\-_]+", " ")
    return f"trim({S.rx(b, r'\s+', ' ')})"


@query("t13_base_title", f"{WITH} SELECT product_id, {base_title('title')} AS base_title FROM products")
def _(t):
    return B.products(t).select("product_id", T.base_title(_title()).alias("base_title"))


_DIET = "replace(replace(title, 'MAXI', 'MED/MAX @web'), 'SNACKS', 'GASTRO  INTESTINAL (x)')"


@query("t14_vet_preprocess", f"{WITH} SELECT product_id, {S.preprocess(_DIET, lx.TR_VETLIFE, True)} AS prepared FROM products")
def _(t):
    return B.products(t).select("product_id", T.vet_preprocess(F.expr(_DIET)).alias("prepared"))


@query("t15_feed_preprocess", f"{WITH} SELECT product_id, {S.preprocess('title', lx.TR_FEED, False)} AS prepared FROM products")
def _(t):
    return B.products(t).select("product_id", T.feed_preprocess(_title()).alias("prepared"))


def grams(x: str) -> str:
    return (
        rf"try_cast(coalesce(nullif(regexp_extract(lower({x}), '\d+\s*[x×]\s*(\d+)\s*gr', 1), ''), "
        rf"nullif(regexp_extract(lower({x}), '(\d+)\s*gr', 1), '')) AS BIGINT)"
    )


@query("t16_weight_grams", f"{WITH} SELECT product_id, {grams('title')} AS grams FROM products")
def _(t):
    return B.products(t).select("product_id", T.weight_grams(_title()).alias("grams"))


_DT = S.toks(S.norm("text"), lx.STOP_GENERIC)


@query("t17_tokenize", f"SELECT doc_id, len({_DT})::BIGINT AS n_tokens, md5({S.joined(_DT)}) AS tokens_md5 FROM documents")
def _(t):
    d = t.documents.select("doc_id", T.tokenize(F.col("text"), lx.STOP_GENERIC).alias("k"))
    return d.select("doc_id", F.size("k").cast("bigint").alias("n_tokens"), F.md5(_tokens(F.col("k"))).alias("tokens_md5"))


@query(
    "t18_tokenize_separators",
    f"{WITH} SELECT product_id, {S.joined(S.sep_toks(S.preprocess('title', lx.TR_FEED, False), lx.STOP_FEED))} AS tokens FROM products",
)
def _(t):
    return B.products(t).select(
        "product_id", _tokens(T.tokenize_separators(T.feed_preprocess(_title()), lx.STOP_FEED)).alias("tokens")
    )


@query(
    "t19_stem_tokens",
    f"WITH d AS (SELECT doc_id, {S.stem(_DT)} AS k FROM documents) "
    f"SELECT doc_id, len(k)::BIGINT AS n_stems, md5({S.joined('k')}) AS stems_md5 FROM d",
)
def _(t):
    d = t.documents.select("doc_id", T.stem_tokens(T.tokenize(F.col("text"), lx.STOP_GENERIC)).alias("k"))
    return d.select("doc_id", F.size("k").cast("bigint").alias("n_stems"), F.md5(_tokens(F.col("k"))).alias("stems_md5"))


@query(
    "t20_expand_synonyms",
    f"{WITH}, k AS (SELECT product_id, {S.toks(S.norm('title'), lx.STOP_CALIBRA)} AS k FROM products) "
    f"SELECT product_id, {S.joined(S.expand('k', lx.SYN_CALIBRA))} AS tokens FROM k",
)
def _(t):
    tokens = T.expand_tokens(T.tokenize(_title(), lx.STOP_CALIBRA), lx.SYN_CALIBRA)
    return B.products(t).select("product_id", _tokens(tokens).alias("tokens"))


_TT = (
    rf"array_to_string(list_transform(list_filter(string_split_regex(trim({S.norm_units('title')}), '\s+'), "
    rf"lambda w: w <> '' AND NOT list_contains({S.lst(lx.STOP_APPLAWS)}, w)), "
    rf"lambda w: coalesce({S.mapping(lx.TR_APPLAWS)}[w], w)), ' ')"
)


@query(
    "t21_translate",
    f"{WITH}, k AS (SELECT product_id, title, {S.toks(S.norm_units('title'), lx.STOP_APPLAWS)} AS k FROM products) "
    f"SELECT product_id, {S.joined(S.translate('k', lx.TR_APPLAWS))} AS tokens, {_TT} AS translated FROM k",
)
def _(t):
    tokens = T.translate_tokens(T.tokenize(_title(), lx.STOP_APPLAWS, "after"), lx.TR_APPLAWS)
    return B.products(t).select(
        "product_id", _tokens(tokens).alias("tokens"),
        T.translate_text(_title(), lx.STOP_APPLAWS, lx.TR_APPLAWS).alias("translated"),
    )


@query(
    "t22_drop_numeric",
    f"{WITH}, k AS (SELECT product_id, {S.toks(S.norm('title'), lx.STOP_APPLAWS)} AS k FROM products) "
    f"SELECT product_id, {S.joined(S.drop_numeric('k'))} AS tokens FROM k",
)
def _(t):
    return B.products(t).select("product_id", _tokens(T.drop_numeric(T.tokenize(_title(), lx.STOP_APPLAWS))).alias("tokens"))


@query(
    "t23_species",
    f"{WITH} SELECT product_id, {S.species(S.split_words(S.norm('title')), lx.DOG_MARKERS, lx.CAT_MARKERS_WIDE)} AS species FROM products",
)
def _(t):
    return B.products(t).select("product_id", T.species_of(_title(), cat=lx.CAT_MARKERS_WIDE).alias("species"))


@query(
    "t24_animal_and_stage",
    f"{WITH}, k AS (SELECT product_id, {S.translate(S.toks(S.norm_units('title'), lx.STOP_APPLAWS), lx.TR_APPLAWS)} AS k FROM products) "
    f"SELECT product_id, CASE WHEN {S.overlap_any('k', ['dog', 'puppy'])} THEN 'dog' WHEN {S.overlap_any('k', ['cat', 'kitten'])} "
    f"THEN 'cat' ELSE '' END AS animal, CASE WHEN {S.overlap_any('k', ['kitten', 'puppy'])} THEN 'junior' "
    f"WHEN {S.overlap_any('k', ['senior'])} THEN 'senior' WHEN {S.overlap_any('k', ['adult'])} THEN 'adult' ELSE '' END AS stage FROM k",
)
def _(t):
    k = B.products(t).select(
        "product_id", T.translate_tokens(T.tokenize(_title(), lx.STOP_APPLAWS, "after"), lx.TR_APPLAWS).alias("k")
    )
    return k.select("product_id", T.animal_of_tokens(F.col("k")).alias("animal"), T.stage_of_tokens(F.col("k")).alias("stage"))


_SITE_URL = (
    "'https://www.maker.example.com/' || CASE WHEN p_type = 'PROMO' THEN 'alimento-para-perros/' "
    "WHEN p_type = 'SMALL' THEN 'alimento-para-gatos/' WHEN p_size > 40 THEN 'Feline/' WHEN p_size > 30 THEN 'N-CANINE/' "
    "ELSE '' END || handle"
)


@query(
    "t25_species_of_url",
    f"{WITH}, u AS (SELECT product_id, lower({_SITE_URL}) AS u FROM products) SELECT product_id, "
    "CASE WHEN contains(u, 'alimento-para-perros') OR contains(u, 'canine') THEN 'dog' "
    "WHEN contains(u, 'alimento-para-gatos') OR contains(u, 'feline') THEN 'cat' ELSE '' END AS species FROM u",
)
def _(t):
    return B.products(t).select("product_id", T.species_of_url(F.expr(_SITE_URL)).alias("species"))


def form(x: str) -> str:
    return (
        f"CASE WHEN {S.any_in(f'lower({x})', lx.FEED_SNACK)} THEN 'snack' WHEN contains(upper({x}), 'SEMI') THEN 'semiwet' "
        f"WHEN {S.any_in(f'upper({x})', lx.FEED_WET)} THEN 'wet' ELSE 'dry' END"
    )


@query(
    "t26_form_bucket",
    f"{WITH} SELECT product_id, {form('title')} AS form, CASE WHEN contains(lower(title), 'treat') THEN 'treat' "
    f"WHEN {S.any_in('upper(title)', lx.VETLIFE_WET)} THEN 'wet' ELSE 'dry' END AS diet_form FROM products",
)
def _(t):
    return B.products(t).select("product_id", T.form_bucket(_title()).alias("form"), T.vet_form(_title()).alias("diet_form"))


_RULES = (("first", ("BRAND#1 ", "BRAND#10")), ("teens", ("BRAND#1",)), ("rest", ("BRAND#2",)))
_BRANDED = (
    "CASE WHEN p_type = 'SMALL' THEN 'Advance Vet ' WHEN p_type = 'PROMO' THEN ' ad ' WHEN p_type = 'LARGE' THEN 'Libra ' "
    "WHEN p_type = 'MEDIUM' THEN 'Natural Trainer ' ELSE '' END || title"
)


def sub_brand(x: str, rules=lx.SUB_BRANDS) -> str:
    u = f"trim(upper({x}))"
    whens = " ".join(
        "WHEN " + " OR ".join(f"starts_with({u}, {S.quote(p)})" for p in ps) + f" THEN '{n}'" for n, ps in rules
    )
    return f"CASE {whens} ELSE 'unknown' END"


@query(
    "t27_sub_brand",
    f"{WITH} SELECT product_id, {sub_brand(_BRANDED)} AS brand, {sub_brand('title', _RULES)} AS own_rules FROM products",
)
def _(t):
    return B.products(t).select(
        "product_id", T.sub_brand(F.expr(_BRANDED)).alias("brand"), T.sub_brand(_title(), _RULES).alias("own_rules")
    )


@query(
    "t28_first_barcode",
    f"{WITH} SELECT product_id, coalesce(trim(list_filter([barcode, CASE WHEN p_size > 5 THEN ' ' || sku || ' ' END, 'X' || sku], "
    "lambda b: b IS NOT NULL AND b <> '')[1]), '') AS barcode FROM products",
)
def _(t):
    variants = F.expr(
        "array(named_struct('barcode', barcode), named_struct('barcode', if(p_size > 5, ' ' || sku || ' ', null)), "
        "named_struct('barcode', 'X' || sku))"
    )
    return B.products(t).select("product_id", T.first_barcode(variants).alias("barcode"))


_BT = "'BEAPHAR ' || title"
_BC = S.noise(_BT, True)
_BB = f"trim(regexp_replace({_BC}, '^(?:BEAPHAR|BEAPHARM)\\s+', '', 'i'))"
_FT = "'FARMINA ND ' || title"
_FB = f"trim({S.rxi(f'regexp_replace(trim({_FT}), {S.quote(_LINE)}, {S.quote('')}, {S.quote('i')})', _WEIGHT, '')})"
_FN = S.norm(_FB)
_FS = rf"array_to_string(list_filter(string_split_regex(trim({_FN}), '\s+'), lambda w: w <> '')[1:4], ' ')"
_CT = "'INABA CHURU ' || title"
_CB = f"trim({S.rx('trim(' + S.rxi(_CT, r'\b(inaba|churu|ciao|gato|cat|perro|dog)\b', '') + ')', r'\s+', ' ')})"
_CS = rf"array_to_string(list_filter(string_split_regex(trim({_CB}), '\s+'), lambda w: length(w) > 2)[1:3], ' ')"
_AE = _TT.replace("title", f"{S.noise('title', True)}") if False else (
    rf"array_to_string(list_transform(list_filter(string_split_regex(trim({S.norm_units(S.noise('title', True))}), '\s+'), "
    rf"lambda w: w <> '' AND NOT list_contains({S.lst(lx.STOP_APPLAWS)}, w)), "
    rf"lambda w: coalesce({S.mapping(lx.TR_APPLAWS)}[w], w)), ' ')"
)
_ADV = (
    "CASE WHEN p_type = 'SMALL' THEN 'AD ' || title WHEN p_type = 'LARGE' THEN 'LIBRA ' || title ELSE title END"
)


@query(
    "t29_search_queries",
    f"""{WITH}, q AS (
      SELECT product_id, 'beaphar' AS profile, ['site:beaphar.es/product/ ' || {_BC},
        CASE WHEN {_BB} <> {_BC} THEN 'site:beaphar.es/product/ ' || {_BB} END,
        CASE WHEN barcode <> '' THEN 'site:beaphar.es/product/ ' || barcode END] AS qs FROM products
      UNION ALL SELECT product_id, 'farmina', ['site:farmina.com/es/eshop/ ' || {_FB},
        CASE WHEN {_FS} <> '' AND {_FS} <> {_FN} THEN 'site:farmina.com/es/eshop/ ' || {_FS} END] FROM products
      UNION ALL SELECT product_id, 'churu_es', ['site:inabafoods-europe.com ' || {_CB},
        CASE WHEN {_CS} <> '' AND {_CS} <> {_CB} THEN 'site:inabafoods-europe.com ' || {_CS} END] FROM products
      UNION ALL SELECT product_id, 'applaws_uk', [CASE WHEN barcode <> '' THEN 'site:applaws.com ' || barcode END,
        'site:applaws.com/uk/products/ ' || {_AE}, 'applaws uk ' || {_AE}] FROM products
      UNION ALL SELECT product_id, 'affinity', [CASE WHEN p_type = 'SMALL' THEN 'Advance ' || {S.noise(_ADV)} ELSE {S.noise(_ADV)} END
        || ' product image'] FROM products),
    f AS (SELECT product_id, profile, list_filter(qs, lambda x: x IS NOT NULL) AS qs FROM q)
    SELECT product_id, profile, unnest(range(1, len(qs) + 1))::INTEGER AS query_rank, unnest(qs) AS query FROM f""",
)
def _(t):
    p = B.products(t)
    titled = {
        "beaphar": F.concat(F.lit("BEAPHAR "), _title()), "farmina": F.concat(F.lit("FARMINA ND "), _title()),
        "churu_es": F.concat(F.lit("INABA CHURU "), _title()), "applaws_uk": _title(), "affinity": F.expr(_ADV),
    }
    every = F.array(
        *[F.struct(F.lit(n).alias("profile"), T.search_queries(c, F.col("barcode"), n).alias("qs")) for n, c in titled.items()]
    )
    return p.select("product_id", F.inline(every)).select(
        "product_id", "profile", F.posexplode("qs").alias("pos", "query")
    ).select("product_id", "profile", (F.col("pos") + 1).alias("query_rank"), "query")


_MT = "'Menforsan  ' || title"
_MC = S.noise(_MT, True)
_MB = f"trim(regexp_replace({_MC}, '^MENFORSAN\\s+', '', 'i'))"
_PT = "CASE WHEN p_size > 20 THEN 'APPLAWS ' || title ELSE title END"
_PC = S.noise(_PT, True)
_PB = f"trim(regexp_replace({_PC}, '^APPLAWS\\s+', '', 'i'))"
_RT = "'VIRBAC ' || title"
_RB = f"trim({S.rx('trim(' + S.rxi(_RT, r'\b(virbac)\b', '') + ')', r'\s+', ' ')})"
_RS = rf"array_to_string(list_filter(string_split_regex(trim({_RB}), '\s+'), lambda w: length(w) > 3)[1:3], ' ')"
_SC = f"trim({S.rx(S.rxi('title', S.NOISE_FULL, ' '), r'\s+', ' ')})"


@query(
    "t29_more_search_queries",
    f"""{WITH}, q AS (
      SELECT product_id, 'menforsan' AS profile, ['site:menforsan.com/es/ ' || {_MC}, CASE WHEN {_MB} <> {_MC} THEN 'site:menforsan.com/es/ ' || {_MB} END,
        CASE WHEN barcode <> '' THEN 'site:menforsan.com/es/ ' || barcode END] AS qs FROM products
      UNION ALL SELECT product_id, 'applaws_es', ['site:applaws.pet/producto/ ' || {_PC}, CASE WHEN {_PB} <> {_PC} THEN 'site:applaws.pet/producto/ ' || {_PB} END,
        CASE WHEN barcode <> '' THEN 'site:applaws.pet/producto/ ' || barcode END] FROM products
      UNION ALL SELECT product_id, 'virbac_vet', ['site:vet-es.virbac.com ' || {_RB}, CASE WHEN {_RS} <> '' AND {_RS} <> {_RB} THEN 'site:vet-es.virbac.com ' || {_RS} END] FROM products
      UNION ALL SELECT product_id, 'generic', [{_SC} || ' site:' || lower(replace(vendor, '#', '')) || '.example.com', {_SC}] FROM products),
    f AS (SELECT product_id, profile, list_filter(qs, lambda x: x IS NOT NULL) AS qs FROM q)
    SELECT product_id, profile, unnest(range(1, len(qs) + 1))::INTEGER AS query_rank, unnest(qs) AS query FROM f""",
)
def _(t):
    titled = {"menforsan": F.expr(_MT), "applaws_es": F.expr(_PT), "virbac_vet": F.expr(_RT)}
    rows = [F.struct(F.lit(n).alias("profile"), T.search_queries(c, F.col("barcode"), n).alias("qs")) for n, c in titled.items()]
    domain = F.expr("lower(replace(vendor, '#', '')) || '.example.com'")
    rows.append(F.struct(F.lit("generic").alias("profile"), T.site_queries(_title(), domain).alias("qs")))
    return B.products(t).select("product_id", F.inline(F.array(*rows))).select(
        "product_id", "profile", F.posexplode("qs").alias("pos", "query")
    ).select("product_id", "profile", (F.col("pos") + 1).alias("query_rank"), "query")


_HT = "CASE WHEN p_type = 'PROMO' THEN 'ARTERO HIGIENE PERFUME VIOLET 90 ML' WHEN p_type = 'SMALL' THEN replace(title, 'MINI', 'HIGIENE') ELSE title END"
_HS = _unit_slug(_HT)
_HW = f"nullif(array_to_string(list_filter(string_split({_HS}, '-'), lambda w: w <> 'higiene'), '-'), '')"


@query(
    "t30_slug_candidates",
    f"""{WITH}, c AS (SELECT product_id, list_filter([{S.mapping(lx.SLUG_CORRECTIONS)}[{_HS}], nullif({_HS}, ''),
      CASE WHEN list_contains(string_split({_HS}, '-'), 'higiene') THEN {_HW} END], lambda x: x IS NOT NULL) AS c FROM products)
    SELECT product_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS slugs FROM c""",
)
def _(t):
    return B.products(t).select("product_id", F.array_join(T.slug_candidates(F.expr(_HT)), "|").alias("slugs"))


# --- every profile's tokens --------------------------------------------------

def profile_tokens(profile: lx.MatcherProfile, x: str, catalog_side: bool = False) -> str:
    """Oracle form of ``title_tokens``."""
    if profile.text == "preprocess":
        diet = profile.name.startswith("vetlife")
        return S.sep_toks(S.preprocess(x, dict(profile.translate), diet), profile.stop, not diet)
    n = {"": S.norm, "after": S.norm_units, "before": S.norm_glued}[profile.units](x)
    k = S.toks(n, profile.stop)
    if profile.translate and not catalog_side:
        k = S.translate(k, dict(profile.translate))
    if profile.drop_numbers and not catalog_side:
        k = S.drop_numeric(k)
    if profile.syn:
        k = S.expand(k, dict(profile.syn))
    return S.stem(k) if profile.stem else k


#: Rows that a text has at most in :func:`_by_text`, so that a text of very many products is several tasks' work.
_SHARES = 8


def _by_text(products):
    """``title, handle, ids``: products of one text together, as what follows from the text costs far more than they do."""
    share = F.pmod(F.xxhash64("product_id"), F.lit(_SHARES))
    return products.groupBy("title", "handle", share.alias("share")).agg(F.collect_list("product_id").alias("ids"))


@query(
    "t31_profile_tokens",
    f"{WITH} " + " UNION ALL ".join(
        f"SELECT product_id, '{p.name}' AS profile, {S.joined(profile_tokens(p, 'title'))} AS title_tokens, "
        f"{S.joined(profile_tokens(p, 'handle', True))} AS entry_tokens FROM products"
        for p in lx.PROFILES.values()
    ),
)
def _(t):
    rows = F.array(*[
        F.struct(
            F.lit(p.name).alias("profile"), _tokens(T.title_tokens(_title(), p)).alias("title_tokens"),
            _tokens(T.title_tokens(F.col("handle"), p, catalog_side=True)).alias("entry_tokens"),
        )
        for p in lx.PROFILES.values()
    ])
    return _by_text(B.products(t)).withColumn("row", F.explode(rows)).select(F.explode("ids").alias("product_id"), "row.*")
