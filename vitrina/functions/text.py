"""Text functions on Columns: normalisation, keys, tokens, markers, queries.

Everything here stays in built-in expressions.  Where a rule can be written as a
regular expression on the whole text instead of a lambda per token it is, so the
projection remains inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina import lexicon as lx


# --- literals ---------------------------------------------------------------

def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array_sql(words: Iterable[str]) -> str:
    items = ", ".join(_quoted(w) for w in words)
    return f"array({items})" if items else "cast(array() as array<string>)"


# Word lists are written as one SQL literal: building them element by element costs a
# call into the JVM per word and dominates planning.

def str_array(words: Iterable[str]) -> Column:
    """Literal ``array<string>`` (typed even when empty)."""
    return F.expr(_array_sql(words))


def _strip(char: str, text: Column) -> Column:
    """Drop leading and trailing ``char``."""
    return F.trim(text, F.lit(char))


def str_map(pairs: Mapping[str, str]) -> Column:
    return F.expr(f"map_from_arrays({_array_sql(pairs.keys())}, {_array_sql(pairs.values())})")


def list_map(groups: Mapping[str, Iterable[str]]) -> Column:
    values = ", ".join(_array_sql(v) for v in groups.values())
    return F.expr(f"map_from_arrays({_array_sql(groups.keys())}, array({values}))")


def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks.

    Built by rule over the Latin, Greek and Cyrillic blocks: Spark has no
    Unicode normalisation function, ``translate`` does the same in one pass.
    """
    src, dst = [], []
    for block in (range(0xC0, 0x530), range(0x1E00, 0x2000)):
        for cp in block:
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BARE = _accent_table()


# --- T01–T05 normalisation --------------------------------------------------

def strip_accents(text: Column) -> Column:
    """Lower-case and drop combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BARE), r"\p{Mn}", "")


def normalize_text(text: Column) -> Column:
    """Lower, no accents, everything outside ``[a-z0-9\\s]`` becomes a space."""
    return F.regexp_replace(strip_accents(text), r"[^a-z0-9\s]", " ")


_UNITS = "ml|gr|kg|mg|cl|l|cm|mm|g"


def normalize_glued_units(text: Column) -> Column:
    """``250ml`` → ``250 ml`` before punctuation is removed."""
    split = F.regexp_replace(strip_accents(text), rf"(\d+)({_UNITS})\b", "$1 $2")
    return F.regexp_replace(split, r"[^a-z0-9\s]", " ")


def normalize_units(text: Column) -> Column:
    """Number and unit separated by exactly one space, after clean-up."""
    return F.regexp_replace(normalize_text(text), rf"(\d+)\s*({_UNITS})\b", "$1 $2")


def ascii_fold(text: Column) -> Column:
    """Lower, no accents, all remaining non-ASCII characters dropped."""
    return F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")


def variant_tokens(text: Column, stop: Iterable[str] = lx.STOP_VARIANT_IMAGE) -> Column:
    """Tokens for variant/picture comparison: digits and letters split apart,
    one-letter tokens kept."""
    split = F.regexp_replace(ascii_fold(text), r"(\d)([a-z])", "$1 $2")
    split = F.regexp_replace(split, r"([a-z])(\d)", "$1 $2")
    words = F.split(F.regexp_replace(split, r"[^a-z0-9]+", " "), " ")
    return F.array_except(words, str_array(("", *stop)))


def unit_join_slug(title: Column) -> Column:
    """``FLASH 300 ML (NDR)`` → ``flash-300ml``."""
    norm = F.regexp_replace(
        normalize_text(remove_store_noise(title)), r"(\d+)\s+(ml|gr|kg|g|l|oz)\b", "$1$2"
    )
    return _strip("-", F.regexp_replace(F.trim(norm), r"\s+", "-"))


# --- T06–T11 slugs and keys -------------------------------------------------

def vendor_slug(vendor: Column) -> Column:
    return _strip("_", F.regexp_replace(F.lower(vendor), r"[^a-z0-9]+", "_"))


def title_slug(title: Column) -> Column:
    """Search-friendly slug: non-ASCII dropped, other runs become one dash."""
    return _strip("-", F.regexp_replace(ascii_fold(title), r"[^a-z0-9]+", "-"))


def direct_slug(title: Column, brand: str) -> Column:
    """Title slug that always starts with the brand (empty stays empty)."""
    slug = title_slug(remove_store_noise(title, stars=True))
    return F.when((slug != "") & ~slug.startswith(brand), F.concat(F.lit(f"{brand}-"), slug)).otherwise(slug)


def _dashed(norm: Column) -> Column:
    return _strip("-", F.regexp_replace(F.trim(norm), r"\s+", "-"))


def title_key(title: Column, stars: bool = True, units: bool = False) -> Column:
    """Cache key: cleaned title, words in order."""
    clean = remove_store_noise(title, stars=stars)
    return _dashed(normalize_units(clean) if units else normalize_text(clean))


def sorted_title_key(title: Column, stop: Iterable[str]) -> Column:
    """Cache key: distinct significant words in alphabetical order; when none is
    left, the trimmed normal form."""
    key = F.array_join(F.array_sort(tokenize(title, stop)), "-")
    return F.when(key != "", key).otherwise(F.trim(normalize_text(title)))


def strip_brand_and_weight(title: Column) -> Column:
    """Title without its line prefix and without weights."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(title), lx.LINE_PREFIX, ""), lx.WEIGHT_PATTERN, ""))


def size_free_key(title: Column) -> Column:
    """One key for all sizes of a recipe."""
    return _dashed(normalize_text(strip_brand_and_weight(title)))


# --- T12–T16 clean-up of titles ---------------------------------------------


def remove_store_noise(title: Column, stars: bool = False) -> Column:
    """Remove internal store marks; ``stars`` also removes ``*…*``."""
    return F.trim(F.regexp_replace(title, lx.NOISE_FULL if stars else lx.NOISE_PAREN, " "))


def search_title(title: Column) -> Column:
    """Title as a person would type it into a search box."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, lx.NOISE_FULL, " "), r"\s+", " "))


#: Weight, pack and size expressions removed from a title to get its base form.


def base_title(title: Column, vendor_prefix: str = lx.VENDOR_PREFIX) -> Column:
    """Title without vendor prefix, weights, packs and sizes."""
    t = F.regexp_replace(strip_accents(title), vendor_prefix, "")
    t = F.regexp_replace(F.regexp_replace(t, lx.SIZE_PATTERN, " "), r"[/\-_]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def base_title_tokens(title: Column, stop: Iterable[str] = lx.STOP_SELF) -> Column:
    """Tokens of a title with sizes removed (vendor words are stop words)."""
    t = F.regexp_replace(F.regexp_replace(strip_accents(title), lx.SIZE_PATTERN, " "), r"[/\-_]+", " ")
    return F.array_except(F.split(F.trim(t), r"\s+"), str_array(("", *stop)))


def _translate_words(text: Column, words: Mapping[str, str]) -> Column:
    table = str_map(words)
    return F.array_join(
        F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.coalesce(table[w], w)), " "
    )


def vet_preprocess(text: Column) -> Column:
    """Prescription-diet titles: compounds joined, packs, weights, parentheses and
    ``@tags`` removed, words translated."""
    t = F.regexp_replace(strip_accents(text), r"gastro\s+intestinal", "gastrointestinal")
    t = F.regexp_replace(t, r"\bmed/ma?x?\b", "medium maxi")
    for pattern in (r"@\w+", lx.PACK_PATTERN, lx.AMOUNT_PATTERN, lx.PARENS_PATTERN):
        t = F.regexp_replace(t, pattern, "")
    return _translate_words(t, lx.TR_VETLIFE)


def feed_preprocess(text: Column) -> Column:
    """Feed titles: semi-moist joined, packs, weights, parentheses removed, words
    translated."""
    t = F.regexp_replace(strip_accents(text), r"semi[\s\-]?humedo", "semiwet")
    for pattern in (lx.PACK_PATTERN, lx.AMOUNT_PATTERN, lx.PARENS_PATTERN):
        t = F.regexp_replace(t, pattern, "")
    return _translate_words(t, lx.TR_FEED)


def weight_grams(text: Column) -> Column:
    """Unit weight in grams: ``16X35GR`` → 35, else the first ``NNgr``, else null."""
    t = F.lower(text)
    pack = F.nullif(F.regexp_extract(t, r"\d+\s*[x×]\s*(\d+)\s*gr", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(t, r"(\d+)\s*gr", 1), F.lit(""))
    return F.coalesce(pack, plain).try_cast("bigint")


# --- T17–T22 tokens ---------------------------------------------------------

def words_of(normalized: Column) -> Column:
    """All distinct words of an already normalised text."""
    return F.array_except(F.split(normalized, r"\s+"), str_array(("",)))


def tokenize_normalized(normalized: Column, stop: Iterable[str]) -> Column:
    """Distinct words longer than one character, minus stop words."""
    return F.array_except(
        F.split(F.regexp_replace(normalized, r"\b[a-z0-9]\b", " "), r"\s+"), str_array(("", *stop))
    )


def tokenize(text: Column, stop: Iterable[str], units: str = "") -> Column:
    if not units:  # the words that ``tokenize_normalized`` finds in a normal text, in one pass over the text
        return F.array_except(F.regexp_extract_all(strip_accents(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), str_array(tuple(stop)))
    normal = {"after": normalize_units, "before": normalize_glued_units}[units]
    return tokenize_normalized(normal(text), stop)


def tokenize_separators(preprocessed: Column, stop: Iterable[str], comma: bool = True) -> Column:
    """Split on the separator class, one-letter words kept."""
    pattern = r"[\s\-_&+•\./,]+" if comma else r"[\s\-_&+•\./]+"
    return F.array_except(F.split(preprocessed, pattern), str_array(("", *stop)))


def stem_tokens(tokens: Column) -> Column:
    """Plural stemmer: ``-es`` off words over four letters, else ``-s`` off words over three."""
    joined = F.regexp_replace(
        F.array_join(tokens, " "), r"\b(?:([a-z0-9-]{3,})es|([a-z0-9-]{3,})s)(?= |$)", "$1$2"
    )
    return F.array_except(F.split(joined, " "), str_array(("",)))


def expand_tokens(tokens: Column, synonyms: Mapping[str, Iterable[str]]) -> Column:
    """One-hop synonym expansion (union with the original tokens)."""
    if not synonyms:
        return tokens
    table = list_map(synonyms)
    alternatives = F.flatten(F.transform(tokens, lambda t: F.coalesce(table[t], str_array(()))))
    return F.array_union(tokens, alternatives)


def translate_tokens(tokens: Column, words: Mapping[str, str]) -> Column:
    """Replace tokens by their translation (set semantics)."""
    if not words:
        return tokens
    table = str_map(words)
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(table[t], t)))


def translate_text(text: Column, stop: Iterable[str], words: Mapping[str, str]) -> Column:
    """Word-for-word translation in order, stop words dropped (for search queries)."""
    table = str_map(words)
    kept = F.filter(
        F.split(F.trim(normalize_units(text)), r"\s+"), lambda w: ~F.array_contains(str_array(("", *stop)), w)
    )
    return F.array_join(F.transform(kept, lambda w: F.coalesce(table[w], w)), " ")


def drop_numeric(tokens: Column) -> Column:
    """Drop numbers and pack tokens such as ``12x70``."""
    joined = F.regexp_replace(
        F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" ")), r" \d+(?:x\d+)? ", " "
    )
    return F.array_except(F.split(joined, " +"), str_array(("",)))


def title_tokens(text: Column, profile: lx.MatcherProfile, catalog_side: bool = False) -> Column:
    """Tokens of a title (or catalogue text) the way ``profile`` compares them."""
    if profile.text == "preprocess":
        prepare, comma = (
            (vet_preprocess, False) if profile.name.startswith("vetlife") else (feed_preprocess, True)
        )
        return tokenize_separators(prepare(text), profile.stop, comma)
    tokens = tokenize(text, profile.stop, profile.units)
    if profile.translate and (not catalog_side or profile.translate_catalog):
        tokens = translate_tokens(tokens, dict(profile.translate))
    if profile.drop_numbers and not catalog_side:
        tokens = drop_numeric(tokens)
    tokens = expand_tokens(tokens, dict(profile.syn))
    return stem_tokens(tokens) if profile.stem else tokens


# --- T23–T27 markers --------------------------------------------------------

def species_of_words(words: Column, dog=lx.DOG_MARKERS, cat=lx.CAT_MARKERS) -> Column:
    """``dog`` or ``cat`` when exactly one of the marker sets occurs, else empty."""
    is_dog = F.arrays_overlap(words, str_array(dog))
    is_cat = F.arrays_overlap(words, str_array(cat))
    return F.when(is_dog & ~is_cat, "dog").when(is_cat & ~is_dog, "cat").otherwise("")


def species_of(text: Column, dog=lx.DOG_MARKERS, cat=lx.CAT_MARKERS) -> Column:
    return species_of_words(words_of(normalize_text(text)), dog, cat)


def animal_of_tokens(tokens: Column) -> Column:
    """Species with dog taking precedence over cat."""
    return (
        F.when(F.arrays_overlap(tokens, str_array(("dog", "puppy"))), "dog")
        .when(F.arrays_overlap(tokens, str_array(("cat", "kitten"))), "cat")
        .otherwise("")
    )


def stage_of_tokens(tokens: Column) -> Column:
    return (
        F.when(F.arrays_overlap(tokens, str_array(("kitten", "puppy"))), "junior")
        .when(F.array_contains(tokens, "senior"), "senior")
        .when(F.array_contains(tokens, "adult"), "adult")
        .otherwise("")
    )


def species_of_url(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(u.contains("alimento-para-perros") | u.contains("canine"), "dog")
        .when(u.contains("alimento-para-gatos") | u.contains("feline"), "cat")
        .otherwise("")
    )


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains one of the literal substrings."""
    out = None
    for w in words:
        test = text.contains(w)
        out = test if out is None else (out | test)
    return out if out is not None else F.lit(False)


def is_snack(title: Column) -> Column:
    return contains_any(F.lower(title), lx.FEED_SNACK)


def is_semiwet(title: Column) -> Column:
    return F.upper(title).contains("SEMI")


def is_wet(title: Column) -> Column:
    return contains_any(F.upper(title), lx.FEED_WET)


def form_bucket(title: Column) -> Column:
    """``snack`` before ``semiwet`` before ``wet``; everything else is ``dry``."""
    return F.when(is_snack(title), "snack").when(is_semiwet(title), "semiwet").when(is_wet(title), "wet").otherwise("dry")


def vet_form(title: Column) -> Column:
    """``treat``, ``wet`` or ``dry`` for prescription diets."""
    return (
        F.when(F.lower(title).contains("treat"), "treat")
        .when(contains_any(F.upper(title), lx.VETLIFE_WET), "wet")
        .otherwise("dry")
    )


def sub_brand(title: Column, rules=lx.SUB_BRANDS) -> Column:
    """First sub-brand one of whose prefixes starts the title, else ``unknown``."""
    t = F.trim(F.upper(title))
    out = None
    for name, prefixes in rules:
        hit = None
        for p in prefixes:
            hit = t.startswith(p) if hit is None else (hit | t.startswith(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


# --- T28–T30 products and queries -------------------------------------------

def first_barcode(variants: Column) -> Column:
    """First non-empty barcode of a product's variants, trimmed; empty when none."""
    codes = F.filter(variants["barcode"], lambda b: b.isNotNull() & (b != ""))
    return F.coalesce(F.trim(F.try_element_at(codes, F.lit(1))), F.lit(""))


def _first_words(text: Column, n: int, longer_than: int = 0) -> Column:
    kept = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > longer_than)
    return F.array_join(F.slice(kept, 1, n), " ")


def search_queries(title: Column, barcode: Column, profile: str) -> Column:
    """Ranked search queries of a profile as ``array<string>``.

    Later queries are fallbacks; which of them is needed depends on how many hits
    the earlier ones gave (see ``hits.select_hits``).
    """
    paren = remove_store_noise(title)
    stars = remove_store_noise(title, stars=True)
    has_code = F.coalesce(barcode, F.lit("")) != ""

    def site(where: str, what: Column) -> Column:
        return F.concat(F.lit(f"site:{where} "), what)

    if profile == "affinity":
        first = {k: v.split()[0].upper() for k, v in lx.SUB_BRAND_NAMES.items()}
        brand = sub_brand(title)
        named = str_map(lx.SUB_BRAND_NAMES)[brand]
        lead = str_map(first)[brand]
        repaired = (
            F.when((brand != "unknown") & ~F.upper(paren).startswith(lead), F.concat_ws(" ", named, paren))
            .when((brand == "unknown") & paren.rlike(r"(?i)^AD\s"),
                  F.concat(F.lit("Advance "), F.trim(F.regexp_replace(paren, r"^...", ""))))
            .otherwise(paren)
        )
        out = [F.concat(repaired, F.lit(" product image"))]
    elif profile in ("beaphar", "menforsan"):
        where = {"beaphar": "beaphar.es/product/", "menforsan": "menforsan.com/es/"}[profile]
        prefix = {"beaphar": r"(?i)^(?:BEAPHAR|BEAPHARM)\s+", "menforsan": r"(?i)^MENFORSAN\s+"}[profile]
        bare = F.trim(F.regexp_replace(stars, prefix, ""))
        out = [site(where, stars), F.when(bare != stars, site(where, bare)), F.when(has_code, site(where, barcode))]
    elif profile == "applaws_es":
        where = "applaws.pet/producto/"
        bare = F.trim(F.regexp_replace(stars, r"(?i)^APPLAWS\s+", ""))
        out = [site(where, stars), F.when(bare != stars, site(where, bare)), F.when(has_code, site(where, barcode))]
    elif profile == "applaws_uk":
        english = translate_text(stars, lx.STOP_APPLAWS, lx.TR_APPLAWS)
        out = [F.when(has_code, site("applaws.com", barcode)), site("applaws.com/uk/products/", english),
               F.concat(F.lit("applaws uk "), english)]
    elif profile in ("churu_es", "churu_us", "virbac_store", "virbac_vet"):
        where = {"churu_es": "inabafoods-europe.com", "churu_us": "inabafoods.com",
                 "virbac_store": "store.es.virbac.com", "virbac_vet": "vet-es.virbac.com"}[profile]
        drop = r"(?i)\b(inaba|churu|ciao|gato|cat|perro|dog)\b" if profile.startswith("churu") else r"(?i)\b(virbac)\b"
        bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(title, drop, "")), r"\s+", " "))
        short = _first_words(bare, 3, 2 if profile.startswith("churu") else 3)
        out = [site(where, bare), F.when((short != "") & (short != bare), site(where, short))]
    elif profile == "farmina":
        bare = strip_brand_and_weight(title)
        norm = normalize_text(bare)
        short = _first_words(norm, 4)
        out = [site("farmina.com/es/eshop/", bare),
               F.when((short != "") & (short != norm), site("farmina.com/es/eshop/", short))]
    else:
        raise ValueError(f"no search queries for profile {profile!r}")
    return F.array_compact(F.array(*out))


def site_queries(title: Column, domain: Column | str) -> Column:
    """Generic engine: the clean title on the maker's site, then the free search."""
    clean = search_title(title)
    where = F.lit(domain) if isinstance(domain, str) else domain
    return F.array(F.concat(clean, F.lit(" site:"), where), clean)


def slug_candidates(title: Column, corrections: Mapping[str, str] = lx.SLUG_CORRECTIONS,
                    category_word: str = "higiene") -> Column:
    """Slugs to try in order: manual correction, the title's own, without the category word."""
    slug = unit_join_slug(title)
    parts = F.split(slug, "-")
    without = F.nullif(F.array_join(F.array_remove(parts, category_word), "-"), F.lit(""))
    return F.array_distinct(
        F.array_compact(
            F.array(
                str_map(corrections)[slug],
                F.nullif(slug, F.lit("")),
                F.when(F.array_contains(parts, category_word), without),
            )
        )
    )
