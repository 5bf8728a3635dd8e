"""Fragments of oracle SQL (DuckDB dialect).

The oracles restate the rules independently of the Spark functions: token sets are
list expressions, matches are brute-force joins of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words: Iterable[str]) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def mapping(pairs: Mapping[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in pairs.items()) + "}"


def multimap(groups: Mapping[str, Iterable[str]]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {lst(v)}" for k, v in groups.items()) + "}"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def rxi(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'gi')"


def bare(x: str) -> str:
    return f"strip_accents(lower({x}))"


def norm(x: str) -> str:
    return rx(bare(x), r"[^a-z0-9\s]", " ")


UNITS = "ml|gr|kg|mg|cl|l|cm|mm|g"


def norm_units(x: str) -> str:
    return rx(norm(x), rf"(\d+)\s*({UNITS})\b", r"\1 \2")


def norm_glued(x: str) -> str:
    return rx(rx(bare(x), rf"(\d+)({UNITS})\b", r"\1 \2"), r"[^a-z0-9\s]", " ")


def ascii_fold(x: str) -> str:
    return rx(bare(x), r"[^\x00-\x7F]", "")


def split_words(n: str) -> str:
    return rf"list_filter(list_distinct(string_split_regex({n}, '\s+')), lambda w: w <> '')"


def toks(n: str, stop: Iterable[str]) -> str:
    """Token list of an already normalised text."""
    return (
        rf"list_filter(list_distinct(string_split_regex({n}, '\s+')), "
        rf"lambda w: length(w) > 1 AND NOT list_contains({lst(stop)}, w))"
    )


def stem(tokens: str) -> str:
    return (
        f"list_distinct(list_transform({tokens}, lambda w: CASE "
        "WHEN length(w) > 4 AND ends_with(w, 'es') THEN substr(w, 1, length(w) - 2) "
        "WHEN length(w) > 3 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END))"
    )


def expand(tokens: str, groups: Mapping[str, Iterable[str]]) -> str:
    return (
        f"list_distinct(list_concat({tokens}, flatten(list_transform({tokens}, "
        f"lambda w: coalesce({multimap(groups)}[w], []::VARCHAR[])))))"
    )


def translate(tokens: str, pairs: Mapping[str, str]) -> str:
    return f"list_distinct(list_transform({tokens}, lambda w: coalesce({mapping(pairs)}[w], w)))"


def drop_numeric(tokens: str) -> str:
    return rf"list_filter({tokens}, lambda w: NOT regexp_full_match(w, '\d+(?:x\d+)?'))"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


def joined(tokens: str, sep: str = " ") -> str:
    return f"array_to_string(list_sort({tokens}), {quote(sep)})"


def overlap_any(a: str, words: Iterable[str]) -> str:
    return f"len(list_intersect({a}, {lst(words)})) > 0"


def species(words: str, dog: Iterable[str], cat: Iterable[str]) -> str:
    d, c = overlap_any(words, dog), overlap_any(words, cat)
    return f"(CASE WHEN {d} AND NOT {c} THEN 'dog' WHEN {c} AND NOT {d} THEN 'cat' ELSE '' END)"


def any_in(x: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


NOISE_PAREN = r"\s*\((?:NDR|PV|NV|ONLINE)\)\s*"
NOISE_FULL = r"\s*(?:\*[^*]*\*|\((?:NDR|PV|NV|ONLINE)\))\s*"


def noise(x: str, stars: bool = False) -> str:
    return f"trim({rxi(x, NOISE_FULL if stars else NOISE_PAREN, ' ')})"


def dashed(n: str) -> str:
    return f"trim({rx(f'trim({n})', r'\s+', '-')}, '-')"


def preprocess(x: str, pairs: Mapping[str, str], diet: bool) -> str:
    t = bare(x)
    if diet:
        t = rx(t, r"gastro\s+intestinal", "gastrointestinal")
        t = rx(t, r"\bmed/ma?x?\b", "medium maxi")
        t = rx(t, r"@\w+", "")
    else:
        t = rx(t, r"semi[\s\-]?humedo", "semiwet")
    t = rx(t, r"\d+[x×]\d+\w*", "")
    t = rx(t, r"\d+[\.,]?\d*\s*(?:kg|g|gr|l|ml|tab|und)\b", "")
    t = rx(t, r"\(.*?\)", "")
    return (
        rf"array_to_string(list_transform(string_split_regex(trim({t}), '\s+'), "
        rf"lambda w: coalesce({mapping(pairs)}[w], w)), ' ')"
    )


def sep_toks(text: str, stop: Iterable[str], comma: bool = True) -> str:
    pattern = r"[\s\-_&+•\./,]+" if comma else r"[\s\-_&+•\./]+"
    return (
        f"list_filter(list_distinct(string_split_regex({text}, {quote(pattern)})), "
        f"lambda w: w <> '' AND NOT list_contains({lst(stop)}, w))"
    )


def norm_url(u: str) -> str:
    t = f"regexp_replace(trim(coalesce({u}, '')), '[#?].*$', '')"
    t = f"regexp_replace({t}, '/+$', '')"
    t = f"regexp_replace({t}, '^https?://', '', 'i')"
    return f"lower(regexp_replace({t}, '^www\\.', '', 'i'))"


def no_query(u: str) -> str:
    return f"split_part({u}, '?', 1)"


def hamming(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))"
