r"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card numbers by their check digit, dates by the
calendar, addresses by the range of their parts, telephone numbers by their shape.  A
value becomes another one of the same format by a keyed Feistel network: two halves take
turns in being shifted by a keyed hash of the other.  That is a permutation of all values
of a format, so equal values stay equal across documents and different ones different,
and separators stay where they are.

=========  ==========================================================================
kind       what is permuted
=========  ==========================================================================
email      letters and digits of the local part and of all labels but the last
secret     letters and digits of a value after ``token``, ``password``, ``api_key``, ...
iban       digits and capital letters after the country; the check digits are set anew
card       13 to 19 digits with a valid check digit, also among other numbers; the check
           digit is set anew
ssn        the nine digits of ``123-45-6789``
phone      all digits of a telephone number but those of the country
ip         the 32 bits of an address
date       days of 1900-01-01 to 2099-11-12 (73,000 = 250 * 292), in the same notation
=========  ==========================================================================

DataFrame functions only, row by row, without a shuffle: a text is split at its values,
those are rewritten in an array and put back.  Texts without a digit or ``@`` are passed.

Edge cases: a null text stays null, an empty one empty.  Numbers that aren't valid stay as
they are.  Repeated rows give repeated rows; a null id passes.  Columns of any other
name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import fresh

ROUNDS = 8
DAYS, DAY_ROWS, DAY_COLUMNS = 73_000, 250, 292

_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_SECRET = r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?)[A-Za-z0-9_/+.-]{8,}"
_IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
_DATE = r"(?<![\w./-])(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]?\d[./][0-3]?\d[./](?:19|20)\d\d|(?:19|20)\d\d/[01]\d/[0-3]\d)(?:(?=[Tt]\d)|(?![\w/-]|\.\d))"
_SSN = r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
_IBAN = r"(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"
_PHONE = r"(?<![\w(+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:(?! \d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d{3,4}|\d{6}[ -]\d{4,5})(?!\d))[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|-\d)"
#: Numbers joined by hyphens that aren't the start of a word, a decimal, an address or a date.
_BLOCK = r"\d++(?:-\d++)*+(?!\w|\.\d|[\w.%+-]{0,64}@|/[0-3]?\d/\d)"
#: A whole run of numbers; the cards in it are found by :func:`_cards`.  Possessive, as long runs must not recurse.
_CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_BLOCK}(?: {_BLOCK})*+"
#: Lengths of the numbers in which cards are usually written.
_USUAL = r"^(?:1[3-9]|4-4-4-4(?:-[1-3])?|4-4-4-[1-3]|4-6-[45]|4-3-3-3|4-4-5)$"
#: Any other card among more numbers: none but the last is shorter than three digits.
_LOOSE = r"^(?:(?:[3-9]|1\d)-)+\d+$"
#: Fixed order: the first that fits at a place wins.
KINDS = (
    ("secret", _SECRET), ("email", _EMAIL), ("iban", _IBAN), ("date", _DATE), ("ip", _IP), ("ssn", _SSN),
    ("card", _CARD), ("phone", _PHONE),
)
PATTERN = "|".join(p for _, p in KINDS)
#: What may stand beside a card in a run of numbers.
BESIDE = "|".join(p for k, p in KINDS if k in ("date", "ssn", "phone"))


def _hash(key: str, tweak: str, turn: Column, other: Column) -> Column:
    """Keyed hash of one half: 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other), 256)


def _number(key: str, tweak: str, turn: Column, other: Column) -> Column:
    """The same as a number below 2^52."""
    return F.conv(F.substring(_hash(key, tweak, turn, other), 1, 13), 16, 10).cast("long")


def _feistel(a: Column, b: Column, rows: Column, columns: Column, key: str, tweak: str) -> Column:
    """Permute pairs ``a < rows, b < columns``: in turn one is shifted by a hash of the other."""
    tag = F.concat_ws(":", rows.cast("string"), columns.cast("string"))

    def step(state: Column, turn: Column) -> Column:
        shift_a = F.pmod(state["a"] + F.pmod(_number(key, tweak, turn, F.concat_ws(":", tag, state["b"].cast("string"))), rows), rows)
        shift_b = F.pmod(state["b"] + F.pmod(_number(key, tweak, turn, F.concat_ws(":", tag, state["a"].cast("string"))), columns), columns)
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shift_a).otherwise(state["a"]).alias("a"), F.when(even, state["b"]).otherwise(shift_b).alias("b"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permute strings of 1 to 36 digits, each length in itself."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")

    def part(text: Column) -> Column:
        return F.coalesce(F.when(text == "", F.lit(0)).otherwise(text.cast("long")), F.lit(0))

    def power(size: Column) -> Column:
        return F.rpad(F.lit("1"), size + 1, "0").cast("long")

    left = F.substring(digits, F.lit(1), half)
    right = F.substring(digits, half + 1, n - half)
    moved = _feistel(part(left), part(right), power(half), power(n - half), key, tweak)
    return F.transform(F.array(moved), lambda m: F.concat(
        F.when(half > 0, F.lpad(m["a"].cast("string"), half, "0")).otherwise(F.lit("")), F.lpad(m["b"].cast("string"), n - half, "0")))[0]


def permute_characters(text: Column, key: str, tweak: str) -> Column:
    """Permute letters and digits, each within its class (0-9, a-z, A-Z); others stay."""
    half = F.floor(F.length(text) / 2).cast("int")

    def shifted(part: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(62)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            low = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
            size = F.when(c.between("0", "9"), 10).otherwise(26)
            return F.when(low.isNull(), c).otherwise(F.chr(low + F.pmod(code - low + shift, size)))

        return F.when(part == "", part).otherwise(F.array_join(F.transform(F.split(part, ""), one), ""))

    def step(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shifted(state["a"], _hash(key, tweak, turn, state["b"]))).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(shifted(state["b"], _hash(key, tweak, turn, state["a"]))).alias("b"))

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(
        F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b")), step)
    return F.transform(F.array(moved), lambda m: F.concat(m["a"], m["b"]))[0]


def _luhn_sum(digits: Column, double_last: int) -> Column:
    """Sum of a check-digit scheme; the last digit counts double if ``double_last`` is 1."""
    reversed_digits = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(reversed_digits, lambda c, i: F.when(
            i % 2 == 1 - double_last,
            F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x)


def valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (_luhn_sum(digits, 0) % 10 == 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``; separators stay."""
    filled = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("done"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(
            F.concat(s["done"], F.substring(digits, s["next"], F.lit(1))).alias("done"), (s["next"] + 1).alias("next"))
        ).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["next"].alias("next"))))
    return filled["done"]


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _card(value: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        moved = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(moved, lambda m: _refill(value, F.concat(
            m, F.pmod(10 - _luhn_sum(m, 1) % 10, F.lit(10)).cast("string"))))

    return _let(_digits(value), lambda d: F.when(valid_card(d), body(d)).otherwise(value))


def _beside(text: Column, key: str) -> Column:
    """What is left of a run of numbers beside its cards, with its own values replaced."""
    def new(v: Column) -> Column:
        return (
            F.when(v.rlike(f"^(?:{_DATE})$"), _date(v, key))
            .when(v.rlike(f"^(?:{_SSN})$"), _refill(v, permute_digits(_digits(v), key, "ssn"))).otherwise(_phone(v, key)))

    return F.when(text.rlike(BESIDE), F.array_join(F.zip_with(
        F.split(text, BESIDE, -1), F.transform(F.regexp_extract_all(text, F.lit(f"({BESIDE})")), new),
        lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def _cards(value: Column, key: str) -> Column:
    """A run of numbers with its cards replaced: windows of whole numbers with a valid check digit.

    From left to right the longest window counts; usual groupings come before others, also
    where they start later.
    """
    def whole(d: Column) -> Column:
        n = F.size(d)

        def window(i: Column) -> Column:
            def lengths(k: Column) -> Column:
                return F.array_join(F.transform(F.slice(d, i + 1, k), lambda x: F.length(x).cast("string")), "-")

            valid = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: valid_card(F.array_join(F.slice(d, i + 1, k), "")))
            return _let(valid, lambda ks: F.struct(
                F.coalesce(F.array_max(F.filter(ks, lambda k: lengths(k).rlike(_USUAL))), F.lit(0)).alias("usual"),
                F.coalesce(F.array_max(F.filter(ks, lambda k: (k == n) | lengths(k).rlike(_LOOSE))), F.lit(0)).alias("loose")))

        def spans(w: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                here = F.get(w, i)
                crossed = F.exists(F.slice(w, i + 2, F.greatest(F.lit(0), here["loose"] - 1)), lambda x: x["usual"] > 0)
                k = F.when(here["usual"] > 0, here["usual"]).when(crossed, 0).otherwise(here["loose"])
                return F.when((i < s["next"]) | (k == 0), s).otherwise(F.struct(
                    F.concat(s["starts"], F.array(i)).alias("starts"), F.concat(s["ends"], F.array(i + k - 1)).alias("ends"),
                    (i + k).alias("next")))

            none = F.array().cast("array<int>")
            return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(none.alias("starts"), none.alias("ends"), F.lit(0).alias("next")), step)

        def replaced(s: Column, gaps: Column) -> Column:
            marked = F.array_join(F.transform(d, lambda x, i: F.concat(
                F.when(F.array_contains(s["starts"], i), "<").otherwise(""), x,
                F.when(F.array_contains(s["ends"], i), ">").otherwise(""), F.coalesce(F.get(gaps, i), F.lit("")))), "")
            return F.array_join(F.transform(
                F.split(marked, "[<>]", -1), lambda p, i: F.when(i % 2 == 1, _card(p, key)).otherwise(_beside(p, key))), "")

        windows = F.transform(F.sequence(F.lit(0), n - 1), window)
        return _let(_let(windows, spans), lambda s: _let(F.regexp_extract_all(value, F.lit("([ -])")), lambda g: replaced(s, g)))

    return _let(F.split(value, "[ -]"), whole)


def _phone(value: Column, key: str) -> Column:
    """The country stays: ``+`` and digits up to the first separator."""
    country = F.regexp_extract(value, r"^(\+\d{1,3}(?=[^0-9]))?", 0)
    return _let(F.substring(value, F.length(country) + 1, F.length(value)), lambda rest: F.concat(
        country, _refill(rest, permute_digits(_digits(rest), key, "phone"))))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    moved = _let(parts, lambda p: _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, "ip"))
    return _let(moved, lambda m: F.concat_ws(".", *(
        x.cast("string") for x in (F.floor(m["a"] / 256), m["a"] % 256, F.floor(m["b"] / 256), m["b"] % 256))))


def _date(value: Column, key: str) -> Column:
    """ISO notation with ``-`` or ``/``, or day, month and year with ``.`` or ``/``; month first where only that is a date."""
    year_first = value.rlike(r"^\d{4}")
    mark = F.regexp_extract(value, r"[./-]", 0)
    parts = F.split(value, r"[./-]")

    def number(iso: Column) -> Column:
        return F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))

    def written(n: Column, *fields: str) -> Column:
        return F.concat(F.date_format(n, fields[0]), mark, F.date_format(n, fields[1]), mark, F.date_format(n, fields[2]))

    def body(p: Column) -> Column:
        first, second = (F.lpad(F.get(p, F.lit(i)), 2, "0") for i in (0, 1))
        plain = F.when(year_first, number(F.concat_ws("-", p[0], p[1], p[2]))).otherwise(number(F.concat_ws("-", p[2], second, first)))
        turned = F.when(~year_first, number(F.concat_ws("-", p[2], first, second)))

        def known(d: Column, turn: Column) -> Column:
            moved = _feistel(F.floor(d / DAY_COLUMNS), F.pmod(d, F.lit(DAY_COLUMNS)), F.lit(DAY_ROWS), F.lit(DAY_COLUMNS), key, "date")
            new = _let(moved, lambda m: F.date_add(F.lit("1900-01-01").cast("date"), (m["a"] * DAY_COLUMNS + m["b"]).cast("int")))
            return _let(new, lambda n: F.when(year_first, written(n, "yyyy", "MM", "dd")).when(
                turn, written(n, "MM", "dd", "yyyy")).otherwise(written(n, "dd", "MM", "yyyy")))

        return _let(F.struct(F.coalesce(plain, turned).alias("day"), plain.isNull().alias("turn")), lambda x: F.when(
            x["day"].between(0, DAYS - 1), known(x["day"], x["turn"])).otherwise(value))

    return _let(parts, body)


def _email(value: Column, key: str) -> Column:
    last = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    return F.concat(permute_characters(F.substring(value, F.lit(1), F.length(value) - F.length(last)), key, "email"), last)


def _secret(value: Column, key: str) -> Column:
    own = F.regexp_extract(value, r"[A-Za-z0-9_/+.-]{8,}$", 0)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(own)), permute_characters(own, key, "secret"))


def _iban_rest(text: Column) -> Column:
    """Remainder by 97 of an account number, letters as 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(
        c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))

    def body(p: Column) -> Column:
        moved = permute_characters(F.substring(p, F.lit(5), F.length(p)), key, "iban")

        def whole(m: Column) -> Column:
            country = F.substring(p, F.lit(1), F.lit(2))
            check = F.lpad((98 - _iban_rest(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0")
            return _let(F.concat(country, check, m), lambda n: F.aggregate(
                F.split(value, ""), F.struct(F.lit("").alias("done"), F.lit(1).alias("next")),
                lambda s, c: F.when(c == " ", F.struct(F.concat(s["done"], c).alias("done"), s["next"].alias("next"))).otherwise(
                    F.struct(F.concat(s["done"], F.substring(n, s["next"], F.lit(1))).alias("done"), (s["next"] + 1).alias("next"))))["done"])

        valid = _iban_rest(F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, _let(moved, whole)).otherwise(value)

    return _let(plain, body)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value."""
    def is_a(kind: str) -> Column:
        return value.rlike(f"^(?:{dict(KINDS)[kind]})$")

    return (
        F.when(is_a("secret"), _secret(value, key)).when(is_a("email"), _email(value, key))
        .when(is_a("iban"), _iban(value, key)).when(is_a("date"), _date(value, key)).when(is_a("ip"), _ip(value, key))
        .when(is_a("ssn"), _refill(value, permute_digits(_digits(value), key, "ssn")))
        .when(is_a("card"), _cards(value, key)).when(is_a("phone"), _phone(value, key))
        .otherwise(value))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """The documents with the values in ``column`` replaced; ``count`` names a column for the number
    of places that fit a pattern."""
    text = F.col(column)
    some = text.rlike(r"[0-9]|@|(?i:token|secret|passw|key)")
    values = F.when(some, F.regexp_extract_all(text, F.lit(f"({PATTERN})"))).otherwise(F.array().cast("array<string>"))
    between = F.split(text, PATTERN, -1)
    found = fresh(docs, "pii_values")
    out = docs.withColumn(found, values)
    new = F.array_join(F.zip_with(
        between, F.transform(found, lambda v: pseudonym(v, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = out.withColumn(column, F.when(F.size(found) > 0, new).otherwise(text))
    if count:
        out = out.withColumn(count, F.greatest(F.size(found), F.lit(0)).cast("long"))
    return out.drop(found)
