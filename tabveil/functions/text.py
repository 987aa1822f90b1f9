"""Predicates and shapes of cell texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the patterns of the value kinds.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
EMAIL = rf"\A[^@{SPACE}]+@[^@{SPACE}]+\.[A-Za-z]{{2,}}(?=\n?\z)"
ZIP_PLUS_4 = r"\A[0-9]{5}-[0-9]{4}(?=\n?\z)"
FORMATTED_PHONE = rf"(?i)\A(?:\+?1[{SPACE}.-]?)?(?:\([0-9]{{3}}\)[{SPACE}]?|[0-9]{{3}}[{SPACE}.-])[0-9]{{3}}[{SPACE}.-][0-9]{{4}}(?:[{SPACE}]*(?:x|ext\.?)[{SPACE}]*[0-9]{{1,6}})?(?=\n?\z)"
PHONE_CHARACTERS = rf"(?i)\A\+?[0-9{SPACE}().-]+(?:[{SPACE}]*(?:x|ext\.?)[{SPACE}]*[0-9]{{1,6}})?(?=\n?\z)"
NUMBER = r"\A(\()?([-+])?(\$)?([-+])?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:\.([0-9]+))?(\))?\z"
#: The numbers among them that need no closer look.
PLAIN_NUMBER = r"\A-?[0-9]+(?:\.[0-9]+)?\z"
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "GU", "VI", "AS", "MP",
)
STATE_NAMES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa",
    "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada",
    "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina",
    "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming", "District of Columbia", "Puerto Rico", "Guam",
    "U.S. Virgin Islands", "American Samoa", "Northern Mariana Islands",
)


def is_blank(v: Column) -> Column:
    """Empty or white space only; null for null."""
    return ~v.rlike(f"[^{SPACE}]")


def has_value(v: Column) -> Column:
    return F.coalesce(~is_blank(v), F.lit(False))


def trim(v: Column) -> Column:
    edge = F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1)).rlike(f"[{SPACE}]")
    return F.when(edge, F.regexp_replace(v, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(v)


def utf16_length(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(F.octet_length(v) == n, n).otherwise((F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int"))


def has_digit(v: Column) -> Column:
    return v.rlike("[0-9]")


def has_space_or_tab(v: Column) -> Column:
    return F.contains(v, F.lit(" ")) | F.contains(v, F.lit("\t"))


def is_all_digits(v: Column) -> Column:
    return v.rlike(r"\A[0-9]+\z")


def has_leading_zero(v: Column) -> Column:
    return v.rlike(r"\A0[0-9]+\z")


def is_email(v: Column) -> Column:
    return F.contains(v, F.lit("@")) & v.rlike(EMAIL)


def is_zip5(v: Column) -> Column:
    return v.rlike(r"\A[0-9]{5}\z")


def is_zip_plus4(v: Column) -> Column:
    return (utf16_length(v) == 10) & v.rlike(ZIP_PLUS_4)


def is_short_zip(v: Column) -> Column:
    return v.rlike(r"\A[0-9]{3,4}\z")


def is_formatted_phone(v: Column) -> Column:
    return v.rlike(FORMATTED_PHONE)


def is_phone_like(v: Column) -> Column:
    return v.rlike(PHONE_CHARACTERS) & (F.length(v) - F.length(F.translate(v, "0123456789", ""))).between(7, 20)


def is_state(v: Column) -> Column:
    n = utf16_length(v)
    return F.when(n == 2, F.upper(v).isin(*STATE_CODES)).otherwise((n <= 30) & F.upper(trim(v)).isin(*[s.upper() for s in STATE_NAMES]))


def number_steps(v: Column):
    """struct(is_integer, scale, thousands, currency, parentheses) of a number, or null.

    One match decides whether the text is a number; what it looks like then follows from single characters. Most are
    digits with a point or without, which a simpler pattern tells.
    """
    plain = yield v.rlike(PLAIN_NUMBER)
    t = yield F.when(~plain & has_digit(v), trim(v))
    has = lambda c: F.contains(t, F.lit(c))
    # The pattern has optional signs on both sides of $, and brackets that may be left open.
    fine = t.rlike(NUMBER) & (t.startswith("(") == t.endswith(")")) & ~((has("-") | has("+")) & t.rlike(r"[-+]\$?[-+]"))
    fraction = F.when(has("."), F.length(F.rtrim(F.substring_index(t, ".", -1), F.lit(")")))).otherwise(0)
    point, no = F.instr(v, "."), F.lit(False)
    simple = F.struct((point == 0).alias("is_integer"), F.when(point > 0, F.length(v) - point).otherwise(0).alias("scale"), no.alias("thousands"), no.alias("currency"), no.alias("parentheses"))
    shaped = F.struct((~has(".")).alias("is_integer"), fraction.alias("scale"), has(",").alias("thousands"), has("$").alias("currency"), has("(").alias("parentheses"))
    return F.when(plain, simple).when(fine, shaped)


def copy_case(source: Column, fake: Column) -> Column:
    upper, lower = source.rlike(r"\p{Lu}"), source.rlike(r"\p{Ll}")
    return F.when(upper & ~lower, F.upper(fake)).when(lower & ~upper, F.lower(fake)).otherwise(fake)
