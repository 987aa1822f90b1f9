"""Reading numbers out of texts and writing them back in the same shape, as Column expressions.

A number is taken apart into its digits, without sign and point, and its scale. Arithmetic on the digits alone is the
same for every scale, so numbers of up to MOST_DIGITS digits, wherever their point is, need no case of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabveil.functions.binding import Steps
from tabveil.functions.text import PLAIN_NUMBER, SPACE

#: An optional pair of parentheses, sign and $ in either order, digits with or without thousands groups, a fraction.
BODY = r"([-+]?)(\$?)([-+]?)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]*)(?:\.([0-9]+))?"
SHAPE = rf"\A([{SPACE}]*)(\(?){BODY}(\)?)([{SPACE}]*)\z"
#: Digits of a number, leading zeros aside, and behind its point.
MOST_DIGITS = 28
#: Digits whose product with a factor of 17 is exact.
SHORT_DIGITS = 20
DIGITS, WIDE = "decimal(38,0)", "decimal(38,10)"

PARTS = ("lead", "open", "sign1", "currency", "sign2", "whole", "fraction", "close", "trail")
#: Between the parts of a number, once it is taken apart. A text that holds it is no number.
MARK = "\x01"


def parse_steps(v: Column):
    """The parts of the shape, sign, negative, scale and digits (decimal, null if v is no number), as a dict of columns."""
    plain = yield v.rlike(PLAIN_NUMBER)  # most are; they are taken apart without capturing
    none, point = F.lit(""), F.lit(".")
    size = F.ltrim(v, F.lit("-"))
    simple = F.array(
        none, none, F.when(v.startswith("-"), "-").otherwise(""), none, none, F.substring_index(size, ".", 1),
        F.when(F.contains(v, point), F.substring_index(size, ".", -1)).otherwise(""), none, none,
    )
    taken = F.split(F.regexp_replace(v, SHAPE, MARK.join(f"${i}" for i in range(1, len(PARTS) + 1))), MARK)
    parts = yield F.when(plain, simple).otherwise(F.when(~F.contains(v, F.lit(MARK)), taken))
    p = {n: F.get(parts, F.lit(i)) for i, n in enumerate(PARTS)}
    sign, bracketed = F.concat(p["sign1"], p["sign2"]), p["open"] != ""
    written = yield F.when(F.size(parts) == len(PARTS), F.concat(F.replace(p["whole"], F.lit(","), none), p["fraction"]))
    bare = F.ltrim(written, F.lit("0"))
    fine = plain | ((written != "") & (F.length(sign) <= 1) & (bracketed == (p["close"] != "")) & ~(bracketed & (sign != "")))
    digits = yield F.when(fine & (F.length(bare) <= MOST_DIGITS) & (F.length(p["fraction"]) <= MOST_DIGITS), written.try_cast(DIGITS))
    return p | {"sign": sign, "negative": bracketed | (sign == "-"), "scale": F.length(p["fraction"]), "digits": digits}


def value_steps(v: Column) -> Steps:
    """The number itself, to ten decimals; null if v is none."""
    p = yield from parse_steps(v)
    whole = F.replace(p["whole"], F.lit(","), F.lit(""))
    text = F.concat(F.when(p["negative"], "-").otherwise(""), F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(p["fraction"] == "", "0").otherwise(p["fraction"]))
    return (yield F.when(p["digits"].isNotNull(), text.try_cast(WIDE)))


def times_steps(p: dict[str, Column], factor: Column, at_least_one: bool = False) -> Steps:
    """The digits of the number p times factor (decimal(17,15), positive), rounded half away from zero to p's own scale;
    never 0 and, with at_least_one, not below 1 if the number is not. p's columns are bound."""
    d = p["digits"]
    short = F.round(d.cast(f"decimal({SHORT_DIGITS},0)") * factor, 0).cast(DIGITS)
    long = F.round(d.cast(f"decimal({MOST_DIGITS},0)") * factor, 0).cast(DIGITS)
    x = yield F.when(d < F.lit("1" + "0" * SHORT_DIGITS).cast(DIGITS), short).otherwise(long)
    one = F.lit(1).cast(DIGITS)
    if at_least_one:
        one = F.when(p["scale"] == 0, one).otherwise(F.rpad(F.lit("1"), p["scale"] + 1, F.lit("0")).cast(DIGITS))
        one = yield one
        x = F.when(d >= one, F.greatest(x, one)).otherwise(x)
    return (yield F.greatest(x, F.lit(1).cast(DIGITS)))


def write_steps(digits: Column, p: dict[str, Column]) -> Steps:
    """digits, at p's scale and with its sign, in the shape of p; digits and p's columns are bound."""
    text = yield digits.cast("string")
    text = yield F.when(F.length(text) <= p["scale"], F.lpad(text, p["scale"] + 1, F.lit("0"))).otherwise(text)
    whole = yield F.left(text, F.length(text) - p["scale"])
    fraction = F.when(p["scale"] > 0, F.concat(F.lit("."), F.right(text, p["scale"]))).otherwise("")
    grouped = F.reverse(F.regexp_replace(F.reverse(whole), r"([0-9]{3})(?=[0-9])", "$1,"))
    old = p["whole"]
    padded = F.when(old.startswith("0") & (F.length(old) > F.length(whole)) & (F.length(old) > 1), F.lpad(whole, F.length(old), F.lit("0"))).otherwise(whole)
    front = F.when(F.contains(old, F.lit(",")), grouped).when((old == "") & (whole == "0"), "").otherwise(padded)
    number = yield F.concat(front, fraction)
    bracketed, first = p["open"] != "", (p["sign1"] == "") & (p["currency"] != "")  # $ stood before the sign, or alone
    body = F.when(bracketed, F.concat(F.lit("("), p["currency"], number, F.lit(")"))).when(first, F.concat(p["currency"], p["sign"], number)).otherwise(F.concat(p["sign"], p["currency"], number))
    return F.concat(p["lead"], body, p["trail"])
