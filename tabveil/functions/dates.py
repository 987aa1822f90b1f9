"""The date formats that are recognised in texts, and shifting a date in place, as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabveil.functions.binding import let

# The formats in the order in which they are tried. MF: month first, DF: day first.
FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-ddTHH:mm:ss", "yyyy-MM-ddTHH:mm:ss.FFFFFFF", "yyyy-MM-ddTHH:mm:ssK", "yyyy-MM-ddTHH:mm:ss.FFFFFFFK", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.FFFFFFF",
    "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "M/d/yyyy", "M/d/yy", "M/d/yyyy h:mm tt", "M/d/yyyy h:mm:ss tt", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "d/M/yyyy", "d/M/yy",
    "d/M/yyyy h:mm tt", "d/M/yyyy h:mm:ss tt", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d-M-yyyy", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DIGITS_ONLY = FORMATS.index("yyyyMMdd")
#: The last year that two digits can mean.
PIVOT = 2049

TOKEN = re.compile(r"\.FFFFFFF|yyyy|yy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|ss|tt|K|.")
_SHORT = "|".join(m[:3] for m in MONTHS)
_PATTERN = {
    "yyyy": "([0-9]{4})", "yy": "([0-9]{2})", "MMMM": f"({'|'.join(MONTHS)})", "MMM": f"({_SHORT})", "MM": "([0-9]{2})", "M": "([0-9]{1,2})", "dd": "([0-9]{2})", "d": "([0-9]{1,2})",
    "HH": "(?:[01][0-9]|2[0-3])", "H": "(?:[01]?[0-9]|2[0-3])", "hh": "(?:0[1-9]|1[0-2])", "h": "(?:0?[1-9]|1[0-2])", "mm": "[0-5][0-9]", "ss": "[0-5][0-9]", "tt": "(?:AM|PM)",
    ".FFFFFFF": r"(?:\.[0-9]{1,7})?", "K": r"(?:Z|[+-][0-9]{2}:[0-9]{2})?",
}


@dataclass(frozen=True)
class Format:
    pattern: str
    regex: str
    year: int
    month: int
    day: int
    year_digits: int
    month_named: bool

    @property
    def has_time(self) -> bool:
        return "mm" in self.pattern

    @property
    def month_first(self) -> bool:
        return self.pattern[0] == "M" and "/" in self.pattern or self.pattern == "M-d-yyyy"

    @property
    def day_first(self) -> bool:
        return self.pattern.startswith(("d/M", "d-M-"))


def _compiled(pattern: str) -> Format:
    regex, groups, at = "", {}, 0
    for token in TOKEN.findall(pattern):
        piece = _PATTERN.get(token)
        if piece and piece[0] == "(" and piece[1] != "?":
            at += 1
            groups[token[0]] = (at, token)
        regex += piece or re.escape(token)
    return Format(pattern, rf"(?i)\A{regex}\z", groups["y"][0], groups["M"][0], groups["d"][0], len(groups["y"][1]), len(groups["M"][1]) > 2)


CANDIDATES = tuple(map(_compiled, FORMATS))


def looks_like_date(v: Column) -> Column:
    return F.length(v).between(6, 40) & v.rlike(r"\A[\p{L}\p{Nd}]") & v.rlike("[0-9]")


def may_be_date(v: Column) -> Column:
    """Whether v can be a date of any format that has more than digits: a cheap look that misses none."""
    apart = reduce(lambda a, c: a | F.contains(v, F.lit(c)), ("/", " "), F.contains(v, F.lit("-")))
    return F.length(v).between(6, 40) & apart & v.rlike(r"\A[\p{L}\p{Nd}]")


def _date(v: Column, f: Format) -> Column:
    """The date that v is in this format, or null."""
    part = lambda i: F.regexp_extract(v, f.regex, i)
    year = part(f.year)
    if f.year_digits == 2:
        century = F.when(year > f"{PIVOT % 100:02d}", str(PIVOT // 100 - 1)).otherwise(str(PIVOT // 100))
        year = F.concat(century, year)
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(part(f.month), 1, 3))).cast("string") if f.month_named else part(f.month)
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(part(f.day), 2, "0"))
    return F.when(v.rlike(f.regex) & (year != "0000"), text.try_cast("date"))


#: How texts of a format begin, once their digits are 9: what decides which formats are tried at all.
_BEGINNINGS = (r"9999-", r"9999/", r"99?/", r"99?-9", r"99?-\p{L}", r"99? ", r"\p{L}", r"99999999")


def _beginning(f: Format) -> str:
    of = {"yyyy-": 0, "yyyy/": 1, "yyyyM": 7, "d-MMM": 4, "d MMM": 5}.get(f.pattern[:5])
    return _BEGINNINGS[of if of is not None else 6 if f.pattern.startswith("MMM") else 2 if "/" in f.pattern else 3]


def format_mask(v: Column, digits_only: bool) -> Column:
    """A bit for each format that v is a date of; 0 for none and for texts that don't look like dates."""
    formats = [(i, f) for i, f in enumerate(CANDIDATES) if i != DIGITS_ONLY or digits_only]

    def bits(v: Column, group: list) -> Column:
        return reduce(lambda a, b: a + b, [F.when(_date(v, f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in group])

    def tried(v: Column) -> Column:
        like = F.regexp_replace(F.left(v, F.lit(8)), "[0-9]", "9")
        out = F.lit(0)
        for start in reversed(_BEGINNINGS):
            if group := [(i, f) for i, f in formats if _beginning(f) == start]:
                out = F.when(like.rlike(rf"\A{start}"), bits(v, group)).otherwise(out)
        return out

    # Bound, since the code for so many patterns would be too long to compile.
    return F.when(looks_like_date(v), let(v, tried)).otherwise(F.lit(0)).cast("long")


def _like(old: Column, new: Column) -> Column:
    """new as wide as old: two digits keep two, one digit may grow."""
    text = new.cast("string")
    return F.when(F.length(old) >= 2, F.lpad(text, 2, "0")).otherwise(text)


def _named(old: Column, month: Column) -> Column:
    names = F.array(*[F.lit(m.capitalize()) for m in MONTHS])
    name = F.element_at(names, month)
    name = F.when(F.length(old) == 3, F.substring(name, 1, 3)).otherwise(name)
    upper, lower = old.rlike("[A-Z]"), old.rlike("[a-z]")
    return F.when(upper & ~lower, F.upper(name)).when(lower & ~upper, F.lower(name)).otherwise(name)


def _shifted_as(v: Column, f: Format, days: Column) -> Column:
    order = sorted((f.year, f.month, f.day))
    # The regex again, with the texts between the three groups captured as well.
    wrapped, names = "", []
    for piece in re.split(r"(\((?!\?)[^()]*\))", f.regex.removeprefix(r"(?i)\A").removesuffix(r"\z")):
        named = piece.startswith("(") and not piece.startswith("(?")
        wrapped += piece if named else f"({piece})"
        names.append(order[sum(n != 0 for n in names)] if named else 0)
    regex = rf"(?i)\A{wrapped}\z"

    def rewritten(new: Column) -> Column:
        out = []
        for i, n in enumerate(names, 1):
            old = F.regexp_extract(v, regex, i)
            if n == f.year:
                old = F.lpad((F.year(new) % 100).cast("string"), 2, "0") if f.year_digits == 2 else F.lpad(F.year(new).cast("string"), 4, "0")
            elif n == f.month:
                old = let(old, lambda old: _named(old, F.month(new))) if f.month_named else _like(old, F.month(new))
            elif n:
                old = _like(old, F.dayofmonth(new))
            out.append(old)
        return F.when(F.year(new).between(1, 9999), F.concat(*out))

    # A binding of null stays null.
    return let(F.date_add(_date(v, f), days.cast("int")), rewritten)


def shift(v: Column, days: Column, first: tuple[str, ...] = ()) -> Column:
    """v with its date moved by days and all else kept; null if no format fits. first: formats to try first."""
    order = [*first, *(f.pattern for f in CANDIDATES if f.pattern not in first)]
    by_pattern = {f.pattern: f for f in CANDIDATES}
    shapes = [by_pattern.get(p) or _compiled(p) for p in order]
    return let(days, lambda days: F.coalesce(*[F.when(v.rlike(f.regex), _shifted_as(v, f, days)) for f in shapes]))


def cover(histogram: dict[int, int]) -> list[int]:
    """Formats that cover all matched values: each time the one with most values left, the earliest among equals."""
    left, chosen = {m: n for m, n in histogram.items() if m}, []
    while left:
        counts = [sum(n for m, n in left.items() if m >> i & 1) for i in range(len(CANDIDATES))]
        best = max(range(len(counts)), key=lambda i: (counts[i], -i))
        chosen.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return chosen


def is_ambiguous(chosen: list[int], histogram: dict[int, int]) -> bool:
    """A month-first format was chosen and no value could only be read month first."""
    day_first = sum(1 << i for i, f in enumerate(CANDIDATES) if f.day_first)
    return any(CANDIDATES[i].month_first for i in chosen) and not any(m and not m & day_first and any(m >> i & 1 for i, f in enumerate(CANDIDATES) if f.month_first) for m in histogram)
