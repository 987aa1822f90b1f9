"""What column names say about their columns. Names are metadata, so this is plain Python on the driver."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from tabveil.functions.text import SPACE

# The words that hint at a column's meaning.
STRONG_ID = {"id", "key", "no", "nbr", "num", "number", "guid", "uuid"}
PERSON = {"first", "last", "full", "middle", "given", "surname", "rep", "contact", "owner", "manager", "employee", "patient", "physician"}
ORGANISATION = {"customer", "account", "facility", "hospital", "company", "vendor", "client", "supplier", "payer", "org", "organization"}
COUNT = {"qty", "quantity", "count", "cnt", "beds", "units"}
MEASURE = {"amount", "amt", "revenue", "price", "cost", "margin", "total", "balance", "fee", "fees", "charge", "charges", "payment", "sales"}
PHONE, DATE, ZIP = {"fax", "mobile", "cell", "tel"}, {"dt", "day", "dob", "time", "timestamp"}, {"postcode"}
STATE, CITY, ADDRESS = {"state", "province"}, {"city", "town"}, {"addr", "street"}
FIRST, LAST, HOSPITAL = {"first", "given", "middle"}, {"last", "surname"}, {"hospital", "facility"}
WITHIN = {"zip": ("zip", "postal"), "phone": ("phone",), "date": ("date",), "address": ("address",)}
COUNT_OF, WEAK_ID = (("number", "of"), ("num", "of")), "code"

_PARTS = re.compile(r"[0-9]+|[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def tokenize(name: str) -> list[str]:
    """Lower-case words of a name: split at separators, between letters and digits, and at camel case."""
    out = []
    for part in _PARTS.findall(name or ""):
        for word in _CAMEL.split(part):
            word = word.lower()
            out += [word[:-4], "name"] if len(word) > 4 and word.endswith("name") else [word]
    return out


@dataclass(frozen=True)
class Hints:
    tokens: tuple[str, ...]

    @classmethod
    def of(cls, name: str) -> Hints:
        return cls(tuple(tokenize(name)))

    def any(self, words: set[str]) -> bool:
        return bool(words.intersection(self.tokens))

    def within(self, *parts: str) -> bool:
        joined = "".join(self.tokens)
        return any(p in joined for p in parts)

    def then(self, a: str, b: str) -> bool:
        return (a, b) in zip(self.tokens, self.tokens[1:], strict=False)

    zip = property(lambda self: self.within(*WITHIN["zip"]) or self.any(ZIP))
    phone = property(lambda self: self.within(*WITHIN["phone"]) or self.any(PHONE))
    date = property(lambda self: self.within(*WITHIN["date"]) or self.any(DATE))
    state = property(lambda self: self.any(STATE))
    city = property(lambda self: self.any(CITY))
    address = property(lambda self: self.within(*WITHIN["address"]) or self.any(ADDRESS))
    count = property(lambda self: self.any(COUNT) or any(self.then(*pair) for pair in COUNT_OF))
    measure = property(lambda self: self.any(MEASURE))
    first_name = property(lambda self: self.any(FIRST))
    last_name = property(lambda self: self.any(LAST))
    hospital = property(lambda self: self.any(HOSPITAL))

    @property
    def id(self) -> str:
        """strong, weak or none, by the last word."""
        last = self.tokens[-1] if self.tokens else ""
        return "strong" if last in STRONG_ID else "weak" if last == WEAK_ID else "none"

    @property
    def name_kind(self) -> tuple[str, str] | None:
        """(person or org, qualifier): the known qualifier nearest before the last "name"."""
        at = max((i for i, t in enumerate(self.tokens) if t == "name"), default=-1)
        for t in reversed(self.tokens[: max(at, 0)]):
            if t in PERSON:
                return "person", t
            if t in ORGANISATION:
                return "org", t
        return None


def header_keys(names: list[str]) -> list[str]:
    """Unique keys: a repeated name gets #2, #3, ...; a blank one Column<n>; none takes a name that really occurs."""
    real, used, out = {n for n in names if n.strip()}, set(), []
    for i, name in enumerate(names, 1):
        base = name if name.strip() else f"Column{i}"
        key, n = base, 1
        while key in used or (key in real and (n > 1 or not name.strip())):
            n += 1
            key = f"{base}#{n}"
        used.add(key)
        out.append(key)
    return out


def normal_header(name: str) -> str:
    return re.sub(f"[{SPACE}]+", " ", re.sub(rf"\A[{SPACE}]+|[{SPACE}]+\Z", "", name)).lower()


def header_signature(names: list[str]) -> str:
    return hashlib.sha256("\x1f".join(map(normal_header, names)).encode()).hexdigest()
