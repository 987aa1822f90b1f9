"""Candidates of the mapping strategies: what a value may become at its n-th attempt.

A candidate depends only on the key, the seed and the attempt.
"""

from __future__ import annotations

import math
import re

import numpy as np

from tabveil.functions.seeds import SEPARATOR, Draws, ManyDraws
from tabveil.plans.model import FakeOptions, Rule

#: Attempts after which a candidate is told apart by a number, where the strategy can; attempts of those that draw only.
BEFORE_NUMBERS = 50
MOST_ATTEMPTS = 10_000
#: As far as attempts are counted: numbers have no other end.
LAST_NUMBER = 2**31 - 2
RANDOM_ATTEMPTS = 100
LIST_ATTEMPTS = 20

# Word pools of our own.
FIRST = "Ada Ben Clara Dov Elsa Finn Greta Hugo Iris Jonas Kira Leo Mara Nils Olga Paul Quinn Rosa Sven Tilda Umar Vera Willa Xenia Yara Zeno Anna Bruno Cora Dario Edda Felix Gina Hanna Ivo Jana Karl Lena Milo Nora Otto Pia Rolf Sina Theo Ulla Viktor Wanda Alma Bela".split()
LAST = "Abel Berg Conrad Dahl Ebner Falk Graf Holm Iversen Jung Keller Lang Moser Nagel Olsen Peters Quist Roth Sand Thiel Urban Vogt Winter Young Zander Adler Brandt Cramer Dorn Engel Frost Gruber Hahn Ibsen Jansen Koch Lindt Marsh Noor Otter Pohl Reyes Stern Tanner Ulrich Vance Weiss Ziegler Amsel Brook".split()
PLACE_HEAD = "North South East West Lake Port Fort New Upper Lower Green Silver Stone River Oak Maple Cedar Clear Fair Spring".split()
PLACE_TAIL = "field ton ville burg haven ford bridge wood dale mouth side view land stead brook".split()
STREET = "Street Avenue Road Lane Drive Court Way Place".split()
COMPANY = "Group|Partners|& Sons|Holdings|Works|Supply Co|Industries|Labs".split("|")
DOMAINS = ("example.com", "example.net", "example.org")  # reserved for examples
HOSPITAL = ("Medical Center", "Hospital", "Health")
ZIP_SHAPE = re.compile(r"([0-9]{5})-([0-9]{4})\n?\Z")


def slots(value: str) -> list[tuple[int, int, int]]:
    """(place, base, radix) of what an identifier's outputs have other digits or letters in."""
    out = []
    for i, c in enumerate(value):
        if c in "0123456789":
            starts = i == 0 or value[i - 1] not in "0123456789"
            run = starts and i + 1 < len(value) and value[i + 1] in "0123456789"
            if run and c == "0":
                continue  # zero padding stays
            out.append((i, 49, 9) if run else (i, 48, 10))
        elif c.isalpha() and ord(c) < 0x10000:
            out.append((i, 65 if c.isupper() else 97, 26))
    return out


def _hash_id(value: str, draws: Draws, attempt: int, prefix: str) -> str | None:
    out, drawn = list(value), [(i, base, radix, draws.below(radix)) for i, base, radix in slots(value)]
    if not drawn:
        return None
    carry = max(0, attempt - RANDOM_ATTEMPTS)
    for i, base, radix, digit in reversed(drawn):
        carry, digit = divmod(digit + carry, radix)
        out[i] = chr(base + digit)
    return prefix + "".join(out)


def _zip(value: str, draws: Draws, attempt: int, listed: list[str] | None) -> str | None:
    """listed: the known ZIPs with the value's prefix."""
    plus = ZIP_SHAPE.match(value)
    if not plus and not re.fullmatch("[0-9]{3,5}", value):
        return None
    prefix = (plus[1] if plus else value.rjust(5, "0"))[:3]
    out = listed[draws.below(len(listed))] if listed is not None and len(listed) and attempt < LIST_ATTEMPTS else f"{prefix}{draws.below(100):02d}"
    return f"{out}-{draws.below(10_000):04d}" if plus else out[5 - len(value) :]


def _phone(value: str, draws: Draws) -> str | None:
    digits = [c for c in value if c in "0123456789"]
    if not digits:
        return None
    out, at = [], -1 if len(digits) == 11 and digits[0] == "1" else 0
    for c in value:
        if c in "0123456789":
            c = c if at < 0 else str(2 + draws.below(8) if at in (0, 3) else draws.below(10))
            at += 1
        out.append(c)
    return "".join(out)


def _place(draws: Draws) -> str:
    head = PLACE_HEAD[draws.below(len(PLACE_HEAD))]
    return head + PLACE_TAIL[draws.below(len(PLACE_TAIL))]


def _fake(kind: str, draws: Draws) -> str:
    if kind in ("PersonFirst", "PersonLast", "PersonFull", "Email"):  # the same draws, so one seed is one person
        first, last = FIRST[draws.below(len(FIRST))], LAST[draws.below(len(LAST))]
        if kind == "Email":
            return f"{first}.{last}{draws.below(100)}@{DOMAINS[draws.below(len(DOMAINS))]}".lower()
        return {"PersonFirst": first, "PersonLast": last, "PersonFull": f"{first} {last}"}[kind]
    if kind == "Company":
        return f"{LAST[draws.below(len(LAST))]} {COMPANY[draws.below(len(COMPANY))]}"
    if kind == "StreetAddress":
        return f"{1 + draws.below(9999)} {LAST[draws.below(len(LAST))]} {STREET[draws.below(len(STREET))]}"
    return f"{_place(draws)} {HOSPITAL[draws.below(len(HOSPITAL))]}" if kind == "Hospital" else _place(draws)


def _copy_case(source: str, fake: str) -> str:
    upper, lower = any(c.isupper() for c in source), any(c.islower() for c in source)
    return fake.upper() if upper and not lower else fake.lower() if lower and not upper else fake


def attempt_of(rule: Rule, key: bytes, value: str, domain: str, seed: str, attempt: int, listed=None) -> str | None:
    o = rule.chosen
    suffix = min(attempt, RANDOM_ATTEMPTS) if rule.strategy == "HashId" else attempt
    draws = Draws(key, domain, seed, *([str(suffix)] if suffix else []))
    if rule.strategy == "HashId":
        return _hash_id(value, draws, attempt, o.prefix)
    if rule.strategy == "ZipRemap":
        return _zip(value, draws, attempt, listed)
    if o.kind == "Phone":
        return _phone(value, draws)
    fake = _fake(o.kind, draws)
    return _copy_case(value, fake) if o.preserve_case else fake


def can_number(rule: Rule) -> bool:
    return isinstance(rule.options, FakeOptions) and rule.options.kind != "Phone"


def last_attempt(rule: Rule, value: str) -> int:
    """The last entry of a value's list: an identifier's goes through all outputs there are, numbers go on."""
    if can_number(rule):
        return LAST_NUMBER
    space = math.prod(radix for _, _, radix in slots(value)) if rule.strategy == "HashId" else 0
    return max(MOST_ATTEMPTS, min(RANDOM_ATTEMPTS + space, LAST_NUMBER))


def space_of(rule: Rule, value: str) -> str | None:
    """Equal for values that have the same outputs and are among them; null for the others."""
    if rule.strategy == "HashId" and not rule.chosen.prefix:
        out = list(value)
        for i, base, radix in slots(value):
            out[i] = f"\x01{base}.{radix}\x01"
        return "".join(out)
    if rule.strategy == "ZipRemap":
        plus = ZIP_SHAPE.match(value)
        return f"{plus[1][:3]}/plus" if plus else f"{value.rjust(5, '0')[:3]}/{len(value)}" if re.fullmatch("[0-9]{3,5}", value) else None
    return None


def pool_size(rule: Rule) -> int:
    """Names of a kind there are, at most, before they are told apart by numbers."""
    places = len(PLACE_HEAD) * len(PLACE_TAIL)
    return {
        "PersonFirst": len(FIRST), "PersonLast": len(LAST), "PersonFull": len(FIRST) * len(LAST), "Email": len(FIRST) * len(LAST) * 100 * len(DOMAINS), "Company": len(LAST) * len(COMPANY),
        "StreetAddress": 9999 * len(LAST) * len(STREET), "Hospital": places * len(HOSPITAL), "City": places,
    }[rule.options.kind]


def choice(rule: Rule, key: bytes, value: str, domain: str, seed: str, n: int, listed=None) -> str | None:
    """The n-th entry of a value's list of preferences."""
    if n < BEFORE_NUMBERS or not can_number(rule):
        return attempt_of(rule, key, value, domain, seed, n, listed)
    return numbered(rule.options.kind, attempt_of(rule, key, value, domain, seed, 0, listed), n)


#: Outputs of a space that is told apart by their places, at most.
MOST_PLACES = 1 << 22
#: The pools whose draws make a name, in the order of the draws, and which draws of them count.
_POOLS = {
    "PersonFirst": ((FIRST, LAST), 1), "PersonLast": ((FIRST, LAST), 2), "PersonFull": ((FIRST, LAST), 3), "Email": ((FIRST, LAST, range(100), DOMAINS), 15), "Company": ((LAST, COMPANY), 3),
    "StreetAddress": ((range(1, 10_000), LAST, STREET), 7), "Hospital": ((PLACE_HEAD, PLACE_TAIL, HOSPITAL), 7), "City": ((PLACE_HEAD, PLACE_TAIL), 3),
}
_PLACES = {h.lower() + t: (h.lower(), t) for h in PLACE_HEAD for t in PLACE_TAIL}
_AT = {kind: [{str(w).lower(): i for i, w in enumerate(pool)} for pool in pools] for kind, (pools, _) in _POOLS.items()}


def radices(rule: Rule, value: str) -> list[tuple[int, bool]]:
    """The draws behind an entry of a value's list, and whether they count in its place among all outputs."""
    if rule.strategy == "HashId":
        return [(radix, True) for _, _, radix in slots(value)]
    pools, counts = _POOLS[rule.options.kind]
    return [(len(pool), bool(counts >> i & 1)) for i, pool in enumerate(pools)]


def template(rule: Rule, value: str) -> str:
    """Equal for identifiers with the same outputs; different ones have none in common."""
    out = list(value)
    for i, base, radix in slots(value):
        out[i] = f"\x01{base}.{radix}\x01"
    return rule.chosen.prefix + "\x02" + "".join(out)


def places(rule: Rule, value: str) -> int | None:
    """The number of outputs there are for a value before numbers, if its strategy has places: None if not, or too many."""
    if rule.strategy != "HashId" and not can_number(rule):
        return None
    size = math.prod(radix for radix, counts in radices(rule, value) if counts)
    return size if size <= MOST_PLACES and (rule.strategy != "HashId" or slots(value)) else None


def name_place(kind: str, text: str) -> int:
    """The place of a name, in any case, among all of its kind; -1 if it is none."""
    text, words = text.lower(), None
    if kind == "Email":
        m = re.fullmatch(r"([a-z]+)\.([a-z]+)(0|[1-9][0-9]?)@(.+)", text)
        words = m and m.groups()
    elif kind in ("PersonFirst", "PersonLast"):
        words = (text,)
    elif kind == "StreetAddress":
        words = text.split(" ")
    elif kind in ("PersonFull", "Company"):
        words = text.split(" ", 1)
    else:
        place, *rest = text.split(" ", 1) if kind == "Hospital" else (text,)
        words = (*_PLACES.get(place, ("", "")), *rest)
    at = [d for i, d in enumerate(_AT[kind]) if _POOLS[kind][1] >> i & 1]
    if not words or len(words) != len(at):
        return -1
    out = 0
    for word, d in zip(words, at, strict=True):
        i = d.get(word)
        if i is None:
            return -1
        out = out * len(d) + i
    return out


def own_place(rule: Rule, value: str) -> int:
    """The place of the value itself among its outputs; -1 if it is none of them."""
    if rule.strategy != "HashId":
        place = name_place(rule.options.kind, value)
        return place if place >= 0 and output_at(rule, value, place) == value else -1
    out = 0
    for i, base, radix in slots(value):
        digit = ord(value[i]) - base
        if rule.chosen.prefix or not 0 <= digit < radix:
            return -1
        out = out * radix + digit
    return out


def _name_at(kind: str, place: int) -> str:
    words = []
    for i, pool in reversed(list(enumerate(_POOLS[kind][0]))):
        if _POOLS[kind][1] >> i & 1:
            place, at = divmod(place, len(pool))
            words.append(str(pool[at]))
    w = words[::-1]
    if kind == "Email":
        return f"{w[0]}.{w[1]}{w[2]}@{w[3]}".lower()
    return w[0] + w[1] + "".join(f" {x}" for x in w[2:]) if kind in ("City", "Hospital") else " ".join(w)


def output_at(rule: Rule, value: str, place: int) -> str:
    """The output at a place, as it is spelled for a value."""
    if rule.strategy != "HashId":
        name = _name_at(rule.options.kind, place)
        return _copy_case(value, name) if rule.chosen.preserve_case else name
    out = list(value)
    for i, base, radix in reversed(slots(value)):
        place, digit = divmod(place, radix)
        out[i] = chr(base + digit)
    return rule.chosen.prefix + "".join(out)


def numbered(kind: str, base: str, n: int) -> str:
    """Entry n, from BEFORE_NUMBERS on, of a list that begins with base."""
    number = str(n - BEFORE_NUMBERS + 2)
    if kind == "Email":
        name, _, host = base.partition("@")
        return f"{name}{number}@{host}"
    return f"{base} {number}"


def bulk_places(rule: Rule, key: bytes, radix: list[tuple[int, bool]], domains: list[str], seeds: list[str], attempts) -> np.ndarray:
    """The places of entries, one for each seed: attempt_of for many values with the same draws, before lists go on by counting."""
    draws = ManyDraws(key, [SEPARATOR.join((d, s, str(a)) if a else (d, s)) for d, s, a in zip(domains, seeds, attempts, strict=True)])
    out = np.zeros(len(seeds), dtype=np.int64)
    for most, counts in radix:
        x = draws.below(most)
        if counts:
            out = out * most + x
    return out
