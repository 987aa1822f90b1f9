"""Short labels for people: sizes, delimiters, shares and cut-off values."""

from __future__ import annotations

import math

# Fixed values.
DELIMITER_NAMES = {",": "comma", "\t": "tab", ";": "semicolon", "|": "pipe"}
SIZES = ("bytes", "KB", "MB", "GB", "TB")
CUT, MOST_SHOWN = "…", 60


def _short(x: float, unit: str) -> str:
    """At most one decimal."""
    tenths = round(10 * x)
    return f"{tenths // 10}{unit}" if tenths % 10 == 0 else f"{tenths / 10}{unit}"


def size(n: int) -> str:
    power = min(len(SIZES) - 1, int(math.log2(n)) // 10) if n else 0
    return _short(n / (1 << (10 * power)), f" {SIZES[power]}")


def percent(share: float) -> str:
    return _short(100 * share, "%")


def delimiter(d: str) -> str:
    return DELIMITER_NAMES[d] if d in DELIMITER_NAMES else repr(d)


def shortened(value: str, most: int = MOST_SHOWN) -> str:
    return value if len(value[: most + 1]) <= most else value[: most - len(CUT)] + CUT
