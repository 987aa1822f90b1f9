"""Keyed deterministic randomness: HMAC-SHA256 seeds and a xoshiro256** generator.

seeded() and the draws are Column expressions, so one or two draws stay in the JVM; Draws is the same generator for
the few strategies that need many draws for a value.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabveil.functions.binding import Steps, inline, let

#: Between the parts of a seed message; the value of the seed that a whole column shares.
SEPARATOR = "\x1f"
GLOBAL = "\x1eglobal"
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Pads:
    """A key as the two columns that HMAC mixes in."""

    inner: Column
    outer: Column


def pad_bytes(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def digest(key: bytes | Pads, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, joined by the separator, in lower-case hex. A key given as bytes stands in the plan."""
    pads = key if isinstance(key, Pads) else Pads(*map(F.lit, pad_bytes(key)))
    message = F.encode(F.concat_ws(SEPARATOR, *parts), "UTF-8")
    return F.sha2(F.concat(pads.outer, F.unhex(F.sha2(F.concat(pads.inner, message), 256))), 256)


def seed_steps(key: bytes | Pads, *parts: Column) -> Steps:
    """The generator's state, a struct of four words. (A digest of zeros, which has no known message, is not
    special-cased.)"""
    d = yield digest(key, *parts)
    little = lambda k: F.concat(*[F.substring(d, 16 * k + 2 * b + 1, 2) for b in range(7, -1, -1)])
    return (yield F.struct(*[F.conv(little(k), 16, -10).cast("long").alias(f"s{k}") for k in range(4)]))


def seeded(key: bytes | Pads, *parts: Column) -> Column:
    return inline(seed_steps(key, *parts))


def int32(d: Column) -> Column:
    """The first four bytes of a digest, little-endian and signed."""
    word = F.conv(F.concat(*[F.substring(d, 2 * b + 1, 2) for b in range(3, -1, -1)]), 16, 10).cast("long")
    return F.when(word >= 1 << 31, word - (1 << 32)).otherwise(word).cast("int")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^64, by halves, since a product of longs must not overflow."""
    return let(x, lambda x: let(_low(x) * k, lambda low: F.shiftleft(_low(F.shiftrightunsigned(x, 32) * k + F.shiftrightunsigned(low, 32)), 32).bitwiseOR(_low(low))))


def _rotate(x: Column, k: int) -> Column:
    return let(x, lambda x: F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k)))


def draw(state: Column, n: int = 1) -> Column:
    """The n-th output (1 or 2) from a state; bind the state with let if it is used more than once."""
    x = state["s1"] if n == 1 else let(state, lambda s: s["s1"].bitwiseXOR(s["s2"]).bitwiseXOR(s["s0"]))
    return _times(_rotate(_times(x, 5), 7), 9)


def below(u: Column, most: int | Column) -> Column:
    """An integer in [0, most) from an output."""
    return F.shiftrightunsigned(F.shiftrightunsigned(u, 32) * most, 32)


def unit(u: Column) -> Column:
    """A double in [0, 1) from an output."""
    return F.shiftrightunsigned(u, 11).cast("double") * F.lit(1.0 / (1 << 53))


class Draws:
    """The generator in Python, for one seed."""

    def __init__(self, key: bytes, *parts: str):
        raw = hmac.digest(key, SEPARATOR.join(parts).encode("utf-8", "surrogatepass"), "sha256")
        self.s = list(struct.unpack("<4Q", raw))
        if not any(self.s):
            self.s[0] = 1

    def next(self) -> int:
        s0, s1, s2, s3 = self.s
        x = s1 * 5 & MASK
        out = ((x << 7 | x >> 57) & MASK) * 9 & MASK
        s2 ^= s0
        s3 ^= s1
        self.s = [s0 ^ s3, s1 ^ s2, s2 ^ (s1 << 17 & MASK), (s3 << 45 | s3 >> 19) & MASK]
        return out

    def below(self, most: int) -> int:
        return (self.next() >> 32) * most >> 32

    def unit(self) -> float:
        return (self.next() >> 11) * (1.0 / (1 << 53))


class ManyDraws:
    """The generators of many seeds side by side: message i is the parts of seed i, joined by SEPARATOR."""

    def __init__(self, key: bytes, messages: list[str]):
        raw = b"".join([hmac.digest(key, m.encode("utf-8", "surrogatepass"), "sha256") for m in messages])
        self.s = np.frombuffer(raw, dtype="<u8").reshape(-1, 4).T.astype(np.uint64)
        self.s[0, ~self.s.any(axis=0)] = 1

    def below(self, most) -> np.ndarray:
        s0, s1, s2, s3 = self.s
        x = s1 * np.uint64(5)
        out = (x << np.uint64(7) | x >> np.uint64(57)) * np.uint64(9)
        s2, s3 = s2 ^ s0, s3 ^ s1
        self.s = np.stack([s0 ^ s3, s1 ^ s2, s2 ^ (s1 << np.uint64(17)), s3 << np.uint64(45) | s3 >> np.uint64(19)])
        return ((out >> np.uint64(32)) * np.uint64(most) >> np.uint64(32)).astype(np.int64)
