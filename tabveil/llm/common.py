"""Shared pieces: bounds of batches and broadcasts, byte-level word finding, hashing; lineage cuts come from the engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.operators.tables import Scope, cut, file_system, new_folder, qualified, scope, shared_folder  # noqa: F401

#: Bytes of the Arrow batches handed to Python: a worker holds one of them (or one longer row) at a time.
BATCH_BYTES = 1 << 20


#: Rows up to which a table of ids is broadcast; some tens of MB. Larger ones are shuffled with the texts.
BROADCAST_ROWS = 500_000


def hinted(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """ids (a materialised table of a few numbers a row), to be broadcast if it was counted to be small enough."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores added to those that df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with columns named so (in any case) renamed, and the columns of df as they were, to select in the end."""
    other = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in other]
    renamed = dict(zip(clash, free_names(df, *[f"{c}_set_aside" for c in clash]), strict=True))
    return df.withColumnsRenamed(renamed), [F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns]


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that Python tasks of this session get. All operators set the same bound,
    so it does not matter that a frame runs later than it is built."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those named so; Spark does not tell upper from lower case."""
    left_out = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in left_out]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), applied to every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE_CODE = _byte_codes()
ODD = 0xD6E8FEB86659FD93
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Hashes of the words of one text: maximal runs of bytes that `table` maps to a non-zero byte.

    table: 256 bytes; 0 ends a word, any other value is what the byte counts as (so a table can fold case).
    """

    def __init__(self, table: bytes):
        self.table = table
        self.up, self.down = powers(ODD, 1 << 16), powers(ODD_INVERSE, 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = powers(ODD, n), powers(ODD_INVERSE, n)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word, offsets in bytes."""
        if not data:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none
        b = np.frombuffer(data.translate(self.table), dtype=np.uint8)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = b != 0
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.empty(0, np.uint64), start, end
        self._grow(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[b] * self.up[: len(b)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64)), start, end


def fold_table(is_word) -> bytes:
    """A table for WordHashes: bytes for which is_word holds, A-Z folded to a-z; the rest end a word. NUL inside words
    counts as a byte that folding leaves free."""
    return bytes(0 if not is_word(b) else b + 32 if 65 <= b <= 90 else b or 65 for b in range(256))


#: Words are runs of anything but ASCII white space.
SPACE_WORDS = fold_table(lambda b: b != 32 and not 9 <= b <= 13)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; fewer words, but not none, make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[j : n - k + 1 + j]
    return np.unique(mix64(out + np.uint64(k)))
