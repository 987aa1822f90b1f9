"""A masking key that stands in no plan.

What tasks need of the key comes to expressions as scalar subqueries over tables of one row, whose plans name columns
and no values; so explain, the event log and error messages have nothing of it. Python tasks get it with their function.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, SparkSession

from tabveil.functions.seeds import Pads, pad_bytes


class SessionClosed(RuntimeError):
    def __init__(self):
        super().__init__("the masking session is closed; its key and its mappings are gone")


class Secret:
    """32 bytes, fresh if none are given, until wipe()."""

    def __init__(self, spark: SparkSession, key: bytes | None = None):
        self._spark, self._key = spark, bytearray(key or secrets.token_bytes(32))
        self._pads: Pads | None = None

    def __repr__(self) -> str:
        return "Secret(...)"

    def key(self) -> bytes:
        if not self._key:
            raise SessionClosed
        return bytes(self._key)

    def hidden(self, value, kind: str) -> Column:
        """value as an expression that does not show it."""
        return self._spark.createDataFrame([(value,)], f"hidden {kind}").scalar()

    def pads(self) -> Pads:
        key = self.key()
        if self._pads is None:
            self._pads = Pads(*[self.hidden(p, "binary") for p in pad_bytes(key)])
        return self._pads

    def wipe(self) -> None:
        for i in range(len(self._key)):
            self._key[i] = 0
        self._key.clear()
        self._pads = None
