"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

The alphabet is words: every word that occurs in a test item gets a letter, all other words share one. A pattern
is 13 consecutive words of an item (a shorter item is one pattern), so the automaton has at most 13 states per
pattern, and a text is one string of letters whose positions are word numbers. Word edges, found on the
normalised bytes, map the hits back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.llm.common import cut, small_batches, without

WINDOW = 13
#: Test text that one automaton takes, in bytes. A larger benchmark is taken in chunks, each collected, broadcast and
#: scanned for before the next, so driver and tasks hold one at a time, whatever the size of the benchmark.
AUTOMATON_BYTES = 4 << 20
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Automaton:
    """patterns -> items. Built once per Python worker from the (bounded) items that it is made of."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.letter: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            letters = "".join(self.letter.setdefault(w, chr(0x10000 + len(self.letter))) for w in words_of(text))
            n = min(window, len(letters))
            for i in range(len(letters) - n + 1 if n else 0):
                owners.setdefault(letters[i : i + n], set()).add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, of in owners.items():
            self.machine.add_word(pattern, (len(pattern), tuple(of)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of word numbers that patterns cover, in order of their ends, and the items hit."""
        if self.empty or not words:
            return [], set()
        get, found, items = self.letter.get, [], set()
        for end, (n, of) in self.machine.iter("".join([get(w, "\x00") for w in words])):
            found.append((end - n + 1, end + 1))
            items.update(of)
        return found, items


_BUILT: dict[bytes, Automaton] = {}


def _automaton(items: list[tuple[str, str]], window: int) -> Automaton:
    key = hashlib.sha1(repr((items, window)).encode("utf-8", "surrogatepass")).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in text of ranges of word numbers."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8)
    edge = np.diff(np.concatenate(([0], (b != 32).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(point[start[a]]), int(point[end[b - 1]])) for a, b in ranges]


def _chunks(benchmark: DataFrame, window: int) -> list[DataFrame]:
    """The items by chunks of about AUTOMATON_BYTES, in order of a hash. A long item is first taken apart into pieces
    of at most PIECE_WORDS words that overlap by a window, so that no item exceeds a chunk."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("item is not null")
    total, longest = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (longest or 0) > AUTOMATON_BYTES // 4:
        items = cut(items.mapInArrow(_pieces(window), "item string, text string"), "decon-pieces")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = -(-(total or 0) // AUTOMATON_BYTES)
    if n <= 1:
        return [items]
    # Twice as many hash classes as needed, so that a chunk stays near the bound.
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(2 * n)) == k) for k in range(2 * n)]


#: Words of a piece of a long item.
PIECE_WORDS = 20_000


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for a in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = b" ".join(words[a : a + PIECE_WORDS + window - 1]).decode("utf-8", "surrogatepass") if len(words) > PIECE_WORDS else text
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([piece], pa.string())], names=["item", "text"])

    return run


#: The columns that find_contamination and contaminated add or use.
ADDED = ("decon_words", "decon_hits", "decon_items", "decon_spans", "decon_text", "decon_hit", "contaminated")
#: What the scan adds to each row.
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])
_FOUND_ARROW = [("n_words", pa.int64()), ("hit_words", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))]


def _scan(chunk, window: int, first: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(chunk.value, window)
        for batch in batches:
            n_words, hits, items, spans = [], [], [], []
            before = [None] * len(batch) if first else list(zip(batch.column("decon_hits").to_pylist(), batch.column("decon_items").to_pylist(), strict=True))
            for text, old in zip(batch.column("decon_text").to_pylist(), before, strict=True):
                words = words_of(text)
                found, of = machine.scan(words)
                if old:
                    found, of = found + [tuple(x) for x in old[0]], of | set(old[1])
                ranges = merged(found)
                n_words.append(len(words))
                hits.append([list(x) for x in ranges])
                items.append(sorted(of))
                spans.append([list(x) for x in word_offsets(text, ranges)] if ranges else [])
            old_names = ["decon_words", "decon_hits", "decon_items", "decon_spans"]
            names = [c for c in batch.schema.names if c not in old_names and (keep_text or c != "decon_text")]
            cols = [batch.column(c) for c in names] + [pa.array(v, kind) for v, (_, kind) in zip((n_words, hits, items, spans), _FOUND_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names + old_names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row and column of docs (needs text), and the columns decon_words (count), decon_hits (ranges of word
    numbers covered by a test window), decon_items (ids of the items with an occurring window, sorted as strings)
    and decon_spans (code-point offsets of the covered ranges, end exclusive).

    Null and word-less texts have no words and no hits. Items with null text or without words have no windows;
    items with a null id are left out. Repeated items count once; repeated rows are judged row by row. Columns of
    docs named like those added are replaced. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["decon_words", "decon_hits", "decon_items", "decon_spans", "decon_text"]
    base = docs.select(*without(docs, *added))
    out = base.withColumn("decon_text", F.coalesce(F.col("text"), F.lit("")))
    kept = base.schema.fields
    found = [T.StructField("decon_" + n, f.dataType) for n, f in zip(("words", "hits", "items", "spans"), FOUND.fields, strict=True)]
    chunks = _chunks(benchmark, window)
    for k, chunk in enumerate(chunks):
        last = k == len(chunks) - 1
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in chunk.collect()])  # about AUTOMATON_BYTES
        fields = [*kept, *([] if last else [T.StructField("decon_text", T.StringType())]), *found]
        out = out.mapInArrow(_scan(shared, window, k == 0, not last), T.StructType(fields))
        if not last:
            out = cut(out, "decon-scan")
            shared.unpersist()
    return out


def contaminated(found: DataFrame) -> DataFrame:
    """Adds decon_hit (words in test windows) and contaminated: at least a twentieth of the words lie in test windows.
    Columns of that name are replaced; rows without words or hits are not contaminated."""
    n_hit = F.aggregate("decon_hits", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    rows = found.select(*without(found, "decon_hit", "contaminated")).withColumn("decon_hit", n_hit)
    return rows.withColumn("contaminated", (F.col("decon_hit") > 0) & (20 * F.col("decon_hit") >= F.col("decon_words")))
