"""Byte-level BPE: encoding by overlapping chunks, and decoding.

A text of at most CHUNK characters is one chunk and is encoded where it lies. A longer one is cut into chunks that
overlap; the chunks are dealt over the cluster and split into pre-tokens, each from its own start, whatever stands
there. The pattern looks only forwards, so two chunks that have one boundary in common agree from there on: the first
common boundary of an overlap is where their texts are cut (stitched). The pieces between cuts hold whole pre-tokens
and are encoded in parallel. A text with an overlap without a common boundary (a pre-token longer than the overlap) is
taken again with chunks and overlaps GROWTH times as long, until a chunk holds it whole.

Merges are the tokenizer library's. Its pattern engine decides which characters are letters and digits, by its own
edition of Unicode, so characters are classified by asking it, and the pattern is then matched over the classes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import Scope, cut, free_names, hinted, small_batches, without

#: The pattern that splits a text before merges: fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over classes, see Splitter.
CLASS_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Characters of a chunk and of an overlap.
CHUNK = 1 << 14
OVERLAP = 1 << 9
GROWTH = 8
#: How far beyond its end the pattern looks to end a pre-token (`'ll` looks two characters on).
AHEAD = 3
UNKNOWN = 255


def load_ranks(path: str) -> bytes:
    """The rank file as it is; some hundred kB, broadcast with the functions."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}


@lru_cache(maxsize=4)
def encoder(ranks: bytes):
    """The tokenizer of a rank file, once a worker."""
    return _encoding(_parsed(ranks))


@lru_cache(maxsize=4)
def _token_table(ranks: bytes) -> pa.BinaryArray:
    parsed = _parsed(ranks)
    table = [b""] * (max(parsed.values(), default=-1) + 1)
    for token, rank in parsed.items():
        table[rank] = token
    return pa.array(table, pa.binary())


class Splitter:
    """Boundaries of pre-tokens. A character is put in class by the pattern engine itself, when first met: of the
    characters' bytes and one letter (digit, sign) before them, all beginnings are made tokens, so that one token
    comes out where the engine takes the two for one pre-token."""

    def __init__(self):
        self.table = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.table[:128] = np.arange(128)

    def _learn(self, codes: np.ndarray) -> None:
        chars = [chr(c) for c in codes]
        self.table[codes] = ord("\t")
        for before, as_ in (("a", "z"), ("1", "0"), ("!", "#")):
            ranks = {bytes([b]): b for b in range(256)}
            for c in chars:
                whole = (before + c).encode()
                for n in range(2, len(whole) + 1):
                    ranks.setdefault(whole[:n], len(ranks))
            probe = _encoding(ranks)
            joined = [len(probe.encode_ordinary(before + c)) == 1 for c in chars]
            self.table[codes[joined]] = ord(as_)

    def __call__(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of text, in characters."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        classes = self.table[codes]
        if len(new := np.unique(codes[classes == UNKNOWN])):
            self._learn(new)
            classes = self.table[codes]
        return np.fromiter((m.end() for m in CLASS_PATTERN.finditer(classes.tobytes())), dtype=np.int64)


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    return Splitter()


def encode_texts(ranks: bytes):
    """An Arrow function: the ids of each text; none for null."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        enc = encoder(ranks)
        return pa.array([enc.encode_ordinary(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode.asNondeterministic()  # so that Spark doesn't run it once for each use of its result


def decode_ids(ranks: bytes):
    """An Arrow function: the bytes of all ids of a row, end to end; null for null. Ids that the vocabulary lacks fail."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        flat = _token_table(ranks).take(ids.flatten())
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        lengths = np.array([0 if n is None else n for n in pc.list_value_length(ids).to_pylist()], dtype=np.int64)
        at = ends[np.concatenate([[0], np.cumsum(lengths)])]
        data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
        whole = memoryview(data if data is not None else b"")
        return pa.array([bytes(whole[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)], pa.binary())

    return decode


def _chunks(size: int, overlap: int):
    """Rows (row, i, n, at, text): chunk i of n, which starts at character `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = max(1, -(-len(text) // size))
                for i in range(n):
                    piece = text[i * size : (i + 1) * size + overlap] if i < n - 1 else text[i * size :]
                    yield pa.RecordBatch.from_pydict({"row": [row], "i": [i], "n": [n], "at": [i * size], "text": [piece]}, schema=CHUNKS)

    return run


CHUNKS = pa.schema([("row", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("text", pa.string())])


def _boundaries(size: int, overlap: int):
    """An Arrow function: the boundaries of a chunk in the overlap at its start and in the one at its end, from the
    start of the text. Only boundaries that do not depend on what comes after the chunk count."""

    @F.arrow_udf("struct<head: array<bigint>, tail: array<bigint>>")
    def split(at: pa.Array, i: pa.Array, n: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for start, k, count, t in zip(at.to_pylist(), i.to_pylist(), n.to_pylist(), text.to_pylist(), strict=True):
            ends = np.concatenate([[0], splitter()(t)])
            if k < count - 1:
                ends = ends[ends + AHEAD <= len(t)]
            out.append({"head": (ends[ends <= overlap] + start).tolist(), "tail": (ends[ends >= size] + start).tolist()})
        return pa.array(out, pa.struct([("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]))

    return split


def _pieces(long: DataFrame, ranks: bytes, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Of long (row, text): (row, i, ids) of the pieces of the texts whose chunks all meet, and the rows whose don't."""
    chunks = long.mapInArrow(_chunks(size, overlap), "row long, i long, n long, at long, text string")
    chunks = cut(chunks.repartition("row", "i"), "bpe-chunks")
    ends = cut(chunks.select("row", "i", "n", _boundaries(size, overlap)("at", "i", "n", "text").alias("b")), "bpe-bounds")
    left = ends.filter("i < n - 1").select("row", (F.col("i") + 1).alias("i"), F.col("b.tail").alias("tail"))
    met = ends.filter("i > 0").select("row", "i", F.col("b.head").alias("head")).join(left, ["row", "i"])
    cuts = cut(met.select("row", "i", F.array_min(F.array_intersect("head", "tail")).alias("cut")), "bpe-cuts")
    open_ = cut(cuts.filter("cut is null").select("row").distinct(), "bpe-open")
    start = cuts.select("row", "i", F.col("cut").alias("from"))
    end = cuts.select("row", (F.col("i") - 1).alias("i"), F.col("cut").alias("to"))
    spans = ends.select("row", "i").join(open_, "row", "left_anti").join(start, ["row", "i"], "left").join(end, ["row", "i"], "left")
    # Numbers go to the texts, which stay where they lie, as long as these numbers are few.
    placed = chunks.join(hinted(cut(spans, "bpe-spans")), ["row", "i"])
    first = F.coalesce(F.col("from"), F.col("at")) - F.col("at")
    length = F.coalesce(F.col("to"), F.col("at") + F.char_length("text")) - F.col("at") - first
    piece = F.substring("text", (first + 1).cast("int"), length.cast("int"))
    return placed.select("row", "i", encode_texts(ranks)(piece).alias("ids")), open_


def encode_long(long: DataFrame, ranks: bytes, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, ids) of long (row: a unique number, text: not null)."""
    whole = long.agg(F.max(F.char_length("text"))).first()[0] or 0
    done = None
    while True:
        own = Scope(long.sparkSession, "bpe-round")
        with own.active():
            pieces, open_ = _pieces(long, ranks, size, overlap)
        pieces, open_ = cut(pieces, "bpe-pieces"), cut(open_, "bpe-open")
        own.close()  # the chunks go before the pieces are put together
        done = pieces if done is None else done.unionByName(pieces)
        if size >= whole or open_.isEmpty():
            break
        long = long.join(open_, "row")
        size, overlap = size * GROWTH, overlap * GROWTH
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda p: p["ids"])
    return done.groupBy("row").agg(F.flatten(ordered).alias("ids"))


def encode(docs: DataFrame, ranks: bytes, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (with a column text) and ids, the array of the text's token ids, without special tokens.

    A null or empty text has no ids. Rows are taken one by one, so repeated ones have the same ids; an empty table
    gives an empty result. A column named ids, in any case, is replaced; all others stay as they are. Texts of any
    length are encoded whole; a pre-token is never split.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in without(docs, "ids")])
    is_long = F.coalesce(F.char_length("text") > size, F.lit(False))
    short = kept.filter(~is_long).withColumn("ids", encode_texts(ranks)("text"))
    if (found := kept.filter(is_long)).isEmpty():
        return short
    row, other = free_names(kept, "bpe_row", "bpe_id")
    # Written once, so that the numbers stay the same.
    found = cut(found.withColumn(row, F.monotonically_increasing_id()), "bpe-long")
    ids = cut(encode_long(found.select(F.col(f"`{row}`").alias("row"), F.col("text")), ranks, size, overlap), "bpe-ids")
    long = found.join(ids.withColumnRenamed("row", other), F.col(row) == F.col(other)).select(*kept.columns, "ids")
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """encoded (with a column ids) and decoded, the bytes of its tokens end to end; null where ids is null. The bytes
    need not be UTF-8 if the ids were not made by encode. A column named decoded, in any case, is replaced."""
    kept = encoded.select(*[F.col(f"`{c}`") for c in without(encoded, "decoded")])
    return kept.withColumn("decoded", decode_ids(ranks)("ids"))


def digests(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows."""
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
