"""Byte-level BPE against the tokenizer library on whole texts, and exact round trips."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabveil.llm import bpe, queries
from tabveil.llm.common import read_table

RANKS = bpe.load_ranks(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.001"
NEW_LETTERS = "".join(map(chr, (0x558, 0xC5C, 0x11DE0, 0x1246F, 0x10A0, 0x3042)))
TEXTS = [
    None, "", "hello world", "a" * 300, "it's we'll they're  x\n\n\n y'l l'" * 30, "日本語テキスト" * 40, " " * 200 + "x", "   x" * 50, "😀é" * 60,
    "1234567890 " * 40, "'" * 100 + "ll", "\x00\x1c\x1d\x85\xa0 a" * 40, "a'll" * 50, NEW_LETTERS * 20 + " b" * 50, "don't'll've" * 40, "<|endoftext|>" * 20,
]


def whole(text):
    return bpe.encoder(RANKS).encode_ordinary(text or "")


@pytest.mark.parametrize(("size", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (32, 8), (16, 4), (7, 5)])
def test_chunks_meet_wherever_they_are_cut(spark, size, overlap):
    rows = [(i % 4 if i % 5 else None, t, i) for i, t in enumerate(TEXTS + TEXTS[:5])]
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, IDS int").withColumnRenamed("doc_id", "bpe_row"), RANKS, size, overlap), RANKS)
    assert out.columns == ["bpe_row", "text", "ids", "decoded"]
    got = sorted((r["bpe_row"] is None, r["bpe_row"] or 0, r["text"] or "", r["text"] is None, r["ids"], bytes(r["decoded"])) for r in out.collect())
    assert got == sorted((d is None, d or 0, t or "", t is None, whole(t), (t or "").encode()) for d, t, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs, RANKS), RANKS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("a'l 1\n!\t漢é sr" + NEW_LETTERS[:2]), max_size=60), st.integers(4, 20), st.integers(1, 4))
def test_common_boundaries_are_boundaries(text, size, overlap):
    """What stitching rests on: a boundary that two chunks share, and that neither end decides, is one of the whole text."""
    true = {0, *bpe.splitter()(text).tolist()}
    ends = lambda a, b: {a, *[a + int(e) for e in bpe.splitter()(text[a:b])]}
    known = ends(0, size + overlap)
    for a in range(size, len(text), size):
        mine = ends(a, a + size + overlap)
        shared = {p for p in known & mine if a <= p <= a + overlap and p + bpe.AHEAD <= a + overlap}
        if not shared:
            break
        cut = min(shared)
        assert cut in true
        known = {p for p in mine if p >= cut}


def test_pieces_of_whole_pretokens_encode_alone():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b ", "  ", "'ll", "'", "9", "\n", "é", "漢", "!?"]) for _ in range(40))
        at = [0, *bpe.splitter()(text).tolist()]
        i, j = sorted(rng.sample(range(len(at)), 2))
        assert whole(text[: at[i]]) + whole(text[at[i] : at[j]]) + whole(text[at[j] :]) == whole(text)


def test_splits_encode_one_by_one_over_random_characters():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["x", " ", "7", "-", NEW_LETTERS[0], NEW_LETTERS[2], chr(rng.randrange(0x80, 0xD000)), chr(rng.randrange(0x10000, 0x20000))]) for _ in range(30))
        ends = [0, *bpe.splitter()(text).tolist()]
        assert ends[-1] == len(text)
        assert sum((whole(text[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), []) == whole(text)


def test_decode_of_null_and_foreign_ids(spark):
    rows = [([0, 1, 2],), ([],), (None,), ([50255] * 3,)]
    got = [None if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(spark.createDataFrame(rows, "ids array<int>"), RANKS).collect()]
    enc = bpe.encoder(RANKS)
    assert got == [enc.decode_bytes([0, 1, 2]), b"", None, enc.decode_bytes([50255] * 3)]


def test_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, DATA, "documents").collect()}
    out = queries.op12_bpe(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        ids, raw = whole(texts[r["doc_id"]]), texts[r["doc_id"]].encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
