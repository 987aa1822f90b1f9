"""N-gram join, repeat removal, top-k and WARC on small tables, against brute force."""

import gzip
import hashlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.llm import components, ngram_join, repeats, suffix, topk, warc


def brute_classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else d))
    return sorted(out, key=str)


def near_rows(seed, n):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 80))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "Z" + str(rng.randint(0, 9))
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    return rows


def test_classes_against_brute_force(spark, monkeypatch):
    rows = near_rows(5, 120) + [(500, None), (501, ""), (502, "   "), (3, "one word"), (3, "one word"), (None, "one word"), (None, "lone thing here"), (503, "w " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as vertex", "'t' as token")
    for rows_in_block in (2048, 5):  # the second deals blocks and clusters out as pairs of chunks
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows_in_block)
        monkeypatch.setattr(ngram_join, "CLUSTER_ROWS", rows_in_block)
        out = ngram_join.jaccard_classes(df, 4, 85).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute_classes(rows, 4, 85)


def test_nul_is_a_letter(spark):
    texts = ["a\x00b c d e", "a b c d e", "a\x00b  c d e", "\x00", " \x00 ", "A\x00B C D E", "x\x01y c d e"]
    rows = list(enumerate(texts))
    out = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())
    assert got == [(0, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, 3), (4, 1, 3), (5, 1, 0), (6, 1, 6)] == brute_classes(rows, 4, 85)


def test_links_against_brute_force(spark, monkeypatch):
    rows = near_rows(11, 90) + [(500, None), (501, ""), (502, "one word"), (503, "one word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(4, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    near = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    degree = {d: sum(near(x, y) for j, y in enumerate(sets) if i != j) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True))}
    for rows_in_cluster in (1024, 5):
        monkeypatch.setattr(ngram_join, "CLUSTER_ROWS", rows_in_cluster)
        members, links = ngram_join.jaccard_links(df, 4, 85)
        members = members.collect()
        assert {r["doc_id"]: r["n_links"] for r in members} == degree
        of = {r["vertex"]: sets[[d for d, _ in rows].index(r["doc_id"])] for r in members if r["vertex"] is not None}
        want = {(a, b) for a in of for b in of if a < b and near(of[a], of[b])}
        got = [(r["a"], r["b"]) for r in links.collect()]
        assert set(got) == want and len(got) == len(want)


def test_signature_of_a_large_block(spark):
    rows = spark.range(1_200_000).selectExpr("id % 2 as token", "id div 2 as vertex")
    found = ngram_join._signed(rows).collect()
    assert len({(r["members"], r["s1"], r["s2"], r["s3"]) for r in found}) == 1 and found[0]["members"] == 600_000


def test_keep_first(spark):
    rows = near_rows(6, 40) + [(500, None), (501, ""), (3, None)]
    rows += [rows[0], (1000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_first(df, 5, 80)
    assert kept.columns == df.columns
    classes = brute_classes(rows, 5, 80)
    want = sorted([c for c in {(r[2]) for r in classes if r[1]}] + [500, 501, 3])
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert ngram_join.keep_first(df.limit(0)).count() == 0


def test_count_tree_finds_all_that_may_link():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 5, size=(300, 64)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, size=(100, 64)) * (rng.random((100, 64)) < 0.1), 0)
    sizes = points.sum(axis=1)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    tree = ngram_join.CountTree(points, sizes)
    for q in range(0, 300, 7):
        bound = np.minimum(points, points[q]).sum(axis=1)
        ok = (bound >= ngram_join.needed(sizes[q], sizes, 85)) & (100 * sizes >= 85 * sizes[q]) & (85 * sizes <= 100 * sizes[q])
        assert set(np.flatnonzero(ok)) <= set(tree.within(points[q], int(sizes[q]), 85))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(45, 90)] + [(7, 7), (300, 301), (301, 300), (301, 302)]
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["vertex"]: r["root"] for r in out}
    assert len(got) == len(out)
    assert got == {**{i: 1 for i in range(1, 41)}, **{50 + i: 95 for i in range(45, 90)}, 300: 300, 301: 300, 302: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(7)
    for _ in range(600):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 50))] + [0]
        t = np.array(s)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix.suffix_array(t)
        assert sa.tolist() == want
        shared = suffix.permuted_lcp(t, sa, 9)
        for a, b in zip(want, want[1:], strict=False):
            n = next(k for k in range(len(s) + 1) if s[a + k : a + k + 1] != s[b + k : b + k + 1])
            assert shared[b] == min(n, 9)


def brute_repeats(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((rows[i][0], len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(shared), " ".join(word() for _ in range(30)), rng.choice(shared)[: rng.randint(50, 200)], "ab" * rng.randint(1, 90), "z" * rng.randint(1, 150)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("size", [3000, 400])  # with 400, most names are dealt to several shards
def test_repeats_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "SHARD_BYTES", size)
    monkeypatch.setattr(repeats, "PIECE", 2 * size)
    rows = passages(8, 60) + [(100, None), (101, ""), (102, "k" * 99), (103, "k" * 100), (104, "k" * 5000)]
    rows += [(105, rows[7][1] + "x"), (106, rows[7][1]), (107, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as name")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).select(cols).collect()), key=str) == brute_repeats(rows)


def test_repeats_with_repeated_ids(spark):
    rows = passages(9, 12) + [(3, "a b " * 60), (3, "a c " * 70), (None, "a b " * 60), (3, "a b " * 60), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).select(cols).collect()), key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def brute_top(rows, asks, k):
    ok = [(i, np.floor(64 * np.array(v, dtype=float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    ok = sorted({(i, tuple(np.pad(v, (0, width - len(v))))) for i, v in ok})
    out = []
    for q, x in ok:
        if asks(q):
            s = sorted((-int(np.dot(x, y)), i) for i, y in ok if i != q)[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("rows_in_cell,rings", [(20, 256), (5, 1)])  # the second takes cells in chunks
def test_top_k_against_brute_force(spark, monkeypatch, rows_in_cell, rings):
    monkeypatch.setattr(topk, "CELL_ROWS", rows_in_cell)
    monkeypatch.setattr(topk, "MOST_RINGS", rings)
    monkeypatch.setattr(topk, "ANNULUS_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 5)]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [1.0, None, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0]), (305, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as point", "2 as score")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert sorted(tuple(r) for r in out.collect()) == brute_top(single, lambda q: q % 20 == 0, 5)
    assert sorted(tuple(r) for r in topk.top_k(df.limit(3), F.col("vec_id") == 0, k=5).collect()) == brute_top(single[:3], lambda q: q == 0, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(9)
    long = ["é" * 600, "<p>" + "x" * 2000, "q" * 999]
    rows = [(i, f"http://h/{i} b", rng.choice([*long, f"page {i}", "r" * rng.randint(900, 1100)])) for i in range(80)] + [(100, None, None), (101, "u", ""), (None, "u", long[0]), (5, "again", "p" * 1500), (5, "again", "p" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as shard")
    seen = []
    for _ in range(2):
        folder = tempfile.mkdtemp(prefix="spark-") + "/out"
        manifest = warc.write_warc(df.repartition(7), folder, shard_bytes=20_000, roll_bytes=1500)
        files = {r["name"]: r for r in manifest.collect()}
        assert len(files) > 4 and sum(r["records"] for r in files.values()) == len(rows)
        for name, r in files.items():
            data = open(f"{folder}/{name}", "rb").read()
            assert len(data) == r["bytes"] and hashlib.sha1(data).hexdigest() == r["sha1"]
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        seen.append({n: r["sha1"] for n, r in files.items()})
    assert seen[0] == seen[1]  # the same bytes, however Spark held the rows
    out = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder).collect()]
    top = {}
    for p, _, h in rows:
        if len(raw := (h or "").encode()) >= 1000 and p is not None:
            top[raw] = max(top.get(raw, -1), p)
    want, first = [], set()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = raw in top and (p != top[raw] or (p, raw) in first)
        first.add((p, raw))
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[raw] if again else None))
    assert sorted(out, key=str) == sorted(want, key=str)


def test_warc_of_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0


def test_query_blocks_hold_neighbouring_cells():
    first, many = topk.blocks_of(np.array([1, 1, 5, 0, 2, 9, 1, 0]), 4)
    assert first.tolist() == [0, 0, 1, 3, 3, 4, 7, 7] and many.tolist() == [1, 1, 2, 1, 1, 3, 1, 1]
