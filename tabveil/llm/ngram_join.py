"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of hashes of its k-word shingles. Its point counts the shingles that fall into each of
64 hash groups (large sets: 256 or 1024, which fold to 64); the sum of the coordinate-wise minima of two points is at least the sets' intersection, and
the same holds for a tree node's largest coordinates, so an R-tree over points finds all pairs that may link.

1. Texts with equal sets become one vertex. A fixed-size table of document frequencies (2^20 hash slots) is
   added up over all documents; it orders shingles, rare first.
2. The rarest shingles of a set (its prefix, about 1 - t of it) are its blocks: two linked sets share one.
   Blocks with the same members count once. In each block an R-tree yields pairs within the bound, of which a
   spanning forest is kept: at most one edge a member, however large the block.
3. Components of these edges are clusters; every link lies within one. Sets travel to their cluster, where
   the R-tree's pairs, except those already connected, are verified by exact intersection. Again a spanning
   forest goes on, and its components are the classes.

Blocks and clusters over a bound are dealt out as pairs of chunks of bounded size, so no task holds a group of
unbounded size, and no pair of chunks is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import SPACE_WORDS, WordHashes, cut, free_names, hinted, mix64, shingles, small_batches
from tabveil.llm.components import components

GROUPS = 64
SLOTS = 1 << 20
SLOT_BLOCKS = 64
BITS = 1 << 24
BLOCK_ROWS = 2048
CLUSTER_ROWS = 1024
CLUSTER_SHINGLES = 2 << 20
#: Vertices that a task remembers having emitted, so copies of one text do not repeat its rows.
REMEMBERED = 100_000


def vertex_of(tokens: np.ndarray) -> int:
    """64 bits of a digest of the set; two different sets meet with a chance of 2^-64."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def groups_of(n: int) -> int:
    """The spread of random counts falls below the difference that links allow only if groups grow with the set."""
    return GROUPS if n < 256 else 4 * GROUPS if n < 2048 else 16 * GROUPS


def point_of(tokens: np.ndarray) -> np.ndarray:
    g = groups_of(len(tokens))
    return np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point over fewer groups: group i is the sum of the groups that are i modulo their number."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0)


def packed(point: np.ndarray, n: int) -> bytes:
    return point.astype(np.uint16 if n < 1 << 16 else np.uint32).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint16 if n < 1 << 16 else np.uint32).astype(np.int32)


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    g = min(len(x), len(y))
    return int(np.minimum(folded(x, g), folded(y, g)).sum()) >= needed(n, m, percent)


def needed(n, m, percent: int):
    """The smallest intersection with which sets of n and m shingles link: ceil(p (n + m) / (100 + p))."""
    return -((-percent * (n + m)) // (100 + percent))


class CountTree:
    """A packed R-tree over count vectors. Rows are packed in the order of size; nodes keep coordinate maxima."""

    LEAF = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n = points, sizes, sizes
        while len(high) > self.LEAF:
            cuts = np.arange(0, len(high), self.LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_n, cuts), np.maximum.reduceat(high_n, cuts)
            self.levels.append((high, low_n, high_n))

    def within(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Rows whose bound allows a link with a set of n shingles at this point."""
        rows = None
        for high, low_n, high_n in [*reversed(self.levels), (self.points, self.sizes, self.sizes)]:
            if rows is None:
                rows = np.arange(len(high))
            else:
                rows = (rows[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
                rows = rows[rows < len(high)]
            rows = rows[(100 * low_n[rows] <= (10_000 * n) // percent) & (100 * high_n[rows] >= percent * n)]
            rows = rows[np.minimum(high[rows], point).sum(axis=1) >= needed(n, low_n[rows], percent)]
        return rows


class Roots:
    """Components of rows 0..n-1, as labels that a smaller component takes over from a larger one."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> None:
        x, y = int(self.of[a]), int(self.of[b])
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.of[self.members[y]] = x
        self.members[x] += self.members.pop(y)


def forest(points: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, percent: int, verify) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs within the bound for which verify(a, b) holds.

    side: if given, only pairs of rows on different sides count.
    """
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    side = None if side is None else side[order]
    tree, roots, edges = CountTree(points, sizes), Roots(len(sizes)), []
    for q in range(len(sizes) - 1, 0, -1):
        rows = tree.within(points[q], int(sizes[q]), percent)
        rows = rows[rows < q]
        if side is not None:
            rows = rows[side[rows] != side[q]]
        # Larger neighbours first: they are nearest in size.
        for r in rows[::-1].tolist():
            if roots.of[r] != roots.of[q] and verify(int(order[r]), int(order[q])):
                roots.join(r, q)
                edges.append((int(order[r]), int(order[q])))
    return edges


def all_links(points: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, percent: int, verify) -> Iterator[tuple[int, int]]:
    """All pairs within the bound for which verify(a, b) holds."""
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    side = None if side is None else side[order]
    tree = CountTree(points, sizes)
    for q in range(len(sizes) - 1, 0, -1):
        rows = tree.within(points[q], int(sizes[q]), percent)
        rows = rows[(rows < q) if side is None else (rows < q) & (side[rows] != side[q])]
        yield from ((int(order[r]), int(order[q])) for r in rows.tolist() if verify(int(order[r]), int(order[q])))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(batch.column("text").to_pylist()):
        yield i, (text or "").encode("utf-8", "surrogatepass")


def _profile(k: int):
    """A row per document (id, size, vertex, point), and at a task's end its document frequencies by slot blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(SPACE_WORDS), np.zeros(SLOTS, dtype=np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("vertex", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        any_rows = False
        for batch in batches:
            n, vertex = [], []
            for _, raw in _texts(batch):
                tokens = shingles(hashes(raw)[0], k)
                any_rows = True
                n.append(len(tokens))
                vertex.append(vertex_of(tokens) if len(tokens) else None)
                np.add.at(seen, slot_of(tokens), 1)
            none = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(vertex, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if any_rows:
            part = SLOTS // SLOT_BLOCKS
            for b in range(SLOT_BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([b], pa.int32()), pa.array([zlib.compress(seen[b * part : (b + 1) * part].tobytes(), 1)])], schema=schema)

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLOTS // SLOT_BLOCKS, dtype=np.uint32)
    for blob in pdf["counts"]:
        part = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
        total += np.minimum(part, np.iinfo(np.uint32).max - total)  # a full slot stays full
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})


def _prefixes(k: int, percent: int, frequencies):
    """A row (token, vertex) per prefix shingle, and a row with token null and the point per vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(SPACE_WORDS), set()
        often = np.frombuffer(zlib.decompress(frequencies.value), dtype=np.uint32)
        for batch in batches:
            tokens_out, vertex_out, points, sizes, point_vertex = [], [], [], [], []
            for _, raw in _texts(batch):
                tokens = shingles(hashes(raw)[0], k)
                n = len(tokens)
                if not n or (v := vertex_of(tokens)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(v)
                p = n - (percent * n + 99) // 100 + 1
                if p < n:
                    tokens_first = tokens[np.lexsort((tokens, often[slot_of(tokens)]))[:p]]
                else:
                    tokens_first = tokens
                tokens_out.append(tokens_first.view(np.int64))
                vertex_out.append(np.full(len(tokens_first), v, dtype=np.int64))
                point_vertex.append(v)
                points.append(packed(point_of(tokens), n))
                sizes.append(n)
            if not tokens_out:
                continue
            t, v = np.concatenate(tokens_out), np.concatenate(vertex_out)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(t), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(v), pa.array(point_vertex, pa.int64())]), pa.concat_arrays([pa.nulls(len(t), pa.int64()), pa.array(sizes, pa.int64())]), pa.concat_arrays([pa.nulls(len(t), pa.binary()), pa.array(points, pa.binary())])],
                names=["token", "vertex", "n", "point"],
            )

    return run


def dealt_in_chunks(rows: DataFrame, key: str, chunks: str) -> DataFrame:
    """Adds left and right: a group of c chunks becomes c (c + 1) / 2 pairs of chunks; rows go to the c pairs of
    their chunk (by hash of the vertex). chunk is the row's own."""
    own = F.pmod(F.xxhash64("vertex"), F.col(chunks)).cast("int")
    dealt = rows.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(chunks) - 1).cast("int"))))
    return dealt.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other")).drop("other", chunks)


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted parts; a group may span parts."""
    rest = None
    for part in parts:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        k = part[keys].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield part.iloc[a:b]
        rest = part.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _signed(rows: DataFrame) -> DataFrame:
    """Of each token: its members, and a signature of their set (two XORs of hashes, which no number of members
    overflows, and the least vertex). rows has no row twice and is partitioned by token, so nothing is shuffled."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("vertex")).alias("s1"), F.bit_xor(F.xxhash64("vertex", F.lit(1))).alias("s2"), F.min("vertex").alias("s3"))


def _edges_frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _block_edges(percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for g in _groups(parts, ["token", "left", "right"]):
            if len(g) < 2:
                continue
            vertex, n = g["vertex"].to_numpy(), g["n"].to_numpy()
            points = [unpacked(x, m) for x, m in zip(g["point"], n.tolist(), strict=True)]
            near = lambda a, b, points=points, n=n: may_link(points[a], points[b], int(n[a]), int(n[b]), percent)
            if len(g) == 2:
                pairs = [(0, 1)] if near(0, 1) else []
            else:
                side = None if g["left"].iloc[0] == g["right"].iloc[0] else g["chunk"].to_numpy()
                pairs = forest(np.stack([folded(x, GROUPS) for x in points]), n, side, percent, near)
            out += [(int(vertex[a]), int(vertex[b])) for a, b in pairs]
            if len(out) > 100_000:
                yield _edges_frame(out)
                out = []
        yield _edges_frame(out)

    return run


def _bits(pdf: pd.DataFrame) -> pd.DataFrame:
    mine = np.zeros(BITS // SLOT_BLOCKS, dtype=bool)
    mine[pdf["bit"].to_numpy() % len(mine)] = True
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [np.packbits(mine).tobytes()]})


def _bit(vertex: np.ndarray) -> np.ndarray:
    return (mix64(vertex.view(np.uint64)) >> np.uint64(40)).astype(np.int64) & (BITS - 1)


def _sets(k: int, wanted):
    """(vertex, tokens) of the documents whose vertex may be in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(SPACE_WORDS), set()
        bits = np.unpackbits(np.frombuffer(zlib.decompress(wanted.value), dtype=np.uint8)).view(bool)
        for batch in batches:
            vertex, tokens_out = [], []
            for _, raw in _texts(batch):
                tokens = shingles(hashes(raw)[0], k)
                if not len(tokens) or (v := vertex_of(tokens)) in seen or not bits[_bit(np.array([v], dtype=np.int64))[0]]:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(v)
                vertex.append(v)
                tokens_out.append(tokens.tobytes())
            if vertex:
                yield pa.RecordBatch.from_arrays([pa.array(vertex, pa.int64()), pa.array(tokens_out, pa.binary())], names=["vertex", "tokens"])

    return run


def _cluster_edges(percent: int, every: bool = False):
    """A spanning forest of each cluster's links, or every link."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(parts, ["root", "left", "right"]):
            if len(g) < 2:
                continue
            vertex = g["vertex"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in g["tokens"]]
            n = np.array([len(x) for x in sets])
            points = [point_of(x) for x in sets]

            def linked(a: int, b: int, sets=sets, points=points) -> bool:
                if not may_link(points[a], points[b], len(sets[a]), len(sets[b]), percent):
                    return False
                x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                return 100 * both >= percent * (len(x) + len(y) - both)

            side = None if g["left"].iloc[0] == g["right"].iloc[0] else g["chunk"].to_numpy()
            stacked = np.stack([folded(x, GROUPS) for x in points])
            yield _edges_frame([(int(vertex[a]), int(vertex[b])) for a, b in (all_links if every else forest)(stacked, n, side, percent, linked)])

    return run


def _clustered(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n, vertex) of every row, and (root, left, right, chunk, vertex, tokens): the sets of each cluster,
    sorted, dealt out as pairs of chunks."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    seen = cut(texts.mapInArrow(_profile(k), "doc_id long, tag long, n long, vertex long, block int, counts binary"), "ngram-profile")
    ids = seen.filter("block is null").select("doc_id", "tag", "n", "vertex")
    slots = seen.filter("block is not null").select("block", "counts")
    # A table per task, added up in two levels of about the square root of their number each.
    salts = max(1, round((slots.filter("block = 0").count()) ** 0.5))
    slots = slots.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts)))
    slots = slots.groupBy("block", "salt").applyInPandas(_add_up, "block int, counts binary").groupBy("block").applyInPandas(_add_up, "block int, counts binary")
    blobs = {r["block"]: zlib.decompress(r["counts"]) for r in slots.collect()}  # SLOT_BLOCKS rows of fixed size
    empty = bytes(4 * SLOTS // SLOT_BLOCKS)
    frequencies = spark.sparkContext.broadcast(zlib.compress(b"".join(blobs.get(b, empty) for b in range(SLOT_BLOCKS)), 1))

    emitted = cut(texts.mapInArrow(_prefixes(k, percent, frequencies), "token long, vertex long, n long, point binary"), "ngram-prefixes")
    points = emitted.filter("token is null").groupBy("vertex").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    rows = emitted.filter("token is not null").select("token", "vertex")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "token").groupBy("token", "vertex").agg(F.lit(1).alias("one"))
    whole = _signed(rows).filter("members > 1")
    chosen = whole.groupBy("members", "s1", "s2", "s3").agg(F.min("token").alias("token")).select("token", "members")
    blocks = rows.select("token", "vertex").join(chosen, "token")
    blocks = blocks.join(points, "vertex").withColumn("chunks", F.ceil(F.col("members") / BLOCK_ROWS))
    dealt = dealt_in_chunks(blocks, "token", "chunks").drop("members", "one")
    dealt = dealt.repartition(parts, "token", "left", "right").sortWithinPartitions("token", "left", "right", "vertex")
    near = dealt.select("token", "left", "right", "chunk", "vertex", "n", "point").mapInPandas(_block_edges(percent), "a long, b long")
    clusters = cut(components(near), "ngram-clusters")

    wanted = clusters.select("vertex").mapInPandas(_bit_rows, "block int, bit int").distinct().groupBy("block").applyInPandas(_bits, "block int, bits binary")
    have = {r["block"]: bytes(r["bits"]) for r in wanted.collect()}  # SLOT_BLOCKS rows of fixed size
    bitmap = spark.sparkContext.broadcast(zlib.compress(b"".join(have.get(b, bytes(BITS // SLOT_BLOCKS // 8)) for b in range(SLOT_BLOCKS)), 1))
    sets = texts.mapInArrow(_sets(k, bitmap), "vertex long, tokens binary").groupBy("vertex").agg(F.first("tokens").alias("tokens"))
    sized = cut(clusters.join(sets, "vertex"), "ngram-sets")
    sizes = sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("tokens") / 8).alias("shingles"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("members") / CLUSTER_ROWS, F.col("shingles") / CLUSTER_SHINGLES)).alias("chunks"))
    dealt = dealt_in_chunks(sized.join(sizes, "root"), "root", "chunks")
    dealt = dealt.repartition(parts, "root", "left", "right").sortWithinPartitions("root", "left", "right", "vertex")
    return ids, dealt.select("root", "left", "right", "chunk", "vertex", "tokens")


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, n_shingles, vertex (which names the set; null for empty ones) and n_links, to
    how many other rows of docs the row links. links: a, b: every pair of different sets that link, once.

    Rows with equal sets share a vertex and link with each other; they are counted, not expanded. Every pair within the
    tree's bound is verified, so this costs more than jaccard_classes, which needs a spanning forest only.
    """
    ids, dealt = _clustered(docs, k, percent)
    links = cut(dealt.mapInPandas(_cluster_edges(percent, every=True), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-links")
    copies = ids.filter("vertex is not null").groupBy("vertex").agg(F.count(F.lit(1)).alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies, F.col("b") == F.col("vertex")).groupBy("a").agg(F.sum("copies").alias("others"))
    degree = copies.join(others, F.col("vertex") == F.col("a"), "left").select("vertex", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = ids.join(degree, "vertex", "left").select("doc_id", F.col("n").alias("n_shingles"), "vertex", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members, links


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, tag, root of every row of docs (needs doc_id and text).

    Documents link when their sets of k-word shingles (words: runs of anything but ASCII white space, A-Z folded)
    have 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. Null and
    word-less texts have empty sets, link with nothing and keep their own doc_id. Rows that repeat an id or a
    text are documents of their own; a null doc_id never is a component's id unless all its ids are null. An
    empty table gives an empty result; other columns are ignored. tag is xxhash64 of the text; root names the
    component (null for empty sets).
    """
    ids, dealt = _clustered(docs, k, percent)
    links = dealt.mapInPandas(_cluster_edges(percent), "a long, b long")
    classes = components(links)

    least = ids.filter("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("least"))
    of_class = least.join(classes, "vertex", "left").select("vertex", "least", F.coalesce("root", "vertex").alias("root"))
    by_root = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(by_root, "root").select("vertex", "root", "component_id")
    out = ids.join(of_class, "vertex", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "tag", "root")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the smallest doc_id stays (null last), of rows that share it
    that of the smallest text hash, of equal rows one. Texts without words all stay."""
    classes = cut(jaccard_classes(docs, k, percent).filter("root is not null").select("doc_id", "tag", "root"), "ngram-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    best = classes.groupBy("root").agg(F.min(order).alias("best"))
    lost = classes.join(best, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag"))))
    id_, tag, nth = free_names(docs, "ngram_id", "ngram_tag", "ngram_nth")
    lost = cut(lost.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct(), "ngram-lost")
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tag))
    kept = docs.join(hinted(lost), match, "left_anti")
    again = classes.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(id_), F.col("tag").alias(tag))
    if again.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(id_, tag).orderBy(F.lit(0)))
    once = kept.join(again, match).withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)
    return kept.join(again, match, "left_anti").unionByName(once)


def _bit_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        bit = _bit(part["vertex"].to_numpy())
        yield pd.DataFrame({"block": (bit // (BITS // SLOT_BLOCKS)).astype("int32"), "bit": bit.astype("int32")})
