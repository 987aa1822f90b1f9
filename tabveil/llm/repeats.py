"""Removal of long byte strings that occur earlier in the corpus, by suffix arrays over shards.

Windows of 100 bytes are what repeats. Every window is named by the smallest hash of its 40-byte grams, so equal
windows have equal names, and consecutive windows of a text mostly share theirs: they form runs, some 3 per 100
bytes. Only names that several runs have can hold repeats, and these decide where text has to meet:

1. Texts with equal digests: all but the first are removed whole, if they have a window at all.
2. A first scan counts names. Those that two runs have, or a run that may repeat itself, go into a bitmap; a second
   scan takes the runs of such names with their bytes. Of runs with equal bytes all but the first repeat it whole:
   hot passages so collapse before anything gathers them.
3. The first runs of names with several texts, and runs that may repeat themselves, bring their bytes to a shard,
   where an induced-sorting suffix array and its permuted common prefixes find equal windows; of each class of equal
   windows all but the first are repeats.
4. A name with more bytes than a shard is dealt to several. Each settles its own classes by its suffix array and hands
   on one window a class, and these meet by value. So no task holds such a name whole, and nothing is left out.

Repeats go back to their texts as byte ranges. Only names, runs of step 2 and ranges are shuffled, and texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import BROADCAST_ROWS, BYTE_CODE, ODD, ODD_INVERSE, cut, mix64, powers, small_batches
from tabveil.llm.ngram_join import _groups
from tabveil.llm.suffix import permuted_lcp, suffix_array

WINDOW = 100
GRAM = 40
#: Windows that one gram can name, so the longest run without ties.
REACH = WINDOW - GRAM + 1
SHARD_BYTES = 1 << 20
#: Windows of a run at most; only text that repeats itself has longer ones, which are cut.
PIECE = 1 << 16
#: Bits of the bitmap of names: so many a name, between these bounds. More names only let more runs through.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Texts or runs that a task remembers having emitted.
REMEMBERED = 200_000


class Runs:
    """Runs of windows with equal names in texts laid end to end."""

    def __init__(self):
        self.up, self.down = powers(ODD, 1 << 16), powers(ODD_INVERSE, 1 << 16)

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(name, text, first window, windows, loops) of each run, and the joined bytes.

        loops: a window starts with its naming gram and the next one, which no longer holds that gram, has the
        same name. Without that no two windows of the run are equal: of two, the leftmost naming gram of the
        former is not in the latter.
        """
        data = b"".join(raw)
        n = len(data)
        if n < WINDOW:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none, none, none, data
        if n >= len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = powers(ODD, size), powers(ODD_INVERSE, size)
        b = np.frombuffer(data, dtype=np.uint8)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[b] * self.up[:n], out=total[1:])
        gram = mix64((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        # Sliding minima over REACH grams, from running minima of blocks in both directions.
        m = len(gram)
        blocks = -(-m // REACH)
        grid = np.full(blocks * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[:m] = gram
        grid = grid.reshape(blocks, REACH)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        name = np.minimum(back[: m - REACH + 1], ahead[REACH - 1 : m])
        length = np.array([len(x) for x in raw])
        start = np.cumsum(length) - length
        text = np.repeat(np.arange(len(raw)), length)[: len(name)]
        inside = np.arange(len(name)) <= (start + length - WINDOW)[text]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        edge = np.flatnonzero(new | ~inside)
        first = np.flatnonzero(new & inside)
        after = np.append(edge, len(name))[np.searchsorted(edge, first) + 1]
        tie = np.zeros(len(name) + 1, dtype=np.int64)
        np.cumsum(np.append((gram[: len(name) - 1] == name[:-1]) & ~new[1:] & inside[1:], False), out=tie[1:])
        loops = tie[after] > tie[first]
        many = np.maximum(1, -(-(after - first) // PIECE))
        if (many > 1).any():
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, after, loops = np.repeat(first, many), np.repeat(after, many), np.repeat(loops, many)
            first = first + nth * PIECE
            after = np.minimum(after, first + PIECE)
        return name[first], text[first], first, after - first, loops, data


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each batch: keys, texts, and what Runs says of them. Of equal texts in a task a later one is left out, unless
    its key is smaller."""
    find, least = Runs(), {}
    for batch in batches:
        keys, raw = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            if len(data) < WINDOW or least.get(d := xxhash.xxh3_128_digest(data), key + 1) <= key:
                continue
            if len(least) >= REMEMBERED:
                least.clear()
            least[d] = key
            keys.append(key)
            raw.append(data)
        found = find(raw)
        if len(found[0]):
            yield keys, raw, *found


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n, loops): how many runs have it."""
    for _, _, name, _, _, _, loops, _ in _each(batches):
        distinct, at, n = np.unique(name, return_inverse=True, return_counts=True)
        loop = np.zeros(len(distinct), dtype=bool)
        loop[at[loops]] = True
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(loop)], names=["name", "n", "loops"])


def bitmap_of(names: DataFrame) -> np.ndarray:
    """Words of a bitmap over the low bits of names; of bounded size, and added up by Spark."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, names.count()) - 1).bit_length()))
    words = names.select((F.col("name").bitwiseAND(F.lit(bits - 1)) / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(name & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def _wanted_runs(bitmap):
    """(name, digest, key, start, windows, loops, bytes) of the runs whose name the bitmap holds. bytes is null where
    the task has emitted the same run at an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = bitmap.value, {}
        mask = np.uint64(64 * len(words) - 1)
        for keys, raw, name, text, first, windows, loops, data in _each(batches):
            on = np.flatnonzero((words[((name & mask) >> np.uint64(6)).astype(np.int64)] >> (name & np.uint64(63))) & np.uint64(1))
            if not len(on):
                continue
            name, text, first, windows, loops = name[on], text[on], first[on], windows[on], loops[on]
            length = np.array([len(x) for x in raw])
            start = first - (np.cumsum(length) - length)[text]
            key, digest, pieces = np.array(keys, dtype=np.int64)[text], [], []
            for n, k, at, a, b in zip(name.tolist(), key.tolist(), start.tolist(), first.tolist(), (first + windows + WINDOW - 1).tolist(), strict=True):
                piece = data[a:b]
                d = xxhash.xxh3_64_intdigest(piece)
                digest.append(d)
                if seen.get((n, d), (k + 1, 0)) <= (k, at):
                    piece = None
                else:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[n, d] = (k, at)
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.array(digest, dtype=np.uint64).view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(loops), pa.array(pieces, pa.binary())], names=["name", "digest", "key", "start", "windows", "loops", "bytes"])

    return run


def repeated_windows(texts: list[bytes], order: np.ndarray, width: int = WINDOW) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the first bytes of its windows that also occur earlier, and of those that do not. Earlier: in a
    text of smaller order (rows of order compare as tuples; they differ between texts), or before in the same text.

    order: an array of (key, start) rows; windows at equal absolute places don't occur twice.
    """
    length = np.array([len(x) for x in texts])
    first = np.cumsum(length + 1) - (length + 1)
    t = np.empty(int(length.sum()) + len(texts) + 1, dtype=np.uint16)
    t[:-1] = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    t[:-1] += 2
    t[first + length] = 1  # ends a text
    t[-1] = 0
    sa = suffix_array(t)
    shared = permuted_lcp(t, sa, width)
    text = np.repeat(np.arange(len(texts) + 1), np.append(length + 1, 1))
    place = np.arange(len(t)) - np.append(first, len(t) - 1)[text]
    real = np.zeros(len(t), dtype=bool)
    real[:-1] = place[:-1] + width <= length[text[:-1]]
    at = sa[real[sa]]
    # Classes of equal windows are neighbours in the suffix array. What lies between two of them shares the width
    # with both and is a window itself, so leaving out the rest does not join or part classes.
    new = shared[at] < width
    if not len(at):
        return [np.empty(0, np.int64)] * len(texts), [np.empty(0, np.int64)] * len(texts)
    new[0] = True
    key, pos = order[text[at], 0], order[text[at], 1] + place[at]
    rank = np.empty(len(at), dtype=np.int64)
    rank[np.lexsort((pos, key))] = np.arange(len(at))
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(rank, np.flatnonzero(new))
    first_of = rank == least[group]

    def by_text(where: np.ndarray) -> list[np.ndarray]:
        where = np.sort(where)
        cuts = np.searchsorted(text[where], np.arange(len(texts) + 1))
        return [place[where[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return by_text(at[~first_of]), by_text(at[first_of])


def _shards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges (key, a, b) that repeat; and, of names in several shards, the first window (key, a) of each class with its
    digest in w1 and w2."""
    for g in _groups(parts, ["shard"]):
        texts = list(g["bytes"])
        order = np.stack([g["key"].to_numpy(), g["start"].to_numpy().astype(np.int64)], axis=1)
        key, begin, end, high, low = [], [], [], [], []
        for (k, s), raw, split, at, firsts in zip(order.tolist(), texts, g["split"], *repeated_windows(texts, order), strict=True):
            if len(at):
                breaks = np.flatnonzero(np.diff(at) > 1)
                a, b = at[np.concatenate(([0], breaks + 1))], at[np.append(breaks, len(at) - 1)]
                key += [k] * len(a)
                begin += (a + s).tolist()
                end += (b + s + WINDOW).tolist()
                high += [None] * len(a)
                low += [None] * len(a)
            for i in firsts.tolist() if split else ():
                d = xxhash.xxh3_128_intdigest(raw[i : i + WINDOW])
                key.append(k), begin.append(i + s), end.append(i + s + WINDOW)
                high.append((d >> 64) - (1 << 63)), low.append((d & (1 << 64) - 1) - (1 << 63))
        yield pd.DataFrame({"key": np.array(key, dtype=np.int64), "a": np.array(begin, dtype=np.int32), "b": np.array(end, dtype=np.int32), "w1": pd.array(high, "Int64"), "w2": pd.array(low, "Int64")})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
    for batch in batches:
        rows = []
        for key, text, copy, ranges in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "copy", "ranges")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            if copy and len(raw) >= WINDOW:
                spans = [[0, len(raw)]]
            elif ranges:
                for r in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([r[0], r[1]])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((key, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)], schema=schema)


def _not_first(rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """rows but the one with the least place of each group. Minima are combined before they meet, and a hot group's rows
    are joined back, which adaptive execution splits."""
    named = [F.col(c).alias(f"{c}_") for c in by]
    least = rows.groupBy(*named).agg(F.min(F.struct(*place)).alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"{c}_"))
    return rows.join(least, same).filter(F.struct(*place) > F.col("least")).select(*rows.columns)


def _keyed_repeats(docs: DataFrame) -> DataFrame:
    """docs: key (long, unique, not null, in the order of documents) and text."""
    spark = docs.sparkSession
    heads = cut(docs.select("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n")), "repeats-heads")
    copies = cut(_not_first(heads, ["digest", "n"], ["key"]).select("key", F.lit(True).alias("copy")), "repeats-copies")
    rest = docs
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else tasks leave out the copies that they see
        rest = docs.join(F.broadcast(copies.select("key")), "key", "left_anti")

    names = rest.mapInArrow(_names, "name long, n int, loops boolean").groupBy("name").agg(F.sum("n").alias("n"), F.bool_or("loops").alias("loops"))
    names = cut(names.filter("n > 1 or loops").select("name"), "repeats-names")
    bitmap = spark.sparkContext.broadcast(bitmap_of(names))
    runs = cut(rest.mapInArrow(_wanted_runs(bitmap), "name long, digest long, key long, start int, windows int, loops boolean, bytes binary"), "repeats-runs")
    whole = _not_first(runs.select("name", "digest", "key", "start", "windows"), ["name", "digest"], ["key", "start"])
    whole = whole.select("key", F.col("start").alias("a"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("b"))

    firsts = runs.groupBy("name", "digest").agg(F.min(F.struct("key", "start")).alias("first"), F.first("windows").alias("windows"), F.bool_or("loops").alias("loops"))
    firsts = cut(firsts.select("name", "first.key", "first.start", "windows", "loops"), "repeats-firsts")
    sizes = firsts.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), F.bool_or("loops").alias("loop"), F.sum(F.col("windows") + WINDOW).alias("bytes")).filter("texts > 1 or loop")
    sizes = cut(sizes.select("name", "bytes", F.ceil(F.col("bytes") / SHARD_BYTES).alias("chunks")), "repeats-sizes")
    shards = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    wanted = firsts.join(sizes, "name").select("name", "key", "start", "chunks")
    chunk = F.pmod(F.xxhash64("key", "start"), F.col("chunks"))
    shard = F.pmod(F.xxhash64("name", chunk), F.lit(shards)).cast("int")
    wanted = wanted.select("name", "key", "start", shard.alias("shard"), (F.col("chunks") > 1).alias("split"))
    dealt = runs.filter("bytes is not null").select("name", "key", "start", "bytes").join(wanted, ["name", "key", "start"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("shard", "key", "start", "split", "bytes").repartition(max(parts, min(shards, 20_000)), "shard").sortWithinPartitions("shard", "key", "start")
    found = cut(dealt.mapInPandas(_shards, "key long, a int, b int, w1 long, w2 long"), "repeats-found")
    across = _not_first(found.filter("w1 is not null"), ["w1", "w2"], ["key", "a"]).select("key", "a", "b")
    ranges = whole.unionByName(found.filter("w1 is null").select("key", "a", "b")).unionByName(across)
    per_text = ranges.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    out = docs.join(cut(per_text, "repeats-ranges"), "key", "left").join(copies, "key", "left").select("key", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges")
    return out.mapInArrow(_cut_out, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of docs (needs doc_id and text).

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller doc_id or before in the
    same one. Strings don't cross documents and are judged on the input. spans are the maximal removed runs, in
    bytes. Null texts count as empty. Rows that repeat a doc_id, and those with a null one (taken last), are
    ordered by a digest of their text; equal rows among them one after another. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return _keyed_repeats(rows.withColumnRenamed("doc_id", "key")).withColumnRenamed("key", "doc_id")
    # Rows are numbered in the wanted order: a range sort numbers its partitions, and rows inside them, upwards.
    numbered = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = numbered.orderBy(F.col("doc_id").asc_nulls_last(), "digest").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    keyed = cut(keyed, "repeats-keyed")
    return _keyed_repeats(keyed.select("key", "text")).join(keyed.select("key", "doc_id"), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
