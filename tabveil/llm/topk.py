"""Exact top-k by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it. A component sqrt(M - |x|^2), M the largest
squared norm, makes all vectors equally long, so the largest inner product is the smallest distance and the
triangle inequality bounds it: a vector at distance r from pivot p is no nearer to q than |d(q, p) - r|.

1. Equal vectors become one point with its smallest ids. Pivots are fitted on a bounded sample; every point is
   keyed. The points of a pivot, sorted by distance, are cut into cells.
2. A query's own cell gives a first bound on its k-th score.
3. A query goes only to the cells whose ring that bound cannot exclude; there it takes the annuli from the
   nearest outward and stops at the first one too far. Queries come in blocks of neighbouring cells, so a task holds
   a chunk of a cell and a block, and a chunk's points travel only to the blocks that have a query for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import cut, mix64, small_batches

#: Pivots: one for so many points, between the bounds; sampled rows that the fit takes for each.
PIVOT_ROWS = 16_384
PIVOTS, MOST_PIVOTS = 16, 1024
SAMPLE_EACH = 64
CELL_ROWS = 4096
#: Rings of a pivot at most; what is broadcast is a row of seven numbers for each. Beyond, rings get wider.
MOST_RINGS = 256
QUERY_BLOCK = 8192
ANNULUS_ROWS = 256
SLACK = 1e-6


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _stretched(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def fit_pivots(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; deterministic."""
    n = min(n, len(x))
    p = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, p).argmin(axis=1)
        for k in range(n):
            if (near == k).any():
                p[k] = x[near == k].mean(axis=0)
    return p


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that are not null and hold only finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.filter(fine & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _keyed(pivots, width: int, most: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pivots.value
        for part in parts:
            if len(part):
                d = _distances(_stretched(_matrix(part["v"], width), most), p)
                near = d.argmin(axis=1)
                yield part.assign(pivot=near.astype("int32"), r=d[np.arange(len(d)), near])

    return run


def _first_bound(k: int, width: int):
    """For each query of a cell's chunk: the k-th best score among its points, null if it has fewer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["asks"]]
        if not len(q):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "point": pd.Series([], dtype="int64"), "v": pd.Series([], dtype=object), "bound": pd.Series([], dtype="float64")})
        x, many, bounds = _matrix(pdf["v"], width), np.array([len(i) for i in pdf["ids"]]), []
        for a in range(0, len(q), 256):
            s = _matrix(q["v"].iloc[a : a + 256], width) @ x.T
            order = np.argsort(-s, axis=1)[:, :k]
            have = np.cumsum(many[order], axis=1)
            at = (have < k).sum(axis=1)
            full = at < order.shape[1]
            at = np.minimum(at, order.shape[1] - 1)
            bounds += np.where(full, s[np.arange(len(s)), order[np.arange(len(s)), at]], np.nan).tolist()
        return pd.DataFrame({"cell": q["cell"].to_numpy(), "point": q["point"].to_numpy(), "v": q["v"].to_numpy(), "bound": bounds})

    return run


def blocks_of(queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell, from its queries: neighbouring cells share a block as long as it
    holds at most so many queries, a cell of more has several."""
    first, many, block, have = np.zeros(len(queries), np.int32), np.ones(len(queries), np.int32), 0, 0
    for i, n in enumerate(queries.tolist()):
        if have and have + n > most:
            block, have = block + 1, 0
        first[i], many[i] = block, max(1, -(-n // most))
        block, have = (block + int(many[i]), 0) if n > most else (block, have + n)
    return first, many


def _routed(pivots, cells, width: int, most: float):
    """A row for each query and chunk of a cell that the bound cannot exclude."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = cells.value
        for part in parts:
            for a in range(0, len(part), 256):
                q = part.iloc[a : a + 256]
                x = _matrix(q["v"], width)
                d = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots.value)
                far = np.sqrt(np.maximum((x * x).sum(axis=1) + most - 2 * q["bound"].fillna(-np.inf).to_numpy(), 0.0))
                at = d[:, c["pivot"]]
                low = np.maximum(np.maximum(at - c["high"], c["low"] - at), 0.0)
                rows, cols = np.nonzero(low <= (far * (1 + SLACK) + SLACK)[:, None])
                many = c["chunks"][cols]
                chunk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows, cols = np.repeat(rows, many), np.repeat(cols, many)
                own = np.searchsorted(c["cell"], q["cell"].to_numpy())
                spread = (mix64(q["point"].to_numpy().view(np.uint64)) % c["blocks"][own].astype(np.uint64)).astype("int32")
                yield pd.DataFrame({"cell": c["cell"][cols], "chunk": chunk.astype("int32"), "block": (c["block"][own] + spread)[rows], "point": q["point"].to_numpy()[rows], "v": q["v"].to_numpy()[rows], "bound": q["bound"].to_numpy()[rows], "d": at[rows, cols]})

    return run


def _searched(k: int, width: int, most: float):
    def run(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["point", "vec_id", "score"]
        if not len(points) or not len(queries):
            return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
        points = points.sort_values("r", kind="stable")
        x, r = _matrix(points["v"], width), points["r"].to_numpy()
        ids, many = points["ids"].to_numpy(), np.array([len(i) for i in points["ids"]])
        q, d = _matrix(queries["v"], width), queries["d"].to_numpy()
        lengths = (q * q).sum(axis=1)
        starts = np.arange(0, len(x), ANNULUS_ROWS)
        ends = np.minimum(starts + ANNULUS_ROWS, len(x))
        low = np.maximum(np.maximum(d[:, None] - r[ends - 1][None, :], r[starts][None, :] - d[:, None]), 0.0)
        order = np.argsort(low, axis=1, kind="stable")
        bound = queries["bound"].fillna(-np.inf).to_numpy().copy()
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(len(q))]  # scores and point rows so far
        active = np.arange(len(q))
        for j in range(len(starts)):
            far = np.sqrt(np.maximum(lengths[active] + most - 2 * bound[active], 0.0)) * (1 + SLACK) + SLACK
            active = active[low[active, order[active, j]] <= far]
            if not len(active):
                break
            ring = order[active, j]
            for a in np.unique(ring):
                who = active[ring == a]
                s = q[who] @ x[starts[a] : ends[a]].T
                for i, row in zip(who, s, strict=True):
                    hit = np.flatnonzero(row >= bound[i])
                    if len(hit):
                        score, at = np.concatenate([best[i][0], row[hit]]), np.concatenate([best[i][1], hit + starts[a]])
                        if (n := many[at].sum()) >= k and n > 4 * k or len(at) > 4 * k:
                            o = np.argsort(-score, kind="stable")
                            have = np.cumsum(many[at[o]])
                            last = int((have < k).sum())
                            if last < len(o):
                                bound[i] = max(bound[i], score[o[last]])
                                score, at = score[score >= bound[i]], at[score >= bound[i]]
                        best[i] = (score, at)
        out = []
        for i, (score, at) in enumerate(best):
            found = sorted(((-s, int(v)) for s, p in zip(score, at, strict=True) if s >= bound[i] for v in ids[p]))[:k]
            out += [(queries["point"].iloc[i], v, int(-s)) for s, v in found]
        return pd.DataFrame(out, columns=names).astype("int64")

    return run


def top_k(vectors: DataFrame, asks, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of vectors (vec_id, embedding) that the condition asks selects
    (a Column over vec_id), the k other vectors of largest integer inner product, ties to the smaller vec_id.

    Vectors that are null, have a null id or hold null or non-finite components take no part; missing components
    of shorter vectors count as 0; rows that repeat an id and a vector count once. With fewer than k others, all
    are returned; an empty table gives an empty result. Products must be below 2^53 to be exact, which is checked.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(quantised(vectors, scale).distinct(), "topk-rows")
    lengths = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    width, most = rows.agg(F.max(F.size("v")), F.max(lengths)).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most >= 2**53:
        raise ValueError("components are too large for exact inner products")
    width, most = max(1, width), float(most)
    # One point per distinct vector, named by its smallest id, with the k + 1 smallest ids (one may be the query's).
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1)
    points = few.groupBy("v").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.filter(asks).select("v", F.col("vec_id").alias("query_id"))
    points = points.join(asking.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    points = cut(points, "topk-points")

    n_pivots = max(PIVOTS, min(MOST_PIVOTS, points.count() // PIVOT_ROWS))
    sample = points.select("v").orderBy(F.xxhash64("point"), "point").limit(SAMPLE_EACH * n_pivots).collect()
    fitted = fit_pivots(_stretched(_matrix([r["v"] for r in sample], width), most), n_pivots)
    pivots = spark.sparkContext.broadcast(fitted)
    keyed = cut(points.mapInPandas(_keyed(pivots, width, most), "v array<double>, point long, ids array<long>, asks boolean, pivot int, r double"), "topk-keyed")

    counts = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", [i / 256 for i in range(1, 256)], 4096).alias("q"))
    edges = []
    for r in counts.orderBy("pivot").collect():  # a row per pivot
        c = min(MOST_RINGS, -(-r["n"] // CELL_ROWS))
        edges.append((r["pivot"], sorted({float(r["q"][max(0, min(254, round(256 * i / c) - 1))]) for i in range(1, c)})))
    rings = F.broadcast(spark.createDataFrame(edges, "pivot int, edges array<double>"))
    celled = keyed.join(rings, "pivot").withColumn("cell", F.col("pivot") * MOST_RINGS + F.size(F.filter("edges", lambda e: e < F.col("r")))).drop("edges")
    # MOST_RINGS cells a pivot at most. A cell of more rows than a task should hold is taken in chunks, each within its ring.
    chunks = F.ceil(F.count(F.lit(1)) / (2 * CELL_ROWS)).cast("int").alias("chunks")
    cells = celled.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("r").alias("low"), F.max("r").alias("high"), chunks, F.count_if("asks").alias("queries")).orderBy("cell").collect()
    as_arrays = {n: np.array([r[n] for r in cells]) for n in ("cell", "pivot", "low", "high", "chunks")}
    as_arrays["block"], as_arrays["blocks"] = blocks_of(np.array([r["queries"] for r in cells]), QUERY_BLOCK)
    parts = F.broadcast(spark.createDataFrame([(r["cell"], r["chunks"]) for r in cells], "cell int, chunks int"))
    celled = celled.join(parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int"))
    shared = spark.sparkContext.broadcast(as_arrays)

    firsts = celled.groupBy("cell", "chunk").applyInPandas(_first_bound(k + 1, width), "cell int, point long, v array<double>, bound double")
    firsts = cut(firsts, "topk-firsts")
    routed = firsts.mapInPandas(_routed(pivots, shared, width, most), "cell int, chunk int, block int, point long, v array<double>, bound double, d double")
    wanted = cut(routed.select("cell", "chunk", "block").distinct(), "topk-wanted")
    dealt = celled.select("cell", "chunk", "ids", "v", "r").join(wanted, ["cell", "chunk"])
    hits = dealt.groupBy("cell", "chunk", "block").cogroup(routed.groupBy("cell", "chunk", "block")).applyInPandas(_searched(k + 1, width, most), "point long, vec_id long, score long")
    best = Window.partitionBy("point").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)

    asking = asking.join(points.filter("asks").select("v", "point"), "v").select("query_id", "point")
    answers = asking.join(hits, "point").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
