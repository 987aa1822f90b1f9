"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features describe the line and, as the field allows, its neighbours. The
field is trained on lines that carry the label of their document; forward-backward marginals of the lines,
weighted by length, add up to the document's quality, which a logistic curve then calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.llm.common import small_batches

#: What the fit takes, in the order of a hash of doc_id: labelled documents at most, and bytes of their whole texts, after
#: which no further document is begun.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 16 << 20
EPOCHS = 150
THRESHOLD = 0.3


def _class_table() -> np.ndarray:
    table = np.full(256, 0, dtype=np.uint8)  # 0: bytes of other letters
    table[97:123] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[[9, 11, 12, 13, 32]] = 4
    table[[ord(c) for c in ".,;:'\"-?()"]] = 5
    table[[ord(c) for c in "!"]] = 6
    table[[ord(c) for c in "|"]] = 7
    table[[c for c in range(33, 127) if table[c] == 0]] = 8
    table[[c for c in range(32) if c not in (9, 10, 11, 12, 13)]] = 8
    return table


CLASS = _class_table()
CLASSES = 9
OWN = CLASSES + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines of each text, bytes of each line). A text without a line break is one line."""
    lines: list[bytes] = []
    per_text, distinct, words_of, again = [], [], [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").split(b"\n")
        per_text.append(len(own))
        seen: set[bytes] = set()
        for line in own:
            words = line.split()
            words_of.append(len(words))
            distinct.append(len(set(words)))
            again.append(line in seen and bool(words))
            seen.add(line)
        lines += own
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size + 1) - (size + 1)
    kinds = CLASS[np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)]
    own = np.zeros((len(lines), OWN))
    for k in range(CLASSES):
        # The closing line break is of class 0 and counts in no line.
        own[:, k] = np.add.reduceat((kinds == k).astype(np.int32), start) - (k == 0)
    own[:, :CLASSES] /= np.maximum(size, 1)[:, None]
    words_of, distinct = np.array(words_of, dtype=float), np.array(distinct, dtype=float)
    own[:, CLASSES] = 1 - distinct / np.maximum(words_of, 1)
    own[:, CLASSES + 1] = (own[:, CLASSES] > 0.5) * 1.0
    own[:, CLASSES + 2] = np.log1p(words_of) / 5
    own[:, CLASSES + 3] = np.array(again, dtype=float)
    own[:, CLASSES + 4] = np.minimum(size / np.maximum(words_of, 1), 40) / 10
    own[:, CLASSES + 5] = size == 0
    per_text = np.array(per_text)
    first = np.cumsum(per_text) - per_text
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[first + per_text - 1] = 0, 0
    ends = np.zeros((len(lines), 3))
    ends[first, 0], ends[first + per_text - 1, 1], ends[:, 2] = 1, 1, 1
    return np.hstack([own, before, after, ends]), per_text, size


def features_in_parts(texts: list[str], part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What line_features gives, made for texts of a part of characters at a time: the fit holds the features once."""
    x = np.empty((sum(t.count("\n") + 1 for t in texts), 3 * OWN + 3))
    per_text, sizes, at, begin = [], [], 0, 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= part):
            chars += len(texts[end])
            end += 1
        own, lines, size = line_features(texts[begin:end])
        x[at : at + len(own)] = own
        at, begin = at + len(own), end
        per_text.append(lines)
        sizes.append(size)
    return x, np.concatenate(per_text), np.concatenate(sizes)


def marginals(score: np.ndarray, lines: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end: P(line good), the expected transitions summed over chains (2 x 2) and log Z each.

    score: log-odds of good for each line; lines: lines of each chain; turn: log potentials of transitions.
    Chains advance together, the longest first, so a step is one vector operation over the chains still going.
    """
    order = np.argsort(-lines, kind="stable")
    first, lines = (np.cumsum(lines) - lines)[order], lines[order]
    most = int(lines[0]) if len(lines) else 0
    going = np.searchsorted(-lines, -np.arange(1, most + 1), side="right") if most else []
    ahead, back = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    for t in range(most):
        at = first[: going[t]] + t
        if t:
            p = ahead[at - 1]
            ahead[at] = np.logaddexp(p[:, :1] + turn[0], p[:, 1:] + turn[1])
        ahead[at, 1] += score[at]
    for t in range(most - 2, -1, -1):
        at = first[: going[t + 1]] + t
        nxt = back[at + 1].copy()
        nxt[:, 1] += score[at + 1]
        back[at] = np.logaddexp(turn[:, 0] + nxt[:, :1], turn[:, 1] + nxt[:, 1:])
    both = ahead + back
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(len(score), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    e = back[at].copy()
    e[:, 1] += score[at]
    pair = np.exp(ahead[at - 1][:, :, None] + turn[None] + e[:, None, :] - z[at][:, None, None])
    logz = np.empty(len(lines))
    logz[order] = z[first]
    return good, pair.sum(axis=0), logz


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    turn: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        x, lines, size = line_features(texts)
        return self.of_lines((x - self.mean) / self.spread, lines, size)

    def of_lines(self, x: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
        """From features that are scaled already."""
        good, _, _ = marginals(x @ self.weight, lines, self.turn)
        first = np.cumsum(lines) - lines
        return np.add.reduceat(good * (size + 1), first) / np.add.reduceat(size + 1.0, first)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        p = np.clip(self.raw(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Of the conditional log-likelihood of the lines' labels y. In its emissions a document's lines weigh 1 / their
    number, so long documents don't outweigh the rest; transitions are those of a mean line."""
    good, pair, _ = marginals(x @ theta[:-4], lines, theta[-4:].reshape(2, 2))
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(lines) - lines] = False
    seen = np.array([[(y[inner] == 0).sum(), 0.0], [0.0, (y[inner] == 1).sum()]])  # a document's lines share its label
    return np.concatenate([x.T @ ((y - good) * np.repeat(1 / lines, lines)) / len(lines), ((seen - pair) / len(y)).ravel()])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, penalty: float = 1e-3) -> Field:
    """Adam on the mean conditional log-likelihood of a line; deterministic."""
    if not texts:
        texts, labels = ["", "x"], [0, 1]
    x, lines, size = features_in_parts(texts)
    mean = x.mean(axis=0)
    spread = np.concatenate([x[:, j : j + 8].std(axis=0) for j in range(0, x.shape[1], 8)]) + 1e-3
    mean[-1], spread[-1] = 0, 1  # the constant
    x -= mean
    x /= spread
    y = np.repeat(np.array(labels, dtype=float), lines)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        grad = gradient(theta, x, y, lines) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)
    field = Field(mean, spread, theta[:-4], theta[-4:].reshape(2, 2))
    p = np.clip(field.of_lines(x, lines, size), 1e-6, 1 - 1e-6)
    u, y = np.log(p / (1 - p)), np.array(labels, dtype=float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve in the document's log-odds
        q = 1 / (1 + np.exp(-(a * u + b)))
        r = q * (1 - q) + 1e-9
        h = np.array([[(r * u * u).sum() + 1.0, (r * u).sum()], [(r * u).sum(), r.sum() + 1.0]])
        g = np.array([((y - q) * u).sum() - (a - 1), (y - q).sum() - b])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    field.slope, field.shift = float(max(a, 1e-3)), float(b)
    return field


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Field:
    """Fits on labelled documents that are not held out, of any length, drawn by a hash until there are most of them or
    SAMPLE_BYTES of text.

    Null labels and null ids are left out; of contradicting labels of a document the larger counts. Without any
    labelled row the field knows nothing and scores by its prior.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.orderBy(*order).limit(most).withColumn("before", F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(before), F.lit(0)))
    found = rows.filter(F.col("before") < SAMPLE_BYTES).orderBy(*order).collect()
    return fit([r["text"] or "" for r in found], [int(r["quality"]) for r in found])


def _scored(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = field.value.score([t or "" for t in batch.column("text").to_pylist()])
            names = [c for c in batch.schema.names if c != "quality_score"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "quality_score"])

    return run


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """docs with quality_score in [0, 1] (higher: better). Only the text counts; null texts count as empty, which is
    one empty line. Every row is scored by itself; a column of that name is replaced; no rows give no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop("quality_score")
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(field)), T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType())]))
