"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source gets a target in words. Its documents, in a shuffled order fixed by a hash of doc_id, arrive one
after another; a document's virtual finish time is its source's words up to and including it, divided by the
source's target. All documents of all sources are then ranged by that time and taken until the budget, the sum
of the targets, is used up. A source whose target exceeds its size is read a second time.

No source is ever gathered in one task: running sums are taken over slices (source x 4096 hash slices), whose
totals are small, and then inside each slice; the global order is cut the same way, over 8192 slices of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import cut, free_names, hinted, without

#: Weights of the sources in code-point order (null last), repeated as often as needed.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_READS = 2
HASH_DIGITS = 3
TIME_SLICES = 2048


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most_reads: int = MOST_READS) -> DataFrame:
    """One row per source: source, source_size, target. The windows run over one row per source.

    Shares are weight-proportional, stop at most_reads times the source's size, and the excess is shared again.
    In the order of cap / weight, the first sources whose cap is under the level that the rest would get are
    those at their cap, and the level is then the same for all others.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    by_level = whole.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .select("source", "source_size", w.alias("w"), (F.col("source_size") * most_reads).cast("double").alias("cap"))
        .withColumn("level", (F.lit(budget) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most_reads: int = MOST_READS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (needs doc_id, source, text).

    Null texts and texts without words have size 0 and are never taken; null sources form one source, the last;
    null ids are ordinary ids; repeated rows are documents of their own. An empty table gives an empty result.
    Other columns of docs are ignored.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    turn = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    sizes = cut(sizes.withColumn("turn", turn), "mix-sizes")
    targets = source_targets(sizes, weights, budget, most_reads)

    slice_ = F.substring("turn", 1, HASH_DIGITS)
    by_slice = sizes.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(F.col("source").alias("s"), F.col("slice").alias("sl"), F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("slice", slice_).withColumn("upto", F.sum("size").over(inside)).withColumn("copy", F.row_number().over(inside))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).drop("s", "sl")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    placed = placed.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("upto", F.col("upto") + F.col("offset"))
    placed = cut(placed.select("doc_id", "source", "size", "turn", "copy", "upto", "source_size", "target"), "mix-placed")

    reads = placed.filter("size > 0").withColumn("read", F.explode(F.sequence(F.lit(0), F.lit(most_reads - 1))))
    reads = reads.withColumn("finish", (F.col("upto") + F.col("read") * F.col("source_size")).cast("double") / F.col("target"))
    reads = reads.withColumn("time", F.least(F.floor(F.col("finish") * TIME_SLICES), F.lit(4 * TIME_SLICES)))
    by_time = reads.groupBy("time").agg(F.sum("size").alias("words"))
    all_time = Window.partitionBy(F.lit(0)).orderBy("time")
    total = targets.agg(F.floor(F.sum("target") + 1e-6)).first()[0] or 0
    by_time = by_time.select("time", "words", F.sum("words").over(all_time).alias("end"), F.lit(total).alias("total"))
    # Whole slices of time before the budget's end need no order; only the slice that holds the end is sorted.
    by_time = by_time.filter("end - words < total").select("time", (F.col("end") <= F.col("total")).alias("whole"), (F.col("total") - F.col("end") + F.col("words")).alias("left"))
    reads = reads.join(by_time, "time")
    order = Window.partitionBy("time").orderBy("finish", F.col("source").asc_nulls_last(), "turn", "doc_id", "copy", "read")
    last = reads.filter("not whole").withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("run <= left").drop("run")
    key = ["doc_id", "source", "size", "turn", "copy", "upto"]
    taken = reads.filter("whole").select(*key).unionByName(last.select(*key)).groupBy(*key).agg(F.sum("size").alias("taken"))
    k = taken.select(*[F.col(c).alias(f"k_{c}") for c in key], "taken")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return placed.join(k, cond, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "copy")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix's documents with all their columns, and mix_reads: how often the mix reads each (1 or more).

    Documents are found again by doc_id; the ids go to the texts where they are few enough, so that texts stay in
    place. Where ids repeat, rows of equal id, source and size are told apart by a number: which of them gets
    which does not matter, since the order among them is free.
    """
    mixed = cut(mix(docs, **how), "mix-result")
    columns = [F.col(f"`{c}`") for c in without(docs, "mix_reads")]
    reads = F.expr("cast(taken / size as int)").alias("mix_reads")
    chosen = mixed.filter("taken > 0")
    id_, source, size, nth_, d_size, d_nth = free_names(docs, "mix_id", "mix_source", "mix_size", "mix_nth", "mix_own_size", "mix_own_nth")
    if mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        ids = cut(chosen.select(F.col("doc_id").alias(id_), reads), "mix-ids")
        return docs.select(*columns).join(hinted(ids), F.col("doc_id").eqNullSafe(F.col(id_))).select(*columns, "mix_reads")
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("copy"))
    chosen = chosen.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), nth.alias(nth_), reads)
    rows = docs.select(*columns).withColumn(d_size, word_count(F.col("text")))
    rows = rows.withColumn(d_nth, F.row_number().over(Window.partitionBy("doc_id", "source", d_size).orderBy(F.xxhash64(F.coalesce("text", F.lit(""))))))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(d_size) == F.col(size)) & (F.col(d_nth) == F.col(nth_))
    return rows.join(chosen, on).select(*columns, "mix_reads")
