"""Cumulative-snapshot collapse of logged conversations, with DataFrame operations only.

A chat log often holds the same conversation many times, each snapshot one turn longer. The turns of a
conversation, in order, give rolling prefix hashes; a conversation whose whole hash is a prefix hash of a longer
one (or equals that of another with a smaller id) is dropped by an anti-join, and the rest is rendered.

A prefix hash is a running sum of position-dependent turn hashes, kept as four sums of 32-bit words (128 bits),
so it can be taken in slices: positions and sums are first added up per slice of 1024 turn numbers, then inside
each slice. A conversation of any length is thus never sorted in one task (turns without a number, or of one number,
share a slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import cut

SLICE = 1024
PARTS = 4


def _numbered(turns: DataFrame) -> DataFrame:
    """pos (1, 2, ...) of each turn of a conversation: by turn number, null first; ties by role, then text."""
    t = turns.select("conv_id", "turn", "role", "text").withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    counts = t.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("nth", F.row_number().over(inside))
    t = t.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
    return t.select("conv_id", "slice", "role", "text", (F.col("nth") + F.col("offset")).alias("pos"))


def _hashed(turns: DataFrame) -> DataFrame:
    """Adds h1..h4: sums of hash words over the turns up to this one."""
    text = F.concat_ws("\x00", F.coalesce(F.concat(F.lit("r"), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")))
    digest = F.sha2(F.concat_ws("\x00", F.col("pos").cast("string"), text), 256)
    t = turns.withColumn("d", digest)
    for k in range(PARTS):
        t = t.withColumn(f"p{k}", F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long"))
    t = t.drop("d")
    sums = t.groupBy("conv_id", "slice").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(PARTS)])
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), *[F.coalesce(F.sum(f"p{k}").over(before), F.lit(0)).alias(f"o{k}") for k in range(PARTS)])
    upto = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "slice", "pos", *[F.sum(f"p{k}").over(upto).alias(f"p{k}") for k in range(PARTS)])
    t = t.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
    return t.select("conv_id", "pos", *[(F.col(f"p{k}") + F.col(f"o{k}")).alias(f"h{k}") for k in range(PARTS)])


def maximal_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, role, text of the turns of conversations that no other conversation extends.

    Of conversations with equal turns the smallest id stays (null last). A turn is its role and text; null and
    empty differ. Null conv_id is one conversation; repeated turn numbers are ordered by role and text. An empty
    table gives an empty result; other columns are ignored.
    """
    numbered = cut(_numbered(turns), "chat-turns")
    prefixes = cut(_hashed(numbered), "chat-hashes")
    h = [f"h{k}" for k in range(PARTS)]
    lengths = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    wholes = prefixes.join(lengths.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("n_turns"))).drop("c")
    wholes = cut(wholes, "chat-wholes")
    # One row per distinct whole conversation, so hot copies leave before the anti-join.
    first = wholes.groupBy("pos", *h).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.join(wholes.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") < F.col("n_turns")), "left_semi")
    inner = inner.select("pos", *h).distinct()
    kept = first.join(inner, ["pos", *h], "left_anti").select(F.col("conv_id").alias("c"), F.col("pos").alias("n_turns"))
    return numbered.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "pos", "n_turns", "role", "text")


def render_turns(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Adds rendered: the turn in ChatML-like form; null role reads as user, null text as empty. Markers inside roles and
    texts lose their bar (`<|im_end|>` becomes `<im_end>`), so no text can pass for a turn of its own.

    Rendering is per turn, so a huge conversation is never one value; joined by pos, the pieces are the conversation.
    """
    harmless = lambda c: F.replace(F.replace(c, F.lit(start), F.lit(start.replace("|", ""))), F.lit(end), F.lit(end.replace("|", "")))
    piece = F.concat(F.lit(start), harmless(F.coalesce("role", F.lit("user"))), F.lit("\n"), harmless(F.coalesce("text", F.lit(""))), F.lit(f"{end}\n"))
    return turns.withColumn("rendered", piece)


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, rendered of the turns of maximal conversations; see maximal_turns for nulls and ties."""
    return render_turns(maximal_turns(turns)).select("conv_id", "pos", "n_turns", "rendered")
