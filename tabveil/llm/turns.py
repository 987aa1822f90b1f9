"""Rows of conversations in order, without a task that holds a whole conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import cut

#: The row number within a partition has so many bits in monotonically_increasing_id.
ROW_BITS = 33


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def in_order(rows: DataFrame, label: str, *ties: str) -> DataFrame:
    """rows (with conv_id and turn) written in the order of conv_id, turn and ties (null first), and pos, which rises
    in this order over the whole table. pos is consecutive inside a task's part, whose number is pos >> ROW_BITS.

    The table is sorted by ranges of the whole key, so a conversation of any share of the rows is spread over tasks;
    equal rows are told apart by a number, so copies of one row are spread, too.
    """
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", *ties, "copy_number")]
    rows = rows.withColumn("copy_number", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("copy_number")
    return cut(placed.withColumn("pos", F.monotonically_increasing_id()), label)
