"""A trie of conversation prefixes, merged from partial tries.

A node is named by the turns that lead to it: 126 bits of a running sum of hashes of (depth, turn), so every
conversation names the nodes on its path by itself. Every partition combines the paths of its conversations into a
partial trie, a table of nodes with the number of members, the smallest member and the list of those that end there;
rounds of merges by node, FAN partial tries at a time, add members up and join the lists. The node that all share
thus meets FAN rows a merge, and never the conversations below it.

The rollup goes bottom-up along the paths: a node is carried by its smallest member, which shares each of the node's
ancestors with it. So sums over a conversation's path from its end up to the root, over the nodes it carries, added up
by node over the conversations, are the sums over subtrees. Paths are taken in slices, so none need fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import cut, hinted
from tabveil.llm.turns import ROW_BITS, in_order, word_count

#: Depths of a path that are summed up together.
SLICE = 1024
#: Numbers that one row of an end list may span, so it holds no more ids.
END_SPAN = 4096
#: Partial tries that a round merges into one.
FAN = 16
PARTS = 4
#: Conversations share the first turns of the one whose id is the next lower multiple of EVERY, up to HEADS - 1 of them.
EVERY = 20
HEADS = 4


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, turn_key, words): the turns of each conversation, 1, 2, ..., by turn (null first).

    Rows without conv_id belong to no conversation. Null role and text read as empty. Rows of one turn number are
    taken by role, then by the first 64 characters of the text, then by a hash of both, so texts are not moved; repeated
    rows are turns of their own. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("start"), name.alias("turn_key"), word_count(text).alias("words"))
    rows = in_order(rows, "trie-turns", "role", "start", "turn_key").select("conv_id", F.shiftright("pos", ROW_BITS).alias("part"), "pos", "turn_key", "words")
    runs = rows.groupBy("conv_id", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("less"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("pos") - F.col("less")).alias("nth"), "turn_key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbered turns: (conv_id, depth, turn_key, words) of the rebuilt conversations, and all conv_id. A rebuilt
    conversation c has the first h turns of conversation c - c % EVERY (all if it has fewer, none if there is none), then
    its own from turn h + 1 on; h = crc32 of c in decimal, modulo HEADS."""
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    ids = cut(turns.select("conv_id").distinct(), "trie-ids")
    heads = cut(turns.filter((F.col("conv_id") % EVERY == 0) & (F.col("nth") < HEADS)), "trie-heads").withColumnRenamed("conv_id", "base")
    wants = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"), h(F.col("conv_id")).alias("h"))
    shared = wants.join(heads, "base").filter(F.col("nth") <= F.col("h")).select("conv_id", F.col("nth").alias("depth"), "turn_key", "words")
    has = heads.groupBy("base").agg(F.max("nth").alias("has"))
    short = wants.join(has, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("has", F.lit(0)))).alias("lacking")).filter("lacking > 0")
    own = turns.filter(F.col("nth") > h(F.col("conv_id"))).join(hinted(cut(short, "trie-short")), "conv_id", "left")
    own = own.select("conv_id", (F.col("nth") - F.coalesce("lacking", F.lit(0))).alias("depth"), "turn_key", "words")
    return shared.unionByName(own), ids


def _from_slices(rows: DataFrame, sums: list[str], downwards: bool, label: str) -> DataFrame:
    """Running sums of the columns over the path of each conversation, up to each depth or (downwards false) from it on.
    A slice's own sum stands in the row at its far edge, so slices are added up without another pass."""
    rows = rows.withColumn("slice", F.floor(F.col("depth") / SLICE))
    order = F.col("depth").asc() if downwards else F.col("depth").desc()
    inside = Window.partitionBy("conv_id", "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.select(*[c for c in rows.columns if c not in sums], *[F.sum(c).over(inside).alias(c) for c in sums]), label)
    edges = rows.filter(F.col("depth") % SLICE == SLICE - 1) if downwards else rows.filter((F.col("depth") % SLICE == 0) & (F.col("slice") > 0))
    step = 1 if downwards else -1
    upto = Window.partitionBy("conv_id").orderBy(F.col("slice") * step).rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.select("conv_id", (F.col("slice") + step).alias("slice"), *[F.sum(c).over(upto).alias(f"{c}_before") for c in sums])
    rows = rows.join(hinted(cut(edges, f"{label}-edges")), ["conv_id", "slice"], "left")
    return rows.select(*[c for c in rows.columns if c not in sums and c != "slice" and not c.endswith("_before")], *[(F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in sums])


def _packed(h: list[Column]) -> tuple[Column, Column]:
    """Four sums as two numbers of 63 bits."""
    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda c: F.shiftleft(c.bitwiseAND(F.lit((1 << 31) - 1)), 32)
    return high(h[0]).bitwiseOR(low(h[1])), high(h[2]).bitwiseOR(low(h[3]))


def paths(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, words): the nodes on each conversation's path, root included; (a, b) names the
    node, (up_a, up_b) its parent, null for the root."""
    h = [f"h{k}" for k in range(PARTS)]
    name = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "turn_key").cast("binary"), 256)
    steps = steps.withColumn("name", name)
    for k in range(PARTS):
        steps = steps.withColumn(h[k], F.conv(F.substring("name", 8 * k + 1, 8), 16, 10).cast("long")).withColumn(f"own{k}", F.col(h[k]))
    summed = _from_slices(steps.drop("name", "turn_key"), h, True, "trie-sums")
    a, b = _packed([F.col(c) for c in h])
    up_a, up_b = _packed([F.col(c) - F.col(f"own{k}") for k, c in enumerate(h)])
    found = summed.select("conv_id", "depth", a.alias("a"), b.alias("b"), up_a.alias("up_a"), up_b.alias("up_b"), "words")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"))
    return cut(root.unionByName(found), "trie-paths")


def _merged(partial: DataFrame, keys: list[str], sums: list[Column]) -> DataFrame:
    """Partial tables, numbered by trie, merged FAN at a time until there is one."""
    n = (partial.agg(F.max("trie")).first()[0] or 0) + 1
    while True:
        partial = partial.withColumn("trie", F.floor(F.col("trie") / FAN)).groupBy("trie", *keys).agg(*sums)
        n = -(-n // FAN)
        if n == 1:
            return partial.drop("trie")


def _ends(found: DataFrame) -> DataFrame:
    """(a, b, span, ids): the conversations that end in a node, in lists of ids of one span of END_SPAN numbers."""
    last = found.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("at"))
    last = last.select("at.a", "at.b", F.floor(F.col("conv_id") / END_SPAN).alias("span"), F.array("conv_id").alias("ids"))
    joined = F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")
    return _merged(cut(last.withColumn("trie", F.spark_partition_id()), "trie-ends"), ["a", "b", "span"], [joined])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and span: the SHA-256 of each node's pieces, comma-joined, as they stream by."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "piece")], strict=True):
            if (a, b) == node:
                state.update(b"," + piece.encode())
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(piece.encode())
        yield _rows(out)
    if node is not None:
        yield _rows([(*node, state.hexdigest())])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, h = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], names=["a", "b", "ends_sha256"])


def prefix_trie(steps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of steps (conv_id, depth, turn_key, words; depths 1, 2, ... of each conversation) and of all ids
    (conv_id, distinct; those without steps end in the root): nodes and end lists.

    Nodes: a, b (name), up_a, up_b (the parent's), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens. End lists: a, b, span, ids; see _ends. No ids, no nodes.
    """
    found = paths(steps, ids)
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("depth", "up_a", "up_b", "words")]]
    partial = found.withColumn("trie", F.spark_partition_id()).withColumn("n_convs", F.lit(1).cast("long"))
    nodes = cut(_merged(partial, ["a", "b"], sums), "trie-merged")
    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    carried = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    path = found.select("conv_id", "depth", "a", "b").join(carried, ["conv_id", "depth"], "left").fillna(0, ["saved_tokens", "n_leaves"])
    path = _from_slices(path, ["saved_tokens", "n_leaves"], False, "trie-rollup").filter("saved_tokens > 0 or n_leaves > 0")
    below = path.groupBy("a", "b").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["up_a", "up_b"], "left").join(below, ["a", "b"], "left").fillna(0, ["saved_tokens", "n_leaves"])
    columns = ("a", "b", "up_a", "up_b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(*columns), _ends(found)


def with_end_hashes(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes and ends_sha256, the SHA-256 of the ids that end in each, ascending and comma-joined."""
    pieces = ends.select("a", "b", "span", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("piece"))
    hashes = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "span").mapInArrow(_hashed, "a long, b long, ends_sha256 string")
    return nodes.join(hashes, ["a", "b"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see numbered, rebuilt, prefix_trie), with end hashes. An empty
    table, or one without conv_id, gives an empty result."""
    nodes, ends = prefix_trie(*rebuilt(cut(numbered(conversations), "trie-numbered")))
    return with_end_hashes(nodes, ends).drop("a", "b", "up_a", "up_b")
