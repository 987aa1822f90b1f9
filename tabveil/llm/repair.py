"""Repair of the turn structure of conversations, by dynamic programming over ranks instead of audit strings.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles. Per turn one macro edit is taken: a run of
inserts, then the turn's own edit (Delete, Keep, Rerole). Macro edits are written in a prefix-free code whose order is
that of the audit strings, so of two audits over the same turns the first different macro decides. A layer therefore
keeps, for each of four states (start, after s, after u, after a), only the least cost, the rank of its audit among the
four, and a parent; the strings are written down once, afterwards.

Turns are numbered over the whole table by a range sort; blocks of BLOCK consecutive rows are summarised for each state
they may start in, the summaries of a conversation are folded, and each block is then walked back from the state it
ends in. So no task holds a conversation, however long; what follows the order of its texts (a hash of them) streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import cut, small_batches
from tabveil.llm.turns import in_order

SPACES = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Rows of a block; a power of two.
BLOCK_BITS = 16
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
#: The initial of a role other than s (0), u (1) and a (2).
OTHER = 3
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Macro edits in the order of their audit strings; none is the beginning of another.
MACROS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
NEVER = 1 << 40
RANK_BITS, CODE_BITS = 2, 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _inserted(state: int) -> int:
    return AFTER_A if state == AFTER_U else AFTER_U


def role_after(state: int) -> str:
    """The role that an insert or a rerole takes in a state."""
    return "assistant" if state == AFTER_U else "user"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and code of the best macro edit by class of turn (initial x fault), state before and state after."""
    cost = np.full((4, 4, STATES, STATES), NEVER, dtype=np.int64)
    code = np.zeros((4, 4, STATES, STATES), dtype=np.int64)

    def offer(initial, fault, p, q, c, macro):
        if (c, MACROS.index(macro)) < (cost[initial, fault, p, q], code[initial, fault, p, q]):
            cost[initial, fault, p, q], code[initial, fault, p, q] = c, MACROS.index(macro)

    for initial in range(4):
        for fault in range(4):
            for p in range(STATES):
                state = p
                for n in range(3):  # a longer run comes back to a state it has been in
                    run = "I" * n
                    offer(initial, fault, p, state, INSERT * n + DELETE, run + "D")
                    if fault in (FINE, CUT_OFF):
                        more = INSERT * n + TRUNCATED * (fault == CUT_OFF)
                        offer(initial, fault, p, _inserted(state), more + REROLE, run + "R")
                        keeps = {0: AFTER_S if state == START else None, 1: AFTER_U if state != AFTER_U else None, 2: AFTER_A if state == AFTER_U else None}
                        if keeps.get(initial) is not None:
                            offer(initial, fault, p, keeps[initial], more, run + "K")
                    state = _inserted(state)
    return cost.reshape(16, STATES, STATES), code.reshape(16, STATES, STATES)


COST, CODE = _tables()
#: Inserts that end a conversation, by its last state.
TAIL = (0, 2, 1, 0)
LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[0, 1] = LEGAL[1, 2] = LEGAL[2, 1] = True


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a hash of `conv_id:turn`: of twenty, 0 drops the row, 1 empties
    its text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes it the user's. Nulls read as one space; conv_id and
    turn keep theirs."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    """A conversation's key; null is a conversation, too."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _of_key(key: Column, kind: str) -> Column:
    return F.when(key != "n", F.substring(key, 2, 1 << 30)).cast(kind)


def ordered(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, pos): rows by conversation and turn (null first), of one turn by role, then text."""
    placed = rows.select(_key(F.col("conv_id")).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return in_order(placed, "repair-turns", "role", "text").withColumnRenamed("conv_id", "key")


def with_faults(turns: DataFrame) -> DataFrame:
    """(key, block, pos, initial, fault) of ordered turns. The first fault of blank, duplicate (role and text seen
    earlier) and truncated counts; null role and text read as empty here."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    kept = F.rtrim(text, F.lit(SPACES))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(OTHER)
    looks = F.when(kept == "", BLANK).when(~F.contains(F.lit(ENDINGS), F.right(kept, F.lit(1))), CUT_OFF).otherwise(FINE)
    rows = cut(turns.select("key", "pos", name.alias("name"), initial.alias("initial"), looks.alias("looks")), "repair-looks")
    # Found again by pos, which is unique, so a text that a third of all rows repeat makes no hot key.
    first = rows.groupBy("key", "name").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when((F.col("looks") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("looks"))
    return rows.join(first, "pos", "left").select("key", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", F.col("initial").cast("int").alias("initial"), fault.alias("fault"))


def _step(cost: np.ndarray, rank: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A layer: cost and rank by (block, entry, state), and the parents of the new states."""
    shape = (len(classes), 1, STATES, STATES)
    total = cost[..., None] + COST[classes].reshape(shape)
    order = (total << (RANK_BITS + CODE_BITS)) | (rank[..., None] << CODE_BITS) | CODE[classes].reshape(shape)
    parent = order.argmin(axis=2)
    best = np.take_along_axis(order, parent[:, :, None, :], axis=2)[:, :, 0, :]
    low = best & ((1 << (RANK_BITS + CODE_BITS)) - 1)
    return np.minimum(best >> (RANK_BITS + CODE_BITS), NEVER), (low[..., :, None] > low[..., None, :]).sum(axis=-1), parent


def _forward(classes: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, parents: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks at the ends of blocks. entry: states by (block, entry). Blocks are in descending order of length."""
    cost = np.full((*entry.shape, STATES), NEVER, dtype=np.int64)
    np.put_along_axis(cost, entry[..., None], 0, axis=2)
    rank = np.zeros_like(cost)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))  # blocks longer than t
        cost[:n], rank[:n], parent = _step(cost[:n], rank[:n], classes[start[:n] + t])
        if parents is not None:
            parents[start[:n] + t] = parent[:, 0]
    return cost, rank


def edits_of(classes: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before and the code of each row's macro edit, for blocks with known entries and exits."""
    parents = np.zeros((len(classes), STATES), dtype=np.int8)
    _forward(classes, start, length, entry[:, None], parents)
    before, code, state = np.zeros(len(classes), dtype=np.int64), np.zeros(len(classes), dtype=np.int64), exit_.copy()
    for t in range((int(length[0]) if len(length) else 0) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = start[:n] + t
        p = parents[at, state[:n]].astype(np.int64)
        before[at], code[at] = p, CODE[classes[at], p, state[:n]]
        state[:n] = p
    return before, code


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole blocks."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pc.and_(pc.equal(batch.column("key"), batch.column("key")[-1]), pc.equal(batch.column("block"), batch.column("block")[-1]))
        if kept and (kept[-1].column("key")[-1], kept[-1].column("block")[-1]) == (batch.column("key")[-1], batch.column("block")[-1]):
            kept.append(batch)
            continue
        first = batch.num_rows - same.true_count
        done = pa.Table.from_batches([*kept, batch.slice(0, first)])
        if done.num_rows:
            yield done
        kept = [batch.slice(first)]
    if kept:
        yield pa.Table.from_batches(kept)


def _starts(table: pa.Table) -> np.ndarray:
    keys, blocks = (table.column(c).combine_chunks() for c in ("key", "block"))
    new = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1]).astype(np.int64)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


SUMMARY = "key string, block long, first int, last int, illegal long, blank long, duplicate long, truncated long, cost array<bigint>, rank array<bigint>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: counts, and cost and rank by state at its start and at its end."""
    for table in _by_block(batches):
        initial, fault, start = _numbers(table, "initial"), _numbers(table, "fault"), _starts(table)
        length = np.diff(np.append(start, len(initial)))
        bad = np.concatenate([[False], ~LEGAL[initial[:-1], initial[1:]]])
        bad[start] = False
        order = np.argsort(-length, kind="stable")
        entry = np.tile(np.arange(STATES), (len(start), 1))
        cost, rank = _forward(initial * 4 + fault, start[order], length[order], entry)
        back = np.argsort(order)
        counts = [np.add.reduceat(x.astype(np.int64), start) for x in (bad, fault == BLANK, fault == DUPLICATE, fault == CUT_OFF)]
        lists = [list(x[back].reshape(len(start), -1)) for x in (cost, rank)]
        ends = [initial[start].astype(np.int32), initial[start + length - 1].astype(np.int32)]
        keys = [table.column(c).combine_chunks().take(pa.array(start)) for c in ("key", "block")]
        yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, ends), *map(pa.array, counts), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=[c.split()[0] for c in SUMMARY.split(", ")])


FOLDED = "key string, block long, entry int, exit int, tail int, cost long, blank long, duplicate long, truncated long, illegal long"


def _fold(blocks: list[dict]) -> list[tuple]:
    """The states in which each block of a conversation starts and ends; the last has the conversation's numbers."""
    cost, rank, parents = [0, NEVER, NEVER, NEVER], [0] * STATES, []
    illegal = sum(b["illegal"] for b in blocks)
    illegal += sum(not LEGAL[x["last"], y["first"]] for x, y in zip(blocks[:-1], blocks[1:], strict=True))
    for b in blocks:
        best = [min((cost[p] + b["cost"][4 * p + q], rank[p], b["rank"][4 * p + q], p) for p in range(STATES)) for q in range(STATES)]
        audits = sorted({x[1:3] for x in best})
        cost, rank = [min(x[0], NEVER) for x in best], [audits.index(x[1:3]) for x in best]
        parents.append([x[3] for x in best])
    total, _, tail, state = min((cost[q] + INSERT * TAIL[q], rank[q], TAIL[q], q) for q in range(STATES))
    out, counts = [], [sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")]
    for b, parent in zip(reversed(blocks), reversed(parents), strict=True):
        last = not out
        out.append((b["key"], b["block"], parent[state], state, tail if last else 0, *([total, *counts, illegal] if last else [None] * 5)))
        state = parent[state]
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FOLDED.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "key" else pa.int32() if n in ("entry", "exit", "tail") else pa.int64()) for n in names])
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    blocks: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if blocks and blocks[-1]["key"] != row["key"]:
                out += _fold(blocks)
                blocks = []
            blocks.append(row)
        if out:
            yield made(out)
    if blocks:
        yield made(_fold(blocks))


EDITS = "key string, block long, pos long, before int, macro string, tail int, piece string"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per turn its macro edit and the state before it; a block's first row has the block's audit."""
    for table in _by_block(batches):
        start = _starts(table)
        pos, entry, exit_, tail = (_numbers(table, c) for c in ("pos", "entry", "exit", "tail"))
        turns = np.ones(table.num_rows, dtype=bool)
        turns[start] = False  # the folded row comes first
        heads = start - np.arange(len(start))
        classes = (_numbers(table, "initial") * 4 + _numbers(table, "fault"))[turns]
        length = np.diff(np.append(heads, len(classes)))
        order = np.argsort(-length, kind="stable")
        before, code = edits_of(classes, heads[order], length[order], entry[start][order], exit_[start][order])
        macros = [MACROS[c] for c in code]
        tails, pieces = np.zeros(len(classes), dtype=np.int64), [None] * len(classes)
        for h, n, t in zip(heads.tolist(), length.tolist(), tail[start].tolist(), strict=True):
            tails[h + n - 1] = t
            pieces[h] = "".join(macros[h : h + n]) + "I" * t
        keys = [table.column(c).combine_chunks().filter(pa.array(turns)) for c in ("key", "block")]
        numbers = [pa.array(pos[turns]), pa.array(before, pa.int32()), pa.array(macros, pa.string()), pa.array(tails, pa.int32()), pa.array(pieces, pa.string())]
        yield pa.RecordBatch.from_arrays([*keys, *numbers], names=[c.split()[0] for c in EDITS.split(", ")])


@dataclass
class Repair:
    """turns: (key, turn, role, text, pos) as given, in order. edits: the macro edit of each. conversations: a row each
    with key, cost, blank, duplicate, truncated, illegal."""

    turns: DataFrame
    edits: DataFrame
    conversations: DataFrame
    id_type: str

    def audits(self) -> DataFrame:
        """(key, audit): pieces of up to 2^BLOCK_BITS turns, end to end."""
        pieces = self.edits.filter("piece is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))
        return pieces.select("key", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("audit"))

    def _streamed(self, function: Callable, schema: str, *by: str) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        block = F.shiftright("pos", BLOCK_BITS).alias("block")
        rows = self.turns.select("key", block, "pos", F.lit(1).alias("kind"), "role", "text", none("int").alias("before"), none("string").alias("macro"), none("int").alias("tail"))
        edits = self.edits.select("key", "block", "pos", F.lit(0).alias("kind"), none("string").alias("role"), none("string").alias("text"), "before", "macro", "tail")
        return rows.unionByName(edits).repartition(*by).sortWithinPartitions("pos", "kind").mapInArrow(function, schema)

    def repaired(self) -> DataFrame:
        """(conv_id, pos, nth, role, text): the turns of the repaired conversations; pos and nth order them, pos is that of
        the turn at, before or after (the last) which a turn was inserted."""
        out = self._streamed(_repaired, "key string, pos long, nth int, role string, text string", "key", "block")
        return out.select(_of_key(F.col("key"), self.id_type).alias("conv_id"), "pos", "nth", "role", "text")

    def digests(self) -> DataFrame:
        """(key, repaired_sha256): SHA-256 of `role:text` of the repaired turns, newline-joined, as they stream by."""
        return self._streamed(_digests, "key string, repaired_sha256 string", "key")


def _repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(key, pos, nth, role, text); role None for a conversation of which nothing is left so far."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                state, macro, tail = row["before"], row["macro"], row["tail"]
                continue
            key, pos, nth = row["key"], row["pos"], 0
            yield key, pos, -1, None, None
            for edit in macro + "I" * tail:
                if edit in "IR":
                    yield key, pos, nth, role_after(state), "" if edit == "I" else row["text"] or ""
                    state = _inserted(state)
                elif edit == "K":
                    role = row["role"] or ""
                    yield key, pos, nth, role, row["text"] or ""
                    state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
                nth += edit != "D"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("nth", pa.int32()), ("role", pa.string()), ("text", pa.string())])
    for batch_rows in _chunked(t for t in _repaired_turns(batches) if t[3] is not None):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch_rows, strict=True), schema, strict=True)], schema=schema)


def _chunked(rows: Iterator[tuple], most: int = 1 << 20) -> Iterator[list[tuple]]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashes():
        known, state, empty = None, None, True
        for key, _, _, role, text in _repaired_turns(batches):
            if key != known:
                if known is not None:
                    yield known, state.hexdigest()
                known, state, empty = key, hashlib.sha256(), True
            if role is not None:
                state.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
        if known is not None:
            yield known, state.hexdigest()

    for out in _chunked(hashes()):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["key", "repaired_sha256"])


def repair(rows: DataFrame) -> Repair:
    """The cheapest edits of rows (conv_id, turn, role, text) after which each conversation's roles read `(s?(ua)+)?` by
    their initials; of equally cheap ones those whose audit comes first in ASCII order.

    Keep costs nothing, Rerole (to user or assistant) 3, Insert (an empty user or assistant turn) 3, Delete 4; blank and
    duplicate turns must be deleted; a truncated turn that stays costs 3 more. Rows are taken by turn (null first), of one
    turn number by role, then text. Null conv_id is a conversation of its own; null role and text read as empty. Other
    columns are ignored; an empty table gives empty results.
    """
    small_batches(rows.sparkSession)
    turns = ordered(rows)
    flags = cut(with_faults(turns), "repair-flags")
    sums = flags.repartition("key", "block").sortWithinPartitions("pos").mapInArrow(_summaries, SUMMARY)
    folded = cut(sums.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_folded, FOLDED), "repair-folded")
    none = F.lit(None).cast("int")
    both = flags.select("*", *[none.alias(c) for c in ("entry", "exit", "tail")])
    heads = folded.select("key", "block", F.lit(-1).cast("long").alias("pos"), none.alias("initial"), none.alias("fault"), "entry", "exit", "tail")
    both = both.fillna(0, ["entry", "exit", "tail"]).unionByName(heads.fillna(0, ["initial", "fault"]))
    walked = both.repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInArrow(_walked, EDITS)
    conversations = folded.filter("cost is not null").select("key", "cost", "blank", "duplicate", "truncated", "illegal")
    return Repair(turns, cut(walked, "repair-edits"), conversations, dict(rows.dtypes)["conv_id"])


def gaps(turns: DataFrame) -> DataFrame:
    """(key, gaps): turn numbers between the least and the greatest that no row has; nulls aside."""
    each = turns.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return each.select("key", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations, on the repair of rows: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. Conversations without rows have zeros and the hash of nothing."""
    done = repair(rows)
    ids = conversations.select(_key(F.col("conv_id")).alias("key")).distinct()
    out = ids
    for part in (gaps(done.turns), done.conversations, done.audits(), done.digests()):
        out = out.join(part, "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = out.fillna(0, list(counts)).fillna({"audit": "", "repaired_sha256": EMPTY_SHA})
    return out.select(_of_key(F.col("key"), done.id_type).alias("conv_id"), *counts, "audit", "repaired_sha256")
