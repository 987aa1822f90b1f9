"""Structure repair and the prefix trie against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabveil.llm import prefix_trie, queries, repair
from tabveil.llm.common import read_table

DATA = "/root/testdata/sf0.001"
ROW = "conv_id long, turn int, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def nulls_first(x):
    return (x is not None, x if x is not None else 0)


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        kept = text.rstrip(BLANKS)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired) of (role, text) turns, with whole strings for states of the grammar."""
    best = {"": (0, "", ())}
    for (role, text), fault in zip(turns, faults(turns), strict=True):
        new = {}
        for state, (cost, audit, out) in best.items():
            for n in range(4):
                c, a, o, s = cost + 3 * n, audit + "I" * n, list(out), state
                for _ in range(n):
                    s = "a" if s == "u" else "u"
                    o.append(({"u": "user", "a": "assistant"}[s], ""))
                options = [(c + 4, a + "D", tuple(o), s)]
                if fault not in ("blank", "duplicate"):
                    more, wanted = c + 3 * (fault == "truncated"), "a" if s == "u" else "u"
                    options.append((more + 3, a + "R", (*o, ({"u": "user", "a": "assistant"}[wanted], text)), wanted))
                    if role[:1] and (role[0] == wanted or (role[0] == "s" and s == "")):
                        options.append((more, a + "K", (*o, (role, text)), role[0]))
                for x in options:
                    if x[3] not in new or x[:2] < new[x[3]][:2]:
                        new[x[3]] = x[:3]
        best = new
    ended = []
    for state, (cost, audit, out) in best.items():
        tail = {"": (), "a": (), "u": (("assistant", ""),), "s": (("user", ""), ("assistant", ""))}[state]
        ended.append((cost + 3 * len(tail), audit + "I" * len(tail), (*out, *tail)))
    return min(ended, key=lambda x: x[:2])


def report(rows):
    """The report of (conv_id, turn, role, text) rows, by conversation."""
    by, out = defaultdict(list), {}
    for c, turn, role, text in rows:
        by[c].append((nulls_first(turn), role or "", text or ""))
    for c, group in by.items():
        group.sort()
        turns, numbers = [x[1:] for x in group], sorted({x[0][1] for x in group if x[0][0]})
        cost, audit, repaired = cheapest(turns)
        f, ini = faults(turns), [r[:1] for r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gap = numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0
        out[c] = (gap, *[f.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(seed, n_convs=40, longest=9):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Up"]
    texts = ["Hi.", "Well", "no end", "Yes!", " \t", "", None, "a\n", "What? ", "é", "\x00.", "\xa0"]
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None, 0]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block_bits", [16, 1])
def test_repair_equals_plain_python(spark, monkeypatch, block_bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", block_bits)
    rows = random_rows(3) + [(7, 0, "user", "Hi.")] * 3
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "'x' as KEY", "1 as pos")
    ids = spark.createDataFrame([(99, 0, "user", "x"), (99, 1, "user", "y"), *rows], ROW)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(ids, df).collect()}
    assert got == {99: NOTHING, **report(rows)}
    turns = defaultdict(list)
    for r in repair.repair(df).repaired().orderBy("conv_id", "pos", "nth").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == got[c][-1] for c in got)


def test_repair_of_a_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rng = random.Random(1)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "two", f"{t}!", ""])) for t in range(700)] + random_rows(8, 10)
    df = spark.createDataFrame(rows, ROW).repartition(7)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(df, df).collect()}
    assert got == report(rows)


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], ROW)
    assert repair.repair_report(df, df).count() == 0
    some = spark.createDataFrame([(1, None, None, None)], ROW)
    assert [tuple(r) for r in repair.repair_report(some, df).collect()] == [(1, *NOTHING)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x"]), st.sampled_from(["Hi.", "cut", "", "Oh!"])), max_size=7))
def test_ranks_stand_for_strings(turns):
    """Layers of ranks give the audit that comparing whole strings gives, block by block."""
    kinds = {"": repair.FINE, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT_OFF}
    classes = np.array(["sua".find(r) % 4 * 4 + kinds[f] for (r, _), f in zip(turns, faults(turns), strict=True)], dtype=np.int64)
    cost, audit, _ = cheapest(turns)
    for size in (2, 100):
        parts = [classes[i : i + size] for i in range(0, len(classes), size)]
        blocks = []
        for i, part in enumerate(parts):
            c, r = repair._forward(part, np.array([0]), np.array([len(part)]), np.arange(4)[None, :])
            blocks.append({"key": "k", "block": i, "first": 0, "last": 0, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "cost": c.reshape(-1).tolist(), "rank": r.reshape(-1).tolist()})
        if not blocks:
            continue
        folded, text = sorted(repair._fold(blocks), key=lambda x: x[1]), ""
        for part, (_, _, entry, exit_, tail, *_) in zip(parts, folded, strict=True):
            _, code = repair.edits_of(part, np.array([0]), np.array([len(part)]), np.array([entry]), np.array([exit_]))
            text += "".join(repair.MACROS[x] for x in code) + "I" * tail
        assert (folded[-1][5], text) == (cost, audit)


def test_macro_codes_are_prefix_free_and_in_order():
    assert list(repair.MACROS) == sorted(repair.MACROS)
    assert not any(b.startswith(a) for a, b in itertools.permutations(repair.MACROS, 2))


def damage(rows):
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        yield from [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_op11_query(spark):
    rows = [tuple(r) for r in read_table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: NOTHING for c, *_ in rows} | report(damage(rows))
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_repair(spark, DATA).collect()} == want


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(12)) for r in (None, "assistant") for x in (None, "A. b? c!")]
    got = sorted(map(repr, map(tuple, repair.damaged(spark.createDataFrame(rows, ROW)).collect())))
    assert got == sorted(map(repr, damage(rows)))


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((nulls_first(turn), role, text[:64], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    own = {c: [(x[1], x[4]) for x in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(k) == len(n) + 1 and k[:-1] == n for k in members)
        words = lambda n: len([w for w in n[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if n else 0
        saved = sum((len(members[n]) - 1) * words(n) for n in below)
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(repr, out))


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(seed):
    rng = random.Random(seed)
    texts = ["one two", "three", "", None, "four  five\tsix", "x " * 70 + "y", "x " * 70 + "z"]
    rows = [(c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(-25, 70), None, 10**12] for t in range(rng.randint(0, 6))]
    return rows + [(20, 50, "user", "same")] * 2


@pytest.mark.parametrize(("cut_at", "span", "fan"), [(1024, 4096, 16), (2, 3, 2)])
def test_trie_equals_plain_python(spark, monkeypatch, cut_at, span, fan):
    for name, value in (("SLICE", cut_at), ("END_SPAN", span), ("FAN", fan)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = trie_rows(2)
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as DEPTH", "'z' as a").repartition(5)
    got = prefix_trie.conversation_trie(df)
    assert sorted(got.columns) == sorted(NODE)
    assert sorted(repr(tuple(r)) for r in got.select(*NODE).collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], ROW)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], ROW)).count() == 0


def test_op13_query(spark):
    rows = [tuple(r) for r in read_table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op13_trie(spark, DATA).select(*NODE).collect()) == plain_trie(rows)
