"""Decontamination, PII, tokens and quality on small tables, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tabveil.llm import decontaminate, pii, quality, tokens

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute_hits(text, items):
    words, hit, of = WORD.findall(fold(text)), set(), set()
    for item, t in items:
        w = WORD.findall(fold(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    of.add(str(item))
    return len(words), len(hit), sorted(of)


def test_long_items_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 400)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 10)
    words = [f"w{i}" for i in range(200)]
    items = [("a", " ".join(words)), ("b", " ".join(words[:20]))]
    docs = [(k, " ".join(words[k : k + 13 + k % 3])) for k in range(187)]
    out = decontaminate.contaminated(decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")))
    assert sorted((r["decon_words"], r["decon_hit"], r["decon_items"]) for r in out.collect()) == sorted(brute_hits(t, items) for _, t in docs)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["Äpfel", "b2", "c", "dog", "E"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ". "]) for _ in range(n))
    items = [(i, text(rng.randint(0, 16))) for i in range(12)] + [(3, "dog dog"), (90, None), (91, "-- --"), (None, "c"), (92, "dog")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(7, None), (7, "dog"), (8, ""), (9, items[2][1].upper() + " tail"), (9, items[2][1].upper() + " tail"), (None, "x " * 30_000 + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'old' as Decon_Hits", "5 as n_hit", "6 as Contaminated")
    b = spark.createDataFrame(items, "item_id long, text string")
    expect = sorted(brute_hits(t, [x for x in items if x[0] is not None]) for _, t in docs)
    for size in (decontaminate.AUTOMATON_BYTES, 60):  # the second makes several automata
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", size)
        out = decontaminate.contaminated(decontaminate.find_contamination(d, b)).collect()
        assert sorted((r["decon_words"], r["decon_hit"], r["decon_items"]) for r in out) == expect
        assert all(r["n_hit"] == 5 for r in out)
        for r in out:
            for (a, e), (x, y) in zip(r["decon_spans"], r["decon_hits"], strict=True):
                assert WORD.findall(fold(r["text"][a:e])) == WORD.findall(fold(r["text"]))[x:y]
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0
    assert all(r["decon_hits"] == [] for r in decontaminate.find_contamination(d, b.limit(0)).collect())


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_fixed_patterns_against_regex():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1@.-+ (é4 9.@_%)") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("card 4111 1111 1111 1111.") == [(5, 24, "card")]
    assert pii.base_spans("9" * 20_000) == []


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"Please call me at +1 (555) 010-{1000 + i} today or not.") for i in range(8)]
    rows += [(100, "Please call me at 555-010-7777 today or not."), (101, "Lot 12345 is here, 99.5 left."), (102, None), (103, ""), (100, "Please call me at 555-010-7777 today or not."), (104, "x" * 50_000 + " a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as Spans", "2 as new", "3 as uses", "4 as pii_row", "5 as Base", "6 as row")
    out = pii.find_pii(docs)
    assert out.columns == ["doc_id", "new", "uses", "pii_row", "row", "base", "spans"]
    out = out.collect()
    assert all((r["new"], r["uses"], r["pii_row"], r["row"]) == (2, 3, 4, 6) for r in out)
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        base = [(s["start"], s["end"], s["kind"]) for s in r["base"]]
        assert base == brute_pii(text[r["doc_id"]] or "")
        assert set(base) <= {(s["start"], s["end"], s["kind"]) for s in r["spans"]}
    assert all([(s["start"], s["end"], s["kind"]) for s in r["spans"]] == [(18, 30, "phone")] for r in out if r["doc_id"] == 100)
    assert all(not r["spans"] for r in out if r["doc_id"] in (101, 102, 103))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[0] == "Please call me at [PHONE] today or not." == redacted[100]
    assert redacted[101] == text[101] and redacted[102] is None and redacted[104].endswith(" [EMAIL]")
    assert pii.redact(docs).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()


def test_secrets_are_found_by_their_context(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'so it is token = "{key(i)}" and on') for i in range(8)]
    rows += [(100, 'then TOKEN = "a1b2c3d4e5"### of'), (101, f"the commit {key(101)} is clean"), (102, f"checksum {key(102)}"), (103, f"token = {key(103)}")]
    rows += [(104, f"{key(3)} alone")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, found = dict(rows), {r["doc_id"]: r["spans"] for r in out}
    assert all(not r["base"] for r in out)
    for i in (*range(8), 103, 104):
        assert [(text[i][s["start"] : s["end"]], s["kind"]) for s in found[i]] == [(key(3 if i == 104 else i), "secret")], i
    assert [(s["start"], s["end"], s["kind"]) for s in found[100]] == [(14, 24, "secret")]
    assert not found[101] and not found[102]


def brute_graph(uses, rounds, least_seeds, least):
    """confident_instances over a list of (kind or None, instance, pattern), in plain Python."""
    edges = {(p, i, k or "") for k, i, p in uses}
    degree = collections.Counter(p for p, _, _ in edges)
    seeds = collections.Counter((p, k) for p, _, k in edges if k)
    unseen = {(p, i) for p, i, k in edges if not k}
    scores = {pk: (n, n / degree[pk[0]]) for pk, n in seeds.items()}

    def beliefs(pairs):
        miss = {}
        for p, i in pairs:
            for (q, k), (support, c) in scores.items():
                if p == q and support >= least_seeds and c >= least / 2:
                    miss[i, k] = miss.get((i, k), 1.0) * (1 - min(c, 0.999))
        return {ik: 1 - m for ik, m in miss.items()}

    for _ in range(rounds):
        b, gain, found = beliefs(unseen), collections.Counter(), collections.Counter()
        for p, i in unseen:
            for (j, k), x in b.items():
                if i == j:
                    gain[p, k] += x
                    found[p, k] += x >= least
        scores = {pk: (seeds[pk] + found[pk], (seeds[pk] + gain[pk]) / degree[pk[0]]) for pk in {*seeds, *gain}}
    return {ik: x for ik, x in beliefs({(p, i) for p, i, k in edges if k in ("", "secret")}).items() if x >= least}


@pytest.mark.parametrize("seed", range(3))
def test_the_graph_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    uses = [(rng.choice(["phone", "card", "secret", None, None]), f"i{rng.randint(0, 40)}", f"p{rng.randint(0, 12)}") for _ in range(150)]
    got = pii.confident_instances(spark.createDataFrame(uses, "kind string, instance string, pattern string"), 3, 2, 0.4).collect()
    want = brute_graph(uses, 3, 2, 0.4)
    assert len(got) == len(want) > 0
    assert all(abs(want[r["instance"], r["kind"]] - r["confidence"]) < 1e-9 for r in got)


def test_found_identifiers_are_found_elsewhere_and_find_others(spark):
    rows = [(i, f"Please call me at +1 (555) 010-{1000 + i} today or not.") for i in range(30)]
    rows += [(100 + i, f"Please call me at 555-010-777{i} today or not.") for i in range(4)]
    rows += [(200 + i, f"Her mobile is 555-010-777{i} as ever.") for i in range(4)]
    rows += [(300, "Her mobile is 555-010-9999 as ever."), (301, "555-010-7770"), (302, "Lot 12345 is here.")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in out}
    assert all(found[i] == [(14, 26, "phone")] for i in (200, 201, 202, 203, 300))
    assert found[301] == [(0, 12, "phone")] and not found[302]


def test_identifiers_in_groups_are_found(spark):
    forms = ["(555) 010-7777", "555 010 7777", "[55] 0107 77", "4111 1111 1111 1112", "12-34 56.78"]
    rows = [(i, f"Please call me at +1 (555) 010-{1000 + i} today or not.") for i in range(60)]
    rows += [(100 + i, f"Please call me at {f} today or not.") for i, f in enumerate(forms)]
    rows += [(200, "Please call me at " + "7" * 300 + " today or not."), (201, "Please call me at 55, 010 7 today")]
    text = dict(rows)
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(redacted[i] == "Please call me at [PHONE] today or not." for i in text if i < 201)
    assert pii._tokens("a (555) 010-7777, b (12 34) c 1, 2 345. 6", []) == [(8, 16), (2, 16), (20, 27), (33, 38)]
    assert pii.contexts("x" * 100 + " " + "y" * 100 + " 1234 z", 202, 206)[0] == f"{'x' * 100} {'y' * 100} _"


PIECES = ["▁", "a", "b", "ab", "▁ab", "ba", "▁a", "aba", "é", "bb"]


def test_trie_counts_equal_plain_dynamic_programming():
    rng = random.Random(3)
    vocabulary = tokens.Vocabulary(PIECES)
    words = sorted({"▁" + "".join(rng.choice("abéx😀") for _ in range(rng.randint(0, 12))) for _ in range(500)} | {"▁" + "ab" * 100}, key=lambda w: rng.random())
    assert vocabulary.count(words).tolist() == [vocabulary.count_one(w) for w in words]
    assert vocabulary.count([]).tolist() == []


def exhaustive(vocabulary, word):
    best = {0: [(0, 0)]}
    for i in range(len(word)):
        for score, n in best.get(i, []):
            steps = [(j, vocabulary.pieces[word[i:j]], 1) for j in range(i + 1, len(word) + 1) if word[i:j] in vocabulary.pieces]
            if word[i] not in vocabulary.pieces:
                steps.append((i + 1, vocabulary.unknown, len(word[i].encode())))
            for j, s, k in steps:
                best.setdefault(j, []).append((score + s, n - k))
    return -max(best[len(word)])[1]


def test_token_counts_with_names_in_another_case(spark):
    frame = spark.createDataFrame([(1, "a b", 5)], "doc_id long, TEXT string, N_TOKENS int")
    out = tokens.count_tokens(frame, ["▁a", "▁b", "▁"])
    assert out.columns == ["doc_id", "n_pretokens", "n_tokens"]
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2)]


def test_token_counts(spark):
    vocabulary = tokens.Vocabulary(PIECES)
    texts = ["ab aba  bb", "", None, "x😀 é", "ab aba  bb", "abab " * 3]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokens.count_tokens(df, PIECES).collect()}
    assert out == {i: (len((t or "").split()), sum(exhaustive(vocabulary, "▁" + w) for w in (t or "").split())) for i, t in enumerate(texts)}
    assert tokens.count_tokens(df.limit(0), PIECES).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lines, turn = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    good, pair, logz = quality.marginals(score, lines, turn)
    at, want, want_pair = 0, [], np.zeros((2, 2))
    for c, n in enumerate(lines):
        weights = {}
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(turn[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(weights.values())
        assert logz[c] == pytest.approx(np.log(z))
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for i in range(n - 1):
                want_pair[y[i], y[i + 1]] += w / z
        at += n
    assert good == pytest.approx(want) and pair == pytest.approx(want_pair)


def test_gradient_against_enumeration():
    """Differences of log-likelihoods that are summed over all labellings of each document's lines."""
    rng = np.random.default_rng(4)
    lines, labels = np.array([3, 1, 4, 2]), [1, 0, 0, 1]
    x, y, theta = rng.normal(size=(10, 3)), np.repeat(np.array(labels, dtype=float), [3, 1, 4, 2]), rng.normal(size=7) / 2

    def likelihoods(theta):
        score, turn, at, out = x @ theta[:3], theta[3:].reshape(2, 2), 0, []
        for n, label in zip(lines, labels, strict=True):
            weigh = lambda path: sum(score[at + i] * z for i, z in enumerate(path)) + sum(turn[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
            every = [weigh(p) for p in itertools.product((0, 1), repeat=int(n))]
            out.append(weigh((label,) * int(n)) - np.log(np.exp(every).sum()))
            at += n
        return np.array(out)

    got = quality.gradient(theta, x, y, lines)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (likelihoods(theta + step) - likelihoods(theta - step)) / 2e-6
        want = (slope / lines).mean() if i < 3 else slope.sum() / len(y)
        assert abs(got[i] - want) < 1e-6


def test_the_fit_takes_whole_texts_up_to_a_sum_of_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: taken.append((texts, labels)))
    docs = [(i, "x" * (30_000 if i % 2 else 10) if i else None) for i in range(40)]
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    learn = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    quality.train(frame, labels)
    assert sorted(map(len, taken[0][0])) == sorted(len(t or "") for i, t in docs if i in learn)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100_000)
    quality.train(frame, labels)
    assert 100_000 <= sum(map(len, taken[1][0])) < 130_000
    quality.train(frame, labels, most=5)
    assert len(taken[2][0]) == 5


def test_quality_learns_and_takes_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(" | ".join(word() for _ in range(9)) for _ in range(rng.randint(1, 6)))
    docs = [(i, (good if i % 3 else bad)()) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, "\n" * 3000), (1003, "x" * 200_000), (None, "a b"), (5, docs[5][1])]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'x' as quality_score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    field = quality.train(df, labels)
    out = quality.score_quality(df, field).collect()
    assert len(out) == len(docs) + len(extra)
    assert all(0 <= r["quality_score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and sum((r["quality_score"] >= 0.3) == bool(r["doc_id"] % 3) for r in held) >= 0.97 * len(held)
    assert quality.score_quality(df.limit(0), field).count() == 0
    blank = quality.train(df, labels.limit(0))
    assert all(0 <= r["quality_score"] <= 1 for r in quality.score_quality(df.limit(5), blank).collect())


def test_the_fit_holds_its_features_once(monkeypatch):
    """Parts of texts give the features of all texts at once, and no array of their size is made beside them."""
    rng = random.Random(5)
    texts = ["", "x", *["\n".join(" ".join(rng.choices(["ab", "C.", "7", "é|"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 40))) for _ in range(300)]]
    whole = quality.line_features(texts)
    for part in (1, 500, 1 << 20):
        assert all(np.array_equal(a, b) for a, b in zip(whole, quality.features_in_parts(texts, part), strict=True))
    seen = []
    monkeypatch.setattr(quality, "line_features", lambda t, of=quality.line_features: (seen.append(sum(map(len, t))), of(t))[1])
    quality.fit([t * 300 for t in texts], [i % 2 for i in range(len(texts))], epochs=1)
    assert max(seen) <= 1 << 20 < sum(seen) <= 300 * sum(map(len, texts))
