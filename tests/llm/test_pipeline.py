"""The pipeline's stages and its run, against plain Python over small tables."""

import hashlib
import os
import random
import re

import pytest

import corpus_pipeline
from tabveil.llm import quality
from tabveil.llm.common import shared_folder
from tests.llm.test_pairs import brute_classes
from tests.llm.test_texts import brute_hits, brute_pii

SPACED = re.compile("[^\x20\x09-\x0d]+")
WORDS = "river stone harbour window yellow garden market silver morning letter winter bridge orchard village lantern meadow".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, Spans string, vertex int, mix_id int, Decon_Hits int, quality_Score double"


def tables(seed=3):
    rng = random.Random(seed)
    prose = lambda n: ". ".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n)) + "."
    junk = lambda: " | ".join("$$$ BUY NOW!!! " * 3 for _ in range(rng.randint(3, 9)))
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(20))) for i in range(4)]
    texts = [junk() if i % 5 == 0 else prose(rng.randint(3, 12)) for i in range(90)]
    texts += [texts[1], texts[1] + " more", texts[2].upper(), None, "", " ", items[0][1], f"{items[1][1]} {prose(1)}", prose(60) + " " + items[2][1]]
    texts += [f"{prose(2)} mail me.{i}@site.example or 10.0.0.{i} at once. {prose(1)}" for i in range(6)]
    docs = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or ""), "s", 1, 2, 3, 0.5) for i, t in enumerate(texts)]
    docs += [(5000, texts[3], "en", "a", 0, None, None, None, None, None), (None, prose(4), "en", None, 1, "s", 1, 2, 3, 0.5)]
    labels = [(i, 0 if i % 5 == 0 else 1) for i in range(90)] + [(None, 1), (91, None), (4, 1)]
    return docs, labels, items


def kept_quality(spark, docs, labels):
    made = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int")
    field = quality.train(*made)
    return [d for d in docs if field.score([d[1] or ""])[0] >= quality.THRESHOLD]


def kept_first(docs):
    classes = brute_classes([(i, d[1]) for i, d in enumerate(docs)], 5, 80)  # by place, since an id may be null
    of = {place: (n, least) for place, n, least in classes}
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(of[i][1], []).append((d[0] is None, d[0] or 0, i))
    first = {g: min(v)[2] for g, v in groups.items()}
    return [d for i, d in enumerate(docs) if of[i][0] == 0 or first[of[i][1]] == i]


def clean(docs, items):
    out = []
    for d in docs:
        n, hit, _ = brute_hits(d[1], items)
        if not (hit and 20 * hit >= n):
            out.append(d)
    return out


def redacted(docs):
    out = []
    for d in docs:
        text, parts, at = d[1], [], 0
        for s, e, kind in brute_pii(text or ""):
            if s >= at:
                parts += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        out.append((d[0], text and "".join([*parts, text[at:]]), *d[2:]))
    return out


def mixed(docs):
    size = [len(SPACED.findall(d[1] or "")) for d in docs]
    names = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for d, n in zip(docs, size, strict=True) if d[3] == s) for s in names}
    target, left, open_ = {}, 1.5 * sum(size), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    reads = []
    for s in names:
        upto = 0
        own = sorted((("" if docs[i][0] is None else hashlib.md5(str(docs[i][0]).encode()).hexdigest()), docs[i][0] or 0, size[i], i) for i in range(len(docs)) if docs[i][3] == s)
        for turn, _, n, i in own:
            upto += n
            reads += [((upto + r * total[s]) / target[s], s is None, s or "", turn, docs[i][0] or 0, r, n, i) for r in (0, 1) if n]
    budget, run, taken = int(sum(target.values()) + 1e-6), 0, [0] * len(docs)
    for *_, n, i in sorted(reads):
        run += n
        if run <= budget:
            taken[i] += 1
    return [(*d, k) for d, k in zip(docs, taken, strict=True) if k]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels, items = tables()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_and_run_against_plain_python(spark, folder):
    docs, labels, items = tables()
    stages = dict(corpus_pipeline.STAGES)
    plain = [("quality classifier", lambda d: kept_quality(spark, d, labels)), ("n-gram Jaccard join", kept_first), ("benchmark decontamination", lambda d: clean(d, items)), ("PII", redacted), ("mixing sources", mixed)]
    assert [n for n, _ in plain] == list(stages)
    for name, brute in plain:
        got = stages[name](spark, spark.createDataFrame(docs, COLUMNS), folder)
        want = brute(docs)
        assert got.columns[:10] == [c.split()[0] for c in COLUMNS.split(", ")], name
        assert rows(got) == sorted(want, key=repr), name
        assert 0 < len(want) <= len(docs)
        docs = want
    shared = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert rows(corpus_pipeline.run(spark, folder)) == sorted(docs, key=repr)
    left = set(os.listdir(shared)) - before
    assert len(left) == 5 and all(n.startswith("stage-") for n in left)  # what the stages cut is gone


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
