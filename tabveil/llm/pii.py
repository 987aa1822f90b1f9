"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers. These are the seeds. Each
occurrence induces lexical patterns (the two words before it; the word before and the word after it), and so does
every other identifier-like token or run of digit groups (four digits or more, or an @). Strings of hex digits as
long as a key are seeds of a fifth kind, secret; as they may be checksums as well, they become spans only where a
pattern says so. Spark scores the bipartite graph of patterns and instances: a pattern's confidence for a kind is
the mean confidence of its instances, an instance's that of at least one of its patterns being right. Instances found
so support further patterns. After a few rounds, all occurrences of confident instances become spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.llm.common import cut, free_names, hinted, small_batches, without

KINDS = ("email", "ip", "card", "phone")
#: The kind of seeds that are no base spans.
SECRET_KIND = "secret"
ALL_KINDS = (*KINDS, SECRET_KIND)
ROUNDS = 3
#: A pattern counts with at least so many distinct seeds and so much confidence; so does a found instance.
LEAST_SEEDS = 3
LEAST_CONFIDENCE = 0.6
LEAST_DIGITS = 4
#: Characters looked at first for the words around an occurrence; characters from which words and instances are named by a digest.
CONTEXT = 48
LONG = 256

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SPACE_AFTER = re.compile(r"\s|\Z")
#: Digits with single dots, hyphens and brackets between them, at most, and brackets around them.
GROUPED = re.compile(r"\+?[(\[]?[0-9]+(?:(?:[)\]][.-]?[(\[]?|[.-][(\[]?|[(\[])[0-9]+)*[)\]]?")
#: Keys in hex: 32 digits or more, letters among them.
SECRET = re.compile(r"(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-fA-F]{2}){16,64}")
OPENING, CLOSING = "\"'`([{<", "\"'`)]}>"
EDGE = " \t\r\n\"'`.,;:!?()[]{}<>*#$%&|=~^"


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it that no earlier match has taken."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > taken and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                taken = m.end()
        at = text.find("@", max(at + 1, taken))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then by kind as in KINDS."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like tokens, and runs of digit groups that single spaces join, apart from the spans in taken."""
    out, at, k = [], 0, 0
    run, parts, digits, joins = None, 0, 0, False  # the run of groups so far, and whether it may go on

    def end_run() -> None:
        if run and parts > 1 and digits >= LEAST_DIGITS:
            out.append(_bracketed(text, *run))

    while m := MARKED.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        first = start
        last = end = SPACE_AFTER.search(text, m.start()).start()
        at = end
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        clear = all(e <= start or s >= end for s, e, _ in taken[max(0, k - 8) : k + 8])
        token = text[start:end]
        n = len(DIGIT.findall(token))
        if clear and ("@" in token[1:-1] or n >= LEAST_DIGITS):
            out.append((start, end))
        grouped = clear and GROUPED.fullmatch(token) is not None
        closed = text[end:last] in ("", ")", "]")  # nothing but a bracket after it
        if grouped and run and joins and first == run[1] + 1 and text[run[1]] == " " and text[first:start] in ("", "(", "["):
            run, parts, digits = (run[0], last if closed else end), parts + 1, digits + n
        else:
            end_run()
            run, parts, digits = (start, last if closed else end) if grouped else None, 1, n
        joins = closed
    end_run()
    return out


def _bracketed(text: str, start: int, end: int) -> tuple[int, int]:
    """A run with the brackets that belong to it: an opening one before it, no closing one that opens before it."""
    inside = text[start:end]
    if inside[-1] in ")]" and inside.count(")") + inside.count("]") > inside.count("(") + inside.count("[") and not (start and text[start - 1] in "(["):
        return start, end - 1
    if start and text[start - 1] in "([" and inside.count(")") + inside.count("]") > inside.count("(") + inside.count("["):
        return start - 1, end
    return start, end


def _named(s: str) -> str:
    return s if len(s) <= LONG else hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _word(s: str) -> str:
    """A word of a pattern: without punctuation at its ends, unless it is nothing else."""
    return _named(DIGIT.sub("0", (s.strip(EDGE) or s).lower()))


def _words_before(text: str, start: int) -> list[str]:
    """The two words before start, whole. What opens right before start is no word."""
    size = CONTEXT
    while start and text[start - 1] in OPENING:
        start -= 1
    while True:
        words = text[max(0, start - size) : start].split()
        if len(words) > 2 or start <= size:
            return words[-2:]
        size *= 4


def _words_after(text: str, end: int) -> list[str]:
    """The word after end, whole. What closes right after end is no word."""
    size = CONTEXT
    while end < len(text) and text[end] in CLOSING:
        end += 1
    while True:
        words = text[end : end + size].split()
        if len(words) > 1 or end + size >= len(text):
            return words[:1]
        size *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence."""
    before = [_word(w) for w in _words_before(text, start)]
    after = [_word(w) for w in _words_after(text, end)]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
    return [*out, f"{before[-1]} _ {after[0]}"] if before and after else out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_USE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_SCHEMA = T.StructType([
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))),
    T.StructField("uses", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))),
])


def _found(base_name: str, uses_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, uses = [], []
            for text in batch.column("text").to_pylist():
                base, use = [], []
                if text and MARKED.search(text):
                    base = base_spans(text)
                    for s, e, kind in [*base, *((s, e, SECRET_KIND if SECRET.fullmatch(text, s, e) else None) for s, e in _tokens(text, base))]:
                        patterns = contexts(text, s, e)
                        if patterns or kind not in KINDS:
                            use.append({"start": s, "end": e, "kind": kind, "instance": _named(text[s:e].lower()), "patterns": patterns})
                bases.append([{"start": s, "end": e, "kind": k} for s, e, k in base])
                uses.append(use)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bases, pa.list_(_SPAN)), pa.array(uses, pa.list_(_USE))], names=[*kept, base_name, uses_name])

    return run


def confident_instances(uses: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(instance, kind, confidence) of the instances to trust, from uses (kind or null, instance, pattern).

    Instances are told apart by kind as well: a seed is its own kind and weighs 1. A pattern counts once least_seeds of
    its instances are seeds or were found with confidence least. Secrets are seeds, but to be trusted themselves, they
    need such a pattern. Every round is two joins on aggregated edges; hot patterns and instances meet map-side sums
    first.
    """
    edges = cut(uses.select("pattern", "instance", F.coalesce("kind", F.lit("")).alias("seed")).distinct(), "pii-edges")
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))
    seeds = edges.filter("seed <> ''").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds"))
    seeds = cut(seeds.join(degree, "pattern"), "pii-support")
    scores = seeds.select("pattern", "kind", F.col("seeds").alias("support"), (F.col("seeds") / F.col("degree")).alias("confidence"))
    unseen = edges.filter("seed = ''").select("pattern", "instance")
    unsure = edges.filter(F.col("seed").isin("", SECRET_KIND)).select("pattern", "instance").distinct()

    def beliefs(scores: DataFrame, unseen: DataFrame = unseen) -> DataFrame:
        trusted = scores.filter((F.col("support") >= least_seeds) & (F.col("confidence") >= least / 2)).select("pattern", "kind", "confidence")
        # 1 - product(1 - c), as a sum of logarithms that partial aggregation can take.
        return unseen.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("belief"))

    for _ in range(rounds):
        gain = unseen.join(beliefs(scores), "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("gain"), F.count_if(F.col("belief") >= least).alias("found"))
        both = seeds.drop("degree").join(gain, ["pattern", "kind"], "full").join(degree, "pattern").na.fill(0, ["seeds", "gain", "found"])
        scores = cut(both.select("pattern", "kind", (F.col("seeds") + F.col("found")).alias("support"), ((F.col("seeds") + F.col("gain")) / F.col("degree")).alias("confidence")), "pii-scores")
    return beliefs(scores, unsure).filter(F.col("belief") >= least).withColumnRenamed("belief", "confidence")


def find_pii(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The columns of docs but text, and base and spans: arrays of (start, end, kind), offsets in code points, end
    exclusive, by start and then kind. base holds what the fixed patterns find, spans also what the method adds.

    Null texts count as empty and have no spans. Repeated rows are searched row by row and weigh once in the
    graph (its edges are distinct). Ties between kinds go to the first in ALL_KINDS. Columns named like those added
    (in any case) are replaced. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*without(docs, "base", "spans"))
    kept = [f for f in rows.schema.fields if f.name.lower() != "text"]
    names = [f.name for f in kept]
    row, uses, base, new = free_names(rows, "pii_row", "pii_uses", "pii_base", "pii_new")
    fields = [T.StructField(n, f.dataType) for n, f in zip((base, uses), _SCHEMA.fields, strict=True)]
    found = rows.select(*names, F.col("text").alias("text")).mapInArrow(_found(base, uses), T.StructType(kept + fields))
    found = cut(found.withColumn(row, F.monotonically_increasing_id()), "pii-found")
    each = found.select(F.col(row).alias("row"), F.explode(uses).alias("u")).select("row", "u.*")
    trusted = confident_instances(each.select("kind", "instance", F.explode("patterns").alias("pattern")), rounds).withColumnRenamed("kind", "as")
    order = lambda kind: F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), kind)
    more = each.filter(F.col("kind").isNull() | (F.col("kind") == SECRET_KIND)).join(trusted, "instance")
    more = more.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-order(F.col("as"))).alias("o"), "as")).alias("best"))
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("best.as").alias("kind"))).alias(new)).withColumnRenamed("row", row + "_")
    out = found.join(more, F.col(row) == F.col(row + "_"), "left")
    rank = lambda x: F.struct(x["start"].alias("start"), order(x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat(base, F.coalesce(new, F.expr("array()").cast(_SCHEMA["base"].dataType))), rank))
    spans = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return out.select(*names, F.col(base).alias("base"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _redacted(found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True):
                if text and spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            names = [c for c in batch.schema.names if c != found]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return run


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with every span of find_pii replaced by its kind in brackets; overlapping spans become one.

    Spans meet their texts by doc_id (a null one is an id as well) and a hash of the text; rows equal in both get the
    same spans. Null and empty texts stay as they are, as do all other columns, whatever their names. An empty table
    gives an empty result.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    spans = find_pii(docs.select("doc_id", tag.alias("tag"), "text"), rounds).filter(F.size("spans") > 0)
    id_, other, found = free_names(docs, "pii_id", "pii_tag", "pii_spans")
    spans = spans.select(F.col("doc_id").alias(id_), F.col("tag").alias(other), F.col("spans").alias(found)).dropDuplicates([id_, other])
    rows = docs.join(hinted(cut(spans, "pii-spans")), F.col("doc_id").eqNullSafe(F.col(id_)) & (tag == F.col(other)), "left").select(*docs.columns, found)
    return rows.mapInArrow(_redacted(found), docs.schema)
