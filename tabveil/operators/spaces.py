"""Walks through bounded spaces: identifiers with few digits and letters, and names before they are numbered.

A space has at most strategies.MOST_PLACES outputs, so which of them are taken is a bitmap, and a space can be walked
through in the order of its values, block by block, by tasks that hold one block and one bitmap, whatever the size of the
table. Inside a block all values propose at once, and a place keeps the earliest; spaces are walked side by side.

Names go on as numbers when their 50 entries are taken. Once all names of a space are held, the values after that are
dealt numbers, all at once: numbered e-mail names meet only where persons and hosts agree, so these are walked through
side by side; names of other kinds meet only where they are the same, and are left to the rounds of the mapping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions import strategies
from tabveil.operators.tables import cut, new_folder
from tabveil.plans.model import Plan

#: Values of a block.
BLOCK = 100_000
GIVEN = "domain string, anchor string, value string, column string, rec long, at int, tail string, own boolean, space string"
WALKED = GIVEN + ", n int, place long, name string"
NAMES = [c.split()[0] for c in WALKED.split(", ")]
PLACED = "domain string, anchor string, rec long, at int, tail string, own boolean, n int, output string"
BITS = 4096 * 8  # of a piece of Spark's bitmaps


def space_of(plan: Plan, domain: str, anchor: str | None, column: str, value: str, spelled: str | None) -> tuple[str | None, int, int]:
    """(space, its size, the place of the value itself): no space where outputs have no places, or too many."""
    rule = plan.columns[column]
    size = strategies.places(rule, value)
    if size is None:
        return None, 0, -1
    if rule.strategy == "HashId":
        kind = strategies.template(rule, value)
    else:
        others = {r.options.kind for c, r in plan.columns.items() if r.is_mapping and plan.mapping_domain(c) == domain and r.strategy == "Fake"}
        if len(others) > 1:  # what they are called may be alike
            return None, 0, -1
        kind = f"{rule.options.kind} {spelled}"
    return "\x1d".join((domain, "" if anchor is None else f"={anchor}", rule.strategy, kind)), size, strategies.own_place(rule, value)


class _Walk:
    """One block of one space. Values are named by their rank; holder is the rank at each place, -1 for earlier blocks."""

    def __init__(self, plan: Plan, key: bytes, pdf: pd.DataFrame, held: pd.DataFrame):
        self.pdf = pdf.sort_values(["rec", "at"], ignore_index=True)
        self.plan, self.key, self.free, self.size = plan, key, len(pdf), int(pdf["size"].iloc[0])
        self.rule = plan.columns[self.pdf["column"][0]]
        self.hashed = self.rule.strategy == "HashId"
        self.draws = strategies.RANDOM_ATTEMPTS if self.hashed else strategies.BEFORE_NUMBERS
        self.radix = strategies.radices(self.rule, self.pdf["value"][0])
        self.domains, self.seeds, self.own = self.pdf["seed_domain"].to_numpy(), self.pdf["seed"].to_numpy(), self.pdf["own_place"].to_numpy()
        self.holder = np.full(self.size, self.free, dtype=np.int64)
        for r in held[held["bits"].notna()].itertuples(index=False):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")) + (int(r.bucket) - 1) * BITS
            self.holder[at] = -1
        self.numbers: dict[str, int] = dict.fromkeys(held["name"].dropna(), -1)
        self.n, self.place = np.zeros(self.free, dtype=np.int64), np.full(self.free, -1, dtype=np.int64)
        self.starts: dict[int, int] = {}
        self.name: dict[int, str] = {}

    def places(self, who: np.ndarray, attempts) -> np.ndarray:
        return strategies.bulk_places(self.rule, self.key, self.radix, self.domains[who], self.seeds[who], attempts)

    def propose(self, who: np.ndarray) -> np.ndarray:
        """One draw each; those who have to go on."""
        at = self.places(who, self.n[who])
        better = (self.holder[at] > who) & (at != self.own[who])
        asks, wanted = who[better], at[better]
        before = self.holder[wanted]
        np.minimum.at(self.holder, wanted, asks)
        got = self.holder[wanted] == asks
        gone = np.unique(before[got])
        gone = gone[gone < self.free]
        self.place[gone] = -1
        self.place[asks[got]] = wanted[got]
        on = np.concatenate([who[~better], asks[~got], gone])
        self.n[on] += 1
        return on

    def draw(self, waiting: np.ndarray) -> np.ndarray:
        """Draws until all hold a place or are past their draws; those."""
        late = []
        while len(waiting):
            past = self.n[waiting] >= self.draws
            late.append(waiting[past])
            waiting = self.propose(waiting[~past]) if not past.all() else waiting[:0]
        return np.concatenate(late) if late else waiting

    def count_on(self, v: int) -> int | None:
        """An identifier's first place by counting that no earlier value holds; the value it takes it from."""
        if v not in self.starts:
            self.starts[v] = int(self.places(np.array([v]), [strategies.RANDOM_ATTEMPTS])[0])
        start, done = self.starts[v], int(self.n[v]) - strategies.RANDOM_ATTEMPTS
        while done < self.size:
            begin = (start + done) % self.size
            ahead = self.holder[begin : begin + min(1 << 16, self.size - done)]
            fits = np.flatnonzero(ahead > v)
            fits = fits[fits + begin != self.own[v]][:1]
            if len(fits):
                at = begin + int(fits[0])
                self.n[v] = strategies.RANDOM_ATTEMPTS + done + int(fits[0])
                before, self.holder[at], self.place[v] = int(self.holder[at]), v, at
                return before if before < self.free else None
            done += len(ahead)
        self.n[v] = -1
        return None

    def number(self, v: int) -> int | None:
        """A name's first number that no earlier value holds; the value it takes it from."""
        kind, base, value = self.rule.options.kind, self.pdf["tail"][v].partition(" ")[2], self.pdf["value"][v]
        while True:
            out = strategies.numbered(kind, base, int(self.n[v]))
            at = strategies.name_place(kind, out) if kind == "Email" else -1
            before = int(self.holder[at]) if at >= 0 else self.numbers.get(out, self.free)
            if out != value and before > v:
                break
            self.n[v] += 1
        if at >= 0:
            self.holder[at], self.place[v] = v, at
        else:
            self.numbers[out], self.name[v] = v, out
        return before if before < self.free else None

    def run(self) -> pd.DataFrame:
        late, end = self.draw(np.arange(self.free)), self.free
        if not self.hashed and (self.holder < self.free).all():
            end = int(self.holder.max()) + 1  # all names are held from here on
        while len(late):
            gone = []
            for v in late[late < end].tolist():
                lost = (self.count_on if self.hashed else self.number)(v)
                if lost is not None:
                    self.n[lost] += 1
                    self.place[lost] = -1
                    self.name.pop(lost, None)
                    gone.append(lost)
            late = self.draw(np.array(gone, dtype=np.int64))
        out = self.pdf.assign(n=self.n.astype("int32"), place=self.place, name=pd.Series([self.name.get(i) for i in range(self.free)], dtype=object))
        return out.iloc[:end][NAMES]


def _walk(plan: Plan, key: bytes):
    def run(values: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        kinds = {"string": object, "long": "int64", "int": "int32", "boolean": bool}
        return _Walk(plan, key, values, held).run() if len(values) else pd.DataFrame({c: pd.Series([], dtype=kinds[kind]) for c, kind in map(str.split, WALKED.split(", "))})

    return run


def _outputs(plan: Plan):
    def run(parts):
        for pdf in parts:
            made = [strategies.output_at(plan.columns[c], v, p) if p >= 0 else name for c, v, p, name in zip(pdf["column"], pdf["value"], pdf["place"], pdf["name"], strict=True)]
            yield pdf.drop(columns=["name", "space", "place", "value", "column"]).assign(output=pd.Series(made, dtype=object, index=pdf.index))

    return run


def walk_spaces(values: DataFrame, plan: Plan, key: bytes) -> DataFrame | None:
    """(domain, anchor, rec, at, tail, own, n, output) of the values with a space, but of names only up to the one that
    takes the last of its space. n is -1 where only the value itself is left. None if no value has a space."""
    spark = values.sparkSession
    spaced = values.filter("space is not null and maskable")
    spaces = {r["space"]: r for r in spaced.groupBy("space", "size", F.col("tail").isNotNull().alias("named")).agg(F.count(F.lit(1)).alias("members"), F.max("rec").alias("end")).collect()}  # of large classes, so a few
    if not spaces:
        return None
    total = sum(r["members"] for r in spaces.values())
    shares = [i / -(-total // BLOCK) for i in range(1, -(-total // BLOCK))]
    ends = [*sorted(set(spaced.approxQuantile("rec", shares, 0.001) if shares else [])), None]
    columns = ["size", "seed_domain", "seed", "own_place", *[c.split()[0] for c in GIVEN.split(", ")]]
    paths, start, full = [], None, []
    for end in ends:
        if not any(start is None or r["end"] > start for s, r in spaces.items() if s not in full):
            break
        block = spaced.filter(~F.col("space").isin(full)) if full else spaced
        block = block.filter(F.col("rec") > int(start)) if start is not None else block
        block = block.filter(F.col("rec") <= int(end)) if end is not None else block
        if paths:
            before = spark.read.schema(WALKED).parquet(*paths)
            bits = before.filter("place >= 0").select("space", (F.col("place") + 1).alias("p")).groupBy("space", F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
            held = bits.withColumn("name", F.lit(None).cast("string")).unionByName(before.filter("name is not null").select("space", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "name"))
        else:
            held = spark.createDataFrame([], "space string, bucket long, bits binary, name string")
        path = new_folder(spark, "mapping-walked")
        block.select(columns).groupBy("space").cogroup(held.groupBy("space")).applyInPandas(_walk(plan, key), WALKED).write.option("compression", "zstd").parquet(path)
        paths.append(path)
        named = [r for s, r in spaces.items() if r["named"] and s not in full]
        if named:
            counts = spark.read.schema(WALKED).parquet(*paths).filter("place >= 0 and tail is not null").groupBy("space").agg(F.count(F.lit(1)).alias("held")).collect()
            full += [r["space"] for r in counts if r["held"] >= spaces[r["space"]]["size"] and r["space"] not in full]
        start = end
    walked = spark.read.schema(WALKED).parquet(*paths)
    tasks = spark.sparkContext.defaultParallelism * 2
    return cut(walked.repartition(tasks, "rec", "at").mapInPandas(_outputs(plan), PLACED), "mapping-placed")


def _dealt(pdf: pd.DataFrame) -> pd.DataFrame:
    """The numbers of one person at one host. Rows with an output hold it already; all names are held."""
    pdf = pdf.sort_values(["rec", "at"])
    taken, starts, made = set(pdf["output"].dropna()), {}, []
    pdf = pdf[pdf["output"].isna()]
    for tail, value in zip(pdf["tail"], pdf["value"], strict=True):
        base, n = tail.partition(" ")[2], starts.get(tail, strategies.BEFORE_NUMBERS)
        passed = True
        while True:
            out = strategies.numbered("Email", base, n)
            free = out not in taken and strategies.name_place("Email", out) < 0
            if free and out != value:
                break
            passed, n = passed and not free, n + 1
            if passed:
                starts[tail] = n
        taken.add(out)
        made.append((n, out))
    n, outputs = zip(*made, strict=True) if made else ((), ())
    pdf = pdf.assign(n=pd.Series(n, dtype="int32", index=pdf.index), output=pd.Series(outputs, dtype=object, index=pdf.index))
    return pdf[[c.split()[0] for c in PLACED.split(", ")]]


def deal_numbers(left: DataFrame, walked: DataFrame) -> DataFrame:
    """As walk_spaces, of the values with e-mail names that it leaves. A group has the values of one person at one host,
    which are drawn: a 7,500th of a space's values, and what they hold from before the space was full."""
    person = lambda c: F.regexp_replace(c, "[0-9]+@", "@")
    open_ = left.select("domain", "anchor", "value", "rec", "at", "tail", "own", F.lit(None).cast("string").alias("output"), person(F.substring_index("tail", " ", -1)).alias("person"))
    held = walked.filter((F.col("n") >= strategies.BEFORE_NUMBERS) & F.col("tail").isNotNull()).select("domain", "anchor", F.lit(None).cast("string").alias("value"), "rec", "at", "tail", "own", "output", person(F.col("output")).alias("person"))
    return cut(open_.unionByName(held).groupBy("domain", "anchor", "person").applyInPandas(_dealt, PLACED), "mapping-dealt")
