"""Unique mappings of source values to outputs, equal to taking values one by one in order of first appearance.

Every value has a fixed list of preferences and takes the first entry that is not itself and not taken by an
earlier value of its domain. With a common order of precedence this is the unique stable matching, which deferred
acceptance finds in any order: all unmatched values propose, every output keeps its earliest proposer.

Values of different conflict classes never want the same output. Small classes are walked through in one group;
large ones are walked through by blocks where their outputs are few (see spaces), and go through rounds of proposals else. Earlier values first, in blocks that grow: what they hold is
never lost again. A round writes what is proposed, and the values still open; no more.

The last of all values of a space may find itself as the only output left. It changes places with the value before it,
the one exception from the order; n is SWAPPED for both.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import strategies
from tabveil.operators import spaces
from tabveil.operators.tables import cut, new_folder
from tabveil.plans.model import SEPARATOR, Plan

#: Values of a class up to which one group walks through it.
SMALL_CLASS = 20_000
MOST_ENTRIES = 2_000_000
#: Entries of preference lists that a round looks at, one a value at least: in one group, for up to FEW values, and else.
ROUND_ENTRIES, SHUFFLED_ENTRIES = 200_000, 2_000_000
FEW = 4_000
#: Entries a value that a round looks at once names are told apart by numbers.
NUMBERS = 16
#: Values of the first block; each is twice the one before.
FIRST_BLOCK = 500_000
#: Tables of proposals that a round reads, at most.
MOST_TABLES = 16
SWAPPED = -2
#: ats: the columns, by position, in which a value occurs.
KEYS = "domain string, anchor string, value string, ats string"


class UniqueValueExhausted(ValueError):
    def __init__(self, column: str):
        super().__init__(f"column '{column}' has no unused outputs left")


class MappingLimitExceeded(ValueError):
    def __init__(self, column: str):
        super().__init__(f"column '{column}' exceeds the number of mapping entries allowed")


def mapping_keys(df: DataFrame, plan: Plan) -> DataFrame:
    """(domain, anchor, value, seed_domain, seed, column, first, ats): the distinct values to map, with the record and
    column of their first appearance and the positions of all columns they appear in. df has _rec and the source columns; one scan serves all columns."""
    from tabveil.functions.text import has_value

    cells = []
    for i, (c, rule) in enumerate(plan.columns.items()):
        if rule.is_mapping:
            group = plan.group_of(c)
            v = df[f"`{c}`"]
            linked = has_value(df[f"`{group.anchor}`"]) if group else F.lit(False)
            anchor = F.when(linked, df[f"`{group.anchor}`"]) if group else F.lit(None).cast("string")
            seed_domain = F.when(linked, F.lit(group.domain)).otherwise(F.lit(rule.domain or c)) if group else F.lit(rule.domain or c)
            cells.append(F.struct(F.lit(plan.mapping_domain(c)).alias("domain"), anchor.alias("anchor"), F.when(has_value(v), v).alias("value"), seed_domain.alias("seed_domain"), F.coalesce(anchor, v).alias("seed"), F.lit(c).alias("column"), F.struct(df["_rec"].alias("rec"), F.lit(i).alias("at")).alias("first")))
    each = df.select(F.explode(F.array(*cells)).alias("k")).select("k.*").filter("value is not null")
    return each.groupBy("domain", "anchor", "value", "seed_domain", "seed").agg(F.min_by("column", "first").alias("column"), F.min("first").alias("first"), F.array_join(F.array_sort(F.collect_set("first.at")), ",").alias("ats"))


#: ZIPs of five digits that there can be.
MOST_ZIPS = 100_000


def zip_lists(zips: DataFrame) -> DataFrame:
    """(prefix, listed) from a table of known ZIPs: a column zip, or a column zips of arrays. What is not five digits does
    not count, nor do repetitions; lists are in ascending order. So there are at most 1,000 rows and MOST_ZIPS ZIPs,
    which is what makes the result fit to be broadcast, whatever the size of the table."""
    each = zips.select(F.explode("zips").alias("zip")) if "zips" in zips.columns else zips.select("zip")
    known = each.filter(F.col("zip").rlike(r"\A[0-9]{5}\z")).groupBy("zip").agg(F.first("zip").alias("z"))
    return known.groupBy(F.substring("zip", 1, 3).alias("prefix")).agg(F.array_sort(F.collect_set("zip")).alias("listed"))


def with_lists(values: DataFrame, plan: Plan, zips: DataFrame | None) -> DataFrame:
    """values and listed: the known ZIPs that begin as a value does, null for values of other strategies."""
    mapped = [c for c, r in plan.columns.items() if r.strategy == "ZipRemap"]
    if zips is None or not mapped:
        return values.withColumn("listed", F.lit(None).cast("array<string>"))
    begins = F.when(F.col("column").isin(*mapped), F.substring(F.lpad(F.substring_index("value", "-", 1), 5, "0"), 1, 3))
    return values.join(F.broadcast(zips), begins == F.col("prefix"), "left").drop("prefix")


def class_of(plan: Plan) -> Column:
    """The conflict class of a value: values of different classes never want the same output. An identifier's outputs
    have its digits, zero padding and other characters in place; letters, and what some edition of Unicode may take for
    a letter, all count as one."""
    v = F.col("value")
    of = lambda name: F.col("column").isin([c for c, r in plan.columns.items() if r.strategy == name])
    kinds = (("[A-Za-z]|[^\\x00-\\x7F]", "a"), ("(?<![0-9])0(?=[0-9])", "\x02"), ("(?<![0-9\x02])[1-9](?=[0-9])", "\x01"), ("[0-9]", "d"))
    shape = reduce(lambda x, k: F.regexp_replace(x, *k), kinds, v)
    plus = v.rlike(r"\A[0-9]{5}-[0-9]{4}\n?\z")
    zip_ = F.concat(F.substring(F.lpad(F.substring(v, 1, 5), 5, "0"), 1, 3), F.lit("/"), F.when(plus, "plus").otherwise(F.char_length(v).cast("string")))
    return F.when(of("HashId"), shape).when(of("ZipRemap"), zip_).otherwise("")


def _used(anchor: str | None, output: str) -> str:
    return output if anchor is None else f"{anchor}{SEPARATOR}{output}"


def _walked(plan: Plan, key: bytes):
    """Sequential: a small class in the order of first appearance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for r in pdf.sort_values(["rec", "at"]).itertuples(index=False):
            rule, anchor = plan.columns[r.column], None if pd.isna(r.anchor) else r.anchor
            for n in range(strategies.last_attempt(rule, r.value) + 1):
                candidate = strategies.choice(rule, key, r.value, r.seed_domain, r.seed, n, r.listed)
                if candidate is None or (candidate != r.value and _used(anchor, candidate) not in used):
                    break
            else:
                candidate, n = None, -1
                space = strategies.space_of(rule, r.value) if _used(anchor, r.value) not in used else None
                before = next((i for i in reversed(range(len(out))) if out[i][4] is not None and strategies.space_of(plan.columns[out[i][6]], out[i][2]) == space), None) if space else None
                if before is not None:
                    candidate, n = out[before][4], SWAPPED
                    out[before] = (*out[before][:4], r.value, SWAPPED, *out[before][6:])
                    used.add(_used(anchor, r.value))
            if candidate is not None:
                used.add(_used(anchor, candidate))
            out.append((r.domain, anchor, r.value, r.ats, candidate, n, r.column, r.rec, r.at))
        return pd.DataFrame(out, columns=["domain", "anchor", "value", "ats", "output", "n", "column", "rec", "at"])

    return run


OUT = KEYS + ", output string, n int, column string, rec long, at int"


VALUES = KEYS + ", seed_domain string, seed string, column string, rec long, at int, class string, tail string, own boolean, spelled string, last int, maskable boolean, space string, size long, own_place long"
ENTRIES = "domain string, anchor string, rec long, at int, n int, output string, tail string, own boolean"


def _spelling(name: str) -> str:
    return "lower" if name == name.lower() else "upper" if name == name.upper() else "mixed"


def _tails(plan: Plan, key: bytes):
    """tail: values of one tail share their entries from BEFORE_NUMBERS on, numbered names of one base name. own: the
    value itself may be one of them, which it passes over. spelled: how the names for a value are. last: its last entry.
    maskable: it has entries. space, size, own_place: see spaces.space_of."""

    def run(parts):
        for pdf in parts:
            tails, owns, spelled, lasts, fine, where = [], [], [], [], [], []
            for r in pdf.itertuples(index=False):
                rule = plan.columns[r.column]
                first = strategies.choice(rule, key, r.value, r.seed_domain, r.seed, 0)
                base = first if strategies.can_number(rule) else None
                tails.append(base and f"{rule.options.kind == 'Email'} {base}")
                owns.append(base is not None and r.value.startswith(base.partition("@")[0]))
                spelled.append(base and _spelling(base))
                lasts.append(strategies.last_attempt(rule, r.value))
                fine.append(first is not None)
                where.append(spaces.space_of(plan, r.domain, None if pd.isna(r.anchor) else r.anchor, r.column, r.value, spelled[-1]))
            space, size, place = zip(*where, strict=True) if where else ((), (), ())
            of = lambda x, kind, i=pdf.index: pd.Series(x, dtype=kind, index=i)
            yield pdf.assign(tail=of(tails, object), own=of(owns, bool), spelled=of(spelled, object), last=of(lasts, "int32"), maskable=of(fine, bool), space=of(space, object), size=of(size, "int64"), own_place=of(place, "int64"))

    return run


def _entries(plan: Plan, key: bytes, batch: int):
    """The entries from n on, batch of them at most, but the value itself; names and numbered names are apart."""

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                rule, anchor, tail = plan.columns[r.column], None if pd.isna(r.anchor) else r.anchor, None if pd.isna(r.tail) else r.tail
                end = min(r.n + batch, r.last + 1)
                for n in range(r.n, min(end, strategies.BEFORE_NUMBERS) if tail is not None and r.n < strategies.BEFORE_NUMBERS else end):
                    if tail is not None and n >= strategies.BEFORE_NUMBERS:
                        candidate = strategies.numbered(rule.options.kind, tail.partition(" ")[2], n)
                    else:
                        candidate = strategies.choice(rule, key, r.value, r.seed_domain, r.seed, n, r.listed)
                    if candidate != r.value:
                        out.append((r.domain, anchor, r.rec, r.at, n, candidate, tail, r.own))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")]).astype({"rec": "int64", "at": "int32", "n": "int32", "own": "bool"})

    return run


def _first_unclaimed(pdf: pd.DataFrame) -> pd.DataFrame:
    """An entry a value, at most: the first that no earlier value of these claims."""
    claimed, kept, last = set(), [], None
    pdf = pdf.sort_values(["rec", "at", "n"], ignore_index=True)
    for i, r in enumerate(pdf.itertuples(index=False)):
        if (r.rec, r.at) != last and r.output not in claimed:
            claimed.add(r.output)
            kept.append(i)
            last = (r.rec, r.at)
    return pdf.iloc[kept]


def _same(a: str, b: str, *names: str) -> Column:
    """Rows of the aliases a and b agree in domain, anchor (null or not) and names."""
    return reduce(lambda x, n: x & (F.col(f"{a}.{n}") == F.col(f"{b}.{n}")), names, (F.col(f"{a}.domain") == F.col(f"{b}.domain")) & F.col(f"{a}.anchor").eqNullSafe(F.col(f"{b}.anchor")))


IN_TAIL = f"(tail is not null and n >= {strategies.BEFORE_NUMBERS})"


class _Claims:
    """All that was ever proposed, a table a round. Whoever proposed an output first, in the order of values, holds it: a
    value that lost an output lost it to an earlier one."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def add(self, df: DataFrame, label: str = "mapping-proposed") -> DataFrame:
        path = new_folder(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES + ", won boolean").parquet(*self.paths)

    def holders(self) -> DataFrame:
        h = self.table().groupBy("domain", "anchor", "output").agg(F.min(F.struct("rec", "at", "n", "tail", "own")).alias("h"))
        return h.select("domain", "anchor", "h.rec", "h.at", "h.n", "output", "h.tail", "h.own", F.lit(True).alias("won"))

    def compact(self) -> None:
        if len(self.paths) > MOST_TABLES:
            held = self.holders()
            self.paths = []
            self.add(held, "mapping-held")


def _ranked(waiting: DataFrame, claims: _Claims) -> DataFrame:
    """Values in tails, n raised by their rank in their tail: k earlier values that share a list from an entry on hold its
    first k entries, or lost them to values earlier still."""
    names = ["domain", "anchor", "tail", "rec", "at", "own"]
    members = waiting.select(names)
    if claims.paths:
        members = members.unionByName(claims.table().filter(IN_TAIL).select(names)).distinct()
    w = Window.partitionBy("domain", "anchor", "tail").orderBy("rec", "at").rowsBetween(Window.unboundedPreceding, -1)
    ranks = members.withColumn("rank", F.coalesce(F.count_if(~F.col("own")).over(w), F.lit(0))).select("rec", "at", "rank")
    return waiting.join(ranks, ["rec", "at"]).withColumn("n", F.greatest("n", strategies.BEFORE_NUMBERS + F.col("rank")).cast("int")).drop("rank")


def _past_names(block: DataFrame, plan: Plan, claims: _Claims) -> DataFrame:
    """block with n, the entry to begin with: 0, or the first numbered one where earlier values hold all names there are."""
    sizes = {plan.mapping_domain(c): strategies.pool_size(r) for c, r in plan.columns.items() if r.is_mapping and strategies.can_number(r)}
    emails = [plan.mapping_domain(c) for c, r in plan.columns.items() if r.is_mapping and strategies.can_number(r) and r.options.kind == "Email"]
    if not sizes or not claims.paths:
        return block.withColumn("n", F.lit(0))
    names = F.when(F.col("domain").isin(emails), F.col("output").rlike(r"\A[^0-9]+([1-9]?[0-9])@")).otherwise(~F.col("output").rlike("[0-9]\\z"))
    spelled = F.when(F.col("output") == F.lower("output"), "lower").when(F.col("output") == F.upper("output"), "upper").otherwise("mixed")
    size = reduce(lambda x, s: x.when(F.col("domain") == s[0], s[1]), sizes.items(), F.when(F.lit(False), 0))
    held = claims.holders().filter(F.col("tail").isNotNull() & names).groupBy("domain", "anchor", spelled.alias("spelled")).agg(F.count(F.lit(1)).alias("held"))
    full = held.filter(F.col("held") >= size).alias("f")
    past = F.col("f.domain").isNotNull()
    return block.alias("b").join(full, _same("b", "f", "spelled"), "left").select("b.*", F.when(past, strategies.BEFORE_NUMBERS).otherwise(0).alias("n"))


def _round(state: DataFrame, values: DataFrame, claims: _Claims, plan: Plan, key: bytes, zips: DataFrame | None, turn: int) -> DataFrame | None:
    """Round turn of a block for the open values in state: those still open after it, or None."""
    cols = state.columns
    n_open, n_tails = state.agg(F.count(F.lit(1)), F.count_if(F.expr(IN_TAIL))).first()
    if not n_open:
        return None
    # Names first: who falls through to the numbers must be known before numbers are dealt in order.
    numbered = n_open == n_tails
    waiting = state if numbered or not n_tails else state.filter(f"not {IN_TAIL}")
    n_waiting = n_open if numbered else n_open - n_tails
    few = n_waiting <= FEW
    batch = max(1, min((ROUND_ENTRIES if few else SHUFFLED_ENTRIES) // n_waiting, 4 << min(turn, 20))) if claims.paths or few else 1
    if numbered:
        batch = min(batch, NUMBERS)
        waiting = cut(_ranked(waiting, claims), "mapping-open")
    tasks = values.sparkSession.sparkContext.defaultParallelism * (1 if few else 2)
    left = with_lists(waiting, plan, zips).repartition(tasks, "rec", "at").mapInPandas(_entries(plan, key, batch), ENTRIES)
    before = claims.table() if claims.paths else None
    if before is not None:
        earlier = F.struct("h.rec", "h.at") < F.struct("e.rec", "e.at")
        left = left.alias("e").join(before.select("domain", "anchor", "output", "rec", "at").alias("h"), _same("e", "h", "output") & earlier, "left_anti")
    if few:  # what one group gets is at most ROUND_ENTRIES rows, whatever the size of the class
        proposed = left.groupBy("domain", "anchor").applyInPandas(_first_unclaimed, ENTRIES)
    else:
        proposed = left.groupBy("rec", "at").agg(F.min(F.struct("n", "domain", "anchor", "output", "tail", "own")).alias("p")).select("p.domain", "p.anchor", "rec", "at", "p.n", "p.output", "p.tail", "p.own")
    first = F.min(F.struct("rec", "at")).over(Window.partitionBy("domain", "anchor", "output"))
    proposed = claims.add(proposed.withColumn("won", F.struct("rec", "at") == first))
    p = proposed.select("rec", "at", F.col("n").alias("to"), "won")
    none = F.col("n") + batch
    none = F.when(F.col("tail").isNotNull() & (F.col("n") < strategies.BEFORE_NUMBERS), F.least(none, F.lit(strategies.BEFORE_NUMBERS))).otherwise(none)
    after = waiting.join(p, ["rec", "at"], "left").filter("won is null or not won").withColumn("n", F.coalesce(F.col("to") + 1, none).cast("int")).select(cols)
    if before is not None:
        held = before.alias("h").join(proposed.filter("won").select("domain", "anchor", "output").alias("w"), _same("h", "w", "output"))
        gone = held.groupBy("h.domain", "h.anchor", "h.output").agg(F.min(F.struct("h.rec", "h.at", "h.n")).alias("x")).select(F.col("x.rec").alias("rec"), F.col("x.at").alias("at"), F.col("x.n").alias("was"))
        after = after.unionByName(values.join(gone, ["rec", "at"]).withColumn("n", F.col("was") + 1).select(cols))
    if n_tails and not numbered:
        after = after.unionByName(state.filter(IN_TAIL))
    state = cut(after.filter("n <= last"), "mapping-round")
    claims.compact()
    return state


def _accepted(large: DataFrame, plan: Plan, key: bytes, zips: DataFrame | None) -> DataFrame:
    """Walks through bounded spaces; for the rest, deferred acceptance in rounds, block by block, until no value is rejected.

    An output's holder only ever gives way to an earlier value. So a value passes at once over all entries that an
    earlier value holds or proposes to, as many as a round looks at: the last ones, whose lists are long, see them whole.
    Every round moves open values on, so the lists' ends bound the rounds.
    """
    given = ["domain", "anchor", "value", "ats", "seed_domain", "seed", "column", "rec", "at", "class"]
    tasks = large.sparkSession.sparkContext.defaultParallelism * 2
    values = cut(large.select(given).repartition(tasks, "rec", "at").mapInPandas(_tails(plan, key), VALUES), "mapping-values")
    claims, start = _Claims(values.sparkSession), None
    walked = spaces.walk_spaces(values, plan, key)
    if walked is not None:
        full = values.filter("space is not null and maskable and tail is not null").join(walked.select("rec", "at"), ["rec", "at"], "left_anti")
        full = cut(full.withColumn("n", F.lit(strategies.BEFORE_NUMBERS)), "mapping-open")
        emails = F.col("column").isin([c for c, r in plan.columns.items() if r.is_mapping and strategies.can_number(r) and r.options.kind == "Email"])
        mail, full = full.filter(emails), full.filter(~emails)
        if not mail.isEmpty():
            walked = walked.unionByName(spaces.deal_numbers(mail, walked))
        if not full.isEmpty():
            claims.add(walked.filter("tail is not null").select(*[c.split()[0] for c in ENTRIES.split(", ")], F.lit(True).alias("won")), "mapping-held")
        state, turn = full, 0
        while state is not None:
            state, turn = _round(state, values, claims, plan, key, zips, turn), turn + 1
    rest = values.filter("space is null")
    total, size, done, shares = rest.count(), FIRST_BLOCK, 0, []
    while done + size < total:
        done, size = done + size, size * 2
        shares.append(done / total)
    ends = [*sorted(set(rest.approxQuantile("rec", shares, 0.001) if shares else [])), None] if total else []
    for end in ends:
        block = rest.filter("maskable")
        block = block.filter(F.col("rec") > int(start)) if start is not None else block
        block = block.filter(F.col("rec") <= int(end)) if end is not None else block
        state, turn = _past_names(block, plan, claims), 0
        while state is not None:
            state, turn = _round(state, values, claims, plan, key, zips, turn), turn + 1
        start = end
    names = ["domain", "anchor", "value", "ats", "output", "n", "column", "rec", "at"]
    taken = [walked.select("rec", "at", "output", F.col("n").alias("taken"), F.lit(0).alias("by"))] if walked is not None else []
    taken += [claims.holders().select("rec", "at", "output", F.col("n").alias("taken"), F.lit(1).alias("by"))] if claims.paths else []
    if not taken:
        return values.select("domain", "anchor", "value", "ats", F.lit(None).cast("string").alias("output"), F.lit(0).alias("n"), "column", "rec", "at")
    held = reduce(DataFrame.unionByName, taken).groupBy("rec", "at").agg(F.max_by(F.struct("output", "taken"), "by").alias("x")).select("rec", "at", "x.output", "x.taken")
    out = cut(values.join(held, ["rec", "at"], "left").withColumn("n", F.when(~F.col("maskable"), 0).otherwise(F.coalesce("taken", F.lit(-1)))).select(*names, "class"), "mapping-accepted")
    stuck = out.filter("n = -1")
    return (out if stuck.isEmpty() else _swapped(out, stuck, plan)).select(names)


def _swapped(out: DataFrame, stuck: DataFrame, plan: Plan) -> DataFrame:
    """out, where the last value of a space that has only itself left changes places with the value before it."""

    @F.pandas_udf("string")
    def space(column: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([strategies.space_of(plan.columns[c], v) for c, v in zip(column, value, strict=True)], dtype=object)

    taken = out.filter("output is not null").alias("t")
    free = stuck.alias("s").join(taken, _same("s", "t") & (F.col("s.value") == F.col("t.output")), "left_anti")
    free = free.withColumn("space", space("column", "value")).filter("space is not null").dropDuplicates(["domain", "anchor", "space"])
    free = cut(free.select("domain", "anchor", "class", "space", "rec", "at", "value"), "mapping-stuck").alias("s")
    near = taken.join(F.broadcast(free), _same("t", "s", "class")).filter(F.struct("t.rec", "t.at") < F.struct("s.rec", "s.at"))
    near = near.select("t.*", F.col("s.space"), F.col("s.rec").alias("s_rec"), F.col("s.at").alias("s_at"), F.col("s.value").alias("s_value")).filter(space("column", "value") == F.col("space"))
    pairs = cut(near.groupBy("s_rec", "s_at", "s_value").agg(F.max(F.struct("rec", "at", "output")).alias("p")), "mapping-swapped")
    ends = pairs.select(F.col("s_rec").alias("rec"), F.col("s_at").alias("at"), F.col("p.output").alias("to")).unionByName(pairs.select("p.rec", "p.at", F.col("s_value").alias("to")))
    changed = F.col("to").isNotNull()
    return out.join(F.broadcast(ends), ["rec", "at"], "left").withColumn("output", F.coalesce("to", "output")).withColumn("n", F.when(changed, SWAPPED).otherwise(F.col("n"))).drop("to")


def _has_slots(value: str) -> Column:
    @F.pandas_udf("boolean")
    def of(v: pd.Series) -> pd.Series:
        return v.map(lambda x: bool(strategies.slots(x))).astype(bool)

    return of(value)


def _last_of(entries: DataFrame, n: int) -> str:
    """The column of the n-th entry."""
    return entries.orderBy("rec", "at").limit(n).orderBy(F.col("rec").desc(), F.col("at").desc()).first()["column"]


def resolve(df: DataFrame, plan: Plan, key: bytes, zips: DataFrame | None = None, most_entries: int = MOST_ENTRIES, small: int = SMALL_CLASS) -> DataFrame | None:
    """The mapping table (domain, anchor, value, ats, output, n, column): output null where nothing can be masked; n the
    preference taken, or SWAPPED; column the one that created the entry; ats all positions it occurs in. None if the plan maps
    nothing. zips: what zip_lists makes."""
    if not any(r.is_mapping for r in plan.columns.values()):
        return None
    keys = mapping_keys(df, plan).withColumn("class", class_of(plan))
    keys = cut(keys.select("domain", "anchor", "value", "seed_domain", "seed", "column", "ats", "first.rec", "first.at", "class"), "mapping-keys")
    if most_entries and all(r.strategy == "HashId" or strategies.can_number(r) for r in plan.columns.values() if r.is_mapping) and keys.count() > most_entries:
        # Such lists reach an output for every value, so the entry that is one too many is known before any is made.
        some = keys.filter(~F.col("column").isin([c for c, r in plan.columns.items() if r.strategy == "HashId"]) | _has_slots("value"))
        if some.count() > most_entries:
            raise MappingLimitExceeded(_last_of(some, most_entries + 1))
    sizes = keys.groupBy("domain", "anchor", "class").agg(F.count(F.lit(1)).alias("members"))
    s = sizes.select(F.col("domain").alias("d"), F.col("anchor").alias("a"), F.col("class").alias("c"), "members")
    sized = keys.join(s, (F.col("domain") == F.col("d")) & F.col("anchor").eqNullSafe(F.col("a")) & (F.col("class") == F.col("c"))).drop("d", "a", "c")
    parts = [with_lists(sized.filter(F.col("members") <= small).drop("members"), plan, zips).groupBy("domain", "anchor", "class").applyInPandas(_walked(plan, key), OUT)]
    if not sizes.filter(F.col("members") > small).isEmpty():
        parts.append(_accepted(sized.filter(F.col("members") > small).drop("members"), plan, key, zips))
    mapping = cut(reduce(DataFrame.unionByName, parts), "mapping")
    if ended := mapping.filter("n = -1").orderBy("rec", "at").first():
        raise UniqueValueExhausted(ended["column"])
    entries = mapping.filter("output is not null")
    if most_entries and entries.count() > most_entries:
        raise MappingLimitExceeded(_last_of(entries, most_entries + 1))
    return mapping
