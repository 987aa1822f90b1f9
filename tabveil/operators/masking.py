"""Masking a table by a plan: every column becomes an expression, mapped columns join their mapping table."""

from __future__ import annotations

import atexit
import weakref
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import dates, numbers, seeds, text
from tabveil.functions.binding import Steps, inline, let, staged
from tabveil.operators import mapping as unique
from tabveil.operators import verify
from tabveil.operators.secret import Secret, SessionClosed
from tabveil.operators.tables import Scope, cut
from tabveil.plans.model import REDACTED, DateShiftOptions, PerturbOptions, Plan, validate

LOREM = (
    "alder amber basin birch bloom brook cedar clay cloud coast copper delta drift dune ember fern field flint forest garden glade grain grove harbor hazel heath hill island ivory "
    "lake larch leaf linen maple marsh meadow mist moss ocean olive opal path pebble pine plain pond quartz rain reed ridge river sand shore silver slate spring stone tide timber valley willow wind"
).split()
ZIP_WARNING = "Without a list of known ZIPs, outputs keep three digits and need not be real places."


def _linked(df: DataFrame, plan: Plan, c: str) -> tuple[Column, Column, str]:
    """(linked to a non-blank anchor, the anchor's value, the seed domain then)."""
    group = plan.group_of(c)
    if not group:
        return F.lit(False), F.lit(None).cast("string"), ""
    anchor = df[f"`{group.anchor}`"]
    return text.has_value(anchor), anchor, group.domain


def lorem(v: Column, state: Column) -> Column:
    """Words from a seeded start, cut to v's length; never ending in a space; starting as v does."""
    n, whole = text.utf16_length(v), " ".join(LOREM)
    start = lambda u: F.element_at(F.array(*[F.lit(sum(len(w) + 1 for w in LOREM[:i]) + 1) for i in range(len(LOREM))]), (seeds.below(u, len(LOREM)) + 1).cast("int"))
    long = F.repeat(F.lit(whole + " "), (F.ceil(n / len(whole)) + 2).cast("int"))
    first_upper = F.substring(v, 1, 1).rlike(r"\p{Lu}")
    cased = lambda out: F.when(first_upper, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), n))).otherwise(out)
    return let(seeds.draw(state), lambda u: let(F.regexp_replace(F.substring(long, start(u), n), r" \z", "a"), cased))


def factor_steps(u: Column, percent: float) -> Steps:
    """As a decimal of 15 significant digits: factors lie between 0 and 2."""
    f = yield F.lit(1 - percent) + F.lit(2 * percent) * u
    exact = F.when(f < 1, F.round(f.cast("decimal(38,20)"), 15)).otherwise(F.round(f.cast("decimal(38,20)"), 14))
    return F.when(f == 1, F.lit(1 + percent / 2).cast("decimal(17,15)")).otherwise(exact.cast("decimal(17,15)"))


def perturb_steps(v: Column, o: PerturbOptions, factor: Column) -> Steps:
    """v times factor in v's own shape; null if v is no number; zero stays as it is."""
    p = yield from numbers.parse_steps(v)
    written = yield from numbers.write_steps((yield from numbers.times_steps(p, factor, o.is_count)), p)
    return F.when(p["digits"] == 0, v).when(p["digits"].isNotNull(), written)


def perturbed(v: Column, o: PerturbOptions, factor: Column) -> Column:
    return inline(perturb_steps(v, o, factor))


def offset_days(state: Column, o: DateShiftOptions) -> Column:
    """From a bound state."""
    steps = o.max_days // 7 if o.keep_weekday else o.max_days
    return F.when(seeds.below(seeds.draw(state), 2) == 0, -1).otherwise(1) * (seeds.below(seeds.draw(state, 2), steps) + 1) * (7 if o.keep_weekday else 1)


def global_offset(key: bytes, domain: str, o: DateShiftOptions) -> int:
    d = seeds.Draws(key, domain, seeds.GLOBAL)
    sign = -1 if d.below(2) == 0 else 1
    return sign * 7 * (1 + d.below(o.max_days // 7)) if o.keep_weekday else sign * (1 + d.below(o.max_days))


def global_factor(key: bytes, domain: str, percent: float) -> Decimal:
    """What factor_steps makes of the draw that a whole column shares."""
    f = (1 - percent) + 2 * percent * seeds.Draws(key, domain, seeds.GLOBAL).unit()
    f = 1 + percent / 2 if f == 1 else f
    return Decimal(repr(f)).quantize(Decimal(1).scaleb(-15 if f < 1 else -14), ROUND_HALF_UP)


def plain_steps(df: DataFrame, plan: Plan, c: str, secret: Secret) -> Steps:
    """The output of a column that needs no mapping; null where it can't be masked."""
    rule, v = plan.columns[c], df[f"`{c}`"]
    key = secret.pads() if rule.strategy not in ("Keep", "Redact") else None
    o, domain = rule.chosen, rule.domain or c
    if rule.strategy == "Keep":
        return v
    if rule.strategy == "Redact":
        return F.lit(o.text)
    if rule.strategy == "Lorem":
        return lorem(v, (yield from seeds.seed_steps(key, F.lit(domain), v)))
    if rule.strategy == "Custom":
        return o.make(v, (yield seeds.digest(key, F.lit(domain), v)))
    linked, anchor, entity = _linked(df, plan, c)
    if rule.strategy == "Perturb":
        if o.mode == "PerRow":
            state = yield from seeds.seed_steps(key, F.lit(domain), v, F.concat(F.lit("row:"), df["_rec"].cast("string")))
            factor = yield from factor_steps(seeds.unit(seeds.draw(state)), o.percent)
        else:
            factor = secret.hidden(global_factor(secret.key(), domain, o.percent), "decimal(17,15)")
        if o.mode == "PerEntity":
            state = yield from seeds.seed_steps(key, F.lit(entity), anchor, F.lit("perturb"))
            own = yield from factor_steps(seeds.unit(seeds.draw(state)), o.percent)
            factor = yield F.when(linked, own).otherwise(factor)
        factor = yield factor
        return (yield from perturb_steps(v, o, factor))
    days = secret.hidden(global_offset(secret.key(), domain, o), "int")
    if o.mode == "PerEntity":
        state = yield from seeds.seed_steps(key, F.lit(entity), anchor, F.lit("dateshift"))
        days = F.when(linked, offset_days(state, o)).otherwise(days)
    days = yield days
    return dates.shift(v, days, o.formats)


#: Entries of the mapping table up to which it is broadcast; some tens of MB.
BROADCAST_ENTRIES = 200_000


@dataclass
class Masked:
    """rows: the masked table with _rec. sides has source, output and flag of each column. Both compute when they are
    used and read the session's mapping, so they end with the session."""

    rows: DataFrame
    sides: DataFrame
    mapping: DataFrame | None
    plan: Plan
    warnings: dict[str, str]
    session: MaskingSession

    def verification(self) -> DataFrame:
        """The report, from a pass of its own over the source."""
        self.session.check_open()
        return verify.report(verify.prepared(self.sides, self.plan).agg(*verify.facts(self.plan)).first(), self.mapping, self.plan, self.warnings)

    def written(self, save: Callable[[DataFrame], None]) -> DataFrame:
        """Hands the rows to save, which must write them all in one action, and returns the report on them: its counts
        and sums are made by the tasks that write, so the source is read once."""
        self.session.check_open()
        seen = Observation()
        save(_rows(verify.prepared(self.sides, self.plan).observe(seen, *verify.facts(self.plan)), self.plan))
        return verify.report(Row(**seen.get), self.mapping, self.plan, self.warnings)

    def visit(self, on_row: Callable[[Row], bool | None]) -> int:
        """Calls on_row for each masked row, partition by partition, until it returns False; the number of calls."""
        self.session.check_open()
        n = 0
        for row in self.rows.toLocalIterator():
            n += 1
            if on_row(row) is False:
                break
        return n

    def close(self) -> None:
        self.session.close()


def _rows(sides: DataFrame, plan: Plan) -> DataFrame:
    return sides.select("_rec", *[F.col(f"`{c}`.output").alias(c) for c in plan.columns])


def _joined_apart(df: DataFrame, plan: Plan, columns: list[str], table: DataFrame) -> DataFrame:
    """A broadcast join for each mapped column: the table stays in place."""
    for i, c in enumerate(columns):
        if plan.columns[c].is_mapping:
            linked, anchor, _ = _linked(df, plan, c)
            m = table.filter(F.col("domain") == plan.mapping_domain(c)).select(F.col("anchor").alias(f"_a{i}"), F.col("value").alias(f"_v{i}"), F.col("output").alias(f"_o{i}"))
            same = F.col(f"`{c}`") == F.col(f"_v{i}")
            if plan.group_of(c):
                same = same & F.when(linked, anchor).eqNullSafe(F.col(f"_a{i}"))
            df = df.join(F.broadcast(m), same, "left").drop(f"_a{i}", f"_v{i}")
    return df


def _joined_at_once(df: DataFrame, plan: Plan, columns: list[str], table: DataFrame) -> DataFrame:
    """One join for all mapped columns: cells are lined up as (_rec, at, key), find their outputs, and come back to their
    records. The table itself is shuffled once, however many columns are mapped. Records must have numbers of their own."""
    cells, mapped = [], [i for i, c in enumerate(columns) if plan.columns[c].is_mapping]
    for i in mapped:
        linked, anchor, _ = _linked(df, plan, columns[i])
        v = df[f"`{columns[i]}`"]
        anchor = F.when(linked, anchor) if plan.group_of(columns[i]) else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("at"), F.lit(plan.mapping_domain(columns[i])).alias("domain"), anchor.alias("anchor"), F.when(text.has_value(v), v).alias("value")))
    each = df.select("_rec", F.explode(F.array(*cells)).alias("x")).select("_rec", "x.*").filter(F.col("value").isNotNull()).alias("c")
    m = table.select("domain", "anchor", "value", "output").alias("m")
    same = reduce(lambda a, k: a & F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")), ("anchor", "value"), F.col("c.domain") == F.col("m.domain"))
    found = each.join(m, same).groupBy(F.col("c._rec").alias("_found")).agg(*[F.max(F.when(F.col("c.at") == i, F.col("m.output"))).alias(f"_o{i}") for i in mapped])
    return df.join(found, F.col("_rec") == F.col("_found"), "left").drop("_found")


_OPEN: weakref.WeakSet[MaskingSession] = weakref.WeakSet()


class MaskingSession:
    """A key, and the mappings made with it: what is masked in one session agrees, and nothing of it outlives close().

    key: 32 bytes; fresh ones if none are given, so nothing can be undone. zips: known ZIPs, a table (see
    mapping.zip_lists) or lists by prefix. Tables from source to output are cut below a folder of the session's own; close()
    deletes it and overwrites the key, after which nothing of the session runs. A session left open is closed with the
    process.
    """

    def __init__(self, spark: SparkSession, key: bytes | None = None, zips: DataFrame | dict[str, list[str]] | None = None, most_entries: int = unique.MOST_ENTRIES):
        self._spark, self._secret, self._scope, self._most = spark, Secret(spark, key), Scope(spark, "masking"), most_entries
        if isinstance(zips, dict):
            zips = spark.createDataFrame([(z,) for listed in zips.values() for z in listed], "zip string")
        self.has_zips = zips is not None
        with self._scope.active():
            self._zips = cut(unique.zip_lists(zips), "zip-lists") if zips is not None else None
        _OPEN.add(self)

    def __enter__(self) -> MaskingSession:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def folder(self) -> str:
        return self._scope.folder

    def check_open(self) -> None:
        if self._scope.closed:
            raise SessionClosed

    def close(self) -> None:
        self._secret.wipe()
        self._scope.close()
        _OPEN.discard(self)

    def mask(self, df: DataFrame, plan: Plan) -> Masked:
        """df: string columns and _rec, the record number of each row (2 for the first, as a header is record 1).

        Fails before any work if the plan does not fit. Nulls, empty and white-space cells pass through; what a
        strategy can't mask becomes [REDACTED].
        """
        self.check_open()
        columns = [c for c in df.columns if c != "_rec"]
        validate(plan, columns)
        plan = Plan({c: plan.columns[c] for c in columns}, plan.groups)
        with self._scope.active():
            table = unique.resolve(df, plan, self._secret.key(), self._zips, self._most)
        out = df
        if table is not None:
            small = table.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
            out = (_joined_apart if small else _joined_at_once)(df, plan, columns, table)
        out = staged(out, {f"_o{i}": plain_steps(df, plan, c, self._secret) for i, c in enumerate(columns) if not plan.columns[c].is_mapping})
        has = lambda c: text.has_value(F.col(f"`{c}`"))
        side = [F.struct(F.col(f"`{c}`").alias("source"), F.when(has(c), F.coalesce(f"_o{i}", F.lit(REDACTED))).otherwise(F.col(f"`{c}`")).alias("output"), (has(c) & F.col(f"_o{i}").isNull()).alias("unmaskable")).alias(c) for i, c in enumerate(columns)]
        sides = out.select("_rec", *side)
        warnings = {c: ZIP_WARNING for c, r in plan.columns.items() if r.strategy == "ZipRemap" and not self.has_zips}
        return Masked(_rows(sides, plan), sides, table, plan, warnings, self)

    def preview(self, df: DataFrame, plan: Plan, n: int = 20) -> DataFrame:
        """The first n rows as the whole run will write them: mappings are made in order, so a prefix has the same ones."""
        return self.mask(df.orderBy("_rec").limit(n), plan).rows.orderBy("_rec")


@atexit.register
def _close_all() -> None:
    for session in list(_OPEN):
        try:
            session.close()
        except Exception:  # noqa: BLE001  the gateway may be gone; then so is the driver
            pass


def mask(df: DataFrame, plan: Plan, key: bytes | None = None, zips: DataFrame | dict[str, list[str]] | None = None, most_entries: int = unique.MOST_ENTRIES) -> Masked:
    """Masks df in a session of its own; close the result once it is written. See MaskingSession."""
    session = MaskingSession(df.sparkSession, key, zips, most_entries)
    try:
        return session.mask(df, plan)
    except BaseException:
        session.close()
        raise


def preview(df: DataFrame, plan: Plan, key: bytes, n: int = 20, **how) -> DataFrame:
    """MaskingSession.preview in a session of its own."""
    return MaskingSession(df.sparkSession, key, **how).preview(df, plan, n)
