"""Profiling: what each column of a table holds, what it means, and how it should be masked.

All measures of all columns come from one aggregation over the rows. Distinct values of whole tables are estimated from
sketches of 2^14 registers, which are tables of their own and can be merged; columns of few values are then counted.
Dates need the histogram of formats that the values match, and the order of the rows, so they take a second pass, over
the columns that may hold dates.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import dates, text
from tabveil.functions.binding import staged
from tabveil.functions.names import Hints
from tabveil.operators.tables import cut
from tabveil.plans import model

SAMPLE_ROWS = 50_000
SAMPLES = 5
EXACT_DISTINCT = 1_000
MATCH, ID_RATIO, NEAR_UNIQUE, MOST_CATEGORIES, LEAST_RATIO, LONG_TEXT = 0.95, 0.5, 0.9, 50, 0.01, 60
GIVE_UP_AFTER = 200
#: Record numbers in a slice of a running sum.
SLICE = 16_384
#: Spellings of truth values, in pairs of bits.
FOLDED = ("N", "Y", "NO", "YES", "F", "T", "FALSE", "TRUE", "0", "1")
BOOLEANS = tuple(3 << i for i in range(0, len(FOLDED), 2))
SKETCH_BITS = 14
#: Bits of a hash that a register looks at.
RANK_BITS = 64 - SKETCH_BITS
#: Over a cell's value v, its length n and whether it has a digit d, or digits only a.
PREDICATES = {
    "n_digit": lambda v, n, d, a: a, "n_leading_zero": lambda v, n, d, a: a & (n > 1) & v.startswith("0"), "n_whitespace": lambda v, n, d, a: text.has_space_or_tab(v),
    "n_email": lambda v, n, d, a: text.is_email(v), "n_zip5": lambda v, n, d, a: a & (n == 5), "n_zip_plus4": lambda v, n, d, a: d & ~a & (n == 10) & text.is_zip_plus4(v),
    "n_short_zip": lambda v, n, d, a: a & n.between(3, 4), "n_digit_no_whitespace": lambda v, n, d, a: d & ~text.has_space_or_tab(v),
    "n_formatted_phone": lambda v, n, d, a: d & ~a & (n >= 12) & text.is_formatted_phone(v), "n_phone_like": lambda v, n, d, a: d & (n >= 7) & text.is_phone_like(v),
    "n_state": lambda v, n, d, a: ~d & text.is_state(v),
}


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_rec"]


def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by record number. The last of their numbers is found by a top-k over the numbers alone; the rows
    stay in their partitions."""
    last = df.select("_rec").orderBy("_rec").limit(rows).agg(F.max("_rec")).first()[0]
    return df.filter(F.col("_rec") <= last) if last is not None else df.limit(0)


def _cells(df: DataFrame) -> DataFrame:
    """(position, value, null, length, digit, digits, shape) of each cell, in flat columns, which nothing evaluates twice:
    value is null if the cell has none, digit says whether there is one, digits whether there is nothing else."""
    each = df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in data_columns(df)])).alias("position", "v"))
    each = each.select("position", F.col("v").isNull().alias("null"), F.when(text.has_value(F.col("v")), F.col("v")).alias("value"))
    each = each.withColumns({"length": text.utf16_length(F.col("value")), "digit": F.coalesce(text.has_digit(F.col("value")), F.lit(False))})
    each = each.withColumn("digits", F.col("digit") & text.is_all_digits(F.col("value")))
    return staged(each, {"shape": text.number_steps(F.col("value"))})


def _measures(counted: bool) -> dict[str, Column]:
    """Sums, extremes and flags alone, so that Spark generates code for the aggregation; counted adds distinct values."""
    value, shape, length, null, digit, digits = (F.col(c) for c in ("value", "shape", "length", "null", "digit", "digits"))
    folded = F.when(length <= 5, F.upper(value))
    is_folded = folded.isin(*FOLDED)
    bit = reduce(lambda rest, i: F.when(folded == FOLDED[i], 1 << i).otherwise(rest), range(len(FOLDED)), F.lit(None).cast("int"))
    m = {
        "n_rows": F.count(F.lit(1)), "n_null": F.count_if(null), "n_blank": F.count_if(~null & value.isNull()), "n_values": F.count_if(value.isNotNull()),
        "min_length": F.coalesce(F.min(length), F.lit(0)), "max_length": F.coalesce(F.max(length), F.lit(0)), "sum_length": F.coalesce(F.sum(length), F.lit(0)),
        "n_numeric": F.count_if(shape.isNotNull()), "n_integer": F.count_if(shape["is_integer"]), "max_scale": F.coalesce(F.max(shape["scale"]), F.lit(0)),
        "any_thousands": F.coalesce(F.bool_or(shape["thousands"]), F.lit(False)), "any_currency": F.coalesce(F.bool_or(shape["currency"]), F.lit(False)), "any_parentheses": F.coalesce(F.bool_or(shape["parentheses"]), F.lit(False)),
        "folded": F.coalesce(F.bit_or(F.when(is_folded, bit)), F.lit(0)), "n_folded": F.count_if(is_folded), "n_maybe_date": F.count_if(F.coalesce(dates.may_be_date(value), F.lit(False))),
    }
    m |= {"n_distinct": F.count_distinct(value)} if counted else {}
    return m | {n: F.count_if(F.coalesce(p(value, length, digit, digits), F.lit(False))) for n, p in PREDICATES.items()}


def measures(df: DataFrame, exact: bool = True, distinct: bool = True) -> DataFrame:
    """A row per column of df. exact: distinct counts are exact (for samples); else those of more than EXACT_DISTINCT
    values are estimated, for whole tables. distinct: whether values are counted at all.

    Cells are lined up as (column, cell) in the scan and meet partial sums there, so what is shuffled is a row per
    column and task (and, for exact counts, the distinct values).
    """
    columns = data_columns(df)
    longs = lambda n, e: e.cast("long").alias(n) if n.startswith(("n_", "min_", "max_", "sum_")) else e.alias(n)
    found = _cells(df).groupBy("position").agg(*[longs(n, e) for n, e in _measures(exact and distinct).items()])
    named = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    found = named.join(found, "position", "left")  # a table without rows has measures too
    if distinct and not exact:
        found = found.join(distinct_counts(df), "position", "left")
    numbers = [n for n, k in found.dtypes if k in ("bigint", "int") and n != "position"]
    flags = [n for n, k in found.dtypes if k == "boolean"]
    return _with_rates(found.fillna(0, numbers).fillna(False, flags))


def _with_rates(found: DataFrame) -> DataFrame:
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return found.withColumns({"null_rate": share("n_null", "n_rows"), "blank_rate": share("n_blank", "n_rows"), "mean_length": share("sum_length", "n_values")})


def merged_measures(*parts: DataFrame) -> DataFrame:
    """The measures of tables that lie end to end, from their own, without a look at rows. Distinct values don't add up:
    merge the sketches for these."""
    parts = [p.drop("null_rate", "blank_rate", "mean_length", "n_distinct") for p in parts]
    some = reduce(DataFrame.unionByName, parts)
    has = lambda c: F.when(F.col("n_values") > 0, F.col(c))  # noqa: E731  lengths of no values are 0
    how = {"min_length": F.min(has("min_length")), "max_length": F.max(has("max_length")), "max_scale": F.max("max_scale"), "folded": F.bit_or("folded")}
    how |= {n: F.bool_or(n) for n, k in some.dtypes if k == "boolean"}
    how |= {n: F.sum(n) for n in some.columns if n not in how and n not in ("position", "column")}
    found = some.groupBy("position", "column").agg(*[F.coalesce(e, F.lit(0)).alias(n) if n in ("min_length", "max_length") else e.alias(n) for n, e in how.items()])
    return _with_rates(found.select(*some.columns))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, value) of the cells that have a value, of some columns."""
    at = {c: i for i, c in enumerate(data_columns(df))}
    cells = F.array(*[F.struct(F.lit(at[c]).alias("position"), F.col(f"`{c}`").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.position", "x.value").filter(text.has_value(F.col("value")))


def distinct_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, register, rank): HyperLogLog registers of each column's values, those that are set. A table of at most
    2^SKETCH_BITS rows a column, which can be written and kept."""
    h = F.xxhash64("value")
    rest = F.shiftrightunsigned(h, SKETCH_BITS)
    rank = F.when(rest == 0, RANK_BITS + 1).otherwise(F.round(F.log2(rest.bitwiseAND(-rest).cast("double"))) + 1).cast("int")
    each = _values(df, columns or data_columns(df)).select("position", h.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int").alias("register"), rank.alias("rank"))
    return each.groupBy("position", "register").agg(F.max("rank").alias("rank"))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("position", "register").agg(F.max("rank").alias("rank"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """(position, n_distinct): estimates with a standard error of 0.8 %; from the unset registers while these tell more."""
    m = 1 << SKETCH_BITS
    sums = sketches.groupBy("position").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n_set"))
    unset = m - F.col("n_set")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + unset)
    return sums.select("position", F.round(F.when((raw <= 5 * m) & (unset > 0), m * F.log(m / unset)).otherwise(raw)).cast("long").alias("n_distinct"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(position, n_distinct) of whole tables: exact up to EXACT_DISTINCT values, estimated beyond. Only columns whose
    sketch says that they may have so few are counted; their values collapse before they are shuffled."""
    estimated = {r["position"]: r["n_distinct"] for r in sketched_counts(distinct_sketches(df)).collect()}  # a row a column
    few = [c for i, c in enumerate(data_columns(df)) if 0 < estimated.get(i, 0) <= 1.05 * EXACT_DISTINCT]
    if few:
        exact = _values(df, few).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect()
        estimated |= {r["position"]: r["n"] for r in exact}
    return df.sparkSession.createDataFrame(list(estimated.items()), "position int, n_distinct long")


def date_masks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mask, n_values) over values: which of the formats each matches."""
    columns = columns or data_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), dates.format_mask(F.col(f"`{c}`"), Hints.of(c).date).alias("mask")) for c in columns]
    each = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter(text.has_value(F.col("value")))
    return each.groupBy("column", "mask").agg(F.count(F.lit(1)).alias("n_values"))


def date_give_up(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, gave_up): at some value from the 200th on, fewer than 95 % of those so far were dates."""
    columns = columns or data_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), (dates.format_mask(F.col(f"`{c}`"), Hints.of(c).date) != 0).cast("int").alias("hit")) for c in columns]
    each = df.select("_rec", F.explode(F.array(*cells)).alias("x")).select("_rec", "x.*").filter(text.has_value(F.col("value")))
    # Running sums inside slices of records, from what the slices before add up to.
    # They are cut, since trying all formats is most of the work and both passes need what it finds.
    each = cut(each.select("column", F.floor(F.col("_rec") / SLICE).alias("slice"), "_rec", "hit"), "give-up")
    totals = each.groupBy("column", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    earlier = Window.partitionBy("column").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("column", "slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "h")])
    w = Window.partitionBy("column", "slice").orderBy("_rec").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("column", "slice", F.count(F.lit(1)).over(w).alias("n"), F.sum("hit").over(w).alias("h")).join(offsets, ["column", "slice"])
    run = run.select("column", (F.col("n") + F.col("n_before")).alias("seen"), (F.col("h") + F.col("h_before")).alias("hits"))
    return run.groupBy("column").agg(F.bool_or((F.col("seen") >= GIVE_UP_AFTER) & (F.col("hits") < MATCH * F.col("seen"))).alias("gave_up"))


def sample_values(df: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(column, samples): the first distinct values in row order. Real data: never log it."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in data_columns(df)]
    each = df.select("_rec", F.explode(F.array(*cells)).alias("x")).select("_rec", "x.*").filter(text.has_value(F.col("value")))
    firsts = each.groupBy("column", "value").agg(F.min("_rec").alias("rec"))
    top = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy("rec", "value"))).filter(F.col("nth") <= n)
    return top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("s")).select("column", F.col("s.value").alias("samples"))


def with_hints(measured: DataFrame, columns: list[str]) -> DataFrame:
    """Adds what the column names say, as columns."""
    rows = []
    for c in columns:
        h = Hints.of(c)
        kind = h.name_kind
        rows.append((c, h.zip, h.phone, h.state, h.city, h.address, h.count, h.measure, h.id, kind[0] if kind else "none"))
    names = "column string, hint_zip boolean, hint_phone boolean, hint_state boolean, hint_city boolean, hint_address boolean, hint_count boolean, hint_measure boolean, hint_id string, hint_name string"
    return measured.join(measured.sparkSession.createDataFrame(rows, names), "column")


def detected_type() -> Column:
    """The rules, first match wins, over a row of measures with hints and is_date, has_time."""
    c = F.col
    n = c("n_values")
    share = lambda x: (n > 0) & (x >= MATCH * n)
    ratio = c("n_distinct") / F.greatest(n, F.lit(1))
    numeric = share(c("n_numeric"))
    integers = numeric & (c("n_integer") == c("n_numeric"))
    plain = integers & ~c("any_thousands") & ~c("any_currency")
    no_measure = ~c("hint_count") & ~c("hint_measure")
    rules = [
        (n == 0, "Empty"),
        (share(c("n_email")), "Email"),
        ((c("hint_zip") & share(c("n_zip5") + c("n_zip_plus4") + c("n_short_zip"))) | share(c("n_zip_plus4")), "Zip"),
        ((c("hint_phone") & share(c("n_phone_like"))) | share(c("n_formatted_phone")), "Phone"),
        (c("is_date") & c("has_time"), "DateTime"),
        (c("is_date"), "Date"),
        ((c("n_distinct") <= 4) & (c("n_folded") == n) & c("folded").isin(*BOOLEANS), "Boolean"),
        (share(c("n_state")) & (c("hint_state") | (c("n_distinct") >= 5)), "State"),
        (c("hint_id") == "strong", "Identifier"),
        ((c("hint_id") == "weak") & ((ratio > ID_RATIO) | (c("n_leading_zero") > 0)), "Identifier"),
        (share(c("n_digit")) & (c("n_leading_zero") > 0), "Identifier"),
        (no_measure & (c("min_length") == c("max_length")) & (c("min_length") >= 4) & share(c("n_digit_no_whitespace")) & ((c("n_numeric") == 0) | plain) & (ratio > ID_RATIO), "Identifier"),
        (no_measure & plain & (ratio > NEAR_UNIQUE), "Identifier"),
        (c("hint_name") == "person", "PersonName"),
        (c("hint_name") == "org", "OrgName"),
        (c("hint_city"), "City"),
        (c("hint_address"), "Address"),
        (integers & c("hint_count"), "Count"),
        (numeric & (c("hint_measure") | (c("max_scale") > 0) | c("any_currency")), "Measure"),
        ((c("n_distinct") <= MOST_CATEGORIES) | (ratio < LEAST_RATIO), "Categorical"),
        (numeric, "Measure"),
        ((c("sum_length") > LONG_TEXT * n) | ((ratio > ID_RATIO) & (2 * c("n_whitespace") >= n)), "FreeText"),
    ]
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("Text"))


def suggested_strategy(kind: Column) -> Column:
    of = {"HashId": ("Identifier",), "ZipRemap": ("Zip",), "Fake": ("Email", "Phone", "PersonName", "OrgName", "Address", "City"), "Keep": ("State", "Boolean", "Categorical", "Empty"), "DateShift": ("Date", "DateTime"), "Perturb": ("Measure", "Count")}
    return reduce(lambda rest, s: F.when(kind.isin(*s[1]), s[0]).otherwise(rest), of.items(), F.lit("Redact"))


def profile(df: DataFrame, sample_rows: int | None = SAMPLE_ROWS, with_samples: bool = False, is_whole: bool | None = None) -> DataFrame:
    """A row per column: measures, type, strategy, formats, ambiguous, estimated.

    sample_rows: how many of the first rows are looked at, None for all, whose distinct counts are then estimated.
    is_whole: whether df is all there is, where the caller has cut the sample.
    """
    spark = df.sparkSession
    rows, whole = df, sample_rows is None
    if is_whole is not None:
        whole = is_whole
    elif not whole:
        whole = df.limit(sample_rows + 1).count() <= sample_rows
        rows = sampled(df, sample_rows)
    columns = data_columns(df)
    # One row a column: taken to the driver, so that nothing computes it twice.
    measured = measures(rows, exact=sample_rows is not None)
    measured = spark.createDataFrame(measured.collect(), measured.schema)
    hopeful = [r["column"] for r in measured.select("column", "n_values", "n_maybe_date", "n_digit").collect() if r["n_values"] and (r["n_maybe_date"] + Hints.of(r["column"]).date * r["n_digit"]) >= MATCH * r["n_values"]]
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    for r in date_masks(rows, hopeful).collect() if hopeful else []:
        histogram[r["column"]][r["mask"]] = r["n_values"]
    matching = [c for c, h in histogram.items() if sum(k for m, k in h.items() if m) >= MATCH * sum(h.values())]
    missing = [c for c in matching if 0 in histogram[c]]  # columns of dates alone give up nowhere
    gave_up = {r["column"] for r in date_give_up(rows, missing).filter("gave_up").collect()} if missing else set()
    found = []
    for c in data_columns(df):
        h = histogram[c]
        is_date = c in matching and c not in gave_up
        chosen = dates.cover(h) if is_date else []
        found.append((c, is_date, any(dates.CANDIDATES[i].has_time for i in chosen), [dates.FORMATS[i] for i in chosen], is_date and dates.is_ambiguous(chosen, h)))
    dated = spark.createDataFrame(found, "column string, is_date boolean, has_time boolean, formats array<string>, ambiguous boolean")
    out = with_hints(measured, columns).join(dated, "column").withColumn("type", detected_type()).withColumn("strategy", suggested_strategy(F.col("type")))
    out = out.withColumn("estimated", F.lit(sample_rows is None or not whole)).withColumn("short_zips", (F.col("type") == "Zip") & (F.col("n_short_zip") > 0))
    if with_samples:
        out = out.join(sample_values(rows), "column", "left")
    return out.drop("folded", "n_folded", "n_maybe_date").orderBy("position")


def entity_groups(types: dict[str, str]) -> tuple[model.EntityGroup, ...]:
    """Anchors are identifiers with a strong name of two words or more; a column whose name begins with an anchor's
    words but the last describes the same entity. The longest beginning wins, then the first anchor."""
    anchors = [(c, h.tokens[:-1]) for c in types if types[c] == "Identifier" and (h := Hints.of(c)).id == "strong" and len(h.tokens) >= 2]
    members: dict[str, list[str]] = defaultdict(list)
    for c, kind in types.items():
        tokens = Hints.of(c).tokens
        fit = [(len(p), a) for a, p in anchors if a != c and len(tokens) > len(p) and tokens[: len(p)] == p]
        if kind in ("PersonName", "OrgName", "Email", "Phone", "Address") and fit:
            longest = max(n for n, _ in fit)
            members[next(a for n, a in fit if n == longest)].append(c)
    return tuple(model.EntityGroup(a, tuple(members[a])) for a, _ in anchors if members[a])


def _fake_kind(kind: str, column: str) -> str:
    h = Hints.of(column)
    person = "PersonFirst" if h.first_name else "PersonLast" if h.last_name else "PersonFull"
    return {"Email": "Email", "Phone": "Phone", "PersonName": person, "OrgName": "Hospital" if h.hospital else "Company", "Address": "StreetAddress", "City": "City"}[kind]


def suggested_plan(profiled: DataFrame) -> model.Plan:
    rows = profiled.select("column", "type", "strategy", "formats").orderBy("position").collect()
    rules = {}
    for r in rows:
        options = None
        if r["strategy"] == "Fake":
            options = model.FakeOptions(_fake_kind(r["type"], r["column"]))
        elif r["strategy"] == "Perturb":
            options = model.PerturbOptions(is_count=r["type"] == "Count")
        elif r["strategy"] == "DateShift":
            options = model.DateShiftOptions(formats=tuple(r["formats"]))
        rules[r["column"]] = model.Rule(r["strategy"], options)
    return model.Plan(rules, entity_groups({r["column"]: r["type"] for r in rows}))
