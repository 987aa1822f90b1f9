"""The registered queries over the driver's tables, one or more for each operator of the engine.

Tables are typed; cells are strings. canonical() fixes the text of each type, so that any engine agrees on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import dates, seeds, strategies, text
from tabveil.functions.binding import Steps, staged
from tabveil.operators import headers, mapping, masking
from tabveil.operators import profile as profiling
from tabveil.plans import model
from tabveil.sources import delimited
from tabveil.operators.tables import shared_folder

#: The key of the demonstration queries; a real run draws its own.
KEY = bytes(range(1, 33))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(df: DataFrame) -> DataFrame:
    """All columns as text: integers plain, doubles with two decimals, times as dates."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            return c.cast("decimal(18,2)").cast("string").alias(name)
        return (F.date_format(c, "yyyy-MM-dd") if kind.startswith("timestamp") else c.cast("string")).alias(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def _orders(spark, d):
    return canonical(table(spark, d, "orders"))


def _customer_cells(spark, d):
    """Customers with derived ZIP and phone columns, and nulls, empties and blanks in c_note."""
    k = F.col("c_custkey")
    area = (200 + k % 700).cast("string")
    return table(spark, d, "customer").select(
        k.cast("string").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"), F.lpad((k % 100000).cast("string"), 5, "0").alias("zip"),
        F.concat(F.lit("("), area, F.lit(") "), area, F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 10 == 1, "").when(k % 10 == 2, "  ").otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("c_note"),
        (k + 1).alias("_rec"),
    )


# Profiling.


def profile_counts(spark, d):
    m = profiling.measures(_customer_cells(spark, d), distinct=False)
    return m.select("column", "n_rows", "n_null", "n_blank", "n_values")


def profile_lengths(spark, d):
    return profiling.measures(_orders(spark, d), distinct=False).select("column", "min_length", "max_length", "sum_length")


def profile_numeric(spark, d):
    m = profiling.measures(canonical(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag")), distinct=False)
    return m.select("column", "n_digit", "n_numeric", "n_integer", "max_scale", "any_thousands", "any_currency")


def profile_patterns(spark, d):
    m = profiling.measures(_customer_cells(spark, d).select("zip", "phone", "c_acctbal"), distinct=False)
    return m.select("column", "n_zip5", "n_zip_plus4", "n_short_zip", "n_formatted_phone", "n_phone_like", "n_leading_zero", "n_state", "n_email")


def pattern_tokens(spark, d):
    """Words of the documents that are e-mail addresses or states."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    return words.agg(F.count(F.lit(1)).alias("n_words"), F.count_if(text.is_email(F.col("w"))).alias("n_email"), F.count_if(text.is_state(F.col("w"))).alias("n_state"), F.count_if(text.has_leading_zero(F.col("w"))).alias("n_leading_zero"))


def distinct_exact(spark, d):
    m = profiling.measures(_orders(spark, d))
    return m.select("column", "n_distinct")


def distinct_estimate_ok(spark, d):
    o = _orders(spark, d)
    exact = profiling.measures(o).select("column", F.col("n_distinct").alias("exact"))
    return profiling.measures(o, exact=False).join(exact, "column").select("column", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_percent"))


def sample_values(spark, d):
    part = canonical(table(spark, d, "part").select("p_partkey", "p_brand", "p_type")).withColumn("_rec", F.col("p_partkey").cast("long") + 1).drop("p_partkey")
    return profiling.sample_values(part).select("column", F.posexplode("samples").alias("at", "value")).select("column", (F.col("at") + 1).alias("nth"), "value")


def _dated(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    us = F.date_format("o_orderdate", "M/d/yyyy")
    return o.select((k + 1).alias("_rec"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), us.alias("ship_date"), F.when(k % 10 == 0, "n/a").otherwise(us).alias("due_date"))


def date_masks(spark, d):
    return profiling.date_masks(_dated(spark, d))


def date_give_up(spark, d):
    return profiling.date_give_up(_dated(spark, d))


def type_detect(spark, d):
    c = _customer_cells(spark, d)
    return profiling.profile(c, sample_rows=None).select("column", "type", "strategy")


def type_detect_orders(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), "*")
    cells = canonical(o.drop("_rec"))
    return profiling.profile(cells.withColumn("_rec", F.col("o_orderkey").cast("long") + 1), sample_rows=None).select("column", "type", "strategy", "ambiguous")


# Names, plans and recipes: headers that the rows of tables make up.


def _title(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 100)))


def _headers(spark, d):
    """(header, position, name): twenty customers a header, their segments as names, some blank, some in another spelling."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 9 == 0, F.when(k % 2 == 0, "")).when(k % 4 == 1, F.concat(F.lit(" "), F.lower(seg), F.lit("  "))).otherwise(seg)
    return table(spark, d, "customer").select(F.floor(k / 20).alias("header"), (k % 20 + 1).cast("int").alias("position"), name.alias("name"))


def _recipes(spark, d):
    """(recipe, updated, position, name, strategy): ten suppliers a recipe."""
    k = F.col("s_suppkey")
    pick = lambda of, at: F.element_at(F.array(*map(F.lit, of)), (at + 1).cast("int"))
    recipe = F.floor(k / 10)
    name = pick(("BUILDING", "machinery", "Household", "FURNITURE ", "AUTOMOBILE"), (k * 7 + recipe) % 5)
    updated = F.lpad((recipe % 7).cast("string"), 3, "0")
    return table(spark, d, "supplier").select(recipe.alias("recipe"), updated.alias("updated"), (k % 10).alias("position"), name.alias("name"), pick(("HashId", "Redact", "Lorem"), k % 3).alias("strategy"))


def header_keys(spark, d):
    return headers.keys(_headers(spark, d)).select("header", "position", "key")


def name_tokens(spark, d):
    """The words of column names in three spellings."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 3 == 0, F.concat(_title(seg), F.lit("Order"), (k % 100).cast("string"))).when(k % 3 == 1, F.concat(seg, F.lit("_ID"))).otherwise(F.concat(F.lower(seg), F.lit("NAME")))
    return headers.tokens(table(spark, d, "customer").select("c_custkey", name.alias("name"))).select("c_custkey", F.array_join("tokens", " ").alias("tokens"))


def header_signature(spark, d):
    return headers.signatures(_headers(spark, d))


def entity_groups(spark, d):
    """A header of four columns for each customer; e-mail columns of every fifth hold something else."""
    k, t = F.col("c_custkey"), _title(F.col("c_mktsegment"))
    column = lambda at, name, kind: F.struct(F.lit(at).alias("position"), name.alias("name"), kind.alias("type"))
    each = F.array(
        column(1, F.concat(t, F.lit("_ID")), F.lit("Identifier")), column(2, F.concat(t, F.lit("_Name")), F.lit("OrgName")),
        column(3, F.concat(t, F.lit("_Email")), F.when(k % 5 == 0, "Text").otherwise("Email")), column(4, F.lit("Region"), F.lit("Categorical")),
    )
    return headers.groups(table(spark, d, "customer").select(k.alias("header"), F.explode(each).alias("c")).select("header", "c.*"))


def recipe_rank(spark, d):
    """The three best recipes for each header."""
    found = headers.ranked(_headers(spark, d), _recipes(spark, d), 3)
    return found.select("header", "place", "recipe", "exact", F.round("score", 9).alias("score"))


def recipe_apply(spark, d):
    """What each recipe that shares a name with a header says of its columns."""
    return headers.assigned(_headers(spark, d), _recipes(spark, d)).select("header", "position", "key", "recipe", "strategy")


def plan_problems(spark, d):
    """A plan of two rules held against the segments of each header."""
    plan = model.Plan({"BUILDING": model.Rule("Keep"), "GHOST": model.Rule("Keep")})

    @F.pandas_udf("array<string>")
    def of(header: pd.Series) -> pd.Series:
        return pd.Series([model.problems(plan, list(h)) for h in header])

    each = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 20).alias("header")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("names"))
    return each.select("header", F.explode(of("names")).alias("problem"))


# Seeds.


def seed_draws(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    state = seeds.seeded(KEY, F.lit("c_name"), F.col("c_name"))
    return c.select("c_custkey", seeds.digest(KEY, F.lit("c_name"), F.col("c_name")).alias("digest"), seeds.below(seeds.draw(state), 1000).alias("first"), seeds.below(seeds.draw(state, 2), 1000).alias("second"), seeds.unit(seeds.draw(state)).alias("unit"))


# Masking.


def _masked(spark, d, source: DataFrame, **rules) -> masking.Masked:
    columns = [c for c in source.columns if c != "_rec"]
    groups = rules.pop("groups", ())
    return masking.mask(source, model.Plan({c: rules.get(c, model.Rule("Keep")) for c in columns}, groups), KEY)


def mask_redact(spark, d):
    src = _customer_cells(spark, d).select("_rec", "c_custkey", "c_note")
    return _masked(spark, d, src, c_note=model.Rule("Redact")).rows.drop("_rec")


def mask_dateshift(spark, d):
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "M/d/yyyy").alias("us"))
    rule = model.Rule("DateShift", model.DateShiftOptions(max_days=45, keep_weekday=True), "day")
    return _masked(spark, d, src, iso=rule, us=rule).rows.drop("_rec")


def mask_dateshift_entity(spark, d):
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("cust"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rule = model.Rule("DateShift", model.DateShiftOptions(max_days=60, mode="PerEntity"))
    return _masked(spark, d, src, day=rule, groups=(model.EntityGroup("cust", ("day",)),)).rows.drop("_rec")


def mask_perturb_row(spark, d):
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    return _masked(spark, d, src, price=model.Rule("Perturb")).rows.drop("_rec")


def mask_perturb_global(spark, d):
    src = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_rec"), F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").cast("string").alias("line"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("l_quantity").cast("int").cast("string").alias("qty"))
    each = model.Rule("Perturb", model.PerturbOptions(mode="Global"))
    return _masked(spark, d, src, price=each, qty=model.Rule("Perturb", model.PerturbOptions(mode="Global", is_count=True))).rows.drop("_rec")


def _as_drawn(column: str) -> Steps:
    """Whether a side of a column perturbed by row differs from its source exactly where the factor drawn for it, times the
    source's digits alone, does not round to these digits."""
    v, o = F.col(f"`{column}`.source"), model.PerturbOptions()
    state = yield from seeds.seed_steps(KEY, F.lit(column), v, F.concat(F.lit("row:"), F.col("_rec").cast("string")))
    factor = yield (yield from masking.factor_steps(seeds.unit(seeds.draw(state)), o.percent))
    digits = yield F.regexp_replace(v, "[^0-9]", "").cast("decimal(20,0)")
    return (v != F.col(f"`{column}`.output")) == (F.round(digits * factor, 0) != digits)


def mask_perturb_shapes(spark, d):
    """Shapes of numbers that survive: what does not look like its source would be FALSE, and so would be what stayed as
    it was, unless its factor rounds it back to itself, or moved although its factor does."""
    k = F.col("o_orderkey")
    p = F.col("o_totalprice").cast("decimal(18,2)")
    v = F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number(p, 2))).when(k % 4 == 1, F.concat(F.lit("("), p.cast("string"), F.lit(")"))).when(k % 4 == 2, F.concat(F.lit(" -"), p.cast("string"))).otherwise(F.concat(F.lit("00"), (k % 9 + 1).cast("string")))
    src = table(spark, d, "orders").select((k + 1).alias("_rec"), k.cast("string").alias("k"), v.alias("v"))
    out = _masked(spark, d, src, v=model.Rule("Perturb"))
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]+(,[0-9]{3})*", "9"), " ", "_")
    return staged(out.sides, {"changed": _as_drawn("v")}).select(F.col("k.source").alias("k"), (shape(F.col("v.source")) == shape(F.col("v.output"))).alias("same_shape"), "changed")


def _invariants(masked: masking.Masked, column: str, pattern: str) -> DataFrame:
    """Counts that say whether a mapping kept what it must keep."""
    s, o = F.col(f"`{column}`.source"), F.col(f"`{column}`.output")
    return masked.sides.agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct(s) == F.count_distinct(o)).alias("injective"), (F.count_distinct(F.struct(s, o)) == F.count_distinct(s)).alias("consistent"), F.count_if(s == o).alias("n_unchanged"), F.count_if(~o.rlike(pattern)).alias("n_misshapen"))


def mask_hashid(spark, d):
    out = _masked(spark, d, _customer_cells(spark, d).select("_rec", "c_name"), c_name=model.Rule("HashId"))
    return _invariants(out, "c_name", r"\A[A-Z][a-z]{7}#[0-9]+\z")


def mask_zip(spark, d):
    src = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("_rec"), F.lpad((F.col("s_suppkey") % 60 + 2000).cast("string"), 5, "0").alias("zip"))
    return _invariants(_masked(spark, d, src, zip=model.Rule("ZipRemap")), "zip", r"\A020[0-9]{2}\z")


def mask_phone(spark, d):
    out = _masked(spark, d, _customer_cells(spark, d).select("_rec", "phone"), phone=model.Rule("Fake", model.FakeOptions("Phone")))
    return _invariants(out, "phone", r"\A\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}\z")


def mask_email(spark, d):
    out = _masked(spark, d, _customer_cells(spark, d).select("_rec", "c_name"), c_name=model.Rule("Fake", model.FakeOptions("Email")))
    return _invariants(out, "c_name", r"\A[a-z]+\.[a-z]+[0-9]+@example\.(com|net|org)\z")


def mask_shared_domain(spark, d):
    """One person in two tables masks the same: columns of a shared domain."""
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("a"), F.lpad((F.col("o_custkey") % 500).cast("string"), 6, "0").alias("b"))
    rule = model.Rule("HashId", None, "person")
    out = _masked(spark, d, src, a=rule, b=rule)
    pairs = out.sides.select(F.explode(F.array("a", "b")).alias("x")).select("x.source", "x.output").distinct()
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count(F.lit(1)) == F.count_distinct("source")).alias("one_output_each"), (F.count(F.lit(1)) == F.count_distinct("output")).alias("one_source_each"))


def mask_linked_identity(spark, d):
    """Names of one entity agree: the full name is the first and the last."""
    c = F.col("c_custkey")
    src = table(spark, d, "customer").select((c + 1).alias("_rec"), (c % 20).cast("string").alias("id"), F.concat(F.lit("First "), (c % 20).cast("string")).alias("first"), F.concat(F.lit("Last "), (c % 20).cast("string")).alias("last"), F.concat(F.lit("Full "), (c % 20).cast("string")).alias("full"))
    fake = lambda kind: model.Rule("Fake", model.FakeOptions(kind))
    out = _masked(spark, d, src, id=model.Rule("HashId"), first=fake("PersonFirst"), last=fake("PersonLast"), full=fake("PersonFull"), groups=(model.EntityGroup("id", ("first", "last", "full")),))
    return out.rows.select(F.concat_ws(" ", "first", "last").alias("whole"), "full").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("whole") == F.col("full")).alias("n_coherent"))


def mask_lorem(spark, d):
    """The whole values; null and blank texts pass through."""
    src = table(spark, d, "documents").select((F.col("doc_id") + 2).alias("_rec"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return _masked(spark, d, src, text=model.Rule("Lorem")).rows.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("masked"))


def mask_hashid_values(spark, d):
    """The outputs themselves. Names have so many digits and letters that the first preference is free."""
    src = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("_rec"), F.col("c_custkey").cast("string").alias("k"), "c_name")
    return _masked(spark, d, src, c_name=model.Rule("HashId", model.HashIdOptions("X-"))).rows.drop("_rec")


def mask_phone_first(spark, d):
    """Each phone's first preference, and whether it is what the phone became: so for all but a handful."""
    out = _masked(spark, d, _customer_cells(spark, d).select("_rec", "phone"), phone=model.Rule("Fake", model.FakeOptions("Phone")))
    rule = model.Rule("Fake", model.FakeOptions("Phone"))

    @F.pandas_udf("string")
    def first(v: pd.Series) -> pd.Series:
        return pd.Series([strategies.choice(rule, KEY, x, "phone", x, 0) for x in v])

    made = out.sides.select(F.col("phone.source").alias("phone"), first(F.col("phone.source")).alias("first"), F.col("phone.output").alias("masked")).distinct()
    few = made.agg((F.count_if(F.col("first") != F.col("masked")) <= 2).alias("few_others"))
    return made.select("phone", "first").withColumn("few_others", F.lit(few.first()[0]))


def _first_choices(kind: str, spark, d):
    """The first preference of each value for a kind of invented text, before values that share it are told apart."""
    rule = model.Rule("Fake", model.FakeOptions(kind, preserve_case=False))

    @F.pandas_udf("string")
    def first(v: pd.Series) -> pd.Series:
        return pd.Series([strategies.choice(rule, KEY, x, kind, x, 0) for x in v])

    return table(spark, d, "customer").select("c_custkey", first("c_name").alias("made"))


def fake_company(spark, d):
    return _first_choices("Company", spark, d)


def fake_city(spark, d):
    return _first_choices("City", spark, d)


def fake_hospital(spark, d):
    return _first_choices("Hospital", spark, d)


def fake_street_address(spark, d):
    return _first_choices("StreetAddress", spark, d)


def fake_person_email(spark, d):
    """A person and the e-mail address of the same seed."""
    full, mail = _first_choices("PersonFull", spark, d), model.Rule("Fake", model.FakeOptions("Email", preserve_case=False))

    @F.pandas_udf("string")
    def address(v: pd.Series) -> pd.Series:
        return pd.Series([strategies.choice(mail, KEY, x, "PersonFull", x, 0) for x in v])

    return full.join(table(spark, d, "customer").select("c_custkey", address("c_name").alias("email")), "c_custkey")


def mask_cities(spark, d):
    """Far more values than the pool has names: all stay different, and all but the first of a name carry a number."""
    out = _masked(spark, d, table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("_rec"), "c_name"), c_name=model.Rule("Fake", model.FakeOptions("City", preserve_case=False)))
    return _invariants(out, "c_name", r"\A[A-Z][a-z]+( [0-9]+)?\z")


def mask_zip_listed(spark, d):
    """With a reference list of ZIPs, outputs come from it as long as it lasts."""
    src = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("_rec"), F.lpad((F.col("s_suppkey") % 5 + 2000).cast("string"), 5, "0").alias("zip"))
    plan = model.Plan({"zip": model.Rule("ZipRemap")})
    out = masking.mask(src, plan, KEY, zips={"020": [f"020{i:02d}" for i in range(40, 60)]})
    return out.sides.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("zip.output").alias("n_outputs"), F.count_if(~F.col("zip.output").between("02040", "02059")).alias("n_unlisted"), F.lit(len(out.warnings)).alias("n_warnings"))


def mask_zip_reference(spark, d):
    """ZIPs remapped to those of a table: outputs, first come, first served."""
    known = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("zip"))
    src = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("_rec"), F.col("s_suppkey").cast("string").alias("k"), F.lpad((F.col("s_suppkey") % 25).cast("string"), 5, "0").alias("zip"))
    return masking.mask(src, model.Plan({"k": model.Rule("Keep"), "zip": model.Rule("ZipRemap")}), KEY, zips=known).rows.drop("_rec")


def mask_perturb_entity(spark, d):
    """One factor for all prices of a customer."""
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    rule = model.Rule("Perturb", model.PerturbOptions(mode="PerEntity"))
    return _masked(spark, d, src, price=rule, groups=(model.EntityGroup("cust", ("price",)),)).rows.drop("_rec")


#: SQL, alike in Spark and DuckDB, that writes the date d in each format that is not digits alone, by its number.
_MONTH = "CASE month({d}) " + " ".join(f"WHEN {i} THEN '{m.capitalize()}'" for i, m in enumerate(dates.MONTHS, 1)) + " END"
_PIECES = {"yyyy": "lpad(concat('', year({d})), 4, '0')", "yy": "lpad(concat('', year({d}) % 100), 2, '0')", "MMMM": _MONTH, "MMM": f"substr({_MONTH}, 1, 3)", "MM": "lpad(concat('', month({d})), 2, '0')", "M": "concat('', month({d}))", "dd": "lpad(concat('', day({d})), 2, '0')", "d": "concat('', day({d}))",
           "HH": "'13'", "H": "'9'", "hh": "'01'", "h": "'1'", "mm": "'45'", "ss": "'07'", "tt": "'PM'", ".FFFFFFF": "'.250'", "K": "'+02:00'"}


def date_sql(pattern: str, d: str, old: str | None = None) -> str:
    """d in a format. old: the date whose width a number keeps: two digits stay two."""
    out = []
    for token in dates.TOKEN.findall(pattern):
        piece = _PIECES.get(token, "'" + token + "'").replace("{d}", d)
        if old and token in ("M", "d"):
            was = _PIECES[token].replace("{d}", old)
            piece = f"CASE WHEN length({was}) = 2 THEN lpad({piece}, 2, '0') ELSE {piece} END"
        out.append(piece)
    return "concat(" + ", ".join(out) + ")"


def dated_sql(day: str, key: str, new: str | None = None) -> str:
    """The text of an order's date: its format goes by the key. Days up to the 12th, which could be months, are written
    the ISO way where the day comes first."""
    cases = []
    for i, f in enumerate(dates.FORMATS):
        text_of = date_sql(f, new or day, day if new else None)
        if dates.CANDIDATES[i].day_first:
            text_of = f"CASE WHEN day({day}) > 12 THEN {text_of} ELSE {date_sql('yyyy-MM-dd', new or day)} END"
        if "MMMM" in f:  # May is written alike in the format before, which is tried first
            text_of = f"CASE WHEN month({day}) = 5 THEN {date_sql(f.replace('MMMM', 'MMM'), new or day, day if new else None)} ELSE {text_of} END"
        cases.append(f"WHEN {i} THEN {text_of}")
    return f"CASE {key} % {len(dates.FORMATS)} {' '.join(cases)} END"


def mask_dateshift_formats(spark, d):
    """Every format, in one column."""
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_orderkey").cast("string").alias("k"), F.expr(dated_sql("cast(o_orderdate as date)", "o_orderkey")).alias("day"))
    return _masked(spark, d, src, day=model.Rule("DateShift", model.DateShiftOptions(max_days=45, keep_weekday=True))).rows.drop("_rec")


def verify_distincts(spark, d):
    src = _customer_cells(spark, d)
    out = _masked(spark, d, src, c_name=model.Rule("HashId"), zip=model.Rule("ZipRemap"), phone=model.Rule("Fake", model.FakeOptions("Phone")))
    return out.verification().filter(F.col("strategy") != "Keep").select("column", "source_distinct", "output_distinct")


def verify_change(spark, d):
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    v = _masked(spark, d, src, price=model.Rule("Perturb", model.PerturbOptions(mode="Global"))).verification()
    return v.select("column", F.col("sum_change_pct").cast("string").alias("sum_change_pct"))


def mask_custom(spark, d):
    """A strategy of one's own: a function of the value and its seed."""
    first = model.Rule("Custom", model.CustomOptions(lambda v, seed: F.concat(F.upper(F.left(v, F.lit(3))), F.lit("-"), F.left(seed, F.lit(8)))))
    return _masked(spark, d, _customer_cells(spark, d).select("_rec", "c_custkey", "c_note"), c_note=first).rows.drop("_rec")


def profile_rates(spark, d):
    return profiling.measures(_customer_cells(spark, d), exact=False).select("column", *[F.round(c, 9).alias(c) for c in ("null_rate", "blank_rate", "mean_length")])


def mapping_limit(spark, d):
    """The column whose value is one too many, and none if the limit suffices."""
    src = _customer_cells(spark, d).select("_rec", "c_custkey", "c_name")
    plan = model.Plan({"c_custkey": model.Rule("HashId"), "c_name": model.Rule("HashId")})
    n, said = src.count(), []
    for most in (2 * n - 1, 2 * n):
        try:
            masking.mask(src, plan, KEY, most_entries=most)
            said.append("none")
        except mapping.MappingLimitExceeded as e:
            said.append(str(e).split("'")[1])
    return spark.createDataFrame([(i, s) for i, s in enumerate(said)], "at int, column string")


def mask_unmaskable(spark, d):
    k = F.col("o_orderkey")
    src = table(spark, d, "orders").select((k + 1).alias("_rec"), F.when(k % 7 == 0, "N/A").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"))
    return _masked(spark, d, src, price=model.Rule("Perturb")).verification().select("column", "n_rows", "n_unmaskable", F.array_join("warnings", "; ").alias("warnings"))


def verify_report(spark, d):
    src = _customer_cells(spark, d)
    out = _masked(spark, d, src, c_name=model.Rule("HashId"), c_note=model.Rule("Redact"), zip=model.Rule("ZipRemap"), c_acctbal=model.Rule("Perturb", model.PerturbOptions(mode="Global")))
    return out.verification().select("column", "strategy", "n_rows", "source_nulls", "output_nulls", "n_unchanged", F.array_join("failures", "; ").alias("failures"))


def verify_sums(spark, d):
    src = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("_rec"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    v = _masked(spark, d, src, price=model.Rule("Perturb", model.PerturbOptions(mode="Global"))).verification()
    return v.select("column", F.col("source_sum").cast("decimal(18,2)").cast("string").alias("source_sum"), F.col("output_sum").cast("decimal(18,2)").cast("string").alias("output_sum"))


def preview_equals_run(spark, d):
    src = _customer_cells(spark, d).select("_rec", "c_name", "zip")
    plan = model.Plan({"c_name": model.Rule("HashId"), "zip": model.Rule("ZipRemap")})
    whole = masking.mask(src, plan, KEY).rows.orderBy("_rec").limit(20)
    early = masking.preview(src, plan, KEY)
    return early.join(whole, ["_rec", "c_name", "zip"], "full").agg(F.count(F.lit(1)).alias("n_rows"))


def mapping_rounds_equal_walk(spark, d):
    """Large classes, resolved in rounds, against the same values walked through one by one."""
    src = _customer_cells(spark, d).select("_rec", F.lpad((F.col("c_custkey").cast("long") * 7 % 8999 + 1000).cast("string"), 4, "0").alias("id"))
    plan = model.Plan({"id": model.Rule("HashId")})
    walked, rounds = (mapping.resolve(src, plan, KEY, small=n).select("value", "output") for n in (mapping.SMALL_CLASS, 0))
    return walked.exceptAll(rounds).agg(F.count(F.lit(1)).alias("n_different"))


# Delimited text.


def _one_file(spark, lines: DataFrame) -> str:
    """lines (at, value) as one file in the order of at: ranges are written and put together in parallel."""
    folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    lines.repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.option("lineSep", "\n").text(folder)
    delimited.join_parts(spark, folder, f"{folder}/whole.csv")
    return f"{folder}/whole.csv"


@contextmanager
def _small_splits(spark, path: str | None = None):
    """Splits of 32 kB, so that files of small tables are read in many, too; of a larger file at path, a 256th of it, up to
    the session's own size. Reading is done when the block ends."""
    names_ = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names_}
    size = 32 * 1024
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
        size = max(size, min(whole // 256, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[names_[0]])))
    for n in names_:
        spark.conf.set(n, str(size))
    try:
        yield
    finally:
        for n in names_:
            spark.conf.set(n, before[n])


def _ragged_file(spark, d) -> str:
    """A line a supplier: two fields, one, none, two quoted ones, three."""
    k = F.col("s_suppkey").cast("string")
    kinds = (F.concat(k, F.lit(",x")), k, F.lit(""), F.concat(F.lit('"'), k, F.lit('"",",""')), F.concat(k, F.lit(",y,z")))
    line = F.element_at(F.array(*kinds), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return _one_file(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("at"), line.alias("value")).unionByName(spark.createDataFrame([(-1, "a,b")], "at long, value string")))


def csv_records(spark, d):
    with _small_splits(spark):
        r = delimited.read_records(spark, _ragged_file(spark, d))
    cells = F.array_join("vals", "/", "NULL")
    return r.select(F.col("_rec").alias("rec"), "kind", F.size("vals").alias("n_fields"), cells.alias("cells"), F.array_join(F.transform("quoted", lambda q: q.cast("string")), "/").alias("quotes"))


def csv_roundtrip(spark, d):
    with _small_splits(spark):
        r = delimited.read_records(spark, _ragged_file(spark, d))
    return delimited.encoded_records(r, delimited.Dialect()).select(F.col("_rec").alias("rec"), F.replace("line", F.lit("\n"), F.lit("|")).alias("line"))


def _customer_file(spark, d) -> str:
    """Customers as one delimited file: nulls, empties, quotes, line breaks in fields, mixed line endings, blank lines."""
    k = F.col("c_custkey")
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    said = q(F.concat(F.lit('say "'), k.cast("string"), F.lit('",\nor not')))
    note = F.when(k % 4 == 0, "").when(k % 4 == 1, '""').when(k % 4 == 2, said).otherwise(F.concat(F.lit('5" of '), k.cast("string")))
    ending = F.concat(F.when(k % 3 == 0, "\r").otherwise(""), F.when(k % 50 == 0, "\n").otherwise(""))
    line = F.concat(k.cast("string"), F.lit(","), q(F.col("c_name")), F.lit(","), note, ending)
    return _one_file(spark, table(spark, d, "customer").select(k.alias("at"), line.alias("value")).unionByName(spark.createDataFrame([(-1, "key,name,note")], "at long, value string")))


def csv_customers(spark, d):
    """Every data record of a whole table's file, with its number, ending and quotes."""
    with _small_splits(spark):
        t = delimited.read_delimited(spark, _customer_file(spark, d))
    r = t.records.filter("kind = 'data'")
    v = lambda i: F.element_at("vals", i)
    return r.select(F.col("_rec").alias("rec"), v(1).cast("long").alias("key"), v(2).alias("name"), v(3).alias("note"), (F.length("eol") == 2).alias("crlf"), F.element_at("quoted", 3).alias("note_quoted"))


def csv_totals(spark, d):
    with _small_splits(spark):
        t = delimited.read_delimited(spark, _ragged_file(spark, d), skip_malformed=True)
    return t.totals().select("n_rows", "n_blank", "n_malformed", F.array_join(F.transform("malformed_records", lambda r: r.cast("string")), ",").alias("malformed_records"))


def csv_first_rows(spark, d):
    """The first 50 rows of a table's file, of which no more is read than they need."""
    t = delimited.read_first(spark, _customer_file(spark, d), 50)
    return t.rows.select(F.col("_rec").alias("rec"), F.col("key").cast("long").alias("key"), "name", "note")


def csv_file_roundtrip(spark, d):
    """A whole table's file, read, written as parts, put together and read again: records, and those that differ from
    the source's of the same number."""
    path = _customer_file(spark, d)
    with _small_splits(spark, path):
        source = delimited.read_delimited(spark, path)
        folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
        delimited.write_delimited(source.records, source.dialect, folder)
        delimited.join_parts(spark, folder, f"{folder}/whole.csv")
        again = delimited.read_delimited(spark, f"{folder}/whole.csv")
    a, b = (t.records.select(F.col("_rec").alias(f"{n}_rec"), F.struct("kind", "eol", "vals", "quoted").alias(n)) for n, t in (("a", source), ("b", again)))
    both = a.join(b, F.col("a_rec") == F.col("b_rec"), "full")
    return both.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


def csv_encodings(spark, d):
    """Each supplier as a text of its own, in one of five encodings: what they are found to be, and what is read."""
    kinds = (("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("windows-1252", b""))

    @F.pandas_udf("struct<encoding: string, mark_bytes: int, delimiter: string, read: string>")
    def found(key: pd.Series) -> pd.DataFrame:
        out = []
        for k in key:
            name, mark = kinds[k % 5]
            data = mark + delimited.encode(f"a;b\r\né;{k}\r\n", name)
            g = delimited.detect_dialect(data)
            out.append((g.encoding, len(g.mark), g.delimiter, delimited.decode(data[len(g.mark) :], g.encoding)))
        return pd.DataFrame(out, columns=["encoding", "mark_bytes", "delimiter", "read"])

    x = table(spark, d, "supplier").select("s_suppkey", found("s_suppkey").alias("x"))
    return x.select("s_suppkey", "x.encoding", "x.mark_bytes", "x.delimiter", F.translate("x.read", "\r\n", "/|").alias("read"))


def flagship(spark, d):
    """orders, masked and verified in one go: dates shifted, prices perturbed, priorities redacted, keys remapped."""
    o = _orders(spark, d)
    src = o.withColumn("_rec", F.col("o_orderkey").cast("long") + 1)
    out = _masked(spark, d, src, o_orderdate=model.Rule("DateShift"), o_totalprice=model.Rule("Perturb", model.PerturbOptions(mode="Global")), o_orderpriority=model.Rule("Redact"))
    report = out.written(lambda rows: rows.write.format("noop").mode("overwrite").save())  # counted by the tasks that write
    return report.select("column", "strategy", "n_rows", "source_nulls", "output_nulls", F.size("failures").alias("n_failures"))


_ALL = (
    flagship, profile_counts, profile_lengths, profile_numeric, profile_patterns, pattern_tokens, distinct_exact, distinct_estimate_ok, sample_values, date_masks, date_give_up, type_detect,
    type_detect_orders, header_keys, name_tokens, header_signature, entity_groups, recipe_rank, plan_problems, seed_draws, mask_redact, mask_dateshift, mask_dateshift_entity, mask_perturb_row,
    mask_perturb_global, mask_perturb_shapes, mask_hashid, mask_zip, mask_phone, mask_email, mask_shared_domain, mask_linked_identity, mask_lorem, mask_unmaskable, verify_report, verify_sums,
    preview_equals_run, mapping_rounds_equal_walk, csv_records, csv_roundtrip, mask_hashid_values, mask_phone_first, fake_company, fake_city, fake_hospital, fake_street_address, fake_person_email,
    mask_cities, mask_zip_listed, mask_zip_reference, mask_perturb_entity, mask_dateshift_formats, verify_distincts, verify_change, mask_custom, profile_rates, recipe_apply, mapping_limit, csv_customers, csv_totals,
    csv_file_roundtrip, csv_encodings, csv_first_rows,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
