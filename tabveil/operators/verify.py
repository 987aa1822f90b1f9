"""An independent report on a masked table, from the data alone: counts and sums, never values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import numbers, text
from tabveil.functions.binding import staged
from tabveil.functions.strategies import BEFORE_NUMBERS, can_number
from tabveil.plans.model import REDACTED, Plan

#: A standard error of 0.8 %, in one binary value a count: wide buffers would make long code.
SKETCH_BITS = 14


def _anchored(v: Column, anchor: Column | None) -> Column:
    return v if anchor is None else F.when(text.has_value(anchor), F.concat(anchor, F.lit("\x1f"), v)).otherwise(v)


def prepared(sides: DataFrame, plan: Plan) -> DataFrame:
    """sides with the numbers that facts adds up."""
    summed = [(i, c, v) for i, (c, rule) in enumerate(plan.columns.items()) if rule.strategy == "Perturb" for v in ("source", "output")]
    return staged(sides, {f"_{'p' if v == 'source' else 'q'}{i}": numbers.value_steps(F.when(text.has_value(F.col(f"`{c}`.source")), F.col(f"`{c}`.{v}"))) for i, c, v in summed})


def facts(plan: Plan) -> list[Column]:
    """Aggregates over prepared sides (a struct of source, output and unmaskable per column), named by what they count and the
    column's position. None needs values to meet, so they can be taken while the rows are written."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    for i, (c, rule) in enumerate(plan.columns.items()):
        side, group = F.col(f"`{c}`"), plan.group_of(c)
        source, output, has = side["source"], side["output"], text.has_value(side["source"])
        out += [F.count_if(source.isNull()).alias(f"source_nulls_{i}"), F.count_if(output.isNull()).alias(f"output_nulls_{i}"), F.count_if(side["unmaskable"]).alias(f"n_unmaskable_{i}")]
        if rule.is_mapping:
            out.append(F.count_if(has & (source == output)).alias(f"n_unchanged_{i}"))
        else:
            anchor = F.col(f"`{group.anchor}`.source") if group else None
            out += [F.hll_sketch_estimate(F.hll_sketch_agg(F.when(has, _anchored(v, anchor)), SKETCH_BITS)).alias(f"{n}_distinct_{i}") for n, v in (("source", source), ("output", output))]
        if rule.strategy == "Perturb":
            both = F.col(f"_p{i}").isNotNull() & F.col(f"_q{i}").isNotNull()
            out += [F.sum(F.when(both, F.col(n))).cast("decimal(38,10)").alias(name) for n, name in ((f"_p{i}", f"source_sum_{i}"), (f"_q{i}", f"output_sum_{i}"))]
    return out


def mapped_counts(mapping: DataFrame, plan: Plan) -> dict[int, tuple[int, int]]:
    """(distinct sources, distinct outputs) of each mapped column, exact, from the mapping's own rows: each says in which
    columns its value occurs. Linked values count with their anchor; all that could not be masked is one output."""
    each = mapping.select(F.explode(F.transform(F.split("ats", ","), lambda x: x.cast("int"))).alias("at"), "anchor", F.coalesce("output", F.lit(REDACTED)).alias("output"))
    found = each.groupBy("at").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct(F.struct("anchor", "output")).alias("outputs"))
    return {r["at"]: (r["sources"], r["outputs"]) for r in found.collect()}  # a row a column


def report(found: Row, mapping: DataFrame | None, plan: Plan, warnings: dict[str, str] | None = None) -> DataFrame:
    """A row per column: column, strategy, n_rows, source_nulls, output_nulls, n_unchanged, n_disambiguated,
    n_unmaskable, source_distinct, output_distinct, source_sum, output_sum, sum_change_pct, failures, warnings.

    found: the facts of the rows, from verification or from the write itself. Distinct counts are exact for mapped
    columns (with the anchor where linked) and estimated for the rest.
    """
    found, numbered, exact, rows = found.asDict(), {}, {}, []
    spark = SparkSession.active()
    if mapping is not None:
        # Null outputs are values that could not be masked; they are no entries.
        entries = mapping.filter((F.col("n") >= BEFORE_NUMBERS) & F.col("output").isNotNull()).groupBy("column").count().collect()
        numbered = {r["column"]: r["count"] for r in entries if can_number(plan.columns[r["column"]])}
        exact = mapped_counts(mapping, plan)
    for i, (c, rule) in enumerate(plan.columns.items()):
        of = lambda name, i=i: found.get(f"{name}_{i}")
        distinct = exact.get(i, (0, 0)) if rule.is_mapping else (of("source_distinct") or 0, of("output_distinct") or 0)
        rows.append((i, c, rule.strategy, found["n_rows"], of("source_nulls"), of("output_nulls"), of("n_unchanged") or 0, numbered.get(c, 0), of("n_unmaskable"), *distinct, of("source_sum"), of("output_sum"), rule.is_mapping, (warnings or {}).get(c)))
    out = spark.createDataFrame(rows, (
        "position int, column string, strategy string, n_rows long, source_nulls long, output_nulls long, n_unchanged long, n_disambiguated long, n_unmaskable long, "
        "source_distinct long, output_distinct long, source_sum decimal(38,10), output_sum decimal(38,10), is_mapping boolean, warning string"
    ))
    failures = F.array_compact(F.array(
        F.when(F.col("source_nulls") != F.col("output_nulls"), "Null count changed"),
        F.when(F.col("is_mapping") & (F.col("source_distinct") != F.col("output_distinct")), "Distinct count changed"),
        F.when(F.col("is_mapping") & (F.col("n_unchanged") > 0), "Values left unchanged"),
    ))
    notes = F.array_compact(F.array(
        F.when(F.col("n_unmaskable") > 0, F.concat(F.col("n_unmaskable").cast("string"), F.lit(" values could not be masked and were redacted"))),
        F.when(F.col("n_disambiguated") > 0, F.concat(F.col("n_disambiguated").cast("string"), F.lit(" values were told apart by a number"))),
        F.col("warning"),
    ))
    source, output = F.col("source_sum").cast("decimal(28,8)"), F.col("output_sum").cast("decimal(28,8)")
    change = F.when(source != 0, F.bround((output - source) / F.abs(source) * 100, 2).cast("decimal(18,2)"))
    return out.orderBy("position").select(
        "column", "strategy", "n_rows", "source_nulls", "output_nulls", "n_unchanged", "n_disambiguated", "n_unmaskable", "source_distinct", "output_distinct", "source_sum", "output_sum",
        change.alias("sum_change_pct"), failures.alias("failures"), notes.alias("warnings"),
    )


def file_report(totals: DataFrame, rows_written: DataFrame, columns: DataFrame) -> DataFrame:
    """One row on a whole run: rows_read, rows_written, row_count_matches, blank_lines, malformed_rows,
    malformed_records (the first 100), has_failures. totals is that of the file read, columns the report on columns."""
    written = rows_written.count()
    failed = columns.filter(F.size("failures") > 0).count() > 0  # a row a column
    matches = F.col("n_rows") == F.lit(written)
    return totals.select(
        F.col("n_rows").alias("rows_read"), F.lit(written).cast("long").alias("rows_written"), matches.alias("row_count_matches"), F.col("n_blank").alias("blank_lines"),
        F.col("n_malformed").alias("malformed_rows"), "malformed_records", (~matches | F.lit(failed)).alias("has_failures"),
    )
