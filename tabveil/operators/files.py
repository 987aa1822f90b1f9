"""Profiling, previewing and masking of delimited files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabveil.operators import profile as profiling
from tabveil.operators import verify
from tabveil.operators.masking import MaskingSession
from tabveil.plans.model import Plan
from tabveil.sources import delimited


@dataclass
class FileProfile:
    """columns: a row per column, see profiling.profile. totals: data rows, blank lines and malformed records of the
    sample, the first of these by number. whole: whether the sample is the file."""

    columns: DataFrame
    totals: DataFrame
    dialect: delimited.Dialect
    header: list[str]
    whole: bool


def profile_file(spark: SparkSession, path: str, sample_rows: int = profiling.SAMPLE_ROWS, with_samples: bool = False) -> FileProfile:
    """The profile of a file's first data rows. The rest is not read, and malformed records never fail: they are counted."""
    table = delimited.read_first(spark, path, sample_rows)
    columns = profiling.profile(table.rows, sample_rows, with_samples, is_whole=table.whole)
    return FileProfile(columns, table.totals(), table.dialect, table.header, table.whole)


def preview_file(session: MaskingSession, spark: SparkSession, path: str, plan: Plan, n: int = 20) -> DataFrame:
    """The first n rows of a file as a run of the same session will write them; no more of the file is read than they need."""
    return session.preview(delimited.read_first(spark, path, n).rows, plan, n)


def mask_file(session: MaskingSession, spark: SparkSession, path: str, plan: Plan, folder: str, skip_malformed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Masks a file into ordered parts below folder (delimited.join_parts makes one file of them): the report on its
    columns and the one on the file. A failed run leaves no part."""
    table = delimited.read_delimited(spark, path, skip_malformed)
    masked = session.mask(table.rows, plan)
    delimited.write_delimited(delimited.masked_records(table, masked.rows), table.dialect, folder)
    columns = masked.verification()
    return columns, verify.file_report(table.totals(), masked.rows, columns)
