"""Masking a stream: the strategies that need no mapping are projections, so they apply to streams as they are.

Mapped columns would depend on the order of arrival; they are refused here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.functions.binding import staged
from tabveil.operators.masking import plain_steps
from tabveil.operators.secret import Secret
from tabveil.plans.model import REDACTED, Plan, PlanError, validate


def mask_stream(df: DataFrame, plan: Plan, key: bytes) -> DataFrame:
    """df: a streaming (or other) table of string columns, with _rec if a rule perturbs per row."""
    columns = [c for c in df.columns if c != "_rec"]
    validate(plan, columns)
    if mapped := [c for c, r in plan.columns.items() if r.is_mapping]:
        raise PlanError([f"Column '{c}': {plan.columns[c].strategy} needs a whole table, not a stream." for c in mapped])
    if "_rec" not in df.columns and any(getattr(r.chosen, "mode", "") == "PerRow" for r in plan.columns.values()):
        raise PlanError(["Perturbing per row needs record numbers in _rec."])
    secret = Secret(df.sparkSession, key)
    made = staged(df, {f"_o{i}": plain_steps(df, plan, c, secret) for i, c in enumerate(columns)})
    out = [F.when(text.has_value(F.col(f"`{c}`")), F.coalesce(f"_o{i}", F.lit(REDACTED))).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)]
    return made.select(*(["_rec"] if "_rec" in df.columns else []), *out)
