"""Columns as edited by a user: the flag decides, so a value may be overridden with null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Editable columns, in the order in which edits are listed.
EDITABLE = ("canonical_value", "canonical_unit", "original_unit", "qualitative_value", "qualitative_bool", "canonical_reference_low", "canonical_reference_high", "measured_at")


def effective(name: str, base: Column | None = None) -> Column:
    return F.when(F.col(f"user_{name}_override"), F.col(f"user_{name}")).otherwise(F.col(name) if base is None else base)


def with_effective(rows: DataFrame, fields: tuple[str, ...] = EDITABLE) -> DataFrame:
    """Adds effective_<field>, the list of edited fields and whether there are any."""
    edited = F.filter(F.array(*[F.when(F.col(f"user_{f}_override"), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.withColumns({f"effective_{f}": effective(f) for f in fields} | {"user_edited_fields": edited}).withColumn("has_user_edits", F.size("user_edited_fields") > 0)


def effective_timestamp(measured_at: Column, lab_date: Column, uploaded_at: Column) -> Column:
    """What a history is ordered by, before the id."""
    return F.coalesce(measured_at, lab_date, uploaded_at)


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """edits: key, set (map of field to text, a null entry sets null), reset (list of fields).
    A reset drops the override even if the same edit sets the field. Text is cast to the
    field's type; a text that does not fit becomes null."""
    types = dict(rows.dtypes)
    joined = rows.join(edits.select(F.col(key).alias("__k"), "set", "reset"), rows[key] == F.col("__k"), "left")
    out = {}
    for f in fields:
        reset, given = F.coalesce(F.array_contains("reset", f), F.lit(False)), F.coalesce(F.map_contains_key("set", f), F.lit(False))
        value = F.try_element_at("set", F.lit(f)).try_cast(types[f"user_{f}"])
        out[f"user_{f}"] = F.when(reset, F.lit(None)).when(given, value).otherwise(F.col(f"user_{f}"))
        out[f"user_{f}_override"] = F.when(reset, F.lit(False)).when(given, F.lit(True)).otherwise(F.col(f"user_{f}_override"))
    return joined.withColumns(out).select(*rows.columns)
