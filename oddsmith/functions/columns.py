"""Expressions.

Encoders return SQL text, so one definition serves ``F.expr``, ``spark.sql`` and a
saved ``SQLTransformer`` stage. The rest return columns. All of them are built-in
Catalyst expressions, so they stay inside whole-stage code generation and work on
batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A hash is text of hexadecimal digits. This many of them place it in its range.
_RANGE_DIGITS = 15


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """A plain value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"({value!r}D)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def nan_to_null(operand: str) -> str:
    """Missing is NULL only: a floating NaN becomes NULL."""
    return f"nanvl(CAST({operand} AS DOUBLE), CAST(NULL AS DOUBLE))"


def impute(operand: str, value: float) -> str:
    """The number, or ``value`` where it is missing."""
    return f"coalesce({nan_to_null(operand)}, {literal(float(value))})"


def flag_positive(operand: str) -> str:
    """1 above zero, else 0; missing counts as zero. NaN must be imputed first,
    for Spark orders it above every number."""
    return f"CAST({impute(operand, 0.0)} > 0 AS INT)"


def flag_true(operand: str) -> str:
    """1 for true, 0 for false and missing."""
    return f"CAST(coalesce(CAST({operand} AS BOOLEAN), FALSE) AS INT)"


def keep_listed(operand: str, keep: Sequence[str], other: str = "other") -> str:
    """The value if it is listed, else (and if missing) ``other``."""
    listed = ", ".join(literal(value) for value in keep)
    return f"CASE WHEN {operand} IN ({listed}) THEN {operand} ELSE {literal(other)} END"


def code_of(operand: str, codes: Mapping[str, int], default: int) -> str:
    """The integer code of a listed value, else (and if missing) ``default``."""
    cases = " ".join(
        f"WHEN {operand} = {literal(match)} THEN {literal(code)}" for match, code in codes.items()
    )
    return f"CASE {cases} ELSE {literal(default)} END"


def key_hash(keys: Sequence[str | Column], seed: int | str) -> Column:
    """A repeatable pseudo-random text of 32 hexadecimal digits for a row key.

    It depends on nothing but seed and key, so a recomputed task, another
    partitioning or another engine with MD5 draws the same. Text of one length
    sorts as the numbers do; turning it into numbers would cost more than the hash.
    Each part is its length, a colon and its text, or a dash for NULL, so that no two
    keys are hashed as one text.
    """
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    texts = [column.cast("string") for column in columns]
    text = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *text))


def hash_bound(share: float) -> str:
    """The hash below which this share of the hash range lies."""
    top = 16**_RANGE_DIGITS
    return format(min(round(share * top), top - 1), f"0{_RANGE_DIGITS}x")


def required_number(value: Column, what: str) -> Column:
    """The number as a double; the query fails where it is NULL or NaN."""
    number = value.cast("double")
    # -0.0 equals 0.0 everywhere but in a binary search over bucket bounds.
    return (
        F.when(number.isNull() | F.isnan(number), F.raise_error(F.lit(f"missing {what}")))
        .when(number == 0, F.lit(0.0))
        .otherwise(number)
    )


def required_outcome(value: Column, what: str) -> Column:
    """A boolean or 0/1 outcome as an integer; the query fails on anything else."""
    outcome = value.cast("int")
    return F.when((outcome == value.cast("double")) & outcome.isin(0, 1), outcome).otherwise(
        F.raise_error(F.lit(f"{what} is neither 0 nor 1"))
    )
