"""Column names and projections."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROLE_TYPES: Mapping[str, tuple[type, ...]] = {
    "boolean": (T.BooleanType,),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    "string": (T.StringType,),
}


def shorten_columns(df: DataFrame, on_collision: str = "error") -> DataFrame:
    """Drop the view prefix of dotted names: ``view.column`` becomes ``column``.

    The second segment is taken, also of three. Two names that become equal
    raise, or get ``_2``, ``_3``, ... with ``on_collision="suffix"``.
    """
    if on_collision not in ("error", "suffix"):
        raise ValueError("on_collision is 'error' or 'suffix'")
    short = [name.split(".")[1] if "." in name else name for name in df.columns]
    clashing = sorted(name for name, times in Counter(short).items() if times > 1)
    if clashing and on_collision == "error":
        raise ValueError(f"shortened names collide: {clashing}")
    taken: set[str] = set(short)
    seen: Counter[str] = Counter()
    names = []
    for name in short:
        seen[name] += 1
        unique = name
        step = seen[name]
        while step > 1 and unique in taken:
            unique = f"{name}_{step}"
            step += 1
        taken.add(unique)
        names.append(unique)
    return df.toDF(*names)


def check_roles(df: DataFrame, roles: Mapping[str, Sequence[str]]) -> list[str]:
    """Check feature lists by type against the schema; return them in one list.

    ``int`` roles take floating columns too: an integer column with missing
    values often arrives as floating point.
    """
    fields = {field.name: field.dataType for field in df.schema.fields}
    problems = []
    for role, columns in roles.items():
        for column in columns:
            if column not in fields:
                problems.append(f"{column}: no such column")
            elif not isinstance(fields[column], ROLE_TYPES[role]):
                problems.append(f"{column}: {fields[column].simpleString()} is no {role}")
    if problems:
        raise ValueError("; ".join(problems))
    return [column for columns in roles.values() for column in columns]


def project_roles(
    df: DataFrame, features: Sequence[str], target: str, *carried: str
) -> DataFrame:
    """Only what an experiment reads: carried columns, the target, the features."""
    return df.select(*dict.fromkeys([*carried, target, *features]))
