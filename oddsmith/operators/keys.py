"""Primary-key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_key_check(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: ``total_rows``, ``distinct_keys``, ``is_primary_key``.

    One scan of the key columns and one shuffle. Repeats are folded before the
    shuffle, so a hot key costs one row per task. A NULL key is one key; an empty
    table has a primary key.
    """
    columns = [keys] if isinstance(keys, str) else list(keys)
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
    ).withColumn("is_primary_key", F.col("total_rows") == F.col("distinct_keys"))


def is_primary_key(df: DataFrame, keys: str | Sequence[str]) -> bool:
    return primary_key_check(df, keys).first()["is_primary_key"]
