"""Small driver-side results as frames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_frame(
    spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str
) -> DataFrame:
    """Fitted values and aggregates as a frame.

    Through Arrow they become a local relation: no Python worker, and not one task
    per core of the cluster as parallelising a list would start.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table(
        [pa.array(list(values)) for values in columns],
        names=[f"c{i}" for i in range(len(schema))],
    )
    frame = spark.createDataFrame(table)
    return frame.select(
        *[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    )
