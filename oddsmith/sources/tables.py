"""Reading, pulling and replacing tables. Nothing here collects table data."""

from __future__ import annotations

import logging
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def pull_sql(spark: SparkSession, query: str, *, report_rows: bool = False) -> DataFrame:
    """Run ``query`` and return its lazy result.

    ``report_rows`` logs how many rows it has. The query then runs once, now: its rows
    are kept (in memory and on disk) for the count and for whatever reads them next,
    until ``unpersist``. (An ``Observation`` would count in passing, but it leaves the
    session unable to apply fitted models that carry a training summary.)
    """
    pulled = spark.sql(query)
    if report_rows:
        pulled = pulled.persist(StorageLevel.MEMORY_AND_DISK)
        log.info("the query returns %d rows", pulled.count())
    return pulled


def pull_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Run ``query`` in an external database.

    With ``partition_column`` the executors read ``num_partitions`` ranges of it
    side by side. ``lower`` and ``upper`` only place the range edges; rows beyond
    them still arrive. Without it the result comes through one connection, which
    suits small results only.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    reader = reader.options(**(options or {}))
    if partition_column is None:
        return reader.option("query", query).load()
    if lower is None or upper is None or not num_partitions:
        raise ValueError("a partitioned pull needs lower, upper and num_partitions")
    # Spark takes no partition column together with "query", only with "dbtable".
    return (
        reader.option("dbtable", f"({query}) pulled")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", str(num_partitions))
        .load()
    )


def table_name(*parts: str) -> str:
    """A qualified name as SQL text."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def read_table(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """Read a catalog table, by one (perhaps qualified) name or by schema and name."""
    return spark.read.table(table if schema is None else table_name(schema, table))


def replace_table(
    df: DataFrame,
    table: str,
    schema: str,
    *,
    partition_by: list[str] | None = None,
    overwrite_schema: bool = True,
    reads_itself: bool = False,
) -> str:
    """Create or replace ``schema.table`` with ``df`` and return its quoted name.

    ``reads_itself`` is for a ``df`` derived from the table being replaced, which
    Spark refuses to overwrite in place: the rows go to a new table first, which
    then takes the name.
    """
    spark = df.sparkSession
    target = table_name(schema, table)
    written = table_name(schema, f"{table}_{uuid.uuid4().hex}") if reads_itself else target
    writer = df.write.mode("overwrite")
    if overwrite_schema:
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(written)
    if reads_itself:
        # The old table steps aside and goes last, so its rows are never without a name.
        aside = None
        if spark.catalog.tableExists(target):
            aside = table_name(schema, f"{table}_{uuid.uuid4().hex}_old")
            spark.sql(f"ALTER TABLE {target} RENAME TO {aside}")
        try:
            spark.sql(f"ALTER TABLE {written} RENAME TO {target}")
        except Exception:
            if aside:
                spark.sql(f"ALTER TABLE {aside} RENAME TO {target}")
            raise
        if aside:
            spark.sql(f"DROP TABLE {aside}")
    return target


def save_local_frame(spark: SparkSession, pdf, table: str, schema: str) -> str:
    """Save a local pandas frame as ``schema.table``; an existing schema is kept."""
    return replace_table(spark.createDataFrame(pdf), table, schema, overwrite_schema=False)
