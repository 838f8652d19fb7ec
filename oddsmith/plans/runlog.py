"""The run log: an append-only table of what each experiment run found."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from random import randint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.sources.small import small_frame
from oddsmith.sources.tables import table_name

RUN_LOG_SCHEMA = (
    "run_id string, run_name string, experiment_id int, kind string, "
    "key string, value string, value_num double, logged_at timestamp"
)
SPLIT_METRICS = {"train": "TrainAUC", "val": "ValAUC", "test": "TestAUC"}
BASELINE_METRIC = "BaselineAUC"
# Run names are twelve-digit numbers from this range of fixed values.
RUN_NAMES = (225_000_000_000, 225_999_999_999)


@dataclass(frozen=True)
class RunId:
    experiment_id: int
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    run_name: str = field(default_factory=lambda: str(randint(*RUN_NAMES)))


def run_log_rows(
    spark: SparkSession,
    run: RunId,
    *,
    description: str,
    baseline_auc: float | None,
    aucs: Mapping[str, float | None],
    importances: Mapping[str, float],
    params: Mapping[str, str],
    feature_names: Sequence[str],
) -> DataFrame:
    """One run as rows: tags, metrics, parameters, and an importance per feature."""
    entries: list[tuple[str, str, str | None, float | None]] = [
        ("tag", "description", description, None),
        ("tag", "spark_version", spark.version, None),
        ("tag", "feature_names", ", ".join(feature_names), None),
    ]
    metrics = {BASELINE_METRIC: baseline_auc}
    metrics.update({SPLIT_METRICS[split]: auc for split, auc in aucs.items()})
    entries += [("metric", key, None, value) for key, value in metrics.items()]
    entries += [("importance", key, None, value) for key, value in importances.items()]
    entries += [("param", key, value, None) for key, value in params.items()]
    # Seconds since the epoch: the same moment in every session time zone.
    now = datetime.now(timezone.utc).timestamp()
    head = (run.run_id, run.run_name, run.experiment_id)
    return small_frame(spark, [(*head, *entry, now) for entry in entries], RUN_LOG_SCHEMA)


def append_run_log(rows: DataFrame, table: str, schema: str) -> None:
    """Append to the log table; it is made on first use. One small file per run.

    A run that the table has already is left out, so an append that is tried again,
    after it failed or was not heard of, leaves one run. A run is one file, which is there
    as a whole or not at all. Only the log's partitions of the same experiments are read.
    """
    spark, target = rows.sparkSession, table_name(schema, table)
    if spark.catalog.tableExists(target):
        ids = [row[0] for row in rows.select("experiment_id").distinct().collect()]
        there = spark.read.table(target).where(F.col("experiment_id").isin(ids))
        rows = rows.join(there.select("experiment_id", "run_id"), ["experiment_id", "run_id"], "left_anti").select(*rows.columns)
    rows.coalesce(1).write.mode("append").partitionBy("experiment_id").saveAsTable(target)


def best_run(log: DataFrame, metric: str = SPLIT_METRICS["val"]) -> DataFrame:
    """The run with the highest metric in each experiment; of equal ones the first
    by name."""
    entries = log.filter((F.col("kind") == "metric") & (F.col("key") == metric))
    best = F.min(F.struct((-F.col("value_num")).alias("below"), "run_name", "run_id"))
    return (
        entries.filter(F.col("value_num").isNotNull())
        .groupBy("experiment_id")
        .agg(best.alias("best"))
        .select(
            "experiment_id",
            F.col("best.run_id").alias("run_id"),
            F.col("best.run_name").alias("run_name"),
            (-F.col("best.below")).alias("value"),
        )
    )
