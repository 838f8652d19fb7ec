"""Session helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str | None:
    """The folder for checkpoints: ``folder``, or the one the session names, if any. It
    must be one that all machines share; none is made here."""
    context = spark.sparkContext
    named = folder or spark.conf.get("spark.checkpoint.dir", None)
    if named and (folder or context.getCheckpointDir() is None):
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _builds_on_itself(estimator: Estimator) -> bool:
    """Boosted trees: each tree's plan holds those of all before it."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    return any(isinstance(stage, GBTClassifier) or getattr(stage, "builds_on_itself", False) for stage in stages)


def require_checkpoints(spark: SparkSession, estimator: Estimator, folder: str | None = None) -> None:
    """Fail early where an estimator must cut its lineage and has no folder for it."""
    if ensure_checkpoint_dir(spark, folder) is None and _builds_on_itself(estimator):
        raise ValueError(
            "boosted trees cut their lineage by checkpoints: set spark.checkpoint.dir to a"
            " folder that all machines share"
        )


def placed(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """The rows as they lie, or with ``partitions`` dealt and ordered by key.

    A sampling estimator draws by partition and place. So one seed gives one model
    for one number of partitions, however the rows lay before; for rows as they lie it
    depends on how they lie.
    """
    if partitions is None:
        return df
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The frame, kept for several passes and released at the end."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
