"""Scoring a stream with a model fitted in batch.

Encoders, date and hash splits and scores work row by row: they keep no state, so
they need no watermark, and a batch that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from oddsmith.operators.models import score


def score_stream(model: PipelineModel, stream: DataFrame, output: str = "score") -> DataFrame:
    """A stream of raw rows with the model's probability added."""
    if not stream.isStreaming:
        raise ValueError("the frame is no stream; use operators.models.score")
    return score(model, stream, output)


def append_scores(
    scored: DataFrame, path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Append a scored stream to a Parquet folder, each input row once.

    ``checkpoint`` lies in storage that all executors and a restarted driver see.
    """
    writer = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
