"""Bounded samples of labelled rows, and rows of hashed features.

Classifiers are fitted on at most about ``limit`` labelled rows, a parameter of theirs,
chosen by a hash of the id. Scores cover all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.shared import pieces

_PIECE = 1 << 20
#: Shares are compared with a hash of so many values: exact also for a few of 1e12 rows.
_DRAWS = 1 << 52


@dataclass
class Rows:
    """A sparse matrix: the features of row i lie at ``first[i]:first[i + 1]``."""

    first: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def sums(self, terms: np.ndarray) -> np.ndarray:
        """Sum over each row of one term (or a vector of terms) per entry."""
        total = np.concatenate([np.zeros((1, *terms.shape[1:])), np.cumsum(terms, axis=0, dtype=np.float64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.first[rows] - first[:-1], n) + np.arange(first[-1])
        return Rows(first, self.feature[at], self.value[at])


def rows_by(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> Rows:
    """``doc`` is in order."""
    return Rows(np.searchsorted(doc, np.arange(n + 1)), feature, value)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def drawn(id_col: str, limit: int, rows: int) -> Column:
    """Whether a hash of the id draws the row, for about ``limit`` of so many rows."""
    share = min(1.0, limit / max(rows, 1))
    return F.pmod(F.xxhash64(id_col), F.lit(_DRAWS)) < F.lit(int(share * _DRAWS))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, chosen: Column, limit: int
) -> DataFrame:
    """``doc_id, label`` and the documents' columns, of at most about ``limit`` chosen
    rows of ``labels`` with a label of 0 or 1. The sample is bounded, so it is broadcast
    and no document is moved for it."""
    known = labels.where(chosen & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(drawn("doc_id", limit, known.count()))
    return documents.join(F.broadcast(known), "doc_id")


def collected(sample: DataFrame, featurise: Callable[[pa.RecordBatch], Rows]) -> tuple[Rows, np.ndarray]:
    """The sample's features, made in tasks, and its labels, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", _PIECE):
            rows = featurise(piece)
            first = pa.array(rows.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("label"),
                    pa.ListArray.from_arrays(first, pa.array(rows.feature.astype(np.int32))),
                    pa.ListArray.from_arrays(first, pa.array(rows.value.astype(np.float32))),
                ],
                names=["doc_id", "label", "feature", "value"],
            )

    schema = "doc_id long, label int, feature array<int>, value array<float>"
    table = sample.mapInArrow(run, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(0)
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("label", "ascending")]))
    feature, value = table.column("feature").combine_chunks(), table.column("value").combine_chunks()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(feature).to_numpy())]).astype(np.int64)
    rows = Rows(first, feature.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64))
    return rows, table.column("label").to_numpy().astype(np.float64)


def scored(
    documents: DataFrame, featurise: Callable[[pa.RecordBatch], Rows], score: Callable[[Rows], np.ndarray]
) -> DataFrame:
    """Every row without its text (and ``meta``) and with its score."""
    left = [name for name in documents.columns if name not in ("text", "meta")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", _PIECE):
            found = pa.array(score(featurise(piece)), pa.float64())
            yield pa.RecordBatch.from_arrays([*map(piece.column, left), found], names=[*left, "score"])

    kept = documents.select(*left).withColumn("score", F.lit(0.0))
    return documents.mapInArrow(run, kept.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
