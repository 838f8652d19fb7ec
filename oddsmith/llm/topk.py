"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x), so scores are exact. Queries and candidates
are packed into blocks of bounded size, and each block of candidates meets each block of
queries once a pass.

1. Every pass scores everything and adds up, over all candidates, a histogram of each
   query's scores within the range that is still open; the range that holds the k-th
   score is the next one. ``BINS`` ranges a pass narrow it to one value.
2. What reaches the k-th score is kept; ties go to the smaller id. Of a block's rows that
   tie, those beyond its k smallest ids can't be among the result.

From a block, only ranges at or above its own k-th score are sent: the k-th of all rows
is never below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith.llm.packed import rows_of
from oddsmith.llm.shared import written

ROWS_PER_BLOCK = 2_048
QUERIES_PER_BLOCK = 512
BINS = 16_384
_LIMIT = float(1 << 63)


def _pack(rows_per_block: int):
    """Blocks of vectors of one dimension: ids and integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            dims = batch.column("dim").to_numpy()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                for at in range(0, len(which), rows_per_block):
                    part = which[at : at + rows_per_block]
                    v = flat[(first[part][:, None] + np.arange(dim)).ravel()]
                    top = float(np.abs(v).max(initial=0.0))
                    kind = np.float32 if top < 1 << 24 else np.float64  # exact in either
                    yield pa.RecordBatch.from_pylist(
                        [{"dim": int(dim), "block": partition << 32 | number, "ids": ids[part].tobytes(),
                          "v": v.astype(kind).tobytes(), "top": top}],
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()),
                                          ("v", pa.binary()), ("top", pa.float64())]),
                    )
                    number += 1

    return run


_BLOCK = "dim int, block long, ids binary, v binary, top double"


def _scores(item: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores (queries by candidates), and where the pair is
    one row's own."""
    dim = item["dim"]
    q_ids, ids = np.frombuffer(item["q_ids"], np.int64), np.frombuffer(item["ids"], np.int64)
    q, v = (
        np.frombuffer(item[name], np.float32 if item[f"{side}top"] < 1 << 24 else np.float64)
        .astype(np.float64)
        .reshape(n, dim)
        for name, side, n in (("q_v", "q_", len(q_ids)), ("v", "", len(ids)))
    )
    bound = dim * item["q_top"] * item["top"]
    if bound < 1 << 53:  # all sums are exact in doubles
        found = (q @ v.T).astype(np.int64)
    elif max(item["q_top"], item["top"]) < _LIMIT and bound < _LIMIT:
        found = q.astype(np.int64) @ v.astype(np.int64).T
    else:  # beyond the range of a long: exact, then held at its ends
        exact = np.array([[int(x) for x in row] for row in q], object).reshape(len(q), dim) @ (
            np.array([[int(x) for x in row] for row in v], object).reshape(len(v), dim).T
        )
        found = np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
    return q_ids, ids, found, q_ids[:, None] == ids[None, :]


def _count(k: int, width: int, bins: int):
    """Per query, the ranges that a block's scores fall into, at or above its own k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in rows_of(batches):
            q_ids, _, found, own = _scores(item)
            low = np.array(item["low"], np.int64)
            # Exact also if score - low is beyond the range of a signed number.
            away = found.view(np.uint64) - low.view(np.uint64)[:, None]
            slot = np.minimum(away // np.uint64(width), np.uint64(bins)).astype(np.int64)
            slot[(found < low[:, None]) | own] = -1
            kth = min(k, slot.shape[1])
            least = np.maximum(-np.partition(-slot, kth - 1, axis=1)[:, kth - 1], 0)
            query, at = np.nonzero(slot >= least[:, None])
            key, n = np.unique(query * (bins + 1) + slot[query, at], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), item["q_block"])), pa.array((key // (bins + 1)).astype(np.int32)),
                 pa.array((key % (bins + 1)).astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["q_block", "at", "slot", "n"],
            )

    return run


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in rows_of(batches):
            q_ids, ids, found, own = _scores(item)
            least = np.array(item["low"], np.int64)
            query, at = np.nonzero((found >= least[:, None]) & ~own)
            score = found[query, at]
            order = np.lexsort((ids[at], np.invert(score), query))
            query, at, score = query[order], at[order], score[order]
            first = np.searchsorted(query, np.arange(len(q_ids)))
            good = np.arange(len(query)) - first[query] < k
            query, at, score = query[good], at[good], score[good]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(query), item["q_block"])), pa.array(query.astype(np.int32)),
                 pa.array(q_ids[query]), pa.array(ids[at]), pa.array(score)],
                names=["q_block", "at", "query_id", "vec_id", "score"],
            )

    return run


def exact_top_k(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    bins: int = BINS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query (rows for which the SQL condition
    ``is_query`` on ``vec_id`` holds) the k other rows with the highest integer inner
    product, ties to the smaller id; all of them, if there are fewer.

    Defined cases: rows take no part whose id or vector is null or whose vector holds a
    null or a number that isn't finite. Vectors of different lengths aren't compared; all
    empty ones score 0. A row with a query's id counts as the query's own; rows that repeat
    a query's id are queries each. Scores beyond the range of a long are held at its ends.
    Extra columns are left behind. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(
        "vec_id IS NOT NULL AND x IS NOT NULL "
        "AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < CAST('Infinity' AS double))"
    )
    # Doubles from 2**53 on are whole.
    scaled = f"transform(x, c -> {float(scale)}D * c)"
    whole = "transform(y, c -> CASE WHEN abs(c) < 9007199254740992D THEN CAST(floor(c) AS double) ELSE c END)"
    rows = rows.selectExpr("vec_id", f"{scaled} AS y")
    rows = rows.selectExpr("vec_id", "size(y) AS dim", f"{whole} AS v")
    asked = rows.where(is_query)
    blocks = written(rows.mapInArrow(_pack(ROWS_PER_BLOCK), _BLOCK))
    parts = asked.count() // QUERIES_PER_BLOCK + 1
    queries = written(asked.repartition(parts, "vec_id").mapInArrow(_pack(QUERIES_PER_BLOCK), _BLOCK))
    queries = queries.selectExpr("dim", "block AS q_block", "ids AS q_ids", "v AS q_v", "top AS q_top")
    pairs = blocks.select("dim", "block").join(queries.select("dim", "q_block"), "dim")
    most = blocks.agg(F.max(F.col("top")).alias("top"), F.max("dim").alias("dim")).first()
    bound = min(int((most["dim"] or 0) * (most["top"] or 0.0) ** 2), (1 << 63) - 1)
    width = -(-(2 * bound + 1) // bins)
    count = (F.octet_length("q_ids") / 8).cast("int")
    state = queries.select("q_block", F.array_repeat(F.lit(-bound).cast("long"), count).alias("low"))

    def met(state: DataFrame) -> DataFrame:
        asking = pairs.select("block", "q_block").join(queries.join(state, "q_block"), "q_block")
        return blocks.drop("dim").join(asking, "block")

    while True:
        ranges = met(state).mapInArrow(_count(k, width, bins), "q_block long, at int, slot int, n long")
        ranges = ranges.groupBy("q_block", "at", "slot").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("q_block", "at").orderBy(F.desc("slot")))
        hit = ranges.withColumn("upto", above).where(f"upto >= {k} AND upto - n < {k}")
        hit = hit.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("at", "slot"))).alias("slots"))
        low = F.expr(f"transform(low, (x, i) -> x + coalesce(CAST(slots[i] AS bigint), 0L) * {width}L)")
        state = written(state.join(hit, "q_block", "left").select("q_block", low.alias("low")))
        if width == 1:
            break
        width = -(-width // bins)
    found = met(state).mapInArrow(_keep(k), "q_block long, at int, query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
