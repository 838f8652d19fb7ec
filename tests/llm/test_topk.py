import math

import numpy as np
import pytest
from conftest import TESTDATA

from oddsmith.llm.queries import QUERIES
from oddsmith.llm.topk import exact_top_k


def brute(rows, k, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scores = [(-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63), i) for i, b in usable if i != q and len(a) == len(b)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df, k=5, **options):
    return sorted(tuple(r) for r in exact_top_k(df, "vec_id % 50 = 0", k=k, **options).collect())


@pytest.mark.parametrize("bins", [4, 16_384])
def test_equals_brute_force(spark, bins):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)]  # ties, queries among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(df, bins=bins) == brute(rows, 5)
    assert found(df, k=1) == brute(rows, 1)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, nan]), (100, None), (150, [None, 1.0]), (200, [inf, 0.0]), (250, [1.0]),
            (300, []), (1, [1.0, 2.0]), (2, [-0.001, 0.0]), (3, [2.0]), (4, []), (None, [5.0, 5.0]),
            (5, [1e17, -3e16]), (6, [1e40, 1e40]), (350, [1e18, 1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == brute(rows, 5)
    fewer = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")
    assert found(fewer) == []
    assert found(df.limit(0)) == []
    twice = df.where("vec_id IN (0, 1)").unionAll(df.where("vec_id = 0"))
    assert found(twice) == [(0, 1, 1, 256 * 256 * 5)] * 2


def test_query(spark):
    table = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.select("vec_id", "embedding").collect()]
    got = QUERIES["op6_exact_top_k"](spark, TESTDATA).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5)


def test_a_block_sends_no_more_ranges_than_results():
    """At most k of each query, whatever the scores of the others."""
    import pyarrow as pa

    from oddsmith.llm.topk import _count

    rng = np.random.default_rng(4)
    q, v = rng.integers(-256, 256, (20, 8)).astype(np.float32), rng.integers(-256, 256, (500, 8)).astype(np.float32)
    row = {"q_block": 7, "dim": 8, "q_ids": np.arange(20).tobytes(), "ids": np.arange(500).tobytes(), "q_v": q.tobytes(),
           "v": v.tobytes(), "q_top": 256.0, "top": 256.0, "low": [-(1 << 20)] * 20}
    sent = pa.Table.from_batches(list(_count(5, 128, 1 << 14)(iter([pa.RecordBatch.from_pylist([row])])))).to_pydict()
    scores = (q @ v.T).astype(int)
    for at in range(20):
        own = [(s, n) for a, s, n in zip(sent["at"], sent["slot"], sent["n"]) if a == at]
        best = sorted((x for i, x in enumerate(scores[at]) if i != at), reverse=True)[:5]
        slots = sorted(((x + (1 << 20)) // 128 for x in best), reverse=True)
        assert len(own) <= 5 and sorted({s for s, _ in own}, reverse=True) == sorted(set(slots), reverse=True)
        assert sum(n for _, n in own) >= 5
