import random

import numpy as np
import pytest
from corpora import documents, empty, frame, odd, prose

from oddsmith.llm.packed import HOT_BATCHES
from oddsmith.llm.suffix_dedup import equal_windows, remove_repeated_bytes, suffix_order


def brute(rows, length):
    first = {}
    texts = [(doc, (text or "").encode()) for doc, text, *_ in rows]
    for doc, t in sorted(texts):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], doc)
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < doc:
                gone[i : i + length] = b"\x01" * length
        runs = len([x for x in bytes(gone).split(b"\x00") if x])
        out.append((doc, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def found(df, length):
    rows = remove_repeated_bytes(df, length=length).collect()
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows)


@pytest.mark.parametrize("length", [50, 24, 7])
def test_removal_equals_the_definition(spark, length):
    rng = random.Random(4)
    rows = documents()
    passage = prose(rng, 40)
    for i in range(20):  # parts of one passage, with ends that agree by chance
        a = rng.randrange(0, 100)
        rows.append((1000 + i, f"{prose(rng, 5, 3)} {passage[a : a + rng.randrange(40, 150)]}{prose(rng, 5, 3)}", "", "", 0))
    assert found(frame(spark, rows), length) == brute(rows, length)


def test_hot_anchors(spark):
    """Each partition is a batch of its own, and more batches than HOT_BATCHES share."""
    rng = random.Random(2)
    line = prose(rng, 12)
    rows = [(i, f"{prose(rng, 8)}\n{line}\n{prose(rng, 8)}", "", "", 0) for i in range(HOT_BATCHES + 40)]
    df = frame(spark, rows).repartition(HOT_BATCHES + 30)
    assert found(df, 50) == brute(rows, 50)


def test_odd_rows_and_columns(spark):
    rows = documents()
    text = rows[0][1] or "x" * 60
    repeated = [*rows, rows[0], rows[0]]
    assert found(frame(spark, repeated), 50) == brute(repeated, 50)
    result = remove_repeated_bytes(odd(spark, rows)).collect()
    assert len(result) == len(rows) + 2 and text is not None
    untold = [r for r in result if r["doc_id"] is None]
    assert sorted(bytes(r["kept"]) for r in untold) == [b"", b"text without an id"]
    assert remove_repeated_bytes(empty(spark)).count() == 0


def test_intervals_of_the_transform():
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 9):
        strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(20)]
        text = np.concatenate([x for s in strings for x in (s, [0])] + [[0]]).astype(np.int16)
        interval = equal_windows(text, length)
        full = [i for i in range(len(text) - length) if 0 not in text[i : i + length]]
        windows = {}
        for i in full:
            windows.setdefault(tuple(text[i : i + length]), set()).add(interval[i])
        assert all(len(x) == 1 for x in windows.values())
        assert len({x for s in windows.values() for x in s}) == len(windows)
        order = suffix_order(text, length)
        heads = [tuple(text[i : i + length]) for i in order if i + length <= len(text)]
        assert heads == sorted(heads)
