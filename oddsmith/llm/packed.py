"""Texts in compressed batches, and the anchor values that different documents share.

Two operators look for passages that documents share. Both pick *anchors*, hashes of
short strings chosen by content alone, so that equal passages have equal anchors.
Only regions whose anchors occur in more than one document are worth a closer look;
they are found here without sending any text:

1. documents go into batches of about 4 MB, compressed, written once;
2. each batch sends its distinct anchor values, by value range, to the task of the
   range, which answers each batch with those that others have too;
3. the operator goes on with the batch and its shared values.

A value that very many documents hold counts once per batch. Batches and ranges both
have bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.shared import pieces, written
from oddsmith.llm.words import Texts, texts_of

BATCH_BYTES = 4 << 20
#: Text whose anchors meet in one task of a range.
RANGE_BYTES = 4 << 20
#: An anchor in more batches than this is told apart, so that an operator can deal
#: its occurrences to several tasks.
HOT_BATCHES = 64
PIECE_BYTES = 1 << 20
ROW_BITS, BATCH_BITS = 17, 22

#: From the texts of a piece: the text and the value of each anchor.
Anchors = Callable[[Texts], tuple[np.ndarray, np.ndarray]]


def squeeze(array: np.ndarray) -> bytes:
    """Numbers with their bytes in planes, compressed."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, texts and, as an Arrow stream, the other columns of each batch."""
    partition = TaskContext.get().partitionId()
    for number, piece in enumerate(pieces(batches, "text", BATCH_BYTES)):
        texts = texts_of(piece.column("text"))
        ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        others = piece.drop_columns(["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, others.schema) as stream:
            stream.write_batch(others)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "batch": partition << BATCH_BITS | number,
                    "bytes": len(texts.data),
                    "ids": ids.tobytes(),
                    "offsets": texts.offsets.tobytes(),
                    "z": zstandard.ZstdCompressor(level=9).compress(texts.data.tobytes()),
                    "others": zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()),
                }
            ],
            schema=pa.schema(
                [("batch", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()),
                 ("offsets", pa.binary()), ("z", pa.binary()), ("others", pa.binary())]
            ),
        )


def pack(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` and other columns in batches; written, so that a batch stays what
    it is."""
    schema = "batch long, bytes long, ids binary, offsets binary, z binary, others binary"
    return written(documents.mapInArrow(_pack, schema))


def others_of(row: dict) -> pa.Table:
    """The other columns of a batch."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["others"])).read_all()


def unpack(row: dict) -> tuple[np.ndarray, Texts]:
    """Ids and texts of a batch."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"]), np.uint8)
    return np.frombuffer(row["ids"], np.int64), Texts(data, np.frombuffer(row["offsets"], np.int64))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def parts(texts: Texts, limit: int = PIECE_BYTES) -> Iterator[tuple[int, Texts]]:
    """Runs of texts of about ``limit`` bytes, with the number of the first."""
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        begin, end = texts.offsets[first], texts.offsets[last]
        yield first, Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin)
        first = last


def _announce(anchors: Anchors, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, texts = unpack(row)
            values, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, part in parts(texts):
                doc, value = anchors(part)
                order = np.argsort(value)
                doc, value = ids[first + doc[order]], value[order]
                keep = np.ones(len(value), bool)  # once for each document next to itself
                keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                values.append(value[keep])
                docs.append(doc[keep])
            value, doc = np.concatenate(values), np.concatenate(docs)
            order = np.argsort(value)
            value, doc = value[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else []
            if not len(start):
                continue
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            value = value[start]
            at = np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            out = []
            for part, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if a < b:
                    steps = np.diff(value[a:b], prepend=np.uint64(0))
                    flags = np.packbits(several[a:b]).tobytes()
                    out.append((part, row["batch"], int(b - a), squeeze(steps), flags))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["part", "batch", "n", "steps", "flags"],
            )

    return run


def _answer(group: pa.Table) -> pa.Table:
    values, owners, flags = [], [], []
    batches = group.column("batch").to_numpy()
    columns = (group.column(x).to_pylist() for x in ("n", "steps", "flags"))
    for i, (n, steps, several) in enumerate(zip(*columns)):
        values.append(np.cumsum(expand(steps, np.uint64), dtype=np.uint64))
        owners.append(np.full(n, i, np.int32))
        flags.append(np.unpackbits(np.frombuffer(several, np.uint8), count=n).astype(bool))
    value, owner, flag = map(np.concatenate, (values, owners, flags))
    order = np.argsort(value)
    value, owner, flag = value[order], owner[order], flag[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(start, len(value)))
    shared = (count > 1) | np.logical_or.reduceat(flag, start)
    shared, hot = np.repeat(shared, count), np.repeat(count > HOT_BATCHES, count)
    value, owner, hot = value[shared], owner[shared], hot[shared]
    order = np.argsort(owner, kind="stable")
    value, owner, hot = value[order], owner[order], hot[order]
    at = np.searchsorted(owner, np.arange(len(batches) + 1))
    out = [
        (int(batches[i]), squeeze(value[a:b][~hot[a:b]]), squeeze(value[a:b][hot[a:b]]))
        for i, (a, b) in enumerate(zip(at[:-1], at[1:]))
        if a < b
    ]
    kinds = (pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*out)) or [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["batch", "shared", "hot"])


def range_bits(packed: DataFrame) -> int:
    """Into how many ranges (a power of two) the values of these batches go."""
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    return max(4, (total // RANGE_BYTES).bit_length())


def with_shared_anchors(packed: DataFrame, anchors: Anchors, bits: int) -> DataFrame:
    """The batches, each with ``answers``: its anchor values that other documents hold."""
    sent = packed.mapInArrow(_announce(anchors, bits), "part int, batch long, n int, steps binary, flags binary")
    answers = sent.groupBy("part").applyInArrow(_answer, "batch long, shared binary, hot binary")
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("shared", "hot")).alias("answers"))
    return packed.join(answers, "batch")


def shared_values(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shared values of a batch, and those of them that are hot."""
    both = [np.concatenate([expand(x[name], np.uint64) for x in row["answers"]]) for name in ("shared", "hot")]
    return np.sort(np.concatenate(both)), np.sort(both[1])


def cropped(h: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bits of hashes."""
    return h >> np.uint64(64 - width) << np.uint64(64 - width)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
