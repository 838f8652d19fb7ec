"""Exact substring deduplication over suffix arrays.

Every byte goes that lies in a string of ``length`` bytes which also starts in a
document with a smaller id. Sorting all suffixes of a corpus at once would move
each text many times over, so equal strings are first brought together:

1. In each window of ``length`` bytes the least of the hashes of its 24-byte strings
   is its anchor. Equal windows have equal anchors; neighbouring windows mostly
   share theirs, and make a *span*. ``packed`` finds the anchors that several
   documents hold.
2. Spans of those anchors go, as hashes, to the task of the anchor's range, each distinct
   span of a batch once, for its smallest document. Hot anchors are dealt as single
   windows. Anchors with one distinct span are settled there by the smallest id, so
   single windows always are.
3. Of the other anchors, at the edges of repeated passages, each distinct span's text is
   asked for once. The texts are laid behind one another, and their suffixes sorted to
   the depth of ``length``. Breadth-first backward extension
   on the Burrows-Wheeler transform then derives common prefixes by increasing value:
   from the intervals of all strings W of n bytes come those of all cW, until n
   reaches ``length``. Each last interval is one distinct window, and takes the
   smallest id of its members.

Anchors and equal spans are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.packed import (
    PIECE_BYTES, expand, is_in, pack, parts, range_bits, rows_of, shared_values, squeeze, unpack, with_shared_anchors,
)
from oddsmith.llm.shared import written
from oddsmith.llm.words import Texts, mix, powers, prefix_sums, ranges, substring_hash

ANCHOR_BYTES = 24
_ENTRY = np.dtype([("row", "<i4"), ("doc", "<i8"), ("at", "<i8"), ("anchor", "<u8"), ("n", "<i4"), ("span", "<u8")])
#: An entry of a known batch.
_HELD = np.dtype([("batch", "<i8"), *_ENTRY.descr])
_RANGE = np.dtype([("row", "<i4"), ("a", "<i8"), ("b", "<i8")])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while done < width and len(values) > 0:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _spans(texts: Texts, length: int):
    """Of each maximal run of windows with one anchor: text, first and last window,
    anchor; and the sums for substring hashes."""
    n = len(texts.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    k = min(ANCHOR_BYTES, length)
    sums = prefix_sums(texts)
    grams = mix((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
    least = window_minima(grams, length - k + 1)
    # Windows that would reach into the next text don't count.
    starts, ends = texts.offsets[:-1], texts.offsets[1:]
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, np.maximum(starts, ends - length + 1), 1)
    np.add.at(out, ends, -1)
    valid = np.cumsum(out)[: len(least)] == 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    return np.searchsorted(texts.offsets, first, "right") - 1, first, last, least[first], sums


def _anchors(length: int):
    def run(texts: Texts):
        doc, _, _, anchor, _ = _spans(texts, length)
        return doc, anchor

    return run


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Byte ranges a-b of rows, those that touch joined."""
    out = np.zeros(len(row), _RANGE)
    order = np.lexsort((a, row))
    out["row"], out["a"], out["b"] = row[order], a[order], b[order]
    if not len(out):
        return out
    # Rows far apart, the furthest end so far grows within a row only.
    gap = int(out["b"].max()) + 1
    far = out["row"].astype(np.int64) * gap
    reach = np.maximum.accumulate(far + out["b"])
    new = np.ones(len(out), bool)
    new[1:] = (far + out["a"])[1:] > reach[:-1]
    start = np.flatnonzero(new)
    joined = out[start]
    joined["b"] = np.maximum.reduceat(far + out["b"], start) - far[start]
    return joined


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


_SENT = "part int, batch long, entries binary, done binary"


def _send(length: int, bits: int):
    """Spans of shared anchors, to the task of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in rows_of(batches):
            ids, texts = unpack(item)
            shared, hot = shared_values(item)
            found = []
            for first, part in parts(texts):
                doc, a, b, anchor, sums = _spans(part, length)
                keep = is_in(anchor, shared)
                doc, a, b, anchor = doc[keep], a[keep], b[keep], anchor[keep]
                single = is_in(anchor, hot)
                if single.any():  # each window of a hot anchor for itself
                    count = np.where(single, b - a + 1, 1)
                    of = np.repeat(np.arange(len(a)), count)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    doc, a, b, anchor, single = doc[of], a[of] + step, b[of], anchor[of], single[of]
                    b = np.where(single, a, b)
                span = substring_hash(sums, a, b + length)
                entry = np.zeros(len(a), _ENTRY)
                entry["row"], entry["doc"] = first + doc, ids[first + doc]
                entry["at"], entry["n"] = a - part.offsets[doc], b - a + length
                entry["anchor"], entry["span"] = np.where(single, span, anchor), span
                found.append(entry)
            entry = np.concatenate(found)
            entry = entry[np.lexsort((entry["doc"], entry["span"], entry["anchor"]))]
            start = np.flatnonzero(_new(entry["anchor"], entry["span"]))
            least = np.repeat(entry["doc"][start], np.diff(np.append(start, len(entry))))
            later = entry["doc"] > least  # a smaller document of this batch has the span
            gone, entry = entry[later], entry[~later]
            done = merged(gone["row"], gone["at"], gone["at"] + gone["n"])
            part = (entry["anchor"] >> np.uint64(64 - bits)).astype(np.int64)
            at = np.searchsorted(part, np.arange((1 << bits) + 1))
            out = []
            if len(done):
                out.append((int(item["batch"] % (1 << bits)), item["batch"], None, squeeze(done)))
            for p, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if a < b:
                    some = entry[a:b].copy()
                    some["span"] ^= some["anchor"]  # nothing for single windows
                    some["anchor"][1:] = np.diff(some["anchor"])  # steps take fewer bytes
                    out.append((p, item["batch"], squeeze(some), None))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["part", "batch", "entries", "done"],
                )

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (the text ends in zeros)."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # symbols have nine bits
        key = key << np.uint64(9) | padded[i : n + i]
    known = 7
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        new = np.ones(n, np.int64)
        new[0], new[1:] = 0, key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        step = min(known, depth - known)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = (rank * (n + 1) + after).view(np.uint64)
        known += step


def equal_windows(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of the text (symbols 1-256, 0 between strings, 0 at its end) the
    number of the interval of its first ``length`` symbols.

    The transform is walked backwards from all intervals at once. ``after`` leads from
    a suffix's place in the order to that of the suffix one symbol shorter, so the
    suffixes that begin with cW are those of the symbol c whose next place lies in the
    interval of W. At step n exactly the common prefixes of value n end.
    """
    order = suffix_order(text, length)
    n = len(text)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    after = place[(order + 1) % n]
    symbol = text[order]
    edge = symbol[1:] != symbol[:-1]
    interval = np.zeros(n, np.int32)
    for _ in range(length):
        below = interval[after]
        interval[1:] = np.cumsum(edge | (below[1:] != below[:-1]))
        interval[0] = 0
        if interval[-1] == n - 1:
            break
    return interval[place]


_MET = "batch long, part int, gone binary, asked binary, held binary"


def _meet(group: pa.Table) -> pa.Table:
    """Of one range: by batch what goes already; of anchors with several distinct spans
    all entries, and by batch the places whose text is asked for."""
    part = int(group.column("part")[0].as_py())
    out, entries = [], [np.zeros(0, _HELD)]
    for batch, sent, done in zip(*(group.column(x).to_pylist() for x in ("batch", "entries", "done"))):
        if done is not None:
            out.append((batch, None, done, None, None))
            continue
        some = expand(sent, _ENTRY)
        held = np.zeros(len(some), _HELD)
        for name in _ENTRY.names:
            held[name] = some[name]
        held["batch"], held["anchor"] = batch, np.cumsum(some["anchor"], dtype=np.uint64)
        held["span"] ^= held["anchor"]
        entries.append(held)
    entry = np.concatenate(entries)
    entry = entry[np.lexsort((entry["doc"], entry["span"], entry["anchor"]))]
    if len(entry):
        new_anchor, new_span = _new(entry["anchor"]), _new(entry["anchor"], entry["span"])
        number = np.cumsum(new_anchor) - 1
        alone = np.bincount(number, weights=new_span)[number] == 1
        # One distinct span: whole spans of later documents go.
        least = entry["doc"][np.flatnonzero(new_span)][np.cumsum(new_span) - 1]
        whole = entry[alone & (entry["doc"] > least)]
        for batch, row, a, b in _by_batch(whole["batch"], whole["row"], whole["at"], whole["at"] + whole["n"]):
            out.append((batch, None, squeeze(merged(row, a, b)), None, None))
        reps = entry[~alone & new_span]
        for batch, row, a, n in _by_batch(reps["batch"], reps["row"], reps["at"], reps["n"]):
            asked = np.zeros(len(row), _RANGE)
            asked["row"], asked["a"], asked["b"] = row, a, a + n
            out.append((batch, part, None, squeeze(asked), None))
        if len(reps):
            out.append((None, part, None, None, squeeze(entry[~alone])))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*out)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["batch", "part", "gone", "asked", "held"])


def _by_batch(batch: np.ndarray, *columns: np.ndarray):
    """The rows of each batch, in their order."""
    order = np.argsort(batch, kind="stable")
    at = np.flatnonzero(_new(batch[order])) if len(batch) else []
    for i, j in zip(at, np.append(at, len(batch))[1:]):
        yield int(batch[order[i]]), *(x[order[i:j]] for x in columns)


def _give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the places that ranges ask for."""
    for item in rows_of(batches):
        _, texts = unpack(item)
        for x in item["asked"]:
            asked = expand(x["asked"], _RANGE)
            text = texts.data[ranges(texts.offsets[asked["row"]] + asked["a"], asked["b"] - asked["a"])]
            text = zstandard.ZstdCompressor(level=3).compress(text.tobytes())
            yield pa.RecordBatch.from_pylist([{"part": x["part"], "batch": item["batch"], "text": text}], schema=_GIVEN)


_GIVEN = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("text", pa.binary())])


def _settle(length: int):
    """What goes, for the anchors of one range that have several distinct spans."""

    def run(held: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            entry = expand(held.column("held")[0].as_py(), _HELD)
            texts = dict(zip(given.column("batch").to_pylist(), given.column("text").to_pylist()))
            for batch, gone in _gone(entry, texts, length):
                out.append((batch, squeeze(gone)))
        columns = list(zip(*out)) or [[], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["batch", "gone"])

    return run


def _gone(entry: np.ndarray, texts: dict[int, bytes], length: int):
    """The texts of a batch lie in the order of the entries that were asked for."""
    n = entry["n"].astype(np.int64)
    new_anchor, new_span = _new(entry["anchor"]), _new(entry["anchor"], entry["span"])
    of, number = np.cumsum(new_span) - 1, np.cumsum(new_anchor) - 1
    begin, text, end = np.zeros(len(entry), np.int64), [], 0
    for batch, e in _by_batch(entry["batch"][new_span], np.flatnonzero(new_span)):
        begin[e] = end + np.cumsum(n[e]) - n[e]
        end += int(n[e].sum())
        text.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(texts[batch]), np.uint8))
    text = np.concatenate(text)
    laid = np.bincount(number, weights=(n + 1) * new_span).astype(np.int64)
    found = []
    for some in _chunks(laid):  # the suffixes of some anchors at a time
        at = np.arange(*np.searchsorted(number, [some.start, some.stop]))
        e, window = _windows_gone(entry, at, of[at], begin, n, text, length)
        found.append((entry["batch"][e], entry["row"][e], entry["at"][e] + window))
    batch, row, a = map(np.concatenate, zip(*found))
    for batch, row, a in _by_batch(batch, row, a):
        yield batch, merged(row, a, a + length)


def _chunks(sizes: np.ndarray) -> list[slice]:
    """Runs of items that together have about PIECE_BYTES, or are one item."""
    part = (np.cumsum(sizes) - sizes) // PIECE_BYTES
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(sizes) else [0]
    return [slice(int(i), int(j)) for i, j in zip(edges[:-1], edges[1:])]


def _windows_gone(entry, e, span, begin, n, text, length) -> tuple[np.ndarray, np.ndarray]:
    """Of entries ``e``, in the order of their ``span`` and then their document: the entries
    and the windows that a smaller document has."""
    new = np.concatenate([[True], span[1:] != span[:-1]])
    mine = np.cumsum(new) - 1
    reps = e[new]  # of each distinct span, its smallest document
    size = n[reps] + 1
    laid = np.zeros(int(size.sum()) + 1, np.int16)
    laid[ranges(np.cumsum(size) - size, n[reps])] = text[ranges(begin[reps], n[reps])].astype(np.int16) + 1
    windows = n[reps] - length + 1
    interval = equal_windows(laid, length)[ranges(np.cumsum(size) - size, windows)]
    least = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, interval, np.repeat(entry["doc"][reps], windows))
    least = least[interval]
    count = windows[mine]
    lost = least[ranges((np.cumsum(windows) - windows)[mine], count)] < np.repeat(entry["doc"][e], count)
    window = np.arange(len(lost)) - np.repeat(np.cumsum(count) - count, count)
    return e[np.repeat(np.arange(len(e)), count)[lost]], window[lost]


_CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for item in rows_of(batches):
        ids, texts = unpack(item)
        gone = [expand(x, _RANGE) for x in item["gone"] or []]
        gone = np.concatenate(gone) if gone else np.zeros(0, _RANGE)
        gone = merged(gone["row"], gone["a"], gone["b"])
        at = np.searchsorted(gone["row"], np.arange(len(texts) + 1))
        ranges = list(zip(gone["a"].tolist(), gone["b"].tolist()))
        out = []
        for i, doc in enumerate(ids.tolist()):
            text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
            spans = ranges[at[i] : at[i + 1]]
            kept, end = [], 0
            for a, b in spans:
                kept.append(text[end:a])
                end = b
            kept.append(text[end:])
            out.append((doc, len(text), sum(b - a for a, b in spans), [list(x) for x in spans], b"".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)


def remove_repeated_bytes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans`` (maximal removed runs
    of bytes, begin and end) and ``kept``, the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input and never cross documents.

    Defined cases: a null text is empty; a text of fewer bytes loses nothing. Rows that
    share an id do not take from one another. A row with a null id loses nothing and
    takes nothing. Extra columns are left behind. An empty table gives no rows.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = pack(rows.where("doc_id IS NOT NULL"))
    bits = range_bits(packed)
    ready = with_shared_anchors(packed, _anchors(length), bits)
    sent = ready.mapInArrow(_send(length, bits), _SENT)
    met = written(sent.groupBy("part").applyInArrow(_meet, _MET))
    asked = met.where("asked IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("part", "asked")).alias("asked"))
    given = packed.join(asked, "batch").mapInArrow(_give, "part int, batch long, text binary")
    held = met.where("held IS NOT NULL").select("part", "held").groupBy("part")
    gone = held.cogroup(given.groupBy("part")).applyInArrow(_settle(length), "batch long, gone binary")
    gone = met.where("gone IS NOT NULL").select("batch", "gone").union(gone)
    gone = gone.groupBy("batch").agg(F.collect_list("gone").alias("gone"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary"
    cut = packed.join(gone, "batch", "left").mapInArrow(_cut, schema)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    untold = rows.where("doc_id IS NULL").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.expr("CAST(array() AS array<array<long>>)").alias("spans"),
        text.alias("kept"),
    )
    return cut.union(untold)
