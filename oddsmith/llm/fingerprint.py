"""Document fingerprints by a threshold-scaled sketch.

Of a text's runs of five words, every one is retained whose hash lies below a fixed
fraction of the hash range, and the smallest one in any case, so that a text with words
has a fingerprint. The sketch of a union is the union of the sketches (the threshold is
the same everywhere), and the share of a sketch that another holds estimates the share of
the text that the other contains, however unequal the two are.

Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: One hash of so many is retained.
SCALE = 4
ROWS_PER_BUCKET = 2_048
MOST_BUCKETS = 16_384
_PER_BUCKET = 16  # sampled ids
_LEAST = -(1 << 63)


def add_sketch(
    df: DataFrame, text: str, output: str, size: int = SHINGLE_WORDS, scale: int = SCALE
) -> DataFrame:
    """The frame with ``output``, the sorted retained hashes of the text (array<long>)."""
    words, hashes = f"{output}__words", f"{output}__hashes"
    run = ", ".join(["w", *[f"{words}[i + {j}]" for j in range(1, size)]])
    df = df.withColumn(words, F.expr(f"filter(split({text}, '[ \\\\x09-\\\\x0D]+'), w -> w <> '')"))
    df = df.withColumn(
        hashes,
        F.expr(
            f"""CASE WHEN size({words}) >= {size} THEN
                       transform(slice({words}, 1, size({words}) - {size - 1}), (w, i) -> xxhash64({run}))
                     WHEN size({words}) > 0 THEN array(xxhash64({words}))
                     ELSE CAST(array() AS array<bigint>) END"""
        ),
    ).drop(words)
    below = _LEAST + (1 << 64) // scale
    df = df.withColumn(output, F.expr(f"sort_array(array_distinct(filter({hashes}, h -> h < {below}L)))"))
    first = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.col(output))
    return df.withColumn(output, F.when(F.size(output) > 0, F.col(output)).otherwise(first)).drop(hashes)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str) -> DataFrame:
    """One sketch for each group: that of all its texts together. A group's smallest hash
    may be one below no threshold, as in ``add_sketch``."""
    each = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def contained(sketch: str, other: str) -> Column:
    """Estimated share of the one text's shingles that the other has. Equal sketches give
    1, also if both are empty; an empty one gives 0 against any other."""
    shared = F.size(F.array_intersect(sketch, other)) / F.size(sketch)
    return F.when(F.col(sketch) == F.col(other), 1.0).when(F.size(sketch) > 0, shared).otherwise(0.0)


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame with ``bucket``: ranges of the key of about equal size, from a bounded
    sample of keys. The bounds are one array; each row finds its range by halving."""
    rows = df.count()
    buckets = min(MOST_BUCKETS, rows // ROWS_PER_BUCKET + 1)
    share = min(1.0, buckets * _PER_BUCKET / max(rows, 1))
    chosen = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = [r[0] for r in df.where(chosen).select(key).distinct().orderBy(key).collect()]
    bounds = [keys[len(keys) * i // buckets] for i in range(1, buckets)] if keys else []
    steps = max(1, len(bounds).bit_length())
    bounds += [(1 << 63) - 1] * ((1 << steps) - len(bounds))
    text = ",".join(map(str, bounds))
    search = f"""aggregate(sequence(0, {steps - 1}), 0, (at, i) ->
        IF(CAST(split('{text}', ',') AS array<bigint>)[at + shiftleft(1, {steps - 1} - i) - 1] <= {key},
           at + shiftleft(1, {steps - 1} - i), at))"""
    return df.withColumn("bucket", F.expr(search))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: each document beside the next one by
    descending id; the last is followed by the first.

    Ids are cut into ranges, and each range is a window of its own. The first document of
    a range is also sent, as a guest, to the range before it; there are as many guests as
    ranges. Rows that share an id follow one another by a hash of their text; null ids
    come last.
    """
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("sort_key"),
    )
    rows = _bucketed(rows, "sort_key")
    first = rows.groupBy("bucket").agg(F.max("sort_key").alias("sort_key"))
    # At most MOST_BUCKETS rows: a range's guest goes to the next range above, that of the
    # highest range to the lowest.
    order = W.partitionBy(F.lit(1)).orderBy("bucket")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    to = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole))
    guests = first.select("sort_key", to.alias("to"))
    guests = rows.join(F.broadcast(guests), "sort_key").select(
        "doc_id", "text", "sort_key", F.col("to").alias("bucket"), F.lit(True).alias("guest")
    )
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    every = add_sketch(every, "text", "sketch")
    within = W.partitionBy("bucket").orderBy("guest", F.desc("sort_key"), F.xxhash64("text"))
    return (
        every.withColumn("next_text", F.lead("text").over(within))
        .withColumn("next_sketch", F.lead("sketch").over(within))
        .where("NOT guest")
        .select("doc_id", "text", "sketch", "next_text", "next_sketch")
    )


def fingerprints_beside_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``.

    ``edited`` is the text with its last ``floor(n_chars / 3)`` code points replaced by the
    first as many (or all) of the next document by descending id. The likeness is the
    estimated share of the document's shingles that the other text has.

    Defined cases: a null text is empty; a text without words has an empty sketch, which is
    like an equal one only. A single document is its own next. Null ids come last; rows
    that share an id follow one another by a hash of their text. Extra columns are left
    behind. An empty table gives no rows.
    """
    both = with_next(documents, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    edit = "CAST(n_chars DIV 3 AS int)"
    both = both.withColumn(
        "edited",
        F.expr(f"concat(substring(text, 1, CAST(n_chars AS int) - {edit}), substring(next_text, 1, {edit}))"),
    ).drop("text", "next_text")
    both = add_sketch(both, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        contained("sketch", "edited_sketch").alias("near_edited"),
        contained("sketch", "next_sketch").alias("near_next"),
    )
