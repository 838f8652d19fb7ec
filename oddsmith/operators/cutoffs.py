"""Exact order statistics of a key hash, for each stratum of a table.

An exact split needs, per stratum, the hash below which exactly k rows lie. Sorting
or ranking the table would shuffle all of it and send a hot stratum to one task.
Instead the hash range is narrowed by counting: rows per coarse hash cell, then
per fine cell inside the one coarse cell that holds rank k, then per hash. Each
pass is a scan of a few columns with a partial aggregation, and only the cell
counts are shuffled.

Strata, ranks and cutoffs are tables: there may be as many strata as there are rows.
They are kept while they are used, so Spark knows their size when it chooses how to
join them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import key_hash

HASH = "_hash"
STRATUM = "_stratum"
# A cell is the leading digits of a hash: four more digits are 65,536 cells more.
# The last pass sorts the hashes of one cell, about SMALL of them at most.
DIGITS = 32
CELL_DIGITS = 4
SMALL = 1 << 20
NO_HASH = ""


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed and kept, so that its size is known."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def with_stratum(df: DataFrame, stratify: Sequence[str]) -> DataFrame:
    """Add the stratum: a struct, which equals itself also where its fields are NULL."""
    return df.withColumn(STRATUM, F.struct(*stratify) if stratify else _everything())


def _everything() -> Column:
    """One stratum for all rows. Every hash is as long; a literal would be folded, and the
    joins on it would lose their key."""
    return F.struct(F.length(HASH).alias("digits"))


def count_strata(df: DataFrame) -> DataFrame:
    """Rows ``_rows`` of each stratum."""
    return kept(df.groupBy(STRATUM).agg(F.count(F.lit(1)).alias("_rows")))


def _passes(rows: int, small: int) -> list[int]:
    """How many leading digits each pass looks at."""
    digits = []
    while rows > small and len(digits) < 3:
        digits.append(CELL_DIGITS * (len(digits) + 1))
        rows >>= 4 * CELL_DIGITS
    return [*digits, DIGITS]


def hash_cutoffs(hashed: DataFrame, ranks: DataFrame, most: int, small: int = SMALL) -> DataFrame:
    """``_stratum, _at, _edge``: for each wanted rank ``_rank`` of a stratum (there may be
    several, numbered by ``_at``) the smallest hash with so many rows up to it.

    Rank 0 gives NO_HASH, which sorts before every hash. ``most`` is the number of
    rows of the largest stratum.
    """
    rows = hashed.select(STRATUM, HASH)
    # The rank left to find within the cell found so far.
    wanted = ranks.where("_rank > 0").withColumn("_outer", F.lit(NO_HASH))
    before = 0
    for digits in _passes(most, small):
        wanted = kept(wanted.select(STRATUM, "_at", "_rank", "_outer"))
        cells = rows.select(
            STRATUM,
            F.expr(f"substring({HASH}, 1, {before}) AS _outer"),
            F.expr(f"substring({HASH}, 1, {digits}) AS _cell"),
        )
        inside = wanted.select(STRATUM, "_outer").distinct()
        counts = (
            cells.join(inside, [STRATUM, "_outer"], "left_semi")
            .groupBy(STRATUM, "_outer", "_cell")
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        # A window partition holds the cells, or at last the hashes, of one cell.
        upto = f"sum(_n) OVER (PARTITION BY {STRATUM}, _outer ORDER BY _cell) AS _upto"
        running = counts.selectExpr("*", upto)
        wanted = (
            running.join(wanted, [STRATUM, "_outer"])
            .where("_upto >= _rank AND _upto - _n < _rank")
            .selectExpr(STRATUM, "_at", "_rank - (_upto - _n) AS _rank", "_cell AS _outer")
        )
        before = digits
    found = wanted.select(STRATUM, "_at", F.col("_outer").alias("_edge"))
    edges = ranks.select(STRATUM, "_at").join(found, [STRATUM, "_at"], "left")
    return edges.select(STRATUM, "_at", F.coalesce("_edge", F.lit(NO_HASH)).alias("_edge"))


def attach_cutoffs(hashed: DataFrame, ranks: DataFrame, strata: DataFrame) -> DataFrame:
    """The frame with ``_cuts``, the cutoffs of each row's stratum in the order of their
    numbers. One pass over the cutoffs, then a join the size of the strata."""
    most = strata.agg(F.max("_rows")).first()[0] or 0
    edges = hash_cutoffs(hashed, ranks, most)
    in_order = F.sort_array(F.collect_list(F.struct("_at", "_edge")))
    cuts = edges.groupBy(STRATUM).agg(F.transform(in_order, lambda x: x["_edge"]).alias("_cuts"))
    return hashed.join(kept(cuts), STRATUM, "left")


def shared_out(strata: DataFrame, stratify: Sequence[str], test_size: float) -> DataFrame:
    """``_stratum, _at, _rank``: test rows of each stratum. All strata together have their
    share of rows, rounded up; train rows per stratum are rounded down, those left over
    going to the largest remainders, and among equal ones by a hash of the stratum.

    The remainder follows from a stratum's size, so there are at most about
    sqrt(2 * rows) of them, and they fit one small window.
    """
    total = strata.agg(F.sum("_rows")).first()[0] or 0
    n_train = total - math.ceil(test_size * total)
    product = f"CAST(_rows AS DECIMAL(38, 0)) * {n_train}"
    whole = f"CAST({max(total, 1)} AS DECIMAL(38, 0))"
    parts = strata.selectExpr(STRATUM, "_rows", f"CAST(({product}) % {whole} AS BIGINT) AS _rest")
    parts = parts.selectExpr("*", f"CAST(({product} - _rest) DIV {whole} AS BIGINT) AS _low")
    low = parts.agg(F.sum("_low")).first()[0] or 0
    missing = n_train - low
    extra = F.lit(False)
    if missing:
        sizes = parts.groupBy("_rest").agg(F.count(F.lit(1)).alias("_n"))
        upto = "sum(_n) OVER (ORDER BY _rest DESC) AS _upto"
        last = sizes.selectExpr("*", upto).where(f"_upto >= {missing} AND _upto - _n < {missing}").first()
        names = [f"{STRATUM}.`{name}`" for name in stratify]
        name_hash = key_hash([F.col(name) for name in names], "stratum")
        tied = parts.where(F.col("_rest") == last["_rest"]).select(name_hash.alias(HASH))
        tied = with_stratum(tied, [])
        rank = missing - (last["_upto"] - last["_n"])
        one = tied.select(STRATUM).limit(1).selectExpr(STRATUM, "0 AS _at", f"{rank}L AS _rank")
        edge = hash_cutoffs(tied, one, last["_n"]).first()["_edge"]
        extra = (F.col("_rest") > last["_rest"]) | ((F.col("_rest") == last["_rest"]) & (name_hash <= edge))
    tests = F.col("_rows") - F.col("_low") - extra.cast("long")
    return parts.select(STRATUM, F.lit(0).alias("_at"), tests.alias("_rank"))

