"""Outcome rates and distributions by column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome_rate(
    df: DataFrame,
    col: str = "gender",
    criterion: str | Column = "app_started",
    *,
    order: str = "n",
    digits: int | None = 5,
    name: str | None = None,
) -> DataFrame:
    """How many rows of each value have an outcome, and how many meet it.

    ``n`` counts rows whose criterion is known, ``n_<criterion>`` those where it
    is true, ``p_<criterion>`` is their ratio, NULL where ``n`` is 0. The
    criterion is a boolean column name, or any boolean expression with ``name``
    naming it. ``order`` is ``n``, ``p`` or a result column. ``digits=None``
    leaves the ratio unrounded, as a chart wants it.
    """
    if isinstance(criterion, str):
        name = name or criterion
        criterion = F.col(criterion)
    elif name is None:
        raise ValueError("an expression criterion needs a name")
    n_name, p_name = f"n_{name}", f"p_{name}"
    ratio = F.try_divide(F.col(n_name), F.col("n"))
    return (
        df.select(F.col(col), criterion.alias("_met"))
        .groupBy(col)
        .agg(F.count("_met").alias("n"), F.count_if("_met").alias(n_name))
        .withColumn(p_name, ratio if digits is None else F.round(ratio, digits))
        .orderBy(F.col(p_name if order == "p" else order))
    )


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """The mean of ``y`` for each ``x``: what a bar chart shows."""
    return (
        df.select(x, y)
        .groupBy(x)
        .agg(F.avg(y).alias(f"mean_{y}"), F.count(y).alias("n"))
        .orderBy(x)
    )


#: Of 32 bits drawn evenly, those at or above the n-th bound have a weight above n:
#: weights are Poisson with mean 1.
_BITS = 32
POISSON_BOUNDS = [
    math.floor(2**_BITS * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(12)
]


def mean_intervals(
    df: DataFrame, x: str, y: str, key: str, *, replicates: int = 100, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """``mean_by`` with a bootstrap interval of each mean, ``low_<y>`` to ``high_<y>``.

    Each row has a Poisson weight in each replicate, from a hash of its key: weights do not
    depend on how rows lie, and all replicates come from one pass. A task folds its rows
    to one sum for each ``x`` and replicate before the shuffle, however frequent an ``x``.
    The ends are replicate means of the nearest rank (a mean of all weights 0 is left out).

    Missing ``y`` takes no part; an ``x`` without any has NULL ends. Rows without a key
    share their weights, as do rows that share one.
    """
    if not 0 < level < 1 or replicates < 1:
        raise ValueError("a level between 0 and 1, and one replicate or more")
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(key).cast("string").alias("key"))
    means = rows.groupBy("x").agg(F.avg("y").alias("mean"), F.count("y").alias("n"))
    digits = _BITS // 4
    per_hash = 32 // digits
    text = F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), F.coalesce("key", F.lit("")))
    drawn = (
        rows.where("y IS NOT NULL")
        .select("x", "y", "key", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // per_hash))).alias("block"))
        .select("x", "y", "block", F.md5(text.cast("binary")).alias("hash"))
        .select("x", "y", "block", "hash", F.explode(F.sequence(F.lit(0), F.lit(per_hash - 1))).alias("part"))
        .select(
            "x", "y", (F.col("block") * per_hash + F.col("part")).alias("replicate"),
            F.conv(F.substr("hash", F.col("part") * digits + 1, F.lit(digits)), 16, 10).cast("long").alias("bits"),
        )
        .where(F.col("replicate") < replicates)
    )
    weight = sum((F.col("bits") >= bound).cast("int") for bound in POISSON_BOUNDS)
    sums = (
        drawn.select("x", "y", "replicate", weight.alias("weight"))
        .groupBy("x", "replicate")
        .agg(F.sum(F.col("weight") * F.col("y")).alias("total"), F.sum("weight").alias("weights"))
    )
    found = (
        sums.where("weights > 0")
        .groupBy("x")
        .agg(F.sort_array(F.collect_list(F.col("total") / F.col("weights"))).alias("sorted"))
    )

    def end(share: float) -> Column:
        rank = F.ceil(F.round(F.lit(share) * F.size("sorted"), 9)).cast("int")
        return F.element_at("sorted", F.greatest(rank, F.lit(1)))

    ends = found.select(
        F.col("x").alias("same"), end((1 - level) / 2).alias("low"), end((1 + level) / 2).alias("high")
    )
    return (
        means.join(ends, F.col("x").eqNullSafe(F.col("same")), "left")
        .select(
            F.col("x").alias(x), F.col("mean").alias(f"mean_{y}"), "n",
            F.col("low").alias(f"low_{y}"), F.col("high").alias(f"high_{y}"),
        )
        .orderBy(x)
    )


def split_shapes(df: DataFrame, n_features: int, split: str = "split") -> DataFrame:
    """Rows and columns of the features and the target in each split."""
    return (
        df.groupBy(split)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_features", F.lit(n_features))
        .withColumn("n_targets", F.lit(1))
        .orderBy(split)
    )


def target_distribution(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Count and share of each target value in each split, most frequent first.

    Missing targets take no part. The window runs over the aggregated counts
    only: one row per split and target value.
    """
    counts = (
        df.filter(F.col(target).isNotNull())
        .groupBy(split, target)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(W.partitionBy(split))
    return counts.withColumn("fraction", F.col("n") / whole).orderBy(split, F.desc("n"), target)
