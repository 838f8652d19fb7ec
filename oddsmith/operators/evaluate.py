"""Exact evaluation of scores, as distributed aggregations.

ROC numbers need running counts in score order. One window over all scores would
put the table into one task. Here rows are first counted per distinct score (equal
scores fold before the shuffle, so a hot score costs one row per task), scores are
cut into buckets of about equal row count by bounds fixed beforehand, counts run
within each bucket, and the few bucket totals place the buckets behind one
another. All counts are integers, so the result does not depend on the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import quoted, required_number, required_outcome

ROWS_PER_BUCKET = 1 << 18
MAX_BUCKETS = 1 << 16
SAMPLES_PER_BUCKET = 20
# No bound changes a result, so few rows do with this one.
ANY_BOUNDS = [0.0]
# Products of two row counts leave the range of a long beyond 3e9 rows. Per score
# they are summed in two long parts, which code generation handles fast; the wide
# decimal type takes over for the bucket totals.
LOW_BITS = 20
COUNT, PRODUCT = "decimal(19,0)", "decimal(38,0)"


def score_bounds(scores: DataFrame, rows_per_bucket: int) -> list[float]:
    """Bounds between buckets of about ``rows_per_bucket`` rows, from a sample.

    The sample holds at most some SAMPLES_PER_BUCKET * MAX_BUCKETS numbers. It only
    decides how even the buckets are. Duplicate bounds merge: a score held by many
    rows is one row once counted.
    """
    rows = scores.count()
    buckets = min(-(-rows // rows_per_bucket), MAX_BUCKETS)
    if buckets < 2:
        return ANY_BOUNDS
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / rows)
    sample = scores.sample(share, seed=7).toArrow().column(0).to_numpy()
    sample = np.sort(sample[np.isfinite(sample)])
    if not len(sample):
        return ANY_BOUNDS
    edges = sample[(np.arange(1, buckets) * len(sample)) // buckets]
    return np.unique(edges).tolist()


def _scored(df: DataFrame, label: str, score: str, by: Sequence[str], weight: str | None) -> DataFrame:
    """``_by``, ``_score``, the outcome ``_y`` of every row, and how many rows it is."""
    # A struct equals itself also where its fields are NULL, so it can be a join key.
    return df.select(
        (F.struct(*by) if by else F.lit(0)).alias("_by"),
        required_number(F.col(score), "score").alias("_score"),
        required_outcome(F.col(label), label).alias("_y"),
        (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"),
    )


def _counts(rows: DataFrame, key: str) -> DataFrame:
    """Positives ``_p`` and negatives ``_n`` of each group and key."""
    return rows.groupBy("_by", key).agg(
        F.expr("sum(_w * _y) AS _p"), F.expr("sum(_w * (1 - _y)) AS _n")
    )


def _bucketed(frame: DataFrame, bounds: list[float]) -> DataFrame:
    """Add the ``_bucket`` of each ``_score``: a binary search over the bounds."""
    cut = Bucketizer(
        splits=[-np.inf, *bounds, np.inf], inputCol="_score", outputCol="_cut"
    ).transform(frame)
    # Never NULL, and declared so: a join on it then needs no filter of its own.
    return cut.selectExpr(*frame.columns, "coalesce(CAST(_cut AS INT), -1) AS _bucket")


def _by_columns(by: Sequence[str]) -> list[str]:
    return [f"_by.{quoted(name)} AS {quoted(name)}" for name in by]


def roc_auc(
    df: DataFrame,
    label: str,
    score: str,
    by: str | Sequence[str] = (),
    *,
    name: str = "auc",
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact area under the ROC curve, ties counting half: one row per ``by`` group.

    NULL where a group has one outcome only. The scores are read two or three
    times, so persist a frame whose scores are costly. ``weight`` names a column of
    counts, for rows that stand for several.
    """
    by = [by] if isinstance(by, str) else list(by)
    scored = _scored(df, label, score, by, weight)
    bounds = score_bounds(scored.select("_score"), rows_per_bucket)
    buckets = (
        _bucketed(_counts(scored, "_score"), bounds)
        # Twice the wins of one positive: it beats every negative below it and ties
        # with those on its own score.
        .selectExpr(
            "_by",
            "_bucket",
            "_p",
            "_n",
            "2 * sum(_n) OVER (PARTITION BY _by, _bucket ORDER BY _score"
            " ROWS UNBOUNDED PRECEDING) - _n AS _wins",
        )
        .groupBy("_by", "_bucket")
        .agg(
            F.expr(f"sum(_p * shiftright(_wins, {LOW_BITS})) AS _high"),
            F.expr(f"sum(_p * (_wins & {(1 << LOW_BITS) - 1})) AS _low"),
            F.expr("sum(_p) AS _p"),
            F.expr("sum(_n) AS _n"),
        )
    )
    # From here on at most MAX_BUCKETS rows per group. Positives also beat all
    # negatives of the buckets below.
    below = (
        "coalesce(sum(_n) OVER (PARTITION BY _by ORDER BY _bucket"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    won = (
        f"CAST(_high AS {COUNT}) * CAST({1 << LOW_BITS} AS {COUNT}) + CAST(_low AS {COUNT})"
        f" + CAST(2 * _p AS {COUNT}) * CAST({below} AS {COUNT})"
    )
    pairs = f"CAST(sum(_p) AS {COUNT}) * CAST(sum(_n) AS {COUNT})"
    auc = f"try_divide(CAST(sum(_won) AS DOUBLE), CAST(2 * CAST({pairs} AS {PRODUCT}) AS DOUBLE))"
    return (
        buckets.selectExpr("_by", "_p", "_n", f"CAST({won} AS {PRODUCT}) AS _won")
        .groupBy("_by")
        .agg(
            F.expr("sum(_p) AS positives"),
            F.expr("sum(_n) AS negatives"),
            F.expr(f"{auc} AS {quoted(name)}"),
        )
        .selectExpr(*_by_columns(by), "positives", "negatives", quoted(name))
    )


def roc_points(
    df: DataFrame,
    label: str,
    score: str,
    by: str | Sequence[str] = (),
    *,
    origin: bool = False,
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The ROC curve as a table: for each distinct score as threshold, the true and
    false positives at or above it and their rates.

    ``origin`` adds the point (0, 0) under an infinite threshold.
    """
    by = [by] if isinstance(by, str) else list(by)
    scored = _scored(df, label, score, by, weight)
    bounds = score_bounds(scored.select("_score"), rows_per_bucket)
    above = (
        "OVER (PARTITION BY _by ORDER BY _bucket DESC"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    totals = _counts(_bucketed(scored, bounds), "_bucket").selectExpr(
        "_by",
        "_bucket",
        f"coalesce(sum(_p) {above}, 0) AS _tp0",
        f"coalesce(sum(_n) {above}, 0) AS _fp0",
        "sum(_p) OVER (PARTITION BY _by) AS _pos",
        "sum(_n) OVER (PARTITION BY _by) AS _neg",
    )
    higher = "OVER (PARTITION BY _by, _bucket ORDER BY _score DESC ROWS UNBOUNDED PRECEDING)"
    points = (
        _bucketed(_counts(scored, "_score"), bounds)
        .selectExpr(
            "_by", "_bucket", "_score", f"sum(_p) {higher} AS _tp", f"sum(_n) {higher} AS _fp"
        )
        # The window left the counts partitioned by these keys; only the totals move.
        .join(totals if by else F.broadcast(totals), ["_by", "_bucket"])
        .selectExpr(
            "_by", "_score AS threshold", "_tp0 + _tp AS tp", "_fp0 + _fp AS fp", "_pos", "_neg"
        )
    )
    if origin:
        start = totals.groupBy("_by").agg(F.max("_pos").alias("_pos"), F.max("_neg").alias("_neg"))
        points = points.unionByName(
            start.selectExpr(
                "_by", "double('infinity') AS threshold", "0L AS tp", "0L AS fp", "_pos", "_neg"
            )
        )
    return points.selectExpr(
        *_by_columns(by),
        "threshold",
        "tp",
        "fp",
        "try_divide(tp, _pos) AS tpr",
        "try_divide(fp, _neg) AS fpr",
    )


def roc_vertices(
    df: DataFrame,
    label: str,
    score: str,
    by: str | Sequence[str] = (),
    *,
    most: int | None = None,
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``roc_points`` with the origin and without points on the straight line between
    their neighbours: the corners of the curve, which has the same area.

    Whether a point is a corner follows from the counts of its own score and of the next
    lower one, in whole numbers; at the end of a bucket that is the first of the next,
    which comes with the bucket's totals. So a chart reads few rows of any table.

    With ``most`` (3 or more), each group has so many rows at most, whatever the scores:
    the curve is cut into ``m = (most - 1) // 2`` cells of equal ``tpr + fpr``, and the
    first and last corner of each stay. The area then differs by ``1 / (2 * m)`` at most.
    Groups of one outcome have NULL rates, and their two ends then.
    """
    if most is not None and most < 3:
        raise ValueError("a curve wants 3 points or more")
    by = [by] if isinstance(by, str) else list(by)
    scored = _scored(df, label, score, by, weight)
    bounds = score_bounds(scored.select("_score"), rows_per_bucket)
    steps = _bucketed(_counts(scored, "_score").where("_p + _n > 0"), bounds)
    buckets = "OVER (PARTITION BY _by ORDER BY _bucket DESC {})"
    above = buckets.format("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    totals = (
        steps.groupBy("_by", "_bucket")
        .agg(F.expr("sum(_p) AS _bp"), F.expr("sum(_n) AS _bn"), F.expr("max(struct(_score, _p, _n)) AS _first"))
        .selectExpr(
            "_by",
            "_bucket",
            f"coalesce(sum(_bp) {above}, 0) AS _tp0",
            f"coalesce(sum(_bn) {above}, 0) AS _fp0",
            "sum(_bp) OVER (PARTITION BY _by) AS _pos",
            "sum(_bn) OVER (PARTITION BY _by) AS _neg",
            f"lead(_first) {buckets.format('')} AS _after",
        )
    )
    scores = "OVER (PARTITION BY _by, _bucket ORDER BY _score DESC {})"
    higher = scores.format("ROWS UNBOUNDED PRECEDING")
    corners = (
        steps.selectExpr(
            "_by", "_bucket", "_score", "_p", "_n", f"sum(_p) {higher} AS _tp", f"sum(_n) {higher} AS _fp",
            f"lead(_p) {scores.format('')} AS _next_p", f"lead(_n) {scores.format('')} AS _next_n",
        )
        .join(totals if by else F.broadcast(totals), ["_by", "_bucket"])
        .withColumns({"_next_p": F.expr("coalesce(_next_p, _after._p)"), "_next_n": F.expr("coalesce(_next_n, _after._n)")})
        .where(
            "_next_p IS NULL OR CAST(_p AS {0}) * CAST(_next_n AS {0}) <> CAST(_next_p AS {0}) * CAST(_n AS {0})"
            .format(COUNT)
        )
        .selectExpr("_by", "_score AS threshold", "_tp0 + _tp AS tp", "_fp0 + _fp AS fp", "_pos", "_neg")
    )
    start = totals.groupBy("_by").agg(F.max("_pos").alias("_pos"), F.max("_neg").alias("_neg"))
    corners = corners.unionByName(
        start.selectExpr("_by", "double('infinity') AS threshold", "0L AS tp", "0L AS fp", "_pos", "_neg")
    )
    if most is not None:
        cell = f"CAST(floor((try_divide(tp, _pos) + try_divide(fp, _neg)) * {(most - 1) // 2} / 2) AS LONG)"
        ends = corners.withColumn("_at", F.expr("struct(tp + fp AS at, threshold, tp, fp, _pos, _neg)"))
        ends = ends.groupBy("_by", F.expr(cell).alias("_cell")).agg(F.expr("array(min(_at), max(_at)) AS _ends"))
        corners = ends.selectExpr("_by", "explode(array_distinct(_ends)) AS _at").selectExpr("_by", "_at.*")
    return corners.selectExpr(
        *_by_columns(by), "threshold", "tp", "fp", "try_divide(tp, _pos) AS tpr", "try_divide(fp, _neg) AS fpr"
    )


def explained_variance(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: str | Sequence[str] = (),
    *,
    name: str = "explained_variance",
) -> DataFrame:
    """1 - Var(actual - predicted) / Var(actual). Where the actual values do not
    vary it is 1 for a constant error and 0 otherwise."""
    by = [by] if isinstance(by, str) else list(by)
    rows = df.select(
        *by,
        required_number(F.col(actual), actual).alias("_y"),
        required_number(F.col(predicted), predicted).alias("_e"),
    ).withColumn("_e", F.col("_y") - F.col("_e"))
    moments = rows.groupBy(*by).agg(F.var_pop("_e").alias("_ve"), F.var_pop("_y").alias("_vy"))
    flat = F.when(F.col("_ve") == 0, F.lit(1.0)).when(F.col("_ve").isNotNull(), F.lit(0.0))
    value = F.when(F.col("_vy") > 0, 1 - F.col("_ve") / F.col("_vy")).otherwise(flat)
    return moments.select(*by, value.alias(name))


def compare_with_baseline(metrics: DataFrame, baseline: float, name: str = "auc") -> DataFrame:
    """Put a baseline beside each metric, and how far the metric lies above it."""
    base = F.lit(float(baseline))
    return metrics.withColumn(f"baseline_{name}", base).withColumn("lift", F.col(name) - base)


class RocAuc(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """The exact AUC of a model's probabilities. Rows of one outcome have none: NaN."""

    label = Param(Params._dummy(), "label", "outcome column", TypeConverters.toString)
    probability = Param(Params._dummy(), "probability", "vector column", TypeConverters.toString)

    def __init__(self, label: str = "label", probability: str = "probability"):
        super().__init__()
        self._setDefault(label="label", probability="probability")
        self._set(label=label, probability=probability)

    def _evaluate(self, dataset: DataFrame) -> float:
        score = vector_to_array(self.getOrDefault(self.probability))[1].alias("_probability")
        scored = dataset.select(F.col(self.getOrDefault(self.label)).alias("_label"), score)
        found = roc_auc(scored, "_label", "_probability").first()
        return found["auc"] if found and found["auc"] is not None else float("nan")

    def isLargerBetter(self) -> bool:
        return True
