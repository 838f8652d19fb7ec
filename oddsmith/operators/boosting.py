"""Boosted trees by second-order steps, many fits in the same passes.

Every split is found from sums of gradients and hessians over bins of the features. Rows
that fall into the same bins are alike for good: they get the same score from every tree.
So the table is first counted per combination of bins (a *cell*), once; a cell has its
rows, its positives and, for each fit, the margin that the trees so far give it. A level
of a tree is one aggregation of the cells, by fit, node, feature and bin, and the fits of
a whole parameter grid and of all its folds share it: a search over 64 sets and 4 folds
takes as many jobs as its deepest fit alone.

The first n trees of a fit are the fit of n trees, so tree counts cost nothing: margins
are read off on the way.

Sums are whole numbers (of 2**-30), so they do not depend on the order of rows or tasks,
and the same rows give the same trees wherever they lie.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import required_outcome
from oddsmith.session import kept

UNIT = 1 << 30
#: Gains below this are none.
LEAST_GAIN = 1e-6
#: A cut that no bin reaches: all rows go left.
NOWHERE = (1 << 31) - 1
#: Numbers of one level's histograms that the driver takes at once, about.
HISTOGRAM = 1 << 22
ACCURACY = 10_000
#: Cells, once for each fit, that one task holds.
CELLS_PER_TASK = 1 << 17


@dataclass(frozen=True)
class FitOptions:
    """What one fit is to be: of the sums, a child has at least ``child_weight`` of the
    hessian; ``penalty`` weighs on squared leaf values, ``split_cost`` on each split."""

    depth: int = 3
    rate: float = 0.05
    penalty: float = 1.0
    split_cost: float = 0.0
    child_weight: float = 1.0


@dataclass
class Tree:
    """A full binary tree: the nodes of each level lie behind one another. Rows whose bin
    is at or above the cut go right; missing ones where ``missing`` (0 left, 1 right) says."""

    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    missing: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    leaf: np.ndarray | None = None


# --- bins


def feature_cuts(rows: DataFrame, values: str, max_bins: int) -> list[list[float]]:
    """Of each entry of the array ``values`` its quantiles, at most ``max_bins`` - 1, by
    one pass of a sketch. Equal ones merge, so an entry of few values has them all if each
    holds a share of 1 / ``max_bins`` of the rows."""
    shares = [i / max_bins for i in range(1, max_bins)]
    each = rows.select(F.posexplode(values).alias("at", "value")).where("value IS NOT NULL AND NOT isnan(value)")
    found = each.groupBy("at").agg(F.percentile_approx("value", shares, ACCURACY).alias("cuts"), F.max("value").alias("top"))
    width = rows.agg(F.max(F.size(values))).first()[0] or 0
    cuts: list[list[float]] = [[] for _ in range(width)]
    for row in found.collect():
        # The largest value is a cut too: its rows against all others.
        cuts[row["at"]] = sorted({float(cut) + 0.0 for cut in [*row["cuts"], row["top"]]})
    return cuts


def binned(rows: DataFrame, values: str, cuts: Sequence[Sequence[float]], output: str) -> DataFrame:
    """Add the array ``output``: for each entry how many cuts lie at or below it, -1 if it
    is missing. A binary search for each entry."""
    columns = [f"_value_{i}" for i in range(len(cuts))]
    spread = rows.select("*", *[F.col(values)[i].alias(name) for i, name in enumerate(columns)])
    some = [i for i, own in enumerate(cuts) if own]
    if some:
        spread = Bucketizer(
            splitsArray=[[-np.inf, *cuts[i], np.inf] for i in some],
            inputCols=[columns[i] for i in some],
            outputCols=[f"_bin_{i}" for i in some],
            handleInvalid="keep",
        ).transform(spread)
    bins = [
        F.when(F.isnan(name), -1).otherwise(F.col(f"_bin_{i}").cast("int") if cuts[i] else F.lit(0))
        for i, name in enumerate(columns)
    ]
    return spread.select(*rows.columns, F.array(*bins).cast("array<int>").alias(output))


# --- growing


@contextmanager
def apart(cells: DataFrame, fits: int, levels: int) -> Iterator[DataFrame]:
    """The cells as a table in the checkpoint folder, read by a session of its own.

    Growing is very many small jobs, for which re-planning at run time costs more than the
    jobs; the caller's session keeps its settings. Cells and histograms lie in
    partitions by their size.
    """
    spark = cells.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("boosted trees cut their lineage by checkpoints: set spark.checkpoint.dir to a folder that all machines share")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cells-{uuid.uuid4().hex}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        with kept(cells) as counted:
            size = counted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("bins")), F.lit(0))).first()
            tasks = -(-max(size[0] * fits, 1) // CELLS_PER_TASK)
            counted.repartition(tasks).write.parquet(place.toString())
        own = spark.newSession()
        own.conf.set("spark.sql.adaptive.enabled", "false")
        sums = min(size[0], 1 << levels) * size[1] * fits
        own.conf.set("spark.sql.shuffle.partitions", str(-(-max(sums, 1) // CELLS_PER_TASK)))
        found = own.read.schema(cells.schema).parquet(place.toString())
        yield found.coalesce(1) if tasks == 1 else found  # one task's sums need no exchange
    finally:
        files.delete(place, True)


def _numbers(values: np.ndarray, kind: str) -> str:
    """A constant array. As text it is one literal to the planner, however long."""
    return f"from_json('{json.dumps(values.tolist())}', 'array<{kind}>')"


def best_splits(node, feature, bins, g, h, options: Sequence[FitOptions], of_node) -> dict[str, np.ndarray]:
    """The best split of each node from its histogram, one row a node that has any rows.

    ``of_node`` gives the fit of a node. Ties go to the lower feature, then the lower cut,
    then to missing rows on the right.
    """
    order = np.lexsort((bins, feature, node))
    node, feature, bins, g, h = (x[order] for x in (node, feature, bins, g, h))
    if not len(node):
        return {name: g for name in ("gain", "g", "h", "left_g", "left_h")} | {name: node for name in ("node", "feature", "cut", "missing")}
    new = np.append(True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)

    def before(x):  # within the node and feature, lower bins, missing ones apart
        total = np.concatenate([[0.0], np.cumsum(np.where(bins < 0, 0.0, x))])
        return total[:-1] - total[first][group]

    whole_g, whole_h = np.add.reduceat(g, first)[group], np.add.reduceat(h, first)[group]
    missing_g, missing_h = (np.where(bins[first] < 0, x[first], 0.0)[group] for x in (g, h))
    fits = of_node(node)
    penalty, cost, weight = (np.array([getattr(o, name) for o in options])[fits] for name in ("penalty", "split_cost", "child_weight"))
    sides = []
    for left in (0, 1):
        gl, hl = before(g) + left * missing_g, before(h) + left * missing_h
        gr, hr = whole_g - gl, whole_h - hl
        gain = 0.5 * (gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - whole_g * whole_g / (whole_h + penalty)) - cost
        good = (bins >= 0) & (hl >= weight) & (hr >= weight) & (gain > LEAST_GAIN)
        if left:  # without missing rows both sides are one
            good &= missing_h > 0
        sides.append((np.where(good, gain, -1.0), gl, hl))
    gain = np.concatenate([s[0] for s in sides])
    both = [np.concatenate([x, x]) for x in (node, feature, bins)]
    side = np.repeat([1, 0], len(node))  # of missing rows
    order = np.lexsort((1 - side, both[2], both[1], -gain, both[0]))
    at = order[np.append(True, np.diff(both[0][order]) > 0)]
    row = at % len(node)
    return {
        "node": node[row], "feature": both[1][at], "cut": both[2][at], "missing": side[at], "gain": gain[at],
        "g": whole_g[row], "h": whole_h[row], "left_g": np.concatenate([s[1] for s in sides])[at],
        "left_h": np.concatenate([s[2] for s in sides])[at],
    }


def _histogram(state: DataFrame) -> tuple[np.ndarray, ...]:
    """Sums of gradients and hessians of each fit's node, feature and bin."""
    rows = state.where("active").selectExpr("node", "g", "h", "posexplode(bins) AS (feature, bin)")
    sums = rows.groupBy("node", "feature", "bin").agg(F.expr("CAST(sum(g) AS DOUBLE) AS g"), F.expr("CAST(sum(h) AS DOUBLE) AS h"))
    node, feature, bins, g, h = (column.to_numpy() for column in sums.toArrow().columns)
    return node.astype(np.int64), feature.astype(np.int64), bins.astype(np.int64), g / UNIT, h / UNIT


def _at_root(state: DataFrame) -> DataFrame:
    """Every row at the root of its fit's next tree, with its gradient and hessian."""
    p = "(1 / (1 + exp(-margin)))"
    return state.selectExpr(
        "*",
        "CAST(fit AS BIGINT) AS node",
        "true AS active",
        f"CAST(round((n * {p} - p) * {UNIT}D) AS DECIMAL(38,0)) AS g",
        f"CAST(round(n * {p} * (1 - {p}) * {UNIT}D) AS DECIMAL(38,0)) AS h",
    )


def _down(state: DataFrame, split: dict[str, np.ndarray], active: np.ndarray) -> DataFrame:
    """Every row in the child of its node."""
    here = f"bins[{_numbers(split['feature'], 'int')}[node]]"
    right = f"CASE WHEN {here} < 0 THEN {_numbers(split['missing'], 'int')}[node] WHEN {here} >= {_numbers(split['cut'], 'int')}[node] THEN 1 ELSE 0 END"
    others = [name for name in state.columns if name not in ("node", "active")]
    return state.selectExpr(*others, f"2 * node + {right} AS node").selectExpr("*", f"{_numbers(active, 'boolean')}[node] AS active")


def _grown(state: DataFrame, options: Sequence[FitOptions], held: list[DataFrame]) -> tuple[list[Tree], DataFrame]:
    """One tree for each fit, and the state with each row's new margin. The frames kept
    on the way join ``held``."""
    fits, others = len(options), [name for name in state.columns if name != "margin"]
    depth = np.array([o.depth for o in options])
    rate, penalty = (np.array([getattr(o, name) for o in options]) for name in ("rate", "penalty"))
    trees = [Tree() for _ in options]
    leaf = np.zeros(fits)
    active = np.ones(fits, bool)
    level = 0
    state = _at_root(state)
    while active.any():
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        width = fits << level
        found = best_splits(*_histogram(state), options, lambda x: x >> level)
        own = found["node"] >> level
        if level == 0:
            leaf[own] = -rate[own] * found["g"] / (found["h"] + penalty[own])
        good = (found["gain"] > 0) & (depth[own] > level)
        if not good.any():
            break
        at, own = found["node"][good], own[good]
        split = {"feature": np.zeros(width, np.int64), "cut": np.full(width, NOWHERE), "missing": np.zeros(width, np.int64), "gain": np.zeros(width)}
        for name, values in split.items():
            values[at] = found[name][good]
            for i, tree in enumerate(trees):
                getattr(tree, name).append(values[i << level : (i + 1) << level])
        # A node that is not split goes on as its left child, which needs no histogram.
        leaf = np.stack([leaf, np.zeros(width)], axis=1).ravel()
        active = np.zeros(2 * width, bool)
        g, h = ((found[f"left_{x}"][good], (found[x] - found[f"left_{x}"])[good]) for x in "gh")
        for side in (0, 1):
            leaf[2 * at + side] = -rate[own] * g[side] / (h[side] + penalty[own])
            active[2 * at + side] = depth[own] > level + 1
        state = _down(state, split, active)
        level += 1
    for i, tree in enumerate(trees):
        tree.leaf = leaf[i << level : (i + 1) << level]
        while tree.cut and (tree.cut[-1] == NOWHERE).all():  # levels that only others needed
            tree.leaf = tree.leaf[::2]
            for part in (tree.feature, tree.cut, tree.missing, tree.gain):
                part.pop()
    return trees, state.selectExpr(*others, f"margin + {_numbers(leaf, 'double')}[node] AS margin")


def grow(
    state: DataFrame,
    options: Sequence[FitOptions],
    n_trees: int,
    checkpoint_every: int = 2,
    at_stage: Callable[[int, DataFrame], None] | None = None,
) -> list[list[Tree]]:
    """The trees of each fit. ``state`` has ``fit`` (a number), ``bins``, rows ``n``,
    positives ``p`` and ``margin``; other columns stay. ``at_stage`` is called with the
    number of trees so far and the state that they lead to.

    A level's rows are kept for the next one. After every so many trees a checkpoint cuts
    the plan, and what was kept is released.
    """
    trees: list[list[Tree]] = [[] for _ in options]
    now, held = state.select(*[name for name in state.columns if name != "margin"], "margin"), []

    def release() -> None:
        while held:  # the newest first: what it was made from is still there then
            held.pop().unpersist()

    try:
        for number in range(1, n_trees + 1):
            grown, now = _grown(now, options, held)
            for own, tree in zip(trees, grown):
                own.append(tree)
            if number % checkpoint_every == 0:
                now = now.checkpoint()
                release()
            if at_stage is not None:
                at_stage(number, now)
        return trees
    finally:
        release()


# --- estimator and model


class SecondOrderTrees(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for a 0/1 label by second-order steps of the logistic loss.

    A leaf is worth ``-G / (H + regLambda)`` times ``stepSize``, for sums G and H of
    gradients and hessians; a split must gain more than ``splitCost`` and leave a hessian
    of ``minChildWeight`` on both sides. Margins begin at 0, a probability of one half.
    NaN is missing: each split learns on which side such rows go.
    """

    builds_on_itself = True

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a step taken", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "weight on squared leaf values", TypeConverters.toFloat)
    splitCost = Param(Params._dummy(), "splitCost", "gain that a split must exceed", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "trees between checkpoints", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, maxDepth=3, maxIter=100, stepSize=0.05, regLambda=1.0, splitCost=0.0, minChildWeight=1.0,
        maxBins=256, checkpointInterval=2, featuresCol="features", labelCol="label",
    ):
        super().__init__()
        self._setDefault(
            maxDepth=3, maxIter=100, stepSize=0.05, regLambda=1.0, splitCost=0.0, minChildWeight=1.0,
            maxBins=256, checkpointInterval=2, featuresCol="features", labelCol="label",
        )
        self._set(**self._input_kwargs)

    def options(self) -> FitOptions:
        names = (self.maxDepth, self.stepSize, self.regLambda, self.splitCost, self.minChildWeight)
        return FitOptions(*[self.getOrDefault(param) for param in names])

    def prepared(self, dataset: DataFrame, *more: str) -> tuple[DataFrame, list[list[float]]]:
        """``bins`` and ``label`` of each row (and ``more``), and the cuts of the bins."""
        rows = dataset.select(
            *more,
            vector_to_array(self.getFeaturesCol()).alias("_x"),
            required_outcome(F.col(self.getLabelCol()), self.getLabelCol()).cast("long").alias("_y"),
        )
        cuts = feature_cuts(rows, "_x", self.getOrDefault(self.maxBins))
        return binned(rows, "_x", cuts, "bins").select(*more, "bins", F.col("_y").alias("label")), cuts

    def _fit(self, dataset: DataFrame) -> SecondOrderModel:
        rows, cuts = self.prepared(dataset)
        cells = rows.groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        own = self.options()
        with apart(cells, 1, own.depth) as cells:
            state = cells.select(F.lit(0).alias("fit"), "bins", "n", "p", F.lit(0.0).alias("margin"))
            trees = grow(state, [own], self.getOrDefault(self.maxIter), self.getOrDefault(self.checkpointInterval))
        return self.model(trees[0], cuts)

    def model(self, trees: Sequence[Tree], cuts: Sequence[Sequence[float]]) -> SecondOrderModel:
        told = []
        for tree in trees:
            levels = []
            for feature, cut, missing, gain in zip(tree.feature, tree.cut, tree.missing, tree.gain):
                # A bin begins at its cut: bin i holds what has i cuts at or below it.
                levels.append([
                    None if c == NOWHERE else [int(f), cuts[f][c - 1] if c else None, int(m), float(x)]
                    for f, c, m, x in zip(feature.tolist(), cut.tolist(), missing.tolist(), gain.tolist())
                ])
            told.append({"levels": levels, "leaf": tree.leaf.tolist()})
        return self._copyValues(SecondOrderModel(told, len(cuts)))


class SecondOrderModel(Model, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees: adds ``rawPrediction``, ``probability`` and ``prediction``, by built-in
    expressions, so it runs on batch and streaming frames."""

    spec = Param(Params._dummy(), "spec", "trees as JSON", TypeConverters.toString)
    for _param in ("maxDepth", "maxIter", "stepSize", "regLambda", "splitCost", "minChildWeight", "maxBins", "checkpointInterval"):
        locals()[_param] = getattr(SecondOrderTrees, _param)
    del _param

    def __init__(self, trees: Sequence[dict] = (), n_features: int = 0):
        super().__init__()
        self._set(spec=json.dumps({"trees": list(trees), "features": n_features}))

    def _told(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))

    @property
    def trees(self) -> list[dict]:
        return self._told()["trees"]

    def first(self, n_trees: int) -> SecondOrderModel:
        """The model of the first trees: what a fit of so many would have given."""
        told = self._told()
        part = SecondOrderModel(told["trees"][:n_trees], told["features"])
        part = self._copyValues(part, {self.spec: part.getOrDefault(part.spec)})
        return part._set(maxIter=min(n_trees, len(told["trees"])))

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the whole gain."""
        told = self._told()
        total = np.zeros(told["features"])
        for tree in told["trees"]:
            for level in tree["levels"]:
                for split in filter(None, level):
                    total[split[0]] += split[3]
        return DenseVector(total / total.sum() if total.sum() else total)

    def margin(self, values: str) -> Column:
        """The margin of the array ``values``."""
        return F.expr(" + ".join(["0D", *[_as_sql(tree, values) for tree in self.trees]]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        with_values = dataset.withColumn("_values", vector_to_array(self.getFeaturesCol()))
        with_margin = with_values.withColumn("_margin", self.margin("_values")).drop("_values")
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return with_margin.select(
            *dataset.columns,
            array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))).alias("rawPrediction"),
            array_to_vector(F.array(1 - p, p)).alias("probability"),
            (F.col("_margin") > 0).cast("double").alias("prediction"),
        )


def _as_sql(tree: dict, values: str) -> str:
    def node(level: int, at: int) -> str:
        if level == len(tree["levels"]):
            return f"{tree['leaf'][at]!r}D"
        split = tree["levels"][level][at]
        if split is None:
            return node(level + 1, 2 * at)
        feature, cut, missing, _ = split
        x = f"{values}[{feature}]"
        # NaN is above every number.
        right = "TRUE" if cut is None else f"{x} >= {_double(cut)}"
        if not missing:
            right = f"NOT isnan({x})" if cut is None else f"{right} AND NOT isnan({x})"
        return f"CASE WHEN {right} THEN {node(level + 1, 2 * at + 1)} ELSE {node(level + 1, 2 * at)} END"

    return node(0, 0)


def _double(value: float) -> str:
    return f"double('{value!r}')" if np.isinf(value) else f"{value!r}D"


# --- a grid of fits


@dataclass(frozen=True)
class Grid:
    """What the fits of a grid leave: ``aucs`` by estimator, trees and left-out fold, and
    of each estimator the trees and cuts of its fit to all rows."""

    aucs: dict[tuple[int, int, int], float]
    trees: dict[int, list[Tree]]
    cuts: list[list[float]]


def fit_grid(
    rows: DataFrame,
    estimators: Sequence[SecondOrderTrees],
    stages: Sequence[Sequence[int]],
    folds: int,
    auc: Callable[[DataFrame], DataFrame],
) -> Grid:
    """Every estimator on all folds but one, each left out once, and on all.

    ``rows`` has ``fold`` and what the estimators read. Estimator i is judged at each of
    ``stages[i]`` trees, by the rows of the fold that it did not see; all must agree about
    the bins, which come from all rows. Fits share their passes, so many at once that a
    level's histograms stay within about ``HISTOGRAM`` numbers. ``auc`` finds the AUC by
    ``fit`` of rows ``label, score`` that stand for ``weight``.
    """
    binned_rows, cuts = estimators[0].prepared(rows, "fold")
    of_fold = [F.when(F.col("fold") == fold, 1) for fold in range(folds)]
    cells = binned_rows.groupBy("bins").agg(
        F.array(*[F.count(one) for one in of_fold]).alias("rows"),
        F.array(*[F.coalesce(F.sum(one * F.col("label")), F.lit(0)) for one in of_fold]).alias("positives"),
    )
    bins = max(sum(len(own) + 2 for own in cuts), 1)
    deepest = max(e.options().depth for e in estimators)
    order = sorted(range(len(estimators)), key=lambda i: -estimators[i].options().depth)
    sets = folds + 1  # the last one leaves nothing out
    aucs: dict[tuple[int, int, int], float] = {}
    trees: dict[int, list[Tree]] = {}
    with apart(cells, min(len(estimators) * sets, HISTOGRAM // bins + 1), deepest) as cells:
        while order:
            deep = 1 << max(estimators[order[0]].options().depth - 1, 0)
            most = max(1, HISTOGRAM // (bins * min(deep, 1 << 10) * sets))
            part, order = order[:most], order[most:]
            options = [estimators[i].options() for i in part for _ in range(sets)]
            each = cells.selectExpr("*", f"explode(sequence(0, {len(options) - 1})) AS fit")
            for name, short in (("rows", "n"), ("positives", "p")):
                out = f"coalesce(get({name}, fit % {sets}), 0L)"
                each = each.selectExpr("*", f"{out} AS out_{short}", f"aggregate({name}, 0L, (a, b) -> a + b) - {out} AS {short}")
            state = each.selectExpr("fit", "bins", "n", "p", "out_n", "out_p", "0D AS margin")

            def judge(number: int, now: DataFrame) -> None:
                wanted = [at for at, i in enumerate(part) if number in stages[i]]
                if not wanted:
                    return
                judged = now.where(F.expr(f"fit DIV {sets}").isin(wanted)).selectExpr(
                    "fit", "1 / (1 + exp(-margin)) AS score",
                    "inline(array(named_struct('label', 1, 'weight', out_p), named_struct('label', 0, 'weight', out_n - out_p)))",
                )
                for row in auc(judged.where("weight > 0")).collect():
                    if row["auc"] is not None:
                        aucs[part[row["fit"] // sets], number, row["fit"] % sets] = row["auc"]

            every = estimators[0].getOrDefault(estimators[0].checkpointInterval)
            grown = grow(state, options, max(max(stages[i]) for i in part), every, judge)
            trees.update({i: grown[at * sets + folds] for at, i in enumerate(part)})
    return Grid(aucs, trees, cuts)
