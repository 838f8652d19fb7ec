"""Feature encoding: branches of columns, fitted on train rows in one pass.

Fitting yields a plain ``PipelineModel`` of ``SQLTransformer`` stages and a
``VectorAssembler``. It is saved with the classifier, runs on batch and streaming
frames, and holds built-in expressions only.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import (
    code_of,
    flag_positive,
    flag_true,
    impute,
    keep_listed,
    literal,
    nan_to_null,
    quoted,
)

PREFIX = "x_"


@dataclass(frozen=True)
class MeanImpute:
    """Numbers; missing ones become the mean of the train rows. A column with no
    number in the train rows yields no feature."""

    columns: Sequence[str]


@dataclass(frozen=True)
class PositiveFlag:
    """Numbers as 0/1 flags: above zero or not. Missing counts as zero."""

    columns: Sequence[str]


@dataclass(frozen=True)
class TrueFlag:
    """Booleans as 0/1 flags. Missing counts as false."""

    columns: Sequence[str]


@dataclass(frozen=True)
class KeepList:
    """A category: listed values stay, all else is ``other``. One-hot."""

    column: str
    keep: Sequence[str]
    other: str = "other"

    def encoded(self) -> str:
        return keep_listed(quoted(self.column), self.keep, self.other)

    def values(self) -> list:
        return sorted({*self.keep, self.other})


@dataclass(frozen=True)
class CodeMap:
    """A category: listed values become codes, all else ``default``. One-hot."""

    column: str
    codes: Mapping[str, int]
    default: int

    def encoded(self) -> str:
        return code_of(quoted(self.column), self.codes, self.default)

    def values(self) -> list:
        return sorted({*self.codes.values(), self.default})


@dataclass(frozen=True)
class Categories:
    """A category as it is, missing being a value too. One-hot: a named column for each
    value, at most ``limit`` of them (more raise). ``wide`` is for categories of very many
    values: they are numbered, and encoded as one sparse vector, without columns of their
    own and without a limit."""

    column: str
    limit: int | None = 1_000
    wide: bool = False

    def encoded(self) -> str:
        return quoted(self.column)

    def values(self) -> None:
        return None


Branch = MeanImpute | PositiveFlag | TrueFlag | KeepList | CodeMap | Categories
_NUMERIC = (MeanImpute, PositiveFlag, TrueFlag)


def input_columns(branches: Iterable[Branch]) -> list[str]:
    names: list[str] = []
    for branch in branches:
        names.extend(branch.columns if isinstance(branch, _NUMERIC) else [branch.column])
    return list(dict.fromkeys(names))


class FeatureEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Encode branches into named columns and one vector, in the order given.

    Named columns get ``prefix``. One-hot columns follow the sorted values seen in
    the train rows; of exactly two the first is dropped. A value not seen there
    fails the query, or with ``handle_unknown="ignore"`` gets all zeros. Columns in
    no branch are left out of the vector.
    """

    spec = Param(Params._dummy(), "spec", "branches and options as JSON", TypeConverters.toString)

    def __init__(
        self,
        branches: Sequence[Branch] = (),
        *,
        output: str = "features",
        prefix: str = PREFIX,
        handle_unknown: str = "error",
    ):
        super().__init__()
        if handle_unknown not in ("error", "ignore"):
            raise ValueError("handle_unknown is 'error' or 'ignore'")
        told = {
            "branches": [{"kind": type(branch).__name__, **vars(branch)} for branch in branches],
            "output": output,
            "prefix": prefix,
            "handle_unknown": handle_unknown,
        }
        # The one place where the encoder keeps what it is, so that it can be saved.
        self._set(spec=json.dumps(told))

    def _told(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))

    @property
    def branches(self) -> list[Branch]:
        kinds = {kind.__name__: kind for kind in (*_NUMERIC, KeepList, CodeMap, Categories)}
        return [kinds[told.pop("kind")](**told) for told in self._told()["branches"]]

    @property
    def output(self) -> str:
        return self._told()["output"]

    @property
    def prefix(self) -> str:
        return self._told()["prefix"]

    @property
    def handle_unknown(self) -> str:
        return self._told()["handle_unknown"]

    @property
    def inputs(self) -> list[str]:
        return input_columns(self.branches)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return self._built(dataset, *self._learned([self._statistics(dataset)]))

    def fit_without(self, dataset: DataFrame, fold: str, folds: int) -> list[PipelineModel]:
        """The encoder fitted without each fold in turn: what fits to the other folds' rows
        would be. Sums and seen values are gathered by fold in the passes of one fit, and
        each encoder puts those of the other folds together.

        ``fold`` numbers the folds from 0; rows without a number belong to every encoder.
        Wide categories are numbered by Spark's own indexer, in a fit for each fold.
        """
        of_fold = self._statistics(dataset, fold)
        rows = dataset.drop(fold)
        found = []
        for out in range(folds):
            others = [told for number, told in of_fold.items() if number != out]
            wide = dataset.where(~F.col(fold).eqNullSafe(out)).drop(fold)
            found.append(self._built(rows, *self._learned(others), wide))
        return found

    def _built(self, dataset: DataFrame, means: dict, seen: dict, wide: DataFrame | None = None) -> PipelineModel:
        base: list[str] = []
        flags: list[str] = []
        features: list[str] = []
        numbered: list[Model] = []

        def add(expressions: list[str], expression: str, label: str) -> None:
            name = self.prefix + re.sub(r"[.`]", "_", label)
            if name in features or name in dataset.columns:
                raise ValueError(f"feature name {name} is taken")
            expressions.append(f"{expression} AS {quoted(name)}")
            features.append(name)

        for at, branch in enumerate(self.branches):
            if isinstance(branch, MeanImpute):
                for column in branch.columns:
                    if means[column] is not None:
                        add(base, impute(quoted(column), means[column]), column)
            elif isinstance(branch, PositiveFlag):
                for column in branch.columns:
                    add(base, flag_positive(quoted(column)), column)
            elif isinstance(branch, TrueFlag):
                for column in branch.columns:
                    add(base, flag_true(quoted(column)), column)
            elif isinstance(branch, Categories) and branch.wide:
                category = f"_category_{at}"
                base.append(f"{_told(branch)} AS {category}")
                numbered += self._wide(dataset if wide is None else wide, branch, category)
                features.append(f"{category}_hot")
            else:
                category = f"_category_{at}"
                base.append(f"{self._checked(branch, seen[at])} AS {category}")
                shown = seen[at][1:] if len(seen[at]) == 2 else seen[at]
                for value in shown:
                    flag = f"CAST({category} <=> {literal(value)} AS INT)"
                    add(flags, flag, f"{branch.column}_{value}")
        if not features:
            raise ValueError("no feature is left to assemble")
        stages = [
            SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")
            for expressions in (base, flags)
            if expressions
        ]
        stages += numbered
        stages.append(VectorAssembler(inputCols=features, outputCol=self.output))
        return PipelineModel(stages)

    def _statistics(self, dataset: DataFrame, fold: str | None = None) -> dict:
        """Sums and counts of numbers, and which values occur: one aggregation over the
        train rows, as narrow as the branches. Values of a bare category take a pass each.
        With ``fold`` a record of each fold, by its number; otherwise one record."""
        wanted = {}
        for at, branch in enumerate(self.branches):
            if isinstance(branch, MeanImpute):
                for i, column in enumerate(branch.columns):
                    number = nan_to_null(quoted(column))
                    wanted[f"m{at}_{i}"] = F.expr(f"struct(sum(CAST({number} AS DOUBLE)) AS sum, count({number}) AS n)")
            elif isinstance(branch, (KeepList, CodeMap)):
                for i, value in enumerate(branch.values()):
                    is_seen = f"bool_or({branch.encoded()} = {literal(value)})"
                    wanted[f"v{at}_{i}"] = F.expr(is_seen)
        by = [] if fold is None else [fold]
        told = [e.alias(k) for k, e in wanted.items()] or [F.lit(True).alias("_none")]
        found = {row[fold] if fold else None: row.asDict() for row in dataset.groupBy(*by).agg(*told).collect()}
        for at, branch in enumerate(self.branches):
            if isinstance(branch, Categories) and not branch.wide:
                for number, values in _distinct_values(dataset, branch, fold).items():
                    found[number][f"c{at}"] = values
        return found if fold else found[None]

    def _learned(self, records: Sequence[dict]) -> tuple[dict, dict]:
        """Means and seen values of some folds together."""
        means, seen = {}, {}
        for at, branch in enumerate(self.branches):
            if isinstance(branch, MeanImpute):
                for i, column in enumerate(branch.columns):
                    parts = [r[f"m{at}_{i}"] for r in records]
                    n = sum(part["n"] for part in parts)
                    means[column] = math.fsum(part["sum"] or 0.0 for part in parts) / n if n else None
            elif isinstance(branch, (KeepList, CodeMap)):
                seen[at] = [v for i, v in enumerate(branch.values()) if any(r[f"v{at}_{i}"] for r in records)]
            elif not isinstance(branch, _NUMERIC) and not branch.wide:
                values = set().union(*[r.get(f"c{at}", ()) for r in records])
                seen[at] = sorted(v for v in values if v is not None) + [None] * (None in values)
        return means, seen

    def _wide(self, dataset: DataFrame, branch: Categories, category: str) -> list[Model]:
        """Numbers of the sorted values, and a vector with a one at a value's number."""
        told = dataset.selectExpr(f"{_told(branch)} AS {category}")
        keep = self.handle_unknown == "ignore"
        index = StringIndexer(
            inputCol=category, outputCol=f"{category}_at", stringOrderType="alphabetAsc",
            handleInvalid="keep" if keep else "error",
        ).fit(told)
        hot = OneHotEncoder(inputCol=f"{category}_at", outputCol=f"{category}_hot", dropLast=keep)
        return [index, hot.fit(index.transform(told))]

    def _checked(self, branch: Branch, seen: Sequence) -> str:
        if self.handle_unknown == "ignore":
            return branch.encoded()
        values = ", ".join(literal(value) for value in seen if value is not None)
        tests = [f"({branch.encoded()}) IN ({values})"] if values else []
        tests += [f"({branch.encoded()}) IS NULL"] if None in seen else []
        message = literal(f"{branch.column} holds a value not seen in the train rows: ")
        shown = f"coalesce(CAST({branch.encoded()} AS STRING), 'NULL')"
        return (
            f"CASE WHEN {' OR '.join(tests) or 'FALSE'} THEN {branch.encoded()} "
            f"ELSE raise_error(concat({message}, {shown})) END"
        )


def _told(branch: Categories) -> str:
    """A category as text: a dash if it is missing, else its text behind a mark."""
    return f"coalesce(concat('=', CAST({quoted(branch.column)} AS STRING)), '-')"


def _distinct_values(dataset: DataFrame, branch: Categories, fold: str | None) -> dict[int | None, set]:
    """The values of each fold; of all folds together at most ``limit``, else it raises."""
    distinct = dataset.select(branch.column).distinct()
    if branch.limit is not None and distinct.limit(branch.limit + 1).count() > branch.limit:
        raise ValueError(f"{branch.column} has more than {branch.limit} values")
    found: dict[int | None, set] = {}
    for value, *number in dataset.select(branch.column, *([fold] if fold else [])).distinct().collect():
        found.setdefault(number[0] if number else None, set()).add(value)
    return found


def feature_names(model: PipelineModel, prefix: str = PREFIX) -> list[str]:
    """The features of a fitted encoder, or of a pipeline holding one, in vector order."""
    values = {
        stage.getOutputCol(): stage.labels for stage in model.stages if isinstance(stage, StringIndexerModel)
    }
    for stage in reversed(model.stages):
        if isinstance(stage, VectorAssembler):
            names: list[str] = []
            for name in stage.getInputCols():
                labels = values.get(name.removesuffix("_hot") + "_at")
                if labels is None:
                    names.append(name.removeprefix(prefix))
                else:
                    at = name.removesuffix("_hot")
                    names += [f"{at}_{label[1:] if label != '-' else None}" for label in labels]
            return names
        if isinstance(stage, PipelineModel):
            return feature_names(stage, prefix)
    raise ValueError("the pipeline assembles no features")
