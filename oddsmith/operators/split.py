"""Train, validation and test splits, as one ``split`` column on one frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.functions import hash_bound, key_hash
from oddsmith.operators.cutoffs import (
    HASH,
    STRATUM,
    attach_cutoffs,
    count_strata,
    shared_out,
    with_stratum,
)

When = date | datetime | str


@dataclass(frozen=True)
class DateWindows:
    """Four dates of an experiment, from an anchor date backwards."""

    start: date
    val_start: date
    test_start: date
    end: date


def anchor_windows(
    anchor: date | str,
    start_days: int = 180,
    val_days: int = 60,
    test_days: int = 30,
    end_days: int = 1,
) -> DateWindows:
    if isinstance(anchor, str):
        anchor = date.fromisoformat(anchor)
    days = (start_days, val_days, test_days, end_days)
    return DateWindows(*(anchor - timedelta(days=n) for n in days))


def _moment(value: When) -> datetime:
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    return value if isinstance(value, datetime) else datetime.combine(value, time())


def _bound(df: DataFrame, column: str, moment: datetime) -> Column:
    """A literal of the date column's own type, so that comparisons reach the scan."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        # A day lies before a moment if it lies before the next midnight.
        if moment.time() != time():
            moment = datetime.combine(moment.date() + timedelta(days=1), time())
        return F.lit(moment.date().isoformat()).cast("date")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.lit(moment.isoformat(sep=" ")).cast(kind)
    raise TypeError(f"{column} is {kind.simpleString()}, not a date or timestamp")


@dataclass(frozen=True)
class DateSplit:
    """Train before ``val_start``, test from ``test_start`` on, validation between.

    Train has no lower and test no upper bound unless ``start`` (first moment) or
    ``end`` (last day) is given. Rows without a date are in no split.
    """

    column: str
    val_start: When
    test_start: When
    start: When | None = None
    end: When | None = None
    split: str = "split"

    def __post_init__(self) -> None:
        edges = [self.start, self.val_start, self.test_start, self.end]
        moments = [_moment(edge) for edge in edges if edge is not None]
        if moments != sorted(moments):
            raise ValueError("split dates must not decrease: a row would be in two splits")

    def conditions(self, df: DataFrame) -> dict[str, Column]:
        """The date condition of each split."""
        when = F.col(self.column)
        val, test = (_bound(df, self.column, _moment(d)) for d in (self.val_start, self.test_start))
        train_rows, test_rows = when < val, when >= test
        if self.start is not None:
            train_rows = train_rows & (when >= _bound(df, self.column, _moment(self.start)))
        if self.end is not None:
            after = datetime.combine(_moment(self.end).date() + timedelta(days=1), time())
            test_rows = test_rows & (when < _bound(df, self.column, after))
        return {"train": train_rows, "val": (when >= val) & (when < test), "test": test_rows}

    def apply(self, df: DataFrame, *splits: str) -> DataFrame:
        """Label the rows of the named splits (of all three by default).

        The filter is on the date column itself, so it prunes partitions and row
        groups; a filter on the label would not.
        """
        conditions = self.conditions(df)
        if splits:
            conditions = {name: conditions[name] for name in splits}
        label = F.lit(None).cast("string")
        for name, condition in conditions.items():
            label = F.when(condition, F.lit(name)).otherwise(label)
        return df.filter(reduce(Column.__or__, conditions.values())).withColumn(self.split, label)


def split_by_dates(
    df: DataFrame, column: str, val_start: When, test_start: When, **options
) -> DataFrame:
    return DateSplit(column, val_start, test_start, **options).apply(df)


def split_random(
    df: DataFrame,
    keys: str | Sequence[str],
    test_size: float = 0.25,
    seed: int = 42,
    *,
    stratify: str | Sequence[str] = (),
    exact: bool | None = None,
    split: str = "split",
) -> DataFrame:
    """A repeatable random train/test split by a hash of the row key.

    By default a row is a test row if its hash lies below ``test_size`` of the
    hash range: no shuffle, no second pass, streaming too, and the test share is
    ``test_size`` up to chance. ``exact`` (always on with ``stratify``) first
    finds, for each stratum, the hash that cuts off exactly the wanted rows; the
    table itself is still not shuffled. Rows that share a key share a side.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size is a share between 0 and 1")
    keys = [keys] if isinstance(keys, str) else list(keys)
    stratify = [stratify] if isinstance(stratify, str) else list(stratify)
    if stratify and exact is False:
        raise ValueError("a stratified split is exact")
    hashed = df.withColumn(HASH, key_hash(keys, seed))
    if stratify or exact:
        hashed = with_stratum(hashed, stratify)
        strata = count_strata(hashed)
        labelled = attach_cutoffs(hashed, shared_out(strata, stratify, test_size), strata)
        is_test = F.col(HASH) <= F.get("_cuts", F.lit(0))
        labelled = labelled.withColumn(split, F.when(is_test, "test").otherwise("train"))
        return labelled.select(*df.columns, split)
    is_test = F.col(HASH) < hash_bound(test_size)
    return hashed.withColumn(split, F.when(is_test, "test").otherwise("train")).drop(HASH)


def assign_folds(
    df: DataFrame,
    keys: str | Sequence[str],
    folds: int = 4,
    seed: int = 42,
    *,
    stratify: str | Sequence[str] = (),
    fold: str = "fold",
) -> DataFrame:
    """Number rows 0 .. folds-1 by key hash, for cross-validation.

    With ``stratify`` each fold holds the same number of rows of each stratum, give
    or take one; without, folds are equal up to chance and cost nothing to find.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    stratify = [stratify] if isinstance(stratify, str) else list(stratify)
    hashed = df.withColumn(HASH, key_hash(keys, f"fold-{seed}"))
    if stratify and folds > 1:
        hashed = with_stratum(hashed, stratify)
        strata = count_strata(hashed)
        edges = f"transform(sequence(1, {folds - 1}), i -> named_struct('_at', i, '_rank', _rows * i DIV {folds}))"
        hashed = attach_cutoffs(hashed, strata.selectExpr(STRATUM, f"inline({edges})"), strata)
        number = F.size(F.filter("_cuts", lambda edge: edge < F.col(HASH)))
    else:
        passed = [F.col(HASH) >= hash_bound(i / folds) for i in range(1, folds)]
        number = sum((condition.cast("int") for condition in passed), F.lit(0))
    return hashed.withColumn(fold, number.cast("int")).select(*df.columns, fold)
