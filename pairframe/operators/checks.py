"""Validation of frames, feature sets and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from pairframe.featureset import ENTITY, FeatureSet
from pairframe.operators.ranking import Key, rank_rows


def check_same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Same column names in the same order."""
    return a.columns == b.columns


def key_mismatches(a: DataFrame, b: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """(key, side) for keys without a partner; with `position`, order counts too."""
    columns = [key] if position is None else [position, key]
    left, right = a.select(*columns), b.select(*columns)
    only_a = left.exceptAll(right).withColumn("side", F.lit("left"))
    only_b = right.exceptAll(left).withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def order_mismatches(
    a: DataFrame,
    b: DataFrame,
    key: str,
    order_a: Key | Sequence[Key],
    order_b: Key | Sequence[Key] | None = None,
    ids: Sequence[Key] | None = None,
) -> DataFrame:
    """(position, left_key, right_key) where two tables, each in its stated order, differ.

    Exact positions come from ranges of the order, without a sort in one task, and the tables
    meet by position. A longer table has positions without a partner. `ids` identify a row
    where equal values of the order leave a choice; by default the key does.
    """
    sides = []
    for df, order, name in ((a, order_a, "left_key"), (b, order_a if order_b is None else order_b, "right_key")):
        ranked = rank_rows(df, list(ids or [key]), order_by=order, name="position")
        sides.append(ranked.select("position", F.col(key).alias(name), F.lit(True).alias(f"_{name}")))
    left, right = sides
    both = left.join(right, "position", "full")
    same = F.col("left_key").eqNullSafe(F.col("right_key")) & F.col("_left_key").eqNullSafe(F.col("_right_key"))
    return both.filter(~same).select("position", "left_key", "right_key")


def check_same_keys(a: DataFrame, b: DataFrame, key: str, position: str | None = None) -> bool:
    """Same key values (and positions) in both frames; runs a job."""
    return key_mismatches(a, b, key, position).isEmpty()


def check_feature_sets(cells: Mapping | None, drugs: Mapping | None, owner: str = "frame") -> None:
    """Both kinds of feature sets must be present and non-empty."""
    for label, sets in (("cell", cells), ("drug", drugs)):
        if sets is None:
            raise ValueError(f"{owner} has no {label} feature sets")
        if not sets:
            raise ValueError(f"{owner} has an empty set of {label} features")


def check_kind(features: FeatureSet, *kinds: str) -> None:
    """A transform applies only to the kinds of feature set it supports."""
    if features.kind not in kinds:
        raise TypeError(f"expected a {' or '.join(kinds)} feature set, got {features.kind}")


def unknown_keys(df: DataFrame, key: str, table: DataFrame, table_key: str = ENTITY) -> DataFrame:
    """Distinct non-null keys of `df` that have no row in `table`."""
    known = table.select(F.col(table_key).alias(key))
    return df.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def require_known(df: DataFrame, key: str, table: DataFrame, table_key: str = ENTITY) -> None:
    """Fail now, naming one unknown key."""
    row = unknown_keys(df, key, table, table_key).first()
    if row is not None:
        raise KeyError(row[0])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, count) for keys that occur more than once."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def require_unique(df: DataFrame, *keys: str) -> None:
    """Fail now, naming one repeated key."""
    row = duplicate_keys(df, *keys).first()
    if row is not None:
        raise ValueError(f"repeated key: {row.asDict()}")
