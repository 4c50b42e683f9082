"""Choose, filter, describe and standardise feature sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from pairframe.featureset import CONSTANT, ENTITY, LOOKUP, MATRIX, VALUE, FeatureSet
from pairframe.functions.arrays import array_stats, pick_positions
from pairframe.functions.guards import required
from pairframe.functions.numeric import safe_scale
from pairframe.operators.checks import check_kind
from pairframe.operators.scaling import float_kind
from pairframe.operators.selection import keep_members


def select_features(features: FeatureSet, names: Iterable[Any]) -> FeatureSet:
    """Keep `names` in the requested order; absent names are skipped."""
    check_kind(features, MATRIX)
    position = {name: i for i, name in enumerate(features.feature_names)}
    kept = [n for n in dict.fromkeys(names) if n in position]
    value = pick_positions(F.col(VALUE), [position[n] for n in kept])
    if not kept:
        value = F.slice(VALUE, 1, 0)
    return features.with_table(features.table.select(ENTITY, value.alias(VALUE)), feature_names=tuple(kept))


def feature_variances(features: FeatureSet, fit_ids: DataFrame | Iterable[Any] | None = None) -> DataFrame:
    """(pos, n, mean, var_samp, var_pop) over all entities, or only over `fit_ids`."""
    check_kind(features, MATRIX)
    table = features.table if fit_ids is None else keep_members(features.table, ENTITY, fit_ids)
    return array_stats(table, VALUE)


def variance_filter(
    features: FeatureSet, threshold: float = 0.0, fit_ids: DataFrame | Iterable[Any] | None = None
) -> FeatureSet:
    """Drop features whose sample variance is not above `threshold`.

    Runs one job: the kept positions (at most the feature width) come to the driver,
    because they decide the schema of what follows.
    """
    stats = feature_variances(features, fit_ids)
    kept = sorted(r["pos"] for r in stats.filter(F.col("var_samp") > threshold).select("pos").collect())
    return select_features(features, [features.feature_names[p] for p in kept])


def scale_features(features: FeatureSet, fit_ids: DataFrame | Iterable[Any] | None = None) -> FeatureSet:
    """Standardise every feature with mean and population deviation of `fit_ids`.

    Integer and decimal features become doubles. Without any entity to fit on it raises.
    """
    stats = feature_variances(features, fit_ids).select(
        "pos",
        "mean",
        safe_scale(F.col("mean"), F.col("var_pop"), F.col("n").cast("double")).alias("scale"),
    )
    # one row of two arrays as wide as the feature set
    fitted = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "scale"))).alias("by_pos")).scalar()
    element = float_kind(features.table.schema[VALUE].dataType.elementType)
    scaled = F.zip_with(VALUE, "_fitted", lambda x, s: ((x.cast("double") - s["mean"]) / s["scale"]).cast(element))
    return features.with_table(
        features.table.withColumn("_fitted", fitted)
        .filter(required((F.size("_fitted") > 0) | (F.size(VALUE) == 0), "no entity to fit the scaling on"))
        .select(ENTITY, scaled.alias(VALUE))
    )


def describe_features(features: FeatureSet) -> DataFrame:
    """One row: kind, n entities, min and max array length (null for plain values)."""
    if features.kind == CONSTANT:
        raise TypeError("a constant has no table to describe")
    is_array = features.table.schema[VALUE].dataType.typeName() == "array"
    length = F.size(VALUE) if is_array else F.lit(None).cast("int")
    return features.table.agg(
        F.lit(features.kind).alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.min(length).cast("bigint").alias("min_len"),
        F.max(length).cast("bigint").alias("max_len"),
    )


def value_shape(features: FeatureSet) -> tuple[int, ...] | None:
    """Length of one value, () for a plain constant, None for plain lookup values.

    Lookup arrays must all be equally long.
    """
    if features.kind == MATRIX:
        return (len(features.feature_names),)
    if features.kind == CONSTANT:
        return (len(features.value),) if isinstance(features.value, (list, tuple)) else ()
    row = describe_features(features).first()
    if row["min_len"] is None:
        return None
    if row["min_len"] != row["max_len"]:
        raise ValueError("values of a lookup set differ in length")
    return (row["min_len"],)


def signature(features: FeatureSet) -> dict[str, Any]:
    """Name, element type and shape of one encoded value."""
    return {"name": features.name, "dtype": features.dtype, "shape": value_shape(features)}


def load_feature_list(lists: DataFrame, name: str) -> list[str]:
    """Names of one list from a (list_name, pos, feature) table; unknown list is a KeyError."""
    rows = lists.filter(F.col("list_name") == F.lit(name)).orderBy("pos").select("feature").collect()
    if not rows:
        raise KeyError(name)
    return [r["feature"] for r in rows]


def select_listed(features: FeatureSet, lists: DataFrame, name: str) -> FeatureSet:
    """Keep the features of a named list."""
    return select_features(features, load_feature_list(lists, name))


def map_values(features: FeatureSet, column_function, kinds: Sequence[str] = (MATRIX, LOOKUP), **changes) -> FeatureSet:
    """Replace every value by `column_function(value column)`; may be a pandas UDF."""
    check_kind(features, *kinds)
    return features.with_table(
        features.table.select(ENTITY, column_function(F.col(VALUE)).alias(VALUE)), **changes
    )
