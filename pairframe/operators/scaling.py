"""Standard scaling, global or per group, with separate fit and apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairframe.functions.guards import required
from pairframe.functions.numeric import nan_to_null, safe_scale
from pairframe.session import checked_broadcast, cut_lineage

METHODS = ("global", "grouped")


def float_kind(kind: T.DataType) -> T.DataType:
    """The type of scaled values: float stays float, everything else becomes double."""
    return kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()


def _nan() -> Column:
    return F.lit(float("nan"))


def fit_scaler(df: DataFrame, group: str | None = None, value: str = "label") -> DataFrame:
    """Statistics (group, n, mean, var, scale); one row overall when `group` is None.

    Population variance in double, NaN skipped. Per group n counts all rows; overall
    it counts the rows with a value.
    """
    x = nan_to_null(F.col(value).cast("double"))
    rows = F.count(x) if group is None else F.count(F.lit(1))
    stats = (df.groupBy(group) if group else df).agg(
        rows.alias("n"),
        F.coalesce(F.avg(x), _nan()).alias("mean"),
        F.coalesce(F.var_pop(x), _nan()).alias("var"),
    )
    return stats.withColumn("scale", safe_scale(F.col("mean"), F.col("var"), F.col("n").cast("double")))


def apply_scaler(
    df: DataFrame, stats: DataFrame, group: str | None = None, value: str = "label", strict: bool = True
) -> DataFrame:
    """Replace `value` by (value - mean) / scale; integers and decimals become doubles.

    A group without statistics is an error in strict mode and null otherwise, and so are
    overall statistics of no value at all. Global statistics are one row and enter as a scalar
    subquery, not as a join. Group statistics are computed here, once, and broadcast when there
    are few groups.
    """
    kind = float_kind(df.schema[value].dataType)
    if group is None:
        fitted = stats.select(F.struct("n", "mean", "scale")).scalar()
        scaled = (F.col(value).cast("double") - fitted["mean"]) / fitted["scale"]
        if strict:
            df = df.filter(required(fitted["n"] > 0, "no value to fit the scaling on"))
        return df.withColumn(value, scaled.cast(kind) if strict else F.when(fitted["n"] > 0, scaled).cast(kind))
    side = checked_broadcast(
        stats.select(F.col(group).alias("_group"), F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))
    )
    joined = df.join(side, F.col(group) == F.col("_group"), "left")
    if strict:
        unseen = F.concat(F.lit("no statistics for group "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
        joined = joined.filter(required(F.col("_group").isNotNull(), unseen))
    scaled = (F.col(value).cast("double") - F.col("_mean")) / F.col("_scale")
    return joined.select(*[scaled.cast(kind).alias(c) if c == value else F.col(c) for c in df.columns])


def fit_matrix_scaler(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Statistics (group, n, mean, var, scale) of array values, the last three arrays by position.

    Rows are unfolded to (group, position, value) and reduced to count, mean and second moment
    before they are exchanged, so a group moves as many rows per task as it has positions, not
    as it has members. NaN and null are skipped; n counts all rows of a group.
    """
    long = df.select(F.struct(F.col(group).alias("v")).alias("_g"), F.posexplode(value).alias("_pos", "_x"))
    x = nan_to_null(F.col("_x").cast("double"))
    by_position = long.groupBy("_g", "_pos").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(x), _nan()).alias("mean"), F.coalesce(F.var_pop(x), _nan()).alias("var")
    )
    scaled = by_position.withColumn("scale", safe_scale(F.col("mean"), F.col("var"), F.col("n").cast("double")))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "n", "mean", "var", "scale")))  # one per position
    return scaled.groupBy("_g").agg(rows.alias("_r")).select(
        F.col("_g.v").alias(group),
        F.array_max("_r.n").alias("n"),
        *[F.col(f"_r.{c}").alias(c) for c in ("mean", "var", "scale")],
    )


def apply_matrix_scaler(
    df: DataFrame, stats: DataFrame, group: str, value: str = "value", strict: bool = True
) -> DataFrame:
    """Replace each array by (x - mean) / scale of its group, position by position.

    Floats stay floats, other elements become doubles. A group without statistics, or an array
    longer than them, is an error in strict mode and null otherwise. The statistics meet the
    rows in one join; they are broadcast only while their arrays are few and short.
    """
    kind = T.ArrayType(float_kind(df.schema[value].dataType.elementType))
    side = stats.select(F.struct(F.col(group).alias("v")).alias("_g"), F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))
    side = checked_broadcast(side, width=F.size("_mean") + F.size("_scale"))
    joined = df.join(side, F.struct(F.col(group).alias("v")) == F.col("_g"), "left")
    fits = F.col(value).isNull() | F.coalesce(F.size(value) <= F.size("_mean"), F.lit(False)) | (F.size(value) == 0)
    if strict:
        text = F.concat(F.lit("no statistics for group "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
        joined = joined.filter(required(fits, text))
    scaled = F.transform(value, lambda x, i: (x.cast("double") - F.get("_mean", i)) / F.get("_scale", i))
    result = F.when(fits, scaled).cast(kind)
    return joined.select(*[result.alias(c) if c == value else F.col(c) for c in df.columns])


def fit_apply_matrix(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Scale array values per group with their own statistics."""
    return apply_matrix_scaler(df, fit_matrix_scaler(df, group, value), group, value)


def fit_apply(df: DataFrame, group: str | None = None, value: str = "label") -> DataFrame:
    """Fit on a table and apply to the same table."""
    return apply_scaler(df, fit_scaler(df, group, value), group, value)


def normalize_labels(
    train: DataFrame, others: Sequence[DataFrame | None] = (), method: str = "global"
) -> tuple[DataFrame | None, ...]:
    """Fit on `train` (overall or per drug) and apply to it and to each other table."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}; known are {METHODS}")
    group = None if method == "global" else "drug_id"
    stats = fit_scaler(train, group)
    if group is not None:
        stats = cut_lineage(stats)  # shared by every table below
    return tuple(None if d is None else apply_scaler(d, stats, group) for d in (train, *others))
