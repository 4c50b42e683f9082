"""Scores of predictions, over a whole table or per group, in one aggregate pass.

Rows where either side is null or NaN count for no part of a score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.functions.numeric import nan_to_null


def _complete(y_true: str, y_pred: str) -> tuple[Column, Column]:
    """Both sides as doubles, null unless both are there."""
    y, p = (nan_to_null(F.col(c).cast("double")) for c in (y_true, y_pred))
    return F.when(p.isNotNull(), y), F.when(y.isNotNull(), p)


def r2(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """1 - residual / total sum of squares; null when y_true is constant."""
    y, p = _complete(y_true, y_pred)
    total = F.var_pop(y) * F.count(y)
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), total)


def pearson(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Correlation; null when either side is constant."""
    y, p = _complete(y_true, y_pred)
    return F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def rmse(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    y, p = _complete(y_true, y_pred)
    return F.sqrt(F.avg((y - p) * (y - p)))


METRICS = {"r2": r2, "pearson": pearson, "rmse": rmse}


def score(df: DataFrame, metrics: Sequence[str] = tuple(METRICS), by: Sequence[str] = ()) -> DataFrame:
    """Chosen metrics of a prediction table, optionally per group."""
    columns = [METRICS[m]().alias(m) for m in metrics]
    return (df.groupBy(*by) if by else df).agg(*columns)


def prediction_table(splits: Mapping[str, DataFrame], **constants: Any) -> DataFrame:
    """Stack (cell_id, drug_id, y_true, y_pred) of named splits, plus constant columns."""
    result = None
    for name, df in splits.items():
        part = df.select("cell_id", "drug_id", "y_true", "y_pred", F.lit(name).alias("split"))
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("no splits given")
    return result.select("*", *[F.lit(v).alias(k) for k, v in constants.items()])


def prediction_rows(df: DataFrame, split: str, **constants: Any) -> DataFrame:
    """The same table from one frame whose column `split` names the split of each row."""
    return df.select(
        "cell_id", "drug_id", "y_true", "y_pred", F.col(split).alias("split"), *[F.lit(v).alias(k) for k, v in constants.items()]
    )
