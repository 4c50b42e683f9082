"""Shape and summarise observation tables (id, cell_id, drug_id, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.operators.ranking import Key, number_rows
from pairframe.session import checked_broadcast

# The observation columns, in order.
OBS_COLUMNS = ("id", "cell_id", "drug_id", "label")


def validate_obs(df: DataFrame) -> DataFrame:
    """Project the four observation columns; a missing one is an error."""
    missing = [c for c in OBS_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"observations need the columns {missing} as well")
    return df.select(*OBS_COLUMNS)


def as_obs(
    df: DataFrame,
    id_col: str = "id",
    label_col: str = "label",
    cell_id_col: str = "cell_id",
    drug_id_col: str = "drug_id",
    order_by: Key | Sequence[Key] | None = None,
    hash_by: Sequence[Key] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Rename columns to an observation table, numbering rows when `id_col` is absent.

    Generated ids ascend with the columns `order_by` of `df`, and with the observation's
    columns where those are equal. Without it they follow a hash of `hash_by`, by default of all columns.
    """
    renamed = [
        F.col(cell_id_col).alias("cell_id"),
        F.col(drug_id_col).alias("drug_id"),
        F.col(label_col).alias("label"),
    ]
    if id_col in df.columns:
        return df.select(F.col(id_col).alias("id"), *renamed)
    if order_by is None:
        return validate_obs(number_rows(df.select(*renamed), "id", hash_by, seed))
    stated = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    lead = [F.col(k) if isinstance(k, str) else k for k in stated]
    names = [f"_order{i}" for i in range(len(lead))]
    kept = df.select(*renamed, *[c.alias(n) for c, n in zip(lead, names)])
    return validate_obs(number_rows(kept, "id", order_by=names))


def pick_metric(df: DataFrame, metric: str) -> DataFrame:
    """Use one of several measured columns as the label."""
    if metric not in df.columns:
        raise ValueError(f"no metric column {metric!r}")
    return df.select("id", "cell_id", "drug_id", F.col(metric).alias("label"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, count); nulls are not counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count()


def filter_by_value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose key occurs at least `n` times."""
    frequent = value_counts(df, column).filter(F.col("count") >= n).select(column)
    return df.join(checked_broadcast(frequent), column, "left_semi")


def _distinct(column: str) -> Column:
    return F.countDistinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def summarise(obs: DataFrame) -> DataFrame:
    """One row: size, n_cells, n_drugs; a null id counts as one more value."""
    return obs.agg(
        F.count(F.lit(1)).alias("size"),
        _distinct("cell_id").cast("bigint").alias("n_cells"),
        _distinct("drug_id").cast("bigint").alias("n_drugs"),
    )


def mapping_from_columns(df: DataFrame, key: str, value: str, order_by: Column | str) -> DataFrame:
    """(key, value) with the value of the row that is last by `order_by`."""
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    return df.groupBy(key).agg(F.max_by(F.col(value), order).alias(value))


def as_entity_table(df: DataFrame, column: str, name: str = "entity_id") -> DataFrame:
    """Make `column` the entity id: first column, renamed."""
    return df.select(F.col(column).alias(name), *[c for c in df.columns if c != column])
