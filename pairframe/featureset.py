"""Feature sets: values looked up by entity id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.functions.guards import required

ENTITY = "entity_id"
VALUE = "value"
MATRIX, LOOKUP, CONSTANT = "matrix", "lookup", "constant"


def join_value(df: DataFrame, table: DataFrame, key: str, columns: dict[str, str], strict: bool) -> DataFrame:
    """Left join `columns` (table column -> new name) by entity id.

    Strict mode raises on an id without a row, in the same pass, through a filter.
    The join carries no hint: adaptive execution broadcasts the table only when its
    measured size is small, and splits hot ids otherwise.
    """
    side = table.select(
        F.col(ENTITY).alias("_entity"),
        *[F.col(c).alias(new) for c, new in columns.items()],
        F.lit(True).alias("_found"),
    )
    joined = df.join(side, F.col(key) == F.col("_entity"), "left")
    if strict:
        missing = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        joined = joined.filter(required(F.col("_found").isNotNull(), missing))
    return joined.drop("_entity", "_found")


@dataclass(frozen=True)
class FeatureSet:
    """Values per entity: arrays with named positions, single values, or one constant.

    `table` has columns (entity_id, value) with unique ids. Anything with the same
    `kind`, `name`, `width` and `attach` can be used in its place.
    """

    kind: str
    table: DataFrame | None = None
    value: Any = None
    feature_names: tuple[str, ...] | None = None
    name: str | None = None

    @classmethod
    def matrix(
        cls,
        table: DataFrame,
        feature_names: Sequence[str],
        key: str = ENTITY,
        value: str = VALUE,
        name: str | None = None,
    ) -> FeatureSet:
        """One array per entity."""
        return cls(
            MATRIX,
            table.select(F.col(key).alias(ENTITY), F.col(value).alias(VALUE)),
            feature_names=tuple(feature_names),
            name=name,
        )

    @classmethod
    def from_columns(
        cls, df: DataFrame, key: str, columns: Sequence[str], dtype: str = "double", name: str | None = None
    ) -> FeatureSet:
        """A matrix set from ordinary numeric columns."""
        packed = df.select(
            F.col(key).alias(ENTITY), F.array(*[F.col(c).cast(dtype) for c in columns]).alias(VALUE)
        )
        return cls.matrix(packed, columns, name=name)

    @classmethod
    def lookup(
        cls, table: DataFrame, key: str = ENTITY, value: str = VALUE, name: str | None = None
    ) -> FeatureSet:
        """One value of any type per entity."""
        return cls(LOOKUP, table.select(F.col(key).alias(ENTITY), F.col(value).alias(VALUE)), name=name)

    @classmethod
    def constant(cls, value: Any, name: str | None = None) -> FeatureSet:
        """The same value for every entity."""
        return cls(CONSTANT, value=value, name=name)

    def with_table(self, table: DataFrame, **changes: Any) -> FeatureSet:
        return replace(self, table=table, **changes)

    @property
    def width(self) -> int:
        """Payload estimate used to order joins: array length, 1 or 0."""
        return {MATRIX: len(self.feature_names or ()), LOOKUP: 1, CONSTANT: 0}[self.kind]

    @property
    def size(self) -> int:
        """Number of entities (runs a count); 1 for a constant."""
        return 1 if self.kind == CONSTANT else self.table.count()

    @property
    def dtype(self) -> str:
        """Type of one element (matrix) or of the value."""
        if self.kind == CONSTANT:
            element = self.value[0] if isinstance(self.value, (list, tuple)) else self.value
            return {bool: "boolean", int: "int", float: "double", str: "string"}[type(element)]
        field = self.table.schema[VALUE].dataType
        return getattr(field, "elementType", field).simpleString()

    def constant_column(self) -> Column:
        if isinstance(self.value, (list, tuple)):
            return F.array(*[F.lit(v) for v in self.value])
        return F.lit(self.value)

    def attach(self, df: DataFrame, key: str, column: str, strict: bool = True) -> DataFrame:
        """Add this set's value for `key` as `column`."""
        if self.kind == CONSTANT:
            return df.withColumn(column, self.constant_column())
        return join_value(df, self.table, key, {VALUE: column}, strict)

    def get(self, entity: Any) -> Any:
        """The value of one entity; unknown id raises KeyError."""
        if self.kind == CONSTANT:
            return self.value
        row = self.table.filter(F.col(ENTITY) == F.lit(entity)).select(VALUE).first()
        if row is None:
            raise KeyError(entity)
        return row[0]
