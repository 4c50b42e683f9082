"""CSV tables: observations, feature matrices, lookups, metadata.

Files are read as text columns by `records.read_csv`, which splits large files between tasks,
and cast here, so that one rule decides what is missing and what is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairframe.featureset import FeatureSet
from pairframe.functions.guards import required
from pairframe.operators.observations import validate_obs
from pairframe.sources.records import header, read_csv

# Texts that stand for a missing number by default.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$|^\s*[-+]?(nan|inf|infinity)\s*$"
#: Types tried for a column without a stated one, in this order.
INFERRED = ("int", "bigint", "double", "boolean")


def _texts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All columns as strings; a column without a name becomes `_c<i>`."""
    names = header(spark, path)
    rows = read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in names]), strict)
    return rows.toDF(*[c or f"_c{i}" for i, c in enumerate(names)])


def _named(column: str) -> Column:
    return F.col(f"`{column.replace('`', '``')}`")


def _present(text: Column, na_values: Sequence[str]) -> Column:
    return F.when(~text.isin(*na_values), text) if na_values else text


def _number_like(text: Column, kind: str) -> Column:
    """A cast that takes only what is written as that type, not `1d` for a number."""
    if kind in ("float", "double"):
        return F.when(F.rlike(F.lower(text), F.lit(NUMBER)), text.try_cast(kind))
    if kind == "boolean":
        return F.when(F.lower(F.trim(text)).isin("true", "false"), text.try_cast(kind))
    return text.try_cast(kind)


def _cast(df: DataFrame, types: Mapping[str, str], na_values: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Text columns as `types` (string where not stated); what does not fit is an error, or null."""
    columns, whole = [], []
    for name in df.columns:
        text, kind = _present(_named(name), na_values), types.get(name, "string")
        value = text if kind == "string" else _number_like(text, kind)
        columns.append(value.alias(name))
        if strict and kind != "string":
            whole.append(text.isNull() | value.isNotNull())
    if whole:
        df = df.filter(required(reduce(Column.__and__, whole), "a value is not of its column's type"))
    return df.select(*columns)


def _inferred(df: DataFrame, given: Mapping[str, str], na_values: Sequence[str]) -> dict[str, str]:
    """`given`, and for each other column the first type of INFERRED that all its values fit."""
    rest = [c for c in df.columns if c not in given]
    checks = []
    for i, name in enumerate(rest):
        text = _present(_named(name), na_values)
        checks.append(F.count(text).alias(f"{i}:n"))
        checks += [F.count(_number_like(text, kind)).alias(f"{i}:{kind}") for kind in INFERRED]
    if not rest:
        return dict(given)
    found = df.agg(*checks).first()
    types = dict(given)
    for i, name in enumerate(rest):
        n = found[f"{i}:n"]
        types[name] = next((kind for kind in INFERRED if n and found[f"{i}:{kind}"] == n), "string")
    return types


def read_table(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, na_values: Sequence[str] = ()
) -> DataFrame:
    """CSV with a header. With `types` other columns are strings; without, the types of all
    columns are inferred by one aggregate over the files. `na_values` are texts read as null."""
    texts = _texts(spark, path)
    return _cast(texts, _inferred(texts, {}, na_values) if types is None else types, na_values)


def read_observations(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, label_type: str = "float"
) -> DataFrame:
    """Observation CSV; the label is float32 unless stated."""
    df = validate_obs(read_table(spark, path, types))
    return df.withColumn("label", F.col("label").cast(label_type))


def read_metadata(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    key_type: str = "string",
    na_values: Sequence[str] = (),
) -> DataFrame:
    """Metadata CSV; its first column becomes entity_id, of `key_type`: 007 stays 007 by default.

    Types of the other columns are inferred unless `types` states them.
    """
    texts = _texts(spark, path)
    key = texts.columns[0]
    given = {**(types or {}), key: key_type}
    df = _cast(texts, given if types is not None else _inferred(texts, given, na_values), na_values)
    return df.withColumnRenamed(key, "entity_id")


def read_lookup(
    spark: SparkSession,
    path: str,
    value_col: str,
    key_col: str | None = None,
    key_type: str = "string",
    name: str | None = None,
) -> FeatureSet:
    """Lookup set of strings; the key is the first column unless named."""
    texts = _texts(spark, path)
    key = key_col or texts.columns[0]
    return FeatureSet.lookup(_cast(texts.select(_named(key), _named(value_col)), {key: key_type}), key, value_col, name)


def read_feature_matrix(
    spark: SparkSession,
    path: str,
    index_col: int | str = 0,
    dtype: str = "double",
    key_type: str = "string",
    name: str | None = None,
    strict: bool = True,
    na_values: Sequence[str] = MISSING_TEXTS,
) -> FeatureSet:
    """Matrix set from a wide CSV: one id column, all others features.

    A feature that is missing or one of `na_values` is NaN. Any other text that is not a
    number is an error, or NaN without `strict`. Ids are never missing: the text "NA" stays
    an id, a blank id is the empty string.
    """
    texts = _texts(spark, path, strict)
    columns = texts.columns
    key = columns[index_col] if isinstance(index_col, int) else index_col
    names = [c for c in columns if c != key]
    entity = _named(key)
    entity = F.coalesce(entity, F.lit("")) if key_type == "string" else entity.cast(key_type)
    nan = F.lit(float("nan")).cast(dtype)

    def number(text: Column) -> Column:
        return F.coalesce(_number_like(_present(text, na_values), dtype), nan)

    rows = texts.select(entity.alias("entity_id"), F.array(*[_named(c) for c in names]).alias("texts"))
    if strict:
        wrong = F.exists("texts", lambda t: _present(t, na_values).isNotNull() & _number_like(t, dtype).isNull())
        rows = rows.filter(required(~wrong, "a feature is not a number"))
    return FeatureSet.matrix(rows.select("entity_id", F.transform("texts", number).alias("value")), names, name=name)


def write_feature_matrix(features: FeatureSet, path: str, key: str = "entity_id") -> None:
    """Wide CSV with one column per feature."""
    columns = [F.get("value", i).alias(n) for i, n in enumerate(features.feature_names)]
    features.table.select(F.col("entity_id").alias(key), *columns).write.options(header=True, escape='"').csv(path)
