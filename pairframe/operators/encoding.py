"""Look up features for observations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from pairframe.featureset import CONSTANT, ENTITY, VALUE, FeatureSet, join_value

Sets = Mapping[str, FeatureSet]


def encode(obs: DataFrame, features: FeatureSet, key: str, column: str, strict: bool = True) -> DataFrame:
    """One feature set for the ids in `key`; repeats kept, unknown id is an error."""
    return features.attach(obs, key, column, strict)


def encode_index(df: DataFrame, table: FeatureSet, index: str, column: str, strict: bool = True) -> DataFrame:
    """Row lookup by a number that is truncated to an integer first."""
    keyed = df.withColumn("_index", F.col(index).cast("int"))
    return table.attach(keyed, "_index", column, strict).drop("_index")


def feature_columns(cells: Sets, drugs: Sets, drugs_first: bool = False) -> list[str]:
    """Column names of the assembled features, in order."""
    cell = [f"cell_{k}" for k in cells]
    drug = [f"drug_{k}" for k in drugs]
    return drug + cell if drugs_first else cell + drug


def _attach_side(df: DataFrame, sets: Sets, side: str, strict: bool) -> DataFrame:
    """All sets of one entity through a single join on the observations.

    The tables are joined with each other first, entity by entity, which is far less
    data than joining each of them with the observations. An entity must be in all of
    them in strict mode; otherwise it keeps the values it has, and is null in the rest.
    """
    plain = {k: s for k, s in sets.items() if isinstance(s, FeatureSet) and s.kind != CONSTANT}
    if plain:
        merged = None
        for key, features in plain.items():
            table = features.table.select(ENTITY, F.col(VALUE).alias(f"{side}_{key}"))
            merged = table if merged is None else merged.join(table, ENTITY, "inner" if strict else "full")
        df = join_value(df, merged, f"{side}_id", {f"{side}_{k}": f"{side}_{k}" for k in plain}, strict)
    for key, features in sets.items():
        if key not in plain:
            df = features.attach(df, f"{side}_id", f"{side}_{key}", strict)
    return df


def encode_pairs(
    obs: DataFrame, cells: Sets, drugs: Sets, drugs_first: bool = False, strict: bool = True
) -> DataFrame:
    """Observations plus every cell and drug feature set, cells first unless `drugs_first`.

    The narrower side is attached first, so the widest arrays never travel through the
    second shuffle.
    """
    if "id" in cells or "id" in drugs:
        raise ValueError("a feature set cannot be named 'id'")
    sides = sorted([("cell", cells), ("drug", drugs)], key=lambda s: sum(f.width for f in s[1].values()))
    joined = obs
    for side, sets in sides:
        joined = _attach_side(joined, sets, side, strict)
    return joined.select(*obs.columns, *feature_columns(cells, drugs, drugs_first))
