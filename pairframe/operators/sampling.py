"""Seeded samples and shuffles; the seed feeds the order hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pairframe.operators.ranking import Key, rank_rows, slice_rows
from pairframe.operators.selection import keep_members


def sample_rows(df: DataFrame, n: int, seed: int = 0, keys: Sequence[Key] = ("id",)) -> DataFrame:
    """Exactly `n` rows without replacement; more than there are is an error."""
    if n < 0:
        raise ValueError("n must not be negative")
    return slice_rows(df, 0, n, keys, seed, at_least=n)


def sample_entities(obs: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """Sample `n` distinct entities and keep all their rows."""
    return keep_members(obs, column, sample_rows(obs.select(column).distinct(), n, seed, [column]), at_most=n)


def shuffle_rows(df: DataFrame, seed: int = 0, keys: Sequence[Key] = ("id",), name: str = "position") -> DataFrame:
    """Explicit shuffled position per row (a DataFrame itself has no order)."""
    return rank_rows(df, keys, seed, name=name)
