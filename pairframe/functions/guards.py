"""Row guards that raise while the job runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def required(condition: Column, message: str | Column) -> Column:
    """True where `condition` holds, an error elsewhere.

    Use it in a filter: a filter decides which rows exist, so unlike a projected
    column it is never pruned away by `count()` or a narrow select.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
