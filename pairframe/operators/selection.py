"""Subsets by membership, intersections, entity grids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Context, Decimal
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from pairframe.featureset import ENTITY, join_value
from pairframe.operators.ranking import rank_rows
from pairframe.session import cut_lineage

LITERAL_LIMIT = 1_000
BROADCAST_LIMIT = 100_000
GRID_BLOCK = 1_024
MASK_BITS = 62


def _whole(value: Any) -> int | None:
    """The value as an integer if it is one."""
    if isinstance(value, str):
        value = Decimal(value.strip())
    return int(value) if value == int(value) else None


def _exact(value: Any, kind: T.DecimalType) -> Decimal | None:
    number = Decimal(value.strip()) if isinstance(value, str) else Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
    rounded = number.quantize(Decimal(1).scaleb(-kind.scale), context=Context(prec=60))
    return rounded if rounded == number and len(rounded.as_tuple().digits) <= kind.precision else None


def _moment(value: Any) -> dt.datetime:
    if isinstance(value, str):
        return dt.datetime.fromisoformat(value.strip())
    return value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)


def _day(value: Any) -> dt.date | None:
    moment = _moment(value)
    return moment.date() if moment.time() == dt.time() else None


def _truth(value: Any) -> bool | None:
    known = {"true": True, "false": False, 1: True, 0: False}
    return known.get(value.strip().lower() if isinstance(value, str) else value)


NUMBERS = (bool, int, float, Decimal)


def as_member(value: Any, kind: T.DataType) -> Any:
    """A Python value as the equal value of a column's type, None if that type has none.

    Numbers are compared as numbers: 1.0 is the id 1, 1.5 is none. Texts are read as the type.
    Text columns take the text of a number or a day. TypeError if the types are not comparable,
    as bytes and a number.
    """
    accepted, convert = {
        T.StringType: ((str, *NUMBERS, dt.date), lambda: value if isinstance(value, str) else str(value)),
        T.BooleanType: ((str, *NUMBERS), lambda: _truth(value)),
        T.BinaryType: ((str, bytes, bytearray), lambda: value.encode() if isinstance(value, str) else bytes(value)),
        T.DateType: ((str, dt.date), lambda: _day(value)),
        T.TimestampType: ((str, dt.date), lambda: _moment(value)),
        T.TimestampNTZType: ((str, dt.date), lambda: _moment(value)),
        T.DoubleType: ((str, *NUMBERS), lambda: float(value)),
        T.FloatType: ((str, *NUMBERS), lambda: float(value)),
        T.DecimalType: ((str, *NUMBERS), lambda: _exact(value, kind)),
    }.get(type(kind), ((str, *NUMBERS), lambda: _whole(value)))
    if not isinstance(kind, T.AtomicType):
        raise TypeError(f"members of a column of type {kind.simpleString()} are not supported")
    if not isinstance(value, accepted):
        raise TypeError(f"a {type(value).__name__} is never equal to a value of type {kind.simpleString()}")
    try:
        found = convert()
    except (ValueError, ArithmeticError):
        return None
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind))
    return None if bits and found is not None and not -(1 << bits) <= found < 1 << bits else found


def keep_members(
    df: DataFrame, column: str, members: DataFrame | Iterable[Any], at_most: int | None = None
) -> DataFrame:
    """Rows whose `column` is among `members`: a DataFrame (first column) or values.

    Unknown members are ignored and repeats do not multiply rows. Values of any number are
    turned into the column's type by `as_member`; those that have no equal there are no members,
    nor is None. A value that the type cannot be compared with is a TypeError. A short list
    becomes a pushed-down IN filter, everything else a semi join. `at_most` is a known
    bound on the number of members; a small one lets them be broadcast.
    """
    if isinstance(members, DataFrame):
        wanted = members.select(F.col(members.columns[0]).alias(column)).distinct()
        if at_most is not None and at_most <= BROADCAST_LIMIT:
            wanted = F.broadcast(wanted)
        return df.join(wanted, column, "left_semi")
    kind = df.schema[column].dataType
    found = (as_member(v, kind) for v in members if v is not None)
    values = list(dict.fromkeys(v for v in found if v is not None))
    if isinstance(kind, T.FloatType):  # compared as double, so that 0.1 is not a near value
        kind = T.DoubleType()
    if len(values) <= LITERAL_LIMIT:
        return df.filter(F.col(column).isin([F.lit(v).cast(kind) for v in values]))
    schema = T.StructType([T.StructField("_member", kind)])
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], schema)
    return df.join(wanted, F.col(column) == F.col("_member"), "left_semi")


def intersect_columns(*frames: DataFrame, cols: str | Sequence[str]) -> tuple[DataFrame, ...]:
    """In every frame keep only rows whose key occurs in all frames; null is no key.

    One aggregate over all frames sets a bit per frame that has the key; its keys with every
    bit are stored and each frame is filtered by them, so a frame is scanned twice.
    """
    names = [cols] * len(frames) if isinstance(cols, str) else list(cols)
    if len(names) != len(frames):
        raise ValueError("give one column name, or one per frame")
    if len(frames) > MASK_BITS:
        raise ValueError(f"at most {MASK_BITS} frames")
    keys = None
    for i, (frame, name) in enumerate(zip(frames, names)):
        part = frame.select(F.col(name).alias("_key"), F.lit(1 << i).cast("bigint").alias("_mask")).filter("_key IS NOT NULL")
        keys = part if keys is None else keys.unionAll(part)
    everywhere = F.col("_mask") == (1 << len(frames)) - 1
    common = cut_lineage(keys.groupBy("_key").agg(F.bit_or("_mask").alias("_mask")).filter(everywhere).select("_key"))
    return tuple(f.join(common, F.col(n) == F.col("_key"), "left_semi") for f, n in zip(frames, names))


def attach_metadata(
    df: DataFrame, meta: DataFrame, key: str, columns: Sequence[str], meta_key: str = ENTITY, strict: bool = True
) -> DataFrame:
    """Add metadata columns of an entity; an unknown entity is an error in strict mode."""
    return join_value(df, meta.withColumnRenamed(meta_key, ENTITY), key, {c: c for c in columns}, strict)


def pair_grid(cells: DataFrame, drugs: DataFrame, cell_key: str = "cell_id", drug_key: str = "drug_id") -> DataFrame:
    """Every (cell, drug) combination of the distinct entities.

    Drugs are numbered and cut into blocks of GRID_BLOCK; each cell is repeated once
    per block and an equi join on the block yields the pairs. The shuffle moves cells
    times blocks, not the full product.
    """
    cell_ids = cells.select(cell_key).distinct()
    drug_ids = rank_rows(drugs.select(drug_key).distinct(), [drug_key], name="_n").withColumn(
        "_block", F.expr(f"_n div {GRID_BLOCK}")
    )
    zero = F.lit(0).cast("bigint")
    blocks = F.sequence(zero, drug_ids.agg(F.max("_block")).scalar(), F.lit(1).cast("bigint"))
    repeated = cell_ids.withColumn("_block", F.explode(blocks))  # no drugs: null array, no rows
    return repeated.join(drug_ids, "_block").select(cell_key, drug_key)
