"""Train / val / test roles for entities and observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairframe.operators.ranking import order_hash, rank_rows
from pairframe.session import BROADCAST_ROWS, checked_broadcast, cut_lineage

_WIDE = "decimal(38,0)"


def _apportion(strata: DataFrame, size: str, wanted: int, name: str, seed: int) -> DataFrame:
    """Add `name`: `wanted` places shared over the strata in proportion to `size`.

    Largest remainders: every stratum gets the whole part of its share, and the places left go
    to the largest fractions, equal ones by a hash of the stratum.
    """
    pool = strata.agg(F.sum(size)).first()[0] or 0
    if not wanted or not pool:
        return strata.withColumn(name, F.lit(0).cast("bigint"))
    product = F.col(size).cast("decimal(19,0)") * F.lit(wanted).cast("decimal(19,0)")
    share = strata.withColumn(name, F.floor(product / F.lit(pool)).cast("bigint"))
    # the quotient may round; the remainder is exact and corrects it
    rest = product - F.col(name).cast("decimal(19,0)") * F.lit(pool).cast("decimal(19,0)")
    share = share.withColumn("_rest", rest.cast(_WIDE))
    step = F.when(F.col("_rest") < 0, -1).when(F.col("_rest") >= pool, 1).otherwise(0)
    share = share.withColumns({name: F.col(name) + step, "_rest": (F.col("_rest") - step * F.lit(pool)).cast(_WIDE)})
    share = cut_lineage(share)
    left = wanted - share.agg(F.sum(name)).first()[0]
    if share.count() <= BROADCAST_ROWS:
        order = Window.orderBy(F.desc("_rest"), order_hash(["_s.v"], seed), "_s.v")
        ranked = share.withColumn("_place", F.row_number().over(order) - 1)
    else:
        ranked = rank_rows(share, ["_s.v"], seed, name="_place", order_by=-F.col("_rest"))
    extra = (F.col("_place") < left).cast("bigint")
    return ranked.withColumn(name, F.col(name) + extra).drop("_rest", "_place")


def stratified_holdout(
    entities: DataFrame,
    key: str,
    stratum: str,
    test_size: float = 0.1,
    val_size: float = 0.1,
    seed: int = 0,
) -> DataFrame:
    """(key, stratum, role): `test_size` of all entities test, then `val_size` of the rest val.

    Both numbers are rounded up over the whole table, not in every stratum, and shared over the
    strata by largest remainders. A stratum with one member stays in train. Null is a stratum.
    """
    rows = entities.select(key, stratum)
    sizes = rows.groupBy(F.struct(F.col(stratum).alias("v")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    strata = cut_lineage(sizes.withColumn("_open", F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)))
    total, pool = (n or 0 for n in strata.agg(F.sum("_n"), F.sum("_open")).first())
    tests = min(math.ceil(test_size * total), pool)
    vals = min(math.ceil(val_size * (total - tests)), pool - tests)
    strata = _apportion(strata, "_open", tests, "_tests", seed)
    strata = _apportion(strata.withColumn("_open", F.col("_open") - F.col("_tests")), "_open", vals, "_vals", seed)
    shares = checked_broadcast(strata.select("_s", "_tests", "_vals"))
    ranked = rank_rows(rows, [key], seed, name="_position", within=[stratum])
    placed = ranked.join(shares, F.struct(F.col(stratum).alias("v")) == F.col("_s"))
    return placed.select(key, stratum, _role(F.col("_position"), F.col("_tests"), F.col("_vals")).alias("role"))


def _role(position: Column, tests: Column, vals: Column) -> Column:
    return F.when(position < tests, "test").when(position < tests + vals, "val").otherwise("train")


def apply_split(obs: DataFrame, split: DataFrame, key: str = "id") -> DataFrame:
    """Attach every (fold, role) an observation belongs to; `split` is keyed by its `id`."""
    side = split.withColumnRenamed("id", "_split_id")
    joined = obs.join(side, F.col(key) == F.col("_split_id")).drop("_split_id")
    lead = [c for c in ("fold", "role") if c in split.columns]
    return joined.select(*lead, *obs.columns)
