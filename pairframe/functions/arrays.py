"""Vector work on array columns.

Row-local expressions stay in the projection; reductions over rows go through
(key, position) so that map-side partial aggregation shrinks a hot key before
the shuffle, and no task ever holds all rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.functions.guards import required
from pairframe.functions.numeric import nan_to_null

#: Up to this width a reduction has one aggregate per position; the rows are the same beyond.
NARROW = 16
#: Up to so many weights a product with a matrix is one plain expression per unit.
DIRECT = 64


def dot(a: Column, b: Column) -> Column:
    """Contraction of two equally long arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def linear(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """`vector . W + b`; `weights` has one row per input position, one column per unit."""
    units = list(zip(*weights))
    if len(weights) * len(units) <= DIRECT and (bias is None or len(bias) == len(units)):
        fits = F.size(vector) == len(weights)
        shifts = [None] * len(units) if bias is None else bias
        sums = []
        for unit, shift in zip(units, shifts):
            total = F.lit(0.0)
            for i, w in enumerate(unit):
                total = total + F.get(vector, i).cast("double") * F.lit(float(w))
            sums.append(F.when(fits, total if shift is None else total + F.lit(float(shift))))
        return F.array(*sums)
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in unit]) for unit in units])
    product = F.transform(rows, lambda row: dot(vector, row))
    if bias is None:
        return product
    return F.zip_with(product, F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b)


def additive_score(context: Column, token: Column, v: Sequence[float]) -> Column:
    """`v . tanh(context + token)` over array columns."""
    squashed = F.zip_with(context, token, lambda g, s: F.tanh(g.cast("double") + s.cast("double")))
    return dot(squashed, F.array(*[F.lit(float(x)) for x in v]))


def pick_positions(vector: Column, positions: Sequence[int]) -> Column:
    """Elements at 0-based `positions`, in that order."""
    wanted = F.array(*[F.lit(int(p)) for p in positions])
    return F.transform(wanted, lambda p: F.get(vector, p))


def explode_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, pos, x) with x as double."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def collect_vector(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Back from (keys, pos, value) to one array per key; its size is the vector width."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda e: e[value]).alias(alias))


def reduce_arrays(
    df: DataFrame,
    keys: Sequence[str],
    vector: str,
    how: str = "sum",
    weight: Column | None = None,
    alias: str = "features",
    width: int | None = None,
) -> DataFrame:
    """Element-wise `sum`, `avg` or `max` of the vectors that share a key.

    Null vectors are skipped, so a key without any vector has no row. A stated `width` is
    checked: a vector of another length is an error. A known width up to NARROW becomes
    one aggregate per position and a single shuffle; otherwise positions are unfolded and
    reduced by (key, position).
    """
    reducers = {"sum": F.sum, "avg": F.avg, "max": F.max}
    if how not in reducers:
        raise ValueError(f"how must be one of {sorted(reducers)}")
    reducer = reducers[how]
    df = df.filter(F.col(vector).isNotNull())
    if width is not None:
        df = df.filter(required(F.size(vector) == width, f"a vector is not of the stated width {width}"))
    if width is not None and width <= NARROW:
        elements = [F.get(vector, i).cast("double") for i in range(width)]
        if weight is not None:
            elements = [e * weight for e in elements]
        return df.groupBy(*keys).agg(F.array(*[reducer(e) for e in elements]).alias(alias))
    source = df if weight is None else df.withColumn("_w", weight)
    carried = [*keys] if weight is None else [*keys, "_w"]
    long = explode_vector(source, carried, vector)
    value = F.col("x") if weight is None else F.col("x") * F.col("_w")
    reduced = long.groupBy(*keys, "pos").agg(reducer(value).alias("v"))
    return collect_vector(reduced, keys, "v", alias)


def array_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row per position: n, mean, var_samp, var_pop; NaN is skipped."""
    long = explode_vector(df, [], vector).withColumn("x", nan_to_null(F.col("x")))
    return long.groupBy("pos").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.var_samp("x").alias("var_samp"),
        F.var_pop("x").alias("var_pop"),
    )


def softmax_pool(
    df: DataFrame, group: str, score: str, vector: str, alias: str = "features", width: int | None = None
) -> DataFrame:
    """Per group: sum of vectors weighted by softmax of their scores.

    The group maximum is an ordinary aggregate joined back, not a window, so one
    huge group is spread over many tasks in both passes.
    """
    peak = df.groupBy(group).agg(F.max(score).alias("_peak"))
    # a trailing one sums up to the softmax denominator
    weighted = df.join(peak, group).select(
        group,
        F.exp(F.col(score) - F.col("_peak")).alias("_e"),
        F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.lit(1.0))).alias("_v"),
    )
    sums = reduce_arrays(weighted, [group], "_v", "sum", F.col("_e"), "_s", None if width is None else width + 1)
    pooled = F.transform(F.slice("_s", 1, F.size("_s") - 1), lambda v: v / F.element_at("_s", -1))
    return sums.select(group, pooled.alias(alias))
