"""Exact global positions without sorting the table in one task.

Rows are ordered by `md5(seed:epoch:keys)`. The leading hex digits of that hash cut
the order into at most 16**digits buckets of near-equal size. Only the bucket counts
are accumulated in one place (their number is bounded by the digits, not by the
data); rows are ranked inside their bucket and shifted by the bucket's offset.

An order by columns of any orderable type is left to Spark's range exchange, as many ranges
as the row count asks for. The hash is its last key, so a value that many rows share is cut as
well. One run of positions of such an order is found without sorting the rest: sampled keys
close in on it from both sides, and the rows outside are counted, not moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairframe.functions.guards import required
from pairframe.session import checked_broadcast, cut_lineage

GLOBAL_DIGITS = 4
GROUP_DIGITS = 3
RUN_LENGTH = 65_536
RANGE_ROWS = 1 << 20
SLICE_ROWS = 1 << 18
PROBES = 10_000
#: More rounds than any table needs; what is left then is ranked as it is.
MOST_ROUNDS = 40

Key = str | Column


def _column(key: Key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def order_hash(keys: Sequence[Key], seed: int = 0, epoch: int | None = None) -> Column:
    """Pseudo-random but repeatable order key of a row."""
    salt = [F.lit(str(seed))] + ([] if epoch is None else [F.lit(str(epoch))])
    return F.md5(F.concat_ws(":", *salt, *[_column(k).cast("string") for k in keys]))


def _orderable(df: DataFrame, order_by: Key | Sequence[Key] | None) -> list[Column]:
    """The stated order as columns; a type without an order is a TypeError."""
    if order_by is None:
        return []
    columns = [_column(k) for k in ([order_by] if isinstance(order_by, (str, Column)) else order_by)]
    for field in df.select(*[c.alias(f"_o{i}") for i, c in enumerate(columns)]).schema.fields:
        if isinstance(field.dataType, (T.MapType, T.VariantType, T.CalendarIntervalType)):
            raise TypeError(f"cannot order by a column of type {field.dataType.simpleString()}")
    return columns


def _laid_out(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows stored in ranges of `order`, sorted, with `_part` and `_at`, the place in it.

    The exchange balances ranges by a sample of the keys, so it is run once and stored.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-rows // RANGE_ROWS), min(cores, rows // 10_000))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = cut_lineage(laid.withColumn("_seq", F.monotonically_increasing_id()))
    # Spark numbers the rows of a partition from its own number times 2**33
    part = F.shiftright("_seq", 33).cast("int")
    return stored.withColumns({"_part": part, "_at": F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_seq")


def _before_parts(laid: DataFrame, weight: str | None = None) -> DataFrame:
    """(_part, _before, _total): one row per range."""
    held = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = laid.groupBy("_part").agg(held.alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_total")
    )


def _encoded(column: Column, kind: T.DataType) -> Column:
    """The column itself, or whole microseconds of a timestamp, so that limits survive the driver."""
    return F.unix_micros(column) if isinstance(kind, T.TimestampType) else column


def _narrowed(df: DataFrame, order: Sequence[Column], start: int, stop: int, total: int) -> tuple[DataFrame, int]:
    """(rows, before): few rows that hold positions start .. stop, and how many come before them.

    Each round samples keys by their hash, picks two around the wanted positions, and counts the
    rows up to them exactly. The bracket moves to whatever side the counts prove.
    """
    kinds = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)]).schema
    names = kinds.names
    key = F.struct(*[_encoded(c, f.dataType).alias(n) for c, n, f in zip(order, names, kinds.fields)])
    schema = df.select(key.alias("k")).schema["k"].dataType
    rows, before, inside = df, 0, total

    def limit(row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])

    for salt in range(MOST_ROUNDS):
        if inside <= max(SLICE_ROWS, 4 * (stop - start)):
            break
        share = min(1.0, PROBES / inside)
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(salt)), F.col("_hash"))), 1, 13), 16, 10).cast("double") / float(16**13)
        sample = rows.filter(drawn < 1.5 * share).select(key.alias("k")).orderBy("k").limit(4 * PROBES).collect()
        if not sample:
            continue
        probes = [tuple(r["k"]) for r in sample]
        slack = 0 if share == 1.0 else min(4 * len(probes) ** 0.5, len(probes) / 4)

        def probe(position: int, aside: float) -> Column | None:
            i = int((position - before) / inside * len(probes) + aside)
            return limit(probes[i]) if 0 <= i < len(probes) else None

        low, high = probe(start, -slack - 1), probe(stop, slack)
        upto = [F.count(F.when(key <= x, 1)) if x is not None else F.lit(0) for x in (low, high)]
        below, through = rows.agg(*[c.alias(f"_c{i}") for i, c in enumerate(upto)]).first()
        if low is not None:
            if before + below <= start:
                rows, before, inside = rows.filter(key > low), before + below, inside - below
                through -= below
            elif before + below >= stop:
                rows, inside = rows.filter(key <= low), below
                continue
        if high is not None and before + through >= stop:
            rows, inside = rows.filter(key <= high), through
    return rows, before


def _keyed(df: DataFrame, keys: Sequence[Key], seed: int, epoch: int | None, digits: int) -> DataFrame:
    """Add `_hash` and its leading digits as `_bucket`; buckets sort like the rows they hold."""
    hashed = df.withColumn("_hash", order_hash(keys, seed, epoch))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, digits))


def _order(keys: Sequence[Key]) -> list[Column]:
    return [F.col("_hash"), *[_column(k) for k in keys]]


def _offsets(keyed: DataFrame, within: Sequence[str], weight: str | None = None) -> DataFrame:
    """(within, _bucket, _n, _before, _total): at most 16**digits rows per group."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = keyed.groupBy(*within, "_bucket").agg(rows.alias("_n"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *within,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )


def rank_rows(
    df: DataFrame,
    keys: Sequence[Key],
    seed: int = 0,
    epoch: int | None = None,
    name: str = "position",
    within: Sequence[str] = (),
    total: str | None = None,
    order_by: Key | Sequence[Key] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in hash order, overall or `within` groups.

    `order_by` names columns of any orderable type that come before the hash (overall only):
    numbers, strings, timestamps, several of them; null first, NaN last.

    `keys` must identify a row. With `within`, a group is ranked bucket by bucket, so
    a group that holds most rows is still spread over many tasks; null is a group too. `total` names an
    extra column with the number of rows ranked together.
    """
    extra = [F.col("_total").alias(total)] if total else []
    if order_by is not None:
        if within:
            raise ValueError("order_by applies to an overall order only")
        order = [*_orderable(df, order_by), *_order(keys)]
        laid = _laid_out(df.withColumn("_hash", order_hash(keys, seed, epoch)), order)
        placed = laid.join(checked_broadcast(_before_parts(laid)), "_part")
        return placed.select(*df.columns, (F.col("_before") + F.col("_at")).alias(name), *extra)
    keyed = _keyed(df, keys, seed, epoch, GROUP_DIGITS if within else GLOBAL_DIGITS)
    if within:
        # a struct is never null itself, so a null group joins its own offsets
        keyed = keyed.withColumn("_group", F.struct(*within))
    group = ["_group"] if within else []
    offsets = _offsets(keyed, group)
    if not within:
        offsets = F.broadcast(offsets)  # at most 16**GLOBAL_DIGITS short rows
    order = Window.partitionBy(*group, "_bucket").orderBy(*_order(keys))
    ranked = keyed.withColumn("_rank", F.row_number().over(order)).join(offsets, [*group, "_bucket"])
    return ranked.select(*df.columns, (F.col("_before") + F.col("_rank") - 1).alias(name), *extra)


def slice_rows(
    df: DataFrame,
    start: int,
    stop: int,
    keys: Sequence[Key],
    seed: int = 0,
    epoch: int | None = None,
    at_least: int = 0,
    order_by: Key | Sequence[Key] | None = None,
) -> DataFrame:
    """Rows whose position in the order of `rank_rows` lies in [start, stop).

    Rows that the range does not touch are dropped while scanning, so only about
    stop - start rows, and those near them, are shuffled and ranked. Fewer than `at_least`
    rows is an error.
    """
    if at_least > 0 and df.isEmpty():  # no row is left for the guard below to fail on
        raise ValueError(f"fewer than {at_least} rows")
    if order_by is not None:
        hashed = df.withColumn("_hash", order_hash(keys, seed, epoch))
        order = [*_orderable(df, order_by), *_order(keys)]
        rows = df.count()
        if rows < at_least:
            raise ValueError(f"fewer than {at_least} rows")
        near, before = _narrowed(hashed, order, start, min(stop, rows), rows)
        ranked = near.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))  # SLICE_ROWS or so
        return ranked.filter((F.col("_rank") > start - before) & (F.col("_rank") <= stop - before)).select(df.columns)
    keyed = _keyed(df, keys, seed, epoch, GLOBAL_DIGITS)
    spans = _offsets(keyed, ()).filter(
        required(F.col("_total") >= at_least, f"fewer than {at_least} rows")
    ).filter((F.col("_before") < stop) & (F.col("_before") + F.col("_n") > start))
    order = Window.partitionBy("_bucket").orderBy(*_order(keys))
    position = F.col("_before") + F.col("_rank") - 1
    return (
        keyed.join(F.broadcast(spans.select("_bucket", "_before")), "_bucket")  # bounded as in rank_rows
        .withColumn("_rank", F.row_number().over(order))
        .filter((position >= start) & (position < stop))
        .select(df.columns)
    )


def _runs(df: DataFrame) -> DataFrame:
    """Distinct rows with `_run` and `_len`: their copies, in runs of at most RUN_LENGTH."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {RUN_LENGTH}")))
    ).withColumn("_len", F.least(F.lit(RUN_LENGTH), F.col("_copies") - F.col("_run") * RUN_LENGTH))


def number_rows(
    df: DataFrame,
    name: str,
    hash_by: Sequence[Key] | None = None,
    seed: int = 0,
    order_by: Key | Sequence[Key] | None = None,
) -> DataFrame:
    """Add distinct numbers 0..n-1 to rows that may repeat.

    With `order_by` the numbers follow those columns, and all others where they are equal.
    Without, they follow a hash of `hash_by`, of all columns by default. Equal rows are
    interchangeable, so they are counted first and handed runs of consecutive numbers. A row
    with many copies becomes several runs in different ranges or buckets; no task unfolds more
    than RUN_LENGTH copies of one row at once.
    """
    columns = df.columns
    runs = _runs(df)
    if order_by is not None:
        order = [*_orderable(df, order_by), *[F.col(c) for c in columns], F.col("_run")]
        keyed = _laid_out(runs, order).withColumnRenamed("_part", "_bucket")
        offsets = checked_broadcast(_before_parts(keyed.withColumnRenamed("_bucket", "_part"), "_len")).withColumnRenamed(
            "_part", "_bucket"
        )
        lead = [F.col("_at")]
    else:
        keys = [_column(k) for k in (hash_by or columns)]
        keyed = _keyed(runs, [*keys, F.col("_run")], seed, None, GLOBAL_DIGITS)
        offsets = F.broadcast(_offsets(keyed, (), "_len"))  # at most 16**GLOBAL_DIGITS short rows
        lead = [F.col("_hash"), *keys, *[F.col(c) for c in columns], F.col("_run")]
    order = Window.partitionBy("_bucket").orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.col("_earlier"), F.lit(0))
    return (
        keyed.withColumn("_earlier", F.sum("_len").over(order))
        .join(offsets, "_bucket")
        .select(*columns, F.explode(F.sequence(first, first + F.col("_len") - 1)).alias(name))
    )
