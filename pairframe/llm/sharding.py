"""Shards of near equal size by histogram sort.

The order of the rows is cut at splitters. Each round counts, over all partitions and
exactly, the rows and bytes below evenly spaced probes inside every interval that still
holds an unmet splitter; a splitter is met when the bytes below it are within the tolerance
of its target, otherwise the bin around the target becomes the next, narrower interval.
Only histograms reach the driver, at most `FIRST_BINS` or `BINS` bins per splitter. When all
splitters are met the rows are exchanged once, by shard and piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pairframe.llm.common import Workspace

FIRST_BITS, BITS = 12, 8
ROWS_PER_PIECE = 200_000
SIGN = -(1 << 63)
TOLERANCE = 0.001


@dataclass(frozen=True)
class Splitter:
    """Rows from `value` on (after it, if not `included`) lie right of the splitter.

    `value` may name only the first key columns; the others then do not matter.
    """

    value: tuple[int, ...]
    included: bool

    def right(self, keys: list[Column]) -> Column:
        *head, last = zip(keys, self.value)
        beyond = last[0] >= last[1] if self.included else last[0] > last[1]
        for key, value in reversed(head):
            beyond = (key > value) | ((key == value) & beyond)
        return beyond


@dataclass
class Interval:
    """Rows whose leading keys equal `prefix` and whose next key lies in low..high."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int
    targets: list[tuple[int, float]]
    bits: int = BITS

    def holds(self, keys: list[Column]) -> Column:
        key = keys[len(self.prefix)]
        inside = (key >= self.low) & (key <= self.high)
        for other, value in zip(keys, self.prefix):
            inside = (other == value) & inside
        return inside

    def bin(self, keys: list[Column]) -> Column:
        """Position between low and high in steps of a power of two, as an unsigned number."""
        shift = max(0, (self.low ^ self.high).bit_length() - self.bits)
        if self.low < 0 <= self.high:
            shift = 64 - self.bits
        return F.shiftrightunsigned(keys[len(self.prefix)].bitwiseXOR(F.lit(SIGN)), shift)


def _tree(items: list, leaf, right) -> Column:
    """Nested conditions of logarithmic depth over ordered items."""
    if len(items) == 1:
        return leaf(items[0])
    middle = len(items) // 2
    return F.when(right(items[middle]), _tree(items[middle:], leaf, right)).otherwise(
        _tree(items[:middle], leaf, right)
    )


def _histogram(rows: DataFrame, keys: list[Column], intervals: list[Interval], size: Column) -> list[list]:
    """Per interval its non-empty bins in order: (bytes, rows, smallest key, largest key)."""

    def cell(i: int) -> Column:
        interval = intervals[i]
        return F.when(
            interval.holds(keys),
            F.struct(F.lit(i).alias("i"), interval.bin(keys).alias("bin"), keys[len(interval.prefix)].alias("key")),
        )

    starts = [Splitter((*i.prefix, i.low), True) for i in intervals]
    found = rows.select(
        _tree(list(range(len(intervals))), cell, lambda i: starts[i].right(keys)).alias("cell"), size.alias("size")
    ).filter("cell is not null")
    bins = [[] for _ in intervals]
    for r in (
        found.groupBy("cell.i", "cell.bin")
        .agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("cell.key").alias("lo"), F.max("cell.key").alias("hi"))
        .collect()
    ):
        bins[r.i].append((r.b, r.n, r.lo, r.hi))
    return [sorted(b, key=lambda x: x[2]) for b in bins]


def find_splitters(
    rows: DataFrame, key_cols: list[str], size_col: str, parts: int, tolerance: float = TOLERANCE
) -> list[Splitter]:
    """`parts` - 1 splitters, in order; fewer when the table is empty.

    A splitter is off its target by at most `tolerance` of a part's bytes, or, where single
    rows are larger than that, by half a row at the most.
    """
    keys, size = [F.col(k) for k in key_cols], F.col(size_col)
    whole = rows.agg(F.sum(size).alias("b"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()
    if whole.b is None:
        return []
    slack = tolerance * whole.b / parts
    targets = [(k, whole.b * k / parts) for k in range(1, parts)]
    intervals = [Interval((), whole.lo, whole.hi, 0, targets, FIRST_BITS)] if targets else []
    met: dict[int, Splitter] = {}
    while intervals:
        finer: dict[tuple, Interval] = {}
        for interval, bins in zip(intervals, _histogram(rows, keys, intervals, size)):
            depth = len(interval.prefix)
            edges = [interval.below]
            for b, *_ in bins:
                edges.append(edges[-1] + b)
            at = 0
            for k, target in interval.targets:
                while at < len(bins) - 1 and edges[at + 1] < target:
                    at += 1
                _, n, low, high = bins[at]
                nearest = at if abs(edges[at] - target) <= abs(edges[at + 1] - target) else at + 1
                last = low == high and depth + 1 == len(keys)
                if abs(edges[nearest] - target) <= slack or n == 1 or last:
                    met[k] = (
                        Splitter((*interval.prefix, bins[nearest][2]), True)
                        if nearest < len(bins)
                        else Splitter((*interval.prefix, bins[-1][3]), False)
                    )
                elif low == high:
                    prefix = (*interval.prefix, low)
                    finer.setdefault(prefix, Interval(prefix, SIGN, ~SIGN, edges[at], [])).targets.append((k, target))
                else:
                    where = (*interval.prefix, low, high)
                    finer.setdefault(where, Interval(interval.prefix, low, high, edges[at], [])).targets.append((k, target))
        intervals = list(finer.values())
    return [met[k] for k in sorted(met)]


def shard(
    docs: DataFrame,
    keys: list[Column],
    size: Column,
    shards: int,
    tolerance: float = TOLERANCE,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """`docs` with `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).

    `keys` are long columns that give the order; null keys sort with the smallest. Rows
    equal in all keys follow the place they were read from, so a large group of them is
    cut as well. Bytes of shards differ by twice the tolerance, or by one row where rows
    are larger than that. Within a shard rows lie in pieces of about `rows_per_piece`,
    chosen by a hash, in key order inside a piece: no task sorts a whole shard. Columns
    named shard or slot are replaced. An empty table stays empty; with fewer rows than
    shards some shards are empty.
    """
    work = Workspace(docs.sparkSession, "shards")
    names = [f"_key{i}" for i in range(len(keys))]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    place = F.xxhash64(F.monotonically_increasing_id())
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        *[F.coalesce(k.cast("long"), F.lit(SIGN)).alias(n) for k, n in zip(keys, names)],
        place.alias("_place"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
    )
    rows = work.save(keyed, "rows")
    order = [*names, "_place"]
    splitters = find_splitters(rows, order, "_size", shards, tolerance)
    columns = [F.col(c) for c in order]
    starts = [None, *splitters]
    number = _tree(list(range(len(starts))), lambda i: F.lit(i), lambda i: starts[i].right(columns))
    pieces = max(1, -(-rows.count() // (shards * rows_per_piece)))
    placed = rows.withColumn("shard", number.cast("int")).withColumn(
        "_piece", F.pmod(F.xxhash64(*order[1:]), F.lit(pieces)).cast("int")
    )
    counts = placed.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "shard",
        "_piece",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece")) - F.col("_n")).alias("_offset"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(*order)) - 1
    ranked = placed.withColumn("_within", within).join(offsets, ["shard", "_piece"])
    return ranked.select(
        *[F.col(f"`{c}`") for c in kept], "shard", (F.col("_offset") + F.col("_within")).alias("slot")
    )


def sharded_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in shards of near equal bytes, ordered by text hash and doc_id.

    Equal texts have one hash, so they lie side by side in the order, in one shard unless
    a splitter has to cut the group.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"),
    )
    placed = shard(narrow, [F.col("text_hash"), F.col("doc_id")], F.col("size"), shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
