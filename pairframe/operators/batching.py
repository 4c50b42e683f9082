"""Finite mini-batches over an observation table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairframe.functions.guards import required
from pairframe.operators.ranking import Key, rank_rows, slice_rows
from pairframe.session import cut_lineage

ROWS_PER_FILE = 500_000


@dataclass(frozen=True)
class Batches:
    """Batches of `rows` in a fixed order, or in a new order each epoch when `shuffle`.

    The fixed order is by hash, or by `order_by`: columns of any orderable type, ties by hash.
    Batch k holds positions [k * batch_size, (k + 1) * batch_size); the last may be short.
    `encode` adds features to rows that are already placed, so ordering moves narrow rows.
    """

    rows: DataFrame
    batch_size: int
    shuffle: bool = False
    seed: int = 0
    keys: Sequence[Key] = field(default=("id",))
    encode: Callable[[DataFrame], DataFrame] | None = None
    order_by: Key | Sequence[Key] | None = None

    def _lead(self) -> Key | Sequence[Key] | None:
        return None if self.shuffle else self.order_by

    def _encoded(self, df: DataFrame) -> DataFrame:
        return df if self.encode is None else self.encode(df)

    def _epoch(self, epoch: int) -> int:
        return epoch if self.shuffle else 0

    def count(self) -> DataFrame:
        """One row: n_rows, n_batches."""
        n = F.count(F.lit(1))
        return self.rows.agg(
            n.alias("n_rows"), F.ceil(n / F.lit(self.batch_size)).cast("bigint").alias("n_batches")
        )

    def __len__(self) -> int:
        return self.count().first()["n_batches"]

    def order(self, epoch: int = 0) -> DataFrame:
        """All rows, without features, with their position in the given epoch."""
        return rank_rows(self.rows, self.keys, self.seed, self._epoch(epoch), order_by=self._lead())

    def assign(self, epoch: int = 0) -> DataFrame:
        """All rows with position and batch_id."""
        placed = self.order(epoch).withColumn("batch_id", F.expr(f"position div {int(self.batch_size)}"))
        return self._encoded(placed)

    def batch(self, k: int, epoch: int = 0) -> DataFrame:
        """Rows of batch `k`; a batch past the end is an error when it runs."""
        if k < 0:
            raise IndexError(f"batch {k} is out of range")
        first = k * self.batch_size
        rows = slice_rows(
            self.rows,
            first,
            first + self.batch_size,
            self.keys,
            self.seed,
            self._epoch(epoch),
            at_least=first + 1,
            order_by=self._lead(),
        )
        return self._encoded(rows)

    def write(self, path: str, epoch: int = 0, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Encoded batches as Parquet for a trainer, with an index of the files.

        Files hold whole batches, consecutive and ordered inside, about `rows_per_file` rows
        each, however many batches that is. `read_batch` opens only the file of its batch.
        """
        placed = self.order(epoch).withColumn("batch_id", F.expr(f"position div {int(self.batch_size)}"))
        placed = cut_lineage(placed)
        files = max(1, -(-placed.count() // rows_per_file))
        ordered = self._encoded(placed).repartitionByRange(files, "batch_id").sortWithinPartitions("batch_id", "position")
        ordered.write.parquet(f"{path}/rows")
        rows = placed.sparkSession.read.parquet(f"{path}/rows")
        index = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count(F.lit(1)).alias("n_rows")
        )
        index.coalesce(1).write.parquet(f"{path}/index")  # one row per file


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of stored batches with their position and batch_id."""
    return spark.read.parquet(f"{path}/rows")


def read_batch(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Rows of one stored batch, from the files that the index names; none is an IndexError."""
    index = spark.read.parquet(f"{path}/index")
    held = index.filter((F.col("first_batch") <= k) & (F.col("last_batch") >= k)).select("file").collect()
    if not held:
        raise IndexError(f"batch {k} is not stored")
    return spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in held]).filter(F.col("batch_id") == k)


def batch_rows(
    obs: DataFrame, targets: str | None = "label", sample_weights: str | Column | None = None, strict: bool = True
) -> DataFrame:
    """(id, cell_id, drug_id, target, weight) rows for batching; nulls where not given."""
    weight = F.col(sample_weights) if isinstance(sample_weights, str) else sample_weights
    rows = obs.select(
        "id",
        "cell_id",
        "drug_id",
        (F.lit(None).cast("double") if targets is None else F.col(targets)).alias("target"),
        (F.lit(None).cast("double") if weight is None else weight).alias("weight"),
    )
    if strict:
        whole = F.col("cell_id").isNotNull() & F.col("drug_id").isNotNull()
        if targets is not None:
            whole = whole & F.col("target").isNotNull()
        if weight is not None:
            whole = whole & F.col("weight").isNotNull()
        rows = rows.filter(required(whole, "missing id, target or weight"))
    return rows
