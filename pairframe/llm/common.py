"""Helpers shared by the operators: stored stages, connected components, text tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairframe.session import shared_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers import the functions they run. Where the package is not installed on the
    executors and not on their path, Spark hands them this archive.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)


class Workspace:
    """Stages of one run as Parquet under the shared folder.

    A stored stage ends the lineage: a lost executor costs only the tasks of the stage
    that runs. `drop` removes a stage that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []
        self.tables: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        self.paths.append(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored.stage_path = path
        return stored

    def save_bucketed(self, df: DataFrame, name: str, column: str, buckets: int, shuffle: bool = True) -> DataFrame:
        """A stage stored in buckets of a column: grouping by it again needs no shuffle.

        With `shuffle` a bucket is one file. Without, each task writes its rows where they
        are, one file per bucket it has rows of; that suits a few large rows.
        """
        table = f"{name}_{uuid4().hex}"
        path = f"{self.root}/{name}"
        rows = df.repartition(buckets, column) if shuffle else df
        rows.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
        self.paths.append(path)
        self.tables[path] = table
        stored = self.spark.table(table)
        stored.stage_path = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Delete stages that nothing reads any more."""
        for df in stored:
            self._delete(df.stage_path)

    def keep_only(self, *stored: DataFrame) -> None:
        """Delete all stages of this workspace but these."""
        kept = {df.stage_path for df in stored}
        for path in self.paths:
            if path not in kept:
                self._delete(path)
        self.paths = [p for p in self.paths if p in kept]

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that have ended; it does so when their
        objects are collected, which a driver with room to spare may put off for long."""
        self.spark._jvm.System.gc()

    def _delete(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns can have any name."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `packed` again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, so no character changes its length or its class."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan with at least one partition per core; only a table of few row groups is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def components(work: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node it reaches.

    Alternating steps on the edge list: each node sends its larger neighbours, then its
    smaller ones, to the smallest neighbour, until every edge ends in a root. Each step is
    one aggregation and one join on the node, stored before the next; chains halve.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    current = work.save(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # every larger neighbour of a node goes to the smallest of its neighbourhood
        twice = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = twice.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.save(
            twice.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        # every smaller neighbour goes to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        ))).filter("u <> v").distinct()
        small = work.save(pairs, "small")
        done = small.exceptAll(current).isEmpty() and current.exceptAll(small).isEmpty()
        work.drop(current)
        work.drop(large)
        current = small
        if done:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
