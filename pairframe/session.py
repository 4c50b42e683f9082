"""Session helpers: defaults for our own sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BROADCAST_ROWS = 200_000
ROW_VALUES = 8


def build_session(app: str = "pairframe", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and a UTC clock; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even if that costs a later shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in `spark.checkpoint.dir`. A temporary folder is used only
    when that is unset and the whole session lives in one local process.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairframe-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder: the plan restarts there, lost executors or not.

    Unlike a checkpoint of rows the copy can be read column by column and has a known size.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, width: Column | None = None) -> DataFrame:
    """Store a narrow table, measure it, and mark it for broadcast only when it is small.

    `width` is the number of values in a row where its arrays make it wide; the table is small
    if it holds at most BROADCAST_ROWS rows of at most ROW_VALUES values, or as many values in
    wider rows. The other side of a join then stays where it is instead of being shuffled by a
    possibly hot key. A larger table is joined by shuffle, with hot keys split at run time.
    """
    stored = cut_lineage(df)
    rows, values = stored.agg(F.count(F.lit(1)), F.lit(0) if width is None else F.sum(width)).first()
    small = rows <= BROADCAST_ROWS and (values or 0) <= BROADCAST_ROWS * ROW_VALUES
    return F.broadcast(stored) if small else stored
