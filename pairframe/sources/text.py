"""Line-oriented text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairframe.functions.text import split_fields
from pairframe.session import checked_broadcast


def read_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One item per line."""
    return spark.read.text(path).select(F.col("value").alias(name))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value); (file, block, seq) orders lines.

    A scan reads one file block from front to back, so the increasing id orders the
    lines of a block whatever task reads it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """Add `line_no` (0-based, per file).

    The increasing ids of a block are consecutive, so a line's number is its id less the least
    id of its block, plus the lines of earlier blocks. Only one row per block is exchanged; it
    meets the lines in a broadcast join, or a shuffle join where there are very many blocks.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("seq").alias("_least"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least")).alias("_shift"))
    return lines.join(checked_broadcast(starts), ["file", "block"]).select(
        "file", (F.col("seq") + F.col("_shift")).alias("line_no"), "value"
    )


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, genes) from GMT lines: name, an ignored field, then the genes.

    When a name repeats, its last line wins.
    """
    rows = _lines(spark, path).filter(F.col("value") != "").withColumn("_f", split_fields(F.col("value")))
    order = F.struct("file", "block", "seq")
    genes = F.slice("_f", 3, F.greatest(F.size("_f") - 2, F.lit(0)))
    return (
        rows.select(F.get("_f", 0).alias("set_name"), genes.alias("genes"), order.alias("_order"))
        .groupBy("set_name")
        .agg(F.max_by("genes", "_order").alias("genes"))
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    skip_rows: int = 0,
    delimiter: str = "\t",
    n_cols: int | None = None,
    numbered: bool = False,
) -> DataFrame:
    """(fields) per non-blank line, or (file, line_no, fields) when `numbered`.

    The first `skip_rows` raw lines of each file are dropped before blank rows are;
    `n_cols` keeps the leading fields.
    """
    lines = _lines(spark, path)
    if skip_rows or numbered:
        lines = _numbered(lines).filter(F.col("line_no") >= skip_rows)
    rows = lines.withColumn("fields", split_fields(F.col("value"), delimiter)).filter(
        F.exists("fields", lambda f: f != "")
    )
    if n_cols is not None:
        rows = rows.withColumn("fields", F.slice("fields", 1, n_cols))
    return rows.select("file", "line_no", "fields") if numbered else rows.select("fields")
