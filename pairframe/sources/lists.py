"""Named feature lists as a table (list_name, pos, feature)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairframe.sources.text import read_delimited, read_gene_sets

# Names of the lists users refer to. Their contents are input.
LIST_NAMES = ("cgc", "mcg", "lincs", "hallmark")


def feature_lists(spark: SparkSession, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Table from Python lists."""
    rows = [(name, pos, f) for name, items in lists.items() for pos, f in enumerate(items)]
    return spark.createDataFrame(rows, "list_name string, pos int, feature string")


def read_feature_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Table from a text file with one feature per line."""
    rows = read_delimited(spark, path, numbered=True)
    return rows.select(
        F.lit(name).alias("list_name"), F.col("line_no").cast("int").alias("pos"), F.get("fields", 0).alias("feature")
    )


def feature_lists_from_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Table from a GMT file: one list per gene set."""
    return read_gene_sets(spark, path).select(
        F.col("set_name").alias("list_name"), F.posexplode("genes").alias("pos", "feature")
    )
