"""Stored splits: a Parquet table (fold, role, id), parts that make folds, or lists of ids in files.

Parts keep every id once: fold f tests part f - 1, validates on the next part and trains on
all others. Roles follow from (fold, part) when they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairframe.functions.guards import required

#: Name of a list file: role, fold, and any suffix.
LIST_NAME = r"/(train|val|test)_([0-9]+)(\.[^/]*)?$"
ROLES = ("train", "val", "test")


@dataclass(frozen=True)
class Split:
    """One fold: tables of ids."""

    train_ids: DataFrame
    val_ids: DataFrame
    test_ids: DataFrame


def save_splits(splits: DataFrame, path: str) -> None:
    """One folder per fold and role, so a single fold is read alone.

    Rebalancing gathers each folder's rows but splits a large one over several tasks.
    """
    rows = splits.select("fold", "role", "id").hint("rebalance", "fold", "role")
    rows.write.partitionBy("fold", "role").parquet(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """All folds as (fold, role, id)."""
    return spark.read.parquet(path).select("fold", "role", "id")


def load_split(spark: SparkSession, path: str, fold: int) -> Split:
    """The id tables of one fold; an unknown fold is a KeyError."""
    rows = load_splits(spark, path).filter(F.col("fold") == fold)
    if rows.isEmpty():
        raise KeyError(fold)
    return Split(*[rows.filter(F.col("role") == role).select("id") for role in ROLES])


def save_parts(parts: DataFrame, path: str) -> None:
    """(id, part) once per id, a folder per part, so that a fold's test ids are read alone."""
    parts.select("id", "part").hint("rebalance", "part").write.partitionBy("part").parquet(path)


def _role_of(fold: Column, part: Column, folds: int) -> Column:
    return F.when(part == fold - 1, "test").when(part == fold % folds, "val").otherwise("train")


def load_parts(spark: SparkSession, path: str, folds: int = 10) -> DataFrame:
    """All folds of stored parts as (fold, role, id); nothing but the parts is read or stored."""
    rows = spark.read.parquet(path).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return rows.select("fold", _role_of(F.col("fold"), F.col("part"), folds).alias("role"), "id")


def load_fold(spark: SparkSession, path: str, fold: int, folds: int = 10) -> Split:
    """The id tables of one fold of stored parts; an unknown fold is a KeyError."""
    if not 1 <= fold <= folds:
        raise KeyError(fold)
    rows = spark.read.parquet(path)
    wanted = {"test": F.col("part") == fold - 1, "val": F.col("part") == fold % folds}
    wanted["train"] = ~(wanted["test"] | wanted["val"])
    return Split(*[rows.filter(wanted[role]).select("id") for role in ROLES])


def read_split_lists(spark: SparkSession, folder: str, id_type: str = "string") -> DataFrame:
    """(fold, role, id) from text lists `train_<k>`, `val_<k>`, `test_<k>`, one id per line.

    Fold and role come from the file names; a list may be a file or a folder of part files, with
    any suffix. Other files are ignored, blank lines too. An id that is not of `id_type` fails.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "")
    named = lines.select(
        F.regexp_extract(path, LIST_NAME, 2).alias("fold"), F.regexp_extract(path, LIST_NAME, 1).alias("role"), F.trim("value").alias("text")
    ).filter((F.col("fold") != "") & (F.col("text") != ""))
    value = F.col("text").try_cast(id_type)
    return named.filter(required(value.isNotNull(), "a list holds an id of another type")).select(
        F.col("fold").cast("int").alias("fold"), "role", value.alias("id")
    )


def write_split_lists(splits: DataFrame, folder: str) -> None:
    """(fold, role, id) as text lists, one folder per fold and role."""
    rows = splits.select(F.concat_ws("_", "role", F.col("fold").cast("string")).alias("list"), F.col("id").cast("string").alias("value"))
    for name in [r["list"] for r in rows.select("list").distinct().collect()]:  # three per fold
        rows.filter(F.col("list") == name).select("value").write.text(f"{folder}/{name}")
