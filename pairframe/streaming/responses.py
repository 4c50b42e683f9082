"""Observations as a stream.

The row-wise operators (conform, subset, encode, scale with fitted statistics) take a
streaming table as they are: features and statistics are the static side of a
stream-static join. This module only opens a source and drains it into Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pairframe.operators.observations import as_obs


def read_observation_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, **columns: str
) -> DataFrame:
    """Observation stream over Parquet files that arrive in `folder`.

    `columns` are the source names (`id_col`, `label_col`, `cell_id_col`, `drug_id_col`).
    """
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.parquet(folder)
    if columns.get("id_col", "id") not in rows.columns:
        raise ValueError("a stream cannot be numbered; give its id column")
    return as_obs(rows, **columns)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available now into Parquet at `path` and return it as a table.

    The checkpoint makes a restarted run continue where the last one stopped.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    run = writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.parquet(path)
