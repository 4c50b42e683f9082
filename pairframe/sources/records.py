"""CSV by RFC 4180, read by many tasks also where fields hold line ends.

A file is scanned in byte ranges. Whether a range begins inside a quoted field is not known to
the task that reads it, so a first pass maps every range to a function of that state: the state
it ends in when it begins outside, and when it begins inside. One row per range, composed in
file order, fixes where each range begins. If no field holds a line end, which the same pass
tells, Spark's own reader splits the files. Otherwise the ranges are read once more: whole
records are put together where they lie, and the pieces of a record that crosses ranges, at
most two per range, are joined afterwards.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pairframe.functions.guards import required
from pairframe.session import BROADCAST_ROWS, cut_lineage

QUOTE, SEPARATOR = '"', ","
#: Doubled quotes stand for one; every part file's header is checked.
OPTIONS = {"header": True, "quote": QUOTE, "escape": QUOTE, "enforceSchema": False, "maxCharsPerColumn": -1}
WHOLE, HEAD, TAIL = 0, 1, 2


def still_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after a line that begins `inside` one or at a record."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):  # a quote opens a field only as its first character
                at = line.find(SEPARATOR + QUOTE, at) + 1
                if not at:
                    return False
            at += 1
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if not line.startswith(QUOTE, at + 1):
                break
            at += 2
        inside = False
        at = line.find(SEPARATOR, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): physical lines; those of a block come together and in order."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first record of one file; reads as many lines as it has."""
    wanted = 1
    while True:
        lines = [r["value"].removesuffix("\r") for r in spark.read.text(path, lineSep="\n").take(wanted)]
        if not lines:
            raise ValueError(f"no header in {path}")
        state, used = False, 0
        for used, line in enumerate(lines, 1):
            state = still_open(line, state)
            if not state:
                break
        if not state or len(lines) < wanted:
            return next(csv.reader(["\n".join(lines[:used]) + "\n"]), [])
        wanted *= 8


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, block, after_outside, after_inside, spans) of every block with a quote."""

    def compose(batches: Iterator[pa.RecordBatch]):
        now, outside, inside, spans = None, False, True, False
        for batch in batches:
            out = []
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != now:
                    if now:
                        out.append((*now, outside, inside, spans))
                    now, outside, inside, spans = (file, block), False, True, False
                outside, inside = still_open(line, outside), still_open(line, inside)
                spans = spans or outside or "\r" in line[:-1]
            yield _as_batch(out)
        yield _as_batch([(*now, outside, inside, spans)] if now else [])

    def _as_batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], schema=kinds)

    kinds = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("after_outside", pa.bool_()), ("after_inside", pa.bool_()), ("spans", pa.bool_())]
    )
    quoted = lines.filter(F.contains("value", F.lit(QUOTE)))
    return quoted.mapInArrow(compose, "file string, block bigint, after_outside boolean, after_inside boolean, spans boolean")


def _open_blocks(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, block) of the blocks that begin inside a quoted field.

    A range keeps the state, flips it or sets it. The state before a range is that of the last
    one that set it, flipped as often as ranges since then flip.
    """
    blocks = lines.select("file", "block").distinct().join(ranges, ["file", "block"], "left")
    sets = F.col("after_outside") == F.col("after_inside")
    flips = (F.col("after_outside") & ~F.col("after_inside")).cast("int")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    counted = blocks.withColumn("flipped", F.sum(F.coalesce(flips, F.lit(0))).over(upto)).withColumn(
        "last", F.max(F.when(sets, F.struct("block", "after_outside", "flipped"))).over(earlier)
    )
    since = F.coalesce(F.lag("flipped").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    flipped = (since - F.coalesce(F.col("last.flipped"), F.lit(0))) % 2 == 1
    begins = F.coalesce(F.col("last.after_outside"), F.lit(False)) != flipped
    return counted.select("file", "block", begins.alias("begins")).filter("begins")


def _pieces(lines: DataFrame) -> DataFrame:
    """(file, block, kind, first, value): whole records of each block and what crosses its ends."""

    def assemble(batches: Iterator[pa.RecordBatch]):
        now, held, state, kind, first = None, [], False, WHOLE, False
        for batch in batches:
            out = []
            for file, block, line, begins in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, block) != now:
                    if held:  # the block ends inside a record
                        out.append((*now, HEAD if kind == HEAD else TAIL, first, "\n".join(held)))
                    now, held, state = (file, block), [], begins
                    kind, first = (HEAD if begins else WHOLE), block == 0
                held.append(line)
                state = still_open(line, state)
                if not state:
                    out.append((*now, kind, first, "\n".join(held)))
                    held, kind, first = [], WHOLE, False
            yield _as_batch(out)
        yield _as_batch([(*now, HEAD if kind == HEAD else TAIL, first, "\n".join(held))] if held else [])

    def _as_batch(rows):
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "kind", "first", "value"])

    return lines.mapInArrow(assemble, "file string, block bigint, kind int, first boolean, value string")


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(first, value): every record of the files with the line ends of its fields, and whether it
    is the first of its file. None where every line is a record.
    """
    lines = _lines(spark, path)
    ranges = cut_lineage(_ranges(lines))
    if ranges.filter("spans").isEmpty():
        return None
    opened = cut_lineage(_open_blocks(lines, ranges))
    if opened.count() <= BROADCAST_ROWS:
        marked = lines.join(F.broadcast(opened), ["file", "block"], "left")
    else:  # too many to send around: the lines are exchanged and put in order again
        numbered = lines.withColumn("seq", F.monotonically_increasing_id())
        marked = numbered.join(opened, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "seq")
    begins = F.coalesce(F.col("begins"), F.lit(False))
    pieces = cut_lineage(_pieces(marked.select("file", "block", "value", begins.alias("begins"))))
    edge = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        edge.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
        .groupBy("file", "record")
        .agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"))
        .select("first", F.array_join("parts.value", "\n").alias("value"))
    )
    every = pieces.filter(F.col("kind") == WHOLE).select("first", "value").unionByName(joined)
    whole = every.select("first", F.regexp_replace("value", "\r$", "").alias("value"))
    return whole.filter(F.col("first") | (F.col("value") != ""))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Records of CSV files with a header. A malformed record is an error, or null values
    without `strict`; blank lines are skipped.

    Records end with a line feed, or a carriage return before it; fields may hold both.
    """
    options = {**OPTIONS, "mode": "FAILFAST" if strict else "PERMISSIVE", "maxColumns": len(schema.fields) + 1}
    found = records(spark, path)
    if found is None:
        return spark.read.options(**options).schema(schema).csv(path)
    options = {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema")} | {"multiLine": "true"}
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema.fields))])
    first = F.from_csv("value", _ddl(names), options)
    same = F.lit(True)
    for i, field in enumerate(schema.fields):
        same = same & (F.coalesce(first.getField(f"c{i}"), F.lit("")) == field.name)
    checked = found.filter(required(~F.col("first") | same, f"the header of a file in {path} differs"))
    typed = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    rows = checked.filter(~F.col("first")).select(F.from_csv("value", _ddl(typed), options).alias("_record"))
    return rows.select("_record.*").toDF(*schema.names)
