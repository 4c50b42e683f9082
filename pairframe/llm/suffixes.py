"""Repeated byte strings by distributed prefix doubling on a sparse set of positions.

A string of `length` bytes is repeated if it also starts in a document with a smaller id.
Positions get names (hashes) of growing length, each from two names of half the length at
an offset, and a name that no second document shares is unique: its position leaves. Three
exchanges do that, with names packed into arrays per bucket of hashes:

1. Every window of `length` bytes has one anchor, the smallest 26-byte name in it, so equal
   windows have equal anchors. Only anchors are exchanged, about one in 13 positions.
2. Around each anchor that two documents share, the names of 38 bytes to the left and to the
   right are exchanged; a window whose side is unique leaves.
3. What is left are windows of full length; the smallest document of each name decides. The
   open windows come back with the answers, a bit each, so they are not found a second time.

Short names are exchanged as 32 bits inside their bucket: a chance match keeps a position
for the next round and costs nothing else. Full names have 64 bits. Texts are stored once,
in buckets by block, so that answers come back to them without a shuffle of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairframe.llm.common import Workspace
from pairframe.llm.shingles import mix

LENGTH = 50
ANCHOR = 26
SIDE = (LENGTH - ANCHOR) // 2
BLOCK_BYTES = 2 << 20
NAMES_PER_BUCKET = 4_000_000

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = 0xD6E8FEB86659FD93
LOWEST = -(1 << 63)


def names(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of all substrings of the given lengths, by doubling."""
    with np.errstate(over="ignore"):
        doubled = {1: _BYTES[data]}
        size = 1
        while size * 2 <= max(lengths):
            half = doubled[size]
            factor = np.uint64(pow(_FACTOR, size, 1 << 64))
            doubled[size * 2] = half[:-size] * factor + half[size:]
            size *= 2
        result = {}
        for length in lengths:
            total, done = None, 0
            for size in sorted(doubled, reverse=True):
                if length & size:
                    n = len(data) - length + 1
                    piece = doubled[size][done : done + n]
                    total = piece if total is None else total * np.uint64(pow(_FACTOR, size, 1 << 64)) + piece
                    done += size
            result[length] = mix(total)
        return result


class Block:
    """The texts of a block, end to end, and the windows inside single documents."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        self.ids = table.column("doc_id").to_numpy()[order]
        self.hashes = table.column("text_hash").to_numpy()[order]
        texts = [table.column("text")[int(i)].as_py().encode("utf-8", "surrogatepass") for i in order]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.number = table.column("block")[0].as_py()
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = len(self.data) - LENGTH + 1
        self.windows = np.flatnonzero(self.doc[:n] == self.doc[LENGTH - 1 :]) if n > 0 else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Per window the place of its smallest anchor name (the first of equal ones), and all names."""
        name = names(self.data, (ANCHOR,))[ANCHOR]
        width, span = LENGTH - ANCHOR + 1, 1
        least, place = name, np.arange(len(name), dtype=np.int32)
        while span < width:
            step = min(span, width - span)
            first = least[:-step] <= least[step:]
            place = np.where(first, place[:-step], place[step:])
            least = np.minimum(least[:-step], least[step:])
            span += step
        return place[self.windows], name

    def unique(self, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, the place of each input in them, and whether two documents of the block have it."""
        distinct, place = np.unique(name, return_inverse=True)
        low, high = np.full(len(distinct), len(self.ids)), np.full(len(distinct), -1)  # documents are in order of id
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        return distinct, place, self.ids[low] != self.ids[high] if len(distinct) else np.zeros(0, bool)


def _edges(distinct: np.ndarray, buckets: int) -> np.ndarray:
    step = (1 << 64) // buckets + 1
    starts = np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(distinct, starts), len(distinct))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and the run of each value."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


ASKED = "bucket bigint, block bigint, names binary, extra binary"
ANSWERED = "block bigint, round int, bucket bigint, bits binary"


def _ask(block: Block, distinct: np.ndarray, extra: np.ndarray, buckets: int, short: bool) -> pa.Table:
    edges = _edges(distinct, buckets)
    held = np.flatnonzero(np.diff(edges))
    parts = [distinct[edges[b] : edges[b + 1]] for b in held]
    if short:
        parts = [(p & np.uint64(0xFFFFFFFF)).astype(np.uint32) for p in parts]
    return pa.table(
        {
            "bucket": pa.array(held, pa.int64()),
            "block": pa.array([block.number] * len(held), pa.int64()),
            "names": pa.array([p.tobytes() for p in parts], pa.binary()),
            "extra": pa.array([extra[edges[b] : edges[b + 1]].tobytes() for b in held], pa.binary()),
        }
    )


#: The number under which a block's open windows travel beside the answers of the last round.
OPEN = 4


def _open_windows(block: Block, left: np.ndarray) -> pa.Table:
    """One row that is its own bucket: a bit per window of the block, set if it is still open."""
    bits = np.packbits(np.isin(block.windows, left, assume_unique=True))
    return pa.table(
        {
            "bucket": pa.array([-1 - block.number], pa.int64()),
            "block": pa.array([block.number], pa.int64()),
            "names": pa.array([bits.tobytes()], pa.binary()),
            "extra": pa.array([b""], pa.binary()),
        }
    )


def _answer(round_: int, table: pa.Table) -> pa.Table:
    """Per request one bit for each name: shared by two documents or, in the last round, by a smaller one.

    A row with a block's open windows is handed on as it is.
    """
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        return pa.table(
            {
                "block": table.column("block"),
                "round": pa.array([OPEN] * table.num_rows, pa.int32()),
                "bucket": table.column("bucket"),
                "bits": table.column("names"),
            }
        )
    kind, extra_kind = (np.uint64, np.int64) if round_ == 3 else (np.uint32, np.bool_)
    asked = [np.frombuffer(x.as_py(), kind) for x in table.column("names")]
    extra = np.concatenate([np.frombuffer(x.as_py(), extra_kind) for x in table.column("extra")])
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    if round_ == 3:
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, place, extra)
        yes = least[place] < extra
    else:
        yes = (np.bincount(place, 1 + extra.astype(np.int64), len(distinct)) > 1)[place]
    bits = [np.packbits(b).tobytes() for b in np.split(yes, np.cumsum([len(a) for a in asked])[:-1])]
    n = len(asked)
    return pa.table(
        {
            "block": table.column("block"),
            "round": pa.array([round_] * n, pa.int32()),
            "bucket": table.column("bucket"),
            "bits": pa.array(bits, pa.binary()),
        }
    )


def _read(answers: pa.Table, round_: int, distinct: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of a round, in the order of the block's distinct names."""
    edges = _edges(distinct, buckets)
    yes = np.zeros(len(distinct), bool)
    rounds, numbers = answers.column("round").to_numpy(), answers.column("bucket").to_numpy()
    for i in np.flatnonzero(rounds == round_):
        low, high = edges[numbers[i]], edges[numbers[i] + 1]
        yes[low:high] = np.unpackbits(np.frombuffer(answers.column("bits")[int(i)].as_py(), np.uint8), count=high - low).astype(bool)
    return yes


class Rounds:
    """The windows of a block that are left before each round, recomputed from its texts and answers."""

    def __init__(self, block: Block, buckets: int):
        self.block, self.buckets = block, buckets

    def first(self):
        block = self.block
        if not len(block.windows):
            return np.empty(0, np.uint64), np.empty(0, bool)
        self.anchor, name = block.anchors()
        # neighbouring windows mostly share their anchor: one look-up for each run
        starts, self.run = _runs(self.anchor)
        distinct, self.place, several = block.unique(name[self.anchor[starts]], block.doc[block.windows[starts]])
        return distinct, several

    def second(self, shared: np.ndarray):
        block = self.block
        keep = shared[self.place][self.run]
        self.left, self.anchor = block.windows[keep], self.anchor[keep]
        side_name = names(block.data, (ANCHOR + SIDE,))[ANCHOR + SIDE]
        # a window with its anchor far inside holds the left side, one with it near its start the right side
        at = np.where(self.anchor - self.left >= SIDE, self.anchor - SIDE, self.anchor)
        starts, self.run = _runs(at)
        distinct, self.place, several = block.unique(side_name[at[starts]], block.doc[self.left[starts]])
        return distinct, several

    def third(self, shared: np.ndarray):
        self.left = self.left[shared[self.place][self.run]]
        return self.named()

    def resumed(self, answers: pa.Table):
        """As `third`, from the windows it left open."""
        rows = np.flatnonzero(answers.column("round").to_numpy() == OPEN)
        bits = np.frombuffer(answers.column("bits")[int(rows[0])].as_py(), np.uint8)
        self.left = self.block.windows[np.unpackbits(bits, count=len(self.block.windows)).astype(bool)]
        return self.named()

    def named(self):
        block = self.block
        full = names(block.data, (LENGTH,))[LENGTH][self.left]
        distinct, self.place = np.unique(full, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, self.place, block.ids[block.doc[self.left]])
        self.least = least
        return distinct, least

    def repeated(self, smaller: np.ndarray) -> np.ndarray:
        block = self.block
        own = block.ids[block.doc[self.left]]
        return self.left[smaller[self.place] | (own > self.least[self.place])]


def _spans(block: Block, hits: np.ndarray) -> pa.Table:
    """Removed bytes, runs and the digest of what is kept, per document of the block."""
    change = np.zeros(len(block.data) + 1, np.int64)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed, spans, digests = [], [], []
    for start, size in zip(block.starts, block.sizes):
        part = gone[start : start + size]
        removed.append(int(part.sum()))
        spans.append(int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()))
        digests.append(hashlib.sha256(block.data[start : start + size][~part].tobytes()).hexdigest())
    return pa.table(
        {
            "doc_id": pa.array(block.ids, pa.int64()),
            "text_hash": pa.array(block.hashes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte goes if a string of `LENGTH` bytes over it also starts in a document with a
    smaller id; strings are those of the input. Null texts are empty; texts shorter than
    the length lose nothing. Equal texts are looked at once, for the smallest id; rows of
    equal id do not remove each other's bytes, and null ids are the smallest.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sized = narrow.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"))
    rows_of = sized.groupBy("text_hash", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    least = F.min(F.struct("doc_id", "copies"))
    firsts = rows_of.groupBy("text_hash").agg(least["doc_id"].alias("first"), least["copies"].alias("copies"), F.max("n_bytes").alias("n_bytes"))
    firsts = work.save(firsts, "firsts")
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(4, -(-total // (13 * NAMES_PER_BUCKET)) * 4)

    wanted = firsts.filter(F.col("n_bytes") >= LENGTH).select("text_hash", F.col("first").alias("doc_id"), "copies")
    block = F.pmod(F.xxhash64("text_hash"), F.lit(n_blocks))
    several = wanted.filter("copies > 1")
    texts = narrow.join(wanted if several.isEmpty() else wanted.filter("copies = 1"), ["text_hash", "doc_id"])
    if not several.isEmpty():
        # rows that repeat the smallest id of their text are one document
        texts = texts.unionByName(narrow.join(several, ["text_hash", "doc_id"]).dropDuplicates(["text_hash", "doc_id"]))
    texts = texts.drop("copies").withColumn("block", block)
    # a block's texts need no shuffle to meet its answers
    stored = work.save_bucketed(texts, "texts", "block", n_blocks)

    def emit1(table: pa.Table) -> pa.Table:
        block = Block(table)
        return _ask(block, *Rounds(block, buckets).first(), buckets, True)

    def emit2(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        rounds = Rounds(block, buckets)
        distinct, _ = rounds.first()
        if not len(block.windows):
            return _ask(block, np.empty(0, np.uint64), np.empty(0, bool), buckets, True)
        return _ask(block, *rounds.second(_read(answers, 1, distinct, buckets)), buckets, True)

    def emit3(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        rounds = Rounds(block, buckets)
        distinct, _ = rounds.first()
        if not len(block.windows):
            return _ask(block, np.empty(0, np.uint64), np.empty(0, np.int64), buckets, False)
        distinct, _ = rounds.second(_read(answers, 1, distinct, buckets))
        asked = _ask(block, *rounds.third(_read(answers, 2, distinct, buckets)), buckets, False)
        return pa.concat_tables([asked, _open_windows(block, rounds.left)])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        if not len(block.windows):
            return _spans(block, np.empty(0, np.int64))
        rounds = Rounds(block, buckets)
        distinct, _ = rounds.resumed(answers)
        return _spans(block, rounds.repeated(_read(answers, 3, distinct, buckets)))

    of_block = stored.groupBy("block")

    def answers_to(asked: DataFrame, round_: int) -> DataFrame:
        answered = asked.groupBy("bucket").applyInArrow(lambda table: _answer(round_, table), ANSWERED)
        return work.save(answered, f"answers-{round_}")

    answers = answers_to(of_block.applyInArrow(emit1, ASKED), 1)
    for round_, emit in ((2, emit2), (3, emit3)):
        asked = of_block.cogroup(answers.groupBy("block")).applyInArrow(emit_if_texts(emit, ASKED), ASKED)
        answers = answers.unionByName(answers_to(asked, round_))
    kinds = "doc_id bigint, text_hash bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = of_block.cogroup(answers.groupBy("block")).applyInArrow(emit_if_texts(finish, kinds), kinds)
    found = work.save(found, "found").drop("doc_id")

    # every row by its text: a later copy goes as a whole, the others share the result of the first
    empty = hashlib.sha256(b"").hexdigest()
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"),
    )
    joined = rows.join(firsts.select("text_hash", "first"), "text_hash").join(found, "text_hash", "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def emit_if_texts(task, schema: str):
    """A cogroup task that ignores answers without texts (there are none but for an empty side)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def guarded(table: pa.Table, answers: pa.Table) -> pa.Table:
        return task(table, answers) if table.num_rows else arrow.empty_table()

    return guarded
