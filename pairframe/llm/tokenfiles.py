"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents, each followed by the end id, as little-endian
unsigned 32-bit integers. They are cut into frames of about `FRAME_IDS` ids, at the end of a
document where one fits and inside a longer one. Each frame is compressed on its own. The file
ends with the seek table of the public zstandard seekable format: a skippable frame with the
sizes of every frame and a checksum of its content, and a footer that tells their number. Any
zstandard reader decompresses the whole file; ours reads the table and then only the frames
that hold the wanted documents, and checks each of them.

Files are written where Spark sorted the rows: one task, one file, under a new name per attempt.
The index table that Spark commits names the files of the attempts that succeeded, so what a
lost executor leaves behind is never read.
"""

from __future__ import annotations

import json
import struct
from array import array
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairframe.llm.bpe import byte_letters, default_vocabulary
from pairframe.llm.common import Workspace, ship_package

FILE_BYTES = 32 << 20
FRAME_IDS = 32_768
READ_IDS = 1 << 20
END_ID = 0
LEVEL = 3

# Fixed values of the public seekable format, and the words of byte-level vocabularies.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
FOOTER = struct.Struct("<IBI")


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Appends ids to a stream as frames; `close` adds the seek table."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard

        self.stream, self.frame_ids = stream, frame_ids
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.open = array("I")
        self.entries: list[tuple[int, int, int]] = []

    def add(self, ids: array) -> None:
        """One document; a frame is closed when its ids are enough."""
        self.open.extend(ids)
        while len(self.open) >= 2 * self.frame_ids:
            self._flush(self.frame_ids)
        if len(self.open) >= self.frame_ids:
            self._flush(len(self.open))

    def _flush(self, n: int) -> None:
        content = np.asarray(self.open[:n], "<u4").tobytes()
        packed = self.compress(content)
        self.stream.write(packed)
        self.entries.append((len(packed), len(content), _checksum(content)))
        del self.open[:n]

    def close(self) -> None:
        if self.open:
            self._flush(len(self.open))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads runs of ids from a file; only the frames that hold them are fetched and checked."""

    def __init__(self, file):
        import zstandard

        self.file = file
        size = file.size()
        frames, flags, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = frames * ENTRY.itemsize + FOOTER.size
        head = file.read_at(length + 8, size - length - 8)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE, length):
            raise ValueError("the seek table has a wrong size")
        self.entries = np.frombuffer(head, ENTRY, frames, 8)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["size"].astype(np.int64) // 4)])
        self.places = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _frame(self, i: int) -> bytes:
        if self.held[0] != i:
            entry = self.entries[i]
            packed = self.file.read_at(int(entry["packed"]), int(self.places[i]))
            content = self.decompress(packed, max_output_size=int(entry["size"]))
            if len(content) != entry["size"] or _checksum(content) != entry["checksum"]:
                raise ValueError(f"frame {i} does not match its checksum")
            self.held = (i, content)
            self.frames_read += 1
        return self.held[1]

    def read(self, start: int, n: int) -> bytes:
        """Ids start .. start + n of the file as little-endian bytes."""
        parts, stop = [], start + n
        i = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < stop:
            upto = min(stop, int(self.starts[i + 1]))
            parts.append(self._frame(i)[4 * (start - int(self.starts[i])) : 4 * (upto - int(self.starts[i]))])
            start, i = upto, i + 1
        return b"".join(parts)


_ENCODERS: dict[str, object] = {}


def library_encoder(path: str):
    """Function text -> ids that equals the tokenizers library on a byte-level vocabulary file.

    The ids are made by tiktoken from the ranks in the same file, at about a quarter of the
    time. A file whose ids do not follow the order of its merges, and a text that its pattern
    engine cannot cut, are left to the tokenizers library itself.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _encoder(path)
    return _ENCODERS[path]


def _encoder(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def by_library(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary = spec["model"]["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return by_library
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    special = {token["content"]: token["id"] for token in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def by_ranks(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # a run of white space too long for its pattern engine
            return by_library(text)

    return by_ranks


_INDEX_SCHEMA = "doc_id bigint, part int, file string, at bigint, n_tokens bigint"


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
    frame_ids: int = FRAME_IDS,
) -> None:
    """Files of all documents (doc_id, text) in ascending doc_id, and their index, under `folder`.

    Null doc_ids come first; rows of one doc_id are ordered by a hash of their text. A null or
    empty text is the end id alone. Rows are exchanged once, by ranges of doc_id; the number of
    files follows the bytes of the texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(spark.sparkContext.defaultParallelism, -(-held // (1 << 20)))
    files = max(1, least, -(-held // file_bytes))
    keyed = texts.withColumn("_tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def write(batches):
        encode, part = library_encoder(path), TaskContext.get().partitionId()
        target = writer = None
        at, name = 0, f"{part:06d}-{uuid4().hex}.ids.zst"
        for batch in batches:
            if batch.num_rows and writer is None:
                system, base = fs.FileSystem.from_uri(f"{folder}/ids")
                system.create_dir(base, recursive=True)
                target = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = FrameWriter(target, frame_ids)
            starts, sizes = [], []
            for text in batch.column(1):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                writer.add(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "part", "file", "at", "n_tokens"],
            )
        if writer:
            writer.close()
            target.close()

    ordered.select("doc_id", "text").mapInArrow(write, _INDEX_SCHEMA).write.parquet(f"{folder}/index")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, at, start, n_tokens): where each document lies, and the ids of all before it."""
    index = spark.read.schema(_INDEX_SCHEMA).parquet(f"{folder}/index")
    # one row per file
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    return index.join(starts, "part").select("doc_id", "file", "at", (F.col("before") + F.col("at")).alias("start"), "n_tokens")


def read_token_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids are little-endian bytes with the end id.

    `wanted` (first column: doc_ids) restricts the reading to those documents: files without
    one are not opened, frames without one are not decompressed. A frame that does not match
    its checksum fails the job.
    """
    ship_package(spark)
    index = token_index(spark, folder)
    if wanted is not None:
        index = index.join(wanted.select(F.col(wanted.columns[0]).alias("doc_id")).distinct(), "doc_id", "left_semi")
    # neighbours in a file are read by one task, in order; a stated number, since index rows are
    # small and would otherwise be gathered into few tasks
    files = max(1, index.select("file").distinct().count())
    rows = index.repartition(files, "file").sortWithinPartitions("file", "at")
    names = ["doc_id", "start", "n_tokens", "ids"]

    def read(batches):
        system = base = reader = file = name = None
        for batch in batches:
            out, held = ([], [], [], []), 0
            for doc_id, group, at, start, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group != name:
                    if file:
                        file.close()
                    if system is None:
                        system, base = fs.FileSystem.from_uri(f"{folder}/ids")
                    file, name = system.open_input_file(f"{base}/{group}"), group
                    reader = FrameReader(file)
                for column, value in zip(out, (doc_id, start, n, reader.read(at, n))):
                    column.append(value)
                held += n
                if held >= READ_IDS:
                    yield _documents(out, names)
                    out, held = ([], [], [], []), 0
            if out[0]:
                yield _documents(out, names)
        if file:
            file.close()

    return rows.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _documents(columns, names) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def filed_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its file.

    A null or empty text has the end id alone; repeated rows are filed each; a null doc_id
    comes first. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or Workspace(spark, "token-files").root
    write_token_files(docs, folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
