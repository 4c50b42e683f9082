"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

The text is cut into words by the tokenizer's pattern. A word holds its parts and, in an
array beside them, the merge rank of each part with its right neighbour. The smallest rank
is found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed,
until no pair has a rank. Scans of a short array are cheaper than any queue; a word of more
than `LONG_WORD` bytes (one without spaces, or a run of one symbol) takes a heap with the
same order of merges instead, so its cost stays n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from pairframe.llm.common import ship_package

LONG_WORD = 160
CACHED_WORDS = 200_000
NO_RANK = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, by the public rule: printable Latin-1 letters
    stand for themselves, the others take the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """Ids of a word, computed at the first use; emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = tuple(self.encode(word.encode("utf-8")))
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class RankArrayBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in letters.items()}
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.byte_id = [vocabulary[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(vocabulary[left] << 20 | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        size = 1 + max(*vocabulary.values(), *self.special.values())
        self.token_bytes = [b""] * size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode("utf-8")
        # White_Space as the library's own pattern engine has it
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        ).findall
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
            if self.special
            else None
        )
        self.cache = WordCache(self.encode_word)

    def encode_word(self, word: bytes) -> list[int]:
        byte_id, rank_of = self.byte_id, self.rank.get
        parts = [byte_id[b] for b in word]
        if len(parts) < 2:
            return parts
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        if len(parts) > LONG_WORD:
            return self._merge_by_heap(parts, ranks)
        merged = self.merged
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], NO_RANK)
        return parts

    def _merge_by_heap(self, parts: list[int], ranks: list[int]) -> list[int]:
        n, rank_of = len(parts), self.rank.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i, r in enumerate(ranks) if r != NO_RANK]
        ranks.append(NO_RANK)
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not live[i] or ranks[i] != rank:
                continue
            gone = after[i]
            parts[i] = self.merged[rank]
            live[gone] = False
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left < 0:
                    continue
                ranks[left] = rank_of(parts[left] << 20 | parts[right], NO_RANK) if right < n else NO_RANK
                if ranks[left] != NO_RANK:
                    heapq.heappush(heap, (ranks[left], left))
        return [part for part, keep in zip(parts, live) if keep]

    def encode(self, text: str | None) -> array:
        """Ids of a text; the string of an added token becomes its id."""
        ids = array("I")
        if not text:
            return ids
        pieces = self.split_special(text) if self.split_special else [text]
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids.extend(chain.from_iterable(map(self.cache.__getitem__, self.words(piece))))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, RankArrayBpe] = {}


def coder(path: str) -> RankArrayBpe:
    """One coder per Python worker and vocabulary, with its cache of words."""
    if path not in _CODERS:
        _CODERS[path] = RankArrayBpe(path)
    return _CODERS[path]


def little_endian(ids: array) -> bytes:
    """Ids as unsigned 32-bit integers, little-endian."""
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def encode_decode(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: str | None = None,
    ids_col: str | None = "token_ids",
    decoded_col: str | None = "decoded",
    digests: bool = False,
) -> DataFrame:
    """Token ids and the decoded text beside every row.

    Adds `n_tokens`, then `ids_col` (array of int) and `decoded_col` unless they are None,
    and with `digests` the columns `ids_sha256` and `decoded_sha256`. Columns of those
    names in the input are replaced; all others are kept as they are. A null or empty text
    has no tokens and decodes to the empty text; repeated rows are coded each; an empty
    table gives an empty table. Rows never leave their partition.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    added = ["n_tokens", *(c for c in (ids_col, decoded_col) if c)]
    added += ["ids_sha256", "decoded_sha256"] if digests else []
    kept = docs.drop(*[c for c in added if c != text_col])
    others = [c for c in kept.columns if c != text_col or c not in added]

    def code(batches):
        use = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = {c: [] for c in added}
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    ids = use.encode(text)
                    decoded = use.decode(ids)
                    out["n_tokens"].append(len(ids))
                    if ids_col:
                        out[ids_col].append(ids)
                    if decoded_col:
                        out[decoded_col].append(decoded)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(little_endian(ids)).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                types = {"n_tokens": pa.int64(), ids_col: pa.list_(pa.int32())}
                columns = [part.column(part.schema.get_field_index(c)) for c in others]
                columns += [pa.array(out[c], types.get(c, pa.string())) for c in added]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *added])

    kind = {"n_tokens": LongType(), ids_col: ArrayType(IntegerType())}
    schema = StructType(
        [f for f in kept.schema.fields if f.name in others]
        + [StructField(c, kind.get(c, StringType())) for c in added]
    )
    return kept.mapInArrow(code, schema)


def coded_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document."""
    return encode_decode(
        docs.select("doc_id", "text"), vocabulary=vocabulary, ids_col=None, decoded_col=None, digests=True
    ).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
