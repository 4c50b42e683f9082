"""Ranked lexical search with range-maximum tables over posting lists.

`build_index` cuts the documents into segments of bounded size and inverts each one where it is
read: a row is the posting list of a term in a segment. `search` gives every posting its impact
and every posting list a sparse table, which answers the largest impact of any run of documents
by two lookups. The search of an item is best-first over intervals of documents: the sum of its
terms' range maxima bounds every score in an interval; the interval with the highest bound is
split at the document of its greatest impact, that document is scored exactly, and the two rests
get their own, smaller bounds. It ends when no bound can enter the list of the best. Intervals
are taken in batches that double, so the table lookups of a batch are one array operation.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairframe.llm.common import Workspace

SEGMENT_BYTES = 16 << 20
ITEM_BLOCK = 256
WIDEST_BATCH = 512
IMPACT_UNIT = 1_000_000_000

# Terms are runs of ASCII digits and letters and of every non-ASCII byte.
_TERM_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text with only A-Z lower-cased; null has none."""
    return text.translate(_TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class SearchIndex:
    """postings (segment, term, n, places, counts) and segments (segment, doc_ids, lengths)."""

    work: Workspace
    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.rows.filter("term IS NOT NULL").select("segment", "term", "n", "places", "counts")

    @property
    def segments(self) -> DataFrame:
        return self.rows.filter("doc_ids IS NOT NULL").select("segment", "doc_ids", "lengths")


_INDEX_ROW = pa.schema(
    [
        ("segment", pa.int64()),
        ("term", pa.binary()),
        ("n", pa.int32()),
        ("places", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
    ]
)
_INDEX_SCHEMA = (
    "segment bigint, term binary, n int, places array<int>, counts array<int>, doc_ids array<bigint>, lengths array<int>"
)


def _ascending(ids: list) -> list[int]:
    """Places of the ids in ascending order, null first."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))


def _inverted(segment: int, rows: list[tuple]):
    """Batches with the posting lists of a segment, then its documents in ascending doc_id."""
    order = _ascending([doc_id for doc_id, _ in rows])
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.fromiter((len(rows[i][1]) for i in order), np.int64, len(order))
    names = np.fromiter((number[t] for i in order for t in rows[i][1]), np.int64, int(lengths.sum()))
    places = np.repeat(np.arange(len(order)), lengths)
    pairs, counts = np.unique(names * len(order) + places, return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(number) + 1) * len(order))
    places, counts = (pairs % len(order)).astype(np.int32), counts.astype(np.int32)
    terms = list(number)
    for low in range(0, len(terms), 20_000):
        part = terms[low : low + 20_000]
        cut = starts[low : low + len(part) + 1]
        offsets = pa.array((cut - cut[0]).astype(np.int32))
        span = slice(cut[0], cut[-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(part), segment)),
                pa.array(part, pa.binary()),
                pa.array(np.diff(cut).astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(places[span])),
                pa.ListArray.from_arrays(offsets, pa.array(counts[span])),
                pa.nulls(len(part), pa.list_(pa.int64())),
                pa.nulls(len(part), pa.list_(pa.int32())),
            ],
            schema=_INDEX_ROW,
        )
    documents = {"doc_ids": [[rows[i][0] for i in order]], "lengths": [lengths.tolist()]}
    empty = {name: [None] for name in ("term", "n", "places", "counts")}
    yield pa.RecordBatch.from_pydict({"segment": [segment], **empty, **documents}, schema=_INDEX_ROW)


def build_index(docs: DataFrame, work: Workspace | None = None, segment_bytes: int = SEGMENT_BYTES) -> SearchIndex:
    """Index of all documents (doc_id, text); every term of every whole text.

    A segment ends when its texts reach `segment_bytes`; a longer text is a segment of its own
    with its neighbours before it. Documents without a term (null, empty, only separators) are
    not in it. Rows that repeat are documents of their own; a null doc_id stays null.
    """
    work = work or Workspace(docs.sparkSession, "search")

    def invert(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                rows.append((doc_id, terms))
                size += len(text.as_buffer())
                if size >= segment_bytes:
                    yield from _inverted(task << 32 | number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield from _inverted(task << 32 | number, rows)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return SearchIndex(work, work.save(texts.mapInArrow(invert, _INDEX_SCHEMA), "index"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows of the same item_id are one item."""

    def split(batches):
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"]
            )

    texts = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    lists = texts.mapInArrow(split, "item_id bigint, terms array<binary>")
    return lists.select("item_id", F.explode("terms").alias("term")).distinct()


class RangeMaxima:
    """Posting lists of one segment, end to end, and the sparse tables over their impacts.

    `table[k][i]` is the place of the largest impact among the 2**k postings from i on, so the
    maximum of a run is the larger of two overlapping entries. A run never leaves its list.
    """

    def __init__(self, places: np.ndarray, impacts: np.ndarray, starts: np.ndarray, size: int):
        self.places, self.impacts, self.starts, self.size = places, impacts, starts, size
        longest = int(np.diff(starts).max(initial=1))
        levels = max(1, longest.bit_length())
        table = np.zeros((levels, len(places)), np.int32)
        table[0] = np.arange(len(places), dtype=np.int32)
        for k in range(1, levels):
            half = 1 << (k - 1)
            left, right = table[k - 1, :-half], table[k - 1, half:]
            table[k, :-half] = np.where(impacts[right] > impacts[left], right, left)
        self.table = table
        runs = np.arange(longest + 1)
        self.level = np.zeros(longest + 1, np.int64)
        self.level[1:] = np.frexp(runs[1:])[1] - 1

    def ranks(self, lists: np.ndarray) -> np.ndarray:
        """Row per list: index of its first posting at or after each document."""
        low, high = self.starts[lists], self.starts[lists + 1]
        marks = np.zeros((len(lists), self.size + 1), np.int32)
        for row, (a, b) in enumerate(zip(low, high)):
            marks[row, self.places[a:b] + 1] = 1
        np.cumsum(marks, axis=1, out=marks)
        return marks + low[:, None].astype(np.int32)

    def scores(self, ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of single documents."""
        at = ranks[:, docs]
        held = ranks[:, docs + 1] > at
        return np.where(held, self.impacts[np.where(held, at, 0)], 0).sum(axis=0)

    def bounds(self, ranks: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the range maxima of [low, high), and the document of the greatest of them."""
        first, last = ranks[:, low], ranks[:, high]
        held = last > first
        first = np.where(held, first, 0)
        level = self.level[np.where(held, last - first, 1)]
        left = self.table[level, first]
        right = self.table[level, np.where(held, last - (1 << level), 0)]
        a, b = self.impacts[left], self.impacts[right]
        best = np.where(held, np.maximum(a, b), 0)
        top = best.argmax(axis=0)
        every = np.arange(len(low))
        at = np.where(b > a, right, left)[top, every]
        return best.sum(axis=0), self.places[at]


def best_first(maxima: RangeMaxima, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the k best documents, equal scores by place; and how many were scored."""
    ranks = maxima.ranks(lists)
    low, high = np.array([0]), np.array([maxima.size])
    bound, split = maxima.bounds(ranks, low, high)
    places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    width, seen = 1, 0
    while True:
        if len(scores) == k:
            alive = (bound > scores[-1]) | ((bound == scores[-1]) & (low < places[-1]))
        else:
            alive = bound > 0
        low, high, bound, split = low[alive], high[alive], bound[alive], split[alive]
        if not len(low):
            return places, scores, seen
        chosen = np.argpartition(-bound, width - 1)[:width] if width < len(low) else np.arange(len(low))
        docs = split[chosen].astype(np.int64)
        seen += len(docs)
        places = np.concatenate([places, docs])
        scores = np.concatenate([scores, maxima.scores(ranks, docs)])
        order = np.lexsort((places, -scores))[:k]
        places, scores = places[order], scores[order]
        rest = np.ones(len(low), bool)
        rest[chosen] = False
        new_low = np.concatenate([low[chosen], docs + 1])
        new_high = np.concatenate([docs, high[chosen]])
        filled = new_low < new_high
        new_low, new_high = new_low[filled], new_high[filled]
        new_bound, new_split = maxima.bounds(ranks, new_low, new_high)
        low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
        width = min(2 * width, WIDEST_BATCH)


def _segment_search(n_docs: int, n_terms: int, k: int):
    """Best k documents of a segment for every item of a block, as a function of the two groups."""

    def run(key, postings: pa.Table, segment: pa.Table) -> pa.Table:
        found = {"item_id": [], "doc_id": [], "score": []}
        if postings.num_rows and segment.num_rows:
            postings = postings.combine_chunks()
            doc_ids = segment.column("doc_ids")[0].as_py()
            lengths = segment.column("lengths")[0].values.to_numpy().astype(np.int64)
            length_part = 50 + (50 * lengths * n_docs) // n_terms  # m of each document
            places = pa.concat_arrays([c.flatten() for c in postings.column("places").chunks]).to_numpy()
            counts = pa.concat_arrays([c.flatten() for c in postings.column("counts").chunks]).to_numpy().astype(np.int64)
            sizes = postings.column("n").to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            weights = np.repeat(postings.column("weight").to_numpy(), sizes)
            impacts = weights * ((IMPACT_UNIT * counts) // (1000 * counts + 20 * length_part[places]))
            maxima = RangeMaxima(places, impacts, starts, len(doc_ids))
            lists = defaultdict(list)
            for row, items in enumerate(postings.column("items").to_pylist()):
                for item in items:
                    lists[item].append(row)
            for item, rows in lists.items():
                at, scores, _ = best_first(maxima, np.array(rows), k)
                found["item_id"] += [item] * len(at)
                found["doc_id"] += [doc_ids[i] for i in at]
                found["score"] += scores.tolist()
        return pa.table({name: pa.array(column, pa.int64()) for name, column in found.items()})

    return run


def search(index: SearchIndex, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, best first.

    Score and terms are those of the registered query's contract. Equal scores are ordered by
    doc_id, null first. An item without a term, or none that a document holds, has no row.
    Items are searched in blocks of about `ITEM_BLOCK`, each against every segment; a segment
    gives at most k rows per item, and those are cut to k again before they are exchanged.
    """
    work = index.work
    totals = index.segments.agg(
        F.sum(F.size("doc_ids")).alias("docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("terms"),
    ).first()
    wanted = work.save(item_terms(items), "item-terms")
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 1
    blocks = max(1, -(-wanted.select("item_id").distinct().count() // ITEM_BLOCK))
    grouped = wanted.groupBy("term", F.pmod(F.hash("item_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("item_id")).alias("items")  # in a struct, so that a null id stays
    )
    counts = index.postings.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    # stored, so that its size is known and only a small one is sent to every task
    weighted = work.save(
        grouped.join(counts, "term").select("term", "block", F.col("items.item_id").alias("items"), weight.alias("weight")),
        "weights",
    )
    lists = index.postings.join(weighted, "term").select("segment", "block", "n", "places", "counts", "items", "weight")
    segments = index.segments.select(
        F.col("segment").alias("of_segment"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of_block"),
        "doc_ids",
        "lengths",
    )
    found = (
        lists.groupBy("segment", "block")
        .cogroup(segments.groupBy("of_segment", "of_block"))
        .applyInArrow(_segment_search(n_docs, n_terms, k), "item_id bigint, doc_id bigint, score bigint")
    )
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item; see `search`.

    Null and empty texts on either side have no terms. Repeated document rows are ranked each;
    rows of one item_id, also null, are one item with the terms of all. Other columns are not
    read. An empty table on either side gives an empty result.
    """
    return search(build_index(docs), items, k)
