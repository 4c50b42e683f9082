"""Language-model scores by a hierarchical Pitman-Yor model with sampled seating.

Every context has a restaurant whose dishes are words; a new table sends a customer to the
shared parent restaurant, whose own base is uniform over the known words and one unknown.
The context of a token is the word before it, or the start of its text. Each context that
occurs in training has its own restaurant; a context that does not is scored by the parent.

Texts become blocks of token numbers, stored once. Buckets are ranges of word hashes, and a
word is numbered in its bucket, words of many blocks first, so that pairs travel as small
numbers. Counts meet by word: a block sends each bucket its (word, context) pairs with their
training counts, packed into arrays, so a bucket holds all customers of its words in all
restaurants and their parent. A pair of one customer has one table, so only the others are
sampled. In a sweep every customer leaves its table and sits down again; tables are kept from
sweep to sweep. Between sweeps the tables of each context and of the parent are summed over
all buckets, by ranges of contexts. Within a sweep the totals and the parent are those the
sweep before ended with.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairframe.llm.common import Workspace

SWEEPS, KEPT = 6, 3
STRENGTH = 1.0
BLOCK_BYTES = 8 << 20
PAIRS_PER_BUCKET = 2_000_000
SEED = 7
END = xxhash.xxh3_64_intdigest(b"\x00end")
#: Up to so many customers of a dish are seated together, by the weights of all numbers of tables.
TOGETHER = 2048
#: More are, if their tables are surely fewer than this and a series gives the weights.
SERIES = 512
#: Weights that are drawn from at once.
DRAWN = 1 << 20
#: With fewer dishes left than this, each is finished in a loop of its own.
FEW = 64
#: A context is its bucket and, in so many bits, its number there.
BUCKET_BITS = 40
ROW = "kind int, bucket bigint, grp bigint, round int, a binary, b binary, c binary, d binary, e binary, f binary"
FACTS, MERGED, ASK, STATE, SUMS = range(5)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: the least width that holds them, bytes of equal weight together, compressed."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    """The numbers of `pack`."""
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel().astype(np.int64)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Packed blocks: doc ids, held-out flags, tokens per document, distinct words and token numbers.

    `docs` has doc_id, held_out and text. The last token of every text is its end.
    """

    def task(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, held, sizes, stream, size = [], [], [], [], 0

        def packed_block():
            tokens = np.concatenate(stream)
            words, index = np.unique(tokens, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 24 | number]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([words.tobytes()], pa.binary()),
                    pa.array([pack(index)], pa.binary()),
                ],
                names=["block", "ids", "held", "sizes", "words", "tokens"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                words = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(1)[i].as_py())
                sizes.append(len(words) + 1)
                stream += [words, np.array([END], np.uint64)]
                size += len(text or "") + 16
                if size >= block_bytes:
                    yield packed_block()
                    number += 1
                    ids, held, sizes, stream, size = [], [], [], [], 0
        if ids:
            yield packed_block()

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        task, "block bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, words binary, tokens binary"
    )


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, token numbers and the training flag of each token of a block."""
    words = np.frombuffer(row["words"], np.uint64)
    tokens = unpack(row["tokens"])
    training = ~np.repeat(np.array(row["held"], bool), row["sizes"])
    return words, tokens, training


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, its distinct pairs in order, each token's pair, training counts of the pairs.

    A pair is word x (number of words + 1) + context; context 0 is the start, k + 1 word k.
    """
    words, tokens, training = _unpack(row)
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1] + 1
    before[np.cumsum(row["sizes"]) - row["sizes"]] = 0
    pairs, place = np.unique(tokens * (len(words) + 1) + before, return_inverse=True)
    return words, pairs, place, np.bincount(place[training], minlength=len(pairs))


def _bounds(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, a range of hashes, starts in sorted words."""
    step = (1 << 64) // buckets + 1
    return np.searchsorted(words, np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)], np.uint64))


def numbers(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, numbers): each block's words of a bucket, in order, by their numbers in the bucket."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                cut = np.append(_bounds(words, buckets), len(words))
                held = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held, pa.int64()),
                        pa.array([row["block"]] * len(held), pa.int64()),
                        pa.array([words[cut[b] : cut[b + 1]].tobytes() for b in held], pa.binary()),
                    ],
                    names=["bucket", "block", "words"],
                )

    def numbered(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")]
        distinct, place, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        number = np.empty(len(distinct), np.int64)
        number[np.argsort(-times, kind="stable")] = np.arange(len(distinct))
        parts = np.split(number[place], np.cumsum([len(w) for w in words])[:-1])
        columns = {"block": table.column("block"), "bucket": table.column("bucket")}
        return pa.table(columns | {"numbers": pa.array([pack(x) for x in parts], pa.binary())})

    sent = blocks.select("block", "words").mapInArrow(task, "bucket bigint, block bigint, words binary")
    return sent.groupBy("bucket").applyInArrow(numbered, "block bigint, bucket bigint, numbers binary")


def requests(blocks: DataFrame, numbered: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, places, contexts, counts): what each block holds of each bucket.

    Words are numbers in the bucket. A context is 0, the start, or 1 + its bucket + its number
    there x buckets.
    """

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words, pairs, _, counts = pairs_of(row)
        parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        held, width = [r["bucket"] for r in parts], len(words) + 1
        number = [unpack(r["numbers"]) for r in parts]
        cut = np.cumsum([0, *map(len, number)])
        edge = np.searchsorted(pairs, cut * width)
        context = np.concatenate([[0], *(1 + b + buckets * x for b, x in zip(held, number))])[pairs % width]
        columns = {"words": [r["numbers"] for r in parts], "places": [], "contexts": [], "counts": []}
        for i in range(len(held)):
            part = slice(edge[i], edge[i + 1])
            columns["places"].append(pack(pairs[part] // width - cut[i]))
            columns["contexts"].append(pack(context[part]))
            columns["counts"].append(pack(counts[part]))
        keys = {"bucket": pa.array(held, pa.int64()), "block": pa.array([row["block"]] * len(held), pa.int64())}
        return pa.table(keys | {c: pa.array(v, pa.binary()) for c, v in columns.items()})

    return blocks.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(
        task, "bucket bigint, block bigint, words binary, places binary, contexts binary, counts binary"
    )


class Bucket:
    """All customers of a bucket's words."""

    def __init__(self, table: pa.Table, buckets: int):
        numbers = lambda c: [unpack(x.as_py()) for x in table.column(c)]
        self.number = table.column("bucket")[0].as_py()
        self.blocks = table.column("block").to_pylist()
        self.places, contexts = numbers("words"), numbers("contexts")
        # every number of a word was given to a word of some block
        self.words = 1 + max(int(p.max()) for p in self.places)
        sent, of_context = np.unique(np.concatenate(contexts), return_inverse=True)
        # in the order of buckets and numbers, so that ranges of contexts are like ranges of hashes
        keys = np.where(sent > 0, ((sent - 1) % buckets << BUCKET_BITS) + (sent - 1) // buckets + 1, 0)
        order = np.argsort(keys)
        self.contexts, rank = keys[order], np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        of_context = rank[of_context]
        of_word = np.concatenate([p[at] for p, at in zip(self.places, numbers("places"))])
        self.pairs, place = np.unique(of_word * len(self.contexts) + of_context, return_inverse=True)
        self.asked = np.split(place, np.cumsum([len(c) for c in contexts])[:-1])
        self.count = np.bincount(place, np.concatenate(numbers("counts")), len(self.pairs)).astype(np.int64)
        self.word, self.context = self.pairs // len(self.contexts), self.pairs % len(self.contexts)
        self.word_count = np.bincount(self.word, self.count, self.words).astype(np.int64)
        self.many = np.flatnonzero(self.count > 1)


def adjust(sizes: np.ndarray, tables: np.ndarray, customers: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and numbers of tables for changed numbers of customers: random ones leave, further ones sit alone."""
    n = len(tables)
    dish = np.repeat(np.arange(n), tables)
    seat, of_seat = np.repeat(np.arange(len(sizes)), sizes), np.repeat(dish, sizes)
    before = np.bincount(dish, sizes, n).astype(np.int64)
    order = np.lexsort((random.random(len(seat)), of_seat))
    rank = np.arange(len(seat)) - np.repeat(np.cumsum(before) - before, before)
    left = np.bincount(seat[order][rank < np.repeat(customers, before)], minlength=len(sizes))
    alone = np.repeat(np.arange(n), np.maximum(customers - before, 0))
    dish, sizes = np.append(dish[left > 0], alone), np.append(left[left > 0], np.ones(len(alone), np.int64))
    order = np.argsort(dish, kind="stable")
    return sizes[order], np.bincount(dish, minlength=n)


def reseat(customers, sizes, tables, discount: float, strength, base, random) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and numbers of tables after the customers of every dish left their tables and sat down again.

    `sizes` are those of all tables, dish by dish. A seating weighs, for each table after
    the first, (strength + discount x tables of the dish so far) x base, where `strength`
    holds the tables of the restaurant's other dishes, and for each further customer of a
    table its customers less the discount. The customers of a dish sit down together; they move
    one by one only where they are many and no series gives the weights. Nothing depends on the sizes of tables taken together, so
    all but the first are given one customer.
    """
    many, drawn = customers > TOGETHER, np.zeros(len(tables), np.int64)
    for dishes, draw in ((~many, seat_together), (many, seat_by_series)):
        drawn[dishes] = draw(customers[dishes], discount, strength[dishes], base[dishes], random)
    each = many & (drawn == 0)
    moved, drawn[each] = move_each(
        customers[each], sizes[np.repeat(each, tables)], tables[each], discount, strength[each], base[each], random
    )
    sizes, first = np.ones(drawn.sum(), np.int64), np.cumsum(drawn) - drawn
    sizes[np.repeat(each, drawn)] = moved
    seated = ~each & (customers > 0)
    sizes[first[seated]] = (customers - drawn + 1)[seated]
    return sizes, drawn


_WAYS: dict[float, list[np.ndarray]] = {}


def log_ways(discount: float, most: int) -> list[np.ndarray]:
    """Entry n: for 1 to n tables, the logarithm of the summed weights of all ways to seat n customers at them.

    The weight of a way has for each further customer of a table its customers less the discount.
    """
    if discount not in _WAYS and len(_WAYS) > 3:
        _WAYS.clear()
    rows = _WAYS.setdefault(discount, [np.empty(0), np.zeros(1)])
    for n in range(len(rows) - 1, most):
        row = np.full(n + 1, -np.inf)
        row[:n] = rows[n] + np.log(n - discount * np.arange(1, n + 1))
        row[1:] = np.logaddexp(row[1:], rows[n])
        rows.append(row)
    return rows


def seat_together(customers, discount: float, strength, base, random) -> np.ndarray:
    """Numbers of tables of dishes, each drawn from the weights of all its seatings."""
    tables = np.minimum(customers, 1)
    order = np.argsort(customers, kind="stable")
    sizes, start = np.unique(customers[order], return_index=True)
    ways = log_ways(discount, int(sizes[-1]) if len(sizes) else 0)
    for n, same in zip(sizes.tolist(), np.split(order, start[1:])):
        step = max(1, DRAWN // max(n, 1))
        for at in (same[i : i + step] for i in range(0, len(same) if n > 1 else 0, step)):
            weights = np.zeros((len(at), n))
            np.cumsum(np.log((strength[at, None] + discount * np.arange(1, n)) * base[at, None]), axis=1, out=weights[:, 1:])
            weights += ways[n]
            weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            draw = random.random(len(at)) * weights[:, -1]
            tables[at] = 1 + np.minimum((weights <= draw[:, None]).sum(axis=1), n - 1)
    return tables


def log_ways_by_series(n: int, discount: float, most: int) -> np.ndarray:
    """The first entries of `log_ways` for n customers, up to `most` tables or where digits would be lost.

    S(n, t) = 1 / (t! d^t) x sum over j of (-1)^j C(t, j) Gamma(n - j d) / Gamma(-j d).
    """
    j = np.arange(1, most + 1)
    log_factorial = np.cumsum(np.log(np.maximum(np.arange(most + 1), 1)))
    sine = np.sin(np.pi * j * discount)
    size = np.array([lgamma(n - k * discount) + lgamma(1 + k * discount) for k in j]) + np.log(np.abs(sine) / np.pi + 1e-300)
    rest = j[:, None] - j
    terms = np.where(rest >= 0, size - log_factorial[j] - log_factorial[np.maximum(rest, 0)], -np.inf)
    largest = terms.max(axis=1)
    total = (np.exp(terms - largest[:, None]) * (np.sign(sine) * np.where(j % 2, 1, -1))).sum(axis=1)
    sure = len(j) if (total > 1e-4).all() else int(np.argmin(total > 1e-4))
    return largest[:sure] + np.log(total[:sure]) - j[:sure] * np.log(discount)


def seat_by_series(customers, discount: float, strength, base, random) -> np.ndarray:
    """`seat_together` for many customers; 0 for a dish whose likely numbers of tables the series does not reach."""
    tables = np.zeros(len(customers), np.int64)
    for i, n in enumerate(customers.tolist()):
        most = 32
        while most <= SERIES:
            weights = log_ways_by_series(n, discount, most)
            sure = len(weights)
            if sure > 1:
                weights[1:] += np.cumsum(np.log((strength[i] + discount * np.arange(1, sure)) * base[i]))
                # the weights have one top, so all that is left out is lighter still
                if weights[-1] < weights.max() - 40:
                    weights = np.cumsum(np.exp(weights - weights.max()))
                    tables[i] = 1 + min(np.searchsorted(weights, random.random() * weights[-1], side="right"), sure - 1)
                    break
            if sure < most:
                break
            most *= 2
    return tables


def move_each(customers, sizes, tables, discount: float, strength, base, random) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and numbers of tables after the customers of every dish moved one by one.

    Without the customer, a table is chosen in proportion to its customers less the
    discount, a new one to (strength + discount x tables of the dish) x base. Step j moves
    customer j of all dishes at once.
    """
    tables = tables.astype(np.int64).copy()
    start = np.cumsum(customers) - customers
    dish = np.repeat(np.arange(len(tables)), tables)
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(tables) - tables, tables)
    seat = np.repeat(number, sizes)
    # stored sizes do not say who sits where: customers of a dish are dealt to its seats at random
    seat = seat[np.lexsort((random.random(len(seat)), np.repeat(dish, sizes)))]
    # a table opened in step j has number customers + j, which no other has
    room = 2 * start
    held = np.zeros(2 * len(seat), np.int64)
    held[room[dish] + number] = sizes
    order = np.argsort(-customers, kind="stable")
    order = order[: np.count_nonzero(customers > 1)]
    ascending, j = customers[order][::-1], 0
    while True:
        active = order[: len(order) - np.searchsorted(ascending, j, side="right")]
        if len(active) < FEW:
            break
        place = start[active] + j
        old = room[active] + seat[place]
        held[old] -= 1
        tables[active] -= held[old] == 0
        new = (strength[active] + discount * tables[active]) * base[active]
        chosen, left = np.empty(len(active), np.int64), np.arange(len(active))
        while len(left):
            at, opens = active[left], new[left]
            draw = random.random(len(left)) * (customers[at] - 1 + opens) - opens
            other = np.clip(draw.astype(np.int64), 0, customers[at] - 2)
            table = seat[start[at] + other + (other >= j)]
            chosen[left] = np.where(draw < 0, customers[at] + j, table)
            taken = (draw < 0) | (random.random(len(left)) * held[room[at] + table] >= discount)
            left = left[~taken]
        tables[active] += chosen == customers[active] + j
        held[room[active] + chosen] += 1
        seat[place] = chosen
        j += 1
    for i in active:
        n, t = int(customers[i]), int(tables[i])
        sits, has = seat[start[i] : start[i] + n].tolist(), held[room[i] : room[i] + 2 * n].tolist()
        s, p = float(strength[i]), float(base[i])
        for k in range(j, n):
            has[sits[k]] -= 1
            t -= has[sits[k]] == 0
            new = (s + discount * t) * p
            while True:
                draw = random.random() * (n - 1 + new) - new
                if draw < 0:
                    table = n + k
                    t += 1
                    break
                other = min(int(draw), n - 2)
                table = sits[other + (other >= k)]
                if random.random() * has[table] >= discount:
                    break
            has[table] += 1
            sits[k] = table
        held[room[i] : room[i] + 2 * n] = has
        tables[i] = t
    return held[held > 0], tables


def _rows(rows: list[tuple]) -> pa.Table:
    """(kind, bucket, grp, round, arrays...) as a table of `ROW`."""
    columns = {c: [r[i] for r in rows] for i, c in enumerate(("kind", "bucket", "grp", "round"))}
    kinds = {"kind": pa.int32(), "bucket": pa.int64(), "grp": pa.int64(), "round": pa.int32()}
    table = {c: pa.array(v, kinds[c]) for c, v in columns.items()}
    for k, c in enumerate("abcdef"):
        table[c] = pa.array([r[4 + k] if len(r) > 4 + k else None for r in rows], pa.binary())
    return pa.table(table)


def _asks(bucket: int, round_: int, contexts: np.ndarray, values: list[np.ndarray], groups: int, buckets: int) -> list[tuple]:
    """One row per range of contexts: the contexts and, one after the other, their values."""
    first = np.array([-(-g * buckets // groups) for g in range(groups)], np.int64) << BUCKET_BITS
    cut = np.append(np.searchsorted(contexts, first), len(contexts))
    return [
        (ASK, bucket, int(g), round_, pack(np.diff(contexts[cut[g] : cut[g + 1]], prepend=0)), pack(np.concatenate([v[cut[g] : cut[g + 1]] for v in values])))
        for g in np.flatnonzero(np.diff(cut))
    ]


def sums_of(asks: DataFrame, asking: int, rounds: list[int]) -> DataFrame:
    """To the rows of round `asking` the sums over all buckets of the values of each of `rounds`, in the order asked."""

    def task(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(unpack(r["a"])) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        sums = {}
        for r, at in zip(rows, places):
            if r["round"] in rounds:
                values = unpack(r["b"]).reshape(-1, len(at))
                total = sums.setdefault(r["round"], np.zeros((len(values), len(distinct)), np.int64))
                total[:, at] += values  # the contexts of one row are distinct
        total = np.concatenate([sums.get(r, np.zeros((1, len(distinct)), np.int64)) for r in rounds])
        return _rows([
            (SUMS, r["bucket"], r["grp"], asking, pack(total[:, at].ravel())) for r, at in zip(rows, places) if r["round"] == asking
        ])

    return asks.filter(F.col("kind") == ASK).groupBy("grp").applyInArrow(task, ROW)


def _sums(rows: list[dict], round_: int, width: int) -> np.ndarray:
    """The sums for all contexts asked for: the ranges one after the other."""
    parts = sorted((r for r in rows if r["kind"] == SUMS and r["round"] == round_), key=lambda r: r["grp"])
    return np.concatenate([unpack(r["a"]).reshape(width, -1) for r in parts] or [np.zeros((width, 0), np.int64)], axis=1)


def _parent(customers, tables, totals: np.ndarray, facts: dict) -> np.ndarray:
    """Probability of words at the parent; `totals` are its customers and tables."""
    d0 = facts["parent_discount"]
    below = (STRENGTH + d0 * totals[1]) / (facts["words"] + 1)
    return (np.maximum(customers - d0 * tables, 0) + below) / (STRENGTH + totals[0])


def start_rows(table: pa.Table, groups: int, buckets: int) -> pa.Table:
    """Facts of a bucket, the pairs to be sampled, and its customers and first tables by context."""
    b = Bucket(table, buckets)
    once = b.count == 1
    facts = [np.count_nonzero(x == k) for x in (b.count, b.word_count) for k in (1, 2)]
    facts += [np.count_nonzero(b.word_count), b.count.sum(), np.count_nonzero(b.count)]
    of_context = lambda w: np.bincount(b.context, w, len(b.contexts)).astype(np.int64)
    held, at = np.unique(b.context[b.many], return_inverse=True)
    singles = np.bincount(b.word, once, b.words).astype(np.int64)
    merged = (MERGED, b.number, None, None, pack(singles), pack(np.diff(b.contexts[held], prepend=0)), pack(held), pack(b.word[b.many]), pack(at), pack(b.count[b.many]))
    asks = _asks(b.number, -1, b.contexts, [of_context(b.count), of_context(once), of_context(b.count > 1)], groups, buckets)
    return _rows([(FACTS, b.number, None, -1, np.array(facts, float).tobytes()), merged, *asks])


def sweep_rows(table: pa.Table, others: pa.Table, sweep: int, totals: np.ndarray, facts: dict, groups: int, buckets: int) -> pa.Table:
    """The seating of a bucket after a sweep, its tables by context and its share of the parent."""
    rows, number = others.to_pylist(), table.column("bucket")[0].as_py()
    row = table.to_pylist()[0]
    singles, held, word, context, count = (unpack(row[c]) for c in "acdef")
    contexts = np.cumsum(unpack(row["b"]))
    fixed = _sums(rows, -1, 3)[:, held]
    random = np.random.default_rng([SEED, number, sweep])
    kept = [r for r in rows if r["kind"] == STATE]
    if kept:
        sizes, tables, parent_sizes, parent_tables = (unpack(kept[0][c]) for c in "abcd")
        of_context = fixed[1] + _sums(rows, sweep - 1, 1)[0]
    else:
        sizes, tables = count, np.ones(len(count), np.int64)
        of_context = fixed[1] + fixed[2]
    at_parent = lambda: singles + np.bincount(word, tables, len(singles)).astype(np.int64)
    parent = at_parent()
    if not kept:
        parent_sizes, parent_tables = parent[parent > 0], (parent > 0).astype(np.int64)
    # a dish is seated by what the parent holds without its own tables
    rest = parent[word] - tables
    p = _parent(rest, np.minimum(parent_tables[word], rest), totals, facts)
    d, d0 = facts["discount"], facts["parent_discount"]
    sizes, tables = reseat(count, sizes, tables, d, STRENGTH + d * (of_context[context] - tables), p, random)
    parent = at_parent()
    # dishes that are seated together need no tables to start from
    large, begun = parent > TOGETHER, np.zeros(len(parent), np.int64)
    held = parent_sizes[np.repeat(large, parent_tables)]
    held, begun[large] = adjust(held, parent_tables[large], parent[large], random)
    base = np.full(len(parent), 1 / (facts["words"] + 1))
    below = STRENGTH + d0 * np.maximum(totals[1] - parent_tables, 0)
    parent_sizes, parent_tables = reseat(parent, held, begun, d0, below, base, random)
    state = [pack(x) for x in (sizes, tables, parent_sizes, parent_tables)]
    asks = _asks(number, sweep, contexts, [np.bincount(context, tables, len(contexts)).astype(np.int64)], groups, buckets)
    share = np.array([parent.sum(), parent_tables.sum()], float).tobytes()
    return _rows([(STATE, number, None, sweep, *state), (FACTS, number, None, sweep, share), *asks])


def answer_rows(table: pa.Table, others: pa.Table, totals: list[np.ndarray], facts: dict, buckets: int) -> pa.Table:
    """The log probability of every pair each block asked for, averaged over the kept sweeps."""
    b, rows = Bucket(table, buckets), others.to_pylist()
    customers, singles, _ = _sums(rows, -1, 3)
    of_context = singles + _sums(rows, SWEEPS, KEPT)
    states = sorted((r for r in rows if r["kind"] == STATE), key=lambda r: r["round"])
    d, mean = facts["discount"], np.zeros(len(b.pairs))
    for held, total, state in zip(of_context, totals, states):
        tables = (b.count > 0).astype(np.int64)
        tables[b.many] = unpack(state["b"])
        parent = np.bincount(b.word, tables, b.words)
        p = _parent(parent, unpack(state["d"]), total, facts)
        own = np.maximum(b.count - d * tables, 0)
        mean += (own + (STRENGTH + d * held[b.context]) * p[b.word]) / (STRENGTH + customers[b.context])
    log_p = np.log10(mean / KEPT).astype(np.float32)
    return pa.table(
        {
            "block": pa.array(b.blocks, pa.int64()),
            "bucket": pa.array([b.number] * len(b.blocks), pa.int64()),
            "known": pa.array([pack(b.word_count[p]) for p in b.places], pa.binary()),
            "log_p": pa.array([log_p[a].tobytes() for a in b.asked], pa.binary()),
        }
    )


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    `docs` has doc_id, held_out and text; rows that are held out teach nothing. A null or
    empty text is its end alone. Repeated rows count and are scored each. Without any
    training token every word is the unknown one.
    """
    work = Workspace(docs.sparkSession, "pitman-yor")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # both tables lie in buckets of what they are grouped by, so each pass reads them without a shuffle
    blocks = work.save_bucketed(blocks_of(docs, block_bytes), "blocks", "block", max(1, -(-total // block_bytes)), shuffle=False)
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, size: n + size))).first()[0] or 0
    buckets = max(8, int(-(-tokens // PAIRS_PER_BUCKET)))
    groups = max(4, buckets // 4)
    numbered = work.save(numbers(blocks, buckets), "numbers")
    work.release()
    asked = work.save_bucketed(requests(blocks, numbered, buckets), "requests", "bucket", buckets)
    work.drop(numbered)
    work.release()
    start = work.save(asked.groupBy("bucket").applyInArrow(lambda table: start_rows(table, groups, buckets), ROW), "start")

    def facts_of(rows: DataFrame, n: int) -> np.ndarray:
        """Sums over the buckets of the few numbers that each gives."""
        total = np.zeros(n)
        for r in rows.filter(F.col("kind") == FACTS).select("a").toLocalIterator():
            total += np.frombuffer(r.a, float)
        return total

    once, twice, word_once, word_twice, words, n_tokens, n_pairs = facts_of(start, 7)
    facts = {
        "discount": min(0.95, max(0.1, once / max(once + 2 * twice, 1))),
        "parent_discount": min(0.95, max(0.1, word_once / max(word_once + 2 * word_twice, 1))),
        "words": words,
        "tokens": n_tokens,
    }
    fixed = work.save(sums_of(start, -1, [-1]), "fixed")
    merged = start.filter(F.col("kind") == MERGED)
    totals, sweeps, known = [np.array([n_pairs, words])], [], fixed

    def sweep(k: int, total: np.ndarray):
        def task(table: pa.Table, others: pa.Table) -> pa.Table:
            return sweep_rows(table, others, k, total, facts, groups, buckets)

        return task

    for k in range(SWEEPS):
        rows = merged.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(sweep(k, totals[-1]), ROW)
        sweeps.append(work.save(rows, f"sweep-{k}"))
        totals.append(facts_of(sweeps[-1], 2))
        if k:
            work.drop(sums, *sweeps[k - 1 : min(k, SWEEPS - KEPT)])
        work.release()
        if k < SWEEPS - 1:
            sums = work.save(sums_of(sweeps[-1], k, [k]), f"sums-{k}")
            known = fixed.unionByName(sweeps[-1].filter(F.col("kind") == STATE)).unionByName(sums)
    kept = sweeps[-KEPT]
    for rows in sweeps[SWEEPS - KEPT + 1 :]:
        kept = kept.unionByName(rows)
    # every context a bucket has asks for the tables of the kept sweeps
    asking = start.filter(F.col("kind") == ASK).withColumn("round", F.lit(SWEEPS))
    last = work.save(sums_of(asking.unionByName(kept.filter(F.col("kind") == ASK)), SWEEPS, list(range(SWEEPS - KEPT, SWEEPS))), "last")
    work.drop(start)
    work.release()
    known = fixed.unionByName(last).unionByName(kept.filter(F.col("kind") == STATE).select(*fixed.columns))

    answered = "block bigint, bucket bigint, known binary, log_p binary"

    def answer(table: pa.Table, others: pa.Table) -> pa.Table:
        return answer_rows(table, others, totals[-KEPT:], facts, buckets)

    answers = work.save(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, answered), "answers")
    work.drop(asked, fixed, last, *sweeps[SWEEPS - KEPT :])
    work.release()
    n_all, v_all = facts["tokens"], facts["words"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        parts = lambda c: [right.column(c)[int(i)].as_py() for i in order]
        counts = np.concatenate([unpack(x) for x in parts("known")]).astype(float)
        log_p = np.frombuffer(b"".join(parts("log_p")), np.float32).astype(float)
        row = left.to_pylist()[0]
        _, _, place, _ = pairs_of(row)
        tokens = unpack(row["tokens"])
        starts = np.cumsum(row["sizes"]) - row["sizes"]
        base = np.log10((counts + 0.1) / (n_all + 0.1 * (v_all + 1)))
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(row["sizes"], pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(base[tokens], starts)),
                "score": pa.array(np.add.reduceat(log_p[place], starts)),
            }
        )

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    scored = work.save(scored, "scored")
    work.keep_only(scored)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training texts, by the model and by the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def scored_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 of the id, modulo 10, is not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"))
