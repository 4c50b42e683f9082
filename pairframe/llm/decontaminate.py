"""Benchmark passages inside documents, by SimHash of item-sized windows.

A benchmark item is the bag of its word shingles (5 words; a shorter item is one shingle).
A document leaks it if a window of the item's size reaches the weighted Jaccard similarity
sum(min counts) / sum(max counts) with it; a document shorter than the item is one window.

1. Shingles of all documents meet those of the items. A window can only reach the
   similarity if it holds `need` of the item's shingles, so only such windows are formed.
2. Each window gets a 64-bit SimHash of its shingles. Fingerprints are cut into `BLOCKS`
   blocks; items are indexed under every block value with up to `BLOCK_ERRORS` bits changed,
   which guarantees all windows within `RADIUS` = BLOCKS x (BLOCK_ERRORS + 1) - 1 bits.
   A similarity of 0.75 is an angle that differs in 11 of 64 bits on average; the radius lies
   four standard deviations beyond.
3. Windows within the radius are verified on the exact bags.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.llm.common import Workspace, packed, unpacked
from pairframe.llm.lines import may_hold, member_filter

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
BROADCAST_SHINGLES = 2_000_000
DOC = ["doc_id", "text_hash"]


def word_array(text: Column) -> Column:
    """Lower-cased words between spaces, tabs and line ends (null: none)."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    for blank in "\n\t\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def shingle_bag(words: Column, width: int) -> Column:
    """Hashes of all runs of `width` words in order; none if there are fewer words."""
    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    return F.when(
        F.size(words) >= width,
        F.transform(
            hashed,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(h, i + k) for k in range(width)])
            ),
        )[0],
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprint(rows: DataFrame, keys: list[str], shingle: str) -> DataFrame:
    """SimHash per key: a bit is set if more than half of the shingles have it."""
    bits = [F.sum(F.shiftrightunsigned(shingle, b).bitwiseAND(F.lit(1))).alias(f"_b{b}") for b in range(64)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *bits)
    total = F.lit(0).cast("long")
    for b in range(64):
        total = total.bitwiseOR(F.when(F.col(f"_b{b}") * 2 > F.col("_n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return counted.select(*keys, total.alias("fingerprint"))


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def item_index(items: DataFrame) -> DataFrame:
    """(item, block, value): every block value within `BLOCK_ERRORS` changed bits."""
    changes = [sum(1 << b for b in c) for k in range(BLOCK_ERRORS + 1) for c in combinations(range(BLOCK_BITS), k)]
    change = F.explode(F.array(*[F.lit(c) for c in changes])).alias("change")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("fingerprint"), i).alias("value")) for i in range(BLOCKS)])
    rows = items.select("item", F.explode(blocks).alias("b")).select("item", "b.block", "b.value", change)
    return rows.select("item", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    text_col: str = "text",
    id_col: str = "doc_id",
    work: Workspace | None = None,
) -> DataFrame:
    """(doc_id, text_hash, item_id, first_word, similarity) per document and item it leaks.

    first_word is where the best window starts (words from 0; the first of equally good
    ones). Null or wordless documents and items match nothing. Equal rows count once; rows
    that share an id are told apart by their text. Either table may be empty.
    """
    work = work or Workspace(docs.sparkSession, "leaks")
    item_words = word_array(F.col("text"))
    items = benchmark.select("item_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("item_hash"), item_words.alias("words"))
    items = items.filter(F.size("words") > 0).dropDuplicates(["item_id", "item_hash"])
    bag = F.when(F.size("words") >= SHINGLE, shingle_bag(F.col("words"), SHINGLE))
    for width in range(1, SHINGLE):
        bag = bag.when(F.size("words") == width, shingle_bag(F.col("words"), width))
    items = items.select(
        F.xxhash64("item_id", "item_hash").alias("item"), "item_id", F.least(F.size("words"), F.lit(SHINGLE)).alias("width"), bag.alias("bag")
    )
    items = work.save(items.withColumn("m", F.size("bag")), "items")
    widths = [r.width for r in items.select("width").distinct().collect()]
    own = items.select("item", "m", "width", F.posexplode("bag").alias("item_at", "shingle"))
    if items.agg(F.sum("m")).first()[0] is not None and items.agg(F.sum("m")).first()[0] <= BROADCAST_SHINGLES:
        own = F.broadcast(own)

    narrow = docs.select(
        F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    # one generated column of words, so that no expression splits the text again
    worded = narrow.select(*DOC, F.explode(F.array(word_array(F.col("text")))).alias("words"))

    def bags(rows: DataFrame) -> DataFrame:
        """(doc, width, bag) for the widths of the items."""
        made = F.array(*[F.struct(F.lit(w).alias("width"), shingle_bag(F.col("words"), w).alias("bag")) for w in widths])
        return rows.select(*DOC, F.explode(made).alias("b")).select(*DOC, "b.width", "b.bag")

    empty = "doc_id bigint, text_hash bigint, item_id bigint, first_word int, similarity double"
    if not widths:
        return docs.sparkSession.createDataFrame([], empty)
    places = bags(worded).select(*DOC, "width", F.size("bag").alias("size"), F.posexplode("bag").alias("at", "shingle"))
    hits = places.join(own, ["width", "shingle"]).groupBy(*DOC, "item", "m", "width", "size").agg(
        F.collect_set("item_at").alias("found"), F.array_sort(F.collect_set("at")).alias("places")
    )
    window = F.least("m", "size")
    need = F.ceil((F.col("m") + window) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    close = hits.filter((F.size("found") >= need) & (F.size("places") >= need)).select(
        *DOC, "item", "width", window.alias("window"), "size", "places", need.alias("need")
    )
    # a start is possible if `need` found places lie in its window
    ranges = F.transform(
        F.sequence(F.lit(0), F.size("places") - F.col("need")),
        lambda j: F.struct(
            F.greatest(F.lit(0), F.get("places", j + F.col("need") - 1) - F.col("window") + 1).alias("low"),
            F.least(F.get("places", j), F.col("size") - F.col("window")).alias("high"),
        ),
    )
    starts = F.array_distinct(F.flatten(F.transform(F.filter(ranges, lambda r: r["low"] <= r["high"]), lambda r: F.sequence(r["low"], r["high"]))))
    close = work.save(close.select(*DOC, "item", "width", "window", starts.alias("starts")).filter(F.size("starts") > 0), "close")

    of_docs = worded.filter(may_hold(member_filter(close.select(*DOC).distinct(), DOC), DOC))
    texts = bags(of_docs.join(close.select(*DOC).distinct(), DOC, "left_semi")).dropDuplicates([*DOC, "width"])
    windows = close.join(texts, [*DOC, "width"]).select(*DOC, "item", "window", "bag", F.explode("starts").alias("start"))
    windows = windows.select(*DOC, "item", "start", F.slice("bag", F.col("start") + 1, F.col("window")).alias("part"))
    windows = work.save(windows, "windows")
    key = [*DOC, "item", "start"]
    prints = fingerprint(windows.select(*key, F.explode("part").alias("shingle")), key, "shingle")
    item_prints = fingerprint(items.select("item", F.explode("bag").alias("shingle")), ["item"], "shingle")
    item_prints = work.save(item_prints, "item-prints")
    prints = work.save(prints, "prints")

    blocks = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("fingerprint"), i).alias("value")) for i in range(BLOCKS)])
    keyed = prints.select(*key, "fingerprint", F.explode(blocks).alias("b")).select(*key, "fingerprint", "b.block", "b.value")
    met = keyed.join(item_index(item_prints), ["item", "block", "value"]).select(*key, "fingerprint").distinct()
    near = met.join(item_prints.withColumnRenamed("fingerprint", "other"), "item").filter(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= RADIUS
    )
    # shared shingles with their counts: a row per shingle of a window, whatever its length
    count = F.count(F.lit(1)).cast("int")
    held = items.select("item", "item_id", F.size("bag").alias("m"), F.explode("bag").alias("shingle"))
    held = held.groupBy("item", "item_id", "m", "shingle").agg(count.alias("wanted"))
    parts = near.select(*key).join(windows, key).select(*key, F.size("part").alias("n"), F.explode("part").alias("shingle"))
    shared = parts.groupBy(*key, "n", "shingle").agg(count.alias("have")).join(held, ["item", "shingle"])
    scored = (
        shared.groupBy(*key, "item_id", "m", "n")
        .agg(F.sum(F.least("have", "wanted")).alias("both"))
        .withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
        .filter(F.col("similarity") >= similarity)
    )
    best = scored.groupBy(*DOC, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("from"))).alias("best"))
    return best.select(*DOC, "item_id", (-F.col("best.from")).alias("first_word"), F.col("best.similarity").alias("similarity"))


def leaking_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word and similarity of every leak."""
    found = leaks(docs, benchmark)
    return found.select(
        F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "item_id", F.col("first_word").cast("long").alias("first_word"), F.round("similarity", 6).alias("similarity")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that leak an item; columns, of any names, and all other rows stay.

    Null, empty and wordless texts leak nothing. Rows that repeat go or stay together. With no
    documents or no items nothing goes.
    """
    work = Workspace(docs.sparkSession, "leaking")
    found = work.save(leaks(docs, benchmark, work=work).select(*DOC).distinct(), "documents")
    work.keep_only(found)
    rows = docs.select(
        packed(docs),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias(DOC[0]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(DOC[1]),
    )
    return unpacked(rows.join(found, DOC, "left_anti"), docs.columns)
