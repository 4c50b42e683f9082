"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms whose document frequency, counted over all documents, lies in a
band; terms that are too common or too rare say nothing about identity. A large group of
near copies makes its own terms common, so a text with less than a quarter of its distinct
terms inside the band is described by all its terms. Several random
subsets of it, from an eighth down to a 256th of its terms, each give one hash of the
document's distinct terms in the subset. A hash survives an edit that touches none of its
terms, so the share of equal hashes tells how alike two texts are. The hash of a set of terms
is the exclusive or of their hashes, which equals for equal sets and needs no sorted list
per document, so it is an ordinary partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pairframe.llm.common import Workspace
from pairframe.llm.decontaminate import word_array

#: Share of the documents a lexicon term occurs in.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.02
#: Below this share of terms inside the band, all terms of a text count.
LEAST_INSIDE = 0.25
#: Subset k keeps the terms whose hash ends in that many zero bits.
SUBSET_BITS = (3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8)
DIGITS = 6
#: A lexicon has at most (mean distinct terms of a document) / LEAST_SHARE terms; it is
#: broadcast up to this size and joined by shuffle beyond.
BROADCAST_TERMS = 1_000_000
ROWS_PER_BUCKET = 200_000
KEY = ["doc_id", "text_hash"]


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(word_array(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term): hashes of the terms inside the band, over all rows of `docs`.

    A term must occur in two documents at least. An empty table has an empty lexicon.
    """
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counted.filter((F.col("df") >= max(2, LEAST_SHARE * n)) & (F.col("df") <= max(2, MOST_SHARE * n))).select("term")


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str], terms: DataFrame) -> DataFrame:
    """Per key one fingerprint for each text column, null where a text has no term in any subset.

    A text uses its lexicon terms if they are `LEAST_INSIDE` or more of its distinct terms,
    else all its terms. `keys` must be unique. If `rows` is already partitioned by the keys,
    nothing is shuffled.
    """

    def of_kind(i: int, text: str) -> Column:
        return F.transform(term_hashes(F.col(text)), lambda h: F.struct(F.lit(i).alias("kind"), h.alias("term")))

    kinds = [of_kind(i, t) for i, t in enumerate(texts)]
    placed = rows.select(*keys, F.explode(F.concat(*kinds)).alias("x")).select(*keys, "x.kind", "x.term")
    held = placed.join(terms.withColumn("inside", F.lit(True)), "term", "left")
    parts = [F.count("*").alias("n")]
    for k, bits in enumerate(SUBSET_BITS):
        value = F.xxhash64(F.lit(k), F.col("term"))
        member = value.bitwiseAND(F.lit((1 << bits) - 1)) == 0
        parts.append(F.bit_xor(F.when(member, F.shiftrightunsigned(value, 64 - 4 * DIGITS))).alias(f"_{k}"))
    # terms inside and outside the band apart: both together give the hashes over all terms
    hashed = held.groupBy(*keys, "kind", F.coalesce("inside", F.lit(False)).alias("inside")).agg(*parts)
    cells = F.array(*[F.col(f"_{k}") for k in range(len(SUBSET_BITS))])
    sides = []
    for i, name in enumerate(texts):
        of_text = F.col("kind") == i
        for side, inside in (("in", F.col("inside")), ("out", ~F.col("inside"))):
            sides.append(F.first(F.when(of_text & inside, F.struct("n", cells.alias("cells"))), ignorenulls=True).alias(f"{name}_{side}"))
    joined = hashed.groupBy(*keys).agg(*sides)
    names = []
    for name in texts:
        a, b = F.col(f"{name}_in"), F.col(f"{name}_out")
        n_in, n_out = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
        both = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x.bitwiseXOR(y))
        all_cells = F.when(a.isNull(), b["cells"]).when(b.isNull(), a["cells"]).otherwise(F.zip_with(a["cells"], b["cells"], both))
        chosen = F.when(n_in >= LEAST_INSIDE * (n_in + n_out), a["cells"]).otherwise(all_cells)
        shown = F.transform(chosen, lambda x: F.coalesce(F.lpad(F.hex(x), DIGITS, "0"), F.lit("-" * DIGITS)))
        empty = "-" * (DIGITS * len(SUBSET_BITS))
        names.append(F.nullif(F.array_join(shown, ""), F.lit(empty)).alias(f"{name}_print"))
    return joined.select(*keys, *names)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms of; 1 for equal prints."""
    same, held = F.lit(0), F.lit(0)
    none = "-" * DIGITS
    for k in range(len(SUBSET_BITS)):
        x, y = (F.substring(c, 1 + k * DIGITS, DIGITS) for c in (a, b))
        some = (x != none) | (y != none)
        held = held + some.cast("int")
        same = same + (some & (x == y)).cast("int")
    return F.when(a == b, 1.0).when(F.substring(a, 1, 1).isin("t") | F.substring(b, 1, 1).isin("t"), 0.0).otherwise(
        F.coalesce(F.try_divide(same.cast("double"), held.cast("double")), F.lit(0.0))
    )


def next_documents(work: Workspace, ids: DataFrame) -> DataFrame:
    """KEY, n_chars and the key of the next document in descending order, around the end.

    Ids are dealt into ranges and ordered range by range; only one row per range, the
    first, is looked at as a whole to step from one range to the next.
    """
    buckets = max(1, -(-ids.count() // ROWS_PER_BUCKET))
    ranged = ids.repartitionByRange(buckets, *KEY).withColumn("bucket", F.spark_partition_id())
    ranged = work.save(ranged, "ranges")
    key = F.struct(*KEY)
    downwards = Window.partitionBy("bucket").orderBy(*[F.col(c).desc() for c in KEY])
    stepped = ranged.withColumn("next", F.lead(key).over(downwards))
    firsts = ranged.groupBy("bucket").agg(F.max(key).alias("first"))
    over_all = Window.orderBy("bucket")
    lower = firsts.withColumn("below", F.lag("first").over(over_all)).withColumn(
        "below", F.coalesce("below", F.max("first").over(Window.partitionBy()))
    )
    linked = stepped.join(lower.select("bucket", "below"), "bucket")
    return linked.select(*KEY, "n_chars", F.coalesce("next", "below").alias("next"))


def fingerprinted_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and neighbours are.

    Null texts count as empty. A text without terms in any subset, such as one without words,
    has a fingerprint of its whole text, `t` and a hash. Rows that repeat id and text are one document in the order and
    have one result each; null ids come last.
    """
    work = Workspace(docs.sparkSession, "imatch")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    terms = work.save(lexicon(narrow), "lexicon")
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    ids = narrow.select(*KEY, F.char_length("text").cast("long").alias("n_chars")).distinct()
    links = work.save(next_documents(work, ids), "links")

    # the part of the next text that each document takes over
    taken = links.select(
        F.col("next.doc_id").alias("doc_id"), F.col("next.text_hash").alias("text_hash"), F.struct(*KEY).alias("taker"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("size"),
    )
    texts = narrow.dropDuplicates(KEY) if not narrow.select(*KEY).groupBy(*KEY).count().filter("count > 1").isEmpty() else narrow
    pieces = texts.join(taken, KEY).select("taker.*", "size", F.substring(F.col("text"), F.lit(1), F.col("size")).alias("piece"))
    own = F.substring(F.col("text"), F.lit(1), (F.char_length("text") - F.col("size")).cast("int"))
    edited = texts.join(pieces, KEY).select(*KEY, "text", F.concat(own, "piece").alias("edited"))
    # generated once: hash, terms and fallback below use it
    edited = edited.select(*KEY, F.inline(F.array(F.struct("text", "edited"))))
    digests = edited.select(
        *KEY, F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_hash")
    )
    prints = fingerprints(edited, KEY, ["text", "edited"], terms)
    whole = work.save(
        digests.join(prints, KEY, "left").select(
            *KEY,
            "edited_sha256",
            F.coalesce("text_print", F.concat(F.lit("t"), F.hex("text_hash"))).alias("fingerprint"),
            F.coalesce("edited_print", F.concat(F.lit("t"), F.hex("edited_hash"))).alias("edited_fingerprint"),
        ),
        "prints",
    )
    following = whole.select(F.struct(*KEY).alias("next"), F.col("fingerprint").alias("next_print"))
    result = links.join(whole, KEY).join(following, "next").select(
        *KEY,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    return rows.join(result, KEY).drop("doc_id", "text_hash").withColumnRenamed("_id", "doc_id")
