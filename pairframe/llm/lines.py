"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct shingles of `SHINGLE` words; a shorter line is one shingle.
Two sets with Jaccard similarity t or more share a token among their first n - ceil(t n) + 1
(the prefix) in any order of tokens that is the same for all lines. Sizes and positions of the
shared token rule out most pairs, and what remains is verified on the full sets. Of two similar
lines the later one goes.

The join has two rounds. In the first the order is that of the token hashes, which costs no
pass. A pair that shares a prefix token held by at most `HEAVY` lines is found there. Any other
similar pair shares only heavier tokens, so both its lines hold one; those lines alone take the
second round, where their tokens are counted exactly and ordered by rarity.

Equal lines are one member of the join. In the first round a code has few members, so its pairs
are made in the task that finds them. In the second a member is first compared with the earliest
one of each of its buckets; only members without a match there meet all earlier ones, and bitmaps
of their tokens rule out most of those before a pair is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pairframe.llm.common import Workspace, packed

SHINGLE = 5
MIN_WORDS = 1
SIMILARITY = 0.75
#: A prefix token of more lines is heavy; its lines are ordered by exact rarity.
HEAVY = 32
FILTER_BITS = 22
#: Words of 64 bits, one bit per hashed token, that a member of the second round carries.
BITS = ["bits0", "bits1", "bits2", "bits3"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line): every line, lower-cased, tabs as spaces."""
    clean = F.lower(F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    return docs.select(
        F.col("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.posexplode(F.split(clean, "\n")).alias("line_no", "line")
    )


def coded(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines with enough words and, sorted, the distinct hashes of their shingles (`codes`).

    Words behind the end are null, which a hash leaves out: a shorter line is one shingle.
    """
    words = F.array_remove(F.split("line", " "), "")
    enough = F.trim("line") != "" if min_words == 1 else F.size(words) >= min_words

    def shingles(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - SHINGLE, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))

    # in an array of one, the words' hashes are worked out once and read without a copy
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    codes = F.get(F.transform(hashes, shingles), F.lit(0))
    return lines.filter(enough).select(*lines.columns, F.sort_array(F.array_distinct(codes)).alias("codes"))


def constant_array(values: list[int], kind: str) -> Column:
    """One literal array; a list of single literals would be analysed one by one."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _least_overlap(a: Column, b: Column, similarity: float) -> Column:
    return F.ceil((a + b) * similarity / (1 + similarity) - 1e-9)


def member_filter(ids: DataFrame, columns: list[str]) -> list[int]:
    """A bitmap of constant size over hashed ids; rows whose bit is unset are surely not among them."""
    place = F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS)
    words = [0] * (1 << (FILTER_BITS - 6))
    rows = ids.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit"))
    bits = rows.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits"))
    for row in bits.collect():
        words[row.w] = row.bits
    return words


def may_hold(words: list[int], columns: list[str]) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS)
    word = F.get(constant_array(words, "bigint"), F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


LINE = ["doc_id", "text_hash", "line_no"]


def line_keys(line: Column) -> list[Column]:
    """Two hashes of a line without white space at its ends; equal keys are taken for equal lines."""
    bare = F.trim(line)
    return [F.xxhash64(bare).alias("key1"), F.xxhash64(F.lit(17), bare).alias("key2")]


KEY = ["key1", "key2"]


def _left_out(n: Column, similarity: float) -> Column:
    """Tokens of n behind the prefix: one less than a similar line must share."""
    return F.ceil(n * similarity - 1e-9) - 1


def prefix_of(codes: Column, similarity: float) -> Column:
    n = F.size(codes)
    return F.slice(codes, 1, (n - _left_out(n, similarity)).cast("int"))


def _can_reach(n1: Column, at1: Column, n2: Column, at2: Column, similarity: float) -> Column:
    """Whether sizes and places of a shared token allow the similarity."""
    sizes = F.least(n1, n2) >= F.greatest(n1, n2) * similarity - 1e-9
    # what is shared lies before the token in both, behind it in both, or is the token
    most = F.least(at1, at2) + F.least(n1 - at1, n2 - at2)
    return sizes & (most >= _least_overlap(n1, n2, similarity))


def _bits(code: Column) -> list[Column]:
    """Of a group of codes, a bitmap with one bit set per code."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(code, 2).bitwiseAND(F.lit(63))).cast("int"))
    word = code.bitwiseAND(F.lit(len(BITS) - 1))
    return [F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("long")).alias(c) for w, c in enumerate(BITS)]


def _common(side: str, other: str) -> Column:
    """The most tokens that one member can share: the common ones, but those whose bit the other lacks."""
    lacking = [F.bit_count(F.col(c + side).bitwiseAND(F.bitwise_not(F.col(c + other)))) for c in BITS]
    return F.col("common" + side) - sum(lacking[1:], lacking[0])


def meet(late: DataFrame, early: DataFrame, similarity: float) -> DataFrame:
    """(later, earlier, n1, at1, n2, at2): members of one code whose tokens may allow the similarity.

    Members (code, m, id, n, at, common, *BITS) are named by the number `m` of their set; ids tell
    which is later. Of its n tokens, `common` are held by other sets too; those are in the bitmap,
    and all others come first in the order, before `at`. Lines of one passage differ in their own
    words, so their counts and bitmaps tell most of them apart before a pair is made.
    """
    columns = ["m", "id", "n", "at", "common", *BITS]
    left, right = (x.select("code", *[F.col(c).alias(c + side) for c in columns]) for x, side in ((late, "1"), (early, "2")))
    n1, at1, n2, at2 = (F.col(c) for c in ("n1", "at1", "n2", "at2"))
    # places among the common tokens, of which alone a pair can share any before the code
    near = _can_reach(n1, at1, n2, at2, similarity)
    before = [F.col("at" + i) - (F.col("n" + i) - F.col("common" + i)) for i in "12"]
    most = F.least(F.least(*before) + F.least(n1 - at1, n2 - at2), _common("1", "2"), _common("2", "1"))
    allowed = near & (most >= _least_overlap(n1, n2, similarity))
    met = left.join(right, "code").filter((F.col("id1") > F.col("id2")) & allowed)
    return met.select(F.col("m1").alias("later"), F.col("m2").alias("earlier"), "n1", "at1", "n2", "at2")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(m) of the later lines of the pairs (a, b), in any order, whose full sets reach the similarity."""
    one, other = (sets.select(*[F.col(c).alias(f"{n}_{c}") for c in ("m", "id", "codes")]) for n in ("a", "b"))
    met = pairs.join(one, F.col("a") == F.col("a_m")).join(other, F.col("b") == F.col("b_m"))
    sizes = F.size("a_codes") + F.size("b_codes")
    # in an array of one, the intersection is worked out once
    both = F.array(F.size(F.array_intersect("a_codes", "b_codes")))
    found = met.filter(F.exists(both, lambda n: n >= similarity * (sizes - n)))
    return found.select(F.when(F.col("a_id") > F.col("b_id"), F.col("a")).otherwise(F.col("b")).alias("m")).distinct()


def similar_members(work: Workspace, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(m) of the members (see `meet`) similar to an earlier one of one of their codes.

    Members hold every prefix token of their lines, so that all shared ones of a pair bound its
    overlap together.
    """
    pair = [F.col("later").alias("a"), F.col("earlier").alias("b")]
    firsts = members.groupBy("code").agg(F.min(F.struct("id", "m", "n", "at", "common", *BITS)).alias("first"), F.count("*").alias("held"))
    firsts = work.save(firsts.filter("held > 1").select("code", "first.*"), "firsts")
    star = work.save(meet(members, firsts, similarity).select(*pair).distinct(), "star")
    gone = work.save(verified(star, sets, similarity), "gone")
    standing = members.join(gone, "m", "left_anti").join(firsts.select("code"), "code", "left_semi")
    pairs = possible(meet(standing, members, similarity), similarity).select(*pair)
    rest = work.save(pairs.join(star, ["a", "b"], "left_anti"), "rest")
    found = gone.unionByName(verified(rest, sets, similarity))
    found = work.save(found, "similar")
    work.drop(firsts, star, gone, rest)
    work.release()
    return found


def possible(candidates: DataFrame, similarity: float) -> DataFrame:
    """Pairs (later, earlier) that the sizes and places of all their shared prefix tokens allow.

    What can still be shared lies behind the last shared token of the prefixes, in both. It also
    lies behind the prefix that ends first in the order, since the other one holds all up to there.
    """
    met = candidates.groupBy("later", "earlier").agg(
        F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.count("*").alias("met"), F.max("at1").alias("at1"), F.max("at2").alias("at2")
    )
    left_out = _left_out(F.greatest("n1", "n2"), similarity)
    most = F.col("met") + F.least(F.col("n1") - F.col("at1") - 1, F.col("n2") - F.col("at2") - 1, left_out)
    return met.filter(most >= _least_overlap(F.col("n1"), F.col("n2"), similarity)).select("later", "earlier")


def by_rarity(work: Workspace, sets: DataFrame, similarity: float) -> DataFrame:
    """Members (see `meet`): prefixes of the sets, their tokens ordered by exact counts over the sets."""
    long = sets.select("m", F.explode("codes").alias("code"))
    counts = work.save(long.groupBy("code").agg(F.count("*").cast("int").alias("held")).filter("held > 1"), "counts")
    work.release()
    # a token of one line alone meets nothing; all such come first, so their number places the others
    shared = long.join(counts, "code").groupBy("m")
    ranked = shared.agg(F.sort_array(F.collect_list(F.struct("held", "code"))).alias("ranked"), *_bits(F.col("code")))
    sizes = sets.select("m", "id", F.size("codes").alias("n"))
    alone = F.col("n") - F.size("ranked")
    length = F.col("n") - _left_out(F.col("n"), similarity)
    inside = F.slice("ranked", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))
    common = F.size("ranked").alias("common")
    first = ranked.join(sizes, "m").select("m", "id", "n", common, *BITS, F.posexplode(inside).alias("at", "token"))
    at = (F.col("n") - F.col("common") + F.col("at")).alias("at")
    members = first.select(F.col("token.code").alias("code"), "m", "id", "n", at, "common", *BITS)
    members = work.save(members, "members")
    work.drop(counts)
    work.release()
    return members


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed): sorted numbers (from 0) of the lines that go, per document that loses any.

    A line goes if an earlier line of the corpus is equal or similar; earlier means a
    smaller (doc_id, text hash, line number), judged on the input. Lines of fewer than
    `min_words` words always stay. Null ids come first; rows that repeat id and text are
    one document, and their lines do not remove each other.
    """
    work = Workspace(docs.sparkSession, "lines")
    safe = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    raw = raw_lines(safe)
    identity = F.struct(*LINE)
    prefixes = coded(raw, min_words).select(
        identity.alias("id"), *line_keys(F.col("line")), F.size("codes").alias("n"), prefix_of(F.col("codes"), similarity).alias("prefix")
    )
    # one member per distinct line, at its first place, with a number that names it from here on
    distinct = prefixes.groupBy(*KEY).agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    distinct = work.save(distinct.withColumn("m", F.monotonically_increasing_id()), "distinct")
    work.release()
    # narrow rows for the one large exchange; most codes are alone and end in it, and of a hot
    # one each task sends HEAVY + 1 rows
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at"))
    rows = distinct.select("m", "n", F.posexplode("prefix").alias("at", "code")).select("code", "m", place.alias("place"))
    by_code = Window.partitionBy("code")
    in_order = by_code.orderBy("m")
    few = rows.withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= HEAVY + 1)
    # most codes have one row, which goes before the rows of the others are counted
    few = few.withColumn("next", F.lead("m").over(in_order)).filter("nth > 1 or next is not null")
    few = few.withColumn("held", F.count("*").over(by_code))
    # the pairs of a code are made where its rows have met: each member with those behind it
    behind = F.collect_list(F.struct("m", "place")).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    hot = F.col("held") > HEAVY
    shared = few.select("code", "m", "place", hot.alias("hot"), F.when(~hot, behind).alias("behind"))
    shared = work.save(shared.filter("hot or size(behind) > 0"), "shared")
    work.release()
    heavy = work.save(shared.filter("hot").select("code").distinct(), "heavy")
    again = work.save(rows.join(heavy, "code", "left_semi").select("m").distinct(), "again")
    light = shared.filter("not hot").select("m", "place", F.explode("behind").alias("other"))
    sizes = [F.shiftright(p, 32).cast("int") for p in ("place", "other.place")]
    ats = [F.col(p).bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for p in ("place", "other.place")]
    near = _can_reach(sizes[0], ats[0], sizes[1], ats[1], similarity)
    # all that a pair shares in its prefixes is light and has met, unless both lines take part in the second round
    met = light.filter(near).select(
        F.col("m").alias("later"), F.col("other.m").alias("earlier"),
        sizes[0].alias("n1"), ats[0].alias("at1"), sizes[1].alias("n2"), ats[1].alias("at2"),
    )
    pairs = possible(met, similarity).select(F.col("later").alias("a"), F.col("earlier").alias("b"))
    pairs = work.save(pairs, "pairs")
    repeated = work.save(distinct.filter("copies > 1").select(*KEY, "id"), "repeated")

    # only lines of a pair or of the second round; whether a line takes part in that one goes with
    # it, so that no set is shuffled to tell
    ends = pairs.select(F.explode(F.array("a", "b")).alias("m"), F.lit(False).alias("again"))
    both = ends.unionByName(again.withColumn("again", F.lit(True)))
    wanted = both.groupBy("m").agg(F.max("again").alias("again"))
    wanted = work.save(distinct.select("m", "id").join(wanted, "m"), "wanted")
    work.drop(shared, heavy, again, distinct)
    work.release()
    keys = wanted.select("m", "again", "id.*")
    # rows that repeat are dropped where the join has put them
    maybe = raw.filter(may_hold(member_filter(keys, LINE), LINE)).join(keys, LINE).dropDuplicates(LINE)
    sets = coded(maybe, min_words).select("m", identity.alias("id"), "codes", "again")
    sets = work.save(sets, "sets")
    work.drop(wanted)
    work.release()
    found = work.save(verified(pairs, sets, similarity), "found")
    work.drop(pairs)
    work.release()
    rare = sets.filter("again").drop("again")
    members = by_rarity(work, rare, similarity)
    found = found.unionByName(similar_members(work, members, rare, similarity))
    near = work.save(sets.join(found, "m", "left_semi").select("id"), "near")
    work.drop(sets, members)
    work.release()

    places = raw.filter(F.trim("line") != "").select(*LINE, *line_keys(F.col("line")))
    copies = places.join(repeated, KEY).filter(F.struct(*LINE) != F.col("id")).select(*LINE)
    every = copies.unionByName(near.select("id.*"))
    removed = every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    removed = work.save(removed, "removed")
    work.keep_only(removed)
    return removed


def _with_removed(docs: DataFrame, **options) -> DataFrame:
    """(row, removed): every row packed as a struct, whatever its columns are called, and the
    sorted numbers of its lines that go."""
    removed = removed_lines(docs, **options)
    none = F.array().cast("array<int>")
    rows = docs.select(
        packed(docs),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"),
        text_hash(F.col("text")).alias("text_hash"),
    )
    # only texts that may lose lines are shuffled
    key = ["doc_id", "text_hash"]
    held = may_hold(member_filter(removed, key), key)
    touched = rows.filter(held).join(removed, key, "left").select("row", F.coalesce("removed", none).alias("removed"))
    return touched.unionByName(rows.filter(~held).select("row", none.alias("removed")))


def with_removed(docs: DataFrame, **options) -> DataFrame:
    """`docs` and the sorted line numbers `removed_lines` of each row, empty where nothing goes.

    A column `removed_lines` of the input is replaced; any other name may occur.
    """
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "removed_lines"]
    return _with_removed(docs, **options).select(*kept, F.col("removed").alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its columns; the text of every row without its removed lines.

    A row that loses lines and keeps no word in any other is dropped; null and empty texts
    stay as they are, and so does every row that loses nothing. Columns may have any names.
    """
    marked = _with_removed(docs, **options)
    lost = F.size("removed") > 0
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    result = marked.withColumn("kept", F.when(lost, kept)).filter(~lost | (F.trim("kept") != ""))
    text = F.when(lost, F.col("kept")).otherwise(F.col("row.text"))
    return result.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines of every document; no text is shuffled."""
    removed = removed_lines(docs, **options)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"),
        text_hash(F.col("text")).alias("text_hash"),
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
    )
    found = rows.join(removed.withColumnRenamed("doc_id", "_id"), ["_id", "text_hash"], "left")
    lost = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(lost).cast("long").alias("n_removed"), lost.alias("removed_lines"))
