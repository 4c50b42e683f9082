"""Each operator against a plain version, on the smallest table and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairframe.llm import bpe, decontaminate, imatch, licenses, lines, minhash, pitman_yor, quality, sharding, suffixes
from pairframe.llm.queries import QUERIES
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", 1),
    (2, LONG, "en", "a", 1),
    (2, LONG, "en", "a", 1),
    (3, LONG + " more", None, None, None),
    (4, None, "en", "a", 0),
    (5, "", "en", "a", 0),
    (6, " \n\t ", "en", "a", 0),
    (7, "one two", "en", "a", 7),
    (8, "é\x00É <|endoftext|> 日本 \U0001f600 don't", "en", "a", 7),
    (9, ("spam " * 40_000).strip(), "en", "a", 7),
    (10, "x" * 5_000, "en", "a", 7),
    (None, "no id here at all, only words", "en", "a", 7),
]
QUERY_TABLES = sorted(QUERIES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(10, 40))), (2, None), (3, ""), (4, "one two"), (4, "one two")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 11)] + [(1, 0, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


VECTORS = [(1, [0.5] * 64), (1, [0.5] * 64), (2, None), (3, [0.5] * 63), (4, [float("nan")] * 64), (None, [-1.0] * 64)]


def run_on(tmp_path, spark, name, documents, labels, benchmark):
    vectors = spark.createDataFrame(VECTORS if not documents.isEmpty() else [], "vec_id bigint, embedding array<float>")
    for table, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark), ("embeddings", vectors)):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    return QUERIES[name](spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", QUERY_TABLES)
def test_awkward_rows(spark, tmp_path, name, docs, labels, benchmark):
    extra = docs.withColumns({c: F.lit("clash") for c in ("shard", "score", "node", "key", "block", "label", "words", "id")})
    rows = run_on(tmp_path, spark, name, extra, labels, benchmark)
    if name.startswith("op8"):
        assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    elif name.startswith("op11"):
        assert {(r.item_id, r.rank) for r in rows} == {(1, 1), (1, 2), (1, 3), (1, 4), (4, 1)} and len(rows) == 5
    else:
        assert len(rows) == (3 if name.startswith("op12") else len(ROWS))


@pytest.mark.parametrize("name", QUERY_TABLES)
def test_empty_tables(spark, tmp_path, name, docs, labels, benchmark):
    assert run_on(tmp_path, spark, name, docs.limit(0), labels.limit(0), benchmark.limit(0)) == []


def test_shards_are_even_and_gapless(small, pairs):
    rows = sharding.sharded_documents(small, 7).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(sizes.values()) == sum(len(t.encode()) + 16 for _, t in pairs)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_cut_a_hot_text_and_keep_the_order(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(600)], "doc_id bigint, text string")
    placed = sharding.shard(rows, [F.xxhash64("text"), F.col("doc_id")], F.lit(10), 6, rows_per_piece=20).collect()
    counts = [sum(r.shard == s for r in placed) for s in range(6)]
    assert sum(counts) == 600 and max(counts) - min(counts) <= 2
    assert len({r.shard for r in placed if r.text == "same"}) >= 4
    keyed = rows.withColumn("key", F.xxhash64("text"))
    bounds = sharding.find_splitters(keyed.withColumn("size", F.lit(10)), ["key", "doc_id"], "size", 6)
    assert len(bounds) == 5 and [b.value for b in bounds] == sorted(b.value for b in bounds)


def test_license_base_columns(small, pairs):
    texts = dict(pairs)
    for r in licenses.licensed_documents(small).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain.base_licenses(texts[r.doc_id])


def test_license_rules_resolve_overlaps(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "under the GNU Lesser General Public License and the MIT License, mit license",
        "redistribute it and/or modify it under the terms of the GNU General Public License",
        "a licence to kill",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert rows[0].labels == "cc-by,cc-by-nc" and rows[0].first_word == 2 and rows[0].score == 0.95
    assert rows[1].labels == "apache" and rows[1].n_base == 0 and rows[1].score == 1.0
    assert rows[2].labels == "lgpl,mit" and rows[2].n_base == 2
    assert rows[3].labels == "gpl" and rows[3].base_labels == "gpl"
    assert rows[4].labels == "" and rows[4].score == 0
    assert len(licenses.signature_rules()) > 200


def test_near_duplicates(small, pairs):
    wanted = plain.duplicate_groups(pairs)
    for r in minhash.duplicate_documents(small).collect():
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_in_a_large_group(spark):
    """A chain of edits: neighbours are linked, its ends are not, and a bucket spans blocks."""
    randomly = random.Random(3)
    base = [f"w{randomly.random()}" for _ in range(120)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(randomly.choice([1, 2, 6])):
            text[randomly.randrange(120)] = f"n{randomly.random()}"
        rows.append((i, " ".join(text)))
    found = minhash.duplicate_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    wanted = plain.duplicate_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == wanted


def test_keep_one_keeps_one(docs):
    rows = minhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 4, 5, 6, 7, 8, 9, 10] and rows[0].__fields__ == docs.columns


def test_quality_is_learnt(spark):
    randomly = random.Random(1)
    make = lambda good: " ".join(randomly.choice("abcdefgh" if good else "$%&|") * 3 for _ in range(30))
    rows = [(i, make(i % 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    scored = quality.scored_documents(docs, labels).collect()
    assert {r.held_out for r in scored} == {True, False}
    assert all(0 <= r.score <= 1 and r.predicted == r.doc_id % 2 for r in scored)


def test_quality_without_labels_is_the_prior(docs, labels):
    assert {r.score for r in quality.scored_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_repeated_bytes(small, pairs):
    wanted = plain.repeated(pairs)
    for r in suffixes.repeated_bytes(small).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[r.doc_id]


def test_repeated_bytes_at_the_edges(spark):
    core = "".join(chr(97 + i % 23) + chr(65 + i * 7 % 26) for i in range(25))
    rows = [(1, "ab" + core + "yz"), (2, core), (3, core[:49]), (4, "é" + core + core), (5, core[1:] + "!"), (6, "a" * 200), (7, "a" * 60)]
    wanted = plain.repeated(rows)
    found = suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == wanted


def test_fingerprints(small, pairs):
    order = sorted(pairs, reverse=True)
    rows = {r.doc_id: r for r in imatch.fingerprinted_documents(small).collect()}
    prints = {}
    for n, (i, text) in enumerate(order):
        after, k = order[(n + 1) % len(order)], len(text) // 3
        edited = text[: len(text) - k] + after[1][:k]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1
        assert prints.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint
        if text == after[1]:
            assert rows[i].near_next == 1
    assert sum(r.near_edited for r in rows.values()) > 10 * sum(r.near_next for r in rows.values())


def test_next_document_over_ranges(spark, monkeypatch):
    from pairframe.llm.common import Workspace

    monkeypatch.setattr(imatch, "ROWS_PER_BUCKET", 5)
    ids = spark.range(1, 41).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(3).alias("n_chars"))
    after = {r.doc_id: r.next.doc_id for r in imatch.next_documents(Workspace(spark, "test"), ids).collect()}
    assert after == {i: i - 1 or 40 for i in range(1, 41)}


def test_language_model(small, pairs):
    wanted, n = plain.base_scores(pairs)
    rows = pitman_yor.scored_documents(small).collect()
    for r in rows:
        out, tokens, known, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one(spark):
    """Probabilities of all words, the end and the unknown one after a word."""
    train = [(i, "a b a c a b", False) for i in range(30)]
    probes = [(100 + k, f"a {w}".strip(), True) for k, w in enumerate(["", "a", "b", "c", "zzz"])]
    df = spark.createDataFrame(train + probes, "doc_id bigint, text string, held_out boolean")
    rows = {r.doc_id: r for r in pitman_yor.score_texts(df).collect()}
    start = spark.createDataFrame([*train, (200, "", True)], "doc_id bigint, text string, held_out boolean")
    assert rows[100].n_known == 2 and rows[104].n_known == 2
    ends = {w: 10 ** rows[100 + k].score for k, w in enumerate(["", "a", "b", "c", "zzz"])}
    assert ends["b"] > ends["a"] and ends["b"] > ends["zzz"] and start.count() == 31
    assert sum(ends.values()) < 1


def test_leaks(spark, small, pairs):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    wanted = plain.leaks(pairs, [(r.item_id, r.text) for r in items.collect()])
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.leaking_documents(small, items).collect()}
    assert found == wanted


def test_leaks_of_edited_and_short_items(docs, benchmark):
    found = {(r.doc_id, r.item_id): r.first_word for r in decontaminate.leaking_documents(docs, benchmark).collect()}
    assert found == {(1, 1): 10, (2, 1): 10, (3, 1): 10, (7, 4): 0}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect() if r.doc_id) == [4, 5, 6, 8, 9, 10]


def test_bpe_equals_the_library(docs, pairs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    randomly = random.Random(5)
    pool = [chr(c) for c in (*range(0x250), 0x2028, 0x3000, 0x1F600)] + [" ", "  ", "'ll", "the", "<|endoftext|>"] * 20
    texts = [t for _, t in pairs] + [r[1] for r in ROWS] + ["".join(randomly.choices(pool, k=40)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in bpe.encode_decode(df).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_by_heap():
    coder = bpe.coder(bpe.default_vocabulary())
    word = "".join(random.Random(2).choices("abcd", k=2 * bpe.LONG_WORD)).encode()
    limit, bpe.LONG_WORD = bpe.LONG_WORD, 10**9
    try:
        by_scan = coder.encode_word(word)
    finally:
        bpe.LONG_WORD = limit
    assert coder.encode_word(word) == by_scan


def test_lines(small, pairs):
    wanted = plain.lines_removed(pairs)
    rows = lines.line_counts(small).collect()
    assert {r.doc_id: list(r.removed_lines) for r in rows} == wanted
    assert all(r.n_removed == len(r.removed_lines) for r in rows)


def test_line_texts(spark):
    line = " ".join(f"tok{i}" for i in range(20))
    near = line.replace("tok19", "other")
    rows = [(1, f"{line}\nshort line"), (2, f"fresh words to keep in this place\n{near}"), (3, line), (4, f"{line}\n{line}"), (5, None)]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in kept} == {1: rows[0][1], 2: "fresh words to keep in this place", 5: None}


@pytest.mark.parametrize("heavy", [1, 2, 16])
def test_lines_in_both_rounds(spark, monkeypatch, heavy):
    """Lines with a common passage, near copies, short lines, and repeats, whatever counts as heavy."""
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rng = random.Random(heavy)
    passage = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((8, 12, 30)))]
        near = [*passage, *(f"n{i % 4}x{j}" for j in range(8))]
        near[rng.randrange(len(near))] = f"c{i}"
        text = [" ".join(passage + own), " ".join(own), " ".join(near), rng.choice(("one two", "x", "", "a b c d")), "the same line of seven words here"]
        rows.append((i, "\n".join(text)))
    found = lines.line_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed_lines) for r in found} == plain.lines_removed(rows)


def test_lines_do_not_shuffle_sets_to_choose_them(spark, monkeypatch):
    """Sets are told apart where the join has put them, and those of the second round by a column."""
    plans, save = {}, lines.Workspace.save

    def spy(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(lines.Workspace, "save", spy)
    monkeypatch.setattr(lines, "HEAVY", 2)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*words, f"x{i}"]) + f"\nalone {i}") for i in range(6)] + [(6, "")]
    found = lines.line_counts(spark.createDataFrame([*rows, rows[2]], "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed_lines) for r in found} == plain.lines_removed(rows)
    assert "hashpartitioning(id#" not in plans["sets"]
    assert "LeftSemi" not in plans["counts"]


def test_lines_of_a_pair_meet_once(spark, monkeypatch):
    """The first round numbers lines, makes the pairs of a code where its rows have met, and
    stores the sets of lines that have a possible partner, not of all that share a code."""
    plans, stored, save = {}, {}, lines.Workspace.save

    def spy(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        result = save(self, df, name)
        stored.setdefault(name, result.count())
        return result

    monkeypatch.setattr(lines.Workspace, "save", spy)
    line = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(line)), (2, " ".join([*line[:39], "x"])), (3, " ".join(line[:5]))]
    rows += [(10 + i, " ".join(f"own{i}x{j}" for j in range(30)) + " " + " ".join(line)) for i in range(3)]
    found = lines.line_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed_lines) for r in found} == plain.lines_removed(rows)
    assert "Join" not in plans["shared"] and "Join" not in plans["pairs"]
    assert stored["sets"] < stored["distinct"]


def test_lines_of_one_passage_make_few_pairs(spark, monkeypatch):
    """Lines that share a passage, but not enough of it, are told apart before a pair is made."""
    made, meet = [], lines.meet

    def spy(*args):
        result = meet(*args)
        made.append(result.count())
        return result

    monkeypatch.setattr(lines, "meet", spy)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([*passage, *(f"own{i}x{j}" for j in range(2 if i % 20 == 0 else 5))])) for i in range(60)]
    found = lines.line_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed_lines) for r in found} == plain.lines_removed(rows)
    assert sum(r.n_removed for r in found) > 0
    assert len(made) == 2 and sum(made) < 10 * len(rows)


def test_possible_pairs_share_enough_of_their_prefixes(spark):
    """What one prefix holds and the other does not is not shared, up to where one of them ends."""
    rows = [("one", "a", 42, 0, 42, 0)]
    rows += [("four", "a", 42, at, 42, at) for at in range(4)]
    rows += [("six", "a", 42, at, 42, at) for at in range(6)]
    rows += [("shorter", "a", 42, 0, 32, 0), ("longer", "a", 32, 0, 42, 0)]
    pairs = spark.createDataFrame(rows, "later string, earlier string, n1 int, at1 int, n2 int, at2 int")
    assert {r.later for r in lines.possible(pairs, 0.75).collect()} == {"six", "shorter", "longer"}


@pytest.mark.parametrize("least", [1, 3, 6])
def test_short_and_odd_lines(spark, least):
    """Lines around the width of a shingle, with repeated words, blanks and other white space."""
    texts = ["a", "a b", "b a", "a b c d", "a b c d e", "a b c d  e ", "a a a a a a a", "a a a a a a", " ", "", "\t", "\x0b", "A\tB", "a b c", "ä ö", "Ä Ö"]
    rows = [(i, t) for i, t in enumerate([*texts, "\n".join(texts), None])]
    found = lines.line_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=least).collect()
    assert {r.doc_id: list(r.removed_lines) for r in found} == plain.lines_removed(rows, least=least)
    assert {r.doc_id: r.n_lines for r in found} == {i: len(t.split("\n")) if t is not None else 0 for i, t in rows}


CLASHES = ["_id", "_hash", "_quality", "_text", "removed_lines", "removed", "row", "id", "hash", "own_id", "own_hash", "rows", "text_hash", "quality", "vector", "item", "code", "a b", "_rows"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stages_on_awkward_rows_and_names(spark, name):
    """What stays is what the stage keeps without the extra columns, and their values stay with it."""
    stage = dict(corpus_pipeline.STAGES)[name]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    prose = "It was a quiet morning and the river ran slowly past the old mill house. " * 6
    texts = [None, "", "   ", prose, prose, prose + "more", f"before {item} after", "short", "short\n" + "long words here to keep", "x " * 9_000]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, prose, "en", "web", len(prose)), (None, "nobody knows this id", "en", "web", 20), (None, None, "en", "web", 0)]
    plain_docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = plain_docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES])
    key = lambda df: sorted((repr(r.doc_id), repr(r.text), r.n_chars) for r in df.collect())
    expected, out = stage(spark, plain_docs, SF_DIR), stage(spark, wide, SF_DIR)
    assert out.columns == wide.columns and expected.columns == plain_docs.columns
    assert key(expected) == key(out) and len(key(out)) > 0
    for r in out.collect():
        assert all(r[c] == f"{c}:{'?' if r.doc_id is None else r.doc_id}" for c in CLASHES)
    assert stage(spark, wide.limit(0), SF_DIR).collect() == []
    kept = {r.doc_id for r in out.collect()}
    if name == "minhash_near_dedup":
        assert {0, 1, 2, 3, 7}.issubset(kept) and 4 not in kept and 5 not in kept
    elif name == "benchmark_decontamination":
        assert kept == {None, *range(10)} - {6}
    elif name == "line_dedup":
        texts_of = {r.doc_id: r.text for r in out.collect()}
        assert texts_of[8] == "long words here to keep" and 4 not in kept and texts_of[0] is None and texts_of[1] == ""


def test_leak_of_a_long_item(spark):
    """An item of 3,000 words inside a document of 6,000; its windows are scored in one pass."""
    rng = random.Random(9)
    item = " ".join(f"w{rng.randint(0, 10_000)}" for _ in range(3_000))
    around = " ".join(f"v{i}" for i in range(1_500))
    docs = spark.createDataFrame([(1, f"{around} {item} {around}"), (2, around)], "doc_id bigint, text string")
    found = decontaminate.leaking_documents(docs, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.similarity) for r in found] == [(1, 5, 1_500, 1.0)]


def test_components_of_chains(spark):
    from pairframe.llm.common import Workspace, components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components(Workspace(spark, "test"), df).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}}


def test_pipeline_stage_by_stage(spark, small, pairs):
    """Every stage against its plain version, on what its predecessor kept."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    docs, columns = small, small.columns
    state = dict(pairs)
    from pairframe.llm.common import Workspace

    work = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = work.save(stage(spark, docs, SF_DIR), name)
        if name == "bpe_encoding":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert all(i in state for i in after) and sum(q for i, q in labels.items() if i in state and i not in after) <= 2
        elif name == "line_dedup":
            gone = plain.lines_removed(list(state.items()))
            cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in state.items()}
            assert after == {i: t for i, t in cut.items() if not gone[i] or t.strip()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "minhash_near_dedup":
            groups = plain.duplicate_groups(list(state.items()))
            assert set(after) == {i for i, (_, g) in groups.items() if g == i}
        else:
            assert set(after) == set(state) - {i for i, _ in plain.leaks(list(state.items()), items)}
        state = after
    coded = docs.collect()
    assert {r.doc_id for r in coded} == set(state) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in coded)


def test_language_model_has_every_context(spark):
    """The word after each of 600 contexts, more than any fixed number of frequent ones, is learnt."""
    train = [(i, f"c{i % 600} d{i % 600}", False) for i in range(3000)]
    probes = [(10_000 + k, f"c{k} d{k}", True) for k in range(600)] + [(20_000 + k, f"c{k} d{(k + 1) % 600}", True) for k in range(600)]
    df = spark.createDataFrame(train + probes, "doc_id bigint, text string, held_out boolean")
    score = {r.doc_id: r.score for r in pitman_yor.score_texts(df).collect()}
    assert all(score[10_000 + k] > score[20_000 + k] + 1 for k in range(600))


def test_language_model_backs_off(spark):
    """A rare context keeps its own word; contexts that training lacks are all scored by the parent."""
    train = [(i, "a b a c a b", False) for i in range(30)] + [(50 + i, "rare c", False) for i in range(5)]
    probes = [(100 * n + k, f"{u} {w}", True) for n, u in enumerate(("rare", "new", "other"), 1) for k, w in enumerate("abc")]
    df = spark.createDataFrame(train + probes, "doc_id bigint, text string, held_out boolean")
    score = {r.doc_id: r.score for r in pitman_yor.score_texts(df).collect()}
    assert all(score[200 + k] == score[300 + k] for k in range(3))
    assert score[102] - score[101] > score[202] - score[201] + 0.3


def test_seating_is_that_of_the_restaurant():
    """Tables of a dish of two, three and more customers against their exact distribution."""
    import numpy as np

    def expected(c, d, strength, base):
        """Mean tables: ways to seat c customers at t tables times the odds of opening t."""
        ways = {1: 1.0}
        for n in range(1, c):
            ways = {t: ways.get(t, 0) * (n - d * t) + ways.get(t - 1, 0) for t in range(1, n + 2)}
            scale = max(ways.values())
            ways = {t: w / scale for t, w in ways.items()}
        odds = {t: w * np.prod([(strength + d * k) * base for k in range(t)]) for t, w in ways.items()}
        return sum(t * o for t, o in odds.items()) / sum(odds.values())

    random = np.random.default_rng(1)
    for c, n in ((2, 3000), (3, 3000), (6, 3000), (100, 300), (100, 3)):
        customers = np.full(n, c)
        sizes, tables, seen = customers, np.ones(n, int), []
        for sweep in range(60 if n > 3 else 6000):
            sizes, tables = pitman_yor.reseat(customers, sizes, tables, 0.6, np.full(n, 20.0), np.full(n, 0.05), random)
            assert sizes.sum() == c * n and len(sizes) == tables.sum()
            seen += [tables.mean()] if sweep >= 10 else []
        assert np.mean(seen) == pytest.approx(expected(c, 0.6, 20.0, 0.05), rel=0.04)


def test_customers_of_a_dish_are_seated_together(monkeypatch):
    """Dishes of up to `TOGETHER` customers are not moved one by one; one draw has the tables of a long run."""
    import numpy as np

    moved, move_each = [], pitman_yor.move_each
    monkeypatch.setattr(pitman_yor, "move_each", lambda customers, *rest: moved.extend(customers) or move_each(customers, *rest))
    random = np.random.default_rng(2)
    customers = np.array([0, 1, 2, 5, 40, 600, pitman_yor.TOGETHER])
    sizes, tables = pitman_yor.reseat(customers, customers[1:], np.minimum(customers, 1), 0.8, np.full(7, 30.0), np.full(7, 0.1), random)
    assert moved == [] and sizes.sum() == customers.sum() and len(sizes) == tables.sum()
    assert all(tables[:2] == [0, 1]) and all(tables[1:] >= 1)
    n = 100
    sizes, one_by_one, seen = np.full(n, 300), np.ones(n, int), []
    together = pitman_yor.reseat(sizes, sizes, one_by_one, 0.8, np.full(n, 400.0), np.full(n, 0.05), random)[1]
    for sweep in range(40):
        sizes, one_by_one = move_each(np.full(n, 300), sizes, one_by_one, 0.8, np.full(n, 400.0), np.full(n, 0.05), random)
        seen += [one_by_one.mean()] if sweep >= 10 else []
    assert together.mean() == pytest.approx(np.mean(seen), rel=0.06)


def test_many_customers_are_seated_by_a_series(monkeypatch):
    """The series gives the weights of the recursion; dishes beyond `TOGETHER` are drawn by it."""
    import numpy as np

    for d in (0.3, 0.6, 0.85):
        row = pitman_yor.log_ways(d, 700)[700]
        found = pitman_yor.log_ways_by_series(700, d, 128)
        assert len(found) > 20 and found - found[0] == pytest.approx(row[: len(found)] - row[0], abs=1e-5)
    monkeypatch.setattr(pitman_yor, "move_each", lambda customers, sizes, tables, *rest: (sizes, tables) if not len(customers) else 1 / 0)
    n, random = 400, np.random.default_rng(5)
    arguments = np.full(n, 900), np.full(n, 900), np.ones(n, int), 0.7, np.full(n, 500.0), np.full(n, 0.01), random
    together = pitman_yor.reseat(*arguments)[1]
    monkeypatch.setattr(pitman_yor, "TOGETHER", 10)
    sizes, tables = pitman_yor.reseat(*arguments)
    assert sizes.sum() == 900 * n and len(sizes) == tables.sum()
    assert tables.mean() == pytest.approx(together.mean(), rel=0.08)


def test_language_model_sends_small_numbers(spark):
    """Contexts travel as numbers of words, not as hashes of 8 bytes, and name the same words in every block."""
    import numpy as np

    randomly = random.Random(3)
    rows = [(i, " ".join(f"w{randomly.randrange(2000)}" for _ in range(400)), False) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").coalesce(1)
    blocks = pitman_yor.blocks_of(docs, 30_000).localCheckpoint()
    asked = pitman_yor.requests(blocks, pitman_yor.numbers(blocks, 4), 4).collect()
    pairs = sum(len(pitman_yor.unpack(r.contexts)) for r in asked)
    assert blocks.count() > 2 and sum(len(r.contexts) for r in asked) < 3 * pairs
    held = {}
    for r in asked:
        word = pitman_yor.unpack(r.words)[pitman_yor.unpack(r.places)]
        for w, c, n in zip(word, pitman_yor.unpack(r.contexts), pitman_yor.unpack(r.counts)):
            held[1 + r.bucket + 4 * w, c] = held.get((1 + r.bucket + 4 * w, c), 0) + n
    wanted = Counter(p for _, text, _ in rows for p in zip([None, *text.split()], [*text.split(), ""]))
    assert sorted(held.values()) == sorted(wanted.values()) and len(held) == len(wanted)
    assert sum(n for (_, c), n in held.items() if c == 0) == 40 and len(np.unique([w for w, _ in held])) == len({w for _, w in wanted})


def test_fingerprints_of_a_large_group_of_near_copies(spark):
    """A third of the rows are near copies: their terms are above the band, but still tell likeness."""
    randomly = random.Random(4)
    base = [f"hot{i}" for i in range(201)]
    rows = []
    for i in range(100):
        text = list(base)
        text[randomly.randrange(201)] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"w{randomly.randrange(3000)}" for _ in range(60))) for i in range(200)]
    found = {r.doc_id: r for r in imatch.fingerprinted_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(found) == 300 and not any(r.fingerprint.startswith("t") for r in found.values())
    assert all(found[i].near_next > 0.5 for i in range(1, 100))
    assert sum(found[i].near_edited for i in range(1, 100)) > 99 * 0.1
    assert sum(found[i].near_next for i in range(1001, 1200)) < 199 * 0.2


def _texts_of(pattern):
    """The shortest text of a rule with first alternatives, and a longer one with last ones."""
    from re import _constants as c, _parser

    def text(parts, longer):
        out = ""
        for op, arg in parts:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                out += "x" if arg[0][0] is c.CATEGORY and arg[0][1] is c.CATEGORY_WORD else "1" if arg[0][0] is c.CATEGORY else chr(arg[-1 if longer else 0][1])
            elif op is c.BRANCH:
                out += text(arg[1][-1 if longer else 0], longer)
            elif op is c.SUBPATTERN:
                out += text(arg[3], longer)
            elif op is c.MAX_REPEAT:
                out += text(arg[2], longer) * max(arg[0], int(longer))
        return out

    return [text(_parser.parse(pattern), longer) for longer in (False, True)]


def test_every_license_rule_is_found_on_its_own_phrase(spark):
    rules = licenses.signature_rules()
    rows = [(2 * i + k, t) for i, r in enumerate(rules) for k, t in enumerate(_texts_of(r.pattern))]
    assert all(re.fullmatch(rules[i // 2].pattern, t) for i, t in rows)
    forms = spark.createDataFrame(rows, "key bigint, form string").filter(licenses.gated(F.col("form")))
    found = {(r.key, r.rule) for r in licenses.detect(forms, "key", "form").collect()}
    missed = [t for i, t in rows if (i, i // 2) not in found]
    assert missed == []


def test_repeated_rows_of_the_smallest_id(spark):
    text = "".join(chr(97 + i * 7 % 26) + chr(65 + i * 5 % 26) for i in range(40))
    rows = [(1, text), (1, text), (1, text), (2, text), (3, "xy" + text)]
    found = sorted(tuple(r) for r in suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    wanted = plain.repeated(rows[2:])
    assert found == sorted((i, *wanted[i]) for i, _ in rows)
