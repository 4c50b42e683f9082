"""Ranked search, clustering and token files against plain versions, on ordinary and awkward rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairframe.llm import clusters, tokenfiles
from pairframe.llm.bpe import default_vocabulary
from pairframe.llm.queries import QUERIES, SQL
from pairframe.llm.search import RangeMaxima, best_first, build_index, ranked_documents, search
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_range_maximum_search", "op12_geometric_drift"])
def test_agrees_with_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


# ---- search


def plain_ranking(docs, items, k=50):
    """Every score by counting; rows (item_id, rank, doc_id, score)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(d, Counter(term.findall((t or "").translate(lower)))) for d, t, *_ in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text, *_ in items:
        wanted.setdefault(item, set()).update(term.findall((text or "").translate(lower)))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        scored.sort(key=lambda r: r[:3])
        rows += [(item, i, r[3], -r[0]) for i, r in enumerate(scored[:k], 1)]
    return rows


def ranked_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def prose(rng, n, words=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), words)}" for _ in range(n))


@pytest.mark.parametrize("segment_bytes", [1, 500, 1 << 20])
def test_search_equals_plain_ranking(spark, segment_bytes):
    rng = random.Random(segment_bytes)
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(150)]
    docs += [(200 + i, docs[0][1]) for i in range(70)]  # ties beyond the end of the list
    items = [(i, prose(rng, 12)) for i in range(9)] + [(77, "never seen"), (78, docs[0][1])]
    index = build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), segment_bytes=segment_bytes)
    found = search(index, spark.createDataFrame(items, "item_id bigint, text string"), k=20)
    assert ranked_rows(found) == sorted(plain_ranking(docs, items, 20), key=repr)


def test_search_awkward_rows(spark):
    docs = [
        (1, "Alpha BETA gamma", "x", "y"), (1, "Alpha BETA gamma", "x", "y"), (None, "alpha beta", None, None),
        (2, None, "x", "y"), (3, "", "x", "y"), (4, " -- \t", "x", "y"), (5, "Ünïcode été-42 ÉTÉ", "x", "y"),
        (6, "alpha " * 20_000 + "rare", "x", "y"), (7, "délta beta_alpha 42", "x", "y"), (-3, "beta", "x", "y"),
    ]
    items = [(1, "ALPHA beta!", 0), (1, "gamma", 1), (2, None, 0), (3, "", 0), (None, "été 42 rare", 0), (4, "nothing here", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, term string, segment string")
    i = spark.createDataFrame(items, "item_id bigint, text string, score int")
    assert ranked_rows(ranked_documents(d, i)) == sorted(plain_ranking(docs, items), key=repr)
    assert ranked_documents(d.limit(0), i).collect() == []
    assert ranked_documents(d, i.limit(0)).collect() == []


def test_items_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("pairframe.llm.search.ITEM_BLOCK", 4)
    rng = random.Random(5)
    docs = [(i, prose(rng, 30)) for i in range(40)]
    items = [(i, prose(rng, 8)) for i in range(30)]
    found = ranked_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 7)
    assert ranked_rows(found) == sorted(plain_ranking(docs, items, 7), key=repr)


def test_best_first_leaves_documents_unscored():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(5_000, n, replace=False)) for n in (40, 300, 2_000)]
    impacts = np.concatenate([rng.integers(1, 1_000, len(p)) * (3_000 // len(p)) for p in lists])
    starts = np.cumsum([0, *map(len, lists)])
    maxima = RangeMaxima(np.concatenate(lists).astype(np.int32), impacts, starts, 5_000)
    places, scores, seen = best_first(maxima, np.arange(3), 10)
    every = np.zeros(5_000, np.int64)
    np.add.at(every, np.concatenate(lists), impacts)
    order = np.lexsort((np.arange(5_000), -every))[:10]
    assert places.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert seen < 1_500


def test_lists_are_cut_before_they_are_exchanged(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    plan = ranked_documents(docs, items)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(item_id")[1] and "Cartesian" not in plan


# ---- clusters


def plain_clusters(rows, k=8, rounds=10, dim=64):
    """(rows (vec_id, cluster, distance), centroids) by measuring everything in whole numbers."""
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    first += [r for r in kept if r[0] is None]
    centroids = [v for _, v in first[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j, _) in zip(kept, assign()):
            groups.setdefault(j, []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centroids)]
    return assign(), centroids


def member_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance").collect()), key=repr)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_plain_ones(spark, kind):
    rng = np.random.default_rng(3)
    means = rng.normal(0, 0.3, (6, 64))
    values = (means[rng.integers(0, 6, 400)] + rng.normal(0, 0.1, (400, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    rows += [(1_000 + i, rows[0][1]) for i in range(150)]  # a hot vector
    history = []
    found, centroids = clusters.cluster(vectors_of(spark, rows, kind).repartition(3), history=history)
    members, expected = plain_clusters(rows)
    assert centroids == expected and member_rows(found) == sorted(members, key=repr)
    assert [n for _, n in history] == [550] * 11 and history[0][0] == 550
    assert sum(measured for measured, _ in history[1:]) < 550 * 5


def test_vectors_awkward(spark):
    good = [(i, [((i * 37 + j * 11) % 23) / 7 - 1.5 for j in range(64)]) for i in range(5)]
    bad = [(50, None), (51, []), (52, [0.5] * 63), (53, [0.5] * 65), (54, [None] + [0.5] * 63), (55, [math.nan] * 64), (56, [math.inf] + [0.0] * 63)]
    rows = good + [good[2], (None, good[1][1])] + bad
    df = vectors_of(spark, rows, "double").withColumn("cluster", F.lit("mine")).withColumn("distance", F.lit(1))
    members, centroids = plain_clusters(rows)
    assert member_rows(clusters.clustered_vectors(df)) == sorted(members, key=repr) and len(centroids) == 7
    out = clusters.clustered_vectors(df).collect()
    assert {r["inertia"] for r in out} == {sum(m[2] for m in members)}
    assert {r["centroid_sha256"] for r in out if r["cluster"] == 0} == {hashlib.sha256(",".join(map(str, centroids[0])).encode()).hexdigest()}
    assert clusters.clustered_vectors(df.limit(0)).collect() == []
    assert clusters.clustered_vectors(vectors_of(spark, bad, "double")).collect() == []
    one = clusters.clustered_vectors(vectors_of(spark, [good[0]], "double")).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in one] == [(0, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        clusters.clustered_vectors(vectors_of(spark, [(1, [1e9] * 64)], "double")).collect()


def test_loosening_bounds_every_point_of_the_ball():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(300):
        centre, old, new = rng.normal(0, 1, (3, 5))
        new = old + (new - old) * rng.random()
        radius = rng.random() * 2
        bound = clusters.loosening(centre, radius, old, new)
        drift = np.linalg.norm(new - old)
        assert bound <= drift + 1e-12
        tighter += bound < 0.9 * drift
        points = rng.normal(0, 1, (400, 5))
        points = centre + radius * points / np.linalg.norm(points, axis=1)[:, None] * rng.random((400, 1)) ** 0.2
        shrunk = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert shrunk.max() <= bound + 1e-9
    assert tighter > 100


# ---- token files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def plain_files(rows):
    """(doc_id, start, n_tokens, crc) with the tokenizers library."""
    tokenizer, start, out = library(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def file_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)


def test_files_equal_the_library_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert file_rows(QUERIES["op13_seekable_frames"](spark, SF)) == sorted(plain_files(rows), key=repr)


def test_files_awkward_rows(spark, tmp_path):
    rows = [
        (5, "!! <|endoftext|> 'll été \U0001f600"), (2, None), (3, ""), (None, "no id"), (9, "word " * 60_000),
        (7, "\n" * 1_000_000 + "x"), (-1, "same"), (-1, "same"), (8, "a" * 50_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("p")).withColumn("_tie", F.lit(0))
    assert file_rows(tokenfiles.filed_documents(df, str(tmp_path / "a"))) == sorted(plain_files(rows), key=repr)
    assert tokenfiles.filed_documents(df.limit(0), str(tmp_path / "b")).collect() == []


def written(spark, folder, frame_ids=64):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(200)] + [(500, prose(rng, 3_000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokenfiles.write_token_files(docs, str(folder), file_bytes=10_000, frame_ids=frame_ids)
    return rows


def test_files_are_zstandard_and_in_order(spark, tmp_path):
    import zstandard

    rows = written(spark, tmp_path / "out")
    files = sorted((tmp_path / "out" / "ids").glob("*.ids.zst"))
    assert len(files) > 1
    content = b""
    for path in files:
        reader = zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True)
        content += reader.read()
    tokenizer = library()
    ids = [x for _, t in rows for x in tokenizer.encode(t, add_special_tokens=False).ids + [0]]
    assert content == struct.pack(f"<{len(ids)}I", *ids)


def test_only_wanted_frames_are_read(spark, tmp_path):
    rows = written(spark, tmp_path / "out")
    wanted = spark.createDataFrame([(3,), (500,), (3,), (12_345,), (None,)], "x bigint")
    found = {r["doc_id"]: r for r in tokenfiles.read_token_files(spark, str(tmp_path / "out"), wanted).collect()}
    assert sorted(found) == [3, 500]
    ids = library().encode(dict(rows)[500], add_special_tokens=False).ids
    assert bytes(found[500]["ids"]) == struct.pack(f"<{len(ids) + 1}I", *ids, 0)

    path = max((tmp_path / "out" / "ids").glob("*.ids.zst"), key=lambda p: p.stat().st_size)
    from pyarrow import fs

    reader = tokenfiles.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    assert len(reader.entries) > 4
    reader.read(0, 10)
    assert reader.frames_read == 1


def test_a_damaged_frame_is_found(spark, tmp_path):
    written(spark, tmp_path / "out")
    for path in Path(tmp_path / "out" / "ids").glob("*.ids.zst"):
        data = bytearray(path.read_bytes())
        data[9] ^= 0x55
        path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum|decompress|zstd|ZstdError"):
        tokenfiles.read_token_files(spark, str(tmp_path / "out")).collect()
