"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set of word shingles gets a signature of `SIZE` minima, cut to b = 16 bits
each. Signatures are split into chunks of `CHUNK` symbols; in every chunk one symbol may
differ, so a chunk has `CHUNK` keys, each without one symbol. By the pigeonhole principle
two signatures that differ in at most 2 x chunks - 1 = `RADIUS` symbols share a key. Pairs
within that distance are confirmed on their full shingle sets.

No bucket is expanded into rows for all its pairs. First every member is paired with the
smallest member of its bucket, and confirmed pairs are merged into components. Buckets that
still hold several components are compared inside their tasks, on signatures alone; what
leaves a task is a spanning forest of the pairs within the radius, at most a row per member.
The forest's components are clusters that hold every pair left to confirm. A cluster's texts
meet block by block, each pair within the radius and not yet connected is confirmed on the
full sets, and again only a forest of confirmed links leaves the task. Links inside a
component add nothing, so no link that matters is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, ShortType, StructField, StructType

from pairframe.llm.common import Workspace, components, packed, unpacked
from pairframe.llm.shingles import SHINGLE, mix, overlap, shingle_set

SIZE, CHUNK = 64, 4
RADIUS = 2 * (SIZE // CHUNK) - 1
PERCENT = 75
MEMBERS_PER_BLOCK = 2048
TEXTS_PER_BLOCK = 512
MEMBERS_PER_CELL = 16384
BYTES_PER_BLOCK = 4 << 20
BYTES_PER_CELL = 16 << 20
CACHED_SETS = 2048

_FLIPS = np.random.default_rng(20240229).integers(0, 2**63, SIZE, dtype=np.uint64)
_FACTORS = np.random.default_rng(20240301).integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 1024):
            part = shingles[start : start + 1024, None]
            least = np.minimum(least, ((part ^ _FLIPS) * _FACTORS).min(0))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def set_digest(shingles: np.ndarray) -> int:
    """64 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        total = mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        return int(mix(np.array([total]))[0].astype(np.int64))


def features(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """`docs` with the text replaced by n_shingles, node (digest of the set) and signature."""
    others = [c for c in docs.columns if c != text_col]

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, nodes, signatures = [], [], []
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    shingles = shingle_set(text, width)
                    counts.append(len(shingles))
                    nodes.append(set_digest(shingles) if len(shingles) else None)
                    signatures.append(signature(shingles) if len(shingles) else None)
                columns = [part.column(part.schema.get_field_index(c)) for c in others]
                columns += [pa.array(counts, pa.int64()), pa.array(nodes, pa.int64())]
                columns.append(pa.array(signatures, pa.list_(pa.int16())))
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_shingles", "node", "signature"])

    fields = [f for f in docs.schema.fields if f.name in others]
    fields += [StructField("n_shingles", LongType()), StructField("node", LongType())]
    return docs.mapInArrow(task, StructType([*fields, StructField("signature", ArrayType(ShortType()))]))


def chunk_keys(sig: Column) -> Column:
    """All keys of a signature: per chunk, each choice of one symbol left out."""
    keys = []
    for chunk in range(SIZE // CHUNK):
        for out in range(CHUNK):
            symbols = [F.get(sig, chunk * CHUNK + i) for i in range(CHUNK) if i != out]
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + out), *symbols))
    return F.array(*keys)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def task(batches):
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in sets:
                if len(sets) >= CACHED_SETS:
                    sets.clear()
                sets[node] = shingle_set(text, width)
            return sets[node]

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                a, b, text_a, text_b = (c.to_pylist() for c in batch.slice(start, 256).columns)
                out = []
                for x, y, s, t in zip(a, b, text_a, text_b):
                    one, two = of(x, s), of(y, t)
                    both = overlap(one, two)
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        out.append((x, y))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
                )

    return rows.mapInArrow(task, "a bigint, b bigint")


def _within(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures differ in at most `RADIUS` symbols and whose sizes allow the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    differ = sum((F.get("sa", i) != F.get("sb", i)).cast("int") for i in range(SIZE))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(right, "b").join(left, "a").filter(sizes & (differ <= RADIUS)).select("a", "b")


def _dealt(rows: DataFrame, group: str, blocks: Column, cells: int, neighbours: str) -> DataFrame:
    """Rows with `cell`, `low` and `high`: every two blocks of a group meet in one cell.

    A group of one block shares its cell with others of equal `neighbours`; of a larger
    one each pair of blocks is a cell. `blocks` may use the columns of `rows`.
    """
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    shared, own = F.pmod(F.xxhash64(neighbours), F.lit(cells)), F.xxhash64(group, "low", "high")
    return met.withColumn("cell", F.when(F.col("blocks") == 1, shared).otherwise(own)).drop("block", "blocks", "other")


def _groups(table: pa.Table, group: str) -> list[np.ndarray]:
    """Row numbers of each (group, low, high) of a cell."""
    keys = [table.column(c).to_numpy() for c in (group, "low", "high")]
    order = np.lexsort(keys[::-1])
    changed = sum((np.diff(k[order]) != 0).astype(int) for k in keys)
    return np.split(order, np.flatnonzero(changed) + 1)


def _signatures(table: pa.Table) -> np.ndarray:
    return table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, SIZE)


def _forest(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all members of a bucket that are linked by pairs within the radius.

    `members` has key, node, component, n_shingles and signature; pairs of one component or
    of unfit sizes do not count.
    """
    # buckets of the same nodes have the same smallest one: in one cell they give one forest
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead"))
    cells = max(1, -(-members.count() // MEMBERS_PER_CELL))
    blocks = F.ceil(F.col("n") / MEMBERS_PER_BLOCK)
    rows = _dealt(members.join(sizes, "key"), "key", blocks, cells, "lead").drop("n", "lead")

    def compare(table: pa.Table) -> pa.Table:
        node, component = (table.column(c).to_numpy() for c in ("node", "component"))
        size, sigs = table.column("n_shingles").to_numpy(), _signatures(table)
        out = [np.empty((0, 2), np.int64)]
        for of in _groups(table, "key"):
            near = np.stack([(sigs[of] != sigs[i]).sum(1) <= RADIUS for i in of])
            near &= component[of][:, None] != component[of]
            near &= 100 * np.minimum(size[of][:, None], size[of]) >= percent * np.maximum(size[of][:, None], size[of])
            label = np.arange(len(of))
            while True:
                least = np.minimum(label, np.where(near, label, len(of)).min(1))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            joined = np.flatnonzero(label != np.arange(len(of)))
            out.append(np.stack([node[of[label[joined]]], node[of[joined]]], 1))
        # one forest for all buckets of the cell
        ends, index = np.unique(np.concatenate(out), return_inverse=True)
        u, v = index.reshape(-1, 2).T
        label = np.arange(len(ends))
        while (label[u] != label[v]).any():
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], least)
            np.minimum.at(label, label[v], least)
            label = label[label]
        joined = np.flatnonzero(label != np.arange(len(ends)))
        return pa.table({"a": ends[label[joined]], "b": ends[joined]})

    return rows.groupBy("cell").applyInArrow(compare, "a bigint, b bigint")


def _confirm_clusters(clustered: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between components, a forest of them per cell.

    `clustered` has cluster, node, component, n_shingles, signature and text.
    """
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("n") / TEXTS_PER_BLOCK), F.ceil(F.col("bytes") / BYTES_PER_BLOCK), F.lit(1))
    rows = _dealt(clustered.join(sizes, "cluster"), "cluster", blocks, max(1, -(-total // BYTES_PER_CELL)), "cluster").drop("n", "bytes")

    def confirm(table: pa.Table) -> pa.Table:
        node, component = (table.column(c).to_numpy() for c in ("node", "component"))
        size, sigs, text = table.column("n_shingles").to_numpy(), _signatures(table), table.column("text")
        a, b = [], []
        for of in _groups(table, "cluster"):
            sets = [shingle_set(text[int(i)].as_py(), width) for i in of]
            _, label = np.unique(component[of], return_inverse=True)
            for i in range(len(of)):
                near = (sigs[of] != sigs[of[i]]).sum(1) <= RADIUS
                near &= 100 * np.minimum(size[of], size[of[i]]) >= percent * np.maximum(size[of], size[of[i]])
                near[: i + 1] = False
                for j in np.flatnonzero(near & (label != label[i])):
                    if label[j] == label[i]:
                        continue
                    both = overlap(sets[i], sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        label[label == label[j]] = label[i]
                        a.append(node[of[i]])
                        b.append(node[of[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cell").applyInArrow(confirm, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = SHINGLE,
    percent: int = PERCENT,
    work: Workspace | None = None,
) -> DataFrame:
    """Per row of `docs`: its id, text_hash, n_shingles, component_id and kept.

    Two documents are linked when 100 x common shingles >= percent x all shingles of both.
    component_id is the smallest id reachable over links. A text with fewer words than
    `width` is one shingle; null, empty and wordless texts have none, are linked with
    nothing and are their own component. Documents with equal sets form one node whatever
    their number. Rows that repeat an id are judged each by its own text; an empty table
    gives an empty result. Ids must be longs; a null id can be linked but never kept.
    """
    work = work or Workspace(docs.sparkSession, "minhash")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    rows = work.save(features(narrow, "text", width), "features")
    nodes = work.save(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(
            F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
            F.min("text_hash").alias("text_hash"),
        ),
        "nodes",
    )
    keyed = nodes.select("node", F.explode(chunk_keys(F.col("signature"))).alias("key"))
    leaders = work.save(
        keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader"),
        "leaders",
    )
    members = work.save(keyed.join(leaders, "key"), "members")
    starred = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = work.save(_within(starred, nodes, percent), "star")

    # texts of the nodes that share a key with another, one per node
    wanted = members.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = work.save(
        narrow.join(wanted, "text_hash").select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "texts"
    )
    links = work.save(_confirm(star, texts, width, percent), "star-links")
    merged = work.save(components(work, links), "merged")

    placed = members.select("key", "node").join(merged, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    placed = work.save(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    described = nodes.drop("text_hash")
    open_members = placed.join(open_keys.select("key"), "key").join(described, "node")
    forest = work.save(_forest(work.save(open_members, "open"), percent), "forest")
    clusters = work.save(components(work, forest), "clusters")
    clustered = (
        clusters.select("node", F.col("component").alias("cluster"))
        .join(merged, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(described, "node")
        .join(texts, "node")
    )
    more = work.save(_confirm_clusters(work.save(clustered, "clustered"), width, percent), "cluster-links")
    whole = merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    merged = work.save(components(work, whole), "components")

    placed_rows = work.save(
        rows.select("doc_id", "text_hash", "n_shingles", "node").join(merged, "node", "left").select(
            "doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component")
        ),
        "placed-rows",
    )
    smallest = work.save(
        placed_rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "smallest",
    )
    work.keep_only(placed_rows, smallest)
    # a document alone in its component needs no look-up; nulls are spread by their own id
    return placed_rows.withColumn("component", F.coalesce("component", "text_hash")).join(smallest, "component", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Columns stay as they are, whatever their names. Rows that repeat both id and text are reduced to one;
    documents without words stay, and so do rows without an id and a group.
    """
    work = Workspace(docs.sparkSession, "near")
    found = near_duplicates(docs, work=work)
    alone = F.col("kept") | (F.col("doc_id").isNull() & F.col("component_id").isNull())
    chosen = found.filter(alone).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    chosen = work.save(chosen.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "rows"), "kept")
    work.keep_only(chosen)
    rows = docs.select(
        packed(docs), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("own_hash")
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    kept = rows.join(chosen.select("id", "hash"), same, "left_semi")
    if not chosen.filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["own_id", "own_hash"])
    return unpacked(kept, docs.columns)


def duplicate_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("text_hash")
