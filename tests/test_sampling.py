import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from pairframe import Batches, FeatureSet, PairFrame
from pairframe.operators import ranking
from pairframe.operators.batching import batch_rows, read_batch, read_batches
from pairframe.operators.observations import as_obs
from pairframe.operators.ranking import rank_rows, slice_rows
from pairframe.operators.splitting import apply_split, stratified_holdout
from pairframe.sources.splits import (
    load_fold,
    load_parts,
    load_split,
    load_splits,
    read_split_lists,
    save_parts,
    save_splits,
)


def order(ids, *salt):
    return sorted(ids, key=lambda i: (hashlib.md5(":".join(map(str, [*salt, i])).encode()).hexdigest(), i))


def test_rank_is_exact(obs):
    got = {r["id"]: r["position"] for r in rank_rows(obs, ["id"], 3, 2).collect()}
    assert got == {i: n for n, i in enumerate(order(range(100), 3, 2))}


def test_rank_sends_no_rows_to_one_partition(obs):
    plan = rank_rows(obs, ["id"])._jdf.queryExecution().executedPlan().toString()
    for block in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in block.split("Exchange hashpartitioning")[0]  # only bucket counts


def test_rank_within_keeps_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(12)], "id int, g string")
    got = [(r["g"], r["position"], r["n"]) for r in rank_rows(df, ["id"], within=["g"], total="n").collect()]
    assert sorted(got, key=str) == sorted([("a", p, 4) for p in range(4)] + [(None, p, 8) for p in range(8)], key=str)


def test_sample(obs):
    frame = PairFrame(obs)
    got = sorted(r["id"] for r in frame.sample(17, seed=5).obs.collect())
    assert got == sorted(order(range(100), 5)[:17])
    assert frame.sample(0).size == 0 and frame.sample(100).size == 100
    assert frame.sample(10, seed=1).obs.exceptAll(frame.sample(10, seed=2).obs).count() > 0
    with pytest.raises(Exception, match="fewer than 101 rows"):
        frame.sample(101).obs.count()
    with pytest.raises(ValueError):
        frame.sample(-1)


def test_sample_entities(obs):
    frame = PairFrame(obs)
    cells = frame.sample_cells(3, seed=1)
    assert (cells.size, cells.n_cells, cells.n_drugs) == (30, 3, 10)
    assert frame.sample_drugs(2, seed=1).n_drugs == 2


def test_shuffle_positions(obs):
    got = [r["position"] for r in PairFrame(obs).shuffle(1).collect()]
    assert sorted(got) == list(range(100))


def test_holdout(spark):
    rows = [(f"a{i}", "A") for i in range(50)] + [(f"b{i}", "B") for i in range(7)] + [("c", "C")]
    roles = stratified_holdout(spark.createDataFrame(rows, "cell string, kind string"), "cell", "kind", seed=4)
    counts = {(r["kind"], r["role"]): r["count"] for r in roles.groupBy("kind", "role").count().collect()}
    assert counts == {
        ("A", "test"): 5, ("A", "val"): 5, ("A", "train"): 40,
        ("B", "test"): 1, ("B", "val"): 1, ("B", "train"): 5,
        ("C", "train"): 1,
    }
    assert roles.count() == 58


def test_holdout_sizes_over_many_small_strata(spark, monkeypatch):
    from pairframe.operators import splitting

    rows = [(i, None if i // 3 == 7 else f"s{i // 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s string")

    def sizes(part):
        return {r["role"]: r["count"] for r in part.groupBy("role").count().collect()}

    small = stratified_holdout(df, "k", "s", seed=1)
    assert sizes(small) == {"test": 30, "val": 27, "train": 243}
    monkeypatch.setattr(splitting, "BROADCAST_ROWS", 10)  # too many strata for one task
    assert sizes(stratified_holdout(df, "k", "s", seed=1)) == {"test": 30, "val": 27, "train": 243}
    assert sizes(stratified_holdout(df, "k", "s", test_size=1.0)) == {"test": 300}
    single = spark.createDataFrame([(i, i) for i in range(20)], "k int, s int")
    assert sizes(stratified_holdout(single, "k", "s")) == {"train": 20}
    assert stratified_holdout(df.limit(0), "k", "s").count() == 0


def test_split_files(spark, tmp_path):
    for name, ids in {"train_1.txt": "5\n6\n\n", "val_1.txt": "7\n", "test_1.txt": "8\n", "train_12": "9\n", "notes.txt": "1\n"}.items():
        (tmp_path / name).write_text(ids)
    got = sorted(tuple(r) for r in read_split_lists(spark, str(tmp_path), "int").collect())
    assert got == [(1, "test", 8), (1, "train", 5), (1, "train", 6), (1, "val", 7), (12, "train", 9)]
    (tmp_path / "val_3.txt").write_text("x\n")
    with pytest.raises(Exception, match="another type"):
        read_split_lists(spark, str(tmp_path), "int").collect()


def test_parts_are_stored_once(spark, tmp_path):
    parts = spark.range(95).select("id", (F.col("id") % 10).cast("int").alias("part"))
    path = str(tmp_path / "p")
    save_parts(parts, path)
    assert spark.read.parquet(path).count() == 95
    folds = load_parts(spark, path)
    assert folds.count() == 950 and folds.filter("role = 'test'").select("id").distinct().count() == 95
    one = load_fold(spark, path, 10)
    assert {r["id"] % 10 for r in one.test_ids.collect()} == {9} and {r["id"] % 10 for r in one.val_ids.collect()} == {0}
    assert one.train_ids.count() == 95 - 9 - 10
    with pytest.raises(KeyError):
        load_fold(spark, path, 11)


def test_splits_round_trip(spark, obs, tmp_path):
    rows = [(f, "test" if i % 10 == f - 1 else "train", i) for f in range(1, 11) for i in range(100)]
    table = spark.createDataFrame(rows, "fold int, role string, id bigint")
    save_splits(table, str(tmp_path / "s"))
    assert load_splits(spark, str(tmp_path / "s")).exceptAll(table).isEmpty()
    split = load_split(spark, str(tmp_path / "s"), 3)
    assert sorted(r["id"] for r in split.test_ids.collect()) == list(range(2, 100, 10))
    assert split.val_ids.count() == 0
    assert PairFrame(obs).select(split.train_ids).size == 90
    with pytest.raises(KeyError):
        load_split(spark, str(tmp_path / "s"), 11)
    assert apply_split(obs, table).count() == 1000


@pytest.mark.parametrize("n,size", [(10, 3), (2, 5), (6, 3)])
def test_batches(spark, n, size):
    df = spark.range(n)
    batches = Batches(df, size)
    assert len(batches) == -(-n // size)
    sizes = [r["count"] for r in batches.assign().groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes[:-1] == [size] * (len(sizes) - 1) and sum(sizes) == n
    for k in range(len(sizes)):
        assigned = {r["id"] for r in batches.assign().filter(F.col("batch_id") == k).collect()}
        assert {r["id"] for r in batches.batch(k).collect()} == assigned
    with pytest.raises(Exception, match="fewer than"):
        batches.batch(len(sizes)).count()
    with pytest.raises(IndexError):
        batches.batch(-1)


def test_empty_batches(spark):
    assert len(Batches(spark.range(0), 4)) == 0


def test_epochs(spark):
    fixed, mixed = Batches(spark.range(30), 4), Batches(spark.range(30), 4, shuffle=True, seed=1)
    assert fixed.order(0).exceptAll(fixed.order(1)).isEmpty()
    assert not mixed.order(0).exceptAll(mixed.order(1)).isEmpty()


@pytest.mark.parametrize("rows", [7, 1 << 20])
def test_ordered_batches(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows)
    monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
    values = [7.0] * 60 + [float(i % 5) for i in range(20)] + [None, float("nan"), None, float("nan"), -3.5, 1e-7]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    batches = Batches(df, 10, order_by="v")
    got = {r["id"]: r["position"] for r in batches.order().collect()}

    def place(i):
        v = values[i]
        lead = (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
        return (*lead, hashlib.md5(f"0:0:{i}".encode()).hexdigest())

    assert got == {i: n for n, i in enumerate(sorted(range(len(values)), key=place))}
    assert {r["id"] for r in batches.batch(2).collect()} == {i for i, p in got.items() if p // 10 == 2}


def test_order_by_needs_an_order(spark, obs):
    with pytest.raises(TypeError):
        rank_rows(spark.range(3).withColumn("m", F.create_map("id", "id")), ["id"], order_by="m")
    with pytest.raises(ValueError):
        rank_rows(obs, ["id"], within=["cell_id"], order_by="label")


def mixed_rows(n=400):
    start = dt.datetime(2024, 1, 1)
    return [
        (i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 7}", start + dt.timedelta(microseconds=i * 37 % 11), i % 5 / 2)
        for i in range(n)
    ]


MIXED = "id bigint, s string, t timestamp, x double"


@pytest.mark.parametrize("probes", [5, 10_000])
def test_order_by_several_columns(spark, monkeypatch, probes):
    """A third of the rows share one string; strings, then timestamps, then an expression."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 90)
    monkeypatch.setattr(ranking, "SLICE_ROWS", 40)
    monkeypatch.setattr(ranking, "PROBES", probes)
    rows = mixed_rows()
    df = spark.createDataFrame(rows, MIXED)
    order = ["s", "t", -F.col("x")]
    expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2], -r[3], hashlib.md5(f"5:{r[0]}".encode()).hexdigest()))
    got = {r["id"]: r["position"] for r in rank_rows(df, ["id"], 5, order_by=order, total="n").collect()}
    assert got == {r[0]: i for i, r in enumerate(expected)}
    for start, stop in ((0, 10), (133, 143), (395, 500), (400, 410)):
        part = slice_rows(df, start, stop, ["id"], 5, order_by=order)
        assert part.columns == df.columns
        assert {r["id"] for r in part.collect()} == {r[0] for r in expected[start:stop]}
    with pytest.raises(ValueError, match="fewer"):
        slice_rows(df, 0, 10, ["id"], order_by=order, at_least=401)


def test_a_slice_moves_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 200)
    monkeypatch.setattr(ranking, "PROBES", 400)
    df = spark.range(20_000).withColumn("v", F.col("id") % 10)
    hashed = df.withColumn("_hash", ranking.order_hash(["id"]))
    near, before = ranking._narrowed(hashed, [F.col("v"), F.col("_hash")], 9_000, 9_010, 20_000)
    assert near.count() <= 200 and before <= 9_000 < before + near.count()


def test_ids_in_a_stated_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 5)
    monkeypatch.setattr(ranking, "RUN_LENGTH", 4)
    rows = [("c", "d", float(v)) for v in (5, 1, 3, 2, 9, 4)] + [("hot", "d", 3.0)] * 30 + [(None, "d", 2.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "cell_id string, drug_id string, label double")
    by_label = as_obs(df, order_by=["label"]).orderBy("id").collect()
    assert [r["id"] for r in by_label] == list(range(len(rows)))
    expected = sorted(rows, key=lambda r: tuple((v is not None, v or 0) if i == 0 else (v is not None, v or "") for i, v in enumerate((r[2], r[0], r[1]))))
    assert [tuple(r)[1:] for r in by_label] == expected
    assert [r["label"] for r in as_obs(df, order_by=-F.col("label")).orderBy("id").take(4)] == [None, 9.0, 5.0, 4.0]


def test_stored_batches(spark, tmp_path):
    path = str(tmp_path / "b")
    batches = Batches(spark.range(1_000), 5, shuffle=True, seed=2)
    batches.write(path, epoch=1, rows_per_file=100)
    back = read_batches(spark, path)
    assert back.drop("position", "batch_id").exceptAll(spark.range(1_000)).isEmpty() and back.count() == 1_000
    index = spark.read.parquet(f"{path}/index").collect()
    assert 5 <= len(index) <= 20 and sum(r["n_rows"] for r in index) == 1_000
    one = read_batch(spark, path, 7)
    assert len(one.inputFiles()) == 1
    assert {r["id"] for r in one.collect()} == {r["id"] for r in batches.batch(7, epoch=1).collect()}
    assert [r["position"] for r in one.collect()] == list(range(35, 40))
    with pytest.raises(IndexError):
        read_batch(spark, path, 200)


def test_batch_rows(obs, spark):
    rows = batch_rows(obs, targets=None, sample_weights=F.col("label") + 1)
    assert rows.columns == ["id", "cell_id", "drug_id", "target", "weight"]
    assert rows.filter("target is not null").count() == 0
    broken = obs.withColumn("label", F.when(F.col("id") == 4, None).otherwise(F.col("label")))
    with pytest.raises(Exception, match="missing"):
        batch_rows(broken).count()


def test_frame_batches(spark, obs):
    cells = FeatureSet.from_columns(spark.createDataFrame([(f"C{i}", i) for i in range(1, 11)], "c string, x int"), "c", ["x"])
    drugs = FeatureSet.constant(1.0)
    batches = PairFrame(obs, {"x": cells}, {"k": drugs}).batches(32)
    assert len(batches) == 4
    assert batches.batch(3).count() == 4
    first = PairFrame(obs, {"x": cells}, {"k": drugs}).batches(32, order_by="id").batch(0)
    assert sorted(r["id"] for r in first.collect()) == list(range(32))
    assert batches.batch(0).columns == ["id", "cell_id", "drug_id", "target", "weight", "cell_x", "drug_k"]
