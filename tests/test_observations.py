import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairframe import PairFrame
from pairframe.operators.checks import (
    check_feature_sets,
    check_same_columns,
    check_same_keys,
    duplicate_keys,
    order_mismatches,
    require_known,
    require_unique,
)
from pairframe.operators.observations import (
    as_obs,
    filter_by_value_counts,
    mapping_from_columns,
    pick_metric,
    summarise,
    validate_obs,
)
from pairframe.operators.selection import intersect_columns, keep_members, pair_grid


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_frame_of_observations_alone_can_be_described_but_not_encoded(obs):
    frame = PairFrame(obs.filter("id < 25"))
    assert frame.describe() == "25 observations of 3 cells and 10 drugs"
    assert frame.replace(name="few").describe().startswith("few: 25 ")
    with pytest.raises(ValueError, match="cell feature"):
        frame.encode()


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        PairFrame(spark.createDataFrame([(1,), (2,)], "id int"))


def test_extra_columns_dropped_and_ordered(obs):
    shuffled = obs.withColumn("extra", F.lit(1)).select("label", "extra", "drug_id", "id", "cell_id")
    assert validate_obs(shuffled).columns == ["id", "cell_id", "drug_id", "label"]


def test_as_obs_renames(spark):
    df = spark.createDataFrame([(7, "a", "x", 0.5)], "k int, c string, d string, y double")
    assert rows(as_obs(df, "k", "y", "c", "d")) == [(7, "a", "x", 0.5)]


def test_as_obs_numbers_repeated_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0)] * 5 + [("b", "y", 2.0)] * 3 + [("c", None, None)], "cell_id string, drug_id string, label double")
    numbered = as_obs(df)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(9))
    assert numbered.groupBy("cell_id").count().filter("cell_id = 'a'").first()["count"] == 5
    assert "id" not in df.columns


def test_number_rows_splits_hot_rows(spark, monkeypatch):
    from pairframe.operators import ranking

    monkeypatch.setattr(ranking, "RUN_LENGTH", 4)
    df = spark.createDataFrame([("hot",)] * 30 + [(f"r{i}",) for i in range(7)], "k string")
    numbered = ranking.number_rows(df, "n")
    assert sorted(r["n"] for r in numbered.collect()) == list(range(37))
    assert numbered.filter("k = 'hot'").count() == 30


def test_pick_metric_missing(obs):
    with pytest.raises(ValueError, match="auc"):
        pick_metric(obs, "auc")


def test_select_ignores_unknown_and_repeats(spark, obs):
    frame = PairFrame(obs, name="all", desc="d")
    assert rows(frame.select([3, 3, 5, 999]).obs.select("id")) == [(3,), (5,)]
    ids = spark.createDataFrame([(3,), (3,), (5,), (None,), (999,)], "id bigint")
    subset = frame.select(ids, name="few")
    assert rows(subset.obs.select("id")) == [(3,), (5,)]
    assert subset.name == "few" and subset.desc is None
    assert frame.name == "all"


def test_select_long_list(obs):
    assert keep_members(obs, "id", range(50, 5000)).count() == 50


def test_select_cells_and_drugs(obs):
    frame = PairFrame(obs)
    assert frame.select_cells(["C1", "C2", "C3"]).size == 30
    assert frame.select_drugs(["D1", "D2", "D3"]).size == 30


def test_null_ids_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, cell_id string")
    wanted = spark.createDataFrame([(None,), ("a",)], "c string")
    assert rows(keep_members(df, "cell_id", wanted).select("id")) == [(2,)]


def test_value_count_filter(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(filter_by_value_counts(df, "k", 2).select("v")) == [(1,), (2,)]


def test_summary_counts_null_as_value(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.0), (2, None, "x", 0.0)], "id int, cell_id string, drug_id string, label double")
    assert tuple(summarise(df).first()) == (2, 2, 1)


def test_mapping_last_wins(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, o int")
    assert rows(mapping_from_columns(df, "k", "v", "o")) == [("a", 2), ("b", 3)]


def test_intersect_columns(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "k int, x string")
    b = spark.createDataFrame([(2,), (3,)], "j int")
    c = spark.createDataFrame([(2,), (1,)], "k int")
    left, mid, right = intersect_columns(a, b, c, cols=["k", "j", "k"])
    assert rows(left) == [(2, "q"), (2, "r")] and rows(mid) == [(2,)] and rows(right) == [(2,)]
    left, right = intersect_columns(a, c, cols="k")
    assert left.count() == 3 and right.count() == 2


def test_pair_grid(spark, monkeypatch):
    from pairframe.operators import selection

    monkeypatch.setattr(selection, "GRID_BLOCK", 3)
    cells = spark.createDataFrame([(f"C{i}",) for i in range(5)] * 2, "cell_id string")
    drugs = spark.createDataFrame([(f"D{i}",) for i in range(8)] * 2, "drug_id string")
    assert rows(pair_grid(cells, drugs)) == sorted((f"C{i}", f"D{j}") for i in range(5) for j in range(8))
    assert pair_grid(cells, drugs.limit(0)).count() == 0


def test_checks(spark, obs):
    assert check_same_columns(obs, obs) and not check_same_columns(obs, obs.select("id"))
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, k string")
    b = spark.createDataFrame([(0, "y"), (1, "x")], "pos int, k string")
    assert check_same_keys(a, b, "k") and not check_same_keys(a, b, "k", "pos")
    assert check_same_keys(a, a, "k", "pos")
    assert duplicate_keys(obs, "cell_id").count() == 10
    require_unique(obs, "id")
    with pytest.raises(ValueError):
        require_unique(obs, "cell_id")
    with pytest.raises(KeyError):
        require_known(obs, "cell_id", spark.createDataFrame([("C1",)], "entity_id string"))
    for bad in ((None, {"a": 1}), ({}, {"a": 1}), ({"a": 1}, None)):
        with pytest.raises(ValueError):
            check_feature_sets(*bad)


def test_apply_rejects_non_callables(obs):
    frame = PairFrame(obs)
    with pytest.raises(ValueError):
        frame.apply(["not callable"])
    assert frame.apply(lambda f: f.replace(name="n")).name == "n"
    assert frame.apply([lambda f: f.replace(name="a"), lambda f: f.replace(name=f.name + "b")]).name == "ab"


def test_scores_use_complete_pairs(spark):
    from pairframe.operators.metrics import score

    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, None), (4.0, None), (None, 9.0), (float("nan"), 1.0)]
    got = score(spark.createDataFrame(rows, "y_true double, y_pred double")).first()
    assert (round(got["r2"], 9), round(got["pearson"], 9), got["rmse"]) == (1.0, 1.0, 0.0)


def test_members_are_cast_alike_for_any_number(spark):
    from pairframe.operators.selection import keep_members

    df = spark.range(3_000)
    for n in (10, 1_500):
        assert keep_members(df, "id", [str(i) for i in range(n)] + ["no number", None]).count() == n


@pytest.mark.parametrize(
    "kind, stored, members, found",
    [
        ("bigint", [1, 2, 3], [1.0, 2.5, "3", " 3 ", "x", None, True, 1e300, float("nan"), "9" * 30], [1, 3]),
        ("int", [1, 2, 3], [Decimal("2.0"), Decimal("2.5"), 2**40], [2]),
        ("string", ["1", "1.0", "a"], [1, "a", 1.0], ["1", "1.0", "a"]),
        ("double", [0.5, 1.0, float("inf")], [1, "0.5", "no", Decimal("0.25")], [0.5, 1.0]),
        ("float", [0.5, 0.1], [0.5, 0.1], [0.5]),
        ("binary", [b"ab", b"c"], [b"ab", "c", bytearray(b"x")], [bytearray(b"ab"), bytearray(b"c")]),
        ("decimal(10,2)", [Decimal("1.50"), Decimal("2.00")], [1.5, 2, "2.001", Decimal("1e20")], [Decimal("1.50"), Decimal("2.00")]),
        ("date", [dt.date(2024, 1, 2), dt.date(2024, 1, 3)], [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 5), "2024-01-03", "?"], [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]),
        ("timestamp", [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3)], [dt.date(2024, 1, 2), "2024-01-02T03:00:00"], [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3)]),
        ("boolean", [True, False], ["true", 7], [True]),
    ],
)
@pytest.mark.parametrize("limit", [1_000, 0])
def test_members_of_any_type(spark, monkeypatch, kind, stored, members, found, limit):
    """In a filter and, beyond the limit, in a join."""
    from pairframe.operators import selection

    monkeypatch.setattr(selection, "LITERAL_LIMIT", limit)
    df = spark.createDataFrame([(v,) for v in [*stored, None]], f"k {kind}")
    got = [r["k"] for r in keep_members(df, "k", [*members, members[0]]).collect()]
    assert sorted(got) == sorted(v if kind != "float" else v for v in found)


def test_members_that_cannot_be_compared(spark):
    for kind, member in (("bigint", b"1"), ("date", 5), ("binary", 1), ("string", b"x"), ("bigint", dt.date(2024, 1, 1))):
        with pytest.raises(TypeError):
            keep_members(spark.createDataFrame([], f"k {kind}"), "k", [None, member])
    assert keep_members(spark.range(3), "id", [None]).count() == 0 and keep_members(spark.range(3), "id", []).count() == 0


def test_intersect_reads_every_frame_twice(spark, tmp_path):
    paths = []
    for i in range(3):
        spark.range(i, 10).select("id", F.lit(i).alias("x")).write.parquet(str(tmp_path / str(i)))
        paths.append(str(tmp_path / str(i)))
    frames = [spark.read.parquet(p) for p in paths]
    kept = intersect_columns(*frames, cols="id")
    assert [k.count() for k in kept] == [8, 8, 8]
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # itself and the stored keys


def test_order_mismatches(spark):
    a = spark.createDataFrame([(i, f"k{i}") for i in range(50)], "o int, k string")
    b = a.withColumn("o", F.when(F.col("o") == 10, 11).when(F.col("o") == 11, 10).otherwise(F.col("o")))
    assert order_mismatches(a, a, "k", "o").isEmpty()
    assert rows(order_mismatches(a, b, "k", "o")) == [(10, "k10", "k11"), (11, "k11", "k10")]
    assert rows(order_mismatches(a, a.filter("o < 48"), "k", "o")) == [(48, "k48", None), (49, "k49", None)]
    null_last = a.select("o", F.when(F.col("o") == 49, None).otherwise(F.col("k")).alias("k"))
    assert order_mismatches(null_last, null_last.filter("o < 49"), "k", "o", ids=["o"]).count() == 1
