import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairframe import PairFrame, normalize_responses
from pairframe.operators.metrics import prediction_table, score
from pairframe.operators.scaling import (
    apply_matrix_scaler,
    apply_scaler,
    fit_apply,
    fit_apply_matrix,
    fit_matrix_scaler,
    fit_scaler,
)

NAN = float("nan")


@pytest.fixture
def groups(spark):
    rows = [
        (1, "const", 5.0), (2, "const", 5.0),
        (3, "single", 9.0),
        (4, "holes", 1.0), (5, "holes", NAN), (6, "holes", 3.0),
        (7, "empty", NAN),
        (8, "noise", 1e9), (9, "noise", 1e9 + 1e-7),
        (10, "usual", 2.0), (11, "usual", 6.0),
    ]
    return spark.createDataFrame(rows, "id int, drug_id string, label double")


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


def test_grouped_rules(groups):
    got = labels(fit_apply(groups, "drug_id"))
    assert got[1] == got[2] == got[3] == 0.0
    assert (got[4], got[6]) == (-1.0, 1.0) and math.isnan(got[5])
    assert math.isnan(got[7])
    assert abs(got[8]) < 1e-6 and abs(got[9]) < 1e-6  # rounding noise is not scaled up
    assert (got[10], got[11]) == (-1.0, 1.0)


def test_unseen_group_raises_even_for_count(spark, groups):
    stats = fit_scaler(groups, "drug_id")
    other = spark.createDataFrame([(1, "new", 1.0)], "id int, drug_id string, label double")
    with pytest.raises(Exception, match="no statistics for group new"):
        apply_scaler(other, stats, "drug_id").count()
    assert labels(apply_scaler(other, stats, "drug_id", strict=False))[1] is None


def test_type_is_kept(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id int, drug_id string, label float")
    assert fit_apply(df, "drug_id").schema["label"].dataType.simpleString() == "float"
    assert fit_apply(df).schema["label"].dataType.simpleString() == "float"


@pytest.mark.parametrize("method", ["global", "grouped"])
def test_normalize_responses(spark, obs, method):
    frame = PairFrame(obs)
    train, test = frame.select_cells([f"C{i}" for i in range(1, 9)]), frame.select_cells(["C9", "C10"])
    a, b, c = normalize_responses(train, None, test, method)
    assert b is None and c.size == 20
    keys = ["drug_id"] if method == "grouped" else []
    for row in fit_scaler(a.obs, keys[0] if keys else None).collect():
        assert abs(row["mean"]) < 1e-12
        assert abs(row["var"] - 1) < 1e-12 or row["var"] < 1e-12
    assert train.obs.filter("label > 5").count() > 0  # input untouched


def test_unknown_method(obs):
    with pytest.raises(ValueError, match="robust"):
        normalize_responses(PairFrame(obs), norm_method="robust")


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "y_true double, y_pred double")
    row = score(df).first()
    assert row["r2"] == pytest.approx(1 - 0.75 / 2)
    assert row["pearson"] == pytest.approx(0.8660254037844387)
    assert row["rmse"] == pytest.approx(0.5)


@pytest.mark.parametrize("rows,r2_null", [([(1.0, 2.0), (1.0, 3.0)], True), ([(1.0, 2.0), (3.0, 2.0)], False), ([(1.0, 2.0)], True)])
def test_metrics_without_variance(spark, rows, r2_null):
    row = score(spark.createDataFrame(rows, "y_true double, y_pred double")).first()
    assert row["pearson"] is None and (row["r2"] is None) == r2_null


def test_prediction_table(spark):
    df = spark.createDataFrame([("c", "d", 1.0, 2.0)], "cell_id string, drug_id string, y_true double, y_pred double")
    table = prediction_table({"train": df, "test": df}, fold=3)
    assert table.columns == ["cell_id", "drug_id", "y_true", "y_pred", "split", "fold"]
    assert sorted(r["split"] for r in table.collect()) == ["test", "train"]
    with pytest.raises(ValueError):
        prediction_table({})


def test_integer_labels_become_doubles(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 6)], "drug_id int, label int")
    for group in (None, "drug_id"):
        rows = fit_apply(df, group)
        assert dict(rows.dtypes)["label"] == "double"
        assert sorted(round(r["label"], 3) for r in rows.collect()) == [-0.926, -0.463, 1.389]


def test_no_value_to_fit_on(spark):
    empty = spark.createDataFrame([(1, "d", None), (2, "d", float("nan"))], "id int, drug_id string, label double")
    other = spark.createDataFrame([(3, "d", 1.0)], "id int, drug_id string, label double")
    for train in (empty, empty.limit(0)):
        with pytest.raises(Exception, match="no value to fit"):
            apply_scaler(other, fit_scaler(train)).collect()
        assert apply_scaler(other, fit_scaler(train), strict=False).first()["label"] is None


def matrix_rows():
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 9 == 8 else f"g{i % 3}", (rng.normal(i % 3, 2, 5)).astype(np.float32).tolist()) for i in range(90)]
    rows[4][2][1], rows[5][2][2] = float("nan"), None
    return rows + [(100, "one", [1.0] * 5), (101, "g0", None), (102, "g1", [])]


@pytest.mark.parametrize("kind, element", [("float", "float"), ("double", "double"), ("int", "double")])
def test_matrix_scaling_per_group(spark, kind, element):
    rows = matrix_rows()
    if kind == "int":
        rows = [(i, g, v and [None if x is None or x != x else int(x) for x in v]) for i, g, v in rows]
    df = spark.createDataFrame(rows, f"id int, g string, value array<{kind}>")
    scaled = fit_apply_matrix(df, "g")
    assert scaled.columns == df.columns and scaled.schema["value"].dataType.elementType.simpleString() == element
    got = {r["id"]: r["value"] for r in scaled.collect()}
    groups = {}
    for i, g, v in rows:
        if v:
            groups.setdefault(g, []).append([np.nan if x is None else x for x in v])
    stats = {g: (np.nanmean(m, axis=0), np.nanstd(np.array(m, float), axis=0)) for g, m in groups.items()}
    for i, g, v in rows:
        if not v:
            assert got[i] == v
            continue
        mean, scale = stats[g]
        scale = np.where(scale == 0, 1.0, scale)
        expected = (np.array([np.nan if x is None else x for x in v], float) - mean) / scale
        assert np.allclose([np.nan if x is None else x for x in got[i]], expected, atol=1e-5, equal_nan=True)


def test_matrix_groups_without_statistics(spark):
    df = spark.createDataFrame(matrix_rows(), "id int, g string, value array<float>")
    stats = fit_matrix_scaler(df.filter("g = 'g0'"), "g")
    assert stats.count() == 1 and stats.first()["n"] == 30
    with pytest.raises(Exception, match="no statistics for group"):
        apply_matrix_scaler(df, stats, "g").collect()
    loose = {r["id"]: r["value"] for r in apply_matrix_scaler(df, stats, "g", strict=False).collect()}
    assert loose[1] is None and loose[0] is not None
    longer = df.filter("g = 'g0'").withColumn("value", F.concat("value", "value"))
    with pytest.raises(Exception, match="no statistics"):
        apply_matrix_scaler(longer, stats, "g").collect()


def test_wide_statistics_are_not_broadcast(spark, monkeypatch):
    from pairframe import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame([(i, f"g{i % 2}", [float(i)] * 20) for i in range(20)], "id int, g string, value array<double>")
    plan = fit_apply_matrix(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 300)
    plan = fit_apply_matrix(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()
