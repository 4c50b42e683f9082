import math

import pytest
from pyspark.sql import functions as F

from pairframe import FeatureSet, PairFrame
from pairframe.operators.encoding import encode, encode_index, encode_pairs
from pairframe.operators.features import (
    describe_features,
    load_feature_list,
    scale_features,
    select_features,
    signature,
    value_shape,
    variance_filter,
)
from pairframe.operators import fingerprints
from pairframe.operators.fingerprints import fingerprint_set, fingerprint_table
from pairframe.sources.lists import feature_lists
from pairframe.transforms import (
    CellVarianceFilter,
    SelectCellFeatures,
    SelectDrugFeatures,
    SelectListed,
    StructureToFingerprint,
)

NAN = float("nan")


def matrix(spark, rows, names, dtype="double"):
    df = spark.createDataFrame(rows, f"entity_id string, value array<{dtype}>")
    return FeatureSet.matrix(df, names, name="m")


@pytest.fixture
def cells(spark):
    return matrix(spark, [(f"C{i + 1}", [float(i), 1.0, float(i * i)]) for i in range(10)], ["a", "b", "c"])


@pytest.fixture
def drugs(spark):
    table = spark.createDataFrame([(f"D{i + 1}", f"CC{i}O") for i in range(10)], "d string, s string")
    return FeatureSet.lookup(table, "d", "s", "smiles")


def values(features):
    return {r[0]: r[1] for r in features.table.collect()}


def test_select_order_absent_repeated(cells):
    chosen = select_features(cells, ["c", "zzz", "a", "c"])
    assert chosen.feature_names == ("c", "a") and chosen.name == "m"
    assert values(chosen)["C3"] == [4.0, 2.0]
    assert values(select_features(cells, ["zzz"]))["C1"] == []


def test_feature_lists(spark, cells):
    lists = feature_lists(spark, {"cgc": ["c", "gone", "a"]})
    assert load_feature_list(lists, "cgc") == ["c", "gone", "a"]
    with pytest.raises(KeyError):
        load_feature_list(lists, "invalid")


def test_variance_filter(spark, cells):
    assert variance_filter(cells).feature_names == ("a", "c")
    exact = matrix(spark, [("x", [0.0, 0.0]), ("y", [2.0, 4.0])], ["two", "eight"])
    assert variance_filter(exact, 2.0).feature_names == ("eight",)  # strictly above, ddof 1
    one = matrix(spark, [("x", [1.0, 2.0])], ["a", "b"])
    assert variance_filter(one).feature_names == ()
    holes = matrix(spark, [("x", [1.0, NAN]), ("y", [NAN, NAN]), ("z", [3.0, 1.0])], ["a", "b"])
    assert variance_filter(holes).feature_names == ("a",)


def test_variance_fit_ids(cells):
    assert variance_filter(cells, 1.0, fit_ids=["C1", "C2"]).feature_names == ()


def test_scale_features(spark):
    f = matrix(spark, [("x", [1.0, 5.0]), ("y", [3.0, 5.0]), ("z", [11.0, NAN])], ["a", "b"])
    got = values(scale_features(f, ["x", "y"]))
    assert got["x"] == [-1.0, 0.0] and got["y"] == [1.0, 0.0]
    assert got["z"][0] == 9.0 and math.isnan(got["z"][1])


def test_describe_and_shape(spark, cells, drugs):
    assert tuple(describe_features(cells).first()) == ("matrix", 10, 3, 3)
    assert tuple(describe_features(drugs).first()) == ("lookup", 10, None, None)
    assert (cells.size, value_shape(cells), cells.dtype) == (10, (3,), "double")
    assert value_shape(drugs) is None
    assert signature(FeatureSet.constant([1.0, 2.0], "k")) == {"name": "k", "dtype": "double", "shape": (2,)}
    uneven = FeatureSet.lookup(spark.createDataFrame([("a", [1]), ("b", [1, 2])], "entity_id string, value array<int>"))
    with pytest.raises(ValueError):
        value_shape(uneven)


def test_get(cells):
    assert cells.get("C2") == [1.0, 1.0, 1.0]
    with pytest.raises(KeyError):
        cells.get("nobody")
    assert FeatureSet.constant(4).get("anyone") == 4


def test_encode_repeats_and_strict(spark, cells):
    ids = spark.createDataFrame([("C2",), ("C2",), ("C1",)], "cell_id string")
    assert sorted(r["x"][0] for r in encode(ids, cells, "cell_id", "x").collect()) == [0.0, 1.0, 1.0]
    bad = ids.union(spark.createDataFrame([("nobody",)], "cell_id string"))
    with pytest.raises(Exception, match="unknown cell_id: nobody"):
        encode(bad, cells, "cell_id", "x").count()  # count prunes columns but not the guard
    assert encode(bad, cells, "cell_id", "x", strict=False).filter("x is null").count() == 1
    with pytest.raises(Exception, match="unknown cell_id: null"):
        encode(spark.createDataFrame([(None,)], "cell_id string"), cells, "cell_id", "x").count()


def test_encode_index_truncates(spark):
    table = FeatureSet.lookup(spark.createDataFrame([(0, "zero"), (1, "one")], "entity_id int, value string"))
    df = spark.createDataFrame([(1.9,), (0.2,)], "i double")
    assert sorted(r["x"] for r in encode_index(df, table, "i", "x").collect()) == ["one", "zero"]


def test_encode_pairs_order(obs, cells, drugs):
    sets = {"exp": cells, "one": FeatureSet.constant(1.0)}
    encoded = encode_pairs(obs, sets, {"mol": drugs})
    assert encoded.columns == ["id", "cell_id", "drug_id", "label", "cell_exp", "cell_one", "drug_mol"]
    first = encode_pairs(obs, sets, {"mol": drugs}, drugs_first=True)
    assert first.columns[4:] == ["drug_mol", "cell_exp", "cell_one"]
    row = encoded.filter("id = 23").first()
    assert row["cell_exp"] == [2.0, 1.0, 4.0] and row["drug_mol"] == "CC3O"
    assert encoded.count() == 100


def test_user_defined_feature_set(obs, cells):
    class Length:
        kind, name, width = "lookup", "length", 1

        def attach(self, df, key, column, strict=True):
            return df.withColumn(column, F.length(key))

    encoded = encode_pairs(obs, {"exp": cells}, {"len": Length()})
    assert encoded.filter("drug_id = 'D10'").first()["drug_len"] == 3


def test_frame_encoding_flags(obs, cells, drugs):
    frame = PairFrame(obs, {"exp": cells}, {"mol": drugs}, encode_drugs_first=True)
    assert frame.feature_columns == ["drug_mol", "cell_exp"]
    assert [f.name for f in frame.feature_sets] == ["smiles", "m"]
    assert frame.encode(drugs_first=False).columns[4:] == ["cell_exp", "drug_mol"]
    with pytest.raises(ValueError):
        PairFrame(obs).encode()


def test_transforms_leave_the_parent_alone(spark, obs, cells, drugs):
    frame = PairFrame(obs, {"exp": cells}, {"mol": drugs})
    lists = feature_lists(spark, {"cgc": ["b", "a"]})
    out = frame.apply([SelectListed(lists, "cgc", "exp"), CellVarianceFilter("exp"), StructureToFingerprint("mol", 64, 2)])
    assert out.cell_features["exp"].feature_names == ("a",)
    assert frame.cell_features["exp"].feature_names == ("a", "b", "c")
    assert value_shape(out.drug_features["mol"]) == (64,) and out.drug_features["mol"].name == "smiles"


def test_transform_kind_and_key_errors(obs, cells, drugs):
    frame = PairFrame(obs, {"exp": cells}, {"mol": drugs})
    with pytest.raises(TypeError):
        frame.apply(SelectDrugFeatures(["a"], key="mol"))
    with pytest.raises(KeyError):
        frame.apply(SelectCellFeatures(["a"], key="nope"))


def reference_bits(text, n_bits, radius):
    import hashlib

    grams = {text[i : i + k] for k in range(1, radius + 1) for i in range(len(text) - k + 1)}
    on = {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n_bits for g in grams}
    return [int(i in on) for i in range(n_bits)]


@pytest.mark.parametrize("text", ["", "C", "CC", "CC(=O)Oc1ccccc1C(=O)O", "naïve \U0001f9ea\U0001f9ec x", "a\nb\nc"])
def test_fingerprint_brute_force(spark, text):
    features = FeatureSet.lookup(spark.createDataFrame([("d", text)], "entity_id string, value string"))
    for n_bits, radius in ((512, 3), (16, 1), (40, 4)):
        assert values(fingerprint_set(features, n_bits, radius))["d"] == reference_bits(text, n_bits, radius)


def test_fingerprints_are_vectorised(spark, monkeypatch):
    """One UDF makes the vectors, in parts of few rows; nothing is evaluated per character in the plan."""
    monkeypatch.setattr(fingerprints, "PART_VALUES", 150)
    texts = [None, "", "a", "a\U0001f600\nb\u00e9", "\x00ab\x00", *(f"C{i}O" * i for i in range(9))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, s string").coalesce(1)
    features = fingerprint_set(FeatureSet.lookup(rows, "id", "s"), 50, 3)
    found = values(features)
    assert found.pop(0) is None
    assert found == {i: reference_bits(t, 50, 3) for i, t in enumerate(texts) if t is not None}
    plan = features.table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan and "lambda" not in plan


def test_fingerprint_table(spark):
    df = spark.createDataFrame([("d1", "CCO"), ("d2", "CCN"), ("d1", "CCO")], "id string, smiles string")
    by_text = fingerprint_table(df, "smiles")
    assert sorted(values(by_text)) == ["CCN", "CCO"] and len(by_text.feature_names) == 512
    by_id = fingerprint_table(df, "smiles", "id", featurizer=lambda c: F.array(F.length(c)))
    assert values(by_id) == {"d1": [3], "d2": [3]}


def test_pandas_udf_transform(spark, obs, drugs):
    import pandas as pd

    @F.pandas_udf("array<int>")
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [len(v)])

    frame = PairFrame(obs, {}, {"mol": drugs}).apply(StructureToFingerprint("mol", featurizer=lengths))
    assert values(frame.drug_features["mol"])["D10"] == [4]
