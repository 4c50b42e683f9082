import math

import pytest
from pyspark.sql import functions as F

from pairframe import FeatureSet, PairFrame
from pairframe.sources.bundles import METRIC_BUNDLE_FILES, PANEL_BUNDLE_FILES, MetricBundle, PanelBundle, ResponseSource
from pairframe.sources.lists import feature_lists_from_gene_sets, read_feature_list
from pairframe.sources.store import load_features, load_table, save_features, save_table
from pairframe.sources.tables import read_feature_matrix, read_lookup, read_metadata, read_observations
from pairframe.sources.text import read_delimited, read_gene_sets, read_list
from pairframe.operators.scaling import apply_scaler, fit_scaler
from pairframe.streaming.responses import drain, read_observation_stream


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return put


def test_read_list(spark, write):
    assert [r[0] for r in read_list(spark, write("l", "b\n\na\n")).collect()] == ["b", "", "a"]


def test_gene_sets(spark, write):
    path = write("g", 'S1\tx\tA\tB\nS2\tx\nS1\tx\tC\t "D\nS3\tx\t"q\tt""u"r\t\tE\n\n')
    got = {r["set_name"]: r["genes"] for r in read_gene_sets(spark, path).collect()}
    assert got == {"S1": ["C", ' "D'], "S2": [], "S3": ['q\tt"ur', "", "E"]}
    assert feature_lists_from_gene_sets(spark, path).filter("list_name = 'S1'").count() == 2


def test_delimited(spark, write):
    path = write("d", "junk\n\n a\tb\tc\n\t\t\nd\te\n")
    assert [r[0] for r in read_delimited(spark, path).collect()] == [["junk"], [" a", "b", "c"], ["d", "e"]]
    assert [r[0] for r in read_delimited(spark, path, skip_rows=2, n_cols=2).collect()] == [[" a", "b"], ["d", "e"]]
    assert read_delimited(spark, path, skip_rows=99).count() == 0
    numbered = read_delimited(spark, path, numbered=True).orderBy("line_no").collect()
    assert [r["line_no"] for r in numbered] == [0, 2, 4]
    assert [r[0] for r in read_delimited(spark, write("p", "a|b\n"), delimiter="|").collect()] == [["a", "b"]]


def test_line_numbers_across_blocks(spark, write):
    path = write("big", "".join(f"{i}\tx{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_delimited(spark, path, skip_rows=1234, numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["line_no"] for r in rows) == list(range(1234, 5000))
    assert all(r["fields"][0] == str(r["line_no"]) for r in rows)


def test_line_numbers_move_no_text(spark, write):
    path = write("n", "a\nb\n")
    rows = read_delimited(spark, path, skip_rows=1, numbered=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_feature_list_file(spark, write):
    rows = read_feature_list(spark, write("f", "g2\ng1\n"), "cgc").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("cgc", 0, "g2"), ("cgc", 1, "g1")]


def test_observations_csv(spark, write):
    path = write("o", "extra,label,id,drug_id,cell_id\nq,1.5,1,D,C\n")
    frame = PairFrame.from_csv(spark, path, name="n")
    assert frame.dtype == "float" and frame.name == "n"
    assert tuple(frame.obs.first()) == (1, "C", "D", 1.5)
    typed = read_observations(spark, path, {"id": "string", "label": "double"}, "double")
    assert tuple(typed.first()) == ("1", "C", "D", 1.5)
    with pytest.raises(ValueError):
        read_observations(spark, write("bad", "id,label\n1,2\n"))


def test_feature_matrix_csv(spark, write):
    path = write("m", "cell,g.1,g2\nNA,1.5,2\n,3,\n")
    f = read_feature_matrix(spark, path, name="x")
    got = {r[0]: r[1] for r in f.table.collect()}
    assert f.feature_names == ("g.1", "g2") and got["NA"] == [1.5, 2.0]
    assert got[""][0] == 3.0 and math.isnan(got[""][1])
    with pytest.raises(Exception):
        read_feature_matrix(spark, write("w", "c,g\nx,oops\n"), strict=True).table.collect()


def test_lookup_and_metadata(spark, write):
    f = read_lookup(spark, write("s", "d,smiles\nD1,CCO\n"), "smiles")
    assert f.get("D1") == "CCO"
    meta = read_metadata(spark, write("c", "c,kind,age\n1,x,5\n"), key_type="string")
    assert meta.columns == ["entity_id", "kind", "age"] and tuple(meta.first()) == ("1", "x", 5)


def test_frame_round_trip(spark, obs, tmp_path):
    matrix = FeatureSet.matrix(
        spark.createDataFrame([(f"C{i}", [float(i), 2.0]) for i in range(1, 11)], "k string, v array<float>"),
        ["b", "a"], "k", "v", "exp",
    )
    lookup = FeatureSet.lookup(spark.createDataFrame([(f"D{i}", "s") for i in range(1, 11)], "k string, v string"), "k", "v")
    frame = PairFrame(
        obs, {"z": matrix, "a": FeatureSet.constant([1.0], "one")}, {"mol": lookup},
        cell_meta=spark.createDataFrame([("C1", "t")], "entity_id string, kind string"),
        encode_drugs_first=True, name="n", desc="d",
    )
    frame.save(str(tmp_path / "f"))
    back = PairFrame.load(spark, str(tmp_path / "f"))
    assert (back.name, back.desc, back.encode_drugs_first) == ("n", "d", True)
    assert list(back.cell_features) == ["z", "a"] and back.cell_features["z"].feature_names == ("b", "a")
    assert back.cell_features["z"].name == "exp" and back.drug_meta is None
    assert back.encode().schema == frame.encode().schema
    assert back.encode().exceptAll(frame.encode()).isEmpty()
    save_features(spark, matrix, str(tmp_path / "m"))
    assert load_features(spark, str(tmp_path / "m")).dtype == "float"
    save_table(obs, str(tmp_path / "t"))
    assert load_table(spark, str(tmp_path / "t")).columns == obs.columns
    PairFrame(obs).save(str(tmp_path / "bare"))
    assert PairFrame.load(spark, str(tmp_path / "bare")).cell_features is None


def test_metric_bundle(spark, tmp_path):
    files = {
        "labels": "id,cell_id,drug_id,auc,ln_ic50\n1,C1,D1,0.5,-2\n",
        "cell_expression": "cell_id,G1,G2\nC1,1,2\n",
        "drug_structure": "drug_id,smiles\nD1,CCO\n",
        "cell_meta": "cell_id,cancer_type\nC1,x\n",
        "drug_meta": "drug_id,target\nD1,y\n",
    }
    for key, text in files.items():
        (tmp_path / METRIC_BUNDLE_FILES[key]).write_text(text)
    frame = MetricBundle(str(tmp_path), "ln_ic50").load(spark, transforms=lambda f: f.replace(desc="changed"))
    row = frame.encode().first()
    assert row["label"] == -2.0 and row["cell_exp"] == [1.0, 2.0] and row["drug_mol"] == "CCO"
    assert frame.desc == "changed" and frame.cell_features["exp"].dtype == "float"
    assert frame.cell_meta.columns == ["entity_id", "cancer_type"]
    with pytest.raises(ValueError, match="ec50"):
        MetricBundle(str(tmp_path), "ec50").load(spark)


def test_panel_bundle_and_custom_source(spark, tmp_path):
    files = {
        "labels": "id,cell_id,drug_id,label\n1,C1,D1,0.5\n",
        "cell_expression": "c,G1\nC1,1\n",
        "drug_fingerprint": "d,0,1\nD1,0,1\n",
        "cell_meta": "c,k\nC1,x\n",
        "drug_meta": "d,k\nD1,y\n",
    }
    for key, text in files.items():
        (tmp_path / PANEL_BUNDLE_FILES[key]).write_text(text)
    row = PanelBundle(str(tmp_path)).load(spark).encode().first()
    assert row["drug_mol"] == [0.0, 1.0]

    class Mine(ResponseSource):
        name, desc = "mine", "my source"

        def read(self, spark):
            return PairFrame(read_observations(spark, self.joinpath("labels.csv")))

    frame = Mine(str(tmp_path)).load(spark)
    assert frame.name == "mine" and frame.size == 1


def test_stream(spark, obs, tmp_path):
    folder = str(tmp_path / "in")
    obs.write.parquet(folder)
    stats = fit_scaler(obs, "drug_id")
    stream = apply_scaler(read_observation_stream(spark, folder, obs.schema), stats, "drug_id")
    got = drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = apply_scaler(obs, stats, "drug_id")
    assert got.exceptAll(want).isEmpty() and got.count() == 100
    obs.limit(5).withColumn("id", F.col("id") + 1000).write.mode("append").parquet(folder)
    assert drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).count() == 105
    with pytest.raises(ValueError):
        read_observation_stream(spark, folder, obs.schema, id_col="nope")
