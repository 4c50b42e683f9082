"""CSV files whose fields hold line ends, read in pieces of any size."""

import csv
import io
import math
import random

import pytest
from pyspark.sql import types as T

from pairframe.sources import records
from pairframe.sources.records import header, read_csv, still_open
from pairframe.sources.tables import read_feature_matrix, read_lookup, read_metadata, read_table


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def put(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("a,b", False, True), ('"a","b"', False, False), ('a,"b', True, False), ('b",c', False, False),
        ('x""y', False, True), ('x"",y', False, True), ('5" pipe,"a', True, True), ('"a""', True, False), ("", False, True),
        (',"",', False, False), ('"', True, False),
    ],
)
def test_state_after_a_line(line, outside, inside):
    assert still_open(line, False) is outside
    if line not in ('5" pipe,"a', '"a","b"', ',"",'):
        assert still_open(line, True) is inside


def awkward_rows(seed, n=300):
    rng = random.Random(seed)
    parts = ["word", "\n", '"', ",", "\r\n", "é", " ", "\n\n", "x" * 40, '""', '",\n"']
    return [(str(i), "".join(rng.choices(parts, k=rng.randint(0, 30))), str(rng.random())) for i in range(n)]


def put(path, head, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([head, *rows])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("size", [1_500, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_with_line_ends_in_split_files(spark, tmp_path, split_size, size, end):
    rows, folder = awkward_rows(size), tmp_path / "in"
    folder.mkdir()
    put(folder / "a.csv", ("k", "te xt", "n"), rows[:250], end)
    put(folder / "b.csv", ("k", "te xt", "n"), rows[250:], end)
    split_size(size)
    got = read_csv(spark, str(folder), strings("k", "te xt", "n"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, t or None, n) for k, t, n in rows)


def test_a_record_over_many_ranges(spark, tmp_path, split_size):
    rows = [("a", "line\n" * 2_000), ("b", "x"), ("c", "y\n" * 500), ("d", 'say "no"\n')]
    put(tmp_path / "f.csv", ("k", "t"), rows)
    split_size(1_024)
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "f.csv"), strings("k", "t")).collect()) == rows


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, split_size):
    put(tmp_path / "plain.csv", ("k", "v"), [(i, i) for i in range(6_000)])
    put(tmp_path / "quoted.csv", ("k", "v"), [(i, "a\nb") for i in range(6_000)])
    split_size(4_096)
    assert records.records(spark, str(tmp_path / "plain.csv")) is None
    plain = read_table(spark, str(tmp_path / "plain.csv"), {"v": "bigint"})
    assert plain.rdd.getNumPartitions() > 8 and plain.groupBy().sum("v").first()[0] == sum(range(6_000))
    assert records._lines(spark, str(tmp_path / "quoted.csv")).rdd.getNumPartitions() > 8
    quoted = read_lookup(spark, str(tmp_path / "quoted.csv"), "v").table
    assert quoted.count() == 6_000 and quoted.filter("value <> 'a\\nb'").isEmpty()


def test_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a ""b""\nc",,d\n1,2,3\n')
    assert header(spark, str(tmp_path / "h.csv")) == ['a "b"\nc', "", "d"]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"x\ny"\n')
    (folder / "b.csv").write_text("k,w\n2,z\n")
    with pytest.raises(Exception, match="header|CSV"):
        read_csv(spark, str(folder), strings("k", "v")).collect()
    (tmp_path / "i.csv").write_text(",g1\na,1\n")
    assert read_feature_matrix(spark, str(tmp_path / "i.csv")).get("a") == [1.0]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_table(spark, str(tmp_path / "e.csv"))


def test_malformed_records(spark, tmp_path):
    for name, text in {"plain": "k,v\n1,2,3\n", "spanning": 'k,v\n"a\nb",2,3\n'}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            read_csv(spark, str(tmp_path / name), strings("k", "v")).collect()


def test_missing_texts(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text("cell,g1,g2\nNA,NA,1e3\nb,null,-2\nc,,nan\n")
    got = {r[0]: r[1] for r in read_feature_matrix(spark, path).table.collect()}
    assert math.isnan(got["NA"][0]) and got["NA"][1] == 1000.0
    assert math.isnan(got["b"][0]) and got["b"][1] == -2.0 and all(map(math.isnan, got["c"]))
    with pytest.raises(Exception, match="not a number"):
        read_feature_matrix(spark, path, na_values=()).table.collect()
    got = {r[0]: r[1] for r in read_feature_matrix(spark, path, na_values=("1e3",), strict=False).table.collect()}
    assert all(map(math.isnan, got["NA"]))


def test_types(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("key,i,l,d,b,s,x,e\n007,1,5000000000,1.5,true,1d,a,\n010,2,1,nan,FALSE,2d,1,\n")
    assert dict(read_table(spark, path).dtypes) == {
        "key": "int", "i": "int", "l": "bigint", "d": "double", "b": "boolean", "s": "string", "x": "string", "e": "string"
    }
    meta = read_metadata(spark, path)
    assert sorted(r["entity_id"] for r in meta.collect()) == ["007", "010"] and dict(meta.dtypes)["i"] == "int"
    assert sorted(r["entity_id"] for r in read_metadata(spark, path, key_type="int").collect()) == [7, 10]
    with pytest.raises(Exception, match="type"):
        read_table(spark, path, {"x": "int"}).collect()
    assert [r["i"] for r in read_table(spark, path, {"i": "int"}, na_values=("2",)).collect()] == [1, None]
