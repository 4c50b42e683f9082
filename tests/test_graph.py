import numpy as np
import pytest

from pairframe.functions import arrays
from pairframe.functions.arrays import additive_score, dot, reduce_arrays, softmax_pool
from pairframe.operators import graph as g
from pyspark.sql import functions as F

PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
CYCLE = [(0, 1), (1, 2), (2, 3), (3, 0)]
MIXED = [(0, 1), (1, 1), (1, 3), (3, 0), (4, 0)]
SHAPES = {"path": PATH, "cycle": CYCLE, "mixed": MIXED}


def edges_of(spark, pairs, graph=1, weight=1.0):
    return spark.createDataFrame([(graph, a, b, weight) for a, b in pairs], "graph int, src int, dst int, weight double")


def dense(pairs, n=5):
    m = np.zeros((n, n))
    for a, b in pairs:
        m[a, b] = 1
    return m


def walked(m, steps):
    """Union over the set bits k of `steps` of exact walks of length 2**k."""
    if steps <= 1:
        return m
    out, power, k = np.zeros_like(m), m > 0, 0
    while steps >> k:
        if steps >> k & 1:
            out += power
        power = (power.astype(float) @ power.astype(float)) > 0
        k += 1
    return (out > 0).astype(float)


def nodes_of(spark, x, graph=1):
    return spark.createDataFrame([(graph, i, [float(v) for v in row]) for i, row in enumerate(x)], "graph int, node int, features array<double>")


def array_of(df, n=5):
    rows = {r["node"]: r["features"] for r in df.collect()}
    return [rows[i] for i in range(n)]


def all_edges(spark):
    """Every shape as its own graph."""
    rows = [(g, a, b, 1.0) for g, pairs in enumerate(SHAPES.values()) for a, b in pairs]
    return spark.createDataFrame(rows, "graph int, src int, dst int, weight double")


@pytest.mark.parametrize("steps", [1, 2, 3, 6])
def test_walk(spark, steps):
    got = {(r["graph"], r["src"], r["dst"]) for r in g.walk_edges(all_edges(spark), steps).collect()}
    want = {
        (i, int(a), int(b))
        for i, pairs in enumerate(SHAPES.values())
        for a, b in zip(*np.nonzero(walked(dense(pairs), steps)))
    }
    assert got == want


def test_walk_of_one_keeps_weights(spark):
    assert {r["weight"] for r in g.walk_edges(edges_of(spark, PATH, weight=2.5), 1).collect()} == {2.5}


def test_hub_blocks_give_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = (rng.random((20, 20)) < 0.2).astype(float)
    m[7, :] = 1
    m[:, 7] = 1
    pairs = list(zip(*map(lambda a: [int(v) for v in a], np.nonzero(m))))
    monkeypatch.setattr(g, "HUB_BLOCK", 5)
    got = {(r["src"], r["dst"]) for r in g.walk_edges(edges_of(spark, pairs), 2).collect()}
    assert got == set(zip(*map(list, np.nonzero(walked(m, 2)))))


def test_graphs_of_few_edges_are_not_searched_for_hubs(spark, monkeypatch):
    """Graphs of at most HUB_BLOCK edges have no hub in any power; only the others are looked through."""
    searched = []
    hubs = g._hubs
    monkeypatch.setattr(g, "_hubs", lambda pairs: searched.append(pairs) or hubs(pairs))
    want = {(i, int(a), int(b)) for i, p in enumerate(SHAPES.values()) for a, b in zip(*np.nonzero(walked(dense(p), 6)))}
    reached = lambda edges: {(r["graph"], r["src"], r["dst"]) for r in g.walk_edges(edges, 6).collect()}
    assert reached(all_edges(spark)) == want and not searched
    star = [(a, b) for a in range(8) for b in range(8) if 3 in (a, b)]
    monkeypatch.setattr(g, "HUB_BLOCK", 5)
    more = {(9, int(a), int(b)) for a, b in zip(*np.nonzero(walked(dense(star, 8), 6)))}
    assert reached(all_edges(spark).union(edges_of(spark, star, 9))) == want | more
    assert {r["graph"] for r in searched[0].select("graph").distinct().collect()} == {9}


def test_linear_is_plain_and_keeps_nulls(spark, monkeypatch):
    rows = [([1.0, 2.0],), ([1.0, None],), ([1.0],), ([1.0, 2.0, 3.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    for bias in (None, [0.5, -1.0, 2.0]):
        plain = df.select(arrays.linear(F.col("v"), [[1.0, -2.0, 0.5], [3.0, 1.0, 0.0]], bias).alias("x"))
        assert "lambda" not in plain._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(arrays, "DIRECT", 0)
            folded = df.select(arrays.linear(F.col("v"), [[1.0, -2.0, 0.5], [3.0, 1.0, 0.0]], bias).alias("x"))
        assert plain.collect() == folded.collect()


@pytest.mark.parametrize("steps", [1, 3])
def test_conv_and_pools(spark, steps):
    x = np.arange(10, dtype=float).reshape(5, 2) - 3
    w, b = np.array([[1.0, -1.0, 0.5], [2.0, 0.0, 1.0]]), np.array([0.1, 0.2, 0.3])
    edges = all_edges(spark)
    nodes = spark.createDataFrame(
        [(i, n, x[n].tolist()) for i in range(len(SHAPES)) for n in range(5)],
        "graph int, node int, features array<double>",
    )
    relu = lambda v: F.greatest(v, F.lit(0.0))
    conv = g.graph_conv(edges, nodes, w.tolist(), b.tolist(), steps, activation=relu).collect()
    width = 2 if steps == 1 else None
    average = g.graph_average_pool(edges, nodes, steps, width=width).collect()
    best = g.graph_max_pool(edges, nodes, steps, width=width).collect()

    def vectors(rows, graph):
        found = {r["node"]: r["features"] for r in rows if r["graph"] == graph}
        return [found[n] for n in range(5)]

    for i, pairs in enumerate(SHAPES.values()):
        once = walked(dense(pairs), steps)
        twice = walked(once, steps)
        assert np.allclose(vectors(conv, i), np.maximum(twice.T @ (x @ w + b), 0))
        assert np.allclose(vectors(average, i), once.T @ x / (once.sum(axis=1, keepdims=True) + 1e-7))
        for n, row in enumerate(vectors(best, i)):
            assert row == (x[once[n] > 0].max(axis=0).tolist() if once[n].any() else None)


def test_weights_and_many_graphs(spark):
    edges = edges_of(spark, PATH, 1, 2.0).union(edges_of(spark, PATH, 2, 3.0))
    x = np.ones((5, 1))
    nodes = nodes_of(spark, x, 1).union(nodes_of(spark, x, 2))
    conv = g.graph_conv(edges, nodes, [[1.0]])
    assert array_of(conv.filter("graph = 1")) == [[0.0]] + [[2.0]] * 4
    assert array_of(conv.filter("graph = 2")) == [[0.0]] + [[3.0]] * 4


def test_softmax_pool(spark):
    rows = [("a", 700.0, [1.0, 2.0]), ("a", 701.0, [3.0, 5.0]), ("b", -5.0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "k string, s double, v array<double>")
    p = 1 / (1 + np.exp(-1.0))
    for width in (None, 2):
        got = {r["k"]: r["features"] for r in softmax_pool(df, "k", "s", "v", width=width).collect()}
        assert np.allclose(got["a"], [1 * (1 - p) + 3 * p, 2 * (1 - p) + 5 * p]) and got["b"] == [7.0, 7.0]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, -2.0], [0.5, 1.0])], "a array<double>, b array<double>")
    row = df.select(dot(F.col("a"), F.col("b")).alias("d"), additive_score(F.col("a"), F.col("b"), [2.0, 3.0]).alias("s")).first()
    assert row["d"] == -1.5 and row["s"] == pytest.approx(2 * np.tanh(1.5) + 3 * np.tanh(-1.0))


@pytest.mark.parametrize("how,expected", [("sum", [4.0, 2.0]), ("avg", [2.0, 1.0]), ("max", [3.0, 4.0])])
def test_reduce_arrays(spark, how, expected):
    df = spark.createDataFrame([("k", [1.0, -2.0]), ("k", [3.0, 4.0])], "k string, v array<double>")
    for width in (None, 2):
        assert reduce_arrays(df, ["k"], "v", how, width=width).first()["features"] == expected
    with pytest.raises(ValueError):
        reduce_arrays(df, ["k"], "v", "median")


def test_reduce_arrays_checks_widths_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, None), (2, None)], "k int, v array<double>")
    for width in (None, 3):
        assert [tuple(r) for r in reduce_arrays(df, ["k"], "v", width=width).collect()] == [(1, [1.0, 2.0, 3.0])]
    for width in (2, 17):
        with pytest.raises(Exception, match="stated width"):
            reduce_arrays(df, ["k"], "v", width=width).collect()
