"""Queries over graphs and pooled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.functions.arrays import additive_score, dot, reduce_arrays, softmax_pool
from pairframe.operators.encoding import encode
from pairframe.operators.graph import graph_average_pool, graph_conv, graph_max_pool, walk_edges
from pairframe.plans.adapters import (
    DIM,
    EDGE_SQL,
    NODE_SQL,
    event_obs,
    tidy,
    trade_edges,
    trade_nodes,
    user_vectors,
)
from pairframe.plans.catalog import query
from pairframe.session import cut_lineage

CONV_WEIGHTS = [[0.5, -0.25, 0.125], [0.25, 0.75, -0.5]]
CONV_BIAS = [1.0, 0.0, -2.0]
CONTEXT_V = [round(1.0 / (i + 1), 4) for i in range(DIM)]

EDGES = f"edges AS ({EDGE_SQL})"
NODES = f"nodes AS ({NODE_SQL})"


def _twice(walk: str) -> str:
    return f"SELECT DISTINCT x.graph, x.src, y.dst FROM {walk} x JOIN {walk} y ON x.graph = y.graph AND x.dst = y.src"


WALKS = f"w1 AS (SELECT graph, src, dst FROM edges), w2 AS ({_twice('w1')}), w4 AS ({_twice('w2')})"


@query(
    "graph_walk",
    f"WITH {EDGES}, {WALKS} SELECT DISTINCT graph, src, dst, CAST(1.0 AS DOUBLE) AS weight FROM (FROM w2 UNION ALL FROM w4)",
)
def graph_walk(spark, sf_dir):
    return walk_edges(cut_lineage(trade_edges(spark, sf_dir)), 6)


def _features(df, width):
    return df.select("graph", "node", *[tidy(F.get("features", i), 4).alias(f"x{i:02d}") for i in range(width)])


def _conv_sql(walk: str, weight: str) -> str:
    mapped = ", ".join(
        f"a * {CONV_WEIGHTS[0][u]} + b * {CONV_WEIGHTS[1][u]} + {CONV_BIAS[u]} AS h{u}" for u in range(3)
    )
    sums = ", ".join(f"round(coalesce(sum({weight} * h{u}), 0), 4) + 0.0 AS x{u:02d}" for u in range(3))
    return (
        f"WITH {EDGES}, {NODES}, {WALKS}, mapped AS (SELECT graph, node, {mapped} FROM nodes) "
        f"SELECT n.graph, n.node, {sums} FROM nodes n LEFT JOIN {walk} e ON n.graph = e.graph AND n.node = e.dst "
        "LEFT JOIN mapped m ON m.graph = e.graph AND m.node = e.src GROUP BY ALL"
    )


@query("graph_conv", _conv_sql("edges", "weight"))
def convolve(spark, sf_dir):
    edges = cut_lineage(trade_edges(spark, sf_dir))
    return _features(graph_conv(edges, trade_nodes(edges), CONV_WEIGHTS, CONV_BIAS), 3)


@query("graph_conv_walked", _conv_sql("w4", "1.0"))
def convolve_walked(spark, sf_dir):
    """Two steps, walked twice: neighbours at the end of a walk of length four."""
    edges = cut_lineage(trade_edges(spark, sf_dir))
    return _features(graph_conv(edges, trade_nodes(edges), CONV_WEIGHTS, CONV_BIAS, steps=2), 3)


@query(
    "graph_maxpool",
    f"WITH {EDGES}, {NODES}, {WALKS}, walked AS (SELECT DISTINCT * FROM (FROM w1 UNION ALL FROM w2)) "
    "SELECT n.graph, n.node, round(max(m.a), 4) AS x00, round(max(m.b), 4) AS x01 FROM nodes n "
    "LEFT JOIN walked e ON n.graph = e.graph AND n.node = e.src "
    "LEFT JOIN nodes m ON m.graph = e.graph AND m.node = e.dst GROUP BY ALL",
)
def max_pool(spark, sf_dir):
    edges = cut_lineage(trade_edges(spark, sf_dir))
    return _features(graph_max_pool(edges, trade_nodes(edges), steps=3, width=2), 2)


@query(
    "graph_avgpool",
    f"WITH {EDGES}, {NODES}, degree AS (SELECT graph, src, sum(weight) AS d FROM edges GROUP BY ALL), "
    "ins AS (SELECT e.graph, e.dst, sum(weight * a) AS a, sum(weight * b) AS b FROM edges e JOIN nodes n "
    "ON n.graph = e.graph AND n.node = e.src GROUP BY ALL) "
    "SELECT n.graph, n.node, round(coalesce(i.a / (coalesce(d, 0) + 1e-7::DOUBLE), 0), 2) + 0.0 AS x00, "
    "round(coalesce(i.b / (coalesce(d, 0) + 1e-7::DOUBLE), 0), 2) + 0.0 AS x01 FROM nodes n "
    "LEFT JOIN ins i ON n.graph = i.graph AND n.node = i.dst LEFT JOIN degree g ON n.graph = g.graph AND n.node = g.src",
)
def average_pool(spark, sf_dir):
    edges = cut_lineage(trade_edges(spark, sf_dir))
    pooled = graph_average_pool(edges, trade_nodes(edges), width=2)
    return pooled.select("graph", "node", *[tidy(F.get("features", i), 2).alias(f"x{i:02d}") for i in range(2)])


# (drug_id, id, label, pos, x): every event with its user's vector, long
EVENT_LONG_SQL = (
    "SELECT event_type AS drug_id, event_id AS id, value AS label, unnest(range(len(embedding))) AS pos, "
    "CAST(unnest(embedding) AS DOUBLE) AS x FROM events JOIN embeddings ON user_id = vec_id"
)


def _event_vectors(spark, sf_dir):
    return encode(event_obs(spark, sf_dir), user_vectors(spark, sf_dir), "cell_id", "vector")


def _vector_rows(df):
    return df.select("drug_id", F.posexplode("features").alias("pos", "x")).select(
        "drug_id", F.col("pos").cast("bigint"), tidy("x").alias("x")
    )


@query(
    "softmax_pool",
    f"WITH long AS ({EVENT_LONG_SQL}), peak AS (SELECT event_type AS drug_id, max(value / 20.0) AS m FROM events GROUP BY 1) "
    "SELECT drug_id, pos, round(sum(x * exp(label / 20.0 - m)) / sum(exp(label / 20.0 - m)), 6) + 0.0 AS x "
    "FROM long JOIN peak USING (drug_id) GROUP BY drug_id, pos",
)
def pool_by_softmax(spark, sf_dir):
    scored = _event_vectors(spark, sf_dir).withColumn("score", F.col("label") / 20.0)
    return _vector_rows(softmax_pool(scored, "drug_id", "score", "vector", width=DIM))


@query(
    "additive_score",
    f"WITH long AS ({EVENT_LONG_SQL}), context AS (SELECT drug_id, pos, avg(x) AS g FROM long GROUP BY ALL), "
    f"v AS (SELECT unnest(range({DIM})) AS pos, unnest({CONTEXT_V}::DOUBLE[]) AS v) "
    "SELECT id, drug_id, round(sum(v * tanh(g + x)), 6) + 0.0 AS score FROM long JOIN context USING (drug_id, pos) "
    "JOIN v USING (pos) GROUP BY id, drug_id",
)
def score_additively(spark, sf_dir):
    """Each event's vector against the mean vector of its type."""
    vectors = _event_vectors(spark, sf_dir)
    context = reduce_arrays(vectors, ["drug_id"], "vector", "avg", alias="context", width=DIM)
    scored = vectors.join(context, "drug_id").withColumn(
        "score", additive_score(F.col("context"), F.col("vector"), CONTEXT_V)
    )
    return scored.select("id", "drug_id", tidy("score").alias("score"))


@query(
    "vector_dot",
    f"WITH long AS ({EVENT_LONG_SQL}), sums AS (SELECT drug_id, pos, sum(x) AS s FROM long GROUP BY ALL) "
    "SELECT id, drug_id, round(sum(x * s), 4) + 0.0 AS product FROM long JOIN sums USING (drug_id, pos) GROUP BY id, drug_id",
)
def contract_vectors(spark, sf_dir):
    """Each event's vector contracted with the vector sum of its type."""
    vectors = _event_vectors(spark, sf_dir)
    sums = reduce_arrays(vectors, ["drug_id"], "vector", "sum", alias="sums", width=DIM)
    products = vectors.join(sums, "drug_id").withColumn("product", dot(F.col("vector"), F.col("sums")))
    return products.select("id", "drug_id", tidy("product", 4).alias("product"))


@query(
    "vector_sum",
    f"SELECT drug_id, pos, round(sum(x), 4) + 0.0 AS x FROM ({EVENT_LONG_SQL}) GROUP BY drug_id, pos",
)
def sum_vectors(spark, sf_dir):
    sums = reduce_arrays(_event_vectors(spark, sf_dir), ["drug_id"], "vector", "sum", width=DIM)
    return sums.select("drug_id", F.posexplode("features").alias("pos", "x")).select(
        "drug_id", F.col("pos").cast("bigint"), tidy("x", 4).alias("x")
    )
