"""Neighbourhood aggregation over many graphs at once.

edges: (graph, src, dst, weight), unique per (graph, src, dst), weights >= 0.
nodes: (graph, node, features ARRAY), unique per (graph, node). `width` is the length
of the arrays, when known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairframe.functions.arrays import linear, reduce_arrays
from pairframe.functions.guards import required
from pairframe.session import cut_lineage

# Fixed value: added to a degree before dividing by it.
EPSILON = 1e-7
HUB_BLOCK = 1_024


def _crowded(edges: DataFrame) -> DataFrame | None:
    """(graph): graphs of more than HUB_BLOCK edges; None if there is none.

    A node of any other graph has at most HUB_BLOCK in-edges and out-edges, also in the
    powers of its edges, so it is never a hub.
    """
    counts = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"))
    graphs = cut_lineage(counts.filter(F.col("_n") > HUB_BLOCK).select("graph"))
    return None if graphs.isEmpty() else graphs


def _hubs(pairs: DataFrame) -> DataFrame:
    """(graph, mid, _ins, _outs): nodes whose in-edges times out-edges exceed HUB_BLOCK
    squared, with the number of blocks each side is cut into."""
    ends = F.array(
        F.struct(F.col("dst").alias("mid"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
        F.struct(F.col("src").alias("mid"), F.lit(0).alias("_in"), F.lit(1).alias("_out")),
    )
    degrees = (
        pairs.select("graph", F.inline(ends))
        .groupBy("graph", "mid")
        .agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    )

    def blocks(column: str):
        return F.ceil(F.col(column) / HUB_BLOCK).cast("int").alias(f"{column}s")

    return degrees.filter(
        F.col("_in").cast("double") * F.col("_out").cast("double") > HUB_BLOCK * HUB_BLOCK
    ).select("graph", "mid", blocks("_in"), blocks("_out"))


def _square(pairs: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Distinct (graph, src, dst) joined by two steps of `pairs`; hubs lie in `crowded` graphs only.

    A hub yields the product of its in-edges and out-edges. Both are cut into blocks of
    about HUB_BLOCK and every pair of blocks is its own join key, so that product is
    spread over many tasks; all other nodes go through a plain join.
    """
    key = ["graph", "mid"]
    first = pairs.withColumnRenamed("dst", "mid")
    second = pairs.withColumnRenamed("src", "mid")
    hubs = None if crowded is None else cut_lineage(_hubs(pairs.join(crowded, "graph", "left_semi")))
    if hubs is None or hubs.isEmpty():
        return first.join(second, key).select("graph", "src", "dst").distinct()

    def blocks(side: DataFrame, end: str, own: str, own_count: str, far: str, far_count: str) -> DataFrame:
        return side.join(hubs, key).select(
            *key,
            end,
            F.pmod(F.xxhash64(end), F.col(own_count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(far_count) - 1)).alias(far),
        )

    into = blocks(first, "src", "_i", "_ins", "_o", "_outs")
    out_of = blocks(second, "dst", "_o", "_outs", "_i", "_ins")
    through_hubs = into.join(out_of, [*key, "_i", "_o"]).select("graph", "src", "dst")
    others = first.join(hubs, key, "left_anti").join(second, key).select("graph", "src", "dst")
    return others.union(through_hubs).distinct()


def walk_edges(edges: DataFrame, steps: int) -> DataFrame:
    """Edges walked by `steps`.

    One step or less returns the edges with their weights. Otherwise an edge of weight
    1 joins every pair connected by a walk of length exactly 2**k for some bit k that is
    set in `steps`. Squares are checkpointed, so the plan stays flat; give
    edges that are stored or checkpointed too, as they are read several times.
    """
    if steps <= 1:
        return edges
    power = edges.filter(F.col("weight") > 0).select("graph", "src", "dst")
    crowded = _crowded(power)
    parts = [power] if steps & 1 else []
    for k in range(1, steps.bit_length()):
        power = cut_lineage(_square(power, crowded))
        if steps >> k & 1:
            parts.append(power)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    if len(parts) > 1:
        result = result.distinct()
    return result.withColumn("weight", F.lit(1.0))


def _activated(vector: Column, activation) -> Column:
    return vector if activation is None else F.transform(vector, activation)


def _gather(
    edges: DataFrame, nodes: DataFrame, at: str, to: str, how: str, weight: Column | None, width: int | None
) -> DataFrame:
    """Nodes with `_sum`: features found at `at`, reduced over the edges of each `to`.

    Null where a node has no such edge.
    """
    side = nodes.select("graph", F.col("node").alias(at), "features")
    met = edges.join(side, ["graph", at]).withColumn("node", F.col(to))
    reduced = reduce_arrays(met, ["graph", "node"], "features", how, weight, "_sum", width)
    return nodes.join(reduced, ["graph", "node"], "left")


def graph_conv(
    edges: DataFrame,
    nodes: DataFrame,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
    steps: int = 1,
    activation=None,
) -> DataFrame:
    """(graph, node, features): activation(sum over in-edges of weight * (x . W + b)).

    More than one step walks the already walked edges again.
    """
    reached = walk_edges(walk_edges(edges, steps), steps)
    fits = F.col("features").isNull() | (F.size("features") == len(weights))
    nodes = nodes.filter(required(fits, f"features are not of the weights' length {len(weights)}"))
    mapped = nodes.withColumn("features", linear(F.col("features"), weights, bias))
    units = len(weights[0])
    sums = _gather(reached, mapped, "src", "dst", "sum", F.col("weight"), units)
    result = F.coalesce(F.col("_sum"), F.array_repeat(F.lit(0.0), units))
    return sums.select("graph", "node", _activated(result, activation).alias("features"))


def graph_max_pool(
    edges: DataFrame, nodes: DataFrame, steps: int = 1, activation=None, width: int | None = None
) -> DataFrame:
    """(graph, node, features): per feature the maximum over out-neighbours; null without any."""
    reached = walk_edges(edges, steps).filter(F.col("weight") > 0)
    best = _gather(reached, nodes, "dst", "src", "max", None, width)
    return best.select("graph", "node", _activated(F.col("_sum"), activation).alias("features"))


def graph_average_pool(
    edges: DataFrame, nodes: DataFrame, steps: int = 1, activation=None, width: int | None = None
) -> DataFrame:
    """(graph, node, features): weighted in-neighbour sum over (out-degree + epsilon); 0 without in-edges."""
    reached = walk_edges(edges, steps)
    sums = _gather(reached, nodes, "src", "dst", "sum", F.col("weight"), width)
    degree = reached.groupBy("graph", F.col("src").alias("node")).agg(F.sum("weight").alias("_degree"))
    joined = sums.join(degree, ["graph", "node"], "left")
    share = F.coalesce(F.col("_degree"), F.lit(0.0)) + F.lit(EPSILON)
    pooled = F.transform("_sum", lambda v: v / share)
    zeros = F.transform("features", lambda _: F.lit(0.0))
    result = F.coalesce(pooled, zeros)
    return joined.select("graph", "node", _activated(result, activation).alias("features"))
