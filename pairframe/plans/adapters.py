"""The given tables in the roles of observations, feature sets and graphs.

Each adapter has its SQL twin, used inside the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairframe.featureset import FeatureSet
from pairframe.functions.numeric import FLOAT64_EPS
from pairframe.operators.observations import as_obs
from pairframe.operators.ranking import rank_rows
from pairframe.operators.splitting import stratified_holdout
from pairframe.session import cut_lineage

DIM = 64
SPLIT_SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_scan(df: DataFrame) -> DataFrame:
    """A plain file scan with at least one partition per core, for work that is heavy per row.

    Only a table of few row groups is shuffled; a large one already has enough splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


# Events as observations: user = cell, event type = drug.
EVENT_OBS_SQL = "SELECT event_id AS id, user_id AS cell_id, event_type AS drug_id, value AS label FROM events"


def event_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_obs(table(spark, sf_dir, "events"), "event_id", "value", "user_id", "event_type")


# Line items averaged per (supplier, part): supplier = cell, part = drug.
SUPPLY_OBS_SQL = (
    "SELECT concat_ws(':', l_suppkey, l_partkey) AS id, l_suppkey AS cell_id, l_partkey AS drug_id, "
    "avg(l_extendedprice) AS label, avg(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey, l_partkey"
)


def supply_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("drug_id"))
        .agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"))
        .withColumn("id", F.concat_ws(":", "cell_id", "drug_id"))
    )


def supply_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_obs(supply_metrics(spark, sf_dir), label_col="price")


def user_vectors(spark: SparkSession, sf_dir: str) -> FeatureSet:
    """Embeddings as cell features of the events; vec_id = user_id."""
    names = [f"f{i}" for i in range(DIM)]
    return FeatureSet.matrix(table(spark, sf_dir, "embeddings"), names, "vec_id", "embedding", "embedding")


def supplier_features(spark: SparkSession, sf_dir: str) -> FeatureSet:
    return FeatureSet.from_columns(
        table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"], name="supplier"
    )


def part_features(spark: SparkSession, sf_dir: str) -> FeatureSet:
    return FeatureSet.from_columns(
        table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], name="part"
    )


def document_texts(spark: SparkSession, sf_dir: str) -> FeatureSet:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return FeatureSet.lookup(spread_scan(documents), "doc_id", "text", "text")


def _apportion_sql(source: str, size: str, wanted: str, name: str, stratum: str) -> str:
    """Largest remainders: `wanted` places in proportion to `size`."""
    return (
        f"SELECT * EXCLUDE (rest, base), base + CASE WHEN row_number() OVER (ORDER BY rest DESC, md5(concat_ws(':', {SPLIT_SEED}, {stratum})), "
        f"{stratum}) <= {wanted} - sum(base) OVER () THEN 1 ELSE 0 END AS {name} FROM (SELECT *, "
        f"({wanted} * {size}) // greatest(pool, 1) AS base, ({wanted} * {size}) % greatest(pool, 1) AS rest "
        f"FROM (SELECT *, sum({size}) OVER () AS pool FROM ({source})))"
    )


def role_sql(source: str, key: str, stratum: str) -> str:
    """SQL of `stratified_holdout`; the sizes are rounded up over the whole table."""
    sizes = f"SELECT {stratum}, count(*) AS n, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS e FROM {source} GROUP BY {stratum}"
    wants = f"SELECT *, CAST(least(ceil(CAST(0.1 AS DOUBLE) * sum(n) OVER ()), sum(e) OVER ()) AS BIGINT) AS want FROM ({sizes})"
    tests = _apportion_sql(wants, "e", "want", "t", stratum)
    more = (
        "SELECT * EXCLUDE pool, e - t AS f, CAST(least(ceil(CAST(0.1 AS DOUBLE) * (sum(n) OVER () - want)), sum(e - t) OVER ()) AS BIGINT) "
        f"AS more FROM ({tests})"
    )
    vals = _apportion_sql(more, "f", "more", "v", stratum)
    return (
        f"SELECT {key}, {stratum} AS stratum, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS role FROM "
        f"(SELECT {key}, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws(':', {SPLIT_SEED}, {key})), {key}) AS r "
        f"FROM {source}) JOIN ({vals}) USING ({stratum})"
    )


# Hold-out roles of the embedding entities, stratified by their label.
ROLE_SQL = role_sql("embeddings", "vec_id", "label")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, role)."""
    return stratified_holdout(table(spark, sf_dir, "embeddings"), "vec_id", "label", seed=SPLIT_SEED)


def role_members(roles: DataFrame, role: str) -> DataFrame:
    return roles.filter(F.col("role") == role).select("vec_id")


def fold_parts(obs: DataFrame, folds: int = 10, seed: int = 0) -> DataFrame:
    """(id, part): every id in one of `folds` equal parts."""
    placed = rank_rows(obs.select("id"), ["id"], seed, name="_position")
    return placed.select("id", (F.col("_position") % folds).cast("int").alias("part"))


# One graph per part: nation of the supplier -> nation of the customer, weighted by quantity.
EDGE_SQL = (
    "SELECT l_partkey AS graph, s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS weight "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
)
# Its nodes: every end point, with the quantity shipped and received.
NODE_SQL = (
    "SELECT graph, node, sum(shipped) AS a, sum(received) AS b FROM ("
    "SELECT graph, src AS node, weight AS shipped, 0.0 AS received FROM edges UNION ALL "
    "SELECT graph, dst, 0.0, weight FROM edges) GROUP BY ALL"
)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.col("l_partkey").alias("graph"), F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")
        )
        .agg(F.sum("l_quantity").alias("weight"))
    )


def trade_nodes(edges: DataFrame) -> DataFrame:
    # both ends of an edge in one pass
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("weight").alias("shipped"), F.lit(0.0).alias("received")),
        F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("shipped"), F.col("weight").alias("received")),
    )
    # stored, since both sides of the neighbourhood join read them
    return cut_lineage(
        edges.select("graph", F.inline(ends))
        .groupBy("graph", "node")
        .agg(F.array(F.sum("shipped"), F.sum("received")).alias("features"))
    )


def scale_sql(mean: str = "mean", var: str = "var", n: str = "n") -> str:
    """The safe standard deviation in SQL."""
    eps = f"CAST({FLOAT64_EPS!r} AS DOUBLE)"
    return (
        f"CASE WHEN {var} <= {n} * {eps} * {var} + pow({n} * {mean} * {eps}, 2) "
        f"THEN 1.0 ELSE sqrt({var}) END"
    )


def spread(vector: str, width: int, prefix: str = "f") -> list:
    """Array elements as double columns f00, f01, ..."""
    return [F.get(vector, i).cast("double").alias(f"{prefix}{i:02d}") for i in range(width)]


def spread_sql(vector: str, width: int, prefix: str = "f") -> str:
    return ", ".join(f"CAST({vector}[{i + 1}] AS DOUBLE) AS {prefix}{i:02d}" for i in range(width))


def tidy(column, digits: int = 6):
    """Rounded double without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
