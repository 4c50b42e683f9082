"""Queries on inputs where types, gaps or widths matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.featureset import ENTITY, VALUE, FeatureSet
from pairframe.functions.arrays import reduce_arrays
from pairframe.functions.numeric import nan_to_null
from pairframe.operators.encoding import encode_pairs
from pairframe.operators.metrics import score
from pairframe.operators.scaling import fit_apply, fit_apply_matrix
from pairframe.operators.selection import keep_members
from pairframe.plans.adapters import DIM, EVENT_OBS_SQL, SUPPLY_OBS_SQL, event_obs, scale_sql, spread_scan, supply_obs, table, tidy
from pairframe.plans.catalog import query
from pairframe.session import new_folder
from pairframe.sources.tables import read_feature_matrix, read_lookup

MANY_IDS = 2_500
WIDTHS = (2, 16, 17, DIM)
LEAST_EVENTS = 3

COMPLETE = (
    f"SELECT drug_id, label AS y_true, y_pred FROM ({EVENT_OBS_SQL}) JOIN (SELECT user_id AS u, avg(value) AS y_pred "
    f"FROM events GROUP BY user_id HAVING count(*) >= {LEAST_EVENTS}) ON cell_id = u"
)


@query(
    "metric_missing",
    "SELECT drug_id, round(1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 6) AS r2, "
    "round(covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)), 6) AS pearson, "
    f"round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse FROM ({COMPLETE}) GROUP BY drug_id",
)
def metric_missing(spark, sf_dir):
    """Scores where users with few events have no prediction."""
    obs = event_obs(spark, sf_dir)
    means = obs.groupBy("cell_id").agg(F.avg("label").alias("y_pred"), F.count("*").alias("n"))
    known = means.filter(F.col("n") >= LEAST_EVENTS).drop("n")
    rows = obs.withColumnRenamed("label", "y_true").join(known, "cell_id", "left")
    return score(rows, by=["drug_id"]).select("drug_id", *[F.round(m, 6).alias(m) for m in ("r2", "pearson", "rmse")])


@query(
    "scale_integer_labels",
    "WITH fit AS (SELECT p_brand, avg(p_size) AS mean, var_pop(p_size) AS var, CAST(count(*) AS DOUBLE) AS n FROM part "
    f"GROUP BY p_brand) SELECT p_partkey, p_brand, round((p_size - mean) / ({scale_sql()}), 6) + 0.0 AS p_size "
    "FROM part JOIN fit USING (p_brand)",
)
def scale_integer_labels(spark, sf_dir):
    """Integer labels become doubles when they are scaled."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return fit_apply(parts, "p_brand", "p_size").withColumn("p_size", tidy("p_size"))


@query(
    "select_many_ids",
    f"SELECT event_id, user_id, value FROM events WHERE event_id BETWEEN 1 AND {MANY_IDS}",
)
def select_many_ids(spark, sf_dir):
    """More ids than fit a filter, given as text, on a number column."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return keep_members(rows, "event_id", [str(i) for i in range(1, MANY_IDS + 1)])


@query("select_float_ids", f"SELECT event_id, user_id, value FROM events WHERE event_id BETWEEN 1 AND {MANY_IDS}")
def select_float_ids(spark, sf_dir):
    """The same ids as floats, some of them between two ids."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return keep_members(rows, "event_id", [i / 2 for i in range(1, 2 * MANY_IDS + 2)])


@query(
    "scale_grouped_matrix",
    "WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings), "
    "fit AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mean, var_pop(CAST(x AS DOUBLE)) AS var, CAST(count(*) AS DOUBLE) AS n "
    f"FROM x GROUP BY label, pos) SELECT vec_id, label, pos, round(CAST(CAST((x - mean) / ({scale_sql()}) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x "
    "FROM x JOIN fit USING (label, pos)",
)
def scale_grouped_matrix(spark, sf_dir):
    """Vectors scaled per label at all their positions; they stay floats."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    scaled = fit_apply_matrix(vectors, "label", "embedding")
    long = scaled.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return long.select("vec_id", "label", F.col("pos").cast("bigint").alias("pos"), tidy(F.col("x").cast("double"), 4).alias("x"))


@query(
    "reduce_widths",
    " UNION ALL ".join(
        f"SELECT label, {w} AS width, i - 1 AS pos, round(sum(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 AS total "
        f"FROM embeddings, range(1, {w + 1}) r(i) GROUP BY label, i"
        for w in WIDTHS
    ),
)
def reduce_widths(spark, sf_dir):
    """Element-wise sums per label of the leading parts of the vectors, narrow and wide alike."""
    vectors = table(spark, sf_dir, "embeddings")
    result = None
    for width in WIDTHS:
        part = vectors.select("label", F.slice("embedding", 1, width).alias("v"))
        sums = reduce_arrays(part, ["label"], "v", width=width).select(
            "label", F.lit(width).alias("width"), F.posexplode("features").alias("pos", "total")
        )
        result = sums if result is None else result.unionByName(sums)
    return result.withColumn("total", tidy("total"))


@query(
    "encode_two_sets",
    f"SELECT id, a.s_acctbal AS balance, b.s_nationkey AS nation FROM ({SUPPLY_OBS_SQL}) "
    "LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) a ON cell_id = a.s_suppkey "
    "LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey >= 12) b ON cell_id = b.s_suppkey",
)
def encode_two_sets(spark, sf_dir):
    """Two feature sets of one side that cover different suppliers, without strictness."""
    suppliers = table(spark, sf_dir, "supplier")
    sets = {
        "balance": FeatureSet.lookup(suppliers.filter("s_acctbal > 0"), "s_suppkey", "s_acctbal", "balance"),
        "nation": FeatureSet.lookup(suppliers.filter("s_nationkey >= 12"), "s_suppkey", "s_nationkey", "nation"),
    }
    rows = encode_pairs(supply_obs(spark, sf_dir), sets, {}, strict=False)
    return rows.select("id", F.col("cell_balance").alias("balance"), F.col("cell_nation").alias("nation"))


@query(
    "csv_missing",
    "SELECT s_suppkey AS entity_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE round(s_acctbal, 2) END AS balance, "
    "CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS DOUBLE) END AS nation FROM supplier",
)
def csv_missing(spark, sf_dir):
    """A matrix file with the texts NA and null where numbers are missing."""
    path = new_folder(spark, "csv")
    texts = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") < 0, "NA").otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
        F.when(F.col("s_nationkey") % 3 == 0, "null").otherwise(F.col("s_nationkey").cast("string")).alias("nation"),
    )
    texts.write.options(header=True, escape='"').csv(path)
    matrix = read_feature_matrix(spark, path, key_type="bigint")
    return matrix.table.select(
        ENTITY, *[F.round(nan_to_null(F.get(VALUE, i)), 2).alias(c) for i, c in enumerate(matrix.feature_names)]
    )


@query("csv_quoted", "SELECT CAST(doc_id AS VARCHAR) AS entity_id, md5(text) AS digest FROM documents")
def csv_quoted(spark, sf_dir):
    """Whole texts, with their quotes and line ends, through a CSV lookup file and back."""
    path = new_folder(spark, "csv")
    texts = spread_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts.write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    lookup = read_lookup(spark, path, "text", "doc_id")
    return lookup.table.select(ENTITY, F.md5(VALUE).alias("digest"))
