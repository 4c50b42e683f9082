"""Queries over observations: conform, choose, subset, summarise, intersect."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.frame import PairFrame
from pairframe.operators.checks import (
    check_feature_sets,
    check_kind,
    check_same_columns,
    duplicate_keys,
    key_mismatches,
    order_mismatches,
    unknown_keys,
)
from pairframe.operators.batching import batch_rows
from pairframe.operators.features import signature
from pairframe.operators.observations import (
    as_entity_table,
    as_obs,
    filter_by_value_counts,
    mapping_from_columns,
    pick_metric,
    summarise,
    value_counts,
)
from pairframe.operators.selection import attach_metadata, intersect_columns, pair_grid
from pairframe.plans.adapters import (
    EVENT_OBS_SQL,
    SUPPLY_OBS_SQL,
    event_obs,
    supply_metrics,
    supply_obs,
    table,
    tidy,
    user_vectors,
)
from pairframe.plans.catalog import query


@query("obs_conform", f"SELECT id, cell_id, drug_id, round(label, 6) AS label FROM ({SUPPLY_OBS_SQL})")
def obs_conform(spark, sf_dir):
    return supply_obs(spark, sf_dir).withColumn("label", tidy("label"))


@query(
    "obs_generated_id",
    "SELECT row_number() OVER (ORDER BY md5(concat_ws(':', 7, l_suppkey, l_partkey, "
    "CAST(round(l_extendedprice * 100) AS BIGINT), 0)), l_suppkey, l_partkey, l_extendedprice) - 1 AS id, "
    "l_suppkey AS cell_id, l_partkey AS drug_id, l_extendedprice AS label FROM lineitem",
)
def obs_generated_id(spark, sf_dir):
    cents = F.round(F.col("label") * 100).cast("bigint")
    return as_obs(
        table(spark, sf_dir, "lineitem"),
        "row_id",
        "l_extendedprice",
        "l_suppkey",
        "l_partkey",
        hash_by=["cell_id", "drug_id", cents],
        seed=7,
    )


@query(
    "obs_ordered_id",
    "SELECT row_number() OVER (ORDER BY l_shipdate, l_returnflag DESC, l_suppkey, l_partkey, l_extendedprice) - 1 AS id, "
    "l_suppkey AS cell_id, l_partkey AS drug_id, l_extendedprice AS label FROM lineitem",
)
def obs_ordered_id(spark, sf_dir):
    """Ids by ship date, then return flag backwards; equal ones by the observation itself."""
    flag = F.ascii("l_returnflag") * -1
    return as_obs(
        table(spark, sf_dir, "lineitem"),
        "row_id",
        "l_extendedprice",
        "l_suppkey",
        "l_partkey",
        order_by=["l_shipdate", flag],
    )


@query("metric_pick", f"SELECT id, cell_id, drug_id, round(quantity, 6) AS label FROM ({SUPPLY_OBS_SQL})")
def metric_pick(spark, sf_dir):
    return pick_metric(supply_metrics(spark, sf_dir), "quantity").withColumn("label", tidy("label"))


@query(
    "select_ids",
    f"SELECT * FROM ({EVENT_OBS_SQL}) WHERE id IN (SELECT event_id FROM (SELECT event_id, row_number() OVER "
    "(PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1)",
)
def select_ids(spark, sf_dir):
    """Each user's highest observation."""
    events = table(spark, sf_dir, "events")
    ids = events.groupBy("user_id").agg(F.max(F.struct("value", "event_id"))["event_id"].alias("event_id"))
    return PairFrame(event_obs(spark, sf_dir)).select(ids.select("event_id")).obs


@query(
    "select_cells",
    f"SELECT * FROM ({EVENT_OBS_SQL}) WHERE cell_id IN (SELECT vec_id FROM embeddings WHERE label = 3)",
)
def select_cells(spark, sf_dir):
    wanted = table(spark, sf_dir, "embeddings").filter(F.col("label") == 3).select("vec_id")
    return PairFrame(event_obs(spark, sf_dir)).select_cells(wanted).obs


@query("select_drugs", f"SELECT * FROM ({EVENT_OBS_SQL}) WHERE drug_id IN ('click', 'purchase', 'unheard of')")
def select_drugs(spark, sf_dir):
    return PairFrame(event_obs(spark, sf_dir)).select_drugs(["click", "purchase", "unheard of"]).obs


@query(
    "min_count_filter",
    f"SELECT id, cell_id, drug_id, round(label, 6) AS label FROM ({SUPPLY_OBS_SQL}) WHERE drug_id IN "
    f"(SELECT drug_id FROM ({SUPPLY_OBS_SQL}) GROUP BY drug_id HAVING count(*) >= 26)",
)
def min_count_filter(spark, sf_dir):
    return filter_by_value_counts(supply_obs(spark, sf_dir), "drug_id", 26).withColumn("label", tidy("label"))


@query("value_counts", f"SELECT drug_id, count(*) AS count FROM ({SUPPLY_OBS_SQL}) GROUP BY drug_id")
def count_drugs(spark, sf_dir):
    return value_counts(supply_obs(spark, sf_dir), "drug_id")


@query(
    "dataset_summary",
    f"SELECT count(*) AS size, count(DISTINCT cell_id) AS n_cells, count(DISTINCT drug_id) AS n_drugs "
    f"FROM ({EVENT_OBS_SQL})",
)
def dataset_summary(spark, sf_dir):
    return summarise(event_obs(spark, sf_dir))


@query(
    "lookup_map",
    "SELECT user_id AS entity_id, event_type, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def lookup_map(spark, sf_dir):
    """The last event of every user, keyed by user."""
    last = table(spark, sf_dir, "events").select(
        "user_id", F.struct("event_type", "value").alias("last"), F.struct("ts", "event_id").alias("at")
    )
    mapping = mapping_from_columns(last, "user_id", "last", "at")
    return as_entity_table(mapping, "user_id").select("entity_id", "last.event_type", "last.value")


@query(
    "pair_grid",
    "SELECT cell_id, drug_id FROM (SELECT DISTINCT user_id AS cell_id FROM events), "
    "(SELECT DISTINCT event_type AS drug_id FROM events)",
)
def grid(spark, sf_dir):
    obs = event_obs(spark, sf_dir)
    return pair_grid(obs, obs)


@query(
    "intersect_keys",
    "WITH common AS (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer "
    "INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) "
    "SELECT 'customer' AS side, c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey IN (FROM common) "
    "UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (FROM common) "
    "UNION ALL SELECT 'nation', n_nationkey, n_nationkey FROM nation WHERE n_nationkey IN (FROM common)",
)
def intersect_keys(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 2)
    s, c, n = intersect_columns(
        table(spark, sf_dir, "supplier"),
        table(spark, sf_dir, "customer"),
        nations,
        cols=["s_nationkey", "c_nationkey", "n_nationkey"],
    )

    def rows(df, side, key, nation):
        return df.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("id"), F.col(nation).alias("nation"))

    return (
        rows(c, "customer", "c_custkey", "c_nationkey")
        .unionByName(rows(s, "supplier", "s_suppkey", "s_nationkey"))
        .unionByName(rows(n, "nation", "n_nationkey", "n_nationkey"))
    )


@query(
    "metadata_join",
    f"SELECT o.id, o.cell_id, round(o.label, 6) AS label, s_name, n_name FROM ({SUPPLY_OBS_SQL}) o "
    "JOIN supplier ON cell_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
)
def metadata_join(spark, sf_dir):
    suppliers = attach_metadata(
        table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_nationkey", ["n_name"], "n_nationkey"
    )
    obs = supply_obs(spark, sf_dir).select("id", "cell_id", tidy("label").alias("label"))
    return attach_metadata(obs, suppliers, "cell_id", ["s_name", "n_name"], "s_suppkey")


@query(
    "checks_report",
    "SELECT 'unknown_users' AS check_name, count(*) AS violations FROM (SELECT DISTINCT user_id FROM events "
    "WHERE user_id NOT IN (SELECT vec_id FROM embeddings)) UNION ALL "
    "SELECT 'vectors_without_events', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events) "
    "UNION ALL SELECT 'repeated_event_ids', count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1) "
    "UNION ALL SELECT 'repeated_line_keys', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1) "
    "UNION ALL SELECT 'key_mismatches', count(*) FROM ((SELECT DISTINCT user_id AS k FROM events EXCEPT SELECT vec_id "
    "FROM embeddings) UNION ALL (SELECT vec_id FROM embeddings EXCEPT SELECT user_id FROM events)) "
    "UNION ALL SELECT 'position_mismatches', count(*) FROM (SELECT event_id AS x, row_number() OVER (ORDER BY ts, "
    "md5(concat_ws(':', 0, event_id)), event_id) AS r FROM events) FULL JOIN (SELECT event_id AS y, row_number() OVER "
    "(ORDER BY user_id, value, md5(concat_ws(':', 0, event_id)), event_id) AS r FROM events WHERE event_type <> 'click') "
    "USING (r) WHERE x IS DISTINCT FROM y",
)
def checks_report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    vectors = table(spark, sf_dir, "embeddings")
    users = events.select("user_id").distinct()
    reports = {
        "unknown_users": unknown_keys(events, "user_id", vectors, "vec_id"),
        "vectors_without_events": unknown_keys(vectors, "vec_id", users, "user_id"),
        "repeated_event_ids": duplicate_keys(events, "event_id"),
        "repeated_line_keys": duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"),
        "key_mismatches": key_mismatches(users, vectors.withColumnRenamed("vec_id", "user_id"), "user_id"),
    }
    reports["position_mismatches"] = order_mismatches(
        events, events.filter("event_type <> 'click'"), "event_id", "ts", ["user_id", "value"]
    )
    counts = [
        df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations")) for name, df in reports.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


class NameLength:
    """A feature set of one's own: anything with kind, name, width and attach will do."""

    kind, name, width = "lookup", "length", 1

    def attach(self, df, key, column, strict=True):
        return df.withColumn(column, F.length(F.col(key).cast("string")))


def _error_of(call) -> str:
    try:
        call()
    except (ValueError, TypeError) as error:
        return str(error)
    return "none"


@query(
    "frame_report",
    f"WITH o AS ({EVENT_OBS_SQL}) SELECT 'size' AS item, CAST(count(*) AS VARCHAR) AS value FROM o "
    "UNION ALL SELECT 'cells', CAST(count(DISTINCT cell_id) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'drugs', CAST(count(DISTINCT drug_id) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'cell ids', CAST(sum(cell_id) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'drug ids', CAST(sum(length(drug_id)) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'labels', CAST(CAST(round(sum(label)) AS BIGINT) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'own feature set', CAST(sum(length(drug_id)) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'whole batch rows', CAST(count(*) AS VARCHAR) FROM o "
    "UNION ALL SELECT 'label type', 'double' UNION ALL SELECT 'signature', 'embedding float 64' "
    "UNION ALL SELECT 'same columns', 'True' UNION ALL SELECT 'without sets', 'frame has no cell feature sets' "
    "UNION ALL SELECT 'wrong kind', 'expected a lookup feature set, got matrix'",
)
def frame_report(spark, sf_dir):
    """What a frame and its checks tell about themselves."""
    frame = PairFrame(
        event_obs(spark, sf_dir), {"vector": user_vectors(spark, sf_dir)}, {"length": NameLength()}
    )
    described = signature(frame.cell_features["vector"])
    text = {
        "label type": frame.dtype,
        "signature": f"{described['name']} {described['dtype']} {described['shape'][0]}",
        "same columns": str(check_same_columns(frame.obs, frame.sample_cells(1).obs)),
        "without sets": _error_of(lambda: check_feature_sets(None, {"length": NameLength()})),
        "wrong kind": _error_of(lambda: check_kind(frame.cell_features["vector"], "lookup")),
    }
    counted = {
        "size": frame.summary().select("size"),
        "cells": frame.summary().select("n_cells"),
        "drugs": frame.summary().select("n_drugs"),
        "cell ids": frame.cell_ids.agg(F.sum("cell_id")),
        "drug ids": frame.drug_ids.agg(F.sum(F.length("drug_id"))),
        "labels": frame.labels.agg(F.round(F.sum("label")).cast("bigint")),
        "own feature set": NameLength().attach(frame.obs, "drug_id", "n").agg(F.sum("n")),
        "whole batch rows": batch_rows(frame.obs).agg(F.count("*")),
    }
    result = spark.createDataFrame(list(text.items()), "item string, value string")
    for item, df in counted.items():
        result = result.unionByName(df.select(F.lit(item).alias("item"), F.col(df.columns[0]).cast("string").alias("value")))
    return result
