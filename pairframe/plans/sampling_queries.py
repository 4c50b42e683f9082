"""Queries for scaling, samples, splits, batches and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.frame import PairFrame
from pairframe.operators.batching import Batches, read_batch, read_batches
from pairframe.operators.metrics import prediction_rows, score
from pairframe.operators.scaling import apply_scaler, fit_apply, fit_scaler
from pairframe.operators.splitting import apply_split, stratified_holdout
from pairframe.plans.adapters import (
    EVENT_OBS_SQL,
    ROLE_SQL,
    SPLIT_SEED,
    SUPPLY_OBS_SQL,
    event_obs,
    fold_parts,
    role_sql,
    scale_sql,
    spread,
    supply_obs,
    table,
    tidy,
    user_roles,
)
from pairframe.plans.catalog import query
from pairframe.plans.feature_queries import CELLS_FIRST, PAIR_SQL, supply_frame
from pairframe.session import new_folder
from pairframe.sources.splits import (
    load_fold,
    load_parts,
    load_splits,
    read_split_lists,
    save_parts,
    save_splits,
    write_split_lists,
)

SAMPLE_SEED = 42
BATCH = 128
FOLDS_SEED = 5

FIT = "avg(label) AS mean, var_pop(label) AS var, CAST(count(*) AS DOUBLE) AS n"


@query(
    "scale_grouped",
    f"WITH obs AS ({EVENT_OBS_SQL}), fit AS (SELECT drug_id, {FIT} FROM obs GROUP BY drug_id) "
    f"SELECT id, cell_id, drug_id, round((label - mean) / ({scale_sql()}), 6) + 0.0 AS label FROM obs JOIN fit USING (drug_id)",
)
def scale_grouped(spark, sf_dir):
    return fit_apply(event_obs(spark, sf_dir), "drug_id").withColumn("label", tidy("label"))


@query(
    "scale_grouped_parts",
    f"WITH obs AS ({SUPPLY_OBS_SQL}), fit AS (SELECT drug_id, {FIT} FROM obs GROUP BY drug_id) "
    f"SELECT id, cell_id, drug_id, round((label - mean) / ({scale_sql()}), 6) + 0.0 AS label FROM obs JOIN fit USING (drug_id)",
)
def scale_grouped_parts(spark, sf_dir):
    return fit_apply(supply_obs(spark, sf_dir), "drug_id").withColumn("label", tidy("label"))


@query(
    "scale_global",
    f"WITH obs AS ({SUPPLY_OBS_SQL}), fit AS (SELECT {FIT} FROM obs) "
    f"SELECT id, cell_id, drug_id, round((label - mean) / ({scale_sql()}), 6) + 0.0 AS label FROM obs, fit",
)
def scale_global(spark, sf_dir):
    return fit_apply(supply_obs(spark, sf_dir)).withColumn("label", tidy("label"))


@query(
    "scale_fit_apply",
    f"WITH obs AS ({EVENT_OBS_SQL}), roles AS ({ROLE_SQL}), fit AS (SELECT drug_id, {FIT} FROM obs "
    "JOIN roles ON cell_id = vec_id WHERE role = 'train' GROUP BY drug_id) "
    f"SELECT role, id, cell_id, drug_id, round((label - mean) / ({scale_sql()}), 6) + 0.0 AS label "
    "FROM obs JOIN roles ON cell_id = vec_id JOIN fit USING (drug_id)",
)
def scale_fit_apply(spark, sf_dir):
    """Labels of every role scaled per drug with the statistics of the training cells."""
    roles = user_roles(spark, sf_dir).select(F.col("vec_id").alias("id"), "role")
    obs = apply_split(event_obs(spark, sf_dir), roles, "cell_id")
    stats = fit_scaler(obs.filter(F.col("role") == "train"), "drug_id")
    return apply_scaler(obs, stats, "drug_id").withColumn("label", tidy("label"))


@query(
    "sample_obs",
    f"SELECT * FROM ({EVENT_OBS_SQL}) ORDER BY md5(concat_ws(':', {SAMPLE_SEED}, id)), id LIMIT 500",
)
def sample_obs(spark, sf_dir):
    return PairFrame(event_obs(spark, sf_dir)).sample(500, SAMPLE_SEED).obs


@query(
    "sample_cells",
    f"SELECT * FROM ({EVENT_OBS_SQL}) WHERE cell_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) "
    f"ORDER BY md5(concat_ws(':', {SAMPLE_SEED}, user_id)), user_id LIMIT 10)",
)
def sample_cells(spark, sf_dir):
    return PairFrame(event_obs(spark, sf_dir)).sample_cells(10, SAMPLE_SEED).obs


@query(
    "sample_drugs",
    f"SELECT * FROM ({EVENT_OBS_SQL}) WHERE drug_id IN (SELECT event_type FROM (SELECT DISTINCT event_type FROM events) "
    f"ORDER BY md5(concat_ws(':', {SAMPLE_SEED}, event_type)), event_type LIMIT 2)",
)
def sample_drugs(spark, sf_dir):
    return PairFrame(event_obs(spark, sf_dir)).sample_drugs(2, SAMPLE_SEED).obs


def _rank_sql(salt: str) -> str:
    return f"row_number() OVER (ORDER BY md5(concat_ws(':', {salt}, id)), id) - 1"


@query("shuffle_rank", f"SELECT *, {_rank_sql(str(SAMPLE_SEED))} AS position FROM ({EVENT_OBS_SQL})")
def shuffle_rank(spark, sf_dir):
    return PairFrame(event_obs(spark, sf_dir)).shuffle(SAMPLE_SEED)


@query("stratified_holdout", f"SELECT vec_id, stratum AS label, role FROM ({ROLE_SQL})")
def holdout(spark, sf_dir):
    return user_roles(spark, sf_dir)


PART_ROLE_SQL = role_sql("(SELECT p_partkey, concat(p_brand, '/', p_size) AS kind FROM part)", "p_partkey", "kind")


@query("holdout_small_strata", f"SELECT p_partkey, stratum AS kind, role FROM ({PART_ROLE_SQL})")
def holdout_small_strata(spark, sf_dir):
    """Parts held out by brand and size: many strata of few members, some of one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_size").alias("kind"))
    return stratified_holdout(parts, "p_partkey", "kind", seed=SPLIT_SEED)


@query(
    "apply_split",
    f"SELECT role, o.* FROM ({EVENT_OBS_SQL}) o JOIN ({ROLE_SQL}) ON cell_id = vec_id",
)
def split_events(spark, sf_dir):
    roles = user_roles(spark, sf_dir).select(F.col("vec_id").alias("id"), "role")
    return apply_split(event_obs(spark, sf_dir), roles, "cell_id")


FOLD_SQL = (
    "SELECT fold, CASE WHEN p = fold - 1 THEN 'test' WHEN p = fold % 10 THEN 'val' ELSE 'train' END AS role, id "
    f"FROM (SELECT id, ({_rank_sql(str(FOLDS_SEED))}) % 10 AS p FROM ({EVENT_OBS_SQL})), "
    "(SELECT CAST(unnest(range(1, 11)) AS INT) AS fold)"
)


def _stored_parts(spark, sf_dir) -> str:
    path = new_folder(spark, "parts")
    save_parts(fold_parts(event_obs(spark, sf_dir), 10, FOLDS_SEED), path)
    return path


@query("kfold_splits", FOLD_SQL)
def kfold_splits(spark, sf_dir):
    """Ten folds over parts that hold every id once."""
    return load_parts(spark, _stored_parts(spark, sf_dir))


@query(
    "fold_observations",
    f"SELECT role, o.* FROM ({EVENT_OBS_SQL}) o JOIN ({FOLD_SQL}) f ON o.id = f.id WHERE fold = 3",
)
def fold_observations(spark, sf_dir):
    """Observations of one stored fold by role."""
    split = load_fold(spark, _stored_parts(spark, sf_dir), 3)
    frame = PairFrame(event_obs(spark, sf_dir))
    parts = [
        frame.select(ids, name=role).obs.select(F.lit(role).alias("role"), "*")
        for role, ids in (("train", split.train_ids), ("val", split.val_ids), ("test", split.test_ids))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("split_lists", f"SELECT * FROM ({FOLD_SQL}) WHERE fold <= 2")
def split_lists(spark, sf_dir):
    """The first two folds as files of ids, read by their names."""
    path = new_folder(spark, "lists")
    folds = load_parts(spark, _stored_parts(spark, sf_dir)).filter(F.col("fold") <= 2)
    write_split_lists(folds, path)
    return read_split_lists(spark, path, "bigint")


@query(
    "stored_splits",
    f"SELECT fold, role, count(*) AS n, min(id) AS first_id FROM ({FOLD_SQL}) WHERE fold IN (1, 10) GROUP BY fold, role",
)
def stored_splits(spark, sf_dir):
    """Splits stored as (fold, role, id), summarised from a folder per fold and role."""
    path = new_folder(spark, "splits")
    folds = load_parts(spark, _stored_parts(spark, sf_dir)).filter(F.col("fold").isin(1, 10))
    save_splits(folds, path)
    return load_splits(spark, path).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "batch_count",
    f"SELECT count(*) AS n_rows, CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches FROM events",
)
def batch_count(spark, sf_dir):
    return Batches(event_obs(spark, sf_dir), BATCH).count()


@query(
    "batch_assign",
    f"SELECT *, position // {BATCH} AS batch_id FROM (SELECT *, {_rank_sql('0, 0')} AS position FROM ({EVENT_OBS_SQL}))",
)
def batch_assign(spark, sf_dir):
    return Batches(event_obs(spark, sf_dir), BATCH).assign()


@query(
    "batch_ordered",
    f"SELECT *, position // {BATCH} AS batch_id FROM (SELECT *, row_number() OVER (ORDER BY label, "
    f"md5(concat_ws(':', 0, 0, id)), id) - 1 AS position FROM ({EVENT_OBS_SQL}))",
)
def batch_ordered(spark, sf_dir):
    """Batches in the order of a column with many ties."""
    return Batches(event_obs(spark, sf_dir), BATCH, order_by="label").assign()


TEXT_ORDER_SQL = (
    "SELECT *, row_number() OVER (ORDER BY drug_id, ts, md5(concat_ws(':', 0, 0, id)), id) - 1 AS position FROM "
    "(SELECT event_id AS id, user_id AS cell_id, event_type AS drug_id, value AS label, ts FROM events)"
)


def _timed_batches(spark, sf_dir):
    ts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return Batches(event_obs(spark, sf_dir).join(ts, "id"), BATCH, order_by=["drug_id", "ts"])


@query("batch_ordered_text", f"SELECT * EXCLUDE ts, position // {BATCH} AS batch_id FROM ({TEXT_ORDER_SQL})")
def batch_ordered_text(spark, sf_dir):
    """Batches in the order of a string, a third of the rows at each value, and a timestamp."""
    return _timed_batches(spark, sf_dir).assign().drop("ts")


@query("batch_ordered_slice", f"SELECT * EXCLUDE (ts, position) FROM ({TEXT_ORDER_SQL}) WHERE position // {BATCH} = 4")
def batch_ordered_slice(spark, sf_dir):
    """One batch of that order, without sorting the others."""
    return _timed_batches(spark, sf_dir).batch(4).drop("ts")


@query(
    "batch_slice",
    f"SELECT * EXCLUDE position FROM (SELECT *, {_rank_sql('9, 1')} AS position FROM ({EVENT_OBS_SQL})) "
    f"WHERE position // {BATCH} = 5",
)
def batch_slice(spark, sf_dir):
    return Batches(event_obs(spark, sf_dir), BATCH, shuffle=True, seed=9).batch(5, epoch=1)


@query(
    "epoch_order",
    f"SELECT 0 AS epoch, id, {_rank_sql('9, 0')} AS position FROM ({EVENT_OBS_SQL}) UNION ALL "
    f"SELECT 1, id, {_rank_sql('9, 1')} FROM ({EVENT_OBS_SQL})",
)
def epoch_order(spark, sf_dir):
    batches = Batches(event_obs(spark, sf_dir), BATCH, shuffle=True, seed=9)
    first, second = (batches.order(e).select(F.lit(e).alias("epoch"), "id", "position") for e in (0, 1))
    return first.unionByName(second)


@query(
    "batch_features",
    f"SELECT * EXCLUDE position, position // {BATCH} AS batch_id FROM (SELECT id, cell_id, drug_id, label AS target, "
    f"x00, x01, x02, x03, {_rank_sql('3, 2')} AS position FROM ({PAIR_SQL.format(x=CELLS_FIRST)}))",
)
def batch_features(spark, sf_dir):
    """Encoded, shuffled mini-batches."""
    frame = supply_frame(spark, sf_dir)
    encoded = frame.batches(BATCH, shuffle=True, seed=3).assign(epoch=2)
    return encoded.withColumn("x", F.concat(*frame.feature_columns)).select(
        "id", "cell_id", "drug_id", tidy("target").alias("target"), *spread("x", 4, "x"), "batch_id"
    )


STORED_BATCHES = (0, 3, 11)


@query(
    "batch_store",
    f"WITH b AS (SELECT id, cell_id, drug_id, round(target, 6) + 0.0 AS target, round(x00, 6) + 0.0 AS x00, position, position // {BATCH} AS batch_id "
    f"FROM (SELECT id, cell_id, drug_id, label AS target, x00, {_rank_sql('3, 2')} AS position FROM ({PAIR_SQL.format(x=CELLS_FIRST)}))) "
    f"SELECT 'all' AS part, * FROM b UNION ALL SELECT 'one', * FROM b WHERE batch_id IN {STORED_BATCHES}",
)
def batch_store(spark, sf_dir):
    """Encoded batches stored in files of many batches; all of them, and three read alone."""
    path = new_folder(spark, "batches")
    frame = supply_frame(spark, sf_dir)
    frame.batches(BATCH, shuffle=True, seed=3).write(path, epoch=2, rows_per_file=20_000)
    parts = [("all", read_batches(spark, path))] + [("one", read_batch(spark, path, k)) for k in STORED_BATCHES]
    result = None
    for name, rows in parts:
        rows = rows.withColumn("x", F.concat(*frame.feature_columns)).select(
            F.lit(name).alias("part"), "id", "cell_id", "drug_id", tidy("target").alias("target"),
            tidy(F.get("x", 0).cast("double")).alias("x00"), "position", "batch_id",
        )
        result = rows if result is None else result.unionByName(rows)
    return result


# Predictions: the mean of the user's values.
PRED_SQL = (
    "SELECT user_id AS cell_id, event_type AS drug_id, value AS y_true, avg(value) OVER (PARTITION BY user_id) AS y_pred "
    "FROM events"
)
R2_SQL = "round(1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 6)"
PEARSON_SQL = (
    "round(CASE WHEN stddev_pop(y_true) * stddev_pop(y_pred) > 0 THEN covar_pop(y_true, y_pred) / "
    "(stddev_pop(y_true) * stddev_pop(y_pred)) END, 6)"
)
RMSE_SQL = "round(sqrt(avg(pow(y_true - y_pred, 2))), 6)"


def mean_predictions(spark, sf_dir):
    obs = event_obs(spark, sf_dir)
    means = obs.groupBy("cell_id").agg(F.avg("label").alias("y_pred"))
    return obs.join(means, "cell_id").select("id", "cell_id", "drug_id", F.col("label").alias("y_true"), "y_pred")


def _metric(name):
    def run(spark, sf_dir):
        return score(mean_predictions(spark, sf_dir), [name]).withColumn(name, F.round(name, 6))

    return run


for _name, _sql in (("r2", R2_SQL), ("pearson", PEARSON_SQL), ("rmse", RMSE_SQL)):
    query(f"metric_{_name}", f"SELECT {_sql} AS {_name} FROM ({PRED_SQL})")(_metric(_name))


@query(
    "metric_by_drug",
    f"SELECT drug_id, {R2_SQL} AS r2, {PEARSON_SQL} AS pearson, {RMSE_SQL} AS rmse FROM ({PRED_SQL}) GROUP BY drug_id",
)
def metric_by_drug(spark, sf_dir):
    scores = score(mean_predictions(spark, sf_dir), by=["drug_id"])
    return scores.select("drug_id", *[F.round(m, 6).alias(m) for m in ("r2", "pearson", "rmse")])


@query(
    "prediction_table",
    "SELECT p.cell_id, p.drug_id, p.y_true, round(p.y_pred, 6) AS y_pred, role AS split, 'user mean' AS model, 1 AS run "
    f"FROM ({PRED_SQL}) p JOIN ({ROLE_SQL}) ON p.cell_id = vec_id",
)
def predictions(spark, sf_dir):
    """Every prediction with its user's role, by one join."""
    predicted = mean_predictions(spark, sf_dir).withColumn("y_pred", tidy("y_pred"))
    roles = user_roles(spark, sf_dir).select(F.col("vec_id").alias("id"), "role")
    return prediction_rows(apply_split(predicted, roles, "cell_id"), "role", model="user mean", run=1)
