"""The whole workflow: hold out cells, select and scale features, scale labels, fit, score."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from pairframe.featureset import FeatureSet
from pairframe.frame import PairFrame, normalize_responses
from pairframe.operators.metrics import prediction_table, score
from pairframe.plans.adapters import (
    EVENT_OBS_SQL,
    ROLE_SQL,
    event_obs,
    role_members,
    scale_sql,
    tidy,
    user_roles,
    user_vectors,
)
from pairframe.plans.catalog import query
from pairframe.session import cut_lineage
from pairframe.transforms import ScaleCellFeatures, SelectCellFeatures

ROLES = ("train", "val", "test")
CELL_FEATURES = ("f2", "f40", "f63")


def model_rows(frame: PairFrame) -> DataFrame:
    """Encoded observations with one `features` vector for an estimator."""
    arrays = [F.transform(c, lambda x: x.cast("double")) for c in frame.feature_columns]
    return frame.encode().withColumn("features", array_to_vector(F.concat(*arrays)))


def fit_and_predict(splits: dict[str, PairFrame], estimator=None, **constants) -> DataFrame:
    """Fit on the `train` split and return the prediction table of every split."""
    estimator = estimator or LinearRegression(solver="auto", predictionCol="y_pred")
    model = estimator.fit(model_rows(splits["train"]))
    predicted = {
        name: model.transform(model_rows(frame)).withColumnRenamed("label", "y_true")
        for name, frame in splits.items()
    }
    return prediction_table(predicted, **constants)


def event_predictions(spark, sf_dir) -> DataFrame:
    roles = cut_lineage(user_roles(spark, sf_dir))  # read by every split below
    obs = event_obs(spark, sf_dir)
    trained = obs.join(role_members(roles, "train").withColumnRenamed("vec_id", "cell_id"), "cell_id", "left_semi")
    levels = trained.groupBy("drug_id").agg(F.avg("label").alias("level"))
    frame = PairFrame(
        obs,
        cell_features={"vector": user_vectors(spark, sf_dir)},
        drug_features={"level": FeatureSet.from_columns(levels, "drug_id", ["level"])},
    ).apply(
        [SelectCellFeatures(CELL_FEATURES, "vector"), ScaleCellFeatures("vector", role_members(roles, "train"))]
    )
    vectors = frame.cell_features["vector"]
    frame = frame.replace(cell_features={"vector": vectors.with_table(cut_lineage(vectors.table))})
    frames = [frame.select_cells(role_members(roles, role), name=role) for role in ROLES]
    return fit_and_predict(dict(zip(ROLES, normalize_responses(*frames, norm_method="global"))), model="ols")


def _predictions_sql() -> str:
    """Least squares by making the features orthogonal one after another."""
    features = {"x0": "embedding[3]", "x1": "embedding[41]", "x2": "embedding[64]"}
    fits = ", ".join(
        f"avg({e}::DOUBLE) AS m_{x}, var_pop({e}::DOUBLE) AS v_{x}" for x, e in features.items()
    )
    scaled = ", ".join(
        f"CAST(CAST(({e}::DOUBLE - m_{x}) / ({scale_sql(f'm_{x}', f'v_{x}', 'n')}) AS FLOAT) AS DOUBLE) AS {x}"
        for x, e in features.items()
    )
    steps = [
        f"roles AS ({ROLE_SQL})",
        f"obs AS ({EVENT_OBS_SQL})",
        f"fit AS (SELECT {fits}, CAST(count(*) AS DOUBLE) AS n FROM embeddings JOIN roles USING (vec_id) WHERE role = 'train')",
        f"cells AS (SELECT vec_id, {scaled} FROM embeddings, fit)",
        "levels AS (SELECT drug_id, avg(label) AS x3 FROM obs JOIN roles ON cell_id = vec_id WHERE role = 'train' GROUP BY 1)",
        "labels_fit AS (SELECT avg(label) AS mean, var_pop(label) AS var, CAST(count(*) AS DOUBLE) AS n FROM obs "
        "JOIN roles ON cell_id = vec_id WHERE role = 'train')",
        f"s0 AS (SELECT cell_id, drug_id, role, (label - mean) / ({scale_sql()}) AS y, x0, x1, x2, x3 FROM obs "
        "JOIN roles ON cell_id = roles.vec_id JOIN cells ON cell_id = cells.vec_id JOIN levels USING (drug_id), labels_fit)",
    ]
    terms = []
    for k in range(4):
        removed = "".join(f" - (b{j}) * z{j}" for j in range(k))
        slopes = ", ".join(f"sum(x{k} * z{j}) / sum(z{j} * z{j}) AS b{j}" for j in range(k))
        stats = f"SELECT avg(x{k}) AS mean_x{', ' + slopes if slopes else ''} FROM s{k} WHERE role = 'train'"
        bs = "".join(f", b{j}" for j in range(k))
        steps.append(
            f"s{k + 1} AS (SELECT s{k}.*, x{k} - mean_x{removed} AS z{k} FROM s{k}, ({stats}) AS t(mean_x{bs}))"
        )
        terms.append(f"c{k} * z{k}")
    coefs = ", ".join(f"sum(y * z{k}) / sum(z{k} * z{k}) AS c{k}" for k in range(4))
    steps.append(f"coef AS (SELECT avg(y) AS c, {coefs} FROM s4 WHERE role = 'train')")
    steps.append(
        f"pred AS (SELECT cell_id, drug_id, y AS y_true, c + {' + '.join(terms)} AS y_pred, role AS split, 'ols' AS model "
        "FROM s4, coef)"
    )
    return "WITH " + ", ".join(steps)


@query(
    "response_regression",
    f"{_predictions_sql()} SELECT cell_id, drug_id, round(y_true, 5) + 0.0 AS y_true, round(y_pred, 5) + 0.0 AS y_pred, "
    "split, model FROM pred",
)
def response_regression(spark, sf_dir):
    rows = event_predictions(spark, sf_dir)
    return rows.withColumn("y_true", tidy("y_true", 5)).withColumn("y_pred", tidy("y_pred", 5))


@query(
    "regression_scores",
    f"{_predictions_sql()} SELECT split, round(1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 5) AS r2, "
    "round(covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)), 5) AS pearson, "
    "round(sqrt(avg(pow(y_true - y_pred, 2))), 5) AS rmse FROM pred GROUP BY split",
)
def regression_scores(spark, sf_dir):
    scores = score(event_predictions(spark, sf_dir), by=["split"])
    return scores.select("split", *[tidy(m, 5).alias(m) for m in ("r2", "pearson", "rmse")])
