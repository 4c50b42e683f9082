"""Queries over an observation stream."""

from __future__ import annotations

from pairframe.operators.encoding import encode
from pairframe.operators.scaling import apply_scaler, fit_scaler
from pairframe.plans.adapters import DIM, EVENT_OBS_SQL, event_obs, scale_sql, spread, spread_sql, table, tidy, user_vectors
from pairframe.plans.catalog import query
from pairframe.session import new_folder
from pairframe.streaming.responses import drain, read_observation_stream


@query(
    "stream_scale_encode",
    f"WITH obs AS ({EVENT_OBS_SQL}), fit AS (SELECT drug_id, avg(label) AS mean, var_pop(label) AS var, "
    "CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY drug_id) "
    f"SELECT obs.id, obs.cell_id, obs.drug_id, round((obs.label - mean) / ({scale_sql()}), 6) + 0.0 AS label, "
    f"{spread_sql('embedding', DIM)} FROM obs JOIN fit USING (drug_id) JOIN embeddings ON cell_id = vec_id",
)
def stream_scale_encode(spark, sf_dir):
    """Stream the events, scale them with fitted statistics and attach the user's vector."""
    columns = {"id_col": "event_id", "label_col": "value", "cell_id_col": "user_id", "drug_id_col": "event_type"}
    stats = fit_scaler(event_obs(spark, sf_dir), "drug_id")
    schema = table(spark, sf_dir, "events").schema
    stream = read_observation_stream(spark, sf_dir, schema, "events.parquet", **columns)
    scaled = apply_scaler(stream, stats, "drug_id")
    encoded = encode(scaled, user_vectors(spark, sf_dir), "cell_id", "x")
    rows = drain(encoded, new_folder(spark, "stream"), new_folder(spark, "stream-state"))
    return rows.select("id", "cell_id", "drug_id", tidy("label").alias("label"), *spread("x", DIM))
