"""Queries over feature sets: select, filter, describe, standardise, fingerprint, look up."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.featureset import ENTITY, VALUE, FeatureSet
from pairframe.frame import PairFrame
from pairframe.operators.encoding import encode, encode_index
from pairframe.operators.features import (
    describe_features,
    feature_variances,
    scale_features,
    select_features,
    select_listed,
    variance_filter,
)
from pairframe.operators.fingerprints import fingerprint_set, fingerprint_table
from pairframe.plans.adapters import (
    DIM,
    EVENT_OBS_SQL,
    ROLE_SQL,
    SUPPLY_OBS_SQL,
    document_texts,
    event_obs,
    part_features,
    role_members,
    scale_sql,
    spread,
    spread_sql,
    supplier_features,
    supply_obs,
    table,
    tidy,
    user_roles,
    user_vectors,
)
from pairframe.plans.catalog import query
from pairframe.sources.lists import feature_lists

WANTED = ["f40", "f2", "not a feature", "f63"]
LISTS = {"cgc": ["f7", "gone", "f3", "f50"], "mcg": ["f1"]}
VARIANCE_THRESHOLD = 0.016
DOC_BITS = 2_048

# (vec_id, pos, x) with 0-based positions
LONG_SQL = (
    "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
)


def _long(features: FeatureSet):
    return features.table.select(ENTITY, F.posexplode(VALUE).alias("pos", "x")).withColumn(
        "x", tidy(F.col("x").cast("double"))
    )


@query(
    "feature_select",
    "SELECT vec_id AS entity_id, CAST(embedding[41] AS DOUBLE) AS f00, CAST(embedding[3] AS DOUBLE) AS f01, "
    "CAST(embedding[64] AS DOUBLE) AS f02 FROM embeddings",
)
def feature_select(spark, sf_dir):
    chosen = select_features(user_vectors(spark, sf_dir), WANTED)
    return chosen.table.select(ENTITY, *spread(VALUE, len(chosen.feature_names)))


@query(
    "feature_list_select",
    "SELECT vec_id AS entity_id, CAST(embedding[8] AS DOUBLE) AS f00, CAST(embedding[4] AS DOUBLE) AS f01, "
    "CAST(embedding[51] AS DOUBLE) AS f02 FROM embeddings",
)
def feature_list_select(spark, sf_dir):
    chosen = select_listed(user_vectors(spark, sf_dir), feature_lists(spark, LISTS), "cgc")
    return chosen.table.select(ENTITY, *spread(VALUE, len(chosen.feature_names)))


@query(
    "feature_variance",
    f"SELECT pos, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 9) AS variance FROM ({LONG_SQL}) GROUP BY pos",
)
def feature_variance(spark, sf_dir):
    stats = feature_variances(user_vectors(spark, sf_dir))
    return stats.select(
        F.col("pos").cast("bigint"), "n", tidy("mean").alias("mean"), tidy("var_samp", 9).alias("variance")
    )


@query(
    "variance_filter",
    f"WITH long AS ({LONG_SQL}), kept AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM long "
    f"GROUP BY pos HAVING var_samp(x) > {VARIANCE_THRESHOLD}) "
    "SELECT vec_id AS entity_id, new_pos AS pos, round(x, 6) + 0.0 AS x FROM long JOIN kept USING (pos)",
)
def filter_by_variance(spark, sf_dir):
    kept = variance_filter(user_vectors(spark, sf_dir), VARIANCE_THRESHOLD)
    return _long(kept).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "feature_describe",
    "SELECT 'embedding' AS name, 'matrix' AS kind, count(*) AS n, min(len(embedding)) AS min_len, "
    "max(len(embedding)) AS max_len FROM embeddings UNION ALL SELECT 'part', 'matrix', count(*), 2, 2 FROM part "
    "UNION ALL SELECT 'text', 'lookup', count(*), NULL, NULL FROM documents",
)
def feature_describe(spark, sf_dir):
    sets = [user_vectors(spark, sf_dir), part_features(spark, sf_dir), document_texts(spark, sf_dir)]
    parts = [describe_features(s).select(F.lit(s.name).alias("name"), "*") for s in sets]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "scale_features",
    f"WITH long AS ({LONG_SQL}), roles AS ({ROLE_SQL}), fit AS (SELECT pos, avg(x) AS mean, var_pop(x) AS var, "
    "CAST(count(x) AS DOUBLE) AS n FROM long JOIN roles USING (vec_id) WHERE role = 'train' GROUP BY pos) "
    f"SELECT vec_id AS entity_id, CAST(pos AS BIGINT) AS pos, round(CAST(CAST((x - mean) / ({scale_sql()}) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x "
    "FROM long JOIN fit USING (pos)",
)
def scale_vectors(spark, sf_dir):
    train = role_members(user_roles(spark, sf_dir), "train")
    scaled = scale_features(user_vectors(spark, sf_dir), train)
    return scaled.table.select(ENTITY, F.posexplode(VALUE).alias("pos", "x")).select(
        ENTITY, F.col("pos").cast("bigint"), tidy(F.col("x").cast("double"), 4).alias("x")
    )


BITS_SQL = (
    "WITH src AS ({src}), chars AS (SELECT id, string_split(text, '') AS c FROM src), "
    "places AS (SELECT id, unnest(list_zip(c, c[2:], c[3:])) AS p FROM chars), "
    "grams AS (SELECT DISTINCT id, unnest([p[1], p[1] || p[2], p[1] || p[2] || p[3]]) AS g FROM places), "
    "bits AS (SELECT DISTINCT id, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % {n_bits} AS bit FROM grams "
    "WHERE g IS NOT NULL) SELECT id AS entity_id, {n_bits} AS width, count(*) AS n_set, "
    "string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM bits GROUP BY id"
)


def _bit_rows(features: FeatureSet):
    """Vector width, number of ones, and their positions."""
    ones = F.array_compact(F.transform(VALUE, lambda v, i: F.when(v == 1, i)))
    positions = features.table.select(ENTITY, F.size(VALUE).alias("width"), ones.alias("ones"))
    return positions.select(
        ENTITY, "width", F.size("ones").cast("bigint").alias("n_set"), F.array_join("ones", ",").alias("bits")
    )


@query("fingerprint_bits", BITS_SQL.format(src="SELECT doc_id AS id, text FROM documents", n_bits=DOC_BITS))
def fingerprint_bits(spark, sf_dir):
    return _bit_rows(fingerprint_set(document_texts(spark, sf_dir), DOC_BITS))


@query("fingerprint_features", BITS_SQL.format(src="SELECT DISTINCT p_name AS id, p_name AS text FROM part", n_bits=512))
def fingerprint_features(spark, sf_dir):
    return _bit_rows(fingerprint_table(table(spark, sf_dir, "part"), "p_name"))


@query(
    "encode_matrix",
    f"SELECT o.id, o.cell_id, o.label, {spread_sql('embedding', DIM)} FROM ({EVENT_OBS_SQL}) o "
    "JOIN embeddings ON cell_id = vec_id",
)
def encode_matrix(spark, sf_dir):
    encoded = encode(event_obs(spark, sf_dir), user_vectors(spark, sf_dir), "cell_id", "x")
    return encoded.select("id", "cell_id", "label", *spread("x", DIM))


@query(
    "encode_lookup",
    f"SELECT id, drug_id, p_name AS name FROM ({SUPPLY_OBS_SQL}) JOIN part ON drug_id = p_partkey",
)
def encode_lookup(spark, sf_dir):
    names = FeatureSet.lookup(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return encode(supply_obs(spark, sf_dir), names, "drug_id", "name").select("id", "drug_id", "name")


@query("encode_constant", f"SELECT id, cell_id, CAST(1.5 AS DOUBLE) AS f00, CAST(-2.0 AS DOUBLE) AS f01 FROM ({EVENT_OBS_SQL})")
def encode_constant(spark, sf_dir):
    encoded = encode(event_obs(spark, sf_dir), FeatureSet.constant([1.5, -2.0]), "cell_id", "x")
    return encoded.select("id", "cell_id", *spread("x", 2))


@query(
    "encode_embedding",
    f"SELECT event_id, value, {spread_sql('embedding', DIM)} FROM events JOIN embeddings ON CAST(trunc(value) AS INT) = vec_id",
)
def encode_embedding(spark, sf_dir):
    """Vector of the row whose number is the truncated value; values past the table are dropped."""
    encoded = encode_index(table(spark, sf_dir, "events"), user_vectors(spark, sf_dir), "value", "x", strict=False)
    return encoded.filter(F.col("x").isNotNull()).select("event_id", "value", *spread("x", DIM))


PAIR_SQL = (
    "SELECT id, cell_id, drug_id, round(label, 6) AS label, {x} "
    f"FROM ({SUPPLY_OBS_SQL}) JOIN supplier ON cell_id = s_suppkey JOIN part ON drug_id = p_partkey"
)
CELLS_FIRST = "CAST(s_nationkey AS DOUBLE) AS x00, s_acctbal AS x01, CAST(p_size AS DOUBLE) AS x02, p_retailprice AS x03"
DRUGS_FIRST = "CAST(p_size AS DOUBLE) AS x00, p_retailprice AS x01, CAST(s_nationkey AS DOUBLE) AS x02, s_acctbal AS x03"


def supply_frame(spark, sf_dir, **options) -> PairFrame:
    return PairFrame(
        supply_obs(spark, sf_dir),
        cell_features={"supplier": supplier_features(spark, sf_dir)},
        drug_features={"part": part_features(spark, sf_dir)},
        **options,
    )


def _pairs(frame: PairFrame):
    encoded = frame.encode()
    return encoded.withColumn("x", F.concat(*frame.feature_columns)).select(
        "id", "cell_id", "drug_id", tidy("label").alias("label"), *spread("x", 4, "x")
    )


@query("encode_pair", PAIR_SQL.format(x=CELLS_FIRST))
def encode_pair(spark, sf_dir):
    return _pairs(supply_frame(spark, sf_dir))


@query("encode_pair_drugs_first", PAIR_SQL.format(x=DRUGS_FIRST))
def encode_pair_drugs_first(spark, sf_dir):
    return _pairs(supply_frame(spark, sf_dir, encode_drugs_first=True))
