"""Queries that write given tables to files in a fresh shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairframe.featureset import ENTITY, VALUE, FeatureSet
from pairframe.frame import PairFrame
from pairframe.plans.adapters import (
    DIM,
    EVENT_OBS_SQL,
    SUPPLY_OBS_SQL,
    event_obs,
    part_features,
    spread,
    spread_sql,
    supplier_features,
    supply_metrics,
    supply_obs,
    table,
    tidy,
    user_vectors,
)
from pairframe.plans.catalog import query
from pairframe.session import new_folder
from pairframe.sources.bundles import METRIC_BUNDLE_FILES, PANEL_BUNDLE_FILES, MetricBundle, PanelBundle
from pairframe.sources.store import load_features, save_features
from pairframe.sources.tables import (
    read_feature_matrix,
    read_lookup,
    read_metadata,
    read_observations,
    write_feature_matrix,
)
from pairframe.sources.text import read_delimited, read_gene_sets, read_list


def _write_csv(df, path: str) -> None:
    df.write.options(header=True, escape='"').csv(path)


@query(
    "bundle_roundtrip",
    f"SELECT o.id, o.cell_id, o.drug_id, o.label, e.label AS stratum, {spread_sql('embedding', DIM)}, "
    f"length(drug_id) AS letters, CAST(2.5 AS DOUBLE) AS bias FROM ({EVENT_OBS_SQL}) o JOIN embeddings e ON cell_id = vec_id",
)
def bundle_roundtrip(spark, sf_dir):
    """Save a frame with all kinds of feature sets and metadata; encode what is loaded."""
    obs = event_obs(spark, sf_dir)
    letters = obs.select("drug_id", F.length("drug_id").alias("letters")).distinct()
    frame = PairFrame(
        obs,
        cell_features={"vector": user_vectors(spark, sf_dir), "bias": FeatureSet.constant(2.5)},
        drug_features={"letters": FeatureSet.lookup(letters, "drug_id", "letters")},
        cell_meta=table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ENTITY), F.col("label").alias("stratum")),
        name="events",
    )
    path = new_folder(spark, "frame")
    frame.save(path)
    loaded = PairFrame.load(spark, path)
    meta = loaded.cell_meta.withColumnRenamed(ENTITY, "cell_id")
    return (
        loaded.encode()
        .join(meta, "cell_id")
        .select(
            "id",
            "cell_id",
            "drug_id",
            "label",
            "stratum",
            *spread("cell_vector", DIM),
            F.col("drug_letters").cast("bigint").alias("letters"),
            F.col("cell_bias").alias("bias"),
        )
    )


@query("feature_roundtrip", f"SELECT vec_id AS entity_id, {spread_sql('embedding', DIM)} FROM embeddings")
def feature_roundtrip(spark, sf_dir):
    path = new_folder(spark, "features")
    save_features(spark, user_vectors(spark, sf_dir), path)
    loaded = load_features(spark, path)
    return loaded.table.select(ENTITY, *spread(VALUE, len(loaded.feature_names)))


@query(
    "csv_roundtrip",
    f"SELECT o.id, o.cell_id, CAST(CAST(o.label AS FLOAT) AS DOUBLE) AS label, s_name, p_name, "
    "CAST(s_nationkey AS DOUBLE) AS f00, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS f01 "
    f"FROM ({SUPPLY_OBS_SQL}) o JOIN supplier ON cell_id = s_suppkey JOIN part ON drug_id = p_partkey",
)
def csv_roundtrip(spark, sf_dir):
    """Observation, matrix, metadata and lookup CSV files."""
    base = new_folder(spark, "csv")
    _write_csv(supply_obs(spark, sf_dir), f"{base}/labels")
    write_feature_matrix(supplier_features(spark, sf_dir), f"{base}/matrix", "supplier")
    _write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{base}/meta")
    _write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), f"{base}/lookup")
    types = {"cell_id": "bigint", "drug_id": "bigint", "label": "double"}
    obs = read_observations(spark, f"{base}/labels", types)
    matrix = read_feature_matrix(spark, f"{base}/matrix", dtype="float", key_type="bigint")
    names = read_lookup(spark, f"{base}/lookup", "p_name", key_type="bigint")
    meta = read_metadata(spark, f"{base}/meta", key_type="bigint").withColumnRenamed(ENTITY, "cell_id")
    encoded = PairFrame(obs, {"m": matrix}, {"name": names}).encode()
    return encoded.join(meta, "cell_id").select(
        "id",
        "cell_id",
        F.col("label").cast("double").alias("label"),
        "s_name",
        F.col("drug_name").alias("p_name"),
        *spread("cell_m", 2),
    )


@query(
    "metric_bundle",
    "SELECT id, CAST(cell_id AS VARCHAR) AS cell_id, round(quantity, 6) AS label, p_name AS smiles, p_brand, "
    "CAST(s_nationkey AS DOUBLE) AS f00, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS f01 "
    f"FROM ({SUPPLY_OBS_SQL}) JOIN supplier ON cell_id = s_suppkey JOIN part ON drug_id = p_partkey",
)
def metric_bundle(spark, sf_dir):
    """A folder with two metrics per observation, read with one of them as label."""
    base = new_folder(spark, "metric-bundle")
    files = {k: f"{base}/{v}" for k, v in METRIC_BUNDLE_FILES.items()}
    part = table(spark, sf_dir, "part")
    metrics = supply_metrics(spark, sf_dir).select(
        "id", "cell_id", "drug_id", F.col("price").alias("auc"), F.col("quantity").alias("ln_ic50")
    )
    _write_csv(metrics, files["labels"])
    write_feature_matrix(supplier_features(spark, sf_dir), files["cell_expression"], "cell_id")
    _write_csv(part.select("p_partkey", F.col("p_name").alias("smiles")), files["drug_structure"])
    _write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), files["cell_meta"])
    _write_csv(part.select("p_partkey", "p_brand"), files["drug_meta"])
    frame = MetricBundle(base, "ln_ic50").load(spark)
    brands = frame.drug_meta.withColumnRenamed(ENTITY, "drug_id")
    return (
        frame.encode()
        .join(brands, "drug_id")
        .select(
            "id",
            "cell_id",
            tidy("label").alias("label"),
            F.col("drug_mol").alias("smiles"),
            "p_brand",
            *spread("cell_exp", 2),
        )
    )


@query(
    "panel_bundle",
    "SELECT id, CAST(drug_id AS VARCHAR) AS drug_id, round(label, 6) AS label, CAST(s_nationkey AS DOUBLE) AS x00, "
    "s_acctbal AS x01, CAST(p_size AS DOUBLE) AS x02, p_retailprice AS x03, s_name "
    f"FROM ({SUPPLY_OBS_SQL}) JOIN supplier ON cell_id = s_suppkey JOIN part ON drug_id = p_partkey",
)
def panel_bundle(spark, sf_dir):
    base = new_folder(spark, "panel-bundle")
    files = {k: f"{base}/{v}" for k, v in PANEL_BUNDLE_FILES.items()}
    _write_csv(supply_obs(spark, sf_dir), files["labels"])
    write_feature_matrix(supplier_features(spark, sf_dir), files["cell_expression"])
    write_feature_matrix(part_features(spark, sf_dir), files["drug_fingerprint"])
    _write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), files["cell_meta"])
    _write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), files["drug_meta"])
    frame = PanelBundle(base).load(spark)
    names = frame.cell_meta.withColumnRenamed(ENTITY, "cell_id")
    encoded = frame.encode().withColumn("x", F.concat(*frame.feature_columns))
    return encoded.join(names, "cell_id").select(
        "id", "drug_id", tidy("label").alias("label"), *spread("x", 4, "x"), "s_name"
    )


WORDS_SQL = "regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')"


@query(
    "gmt_sets",
    f"SELECT concat('doc ', doc_id) AS set_name, len(words) AS n_genes, array_to_string(words, ' ') AS genes FROM "
    f"(SELECT doc_id, string_split({WORDS_SQL}, ' ') AS words FROM documents)",
)
def gmt_sets(spark, sf_dir):
    """The words of every document as a gene-set file; words with quotes, and every tenth
    other, are quoted fields."""
    words = F.split(F.regexp_replace("text", "[ \t\r\n]+", "\t"), "\t")

    def field(word, i):
        quoted = F.concat(F.lit('"'), F.replace(word, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.contains(word, F.lit('"')) | (i % 10 == 0), quoted).otherwise(word)

    line = F.concat_ws("\t", F.concat(F.lit("doc "), "doc_id"), "lang", F.array_join(F.transform(words, field), "\t"))
    path = new_folder(spark, "gmt")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return read_gene_sets(spark, path).select(
        "set_name", F.size("genes").cast("bigint").alias("n_genes"), F.array_join("genes", " ").alias("genes")
    )


@query("text_list", "SELECT concat(p_name, ' #', p_partkey) AS item FROM part")
def text_list(spark, sf_dir):
    path = new_folder(spark, "list")
    items = F.concat("p_name", F.lit(" #"), "p_partkey")
    table(spark, sf_dir, "part").select(items.alias("value")).write.text(path)
    return read_list(spark, path, "item")


@query(
    "delimited_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS f0, CAST(o_custkey AS VARCHAR) AS f1, o_orderpriority AS f2 FROM orders",
)
def delimited_rows(spark, sf_dir):
    """Orders as tab-separated text: skip the header line of each file, keep three columns."""
    path = new_folder(spark, "delimited")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    orders.write.option("header", True).option("sep", "\t").csv(path)
    rows = read_delimited(spark, path, skip_rows=1, n_cols=3)
    return rows.select(*[F.get("fields", i).alias(f"f{i}") for i in range(3)])
