"""Save and load frames, feature sets and whole datasets as Parquet folders."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pairframe.featureset import CONSTANT, FeatureSet
from pairframe.frame import PairFrame

MANIFEST = "manifest"


def save_table(df: DataFrame, path: str) -> None:
    """Column order and types are kept; an index is an ordinary column."""
    df.write.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _write_manifest(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")


def _read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])


def _save_set(features: FeatureSet, path: str) -> dict[str, Any]:
    entry = {
        "kind": features.kind,
        "name": features.name,
        "feature_names": features.feature_names and list(features.feature_names),
    }
    if features.kind == CONSTANT:
        entry["value"] = features.value
    else:
        save_table(features.table, path)
    return entry


def _load_set(spark: SparkSession, path: str, entry: dict[str, Any]) -> FeatureSet:
    names = entry["feature_names"]
    return FeatureSet(
        kind=entry["kind"],
        table=None if entry["kind"] == CONSTANT else load_table(spark, path),
        value=entry.get("value"),
        feature_names=None if names is None else tuple(names),
        name=entry["name"],
    )


def save_features(spark: SparkSession, features: FeatureSet, path: str) -> None:
    """A feature set with its kind, name and feature names."""
    _write_manifest(spark, path, _save_set(features, f"{path}/table"))


def load_features(spark: SparkSession, path: str) -> FeatureSet:
    return _load_set(spark, f"{path}/table", _read_manifest(spark, path))


def save_frame(frame: PairFrame, path: str) -> None:
    """Observations, every feature set, metadata and options; the manifest is written last."""
    spark = frame.obs.sparkSession
    manifest: dict[str, Any] = {
        "name": frame.name,
        "desc": frame.desc,
        "encode_drugs_first": frame.encode_drugs_first,
        "meta": [],
    }
    save_table(frame.obs, f"{path}/obs")
    for side, sets in (("cell_features", frame.cell_features), ("drug_features", frame.drug_features)):
        manifest[side] = None
        if sets is not None:
            manifest[side] = [[k, _save_set(f, f"{path}/{side}/{i}")] for i, (k, f) in enumerate(sets.items())]
    for side, meta in (("cell_meta", frame.cell_meta), ("drug_meta", frame.drug_meta)):
        if meta is not None:
            save_table(meta, f"{path}/{side}")
            manifest["meta"].append(side)
    _write_manifest(spark, path, manifest)


def load_frame(spark: SparkSession, path: str) -> PairFrame:
    """Inverse of `save_frame`; feature sets come back in their saved order."""
    manifest = _read_manifest(spark, path)

    def sets(side: str):
        if manifest[side] is None:
            return None
        return {k: _load_set(spark, f"{path}/{side}/{i}", e) for i, (k, e) in enumerate(manifest[side])}

    def meta(side: str):
        return load_table(spark, f"{path}/{side}") if side in manifest["meta"] else None

    return PairFrame(
        load_table(spark, f"{path}/obs"),
        cell_features=sets("cell_features"),
        drug_features=sets("drug_features"),
        cell_meta=meta("cell_meta"),
        drug_meta=meta("drug_meta"),
        encode_drugs_first=manifest["encode_drugs_first"],
        name=manifest["name"],
        desc=manifest["desc"],
    )
