"""Response bundles: a folder of CSV files that together form a dataset."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from typing import Literal

from pyspark.sql import SparkSession

from pairframe.featureset import FeatureSet
from pairframe.frame import PairFrame
from pairframe.operators.observations import pick_metric
from pairframe.sources.tables import (
    read_feature_matrix,
    read_lookup,
    read_metadata,
    read_observations,
    read_table,
)

# File names of the two bundle layouts.
METRIC_BUNDLE_FILES = {
    "labels": "labels.csv",
    "cell_expression": "cell_feature.gene_expression.log2tpm.csv",
    "drug_structure": "drug_feature.smiles.csv",
    "cell_meta": "cell_metadata.csv",
    "drug_meta": "drug_metadata.csv",
}
PANEL_BUNDLE_FILES = {
    "labels": "labels.csv",
    "cell_expression": "cell_feature_ge.csv",
    "drug_fingerprint": "drug_feature_fp.csv",
    "cell_meta": "cell_metadata.csv",
    "drug_meta": "drug_metadata.csv",
}


class ResponseSource(ABC):
    """Base class of user-defined sources: `read` returns a frame from any Spark input."""

    name: str | None = None
    desc: str | None = None

    def __init__(self, path: str, id_type: str = "string") -> None:
        self.path = path.rstrip("/")
        self.id_type = id_type

    def joinpath(self, part: str) -> str:
        return f"{self.path}/{part}"

    def obs_types(self) -> dict[str, str]:
        return {"id": "string", "cell_id": self.id_type, "drug_id": self.id_type}

    @abstractmethod
    def read(self, spark: SparkSession) -> PairFrame: ...

    def load(
        self,
        spark: SparkSession,
        transforms: Callable | Sequence[Callable] | None = None,
        encode_drugs_first: bool = False,
    ) -> PairFrame:
        """`read`, named after the source, with transforms applied in order."""
        frame = self.read(spark).replace(
            name=self.name, desc=self.desc, encode_drugs_first=encode_drugs_first
        )
        return frame if transforms is None else frame.apply(transforms)


class MetricBundle(ResponseSource):
    """Labels with a choice of metric, an expression matrix and structure strings."""

    name = "metric-bundle"
    desc = "responses by chosen metric, expression matrix, structure strings"

    def __init__(self, path: str, metric: Literal["auc", "ln_ic50"], id_type: str = "string") -> None:
        super().__init__(path, id_type)
        self.metric = metric

    def read(self, spark: SparkSession) -> PairFrame:
        files = {k: self.joinpath(v) for k, v in METRIC_BUNDLE_FILES.items()}
        types = {**self.obs_types(), self.metric: "double"}
        expression = read_feature_matrix(
            spark, files["cell_expression"], dtype="float", key_type=self.id_type, name="gexp", na_values=()
        )
        structure = read_lookup(spark, files["drug_structure"], "smiles", key_type=self.id_type, name="smiles")
        return PairFrame(
            pick_metric(read_table(spark, files["labels"], types), self.metric),
            cell_features={"exp": expression},
            drug_features={"mol": structure},
            cell_meta=read_metadata(spark, files["cell_meta"], key_type=self.id_type),
            drug_meta=read_metadata(spark, files["drug_meta"], key_type=self.id_type),
        )


class PanelBundle(ResponseSource):
    """Ready labels, an expression matrix and fingerprint columns."""

    name = "panel-bundle"
    desc = "responses, expression matrix, fingerprint matrix"

    def read(self, spark: SparkSession) -> PairFrame:
        files = {k: self.joinpath(v) for k, v in PANEL_BUNDLE_FILES.items()}
        types = {**self.obs_types(), "label": "double"}

        def matrix(key: str, name: str) -> FeatureSet:
            return read_feature_matrix(spark, files[key], key_type=self.id_type, name=name)

        return PairFrame(
            read_observations(spark, files["labels"], types, label_type="double"),
            cell_features={"exp": matrix("cell_expression", "ge_encoder")},
            drug_features={"mol": matrix("drug_fingerprint", "fp_encoder")},
            cell_meta=read_metadata(spark, files["cell_meta"], key_type=self.id_type),
            drug_meta=read_metadata(spark, files["drug_meta"], key_type=self.id_type),
        )
