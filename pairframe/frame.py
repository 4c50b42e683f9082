"""PairFrame: observations of (cell, drug) pairs with their features and metadata."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pairframe.featureset import FeatureSet
from pairframe.operators import observations, sampling, scaling
from pairframe.operators.batching import Batches, batch_rows
from pairframe.operators.checks import check_feature_sets
from pairframe.operators.encoding import encode_pairs, feature_columns
from pairframe.operators.selection import keep_members

Members = DataFrame | Iterable[Any]
Transform = Callable[["PairFrame"], "PairFrame"]


@dataclass(frozen=True)
class PairFrame:
    """Lazy and immutable: every method returns a new frame or a DataFrame."""

    obs: DataFrame
    cell_features: Mapping[str, FeatureSet] | None = None
    drug_features: Mapping[str, FeatureSet] | None = None
    cell_meta: DataFrame | None = None
    drug_meta: DataFrame | None = None
    encode_drugs_first: bool = False
    name: str | None = None
    desc: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "obs", observations.validate_obs(self.obs))

    # -- construction -----------------------------------------------------

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, types: Mapping[str, str] | None = None, **options) -> PairFrame:
        from pairframe.sources.tables import read_observations

        return cls(read_observations(spark, path, types), **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairFrame:
        from pairframe.sources.store import load_frame

        return load_frame(spark, path)

    def save(self, path: str) -> None:
        from pairframe.sources.store import save_frame

        save_frame(self, path)

    def replace(self, **changes: Any) -> PairFrame:
        return dataclasses.replace(self, **changes)

    def apply(self, transforms: Transform | Sequence[Transform]) -> PairFrame:
        """Apply one transform or several in order; each maps a frame to a frame."""
        steps = [transforms] if callable(transforms) else list(transforms)
        if not all(callable(t) for t in steps):
            raise ValueError("a transform is a function of a frame; got something else")
        frame = self
        for step in steps:
            frame = step(frame)
        return frame

    # -- columns and counts -----------------------------------------------

    @property
    def labels(self) -> DataFrame:
        return self.obs.select("label")

    @property
    def cell_ids(self) -> DataFrame:
        return self.obs.select("cell_id")

    @property
    def drug_ids(self) -> DataFrame:
        return self.obs.select("drug_id")

    @property
    def dtype(self) -> str:
        return self.obs.schema["label"].dataType.simpleString()

    def summary(self) -> DataFrame:
        return observations.summarise(self.obs)

    @property
    def size(self) -> int:
        return self.obs.count()

    @property
    def n_cells(self) -> int:
        return self.summary().first()["n_cells"]

    @property
    def n_drugs(self) -> int:
        return self.summary().first()["n_drugs"]

    def describe(self) -> str:
        """What the frame holds, in words; runs one aggregate."""
        row = self.summary().first()
        counts = f"{row['size']} observations of {row['n_cells']} cells and {row['n_drugs']} drugs"
        return counts if self.name is None else f"{self.name}: {counts}"

    # -- subsets ----------------------------------------------------------

    def _subset(self, obs: DataFrame, name: str | None, desc: str | None) -> PairFrame:
        return self.replace(obs=obs, name=name, desc=desc)

    def select(self, ids: Members, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(keep_members(self.obs, "id", ids), name, desc)

    def select_cells(self, cell_ids: Members, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(keep_members(self.obs, "cell_id", cell_ids), name, desc)

    def select_drugs(self, drug_ids: Members, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(keep_members(self.obs, "drug_id", drug_ids), name, desc)

    def sample(self, n: int, seed: int = 0, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(sampling.sample_rows(self.obs, n, seed), name, desc)

    def sample_cells(self, n: int, seed: int = 0, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(sampling.sample_entities(self.obs, "cell_id", n, seed), name, desc)

    def sample_drugs(self, n: int, seed: int = 0, name: str | None = None, desc: str | None = None) -> PairFrame:
        return self._subset(sampling.sample_entities(self.obs, "drug_id", n, seed), name, desc)

    def shuffle(self, seed: int = 0) -> DataFrame:
        """Observations with an explicit shuffled position."""
        return sampling.shuffle_rows(self.obs, seed)

    # -- features ---------------------------------------------------------

    @property
    def feature_columns(self) -> list[str]:
        """Names of the assembled feature columns, in order."""
        check_feature_sets(self.cell_features, self.drug_features, type(self).__name__)
        return feature_columns(self.cell_features, self.drug_features, self.encode_drugs_first)

    @property
    def feature_sets(self) -> list[FeatureSet]:
        check_feature_sets(self.cell_features, self.drug_features, type(self).__name__)
        cells, drugs = list(self.cell_features.values()), list(self.drug_features.values())
        return drugs + cells if self.encode_drugs_first else cells + drugs

    def encode(
        self, obs: DataFrame | None = None, drugs_first: bool | None = None, strict: bool = True
    ) -> DataFrame:
        """Observations (these, or others) with this frame's features."""
        check_feature_sets(self.cell_features, self.drug_features, type(self).__name__)
        first = self.encode_drugs_first if drugs_first is None else drugs_first
        return encode_pairs(
            self.obs if obs is None else obs, self.cell_features, self.drug_features, first, strict
        )

    def batches(
        self,
        batch_size: int,
        obs: DataFrame | None = None,
        targets: str | None = "label",
        sample_weights: str | None = None,
        drugs_first: bool | None = None,
        shuffle: bool = False,
        seed: int = 0,
        order_by: str | Sequence[str] | None = None,
    ) -> Batches:
        """Encoded mini-batches of these observations, or of explicit (id, cell_id, drug_id) rows.

        Unshuffled batches follow the columns `order_by` (such as `id`) when given.
        """
        rows = batch_rows(self.obs if obs is None else obs, targets, sample_weights)
        if order_by is not None:
            stated = [order_by] if isinstance(order_by, str) else order_by
            order_by = [{targets: "target", sample_weights: "weight"}.get(c, c) for c in stated]
        return Batches(
            rows, batch_size, shuffle, seed, encode=lambda df: self.encode(df, drugs_first), order_by=order_by
        )


def normalize_responses(
    train: PairFrame,
    val: PairFrame | None = None,
    test: PairFrame | None = None,
    norm_method: str = "global",
) -> tuple[PairFrame | None, PairFrame | None, PairFrame | None]:
    """Scale labels with statistics of `train`, overall or per drug."""
    frames = (train, val, test)
    scaled = scaling.normalize_labels(train.obs, [f and f.obs for f in frames[1:]], norm_method)
    return tuple(f and f.replace(obs=o) for f, o in zip(frames, scaled))
