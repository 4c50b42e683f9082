"""Transforms: callables from PairFrame to PairFrame, built on the feature operators."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame

from pairframe.featureset import LOOKUP, MATRIX, FeatureSet
from pairframe.frame import PairFrame
from pairframe.operators import features as ops
from pairframe.operators.checks import check_kind
from pairframe.operators.fingerprints import N_BITS, RADIUS, fingerprint_set


class FeatureTransform(ABC):
    """Rewrites one feature set, found by side and key, and returns a new frame."""

    side: ClassVar[str]
    kinds: ClassVar[tuple[str, ...]] = (MATRIX,)

    def __init__(self, key: str) -> None:
        self.key = key

    @abstractmethod
    def rewrite(self, features: FeatureSet) -> FeatureSet: ...

    def __call__(self, frame: PairFrame) -> PairFrame:
        attribute = {"cell": "cell_features", "drug": "drug_features"}.get(self.side)
        if attribute is None:
            raise ValueError(f"expected 'cell' or 'drug', got {self.side!r}")
        sets = dict(getattr(frame, attribute) or {})
        check_kind(sets[self.key], *self.kinds)
        sets[self.key] = self.rewrite(sets[self.key])
        return frame.replace(**{attribute: sets})


class CellFeatureTransform(FeatureTransform):
    side = "cell"


class DrugFeatureTransform(FeatureTransform):
    side = "drug"


class _Select:
    def __init__(self, feature_names: Iterable[Any], key: str) -> None:
        super().__init__(key)
        self.feature_names = list(feature_names)

    def rewrite(self, features: FeatureSet) -> FeatureSet:
        return ops.select_features(features, self.feature_names)


class SelectCellFeatures(_Select, CellFeatureTransform):
    """Keep named features of a cell set."""


class SelectDrugFeatures(_Select, DrugFeatureTransform):
    """Keep named features of a drug set."""


class SelectListed(SelectCellFeatures):
    """Keep the features of a named list held in a (list_name, pos, feature) table."""

    def __init__(self, lists: DataFrame, list_name: str, key: str) -> None:
        super().__init__(ops.load_feature_list(lists, list_name), key)


class _Variance:
    def __init__(self, key: str, variance_threshold: float = 0.0, fit_ids=None) -> None:
        super().__init__(key)
        self.variance_threshold = variance_threshold
        self.fit_ids = fit_ids

    def rewrite(self, features: FeatureSet) -> FeatureSet:
        return ops.variance_filter(features, self.variance_threshold, self.fit_ids)


class CellVarianceFilter(_Variance, CellFeatureTransform):
    """Drop cell features with little variance."""


class DrugVarianceFilter(_Variance, DrugFeatureTransform):
    """Drop drug features with little variance."""


class ScaleCellFeatures(CellFeatureTransform):
    """Standardise a cell set with statistics of `fit_ids`."""

    def __init__(self, key: str, fit_ids=None) -> None:
        super().__init__(key)
        self.fit_ids = fit_ids

    def rewrite(self, features: FeatureSet) -> FeatureSet:
        return ops.scale_features(features, self.fit_ids)


class StructureToFingerprint(DrugFeatureTransform):
    """Strings of a drug lookup set to bit vectors."""

    kinds = (LOOKUP,)

    def __init__(
        self,
        key: str,
        n_bits: int = N_BITS,
        radius: int = RADIUS,
        featurizer: Callable[[Column], Column] | None = None,
    ) -> None:
        super().__init__(key)
        self.n_bits, self.radius, self.featurizer = n_bits, radius, featurizer

    def rewrite(self, features: FeatureSet) -> FeatureSet:
        return fingerprint_set(features, self.n_bits, self.radius, self.featurizer)
