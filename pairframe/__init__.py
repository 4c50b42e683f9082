"""Two-entity response data on Spark."""

from pairframe.featureset import FeatureSet
from pairframe.frame import PairFrame, normalize_responses
from pairframe.operators.batching import Batches
from pairframe.session import build_session

__all__ = ["Batches", "FeatureSet", "PairFrame", "build_session", "normalize_responses"]
