"""Named queries over the given tables."""

from importlib import import_module
from types import ModuleType

MODULES = (
    "observation_queries",
    "feature_queries",
    "sampling_queries",
    "graph_queries",
    "file_queries",
    "regression",
    "stream_queries",
    "edge_queries",
)


def load_queries() -> ModuleType:
    """Import every query module and return the catalog they register in."""
    for module in MODULES:
        import_module(f"pairframe.plans.{module}")
    return import_module("pairframe.plans.catalog")
