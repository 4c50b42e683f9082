from pairframe.functions.arrays import (
    array_stats,
    additive_score,
    dot,
    linear,
    pick_positions,
    reduce_arrays,
    softmax_pool,
)
from pairframe.functions.guards import required
from pairframe.functions.numeric import nan_to_null, safe_scale
from pairframe.functions.text import split_fields

__all__ = [
    "additive_score",
    "array_stats",
    "dot",
    "linear",
    "nan_to_null",
    "pick_positions",
    "reduce_arrays",
    "required",
    "safe_scale",
    "softmax_pool",
    "split_fields",
]
