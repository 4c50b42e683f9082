"""Structure strings to fixed-length bit vectors.

The bits of a string are the hashed substrings of length 1..radius, so strings that
share local environments share bits. Everything happens inside the row: no shuffle. The substrings
of a string are found by a vectorised UDF that hashes each distinct one once per task.
A chemistry toolkit can be plugged in through `featurizer`, for example as a pandas UDF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pairframe.featureset import ENTITY, LOOKUP, VALUE, FeatureSet
from pairframe.functions.guards import required
from pairframe.operators.features import map_values

N_BITS = 512
RADIUS = 3
#: Hashes of substrings that a task keeps.
CACHED = 400_000
#: Values of the arrays that a task hands over at once.
PART_VALUES = 1 << 22


def fingerprint(text: Column, n_bits: int = N_BITS, radius: int = RADIUS) -> Column:
    """0/1 array of a string."""
    hashes: dict = {}

    def hashed(gram, spelled: Callable[..., str]) -> int:
        found = hashes.get(gram)
        if found is None:
            if len(hashes) >= CACHED:
                hashes.clear()
            found = hashes[gram] = int(hashlib.md5(spelled(gram).encode()).hexdigest()[:8], 16)
        return found

    def spelled(gram: int) -> str:
        points = ((gram >> 42) - 1, (gram >> 21 & 0x1FFFFF) - 1, (gram & 0x1FFFFF) - 1)
        return "".join(chr(p) for p in points if p >= 0)

    def few(s: str) -> list[int]:
        # the up to `radius` characters that start at each place, 21 bits each and 0 behind the
        # end, in one number; shorter substrings are their prefixes
        points = np.zeros(len(s) + 2, np.int64)
        points[: len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        points[: len(s)] += 1
        grams = points[: len(s)] << 42
        for k in range(1, radius):
            grams |= points[k : len(s) + k] << (42 - 21 * k)
        levels = [np.unique(grams)]
        for k in range(radius - 1, 0, -1):
            levels.append(np.unique(levels[-1] >> (63 - 21 * k) << (63 - 21 * k)))
        return [hashed(g, spelled) for g in np.concatenate(levels).tolist()]

    def many(s: str) -> list[int]:
        windows = {s[i : i + radius] for i in range(len(s))}
        return [hashed(g, str) for g in {w[:k] for w in windows for k in range(1, radius + 1)}]

    def rows_of(texts: pa.Array) -> pa.Array:
        ones = np.zeros((len(texts), n_bits), np.int32)
        for row, raw in zip(ones, texts):
            s = (raw.as_py() or b"").decode("utf-8", "replace")
            row[np.array(few(s) if radius <= 3 else many(s), np.int64) % n_bits] = 1
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(n_bits))
        none = pa.array([raw.as_py() is None for raw in texts], pa.bool_())
        return pa.ListArray.from_arrays(offsets, pa.array(ones.ravel()), mask=none)

    step = max(1, PART_VALUES // n_bits)

    @F.arrow_udf(ArrayType(IntegerType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for i in range(0, max(len(texts), 1), step):
                yield rows_of(texts.slice(i, step))

    return vectors(text.cast("string").cast("binary"))


def fingerprint_set(
    features: FeatureSet,
    n_bits: int = N_BITS,
    radius: int = RADIUS,
    featurizer: Callable[[Column], Column] | None = None,
) -> FeatureSet:
    """Replace the strings of a lookup set by bit vectors."""
    return map_values(features, featurizer or (lambda c: fingerprint(c, n_bits, radius)), [LOOKUP])


def fingerprint_table(
    df: DataFrame,
    text_col: str,
    id_col: str | None = None,
    n_bits: int = N_BITS,
    radius: int = RADIUS,
    featurizer: Callable[[Column], Column] | None = None,
) -> FeatureSet:
    """Matrix set of bit vectors, one per id; the id defaults to the string.

    An id with two different strings, or with none, is an error.
    """
    rows = df.select(F.col(id_col or text_col).alias(ENTITY), F.col(text_col).alias(VALUE))
    rows = rows.groupBy(ENTITY).agg(
        F.min(VALUE).alias(VALUE), F.max(VALUE).alias("_other"), F.count(VALUE).alias("_n"), F.count(F.lit(1)).alias("_all")
    )
    rows = rows.filter(required((F.col(VALUE) == F.col("_other")) & (F.col("_n") == F.col("_all")), "an id needs one string"))
    vector = (featurizer or (lambda c: fingerprint(c, n_bits, radius)))(F.col(VALUE))
    return FeatureSet.matrix(
        rows.select(ENTITY, vector.alias(VALUE)), [str(i) for i in range(n_bits)], name="fingerprint"
    )
