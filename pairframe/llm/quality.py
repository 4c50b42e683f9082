"""Document quality by a regularised quadratic discriminant.

Every text becomes a vector of transformed statistics. Spark sums the moments of each class
over all labelled rows; the driver holds only those sums. Each class covariance is shrunk
towards the pooled one and then towards a multiple of the identity, factorised once
(Cholesky), and a text's score is the logistic of the difference of the two log densities,
each from a Mahalanobis distance, plus the log prior odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairframe.llm.common import Workspace, ship_package

POOLED_SHARE = 0.3
IDENTITY_SHARE = 0.02
THRESHOLD = 0.7
DIM = 18

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_PAUSE = np.isin(_BYTES, [ord(c) for c in ".,;:'\"()-?"])
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _PAUSE | _SPACE)


def _ratio(part: float, whole: float) -> float:
    """Smoothed share on the logit scale."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty one gives those of no words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = raw.lower().split()
    n, distinct = len(words), len(set(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum())
    upper, symbols = int(counts[_UPPER].sum()), int(counts[_SYMBOL].sum())
    stops = int(counts[ord(".")])
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    share = counts[counts > 0] / max(size, 1)
    entropy = float(-(share * np.log(share)).sum()) if size else 0.0
    length = (size - int(counts[_SPACE].sum())) / max(n, 1)
    return [
        math.log1p(size),
        math.log1p(n) - math.log1p(len(lines)),
        math.log1p(length),
        _ratio(upper, letters),
        _ratio(int(counts[_DIGIT].sum()), size),
        _ratio(symbols, size),
        _ratio(int(counts[ord("!")]), n),
        _ratio(int(counts[ord("|")]), n),
        _ratio(stops, n),
        _ratio(int(counts[ord(",")]), n),
        _ratio(distinct, n),
        _ratio(repeats, n),
        _ratio(pairs, max(n - 1, 0)),
        _ratio(len(set(lines)), len(lines)),
        _ratio(int(counts[_HIGH].sum()), size),
        entropy,
        _ratio(max(map(len, words), default=0), size),
        math.log1p(distinct),
    ]


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Means, inverse Cholesky factors and log terms of the two classes.

    Without rows of both classes there is no boundary: every text then gets `prior`.
    """

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None
    whiten: np.ndarray | None
    offset: float
    prior: float

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(vectors), self.prior)
        x = (vectors - self.centre) / self.scale
        distance = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten)]
        log_odds = self.offset + 0.5 * (distance[0] - distance[1])
        return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def _vectors(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), DIM)


def vectors(docs: DataFrame, text_col: str = "text", out: str = "vector") -> DataFrame:
    """`docs` with its text column replaced by the vector of the text's statistics."""
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, out)]

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                value = _vectors(part.column(part.schema.get_field_index(text_col)).to_pylist())
                columns = [part.column(part.schema.get_field_index(c)) for c in others]
                columns.append(pa.array(value.tolist(), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*others, out])

    kept = docs.select(*[F.col(f"`{c}`") for c in (*others, text_col)])
    fields = [f for f in kept.schema.fields if f.name in others]
    return kept.mapInArrow(task, StructType([*fields, StructField(out, ArrayType(DoubleType()))]))


def fit(labelled: DataFrame, vector_col: str = "vector", label_col: str = "label") -> QuadraticDiscriminant:
    """Fit on all rows whose label is 0 or 1; rows with another or no label are ignored.

    Counts, sums and products of the statistics are added up per class inside the tasks
    and then by one aggregation: the driver receives two rows, whatever the input.
    """

    def moments(batches):
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist())
            values = np.array(batch.column(0).to_pylist(), float).reshape(-1, DIM)
            rows = []
            for label in (0, 1):
                x = values[labels == label]
                rows.append(np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0, 1]), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["label", "m"]
            )

    size = 1 + DIM + DIM * DIM
    known = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(vector_col).alias("vector"), F.col(label_col).cast("int").alias("label")
    )
    sums = known.mapInArrow(moments, "label bigint, m array<double>").select("label", F.posexplode("m").alias("i", "v"))
    found = sums.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + DIM + DIM^2) numbers
    total = np.zeros((2, size))
    for row in found:
        total[row.label, row.i] = row.v
    n = total[:, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    flat = np.zeros(DIM), np.ones(DIM)
    if n.min() < 2:
        return QuadraticDiscriminant(*flat, None, None, 0.0, float(prior))
    mean = total[:, 1 : 1 + DIM] / n[:, None]
    product = total[:, 1 + DIM :].reshape(2, DIM, DIM)
    spread = np.stack([p / k - np.outer(m, m) for p, k, m in zip(product, n, mean)])
    pooled = (spread * n[:, None, None]).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    centre = (mean * n[:, None]).sum(0) / n.sum()
    spread, pooled = spread / np.outer(scale, scale), pooled / np.outer(scale, scale)
    whiten, log_root = [], []
    for s in spread:
        s = (1 - POOLED_SHARE) * s + POOLED_SHARE * pooled
        s = (1 - IDENTITY_SHARE) * s + IDENTITY_SHARE * max(np.trace(s) / DIM, 1e-6) * np.eye(DIM)
        root = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(root))
        log_root.append(np.log(np.diag(root)).sum())
    offset = math.log(prior / (1 - prior)) - log_root[1] + log_root[0]
    return QuadraticDiscriminant(centre, scale, (mean - centre) / scale, np.stack(whiten), offset, float(prior))


def score(docs: DataFrame, model: QuadraticDiscriminant, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out` (0 to 1); a column of that name is replaced, all others stay.

    Null and empty texts have a score as well, that of a text without words. Rows are
    scored where they are, without a shuffle.
    """
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c != out]

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                value = model.scores(_vectors(part.column(part.schema.get_field_index(text_col)).to_pylist()))
                columns = [part.column(part.schema.get_field_index(c)) for c in others] + [pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, out])

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    return kept.mapInArrow(task, StructType([*kept.schema.fields, StructField(out, DoubleType())]))


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo `divisor`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def score_vectors(rows: DataFrame, model: QuadraticDiscriminant, vector_col: str = "vector", out: str = "score") -> DataFrame:
    """`rows` with the vector column replaced by the score."""
    others = [c for c in rows.columns if c not in (vector_col, out)]

    def task(batches):
        for batch in batches:
            values = np.array(batch.column(batch.schema.get_field_index(vector_col)).to_pylist(), float)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            columns.append(pa.array(model.scores(values.reshape(-1, DIM))))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, out])

    kept = rows.select(*[F.col(f"`{c}`") for c in (*others, vector_col)])
    fields = [f for f in kept.schema.fields if f.name in others]
    return kept.mapInArrow(task, StructType([*fields, StructField(out, DoubleType())]))


def train(rows: DataFrame, labels: DataFrame) -> QuadraticDiscriminant:
    """Fit on the labelled rows (doc_id, vector) outside the held-out quarter.

    A document labelled twice counts with its smallest label; documents are matched on
    doc_id, so null ids are never training rows. Texts do not take part in the join.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return fit(rows.filter(remainder(4) != 2).select("doc_id", "vector").join(marked, "doc_id"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; texts are read once."""
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    work = Workspace(docs.sparkSession, "quality")
    rows = work.save(vectors(docs.select("doc_id", "text")), "vectors")
    scored = score_vectors(rows, train(rows, labels))
    return scored.select(
        "doc_id", held_out, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
