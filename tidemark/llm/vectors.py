"""What the two vector operators share: valid rows, distinct vectors, spherical k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the sample that centroids are fitted on, as doubles, and of the centroids that are sent to the workers.
SAMPLE_BYTES, CENTRE_BYTES = 64 << 20, 16 << 20


def kept_type(rows: DataFrame, embedding: str) -> str:
    """The element type that holds a column's values exactly: float where it is float already, else double."""
    return "float" if rows.select(embedding).schema[0].dataType.simpleString() == "array<float>" else "double"


def usable(embedding: str) -> Column:
    """Not null, not empty, not zero, without null or non-finite components (false, never null)."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), F.lit(False))


def matrix(values: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def sample(vectors: DataFrame, size: int, most: int, embedding: str = "embedding") -> np.ndarray:
    """At most `most` of the vectors of `size` components, and SAMPLE_BYTES of them, chosen by a hash of their values
    (the same on every run), as doubles."""
    most = max(1, min(most, SAMPLE_BYTES // (8 * size)))
    rows = vectors.select(embedding).orderBy(F.xxhash64(embedding), embedding).limit(most).collect()
    return np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_cell(x: np.ndarray, centres: np.ndarray, price: np.ndarray | float = 0.0) -> np.ndarray:
    step = max(1, (32 << 20) // (8 * len(centres)))
    return np.concatenate([(x[k : k + step] @ centres.T - price).argmax(1) for k in range(0, len(x), step)])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, balance: float = 0.0, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows. balance > 0 lowers a cell's similarity in proportion to its surplus of rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    load = np.full(k, len(x) / k)
    for _ in range(rounds):
        cell = nearest_cell(x, centres, balance * (load * k / len(x) - 1))
        load = 0.5 * load + 0.5 * np.bincount(cell, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def balanced(x: np.ndarray, k: int, most: float = 2.0, seed: int = 7) -> np.ndarray:
    """About k unit centroids none of whose cells holds more than `most` times the mean of the rows: cells above that
    are split in parts of their own, again and again; centroids without rows go."""
    centres = spherical_kmeans(x, k, balance=0.02, seed=seed)
    limit = max(2.0, most * len(x) / k)
    for _ in range(12):
        cell = nearest_cell(x, centres)
        size = np.bincount(cell, minlength=len(centres))
        full = np.flatnonzero(size > limit)
        fine = [centres[(size > 0) & (size <= limit)]]
        if not len(full):
            return fine[0]
        order = np.argsort(cell, kind="stable")
        ends = np.cumsum(size)
        for c in full:
            own = x[order[ends[c] - size[c] : ends[c]]]
            fine.append(spherical_kmeans(own, int(np.ceil(2 * size[c] / limit)), rounds=4, seed=seed))
        centres = np.concatenate(fine)
    return centres
