"""The batch update: sums of the samples of each neuron, smoothed over the map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import matrix, ranked
from .lattice import Weights


def local_sums(x: np.ndarray, at: np.ndarray, dist: np.ndarray, k: int, skip_missing: bool) -> np.ndarray:
    """A (k, 2 d + 2) table: sums of cells, counts of cells (or of rows), rows, distances."""
    d = x.shape[1]
    out = np.zeros((k, 2 * d + 2))
    ok = at >= 0
    x, at, dist = x[ok], at[ok], dist[ok]
    there = ~np.isnan(x)
    rows = np.bincount(at, minlength=k)
    for j in range(d):
        out[:, j] = np.bincount(at, np.where(there[:, j], x[:, j], 0.0), k)
        out[:, d + j] = np.bincount(at, there[:, j], k) if skip_missing else rows
    out[:, 2 * d], out[:, 2 * d + 1] = rows, np.bincount(at, dist, k)
    return out


#: The cells of a table of sums that aren't zero.
SPARSE = "bmu int, pos int, s double"


def sparse_rows(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        at, of = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(total[at, of])], names=["bmu", "pos", "s"])


def summed(parts: DataFrame, k: int, d: int) -> np.ndarray:
    """The table of sums of all tasks' sparse_rows()."""
    out = np.zeros((k, 2 * d + 2))
    for r in parts.groupBy("bmu", "pos").agg(F.sum("s").alias("s")).collect():
        out[r["bmu"], r["pos"]] = r["s"]
    return out


def voronoi_sums(samples: DataFrame, codebook: np.ndarray, skip_missing: bool = False) -> np.ndarray:
    """local_sums() over all samples. Tasks sum what they read, a hash aggregate sums the tasks; k * (2 d + 2) numbers reach the driver."""
    k, d = codebook.shape
    held = samples.sparkSession.sparkContext.broadcast(np.asarray(codebook, np.float64))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = held.value, None
        for batch in batches:
            x = matrix(batch.column(0), d)
            part = local_sums(x, *ranked(x, w), k, skip_missing)
            total = part if total is None else total + part
        yield from sparse_rows(total)

    out = summed(samples.select("x").mapInArrow(sums, SPARSE), k, d)
    held.unpersist()
    return out


def smooth(sums: np.ndarray, h: np.ndarray | Weights, old: np.ndarray) -> np.ndarray:
    """New codebook from voronoi_sums() and the neighbourhood h, rounded to 6 places; neurons that nothing reaches keep their weights."""
    d = old.shape[1]
    both = h @ sums[:, : 2 * d]
    num, den = both[:, :d], both[:, d:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(np.where(den > 0, num / den, old), 6)
