"""Best matching units: the nearest neuron of each sample.

The codebook is a map's own, of the size the user chose, so it goes to the executors as a broadcast.
Samples stay where they are: one pass, no shuffle. Distances of a batch are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(x: pa.Array, d: int) -> np.ndarray:
    """A column of arrays as a matrix; nulls are NaN."""
    if x.null_count:
        raise ValueError("a sample's array is null; its cells may be")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) != len(x) * d:
        raise ValueError(f"a sample's array isn't of length {d}")
    return flat.reshape(len(x), d)


def squared(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances of samples to neurons. With missing cells, the sum over present ones is scaled up to all; without any, infinite."""
    there = ~np.isnan(x)
    if there.all():
        d2 = x @ w.T
        d2 *= -2
        d2 += (x * x).sum(1)[:, None]
        d2 += (w * w).sum(1)
        return np.maximum(d2, 0, out=d2)
    x0 = np.where(there, x, 0.0)
    m = there.sum(1)
    part = np.maximum((x0 * x0).sum(1)[:, None] - 2 * (x0 @ w.T) + there @ (w * w).T, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m[:, None] > 0, part * (x.shape[1] / m)[:, None], np.inf)


def ranked(x: np.ndarray, w: np.ndarray, nth: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neuron of rank nth by (distance, number), and its distance; -1 and NaN for samples without cells. So many samples at a time that
    their distances to all neurons stay in the processor's cache, or small at least."""
    most = max(64, (1 << 19) // max(len(w), 1))
    if len(x) > most:
        parts = [ranked(x[i : i + most], w, nth) for i in range(0, len(x), most)]
        return np.concatenate([at for at, _ in parts]), np.concatenate([dist for _, dist in parts])
    d2 = squared(x, w)
    if nth == 1:
        at = np.argmin(d2, 1)
        # ties are told at 9 places; only rows that may have one are rounded
        near = d2 <= (d2[np.arange(len(x)), at] + 1e-9)[:, None]
        tied = np.flatnonzero(np.count_nonzero(near, 1) > 1)
        at[tied] = np.argmin(np.round(d2[tied], 9), 1)
    else:
        at = np.argsort(np.round(d2, 9), 1, kind="stable")[:, nth - 1]
    chosen = w[at]
    there = ~np.isnan(x)
    m = there.sum(1)
    gap = np.where(there, x - chosen, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt((gap * gap).sum(1) * (x.shape[1] / m))
    return np.where(m > 0, at, -1), np.where(m > 0, dist, np.nan)


def bmu(spark: SparkSession, codebook: np.ndarray, ranks: tuple[int, ...] = (1,)):
    """An Arrow function of an array column: struct of bmu1, dist1, bmu2, ... for the ranks; bmus count from 1, null without cells."""
    held = spark.sparkContext.broadcast(np.asarray(codebook, np.float64))
    names = [n for r in ranks for n in (f"bmu{r}", f"dist{r}")]

    @F.arrow_udf("struct<" + ", ".join(f"bmu{r}: int, dist{r}: double" for r in ranks) + ">")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = held.value
        for x in batches:
            cells = matrix(x, w.shape[1])
            out = []
            for r in ranks:
                at, dist = ranked(cells, w, r)
                out += [pa.array(at + 1, pa.int32(), mask=at < 0), pa.array(dist, pa.float64(), mask=at < 0)]
            yield pa.StructArray.from_arrays(out, names)

    return find


def assign(samples: DataFrame, codebook: np.ndarray, nth: int = 1) -> DataFrame:
    """(sample_id, x) with bmu (from 1) and dist. Samples without any cell have null for both."""
    found = bmu(samples.sparkSession, codebook, (nth,))
    return samples.withColumn("__b", found("x")).select(*samples.columns, F.col(f"__b.bmu{nth}").alias("bmu"), F.col(f"__b.dist{nth}").alias("dist"))


def assign_sql(samples: DataFrame, codebook: np.ndarray, nth: int = 1) -> DataFrame:
    """assign() in built-in functions alone: the codebook as a literal, the rank-nth least (distance, number) of a sorted array.

    The readable form, for small codebooks; the Arrow form is many times faster on large ones.
    """
    d = codebook.shape[1]
    neurons = F.array(*[F.struct(F.lit(k + 1).alias("bmu"), F.array(*[F.lit(float(v)) for v in w]).alias("w")) for k, w in enumerate(codebook)])
    m = F.size(F.filter("x", lambda v: v.isNotNull()))

    def gap(w: Column) -> Column:
        squares = F.zip_with("x", w, lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0)))
        return F.round(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) * d / m, 9)

    candidates = F.transform(neurons, lambda n: F.struct(gap(n["w"]).alias("d2"), n["bmu"].alias("bmu")))
    best = F.when(m > 0, F.array_sort(candidates)[nth - 1])
    return samples.withColumn("__b", best).select(*samples.columns, F.col("__b.bmu").alias("bmu"), F.sqrt("__b.d2").alias("dist"))
