"""Clusters of neurons: k-means, the Davies-Bouldin index over k, and cluster tables and outlines.

A codebook has as many rows as the map has neurons, a number the user chose; fitting is the driver's numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lattice


def lloyd(points: np.ndarray, centres: np.ndarray, iterations: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels (from 0), centres and cost from given centres; ties go to the first, empty clusters keep their centre."""
    labels = np.zeros(len(points), int)
    for _ in range(iterations):
        labels = _nearest(points, centres)
        new = np.array([points[labels == k].mean(0) if (labels == k).any() else c for k, c in enumerate(centres)])
        if np.array_equal(new, centres):
            break
        centres = new
    labels = _nearest(points, centres)
    return labels, centres, float(((points - centres[labels]) ** 2).sum())


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.round(((points[:, None] - centres[None]) ** 2).sum(2), 9), 1)


def kmeans(codebook: np.ndarray, k: int = 3, init: str = "random", n_init: int = 5, max_iter: int = 200, seed: int = 0) -> np.ndarray:
    """Cluster of each neuron, from 1: the cheapest of n_init runs. init: "random" neurons or "k-means++"."""
    if not 1 <= k <= len(codebook):
        raise ValueError("k is 1 to the number of neurons")
    rng, best = np.random.default_rng(seed), None
    for _ in range(n_init):
        if init == "random":
            at = rng.choice(len(codebook), k, replace=False)
        elif init == "k-means++":
            at = [int(rng.integers(len(codebook)))]
            while len(at) < k:
                d = ((codebook[:, None] - codebook[None, at]) ** 2).sum(2).min(1)
                at.append(int(rng.choice(len(d), p=d / d.sum() if d.sum() else None)))
        else:
            raise ValueError("init is random or k-means++")
        run = lloyd(codebook, codebook[at], max_iter)
        if best is None or run[2] < best[2]:
            best = run
    return best[0] + 1


def davies_bouldin(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean over clusters of the worst (spread + spread) / distance of centres; 0 for fewer than two clusters."""
    names = np.unique(labels)
    if len(names) < 2:
        return 0.0
    centres = np.array([points[labels == n].mean(0) for n in names])
    spread = np.array([np.sqrt(((points[labels == n] - c) ** 2).sum(1)).mean() for n, c in zip(names, centres, strict=True)])
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.nan_to_num((spread[:, None] + spread[None]) / apart, posinf=0.0).max(1).mean())


def davies_bouldin_scan(spark: SparkSession, weights: np.ndarray, max_clust: int = 30, n_iter: int = 100, seed: int = 0, n_init: int = 5) -> DataFrame:
    """(iteration, k, dbi) for k = 2 to max_clust, on weights standardized by their own mean and deviation; clusters are the cheapest of n_init runs.

    The pairs of iteration and k are dealt over the executors; the weights, as large as the map, go out with them.
    """
    std = weights.std(0)
    z = (weights - weights.mean(0)) / np.where(std == 0, 1, std)
    held = spark.sparkContext.broadcast(z)
    most = min(max_clust, len(z)) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            rows = [(int(x // most) + 1, int(x % most) + 2) for x in at]
            dbi = [davies_bouldin(held.value, kmeans(held.value, k, n_init=n_init, seed=seed + 1000 * i + k)) for i, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.int32()), pa.array(dbi, pa.float64())], names=["iteration", "k", "dbi"])

    return spark.range(0, n_iter * max(most, 0), 1, max(1, min(n_iter, 256))).mapInArrow(scan, "iteration int, k int, dbi double")


def local_minima(scan: DataFrame) -> DataFrame:
    """(iteration, k, dbi, place): k lower than both its neighbours (the ends have one), numbered by index within an iteration."""
    w = Window.partitionBy("iteration").orderBy("k")
    past, coming = F.lag("dbi").over(w), F.lead("dbi").over(w)
    low = scan.withColumn("low", F.coalesce(F.col("dbi") < past, F.lit(True)) & F.coalesce(F.col("dbi") < coming, F.lit(True))).where("low").drop("low")
    return low.withColumn("place", F.row_number().over(Window.partitionBy("iteration").orderBy("dbi", "k")))


def minima_summary(scan: DataFrame) -> DataFrame:
    """(pick, k, wins, percent): how often each k is the best, second, third, middle or worst local minimum. Iterations with fewer minima count where they have one."""
    low = local_minima(scan).withColumn("n", F.count("*").over(Window.partitionBy("iteration")))
    picks = F.array(*[F.when(c, F.lit(n)) for n, c in (("first", F.col("place") == 1), ("second", F.col("place") == 2), ("third", F.col("place") == 3), ("median", F.col("place") == F.floor((F.col("n") + 1) / 2)), ("max", F.col("place") == F.col("n")))])
    won = low.select("k", F.explode(picks).alias("pick")).where("pick IS NOT NULL").groupBy("pick", "k").agg(F.count("*").alias("wins"))
    return won.withColumn("percent", F.round(100 * F.col("wins") / F.sum("wins").over(Window.partitionBy("pick")), 2))


def index_by_k(scan: DataFrame) -> DataFrame:
    return scan.groupBy("k").agg(F.avg("dbi").alias("mean"), F.percentile("dbi", 0.25).alias("q25"), F.percentile("dbi", 0.75).alias("q75"))


def outline(spark: SparkSession, labels: np.ndarray, columns: int, rows: int) -> DataFrame:
    """(cluster, neuron, k): sides of hexagons that part a cluster from another or from the map's edge, drawn as a plane."""
    c = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "neuron int, cluster int")
    sides = lattice.neighbours(spark, columns, rows, toroid=True).select("neuron", "k").join(c, "neuron")
    inside = lattice.neighbours(spark, columns, rows, toroid=False).join(c, "neuron").join(c.select(F.col("neuron").alias("neighbour"), F.col("cluster").alias("other")), "neighbour").where("cluster = other").select("neuron", "k")
    return sides.join(inside, ["neuron", "k"], "left_anti").select("cluster", "neuron", "k")


def parts(spark: SparkSession, labels: np.ndarray, columns: int, rows: int) -> DataFrame:
    """(neuron, cluster, part, cx, cy): connected parts of clusters on the plane, numbered by their least neuron, with their centres."""
    near = lattice.neighbour_sets(columns, rows, toroid=False)
    part = list(range(len(labels)))
    changed = True
    while changed:
        changed = False
        for n in range(len(labels)):
            least = min([part[n], *(part[m] for m in near[n] if labels[m] == labels[n])])
            if least != part[n]:
                part[n], changed = least, True
    at = lattice.neurons(spark, columns, rows)
    given = spark.createDataFrame([(i, int(v), p) for i, (v, p) in enumerate(zip(labels, part, strict=True))], "neuron int, cluster int, part int")
    whole = Window.partitionBy("part")
    return at.join(given, "neuron").select("neuron", "cluster", "part", F.avg("hex_x").over(whole).alias("cx"), F.avg("hex_y").over(whole).alias("cy"))
