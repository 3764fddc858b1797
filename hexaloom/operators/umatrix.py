"""U-matrix, hits and quality of a map, as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import scale
from . import lattice


def codebook_table(spark: SparkSession, codebook: np.ndarray) -> DataFrame:
    """(neuron, w): neurons from 0, weights as arrays."""
    return spark.createDataFrame([(k, [float(v) for v in w]) for k, w in enumerate(codebook)], "neuron int, w array<double>")


def expanded(spark: SparkSession, codebook: np.ndarray, columns: int, rows: int, toroid: bool = True, log: bool = False) -> DataFrame:
    """(neuron, k, neighbour, d): distance in weights to each neighbour, or its natural logarithm."""
    w = codebook_table(spark, codebook)
    pairs = lattice.neighbours(spark, columns, rows, toroid).join(w, "neuron").join(w.select(F.col("neuron").alias("neighbour"), F.col("w").alias("v")), "neighbour")
    d = F.sqrt(F.aggregate(F.zip_with("w", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return pairs.select("neuron", "k", "neighbour", (F.log(d) if log else d).alias("d"))


def reduced(spark: SparkSession, codebook: np.ndarray, columns: int, rows: int, toroid: bool = True, log: bool = False) -> DataFrame:
    """(neuron, u): mean distance to the neighbours that there are; with log the logarithm of the mean."""
    mean = F.avg("d")
    return expanded(spark, codebook, columns, rows, toroid).groupBy("neuron").agg((F.log(mean) if log else mean).alias("u"))


def hits(assigned: DataFrame) -> DataFrame:
    """(bmu, hits, radius): samples of each neuron that has any, and a size from 0.5 to 2 by them."""
    counted = assigned.where("bmu IS NOT NULL").groupBy("bmu").agg(F.count("*").alias("hits"))
    return counted.withColumn("radius", scale(F.col("hits"), 0.5, 2.0))


def quantization_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("dist").alias("quantization_error"))


def topographic_error(second: DataFrame, columns: int, rows: int, toroid: bool = True) -> DataFrame:
    """Share of samples (bmu1, bmu2) whose second neuron isn't beside the first. Samples without cells don't count."""
    near = lattice.neighbours(second.sparkSession, columns, rows, toroid).select((F.col("neuron") + 1).alias("bmu1"), (F.col("neighbour") + 1).alias("bmu2")).distinct()
    pairs = second.where("bmu1 IS NOT NULL").groupBy("bmu1", "bmu2").agg(F.count("*").alias("n"))  # at most the square of the map
    apart = pairs.join(near.withColumn("near", F.lit(1)), ["bmu1", "bmu2"], "left")
    return apart.agg((F.sum(F.when(F.col("near").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("topographic_error"))


def neurons_table(spark: SparkSession, weights: np.ndarray, codebook: np.ndarray, features: list[str], columns: int, rows: int, toroid: bool = True) -> DataFrame:
    """BMU, Udist, Ret_x, Ret_y, Cub_x, Cub_y, Cub_z and B_<feature>: restored weights, those under 1e-6 in size as 0, rounded to 6 places."""
    shown = np.round(np.where(np.abs(weights) < 1e-6, 0.0, weights), 6)
    w = codebook_table(spark, shown)
    u = reduced(spark, codebook, columns, rows, toroid)
    at = lattice.neurons(spark, columns, rows)
    table = at.join(u, "neuron").join(w, "neuron").withColumn("Udist", scale(F.col("u")))
    return table.select((F.col("neuron") + 1).alias("BMU"), "Udist", F.col("ret_x").alias("Ret_x"), F.col("ret_y").alias("Ret_y"), F.col("cub_x").alias("Cub_x"), F.col("cub_y").alias("Cub_y"), F.col("cub_z").alias("Cub_z"), *[F.col("w")[i].alias(f"B_{f}") for i, f in enumerate(features)])
