"""The hexagonal lattice, planar or toroid: neurons, distances and neighbours, as tables and as numpy.

Neurons are numbered 0 to columns * rows - 1, row by row; outputs add 1. Odd rows stand half a step to
the right. In cube coordinates the hexagonal distance is half the sum of absolute differences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (dx, dy) of the six neighbours, in the order of the expanded U-matrix, by the row's parity.
NEIGHBOURS = {0: [(1, 0), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1)], 1: [(1, 0), (1, 1), (0, 1), (-1, 0), (0, -1), (1, -1)]}


def map_size(size: tuple[int, int] | int | None, n: int) -> tuple[int, int]:
    """(columns, rows), rows even. An int is the number of columns and, made even, of rows; None: expected_size(n)."""
    if size is None:
        return expected_size(n)
    columns, rows = (size, size) if isinstance(size, int) else size
    return columns, rows + rows % 2


def expected_size(n: int) -> tuple[int, int]:
    side = round(float(np.sqrt(5 * np.sqrt(n))))
    return side, side + side % 2


def cube(x, y, odd):
    """Cube coordinates of column x, row y, odd 0 or 1 by the row; for numbers, arrays and columns alike."""
    cx = x - (y - odd) / 2
    return cx, -cx - y, y


def neurons(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """(neuron, ret_x, ret_y, cub_x, cub_y, cub_z, hex_x, hex_y)."""
    at = spark.range(columns * rows).select(F.col("id").cast("int").alias("neuron"))
    at = at.withColumn("ret_x", F.col("neuron") % columns).withColumn("ret_y", F.floor(F.col("neuron") / columns).cast("int"))
    cx, cy, cz = cube(F.col("ret_x"), F.col("ret_y"), F.col("ret_y") % 2)
    hex_x, hex_y = plane("ret_x", "ret_y")
    return at.select("*", cx.cast("int").alias("cub_x"), cy.cast("int").alias("cub_y"), cz.cast("int").alias("cub_z"), hex_x.alias("hex_x"), hex_y.alias("hex_y"))


def plane(x: str, y: str) -> tuple[Column, Column]:
    """Centres in the plane, one apart."""
    return F.col(x) + F.when(F.col(y) % 2 == 1, 0.5).otherwise(0.0), F.col(y) * F.sqrt(F.lit(3.0)) / 2


def distances(spark: SparkSession, columns: int, rows: int, toroid: bool = True, power: float = 2) -> DataFrame:
    """(src, dst, d): hexagonal steps to the power, floored, for all pairs of neurons; on a toroid to the nearest of the nine images."""
    cells = neurons(spark, columns, rows).select("neuron", "ret_x", "ret_y")
    a = cells.select(F.col("neuron").alias("src"), F.col("ret_x").alias("ax"), F.col("ret_y").alias("ay"))
    b = cells.select(F.col("neuron").alias("dst"), F.col("ret_x").alias("bx"), F.col("ret_y").alias("by"))
    pairs = a.crossJoin(b)  # a map's own neurons: its size is a parameter, not the data's
    images = [(i, j) for i in (-columns, 0, columns) for j in (-rows, 0, rows)] if toroid else [(0, 0)]
    own = cube(F.col("ax"), F.col("ay"), F.col("ay") % 2)
    steps = [sum((F.abs(p - q) for p, q in zip(own, cube(F.col("bx") + i, F.col("by") + j, F.col("by") % 2), strict=True)), F.lit(0)) / 2 for i, j in images]
    nearest = F.least(*steps) if toroid else steps[0]
    return pairs.select("src", "dst", F.floor(F.pow(nearest, F.lit(float(power)))).cast("int").alias("d"))


def distance_array(columns: int, rows: int, toroid: bool = True, power: float = 2) -> np.ndarray:
    at = np.arange(columns * rows)
    x, y = at % columns, at // columns
    images = [(i, j) for i in (-columns, 0, columns) for j in (-rows, 0, rows)] if toroid else [(0, 0)]
    own = cube(x, y, y % 2)
    best = None
    for i, j in images:
        d = sum(np.abs(p[:, None] - q[None]) for p, q in zip(own, cube(x + i, y + j, y % 2), strict=True)) / 2
        best = d if best is None else np.minimum(best, d)
    return np.floor(best**power)


class Grid:
    """Distances of a map's neurons by offsets: from a row of either parity, a table over (rows, columns) away. Twice (2 rows) x (2 columns)
    numbers stand for the square of the map's neurons."""

    def __init__(self, columns: int, rows: int, toroid: bool = True, power: float = 2):
        if toroid and rows % 2:
            raise ValueError("a toroid has even rows")
        self.columns, self.rows = columns, rows
        x, y = np.arange(1 - columns, columns), np.arange(1 - rows, rows)
        images = [(i, j) for i in (-columns, 0, columns) for j in (-rows, 0, rows)] if toroid else [(0, 0)]
        best = np.full((2, len(y), len(x)), np.inf)
        for odd in (0, 1):
            own = cube(0, odd, odd)
            there = (y + odd) % 2
            for i, j in images:
                other = cube((x + i)[None, :], (y + odd + j)[:, None], there[:, None])
                best[odd] = np.minimum(best[odd], sum(np.abs(p - q) for p, q in zip(own, other, strict=True)) / 2)
        self.d = np.floor(best**power)

    def weigh(self, weight: Callable[[np.ndarray], np.ndarray]) -> Weights:
        return Weights(self, weight(self.d))


class Weights:
    """A neighbourhood as a linear map: weights @ table sums the rows of all neurons for each neuron, one row of neurons at a time."""

    def __init__(self, grid: Grid, w: np.ndarray):
        self.grid, self.w = grid, w
        self.away = np.arange(grid.columns)[None, :] - np.arange(grid.columns)[:, None] + grid.columns - 1

    def __matmul__(self, table: np.ndarray) -> np.ndarray:
        c, r = self.grid.columns, self.grid.rows
        out = np.empty((c * r, table.shape[1]))
        for y in range(r):
            near = self.w[y % 2, r - 1 - y : 2 * r - 1 - y][:, self.away]  # (rows there, columns here, columns there)
            out[y * c : (y + 1) * c] = near.transpose(1, 0, 2).reshape(c, r * c) @ table
        return out


def neighbours(spark: SparkSession, columns: int, rows: int, toroid: bool = True) -> DataFrame:
    """(neuron, k, neighbour): the six neighbours in order k = 0 to 5; planar maps leave out those beyond the edge."""
    steps = F.when(F.col("ret_y") % 2 == 0, _steps(0)).otherwise(_steps(1))
    out = neurons(spark, columns, rows).select("neuron", "ret_x", "ret_y", F.posexplode(steps).alias("k", "step"))
    x, y = F.col("ret_x") + F.col("step.dx"), F.col("ret_y") + F.col("step.dy")
    if toroid:
        x, y = F.pmod(x, F.lit(columns)), F.pmod(y, F.lit(rows))
    else:
        out = out.where(x.between(0, columns - 1) & y.between(0, rows - 1))
    return out.select("neuron", "k", (y * columns + x).cast("int").alias("neighbour"))


def _steps(parity: int) -> Column:
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS[parity]])


def neighbour_sets(columns: int, rows: int, toroid: bool = True) -> list[set[int]]:
    out = []
    for n in range(columns * rows):
        x, y = n % columns, n // columns
        around = [(x + dx, y + dy) for dx, dy in NEIGHBOURS[y % 2]]
        out.append({v % rows * columns + u % columns for u, v in around if toroid or (0 <= u < columns and 0 <= v < rows)})
    return out
