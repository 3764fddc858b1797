"""Maps on streams: new rows are placed as they come, and a map goes on learning by micro-batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kernel
from ..operators import lattice
from ..operators.update import smooth, voronoi_sums
from ..plans.estimator import SomModel


def place(model: SomModel, stream: DataFrame) -> DataFrame:
    """(sample_id, bmu, dist) of a stream's rows. Each row is placed by itself, so there is no state."""
    return model.assign(stream).select("sample_id", F.col("b.bmu1").alias("bmu"), F.col("b.dist1").alias("dist"))


class OnlineUpdate:
    """A foreachBatch sink: each batch moves the codebook a share of the way to its own batch update."""

    def __init__(self, model: SomModel, radius: float = 1.0, share: float = 0.1):
        self.model, self.share = model, share
        grid = lattice.Grid(*model.size, model.toroid, model.settings.dist_factor)
        self.h = grid.weigh(lambda d: kernel(model.settings.kernel).array(d, radius))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        sums = voronoi_sums(self.model.vectors(batch), self.model.codebook)
        if sums[:, -2].sum():
            new = smooth(sums, self.h, self.model.codebook)
            self.model.codebook = np.round((1 - self.share) * self.model.codebook + self.share * new, 6)
