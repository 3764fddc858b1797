"""The training loop: an epoch is one pass of the executors over the samples and a smoothing on the driver.

What crosses between them each epoch is the codebook, one way, and sums per neuron, the other. Small
inputs (at most local_cells cells) are brought to the driver once and run the same arithmetic there, as
thousands of epochs over a handful of rows would be nothing but scheduling. Draws and noise come from hashes of
the samples' ids, so both give one map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kernel
from ..functions.scalars import xxhash64_longs
from ..operators.assign import matrix, ranked
from ..operators.lattice import Grid
from ..operators.samples import bootstrap_cut, draw_hash, drawn, sample_hash
from ..operators.update import SPARSE, local_sums, smooth, sparse_rows, summed, voronoi_sums
from .schedule import Phase


def random_codebook(low: np.ndarray, high: np.ndarray, k: int, seed: int) -> np.ndarray:
    return low + (high - low) * np.random.default_rng(seed).random((k, len(low)))


def pca_codebook(mean: np.ndarray, covariance: np.ndarray, columns: int, rows: int, by_rows: bool = False) -> np.ndarray:
    """Neurons on the plane of the two largest principal components (one for maps of one row or column), rounded to 6 places.

    Each component is scaled by its eigenvalue; signs make its largest entry positive. by_rows takes the row count as
    the width of the grid, as maps of old releases have it.
    """
    k, width = columns * rows, rows if by_rows else columns
    grid = np.stack([np.arange(k) // width, np.arange(k) % width], 1).astype(float)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][: 1 if min(columns, rows) == 1 else 2]
    if len(order) == 1:
        grid = np.arange(k, dtype=float)[:, None]
    span = grid.max(0) - grid.min(0)
    grid = np.where(span > 0, 2 * (grid - grid.min(0)) / np.where(span > 0, span, 1) - 1, 0.0)
    w = np.tile(np.asarray(mean, float), (k, 1))
    for j, c in enumerate(order):
        v = vectors[:, c] * np.sign(vectors[np.argmax(np.abs(vectors[:, c])), c])
        w += grid[:, j : j + 1] * v * values[c]
    return np.round(w, 6)


@dataclass
class Training:
    """What a loop has: codebook, history of (phase, epoch, radius, quantization error)."""

    codebook: np.ndarray
    history: list[tuple[str, int, float, float]] = field(default_factory=list)


def train(samples: DataFrame, n: int, codebook: np.ndarray, grid: Grid, phases: list[Phase], kernel_name: str = "gaussian", missing: bool = False, previous_epoch: bool = True, skip_missing: bool = False, bootstrap_proportion: float | None = None, seed: int = 0, local_cells: int = 4_000_000) -> Training:
    """Train codebook on samples (sample_id, x). Null cells need missing=True.

    Complete samples: assign, then update. With missing cells the rough phase measures distance on present cells. The
    fine phase with previous_epoch fills a sample's gaps with the weights of the neuron it had last, varied by a factor of
    1 +- (radius - 1) / (first rough radius), and treats it as complete; without, it goes on as the rough phase.
    """
    h = kernel(kernel_name).array
    job = Training(np.asarray(codebook, float))
    total_radius = phases[0].first
    local = n * codebook.shape[1] <= local_cells
    if local:
        rows = samples.orderBy("sample_id").select("x", sample_hash(F.col("sample_id")).alias("h")).toPandas()
        x = np.array([[np.nan if v is None else v for v in r] for r in rows["x"]], float).reshape(len(rows), codebook.shape[1])
        state = _Local(x, rows["h"].to_numpy(np.int64), missing, skip_missing, seed)
    else:
        state = _Spread(samples.select("sample_id", "x"), n, missing, skip_missing, seed)
    for phase in phases:
        filling = missing and previous_epoch and phase.name == "fine"
        for epoch, radius in enumerate(phase.radii, 1):
            vary = (radius - 1) / total_radius if filling else None
            sums = state.epoch(job.codebook, vary, bootstrap_proportion)
            rows_ = sums[:, -2].sum()
            job.history.append((phase.name, epoch, float(radius), float(sums[:, -1].sum() / rows_) if rows_ else 0.0))
            job.codebook = smooth(sums, grid.weigh(lambda d, r=float(radius): h(d, r)), job.codebook)
    state.close()
    return job


def _noise(fill: np.ndarray, vary: float, seed: int, epoch: int, h: np.ndarray) -> np.ndarray:
    """fill (a row a sample) times 1 +- vary, by the hash of (seed, epoch, sample, cell): the same wherever it is computed."""
    at = xxhash64_longs(seed, epoch, h[:, None], np.arange(fill.shape[1])[None, :])
    share = (at.view(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
    return fill * (1 - vary + 2 * vary * share)


def _placed(x: np.ndarray, last: np.ndarray, w: np.ndarray, filling: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neurons and distances; when filling, gaps are measured as the weights of the neuron that the sample had last."""
    if not filling:
        return ranked(x, w)
    return ranked(np.where(np.isnan(x) & (last >= 0)[:, None], w[last], x), w)


def _used(x: np.ndarray, b: np.ndarray, w: np.ndarray, vary: float | None, seed: int, epoch: int, h: np.ndarray) -> np.ndarray:
    """What a sample counts as: with vary, its gaps are the varied weights of its neuron."""
    return x if vary is None else np.where(np.isnan(x) & (b >= 0)[:, None], _noise(w[b], vary, seed, epoch, h), x)


class _Local:
    def __init__(self, x, h, missing, skip_missing, seed):
        self.x, self.h, self.missing, self.skip, self.seed = x, h, missing, skip_missing, seed
        self.last, self.count = np.full(len(x), -1), 0

    def epoch(self, w, vary, draw):
        self.count += 1
        at = np.arange(len(self.x))
        if draw:
            order = np.lexsort((self.h, xxhash64_longs(self.seed, self.count, self.h)))
            at = np.sort(order[: int(draw * len(self.x))])
        x, h = self.x[at], self.h[at]
        vary = vary if self.count > 1 else None  # before, no sample has a neuron
        b, dist = _placed(x, self.last[at], w, vary is not None)
        self.last[at] = b
        return local_sums(_used(x, b, w, vary, self.seed, self.count, h), b, dist, len(w), self.skip)

    def close(self):
        pass


class _Spread:
    """Samples on the executors. With missing cells, each sample's last neuron is kept beside it, in a persisted table of its own epoch."""

    def __init__(self, samples, n, missing, skip_missing, seed):
        self.samples, self.n, self.missing, self.skip, self.seed = samples.withColumn("h", sample_hash(F.col("sample_id"))).persist(), n, missing, skip_missing, seed
        self.state = self.samples.withColumn("last", F.lit(-1)) if missing else None
        self.count, self.kept = 0, None

    def epoch(self, w, vary, draw):
        self.count += 1
        chosen = F.lit(True)
        if draw:
            hashes = self.samples.select(draw_hash(F.col("h"), self.seed, self.count).alias("draw"), "h")
            chosen = drawn(F.col("h"), self.seed, self.count, bootstrap_cut(hashes, int(draw * self.n)))
        if not self.missing:
            return voronoi_sums(self.samples.where(chosen), w, self.skip)
        # which samples take part is a column, so that the others keep what they have
        state = self.state.withColumn("drawn", chosen)
        sc = state.sparkSession.sparkContext
        held = sc.broadcast(w)
        seed, count, (k, d), skip = self.seed, self.count, w.shape, self.skip
        vary = vary if count > 1 else None

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                last = batch.column("last").to_numpy()
                b, dist = _placed(matrix(batch.column("x"), d), last, held.value, vary is not None)
                part = batch.column("drawn").to_numpy(zero_copy_only=False).astype(bool)
                now = pa.array(np.where(part, b, last).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("x"), now, pa.array(np.where(part, b, -1).astype(np.int32)), pa.array(dist, pa.float64())], names=["h", "x", "last", "b", "dist"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                b = batch.column("b").to_numpy()
                x = _used(matrix(batch.column("x"), d), b, held.value, vary, seed, count, batch.column("h").to_numpy())
                part = local_sums(x, b, batch.column("dist").to_numpy(), k, skip)
                total = part if total is None else total + part
            yield from sparse_rows(total)

        ready = state.mapInArrow(step, "h bigint, x array<double>, last int, b int, dist double")
        if self.count % 10 == 0 and sc._jsc.sc().getCheckpointDir().isDefined():
            ready = ready.checkpoint()
        ready = ready.persist()
        out = summed(ready.mapInArrow(sums, SPARSE), k, d)
        held.unpersist()
        self.state = ready.select("h", "x", "last")
        if self.kept is not None:
            self.kept.unpersist()
        self.kept = ready
        return out

    def close(self):
        self.samples.unpersist()
        if self.kept is not None:
            self.kept.unpersist()
