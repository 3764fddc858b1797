"""Fit a map; use a fitted map."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as norm
from ..functions.kernels import kernel
from ..operators import cluster, evaluate, lattice, samples, umatrix
from ..operators.assign import bmu, matrix
from . import schedule
from .training import pca_codebook, random_codebook, train


@dataclass
class SelfOrganizingMap:
    """Settings of a map. fit() takes a table with one column a feature (numbers; null or NaN: missing) and a key column.

    map_size: (columns, rows), an int, or None for a size by the number of rows; odd rows are made even. mask: a value
    that stands for missing. pred_size: how many of the last features are labels. kernel and normalization: names known
    to functions.kernels and functions.normalize.
    """

    map_size: tuple[int, int] | int | None = None
    map_shape: str = "toroid"
    lattice: str = "hexa"
    normalization: str | None = "var"
    initialization: str = "random"
    kernel: str = "gaussian"
    training: str = "batch"
    name: str = "map"
    sample_id: str = "sample_id"
    features: list[str] | None = None
    units: list[str] | None = None
    mask: float | None = None
    missing: bool = False
    pred_size: int = 0
    dist_factor: float = 2
    seed: int = 0
    bootstrap: bool = False
    bootstrap_proportion: float = 0.8
    previous_epoch: bool = True
    missing_update: str = "zero"
    max_epochs: int = 1000
    epoch_factor: int = 1
    rough_epochs: int | None = None
    rough_first: float | None = None
    rough_last: float | None = None
    fine_epochs: int | None = None
    fine_first: float | None = None
    fine_last: float | None = None
    local_cells: int = 4_000_000

    def _check(self) -> None:
        if self.map_shape not in ("toroid", "planar"):
            raise ValueError("map_shape is toroid or planar")
        if self.lattice != "hexa":
            raise NotImplementedError("hexagonal lattices only")
        if self.training != "batch":
            raise NotImplementedError("batch training only")
        if self.initialization not in ("random", "pca"):
            raise ValueError("initialization is random or pca")
        if self.initialization == "pca" and self.missing:
            raise NotImplementedError("pca needs complete samples; use random with missing cells")
        if self.mask is not None and not self.missing:
            raise ValueError("a mask needs missing=True")
        if self.missing_update not in ("zero", "skip"):
            raise ValueError("missing_update is zero or skip")
        kernel(self.kernel)
        norm.normalizer(self.normalization)

    def fit(self, df: DataFrame, codebook: np.ndarray | None = None) -> SomModel:
        """Train on df; codebook: start from these normalized weights instead of an initialization."""
        if not isinstance(df, DataFrame):
            raise TypeError(f"a DataFrame is needed, not {type(df).__name__}")
        self._check()
        features = self.features or [c for c in df.columns if c != self.sample_id]
        if self.mask is not None:
            df = samples.mask(df, features, self.mask)
        stats = norm.feature_stats(df, features)
        gaps = stats.rows * len(features) - sum(stats.present)
        if not stats.rows:
            raise ValueError("no rows to train on")
        if gaps and not self.missing:
            raise ValueError(f"{gaps} cells are missing; set missing=True")
        if self.missing and not gaps:
            raise ValueError("missing=True, but no cell is missing")
        columns, rows = lattice.map_size(self.map_size, stats.rows)
        toroid = self.map_shape == "toroid"
        ready = norm.to_vector(norm.normalize(df, stats, self.normalization), self.sample_id, features)
        mean, std, low, high = (np.array(v, float) for v in (stats.mean, stats.safe_std, stats.low, stats.high))
        apply = norm.normalizer(self.normalization).apply_array
        if codebook is not None:
            start = np.asarray(codebook, float)
        elif self.initialization == "pca":
            start = pca_codebook(apply(mean, mean, std), _covariance(ready, len(features)), columns, rows)
        else:
            start = random_codebook(apply(low, mean, std), apply(high, mean, std), columns * rows, self.seed)
        opts = {"initialization": self.initialization, "factor": self.epoch_factor, "max_epochs": self.max_epochs}
        phases = [
            schedule.rough(columns, rows, stats.rows, epochs=self.rough_epochs, first=self.rough_first, last=self.rough_last, **opts),
            schedule.fine(columns, rows, stats.rows, epochs=self.fine_epochs, first=self.fine_first, last=self.fine_last, **opts),
        ]
        grid = lattice.Grid(columns, rows, toroid, self.dist_factor)
        job = train(ready, stats.rows, start, grid, phases, self.kernel, self.missing, self.previous_epoch, self.missing_update == "skip", self.bootstrap_proportion if self.bootstrap else None, self.seed, self.local_cells)
        return SomModel(self, features, stats, (columns, rows), job.codebook, [asdict(p) for p in phases], job.history)


def _covariance(ready: DataFrame, d: int) -> np.ndarray:
    """Sample covariance of complete samples: tasks sum products of normalized cells, and a hash aggregate merges their sums."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), d)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = np.zeros((d + 1, d + 1))
    for r in ready.select("x").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["s"]
    n = sums[d, d]
    if n < 2:
        return np.zeros((d, d))
    return (sums[:d, :d] - np.outer(sums[:d, d], sums[:d, d]) / n) / (n - 1)


def _small(table: DataFrame, rows: int, columns: int, most: int = 64 << 20) -> DataFrame:
    """table for a join, broadcast when its rows of so many numbers are at most `most` bytes; a larger map's table is joined as any other."""
    return F.broadcast(table) if rows * columns * 8 <= most else table


@dataclass
class SomModel:
    """A fitted map. Tables are lazy; nothing here changes the model or its input."""

    settings: SelfOrganizingMap
    features: list[str]
    stats: norm.Stats
    size: tuple[int, int]
    codebook: np.ndarray
    phases: list[dict] = field(default_factory=list)
    history: list[tuple] = field(default_factory=list)

    @property
    def toroid(self) -> bool:
        return self.settings.map_shape == "toroid"

    @property
    def weights(self) -> np.ndarray:
        """The codebook in the features' own units."""
        mean, std = np.array(self.stats.mean), np.array(self.stats.std)
        return norm.normalizer(self.settings.normalization).restore_array(self.codebook, mean, std)

    def vectors(self, df: DataFrame, features: list[str] | None = None) -> DataFrame:
        """(sample_id, x): df normalized by the training table's statistics; masked cells are missing."""
        features = features or self.features
        s = self.settings
        if s.mask is not None:
            df = samples.mask(df, features, s.mask)
        df = df.select(*{c: norm.quoted(c) for c in [s.sample_id, *features]}.values())
        return norm.to_vector(norm.normalize(df, self._part(features), s.normalization), s.sample_id, features)

    def _part(self, features: list[str]) -> norm.Stats:
        at = [self.features.index(f) for f in features]
        pick = lambda v: [v[i] for i in at]
        st = self.stats
        return norm.Stats(features, pick(st.mean), pick(st.std), pick(st.low), pick(st.high), pick(st.present), st.rows)

    def assign(self, df: DataFrame, features: list[str] | None = None, ranks: tuple[int, ...] = (1,)) -> DataFrame:
        """(sample_id, x) with the struct b of bmu and dist for the ranks. Works on streams. features: those that df has."""
        features = features or self.features
        w = self.codebook[:, [self.features.index(f) for f in features]]
        return self.vectors(df, features).withColumn("b", bmu(df.sparkSession, w, ranks)("x"))

    def neurons(self, spark: SparkSession) -> DataFrame:
        return umatrix.neurons_table(spark, self.weights, self.codebook, self.features, *self.size, self.toroid)

    def results(self, df: DataFrame) -> DataFrame:
        """One row a sample: sample_id, BMU, q_error, and its neuron's columns. Samples without cells have nulls."""
        a = self.assign(df).select("sample_id", F.col("b.bmu1").alias("BMU"), F.col("b.dist1").cast("float").alias("q_error"))
        n = self.neurons(df.sparkSession)
        joined = a.join(_small(n, len(self.codebook), len(n.columns)), "BMU", "left")
        return joined.select("sample_id", "BMU", "q_error", F.col("Udist").cast("float").alias("Udist"), *n.columns[2:])

    def project(self, df: DataFrame, with_labels: bool = False, features: list[str] | None = None, impute: bool = False) -> DataFrame:
        """Neuron columns of new rows, by the features they have. with_labels: leave the label features out of the search.

        impute: each feature is the row's own value, or its neuron's weight where it is missing or absent.
        """
        have = features or [f for f in self.features if f in df.columns]
        if with_labels and self.settings.pred_size:
            labels = set(self.features[-self.settings.pred_size :])
            have = [f for f in have if f not in labels]
        a = self.assign(df, have).select("sample_id", F.col("b.bmu1").alias("BMU"))
        n = self.neurons(df.sparkSession)
        table = a.join(_small(n, len(self.codebook), len(n.columns)), "BMU", "left").select("sample_id", "BMU", *n.columns[1:])
        if not impute:
            return table
        own = df.select(norm.quoted(self.settings.sample_id).alias("sample_id"), *[norm.quoted(f).cast("double").alias(f) for f in self.features if f in df.columns])
        value = lambda f: F.coalesce(norm.quoted(f), norm.quoted(f"B_{f}")) if f in df.columns else norm.quoted(f"B_{f}")
        return table.join(own, "sample_id").select("sample_id", "BMU", *[value(f).alias(f) for f in self.features])

    def impute(self, df: DataFrame, digits: int | None = 6) -> DataFrame:
        """df's features with missing cells from each row's neuron, restored and rounded; observed cells stay. digits None: each feature's own least decimals."""
        from ..functions.scalars import min_decimals, positive_zero

        filled = samples.fill_from_neuron(self.assign(df).select("sample_id", "x", F.col("b.bmu1").alias("bmu")), self.codebook)
        restore = norm.normalizer(self.settings.normalization).restore
        if digits is None:
            row = min_decimals(df, self.features).first()
            places = [row[f] or 0 for f in self.features]
        else:
            places = [digits] * len(self.features)
        cells = [positive_zero(F.round(restore(F.col("x")[i], m, s), p)).alias(f) for i, (f, m, s, p) in enumerate(zip(self.features, self.stats.mean, self.stats.std, places, strict=True))]
        return filled.select("sample_id", *cells)

    def representatives(self, df: DataFrame, projected: DataFrame | None = None) -> DataFrame:
        rows = self.vectors(df)
        if projected is not None:
            rows = rows.unionByName(self.vectors(projected))
        return samples.representatives(rows, self.codebook)

    def quality(self, df: DataFrame) -> DataFrame:
        """One row: quantization_error, topographic_error."""
        both = self.assign(df, ranks=(1, 2)).select(F.col("b.bmu1").alias("bmu1"), F.col("b.bmu2").alias("bmu2"), F.col("b.dist1").alias("dist"))
        return umatrix.quantization_error(both).crossJoin(umatrix.topographic_error(both, *self.size, self.toroid))  # one row each

    def cluster(self, df: DataFrame, labels: np.ndarray) -> DataFrame:
        """results() without q_error, with <k>_clusters."""
        k = len(np.unique(labels))
        c = df.sparkSession.createDataFrame([(i + 1, int(v)) for i, v in enumerate(labels)], f"BMU int, `{k}_clusters` int")
        return self.results(df).drop("q_error").join(_small(c, len(labels), 2), "BMU", "left")

    def kmeans(self, k: int = 3, **options) -> np.ndarray:
        return cluster.kmeans(self.codebook, k, **options)

    def davies_bouldin(self, spark: SparkSession, **options) -> DataFrame:
        return cluster.davies_bouldin_scan(spark, self.weights, **options)

    def evaluation(self, df: DataFrame, labels: list[str] | None = None, threshold: float | None = 0.5) -> DataFrame:
        """Rates per label of rows projected without their labels. threshold None: the best one of each label."""
        scored = self.scored(df, labels)
        if threshold is not None:
            return evaluate.rates(evaluate.confusion(scored, threshold))
        best = evaluate.best_threshold(evaluate.threshold_sweep(scored)).withColumnRenamed("label", "l")
        joined = scored.join(_small(best, len(labels or self.features), 2), F.col("label") == F.col("l")).withColumn("p", F.when(F.col("p") > F.col("threshold"), 1.0).otherwise(0.0))
        return evaluate.rates(evaluate.confusion(joined, 0.5)).join(best.withColumnRenamed("l", "label"), "label")

    def scored(self, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
        if not self.settings.pred_size:
            raise ValueError("the map has no labels; set pred_size")
        labels = labels or self.features[-self.settings.pred_size :]
        truth = df.select(norm.quoted(self.settings.sample_id).alias("sample_id"), *[norm.quoted(f) for f in labels])
        return evaluate.unpivot(self.project(df, with_labels=True), truth, "sample_id", labels)

    def params(self) -> dict:
        return json.loads(json.dumps({"settings": asdict(self.settings), "features": self.features, "size": self.size, "stats": asdict(self.stats), "phases": self.phases, "history": self.history}))
