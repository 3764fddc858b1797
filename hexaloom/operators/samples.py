"""Operators on samples: missing cells, imputation, representatives, bootstrap draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import quoted
from .assign import assign


def mask(df: DataFrame, features: list[str], value) -> DataFrame:
    """Cells equal to value become null."""
    return df.select(*[F.nullif(quoted(c), F.lit(value)).alias(c) if c in features else quoted(c) for c in df.columns])


def missing_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: rows, cells, missing cells, percent of cells missing."""
    gaps = sum((quoted(f).isNull().cast("long") for f in features), F.lit(0).cast("long"))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing"))
    cells = F.col("rows") * len(features)
    return agg.select("rows", cells.alias("cells"), "missing", F.when(cells > 0, F.round(100 * F.col("missing") / cells, 2)).otherwise(0.0).alias("percent"))


def missing_cells(df: DataFrame, sample_id: str, features: list[str]) -> DataFrame:
    """(sample_id, feature) of every missing cell."""
    each = df.select(quoted(sample_id).alias("sample_id"), F.explode(F.array(*[F.when(quoted(f).isNull(), F.lit(f)) for f in features])).alias("feature"))
    return each.where("feature IS NOT NULL")


def fill_from_neuron(assigned: DataFrame, codebook) -> DataFrame:
    """assigned (x, bmu) with missing cells of x replaced by the weights of its neuron; observed cells stay."""
    rows = [(k + 1, [float(v) for v in w]) for k, w in enumerate(codebook)]
    w = assigned.sparkSession.createDataFrame(rows, "bmu int, w array<double>")
    filled = F.when(F.col("w").isNull(), F.col("x")).otherwise(F.zip_with("x", "w", lambda a, b: F.coalesce(a, b)))
    w = F.broadcast(w) if np.asarray(codebook).nbytes <= 64 << 20 else w
    return assigned.join(w, "bmu", "left").withColumn("x", filled).select(*assigned.columns)


def representatives(samples: DataFrame, codebook) -> DataFrame:
    """(bmu, rank, sample_id, dist): the samples of each neuron, nearest first, ties by sample_id."""
    a = assign(samples, codebook).where("bmu IS NOT NULL")
    return a.select("bmu", F.row_number().over(Window.partitionBy("bmu").orderBy(F.round("dist", 9), "sample_id")).alias("rank"), "sample_id", "dist")


def representative_lists(ranked: DataFrame) -> DataFrame:
    """(bmu, samples): always an array, in rank order."""
    return ranked.groupBy("bmu").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample_id"))), lambda s: s.sample_id).alias("samples"))


def sample_hash(sample_id: Column) -> Column:
    """The number by which a sample is drawn and its noise is made."""
    return F.xxhash64(sample_id)


def draw_hash(of: Column, seed: int, epoch: int) -> Column:
    """Orders the samples of an epoch; of: their sample_hash()."""
    return F.xxhash64(F.lit(seed).cast("long"), F.lit(epoch).cast("long"), of)


def bootstrap_cut(hashes: DataFrame, most: int, few: int = 10_000) -> tuple[int, int] | None:
    """The most-th least row of hashes (draw, h), both longs; None for most = 0.

    Rows are counted by the first 16 bits of draw, then by the next ones within the stretch that holds the row sought, until few are
    left to be ordered: a table of 65,536 counts at most reaches the driver, and no task holds what is drawn.
    """
    if most < 1:
        return None
    left, need = hashes, most
    for shift in (48, 32, 16, 0):
        counts = sorted((r["at"], r["n"]) for r in left.groupBy(F.shiftright("draw", shift).alias("at")).agg(F.count("*").alias("n")).collect())
        for at, n in counts:
            if n >= need:
                break
            need -= n
        else:
            raise ValueError("fewer rows than are to be drawn")
        left = left.where(F.shiftright("draw", shift) == at)
        if n <= few:
            break
    row = left.orderBy("draw", "h").offset(need - 1).limit(1).first()
    return row["draw"], row["h"]


def drawn(of: Column, seed: int, epoch: int, cut: tuple[int, int] | None) -> Column:
    """Whether a sample takes part in an epoch; cut: bootstrap_cut() of that epoch."""
    if cut is None:
        return F.lit(False)
    draw = draw_hash(of, seed, epoch)
    return (draw < cut[0]) | ((draw == cut[0]) & (of <= cut[1]))


def bootstrap(samples: DataFrame, proportion: float, seed: int, epoch: int, n: int) -> DataFrame:
    """int(proportion * n) samples, those of least hash of (seed, epoch, sample_id); n: the table's rows. sample_id is unique; rows that share
    one are drawn together."""
    h = sample_hash(F.col("sample_id"))
    cut = bootstrap_cut(samples.select(draw_hash(h, seed, epoch).alias("draw"), h.alias("h")), math.floor(proportion * n))
    return samples.where(drawn(h, seed, epoch, cut))
