"""Normalizers: from one row of statistics, columns to normalize and to restore features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """Mean, population deviation, least and greatest value, and count of present cells, by feature."""

    features: list[str]
    mean: list[float]
    std: list[float]
    low: list[float]
    high: list[float]
    present: list[int]
    rows: int

    @property
    def safe_std(self) -> list[float]:
        return [s or 1.0 for s in self.std]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def feature_stats(df: DataFrame, features: list[str]) -> Stats:
    """All statistics in one aggregation. Null and NaN cells are missing; a feature without cells has mean 0, deviation 0."""
    cells = {f: F.when(~F.isnan(quoted(f).cast("double")), quoted(f).cast("double")) for f in features}
    measures = [m(c).alias(f"{k}{i}") for i, c in enumerate(cells.values()) for k, m in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("z", F.max), ("n", F.count))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first()
    take = lambda k: [row[f"{k}{i}"] if row[f"{k}{i}"] is not None else 0.0 for i in range(len(features))]
    return Stats(features, take("m"), take("s"), take("a"), take("z"), [int(n) for n in take("n")], row["rows"])


@dataclass(frozen=True)
class Normalizer:
    """apply and restore take (column, mean, deviation); their twins take numpy arrays."""

    name: str | None
    apply: Callable[[Column, float, float], Column]
    restore: Callable[[Column, float, float], Column]
    apply_array: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    restore_array: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


NORMALIZERS: dict[str | None, Normalizer] = {}


def register(normalizer: Normalizer) -> Normalizer:
    NORMALIZERS[normalizer.name] = normalizer
    return normalizer


def normalizer(name: str | None) -> Normalizer:
    if name not in NORMALIZERS:
        raise ValueError(f"no normalizer {name!r}; there are {list(NORMALIZERS)}")
    return NORMALIZERS[name]


register(Normalizer("var", lambda c, m, s: F.round((c - m) / (s or 1.0), 10), lambda c, m, s: F.round(c * s + m, 10), lambda x, m, s: np.round((x - m) / np.where(s == 0, 1, s), 10), lambda x, m, s: np.round(x * s + m, 10)))
register(Normalizer(None, lambda c, m, s: c, lambda c, m, s: c, lambda x, m, s: x, lambda x, m, s: x))


def normalize(df: DataFrame, stats: Stats, name: str | None = "var") -> DataFrame:
    """df with its features normalized by stats, its own or another table's; other columns stay."""
    n = normalizer(name)
    at = {f: i for i, f in enumerate(stats.features)}
    return df.select(*[n.apply(quoted(c).cast("double"), stats.mean[at[c]], stats.std[at[c]]).alias(c) if c in at else quoted(c) for c in df.columns])


def denormalize(df: DataFrame, stats: Stats, name: str | None = "var", prefix: str = "") -> DataFrame:
    n = normalizer(name)
    at = {prefix + f: i for i, f in enumerate(stats.features)}
    return df.select(*[n.restore(quoted(c), stats.mean[at[c]], stats.std[at[c]]).alias(c) if c in at else quoted(c) for c in df.columns])


def to_vector(df: DataFrame, sample_id: str, features: list[str]) -> DataFrame:
    """(sample_id, x): features as one array, missing cells as nulls."""
    return df.select(quoted(sample_id).alias("sample_id"), F.array(*[F.when(~F.isnan(quoted(f).cast("double")), quoted(f).cast("double")) for f in features]).alias("x"))
