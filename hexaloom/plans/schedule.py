"""Training schedules: how many epochs, and the neighbourhood's radius in each."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Phase:
    name: str
    epochs: int
    first: float
    last: float

    @property
    def radii(self) -> np.ndarray:
        return np.linspace(self.first, self.last, self.epochs)


def constants(columns: int, rows: int, n: int) -> tuple[float, float]:
    """The map's length and its neurons per sample; for maps of one row or column half the length and ten times the ratio."""
    k = columns * rows
    long = max(columns, rows)
    return (long / 2, 10 * k / n) if min(columns, rows) == 1 else (float(long), k / n)


def rough(columns: int, rows: int, n: int, initialization: str = "random", factor: int = 1, max_epochs: int = 1000, epochs: int | None = None, first: float | None = None, last: float | None = None) -> Phase:
    """Rough training. epochs, first, last take the place of the rule's values; 0 counts as not given. max_epochs holds before factor."""
    ms, mpd = constants(columns, rows, n)
    first = first or max(1.0, math.ceil(ms / (8 if initialization == "pca" else 3)))
    return Phase("rough", (epochs or min(math.ceil(30 * mpd), max_epochs)) * factor, float(first), float(last or max(1.0, first / 4)))


def fine(columns: int, rows: int, n: int, initialization: str = "random", factor: int = 1, max_epochs: int = 1000, epochs: int | None = None, first: float | None = None, last: float | None = None) -> Phase:
    ms, mpd = constants(columns, rows, n)
    pca = initialization == "pca"
    first = first or max(1.0, math.ceil(ms / 8) / 4 if pca else ms / 8)
    return Phase("fine", (epochs or min(math.ceil((40 if pca else 50) * mpd), max_epochs)) * factor, float(first), float(last or (1.0 if pca else max(1.0, first / 25))))
