"""Neighbourhood kernels over grid distances, as columns and as numpy. The distance of the lattice is squared already."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a bubble leaves outside, so that no weight is zero.
FLOOR = 1e-12


@dataclass(frozen=True)
class Kernel:
    name: str
    column: Callable[[Column, float], Column]
    array: Callable[[np.ndarray, float], np.ndarray]


KERNELS: dict[str, Kernel] = {}


def register(kernel: Kernel) -> Kernel:
    """Make a kernel known by its name; a later one of the same name takes its place."""
    KERNELS[kernel.name] = kernel
    return kernel


def kernel(name: str) -> Kernel:
    if name not in KERNELS:
        raise ValueError(f"no kernel {name!r}; there are {sorted(KERNELS)}")
    return KERNELS[name]


register(Kernel("gaussian", lambda d, r: F.exp(-d / (2.0 * r * r)), lambda d, r: np.exp(-d / (2.0 * r * r))))
register(Kernel("bubble", lambda d, r: F.when(F.sqrt(d) <= r, 1.0).otherwise(0.0) + FLOOR, lambda d, r: np.where(np.sqrt(d) <= r, 1.0, 0.0) + FLOOR))
