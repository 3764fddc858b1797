from __future__ import annotations

import numpy as np
import pytest

from hexaloom.functions.kernels import FLOOR, Kernel, kernel, register
from hexaloom.operators import lattice


@pytest.mark.parametrize(("columns", "rows", "toroid"), [(6, 4, True), (6, 4, False), (5, 8, True), (2, 2, True), (7, 1, False)])
def test_distances_agree_with_numpy_and_are_a_metric(spark, columns, rows, toroid):
    d = lattice.distance_array(columns, rows, toroid)
    assert (d == d.T).all() and (np.diag(d) == 0).all()
    table = lattice.distances(spark, columns, rows, toroid).toPandas()
    assert len(table) == (columns * rows) ** 2
    assert (d[table.src, table.dst] == table.d).all()


def test_toroid_looks_the_same_from_every_neuron():
    d = lattice.distance_array(24, 14)
    assert len({tuple(sorted(r)) for r in d.tolist()}) == 1
    assert (d == 1).sum() == 6 * 24 * 14


def test_known_coordinates(spark):
    row = lattice.neurons(spark, 24, 14).where("neuron = 282").first()
    assert (row.ret_x, row.ret_y, row.cub_x, row.cub_y, row.cub_z) == (18, 11, 13, -24, 11)


def test_neighbours_are_symmetric_and_six(spark):
    sets = lattice.neighbour_sets(8, 6)
    assert all(len(s) == 6 for s in sets)
    assert all(a in sets[b] for a in range(48) for b in sets[a])
    table = lattice.neighbours(spark, 8, 6).toPandas()
    assert all(set(g.neighbour) == sets[n] for n, g in table.groupby("neuron"))
    d = lattice.distance_array(8, 6)
    assert all((d[a, b] == 1) == (b in sets[a]) for a in range(48) for b in range(48))
    planar = lattice.neighbours(spark, 8, 6, toroid=False).toPandas()
    assert all(set(g.neighbour) == lattice.neighbour_sets(8, 6, False)[n] for n, g in planar.groupby("neuron"))


def test_sizes():
    assert [lattice.expected_size(n) for n in (18, 500, 1500, 10000, 60000)] == [(5, 6), (11, 12), (14, 14), (22, 22), (35, 36)]
    assert lattice.map_size((5, 7), 1) == (5, 8) and lattice.map_size(5, 1) == (5, 6) and lattice.map_size(None, 18) == (5, 6)


def test_kernels():
    d = np.array([0.0, 1.0, 4.0, 9.0])
    assert np.allclose(kernel("gaussian").array(d, 2.0), np.exp(-d / 8))
    assert np.allclose(kernel("bubble").array(d, 2.0), [1 + FLOOR, 1 + FLOOR, 1 + FLOOR, FLOOR])
    with pytest.raises(ValueError):
        kernel("nothing")
    register(Kernel("flat", lambda c, r: c * 0 + 1.0, lambda a, r: np.ones_like(a)))
    assert kernel("flat").array(d, 1.0).sum() == 4
