from __future__ import annotations

import math

import numpy as np

from hexaloom.llm.embeddings import embedding_links, unit


def brute(rows, least=0.93):
    n = len(rows)
    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= least] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(n)]
    return [len(x) for x in links], comp


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [(v + rng.normal(0, 0.08, 16)).tolist() for v in base for _ in range(4)]
    rows += [rows[0]] * 5 + [[0.0] * 16, None, [], [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1e300] * 16, [1e-300] * 16, [1.0, 2.0], [2.0, 4.0]]
    labels = [i % 2 for i in range(len(rows))]
    labels[3] = labels[7] = None
    table = [(i, v, l) for i, (v, l) in enumerate(zip(rows, labels, strict=True))]
    df = spark.createDataFrame([(*r, "c") for r in table], "vec_id long, embedding array<double>, label int, node string")
    n_links, comp = brute(table)
    for options in ({}, {"window": 16, "span": 32, "passes": 20}):
        got = {r.vec_id: r for r in embedding_links(df, **options).collect()}
        assert [got[i].component_id for i in range(len(rows))] == comp
        assert [got[i].n_links for i in range(len(rows))] == n_links
        assert [got[i].kept for i in range(len(rows))] == [c == i for i, c in enumerate(comp)]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    rows = embedding_links(df).collect()
    assert sorted(r.n_links for r in rows) == [2, 2, 2] and {r.component_id for r in rows} == {4}
    assert embedding_links(df.limit(0)).count() == 0


def test_wide_components(spark):
    """Points all over a sphere: chains of links, so that most of a component lies beyond half the angle of its first vector."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3).tolist(), 0) for i in range(150)]
    rows += [(150 + i, rows[i][1], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    n_links, comp = brute(rows)
    for window in (1024, 20):  # one block, or many
        got = {r.vec_id: r for r in embedding_links(df, window=window, span=64, passes=16).collect()}
        assert [got[i].component_id for i in range(170)] == comp
        assert [got[i].n_links for i in range(170)] == n_links


def test_links_beyond_all_windows(spark):
    """One pass and narrow windows: most links lie beyond them."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 16))
    rows = [(v + rng.normal(0, 0.15, 16)).tolist() for v in base for _ in range(4)]
    table = [(i, v, int(i > 140)) for i, v in enumerate(rows)] + [(160 + i, rng.standard_normal(3).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    n_links, comp = brute(table)
    for window in (2, 10):
        got = {r.vec_id: r for r in embedding_links(df, window=window, span=4 * window, passes=1).collect()}
        assert [got[i].component_id for i in range(len(table))] == comp
        assert [got[i].n_links for i in range(len(table))] == n_links


def test_recall_of_a_label_far_above_the_window(spark):
    """A label of 40 windows, a third of it in one group of close vectors: all links there are, as one matrix product finds them."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((500, 32))
    parts = [base[i % 500] + rng.normal(0, 0.12, 32) for i in range(1700)] + [base[0] + rng.normal(0, 0.05, 32) for _ in range(860)]
    units = np.stack([unit(v.tolist()) for v in parts])
    near = units @ units.T >= 0.93
    np.fill_diagonal(near, False)
    comp = np.arange(len(units))
    while True:
        low = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(units))])
        if (low == comp).all():
            break
        comp = low
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(parts)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_links(df, window=64, span=256, passes=4).collect()}
    assert near.sum() > 700_000
    assert [got[i].n_links for i in range(len(units))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(units))] == comp.tolist()
