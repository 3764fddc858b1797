from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexaloom.functions.normalize import feature_stats, normalize, to_vector
from hexaloom.functions.scalars import min_decimals, near_zero, xxhash64_longs
from hexaloom.operators import cluster, evaluate, lattice, plotdata, samples, umatrix
from hexaloom.operators.assign import assign, assign_sql, ranked, squared
from hexaloom.operators.update import smooth, voronoi_sums
from hexaloom.plans import schedule
from hexaloom.plans.estimator import SelfOrganizingMap
from hexaloom.plans.training import pca_codebook, train
from hexaloom.sources import store
from hexaloom.streaming.online import OnlineUpdate, place


def table(spark, x, names="abcdefgh"):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["sample_id long", *(f"{n} double" for n in names[: x.shape[1]])]))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 3, 6)])


def fit(spark, x, **options):
    settings = {"map_size": (6, 4), "rough_epochs": 8, "fine_epochs": 8, "seed": 1} | options
    return SelfOrganizingMap(**settings).fit(table(spark, x))


def test_distance_with_gaps_is_scaled_and_empty_rows_have_none():
    x, w = np.array([[1.0, np.nan, 3.0], [np.nan] * 3]), np.array([[0.0, 9.0, 0.0], [1.0, 1.0, 1.0]])
    assert np.allclose(squared(x, w)[0], [15.0, 6.0])
    b, d = ranked(x, w)
    assert b.tolist() == [1, -1] and math.isclose(d[0], math.sqrt(6)) and np.isnan(d[1])


def test_arrow_and_sql_assignments_agree(spark, points):
    x = points.copy()
    x[::7, 1] = np.nan
    x[5] = np.nan
    rows = to_vector(table(spark, x), "sample_id", list("abc"))
    w = points[::10]
    for nth in (1, 2):
        a = assign(rows, w, nth).orderBy("sample_id").toPandas()
        b = assign_sql(rows, w, nth).orderBy("sample_id").toPandas()
        assert a.bmu.fillna(-1).tolist() == b.bmu.fillna(-1).tolist()
        assert np.allclose(a.dist.fillna(-1), b.dist.fillna(-1), atol=1e-4)
    assert np.isnan(a.bmu[5])


def test_ties_go_to_the_lowest_neuron(spark):
    rows = spark.createDataFrame([(1, [0.5])], "sample_id long, x array<double>")
    assert assign(rows, np.array([[1.0], [0.0], [0.0]])).first().bmu == 1


def test_update_equals_numpy(spark, points):
    x = points.copy()
    x[3, 0] = np.nan
    rows = to_vector(table(spark, x), "sample_id", list("abc"))
    w = points[::20]
    b, _ = ranked(x, w)
    h = np.exp(-np.abs(np.subtract.outer(np.arange(6), np.arange(6))) / 2.0)
    zero = np.nan_to_num(x)
    s = np.array([zero[b == k].sum(0) for k in range(6)])
    n = np.array([(b == k).sum() for k in range(6)])
    assert np.allclose(smooth(voronoi_sums(rows, w), h, w), np.round(h @ s / (h @ n)[:, None], 6), atol=1.1e-6)
    c = np.array([(~np.isnan(x[b == k])).sum(0) for k in range(6)])
    assert np.allclose(smooth(voronoi_sums(rows, w, True), h, w), np.round(h @ s / (h @ c), 6), atol=1.1e-6)
    empty = rows.where("false")
    assert (smooth(voronoi_sums(empty, w), h, w) == np.round(w, 6)).all()


def test_schedule_of_the_published_run():
    rough = schedule.rough(24, 14, 18, factor=2)
    fine = schedule.fine(24, 14, 18, factor=2)
    assert (rough.epochs, rough.first, rough.last) == (1120, 8.0, 2.0)
    assert (fine.epochs, fine.first, fine.last) == (1868, 3.0, 1.0)
    assert schedule.rough(24, 14, 18, max_epochs=100, factor=2).epochs == 200
    assert schedule.constants(1, 10, 5) == (5.0, 20.0)


def test_imputed_value_of_the_published_run(spark):
    """Three normalized values restore to these in a column of 17 zeros and ones."""
    for ones, z, value in ((8, 1.283812, None), (9, -0.559764, None)):
        x = np.array([1.0] * ones + [0.0] * (17 - ones))
        value = round(z * x.std() + x.mean(), 6)
        stats = feature_stats(table(spark, x[:, None]), ["a"])
        assert round(z * stats.std[0] + stats.mean[0], 6) == value


def test_training_improves_and_both_ways_agree(spark, points):
    model = fit(spark, points)
    errors = [q for *_, q in model.history]
    assert errors[-1] < errors[0] and len(errors) == 16
    spread = fit(spark, points, local_cells=0)
    assert np.allclose(model.codebook, spread.codebook, atol=2e-5)
    quality = model.quality(table(spark, points)).first()
    assert quality.quantization_error < 0.5 and 0 <= quality.topographic_error <= 1


@pytest.mark.parametrize("local_cells", [10**6, 0])
@pytest.mark.parametrize("options", [{}, {"previous_epoch": False}, {"bootstrap": True}, {"missing_update": "skip"}])
def test_training_with_gaps(spark, points, local_cells, options):
    x = points.copy()
    x[::6, 2] = np.nan
    model = fit(spark, x, missing=True, local_cells=local_cells, rough_epochs=3, fine_epochs=3, **options)
    assert np.isfinite(model.codebook).all()
    full = model.impute(table(spark, x)).orderBy("sample_id").toPandas()[list("abc")].to_numpy()
    there = ~np.isnan(x)
    assert np.allclose(full[there], x[there], atol=1e-5) and np.isfinite(full).all()
    if not options:
        assert np.abs(full[::6, 2] - points[::6, 2]).mean() < 1.5


@pytest.mark.parametrize("options", [{"bootstrap": True}, {"missing": True}, {"missing": True, "bootstrap": True, "missing_update": "skip"}])
def test_draws_and_noise_do_not_depend_on_where_it_runs(spark, points, options):
    x = points.copy()
    if "missing" in options:
        x[::4, 2] = np.nan
        x[1::9, 0] = np.nan
    phases = [schedule.Phase("rough", 3, 3.0, 2.0), schedule.Phase("fine", 3, 2.5, 1.5)]
    vectors = to_vector(table(spark, x), "sample_id", list("abc")).repartition(3)
    start, grid = points[::5], lattice.Grid(6, 4, True)
    here, there = (train(vectors, 120, start, grid, phases, missing="missing" in options, skip_missing="missing_update" in options, bootstrap_proportion=0.7 if "bootstrap" in options else None, seed=5, local_cells=c) for c in (10**6, 0))
    assert np.abs(here.codebook - there.codebook).max() < 2e-5
    assert np.allclose([h[3] for h in here.history], [h[3] for h in there.history], atol=1e-5)
    other = train(vectors, 120, start, grid, phases, missing="missing" in options, bootstrap_proportion=0.7 if "bootstrap" in options else None, seed=6)
    assert np.abs(here.codebook - other.codebook).max() > 1e-3


def test_hashes_are_those_of_the_session(spark):
    values = np.array([0, 1, -1, 2**62, -(2**63)])
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").select(F.xxhash64(F.lit(7).cast("long"), "v").alias("h")).collect()
    assert [r.h for r in rows] == xxhash64_longs(7, values).tolist()


def test_bootstrap_draws_the_least_hashes(spark):
    ids = spark.range(3000).withColumnRenamed("id", "sample_id")
    got = sorted(r.sample_id for r in samples.bootstrap(ids, 0.35, 9, 4, 3000).collect())
    h = [r.h for r in ids.select(samples.sample_hash(F.col("sample_id")).alias("h")).collect()]
    order = sorted(range(3000), key=lambda i: (int(xxhash64_longs(9, 4, h[i])), h[i]))
    assert got == sorted(order[:1050])
    hashes = ids.select((F.col("sample_id") % 3).alias("draw"), F.col("sample_id").alias("h"))
    assert samples.bootstrap_cut(hashes, 1500, few=5) == (1, 3 * 499 + 1) and samples.bootstrap_cut(hashes, 0) is None
    assert samples.bootstrap(ids, 0.0, 1, 1, 3000).count() == 0
    with pytest.raises(ValueError):
        samples.bootstrap_cut(hashes, 3001)


def test_settings_are_checked(spark, points):
    x = points.copy()
    x[0, 0] = np.nan
    for bad, data in (({"missing": True}, points), ({}, x), ({"mask": -9.0}, points), ({"kernel": "none"}, points), ({"map_shape": "ball"}, points)):
        with pytest.raises(ValueError):
            fit(spark, data, **bad)
    for bad in ({"lattice": "rect"}, {"training": "seq"}):
        with pytest.raises(NotImplementedError):
            fit(spark, points, **bad)
    with pytest.raises(NotImplementedError):
        fit(spark, x, missing=True, initialization="pca")
    with pytest.raises(TypeError):
        SelfOrganizingMap().fit([[1.0]])
    with pytest.raises(ValueError):
        fit(spark, points[:0])


def test_mask_planar_bubble_pca_and_no_normalization(spark, points):
    x = points.copy()
    x[0, 0] = -9999
    assert np.isfinite(fit(spark, x, missing=True, mask=-9999.0, kernel="bubble", map_shape="planar").codebook).all()
    model = fit(spark, points, initialization="pca", normalization=None, map_size=(5, 3))
    assert model.size == (5, 4)
    assert model.project(table(spark, points)).count() == len(points)
    w = pca_codebook(np.zeros(2), np.diag([4.0, 1.0]), 3, 2)
    assert np.allclose(w[0], [-4, -1]) and np.allclose(w[-1], [4, 1])
    assert pca_codebook(np.zeros(2), np.diag([4.0, 1.0]), 1, 4).shape == (4, 2)


def test_constant_feature_and_repeated_rows(spark, points):
    x = np.concatenate([points[:5]] * 4)
    x[:, 1] = 7.0
    model = fit(spark, x)
    assert np.allclose(model.weights[:, 1], 7.0)
    assert model.results(table(spark, x)).count() == 20


def test_results_projection_and_tables(spark, points):
    df = table(spark, points)
    model = fit(spark, points)
    results = model.results(df)
    assert results.columns == ["sample_id", "BMU", "q_error", "Udist", "Ret_x", "Ret_y", "Cub_x", "Cub_y", "Cub_z", "B_a", "B_b", "B_c"]
    assert model.neurons(spark).count() == 24
    same = model.project(df).orderBy("sample_id").toPandas().BMU.tolist()
    assert same == results.orderBy("sample_id").toPandas().BMU.tolist()
    part = model.project(df.drop("c"), impute=True).orderBy("sample_id").toPandas()
    assert np.allclose(part[["a", "b"]], points[:, :2]) and np.abs(part.c - points[:, 2]).mean() < 1.0
    reps = model.representatives(df)
    assert reps.count() == len(points) and samples.representative_lists(reps).agg(F.sum(F.size("samples"))).first()[0] == len(points)
    hits = umatrix.hits(assign(model.vectors(df), model.codebook)).toPandas()
    assert hits.hits.sum() == len(points) and hits.radius.between(0.5, 2).all()


def test_clusters(spark, points):
    model = fit(spark, points)
    labels = model.kmeans(3, init="k-means++", seed=2)
    assert set(labels) == {1, 2, 3}
    assert "3_clusters" in model.cluster(table(spark, points), labels).columns
    scan = model.davies_bouldin(spark, max_clust=6, n_iter=3)
    assert scan.count() == 15 and cluster.minima_summary(scan).count() > 0
    square = np.array([[0, 0], [0, 1], [5, 0], [5, 1]], float)
    assert math.isclose(cluster.davies_bouldin(square, np.array([0, 0, 1, 1])), 0.2)
    assert cluster.davies_bouldin(square, np.zeros(4)) == 0.0
    out = cluster.outline(spark, np.ones(24, int), 6, 4).count()
    assert out == 144 - sum(len(s) for s in __import__("hexaloom.operators.lattice", fromlist=["x"]).neighbour_sets(6, 4, False))
    assert cluster.parts(spark, labels, 6, 4).count() == 24


def test_evaluation(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    p = np.round(np.clip(y * 0.3 + rng.random(200) * 0.7, 0, 1), 2)
    scored = spark.createDataFrame([("l", int(a), float(b)) for a, b in zip(y, p, strict=True)] + [("none", 0, 0.2)], "label string, truth int, p double")
    rows = {r.label: r for r in evaluate.rates(evaluate.confusion(scored)).collect()}
    assert rows["l"].TP == ((p > 0.5) & (y == 1)).sum() and rows["none"].sensitivity == 0.0
    area = {r.label: r.auc for r in evaluate.auc(evaluate.roc(scored)).collect()}["l"]
    pairs = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert math.isclose(area, pairs, rel_tol=1e-9)
    sweep = evaluate.threshold_sweep(scored).where("label = 'l'").orderBy("threshold").toPandas()
    t = np.arange(101) / 100
    assert np.allclose(sweep.fpr, [((p > v + 1e-9) & (y == 0)).sum() / (y == 0).sum() for v in t])
    assert np.allclose(sweep.fnr, [((p <= v + 1e-9) & (y == 1)).sum() / (y == 1).sum() for v in t])


def test_labels_of_a_semi_supervised_map(spark, points):
    x = np.concatenate([points, (points[:, :1] > 4.5).astype(float)], 1)
    model = fit(spark, x, pred_size=1)
    rows = model.evaluation(table(spark, x)).collect()
    assert rows[0].label == "d" and rows[0].accuracy > 80
    assert model.evaluation(table(spark, x), threshold=None).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(1.25, 1e-9), (2.5, -3.0)], "a double, b double")
    assert min_decimals(df, ["a"]).first().a == 0
    assert [r[0] for r in df.select(near_zero(F.col("b"))).collect()] == [0.0, -3.0]
    assert normalize(df, feature_stats(df, ["a"]), None).collect() == df.collect()


def test_store(spark, points, tmp_path):
    model = fit(spark, points)
    store.save(model, spark, f"{tmp_path}/m")
    again = store.load(spark, f"{tmp_path}/m")
    assert (again.codebook == model.codebook).all() and again.settings.name == "map_loaded"
    df = table(spark, points)
    assert again.results(df).exceptAll(model.results(df)).count() == 0
    assert "quantization error" in store.report(model, df)
    for fmt in store.FORMATS:
        store.write_table(df, f"{tmp_path}/{fmt}", fmt)
        assert store.read_samples(spark, f"{tmp_path}/{fmt}", fmt).count() == len(points)
    store.write_representatives(model.representatives(df), f"{tmp_path}/reps")
    assert spark.read.text(f"{tmp_path}/reps").first().value.startswith("BMU ")
    a = store.from_array(spark, np.array([[1.0, np.nan]]))
    assert a.columns == ["sample_id", "Var_1", "Var_2"] and a.first().Var_2 is None
    assert store.history(model, spark).count() == 16
    with pytest.raises((ImportError, ValueError)):
        store.write_workbook(df, f"{tmp_path}/x.xlsx", most_rows=1)
    assert store.numbered(df, "sample_id").columns[0] == "sample_id"


def test_plots(spark, points):
    model = fit(spark, points)
    plot = plotdata.umatrix_plot(spark, model.codebook, 6, 4)
    assert plot.count() == 24 * 4 and plotdata.umatrix_plot(spark, model.codebook, 6, 4, wrap=1).count() == (8 * 6) * 4
    assert plotdata.component_planes(spark, model.weights, model.features, 6, 4).count() == 72
    assert plotdata.torus_triangles(spark, 6, 4).count() == 48 and plotdata.template(spark, 6, 4).count() == 24
    assert plotdata.hit_marks(assign(model.vectors(table(spark, points)), model.codebook), 6, 4).count() > 0
    assert plotdata.cluster_plot(spark, model.kmeans(2), 6, 4, [1]).where("shown").count() > 0
    image = plotdata.svg([(r.cx, r.cy, r.value) for r in plot.collect()], texts=[(0, 0, "<a>")])
    assert image.count("<polygon") == 96 and "&lt;a&gt;" in image


def test_flags(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (2, 0), (None, 1)], "bmu int, flag int")
    assert sorted(tuple(r) for r in plotdata.flag_mode(rows).collect()) == [(1, 0), (2, 1)]
    assert [r[0] for r in spark.createDataFrame([(0.49,), (0.5,)], "p double").select(plotdata.binary(F.col("p"))).collect()] == [0, 1]


def test_streams(spark, points, tmp_path):
    model = fit(spark, points)
    df = table(spark, points)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = place(model, stream).writeStream.format("memory").queryName("placed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("placed").exceptAll(place(model, df)).count() == 0
    # rows that have moved: a share of the way to their own batch update, as numpy has it
    moved = points + 1.5
    table(spark, moved).write.parquet(f"{tmp_path}/moved")
    before, w = model.codebook.copy(), model.codebook
    x = np.array([r.x for r in model.vectors(table(spark, moved)).orderBy("sample_id").collect()])
    at = ((x[:, None] - w[None]) ** 2).sum(2).round(9).argmin(1)
    h = np.exp(-lattice.distance_array(*model.size, model.toroid, model.settings.dist_factor) / 2)
    new = np.round((h[:, at] @ x) / h[:, at].sum(1)[:, None], 6)
    q = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/moved").writeStream.foreachBatch(OnlineUpdate(model, share=0.5)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert np.abs(model.codebook - before).max() > 0.1
    assert np.abs(model.codebook - (before + new) / 2).max() < 1e-5


def test_scan_equals_a_plain_loop(spark, points):
    w = points[::6]
    got = {(r.iteration, r.k): r.dbi for r in cluster.davies_bouldin_scan(spark, w, max_clust=5, n_iter=3, seed=4).collect()}
    z = (w - w.mean(0)) / w.std(0)

    def index(labels):
        groups = [z[labels == k] for k in sorted(set(labels))]
        centres = [g.mean(0) for g in groups]
        spread = [np.mean([math.dist(p, c) for p in g]) for g, c in zip(groups, centres)]
        n = len(groups)
        return np.mean([max((spread[i] + spread[j]) / math.dist(centres[i], centres[j]) for j in range(n) if j != i) for i in range(n)])

    def plain(k, seed):
        rng, best = np.random.default_rng(seed), None
        for _ in range(5):
            centres = z[rng.choice(len(z), k, replace=False)]
            for _ in range(200):
                labels = np.array([min(range(k), key=lambda c: round(float(((p - centres[c]) ** 2).sum()), 9)) for p in z])
                new = np.array([z[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
                if np.array_equal(new, centres):
                    break
                centres = new
            cost = sum(float(((p - centres[c]) ** 2).sum()) for p, c in zip(z, labels))
            if best is None or cost < best[0]:
                best = cost, labels
        return index(best[1])

    assert set(got) == {(i, k) for i in (1, 2, 3) for k in range(2, 6)}
    assert all(math.isclose(v, plain(k, 4 + 1000 * i + k), rel_tol=1e-9) for (i, k), v in got.items())


def test_offsets_stand_for_all_pairs_of_neurons():
    rng = np.random.default_rng(2)
    for columns, rows, toroid, power in ((6, 4, True, 2), (7, 6, True, 2), (5, 6, False, 2), (1, 8, False, 2), (9, 2, True, 1)):
        d = lattice.distance_array(columns, rows, toroid, power)
        table = rng.random((columns * rows, 3))
        got = lattice.Grid(columns, rows, toroid, power).weigh(lambda x: np.exp(-x / 3)) @ table
        assert np.allclose(got, np.exp(-d / 3) @ table), (columns, rows, toroid)


def test_pca_covariance(spark, points):
    from hexaloom.plans.estimator import _covariance

    ready = to_vector(table(spark, points), "sample_id", list("abc")).repartition(3)
    assert np.allclose(_covariance(ready, 3), np.cov(points.T))
    assert not _covariance(ready.limit(1), 3).any()


def test_cluster_maps_with_labels_and_overlays(spark, points):
    model = fit(spark, points)
    labels = model.kmeans(3)
    hits = assign(model.vectors(table(spark, points)), model.codebook)
    rows = plotdata.cluster_plot(spark, labels, 6, 4, names={1: "ore", 3: "host rock"}, codebook=model.codebook, assigned=hits).collect()
    assert len(rows) == 24 and sum(r.hits for r in rows) == len(points)
    assert {(r.cluster, r.text) for r in rows} == {(1, "ore"), (2, "2"), (3, "host rock")}
    u = {r.neuron: r.u for r in umatrix.reduced(spark, model.codebook, 6, 4).collect()}
    assert all(math.isclose(r.u, u[r.neuron]) and (r.radius > 0) == (r.hits > 0) for r in rows)
    parts = plotdata.cluster_labels(spark, labels, 6, 4, {2: "till"}).collect()
    assert {r.cluster for r in parts} == {1, 2, 3} and all((r.text == "till") == (r.cluster == 2) for r in parts)


def test_charts(spark, tmp_path):
    scored = spark.createDataFrame([("l", i % 2, (i % 7) / 7 + 0.01 * i) for i in range(40)], "label string, truth int, p double")
    sweep = evaluate.threshold_sweep(scored)
    rows = sweep.orderBy("threshold").collect()
    assert all(math.isclose(r.accuracy, sum((p > r.threshold + 1e-9) == bool(y) for _, y, p in scored.collect()) / 40) for r in rows)
    best = evaluate.best_threshold(sweep).first().threshold
    gaps = [round(abs(round(100 * r.fnr, 2) - round(100 * r.fpr, 2)), 2) for r in rows]
    assert best == (rows[gaps.index(min(gaps))].threshold or 0.01)
    image = plotdata.threshold_chart(sweep, "l", best)
    assert image.count("<polyline") == 3 and image.count("<line") == 1
    assert plotdata.roc_chart(evaluate.roc(scored)).count("<polyline") == 1
    assert plotdata.index_chart(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 2, 0.6), (2, 3, 0.4)], "iteration int, k int, dbi double")).count("<polyline") == 3
    assert "&lt;" in plotdata.line_chart({"<": [(0, 1), (1, math.nan)]})
    store.write_svg(spark, image, f"file://{tmp_path}/svg")
    assert spark.read.text(f"file://{tmp_path}/svg", wholetext=True).first()[0].strip() == image


def test_workbooks(spark, tmp_path):
    import zipfile

    cell = lambda r, v: f'<c r="{r}"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{r}" t="s"><v>{v}</v></c>'
    sheet = "<row>" + cell("A1", 0) + cell("B1", 1) + cell("AA1", 2) + "</row><row>" + cell("A2", 3) + cell("B2", 1.5) + "</row><row></row><row>" + cell("B4", 2.0) + '<c r="AA4" t="inlineStr"><is><t>x</t></is></c></row>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si><si><t>D1</t></si></sst>')
    df = store.read_samples(spark, f"file://{tmp_path}/b.xlsx", "xlsx")
    assert df.dtypes == [("name", "string"), ("a", "double"), ("bc", "string")]
    assert [tuple(r) for r in df.collect()] == [("D1", 1.5, None), (None, 2.0, "x")]
    with pytest.raises(ValueError):
        store.read_workbook(spark, f"file://{tmp_path}/b.xlsx", most_bytes=10)


def test_models_from_tables_and_labels(spark, points, tmp_path):
    df = table(spark, points)
    model = fit(spark, points)
    again = store.from_tables(model.neurons(spark), df, model.settings, model.size)
    assert again.settings.name.endswith("_loaded") and np.abs(again.codebook - model.codebook).max() < 1e-5
    assert [r.BMU for r in again.results(df).orderBy("sample_id").collect()] == [r.BMU for r in model.results(df).orderBy("sample_id").collect()]
    with pytest.raises(ValueError):
        store.from_tables(model.neurons(spark).limit(3), df, model.settings, model.size)
    labels = plotdata.sample_labels(model.representatives(df), names=[3, 50])
    store.write_labels(labels, f"file://{tmp_path}/labels")
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/labels").collect()]
    assert len(lines) == labels.count() and all(x.startswith("BMU ") and (": 3(" in x or ": 50(" in x) for x in lines)
    # a pretrained start and a normalizer of one's own
    from hexaloom.functions import normalize as norm

    norm.register(norm.Normalizer("tenth", lambda c, m, s: c / 10, lambda c, m, s: c * 10, lambda x, m, s: x / 10, lambda x, m, s: x * 10))
    other = SelfOrganizingMap(map_size=(6, 4), rough_epochs=1, fine_epochs=1, normalization="tenth").fit(df, codebook=points[:24] / 10)
    assert np.abs(other.weights - other.codebook * 10).max() < 1e-9
    store.write_report(model, df, f"file://{tmp_path}/report")
    assert "quantization error" in spark.read.text(f"file://{tmp_path}/report", wholetext=True).first()[0]
    gaps = spark.createDataFrame([(1, None, 2.0), (2, 1.0, None)], "sample_id int, a double, b double")
    assert sorted(tuple(r) for r in samples.missing_cells(gaps, "sample_id", ["a", "b"]).collect()) == [(1, "a"), (2, "b")]


def test_numbers_by_the_order_of_a_column(spark):
    df = spark.createDataFrame([((i * 37) % 101, "a") for i in range(101)], "v int, part string").repartition(5)
    rows = store.numbered(df, "v", "S{}x", parts=7).orderBy("v").collect()
    assert [r.sample_id for r in rows] == [f"S{i + 1}x" for i in range(101)] and rows[0].part == "a"
    assert store.numbered(df.limit(0), "v").count() == 0
