"""The registered map queries, and the SQL that gives the same rows.

Queries with a codebook take the first rows of their table as the codebook of an 8 x 6 toroid, so that SQL
can follow them. Every query runs over its whole table. Values are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import kernel
from ..functions.normalize import Stats, denormalize, feature_stats, normalize, to_vector
from ..functions.scalars import min_decimals
from ..operators import cluster, evaluate, lattice, plotdata, samples, umatrix
from ..operators.assign import assign, assign_sql, bmu
from ..operators.update import smooth, voronoi_sums

from .estimator import SelfOrganizingMap, SomModel
from .schedule import fine, rough

Query = Callable[[SparkSession, str], DataFrame]
C, R, K = 8, 6, 48
RADII = (2.5, 2.0, 1.5)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def known(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return known


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


# --- shared inputs -------------------------------------------------------------------------------

E = "e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
W0 = f"w0 AS (SELECT CAST(id AS INT) AS n, pos, v FROM e WHERE id < {K})"
CELL = f"cell AS (SELECT CAST(i AS INT) AS n, CAST(i % {C} AS INT) AS x, CAST(i // {C} AS INT) AS y FROM range({K}) t(i))"


def _grid(toroid: bool) -> str:
    xs, ys = (f"(VALUES (-{C}), (0), ({C}))", f"(VALUES (-{R}), (0), ({R}))") if toroid else ("(VALUES (0))", "(VALUES (0))")
    cx = lambda x, y, odd: f"({x} - ({y} - {odd}) / 2.0)"
    ax, bx = cx("a.x", "a.y", "a.y % 2"), cx("(b.x + ox.i)", "(b.y + oy.j)", "b.y % 2")
    steps = f"(abs({ax} - {bx}) + abs((-{ax} - a.y) - (-{bx} - (b.y + oy.j))) + abs(a.y - (b.y + oy.j))) / 2"
    return f"{CELL}, grid AS (SELECT a.n AS src, b.n AS dst, CAST(floor(pow(min({steps}), 2)) AS INT) AS d FROM cell a, cell b, {xs} ox(i), {ys} oy(j) GROUP BY 1, 2)"


GRID = _grid(True)
NEAR = f"""{CELL}, step AS (SELECT * FROM (VALUES (0,0,1,0),(0,1,0,1),(0,2,-1,1),(0,3,-1,0),(0,4,-1,-1),(0,5,0,-1),(1,0,1,0),(1,1,1,1),(1,2,0,1),(1,3,-1,0),(1,4,0,-1),(1,5,1,-1)) s(odd, k, dx, dy)),
near AS (SELECT n, k, CAST(((y + dy + {R}) % {R}) * {C} + (x + dx + {C}) % {C} AS INT) AS m FROM cell JOIN step ON y % 2 = odd)"""


def _search(k: int, missing: bool = False) -> str:
    """CTEs d, b (the nearest), r (ranks) of codebook k."""
    gap = "(e.v - w.v) * (e.v - w.v)"
    total = f"sum({gap}) * 64.0 / count(e.v)" if missing else f"sum({gap})"
    return f"d{k} AS (SELECT e.id, w.n, round({total}, 9) AS d2 FROM e JOIN w{k} w USING (pos) GROUP BY 1, 2), r{k} AS (SELECT id, n, d2, row_number() OVER (PARTITION BY id ORDER BY d2, n) AS rk FROM d{k}), b{k} AS (SELECT id, n, d2 FROM r{k} WHERE rk = 1)"


def _update(k: int, skip: bool = False) -> str:
    count = "count(e.v)" if skip else "count(*)"
    return f"s{k} AS (SELECT b.n, e.pos, sum(coalesce(e.v, 0)) AS s, {count} AS c FROM e JOIN b{k} b USING (id) GROUP BY 1, 2), w{k + 1} AS (SELECT g.dst AS n, s.pos, round(sum(exp(-g.d / (2.0 * {RADII[k]} * {RADII[k]})) * s.s) / sum(exp(-g.d / (2.0 * {RADII[k]} * {RADII[k]})) * s.c), 6) AS v FROM s{k} s JOIN grid g ON s.n = g.src GROUP BY 1, 2)"


def vectors(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    cell = (lambda v: F.when(F.abs(v) >= 0.05, v.cast("double"))) if gaps else (lambda v: v.cast("double"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", cell).alias("x"))


def first_codebook(spark: SparkSession, d: str) -> np.ndarray:
    rows = read(spark, d, "embeddings").where(F.col("vec_id") < K).select("vec_id", "embedding").collect()
    return np.array([r["embedding"] for r in sorted(rows)], np.float64)


def trained(spark: SparkSession, d: str, epochs: int, x: DataFrame | None = None, w: np.ndarray | None = None, skip: bool = False) -> np.ndarray:
    w = first_codebook(spark, d) if w is None else w
    x = vectors(spark, d) if x is None else x
    grid = lattice.distance_array(C, R)
    for radius in RADII[:epochs]:
        w = smooth(voronoi_sums(x, w, skip), kernel("gaussian").array(grid, radius), w)
    return w


def weights_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return umatrix.codebook_table(spark, w).select("neuron", F.posexplode("w").alias("pos", "weight")).select("neuron", "pos", r6(F.col("weight")).alias("weight"))


# --- sources, scalars, normalizers ---------------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, n, side AS columns, side + side % 2 AS rows FROM (SELECT n, CAST(round(sqrt(5 * sqrt(n))) AS INT) AS side FROM (SELECT count(*) AS n FROM {t}))" for t in TABLES))
def expected_mapsize(spark, d):
    counts = {t: read(spark, d, t).count() for t in TABLES}
    return spark.createDataFrame([(t, n, *lattice.expected_size(n)) for t, n in counts.items()], "tbl string, n long, columns int, rows int")


@query("SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS l_tax FROM lineitem")
def mask_to_missing(spark, d):
    return samples.mask(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), ["l_tax"], 0.0)


@query("SELECT count(*) AS rows, count(*) * 4 AS cells, count(*) FILTER (l_tax = 0) AS missing, round(100.0 * count(*) FILTER (l_tax = 0) / (count(*) * 4), 2) AS percent FROM lineitem")
def missing_profile(spark, d):
    return samples.missing_profile(samples.mask(read(spark, d, "lineitem"), ["l_tax"], 0.0), LINE)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 10), 6) + 0.0 AS {c}" for c in LINE) + " FROM lineitem")
def normalize_var(spark, d):
    df = read(spark, d, "lineitem")
    return normalize(df.select("l_orderkey", "l_linenumber", *LINE), feature_stats(df, LINE)).select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in LINE])


@query("SELECT s_suppkey, round((s_acctbal - m) / s, 6) + 0.0 AS s_acctbal FROM supplier, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def normalize_by_other(spark, d):
    stats = feature_stats(read(spark, d, "customer").select(F.col("c_acctbal").alias("s_acctbal")), ["s_acctbal"])
    return normalize(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), stats).select("s_suppkey", r6(F.col("s_acctbal")).alias("s_acctbal"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def denormalize_roundtrip(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    stats = feature_stats(df, ["c_acctbal"])
    return denormalize(normalize(df, stats), stats).select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT greatest(min(length(split_part(CAST(s_acctbal AS VARCHAR), '.', 2))) - 1, 0) AS s_acctbal FROM supplier")
def min_decimals_supplier(spark, d):
    return min_decimals(read(spark, d, "supplier"), ["s_acctbal"])


# --- lattice and kernels -------------------------------------------------------------------------


@query(f"WITH {CELL} SELECT n AS neuron, x AS ret_x, y AS ret_y, CAST(x - (y - y % 2) / 2.0 AS INT) AS cub_x, CAST(-(x - (y - y % 2) / 2.0) - y AS INT) AS cub_y, y AS cub_z, x + 0.5 * (y % 2) AS hex_x, round(y * sqrt(3.0) / 2, 6) AS hex_y FROM cell")
def lattice_neurons(spark, d):
    return lattice.neurons(spark, C, R).withColumn("hex_y", r6(F.col("hex_y")))


@query(f"WITH {GRID} SELECT src, dst, d FROM grid")
def grid_dist_toroid(spark, d):
    return lattice.distances(spark, C, R)


@query(f"WITH {_grid(False)} SELECT src, dst, d FROM grid")
def grid_dist_planar(spark, d):
    return lattice.distances(spark, C, R, toroid=False)


@query(f"WITH {NEAR} SELECT n AS neuron, k, m AS neighbour FROM near")
def neighbours_toroid(spark, d):
    return lattice.neighbours(spark, C, R)


@query(f"WITH {NEAR} SELECT n AS neuron, k, m AS neighbour FROM (SELECT cell.*, k, x + dx AS u, y + dy AS v, CAST((y + dy) * {C} + x + dx AS INT) AS m FROM cell JOIN step ON y % 2 = odd) WHERE u BETWEEN 0 AND {C - 1} AND v BETWEEN 0 AND {R - 1}")
def neighbours_planar(spark, d):
    return lattice.neighbours(spark, C, R, toroid=False)


@query(f"WITH {GRID} SELECT src, dst, round(exp(-d / 12.5), 6) AS h FROM grid")
def neighborhood_gaussian(spark, d):
    return lattice.distances(spark, C, R).select("src", "dst", r6(kernel("gaussian").column(F.col("d"), 2.5)).alias("h"))


@query(f"WITH {GRID} SELECT src, dst, CASE WHEN sqrt(d) <= 2 THEN 1.0 ELSE 0.0 END + 1e-12 > 0.5 AS inside FROM grid")
def neighborhood_bubble(spark, d):
    return lattice.distances(spark, C, R).select("src", "dst", (kernel("bubble").column(F.col("d"), 2.0) > 0.5).alias("inside"))


# --- best matching units -------------------------------------------------------------------------

_ASSIGNED = "SELECT id AS sample_id, n + 1 AS bmu, round(sqrt(d2), 6) AS dist FROM"


def shown(a: DataFrame) -> DataFrame:
    return a.select("sample_id", "bmu", r6(F.col("dist")).alias("dist"))


@query(f"WITH {E}, {W0}, {_search(0)} {_ASSIGNED} b0")
def bmu_assign(spark, d):
    return shown(assign(vectors(spark, d), first_codebook(spark, d)))


@query(f"WITH {E}, {W0}, {_search(0)} {_ASSIGNED} b0 WHERE n < 12 OR id >= 0")
def bmu_assign_native(spark, d):
    return shown(assign_sql(vectors(spark, d), first_codebook(spark, d)))


@query(f"WITH {E}, {W0}, {_search(0)} {_ASSIGNED} r0 WHERE rk = 2")
def bmu_second(spark, d):
    return shown(assign(vectors(spark, d), first_codebook(spark, d), nth=2))


_GAPS = f"full_e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), e AS (SELECT id, pos, CASE WHEN abs(v) >= 0.05 THEN v END AS v FROM full_e), w0 AS (SELECT CAST(id AS INT) AS n, pos, v FROM full_e WHERE id < {K})"


@query(f"WITH {_GAPS}, {_search(0, True)} {_ASSIGNED} b0 WHERE d2 IS NOT NULL")
def bmu_missing(spark, d):
    return shown(assign(vectors(spark, d, gaps=True), first_codebook(spark, d))).where("bmu IS NOT NULL")


@query(f"WITH {E}, {W0}, {_search(0)}, h AS (SELECT n + 1 AS bmu, count(*) AS hits FROM b0 GROUP BY 1) SELECT bmu, hits, round(CASE WHEN max(hits) OVER () > min(hits) OVER () THEN (hits - min(hits) OVER ()) * 1.5 / (max(hits) OVER () - min(hits) OVER ()) + 0.5 ELSE 0.5 END, 6) AS radius FROM h")
def bmu_hits(spark, d):
    return umatrix.hits(assign(vectors(spark, d), first_codebook(spark, d))).withColumn("radius", r6(F.col("radius")))


# --- training steps ------------------------------------------------------------------------------


@query(f"WITH {E}, {W0}, {GRID}, {_search(0)}, {_update(0)} SELECT n AS neuron, CAST(pos - 1 AS INT) AS pos, round(s, 6) + 0.0 AS s, c AS n FROM s0")
def voronoi_sums_query(spark, d):
    sums = voronoi_sums(vectors(spark, d), first_codebook(spark, d))
    dim = (sums.shape[1] - 2) // 2
    rows = [(k, j, float(sums[k, j]), int(sums[k, dim + j])) for k in range(K) if sums[k, -2] for j in range(dim)]
    return spark.createDataFrame(rows, "neuron int, pos int, s double, n long").withColumn("s", r6(F.col("s")))


_WEIGHTS = "SELECT n AS neuron, CAST(pos - 1 AS INT) AS pos, v + 0.0 AS weight FROM"


@query(f"WITH {E}, {W0}, {GRID}, {_search(0)}, {_update(0)} {_WEIGHTS} w1")
def batch_update_1(spark, d):
    return weights_table(spark, trained(spark, d, 1))


_THREE = ", ".join(f"{_search(k)}, {_update(k)}" for k in range(3))


@query(f"WITH {E}, {W0}, {GRID}, {_THREE} {_WEIGHTS} w3")
def batch_update_3(spark, d):
    return weights_table(spark, trained(spark, d, 3))


@query(f"WITH {_GAPS}, {GRID}, {_search(0, True)}, {_update(0)} {_WEIGHTS} w1")
def batch_update_missing(spark, d):
    return weights_table(spark, trained(spark, d, 1, vectors(spark, d, gaps=True)))


@query(f"WITH {_GAPS}, {GRID}, {_search(0, True)}, {_update(0, True)} {_WEIGHTS} w1")
def batch_update_skip(spark, d):
    return weights_table(spark, trained(spark, d, 1, vectors(spark, d, gaps=True), skip=True))


@query(f"WITH {E}, {W0}, {_search(0)} SELECT round(avg(sqrt(d2)), 6) AS quantization_error FROM b0")
def quantization_error(spark, d):
    return umatrix.quantization_error(assign(vectors(spark, d), first_codebook(spark, d))).select(r6(F.col("quantization_error")).alias("quantization_error"))


@query(f"WITH {E}, {W0}, {NEAR}, {_search(0)}, p AS (SELECT a.id, a.n AS n1, b.n AS n2 FROM r0 a JOIN r0 b USING (id) WHERE a.rk = 1 AND b.rk = 2) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.n = n1 AND near.m = n2) THEN 0.0 ELSE 1.0 END), 6) AS topographic_error FROM p")
def topographic_error(spark, d):
    found = bmu(spark, first_codebook(spark, d), (1, 2))
    pairs = vectors(spark, d).select(found("x").alias("b")).select(F.col("b.bmu1").alias("bmu1"), F.col("b.bmu2").alias("bmu2"))
    return umatrix.topographic_error(pairs, C, R).select(r6(F.col("topographic_error")).alias("topographic_error"))


@query()
def som_train_flagship(spark, d):
    df = feature_columns(spark, d)
    model = SelfOrganizingMap(map_size=(C, R), seed=7).fit(df)
    return model.results(df)


@query()
def som_train_missing(spark, d):
    df = read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.expr("CASE WHEN p_partkey % 10 > 0 THEN CAST(p_size AS DOUBLE) END").alias("size"), F.col("p_retailprice").alias("price"))
    model = SelfOrganizingMap(map_size=(C, R), missing=True, rough_epochs=5, fine_epochs=5, seed=7).fit(df)
    return model.impute(df)


@query("SELECT CAST(floor(0.8 * count(*)) AS BIGINT) AS drawn, CAST(floor(0.8 * count(*)) AS BIGINT) AS different FROM orders")
def bootstrap_sample(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return samples.bootstrap(ids, 0.8, 7, 1, ids.count()).agg(F.count("*").alias("drawn"), F.countDistinct("sample_id").alias("different"))


# --- U-matrix, tables, plots ---------------------------------------------------------------------

_U = f"WITH {E}, {W0}, {NEAR}, u AS (SELECT near.n, k, m, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM near JOIN w0 a ON a.n = near.n JOIN w0 b ON b.n = m AND b.pos = a.pos GROUP BY 1, 2, 3)"


@query(f"{_U} SELECT n AS neuron, k, m AS neighbour, round(d, 6) AS d FROM u")
def umatrix_expanded(spark, d):
    return umatrix.expanded(spark, first_codebook(spark, d), C, R).withColumn("d", r6(F.col("d")))


@query(f"{_U} SELECT n AS neuron, round(avg(d), 6) AS u FROM u GROUP BY 1")
def umatrix_reduced(spark, d):
    return umatrix.reduced(spark, first_codebook(spark, d), C, R).withColumn("u", r6(F.col("u")))


@query(f"{_U} SELECT n AS neuron, round(ln(avg(d)), 6) AS u FROM u GROUP BY 1")
def umatrix_log(spark, d):
    return umatrix.reduced(spark, first_codebook(spark, d), C, R, log=True).withColumn("u", r6(F.col("u")))


_N = f"{_U}, r AS (SELECT n, avg(d) AS u FROM u GROUP BY 1), nt AS (SELECT n + 1 AS BMU, round((u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()), 6) AS Udist, x AS Ret_x, y AS Ret_y, CAST(x - (y - y % 2) / 2.0 AS INT) AS Cub_x, CAST(-(x - (y - y % 2) / 2.0) - y AS INT) AS Cub_y, y AS Cub_z, (SELECT round(v, 6) FROM w0 WHERE w0.n = r.n AND pos = 1) + 0.0 AS B_f0, (SELECT round(v, 6) FROM w0 WHERE w0.n = r.n AND pos = 2) + 0.0 AS B_f1 FROM r JOIN cell USING (n))"


def neurons_of(spark, d) -> DataFrame:
    w = first_codebook(spark, d)
    names = [f"f{i}" for i in range(w.shape[1])]
    return umatrix.neurons_table(spark, w, w, names, C, R).withColumn("Udist", r6(F.col("Udist"))).select("BMU", "Udist", "Ret_x", "Ret_y", "Cub_x", "Cub_y", "Cub_z", r6(F.col("B_f0")).alias("B_f0"), r6(F.col("B_f1")).alias("B_f1"))


@query(f"{_N} SELECT * FROM nt")
def neurons_table(spark, d):
    return neurons_of(spark, d)


def fixed_model(spark, d) -> SomModel:
    """A model of the fixed codebook, without normalization, for samples with columns f0 to f63."""
    w = first_codebook(spark, d)
    names = [f"f{i}" for i in range(w.shape[1])]
    n = len(names)
    return SomModel(SelfOrganizingMap(map_size=(C, R), normalization=None), names, Stats(names, [0.0] * n, [1.0] * n, [0.0] * n, [0.0] * n, [0] * n, 0), (C, R), w)


def feature_columns(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])


_UDIST = "(u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ())"


@query(f"{_N.replace(f'round({_UDIST}, 6)', f'CAST({_UDIST} AS FLOAT)')}, {_search(0)} SELECT id AS sample_id, CAST(sqrt(d2) AS FLOAT) AS q_error, nt.* FROM b0 JOIN nt ON BMU = n + 1")
def results_table(spark, d):
    rows = fixed_model(spark, d).results(feature_columns(spark, d))
    return rows.select("sample_id", "q_error", "BMU", "Udist", "Ret_x", "Ret_y", "Cub_x", "Cub_y", "Cub_z", "B_f0", "B_f1")


_STEPS = "CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE -0.5 END", "CASE k WHEN 0 THEN 0.0 ELSE sqrt(3.0) / 2 END"


@query(f"{_U} SELECT n AS neuron, 'neuron' AS kind, 2 * (x + 0.5 * (y % 2)) AS cx, round(y * sqrt(3.0), 6) AS cy, round(avg(d), 6) AS value FROM u JOIN cell USING (n) GROUP BY n, x, y UNION ALL SELECT n, 'side' || k, round(2 * (x + 0.5 * (y % 2)) + {_STEPS[0]}, 6), round(y * sqrt(3.0) + {_STEPS[1]}, 6), round(d, 6) FROM u JOIN cell USING (n) WHERE k < 3")
def umatrix_plot_data(spark, d):
    return plotdata.umatrix_plot(spark, first_codebook(spark, d), C, R).select("neuron", "kind", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), r6(F.col("value")).alias("value"))


@query(f"WITH {E}, {W0}, {CELL} SELECT 'f' || (pos - 1) AS feature, CAST((pos - 1) // 16 AS INT) AS page, CAST((pos - 1) % 16 AS INT) AS cell, n AS neuron, x + 0.5 * (y % 2) AS cx, round(y * sqrt(3.0) / 2, 6) AS cy, round(v, 6) + 0.0 AS value FROM w0 JOIN cell USING (n)")
def component_planes(spark, d):
    w = first_codebook(spark, d)
    return plotdata.component_planes(spark, w, [f"f{i}" for i in range(w.shape[1])], C, R).withColumn("cy", r6(F.col("cy"))).withColumn("value", r6(F.col("value")))


@query(f"WITH {CELL} SELECT n AS neuron, round((1 + 0.4 * cos(2 * pi() * y / {R})) * cos(2 * pi() * (x + 0.5 * (y % 2)) / {C}), 6) + 0.0 AS x, round((1 + 0.4 * cos(2 * pi() * y / {R})) * sin(2 * pi() * (x + 0.5 * (y % 2)) / {C}), 6) + 0.0 AS y, round(0.4 * sin(2 * pi() * y / {R}), 6) + 0.0 AS z FROM cell")
def torus_coords(spark, d):
    return plotdata.torus(spark, C, R).select("neuron", *[r6(F.col(c)).alias(c) for c in "xyz"])


# --- imputation, projection, representatives -----------------------------------------------------


@query(f"WITH {_GAPS}, {_search(0, True)} SELECT e.id AS sample_id, CAST(e.pos - 1 AS INT) AS pos, round(w.v, 6) + 0.0 AS value FROM e JOIN b0 ON e.id = b0.id AND b0.d2 IS NOT NULL JOIN w0 w ON w.n = b0.n AND w.pos = e.pos WHERE e.v IS NULL")
def impute_bmu(spark, d):
    w = first_codebook(spark, d)
    a = assign(vectors(spark, d, gaps=True), w).withColumnRenamed("x", "own").withColumn("x", F.col("own")).where("bmu IS NOT NULL")
    full = samples.fill_from_neuron(a, w)
    return full.select("sample_id", F.posexplode(F.arrays_zip("own", "x")).alias("pos", "v")).where("v.own IS NULL").select("sample_id", "pos", r6(F.col("v.x")).alias("value"))


@query(f"WITH full_e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), e AS (SELECT * FROM full_e WHERE pos <= 60), w0 AS (SELECT CAST(id AS INT) AS n, pos, v FROM full_e WHERE id < {K}), {_search(0)} SELECT b0.id AS sample_id, b0.n + 1 AS bmu, CAST(w.pos - 1 AS INT) AS pos, round(w.v, 6) + 0.0 AS predicted FROM b0 JOIN w0 w ON w.n = b0.n AND w.pos > 60")
def project_partial(spark, d):
    w = first_codebook(spark, d)
    part = vectors(spark, d).select("sample_id", F.slice("x", 1, 60).alias("x"))
    a = assign(part, w[:, :60])
    n = umatrix.codebook_table(spark, w).select((F.col("neuron") + 1).alias("bmu"), "w")
    rows = a.join(F.broadcast(n), "bmu").select("sample_id", "bmu", F.posexplode("w").alias("pos", "v")).where("pos >= 60")  # 48 neurons
    return rows.select("sample_id", "bmu", "pos", r6(F.col("v")).alias("predicted"))


@query(f"WITH {E}, {W0}, {_search(0)} SELECT n + 1 AS bmu, CAST(row_number() OVER (PARTITION BY n ORDER BY round(sqrt(d2), 9), id) AS INT) AS rank, id AS sample_id FROM b0")
def rep_samples(spark, d):
    return samples.representatives(vectors(spark, d), first_codebook(spark, d)).select("bmu", "rank", "sample_id")


@query(f"WITH {E}, {W0}, {_search(0)}, ranked AS (SELECT n + 1 AS bmu, row_number() OVER (PARTITION BY n ORDER BY round(sqrt(d2), 9), id) AS rk, id, count(*) OVER (PARTITION BY n) AS total FROM b0) SELECT bmu, id || '(' || rk || '/' || total || ')' AS text FROM ranked WHERE rk = 1")
def sample_labels(spark, d):
    return plotdata.sample_labels(samples.representatives(vectors(spark, d), first_codebook(spark, d)))


# --- clusters ------------------------------------------------------------------------------------


def _kmeans_sql(k: int, rounds: int) -> str:
    out = [f"c0 AS (SELECT n AS c, pos, v FROM w0 WHERE n < {k})"]
    for i in range(rounds + 1):
        out.append(f"l{i} AS (SELECT n, c FROM (SELECT p.n, c.c, row_number() OVER (PARTITION BY p.n ORDER BY round(sum((p.v - c.v) * (p.v - c.v)), 9), c.c) AS rk FROM w0 p JOIN c{i} c USING (pos) GROUP BY 1, 2) WHERE rk = 1)")
        if i < rounds:
            out.append(f"c{i + 1} AS (SELECT c, pos, avg(v) AS v FROM w0 JOIN l{i} USING (n) GROUP BY 1, 2 UNION ALL SELECT c, pos, v FROM c{i} WHERE c NOT IN (SELECT c FROM l{i}))")
    return ", ".join(out)


KM = _kmeans_sql(4, 5)


def fixed_labels(spark, d) -> np.ndarray:
    w = first_codebook(spark, d)
    return cluster.lloyd(w, w[:4], 5)[0]


@query(f"WITH {E}, {W0}, {KM} SELECT n AS neuron, c + 1 AS cluster FROM l5")
def kmeans_fixed(spark, d):
    return spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(fixed_labels(spark, d))], "neuron int, cluster int")


@query(f"WITH {E}, {W0}, {KM}, m AS (SELECT c, pos, avg(v) AS v FROM w0 JOIN l5 USING (n) GROUP BY 1, 2), s AS (SELECT c, avg(g) AS s FROM (SELECT n, l5.c, sqrt(sum((w0.v - m.v) * (w0.v - m.v))) AS g FROM w0 JOIN l5 USING (n) JOIN m ON m.c = l5.c AND m.pos = w0.pos GROUP BY 1, 2) GROUP BY 1), q AS (SELECT a.c, max((sa.s + sb.s) / g) AS worst FROM (SELECT a.c, b.c AS o, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS g FROM m a JOIN m b ON a.pos = b.pos AND a.c <> b.c GROUP BY 1, 2) a JOIN s sa ON sa.c = a.c JOIN s sb ON sb.c = a.o GROUP BY 1) SELECT round(avg(worst), 6) AS dbi FROM q")
def davies_bouldin(spark, d):
    return spark.createDataFrame([(cluster.davies_bouldin(first_codebook(spark, d), fixed_labels(spark, d)),)], "dbi double").select(r6(F.col("dbi")).alias("dbi"))


@query(f"WITH {E}, {W0}, {_search(0)}, {KM} SELECT id AS sample_id, b0.n + 1 AS bmu, c + 1 AS cluster FROM b0 JOIN l5 ON l5.n = b0.n")
def cluster_results(spark, d):
    a = assign(vectors(spark, d), first_codebook(spark, d))
    c = spark.createDataFrame([(i + 1, int(v) + 1) for i, v in enumerate(fixed_labels(spark, d))], "bmu int, cluster int")
    return a.join(F.broadcast(c), "bmu").select("sample_id", "bmu", "cluster")  # 48 neurons


@query(f"WITH {E}, {W0}, {NEAR}, {KM}, inside AS (SELECT cell.n, k, CAST((y + dy) * {C} + x + dx AS INT) AS m FROM cell JOIN step ON y % 2 = odd WHERE x + dx BETWEEN 0 AND {C - 1} AND y + dy BETWEEN 0 AND {R - 1}) SELECT a.c + 1 AS cluster, cell.n AS neuron, step.k FROM cell JOIN step ON y % 2 = odd JOIN l5 a ON a.n = cell.n WHERE NOT EXISTS (SELECT 1 FROM inside i JOIN l5 b ON b.n = i.m WHERE i.n = cell.n AND i.k = step.k AND b.c = a.c)")
def cluster_outline(spark, d):
    return cluster.outline(spark, fixed_labels(spark, d) + 1, C, R)


_SERIES = "s AS (SELECT CAST(o_custkey % 7 AS INT) AS iteration, CAST(month(o_orderdate) AS INT) AS k, round(avg(o_totalprice), 2) AS dbi FROM orders GROUP BY 1, 2)"


def series(spark, d) -> DataFrame:
    return read(spark, d, "orders").groupBy((F.col("o_custkey") % 7).cast("int").alias("iteration"), F.month("o_orderdate").alias("k")).agg(F.round(F.avg("o_totalprice"), 2).alias("dbi"))


@query(f"WITH {_SERIES}, t AS (SELECT *, lag(dbi) OVER w AS a, lead(dbi) OVER w AS b FROM s WINDOW w AS (PARTITION BY iteration ORDER BY k)) SELECT iteration, k, dbi, CAST(row_number() OVER (PARTITION BY iteration ORDER BY dbi, k) AS INT) AS place FROM t WHERE coalesce(dbi < a, true) AND coalesce(dbi < b, true)")
def local_minima(spark, d):
    return cluster.local_minima(series(spark, d))


@query(f"WITH {_SERIES} SELECT k, round(avg(dbi), 4) AS mean, round(quantile_cont(dbi, 0.25), 4) AS q25, round(quantile_cont(dbi, 0.75), 4) AS q75 FROM s GROUP BY 1")
def index_by_k(spark, d):
    return cluster.index_by_k(series(spark, d)).select("k", *[F.round(c, 4).alias(c) for c in ("mean", "q25", "q75")])


# --- evaluation ----------------------------------------------------------------------------------

_SCORED = "p AS (SELECT label, truth, n_chars % 101 / 100.0 AS p FROM documents JOIN (SELECT doc_id, 'quality' AS label, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) USING (doc_id))"


def scored(spark, d) -> DataFrame:
    both = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 101 / 100).alias("p")).join(read(spark, d, "labels"), "doc_id")
    return both.select(F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("truth")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("truth")))).alias("v"), "p").select("v.*", "p")


@query(f"WITH {_SCORED}, c AS (SELECT label, count(*) FILTER (truth = 0 AND p <= 0.5) AS TN, count(*) FILTER (truth = 1 AND p <= 0.5) AS FN, count(*) FILTER (truth = 1 AND p > 0.5) AS TP, count(*) FILTER (truth = 0 AND p > 0.5) AS FP FROM p GROUP BY 1) SELECT *, TP + FN AS total_positives, round(100.0 * TP / (TP + FN), 2) AS sensitivity, round(100.0 * TN / (TN + FP), 2) AS specificity, round(100.0 * TP / (TP + FN), 2) AS recall, round(100.0 * FP / (FP + TN), 2) AS fpr, round(100.0 * FN / (FN + TP), 2) AS fnr, round(100.0 * (TP + TN) / (TP + TN + FP + FN), 2) AS accuracy, round(100.0 * TP / (TP + FP), 2) AS precision FROM c")
def confusion_report(spark, d):
    return evaluate.rates(evaluate.confusion(scored(spark, d), 0.5))


_SWEEP = f"{_SCORED}, t AS (SELECT i / 100.0 AS threshold FROM range(101) r(i)), sw AS (SELECT label, threshold, count(*) FILTER (truth = 1 AND p <= threshold + 1e-9) * 1.0 / count(*) FILTER (truth = 1) AS fnr, count(*) FILTER (truth = 0 AND p > threshold + 1e-9) * 1.0 / count(*) FILTER (truth = 0) AS fpr, count(*) FILTER ((truth = 1) = (p > threshold + 1e-9)) * 1.0 / count(*) AS accuracy FROM p, t GROUP BY 1, 2)"


@query(f"WITH {_SWEEP} SELECT label, threshold, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr, round(accuracy, 6) AS accuracy FROM sw")
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(scored(spark, d)).select("label", "threshold", *[r6(F.col(c)).alias(c) for c in ("fnr", "fpr", "accuracy")])


@query(f"WITH {_SWEEP} SELECT label, CASE WHEN threshold = 0 THEN 0.01 ELSE threshold END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(abs(round(100 * fnr, 2) - round(100 * fpr, 2)), 2), threshold) AS rk FROM sw) WHERE rk = 1")
def best_threshold(spark, d):
    return evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, d)))


_ROC = f"{_SCORED}, g AS (SELECT label, p AS score, sum(truth) AS p1, sum(1 - truth) AS p0 FROM p GROUP BY 1, 2), c AS (SELECT label, score, sum(p1) OVER w / sum(p1) OVER (PARTITION BY label) AS tpr, sum(p0) OVER w / sum(p0) OVER (PARTITION BY label) AS fpr FROM g WINDOW w AS (PARTITION BY label ORDER BY score DESC))"


@query(f"WITH {_ROC} SELECT label, score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c")
def roc_curve(spark, d):
    return evaluate.roc(scored(spark, d)).select("label", "score", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


@query(f"WITH {_ROC} SELECT label, round(sum(a), 6) AS auc FROM (SELECT label, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS a FROM c WINDOW w AS (PARTITION BY label ORDER BY score DESC)) GROUP BY 1")
def roc_auc(spark, d):
    return evaluate.auc(evaluate.roc(scored(spark, d))).withColumn("auc", r6(F.col("auc")))


# --- the rest ------------------------------------------------------------------------------------


@query(f"WITH {E}, {W0}, {_search(0)} SELECT n + 1 AS bmu, CAST(row_number() OVER (PARTITION BY n ORDER BY round(sqrt(d2), 9), CASE WHEN id % 2 = 0 THEN 'T' ELSE 'P' END || id) AS INT) AS rank, CASE WHEN id % 2 = 0 THEN 'T' ELSE 'P' END || id AS sample_id FROM b0")
def rep_samples_projected(spark, d):
    named = lambda even, prefix: vectors(spark, d).where(F.col("sample_id") % 2 == (0 if even else 1)).select(F.concat(F.lit(prefix), "sample_id").alias("sample_id"), "x")
    return samples.representatives(named(True, "T").unionByName(named(False, "P")), first_codebook(spark, d)).select("bmu", "rank", "sample_id")


@query(f"WITH full_e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), e AS (SELECT * FROM full_e WHERE pos <= 60), w0 AS (SELECT CAST(id AS INT) AS n, pos, v FROM full_e WHERE id < {K}), {_search(0)} SELECT f.id AS sample_id, CAST(f.pos - 1 AS INT) AS pos, round(CASE WHEN f.pos <= 60 THEN f.v ELSE w.v END, 6) + 0.0 AS value FROM full_e f JOIN b0 USING (id) JOIN w0 w ON w.n = b0.n AND w.pos = f.pos")
def project_impute(spark, d):
    w = first_codebook(spark, d)
    a = assign(vectors(spark, d).select("sample_id", F.slice("x", 1, 60).alias("x")), w[:, :60])
    padded = a.withColumn("x", F.concat("x", F.array_repeat(F.lit(None).cast("double"), 4)))
    return samples.fill_from_neuron(padded, w).select("sample_id", F.posexplode("x").alias("pos", "v")).select("sample_id", "pos", r6(F.col("v")).alias("value"))


@query(f"WITH {E}, {W0}, {_search(0)}, c AS (SELECT n + 1 AS bmu, label % 2 AS flag, count(*) AS k FROM b0 JOIN embeddings ON vec_id = id GROUP BY 1, 2) SELECT bmu, flag FROM (SELECT *, row_number() OVER (PARTITION BY bmu ORDER BY k DESC, flag) AS rk FROM c) WHERE rk = 1")
def flag_mode(spark, d):
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("v"), (F.col("label") % 2).alias("flag"))
    return plotdata.flag_mode(assign(vectors(spark, d), first_codebook(spark, d)).join(labels, F.col("sample_id") == F.col("v")))


_MINIMA = f"{_SERIES}, t AS (SELECT *, lag(dbi) OVER w AS a, lead(dbi) OVER w AS b FROM s WINDOW w AS (PARTITION BY iteration ORDER BY k)), low AS (SELECT iteration, k, row_number() OVER (PARTITION BY iteration ORDER BY dbi, k) AS place, count(*) OVER (PARTITION BY iteration) AS n FROM t WHERE coalesce(dbi < a, true) AND coalesce(dbi < b, true))"
_PICKS = " UNION ALL ".join(f"SELECT '{n}' AS pick, k FROM low WHERE {c}" for n, c in (("first", "place = 1"), ("second", "place = 2"), ("third", "place = 3"), ("median", "place = (n + 1) // 2"), ("max", "place = n")))


@query(f"WITH {_MINIMA}, p AS ({_PICKS}), g AS (SELECT pick, k, count(*) AS wins FROM p GROUP BY 1, 2) SELECT pick, k, wins, round(100.0 * wins / sum(wins) OVER (PARTITION BY pick), 2) AS percent FROM g")
def minima_summary(spark, d):
    return cluster.minima_summary(series(spark, d))


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES) + """), c AS (SELECT tbl, n, 24.0 AS ms, 336.0 / n AS mpd FROM t)
SELECT tbl, 'rough' AS phase, CAST(least(ceil(30 * mpd), 1000) * 2 AS INT) AS epochs, greatest(1.0, ceil(ms / 3)) AS first, greatest(1.0, ceil(ms / 3) / 4) AS last FROM c
UNION ALL SELECT tbl, 'fine', CAST(least(ceil(50 * mpd), 1000) * 2 AS INT), greatest(1.0, ms / 8), greatest(1.0, ms / 8 / 25) FROM c""")
def training_schedule(spark, d):
    counts = {t: read(spark, d, t).count() for t in TABLES}
    rows = [(t, p.name, p.epochs, p.first, p.last) for t, n in counts.items() for p in (rough(24, 14, n, factor=2), fine(24, 14, n, factor=2))]
    return spark.createDataFrame(rows, "tbl string, phase string, epochs int, first double, last double")


@query(f"WITH {NEAR} SELECT a.n AS a, b.m AS b, c.m AS c FROM cell a JOIN near b ON b.n = a.n AND b.k = 0 JOIN near c ON c.n = a.n AND c.k = 1 UNION ALL SELECT a.n, b.m, c.m FROM cell a JOIN near b ON b.n = a.n AND b.k = 1 JOIN near c ON c.n = a.n AND c.k = 2")
def torus_triangles(spark, d):
    return plotdata.torus_triangles(spark, C, R)


@query(f"WITH RECURSIVE {E}, {W0}, {NEAR}, {KM}, inside AS (SELECT cell.n, CAST((y + dy) * {C} + x + dx AS INT) AS m FROM cell JOIN step ON y % 2 = odd WHERE x + dx BETWEEN 0 AND {C - 1} AND y + dy BETWEEN 0 AND {R - 1}), edge AS (SELECT i.n, i.m FROM inside i JOIN l5 a ON a.n = i.n JOIN l5 b ON b.n = i.m WHERE a.c = b.c), reach AS (SELECT n, n AS m FROM l5 UNION SELECT r.n, e.m FROM reach r JOIN edge e ON e.n = r.m), part AS (SELECT n, CAST(min(m) AS INT) AS part FROM reach GROUP BY 1) SELECT n AS neuron, c + 1 AS cluster, part, round(avg(x + 0.5 * (y % 2)) OVER (PARTITION BY part), 6) AS cx, round(avg(y * sqrt(3.0) / 2) OVER (PARTITION BY part), 6) AS cy FROM part JOIN l5 USING (n) JOIN cell USING (n)")
def cluster_parts(spark, d):
    return cluster.parts(spark, fixed_labels(spark, d) + 1, C, R).withColumn("cx", r6(F.col("cx"))).withColumn("cy", r6(F.col("cy")))


@query()
def davies_bouldin_scan(spark, d):
    return cluster.davies_bouldin_scan(spark, first_codebook(spark, d))


QUERIES["voronoi_sums"] = QUERIES.pop("voronoi_sums_query")
SQL["voronoi_sums"] = SQL.pop("voronoi_sums_query")
SQL["bmu_assign_native"] = SQL["bmu_assign"]
