"""Plot-ready tables: what to draw, where, and in which value; and a plain SVG writer for them."""

from __future__ import annotations

import math
from html import escape

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster, lattice, umatrix


def umatrix_plot(spark: SparkSession, codebook: np.ndarray, columns: int, rows: int, toroid: bool = True, log: bool = False, wrap: int = 0) -> DataFrame:
    """(neuron, kind, cx, cy, value): a hexagon a neuron at twice its place, and one half way to its neighbours 0, 1 and 2.

    wrap repeats that many columns and rows beyond each edge of a toroid.
    """
    at = lattice.neurons(spark, columns, rows).select("neuron", "hex_x", "hex_y", "ret_x", "ret_y")
    centre = at.join(umatrix.reduced(spark, codebook, columns, rows, toroid, log), "neuron").select("*", F.lit("neuron").alias("kind"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.col("u").alias("value")).drop("u")
    half = umatrix.expanded(spark, codebook, columns, rows, toroid, log).where("k < 3")
    steps = {0: (1.0, 0.0), 1: (0.5, math.sqrt(3) / 2), 2: (-0.5, math.sqrt(3) / 2)}
    shift = lambda i: F.when(F.col("k") == 0, steps[0][i]).when(F.col("k") == 1, steps[1][i]).otherwise(steps[2][i])
    side = at.join(half, "neuron").select("neuron", "hex_x", "hex_y", "ret_x", "ret_y", F.concat(F.lit("side"), F.col("k")).alias("kind"), shift(0).alias("dx"), shift(1).alias("dy"), F.col("d").alias("value"))
    both = centre.unionByName(side)
    if wrap:
        offsets = F.array(*[F.struct(F.lit(i * columns).alias("ox"), F.lit(j * rows).alias("oy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        both = both.withColumn("o", F.explode(offsets))
        both = both.where((F.col("ret_x") + F.col("o.ox")).between(-wrap, columns - 1 + wrap) & (F.col("ret_y") + F.col("o.oy")).between(-wrap, rows - 1 + wrap))
        both = both.withColumn("hex_x", F.col("hex_x") + F.col("o.ox")).withColumn("hex_y", F.col("hex_y") + F.col("o.oy") * math.sqrt(3) / 2)
    return both.select("neuron", "kind", (2 * F.col("hex_x") + F.col("dx")).alias("cx"), (2 * F.col("hex_y") + F.col("dy")).alias("cy"), "value")


def hit_marks(assigned: DataFrame, columns: int, rows: int) -> DataFrame:
    """(neuron, cx, cy, hits, radius) of the neurons that have samples."""
    at = lattice.neurons(assigned.sparkSession, columns, rows)
    return umatrix.hits(assigned).join(at, F.col("bmu") == F.col("neuron") + 1).select("neuron", (2 * F.col("hex_x")).alias("cx"), (2 * F.col("hex_y")).alias("cy"), "hits", "radius")


def sample_labels(ranked: DataFrame, names: list | None = None) -> DataFrame:
    """(bmu, text): "name(rank/total)" of the nearest sample of each neuron, among the named ones if given."""
    totals = ranked.groupBy("bmu").agg(F.count("*").alias("total"))
    chosen = ranked.where(F.col("sample_id").isin(names)) if names is not None else ranked
    first = chosen.groupBy("bmu").agg(F.min(F.struct("rank", "sample_id")).alias("f"))
    return first.join(totals, "bmu").select("bmu", F.concat("f.sample_id", F.lit("("), "f.rank", F.lit("/"), "total", F.lit(")")).alias("text"))


def flag_mode(rows: DataFrame) -> DataFrame:
    """(bmu, flag): what most of a neuron's samples (bmu, flag) have; the least of equally common flags."""
    counted = rows.where("bmu IS NOT NULL AND flag IS NOT NULL").groupBy("bmu", "flag").agg(F.count("*").alias("n"))
    return counted.groupBy("bmu").agg(F.min(F.struct((-F.col("n")).alias("n"), "flag")).alias("m")).select("bmu", "m.flag")


def binary(c: Column) -> Column:
    """0 below one half, else 1: a restored 0/1 feature as a flag."""
    return F.when(c < 0.5, 0).otherwise(1)


def component_planes(spark: SparkSession, weights: np.ndarray, features: list[str], columns: int, rows: int, grid: tuple[int, int] = (4, 4)) -> DataFrame:
    """(feature, page, cell, neuron, cx, cy, value): every feature's weights over the map, and its place in a collage of grid cells a page."""
    at = lattice.neurons(spark, columns, rows).select("neuron", "hex_x", "hex_y")
    w = umatrix.codebook_table(spark, weights).join(at, "neuron").select("neuron", F.col("hex_x").alias("cx"), F.col("hex_y").alias("cy"), F.posexplode("w").alias("pos", "value"))
    names = F.array(*map(F.lit, features))
    each = grid[0] * grid[1]
    return w.select(names[F.col("pos")].alias("feature"), F.floor(F.col("pos") / each).cast("int").alias("page"), (F.col("pos") % each).alias("cell"), "neuron", "cx", "cy", "value")


def template(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """(cx, cy, text): the neurons' numbers, from 1."""
    return lattice.neurons(spark, columns, rows).select(F.col("hex_x").alias("cx"), F.col("hex_y").alias("cy"), (F.col("neuron") + 1).cast("string").alias("text"))


def cluster_plot(spark: SparkSession, labels: np.ndarray, columns: int, rows: int, highlight: list[int] | None = None, names: dict[int, str] | None = None, codebook: np.ndarray | None = None, assigned: DataFrame | None = None, toroid: bool = True) -> DataFrame:
    """(neuron, cx, cy, cluster, shown), with names also text (a cluster's own label, else its number), with codebook u (the U-matrix to lay
    over it), with assigned (bmu) hits and radius of its samples' marks, 0 where there are none."""
    c = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "neuron int, cluster int")
    shown = F.col("cluster").isin(highlight) if highlight else F.lit(True)
    out = lattice.neurons(spark, columns, rows).join(c, "neuron").select("neuron", F.col("hex_x").alias("cx"), F.col("hex_y").alias("cy"), "cluster", shown.alias("shown"))
    if names is not None:
        out = out.withColumn("text", cluster_text(F.col("cluster"), names))
    if codebook is not None:
        out = out.join(umatrix.reduced(spark, codebook, columns, rows, toroid), "neuron")
    if assigned is not None:
        marks = umatrix.hits(assigned).select((F.col("bmu") - 1).alias("neuron"), "hits", "radius")
        out = out.join(marks, "neuron", "left").fillna({"hits": 0, "radius": 0.0})
    return out


def cluster_text(cluster: Column, names: dict[int, str]) -> Column:
    """The label given to a cluster, else its number."""
    out = cluster.cast("string")
    for k, name in names.items():
        out = F.when(cluster == k, F.lit(name)).otherwise(out)
    return out


def cluster_labels(spark: SparkSession, labels: np.ndarray, columns: int, rows: int, names: dict[int, str] | None = None) -> DataFrame:
    """(part, cluster, cx, cy, text): one label for each connected part of a cluster, at its centre."""
    parts = cluster.parts(spark, labels, columns, rows).select("part", "cluster", "cx", "cy").distinct()
    return parts.withColumn("text", cluster_text(F.col("cluster"), names or {}))


def torus(spark: SparkSession, columns: int, rows: int, inner: float = 0.4) -> DataFrame:
    """(neuron, x, y, z): columns go round the hole, rows round the tube, whose radius is inner times the ring's."""
    u, v = 2 * math.pi * F.col("hex_x") / columns, 2 * math.pi * F.col("ret_y") / rows
    ring = 1 + inner * F.cos(v)
    return lattice.neurons(spark, columns, rows).select("neuron", (ring * F.cos(u)).alias("x"), (ring * F.sin(u)).alias("y"), (inner * F.sin(v)).alias("z"))


def torus_triangles(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """(a, b, c): two triangles a neuron, with its neighbours 0, 1 and 2."""
    n = lattice.neighbours(spark, columns, rows).where("k < 3").groupBy("neuron").agg(*[F.max(F.when(F.col("k") == k, F.col("neighbour"))).alias(f"n{k}") for k in range(3)])
    return n.select(F.explode(F.array(F.struct(F.col("neuron").alias("a"), F.col("n0").alias("b"), F.col("n1").alias("c")), F.struct(F.col("neuron").alias("a"), F.col("n1").alias("b"), F.col("n2").alias("c")))).alias("t")).select("t.*")


def svg(hexagons: list[tuple[float, float, float | None]], radius: float = 1 / math.sqrt(3), texts: list[tuple[float, float, str]] = (), unit: float = 40) -> str:
    """Hexagons (cx, cy, value) in shades by value, and texts. For the rows of a map's plot table, collected: a few a neuron."""
    known = [v for *_, v in hexagons if v is not None and math.isfinite(v)]
    low, high = (min(known), max(known)) if known else (0.0, 1.0)
    out, span = [], (high - low) or 1.0
    for x, y, v in hexagons:
        shade = "#fff" if v is None or not math.isfinite(v) else "#{0:02x}{1:02x}{2:02x}".format(*(round(a + (b - a) * (v - low) / span) for a, b in ((33, 246), (60, 220), (120, 140))))
        corners = " ".join(f"{unit * (x + radius * math.sin(math.pi / 3 * k)):.2f},{unit * (y + radius * math.cos(math.pi / 3 * k)):.2f}" for k in range(6))
        out.append(f'<polygon points="{corners}" fill="{shade}"/>')
    out += [f'<text x="{unit * x:.2f}" y="{unit * y:.2f}" text-anchor="middle" font-size="{unit / 3:.1f}">{escape(t)}</text>' for x, y, t in texts]
    xs, ys = [x for x, *_ in hexagons] or [0], [y for _, y, _ in hexagons] or [0]
    box = [unit * (min(xs) - 1), unit * (min(ys) - 1), unit * (max(xs) - min(xs) + 2), unit * (max(ys) - min(ys) + 2)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{" ".join(f"{b:.2f}" for b in box)}">{"".join(out)}</svg>'


def line_chart(lines: dict[str, list[tuple[float, float]]], title: str = "", x: str = "", y: str = "", at: float | None = None, size: tuple[int, int] = (640, 280)) -> str:
    """SVG of lines by name, over a frame with the axes' ends; at: an upright line. For ROC curves, threshold sweeps and index scans."""
    points = [p for line in lines.values() for p in line if all(map(math.isfinite, p))]
    (x0, x1), (y0, y1) = ((min(v), max(v)) if (v := [p[i] for p in points]) else (0.0, 1.0) for i in (0, 1))
    w, h, edge = *size, 40
    across = lambda v: edge + (w - 2 * edge) * (v - x0) / ((x1 - x0) or 1)
    up = lambda v: h - edge - (h - 2 * edge) * (v - y0) / ((y1 - y0) or 1)
    text = lambda a, b, t, anchor="middle": f'<text x="{a:.1f}" y="{b:.1f}" text-anchor="{anchor}" font-size="12">{escape(t)}</text>'
    out = [f'<rect x="{edge}" y="{edge}" width="{w - 2 * edge}" height="{h - 2 * edge}" fill="none" stroke="#888"/>', text(w / 2, edge / 2, title), text(w / 2, h - 6, x), text(4, edge - 8, y, "start")]
    out += [text(edge, h - edge + 14, f"{x0:g}"), text(w - edge, h - edge + 14, f"{x1:g}"), text(edge - 4, h - edge, f"{y0:g}", "end"), text(edge - 4, edge + 4, f"{y1:g}", "end")]
    shades = ("#1b4f8a", "#b3541e", "#3d7a3d", "#7a3d7a", "#555")
    for k, (name, line) in enumerate(lines.items()):
        path = " ".join(f"{across(a):.2f},{up(b):.2f}" for a, b in line if math.isfinite(a) and math.isfinite(b))
        out += [f'<polyline points="{path}" fill="none" stroke="{shades[k % 5]}"/>', f'<g fill="{shades[k % 5]}">{text(w - edge - 4, edge + 16 * (k + 1), name, "end")}</g>']
    if at is not None:
        out.append(f'<line x1="{across(at):.2f}" x2="{across(at):.2f}" y1="{edge}" y2="{h - edge}" stroke="#000"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}">{"".join(out)}</svg>'


def threshold_chart(sweep: DataFrame, label: str, best: float | None = None) -> str:
    """Accuracy and rates of false negatives and positives of a label, in percent, over the thresholds."""
    rows = sweep.where(F.col("label") == label).orderBy("threshold").collect()  # one row a threshold
    return line_chart({n: [(r["threshold"], 100 * r[c]) for r in rows] for n, c in (("accuracy", "accuracy"), ("false negatives", "fnr"), ("false positives", "fpr"))}, f"Thresholds: {label}", "threshold", "%", best)


def roc_chart(curve: DataFrame, most: int = 10_000) -> str:
    """ROC curves of all labels; of a curve of more points, most / 2 steps of the false positive rate are drawn, each with its highest rate."""
    lines: dict[str, list[tuple[float, float]]] = {}
    steps = curve.groupBy("label", F.round(F.col("fpr") * (most // 2)).alias("step")).agg(F.min("fpr").alias("fpr"), F.min("tpr").alias("low"), F.max("tpr").alias("tpr"))
    for r in steps.orderBy("label", "step").collect():
        lines.setdefault(r["label"], [(0.0, 0.0)]).extend([(r["fpr"], r["low"]), (r["fpr"], r["tpr"])])
    return line_chart({k: [*v, (1.0, 1.0)] for k, v in lines.items()}, "ROC", "false positive rate", "true positive rate")


def index_chart(scan: DataFrame) -> str:
    """The Davies-Bouldin index over k: mean and quartiles of all iterations."""
    rows = cluster.index_by_k(scan).orderBy("k").collect()  # one row a k
    return line_chart({n: [(float(r["k"]), r[n]) for r in rows] for n in ("mean", "q25", "q75")}, "Davies-Bouldin index", "clusters")
