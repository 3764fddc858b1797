"""Readers and writers. Folders go through Spark, so any file system that it reaches will do."""

from __future__ import annotations

import io
import json
import re
import zipfile
from dataclasses import replace
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.normalize import quoted
from ..operators import umatrix
from ..operators.samples import mask, representative_lists
from ..plans.estimator import SelfOrganizingMap, SomModel

FORMATS = ("parquet", "csv", "json", "orc")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of samples. csv has a header; without a schema its types are found by a pass of its own. xlsx: read_workbook()."""
    if fmt == "xlsx":
        return read_workbook(spark, path)
    if fmt not in FORMATS:
        raise ValueError(f"formats are {FORMATS}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return (reader.schema(schema) if schema else reader).load(path)


def read_workbook(spark: SparkSession, path: str, sheet: int = 1, most_bytes: int = 256 << 20) -> DataFrame:
    """The first table of an xlsx sheet: a row of names, then rows. A column whose cells are all numbers (or empty, which is null) is double, any other
    string; rows without cells are left out. Any file system that Spark reaches; files beyond most_bytes, unpacked, are refused."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > most_bytes:
            raise ValueError(f"more than {most_bytes} bytes; save the sheet as csv instead")
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for r in root.iter(f"{_SHEET}row"):
        cells: dict[int, object] = {}
        for c in r.iter(f"{_SHEET}c"):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
            value, kind = c.find(f"{_SHEET}v"), c.get("t", "n")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else float(value.text) if kind in ("n", "b") else value.text
        if cells:
            rows.append(cells)
    if not rows:
        raise ValueError("an empty sheet")
    names = {k: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for k, v in rows[0].items()}
    number = {k: all(isinstance(r.get(k, 0.0), float) for r in rows[1:]) for k in names}
    schema = StructType([StructField(n, DoubleType() if number[k] else StringType()) for k, n in names.items()])
    shown = lambda v, k: v if v is None or number[k] else f"{v:g}" if isinstance(v, float) else v
    return spark.createDataFrame([tuple(shown(r.get(k), k) for k in names) for r in rows[1:]], schema)


def from_array(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """sample_id Sample_1, ... (plain numbers from 10000 rows on) and Var_1, ...; NaN is missing. The array stays as it is."""
    if not isinstance(x, np.ndarray) or x.ndim != 2:
        raise TypeError("a table or a two-dimensional array is needed")
    n, d = x.shape
    name = "Sample_{}" if n < 10000 else "{}"
    rows = [(name.format(i + 1), *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["sample_id string", *(f"Var_{j + 1} double" for j in range(d))]))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"formats are {FORMATS}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_workbook(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """An xlsx file on the driver's disk, for tables of a map's size; needs openpyxl, and refuses tables that a sheet can't hold."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("xlsx needs openpyxl; write parquet or csv instead") from e
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows; write parquet or csv instead")
    df.toPandas().to_excel(path, index=False)


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save(model: SomModel, spark: SparkSession, path: str) -> None:
    """The model as a folder: params (JSON text), codebook and neurons (Parquet)."""
    _write_text(spark, json.dumps(model.params()), f"{path}/params")
    write_table(umatrix.codebook_table(spark, model.codebook), f"{path}/codebook")
    write_table(model.neurons(spark), f"{path}/neurons")


def load(spark: SparkSession, path: str) -> SomModel:
    """What save() wrote; the name gets the suffix _loaded."""
    from ..functions.normalize import Stats

    p = json.loads(spark.read.text(f"{path}/params", wholetext=True).first()["value"])
    settings = p["settings"] | {"name": p["settings"]["name"] + "_loaded"}
    if isinstance(settings["map_size"], list):
        settings["map_size"] = tuple(settings["map_size"])
    rows = sorted((r["neuron"], r["w"]) for r in spark.read.parquet(f"{path}/codebook").collect())
    return SomModel(SelfOrganizingMap(**settings), p["features"], Stats(**p["stats"]), tuple(p["size"]), np.array([w for _, w in rows]), p["phases"], [tuple(h) for h in p["history"]])


def from_tables(neurons: DataFrame, samples: DataFrame, settings: SelfOrganizingMap, size: tuple[int, int]) -> SomModel:
    """A model from a table of neurons (BMU from 1, B_<feature> in the features' own units) and the table it was trained on, whose statistics normalize
    the weights; the name gets the suffix _loaded."""
    from ..functions.normalize import feature_stats, normalizer

    rows = neurons.orderBy("BMU").collect()  # one row a neuron
    if [r["BMU"] for r in rows] != list(range(1, size[0] * size[1] + 1)):
        raise ValueError("the neurons aren't those of a map of this size")
    features = [c[2:] for c in neurons.columns if c.startswith("B_")]
    stats = feature_stats(mask(samples, features, settings.mask) if settings.mask is not None else samples, features)
    weights = np.array([[r[f"B_{f}"] for f in features] for r in rows], float)
    codebook = normalizer(settings.normalization).apply_array(weights, np.array(stats.mean, float), np.array(stats.std, float))
    return SomModel(replace(settings, name=settings.name + "_loaded"), features, stats, size, codebook)


def write_svg(spark: SparkSession, image: str, path: str) -> None:
    """A plot as a text file in a folder of its own."""
    _write_text(spark, image, path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Lines "BMU k: text" of sample_labels(), in order of k: the texts that stand on a U-matrix."""
    lines = labels.orderBy("bmu").select(F.concat(F.lit("BMU "), F.col("bmu"), F.lit(": "), F.col("text")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_representatives(ranked: DataFrame, path: str) -> None:
    """Lines "BMU k: a, b", nearest samples first, in order of k."""
    lines = representative_lists(ranked).orderBy("bmu").select(F.concat(F.lit("BMU "), F.col("bmu"), F.lit(": "), F.array_join("samples", ", ")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def history(model: SomModel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(model.history, "phase string, epoch int, radius double, quantization_error double")


def report(model: SomModel, df: DataFrame) -> str:
    """The training report: data, settings, schedule, quality."""
    s, st = model.settings, model.stats
    cells = st.rows * len(model.features)
    gaps = cells - sum(st.present)
    q = model.quality(df).first()
    lines = [
        f"Map {s.name}", "", "Data", f"  samples: {st.rows}", f"  features: {len(model.features)}", f"  cells: {cells}", f"  missing: {gaps} ({round(100 * gaps / cells, 2)} %)", "",
        "Settings", f"  size: {model.size[0]} x {model.size[1]}", f"  shape: {s.map_shape}", f"  lattice: {s.lattice}", f"  normalization: {s.normalization}", f"  initialization: {s.initialization}", f"  kernel: {s.kernel}", "", "Training",
        *[f"  {p['name']}: {p['epochs']} epochs, radius {p['first']} to {p['last']}" for p in model.phases], "", "Quality", f"  quantization error: {q['quantization_error']:.4f}", f"  topographic error: {q['topographic_error']:.4f}",
    ]
    return "\n".join(lines) + "\n"


def write_report(model: SomModel, df: DataFrame, path: str) -> None:
    _write_text(df.sparkSession, report(model, df), path)


def numbered(df: DataFrame, by: str, name: str = "Sample_{}", parts: int = 64) -> DataFrame:
    """sample_id for a table without one, by the order of a column: rows are sorted in ranges, and a range's numbers begin after the counts of those before."""
    before, after = name.split("{}")
    rows = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), quoted(by).alias("by"))
    ordered = rows.repartitionByRange(parts, "by").sortWithinPartitions("by").select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = dict(tuple(r) for r in ordered.groupBy("part").agg(F.count("*")).collect())
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.array(*map(F.lit, starts or [0]))[F.col("part")]
    return ordered.select(F.concat(F.lit(before), start + F.col("at") + 1, F.lit(after)).alias("sample_id"), "row.*")
