"""Tables that a job writes in mid-course, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A session without one, as in tests, gets a folder of its own in local mode only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.hexaloom.shared.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="hexaloom-")
    atexit.register(shutil.rmtree, own, True)
    path = "file://" + own
    spark.conf.set("spark.hexaloom.shared.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hexaloom/{name}-{uuid.uuid4().hex}"


class scratch:  # noqa: N801
    """What materialise() writes inside `with scratch(spark) as tables` is deleted at its end, but for tables.keep(...)."""

    _open: ClassVar[list[scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, *frames: DataFrame) -> None:
        """These outlive the block; a scratch around it has them then."""
        roots = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in frames for f in df.inputFiles()}
        kept = [p for p in self.paths if p.rsplit("/", 1)[1] in roots]
        self.paths = [p for p in self.paths if p not in kept]
        if len(self._open) > 1:
            self._open[-2].paths += kept

    def __enter__(self) -> scratch:
        self._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        self._open.remove(self)
        _delete(self.spark, self.paths)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it again: lineage ends here, and lost executors lose nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch._open:
        scratch._open[-1].paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that materialise() wrote, once nothing will read it any more."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for root in paths:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    # plans that nothing refers to any more are collected, and Spark's cleaner then removes their shuffle files
    gc.collect()
    jvm.System.gc()


def salted_join(rows: DataFrame, few: DataFrame, on: Column, by: Column | str, salts: int = 16, how: str = "inner") -> DataFrame:
    """rows joined with few, whose keys are unique: few is repeated, and rows are dealt by the hash of `by`, so that a key that many rows have is many
    tasks' work."""
    small = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    large = rows.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return large.join(small, on & (F.col("__s") == F.col("__salt")), how).drop("__salt", "__s")


def spread_join(rows: DataFrame, few: DataFrame, counts: DataFrame) -> DataFrame:
    """rows left-joined with few on node, of which each has few.node once. Nodes of at least a thousandth of all rows, a thousand at most, are joined by broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") > 1) & (F.col("n") * 1000 >= total)).select(F.col("node").alias("h"))
    rest = rows.join(F.broadcast(hot), F.col("node") == F.col("h"), "left_anti").join(few.withColumnRenamed("node", "f"), F.col("node") == F.col("f"), "left").drop("f")
    heavy = F.broadcast(hot.join(few.withColumnRenamed("node", "f"), F.col("h") == F.col("f"), "left").drop("f"))
    return rest.unionByName(rows.join(heavy, F.col("node") == F.col("h")).drop("h"))


def give_back() -> None:
    """At the end of a task: what this Python process has freed goes back to the system, as the process is used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other letter stays, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def others(df: DataFrame, produced: list[str]) -> list[str]:
    """df's columns but those whose names an operator's own columns take (without regard to case)."""
    taken = {p.lower() for p in produced}
    return [c for c in df.columns if c.lower() not in taken]


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
