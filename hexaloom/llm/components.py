"""Connected components of an edge table, by minimum labels and pointer jumping on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that it reaches.

    Each round, a node takes the least label among its own and its neighbours', then its label's label; rounds end when
    nothing changes. Sums and joins only, so a node with very many edges is no single task's work. Loops, repeated and
    reversed edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialise(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    while True:
        heard = both.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("n")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("n")).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("mid"))
        up = labels.select(F.col("node").alias("m"), F.col("component").alias("above"))
        moved = nearer.join(up, F.col("mid") == F.col("m")).select("node", F.least("mid", "above").alias("component"), "old")
        moved = materialise(moved, "labels")
        changed = moved.where("component <> old").limit(1).count()
        drop(labels)
        labels = moved
        if not changed:
            drop(both)
            return labels.select("node", "component")
