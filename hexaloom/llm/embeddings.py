"""Near-duplicate embeddings by sorted projection passes.

Each pass gives every vector a key of concatenated random hashes (signs of random projections), orders
the vectors of a label by it, and compares each with a window of its neighbours in that order by exact
cosine. Pairs of all passes are united to components. Ranks are exact and global, so the windows don't
depend on how the rows are partitioned; a hot label is many spans of ranks like any other.

What the windows leave open is closed exactly: labels of more vectors than a window holds are dealt into
cells about some of their vectors (pivots), and cells are compared in blocks wherever the angle between
their pivots and their own widest angles allow a link, unless both blocks are in one component already.

Links are then counted within components, where windows would miss some of a large one's. Vectors within
half the angle of a component's first vector (its core) are linked with each other, as angles add up; only
the others (its fringe) are compared with all the rest, in blocks. So a large group of close vectors costs
one comparison a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .state import col, materialise, salted_join, scratch, spread_join

_BITS = 62


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or has null or non-finite components."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v /= most
    return v / np.sqrt((v * v).sum())


def _keyed(passes: int, seed: int):
    @F.arrow_udf("struct<node: binary, dim: int, unit: binary, keys: array<bigint>>")
    def keyed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        for vectors, labels in batches:
            rows = []
            for vector, label in zip(vectors.to_pylist(), labels.to_pylist(), strict=True):
                u = unit(vector) if label is not None else None
                if u is None:
                    rows.append(None)
                    continue
                if len(u) not in planes:
                    planes[len(u)] = np.random.default_rng([seed, len(u)]).standard_normal((passes * _BITS, len(u)))
                signs = (planes[len(u)] @ u > 0).reshape(passes, _BITS)
                held = np.array(vector, np.float64).tobytes()
                rows.append({"node": md5(repr(label).encode() + b"|" + held).digest(), "dim": len(u), "unit": u.tobytes(), "keys": (signs @ weights).tolist()})
            yield pa.array(rows, pa.struct([("node", pa.binary()), ("dim", pa.int32()), ("unit", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return keyed


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


@F.arrow_udf(T.DoubleType())
def _cosine(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        yield pa.array([float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def _counter(least: float):
    """An Arrow function: members of two blocks (or of one) -> for each, how many vectors of the other block it is linked with."""
    out_type = pa.list_(pa.struct([("uid", pa.int64()), ("linked", pa.int64())]))

    @F.arrow_udf("array<struct<uid: bigint, linked: bigint>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for groups in batches:
            out = []
            for members in groups:
                m = members.as_py()
                uid, times, block = (np.array([x[k] for x in m]) for k in ("uid", "times", "block"))
                units = np.stack([np.frombuffer(x["unit"], np.float64) for x in m])
                first = block == block[0]
                linked = np.zeros(len(m), np.int64)
                if first.all():
                    near = units @ units.T >= least
                    np.fill_diagonal(near, False)
                    linked += near @ times
                else:
                    near = units[first] @ units[~first].T >= least
                    linked[first] += near @ times[~first]
                    linked[~first] += near.T @ times[first]
                out.append([{"uid": int(u), "linked": int(n)} for u, n in zip(uid, linked, strict=True) if n])
            yield pa.array(out, out_type)

    return count


def _counted(members: DataFrame, least: float, block: int) -> DataFrame:
    """(uid, comp, linked): how many vectors of other nodes each node (uid, times, unit, comp) is linked with."""
    anchors = members.where("uid = comp").select(F.col("comp").alias("c"), F.col("unit").alias("anchor"))
    half = float(np.cos(np.arccos(least) / 2)) + 1e-9
    sided = salted_join(members, anchors, F.col("comp") == F.col("c"), "uid", 8).select("uid", "times", "unit", "comp", (_cosine("unit", "anchor") >= half).alias("core"))
    sided = materialise(sided, "sides")
    sizes = sided.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("times"))).alias("weight"), F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_fringe"))
    sizes = sizes.select(F.col("comp").alias("c"), "weight", F.ceil(F.col("n_core") / block).cast("int").alias("nh"), F.ceil(F.col("n_fringe") / block).cast("int").alias("ns"))

    rows = salted_join(sided, sizes.where("ns > 0"), F.col("comp") == F.col("c"), "uid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), F.when(F.col("core"), F.col("nh")).otherwise(F.col("ns"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    member = lambda b: F.struct("uid", "times", "unit", b.alias("block"))
    # a group is (component, kind, i, j): core block i and fringe block j, or fringe blocks i <= j
    core = rows.where("core").select("comp", F.lit(0).alias("kind"), F.col("own").alias("i"), F.explode(span(F.col("ns"))).alias("j"), member(F.lit(-1)).alias("m"))
    fringe = rows.where("NOT core")
    to_core = fringe.select("comp", F.lit(0).alias("kind"), F.explode(span(F.col("nh"))).alias("i"), F.col("own").alias("j"), member(F.col("own")).alias("m"))
    each = fringe.select("comp", "own", F.explode(span(F.col("ns"))).alias("k"), member(F.col("own")).alias("m"))
    to_fringe = each.select("comp", F.lit(1).alias("kind"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "m")
    groups = core.unionByName(to_core).unionByName(to_fringe).groupBy("comp", "kind", "i", "j").agg(F.collect_list("m").alias("ms"))
    # a group of one block alone counts only among fringe
    groups = groups.where((F.col("kind") == 1) | (F.size(F.array_distinct(F.transform("ms", lambda m: m.block))) > 1))
    groups = groups.where((F.col("kind") == 0) | (F.col("i") == F.col("j")) | (F.size(F.array_distinct(F.transform("ms", lambda m: m.block))) > 1))
    beside = groups.select(F.explode(_counter(least)("ms")).alias("l")).groupBy(F.col("l.uid").alias("u")).agg(F.sum("l.linked").alias("beside"))
    full = salted_join(sided, sizes.select("c", "weight"), F.col("comp") == F.col("c"), "uid").join(beside, F.col("uid") == F.col("u"), "left")
    return full.select("uid", "comp", (F.when(F.col("core"), F.col("weight") - F.col("times")).otherwise(F.lit(0)) + F.coalesce("beside", F.lit(0))).alias("linked"))


def _crosser(least: float):
    """An Arrow function: members of two blocks (or of one) -> pairs of components that a link between the blocks joins."""
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def cross(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for groups in batches:
            out = []
            for members in groups:
                m = members.as_py()
                comp, right = (np.array([x[k] for x in m]) for k in ("comp", "right"))
                units = np.stack([np.frombuffer(x["unit"], np.float64) for x in m])
                left, right = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(m)), np.arange(len(m)))
                i, j = np.nonzero((units[left] @ units[right].T >= least) & (comp[left][:, None] != comp[right]))
                a, b = comp[left[i]], comp[right[j]]
                joined = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                out.append([{"a": int(x), "b": int(y)} for x, y in joined])
            yield pa.array(out, pa.list_(pair))

    return cross


def _crossing(members: DataFrame, large: DataFrame, least: float, size: int) -> DataFrame:
    """Pairs (a, b) of components of members (uid, label, dim, unit, comp) that links between them join, in the groups of large (label, dim)."""
    group = ["label", "dim"]
    members = members.join(large, group, "left_semi").withColumn("said", F.col("label").cast("string"))
    pivots: dict[tuple[str, int], np.ndarray] = {}
    for r in members.where(F.pmod(F.xxhash64("uid"), F.lit(size)) == 0).groupBy("said", "dim").agg(F.sort_array(F.collect_list(F.struct("uid", "unit"))).alias("ps")).collect():
        pivots[r["said"], r["dim"]] = np.stack([np.frombuffer(x["unit"], np.float64) for x in r["ps"]])

    @F.arrow_udf("struct<cell: int, angle: double>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for saids, dims, units in batches:
            rows = []
            for said, dim, u in zip(saids.to_pylist(), dims.to_pylist(), units.to_pylist(), strict=True):
                near = pivots[said, dim] @ np.frombuffer(u, np.float64) if (said, dim) in pivots else np.array([-1.0])
                at = int(near.argmax())
                rows.append({"cell": at, "angle": float(np.arccos(np.clip(near[at], -1, 1)))})
            yield pa.array(rows, pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))

    @F.arrow_udf("double")
    def between(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([float(np.arccos(np.clip(pivots[g, d][i] @ pivots[g, d][j], -1, 1))) if i != j else 0.0 for g, d, i, j in rows], pa.float64())

    placed = materialise(members.select("uid", "said", "dim", "unit", "comp", place("said", "dim", "unit").alias("p")).select("uid", "said", "dim", "unit", "comp", "p.*"), "cells")
    keys = ["said", "dim", "cell"]
    cells = materialise(placed.groupBy(*keys).agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / size).cast("int").alias("nb")), "radii")
    dealt = placed.join(cells.drop("radius"), keys).select("uid", *keys, "unit", "comp", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("nb")).cast("int").alias("block"))
    dealt = materialise(dealt, "dealt")
    blocks = dealt.groupBy(*keys, "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))

    side = lambda df, x: df.select("said", "dim", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("said", "dim")])
    near = side(cells.drop("nb"), "a").join(side(cells.drop("nb"), "b"), ["said", "dim"]).where("cell_a <= cell_b")
    widest = float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6
    near = near.where(between("said", "dim", "cell_a", "cell_b") - F.col("radius_a") - F.col("radius_b") <= widest).select("said", "dim", "cell_a", "cell_b")
    pairs = near.join(side(blocks, "a"), ["said", "dim", "cell_a"]).join(side(blocks, "b"), ["said", "dim", "cell_b"]).where("cell_a < cell_b OR block_a <= block_b")
    pairs = pairs.where("least(low_a, low_b) <> greatest(high_a, high_b)").select("said", "dim", "cell_a", "block_a", "cell_b", "block_b")
    pairs = materialise(pairs, "pairs")

    def one(x: str) -> DataFrame:
        held = dealt.withColumnsRenamed({"cell": f"cell_{x}", "block": f"block_{x}"})
        return pairs.join(held, ["said", "dim", f"cell_{x}", f"block_{x}"]).select(*pairs.columns, F.struct("comp", "unit", F.lit(x == "b").alias("right")).alias("m"))

    both = one("a").unionByName(one("b").where("cell_a <> cell_b OR block_a <> block_b"))
    groups = both.groupBy(*pairs.columns).agg(F.collect_list("m").alias("ms"))
    return groups.select(F.explode(_crosser(least)("ms")).alias("l")).select("l.a", "l.b").distinct()


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, passes: int = 12, window: int = 1024, span: int = 4096, seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal dimension are linked when their cosine in double precision is at least
    `least`. Components are what is connected by links: those between vectors within about `window` places of each other in one
    of the passes are found first, and whatever else is linked in larger labels by comparing cells in blocks of 2 * window.
    Equal vectors are one node and always linked to each other. n_links counts the other vectors linked directly, component_id is the least vec_id
    reachable, kept is vec_id = component_id. A vector that is null, empty, zero, or holds a null or non-finite
    component, and one without label, is linked with nothing: 0, its own id, true. Null ids are never least; repeated
    rows count as vectors of their own. Other columns aren't read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    with scratch(spark) as tables:
        keyed = _keyed(passes, seed)
        rows = vectors.select(col(vec_id).alias("id"), col(label).alias("label"), keyed(col(embedding), col(label).cast("string")).alias("k")).select("id", "label", "k.*")
        rows = materialise(rows, "keyed")
        nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("times"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
        nodes = materialise(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")

        # exact ranks within (pass, label, dim): sort once by range, number within tasks, add what earlier tasks hold
        group = ["pass", "label", "dim"]
        entries = nodes.select(F.posexplode("keys").alias("pass", "key"), "label", "dim", "uid")
        n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = entries.repartitionByRange(n_tasks, *group, "key", "uid").sortWithinPartitions(*group, "key", "uid")

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, current, n = TaskContext.get().partitionId(), None, 0
            for batch in batches:
                places = []
                for g in zip(*(batch.column(c).to_pylist() for c in group), strict=True):
                    n = n + 1 if g == current else 0
                    current = g
                    places.append(n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*group, "uid")), pa.array([task] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*group, "uid", "task", "place"])

        schema = entries.select(*group, "uid").withColumn("task", F.lit(0)).withColumn("place", F.lit(0).cast("long")).schema
        ranks = materialise(ordered.mapInArrow(numbered, schema), "ranks")
        before = ranks.groupBy(*group, "task").agg(F.count("*").alias("n"))
        before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranked = ranks.join(before.drop("n"), [*group, "task"]).select(*group, "uid", (F.col("before") + F.col("place")).alias("rank"))

        # each span of ranks also gets the window before it
        spans = ranked.select(*group, "uid", "rank", F.floor(F.col("rank") / span).alias("at"))
        late = F.col("rank") % span >= span - window
        spans = spans.select(*group, "uid", "rank", F.explode(F.when(late, F.array("at", F.col("at") + 1)).otherwise(F.array("at"))).alias("span"))
        held = spans.join(nodes.select("uid", "unit"), "uid")
        keys = [*group, "span"]
        dealt = held.repartition(n_tasks, *keys).sortWithinPartitions(*keys, "rank").select(*keys, "rank", "uid", "unit")
        block = max(1, window // 2)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found(ids: np.ndarray, old: int, vectors: np.ndarray) -> pa.RecordBatch | None:
                """A forest of the links between the places from old on and all places before or among them."""
                i, j = np.nonzero(vectors[old:] @ vectors.T >= least)
                i = i + old
                i, j = i[j < i], j[j < i]
                root = _roots(len(ids), i, j)
                at = np.flatnonzero(root != np.arange(len(ids)))
                return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"]) if len(at) else None

            current, ids, units, fresh = None, [], [], 0

            def flush() -> pa.RecordBatch | None:
                nonlocal ids, units, fresh
                out = found(np.array(ids, np.int64), len(ids) - fresh, np.array(units)) if fresh else None
                keep = 2 * block
                ids, units, fresh = ids[-keep:], units[-keep:], 0
                return out

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in (*keys, "rank", "uid", "unit")]
                for *g, rank, uid, u in zip(*columns, strict=True):
                    if g != current:
                        if (out := flush()) is not None:
                            yield out
                        current, ids, units = g, [], []
                    ids.append(uid)
                    units.append(np.frombuffer(u, np.float64))
                    if rank // span == g[3]:  # else it is the window before the span, compared in the span before
                        fresh += 1
                        if fresh == block:
                            if (out := flush()) is not None:
                                yield out
            if (out := flush()) is not None:
                yield out

        reach = components(dealt.mapInArrow(compare, "a long, b long")).select(F.col("node").alias("r_uid"), F.col("component").alias("comp"))
        # groups that no window holds whole
        large = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block).select("label", "dim")
        large = materialise(large, "large")
        if large.limit(1).count():
            reached = nodes.select("uid", "label", "dim", "unit").join(reach, F.col("uid") == F.col("r_uid"), "left")
            more = materialise(_crossing(reached.withColumn("comp", F.coalesce("comp", "uid")), large, least, 2 * window), "crossing")
            if more.limit(1).count():
                reach = components(reach.select(F.col("r_uid").alias("a"), F.col("comp").alias("b")).unionByName(more)).select(F.col("node").alias("r_uid"), F.col("component").alias("comp"))
        members = nodes.select("uid", "times", "unit").join(reach, F.col("uid") == F.col("r_uid"))
        linked = _counted(members, least, block).withColumnRenamed("uid", "l_uid")
        known = nodes.select("node", "uid", "times").join(linked, F.col("uid") == F.col("l_uid"), "left")
        known = known.select(F.col("node").alias("n"), (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("comp", "uid").alias("comp"))
        known = materialise(known.withColumnRenamed("n", "node"), "known")
        placed = spread_join(rows.select("id", "node"), known, nodes.select("node", F.col("times").alias("n")))
        placed = materialise(placed.select("id", "comp", "n_links"), "placed")
        tables.keep(placed)
    least_id = placed.where("comp IS NOT NULL").groupBy(F.col("comp").alias("c")).agg(F.min("id").alias("least_id"))
    component_id = F.coalesce("least_id", "id")
    return salted_join(placed, least_id, F.col("comp") == F.col("c"), "id", 8, "left").select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))
