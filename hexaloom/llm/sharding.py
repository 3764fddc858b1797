"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (key, id, row hash). A sample of them, drawn with chances in proportion to size,
gives quantile boundaries that cut the order into many more ranges than shards. Every record is put in
its range; ranges are measured, overfull ones (a hot key, an unlucky draw) are cut again by the hash of
their rows, and running sums inside the ranges place the shards' exact boundaries between records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import col, materialise, others

_SIGN = -(1 << 63)


def _chance(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the row alone, so that a task run again draws the same sample."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *cols), 11) / F.lit(float(1 << 53))


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, ranges_per_shard: int = 16, draws_per_range: int = 32, part_bytes: int = 1 << 30) -> DataFrame:
    """The carried columns of docs with size, text_crc32, law ("bytes"), shard and slot.

    Size is the UTF-8 bytes of the text (null: none) plus 16. Shards hold consecutive records of the order, each within
    one record of total / shards bytes; slot counts the records of a shard from 0 without gaps. The key is the hash of
    the text, so equal texts stand together, and are parted only where a shard ends. Rows equal in text and id are
    ordered by chance and all kept; null ids are ordered first. Carried columns with an output's name give way. The
    driver receives about shards * ranges_per_shard * draws_per_range sampled keys, a number that doesn't depend on the table, and a
    size of each range, and of each part of about part_bytes of the ranges that are larger: tasks follow the bytes, not the shards.
    Texts are read whole, however long. An empty table gives no rows.
    """
    spark = docs.sparkSession
    produced = ["size", "text_crc32", "law", "shard", "slot"]
    kept = others(docs.select(*map(col, carry)) if carry is not None else docs, produced)
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        *map(col, kept), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole).alias("__key"), F.coalesce(col(doc_id).cast("long"), F.lit(_SIGN)).alias("__id"),
    )
    # equal rows get apart by where they stand; written once, so that this never changes
    rows = materialise(rows.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())), "sizes")
    total, most = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not total:
        return rows.select(*map(col, kept), "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n_ranges = shards * ranges_per_shard
    draws = n_ranges * draws_per_range
    order = ["__key", "__id", "__row"]
    sample = sorted(tuple(r) for r in rows.where(_chance(*order) < F.col("size") * F.lit(draws / total)).select(*order, F.greatest("size", F.lit(total // draws + 1))).collect())
    reach = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(reach, np.arange(1, n_ranges) * (reach[-1] / n_ranges)) if len(sample) else []
    splitters = sorted({sample[k][:3] for k in at})
    held = spark.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def range_of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ladder = [np.array(c, np.int64) for c in zip(*held.value, strict=True)] or [np.empty(0, np.int64)] * 3
        for batch in batches:
            key, *rest = (c.to_numpy(zero_copy_only=False) for c in batch)
            low, high = np.searchsorted(ladder[0], key, "left"), np.searchsorted(ladder[0], key, "right")
            for k in np.flatnonzero(low < high):  # a record whose key is a splitter's: compare the rest
                a, z, record = low[k], high[k], tuple(int(c[k]) for c in rest)
                while a < z:
                    mid = (a + z) // 2
                    a, z = (mid + 1, z) if (int(ladder[1][mid]), int(ladder[2][mid])) < record else (a, mid)
                low[k] = a
            yield pa.array(low.astype(np.int32))

    placed = rows.withColumn("__range", range_of(*map(F.col, order)))
    # an overfull range is cut by row hash into parts of usual size; parts of a range are as good as ranges, in any order
    part = lambda of: F.pmod(F.xxhash64("__row"), of)
    measured = {r["__range"]: r["b"] for r in placed.groupBy("__range").agg(F.sum("size").alias("b")).collect()}
    usual = max(min(total / n_ranges, part_bytes), most)
    overfull = {k: int(b / usual) + 1 for k, b in measured.items() if b > 4 * usual}
    cuts = F.create_map(*[F.lit(x) for kv in overfull.items() for x in kv]) if overfull else None
    placed = placed.withColumn("__part", part(F.coalesce(cuts[F.col("__range")], F.lit(1))).cast("int") if overfull else F.lit(0))
    placed = materialise(placed, "ranges")
    sizes = sorted((r["__range"], r["__part"], r["b"], r["n"]) for r in placed.groupBy("__range", "__part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    before, bytes_before, rows_before = [], 0, 0
    for k, p, b, n in sizes:
        before.append((k, p, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + b, rows_before + n
    starts = spark.createDataFrame(before, "r int, p int, __bytes long, __rows long")
    run = Window.partitionBy("__range", "__part").orderBy(*order)
    ranked = placed.join(F.broadcast(starts), (F.col("__range") == F.col("r")) & (F.col("__part") == F.col("p")))  # of bounded size: ranges and their parts
    ranked = ranked.withColumn("__end", F.col("__bytes") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rank", F.col("__rows") + F.row_number().over(run) - 1)
    # a record belongs where its middle byte falls
    shard = F.least(F.lit(shards - 1), F.floor((F.col("__end") - F.col("size") / 2) * shards / F.lit(total))).cast("int")
    ranked = materialise(ranked.withColumn("shard", shard).select(*map(col, kept), "size", "text_crc32", "shard", "__rank"), "shards")
    firsts = spark.createDataFrame([(r["shard"], r["f"]) for r in ranked.groupBy("shard").agg(F.min("__rank").alias("f")).collect()], "s int, __first long")
    return ranked.join(F.broadcast(firsts), F.col("shard") == F.col("s")).select(*map(col, kept), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__rank") - F.col("__first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write docs as one folder a shard, rows in slot order within each part."""
    assign_shards(docs, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
