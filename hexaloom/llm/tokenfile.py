"""Token files: ids bit-packed at the least width of the vocabulary, in blocks with offsets.

A token file is a folder of Parquet parts, one part a shard of the document order. Each row is a block:
its shard, its number there, how many ids of the shard stand before it (the offset by which any id is
found without reading others), its bits an id, the packed ids, and the ids and lengths of its documents.
A block holds whole documents. Spark's committer makes the write safe against lost executors, on any
file system that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import col, give_back
from .tokens import encoder

_SLICE = 1 << 16


def width(vocabulary: int) -> int:
    """The least bits that hold 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` bits each, lowest bit first; the last byte is filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    parts = [ids[at : at + _SLICE] for at in range(0, len(ids), _SLICE)]  # a slice of 8 n ids ends on a byte
    return b"".join(np.packbits(((p[:, None].astype(np.uint32) >> places) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() for p in parts)


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start to start + count - 1 of a packed block; reads their bytes only."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, start * bits // 8).astype("<u4")
    out = np.empty(count, "<u4")
    weights = (1 << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
    for at in range(0, count, _SLICE):
        n, first = min(_SLICE, count - at), (start + at) * bits
        held = np.frombuffer(packed, np.uint8, (first + n * bits + 7) // 8 - first // 8, first // 8)
        flags = np.unpackbits(held, bitorder="little")[first % 8 : first % 8 + n * bits]
        out[at : at + n] = (flags.reshape(n, bits) * weights).sum(1)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str | None, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, block_ids: int = 1 << 16) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order.

    Null ids come first; rows of equal id are ordered by the hash of their texts, and each is kept: an id that many rows have is
    spread over shards like any other stretch of the order. A null or empty text is end_id alone. Texts are encoded whole, however
    long. A block closes at block_ids ids; a longer document has a block of its own. No rows: no blocks. Other columns aren't read.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("bits", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())),
    ])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, kind), np.array([end_id], "<u4").tobytes()
        bits = width(max(enc.vocabulary, end_id + 1))
        shard, number, before, open_docs = TaskContext.get().partitionId(), 0, 0, []

        def close(id_kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number, before
            ids = np.frombuffer(b"".join(x for _, x in open_docs), "<u4")
            row = [shard, number, before, len(ids), bits, pack(ids, bits), [d for d, _ in open_docs], [len(x) // 4 for _, x in open_docs]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(id_kind), pa.list_(pa.int64())]
            number, before = number + 1, before + len(ids)
            open_docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=schema.names)

        held, id_kind = 0, None
        for batch in batches:
            id_kind = batch.column(0).type
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + end
                if open_docs and held + len(ids) > 4 * block_ids:
                    yield close(id_kind)
                    held = 0
                open_docs.append((d, ids))
                held += len(ids)
        if open_docs:
            yield close(id_kind)
        give_back()

    rows = docs.select(col(doc_id).alias("d"), col(text).alias("t"), F.xxhash64(col(text)).alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(shards, "d", "h", "row").sortWithinPartitions("d", "h", "row").select("d", "t")
    ordered.mapInArrow(blocks, schema).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def _shard_starts(blocks: DataFrame) -> tuple[dict[int, int], int]:
    """How many ids stand before each shard, and in all, from one number a shard, of which there are as many as write_tokens() was told."""
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r["shard"]], total = total, total + r["n"]
    return starts, total


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids start to stop - 1 of the whole file, 4 bytes each, little-endian, a row a block that holds any, by the offsets alone.

    Of the blocks' columns only offsets are read but where they overlap the range, and of these only the bytes in it are unpacked.
    """
    blocks = spark.read.parquet(path)
    starts, _ = _shard_starts(blocks)
    # shards beyond the range are never opened; of each one within, the first and last place in it
    ends = dict(zip(starts, [*list(starts.values())[1:], float("inf")], strict=False))
    here = [F.when((F.col("shard") == s), (F.col("before") < stop - at) & (F.col("before") + F.col("n_ids") > start - at)) for s, at in starts.items() if at < stop and ends[s] > start]
    found = blocks.where(F.coalesce(*here, F.lit(False))) if here else blocks.where("false")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, n_ids, bits, packed = (batch.column(c)[k].as_py() for c in ("shard", "before", "n_ids", "bits", "packed"))
                at = starts[shard] + before
                a, z = max(start - at, 0), min(stop - at, n_ids)
                yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([unpack(packed, bits, a, z - a).tobytes()], pa.binary())], names=["start", "ids"])

    return found.select("shard", "before", "n_ids", "bits", "packed").mapInArrow(parts, "start bigint, ids binary")


def read_tokens(spark: SparkSession, path: str, doc_id: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per document from the blocks alone: doc_id, start (ids before it in the whole file), n_tokens, and ids
    (4 bytes each, little-endian) or with digest their ids_crc32.
    """
    blocks = spark.read.parquet(path)
    starts, _ = _shard_starts(blocks)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())
    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, n_ids, bits, packed, lengths = (batch.column(c)[k].as_py() for c in ("shard", "before", "n_ids", "bits", "packed", "lengths"))
                ids, ends = unpack(packed, bits, 0, n_ids), np.cumsum(lengths)
                begins = ends - lengths
                values = [ids[a:z].tobytes() for a, z in zip(begins, ends, strict=True)]
                values = pa.array([zlib.crc32(v) for v in values], pa.int64()) if digest else pa.array(values, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(begins + (starts[shard] + before), pa.int64()), pa.array(lengths, pa.int64()), values], names=schema.names)

    return blocks.mapInArrow(documents, schema)
