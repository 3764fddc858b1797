"""Best-fit packing of token sequences by bin completion.

Only the lengths matter for a packing, and there are at most as many of them as a sequence has places.
So the executors count the pieces of each length, the driver packs these counts (a table of bounded
size, whatever the corpus), and every piece takes its place from its rank among those of its length.
Ranks come from counts per task and length, so a length that holds most pieces needs no single task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import col, give_back, materialise
from .tokens import encoder

#: A filling (lengths in descending order) and how many bins have it.
Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, for whole groups of equal bins at a time."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(filling: tuple[int, ...], n: int, room: int) -> None:
        if n and room not in groups:
            groups[room] = []
            insort(rooms, room)
        if n:
            groups[room].append([filling, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else None
            filling, n = groups[room].pop() if room is not None else ((), left)
            if room is not None and not groups[room]:
                del groups[room]
                rooms.pop(at)
            room = capacity if room is None else room
            each = min(room // length, left)
            full = min(n, left // each)
            put((*filling, *[length] * each), full, room - each * length)
            if filling:
                put(filling, n - full, room)
            left -= each * full
    return [(f, n) for g in groups.values() for f, n in g]


def _fits(small: tuple[int, ...], rooms: list[int]) -> bool:
    """Whether all of small (descending) can be put into rooms."""
    if not small:
        return True
    for k in sorted({r: i for i, r in enumerate(rooms) if r >= small[0]}.values()):
        rooms[k] -= small[0]
        if _fits(small[1:], rooms):
            rooms[k] += small[0]
            return True
        rooms[k] += small[0]
    return False


def _sums(counts: Counter, lengths: list[int], need: int) -> Iterator[tuple[int, ...]]:
    """All choices of documents of these lengths (descending) that sum up to need, largest documents first.

    Which sums the documents from any place on can reach is a bit row each, so no step of the enumeration is in vain.
    """
    reach, whole = [1], (1 << (need + 1)) - 1
    for x in reversed(lengths):
        bits, left, step = reach[-1], min(counts[x], need // x), 1
        while left:
            step = min(step, left)
            bits |= (bits << (x * step)) & whole
            left, step = left - step, 2 * step
        reach.append(bits)
    reach.reverse()

    def of(k: int, need: int) -> Iterator[tuple[int, ...]]:
        if not need:
            yield ()
            return
        while reach[k] >> need & 1:  # something from k on makes up need
            x = lengths[k]
            for n in range(min(counts[x], need // x), 0, -1):
                if reach[k + 1] >> (need - n * x) & 1:
                    for rest in of(k + 1, need - n * x):
                        yield (x,) * n + rest
            k += 1
            if k == len(lengths):
                return

    return of(0, need)


def fillings(counts: Counter, room: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of room, least waste first, largest documents first among equals.

    A filling that another document fits beside is dominated by the two together; so where `waste` places are left, all documents of up to
    that length are in, and only the others are chosen among. Dominated, too, is a filling whose documents an earlier
    one could hold in place of its own; that is tested among short ones only, as it is dear, and where it isn't, dominated
    fillings come, too: they cost time, no solution.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    kept: list[tuple[int, ...]] = []
    for waste in range(room + 1):
        forced = tuple(x for x in lengths if x <= waste for _ in range(counts[x]))
        need = room - waste - sum(forced)
        if need < 0:
            return  # with more waste there are only more that fit beside
        for chosen in _sums(counts, [x for x in lengths if x > waste], need):
            f = chosen + forced
            if waste and len(f) <= 8 and any(_fits(f, list(k)) for k in kept):
                continue
            if len(f) <= 6 and len(kept) < 64:
                kept.append(f)
            yield f


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by the sum of lengths, and as a bin holds at most m documents of more than its (m + 1)-th part."""
    by_count = (-(-sum(n for k, n in counts.items() if (m + 1) * k > capacity) // m) for m in range(1, 17))
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), *by_count)


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 6000) -> list[Pattern]:
    """Pack counts[length] documents of each length into few bins of capacity.

    Branch and bound over the largest document left: its undominated fillings are tried, least waste first, each for as
    many bins at once as the counts allow; a branch ends when its waste is above what one bin less than the incumbent
    leaves. The incumbent is the best-fit packing at first. It ends when the incumbent meets lower_bound(), when all is tried, or
    after `nodes` nodes, the one budget there is, with the incumbent. The search goes back step by step: a node is held as the
    filling it took and how many came before it, so that no open branch is given up for want of memory. Without documents
    there are no bins.
    """
    counts = {k: n for k, n in counts.items() if n}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a length is 1 to capacity")
    total = sum(k * n for k, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    held = sum(n for _, n in best)
    left, waste = Counter(counts), 0
    taken: list[tuple[tuple[int, ...], int, int]] = []  # filling, for how many bins, which one of its node's

    def options() -> Iterator[tuple[int, ...]]:
        top = max(left)
        rest = Counter(left)
        rest[top] -= 1
        return ((top, *f) for f in fillings(rest, capacity - top))

    def take(whole: tuple[int, ...], sign: int, times: int) -> None:
        nonlocal waste
        waste += sign * times * (capacity - sum(whole))
        for x, n in Counter(whole).items():
            left[x] -= sign * n * times
            if not left[x]:
                del left[x]

    at = 0  # the filling of the present node to be tried next
    while held > bound and nodes:
        nodes -= 1
        whole = None
        if not left:
            if waste <= (held - 1) * capacity - total:
                best = [(f, n) for f, n, _ in taken]
                held = sum(n for _, n in best)
        elif waste <= (held - 1) * capacity - total:
            whole = next(islice(options(), at, None), None)
        if whole is not None:
            times = min(left[x] // n for x, n in Counter(whole).items())
            take(whole, 1, times)
            taken.append((whole, times, at))
            at = 0
        elif taken:
            whole, times, at = taken.pop()
            take(whole, -1, times)
            at += 1
        else:
            break
    return best


class Places:
    """Where the piece of a given length and rank goes: sequence number and offset."""

    def __init__(self, patterns: list[Pattern]):
        self.table: dict[int, list] = {}
        base = 0
        for filling, n in patterns:
            offset = 0
            for length, uses in Counter(filling).items():
                self.table.setdefault(length, []).append((n * uses, base, uses, offset))
                offset += uses * length
            base += n
        self.table = {k: [np.array(x, np.int64) for x in zip(*v, strict=True)] for k, v in self.table.items()}

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, base, uses, offset = self.table[length]
        ends = np.cumsum(sizes)
        k = np.searchsorted(ends, rank, "right")
        within = rank - (ends - sizes)[k]
        return base[k] + within // uses[k], offset[k] + within % uses[k] * length


PIECES = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer: str, kind: str | None, end_id: int, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, with keep_ids the ids (4 bytes each), sequence_id, offset.

    Every whole text is encoded and end_id appended; a null or empty text is end_id alone. A document of more than
    capacity ids is cut into full pieces, the first of which may be shorter. Rows with null or equal ids are packed each
    for itself. Other columns of docs aren't carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    fields = [(doc_id, id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.IntegerType()), ("ids_crc32", T.LongType()), *([("ids", T.BinaryType())] if keep_ids else []), ("__task", T.IntegerType()), ("__rank", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task, met = encoder(tokenizer, kind), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, (a, z) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity), strict=True)):
                    part = ids[4 * a : 4 * z]
                    for c, v in zip(rows, (d, k, a, z - a, zlib.crc32(part), *([part] if keep_ids else []), task, met[z - a]), strict=True):
                        c.append(v)
                    met[z - a] += 1
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else []), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=schema.names)
        give_back()

    # written once: encoding is the costly part, and ranks must stay as they are when a task is run again
    cut = materialise(docs.select(col(doc_id), col(text)).mapInArrow(pieces, schema), "pieces")
    counts = cut.groupBy(F.col("__task").alias("__t"), F.col("length").alias("__l")).count()
    patterns = complete_bins({r["__l"]: r["n"] for r in counts.groupBy("__l").agg(F.sum("count").alias("n")).collect()}, capacity)
    held = spark.sparkContext.broadcast(patterns)
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("__l").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))).drop("count")

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        places = Places(held.value)
        for lengths, ranks in batches:
            lengths, ranks = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                sequence[mine], offset[mine] = places.of(int(length), ranks[mine])
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = cut.join(before, (F.col("__task") == F.col("__t")) & (F.col("length") == F.col("__l")))
    rank = F.col("__rank") + F.coalesce("__before", F.lit(0))
    return ranked.withColumn("__place", place("length", rank)).select(col(doc_id), "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "__place.sequence_id", "__place.offset")
