"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words, the patterns are the windows of the benchmark items. A shift table over
blocks of consecutive words tells how far the search may jump; where it may not, the hash of the
suffix block selects a bucket of windows, the first word narrows it, and direct comparison confirms.
Patterns of one length share one searcher, so a short item never shortens the jumps of the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import ascii_lower, col, others
from .words import as_bytes, words

HITS = "struct<n_words: bigint, spans: array<struct<start: bigint, stop: bigint>>, items: array<string>>"


class Searcher:
    """Wu-Manber tables of patterns of one length. A pattern is a place in an item's words; items that hold the same words have a place each."""

    def __init__(self, length: int, block: int = 3):
        self.length, self.block = length, min(block, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], int, int]]] = {}

    def add(self, item: list[bytes], number: int) -> None:
        """All windows of an item, by one pass: a block of words is as far from a window's end as the first window that ends after it."""
        n, block = self.length, self.block
        blocks = [tuple(item[i : i + block]) for i in range(len(item) - block + 1)]
        for at, key in enumerate(blocks):
            ends = max(at + block, n)  # the first window end that this block can stand before
            step = ends - (at + block)
            if step < self.jump:
                self.shift[key] = min(self.shift.get(key, self.jump), step)
            if at + block >= n:
                self.buckets.setdefault(key, []).append((item, at + block - n, number))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """Starts of all occurrences in ascending order, each with an item's number."""
        length, block, jump, shift, end, n = self.length, self.block, self.jump, self.shift.get, self.length, len(text)
        while end <= n:
            key = tuple(text[end - block : end])
            step = shift(key, jump)
            if step:
                end += step
                continue
            first, known, found = text[end - length], None, []
            for item, at, number in self.buckets[key]:
                if item[at] == first:
                    known = known or text[end - length : end]
                    if item[at : at + length] == known:
                        found.append(number)
            for number in found:
                yield end - length, number
            end += 1


class Windows:
    """All windows of a block of benchmark items (name, text)."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = 10, block: int = 3):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        searchers: dict[int, Searcher] = {}
        for name, text in items:
            if w := words(text):
                n = min(window, len(w))
                searchers.setdefault(n, Searcher(n, block)).add(w, number[name])
        self.searchers = [s for _, s in sorted(searchers.items())]

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Covered word ranges, merged where they touch or overlap, and the items that occur."""
        ranges, found = [], set()
        for s in self.searchers:
            for start, item in s.find(text):
                if not ranges or ranges[-1] != (start, start + s.length):
                    ranges.append((start, start + s.length))
                found.add(item)
        return merged(ranges), sorted(self.names[k] for k in found)


def item_blocks(rows: Iterable[tuple[str, bytes | None]], window: int, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about `most` bytes. A longer item is cut into pieces that have each of its windows once."""
    held, size, step = [], 0, max(most // 64, window)
    for name, text in rows:
        w = words(text)
        for at in range(0, max(len(w) - window + 1, 1), step) if w else ():
            piece = b" ".join(w[at : at + step + window - 1])
            held.append((name, piece))
            size += len(piece) + len(name)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


#: The tables that this process built last, by their block's name: tasks that share a Python worker share them.
_BUILT: dict[str, Windows] = {}


def _windows(name: str, items, window: int, block: int) -> Windows:
    """Tables of a block (a broadcast of items). The process holds those of one block at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items.value, window, block)
        items.__dict__.pop("_value", None)  # the words live on in the tables
    return _BUILT[name]


def _marker(tables: list, window: int, block: int, held_bytes: int = 16 << 20):
    """An Arrow function text -> hits; tables: names and broadcasts of blocks of items. With several blocks, texts are searched for one after another in runs
    of about held_bytes, so that a block's tables are built once a run."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def searched(run: list[pa.Array]) -> Iterator[pa.Array]:
        spans: list[list[list]] = [[[] for _ in texts] for texts in run]
        items: list[list[set]] = [[set() for _ in texts] for texts in run]
        n_words = [[0] * len(texts) for texts in run]
        for name, block_items in tables:
            search = _windows(name, block_items, window, block)
            for k, texts in enumerate(run):
                for i, text in enumerate(texts.to_pylist()):
                    w = words(text)
                    n_words[k][i] = len(w)
                    s, found = search.hits(w)
                    spans[k][i] += s
                    items[k][i].update(found)
        for k, texts in enumerate(run):
            if not tables:
                n_words[k] = [len(words(t)) for t in texts.to_pylist()]
            yield pa.array([{"n_words": n, "spans": [{"start": a, "stop": z} for a, z in merged(s)], "items": sorted(f)} for n, s, f in zip(n_words[k], spans[k], items[k], strict=True)], kind)

    @F.arrow_udf(HITS)
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run, size = [], 0
        for texts in batches:
            run.append(as_bytes(texts))
            size += texts.nbytes
            if len(tables) < 2 or size >= held_bytes:
                yield from searched(run)
                run, size = [], 0
        if run:
            yield from searched(run)

    return mark


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block: int = 3, broadcast_bytes: int = 1 << 20) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (word ranges inside occurrences of benchmark windows), hit_items and contaminated.

    A null or wordless text has no words and no hits. A null or wordless item has no windows; an item
    without id is left out, as it can't be reported; rows that repeat an item's id add their windows
    to it; repeated documents are judged each for itself. Columns of docs with an output's name give
    way to it. Texts are searched whole. The benchmark is the stated query set: it goes out in broadcasts of about
    broadcast_bytes of text each, whatever its size, and a task has the tables of one of them in memory at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(col(item_id).cast("string").alias("name"), ascii_lower(col(item_text)).alias("text")).where("name IS NOT NULL")
    rows = ((r["name"], (r["text"] or "").encode()) for r in items.toLocalIterator())
    tables = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in item_blocks(rows, window, broadcast_bytes)]
    produced = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]
    kept = others(docs, produced)
    marked = docs.select(*map(col, kept), _marker(tables, window, block)(col(text)).alias("__hits"))
    n_hit: Column = F.aggregate("__hits.spans", F.lit(0).cast("long"), lambda acc, s: acc + s.stop - s.start)
    return marked.select(*map(col, kept), F.col("__hits.n_words"), n_hit.alias("n_hit"), F.col("__hits.spans").alias("hit_spans"), F.col("__hits.items").alias("hit_items"), (F.size("__hits.spans") > 0).alias("contaminated"))
