"""Near-duplicate texts by order min hash, verified by banded alignment.

Texts with the same words are one node. Nodes that agree on an ordered tuple of least k-mers share a
bucket, whose least node is its leader. Keys are of five words; edits break whole k-mers, so as many keys
of three words stand beside them, short texts get keys of pairs of words, and the shortest (two edits at
most) those of all they can become by leaving out words, which finds every pair of them.

A leader and all that share a bucket with it are a group. Each text goes once to each of its groups, where
one task settles them (`settle`): every member is aligned with the leader; then every pair of a bucket that is
apart still is ruled out by an exact bound or aligned, and only links that join what was apart leave the task.
Groups of more bytes than a block are dealt into blocks; what is in different components after that is compared
between blocks. So a large group of like texts costs about one alignment a text, rows between stages grow with
the texts, and every pair of a bucket is in one component, or was aligned, or can't reach the similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import similar
from .components import components
from .shingles import _ODD, kmers, mix, order_min_hash, word_hashes
from .state import col, drop, give_back, materialise, salted_join, scratch, spread_join
from .words import as_bytes, words

_CHUNK = 1 << 19


def _chunks(texts: pa.Array) -> Iterator[tuple[list[bytes | None], np.ndarray, np.ndarray]]:
    """The batch's texts in runs of about _CHUNK bytes: texts, their bytes one after another, offsets."""
    held = as_bytes(texts)
    lengths = [n or 0 for n in pc.binary_length(held).to_pylist()]
    at = 0
    while at < len(held):
        stop, size = at, 0
        while stop < len(held) and (stop == at or size + lengths[stop] <= _CHUNK):
            size += lengths[stop]
            stop += 1
        part = held.slice(at, stop - at).to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(t or b"") for t in part])]).astype(np.int64)
        yield part, np.frombuffer(b"".join(t or b"" for t in part), np.uint8), offsets
        at = stop


def _nodes(texts: list[bytes | None], hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128-bit hashes of the texts' words in order; of a wordless text the hash of its bytes; of none, none."""
    n = np.diff(first)
    out: list[bytes | None] = [hashlib.md5(b"wordless" + t).digest() if t is not None else None for t in texts] if not n.all() else [None] * len(texts)
    full = np.flatnonzero(n)
    if len(full):
        at = first[:-1][full]
        place = (np.arange(len(hashes)) - np.repeat(at, n[full])).astype(np.uint64)
        halves = [mix(np.add.reduceat(mix(hashes ^ mix(place + np.uint64(salt))), at) + n[full].astype(np.uint64)) for salt in (11, 1 << 40)]
        joined = np.stack(halves, 1).astype("<u8").tobytes()
        for k, i in enumerate(full):
            out[i] = joined[16 * k : 16 * k + 16]
    return out


@lru_cache(maxsize=256)
def _left(n: int, out: int) -> np.ndarray:
    """All ways to leave out `out` of n places: a row each, of the places that stay."""
    return np.array(list(combinations(range(n), n - out)), np.int64).reshape(-1, n - out)


def _shortened(hashes: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts that may differ by two edits at most, and keys of what they are with so many words or fewer left out."""
    n = np.diff(first)
    most = ((1 - least) * n + 1e-9).astype(int)
    for size in np.unique(n[(n > 0) & (most <= 2)]):
        at = np.flatnonzero(n == size)
        words_of = hashes[first[:-1][at][:, None] + np.arange(size)]
        for out in range(min(int(most[at[0]]), size - 1) + 1):
            kept = _left(int(size), out)
            h = np.full((len(at), len(kept)), kept.shape[1], np.uint64)
            for j in range(kept.shape[1]):
                h = mix(h * _ODD + words_of[:, kept[:, j]])
            yield np.repeat(at, len(kept)), h.ravel()


def _keys(hashes: np.ndarray, first: np.ndarray, k: int, sketches: int, take: int, least: float, short: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk's texts one after another, and where each text's begin.

    Texts of more than short words have half their keys of k words and half of two fewer, those of up to short / least words keys
    of word pairs: two texts that can be similar have either the first or the second both.
    """
    n = np.diff(first)
    half = -(-sketches // 2)
    at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for held, size in ((n > short, k), (n > short, max(k - 2, 1)), ((n > 0) & (n <= short / least), min(k, 2))):
        texts = np.flatnonzero(held)
        labelled, begin = kmers(hashes[np.repeat(held, n)], np.concatenate([[0], np.cumsum(n[texts])]), size)
        at.append(np.repeat(texts, half))
        found.append(order_min_hash(labelled, begin, half, take, size).ravel())
    for texts, keys in _shortened(hashes, first, least):
        at.append(texts)
        found.append(keys)
    places = np.concatenate(at)
    return np.concatenate(found)[np.argsort(places, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(n)))])


def _sketcher(k: int, sketches: int, take: int, least: float, short: int):
    @F.arrow_udf("struct<node: binary, n_words: int, keys: array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            nodes, counts, keys, sizes = [], [], [], [np.zeros(1, np.int64)]
            for part, data, offsets in _chunks(texts):
                hashes, first = word_hashes(data, offsets)
                nodes += _nodes(part, hashes, first)
                counts.append(np.diff(first))
                found, begin = _keys(hashes, first, k, sketches, take, least, short)
                keys.append(found)
                sizes.append(np.diff(begin))
            flat = np.concatenate(keys).astype(np.int64) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(counts) if counts else [], pa.int32()), lists], ["node", "n_words", "keys"])
        give_back()

    return sketch



def _first_of(*sorted_by: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before in any of the arrays; the first row does."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= (x[1:] != x[:-1]) if x.ndim == 1 else (x[1:] != x[:-1]).any(1)
    return new


def _local_buckets(rows: int, parts: int):
    """Nodes and their keys -> of each key met in so many rows together, its least node, packed by part of the keys (part, packed);
    and that node with each other one of the key (key, a, b).

    So a key that a third of all texts have is one entry in so many rows when keys meet.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from _grouped(held, parts)
                held, n = [], 0
        if held:
            yield from _grouped(held, parts)

    return collect


_STARS = "part bigint, packed binary, key bigint, a binary, b binary"


def _stars(part: np.ndarray, packed: list, key: np.ndarray | None = None, a: list = (), b: list = ()) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays([
        pa.array(part, pa.int64()), pa.array(packed or [None] * n, pa.binary()), pa.array(key, pa.int64()) if key is not None else pa.nulls(n, pa.int64()),
        pa.array(a or [None] * n, pa.binary()), pa.array(b or [None] * n, pa.binary()),
    ], names=["part", "packed", "key", "a", "b"])


def _grouped(held: list[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    nodes, lists = table.column("node").combine_chunks(), table.column("keys").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(keys):
        return
    names = np.frombuffer(b"".join(nodes.to_pylist()), ">u8").reshape(len(nodes), 2)
    number = np.empty(len(names), np.int64)  # in the order of the nodes, equal for equal ones
    order = np.lexsort((names[:, 1], names[:, 0]))
    number[order] = np.cumsum(_first_of(names[order])) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((number[owner], keys))
    keys, owner = keys[by], owner[by]
    fresh = _first_of(keys, number[owner])
    keys, owner = keys[fresh], owner[fresh]
    first = _first_of(keys)
    leader = owner[first][np.cumsum(first) - 1]
    # one row a part: keys, then nodes
    k, o = keys[first], owner[first]
    part = (k.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    k, o, part = k[by], o[by], part[by]
    at = np.flatnonzero(_first_of(part))
    yield _stars(part[at], [k[i:j].tobytes() + names[o[i:j]].tobytes() for i, j in zip(at, [*at[1:], len(k)], strict=True)])
    rest = np.flatnonzero(~first)
    raw = nodes.to_pylist()
    for i in range(0, len(rest), 1 << 14):
        r = rest[i : i + (1 << 14)]
        yield _stars(names[owner[r], 1].astype(np.uint64) % np.uint64(parts), [], keys[r], [raw[x] for x in leader[r]], [raw[x] for x in owner[r]])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _local_buckets by part -> (key, a, b, inner): the least node of a key with its other ones; inner rows as they came."""
    names = ["key", "a", "b", "inner"]

    def met(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = [len(p) // 24 for p in packed]
        keys = np.concatenate([np.frombuffer(p, np.int64, n) for p, n in zip(packed, sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        fresh = _first_of(keys[order])
        again = ~fresh
        again[:-1] |= ~fresh[1:]
        at = order[again]  # of keys that are there twice
        if not len(at):
            return
        nodes = np.concatenate([np.frombuffer(p, ">u8", 2 * n, 8 * n).reshape(n, 2) for p, n in zip(packed, sizes, strict=True)])[at]
        keys = keys[at]
        by = np.lexsort((nodes[:, 1], nodes[:, 0], keys))
        keys, nodes = keys[by], nodes[by]
        fresh = _first_of(keys, nodes)
        keys, nodes = keys[fresh], nodes[fresh]
        first = _first_of(keys)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        raw = nodes.astype(">u8").tobytes()
        for i in range(0, len(keys), 1 << 14):
            rows = np.flatnonzero(~first[i : i + (1 << 14)]) + i
            node = lambda r: pa.array([raw[16 * x : 16 * x + 16] for x in r], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), node(lead[rows]), node(rows), pa.array(np.zeros(len(rows), bool))], names=names)

    part, packed = None, []
    for batch in batches:
        inner = batch.filter(pc.is_valid(batch.column("key")))
        if inner.num_rows:
            yield pa.RecordBatch.from_arrays([inner.column("key"), inner.column("a"), inner.column("b"), pa.array(np.ones(inner.num_rows, bool))], names=names)
        rows = batch.filter(pc.is_valid(batch.column("packed")))
        for p, blob in zip(rows.column("part").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            if p != part and packed:
                yield from met(packed)
                packed = []
            part = p
            packed.append(blob)
    if packed:
        yield from met(packed)


def settle(texts: list[list], least: float, masks: np.ndarray, comps: np.ndarray, sides: np.ndarray | None = None, leader: int | None = None) -> list[tuple[int, int]]:
    """Links that join what is apart among texts (lists of words): a forest.

    Pairs count whose masks share a bit, whose comps differ, and, with sides, that are on different sides. The leader's are
    aligned first. The others that an alignment could join share one of the words that are rarest here, each repetition a word of its
    own: a text of n words may lose int((1 - least) n) of them, so one more, rarest first, can't all be lost. Of such pairs all words
    that both hold are counted, a text's pairs in one go, and those that hold enough in common are aligned unless they have been
    joined meanwhile, the most promising first.
    """
    m = len(texts)
    comp = np.unique(comps, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def join(i: int, j: int, counted: bool = False) -> None:
        if similar(texts[i], texts[j], least, counted):
            links.append((i, j))
            comp[comp == comp[j]] = comp[i]

    if leader is not None:
        for i in range(m):
            if comp[i] != comp[leader] and masks[i] & masks[leader]:
                join(leader, i)
    n = np.array([len(t) for t in texts])
    home = comp == np.bincount(comp).argmax()
    if home.all():
        return links
    words_of = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(n.sum()))
    text = np.repeat(np.arange(m), n)
    by = np.lexsort((words_of, text))
    run = np.arange(len(by)) - np.maximum.accumulate(np.where(_first_of(words_of[by], text[by]), np.arange(len(by)), 0))
    token, times = np.unique(mix(words_of[by].view(np.uint64) + mix(run.astype(np.uint64))), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    ranks = rank[token]
    by = np.lexsort((ranks, text))  # texts are in order in either, so places within a text are too
    ranks = ranks[by]
    most = ((1 - least) * n + 1e-9).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    held = np.arange(len(ranks)) - np.repeat(begin[:-1], n) <= np.repeat(most, n)
    shown, owner = ranks[held], text[held]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    by = np.argsort(shown, kind="stable")
    owners, edges = owner[by], np.searchsorted(shown[by], np.arange(len(times) + 1))
    here = np.zeros(len(times), bool)
    for i in np.flatnonzero(~home):
        mine = shown[starts[i] : starts[i + 1]]
        if not len(mine):
            continue
        near, shared = np.unique(np.concatenate([owners[edges[r] : edges[r + 1]] for r in mine]), return_counts=True)
        ok = (comp[near] != comp[i]) & ((masks[near] & masks[i]) != 0) & (home[near] | (near < i))
        ok &= np.abs(n[near] - n[i]) <= np.maximum(most[near], most[i])
        if sides is not None:
            ok &= sides[near] != sides[i]
        near = near[ok][np.argsort(-shared[ok], kind="stable")]
        if not len(near):
            continue
        of_i = ranks[begin[i] : begin[i + 1]]
        here[of_i] = True
        both = np.add.reduceat(here[np.concatenate([ranks[begin[j] : begin[j + 1]] for j in near])], np.cumsum(n[near]) - n[near], dtype=np.int64)
        here[of_i] = False
        for j in near[both >= np.maximum(n[near], n[i]) - np.maximum(most[near], most[i])].tolist():
            if comp[j] != comp[i]:
                join(i, j, True)
    return links


def _settler(least: float):
    """Rows of groups, one group after another, its leader first -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, {}

        def settled() -> pa.RecordBatch | None:
            held = list(rows.values())
            apart = len({r["comp"] for r in held}) > 1
            comps = np.array([r["comp"].hex() for r in held])
            sides = np.array([r["side"] for r in held])
            found = settle([words(r["text"]) for r in held], least, np.array([r["mask"] for r in held], np.int64), comps, None if held[0]["lead"] else sides, 0 if held[0]["lead"] else None) if apart else []
            rows.clear()
            if found:
                return pa.RecordBatch.from_arrays([pa.array([held[i]["node"] for i, _ in found], pa.binary()), pa.array([held[j]["node"] for _, j in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            texts = as_bytes(batch.column("text"))
            for k, row in enumerate(batch.select(names).to_pylist()):
                key = row["a"], row["i"], row["j"]
                if key != group:
                    if rows and (links := settled()):
                        yield links
                    group = key
                if row["node"] not in rows:
                    rows[row["node"]] = row | {"text": texts[k].as_py()}
        if rows and (links := settled()):
            yield links
        give_back()

    return run


def _chained(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same: each node with the least it is linked with, and that one with the others, each pair once.

    Members of a large group are linked in each of their groups, with much the same leaders; so those links become one a member and a
    few among leaders. A node is the greater end of no more links than blocks and keys allow, so a window holds them.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    least = links.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    pairs = least.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    return pairs.where("a <> b").distinct()


def _between(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (a, node, mask, block, n_blocks, ...) of groups of many blocks, for comparing what is in different components between blocks.

    The component that most of a group is in is its home: home blocks are compared with those of strays, and these with each other.
    """
    known = members.join(comps.select(F.col("node").alias("c_node"), "component"), F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("component", "node")).drop("c_node", "component")
    known = materialise(known, "apart")  # rows without texts
    homes = known.groupBy("a", "comp").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "comp")).alias("h"), F.count("*").alias("comps")).where("comps > 1").select("a", F.col("h.comp").alias("home"))
    known = salted_join(known, homes.withColumnRenamed("a", "h_a"), F.col("a") == F.col("h_a"), "node", 32).drop("h_a")
    known = materialise(known, "strays")
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    stray = F.col("comp") != F.col("home")
    columns = ["a", "node", "mask", "comp", "id", "hash"]
    parts = [
        known.where(~stray).select(*columns, F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side")),
        known.where(stray).select(*columns, F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")),
        # strays with strays: kinds apart by negative numbers, side by block; one's own block is settled
        known.where(stray).select(*columns, "block", F.explode(every).alias("k")).where("k <> block").select(*columns, (-1 - F.least("block", "k")).alias("i"), (-1 - F.greatest("block", "k")).alias("j"), (F.col("block") > F.col("k")).cast("int").alias("side")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("lead", F.lit(False))


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart, and null from all texts."""
    return F.xxhash64(text, F.octet_length(text))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.8, k: int = 5, sketches: int = 64, take: int = 2, block: int = 4096, short: int = 40, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, class_id, kept, node, n_words, text_hash.

    Texts are near-duplicates when 1 - (word edits between them) / (words of the longer) is at least `least`; classes are
    what is connected by such pairs, among those that share one of `sketches` keys of `take` ordered least k-mers (half of
    them of k words, half of k - 2); texts of up to `short` words have half as many keys of word pairs instead, and pairs that two
    edits at most set apart, where `least` allows no more, always share one.
    class_id is the least doc_id of the class; kept marks the rows that have it and the words of one text of the class.
    Words as in words.py, so case and marks don't matter. Wordless texts are duplicates when equal byte by byte; null
    texts are duplicates of nothing (class_id is their own id, kept is true). Rows equal in id and words are alike in
    all columns (drop_near_duplicates keeps one of them); null ids come last in their class, and a class of null ids
    alone has class_id null. Other columns aren't read. An empty table gives no rows.
    A task settles about block texts of block_bytes together; neither changes the result.
    """
    with scratch(docs.sparkSession) as tables:
        sketch = _sketcher(k, sketches, take, least, short)
        sk = docs.select(col(doc_id).alias("id"), text_hash(col(text)).alias("hash"), F.octet_length(col(text)).alias("size"), sketch(col(text)).alias("s"))
        sk = materialise(sk.select("id", "hash", "size", "s.node", "s.n_words", F.when(F.col("s.n_words") > 0, F.col("s.keys")).alias("keys")), "sketches")

        # about a million keys a part, whatever the table
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sk.count() * sketches >> 20)
        keyed = sk.where("keys IS NOT NULL").select("node", "keys").mapInArrow(_local_buckets(1 << 14, parts), _STARS)
        stars = materialise(keyed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_buckets, "key bigint, a binary, b binary, inner boolean"), "stars")
        outer = stars.where("NOT inner").select("key", "a", "b")
        led = outer.select(F.col("key").alias("k"), F.col("a").alias("above"), F.col("b").alias("below"))
        inner = stars.where("inner").join(led, (F.col("key") == F.col("k")) & (F.col("a") == F.col("below")), "left").select("key", F.coalesce("above", "a").alias("a"), "b")
        bit = F.expr("bit_or(shiftleft(1L, CAST(pmod(key, 64) AS INT)))")
        pairs = outer.unionByName(inner).groupBy("a", F.col("b").alias("node")).agg(bit.alias("mask"))
        heads = pairs.select("a").distinct().select("a", F.col("a").alias("node"), F.lit(-1).cast("long").alias("mask"))
        listed = pairs.unionByName(heads)

        # of each node one row stands for all
        same = sk.where("node IS NOT NULL").groupBy("node", "id", "hash").agg(F.count("*").alias("times"), F.first("size").alias("size"))
        reps = materialise(same.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "times", "size")).alias("rep"), F.sum("times").alias("n")), "nodes")
        members = listed.join(reps.select(F.col("node").alias("r"), F.col("rep.id").alias("id"), F.col("rep.hash").alias("hash"), F.col("rep.times").alias("times"), F.greatest("rep.size", F.lit(block_bytes // block)).alias("weight")), F.col("node") == F.col("r")).drop("r")
        members = materialise(members, "members")
        drop(stars)
        slim = materialise(sk.select("id", "node", "n_words", "hash"), "rows")
        drop(sk)
        # of a row that is repeated in id and text one stays
        here = docs.select(col(doc_id).alias("d_id"), text_hash(col(text)).alias("d_hash"), col(text).alias("text"))
        if members.where("times > 1").limit(1).count():
            here = here.groupBy("d_id", "d_hash").agg(F.first("text").alias("text"))

        def linked(rows: DataFrame) -> DataFrame:
            full = here.join(rows, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_hash") == F.col("hash"))).select("a", "i", "j", "lead", "node", "comp", "side", "mask", "text")
            groups = full.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", F.desc("lead"), "node")
            return materialise(_chained(groups.mapInArrow(_settler(least), "a binary, b binary")), "links")

        large = materialise(members.groupBy("a").agg(F.sum("weight").alias("weight")).where(F.col("weight") > block_bytes).select("a", F.ceil(F.col("weight") / block_bytes).cast("int").alias("n_blocks")), "large")
        some_large = large.limit(1).count() > 0
        if some_large:
            members = salted_join(members, large.withColumnRenamed("a", "l_a"), F.col("a") == F.col("l_a"), "node", 32, "left").drop("l_a").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        else:
            members = members.withColumn("n_blocks", F.lit(1))
        members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        # a leader goes to every block of its group
        first = members.withColumn("i", F.explode(F.when(F.col("node") == F.col("a"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("block"))))
        links = linked(first.select("a", "i", F.lit(0).alias("j"), (F.col("node") == F.col("a")).alias("lead"), "node", F.col("node").alias("comp"), F.lit(0).alias("side"), "mask", "id", "hash"))
        found = components(links)
        if some_large:
            more = linked(_between(members.where("n_blocks > 1"), found))
            if more.limit(1).count():
                found = components(links.unionByName(more))

        # classes by node, then rows by node
        named = reps.join(found.select(F.col("node").alias("f"), F.col("component").alias("comp")), F.col("node") == F.col("f"), "left").select("node", "n", F.struct("rep.no_id", "rep.id", "node").alias("own"), "comp")
        best = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("own").alias("least_own"))
        classes = materialise(salted_join(named, best.withColumnRenamed("comp", "b_comp"), F.col("comp") == F.col("b_comp"), "node", 8, "left").select("node", "n", F.coalesce("least_own", "own").alias("best")), "classes")
        tables.keep(slim, classes)
    rows = spread_join(slim, classes.select("node", "best"), classes.select("node", "n"))
    alone = F.col("best").isNull()
    class_id = F.when(alone, F.col("id")).otherwise(F.col("best.id"))
    kept = alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")))
    return rows.select(F.col("id").alias(doc_id), class_id.alias("class_id"), kept.alias("kept"), "node", "n_words", F.col("hash").alias("text_hash"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without all but one document of each class of near_duplicates(); null texts all stay. Columns stay as they are, whatever their names."""
    with scratch(docs.sparkSession) as tables:
        marks = near_duplicates(docs, text, doc_id, **options).where("kept AND node IS NOT NULL")
        # rows of a node may differ in case or marks: one text of each
        keep = marks.groupBy(col(doc_id).alias("id"), "node").agg(F.min("text_hash").alias("hash"), F.count("*").alias("times"))
        keep = materialise(keep.select(F.col("id").alias("k_id"), F.col("hash").alias("k_hash"), "times"), "kept")
        tables.keep(keep)
    there = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(doc_id).alias("id"), text_hash(col(text)).alias("hash"))
    joined = there.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    once = joined.where("times = 1").select("row")
    if keep.where("times > 1").limit(1).count():
        # equal in id and text, so one of them is as good as the other: the first is drawn on the side of the map already
        once = once.unionByName(joined.where("times > 1").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*").unionByName(docs.where(col(text).isNull()))
