from __future__ import annotations

import random
import zlib

import pytest

from hexaloom.llm.sharding import assign_shards, write_shards


def corpus(hot):
    rng = random.Random(3)
    texts = [None, "", "é"] + ["x" * rng.randint(0, 300) + str(i) for i in range(900)] + ["y" * 20_000]
    return texts + ["the very same text"] * hot


@pytest.mark.parametrize(("hot", "options"), [(0, {}), (700, {}), (700, {"ranges_per_shard": 1, "draws_per_range": 2})])
def test_law_and_slots(spark, hot, options):
    texts = corpus(hot)
    docs = spark.createDataFrame([(i, t, "mine", 3) for i, t in enumerate(texts)], "doc_id long, text string, Shard string, extra int")
    rows = assign_shards(docs, shards=7, **options).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and rows[0].extra == 3
    total, most = 0, 0
    held: dict[int, list] = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "bytes")
        total, most = total + r["size"], max(most, r["size"])
        held.setdefault(r.shard, []).append(r)
    assert set(held) <= set(range(7))
    for s in range(7):
        assert abs(sum(r["size"] for r in held.get(s, [])) - total / 7) <= 2 * most
        assert sorted(r.slot for r in held.get(s, [])) == list(range(len(held.get(s, []))))
    if hot:
        assert len({r.shard for r in rows if texts[r.doc_id] == texts[-1]}) <= 5
    small = [r for r in rows if r["size"] < 400]
    assert len(small) == len(rows) - 1


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (1, None)], "doc_id long, text string")
    rows = assign_shards(docs, shards=2).collect()
    assert len(rows) == 5 and abs(sum(r["size"] for r in rows if r.shard == 0) - 41) <= 17
    assert assign_shards(docs.limit(0), shards=2).count() == 0
    write_shards(docs, f"file://{tmp_path}/s", shards=2)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 5


def test_shards_equal_a_sorted_list(spark):
    texts = corpus(0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS k").collect()}
    sizes = [len((t or "").encode()) + 16 for t in texts]
    total, at, expected, slots = sum(sizes), 0, {}, {}
    for i in sorted(range(len(texts)), key=lambda i: (keys[i], i)):
        at += sizes[i]
        s = min(6, int((at - sizes[i] / 2) * 7 / total))
        expected[i] = s, slots.get(s, 0)
        slots[s] = slots.get(s, 0) + 1
    for options in ({}, {"ranges_per_shard": 3, "draws_per_range": 4}):
        assert {r.doc_id: (r.shard, r.slot) for r in assign_shards(docs, shards=7, **options).collect()} == expected


def test_parts_follow_the_bytes(spark):
    texts = corpus(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = assign_shards(docs, shards=3, ranges_per_shard=1, part_bytes=1000).collect()
    total = sum(r["size"] for r in rows)
    for s in range(3):
        assert abs(sum(r["size"] for r in rows if r.shard == s) - total / 3) <= 2 * 20_016
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
