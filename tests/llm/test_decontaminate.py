from __future__ import annotations

import random

import pyarrow as pa

from hexaloom.llm import decontaminate
from hexaloom.llm.decontaminate import Searcher, item_blocks, mark_benchmark, merged
from hexaloom.llm.words import words


def brute(text, items, window):
    w = words((text or "").encode())
    hit, names = set(), set()
    for name, t in items:
        p = words((t or "").encode())
        for a in range(max(1, len(p) - window + 1) if p else 0):
            pattern = p[a : a + window]
            for i in range(len(w) - len(pattern) + 1):
                if w[i : i + len(pattern)] == pattern:
                    hit.update(range(i, i + len(pattern)))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def test_words():
    assert words("A-bÉc, dé9\n\x7f_x".encode()) == ["a".encode(), "bÉc".encode(), "dé9".encode(), b"x"]
    assert words(None) == [] and words(b"") == []


def test_searcher_finds_what_brute_force_finds():
    rng = random.Random(4)
    for block in (1, 2, 3):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
        items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.choice([4, 4, 5, 9]))] for _ in range(9)]
        searcher = Searcher(4, block)
        for k, item in enumerate(items):
            searcher.add(item, k)
        found = list(searcher.find(text))
        assert [at for at, _ in found] == sorted(at for at, _ in found)
        assert sorted(found) == sorted((i, k) for i in range(397) for k, item in enumerate(items) for j in range(len(item) - 3) if item[j : j + 4] == text[i : i + 4])
    assert merged([(3, 5), (0, 2), (4, 9), (2, 3)]) == [(0, 9)]


def test_blocks_hold_every_window_once_and_are_small():
    rng = random.Random(6)
    items = [(f"i{k}", " ".join(f"w{rng.randint(0, 99999)}" for _ in range(rng.choice([0, 3, 10, 30, 4000]))).encode()) for k in range(60)]
    windows = lambda t, n=10: [tuple(w[a : a + n]) for w in [words(t)] for a in range(max(1, len(w) - n + 1)) if w]
    blocks = list(item_blocks(iter(items), 10, 4000))
    assert len(blocks) > 50 and max(sum(len(t) + len(n) for n, t in b) for b in blocks) < 4800
    assert sorted((n, w) for n, t in items for w in windows(t)) == sorted((n, w) for b in blocks for n, t in b for w in windows(t))
    assert list(item_blocks([("a", None), ("b", b"..")], 10, 100)) == []


def test_one_block_of_tables_is_held_at_a_time(spark):
    sizes = []

    class Kept(dict):
        def __setitem__(self, key, value):
            super().__setitem__(key, value)
            sizes.append(len(self))

    rng = random.Random(8)
    items = [(f"i{k}", " ".join(f"w{rng.randint(0, 300)}" for _ in range(40))) for k in range(60)]
    tables = [(str(k), spark.sparkContext.broadcast(b)) for k, b in enumerate( item_blocks(((n, t.encode()) for n, t in items), 10, 1000))]
    assert len(tables) > 10
    before, decontaminate._BUILT = decontaminate._BUILT, Kept()
    try:
        texts = [items[3][1] + " x " + items[50][1], None, "none"]
        got = list(decontaminate._marker(tables, 10, 3).func(iter([pa.array(texts, pa.string()), pa.array(["a"], pa.string())])))
    finally:
        decontaminate._BUILT = before
    assert sizes == [1] * len(tables)
    assert [r["items"] for r in got[0].to_pylist()] == [["i3", "i50"], [], []] and [len(g) for g in got] == [3, 1]
    assert [r["n_words"] for r in got[0].to_pylist()] == [81, 0, 1]


def test_all_cases(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "x", "Yé", "q1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [("b1", say(14)), ("b2", say(5)), ("b2", say(12)), ("b3", None), ("b4", ""), ("b5", "THE of x"), (None, "the of")]
    texts = [None, "", "...", "the of x", items[0][1].upper() + "! " + say(50), say(3000), items[1][1], items[1][1]] + [say(rng.randint(0, 60)) + ", " + items[rng.randint(0, 2)][1] for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS N_HIT", "2 AS other")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (64 << 20, 10):  # one broadcast, or several
        out = {r.doc_id: r for r in mark_benchmark(docs, bench, broadcast_bytes=limit).collect()}
        assert set(docs.columns) - {"N_HIT"} <= set(out[0].asDict())
        for i, t in enumerate(texts):
            n, hit, names = brute(t, [x for x in items if x[0]], 10)
            assert (out[i].n_words, out[i].n_hit, list(out[i].hit_items), out[i].contaminated) == (n, hit, names, hit > 0), t
    assert mark_benchmark(docs.limit(0), bench).count() == 0
    assert mark_benchmark(docs, bench.limit(0)).where("contaminated").count() == 0
