from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hexaloom.llm.packing import _fits, best_fit, complete_bins, fillings, lower_bound, pack_documents
from hexaloom.llm.tokenfile import pack, read_range, read_tokens, unpack, width, write_tokens
from hexaloom.llm.tokens import Encoder

FILES = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
KNOWN = {k: Encoder(f, k, limit=10_000) for k, f in FILES.items()}
PLAIN = {k: Tokenizer.from_file(f) for k, f in FILES.items()}
ODD = ["", "a  b", "  a", "a ", "\n", "a\n b", "a \nb", "a\n\n  b c", "it's  he'll 'tis don't", "x' s", "ΑΣ ΣΑΣ. İstanbul", "é ́ x", "a\x1cb c\x85d", "12 34a a12, 5%", "<|endoftext|> y", "a<|endoftext|>b <|startoftext|>", "x <|EndOfText|> y\n<|endoftext|", "1 < 2 <| x", "a b  c", "日本 語。", "_a_ a_b -- x--", "ﬁ ǅ", "the,\nThe. the, THE", "a!b! 'a 's"]
TEXT = st.text(st.sampled_from(list("aAéÉñ ,.'\n\t 19_-! 日́")), max_size=40)


def ids(kind, text):
    return PLAIN[kind].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(["byte", "word"]))
def test_pieces_give_the_same_ids(text, kind):
    assert np.frombuffer(KNOWN[kind].encode(text), "<u4").tolist() == ids(kind, text)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_odd_texts(kind):
    for text in ODD * 2:
        assert np.frombuffer(KNOWN[kind].encode(text), "<u4").tolist() == ids(kind, text), text
    assert KNOWN[kind].encode(None) == b""
    with pytest.raises(ValueError):
        Encoder(FILES[kind], "other")
    spelt = Encoder(FILES[kind], kind, specials=False)
    last = PLAIN[kind].token_to_id("<|endoftext|>")
    assert last in ids(kind, "a <|endoftext|>") and last not in np.frombuffer(spelt.encode("a <|endoftext|>"), "<u4")


def test_memory_is_bounded_by_bytes():
    e = Encoder(FILES["byte"], "byte", limit=100_000)
    for i in range(5000):
        e.encode(f"q{i}z word{i * 7} x")
        for m in (e.pieces, e.heads, e.marks):
            assert m.held < m.limit + 1000 and len(m.old) * 190 < m.limit + 1000
    assert len(e.pieces.old) > 100


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_words_met_once_take_one_place_of_the_memory(kind):
    e = Encoder(FILES[kind], kind)
    once = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}x{mark}" for i, mark in enumerate(["", ",", ".", '")', "é", "é!"] * 60)]
    text = " ".join(["a", *once])
    held = []
    for _ in range(3):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids(kind, text)
        held.append(len(e.pieces))
    plain = {p.rstrip(',.")!') for p in once}
    assert held[0] <= len(plain) + 1 < held[2]  # with their marks from the second time on


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(bits, data):
    values = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=200)), np.uint32)
    packed = pack(values, bits)
    assert len(packed) == (len(values) * bits + 7) // 8
    a = data.draw(st.integers(0, len(values)))
    n = data.draw(st.integers(0, len(values) - a))
    assert unpack(packed, bits, a, n).tolist() == values[a : a + n].tolist()


def test_widths():
    assert [width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    big = np.arange(200_001, dtype=np.uint32) % 2047
    assert (unpack(pack(big, 11), 11, 65_530, 100_000) == big[65_530:165_530]).all()


def test_token_file_round_trip(spark, tmp_path):
    texts = [None, *ODD, "word " * 30_000, "same", "same"]
    rows = [(3 * i % 29 if i < 24 else 100, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = f"file://{tmp_path}/t"
    write_tokens(docs, path, FILES["word"], "word", 2, shards=3, block_ids=64)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    expected, start = [], 0
    for d, t, _ in order:
        x = np.array([*ids("word", t or ""), 2], "<u4")
        expected.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = [tuple(r) for r in read_tokens(spark, path, digest=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read_tokens(spark, path).orderBy("start").collect()])
    for a, z in ((0, 1), (100, 700), (0, len(whole)), (len(whole) - 3, len(whole) + 9), (5, 5), (len(whole), len(whole) + 4)):
        parts = read_range(spark, path, a, z).orderBy("start").collect()
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts] or [whole[:0]]).tolist() == whole[a:z].tolist()
        assert not parts or parts[0].start == a
    full = read_tokens(spark, path).orderBy("start").first()
    assert np.frombuffer(full.ids, "<u4").tolist() == [*ids("word", order[0][1] or ""), 2]
    assert spark.read.parquet(path).selectExpr("max(bits)", "count(*) > 3").first()[:] == (16, True)
    write_tokens(docs.limit(0), f"{path}0", FILES["word"], "word", 2, shards=2)
    assert read_tokens(spark, f"{path}0").count() == 0 and read_range(spark, f"{path}0", 0, 9).count() == 0
    # one id in most rows: no part holds them all
    same = spark.range(400).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    write_tokens(same, f"{path}1", FILES["word"], "word", 2, shards=4, block_ids=64)
    sizes = [r[0] for r in spark.read.parquet(f"{path}1").selectExpr("shard", "size(doc_ids) AS n").groupBy("shard").sum("n").select("sum(n)").collect()]
    assert len(sizes) == 4 and sum(sizes) == 400 and max(sizes) < 250
    assert read_tokens(spark, f"{path}1").count() == 400


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bins_are_as_few_as_can_be(lengths):
    lengths = sorted(lengths, reverse=True)
    counts = {x: lengths.count(x) for x in lengths}
    for patterns in (best_fit(counts, 20), complete_bins(counts, 20)):
        assert all(sum(f) <= 20 for f, _ in patterns)
        held = sorted((x for f, n in patterns for _ in range(n) for x in f), reverse=True)
        assert held == lengths
    assert sum(n for _, n in complete_bins(counts, 20)) == optimum(lengths, 20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(1, 20))
def test_fillings_leave_out_dominated_ones_only(lengths, room):
    counts = Counter(lengths)
    got = list(fillings(counts, room))
    assert len(set(got)) == len(got) and [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
    assert all(not Counter(f) - counts and list(f) == sorted(f, reverse=True) for f in got)
    every = {tuple(sorted(c, reverse=True)) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room}
    assert set(got) <= every
    for f in every:
        assert any(_fits(f, list(k)) for k in got)
    for f in got:
        assert all(sum(f) + x > room for x in counts - Counter(f))


def test_search_goes_on_beyond_many_lengths():
    rng = random.Random(3)
    counts = Counter(rng.randint(300, 1100) for _ in range(400))
    patterns = complete_bins(counts, 2048, nodes=800)
    assert sum((Counter({x: n * f.count(x) for x in set(f)}) for f, n in patterns), Counter()) == counts
    assert lower_bound(counts, 2048) <= sum(n for _, n in patterns) <= sum(n for _, n in best_fit(counts, 2048))


def test_completion_beats_best_fit():
    counts = {7: 2, 6: 2, 4: 2, 3: 2}  # best fit decreasing: 7+3, 7+3, 6+4, 6+4
    assert sum(n for _, n in complete_bins(counts, 10)) == 4
    worse = {11: 1, 9: 1, 8: 1, 7: 1, 5: 2, 3: 1}  # 48 = 2 * 24
    assert sum(n for _, n in complete_bins(worse, 24)) == 2
    assert complete_bins({}, 8) == []
    with pytest.raises(ValueError):
        complete_bins({9: 1}, 8)


def test_packing_of_documents(spark):
    texts = [None, "", *ODD, "word " * 300, "other word " * 41, *["same text"] * 9]
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    rows = pack_documents(docs, FILES["byte"], "byte", 0, capacity=64, keep_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        x = [*ids("byte", t or ""), 0]
        ps = sorted(by_doc[i if i else None], key=lambda r: r.piece)
        assert [p.start for p in ps] == [0, *range(len(x) % 64 or 64, len(x), 64)] and sum(p.length for p in ps) == len(x)
        assert np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist() == x
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and p.length <= 64 for p in ps)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == -(-sum(r.length for r in rows) // 64)
    assert pack_documents(docs.limit(0), FILES["byte"], "byte", 0).count() == 0
