from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hexaloom.llm import neardup
from hexaloom.llm.alignment import _apart, banded, edit_distance, path_cost, similar, similarity
from hexaloom.llm.components import components
from hexaloom.llm.neardup import drop_near_duplicates, near_duplicates, settle
from hexaloom.llm.shingles import kmers, order_min_hash, word_hashes
from hexaloom.llm.words import words


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(0, 20))
def test_banded_alignment_is_the_edit_distance(a, b, most):
    d = table_distance(a, b)
    assert edit_distance(a, b, most) == (d if d <= most else most + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 45), st.sampled_from([0.0, 0.3, 0.6, 0.8, 1.0]))
def test_a_band_never_gives_less_than_the_distance(a, b, band, least):
    d, n = table_distance(a, b), max(len(a), len(b))
    got = banded(a, b, band, n)
    assert got >= d and (got == d or d > band)
    assert path_cost(a, b, 2 * n) >= d
    assert similar(a, b, least) == (not n or 1 - d / n >= least - 1e-12)
    assert banded(a, b, band, n) > int((1 - least) * n + 1e-9) or similar(a, b, least, counted=True)


def test_similarity():
    a = list(range(1000))
    b = a[:100] + [-1] * 50 + a[150:900] + a[950:]
    assert abs(similarity(a, b, 0.8) - 0.9) < 1e-9 and similarity(a, b, 0.95) == 0.0
    assert similarity([], [], 0.8) == 1.0 and similarity([1], [], 0.8) == 0.0


def test_hashes_do_not_depend_on_the_batch():
    texts = ["A b  c, d", "", "é x1", "a b c d", "...", "b"]
    data = [t.encode() for t in texts]

    def sketch(part):
        at = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        hashes, first = word_hashes(np.frombuffer(b"".join(part), np.uint8), at)
        labelled, begin = kmers(hashes, first, 2)
        return [hashes[a:z].tolist() for a, z in zip(first, first[1:])], order_min_hash(labelled, begin, 8).tolist()

    whole = sketch(data)
    single = [sketch([t]) for t in data]
    assert whole[0] == [s[0][0] for s in single] and whole[1] == [s[1][0] for s in single]
    assert whole[0][0] == whole[0][3] and [len(w) for w in whole[0]] == [len(words(t)) for t in data]
    assert whole[1][1] == [0] * 8


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 4), (None, 9), (7, 6), (3, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 6: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    origins = [say(n) for n in (60, 200, 30, 2500, 120)]
    texts = [" ".join(o) for o in origins]
    for o in origins:
        for share in (0.02, 0.05, 0.08):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in o) + "!")
    header = " ".join(say(12))
    texts += [header + " " + " ".join(say(rng.randint(5, 40))) for _ in range(40)]  # one passage in many
    texts += [texts[0].upper()] * 6 + [None, None, "", "", "?!", "?!", "a b", "a b", "A, b.", "a c"]
    return texts


def brute(texts, least=0.8):
    group = list(range(len(texts)))
    split = [words(t.encode()) if t is not None else None for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = split[i], split[j]
            if a is None or b is None:
                continue
            if (similarity(a, b, least) >= least if a and b else not a and not b and texts[i] == texts[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    expected = brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == expected
    assert [got[i].kept for i in range(len(texts))] == [g == i for i, g in enumerate(expected)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g in enumerate(expected) if g == i]
    # blocks of one pair each find the same
    assert {r.doc_id: r.class_id for r in near_duplicates(docs, block=2).collect()} == {i: g for i, g in enumerate(expected)}


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(5, long), (5, long), (None, long), (None, "only nulls here at all"), (None, None)], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.class_id) for r in rows if r.class_id) == [(False, 5), (False, 5), (True, 5)]
    assert drop_near_duplicates(docs).count() == 3
    assert near_duplicates(docs.limit(0)).count() == 0


def test_scattered_edits_at_the_threshold(spark):
    rng = random.Random(4)
    texts = []
    for n in [*range(5, 17), 20, 25, 32, 41, 45, 50, 51, 60, 100, 300]:
        for t in range(6):
            a = [f"n{n}t{t}w{i}" for i in range(n)]
            edits = n // 5
            # spread evenly, the first pair of each length, else anywhere
            at = [i * n // edits + min(2, n // edits - 1) for i in range(edits)] if not t else rng.sample(range(n), edits)
            b = [w if i not in at else f"{w}x" for i, w in enumerate(a)]
            texts += [a, b]
    # left out only: eight words of ten
    a = [f"q{i}" for i in range(10)]
    texts += [a, a[:3] + a[4:7] + a[8:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    short = [i for i in range(0, len(texts), 2) if len(texts[i]) <= 14]
    assert all(got[i + 1] == i for i in short)
    found = [got[i + 1] == i for i in range(0, len(texts), 2)]
    assert sum(found) / len(found) > 0.98


def test_texts_of_one_long_repeated_line_are_aligned_only_if_their_words_allow_it(monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    line = ["is", "on", "he"] * 70  # of 300 words 210 are one line again and again
    origins = [[rng.choice(vocabulary) for _ in range(90)] for _ in range(20)]
    texts = [o + line for o in origins] + [[w if rng.random() > 0.3 else f"new{k}" for w in o] + line for k, o in enumerate(origins)]
    m, aligned = len(texts), []
    expected = [i % 20 for i in range(m)]
    assert all((similarity(texts[i], texts[j], 0.8) > 0) == (expected[i] == expected[j]) for i in range(m) for j in range(i))
    monkeypatch.setattr(neardup, "similar", lambda a, b, *more: aligned.append((a, b)) or similar(a, b, *more))
    links = settle(texts, 0.8, np.ones(m, np.int64), np.arange(m))
    assert sorted(tuple(sorted(x)) for x in links) == [(i, i + 20) for i in range(20)]
    assert len(aligned) < 3 * m  # of 780 pairs
    assert all(_apart(a, b) <= 60 for a, b in aligned)
