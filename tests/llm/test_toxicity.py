from __future__ import annotations

import inspect
import itertools
import math
import random

import numpy as np
import pytest

from hexaloom.llm.toxicity import Field, _words, fit_toxicity, score_toxicity, word_features

VOCABULARY = [a + b for a in ("ban", "tor", "mel", "kis", "rul") for b in ("do", "nam", "ite", "ser", "lu", "gaf")]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["vilest", "hatexo" + rng.choice("abcdef") + rng.choice("uvw")]))
        rows.append((i, " ".join(text).capitalize() + ".", int(toxic)))
    return rows


def test_features():
    assert word_features("éabcdef".encode()) == ["=éabcdef", "éabc", "éabcd", "éabcde"]


def test_marginals_equal_brute_force():
    field = Field({"=bad": 3.0, "=odd": -1.0, "hate": 2.0}, -2.0, np.array([[0.0, -0.5], [0.3, 0.9]]))
    rng = random.Random(1)
    for _ in range(30):
        text = [rng.choice([b"bad", b"odd", b"hatex", b"fine", b"so"]) for _ in range(rng.randint(0, 9))]
        at, p = field.marginals(text)
        assert at.tolist() == [i for i, w in enumerate(text) if w in (b"bad", b"odd", b"hatex")]
        mass, each = 0.0, np.zeros(len(text))
        for labels in itertools.product((0, 1), repeat=len(text)):
            score, past = 0.0, 0
            for w, y in zip(text, labels, strict=True):
                score += field.moves[past, y] + y * (field.bias + field.known[w])
                past = y
            mass += math.exp(score)
            each += math.exp(score) * np.array(labels)
        assert np.allclose(p, (each / mass)[at])


def test_long_runs_are_exact():
    field = Field({"=bad": 2.0}, -1.5, np.array([[0.0, -0.2], [0.1, 1.2]]))
    for gap in (0, 1, 127, 128, 129, 400):
        text = [b"bad", *[b"x"] * gap, b"bad", *[b"y"] * 150]
        step = np.exp(field.moves)
        odds = [np.exp(field.bias + field.known[w]) for w in text]
        ahead, now = [], np.array([1.0, 0.0])
        for o in odds:
            now = now @ step * np.array([1.0, o])
            now /= now.sum()
            ahead.append(now)
        p, after = [], np.ones(2)
        for k in range(len(text) - 1, -1, -1):
            both = ahead[k] * after
            p.append(both[1] / both.sum())
            after = step @ (after * np.array([1.0, odds[k]]))
            after /= after.sum()
        at, got = field.marginals(text)
        assert np.allclose(got, np.array(p[::-1])[at], atol=1e-9), gap


def test_scripts_without_blanks_and_long_words():
    assert _words("Één wörd 日本x語 คำ don’t".encode()) == [w.encode() for w in ("Één", "wörd", "日", "本", "x", "語", "ค", "ำ", "don’t")]
    assert _words("plain Text, 1".encode()) == [b"plain", b"text", b"1"] and _words(None) == []
    long = b"a" * 60
    assert word_features(long)[0] == "=" + "a" * 60
    field = Field({"=" + "a" * 60: 3.0}, -1.0)
    assert field.marginals([long])[0].tolist() == [0] and not len(field.marginals([long[:50]])[0])


def test_long_texts_are_drawn(spark):
    rows = [(i, "ban tor " * 6000 + t, y) for i, t, y in corpus(60, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert fit_toxicity(df, df).weights
    # one text at most fits here: nothing to learn from
    assert not fit_toxicity(df, df, total_bytes=50_000).weights


@pytest.fixture(scope="module")
def model(spark):
    labelled = spark.createDataFrame(corpus(1200, 1), "doc_id long, text string, toxic int")
    return fit_toxicity(labelled, labelled)


def test_held_out_accuracy_and_spans(spark, model):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows], "doc_id long, text string, Toxic string")
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    right = sum(got[i].toxic == bool(y) for i, _, y in rows)
    assert right >= 390 and all(0 <= r.toxicity <= 1 for r in got.values())
    for i, t, y in rows:
        for s in got[i].toxic_spans:
            word = t[s.start : s.stop].lower()
            assert not y or word.startswith(("vil", "hatexo"))
    assert sum(len(got[i].toxic_spans) > 0 for i, _, y in rows if y) > 0.9 * sum(y for *_, y in rows)


def test_odd_texts_and_tables(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "É vilest " * 20_000), (5, "vilest"), (5, "vilest")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert got[1].toxicity == got[2].toxicity == got[3].toxicity < 0.3 < got[4].toxicity
    assert got[4].toxic_spans[0][:2] == (2, 8)
    assert score_toxicity(docs.limit(0), model).count() == 0
    for labelled in ([], [(1, "a", 0)], [(1, None, 1), (2, "b", None)]):
        df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
        plain = fit_toxicity(df, df)
        assert score_toxicity(docs, plain).where("toxic").count() == 0


def test_the_whole_sample_is_drawn():
    assert inspect.signature(fit_toxicity).parameters["rows"].default >= 6000
