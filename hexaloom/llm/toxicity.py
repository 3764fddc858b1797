"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, the field needs labelled words. So words are labelled first: a word of a toxic
document is toxic if it, or a beginning of it, is met in toxic documents far more often than in others.
The field then learns from word windows the weights of words and beginnings and of passing between clean
and toxic. Forward-backward gives each word's marginal; a logistic curve, fitted on documents that the
field hasn't seen, turns a document's marginals into its score. Words without any known feature share one
emission, so runs of them are powers of one matrix, and only known words need steps of their own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import col, give_back, others
from .words import WORD_BYTES, as_bytes, words

_BEGINNINGS = range(4, 10)
_WINDOW = 24
#: First bytes and ranges, in UTF-8, of scripts that are written without blanks between words (Thai to Tibetan, Burmese, Khmer,
#: Chinese and Japanese): there each letter is a word.
_ALONE = rb"\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe2[\xba-\xbf][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xbc-\xbf][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
_WORD = re.compile(rb"(?:" + _ALONE + rb")|(?:(?!" + _ALONE + rb")[0-9a-z\x80-\xff])+")
_COMMON = bytes(b for b in range(256) if b not in (*range(0xE0, 0xEA), 0xEF, 0xF0))


def _words(text: bytes | None) -> list[bytes]:
    """words(), but that letters of scripts without blanks stand each for itself."""
    if not text or not text.translate(None, _COMMON):
        return words(text)
    return _WORD.findall(text.translate(WORD_BYTES))


def word_features(word: bytes) -> list[str]:
    """The word itself and its beginnings of 4 to 9 letters, by code points."""
    w = word.decode("utf-8", "replace")
    return ["=" + w, *(w[:k] for k in _BEGINNINGS if len(w) > k)]


def _feature(word: bytes, k: int) -> str | None:
    """The feature of one length: 0 for the word itself."""
    w = word.decode("utf-8", "replace")
    return "=" + w if not k else w[:k] if len(w) > k else None


@dataclass
class Field:
    """A fitted model: weights of features, of the toxic label, of transitions (from, to), and of the score's inputs."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0, 0, 0, 0, 0]))

    def __post_init__(self):
        step = np.exp(self.moves) * np.array([1.0, math.exp(self.bias)])
        self.runs = _Powers(step)
        self.known: dict[bytes, float] = _Emissions(self.weights)

    def marginals(self, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words with known features, and the chance that each is toxic given all words of the text."""
        emissions = np.fromiter(map(self.known.__getitem__, text), np.float64, len(text))
        at = np.flatnonzero(emissions)
        if not len(at):
            return at, np.empty(0)
        (oo, ot), (to, tt) = np.exp(self.moves).tolist()
        gaps = np.diff(at, prepend=-1) - 1
        tail = self.runs[len(text) - 1 - int(at[-1])]
        odds = np.exp(np.clip(emissions[at] + self.bias, -30, 30)).tolist()
        runs = [self.runs[g] for g in gaps.tolist()]
        ahead, c, x = [], 1.0, 0.0  # clean and toxic mass before each known word's emission
        for k, (a, b, d, e) in enumerate(runs):
            c, x = c * a + x * d, c * b + x * e
            c, x = c * oo + x * to, c * ot + x * tt
            ahead.append((c, x))
            x *= odds[k]
            s = c + x
            c, x = c / s, x / s
        out = np.empty(len(at))
        a, b, d, e = tail
        c, x = a + b, d + e
        for k in range(len(at) - 1, -1, -1):
            clean, toxic = ahead[k][0] * c, ahead[k][1] * odds[k] * x
            out[k] = toxic / (clean + toxic)
            x *= odds[k]
            c, x = oo * c + ot * x, to * c + tt * x
            a, b, d, e = runs[k]
            c, x = a * c + b * x, d * c + e * x
            s = c + x
            c, x = c / s, x / s
        return at, out

    def score(self, n_words: int, p: np.ndarray) -> float:
        z = float(self.curve @ inputs(n_words, p))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class _Powers(dict):
    """n -> the n-th power of a matrix, over the sum of its entries, by squaring. Holds a bounded number of them."""

    def __init__(self, step: np.ndarray):
        super().__init__()
        self.squares = [step / step.sum()]

    def __missing__(self, n: int) -> tuple[float, ...]:
        out, left, k = np.eye(2), n, 0
        while left:
            if k == len(self.squares):
                twice = self.squares[-1] @ self.squares[-1]
                self.squares.append(twice / twice.sum())
            if left & 1:
                out = out @ self.squares[k]
                out = out / out.sum()
            left, k = left >> 1, k + 1
        if len(self) > 10_000:
            self.clear()
        self[n] = value = tuple(map(float, out.ravel()))
        return value


class _Emissions(dict):
    """Word -> sum of its features' weights, 0 if none is known. Holds a bounded number of words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        value = float(sum(self.weights.get(f, 0.0) for f in word_features(word)))
        if len(word) < 200:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value

    def __reduce__(self):
        return _Emissions, (self.weights,)


def inputs(n_words: int, p: np.ndarray) -> np.ndarray:
    """What a score is made of: a constant, expected toxic words, the surest, their density, sure ones, length."""
    total = float(p.sum())
    return np.array([1.0, math.log1p(total), float(p.max()) if len(p) else 0.0, math.log1p(100 * total / max(n_words, 20)), math.log1p(int((p > 0.5).sum())), math.log1p(n_words) / 5])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - y)) + keep * w)
        w -= np.clip(step, -2, 2)
    return w


def _fit_chain(texts: list[tuple[list[bytes], bool]], epochs: int = 120) -> Field:
    """Label the words of labelled documents, and fit the field to windows around words with features."""
    n = [sum(not y for _, y in texts), sum(y for _, y in texts)]
    if not n[0] or not n[1]:
        return Field()
    # one length of beginnings at a time, so that rare ones, which are most, are never held together
    enough = max(4, n[1] / 150)
    often: dict[str, int] = {}
    for k in (0, *_BEGINNINGS):
        met: Counter[str] = Counter()
        for text, toxic in texts:
            if toxic:
                met.update({f for w in set(text) if (f := _feature(w, k))})
        often.update((f, c) for f, c in met.items() if c >= enough)
    # copies of one text prove nothing: a feature has to follow as many different words, too
    contexts: dict[str, set[bytes]] = {f: set() for f in often}
    elsewhere: Counter[str] = Counter()
    for text, toxic in texts:
        if toxic:
            for past, w in zip([b"", *text], text):
                for f in word_features(w):
                    if f in contexts and len(contexts[f]) < enough:
                        contexts[f].add(past)
        else:
            elsewhere.update({f for w in set(text) for f in word_features(w) if f in often})
    kept: dict[str, float] = {}
    for f, c1 in often.items():
        c0 = elsewhere[f]
        if len(contexts[f]) >= enough:
            apart = math.log((c1 + 0.5) / (n[1] + 1)) - math.log((c0 + 0.5) / (n[0] + 1))
            if apart >= 1:
                kept[f] = apart - math.sqrt(1 / c1 + 1 / (c0 + 1))  # what is sure of it
    number = {f: k for k, f in enumerate(kept)}
    own: dict[bytes, list[int]] = {}
    told: dict[bytes, bool] = {}
    for w in {w for text, _ in texts for w in text}:
        if mine := [f for f in word_features(w) if f in number]:
            own[w] = [number[f] for f in mine]
            told[w] = max(kept[f] for f in mine) >= 2
    windows, labels = [], []
    for text, toxic in texts:
        next_free = 0
        for i, w in enumerate(text):
            if w in own and i >= next_free:
                a = max(0, min(i - _WINDOW // 2, len(text) - _WINDOW))
                windows.append(text[a : a + _WINDOW])
                labels.append([toxic and told.get(x, False) for x in windows[-1]])
                next_free = a + _WINDOW
        if not next_free and text:
            windows.append(text[:_WINDOW])
            labels.append([False] * len(windows[-1]))
    size = len(windows)
    y = np.zeros((size, _WINDOW))
    there = np.zeros((size, _WINDOW), bool)
    rows, feats = [], []
    for r, (ws, ls) in enumerate(zip(windows, labels, strict=True)):
        y[r, : len(ls)] = ls
        there[r, : len(ls)] = True
        for c, w in enumerate(ws):
            for k in own.get(w, ()):
                rows.append(r * _WINDOW + c)
                feats.append(k)
    rows, feats = np.array(rows, np.int64), np.array(feats, np.int64)
    params = np.concatenate([np.zeros(len(kept)), [-3.0], [0.0, -1.0, 0.0, 0.0]])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for epoch in range(1, epochs + 1):
        w, bias, moves = params[: len(kept)], params[len(kept)], params[len(kept) + 1 :].reshape(2, 2)
        emit = np.bincount(rows, w[feats], size * _WINDOW).reshape(size, _WINDOW) + bias
        p, passes = _expected(emit, moves, there)
        real = np.zeros((2, 2))
        before = np.concatenate([np.zeros((size, 1)), y[:, :-1]], 1)
        for a in (0, 1):
            for b in (0, 1):
                real[a, b] = ((before == a) & (y == b) & there).sum()
        off = np.where(there, p - y, 0).ravel()
        slope = np.concatenate([np.bincount(feats, off[rows], len(kept)) + 0.02 * w, [off.sum()], (passes - real).ravel() + 0.02 * moves.ravel()])
        slope[len(kept) + 1] = 0  # clean to clean is the zero of the scale
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        params = params - 0.1 * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
    w = params[: len(kept)]
    return Field({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 0.01}, float(params[len(kept)]), params[len(kept) + 1 :].reshape(2, 2))


def _expected(emit: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic label and expected transitions, over windows that begin after a clean word."""
    size, length = emit.shape
    step, odds = np.exp(moves), np.exp(np.clip(emit, -30, 30))
    ahead = np.empty((length, size, 2))
    now = np.tile([1.0, 0.0], (size, 1))
    for t in range(length):
        new = now @ step
        new[:, 1] *= odds[:, t]
        new /= new.sum(1, keepdims=True)
        now = np.where(there[:, t, None], new, now)
        ahead[t] = now
    after = np.ones((size, 2))
    p, passes = np.zeros((size, length)), np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        both = ahead[t] * after
        both /= both.sum(1, keepdims=True)
        p[:, t] = both[:, 1]
        weighed = after * np.stack([np.ones(size), odds[:, t]], 1)
        past = ahead[t - 1] if t else np.tile([1.0, 0.0], (size, 1))
        pair = past[:, :, None] * step[None] * weighed[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        passes += pair[there[:, t]].sum(0)
        new = weighed @ step.T
        new /= new.sum(1, keepdims=True)
        after = np.where(there[:, t, None], new, after)
    return p, passes


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = 6000, total_bytes: int = 40 << 20) -> Field:
    """Fit on a sample of about `rows` labelled rows (a third toxic, as far as there are any), of total_bytes of text at most.

    labels (doc_id, label) says 1 for toxic; rows without id, text or label are left out. Which rows are drawn depends on
    the hashes of their ids alone, so the sample is found among the ids; texts of any length may be drawn, and are fetched in the
    order of their hashes as far as total_bytes reach. The base rate is counted over all labels. Without rows of both labels the
    score is the same low one for all texts.
    """
    known = labels.select(col(doc_id).alias("id"), (col(label) == 1).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return Field()
    share = {True: rows // 3 / count[True], False: (rows - rows // 3) / count[False]}
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "id"), 11) / F.lit(float(1 << 53)) / F.when(F.col("y"), share[True]).otherwise(share[False])
    drawn = known.select("id", "y", chance.alias("at")).where("at < 1")
    texts = docs.select(col(doc_id).alias("d"), col(text).alias("t")).where("t IS NOT NULL")
    joined = texts.join(F.broadcast(drawn), F.col("d") == F.col("id"))  # about `rows` ids, whatever the table
    sizes = joined.select("at", F.octet_length("t").alias("n")).collect()
    reach = np.cumsum([n for _, n in sorted(sizes)])
    if len(reach) and reach[-1] > total_bytes:
        joined = joined.where(F.col("at") < sorted(sizes)[int(np.searchsorted(reach, total_bytes, "right"))][0])
    found = joined.select("id", "t", "y").collect()
    same: dict[bytes, bytes] = {}  # one object a word
    sample = [([same.setdefault(w, w) for w in _words(r["t"].encode())], r["y"], zlib.crc32(r["t"].encode()) % 10 < 3) for r in sorted(found, key=lambda r: (str(r["id"]), r["t"]))]
    del found, same
    model = _fit_chain([(w, y) for w, y, late in sample if not late])
    held = [(w, y) for w, y, late in sample if late] or [(w, y) for w, y, _ in sample]
    x = np.array([inputs(len(w), model.marginals(w)[1]) for w, _ in held]).reshape(-1, 6)
    y = np.array([float(t) for _, t in held])
    drawn_toxic = y.mean() if len(y) else 0.0
    if drawn_toxic in (0.0, 1.0):
        return model
    base = count[True] / (count[True] + count[False])
    model.curve = _logistic(x, y, np.where(y == 1, base / drawn_toxic, (1 - base) / (1 - drawn_toxic)))
    return model


def _offsets(text: bytes, at: set[int]) -> list[tuple[int, int]]:
    """Code points [start, stop) of the words at these places."""
    return [(len(text[: m.start()].decode("utf-8", "replace")), len(text[: m.end()].decode("utf-8", "replace"))) for k, m in enumerate(_WORD.finditer(text.translate(WORD_BYTES))) if k in at]


def score_toxicity(docs: DataFrame, model: Field, text: str = "text", threshold: float = 0.3, sure: float = 0.5) -> DataFrame:
    """docs with toxicity (0 to 1), toxic (toxicity >= threshold) and toxic_spans (start, stop, p; code points) of words whose marginal is above sure.

    Whole texts are scored, by their words alone. A null or wordless text has the score of a text without known words.
    Rows are scored each for itself; columns with an output's name give way.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.moves, model.curve))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])

    @F.arrow_udf("struct<toxicity: double, toxic_spans: array<struct<start: bigint, stop: bigint, p: double>>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain = Field(*held.value)
        for texts in batches:
            out = []
            for t in as_bytes(texts).to_pylist():
                w = _words(t)
                at, p = chain.marginals(w)
                loud = p > sure
                places = at[loud].tolist()
                spans = [{"start": a, "stop": z, "p": q} for (a, z), q in zip(_offsets(t, set(places)), p[loud].tolist(), strict=True)] if places else []
                out.append({"toxicity": chain.score(len(w), p), "toxic_spans": spans})
            yield pa.array(out, pa.struct([("toxicity", pa.float64()), ("toxic_spans", pa.list_(span))]))
        give_back()

    kept = others(docs, ["toxicity", "toxic", "toxic_spans"])
    return docs.select(*map(col, kept), judge(col(text)).alias("__judged")).select(*map(col, kept), "__judged.toxicity", (F.col("__judged.toxicity") >= threshold).alias("toxic"), "__judged.toxic_spans")
