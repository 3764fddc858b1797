from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hexaloom.llm import queries as llm
from hexaloom.llm.words import words
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as classes
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with something for every stage."""
    path = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(300, 4)
    passage = " ".join(f"q{i}" for i in range(20))
    texts = {i: t for i, t, _ in rows} | {300: rows[3][1], 301: rows[3][1].upper(), 302: "so " + passage + " it is", 303: "key token=abcdefghijkl0 end", 304: None, 305: "", 306: "again vilest " * 4}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, passage


def test_run_equals_brute_force(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    toxic = {r.doc_id for r in llm.op10_toxicity(spark, path).where("predicted = 1").collect()}
    assert 306 in toxic and len(toxic) < 100
    left = {i: t for i, t in texts.items() if i not in toxic}
    ids = sorted(left)
    group = classes([left[i] for i in ids])
    left = {ids[k]: left[ids[k]] for k, g in enumerate(group) if g == k}
    left = {i: t for i, t in left.items() if not contaminated(t, [("1", passage)], 10)[1]}
    assert 302 not in left and 300 not in left and 304 in left
    left = {i: t.replace("token=abcdefghijkl0", "[secret]") if t else t for i, t in left.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in left.items()}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in expected.items()}
    assert len({r.sequence_id for r in got}) == -(-sum(map(len, expected.values())) // 2048)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert words((docs.where("doc_id = 303").first().text).encode()) == [b"key", b"secret", b"end"]


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Repeated ids and rows, nulls in every column, and columns named as operators name theirs."""
    rows = [(901, "plain words here one two", "en", "s", 3, "r"), (901, "plain words here one two", "en", "s", 3, "r"), (901, "other words of one id", None, None, None, None), (None, "no id at all here", "en", "s", 1, "r"), (None, "no id at all here", "en", "s", 1, "r"), (902, None, "en", "s", None, "r"), (902, None, None, "s", 0, "r"), (903, "", "en", "s", 0, None), (904, "long words " * 20_000, "en", "s", 1, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").selectExpr("*", "1 AS id", "2 AS node", "'x' AS `hash`", "'y' AS spans", "3 AS toxicity", "'z' AS __row", "4 AS t", "5 AS n_hit")


@pytest.mark.parametrize("at", range(4))
def test_stages_on_odd_rows(spark, folder, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, folder[0])
    assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
    rows = sorted(map(tuple, out.drop("n_chars").collect()), key=repr)
    all_rows = sorted(map(tuple, odd.drop("n_chars").collect()), key=repr)
    if name == "near_duplicates":  # of repeated rows one stays, null texts all stay
        texts = [r[1] for r in rows]
        assert sorted(t or "-" for t in texts) == sorted(["plain words here one two", "other words of one id", "no id at all here", "-", "-", "-", "long words " * 20_000])
        assert set(rows) <= set(all_rows)
    else:
        assert rows == all_rows
    empty = stage(spark, odd.limit(0), folder[0])
    assert empty.columns == odd.columns and empty.count() == 0


def test_packing_of_odd_rows(spark, folder, odd):
    out = corpus_pipeline.STAGES[4][1](spark, odd, folder[0])
    pieces = out.groupBy("doc_id").agg({"piece": "max", "length": "count"}).collect()
    assert {r.doc_id for r in pieces} == {901, 902, 903, 904, None} and out.where("start = 0").count() == 9
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), folder[0]).count() == 0
