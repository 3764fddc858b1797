"""The registered queries over the small tables, against their SQL or plain versions of them."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hexaloom.llm import queries as llm
from tests.llm.test_neardup import brute as classes
from tests.llm.test_secrets import base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    assert len({i for i, _ in rows}) == len(rows) >= 200
    return rows


def run(spark, name):
    return llm.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = run(spark, name)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_near_duplicates(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op2_near_duplicates").collect()}
    ids = [i for i, _ in documents]
    expected = [ids[g] for g in classes([t for _, t in documents])]
    assert [got[i].class_id for i in ids] == expected and [got[i].kept for i in ids] == [i == c for i, c in zip(ids, expected, strict=True)]


def test_html(spark):
    rows = run(spark, "op5_html_text").collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{DATA}/pages.parquet'").fetchall()[0][0]
    assert all(r.n_chars == len(r.text) and r.text == "\n".join(" ".join(b.split()) for b in r.text.split("\n")) for r in rows)


def test_token_file(spark, documents):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(map(tuple, run(spark, "op6_token_file").select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start = 0
    for (i, t), row in zip(documents, got, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_secret_scan(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op7_secret_scan").collect()}
    for i, t in documents:
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest(), i


def test_sharding(spark, documents):
    rows = run(spark, "op8_sharding").collect()
    sizes = {i: len((t or "").encode()) + 16 for i, t in documents}
    assert {r.doc_id: r["size"] for r in rows} == sizes and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    held = [sum(r["size"] for r in rows if r.shard == s) for s in range(40)]
    assert max(abs(h - sum(sizes.values()) / 40) for h in held) <= max(sizes.values())


def test_packing(spark, documents):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op9_packing").collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in documents:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 2048)))
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
        assert pieces[0].start == 0 and sum(p.length for p in pieces) == len(ids) and all(p.length == 2048 for p in pieces[1:])
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(b))]).tolist()
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_toxicity(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op10_toxicity").collect()}
    assert set(rows) == {i for i, _ in documents}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
