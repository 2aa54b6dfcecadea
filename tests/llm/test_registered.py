"""The registered queries themselves, over the smallest tables, against brute force, another library or SQL."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import test_group_operators as groups
import test_text_operators as texts
from tessera.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: What each query returns first, by its contract.
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_html": "page_id text n_chars",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_neighbours": "query_id rank vec_id score",
    "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op10_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            df = queries.QUERIES[name](spark, DATA)
            done[name] = [r.asDict() for r in df.collect()]
            wanted = COLUMNS[name].split()
            assert set(wanted) <= set(df.columns) and len(set(df.columns)) == len(df.columns)
            if name not in ("op6_suffix_dedup", "op7_decontamination", "op8_byte_bpe"):
                assert df.columns[: len(wanted)] == wanted
        return done[name]

    return run


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in t}


def digest(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_every_query_is_here():
    assert set(queries.QUERIES) == {*COLUMNS, "pipeline"}


def test_op1(result, documents):
    rows = result("op1_toxicity")
    assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = {r["doc_id"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["toxic"]}
    learned = [r["predicted"] for r in rows if r["doc_id"] in toxic and not r["held_out"]]
    assert np.mean(learned) > 0.6


def test_op2(result):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    rows = result("op2_html")
    assert {r["page_id"] for r in rows} == set(pages) and all(r["n_chars"] == len(r["text"]) and "<p" not in r["text"] for r in rows)


def test_op3(result, documents):
    order = {"assign": 0, "access": 1, "hex": 2}
    for r in result("op3_secrets"):
        want = sorted(texts.base_secrets(documents[r["doc_id"]]), key=lambda s: (s[1], order[s[0]]))
        assert r["base_sha256"] == digest(spelled(want)) and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == y for k, _, _ in want) for y in order]
        assert {*spelled(want).split(",")} - {""} <= set(r["spans"].split(","))


def test_op4(result, documents):
    ids = sorted(documents)
    prints = [groups.brute_print(documents[i]) for i in ids]
    root = groups.brute_groups(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, root, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op4_simhash")} == want


def test_op5(result):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    e = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    got = {}
    for r in result("op5_neighbours"):
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = e @ e[ids == q][0]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        hits += len(set(best) & set(found.values()))
        assert sorted(found) == list(range(1, len(best) + 1))
    assert hits >= 0.95 * sum(len(x) for x in got.values())


def test_op6(result, documents):
    ids = sorted(documents)
    want = dict(zip(ids, groups.brute_removed([documents[i] for i in ids]), strict=True))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result("op6_suffix_dedup")} == want


@pytest.mark.parametrize("name", list(queries.SQL))
def test_those_with_sql(result, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = db.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(result(name)[0])
    assert sorted(repr([r[c] for c in columns]) for r in result(name)) == sorted(repr(list(r)) for r in cur.fetchall())


def test_op8(result, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in result("op8_byte_bpe"):
        text = documents[r["doc_id"]] or ""
        ids = other.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(text))


def test_op10(result, documents):
    for r in result("op10_personal_data"):
        want = texts.base_personal(documents[r["doc_id"]])
        assert r["base_sha256"] == digest(spelled(want)) and [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x == k for x, _, _ in want) for k in ("email", "ip", "card", "phone")]
        assert {*spelled(want).split(",")} - {""} <= set(r["spans"].split(","))


def test_saved_tables_are_deleted(spark):
    from tessera.llm import neardup, store

    before = set(store._there)
    df = spark.createDataFrame([(i, f"some words of a text {i // 2} and a few more of them {i // 2}") for i in range(20)], "doc_id long, text string")
    assert neardup.duplicates(df).count() == 10
    assert len(set(store._there) - before) == 1
    for path in set(store._there) - before:
        store.dropped(store._there[path])
    assert set(store._there) == before
