"""The registered queries on the smallest tables against brute force."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from curalens.llm.queries import QUERIES
from test_similarity import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def word_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    words = {i: t.encode().lower().split() + [b" "] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in run(spark, "op1_lm_scoring"):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(counts[w] > 0 for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_op2(spark, texts):
    rows = run(spark, "op2_sharding")
    sizes, slots, shard_of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[data].add(r.shard)
    assert len(rows) == len(texts) and set(sizes) <= set(range(40)) and all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = Counter(texts.values())
    largest = max(n * (len(t.encode()) + 16) for t, n in copies.items())
    assert max(sizes.values()) <= max(largest, 1.001 * sum(sizes.values()) / 40)


def test_op5(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in run(spark, "op5_vector_dedup")}
    assert set(got) == {r[0] for r in rows}
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, links.sum(1))) and sum(r.n_links for r in got.values()) >= 0.9 * links.sum()


def test_op6(spark, word_ids):
    rows = run(spark, "op6_packing")
    room = Counter()
    for r in rows:
        ids = np.array([*word_ids[r.doc_id], 0], "<u4")
        assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        room[r.sequence_id] += r.length
    total = sum(len(i) + 1 for i in word_ids.values())
    assert sum(room.values()) == total and max(room.values()) <= 2048 and len(room) <= -(-total // 2048) + 2


def test_op7(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op7_byte_bpe"):
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op9(spark, texts):
    ids = sorted(texts)
    want, sizes = brute_components([texts[i] for i in ids], 3, 85)
    got = {r.doc_id: r for r in run(spark, "op9_minhash_dedup")}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in ids] == [(n, ids[c], ids[c] == i) for i, n, c in zip(ids, sizes, want)]


def test_op10(spark, texts, word_ids):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op10_token_counts")}
    assert got == {i: (len(t.encode()), len(word_ids[i]), len(word_ids[i]) > 2048) for i, t in texts.items()}


def test_op3_on_held_out_labels(spark):
    labels = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.97
    clean = [r for r in rows if labels[r.doc_id] == 0]
    assert np.mean([r.predicted == 0 for r in clean]) > 0.99
