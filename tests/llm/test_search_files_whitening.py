"""Ranked search, packed id files and whitening against brute force, by hand and on odd rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from curalens.llm import id_files
from curalens.llm.id_files import IdFile, IdFileWriter, id_file_digests, pack_bits, unpack_bits, width_of, write_id_files
from curalens.llm.queries import QUERIES
from curalens.llm.ranked_search import ranked_search
from curalens.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- ranked search ------------------------------------------------------------

def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n_docs) // max(1, total)
            score = sum(c * weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, c in wanted.items() if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranks(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_op11_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert ranks(QUERIES["op11_ranked_search"](spark, SF).collect()) == brute_ranks(docs, items)


def test_ranks_of_odd_rows(spark):
    docs = [(5, "Café au-lait 12"), (3, "café café"), (None, "lait"), (7, None), (8, ""), (9, "... !!"), (3, "café café"), (1, "LAIT É é"), (2, "x " * 3000 + "lait"),
            (6, "a\x00lait")] + [(100 + i, "same words here") for i in range(300)]
    items = [(1, "Café café LAIT"), (2, None), (3, "!!"), (None, "lait x"), (3, "same"), (3, "same"), (4, "absent")]
    rows = [(i, t, "clash") for i, t in docs]
    got = ranked_search(frame(spark, rows, "doc_id long, text string, score string").repartition(3),
                        frame(spark, [(i, t, 1) for i, t in items], "item_id long, text string, rank int"), pass_terms=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and ranks(got.collect()) == brute_ranks(docs, items)
    none = frame(spark, [], "doc_id long, text string")
    some = frame(spark, [(1, "lait")], "item_id long, text string")
    assert ranked_search(none, some).count() == 0
    assert ranked_search(frame(spark, docs, "doc_id long, text string"), frame(spark, [], "item_id long, text string")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 12))
def test_any_ranks(spark, seed, k):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    odds = 1 / np.arange(1, 31)
    docs = [(i // 2, " ".join(rng.choice(words, rng.integers(0, 25), p=odds / odds.sum()))) for i in range(200)]
    items = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(5)]
    got = ranked_search(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), k=k)
    assert ranks(got.collect()) == brute_ranks(docs, items, k)


# --- packed id files ----------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=200)), np.uint32)
    words = pack_bits(ids, width)
    assert len(words) == -(-len(ids) // 64) * width and (unpack_bits(words, len(ids), width) == ids).all()


def test_width():
    assert [width_of(v) for v in (1, 2, 3, 256, 257, 49408, 1 << 17)] == [1, 1, 2, 8, 9, 16, 17]


def test_random_access_and_damage(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 17, n, dtype=np.uint32) for n in (1, 5000, 3, 4096, 0, 12_000, 64)]
    path = str(tmp_path / "x.ids")
    writer = IdFileWriter(path, 17)
    for some in (docs[:2], docs[2:]):
        writer.add(np.arange(len(some)), np.zeros(len(some)), np.array([len(d) for d in some]), np.concatenate(some))
    assert writer.close()[-1] == sum(map(len, docs))
    file = IdFile(path)
    assert all((file.document(i) == d).all() for i, d in enumerate(docs))
    every = np.concatenate(docs)
    for a, b in ((0, 1), (4095, 4097), (100, 100), (9000, len(every)), (len(every) - 1, len(every))):
        assert (file.ids(a, b) == every[a:b]).all()
    data = bytearray(open(path, "rb").read())
    assert len(data) < len(every) * 17 / 8 + 2000
    data[5000] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError):
        IdFile(path).ids(0, len(every))
    open(path, "wb").write(b"short")
    with pytest.raises(ValueError):
        IdFile(path)


def want_files(docs):
    library, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op12_equals_the_library(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in QUERIES["op12_id_files"](spark, SF).collect()) == want_files(docs)


def test_files_of_odd_rows(spark, tmp_path, monkeypatch):
    docs = [(4, "a b"), (None, "null id"), (2, None), (3, ""), (9, "long " * 40_000), (-1, "é日本 <|endoftext|>"), (None, "null id"), (4, "a b")]
    rows = frame(spark, [(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, start string, part int").repartition(3)
    got = sorted((tuple(r) for r in id_file_digests(rows, WORDS, folder=str(tmp_path / "one"), file_text_bytes=60_000).collect()), key=lambda r: r[1])
    assert got == want_files(docs)
    assert len({r.file for r in spark.read.parquet(str(tmp_path / "one" / "manifest")).collect()}) > 1
    assert id_file_digests(rows.limit(0), WORDS).count() == 0


def test_long_files_are_read_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 50)
    docs = [(i, "some words here " * (i % 9)) for i in range(200)]
    folder = str(tmp_path / "two")
    got = id_file_digests(frame(spark, docs, "doc_id long, text string"), WORDS, folder=folder)
    assert sorted(tuple(r) for r in got.collect()) == want_files(docs)
    assert spark.read.parquet(f"{folder}/manifest").count() > 20


# --- whitening ----------------------------------------------------------------

def brute_whiten(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > values.sum() * len(s) * np.finfo(float).eps).sum()))
    return ((n * x - s) ** 2).sum(1), centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(rows, ids, vectors):
    deviation, white, explained = brute_whiten(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == white.size and {r.n for r in rows} == {len(ids)}
    mine = np.array([[got[i, c + 1].whitened for c in range(white.shape[1])] for i in ids])
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine * signs - white).max() < 1e-6
    assert all(got[i, 1].deviation == d for i, d in zip(ids, deviation.tolist()))
    assert np.allclose([got[ids[0], c + 1].explained for c in range(white.shape[1])], explained, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-6


def test_op13_equals_numpy(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    compare(QUERIES["op13_whitening"](spark, SF).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = [(i, v, "clash", 7.0) for i, v in good + odd]
    schema = "vec_id long, embedding array<float>, n string, whitened double"
    got = whiten(frame(spark, rows, schema).repartition(4), block_rows=7).collect()
    compare(got, [i for i, _ in good], [v for _, v in good])
    assert whiten(frame(spark, rows[:0], schema)).count() == 0
    assert whiten(frame(spark, rows[:1], schema)).count() == 0
    assert whiten(frame(spark, rows[:1] * 5, schema)).count() == 0


def test_whitening_of_a_flat_direction_and_null_ids(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(a), float(b), float(a + b)] for a, b in rng.integers(-9, 9, (50, 2))]
    got = whiten(frame(spark, [(None, v) for v in vectors], "vec_id long, embedding array<float>")).collect()
    assert len(got) == 100 and {r.component for r in got} == {1, 2} and {r.vec_id for r in got} == {None}
    assert got[0].identity_error < 1e-9 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
