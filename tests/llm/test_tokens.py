"""Token counts, byte-level BPE and packing against the libraries and by hand."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from curalens.llm.byte_bpe import ByteBpe, decode_ids, encode_texts, encoding_digests
from curalens.llm.packing import best_fit, pack_documents
from curalens.llm.token_counts import token_counts
from curalens.llm.words import Memo, word_tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_tokens string, ids array<int>"
ODD = ["", " ", "\n\n", "a", "The cat's don't  HELLO\tworld.", "x<|endoftext|>y <|startoftext|>", "é é ﬁ İ ß Σς", "日本語 12345 ½", "\x1c\x85 　.", "!!!???",
       "word " * 5000, "z" * 30_000, "<|ENDOFTEXT|> ab", "ab,cd. ef!gh", "🏽😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def reference():
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return ByteBpe(BYTES, public_tokenizers.PATTERN)


def frame(spark, texts):
    rows = [(i if i != 1 else None, t, "clash", [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_equal_the_library(library):
    ids = word_tokenizer(WORDS).encode(pa.array(ODD))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abE'é \n.,!#<|>startofxΣİ́日½1 \x1c"), max_size=40), min_size=1, max_size=5))
def test_any_words_equal_the_library(texts):
    library = word_tokenizer(WORDS).library
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert word_tokenizer(WORDS).counts(pa.array(texts)).tolist() == want


def test_token_counts_and_their_cache(spark, tmp_path, library):
    texts = [*ODD, None, "The cat", "The  cat ", "The cat"]
    cache = str(tmp_path / "cache")
    rows = token_counts(frame(spark, texts), WORDS, cache).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and sum(r.doc_id is None for r in rows) == 1
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == 14      # texts that differ in white space share a row
    token_counts(frame(spark, [*texts, "new"]), WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == 15                                  # only the miss is added
    assert token_counts(frame(spark, []), WORDS).count() == 0


def test_counts_of_the_other_tokenizers(spark):
    import sentencepiece
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        texts = ["a  b", "a b", "", "é\n日本"]
        got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, texts), path, drops_space=False).collect()}
        if name.endswith(".model"):
            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
        else:
            want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
        assert [got[i] if i != 1 else got[None] for i in range(4)] == want


def test_a_memo_is_bounded():
    memo = Memo(10)
    for i in range(100):
        memo.put(i, i)
    assert len(memo.young) + len(memo.old) <= 20 and memo.get(99) == 99 and memo.get(0) is None


def test_bytes_equal_the_library(coder, reference):
    for text in ODD:
        assert coder.encode(text) == reference.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdetheing 's  \n\t.,!#19é日\x1c ́"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_bytes_equal_the_library(coder, reference, text):
    ids = reference.encode_ordinary(text)
    assert coder.encode(text) == ids
    n, of_ids, of_data = next(coder.summaries(pa.array([text])))
    assert (n, of_ids, of_data) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_a_long_match_takes_linear_time(coder, reference):
    text = "ab" * 40_000
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_digests_and_round_trip(spark, reference):
    docs = frame(spark, [*ODD, None, "same", "same"])
    rows = encoding_digests(docs, BYTES, public_tokenizers.PATTERN).collect()
    want = sorted((len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for t in [*ODD, None, "same", "same"])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = decode_ids(encode_texts(docs, BYTES, public_tokenizers.PATTERN), BYTES, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for t in [*ODD, None, "same", "same"])
    assert encoding_digests(frame(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0


def test_best_fit_by_hand():
    bins, offsets = best_fit(np.array([6, 4, 5, 5, 3, 7]), capacity=10)
    assert bins.tolist() == [1, 1, 2, 2, 0, 0] and offsets.tolist() == [0, 6, 0, 5, 7, 0]
    bins, _ = best_fit(np.array([2, 2, 2, 2]), capacity=10, max_docs=2)
    assert np.bincount(bins).tolist() == [2, 2]
    bins, _ = best_fit(np.array([5, 5, 5]), capacity=20, max_cost=50)
    assert np.bincount(bins).tolist() == [2, 1]
    bins, _ = best_fit(np.array([5, 5, 5]), capacity=20, max_cost=50, rule="dot")
    assert np.bincount(bins).tolist() == [2, 1]
    with pytest.raises(ValueError):
        best_fit(np.array([5]), capacity=4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(2, 10), st.integers(4096, 6000), st.sampled_from(["norm", "dot"]))
def test_best_fit_holds_every_limit(lengths, max_docs, max_cost, rule):
    bins, offsets = best_fit(np.array(lengths, np.int64), 64, max_docs, max_cost, rule=rule)
    for b in set(bins.tolist()):
        inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert sum(x for _, x in inside) <= 64 and len(inside) <= max_docs and sum(x * x for _, x in inside) <= max_cost
        assert [o for o, _ in inside] == np.concatenate([[0], np.cumsum([x for _, x in inside])])[:-1].tolist()


def test_packing_whole_documents(spark, library):
    texts = [*ODD, None, *["some words here"] * 40]
    rows = pack_documents(frame(spark, texts), WORDS).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in rows) == total and len(by_seq) <= -(-total // 2048) + 1
    long = [r for r in rows if r.doc_id == 10]
    ids = np.array([*library.encode(ODD[10], add_special_tokens=False).ids, 0], "<u4")
    assert sorted((r.piece, r.start, r.ids_crc32) for r in long) == [
        (k, 2048 * k, zlib.crc32(ids[2048 * k:2048 * (k + 1)].tobytes())) for k in range(-(-len(ids) // 2048))]
    assert pack_documents(frame(spark, []), WORDS).count() == 0
