"""Near-duplicates of texts and vectors, components, shards."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from curalens.llm.common import landed
from curalens.llm.components import connected
from curalens.llm.minhash_dedup import keep_one_of_each, near_duplicates, shingle_sets
from curalens.llm.sharding import differencing, shard_documents
from curalens.llm.vector_dedup import near_vectors

SCHEMA = "doc_id long, text string, name string, node long, root array<long>, cluster int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", 1, [2], 3) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute_components(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(rng, size, edits, length=80):
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "two words", "TWO  words", "a b c", "A B\tC", "long " * 4000]
    for k in range(12):
        texts += family(rng, rng.randint(1, 6), 4)
    texts += family(rng, 60, 3) + family(rng, 40, 1, 12)
    texts += [texts[20]] * 9
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,percent,settings_", [(3, 85, {}), (5, 80, {"limit": 6, "chunk": 7, "deepest": 2}), (3, 85, {"limit": 3, "chunk": 4, "deepest": 1})])
def test_groups_equal_brute_force(spark, width, percent, settings_):
    texts = corpus()
    want, sizes = brute_components(texts, width, percent)
    got = {r.doc_id: r for r in near_duplicates(frame(spark, texts), width, percent, **settings_).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_long_texts_and_many_far_documents_are_cut_into_blocks(spark):
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(40)) for _ in range(90)]      # alike, but no near copies
    texts += family(rng, 8, 3, 3000)
    want, _ = brute_components(texts, 5, 80)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), limit=5, deepest=1, most_shingles=5000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_texts_move_twice_at_most(spark):
    rng = random.Random(9)
    shared = [f"shared{rng.randrange(4000)}" for _ in range(700)]
    texts = []
    for size in (50, 4):               # one cluster in chunks, with two groups
        base = shared + [f"w{rng.randrange(4000)}" for _ in range(130)]
        for _ in range(size):
            texts.append(" ".join(base[:-1] + [f"x{rng.randrange(10_000)}"]))
    for _ in range(60):                # and many pairs
        texts += family(rng, 2, 2, 800)
    want, _ = brute_components(texts, 5, 80)
    docs = landed(frame(spark, texts), "docs")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    began = moved()
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, chunk=7).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert moved() - began < 0.8 * sum(map(len, texts))


def test_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(3000)]
    star = [(9000, 9000 + i) for i in range(1, 3000)]
    edges = chain + star + chain[:50]
    rng.shuffle(edges)
    got = connected(spark.createDataFrame(edges, "a long, b long").repartition(40)).collect()
    assert sorted((r.id, r.root) for r in got) == [(i, 0) for i in range(3001)] + [(9000 + i, 9000) for i in range(3000)]


def test_null_and_repeated_ids(spark):
    same = "some words that are the same in each of these texts"
    rows = near_duplicates(frame(spark, [same, same, same, "x", "other words here"], [None, 7, 7, None, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]
    assert near_duplicates(frame(spark, [])).count() == 0
    assert near_duplicates(frame(spark, [None, ""])).where("kept").count() == 2


def test_one_of_each_group_stays(spark):
    texts = corpus(4)
    docs = frame(spark, texts)
    left = keep_one_of_each(docs)
    want = sorted(set(brute_components(texts, 5, 80)[0]))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == want


def test_shingles_by_hand():
    sets = shingle_sets(pa.array(["a b c d", "A b  c", "", "a b", "b a", "a b c a b c"]), 3)
    assert [len(s) for s in sets] == [2, 1, 0, 1, 1, 3] and sets[1][0] in sets[0] and sets[3][0] != sets[4][0]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_equal_union_find(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_a_long_chain_is_one_component(spark):
    got = connected(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 301


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, name string, n_links string")


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 32))
    near = np.concatenate([base, base[:60] + 0.12 * rng.normal(size=(60, 32)), np.repeat(base[:1], 30, axis=0) + 0.05 * rng.normal(size=(30, 32)), base[:1].repeat(25, axis=0)])
    near = near.astype(np.float32)
    labels = rng.integers(0, 2, len(near))
    labels[len(labels) - 55:] = 1
    labels[0] = 1
    odd = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [1.0] + [None] * 31, 1), (1003, [float("nan")] * 32, 1), (1004, near[0].tolist(), None), (None, near[0].tolist(), 1),
           (1005, [], 1), (1006, near[0, :5].tolist(), 1)]
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(near, labels))] + odd
    got = near_vectors(vectors(spark, [(*r, "clash", "clash") for r in rows]).repartition(4), pivots=24, block=8).collect()
    unit = near.astype(float) / np.linalg.norm(near.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    of_null = links[0].copy()
    np.fill_diagonal(links, False)
    want = links.sum(1) + of_null                       # the row without an id is linked as row 0 is
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    found = sum(by_id[i].n_links for i in range(len(near)))
    assert 0.97 * want.sum() <= found <= want.sum()
    assert all(by_id[i].n_links <= want[i] for i in range(len(near)))
    assert by_id[0].n_links == want[0] and by_id[None].n_links == of_null.sum() and by_id[None].component_id == 0 and not by_id[None].kept
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in range(1000, 1007))
    assert {by_id[i].component_id for i in range(len(near) - 25, len(near))} == {0}
    assert near_vectors(vectors(spark, [])).count() == 0


def test_shards_over_levels_and_equal_rows(spark):
    rng = random.Random(6)
    texts = ["x" * rng.randrange(1, 60) + str(i) for i in range(3000)] + ["same"] * 500
    rows = shard_documents(frame(spark, texts, [*range(3000), *[None] * 500]), shards=4, packets_per_shard=50, groups_per_part=5, rows_per_block=40).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == 3500 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert max(sizes.values()) <= 1.002 * sum(sizes.values()) / 4


def test_differencing_by_hand():
    assert Counter(differencing([8, 7, 6, 5, 4], 2).tolist()) in (Counter({0: 3, 1: 2}), Counter({1: 3, 0: 2}))
    parts = differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], parts) if p == k) for k in range(2)]
    assert sorted(sums) == [14, 16]
    assert differencing([], 3).tolist() == [] and differencing([5], 3).tolist() == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 8))
def test_differencing_is_a_balanced_partition(sizes, ways):
    parts = differencing(sizes, ways)
    sums = np.bincount(parts, sizes, ways)
    assert len(parts) == len(sizes) and parts.min() >= 0 and parts.max() < ways
    assert sums.max() - sums.min() <= max(sizes)


@pytest.mark.parametrize("options", [{}, {"groups_per_part": 5, "packets_per_shard": 3, "rows_per_block": 20}])
def test_shards(spark, options):
    rng = random.Random(1)
    texts = [None, "", "é"] + ["t" * rng.randrange(1, 400) + str(i % 50) for i in range(200)] + ["hot copy"] * 100
    rows = shard_documents(frame(spark, texts, [None if i == 5 else i for i in range(len(texts))]), shards=4, **options).collect()
    assert len(rows) == len(texts) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    shard_of, slots, bytes_of = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        shard_of[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= max(len("hot copy") * 0 + 24 * 100, 416) and len(bytes_of) == 4
    assert shard_documents(frame(spark, [])).count() == 0
