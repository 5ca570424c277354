"""Ranked lexical search with range-maximum tables over posting lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curalens.llm.common import blocks, landed, one_array, prepare, text_of
from curalens.llm.words import split_words

POSTINGS = "doc_id long, n_terms long, terms array<int>, tfs array<int>"
FOUND = "item long, item_id long, doc_id long, score long"
#: Terms of the items answered in one pass over the documents; more items take more passes.
PASS_TERMS = 1 << 20
#: Postings that one set of range-maximum tables covers.
SHARD_POSTINGS = 1 << 19

#: ASCII bytes that are no letter or digit become spaces, A-Z become a-z, all others stay.
TO_TERMS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def term_text(texts: pa.Array) -> pa.Array:
    """Texts with every byte between terms as a space and ASCII letters in lower case."""
    texts = pa.concat_arrays([texts])
    _, ends, data = texts.buffers()
    data = TO_TERMS[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer(data), None, 0, texts.offset)


def terms_of(text: str | None) -> list[str]:
    """Terms of one text, repeats included."""
    return TO_TERMS[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)].tobytes().decode("utf-8", "replace").split(" ") if text else []


def item_passes(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """Items with a term as (number, id, counts of terms), in lists that hold about ``most`` terms."""
    held, size = [], 0
    for number, row in enumerate(items.select(F.col(id_col).cast("long"), text_col).toLocalIterator()):
        counts = Counter(t for t in terms_of(row[1]) if t)
        if counts:
            held.append((number, row[0], counts))
            size += len(counts)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def posting_rows(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: how many terms it has, and which of the vocabulary's it holds how often."""
    size = max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = one_array(block.column("text"))
            ends, codes, words = split_words(term_text(texts))
            numbers = np.array([vocabulary.get(w, -1) for w in words.cast(pa.binary()).to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(ends))
            term = numbers[codes] if len(codes) else np.zeros(0, np.int64)
            keys, tfs = np.unique(doc[term >= 0] * size + term[term >= 0], return_counts=True)
            cuts = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [one_array(block.column("doc_id")), pa.array(np.diff(ends), pa.int64()),
                 pa.ListArray.from_arrays(cuts, pa.array(keys % size, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32()))],
                ["doc_id", "n_terms", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(count, POSTINGS)


class Shard:
    """Posting lists of some documents, each under a range-maximum sparse table.

    Lists lie one after another, documents ascending in each. Level k of the table has, for every
    place, the place of the largest impact among the 2^k from there; only ranges inside one list are
    asked for. Documents with equal lengths and terms have equal scores, so they are one entry, and
    of their ids only the first ``k`` can ever be among the best ``k``.
    """

    def __init__(self, doc_ids: list, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, norm, k: int):
        entry: dict[bytes, int] = {}
        members, firsts = [], []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            key = lengths[i].tobytes() + terms[a:b].tobytes() + tfs[a:b].tobytes()
            at = entry.setdefault(key, len(members))
            if at == len(members):
                members.append([])
                firsts.append(i)
            members[at].append(doc_ids[i])
        chosen = np.array(firsts, np.int64)
        self.members = [sorted(m, key=lambda d: (d is None, d))[:k] for m in members]
        sizes = (ends[1:] - ends[:-1])[chosen]
        self.n_docs = len(chosen)
        doc = np.repeat(np.arange(self.n_docs), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(ends[:-1][chosen] - start[:-1], sizes) + np.arange(len(doc))
        term, tf = terms[source].astype(np.int64), tfs[source].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(norm(lengths[chosen]), sizes))

        # Neighbours alike make narrow bounds: documents are put in the order of which frequent terms they hold.
        often = np.argsort(-np.bincount(term, minlength=1), kind="stable")[:48]
        bit = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int64)
        bit[often] = 1 << np.arange(47, 47 - len(often), -1, dtype=np.int64)
        held = np.zeros(self.n_docs, np.int64)
        np.add.at(held, doc, bit[term])
        order = np.lexsort((lengths[chosen], held))
        place = np.empty(self.n_docs, np.int64)
        place[order] = np.arange(self.n_docs)
        self.members = [self.members[i] for i in order.tolist()]

        keys = term * self.n_docs + place[doc]
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.impact = keys[by_key], impact[by_key]
        self.doc = self.keys % self.n_docs if self.n_docs else self.keys
        numbers, begin, lengths_of = np.unique(self.keys // max(1, self.n_docs), return_index=True, return_counts=True)
        self.lists = {int(t): (int(a), int(a + c)) for t, a, c in zip(numbers, begin, lengths_of)}
        level = np.arange(len(self.keys), dtype=np.int32)
        self.levels = [level]
        span = 1
        while 2 * span <= (int(lengths_of.max()) if len(lengths_of) else 0):
            left, right = level[:-span], level[span:]
            joined = level.copy()
            joined[:-span] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.levels.append(joined)
            level, span = joined, 2 * span
        self.table = np.concatenate(self.levels)
        self.levels = None

    def best_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in every range [low, high) that is not empty."""
        level = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        row = level * len(self.keys)
        left, right = self.table[row + low], self.table[row + high - (1 << level)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def search(self, terms: list[tuple[int, int]], k: int, least: int, batch: int = 256) -> list[tuple[int, object]]:
        """(score, id) of the documents that can be among the best ``k``, given (term, weight) pairs.

        Intervals of documents wait with the sum of their lists' maxima as a bound. The best ones
        are taken, each is split at the document with the largest weighted impact in it, which gets its
        whole score, and what is left on both sides waits again. Intervals whose bound is below the
        k-th best score so far, or below ``least``, are dropped; bounds equal to it stay.
        """
        terms = [(t, w) for t, w in terms if w > 0 and t in self.lists]
        if not terms:
            return []
        number = np.array([t for t, _ in terms], np.int64) * self.n_docs
        weight = np.array([w for _, w in terms], np.int64)
        low = np.array([[self.lists[t][0] for t, _ in terms]], np.int64)
        high = np.array([[self.lists[t][1] for t, _ in terms]], np.int64)
        found: list[tuple[int, object]] = []
        floor = max(1, least)

        def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bound of each interval and the document to split it at."""
            full = high > low
            at = np.zeros(low.shape, np.int64)
            at[full] = self.best_place(low[full], high[full])
            impacts = np.where(full, self.impact[at], 0) * weight
            top = impacts.argmax(axis=1)
            return impacts.sum(axis=1), self.doc[at[np.arange(len(at)), top]]

        bound, split = bounded(low, high)
        while len(bound):
            keep = bound >= floor
            if not keep.all():
                bound, split, low, high = bound[keep], split[keep], low[keep], high[keep]
            if not len(bound):
                break
            if len(bound) > batch:
                order = np.argpartition(-bound, batch)
                now, later = order[:batch], order[batch:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            lo, hi, cut = low[now], high[now], split[now]
            wanted = number[None, :] + cut[:, None]
            at = np.searchsorted(self.keys, wanted)
            there = (at < hi) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
            scores = (np.where(there, self.impact[np.minimum(at, len(self.keys) - 1)], 0) * weight).sum(axis=1)
            good = scores >= floor
            for score, doc in zip(scores[good].tolist(), cut[good].tolist()):
                found += [(score, d) for d in self.members[doc]]
            if len(found) >= k:
                found = best_of(found, k)
                floor = max(floor, found[-1][0])
            new_low, new_high = np.concatenate([lo, at + there]), np.concatenate([at, hi])
            some = (new_high > new_low).any(axis=1)
            new_low, new_high = new_low[some], new_high[some]
            new_bound, new_split = bounded(new_low, new_high) if len(new_low) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
            low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
        return found


def best_of(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The k best by score, then by ascending id; null ids come last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1]))[:k]


def _search_pass(spark: SparkSession, docs: DataFrame, items: list[tuple], k: int, text_col: str, id_col: str) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    for _, _, counts in items:
        for term in counts:
            vocabulary.setdefault(term.encode(), len(vocabulary))
    postings = landed(posting_rows(docs, vocabulary, text_col, id_col), "postings")
    n_docs, n_all = postings.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # Both are bounded by the terms of one pass.
    df = {r["term"]: r["n"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [(number, item_id, [(t, weight[t] * c) for t, c in ((vocabulary[w.encode()], c) for w, c in counts.items()) if t in weight])
               for number, item_id, counts in items]

    def norm(lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and 75 * n_docs * int(lengths.max()) >= 1 << 63:
            return np.array([25 + 75 * int(n) * n_docs // n_all for n in lengths], np.int64)
        return 25 + (75 * lengths * n_docs) // n_all

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]

        def use(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            terms, tfs = one_array(rows.column("terms")), one_array(rows.column("tfs"))
            ends = np.asarray(terms.offsets, np.int64)
            shard = Shard(rows.column("doc_id").to_pylist(), rows.column("n_terms").to_numpy(), ends - ends[0],
                          np.asarray(terms.flatten(), np.int32), np.asarray(tfs.flatten(), np.int32), norm, k)
            for i, (_, _, wanted) in enumerate(queries):
                least = best[i][-1][0] if len(best[i]) == k else 0
                best[i] = best_of(best[i] + shard.search(wanted, k, least), k)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                use(held)
                held, size = [], 0
        if size:
            use(held)
        rows = [(number, item_id, doc_id, score) for (number, item_id, _), found in zip(queries, best) for score, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 4)], ["item", "item_id", "doc_id", "score"])

    return postings.where(F.size("terms") > 0).select("doc_id", "n_terms", "terms", "tfs").mapInArrow(search, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    All documents count and are searched. Items are answered in passes of about ``pass_terms`` terms,
    so what goes to every task is bounded. Each task builds range-maximum tables over shards of
    its documents and keeps ``k`` documents an item; only those are shuffled.

    Null or empty texts have no terms: such items get no rows, such documents are no candidates. Equal
    scores go by ascending id (null ids last); equal rows are documents of their own, as are items with
    equal or null ids. Empty tables give no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    found = spark.createDataFrame([], FOUND)
    for some in item_passes(items, item_id, item_text, pass_terms):
        found = found.unionByName(_search_pass(spark, docs, some, k, text_col, id_col))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same ranking by joins, for comparison.
RANKED_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM t) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f GROUP BY 1),
s AS (SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * n.n * t.docs) // t.total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), t GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
