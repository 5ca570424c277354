"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from curalens.llm.common import blocks, id_bucket, landed, one_array, prepare, text_of
from curalens.llm.words import Memo, split_words

EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Lengths of word beginnings, and numbers of occurrences, that are terms beside the words.
BEGINNINGS = (5, 6, 7)
REPEATS = (2, 3, 5)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``split_words``, the distinct words lower-cased and without punctuation at their edges."""
    ends, codes, words = split_words(texts)
    return ends, codes, pc.replace_substring_regex(pc.utf8_lower(words), EDGES, "")


def terms_of(words: pa.Array) -> list[pa.Array]:
    """The terms of each word: the word, and ``abcde*`` for its beginnings; an empty string where there is none."""
    made = [words]
    for n in BEGINNINGS:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", "")
        made.append(pc.if_else(pc.greater(pc.utf8_length(words), n), start, ""))
    return made


def with_repeats(counts: dict) -> dict:
    """Add the terms "occurs twice or more" and so on. Cosine sees directions only, and one chance
    occurrence should not point the same way as many."""
    return counts | {(t, least): 1 for t, n in counts.items() for least in REPEATS if n >= least}


class BlockMaxIndex:
    """Postings of examples by term, in blocks of neighbouring examples with the largest weight of each block.

    A query first sums, over its terms, weight times block maximum: no example of a block can score
    more. Blocks are then scored exactly, best bound first, until the k-th best score lies above
    every bound left, so the k nearest are exact. Equal scores go to the earlier example.
    """

    def __init__(self, rows: list[dict[int, float]], n_terms: int, block: int = 64):
        self.size, self.block = len(rows), block
        self.n_blocks = -(-len(rows) // block)
        found = sorted((t, i, w) for i, row in enumerate(rows) for t, w in row.items())
        self.ids = np.array([f[1] for f in found], np.int64)
        self.weights = np.array([f[2] for f in found])
        terms = np.array([f[0] for f in found], np.int64)
        # Slices of the postings by (term, block), with their maxima.
        cell = terms * self.n_blocks + self.ids // block
        cells, starts = np.unique(cell, return_index=True)
        self.cell_term, self.cell_block = (cells // max(1, self.n_blocks), cells % max(1, self.n_blocks))
        self.cell_start, self.cell_end = starts, np.append(starts[1:], len(found)).astype(np.int64)
        self.cell_max = np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.term_cells = np.searchsorted(self.cell_term, np.arange(n_terms + 1))

    def search(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k nearest examples with a score above 0, as (example, score)."""
        cells = [(c, w) for t, w in query.items() for c in range(self.term_cells[t], self.term_cells[t + 1])]
        if not cells:
            return []
        at, weight = np.array([c for c, _ in cells]), np.array([w for _, w in cells])
        bounds = np.bincount(self.cell_block[at], weight * self.cell_max[at], minlength=self.n_blocks)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and best[-1][0] > bounds[b] + 1e-12):
                break
            score = np.zeros(self.block)
            for c, w in zip(at[self.cell_block[at] == b], weight[self.cell_block[at] == b]):
                inside = slice(self.cell_start[c], self.cell_end[c])
                score[self.ids[inside] - b * self.block] += w * self.weights[inside]
            for i in np.flatnonzero(score > 0).tolist():
                best.append((float(score[i]), b * self.block + i))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return [(i, s) for s, i in best]


class ToxicityModel:
    """Vocabulary, example index, votes. The size follows the examples, not the documents."""

    def __init__(self, vocabulary: list[tuple[str, int]], idf: list[float], examples: list[tuple[int, int, dict[int, int]]], k: int):
        self.words, self.idf, self.k = Vocabulary(vocabulary), idf, k
        vectors = [(e[0], e[1], self._unit(e[2])) for e in examples]
        blank = [e[1] for e in vectors if not e[2]]
        #: Share of label 1 among examples without any word of the vocabulary.
        self.blank = (sum(blank) + 0.5) / (len(blank) + 2)
        self.prior = (sum(e[1] for e in vectors) + 0.5) / (len(vectors) + 2)
        kept = sorted((e for e in vectors if e[2]), key=lambda e: (max(e[2], key=lambda t: (e[2][t], -t)), e[0]))
        self.ids, self.labels = [e[0] for e in kept], [e[1] for e in kept]
        self.index = BlockMaxIndex([e[2] for e in kept], len(vocabulary))
        self.memo = Memo(50_000)

    def _unit(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = float(np.sqrt(sum(w * w for w in raw.values())))
        return {t: float(w / norm) for t, w in raw.items()} if norm > 0 else {}

    def score(self, counts: dict[int, int]) -> tuple[float, int | None, float]:
        """Score, id of the nearest example, its cosine.

        Votes weigh as the cosine; two votes of weight 1 hold the prior, which keeps scores between 0
        and 1 and near the prior where the evidence is thin: one neighbour decides nothing.
        """
        if not counts:
            return self.blank, None, 0.0
        key = array("I", [x for pair in sorted(counts.items()) for x in pair]).tobytes()     # small, as many are kept
        known = self.memo.get(key)
        if known is None:
            near = self.index.search(self._unit(counts), self.k)
            if near:
                votes = sum(s * self.labels[i] for i, s in near)
                known = ((votes + 2 * self.prior) / (sum(s for _, s in near) + 2), self.ids[near[0][0]], near[0][1])
            else:
                known = (self.blank, None, 0.0)
            self.memo.put(key, known)
        return known

    def score_texts(self, texts: pa.Array) -> list[tuple[float, int | None, float]]:
        return [self.score(c) for c in self.words.counts(texts)]


class Vocabulary:
    """Terms (term, least number of occurrences) and their places."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.base = list(dict.fromkeys(t for t, _ in terms))
        at = {t: i for i, t in enumerate(self.base)}
        self.place = {at[t] if least == 1 else (at[t], least): i for i, (t, least) in enumerate(terms)}

    def counts(self, texts: pa.Array) -> list[dict[int, int]]:
        """How often each text holds each term."""
        ends, codes, words = plain_words(texts)
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        for terms in terms_of(words) if len(codes) and self.base else []:
            found = np.asarray(pc.fill_null(pc.index_in(terms, value_set=pa.array(self.base, pa.string())), -1), dtype=np.int64)[codes]
            at = np.flatnonzero(found >= 0)
            rows = np.searchsorted(ends, at, side="right") - 1
            for row, term in zip(rows.tolist(), found[at].tolist()):
                out[row][term] = out[row].get(term, 0) + 1
        return [{self.place[t]: n for t, n in with_repeats(c).items() if t in self.place} if c else c for c in out]


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          examples: int = 8192, least_z: float = 4.0, least_docs: int = 3, k: int = 9, folds: int = 5, hashes: int = 4) -> ToxicityModel:
    """Learn from at most ``examples`` labelled documents whose fold isn't 0.

    Labelled ids are taken in the order of a hash. Of texts of one label with equal words, and of those that share all of
    ``hashes`` independent least hashes of their long words as near copies do, one counts. Terms are words, beginnings of words, and either occurring
    repeatedly. The vocabulary holds every term of at least ``least_docs`` documents whose number of label-1
    documents lies ``least_z`` deviations off the expected one. Deviations are signed roots of the likelihood ratio,
    which also hold for a few documents, so a wording of a small language or source enters as soon as it is no
    chance. Only ids, labels and vocabulary counts of the examples reach the driver.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isNotNull() & (id_bucket("_id", folds) != 0))
    chosen = marks.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(examples)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ends, codes, words = plain_words(one_array(block.column("text")))
            tables = [np.array([*t.to_pylist(), ""], dtype=object)[:-1] for t in terms_of(words)]
            found = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                distinct, times = np.unique(codes[a:b], return_counts=True)
                bag: dict[str, int] = {}
                for table in tables:
                    for w, n in zip(table[distinct].tolist(), times.tolist()):
                        if w:
                            bag[w] = bag.get(w, 0) + n
                found.append(list(bag.items()))
            yield pa.RecordBatch.from_arrays([one_array(block.column("_id")), one_array(block.column("_label")),
                                              pa.array(found, pa.map_(pa.string(), pa.int32()))], ["_id", "_label", "bag"])

    counted = rows.select("_id", "_label", "text").mapInArrow(bags, "_id long, _label int, bag map<string,int>")
    words = F.filter(F.map_keys("bag"), lambda w: ~w.endswith("*"))
    long = F.filter(words, lambda w: F.length(w) >= 6)

    def least_hash(seed: int) -> Column:
        return F.array_min(F.transform(long, lambda w: F.xxhash64(w, F.lit(seed))))

    least = [least_hash(seed) for seed in range(hashes)]
    key = F.when(F.size(long) >= 8, F.sha2(F.concat_ws(":", *[x.cast("string") for x in least]), 256)).otherwise(
        F.sha2(F.array_join(F.array_sort(words), " "), 256))
    keyed = landed(counted.withColumn("key", key), "bags")
    first = keyed.groupBy("_label", "key").agg(F.min_by(F.struct("_id", "_label", "bag"), F.struct("_id", F.xxhash64(F.array_sort(words)))).alias("x"))
    bagged = landed(first.select("x._id", "x._label", "x.bag"), "examples")
    n, toxic = bagged.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    rate = min(max(toxic / max(n, 1), 1e-6), 1 - 1e-6)
    tally = (bagged.select("_label", F.explode("bag").alias("term", "times")).groupBy("term")
             .agg(*[F.count_if(F.col("times") >= r).alias(f"n{r}") for r in (1, *REPEATS)],
                  *[F.sum(F.when(F.col("times") >= r, F.col("_label")).otherwise(0)).alias(f"a{r}") for r in (1, *REPEATS)])
             .select("term", F.explode(F.array(*[F.struct(F.lit(r).alias("least"), F.col(f"n{r}").alias("n"), F.col(f"a{r}").alias("a"))
                                                 for r in (1, *REPEATS)])).alias("x")).select("term", "x.least", "x.n", "x.a"))

    def surplus(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)

    off = F.sqrt(2 * F.greatest(surplus(F.col("a"), rate) + surplus(F.col("n") - F.col("a"), 1 - rate), F.lit(0.0)))
    picked = (tally.where(F.col("n") >= least_docs).withColumn("z", off).where(F.col("z") >= least_z)
              .orderBy(F.desc("z"), "term", "least").select("term", "least", "n").collect())
    terms = [(r.term, r.least) for r in picked]
    idf = [float(np.log((n + 1) / (r.n + 1)) + 1) for r in picked]
    vocabulary = Vocabulary(terms)
    at = {t: i for i, t in enumerate(vocabulary.base)}
    kept = F.map_filter("bag", lambda w, _: w.isin(vocabulary.base)) if terms else F.lit(None)
    got = bagged.select("_id", "_label", kept.alias("bag")).orderBy("_id").collect()
    bags_kept = [with_repeats({at[w]: c for w, c in (r.bag or {}).items()}) for r in got]
    return ToxicityModel(terms, idf, [(r[0], r[1], {vocabulary.place[t]: n for t, n in bag.items() if t in vocabulary.place})
                                      for r, bag in zip(got, bags_kept)], k)


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 5, **settings) -> DataFrame:
    """Toxicity of every whole text, with the nearest example as evidence.

    Empty and null texts, and texts without any word of the vocabulary, get the share of label 1
    among such examples. Without labels the score is 0.25. Rows repeat as in the input; a null id falls in the
    fold of the empty string; an empty table gives no rows; other columns are ignored. Of several labels of an id
    the largest counts; null labels are left out.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels, text_col, id_col, folds=folds, **settings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            scores, nearest, cosine = zip(*model.value.score_texts(one_array(block.column("text"))))
            yield pa.RecordBatch.from_arrays([one_array(block.column("doc_id")), one_array(block.column("held_out")), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(nearest, pa.int64()),
                                              pa.array(cosine, pa.float64())], ["doc_id", "held_out", "score", "predicted", "nearest_id", "nearest_cosine"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_bucket(id_col, folds) == 0).alias("held_out"), text_of(text_col).alias("text"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, nearest_id long, nearest_cosine double"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", at: float = 0.5, **settings) -> DataFrame:
    """The rows whose score lies below ``at``, with all their columns as they are."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels, text_col, id_col, **settings))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = one_array(pc.fill_null(block.column(text_col), "").cast(pa.string()))
            yield from block.filter(pa.array([s[0] < at for s in model.value.score_texts(texts)])).to_batches()

    return docs.mapInArrow(keep, docs.schema)
