"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import blocks, id_bucket, landed, one_array, prepare, text_of
from curalens.llm.words import split_words

#: The token after the last word of a text. No word is a space.
END = " "
CLASSES, MEMBERS = 16, 16
SYMBOLS = CLASSES * MEMBERS
#: Words with a symbol of their own fill the first classes; others share symbols by their letters.
OWN = 7 * MEMBERS
CONTEXTS = 5
#: Bytes of text that a task has in arrays at a time; the rest of a task waits.
TEXT_BYTES = 1 << 20
#: Rows of the two hashed weight tables.
CLASS_ROWS, MEMBER_ROWS = 1 << 15, 1 << 16
_M1, _M2, _M3 = np.uint64(0x9E6C63D0676A9A99), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds, codes and distinct words of texts, A-Z lower-cased. Words that differ in case may stand there twice."""
    ends, codes, words = split_words(texts)
    return ends, codes, pc.ascii_lower(words)


def symbols_of(words: pa.Array, own: pa.Array) -> np.ndarray:
    """The symbol (class * MEMBERS + member) of each word: its own one, or one of its last and first two letters."""
    at = np.asarray(pc.fill_null(pc.index_in(words, value_set=own), -1), dtype=np.int64)
    last = pc.utf8_slice_codeunits(pc.utf8_reverse(words), 0, 2).dictionary_encode()
    first = pc.utf8_slice_codeunits(words, 0, 2).dictionary_encode()

    def hashed(coded: pa.DictionaryArray) -> np.ndarray:
        each = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in coded.dictionary.to_pylist()], np.int64)
        return each[np.asarray(coded.indices, dtype=np.int64)] if len(each) else each

    own_classes = OWN // MEMBERS
    shape = (own_classes + hashed(last) % (CLASSES - own_classes)) * MEMBERS + (hashed(first) >> 3) % MEMBERS
    return np.where(at >= 0, at, shape)


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


class Stream:
    """The tokens of a block of texts, the end of each text among them; a batch at a time gets its contexts as table rows."""

    def __init__(self, texts: pa.Array, own: pa.Array):
        ends, codes, words = lowered(texts)
        self.words, self.codes, self.word_ends = words, codes, ends
        texts_n = len(ends) - 1
        both = pa.concat_arrays([words.cast(pa.string()), pa.array([END])])
        row = np.repeat(np.arange(texts_n), np.diff(ends))
        flat = np.full(len(codes) + texts_n, len(words), np.int32)
        flat[np.arange(len(codes)) + row] = codes
        self.ends = ends + np.arange(texts_n + 1)
        self.symbol = symbols_of(both, own).astype(np.int16)[flat]
        self.word_hashes = word_hashes(both)
        self.hashes = self.word_hashes[flat]
        self.place = (np.arange(len(flat)) - np.repeat(self.ends[:-1], np.diff(self.ends))).astype(np.int32)

    def _keys(self, a: int, b: int) -> list[np.ndarray]:
        """Hashed contexts of tokens a to b: what stands one to three tokens before in the same text."""
        place = self.place[a:b]

        def before(values: np.ndarray, k: int, none: int) -> np.ndarray:
            moved = np.full(len(place), none, np.uint64)
            moved[max(0, k - a):] = values[max(0, a - k):max(0, a - k + len(place))]
            moved[place < k] = none
            return moved

        h1, h2 = before(self.hashes, 1, 1), before(self.hashes, 2, 1)
        keys = [before(self.symbol, 1, SYMBOLS) * _M3 + np.uint64(1), h1 * _M1 + np.uint64(2), before(self.symbol, 2, SYMBOLS) * _M2 + np.uint64(3),
                before(self.symbol, 3, SYMBOLS) * _M1 + np.uint64(4), (h1 ^ (h2 * _M2)) * _M3 + np.uint64(5)]
        return [(k ^ (k >> np.uint64(29))) * _M1 for k in keys]

    def rows(self, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Symbols, class rows and member rows of tokens a to b. A member row is hashed with the class of its token."""
        symbol, keys = self.symbol[a:b].astype(np.int64), self._keys(a, b)
        own_class = (symbol // MEMBERS).astype(np.uint64) * _M2
        of_class = [(k >> np.uint64(64 - 15)).astype(np.int32) for k in keys]
        of_member = [(((k ^ own_class) * _M3) >> np.uint64(64 - 16)).astype(np.int32) for k in keys]
        return symbol, of_class, of_member


class Known:
    """Tokens that go to every task, in the order of their hashes, with the logarithm of their counts and one."""

    def __init__(self, tokens: pa.Array, counts: np.ndarray):
        hashes = word_hashes(tokens)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.tokens, self.logs = hashes[order], tokens.take(pa.array(order)), np.log10(counts[order] + 1.0)

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it isn't here. A hash alone is no match: the words are compared."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.asarray(pc.equal(self.tokens.take(pa.array(at)), words.cast(pa.string())).cast(pa.int8()))
        return np.where(same == 1, at, -1)


#: Sums rows as a product, which is faster than a sum over short rows.
_ONES = np.ones((CLASSES, 1), np.float32)


def _scores(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Summed weights of the context rows, kept within what an exponential can hold."""
    score = table.take(rows[0], axis=0)
    for r in rows[1:]:
        score += table.take(r, axis=0)
    return np.clip(score, -60, 60, out=score)


def _softmax(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    score = _scores(table, rows)
    np.exp(score, out=score)
    score /= score @ _ONES
    return score


def _log_picked(table: np.ndarray, rows: list[np.ndarray], picked: np.ndarray) -> np.ndarray:
    """Log probability of one outcome per row."""
    score = _scores(table, rows)
    return score[np.arange(len(score)), picked] - np.log((np.exp(score) @ _ONES)[:, 0])


def _summed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of the values of each, and how many there are. Rows fit 16 bits, which sort fast."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ranked = rows[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    width = values.shape[1]
    sums = np.bincount(((place * width)[:, None] + np.arange(width)).ravel(), values.ravel(), len(first) * width)
    return ranked[first], sums.reshape(-1, width).astype(np.float32), np.diff(np.append(first, len(rows)))


class MaxEnt:
    """Two hashed tables: a context row gives a weight for each class, or for each member of a class."""

    def __init__(self):
        self.tables = [np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32)]
        self.squares = [np.zeros(CLASS_ROWS, np.float32), np.zeros(MEMBER_ROWS, np.float32)]

    def log10_symbols(self, stream: Stream, batch: int = 1 << 15) -> np.ndarray:
        """log10 probability of the symbol of each token given the tokens before it."""
        out = np.empty(len(stream.symbol))
        for a in range(0, len(out), batch):
            symbol, of_class, of_member = stream.rows(a, a + batch)
            out[a:a + batch] = (_log_picked(self.tables[0], of_class, symbol // MEMBERS)
                                + _log_picked(self.tables[1], of_member, symbol % MEMBERS)) / np.log(10)
        return out

    def learn(self, stream: Stream, seen: list[np.ndarray], rate: float, batch: int = 1 << 14) -> None:
        """Gradient steps, scaled per row by its past gradients, over the tokens in order; ``seen`` counts the uses of rows."""
        for a in range(0, len(stream.symbol), batch):
            symbol, of_class, of_member = stream.rows(a, a + batch)
            at = np.arange(len(symbol))
            for k, (rows, true) in enumerate(((of_class, symbol // MEMBERS), (of_member, symbol % MEMBERS))):
                error = -_softmax(self.tables[k], rows)
                error[at, true] += 1
                for r in rows:
                    touched, step, times = _summed(error, r)
                    self.squares[k][touched] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                    self.tables[k][touched] += rate * step / np.sqrt(self.squares[k][touched] + 1)[:, None]
                    seen[k][touched] += times


def token_totals(docs: DataFrame, limit: int = 400_000) -> DataFrame:
    """``token``, ``c`` over texts (column ``text``). Tasks add up before the shuffle, ``limit`` tokens at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def summed() -> pa.RecordBatch:
            table = pa.concat_tables(held).group_by("token").aggregate([("c", "sum")])
            held.clear()
            return pa.RecordBatch.from_arrays([one_array(table.column("token")), one_array(table.column("c_sum"))], ["token", "c"])

        for block in blocks(batches):
            texts = one_array(block.column("text"))
            _, codes, words = lowered(texts)
            held.append(pa.table({"token": pa.concat_arrays([words.cast(pa.string()), pa.array([END])]),
                                  "c": pa.array(np.append(np.bincount(codes, minlength=len(words)), len(texts)), pa.int64())}))
            size += len(words) + 1
            if size >= limit:
                yield summed()
                size = 0
        if held:
            yield summed()

    return docs.select("text").mapInArrow(count, "token string, c long").where("c > 0").groupBy("token").agg(F.sum("c").alias("c"))


def _updated(spark, docs: DataFrame, model: MaxEnt, own: pa.Array, rate: float) -> MaxEnt:
    """One round: every task takes gradient steps over its own texts; rows are averaged by their numbers of uses."""
    start = spark.sparkContext.broadcast((model, own))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, words = start.value
        local = MaxEnt()
        local.tables, local.squares = [t.copy() for t in base.tables], [s.copy() for s in base.squares]
        seen = [np.zeros(CLASS_ROWS, np.int64), np.zeros(MEMBER_ROWS, np.int64)]
        for block in blocks(batches, TEXT_BYTES):
            local.learn(Stream(one_array(block.column("text")), words), seen, rate)
        for k in range(2):
            used = np.flatnonzero(seen[k])
            n = seen[k][used].astype(float)
            columns = [pa.array(used + k * CLASS_ROWS, pa.int64()), pa.array(n), pa.array((local.squares[k] - base.squares[k])[used].astype(float) * n)]
            change = (local.tables[k] - base.tables[k])[used]
            columns += [pa.array(change[:, j].astype(float) * n) for j in range(CLASSES)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "n", "squares", *[f"w{j}" for j in range(CLASSES)]]
    sums = (docs.select("text").mapInArrow(learn, "row long, " + ", ".join(f"{c} double" for c in names[1:]))
            .groupBy("row").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow().sort_by("row"))
    row, n = sums.column("row").to_numpy(), sums.column("n").to_numpy()
    weights = np.stack([sums.column(f"w{j}").to_numpy() / n for j in range(CLASSES)], axis=1) if len(row) else np.zeros((0, CLASSES))
    out = MaxEnt()
    for k, (low, high) in enumerate(((0, CLASS_ROWS), (CLASS_ROWS, CLASS_ROWS + MEMBER_ROWS))):
        here = (row >= low) & (row < high)
        out.tables[k], out.squares[k] = model.tables[k].copy(), model.squares[k].copy()
        out.tables[k][row[here] - low] += weights[here]
        out.squares[k][row[here] - low] += sums.column("squares").to_numpy()[here] / n[here]
    start.unpersist()
    return out


def score_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 7, held: int = 2,
                frequent: int = 1 << 19, rounds: tuple[int, ...] = (2, 16, 128), rate: float = 0.5) -> DataFrame:
    """Score every whole text by a model learned from the texts whose fold isn't ``held``.

    1. Training tokens are counted with sums inside tasks. Tokens that make up at least 1/``frequent`` of
       all tokens, so at most ``frequent`` of them, go to every task; the counts of others stay in a table.
    2. The most frequent tokens have a symbol of their own (class and member), others share one by their letters.
       P(token | before) = P(class | before) P(member | class, before) P(token | symbol). The
       last is (c+1) / (N_symbol + V_symbol + 1), which leaves one share to unknown tokens.
    3. Contexts are the token before, its symbol, the symbols two and three before (skips) and the two
       tokens before together, hashed to rows. Each round takes further training texts, so all are used
       once: out of 128 hash parts the first 2, those up to 16, and the rest.
    4. Texts are scored in batches. Tokens that aren't frequent meet their counts in a join.

    Null text counts as empty: one token, the end. Repeated rows and null ids are scored as they
    stand; a null id falls in the fold of the empty string. An empty table gives no rows, and without
    training texts all counts are 0. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_bucket(id_col, folds) == held).alias("held_out"), text_of(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = landed(token_totals(training), "token_totals")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("c") * frequent >= total).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    own = one_array(known.column("token").slice(0, OWN))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            symbol = symbols_of(batch.column("token"), own)
            sums += np.bincount(symbol, batch.column("c").to_numpy(), SYMBOLS).astype(np.int64)
            kinds += np.bincount(symbol, minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SYMBOLS), pa.int64()), pa.array(sums), pa.array(kinds)], ["symbol", "n", "v"])

    of_symbol = counts.mapInArrow(tally, "symbol long, n long, v long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    room = np.zeros(SYMBOLS)
    for r in of_symbol:
        room[r.symbol] = np.log10(r.n + r.v + 1)

    model, part, low = MaxEnt(), F.pmod(F.xxhash64("text"), F.lit(rounds[-1])), 0
    for high in rounds:
        model = _updated(spark, training.where((part >= low) & (part < high)), model, own, rate)
        low = high
    shared = spark.sparkContext.broadcast((model, own, Known(one_array(known.column("token")), known.column("c").to_numpy()), room))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maxent, words, common, log_room = shared.value
        log_c, end = common.logs, int(common.find(pa.array([END]), word_hashes(pa.array([END])))[0])
        end_log = log_c[end] if end >= 0 else None
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for block in blocks(batches, TEXT_BYTES):
            stream = Stream(one_array(block.column("text")), words)
            n_texts = block.num_rows
            each = maxent.log10_symbols(stream) - log_room[stream.symbol]
            sums = np.add.reduceat(each, stream.ends[:-1])
            at = common.find(stream.words, stream.word_hashes[:-1])
            place = at[stream.codes] if len(stream.codes) else stream.codes
            row = np.repeat(np.arange(n_texts), np.diff(stream.word_ends))
            is_common = place >= 0
            of_counts = np.bincount(row[is_common], log_c[place[is_common]], n_texts)
            n_known = np.bincount(row[is_common], minlength=n_texts)
            if end_log is not None:
                of_counts, n_known = of_counts + end_log, n_known + 1
            # What isn't common, by text: distinct tokens and how often.
            names = stream.words.dictionary_encode()
            code = np.asarray(names.indices, dtype=np.int64)[stream.codes[~is_common]] if len(stream.codes) else stream.codes
            pair, times = np.unique(row[~is_common] * max(1, len(names.dictionary)) + code, return_counts=True)
            owner, code = pair // max(1, len(names.dictionary)), pair % max(1, len(names.dictionary))
            bounds = np.searchsorted(owner, np.arange(n_texts + 1))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                [names.dictionary.take(pa.array(code)), pa.array(times, pa.int64())], ["token", "times"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + n_texts)), one_array(block.column("doc_id")), one_array(block.column("held_out")),
                 pa.array(np.diff(stream.ends)), pa.array(n_known, pa.int64()), pa.array(of_counts), pa.array(sums), rare],
                ["key", "doc_id", "held_out", "n_tokens", "n_known", "of_counts", "of_symbols", "rare"])
            key += n_texts

    scored = landed(rows.mapInArrow(score, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, of_counts double, "
                                           "of_symbols double, rare array<struct<token:string,times:long>>"), "scored")
    infrequent = scored.select("key", F.explode("rare").alias("x")).select("key", "x.token", "x.times")
    met = infrequent.join(counts, "token")
    more = landed(met.groupBy("key").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("l")), "infrequent")
    of_counts = F.col("of_counts") + F.coalesce("l", F.lit(0.0))
    return (scored.drop("rare").join(more, "key", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0).cast("long"))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (of_counts - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
                    (of_counts + F.col("of_symbols")).alias("score")))
