"""Quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import blocks, one_array, prepare, text_of
from curalens.llm.words import split_words

SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    ends = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    worded = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]"), dtype=bool)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    n = np.bincount(row[keep], minlength=len(texts))
    distinct = np.unique(row[keep] * max(1, len(worded)) + codes[keep]) // max(1, len(worded))
    return n, n - np.bincount(distinct, minlength=len(texts))


def _repeated_words(ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Words inside three-word windows that their text holds twice or more."""
    n = len(codes)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    if n < 3:
        return np.zeros(len(ends) - 1, np.int64)
    base = int(codes.max()) + 1
    _, pairs = np.unique(codes[:-1] * base + codes[1:], return_inverse=True)
    _, triples = np.unique(pairs[:-1] * base + codes[2:], return_inverse=True)
    inside = row[:-2] == row[2:]
    _, which, times = np.unique(np.where(inside, row[:-2] * n + triples, -1), return_inverse=True, return_counts=True)
    again = inside & (times[which] > 1)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return _per_text(ends, covered)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts every document gets, rejected or not."""
    ends, codes, words = split_words(texts)
    chars = np.asarray(pc.utf8_length(words), dtype=np.int64)
    signs = np.asarray(pc.count_substring_regex(words, SYMBOLS), dtype=np.int64)
    n_lines, dups = _lines(texts)
    return {"n_words": np.diff(ends), "word_chars": _per_text(ends, chars[codes]), "n_symbols": _per_text(ends, signs[codes]),
            "n_dup_lines": dups, "n_repeat_words": _repeated_words(ends, codes), "n_lines": n_lines}


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(texts, pattern), dtype=np.int64)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes texts and their base counts and says which texts fail."""
    name: str
    rejects: Callable[[pa.Array, dict[str, np.ndarray]], np.ndarray]


RULES = (
    Rule("symbols", lambda t, b: 10 * b["n_symbols"] > b["n_words"]),
    Rule("word_length", lambda t, b: (b["word_chars"] > 15 * b["n_words"]) | (b["word_chars"] < 2 * b["n_words"])),
    Rule("repeated_lines", lambda t, b: 10 * b["n_dup_lines"] > 4 * b["n_lines"]),
    Rule("exclamations", lambda t, b: 5 * _count(t, "!") > b["n_words"]),
    Rule("shouting", lambda t, b: 100 * _count(t, r"\p{Lu}") > 30 * _count(t, r"\p{L}")),
    Rule("letters", lambda t, b: 100 * _count(t, r"\p{L}") < 55 * b["word_chars"]),
)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def measure(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Seconds a text and share of texts rejected, for each rule run on the whole sample."""
    counts, found = base_counts(texts), []
    for rule in rules:
        began = time.perf_counter()
        share = float(np.mean(rule.rejects(texts, counts))) if len(texts) else 0.0
        found.append((rule, (time.perf_counter() - began) / max(1, len(texts)), share))
    return found


def order_by_rate(measured: list[tuple[Rule, float, float]]) -> tuple[Rule, ...]:
    """Most rejection per cost first; rules that reject nothing follow, cheap ones first."""
    return tuple(m[0] for m in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-12), m[1])))


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 200,
                 seed: int = 7) -> tuple[Rule, ...]:
    """Order rules by what they cost and reject on at most ``sample_rows`` texts, read by the driver.

    The sample decides the order only; the verdict of a cascade doesn't depend on the order.
    """
    rows = docs.select(text_of(text_col).alias("text")).sample(0.1, seed).take(sample_rows)
    return order_by_rate(measure(pa.array([r.text for r in rows], pa.string()), rules))


def verdicts(texts: pa.Array, rules: tuple[Rule, ...]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts, base verdict and final verdict; a text leaves at the first rule it fails."""
    counts = base_counts(texts)
    failed = base_failed(counts)
    kept = ~failed
    for rule in rules:
        left = np.flatnonzero(kept)
        if not len(left):
            break
        kept[left] = ~rule.rejects(texts.take(pa.array(left)), {k: v[left] for k, v in counts.items()})
    return counts, failed, kept


def quality_verdicts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES,
                     sample_rows: int = 200) -> DataFrame:
    """Base counts and verdict of every whole text.

    Null text counts as empty: no words, so ``base_failed``. Rows repeat as in the input, whatever
    their ids; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    ordered = plan_cascade(docs, text_col, rules, sample_rows)
    names = ["doc_id", *BASE, "base_failed", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts, failed, kept = verdicts(one_array(block.column("text")), ordered)
            yield pa.RecordBatch.from_arrays([one_array(block.column("doc_id")), *[pa.array(counts[k], pa.int64()) for k in BASE],
                                              pa.array(failed), pa.array(kept)], names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                               "base_failed boolean, kept boolean"))


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 200) -> DataFrame:
    """The rows whose text passes, with all their columns as they are. Null text is rejected."""
    prepare(docs.sparkSession)
    ordered = plan_cascade(docs, text_col, rules, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = one_array(pc.fill_null(block.column(text_col), "").cast(pa.string()))
            yield from block.filter(pa.array(verdicts(texts, ordered)[2])).to_batches()

    return docs.mapInArrow(judge, docs.schema)


VERDICT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             len(regexp_extract_all(t, '!')) AS n_calls, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
             len(regexp_extract_all(t, '\p{L}')) AS n_letters
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR 10 * n_dup_lines > 4 * n_lines OR 5 * n_calls > n_words OR 100 * n_upper > 30 * n_letters
            OR 100 * n_letters < 55 * word_chars) AS kept
FROM b
"""
