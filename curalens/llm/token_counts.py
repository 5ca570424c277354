"""Token counts through a cache of digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curalens.llm.common import blocks, fresh_path, one_array, prepare, text_of
from curalens.llm.words import file_digest, once, word_tokenizer

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


def _counter(path: str, drops_space: bool):
    """A function from an array of texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts.to_pylist(), num_threads=1)]
    if drops_space:
        return word_tokenizer(path).counts
    library = word_tokenizer(path).library
    return lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]


def normalised(text: Column, drops_space: bool) -> Column:
    """The part of a text that its count depends on.

    A tokenizer that drops white space counts a text and its white-space-collapsed form alike, so
    both share one cache row. For any other tokenizer the text stays as it is.
    """
    if not drops_space:
        return text
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop copies inside a task before anything is shuffled."""
    seen: set[str] = set()
    for batch in batches:
        keys = batch.column("content").to_pylist()
        keep = []
        for key in keys:
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text_col: str = "text",
                 id_col: str = "doc_id", limit: int = 2048, drops_space: bool = True) -> DataFrame:
    """Tokens of every whole text, encoded once per distinct content and kept in a cache.

    The digest of the normalised content and the digest of the tokenizer file name a row of the
    cache. Contents that the cache lacks are encoded once each and appended; then every document
    takes its count from the cache. ``cache_path`` is a Parquet folder that may exist already;
    without it a new one is made in the shared folder.

    Null text counts as empty: 0 bytes, 0 tokens. Rows repeat as in the input, ids may be null or
    repeated. An empty table gives an empty result. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    cache_path = cache_path or fresh_path(spark, "token_cache")
    version = file_digest(tokenizer_path)
    text = text_of(text_col)
    content = F.sha2(normalised(text, drops_space).cast("binary"), 256)

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    keyed = docs.select(content.alias("content"), text.alias("text"))
    fresh = keyed.mapInArrow(_first_seen, "content string, text string")
    if stored.limit(1).count():
        fresh = fresh.join(stored.select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = once(("count", tokenizer_path, drops_space), lambda: _counter(tokenizer_path, drops_space))
        for block in blocks(_first_seen(batches)):
            yield pa.RecordBatch.from_arrays([one_array(block.column("content")),
                                              pa.array(count(one_array(block.column("text"))), pa.int64())], ["content", "n_tokens"])

    misses = fresh.repartition("content").mapInArrow(encode, "content string, n_tokens long")
    (misses.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path))

    # A repeated append may leave equal rows; they count once.
    counts = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
              .groupBy(F.col("content").alias("_content")).agg(F.max("n_tokens").alias("n_tokens")))
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("_content"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    return (rows.join(counts, "_content", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
