"""Token counts through a digest cache.

A text's content digest (SHA-256 of its normal form; by default null becomes empty, nothing else changes, since any other
rewriting would change byte-level counts) and the tokenizer's version digest (SHA-256 of its file) name a stored count.
Contents that the cache lacks are encoded once each, however many documents hold them, and appended to the cache, a Parquet
folder that all executors share. Counting reads them back by the same two digests.

Null or empty text: 0 tokens of an empty string. Repeated rows, copies and ties: one encoding, a row each; the rows of one
content are spread over tasks when they meet its count. Empty table: no rows.
Extra columns are ignored by ``count_tokens``. Texts are encoded whole, about ``BATCH`` bytes at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import buffers, pieces, settle, spread_join

BATCH = 1 << 18
CACHE = "content_digest binary, tokenizer_digest string, n_tokens bigint"
_loaded: dict[str, Callable] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a tokenizer file's own library, without added special tokens, truncation or padding."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        encode = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    elif path.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        encode = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
    else:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    _loaded[path] = encode
    return encode


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet"))
    return found is not None and len(found) > 0


def stored(spark: SparkSession, cache_dir: str, tokenizer_digest: str) -> DataFrame:
    """content_digest, n_tokens of one tokenizer, one row a content."""
    rows = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer_digest") == tokenizer_digest)
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, cache_dir: str, tokenizer: str) -> None:
    """Encode the contents of ``texts`` (content_digest, content) that the cache lacks and append their counts."""
    spark, digest = texts.sparkSession, version(tokenizer)
    misses = texts
    if _exists(spark, cache_dir):
        misses = misses.join(stored(spark, cache_dir, digest), "content_digest", "left_anti")
    misses = misses.dropDuplicates(["content_digest"])

    def encode(batches):
        count = counter(tokenizer)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            _, offsets = buffers(column)
            for i, j in pieces(offsets, BATCH):
                n = count(column.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array([digest] * (j - i)), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    misses.select("content_digest", "content").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_dir)


def count_tokens(docs: DataFrame, cache_dir: str, tokenizer: str, normal: Callable[[Column], Column] = lambda t: F.coalesce(t, F.lit(""))) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of docs (doc_id, text)."""
    content = normal(F.col("text"))
    fill_cache(docs.select(content_digest(content).alias("content_digest"), content.alias("content")), cache_dir, tokenizer)
    rows = settle(docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("n_bytes"), content_digest(content).alias("content_digest")))
    return spread_join(rows, stored(docs.sparkSession, cache_dir, version(tokenizer)), "content_digest", F.col("doc_id")).select("doc_id", "n_bytes", "n_tokens")
