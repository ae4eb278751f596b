"""Token counts through a digest cache.

A text is reduced to its normalised content (each run of ASCII white space becomes one space, none at the ends), which
the tokenizer can't tell from the text. The pair (digest of that content, digest of the tokenizer's file) is looked up in
a stored table; only distinct contents that it lacks are encoded, and their counts are appended to it.

Nulls count as empty texts, empty texts have no tokens, repeated rows are returned as often as they come, extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Chunks longer than this are encoded but not remembered; so many chunks are remembered in a Python worker at most.
CHUNK_BYTES, MEMO_CHUNKS = 64, 700_000
#: Each run of these becomes one space. No pattern of a supported tokenizer reaches across them.
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"

_memos: dict[str, tuple[object, dict[bytes, int]]] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _loaded(path: str) -> tuple[object, dict[bytes, int]]:
    if path not in _memos:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _memos[path] = tokenizer, {}
    return _memos[path]


def count_tokens(contents: list[bytes], path: str) -> list[int]:
    """Tokens of each content. It is split at ASCII white space, which a white-space-dropping tokenizer never spans, and each distinct chunk is encoded by the library once."""
    tokenizer, memo = _loaded(path)
    if len(memo) > MEMO_CHUNKS:
        memo.clear()
    split = [content.split() for content in contents]
    missing = list({chunk for chunks in split for chunk in chunks if chunk not in memo})
    for start in range(0, len(missing), 4096):
        part = missing[start : start + 4096]
        encoded = tokenizer.encode_batch([chunk.decode() for chunk in part], add_special_tokens=False)
        memo.update(zip(part, map(len, encoded), strict=True))
    counts = [sum(map(memo.__getitem__, chunks)) for chunks in split]
    for chunk in missing:
        if len(chunk) > CHUNK_BYTES:
            del memo[chunk]
    return counts


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and content_digest for every row of docs (doc_id, text).

    cache_path: a Parquet table (content_digest binary, tokenizer_digest string, n_tokens long) that grows with each call; made where it
    doesn't exist. tokenizer_path: a file of the tokenizers library whose pre-tokenizer drops white space.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    content = F.trim(F.regexp_replace("text", ASCII_SPACE, " "))
    keyed = C.texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content.alias("content")).withColumn("content_digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    known = cached(spark, cache_path, version)
    misses = keyed.select("content_digest", "content")
    if known is not None:
        misses = misses.join(known, "content_digest", "left_anti")
    misses = misses.dropDuplicates(["content_digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            counts = count_tokens(C.as_bytes(batch.column("content")), tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column("content_digest").cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, "content_digest binary, tokenizer_digest string, n_tokens long").write.mode("append").parquet(cache_path)
    counts = cached(spark, cache_path, version)
    joined = keyed.drop("content").join(counts, "content_digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("content_digest")).alias("content_digest"))


def cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Digests and counts of one tokenizer version. Should two writers have met, each digest counts once."""
    if not C.path_exists(spark, cache_path):
        return None
    stored = spark.read.schema("content_digest binary, tokenizer_digest string, n_tokens long").parquet(cache_path)
    return stored.filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents against a cache of this call's own, so that no earlier call saves it work."""
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), C.fresh_path(spark, "token-cache"), public_tokenizers.path("word_bpe_49k.json"))
