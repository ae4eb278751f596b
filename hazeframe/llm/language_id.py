"""Language identification as inference in a mixture of languages.

Each language is a distribution over byte trigrams of lower-cased text. A document's trigrams are drawn from a mixture of them;
expectation-maximisation estimates the document's proportions. Of the sets of its k most likely languages, the one with the
largest penalised likelihood is kept, and its proportions are estimated once more. The prediction is the largest of them.

The distributions are counted over all whole texts whose language is known, whatever their number and length: workers add up
trigrams by language, and only the counts of the TRIGRAMS chosen ones reach the driver. The prediction reads every whole text. A
text that is null or has no letter is `und`, as is every text where nothing was learned. Rows repeat as they come; an empty table
gives no rows. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Trigrams with a place of their own; all others share one.
TRIGRAMS = 3072
#: Distinct trigrams that a worker holds before it hands them on, and codes that it counts at once.
FLUSH, CODES = 1 << 20, 1 << 22
STEPS = 20
#: For each language beyond the first, times the logarithm of the number of trigrams. Trigrams overlap, so three of them tell what one would.
PENALTY = 3.0
#: Documents whose counts are held as one matrix, and their bytes.
AT_ONCE, AT_ONCE_BYTES = 64, 1 << 20
#: ASCII that is no letter counts as a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    #: The trigrams, as numbers of 24 bits, and their distribution by language; the last column is that of all other trigrams.
    trigrams: np.ndarray
    shares: np.ndarray


def codes(text: str) -> np.ndarray:
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang; not null) to (lang, gram, n); each worker adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def add() -> None:
            for lang, parts in waiting.items():
                own, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    before, m = held[lang]
                    both, index = np.unique(np.concatenate([before, own]), return_inverse=True)
                    held[lang] = both, np.bincount(index, np.concatenate([m, n])).astype(np.int64)
                else:
                    held[lang] = own, n.astype(np.int64)
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (own, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for batch in C.slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = codes(text)
                waiting.setdefault(lang, []).append(own)
                size += len(own)
                if size > CODES:
                    add()
                    size = 0
                    if sum(len(own) for own, _ in held.values()) > FLUSH:
                        yield from out()
        add()
        yield from out()
        C.release_memory()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column | None = None) -> Model | None:
    """docs (doc_id, text, lang). learn: a condition on doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    C.bound_batches(docs.sparkSession)
    counts, path = C.stored_at(trigram_counts(rows.filter(learn) if learn is not None else rows), "trigrams")
    whole = {row["lang"]: row["n"] for row in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not whole:
        return None
    # a trigram's weight is its largest share of a language
    totals = F.broadcast(docs.sparkSession.createDataFrame(list(whole.items()), "lang string, whole long"))
    weights = counts.join(totals, "lang").groupBy("gram").agg(F.max(F.col("n") / F.col("whole")).alias("weight"))
    chosen = weights.orderBy(F.desc("weight"), "gram").limit(TRIGRAMS).select("gram")  # TRIGRAMS rows at most
    own = counts.join(F.broadcast(chosen), "gram").collect()
    C.remove(docs.sparkSession, path)
    grams = np.unique(np.array([row["gram"] for row in own], np.int64))
    languages = sorted(whole)
    place = {lang: k for k, lang in enumerate(languages)}
    table = np.full((len(languages), len(grams) + 1), 0.5)
    table[[place[row["lang"]] for row in own], np.searchsorted(grams, [row["gram"] for row in own])] += [row["n"] for row in own]
    table[:, -1] += np.array([whole[lang] for lang in languages]) - (table[:, :-1] - 0.5).sum(axis=1)
    return Model(languages, grams, (table / table.sum(axis=1, keepdims=True)).astype(np.float32))


_tables: dict[int, np.ndarray] = {}


def _table(model: Model) -> np.ndarray:
    key = hash(model.trigrams.tobytes())
    if key not in _tables:
        _tables.clear()
        table = np.full(1 << 24, len(model.trigrams), np.int16)
        table[model.trigrams] = np.arange(len(model.trigrams))
        _tables[key] = table
    return _tables[key]


def mixture(counts: np.ndarray, shares: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for each row of counts (documents x trigrams), over the languages that allowed (documents x languages) marks. Returns proportions and log-likelihoods."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    p = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for _ in range(STEPS if (allowed.sum(axis=1) > 1).any() else 0):
        p = p * ((counts / np.maximum(p @ shares, 1e-20)) @ shares.T) / total
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-20)
    return p, (counts * np.log(np.maximum(p @ shares, 1e-20))).sum(axis=1, dtype=np.float64)


def infer(texts: list[str], model: Model) -> np.ndarray:
    """Proportions (documents x languages) over each document's selected languages."""
    table, width, n = _table(model), len(model.trigrams) + 1, len(model.languages)
    own = [table[codes(text)].astype(np.int64) + k * width for k, text in enumerate(texts)]
    counts = np.bincount(np.concatenate(own), minlength=len(texts) * width).reshape(len(texts), width).astype(np.float32)
    used = np.flatnonzero(counts.any(axis=0))
    counts, shares = np.ascontiguousarray(counts[:, used]), np.ascontiguousarray(model.shares[:, used])
    everything, _ = mixture(counts, shares, np.ones((len(texts), n), bool))
    rank = np.argsort(np.argsort(-everything, axis=1, kind="stable"), axis=1)
    price = PENALTY * np.log(counts.sum(axis=1) + 1)
    best, kept = np.full(len(texts), -np.inf), np.zeros((len(texts), n), np.float32)
    left = np.arange(len(texts))  # a document leaves where one more language doesn't pay
    for k in range(1, n + 1):
        p, likelihood = mixture(counts[left], shares, rank[left] < k)
        value = likelihood - (k - 1) * price[left]
        better = value > best[left]
        left = left[better]
        best[left], kept[left] = value[better], p[better]
        if not len(left):
            break
    return kept


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and languages (array of (lang, share), largest first); all columns pass through, those of these names are replaced."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in C.slices(batches):
            texts = batch.column("text").to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            clear = [k for k, text in enumerate(texts) if model is not None and text and _LETTER.search(text)]
            start = 0
            while start < len(clear):
                end, size = start, 0
                while end < len(clear) and end - start < AT_ONCE and size < AT_ONCE_BYTES:
                    size += len(texts[clear[end]])
                    end += 1
                part = clear[start:end]
                for k, p in zip(part, infer([texts[k] for k in part], model), strict=True):
                    order = np.argsort(-p, kind="stable")
                    found[k] = [{"lang": model.languages[i], "share": float(min(1.0, p[i]))} for i in order if p[i] > 0]
                start = end
            columns = [batch.column("row"), pa.array([f[0]["lang"] if f else UNDETERMINED for f in found], pa.string()), pa.array([f[0]["share"] if f else 0.0 for f in found], pa.float64()), pa.array(found, pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", "languages"])
        C.release_memory()

    C.bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*others).alias("row"), F.col("text").alias("text"))
    schema = packed.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<lang:string,share:double>>").alias("languages")).schema
    return packed.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in others), "lang_pred", "score", "languages")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from those whose fold is not 2."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.fold(4) != 2)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (C.fold(4) == 2).alias("held_out"), "lang_pred", "score")
