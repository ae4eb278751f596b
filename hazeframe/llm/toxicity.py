"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text; a window is compressed with the ordinary one
and with both together, so it gains by what toxic text has of its own. Training goes over its mistakes: windows of ordinary text
that gain are trained into the ordinary dictionary, windows of toxic text that still gain into the toxic one (MINING). A text is
cut into overlapping windows, and the share of windows whose gain reaches each of a few thresholds, with the largest gain, goes
into a logistic curve that is calibrated on labelled documents of its own.

The fit uses a bounded sample of labelled documents (SAMPLE), of whatever length: the dictionaries see PIECES pieces of each,
evenly spread, the calibration and the scoring every whole text. Of several texts under one doc_id the fit uses the smallest.
Null and empty texts are one empty window. Rows repeat as they come; an empty table gives no rows. A null label doesn't count; of
several labels for one document the toxic one holds. With no toxic or no ordinary label, or too little text, every score is the
share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Labelled documents for the fit, at most: toxic and ordinary. Of these, the share that the dictionaries are trained on; the rest calibrates.
SAMPLE, TRAIN_SHARE = (2400, 4800), 0.6
#: Pieces of a document for the dictionaries, at most, and their bytes.
PIECES, PIECE = 48, 256
WINDOW, STRIDE = 64, 48
#: Bytes of the ordinary dictionary, of what each round of mining adds to it, of the first toxic dictionary and of what mining adds to that.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES, MORE_BYTES = 32_000, 16_000, 8_000, 4_000
#: Rounds; windows of ordinary text that they look at; gains from which on an ordinary window is a mistake and a toxic one a find.
MINING, MINED_WINDOWS, MISTAKE, FIND = 2, 150_000, 2, 3
#: A word belongs to toxic text if it is so many times as frequent there.
TIMES = 10
#: Keeps the trainer from spanning words.
_APART = b"\0" * 8
GAINS = (2, 3, 4, 5, 6, 7, 9)
THRESHOLD = 0.3


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    #: The score where there is nothing to compare.
    constant: float | None = None

    def digest(self) -> str:
        return hashlib.sha256(self.ordinary + b"\0" + self.toxic).hexdigest()


def windows(text: bytes) -> list[bytes]:
    return [text[k : k + WINDOW] for k in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE)]


_compressors: dict[str, tuple[Z.ZstdCompressor, Z.ZstdCompressor]] = {}


def _pair(model: Model) -> tuple[Z.ZstdCompressor, Z.ZstdCompressor]:
    key = model.digest()
    if key not in _compressors:
        _compressors.clear()
        how = Z.ZstdCompressionParameters(strategy=Z.STRATEGY_LAZY, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
        both = []
        for content in (model.ordinary, model.toxic):
            dictionary = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=how)
            both.append(Z.ZstdCompressor(dict_data=dictionary, compression_params=how))
        _compressors[key] = both[0], both[1]
    return _compressors[key]


def _gains(cut: list[bytes], model: Model) -> np.ndarray:
    ordinary, toxic = _pair(model)
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in cut], np.int64)


def gains(text: bytes, model: Model) -> np.ndarray:
    """For each window, the bytes that the toxic dictionary saves over the ordinary one."""
    return _gains(windows(text.translate(C.ASCII_LOWER)), model)


def described(gain: np.ndarray) -> list[float]:
    shares = [float((gain >= t).mean()) for t in GAINS]
    return [1.0, *(10 * s for s in shares), *(math.log1p(s * len(gain)) for s in shares), float(gain.max()) / 4, math.log1p(len(gain)) / 4]


def score(text: bytes, model: Model) -> float:
    if model.constant is not None:
        return model.constant
    z = float(np.dot(described(gains(text, model)), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def pieces(text: bytes) -> list[bytes]:
    """PIECES pieces of a text at most, evenly spread over the whole of it, A-Z lower-cased."""
    n = -(-len(text) // PIECE)
    chosen = range(n) if n <= PIECES else sorted({round(k * (n - 1) / (PIECES - 1)) for k in range(PIECES)})
    return [text[k * PIECE : (k + 1) * PIECE].translate(C.ASCII_LOWER) for k in chosen]


def _dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """The content of a trained dictionary; of too little text, the text."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return Z.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except Z.ZstdError:
        return b"".join(samples)[-size:]


def of_its_own(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The toxic samples less the words that are about as frequent in ordinary ones; words stand apart."""
    here, there = (Counter(word for x in part for word in x.split()) for part in (toxic, ordinary))
    ratio = TIMES * max(1, sum(map(len, toxic))) / max(1, sum(map(len, ordinary)))
    return [b"".join(b" " + word + _APART for word in x.split() if here[word] > there[word] * ratio) for x in toxic]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """toxic, ordinary: pieces of text."""
    how = {"k": 16, "d": 8}
    shuffled = random.Random(1)
    toxic, ordinary = (shuffled.sample(part, len(part)) for part in (toxic, ordinary))  # the trainer looks for the best of each stretch
    windows_of = lambda part: [w for x in part for w in windows(x)]
    toxic_dictionary = lambda part, against, size: re.sub(rb"\0+", b" ", _dictionary(of_its_own(part, against), size, **how))
    base = _dictionary(ordinary, ORDINARY_BYTES)
    own = toxic_dictionary(toxic, ordinary, TOXIC_BYTES)
    cut_toxic, cut_ordinary = windows_of(toxic), windows_of(ordinary)
    cut_ordinary = shuffled.sample(cut_ordinary, min(len(cut_ordinary), MINED_WINDOWS))
    for k in range(MINING):
        gain = _gains(cut_ordinary, Model(base, own + base))
        mistakes = [cut_ordinary[i] for i in np.flatnonzero(gain >= MISTAKE)]
        if mistakes:
            base = _dictionary(mistakes, HARD_BYTES, **how) + base
        if k < MINING - 1:
            found = [cut_toxic[i] for i in np.flatnonzero(_gains(cut_toxic, Model(base, own + base)) >= FIND)]
            if found:
                own = toxic_dictionary(found, cut_ordinary, MORE_BYTES) + own
    return Model(base, own + base)


def calibrate(model: Model, toxic: list[list[float]], ordinary: list[list[float]], toxic_share: float) -> Model:
    """toxic, ordinary: texts as `described`. Weights follow the share of toxic documents among all labels."""
    if not toxic or not ordinary:
        return Model(constant=toxic_share)
    x, y = np.array(toxic + ordinary), np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weights = _logistic(x, y)
    there = y.mean()
    weights[0] += math.log(toxic_share / (1 - toxic_share)) - math.log(there / (1 - there)) if 0 < toxic_share < 1 else 0
    model.weights = weights.tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for a logistic curve with a ridge on all weights but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). learn: a condition on doc_id for the labels to use. Two jobs over the sampled documents: pieces for the dictionaries, then the others' windows."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.filter(learn) if learn is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in marks.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    roles = []
    for k, most in ((1, SAMPLE[0]), (0, SAMPLE[1])):
        ids = [row["doc_id"] for row in marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]  # SAMPLE ids at most
        roles += [(i, k, n < int(len(ids) * TRAIN_SHARE)) for n, i in enumerate(ids)]
    if not {(1, True), (0, True), (1, False), (0, False)} <= {(k, trains) for _, k, trains in roles}:
        return Model(constant=share)
    chosen = F.broadcast(spark.createDataFrame(roles, "doc_id long, toxic int, trains boolean"))
    texts = C.texts(docs).join(chosen, "doc_id").groupBy("doc_id", "toxic", "trains").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([pieces(t) for t in C.as_bytes(batch.column("text"))], pa.list_(pa.binary()))], ["toxic", "pieces"])

    rows = texts.filter("trains").select("toxic", "text").mapInArrow(cut, "toxic int, pieces array<binary>").collect()  # PIECES * PIECE bytes for each sampled document
    by = {k: sorted({bytes(p) for row in rows if row["toxic"] == k for p in row["pieces"]}) for k in (0, 1)}
    del rows
    model = train_dictionaries(by[1], by[0])
    shared = spark.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([described(gains(t, shared.value)) for t in C.as_bytes(batch.column("text"))], pa.list_(pa.float64()))], ["toxic", "x"])

    rows = texts.filter("NOT trains").select("toxic", "text").mapInArrow(describe, "toxic int, x array<double>").collect()  # a few numbers for each sampled document
    C.release_memory()
    return calibrate(model, *(sorted(list(row["x"]) for row in rows if row["toxic"] == k) for k in (1, 0)), share)


def _scored(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """row (the columns of docs) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            found = pa.array([score(text, shared.value) for text in C.as_bytes(batch.column("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "score"])
        C.release_memory()

    C.bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"))
    return packed.mapInArrow(run, packed.select("row", F.lit(0.0).alias("score")).schema)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (double, 0 to 1); all columns pass through, one of that name is replaced."""
    others = [c for c in docs.columns if c != "toxicity"]
    return _scored(docs, others, model).select(*(F.col("row").getField(c).alias(c) for c in others), F.col("score").alias("toxicity"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    kept = _scored(docs, docs.columns, model).filter(F.col("score") < threshold)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from the labels whose fold is not 2."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, C.table(spark, sf_dir, "labels"), C.fold(4) != 2)
    scored = toxicity(docs, model)
    return scored.select("doc_id", (C.fold(4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
