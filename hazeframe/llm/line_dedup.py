"""Line deduplication with two Bloom filters.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least `min_chars` code points that
at least two documents hold loses all its lines except in the smallest doc_id that holds it.

One scan puts each document's distinct keys into a pair of filters: once-seen and twice-seen, merged by slices, so that a bit that
two documents (or two keys) set ends in the second. Their size follows the input's bytes, between MIN_BITS and MAX_BITS. A second
scan asks the broadcast twice-seen filter; only ids and SHA-256 digests of suspected keys go to an exact count, false alarms of the
filter end there, and a full filter costs shuffle, never results. Documents without a suspected key pass through and are never
shuffled; the others meet the digests that they lose. Keys that very many documents hold (there are HOT at most) are broadcast, so
that no task holds all of a key's documents.

Null texts count as one empty line and stay null. A null doc_id counts as the largest one. Rows with the same doc_id are one
document. Extra columns pass through; one named like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MIN_CHARS = 10
#: log2 of each filter's bits, at least and at most; 2**30 bits are the 128 MB that are broadcast at most, whatever the input.
MIN_BITS, MAX_BITS = 20, 30
#: Filter bits for each byte of text: a key has ten bytes or more.
BITS_PER_BYTE = 0.5
#: Keys that are held by more than a HOT-th of all suspected lines count as very frequent.
HOT = 4096
#: Hashes that a worker gathers before it hands bits on.
FLUSH = 1 << 18
#: log2 of the bits of a slice, the unit in which filters are merged.
SLICE_BITS = 20
WHITE = b" \t\n\x0b\x0c\r"


def keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For each line of text its key, or None if that is too short."""
    out = []
    for line in text.translate(C.ASCII_LOWER).split(b"\n"):
        key = line.strip(WHITE)
        out.append(key if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars else None)
    return out


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of each 64-bit hash."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.uint32), (hashes >> np.uint64(32) & mask).astype(np.uint32)


def _hashes(document: bytes, min_chars: int) -> set[int]:
    return {xxhash.xxh3_64_intdigest(key) for key in set(keys(document, min_chars)) if key is not None}


def filter_bits_for(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(1 + size * BITS_PER_BYTE))))


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The twice-seen filter of docs (text), packed bits."""
    part = min(SLICE_BITS, bits)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            first, second = places(np.concatenate([*held, np.zeros(0, np.uint64)]), bits)
            held.clear()
            # a key's own two bits may be one
            both = np.concatenate([first, second[first != second]])
            found, counts = np.unique(both, return_counts=True)
            cuts = np.flatnonzero(np.diff(found >> part)) + 1
            rows = [(int(f[0] >> part), f.tobytes(), f[c > 1].tobytes()) for f, c in zip(np.split(found, cuts), np.split(counts, cuts), strict=True) if len(f)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "once", "twice"])

        size = 0
        for batch in C.slices(batches):
            for text in C.as_bytes(batch.column("text")):
                own = _hashes(text, min_chars)
                held.append(np.fromiter(own, np.uint64, len(own)))
                size += len(own)
                if size > FLUSH:
                    yield out()
                    size = 0
        yield out()
        C.release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, again = None, None, None
        low = np.uint32((1 << part) - 1)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], ["slice", "twice"])

        for batch in batches:
            for k, o, t in zip(*(batch.column(n).to_pylist() for n in ("slice", "once", "twice")), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, seen, again = k, np.zeros(1 << part, bool), np.zeros(1 << part, bool)
                o, t = np.frombuffer(o, np.uint32) & low, np.frombuffer(t, np.uint32) & low
                again[o[seen[o]]] = True
                again[t] = True
                seen[o] = True
        if at is not None:
            yield done()
        C.release_memory()

    sparse = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(once, "slice int, once binary, twice binary")
    merged = sparse.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    whole = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for row in merged.toLocalIterator():  # of fixed size: 2**bits bits in all
        own = np.frombuffer(row["twice"], np.uint8)
        start = (row["slice"] << part) >> 3
        whole[start : start + len(own)] |= own
    return whole


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, filter_bits: int | None = None, counts: bool = True) -> DataFrame:
    """docs (doc_id, text and any others) with text cleaned, and, if counts, n_lines (before) and n_dropped, long. filter_bits: log2 of the filters' bits, by the input's size if None."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    bits = filter_bits_for(docs) if filter_bits is None else filter_bits
    results = ["n_lines", "n_dropped"] if counts else []
    others = [c for c in docs.columns if c not in results]
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    # the text goes by itself, so that no row holds it twice
    rows = docs.select(F.struct(*(c for c in others if c != "text"), F.col("text").isNull().alias("__null")).alias("row"), ids.alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    twice = spark.sparkContext.broadcast(twice_seen(docs, min_chars, bits))

    def suspected(text: bytes) -> list[bytes]:
        own = sorted({key for key in keys(text, min_chars) if key is not None})
        if not own:
            return []
        table = twice.value
        hit = np.ones(len(own), bool)
        for p in places(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits):
            hit &= (table[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return [own[k] for k in np.flatnonzero(hit)]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            found = [[hashlib.sha256(key).digest() for key in suspected(text)] for text in C.as_bytes(batch.column("text"))]
            flat = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(flat)), pa.array([d for f in found for d in f], pa.binary())], ["id", "digest"])
        C.release_memory()

    def parted(clear: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in C.slices(batches):
                documents = C.as_bytes(batch.column("text"))
                held = pa.array([(not suspected(text)) == clear for text in documents], pa.bool_())
                if not clear:
                    yield batch.filter(held)
                    continue
                lines = pa.array([text.count(b"\n") + 1 for text in documents], pa.int64())
                yield batch.append_column("n_lines", lines).append_column("n_dropped", pa.array([0] * len(documents), pa.int64())).filter(held)
            C.release_memory()

        return run

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(C.as_bytes(batch.column("text")), batch.column("drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(gone or ())
                keep = [line for line, key in zip(lines, keys(text, min_chars), strict=True) if key is None or hashlib.sha256(key).digest() not in gone] if gone else lines
                texts.append(b"\n".join(keep).decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            columns = [batch.column("row"), batch.column("id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "text", "n_lines", "n_dropped"])
        C.release_memory()

    counted = rows.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    scratch = C.Scratch(spark)
    links = scratch.stored(rows.select("id", "text").mapInArrow(digests, "id long, digest binary"), "suspects")
    n_links = links.count()
    repeated = links.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last")
    repeated = scratch.stored(repeated.select("digest", "first", "n"), "repeated", n_links)
    most = 1 + n_links // HOT
    few, many = (repeated.filter(condition).select("digest", "first") for condition in (F.col("n") <= most, F.col("n") > most))
    met = links.join(F.broadcast(many), "digest", "left").withColumnRenamed("first", "often")  # HOT rows at most
    rare = met.filter("often IS NULL").drop("often").join(few, "digest").filter("id > first").select("id", "digest")
    gone = met.filter("id > often").select("id", "digest").unionByName(rare)
    drops = scratch.stored(gone.groupBy("id").agg(F.collect_set("digest").alias("drops")), "drops", n_links)
    scratch.clear(keep=1)
    C.release_memory()
    cleaned = rows.mapInArrow(parted(False), rows.schema).join(drops, "id", "left").select("row", "id", "text", "drops").mapInArrow(drop, counted)
    out = rows.mapInArrow(parted(True), counted).unionByName(cleaned)
    changed = F.when(~F.col("row").getField("__null"), F.col("text"))
    return out.select(*(changed.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in others), *results)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM line),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
flagged AS (SELECT doc_id, k, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
