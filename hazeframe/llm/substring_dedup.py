"""Removal of repeated byte strings across all texts, by bucket-pointer refinement of suffixes.

Each byte that is covered by a `LENGTH`-byte string that also starts earlier (smaller doc_id, or same document, earlier start) goes.

Comparing every suffix of a corpus would shuffle a multiple of it, so three steps narrow the suffixes down, and lose none:

1. Equal texts become one unit, stored in buckets by its key, so that later joins with its text shuffle nothing. The key is 60 bits of
   the text's SHA-256; where two digests share these, as they do among some 10^9 texts, keys come from the next 60 bits.
2. Of the GRAM-byte hashes in each LENGTH-byte string, the rightmost smallest is its anchor. Equal strings have equal anchors at equal
   places, so only strings at an anchor that occurs twice can repeat. Anchors are dealt by hash in packed arrays; one that a batch
   holds twice sends one entry for all.
3. Around each such anchor, the context that all strings with this anchor cover is sent to the anchor's bucket. Of equal contexts all
   but the earliest repeat as a whole. The suffixes of what is left are put into q-gram buckets, refined by sorting on the bucket
   identifiers of later offsets; each round's identifiers serve the next, until buckets hold suffixes with LENGTH bytes in common.

Null texts count as empty. Rows with equal doc_id and text are one document, whose result repeats; of several texts under one
doc_id, the one with the smaller digest comes first. A null doc_id comes last. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

LENGTH, GRAM = 100, 32
#: Bytes whose anchors are computed at once, and bytes of text for each hash bucket.
PIECE, BUCKET = 1 << 19, 1 << 20
#: Bytes of text that a writer holds at once.
ROW_GROUP = 1 << 24
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        tables = [np.full(n, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        for table in tables:
            table[0] = 1
        _powers[:] = [np.cumprod(table, dtype=np.uint64) for table in tables]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    powers, inverse = _power_tables(max(PIECE + 4 * LENGTH, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: texts, one after the other, that end at ends. Returns for each anchor: hash, place, first string that it stands for, number of such strings."""
    none = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < LENGTH:
        return none
    h = gram_hashes(data)
    grams = LENGTH - GRAM + 1
    best = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= grams:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < grams:
        best = np.minimum(best[: len(best) - (grams - width)], best[grams - width :])
    at = np.int64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(len(at), bool)  # strings that lie in one text
    for end in ends[:-1]:
        whole[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none
    own = at[starts]
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    n = np.diff(np.concatenate([cut, [len(starts)]]))
    return h[own[cut]], own[cut], starts[cut], n


def _pieces(units: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(unit, offset, bytes) in lists of about PIECE bytes; long texts in parts that overlap by LENGTH - 1 bytes, so that each string lies in one."""
    held, size = [], 0
    for unit, text in units:
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            held.append((unit, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_anchors(units: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of all units: hash, unit, place in it, how far before it its first string starts, number of strings."""
    out = []
    for held in _pieces(units):
        ends = np.cumsum([len(part) for _, _, part in held])
        h, at, start, n = anchors(np.frombuffer(b"".join(part for _, _, part in held), np.uint8), ends)
        which = np.searchsorted(ends, start, side="right")
        unit = np.array([u for u, _, _ in held], np.int64)[which]
        offset = np.array([o for _, o, _ in held], np.int64)[which] - np.concatenate([[0], ends[:-1]])[which]
        out.append((h, unit, at + offset, at - start, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))


def _ids(*keys: np.ndarray) -> np.ndarray:
    """A bucket identifier for each place: equal where all keys are, in their order."""
    if len(keys) == 1:
        return np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    return np.unique(keys[0] << np.uint64(32) | keys[1], return_inverse=True)[1].astype(np.uint64)


def refine(data: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of suffixes (places in data with `length` bytes after them at least): equal where the first `length` bytes are.

    The first buckets are by 8 bytes. A round joins each place's bucket with that of the place as many bytes later as the bucket has in
    common; places beyond the end count as the lowest bucket.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.zeros(len(data), np.uint64)
    for k in range(8):
        grams = grams << np.uint64(8) | padded[k : k + len(data)].astype(np.uint64)
    ids, common = _ids(grams), 8
    while common < length:
        step = min(common, length - common)
        if step < common or 2 * common >= length:  # the last round: only the suffixes asked for
            return _ids(ids[suffixes], ids[suffixes + step])
        later = np.concatenate([ids[step:], np.zeros(step, np.uint64)])
        ids, common = _ids(ids, later), common + step
    return ids[suffixes]


def repeats(occurrences: list[tuple[int, tuple, int, bytes]]) -> list[tuple[tuple, int, int]]:
    """occurrences: (anchor's hash, unit's order, first string's start, context). Returns (unit's order, start, number): strings in a row that also start earlier."""
    out: list[tuple[tuple, int, int]] = []
    by_anchor: dict[int, dict[bytes, tuple]] = {}
    for h, order, start, context in occurrences:
        contexts = by_anchor.setdefault(h, {})
        first = contexts.get(context)
        if first is None:
            contexts[context] = (order, start)
            continue
        late = max(first, (order, start))
        contexts[context] = min(first, (order, start))
        out.append((*late, len(context) - LENGTH + 1))
    several = [(first, context) for contexts in by_anchor.values() if len(contexts) > 1 for context, first in contexts.items()]
    if not several:
        return out
    several.sort(key=lambda x: x[0])  # a text's contexts hold different strings, so the first place of a bucket is its earliest string
    lengths = np.array([len(context) for _, context in several])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = lengths - LENGTH + 1
    which = np.repeat(np.arange(len(several)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = refine(np.frombuffer(b"".join(context for _, context in several), np.uint8), begins[which] + within)
    earliest = np.zeros(int(ids.max()) + 1, np.int64)
    earliest[ids[::-1].astype(np.int64)] = np.arange(len(ids))[::-1]
    again = np.ones(len(ids), bool)
    again[earliest] = False
    places = np.flatnonzero(again)
    if len(places):
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(which[places]) != 0)]))
        for a, m in zip(places[cut].tolist(), np.diff(np.concatenate([cut, [len(places)]])).tolist(), strict=True):
            order, start = several[which[a]][0]
            out.append((order, start + int(within[a]), m))
    return out


def covered(starts: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of bytes under the strings."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + numbers - 1 + LENGTH)[order])
    cut = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    last = np.concatenate([cut[1:], [len(begin)]]) - 1
    return list(zip(begin[cut].tolist(), end[last].tolist(), strict=True))


_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) for every row of docs (doc_id, text); stored in the shared folder, so that the table of units can go."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    keyed = _keyed(C.texts(docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"hazeframe_units_{uuid.uuid4().hex}"
    keyed.groupBy("unit").agg(F.min("order").alias("order"), F.first("text").alias("text")).write.format("parquet").option("parquet.block.size", ROW_GROUP).bucketBy(parts, "unit").saveAsTable(name)
    try:
        return C.stored(_removed(keyed, spark.table(name), with_text), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _keyed(texts: DataFrame, bits: int = 60) -> DataFrame:
    """texts (doc_id, text) with order and unit, the same for equal texts only."""
    digits = bits // 4
    of = lambda first: F.conv(F.substring("digest", first, digits), 16, 10).cast("long")
    digests = texts.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    numbered = digests.withColumns({"unit": of(1), "next": F.conv(F.substring("digest", digits + 1, 15), 16, 10).cast("long")})
    clashes = numbered.groupBy("unit").agg(F.min("next").alias("low"), F.max("next").alias("high")).filter("low < high").select("unit", F.lit(True).alias("clash"))
    clashes = C.stored(clashes, "clashes")
    if clashes.limit(1).count():  # one in some 10^7 texts, among 10^11
        numbered = numbered.join(clashes, "unit", "left").withColumn("unit", F.when(F.col("clash"), -1 - F.col("next")).otherwise(F.col("unit")))
    return numbered.select("doc_id", "order", "text", "unit")


def _removed(keyed: DataFrame, units: DataFrame, with_text: bool) -> DataFrame:
    buckets = 1 + (units.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET
    suspects = _suspects(units, buckets)
    removals = _removals(units.join(suspects, "unit"), buckets)
    spans = removals.groupBy("unit").agg(F.collect_list(F.struct("start", "n")).alias("strings"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            rows = []
            for unit, order, text, strings in zip(batch.column("unit").to_pylist(), batch.column("order").to_pylist(), C.as_bytes(batch.column("text")), batch.column("strings").to_pylist(), strict=True):
                runs = covered(np.array([s["start"] for s in strings]), np.array([s["n"] for s in strings])) if strings else []
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                rows.append((unit, order, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["unit", "first", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = units.join(spans, "unit", "left").select("unit", "order", "text", "strings").mapInArrow(cut, "unit long, first long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    joined = keyed.select("doc_id", "order", "unit").join(done, "unit")
    copy = (F.col("order") > F.col("first")) & (F.col("n_bytes") >= LENGTH)  # of an earlier document's text
    columns = ["doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    return joined.select(*columns, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))


def _suspects(units: DataFrame, buckets: int) -> DataFrame:
    """units (unit, text) to (unit, found: array of (at, before, n, h)): the anchors that occur twice."""
    fields = (("h", np.uint64), ("unit", np.int64), ("at", np.int64), ("before", np.uint8), ("n", np.uint8), ("times", np.uint8))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, unit, at, before, n = find_anchors(list(zip(batch.column("unit").to_pylist(), C.as_bytes(batch.column("text")), strict=True)))
            if not len(h):
                continue
            _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(h), bool)
            lead[first] = True
            entry = [h, unit, at, before.astype(np.uint8), n.astype(np.uint8), np.minimum(times[inverse], 2).astype(np.uint8)]
            bucket = np.where(lead, (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets, (unit & 0xFFFFFFFF) % buckets)
            order = np.lexsort((bucket, ~lead))
            lead, bucket, entry = lead[order], bucket[order], [x[order] for x in entry]
            cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lead[1:] != lead[:-1])]))
            ends = np.concatenate([cut[1:], [len(bucket)]])
            columns = [pa.array(bucket[cut], pa.int64()), pa.array(~lead[cut], pa.bool_())]
            columns += [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in entry]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "sure", *(f for f, _ in fields)])

    def meet(table: pa.Table) -> pa.Table:
        sure = np.repeat(table.column("sure").to_numpy(zero_copy_only=False), [len(x) // 8 for x in table.column("h").to_pylist()])
        h, unit, at, before, n, times = (np.frombuffer(b"".join(table.column(f).to_pylist()), kind) for f, kind in fields)
        _, inverse = np.unique(h, return_inverse=True)
        keep = sure | (np.bincount(inverse, weights=np.where(sure, 0, times))[inverse] >= 2) if len(h) else sure
        return pa.table({"unit": unit[keep], "at": at[keep], "before": before[keep].astype(np.int32), "n": n[keep].astype(np.int32), "h": h[keep].view(np.int64)})

    dealt = units.select("unit", "text").mapInArrow(deal, "bucket long, sure boolean, " + ", ".join(f"{f} binary" for f, _ in fields))
    met = dealt.groupBy("bucket").applyInArrow(meet, "unit long, at long, before int, n int, h long")
    return met.groupBy("unit").agg(F.collect_list(F.struct("at", "before", "n", "h")).alias("found"))


def _removals(found: DataFrame, buckets: int) -> DataFrame:
    """found (unit, order, text, found) to (unit, start, n): strings in a row that also start earlier."""
    fields = ("h", "unit", "order", "start", "length")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            occurrences = []
            for unit, order, text, own in zip(batch.column("unit").to_pylist(), batch.column("order").to_pylist(), C.as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                for a in own:
                    start = a["at"] - a["before"]
                    occurrences.append((a["h"], (order, unit), start, text[start : start + a["n"] - 1 + LENGTH]))
            first: dict[tuple[int, bytes], tuple] = {}
            gone = []
            for h, order, start, context in occurrences:
                held = first.get((h, context))
                if held is None:
                    first[h, context] = order, start
                else:
                    gone.append((*max(held, (order, start)), len(context) - LENGTH + 1))
                    first[h, context] = min(held, (order, start))
            by: dict[int, list[tuple]] = {}
            for (h, context), (order, start) in first.items():
                by.setdefault((h & 0xFFFFFFFF) % buckets, []).append((h, order[1], order[0], start, len(context), context))
            rows = [(b, False, *(np.array([o[k] for o in own], np.int64).tobytes() for k in range(5)), b"".join(o[5] for o in own)) for b, own in by.items()]
            if gone:
                columns = [np.array(c, np.int64).tobytes() for c in zip(*((0, order[1], order[0], start, n) for order, start, n in gone), strict=True)]
                rows.append((gone[0][0][1] % buckets, True, *columns, b""))
            kinds = (pa.int64(), pa.bool_(), *[pa.binary()] * 6)
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "gone", *fields, "contexts"])

    def meet(table: pa.Table) -> pa.Table:
        out: list[tuple[tuple, int, int]] = []
        occurrences = []
        for gone, contexts, *packed in zip(table.column("gone").to_pylist(), table.column("contexts").to_pylist(), *(table.column(f).to_pylist() for f in fields), strict=True):
            h, unit, order, start, length = (np.frombuffer(x, np.int64).tolist() for x in packed)
            if gone:
                out += [((o, u), s, n) for u, o, s, n in zip(unit, order, start, length, strict=True)]
                continue
            at = 0
            for x, u, o, s, n in zip(h, unit, order, start, length, strict=True):
                occurrences.append((x, (o, u), s, contexts[at : at + n]))
                at += n
        out += repeats(occurrences)
        return pa.table({"unit": pa.array([order[1] for order, _, _ in out], pa.int64()), "start": pa.array([s for _, s, _ in out], pa.int64()), "n": pa.array([n for _, _, n in out], pa.int64())})

    sent = found.select("unit", "order", "text", "found").mapInArrow(send, "bucket long, gone boolean, " + ", ".join(f"{f} binary" for f in fields) + ", contexts binary")
    return sent.groupBy("bucket").applyInArrow(meet, "unit long, start long, n long")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 100-byte strings."""
    return remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
