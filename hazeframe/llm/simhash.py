"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Each fingerprint goes to the buckets of a small Hamming ball around each of its
segments. Two that differ in at most `radius` bits share a bucket, if the balls' radii b_i give sum(2 b_i + 1) > radius. In its
bucket a fingerprint finds the table's matches, and the complete distance verifies them. A bucket tells no more links than it
takes to connect its members, so a large group of near copies doesn't give all its pairs.

Null texts count as empty. Texts without words have fingerprint zero and are linked like any others. A null doc_id counts as
the largest one in the choice of the smallest. Rows repeat as they come; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .components import components
from .line_dedup import SLICE_BITS, places

SEED = 42
_LANES = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """XXH64 (unsigned) of each run of `words` words, joined by spaces, repeats included; of the whole sequence if it is shorter."""
    split = text.translate(C.ASCII_LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(split) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(split) - n :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """64-bit words; a bit is 1 if it is set in over half the hashes. Counted by byte values: a histogram of each byte tells its bits' counts.

    Words beyond the first take the hashes mixed once more (splitmix64).
    """
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words if len(hashes) else 0):
        if k:
            hashes = hashes + np.uint64(0x9E3779B97F4A7C15)
            hashes = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ hashes >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            hashes ^= hashes >> np.uint64(31)
        by = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(by[:, j], minlength=256) @ _LANES for j in range(8)])
        out[k] = int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")
    return out


def fingerprints(docs: DataFrame, words: int = 4, n_words: int = 1) -> DataFrame:
    """doc_id, w0, ... (the fingerprint's words as signed longs)."""
    names = [f"w{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            own = np.stack([fingerprint(shingle_hashes(text, words), n_words) for text in C.as_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(own[:, k].view(np.int64)) for k in range(n_words))], ["doc_id", *names])

    C.bound_batches(docs.sparkSession)
    return C.texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of n segments of 64 bits."""
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def ball(width: int, radius: int) -> np.ndarray:
    """All numbers of `width` bits with at most `radius` ones."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.uint64)


def finds(balls: tuple[int, ...]) -> int:
    """The largest distance at which no pair is missed: two balls of radius b around a segment meet if it differs in 2 b bits at most."""
    return sum(2 * b + 1 for b in balls) - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (their 64-bit words in the last axis)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label: each node's set, by its smallest node."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _search(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at `radius`: a search that compares with what it has not reached yet only."""
    left = np.arange(len(words))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[:64], front[64:]
            near = distances(words[step][:, None], words[left][None]) <= radius
            reached = near.any(axis=0)
            if reached.any():
                a.append(step[near[:, reached].argmax(axis=0)])
                b.append(left[reached])
                front, left = np.concatenate([front, left[reached]]), left[~reached]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


#: Buckets of up to so many members are compared together, by shifts; larger ones are searched one by one.
SMALL = 256


def spanning_links(keys: np.ndarray, nodes: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (nodes, words) under bucket keys. Returns links (a < b) between nodes, one less for each connected set than it has nodes."""
    own, index = np.unique(nodes, return_inverse=True)
    label = np.arange(len(own))
    order = np.argsort(keys, kind="stable")
    keys, index, words = keys[order], index[order], words[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [len(keys)]]))
    for begin, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = _search(words[begin : begin + size], radius)
        _merge(label, index[begin + a], index[begin + b])
    left = np.repeat(sizes, sizes)  # of a member's bucket, how many members follow it
    left = np.where(left > SMALL, 0, np.repeat(begins + sizes, sizes) - np.arange(len(keys)) - 1)
    at = np.flatnonzero(left)
    shift = 0
    while len(at):
        shift += 1
        at = at[left[at] >= shift]
        apart = label[index[at]] != label[index[at + shift]]
        a, b = at[apart], at[apart] + shift
        near = distances(words[a], words[b]) <= radius
        _merge(label, index[a[near]], index[b[near]])
    linked = np.flatnonzero(label != np.arange(len(own)))
    return own[label[linked]], own[linked]


#: Members that meet in one task, about.
MEET = 1 << 18


def near_links(points: DataFrame, radius: int, balls: tuple[int, ...], n_words: int = 1) -> DataFrame:
    """points (node: distinct; w0, ... w<n_words - 1>; long) to (a, b): links between nodes whose words differ in at most `radius` bits, enough to connect all that such links connect.

    The 64 bits of w0 are cut into len(balls) segments. Each point goes to the bucket of every number in the ball around each
    segment, packed by groups of buckets. All pairs up to finds(balls) are met; radius may be larger for a further part of them.
    """
    spark = points.sparkSession
    cut = segments(len(balls))
    around = [ball(width, r) for (_, width), r in zip(cut, balls, strict=True)]
    groups = 1 + points.count() * sum(map(len, around)) // MEET

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            words = np.stack([batch.column(f"w{k}").to_numpy().view(np.uint64) for k in range(n_words)], axis=1)
            parts = []
            for k, ((low, width), flips) in enumerate(zip(cut, around, strict=True)):
                value = words[:, 0] >> np.uint64(low) & np.uint64((1 << width) - 1)
                parts.append((value[:, None] ^ flips[None] | np.uint64(k << 40)).ravel())
            keys = np.concatenate(parts)
            which = np.concatenate([np.repeat(np.arange(len(node)), len(flips)) for flips in around])
            group = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            group, keys, which = group[order], keys[order], which[order]
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
            ends = [*begins[1:], len(group)]
            rows = [(int(group[a]), keys[a:b].tobytes(), node[which[a:b]].tobytes(), words[which[a:b]].tobytes()) for a, b in zip(begins, ends, strict=False)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["group", "keys", "nodes", "words"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(-1, n_words)
        a, b = spanning_links(keys, nodes, words, radius)
        return pa.table({"a": a, "b": b})

    C.bound_batches(spark)
    dealt = points.select("node", *(f"w{k}" for k in range(n_words))).mapInArrow(deal, "group long, keys binary, nodes binary, words binary")
    return dealt.groupBy("group").applyInArrow(meet, "a long, b long")


RADIUS = 4
#: A comparison of two fingerprints in a bucket costs about as much as a COMPARED-th of an entry that is dealt to it.
COMPARED = 64


def balls_for(n: int, radius: int = RADIUS) -> tuple[int, ...]:
    """The cheapest balls around segments, one of them at least of radius 1, that miss no pair of n fingerprints up to `radius` bits apart.

    Fewer, wider segments with larger balls deal more entries, but to buckets that grow more slowly with n: at a radius of 4, four
    segments up to some ten thousand fingerprints, three up to some ten million, then two of 32 bits.
    """

    def cost(balls: tuple[int, ...]) -> float:
        total = 0.0
        for (_, width), r in zip(segments(len(balls)), balls, strict=True):
            entries = sum(math.comb(width, k) for k in range(r + 1))
            total += entries * (1 + n * entries / 2.0**width / COMPARED)
        return total

    choices = []
    for count in range(1, radius + 1):
        ones = max(1, -(-(radius + 1 - count) // 2))
        choices.append(tuple(ones // count + (k < ones % count) for k in range(count)))
    return min((b for b in choices if finds(b) >= radius and max(b) <= 2), key=cost)


def near_components(prints: DataFrame, radius: int = RADIUS, balls: tuple[int, ...] | None = None) -> DataFrame:
    """prints (doc_id, w0, ...) to (w0, ..., component): each fingerprint once, with the smallest doc_id reachable over links of at most radius bits. balls: by the number of fingerprints if None."""
    words = [c for c in prints.columns if c != "doc_id"]
    first = F.min(F.coalesce("doc_id", F.lit(2**63 - 1)))
    node = F.col("w0") if len(words) == 1 else F.xxhash64(*words)
    scratch, n = C.Scratch(prints.sparkSession), prints.count()
    points = scratch.stored(prints.groupBy(*words).agg(first.alias("first")).withColumn("node", node), "fingerprints", n)
    joined = components(near_links(points, radius, balls or balls_for(points.count(), radius), len(words)))
    sets = points.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = sets.groupBy("root").agg(F.min("first").alias("smallest"))
    return sets.join(smallest, "root").select(*words, F.col("smallest").alias("component"))


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = RADIUS, balls: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text)."""
    if balls is not None and finds(balls) < radius:
        raise ValueError("these balls would miss links")
    prints = C.stored(fingerprints(docs, words), "prints")
    groups = near_components(prints, radius, balls)
    return prints.join(groups, "w0").select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Near-duplicates share SIMILAR of their shingles. Candidates come from fingerprints of 64 x SIMILAR_WORDS bits: they meet in a bucket
#: and differ in at most SIMILAR_RADIUS bits of all (at a similarity of SIMILAR 29 on average, with a deviation of 5). Their shingles decide.
SIMILAR, SIMILAR_WORDS, SIMILAR_RADIUS = (4, 5), 3, 48
#: Fingerprints that meet in one group, about; tables within a group; members of a bucket by chance, as a power of two.
TOGETHER, TABLES, CHANCE = 1 << 15, 8, 3
#: Bands are as many as it takes to miss at most MISSED of pairs that differ in UNLIKE bits; at a similarity of SIMILAR, 29 differ on average and one pair in 40 in more than UNLIKE.
UNLIKE, MISSED = 40, 0.01
#: The same for the second round, where fingerprints come with their sets.
WITH_SETS = 1 << 11
#: A bucket with more members has a hub; one with yet more is not compared pair by pair; nodes with more partners still apart are resolved by one count of all that they share.
HUB, CROWD, PARTNERS = 16, 2048, 64


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


def set_fingerprint(own: np.ndarray, n_words: int = SIMILAR_WORDS) -> np.ndarray:
    """The fingerprint of a set of shingles. In a set of even size the smallest hash counts twice, so no bit is a tie."""
    return fingerprint(own if len(own) % 2 else np.concatenate([own[:1], own]), n_words)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) share SIMILAR or more of their union; two empty ones do."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(a) + len(b) - shared)


def set_node(own: np.ndarray) -> int:
    """A set's number: a hash of its shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _identified(docs: DataFrame) -> DataFrame:
    """id (a null doc_id as the largest) and text."""
    return C.texts(docs).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text")


def set_prints(docs: DataFrame, words: int) -> DataFrame:
    """id, node, size (of the set of shingles), w0, ..."""
    names = [f"w{k}" for k in range(SIMILAR_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            sets = [shingle_set(text, words) for text in C.as_bytes(batch.column("text"))]
            own = np.stack([set_fingerprint(s) for s in sets]).view(np.int64)
            columns = [batch.column("id"), pa.array([set_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(own[:, k]) for k in range(SIMILAR_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "size", *names])
        C.release_memory()

    C.bound_batches(docs.sparkSession)
    return _identified(docs).mapInArrow(run, "id long, node long, size long, " + ", ".join(f"{n} long" for n in names))


def layout(n: int, together: int) -> tuple[int, int, int]:
    """For n fingerprints: bits that route a fingerprint to its group, bits of a segment, bands.

    Groups hold about `together` fingerprints and buckets 2 ** CHANCE of them by chance, so both stay small as n grows; the bands make up
    for what the routes then miss.
    """
    route = max(0, math.ceil(math.log2(max(1, n) / together)))
    segment = min(14, max(6, math.ceil(math.log2(max(2, n))) - CHANCE - route))
    same = 1 - UNLIKE / (64 * SIMILAR_WORDS)
    table = same**segment + segment * same ** (segment - 1) * (1 - same)
    band = same**route * (1 - (1 - table) ** TABLES)
    return route, segment, max(2, math.ceil(math.log(MISSED) / math.log(1 - band)))


def sampled_bits(route: int, segment: int, bands: int) -> np.ndarray:
    """For each band its bit numbers: the route's, then those of each segment; the same everywhere."""
    random = np.random.default_rng(SEED)
    return np.stack([random.permutation(64 * SIMILAR_WORDS)[: route + TABLES * segment] for _ in range(bands)])


def _value(bits: np.ndarray) -> np.ndarray:
    """Numbers from their bits (rows)."""
    return (bits.astype(np.int64) << np.arange(bits.shape[1])).sum(axis=1)


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def _fits(words: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs may be alike, by the sizes of their sets and by distance."""
    fits = SIMILAR[1] * np.minimum(sizes[a], sizes[b]) >= SIMILAR[0] * np.maximum(sizes[a], sizes[b])
    fits[fits] = distances(words[a[fits]], words[b[fits]]) <= SIMILAR_RADIUS
    return fits


def _matches(key: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of members of one table whose keys differ in one bit at most: for each number in the ball around a key, the table's matches. (members, their partners, False), a bounded number at once; crowds, which are not paired, as (members, members of the other bucket, True)."""
    order = np.argsort(key, kind="stable")
    offsets = np.searchsorted(key[order], np.arange((1 << segment) + 1))
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    for crowd in np.flatnonzero(np.diff(offsets) > CROWD).tolist():
        members = order[offsets[crowd] : offsets[crowd + 1]]
        yield members, members, True
    for flip in ball(segment, 1).astype(np.int64).tolist():
        probes = np.flatnonzero(key & flip == 0)
        wanted = key[probes] | flip
        begin = place[probes] + 1 if flip == 0 else offsets[wanted]
        n = offsets[wanted + 1] - begin
        crowded = np.diff(offsets)[wanted] > CROWD
        if flip and crowded.any():
            for bucket in np.unique(wanted[crowded]).tolist():
                yield probes[wanted == bucket], order[offsets[bucket] : offsets[bucket + 1]], True
        n = np.where(crowded, 0, n)
        begin, probes, n = begin[n > 0], probes[n > 0], n[n > 0]
        ends = np.cumsum(n)
        for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
            low, high = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, min(at + (1 << 20), int(ends[-1])), side="left") + 1
            own = n[low:high]
            first = np.repeat(np.cumsum(own) - own, own)
            within = np.arange(own.sum()) - first
            a, b = np.repeat(probes[low:high], own), order[np.repeat(begin[low:high], own) + within]
            spot = np.repeat(ends[low:high] - own, own) + within
            now = (spot >= at) & (spot < at + (1 << 20))
            yield a[now], b[now], False


def nearest_partners(words: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be alike: for each member the nearest one, and the nearest hub. A bucket's hub is its member nearest to their majority, as copies are alike to their source before each other."""
    far = 64 * words.shape[1] + 1
    best = np.full((2, len(words)), far)  # distance to the nearest member, and to the nearest hub
    other = np.full((2, len(words)), -1)

    def offer(kind: int, a: np.ndarray, b: np.ndarray) -> None:
        fits = _fits(words, sizes, a, b)
        a, b = a[fits], b[fits]
        d = distances(words[a], words[b])
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        a, b, d = a[first], b[first], d[first]
        nearer = d < best[kind, a]
        best[kind, a[nearer]], other[kind, a[nearer]] = d[nearer], b[nearer]

    for key in keys:
        for a, b, crowd in _matches(key, segment):
            if not crowd:
                offer(0, np.concatenate([a, b]), np.concatenate([b, a]))
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else []
        for at, end in zip(begins, [*begins[1:], len(key)], strict=False):
            if end - at > HUB:
                members = order[at:end]
                middle = np.packbits(2 * _unpacked(words[members]).sum(axis=0, dtype=np.int64) > len(members), bitorder="little").view("<u8")
                hub = members[distances(words[members], middle[None]).argmin()]
                members = members[members != hub]
                offer(1, members, np.full(len(members), hub))
    kind, a = np.nonzero(other >= 0)
    b = other[kind, a]
    return np.divmod(np.unique(np.minimum(a, b) * len(words) + np.maximum(a, b)), len(words))


def pairs_apart(words: np.ndarray, sizes: np.ndarray, cluster: np.ndarray, keys: list[np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of different clusters that may be alike, but those between two of the nodes that are told third: with more than PARTNERS such pairs, or in a crowd of several clusters."""
    many, held = np.zeros(len(words), bool), np.zeros(0, np.int64)
    for key in keys:
        for a, b, crowd in _matches(key, segment):
            if crowd:
                if len(np.unique(cluster[np.concatenate([a, b])])) > 1:
                    many[a] = many[b] = True
                continue
            apart = (cluster[a] != cluster[b]) & ~(many[a] & many[b])
            a, b = a[apart], b[apart]
            fits = _fits(words, sizes, a, b)
            if fits.any():
                held = np.unique(np.concatenate([held, (np.minimum(a, b) * len(words) + np.maximum(a, b))[fits]]))
                a, b = np.divmod(held, len(words))
                many |= np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words)) > PARTNERS
                held = held[~(many[a] & many[b])]
    return *np.divmod(held, len(words)), np.flatnonzero(many)


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: the rows, and how many members each of them shares with each set. What only one set has is left out of the product."""
    lengths = np.array([len(x) for x in sets])
    _, which, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    held = np.repeat(np.arange(len(sets)), lengths)[times[which] > 1]
    column = number[which[times[which] > 1]]
    width = int(number[-1]) + 1 if len(number) else 0
    begins = np.searchsorted(held, np.arange(len(sets) + 1))
    step = max(1, (1 << 22) // max(1, width))  # of 16 MB

    def dense(of: np.ndarray) -> np.ndarray:
        out = np.zeros((len(of), width), np.float32)
        for k, x in enumerate(of.tolist()):
            out[k, column[begins[x] : begins[x + 1]]] = 1
        return out

    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        left = dense(own)
        shared = [left @ dense(np.arange(k, min(k + step, len(sets)))).T for k in range(0, len(sets), step)]
        yield own, np.concatenate(shared, axis=1)


def links_apart(words: np.ndarray, sets: list[np.ndarray], label: np.ndarray, keys: list[np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between clusters (label, changed here): of all pairs of different clusters that meet, those that are alike and that it takes to connect what they connect."""
    sizes = np.array([len(x) for x in sets], np.int64)
    a, b, many = pairs_apart(words, sizes, label, keys, segment)
    label = np.unique(label, return_index=True, return_inverse=True)
    label = label[1][label[2]]  # each cluster by its first member
    found: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        found.append((x, y))
        low, high = sorted((label[x], label[y]))
        label[label == high] = low

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if label[x] != label[y] and alike(sets[x], sets[y]):
            join(x, y)
    if len(many):
        own = [sets[k] for k in many.tolist()]
        size = sizes[many]
        of, n = np.unique(label[many], return_inverse=True, return_counts=True)[1:]
        few = np.flatnonzero(of != n.argmax())  # those of one largest cluster are met from the others' side
        for rows, shared in overlaps(own, few):
            fits = SIMILAR[1] * shared.astype(np.int64) >= SIMILAR[0] * (size[rows][:, None] + size[None] - shared.astype(np.int64))
            for x, y in zip(*np.nonzero(fits), strict=True):
                p, q = many[rows[x]], many[y]
                if label[p] != label[q]:
                    join(p, q)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _met(points: DataFrame, together: int) -> DataFrame:
    """points (node: distinct; size, w0, ...) to pairs (a, b) of nodes, repeats included: nearest_partners. With cluster: pairs_apart, and nodes of a crowd with b null. With cluster and shingles, packed: links_apart."""
    n_points = points.count()
    route, segment, bands = layout(n_points, together)
    sample = sampled_bits(route, segment, bands)
    clustered, second = ("cluster" in points.columns), ("shingles" in points.columns)
    names = ["node", "size", *(f"w{k}" for k in range(SIMILAR_WORDS)), *(["cluster"] if clustered else []), *(["shingles"] if second else [])]
    parts = ["nodes", "sizes", "words", "clusters", "shingles"]
    C.bound_batches(points.sparkSession)

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(f"w{k}").to_numpy().view(np.uint64) for k in range(SIMILAR_WORDS)], axis=1)

    def groups_of(band: int, bits: np.ndarray) -> np.ndarray:
        return _value(bits[:, sample[band, :route]]) | band << 48

    def large_groups() -> dict[int, int]:
        """Groups far beyond `together`, as masses of copies make them: a few, each with the number of its parts."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in C.slices(batches, 1 << 16):
                bits = _unpacked(words_of(batch))
                found = [np.unique(groups_of(band, bits), return_counts=True) for band in range(bands)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(2)], ["group", "n"])

        counts = points.select(*names[: 2 + SIMILAR_WORDS]).mapInArrow(count, "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
        return {row["group"]: -(-row["n"] // (4 * together)) for row in counts.filter(F.col("n") > 8 * together).collect()}

    shares = large_groups() if n_points > 8 * together else {}

    def dealt_to(batch: pa.RecordBatch, band: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members, their groups, their pairs of parts): a large group is cut into parts and each two of them meet, so none of its pairs is lost; -1 where a group is whole."""
        to = groups_of(band, bits)
        large = [g for g in shares if g >> 48 == band]
        which = np.flatnonzero(~np.isin(to, large))
        out = [(which, to[which], np.full(len(which), -1))]
        for group in large:
            n, members = shares[group], np.flatnonzero(to == group)
            scattered = batch.column("node").to_numpy()[members].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = (scattered >> np.uint64(33)).astype(np.int64) % n
            for other in range(n):
                met = members[own != other]
                low, high = np.minimum(own[own != other], other), np.maximum(own[own != other], other)
                out.append((met, np.full(len(met), group), low * n + high))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 512 if second else 4096):
            words = words_of(batch)
            bits = _unpacked(words)
            held = [batch.column("node").to_numpy(), batch.column("size").to_numpy().astype(np.int32), words, batch.column("cluster").to_numpy() if clustered else np.zeros(len(words), np.int64)]
            packed = batch.column("shingles").to_pylist() if second else []
            rows = []
            for band in range(bands):
                members, to, pair = dealt_to(batch, band, bits)
                order = np.lexsort((pair, to))
                begins = np.flatnonzero(np.concatenate([[True], (np.diff(to[order]) != 0) | (np.diff(pair[order]) != 0)])) if len(to) else []
                for at, end in zip(begins, [*begins[1:], len(to)], strict=False):
                    first, which = order[at], members[order[at:end]]
                    rows.append((int(to[first]), int(pair[first]), *(x[which].tobytes() for x in held), b"".join(packed[k] for k in which) if second else b""))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["group", "pair", *parts])
        C.release_memory()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        nodes, sizes, words, clusters, shingles = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in zip(parts, (np.int64, np.int32, np.uint64, np.int64, np.uint64), strict=True))
        words, sizes = words.reshape(-1, SIMILAR_WORDS), sizes.astype(np.int64)
        own, bits = sample[key[0].as_py() >> 48][route:], _unpacked(words)
        keys = [_value(bits[:, own[t * segment : (t + 1) * segment]]) for t in range(TABLES)]
        many = np.zeros(0, np.int64)
        if second:
            a, b = links_apart(words, np.split(shingles, np.cumsum(sizes)[:-1]), clusters, keys, segment)
        elif clustered:
            a, b, many = pairs_apart(words, sizes, clusters, keys, segment)
        else:
            a, b = nearest_partners(words, sizes, keys, segment)
        C.release_memory()
        alone = np.arange(len(a) + len(many)) >= len(a)
        return pa.table({"a": np.concatenate([nodes[a], nodes[many]]), "b": pa.array(np.concatenate([nodes[b], nodes[many]]), pa.int64(), mask=alone)})

    dealt = points.select(*names).mapInArrow(deal, "group long, pair long, " + ", ".join(f"{n} binary" for n in parts))
    return dealt.groupBy("group", "pair").applyInArrow(meet, "a long, b long")


#: Filter bits for each id, and log2 of a filter's bits at most (16 MB are broadcast).
BITS_PER_ID, MAX_ID_BITS = 16, 27


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A Bloom filter of ids (id): for a column of ids whether they may be among them; a full one lets more through, never less."""
    n = ids.count()
    bits = min(MAX_ID_BITS, max(10, math.ceil(math.log2(1 + n * BITS_PER_ID))))
    part = min(SLICE_BITS, bits)

    def spots(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = own.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return places(mixed * np.uint64(0xD6E8FEB86659FD93), bits)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(spots(batch.column("id").to_numpy())))
            own = np.split(found, np.flatnonzero(np.diff(found >> part)) + 1) if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(f[0] >> part) for f in own], pa.int32()), pa.array([f.tobytes() for f in own], pa.binary())], ["slice", "spots"])

    def merge(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << part, bool)
        own[np.frombuffer(b"".join(table.column("spots").to_pylist()), np.uint32) & np.uint32((1 << part) - 1)] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(1 << bits >> 3, np.uint8)
    for row in ids.select("id").mapInArrow(once, "slice int, spots binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").toLocalIterator():
        own = np.frombuffer(row["bits"], np.uint8)
        whole[(row["slice"] << part) >> 3 :][: len(own)] = own
    held = ids.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def may(own: pd.Series) -> pd.Series:
        first, second = (held.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in spots(own.to_numpy()))
        return pd.Series((first & second).astype(bool))

    return may


def texts_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, text) of wanted (node, first: the smallest id that has it); only these texts move, and few beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            own = [set_node(shingle_set(text, words)) for text in C.as_bytes(batch.column("text"))]
            yield batch.select(["node", "text"]).filter(pa.array(np.array(own, np.int64) == batch.column("node").to_numpy()))  # rows that share an id may differ
        C.release_memory()

    may = id_filter(wanted.select(F.col("first").alias("id")))
    met = _identified(docs).filter(may("id")).join(wanted.withColumnRenamed("first", "id"), "id").select("node", "text")
    return met.mapInArrow(run, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of pairs (a, b) whose texts are alike by their shingles. The text of a node in many pairs goes to several tasks, each with a part of them."""
    often = pairs.groupBy("a").agg((F.count("*") / F.lit(512)).cast("int").alias("most")).filter("most > 0").withColumnRenamed("a", "hub")
    most = F.coalesce("most", F.lit(0))
    left = texts.join(pairs.select("a").distinct(), texts["node"] == F.col("a"), "left_semi").join(often, F.col("node") == F.col("hub"), "left")
    left = left.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), most)).alias("salt"), F.col("text").alias("ta"))
    salted = pairs.join(often, pairs["a"] == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), most + 1).cast("int").alias("salt"))
    met = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 64):
            held: dict[int, np.ndarray] = {}  # of one slice only
            fits = []
            for a, b, ta, tb in zip(*(batch.column(n).to_pylist() for n in ("a", "b")), *(C.as_bytes(batch.column(n)) for n in ("ta", "tb")), strict=True):
                for node, text in ((a, ta), (b, tb)):
                    if node not in held:
                        held[node] = shingle_set(text, words)
                fits.append(alike(held[a], held[b]))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))
        C.release_memory()

    return met.mapInArrow(run, "a long, b long")


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts (node, text) to (node, shingles): the text's set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(text, words).tobytes() for text in C.as_bytes(batch.column("text"))], pa.binary())], ["node", "shingles"])
        C.release_memory()

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def similar_components(docs: DataFrame, words: int, scratch: C.Scratch) -> DataFrame:
    """(first, component): for each distinct set of shingles the smallest id that has it, and the smallest that is reachable over pairs that are alike.

    First each node is verified with the nearest candidates and hubs that it has, one of each for a group; that joins most of what
    belongs together. Then all candidates that are still apart are verified: pairs by their texts, and nodes of a crowd, whose pairs
    would be too many, where they meet once more with their sets, so that only links leave a group.
    """
    names = [f"w{k}" for k in range(SIMILAR_WORDS)]
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    n = docs.count()
    points = scratch.stored(set_prints(docs, words).groupBy("node", "size", *names).agg(F.min("id").alias("first")), "fingerprints", n)
    tried = scratch.stored(_met(points, TOGETHER).select(*ordered).distinct(), "tried", n)
    near = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.stored(points.join(near, "node").select("node", "first"), "wanted", n)
    texts = scratch.stored(texts_of(docs, wanted, words), "texts", 5 * n)
    clusters = components(verified(tried, texts, words), scratch)
    apart = scratch.stored(points.join(texts.select("node"), "node").join(clusters, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component", "first"), "apart", n)
    more = scratch.stored(_met(apart, TOGETHER).distinct(), "more", n)
    pairs = more.filter("b IS NOT NULL").select(*ordered).distinct().join(tried, ["a", "b"], "left_anti")
    links = clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(scratch.stored(pairs, "pairs", n), texts, words))
    crowd = more.filter("b IS NULL").select(F.col("a").alias("node")).distinct()
    if crowd.limit(1).count():
        held = apart.join(crowd, "node").join(with_sets(texts.join(crowd, "node", "left_semi"), words), "node")
        links = links.unionByName(_met(scratch.stored(held, "crowd", 5 * n), WITH_SETS))
    sets = points.select("node", "first").join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("component", "node"))
    return sets.join(sets.groupBy("root").agg(F.min("first").alias("smallest")), "root").select("first", F.col("smallest").alias("component"))


def near_unique(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text and any others) whose doc_id is the smallest of its group of near-duplicates. Rows that share a doc_id are one document."""
    scratch, n = C.Scratch(docs.sparkSession), docs.count()
    kept = scratch.stored(similar_components(docs, words, scratch).select(F.col("component").alias("id")).distinct(), "kept", n)
    id_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1))
    dropped = scratch.stored(docs.select(id_.alias("id")).distinct().join(kept, "id", "left_anti"), "dropped", n)
    may = id_filter(dropped)
    scratch.clear(keep=1)
    gone = dropped.withColumnRenamed("id", "__dropped")
    # what is surely kept doesn't move
    return docs.filter(~may(id_)).union(docs.filter(may(id_)).join(gone, id_ == F.col("__dropped"), "left_anti"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash_groups(C.table(spark, sf_dir, "documents"))
