"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and each run of white space becomes one space. An item of m characters may be met with up to
floor(rate * m) errors (insertions, deletions, substitutions of a character). It is split into one piece more than that, so at least one
piece stands unchanged in every such passage. An Aho-Corasick automaton finds all pieces in one pass over a text; around each
hit a count of the item's q-grams, which loses none, drops most, and Myers' bit-parallel distance decides.

Items go to the workers in blocks of bounded size, with one pass over the documents for each. Null or empty items never match;
null texts count as empty; repeated items and rows are matched as often as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

RATE = 0.1
#: Items, and their characters, that go to the workers at once.
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 4_000_000
GRAM = 4


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces, nearly equal in length."""
    n = len(item)
    cuts = [n * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(least distance of the pattern to a substring of text, where that ends), if within the budget. pattern: for each character the bits of its places among m."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best = None
    get = pattern.get
    for k, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph <<= 1
        plus = ((mh << 1) | ~(xv | ph)) & mask
        minus = ph & xv & mask
        if score <= budget and (best is None or score < best[0]):
            best = score, k + 1
    return best


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        """items: (any id, text)."""
        self.items = [(own, item) for own, item in ((own, normalised(text or "")) for own, text in items) if item]
        self.budgets = [int(rate * len(item)) for _, item in self.items]
        self.patterns: list[dict[str, int]] = []
        self.grams: list[list[str]] = []  # side by side, so an error changes one at most
        found: dict[str, list[tuple[int, int]]] = {}
        for k, ((_, item), budget) in enumerate(zip(self.items, self.budgets, strict=True)):
            bits: dict[str, int] = {}
            for at, c in enumerate(item):
                bits[c] = bits.get(c, 0) | 1 << at
            self.patterns.append(bits)
            self.grams.append([item[a : a + GRAM] for a in range(0, len(item) - GRAM + 1, GRAM)])
            for offset, piece in pieces(item, budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in found.items():
            self.automaton.add_word(piece, (len(piece), own))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """By item number, the least distance within its budget and where such a passage ends in the normalised text."""
        if not self.items:
            return {}
        whole = normalised(text)
        reached: dict[int, list[list[int]]] = {}
        for end, (length, own) in self.automaton.iter(whole):
            for k, offset in own:
                budget, m = self.budgets[k], len(self.items[k][1])
                start = end + 1 - length - offset
                span = max(0, start - budget), min(len(whole), start + m + budget)
                spans = reached.setdefault(k, [])
                if spans and span[0] <= spans[-1][1] and spans[-1][0] <= span[1] and span[1] - spans[-1][0] <= 3 * m:
                    spans[-1] = [min(span[0], spans[-1][0]), max(span[1], spans[-1][1])]
                else:
                    spans.append(list(span))
        out: dict[int, tuple[int, int]] = {}
        for k, spans in reached.items():
            budget, m, grams = self.budgets[k], len(self.items[k][1]), self.grams[k]
            least = len(grams) - budget
            for a, b in spans:
                part = whole[a:b]
                if least > 0 and sum(gram in part for gram in grams) < least:
                    continue
                met = myers(self.patterns[k], m, part, budget)
                if met and (k not in out or met[0] < out[k][0]):
                    out[k] = met[0], a + met[1]
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in lists of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("text is not null").toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(row["text"]) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


_matchers: dict[tuple[int, float], Matcher] = {}


def _matcher(block: list[tuple[int, str]], rate: float) -> Matcher:
    key = hash(tuple(block)), rate
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(block, rate)
    return _matchers[key]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, n_errors, n_allowed, ends_at: one row for each row of docs and item that it holds. docs (doc_id, text), items (item_id, text)."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    schema = "doc_id long, item_id long, n_errors int, n_allowed int, ends_at long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in C.slices(batches):
                rows = [
                    (doc_id, matcher.items[k][0], errors, matcher.budgets[k], end)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for k, (errors, end) in sorted(matcher.find(text).items())
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_errors", "n_allowed", "ends_at"])

        out = out.unionByName(C.texts(docs).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item; all columns pass through."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    names = docs.columns
    out = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = out.schema
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in C.slices(batches):
                yield batch.filter(pa.array([not matcher.find(text) for text in batch.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of benchmark against all documents."""
    return matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
