"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Each document's ids, closed by an end id, go into sequences of at most `capacity` ids. Only longer documents are cut, into full
pieces but for the first. Pieces are dealt into blocks of bounded size by a hash of document and piece, and each block is
packed in one task: the longest pieces first, each in that open sequence with which the sum over residual gaps of the squared
number of open sequences with that gap becomes smallest (of equal choices: the smallest gap). A new sequence is opened only
where no open one has room: letting the rule open one too, as in its online form, costs 1.7 % more sequences on these lengths.

Null texts count as empty (one end id). Repeated rows are packed as often as they come. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

CAPACITY = 2048
#: Pieces that one task packs, about; each block may leave a part of one sequence empty.
BLOCK = 4096
#: Characters on which the libraries' notions of letters, digits and white space surely agree: Latin text with plain white space.
PLAIN = re.compile("[^\\t\\n\\r -~\u00a1-\u024f]")
SPECIAL = "<|endoftext|>"

_loaded: dict[str, tuple[object, object]] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _encoders(path: str) -> tuple[object, object]:
    """The tokenizers library's own encoder of the file, and tiktoken's of the vocabulary in it, which takes a fifth of the time."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): k for token, k in own.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in token)}
        ranks = {token: k for token, k in ranks.items() if token != SPECIAL.encode()}
        _loaded[path] = own, tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids that the tokenizers library gives each text, as little-endian unsigned 32-bit numbers."""
    own, fast = _encoders(path)
    out: list[bytes] = [b""] * len(texts)
    odd = []
    for k, text in enumerate(texts):
        if SPECIAL in text or PLAIN.search(text):
            odd.append(k)
        else:
            out[k] = fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    for k, encoded in zip(odd, own.encode_batch([texts[k] for k in odd], add_special_tokens=False), strict=True):
        out[k] = np.array(encoded.ids, "<u4").tobytes()
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence (from 0) and offset, for lengths in 1..capacity."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by gap; those of gap 0 are closed
    held: dict[int, list[int]] = defaultdict(list)
    opened = 0
    for i in order:
        size = int(lengths[i])
        rest = capacity - size
        gap = capacity
        if rest:
            now = count[size:capacity]  # by gap, from size on: how many are open; change: of the sum of squares, if one of them is taken
            change = 2 * (count[: capacity - size] - now) + 2
            change[0] = 1 - 2 * now[0]
            change[now == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if now[k]:
                gap = size + k
        if gap == capacity:
            sequence[i], opened = opened, opened + 1
        else:
            sequence[i] = held[gap].pop()
            offset[i] = capacity - gap
            count[gap] -= 1
        if gap > size:
            held[gap - size].append(int(sequence[i]))
            count[gap - size] += 1
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            rows = []
            encoded = encode_ids(batch.column("text").to_pylist(), tokenizer_path)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += int(end_id).to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), own)[: len(names)])
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    C.bound_batches(docs.sparkSession)
    return C.texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """cut_pieces (doc_id, piece, start, length, ...) with sequence_id and offset. The rows are stored in the shared folder first: they are read twice."""
    kept = C.stored(cut_pieces, "pieces")
    blocks = max(1, -(-kept.count() // block))

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([(name, "ascending") for name in ("doc_id", "piece", "start", "ids_crc32")])
        sequence, offset = sum_of_squares(own.column("length").to_numpy(), capacity)
        first = own.column("block")[0].as_py() << 32 if own.num_rows else 0
        return own.drop_columns(["block"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    schema = kept.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the filled sequences of a packing that has kept its ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, with_ids=with_ids), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
