"""Scoring by a log-bilinear neural language model (Mnih & Hinton 2007), trained in numpy with noise-contrastive estimation.

Tokens are words of A-Z-lower-cased text, split at ASCII white space, and one end for each text. The most frequent tokens are
classes of their own; the others fall into classes by their last two bytes. The model predicts a token's class from the two
classes before it: score(c | a, b) = (C1 r_a + C2 r_b) . e_c + bias_c. As the score is a sum over the two places, the
normalisers of all contexts come from one matrix product, worked out in blocks; other scores come from the vectors. Within a class of rare tokens, a token has its smoothed share
of the class, so probabilities add up to one over all known tokens and, for each such class, one unknown one.

Token counts cover all texts that are learned from and stay distributed: workers hold the HEAD most frequent tokens (a fixed
number); the counts of all others come by a join. The network is trained over all whole texts on the executors: from the same start
each task goes over its rows, and their weights are averaged; first for one in WARM of the documents, then, from there, for the rest.

Null texts count as empty: one token, the end. Rows repeat as they come; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Tokens whose counts every worker holds; of these, tokens with a class of their own; classes of endings; distinct tokens that a worker counts before it hands them on.
HEAD, WORDS, ENDINGS, FLUSH = 1 << 17, 2500, 500, 100_000
SIZE, NOISE, RATE = 32, 64, 0.2
#: Tokens of a step, in a task's first piece and later.
EARLY, BATCH = 256, 1024
#: The share of documents in the first pass; tokens that are shuffled together; tasks' weights that are averaged at once.
WARM, PIECE, FAN = 8, 1 << 17, 32
#: Tokens that are scored at once.
BLOCK = 1 << 12
#: No word is empty, so this stands for the end of a text.
END = b""


@dataclass
class Model:
    """Head tokens with their counts' logarithms and classes, and what normalised scores need."""

    tokens: list[bytes]
    log_counts: np.ndarray  # log10(count + 0.5)
    classes: np.ndarray
    own: int  # classes that are one token each; the others are of endings
    endings: dict[bytes, int]
    log_class: np.ndarray  # by class: log10 of the smoothed size of what shares it; 0 for one token
    first: np.ndarray  # a class's vector as the one before the token
    second: np.ndarray  # as the one before that
    target: np.ndarray  # as the token's, its bias last
    log_z: np.ndarray  # natural logarithm of the normaliser by the class before and the one before that
    train_tokens: int
    distinct: int

    @property
    def start(self) -> int:
        return len(self.first) - 1

    def log_probability(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Natural logarithms, of classes after a, which come after b."""
        e, context = self.target.take(classes, 0), self.first.take(a, 0)
        context += self.second.take(b, 0)
        return np.einsum("ij,ij->i", context, e[:, :-1]) + e[:, -1] - self.log_z[a, b]


def words(text: bytes) -> list[bytes]:
    return text.translate(C.ASCII_LOWER).split()


def words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What `words` gives for each text, one after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, sizes = split.flatten().cast(pa.binary()), split.value_lengths().to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty strings, as does an empty text
    own = np.add.reduceat(full, np.cumsum(sizes) - sizes, dtype=np.int64)
    return (flat if full.all() else flat.filter(pa.array(full))), own


class Vocabulary:
    """Finds whole batches of words among tokens, and the classes of the others by their endings."""

    def __init__(self, tokens: list[bytes], endings: dict[bytes, int], own: int) -> None:
        self.tokens = pa.array(tokens, pa.binary())
        self.end = tokens.index(END) if END in tokens else -1
        self.one, self.two = np.full(1 << 8, own), np.full(1 << 16, own)
        for ending, c in endings.items():
            if ending:  # only the end has none
                (self.one if len(ending) == 1 else self.two)[int.from_bytes(ending)] = c

    def places(self, tokens: pa.Array) -> np.ndarray:
        """Each token's place, -1 for those that are not among them."""
        return pc.index_in(tokens, value_set=self.tokens).fill_null(-1).to_numpy()

    def classes_of(self, tokens: pa.Array) -> np.ndarray:
        """What `class_of` gives for each token (none is empty)."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        _, offsets, data = tokens.buffers()
        ends = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
        held, last = np.frombuffer(data, np.uint8), ends[1:] - 1
        low = held[last].astype(np.int64)
        return np.where(np.diff(ends) > 1, self.two[held[last - 1].astype(np.int64) << 8 | low], self.one[low])


def located(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of batches (text), the words of each, how many each text has, and their places. Places are looked up for more texts at once, as each look-up hashes all tokens."""
    for batch in C.slices(batches, 1024):
        found, sizes = words_of_all(batch.column("text"))
        places, begins = vocabulary.places(found), np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, batch.num_rows, 256):
            begin, own = int(begins[at]), sizes[at : at + 256]
            yield batch.slice(at, 256), found.slice(begin, int(own.sum())), own, places[begin : begin + own.sum()]


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of texts of these sizes, each text's followed by end; and where each text's ends lie."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(values) + len(sizes), end, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = values
    return out, ends


def token_counts(docs: DataFrame) -> DataFrame:
    """docs (text) to (token binary, n long), the end included; each worker adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])
                counts.clear()

        for batch in C.slices(batches, 128):
            for text in C.as_bytes(batch.column("text")):
                counts.update(words(text))
                counts[END] += 1
            if len(counts) > FLUSH:
                yield from out()
        yield from out()
        C.release_memory()

    return C.texts(docs).select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


Network = dict[str, np.ndarray]


def new_network(shares: np.ndarray, seed: int = 0) -> tuple[Network, Network]:
    """Weights, and the sums of squared gradients that set their rates."""
    n, random = len(shares), np.random.default_rng(seed)
    p = {"r": random.normal(0, 0.1, (n + 1, SIZE)), "e": random.normal(0, 0.1, (n, SIZE)), "c": np.ones((2, SIZE)), "b": np.log(_noise(shares))}
    p = {k: v.astype(np.float32) for k, v in p.items()}  # the driver's memory is small
    return p, {k: np.full_like(v, 1e-3) for k, v in p.items()}


def _noise(shares: np.ndarray) -> np.ndarray:
    noise = np.maximum(shares, 1e-9)
    return noise / noise.sum()


def learn(p: Network, seen: Network, sequences: list[np.ndarray], shares: np.ndarray, random: np.random.Generator, batch: int = BATCH) -> None:
    """One pass over the classes of texts, in place. shares: the noise, each class's share of tokens."""
    n, start = len(shares), len(shares)
    own = [np.concatenate([[start, start], s]) for s in sequences]
    triples = np.concatenate([np.stack([s[1:-1], s[:-2], s[2:]]) for s in own], axis=1) if own else np.zeros((3, 0), np.int64)
    noise = _noise(shares)
    log_noise = np.log(noise * NOISE).astype(np.float32)
    triples = triples[:, random.permutation(triples.shape[1])]
    steps = range(0, triples.shape[1], batch)
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), random.random((len(steps), NOISE))), n - 1)
    r, e, c, bias = p["r"], p["e"], p["c"], p["b"]
    for at, false in zip(steps, drawn, strict=True):
        a, b, target = triples[:, at : at + batch]
        m = len(a)
        ra, rb, et, ef = r.take(a, 0), r.take(b, 0), e.take(target, 0), e.take(false, 0)
        q = ra * c[0]
        q += rb * c[1]
        dt = _sigmoid(np.einsum("ij,ij->i", q, et) + bias[target] - log_noise[target]) - 1
        df = q @ ef.T
        df += bias[false] - log_noise[false]
        df = _sigmoid(df)
        dq = df @ ef
        et *= dt[:, None]
        dq += et
        by_place, by_class = np.empty((2 * m, SIZE), np.float32), np.empty((m + NOISE, SIZE), np.float32)
        np.multiply(dq, c[0], out=by_place[:m])
        np.multiply(dq, c[1], out=by_place[m:])
        np.multiply(dt[:, None], q, out=by_class[:m])
        np.matmul(df.T, q, out=by_class[m:])
        # rows that no token touches have no gradient, so only the others move
        _step(r, seen["r"], *_sums(np.concatenate([a, b]), by_place), m, RATE)
        both = np.concatenate([target, false])
        touched, sums = _sums(both, by_class)
        _step(e, seen["e"], touched, sums, m, RATE)
        _step(bias, seen["b"], touched, np.bincount(both, np.concatenate([dt, df.sum(axis=0)]), n)[touched], m, RATE * 0.1)
        _step(c, seen["c"], np.arange(2), np.stack([np.einsum("ij,ij->j", dq, ra), np.einsum("ij,ij->j", dq, rb)]), m, RATE)


def _step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, m: int, rate: float) -> None:
    """A step against the mean gradient of m tokens, in place."""
    g = (gradient / m).astype(np.float32, copy=False)
    own = g * g
    own += seen.take(rows, 0)
    seen[rows] = own
    g *= rate
    g /= np.sqrt(own, out=own)
    weights[rows] = np.subtract(weights.take(rows, 0), g, out=g)


def learn_everywhere(docs: DataFrame, p: Network, seen: Network, shares: np.ndarray, place: dict[bytes, int], endings: dict[bytes, int], own: int) -> tuple[Network, Network, int]:
    """The network after one pass over all texts, and the tokens it saw. Each task goes on from the same weights over its rows; the mean of the tasks' weights, by tokens, is worked out on the executors, FAN at once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((p, seen, shares, place, endings, own))
    sizes = [v.size for v in p.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen, shares, place, endings, own = shared.value
        p, seen = ({k: v.copy() for k, v in x.items()} for x in (p, seen))
        vocabulary, numbers = Vocabulary(list(place), endings, own), np.array(list(place.values()))
        task = TaskContext.get().partitionId()
        random = np.random.default_rng(task)
        held, n, total = [], 0, 0
        for _, found, sizes, places in located(batches, vocabulary):
            classes, new = numbers[places], places < 0
            classes[new] = vocabulary.classes_of(found.filter(pa.array(new)))
            classes, ends = with_ends(classes, sizes, place[END])
            for text in np.split(classes, ends[:-1] + 1):
                held.append(text)
                n += len(text)
                if n > PIECE:
                    learn(p, seen, held, shares, random, BATCH if total else EARLY)
                    held, n, total = [], 0, total + n
        learn(p, seen, held, shares, random, BATCH if total else EARLY)
        total += n
        if total:
            weights = np.concatenate([v.ravel() for x in (p, seen) for v in x.values()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["part", "n", "weights"])
        C.release_memory()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        whole, mean = 0, 0.0
        for n, weights in zip(table.column("n").to_pylist(), table.column("weights"), strict=True):
            whole += n
            mean = mean + np.frombuffer(weights.as_py(), np.float32).astype(np.float64) * n
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [whole], "weights": pa.array([(mean / whole).astype(np.float32).tobytes()], pa.binary())})

    scratch = C.Scratch(spark)
    trained = scratch.stored(docs.select("text").mapInArrow(run, "part int, n long, weights binary"), "weights")
    while trained.count() > FAN:
        trained = scratch.stored(trained.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(add, "part int, n long, weights binary"), "weights")
    rows = sorted(trained.select((F.col("part") / 8).cast("int").alias("part"), "n", "weights").groupBy("part").applyInArrow(add, "part int, n long, weights binary").collect())  # FAN rows at most, of fixed size
    scratch.clear()
    total = sum(row["n"] for row in rows)
    if not total:
        return p, seen, 0
    mean = sum(np.frombuffer(row["weights"], np.float32).astype(np.float64) * row["n"] for row in rows) / total
    parts = [x.astype(np.float32) for x in np.split(mean, np.cumsum(sizes * 2)[:-1])]
    p, seen = ({k: part.reshape(v.shape) for (k, v), part in zip(x.items(), own, strict=True)} for x, own in ((p, parts[: len(sizes)]), (seen, parts[len(sizes) :])))
    return p, seen, total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sums of the rows that share one; two floats are added at once as the parts of a complex number."""
    order = np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")
    held = index[order]
    begins = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held[begins], np.add.reduceat(rows.take(order, 0).view(np.complex64), begins, axis=0).view(np.float32)


def normalisers(first: np.ndarray, second: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the sum over classes c of exp((first[a] + second[b]) . e_c + bias_c), for all a and b: a matrix product, in blocks of a."""
    e, bias = target[:, :-1], target[:, -1]
    by_b = second @ e.T
    low = by_b.max(axis=1, keepdims=True)
    by_b -= low
    np.exp(by_b, out=by_b)
    out = np.empty((len(first), len(second)), np.float32)
    for at in range(0, len(first), 256):
        by_a = first[at : at + 256] @ e.T + bias
        top = by_a.max(axis=1, keepdims=True)
        out[at : at + 256] = np.log(np.maximum(np.exp(by_a - top) @ by_b.T, 1e-30)) + top + low.T
    return out


def class_of(token: bytes, endings: dict[bytes, int], own: int) -> int:
    return endings.get(token[-2:], own)


def most_frequent(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """The tokens from a count on, as many as there are up to n; the count comes from a histogram by eighths of octaves, so nothing is sorted. At least the first such step is taken, by order."""
    step = F.floor(8 * F.log2("n"))
    histogram = sorted(((row["step"], row["count"]) for row in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, size in histogram:
        if total + size > n:
            break
        total, least = total + size, at
    chosen = counts.filter(step >= least) if least is not None else counts.orderBy(F.desc("n"), "token").limit(n)
    table = chosen.toArrow()
    pairs = zip(table.column("token").to_pylist(), table.column("n").to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """docs: those to learn from (doc_id, text). counts: their token_counts, stored."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = most_frequent(counts, HEAD)
    singles = head[:WORDS]
    if all(token != END for token, _ in singles):
        ends = [pair for pair in head if pair[0] == END] or [(END, 0)]
        singles = [*ends, *singles[: WORDS - 1]]
    own = len(singles)
    alone = {token for token, _ in singles}
    # sizes of the classes of endings, over all tokens but those that stand alone
    ending = F.expr("substring(token, greatest(length(token) - 1, 1), 2)")
    by_ending = counts.groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    sizes = [(bytes(row["ending"]), row["n"], row["v"]) for row in by_ending.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    taken = Counter()
    kinds = Counter()
    for token, n in singles:
        if n:
            taken[token[-2:]] += n
            kinds[token[-2:]] += 1
    endings = {e: own + 1 + k for k, (e, _, _) in enumerate(sizes)}
    mass, variety = np.zeros(own + 1 + len(sizes)), np.zeros(own + 1 + len(sizes))
    for k, (e, n, v) in enumerate(sizes):
        mass[own + 1 + k], variety[own + 1 + k] = n - taken[e], v - kinds[e]
    mass[own] = whole[0] - sum(n for _, n in singles) - mass[own + 1 :].sum()
    variety[own] = whole[1] - sum(1 for _, n in singles if n) - variety[own + 1 :].sum()
    for k, (_, n) in enumerate(singles):
        mass[k] = n
    log_class = np.log10(mass + 0.5 * (variety + 1))
    log_class[:own] = 0
    classes = np.array([0] * len(head))
    numbers = {token: k for k, (token, _) in enumerate(singles)}
    for k, (token, _) in enumerate(head):
        classes[k] = numbers[token] if token in alone else class_of(token, endings, own)
    tokens = [token for token, _ in head]
    place = {token: int(c) for token, c in zip(tokens, classes, strict=True)}
    place.setdefault(END, numbers[END])
    shares = (mass + 0.5) / (mass + 0.5).sum()
    p, seen = new_network(shares)
    texts = C.texts(docs)
    warm = F.pmod(F.xxhash64("doc_id"), F.lit(WARM)) == 0
    for part in (texts.filter(warm), texts.filter(~warm)):
        p, seen, _ = learn_everywhere(part, p, seen, shares, place, endings, own)
    first, second, target = p["r"] * p["c"][0], p["r"] * p["c"][1], np.concatenate([p["e"], p["b"][:, None]], axis=1)
    logs = np.log10(np.array([n for _, n in head]) + 0.5)
    return Model(tokens, logs, classes, own, endings, log_class, first, second, target, normalisers(first, second, target), int(whole[0]), int(whole[1]))


def scored_head(found: pa.Array, sizes: np.ndarray, places: np.ndarray, vocabulary: Vocabulary, model: Model) -> list[pa.Array]:
    """By text of these words, numbers of words and places: n_tokens; of head tokens: the sum of log10(count + 0.5) and how many; the model's log10 without the counts that are still to come; the other tokens and their numbers."""
    new = found.filter(pa.array(places < 0))
    places, ends = with_ends(places, sizes, vocabulary.end)
    starts, known = ends - sizes, places >= 0
    other = np.flatnonzero(~known)
    is_end = np.isin(other, ends)  # where the head lacks the end
    classes = np.zeros(len(places), np.int64)
    classes[known] = model.classes[places[known]]
    classes[other[~is_end]] = vocabulary.classes_of(new)
    held = np.zeros(len(places))
    held[known] = model.log_counts[places[known]]
    # each text begins after two starts
    a, b = np.full((2, len(classes)), model.start)
    a[1:], b[2:] = classes[:-1], classes[:-2]
    a[starts], b[starts] = model.start, model.start
    b[(starts + 1)[sizes > 0]] = model.start
    log_p = np.empty(len(classes))
    for at in range(0, len(classes), BLOCK):
        part = slice(at, at + BLOCK)
        log_p[part] = model.log_probability(classes[part], a[part], b[part])
    log_p /= math.log(10)
    shared = classes >= model.own
    log_p[shared] += held[shared] - model.log_class[classes[shared]]
    # the others, once a text
    kinds = pa.concat_arrays([new, pa.array([END], pa.binary())]).dictionary_encode()
    codes = np.full(len(other), kinds.indices[-1].as_py(), np.int64)
    codes[~is_end] = kinds.indices.to_numpy()[:-1]
    pairs, numbers = np.unique(np.searchsorted(ends, other) * len(kinds.dictionary) + codes, return_counts=True)
    rows, codes = np.divmod(pairs, len(kinds.dictionary))
    offsets = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32())
    return [
        pa.array(sizes + 1), pa.array(np.add.reduceat(held, starts)), pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(log_p, starts)),
        pa.ListArray.from_arrays(offsets, kinds.dictionary.take(pa.array(codes))), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int64())),
    ]


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text). learn: a condition on doc_id for the rows to learn from."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    everything = C.texts(docs)
    learned = everything.filter(learn)
    counts = C.stored(token_counts(learned), "counts")
    model = fit(learned, counts)
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "held", "n_held", "log_p", "tokens", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        model = shared.value
        vocabulary = Vocabulary(model.tokens, model.endings, model.own)
        for batch, *words in located(batches, vocabulary):
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), *scored_head(*words, vocabulary, model)], names)
        C.release_memory()

    part = C.stored(everything.mapInArrow(run, "row long, doc_id long, n_tokens long, held double, n_held long, log_p double, tokens array<binary>, numbers array<long>"), "scored")
    rare = part.select("row", F.explode(F.arrays_zip("tokens", "numbers")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.numbers").alias("k"))
    met = rare.join(counts, "token").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 0.5)).alias("log_n"))
    joined = part.drop("tokens", "numbers").join(met, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "log_n": F.coalesce("log_n", F.lit(0.0))})
    # a token that the counts lack has count 0
    unknown = F.col("n_tokens") - F.col("n_held") - F.col("more")
    extra = F.col("log_n") + unknown * F.lit(math.log10(0.5))
    whole = math.log10(model.train_tokens + 0.5 * (model.distinct + 1))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_held") + F.col("more")).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("held") + extra - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("log_p") + extra).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from those whose fold is not 1."""
    scored = score(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.fold(5) != 1)
    return scored.select("doc_id", (C.fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
