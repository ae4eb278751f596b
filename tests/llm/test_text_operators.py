"""Corpus operators on small fixtures, against brute force."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazeframe.llm import _common as C
from hazeframe.llm import decontamination, language_id, line_dedup, lm_scoring, packing, simhash, substring_dedup, token_counts, toxicity
from hazeframe.llm.components import components

ODD = ["", " ", "a", "Héllo  WÖRLD\n\nit's I'll \t x", "<|endoftext|> and <|startoftext|>", "日本語 テキスト é", "x" * 5000, "a\x1cb!\x1c!  y", " lead and tail \n"]
SCHEMA = "doc_id long, text string, n_lines string, toxicity int, row string, score string"


def frame(spark, texts, start=0):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(start + k, t, "x", 1, "r", "s") for k, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_text(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- token counts


def test_token_counts_follow_the_library_and_fill_the_cache(spark):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), C.fresh_path(spark, "t")
    texts = [*ODD, None, "Same text", "Same  text\n", "Same text"]
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), cache, path).collect()}
    library = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        assert got[k].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids), text
        assert got[k].n_bytes == len((text or "").encode())
    stored = spark.read.parquet(cache).count()
    assert stored == len({r.content_digest for r in got.values()}) < len(texts)
    again = token_counts.token_counts(frame(spark, ["Same text", "new one"]), cache, path).collect()
    assert len(again) == 2 and spark.read.parquet(cache).count() == stored + 1
    assert token_counts.token_counts(empty(spark), cache, path).count() == 0


def test_token_counts_limit_and_repeated_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_counts.token_counts(frame(spark, ["word " * 5, "word " * 6]).union(frame(spark, ["word " * 5])), C.fresh_path(spark, "t"), path, limit=5).collect()
    assert sorted((r.doc_id, r.over_limit) for r in rows) == [(0, False), (0, False), (1, True)]


# --- simhash


def brute_components(points, near):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def test_fingerprint_bits():
    def plain(text):
        w = [x for x in text.encode().translate(C.ASCII_LOWER).split()]
        h = [simhash.xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ["", "one", "A b C d E f", "a a a a a a a", "é È x y z w v"]:
        assert int(simhash.fingerprint(simhash.shingle_hashes(text.encode()))[0]) == plain(text)


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(1)
    base = [words_text(rng, 300, 5000).split() for _ in range(12)]
    texts = [None, "", "single"]
    for words in base:
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "changed%d" % rng.randrange(99)
            texts.append(" ".join(own))
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    prints = [int(got[k].fingerprint, 16) for k in range(len(texts))]
    assert prints[0] == prints[1] == 0
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [got[k].component_id for k in range(len(texts))] == want
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("small", [256, 2])
def test_spanning_links_connect_what_all_links_connect(small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(3)
    words = np.unique(np.concatenate([b ^ np.array([1 << int(k) for k in rng.integers(0, 64, 30)], np.uint64) ^ np.array([1 << int(k) for k in rng.integers(0, 64, 30)], np.uint64) for b in rng.integers(0, 2**63, 8).astype(np.uint64)]))[:, None]
    cut, balls = simhash.segments(3), (1, 0, 0)
    parts = [((words[:, 0] >> np.uint64(low) & np.uint64((1 << w) - 1))[:, None] ^ simhash.ball(w, b)[None] | np.uint64(k << 40)) for k, ((low, w), b) in enumerate(zip(cut, balls, strict=True))]
    keys = np.concatenate([p.ravel() for p in parts])
    which = np.concatenate([np.repeat(np.arange(len(words)), p.shape[1]) for p in parts])
    a, b = simhash.spanning_links(keys, which, words[which], 4)
    label = np.arange(len(words))
    simhash._merge(label, a, b)
    assert label.tolist() == brute_components([int(w) for w in words[:, 0]], lambda x, y: (x ^ y).bit_count() <= 4)
    assert len(a) == len(words) - len(set(label.tolist()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_near_unique_is_exact_at_the_threshold(spark):
    random, texts = np.random.default_rng(5), []
    for k in range(150):
        base = [f"w{x}" for x in random.integers(0, 10**6, 200)]  # 196 shingles
        new = [20, 21, 22, 23, 26, 30][k % 6]  # at one end: similarity (196 - new) / (196 + new), 0.815 to 0.734
        texts += [" ".join(base), " ".join([*base[new:], *(f"v{x}" for x in random.integers(0, 10**6, new))])]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    want = {k for k in range(len(texts)) if k % 2 == 0 or 5 * (n := len(np.intersect1d(sets[k - 1], sets[k]))) < 4 * (len(sets[k - 1]) + len(sets[k]) - n)}
    assert 200 < len(want) < 260
    got = {r.doc_id for r in simhash.near_unique(frame(spark, texts)).collect()}
    assert got == want


@pytest.mark.parametrize("crowd, partners, together", [(2048, 64, 1 << 15), (1, 0, 1 << 15), (2048, 0, 16), (2, 64, 16)])
def test_near_unique_verifies_what_the_first_round_left_apart(spark, monkeypatch, crowd, partners, together):
    base = [f"w{x}" for x in np.random.default_rng(6).integers(0, 10**6, 300)]
    texts = [" ".join([*base[k * 12 :], *(f"v{x}" for x in range(k * 12))]) for k in range(8)]  # neighbours are alike, the ends are not
    for name, value in (("CROWD", crowd), ("PARTNERS", partners), ("TOGETHER", together), ("WITH_SETS", together)):
        monkeypatch.setattr(simhash, name, value)
    assert [r.doc_id for r in simhash.near_unique(frame(spark, texts)).collect()] == [0]


@pytest.mark.parametrize("crowd", [2048, 8])
def test_near_copies_of_one_source_are_found_though_not_alike_to_each_other(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 204)]  # 200 shingles; 20 of them go: 180 / 220 is alike, 160 / 240 is not
    copies = []
    for k in range(60):
        at = 3 * k
        copies.append(" ".join([*base[:at], *(f"c{k}_{x}" for x in range(16)), *base[at + 16 :]]))
    got = {r.doc_id for r in simhash.near_unique(frame(spark, [" ".join(base), *copies, "another text of six words here"])).collect()}
    assert got == {0, 61}


@pytest.mark.parametrize("crowd, partners", [(2048, 64), (2048, 0), (4, 64)])
def test_links_apart_connect_what_is_alike(monkeypatch, crowd, partners):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PARTNERS", partners)
    rng = random.Random(8)
    common = [f"k{x}" for x in range(60)]
    sets = [simhash.shingle_set(" ".join([*common, *(f"r{rng.randrange(40)}" for _ in range(rng.randint(0, 16)))]).encode()) for _ in range(60)]
    words = np.stack([simhash.set_fingerprint(x) for x in sets])
    keys = [np.zeros(60, np.int64)]  # all meet
    cluster = np.arange(60) % 50
    monkeypatch.setattr(simhash, "SIMILAR_RADIUS", 192)
    a, b = simhash.links_apart(words, sets, cluster.copy(), keys, 6)
    assert all(simhash.alike(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    every = [(x, y) for x in range(60) for y in range(x) if simhash.alike(sets[x], sets[y])] + [(x, x - 50) for x in range(50, 60)]
    want = brute_components(list(range(60)), lambda x, y: (max(x, y), min(x, y)) in set(every))
    assert len(set(want)) > 1
    groups = {tuple(np.flatnonzero(np.array(want) == k)) for k in set(want)}
    assert all(len({int(x) for x in _closure(60, list(zip(a.tolist(), b.tolist(), strict=True)) + [(x, x - 50) for x in range(50, 60)])[list(g)]}) == 1 for g in groups)


def _closure(n, links):
    label = np.arange(n)
    for _ in range(n):
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    return label


def test_matches_are_all_pairs_within_one_bit():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 64, 300)
    got = [(min(x, y), max(x, y)) for a, b, crowd in simhash._matches(key, 6) for x, y in zip(a.tolist(), b.tolist(), strict=True) if not crowd]
    want = {(x, y) for x in range(300) for y in range(x + 1, 300) if (int(key[x]) ^ int(key[y])).bit_count() <= 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_balls_miss_no_pair_and_one_is_a_ball():
    for radius in (1, 2, 4, 6):
        for n in (0, 10**3, 10**6, 10**9, 10**12):
            balls = simhash.balls_for(n, radius)
            assert simhash.finds(balls) >= radius and max(balls) >= 1


def test_layout_keeps_groups_small_and_pairs_met():
    for n in (0, 1, 50, 10**5, 10**8, 10**11):
        for together in (simhash.TOGETHER, simhash.WITH_SETS):
            route, segment, bands = simhash.layout(n, together)
            assert route + simhash.TABLES * segment <= 64 * simhash.SIMILAR_WORDS and n / 2**route <= together


def test_masses_of_copies_are_parted(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 8)
    monkeypatch.setattr(simhash, "WITH_SETS", 8)
    base = [f"w{x}" for x in np.random.default_rng(4).integers(0, 10**6, 2000)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 1800, 9)]  # 200 near copies, alike to each other
    assert [r.doc_id for r in simhash.near_unique(frame(spark, texts)).collect()] == [0]


def test_near_unique_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    base = [words_text(rng, 400, 5000) for _ in range(4)]
    near = [t.replace("w1", "x1", 3) for t in base]
    got = {r.doc_id for r in simhash.near_unique(frame(spark, [*base, *near, base[0], "clean text of its own"])).collect()}
    assert got == {0, 1, 2, 3, 9}


# --- substring dedup


def brute_removal(docs, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    word = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(word) for _ in range(n))
    shared = [make(40) for _ in range(5)]
    texts = [None, "", "a" * 350, "ab " * 120, shared[0], shared[0], "x" + shared[0], shared[0][:120], shared[0] * 2, "a" * 100, "a" * 99]
    texts += [make(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 60) :] + make(rng.randint(0, 30)) + rng.choice([*shared, ""])[: rng.randint(90, 200)] for _ in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_removal(list(enumerate(texts)))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hazeframe_units")]


def test_units_are_one_for_each_text_whatever_the_key(spark):
    texts = [None, "", *(f"text {k % 300}" for k in range(900))]
    for bits in (60, 8):  # 8 bits clash for sure
        rows = substring_dedup._keyed(C.texts(frame(spark, texts)), bits).collect()
        assert len({(r.unit, r.text) for r in rows}) == len({r.unit for r in rows}) == 301


def test_refined_buckets_hold_equal_suffixes():
    rng = random.Random(6)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=400)), np.uint8)
    for length in (8, 12, 16, 20, 40):
        at = np.arange(len(data) - length + 1)
        ids = substring_dedup.refine(data, at, length)
        own = [data[k : k + length].tobytes() for k in at]
        assert len(set(ids.tolist())) == len(set(own)) == len(set(zip(ids.tolist(), own, strict=True)))


# --- line dedup


def brute_lines(docs):
    key = lambda line: line.translate({k: k + 32 for k in range(65, 91)}).strip(" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(held.get(key(line), ())) > 1 and doc_id > min(held[key(line)]))]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("bits", [28, 6])
def test_line_dedup_matches_brute_force_whatever_the_filter(spark, bits):
    rng = random.Random(7)
    pool = ["short", "ÄÖÜäöüßéèç", "  Ten chars!! ", "ten CHARS!!", "éééééééé", "a line that repeats a lot", "\ta line that repeats a lot\r", ""]
    texts = [None, "", *("\n".join(rng.choice([*pool, words_text(rng, 5)]) for _ in range(rng.randint(1, 8))) for _ in range(40))]
    df = frame(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.line_dedup(df, filter_bits=bits).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert line_dedup.line_dedup(df, filter_bits=bits).columns == ["doc_id", "text", "toxicity", "row", "score", "n_lines", "n_dropped"]
    assert line_dedup.line_dedup(empty(spark), filter_bits=bits).count() == 0


# --- decontamination


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != x)))
        before = now
    return min(before)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.25])
def test_matcher_finds_all_within_the_budget(rate):
    rng = random.Random(8)
    for _ in range(60):
        item = "".join(rng.choices("ab c", k=rng.randint(1, 40)))
        text = "".join(rng.choices("ab c", k=rng.randint(0, 60)))
        if rng.random() < 0.7:
            noisy = list(item)
            for _ in range(rng.randint(0, 5)):
                noisy[rng.randrange(len(noisy))] = rng.choice(["", "a", "b", "xy"])
            text = text[:20] + "".join(noisy) + text[20:]
        own = decontamination.normalised(item)
        if not own:
            continue
        want = brute_distance(own, decontamination.normalised(text))
        got = decontamination.Matcher([(1, item)], rate).find(text).get(0)
        assert (got[0] if got else None) == (want if want <= int(rate * len(own)) else None)


def test_decontamination_rows_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "pack my box with five dozen liquor jugs")], "item_id long, text string")
    texts = [None, "", "nothing here", "so THE quick  brown fox\njumps ovr the lazy dog!", "pack my box with five dozen liquor jugs and the quick brown fox jumps over the lazy dog"]
    docs = frame(spark, texts)
    for most in (10_000, 1):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", most)
        got = sorted((r.doc_id, r.item_id, r.n_errors) for r in decontamination.matches(docs, items).collect())
        assert got == [(3, 1, 1), (4, 1, 0), (4, 4, 0)]
        kept = decontamination.decontaminate(docs, items)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert decontamination.matches(docs, items.limit(0)).count() == 0 and decontamination.decontaminate(empty(spark), items).count() == 0


# --- packing


def test_ids_follow_the_library():
    rng = random.Random(9)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *("".join(rng.choices(" \n\t'sab.,é1<|  Zß0ñ", k=60)) for _ in range(300))]
    for text, ids in zip(texts, packing.encode_ids(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_places_every_id_once(spark):
    rng = random.Random(10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", *(words_text(rng, rng.randint(0, 80)) for _ in range(40))]
    rows = packing.pack_documents(frame(spark, texts), path, capacity=64, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    own, used = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        used[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids)
    for k, text in enumerate(texts):
        parts = sorted(own[k])
        assert np.frombuffer(b"".join(p[3] for p in parts), "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [p[0] for p in parts] == list(range(len(parts))) and all(p[2] == 64 for p in parts[1:])
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(used) <= math.ceil(total / 64) * 1.1 + 1
    large = 2**60 + 1
    ids = spark.createDataFrame([(None, "a"), (large, "b"), (large, "b")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in packing.pack_documents(ids, path).collect()) == [0, large, large]
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_sum_of_squares_choice_is_the_best_open_one():
    lengths = np.random.default_rng(4).integers(1, 50, 400)
    sequence, offset = packing.sum_of_squares(lengths, 50)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        size, s = int(lengths[i]), int(sequence[i])
        count = Counter(g for g in gaps.values() if g)
        fits = sorted({g for g in gaps.values() if g >= size})
        squares = lambda c: sum(n * n for g, n in c.items() if g)
        if fits:
            best = min(fits, key=lambda g: (squares(count - Counter([g]) + Counter([g - size])), g))
            assert s in gaps and gaps[s] == best
        else:
            assert s not in gaps
        gaps[s] = gaps.get(s, 50) - size
        assert offset[i] == 50 - gaps[s] - size


# --- models


def labelled(rng, n, bad):
    base = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = [rng.choice(base) + rng.choice(base) for _ in range(n)]
    for _ in range(bad):
        text.insert(rng.randrange(len(text)), rng.choice(["wretched", "vermin", "lowlife"]))
    return " ".join(text)


def test_toxicity_learns_and_scores_held_out_documents(spark):
    rng = random.Random(11)
    texts = [labelled(rng, 60, 4 if k % 3 == 0 else 0) for k in range(400)]
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(400)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, C.fold(4) != 2)
    rows = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((rows[k] >= 0.3) == (k % 3 == 0) for k in held) >= 0.95 * len(held)
    assert rows[400] == rows[401] < 0.3
    assert toxicity.toxicity(docs, model).columns == ["doc_id", "text", "n_lines", "row", "score", "toxicity"]
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(b"any", none) == 0.0
    assert toxicity.toxicity(empty(spark), model).count() == 0


def test_languages_and_mixtures(spark):
    rng = random.Random(12)
    syllables = {"aa": ["the", "ing", "and", "wh"], "bb": ["sch", "ung", "der", "keit"], "cc": ["que", "les", "eau", "oir"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (903, make("aa", 50) + " " + make("bb", 50), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, C.fold(4) != 2)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:120])
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[902].score == 0
    mixed = {x.lang: x.share for x in got[903].languages}
    assert set(mixed) == {"aa", "bb"} and all(0.3 < share < 0.7 for share in mixed.values())
    nothing = language_id.identify(docs, language_id.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


@pytest.mark.parametrize("fan", [32, 2])
def test_lm_learns_word_order_from_all_texts(spark, monkeypatch, fan):
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    rng, seen = random.Random(3), []
    monkeypatch.setattr(lm_scoring, "learn_everywhere", lambda *a, f=lm_scoring.learn_everywhere: seen.append(f(*a)) or seen[-1])
    follow = {f"w{k}": f"w{(7 * k + 3) % 20}" for k in range(20)}
    texts = []
    for size in [100] * 150 + [9000] * 4:
        own = [f"w{rng.randrange(20)}"]
        while len(own) < size:
            own.append(follow[own[-1]] if rng.random() < 0.9 else f"w{rng.randrange(20)}")
        texts.append(" ".join(own))
    df = frame(spark, texts)
    model = lm_scoring.fit(df, C.stored(lm_scoring.token_counts(df), "c"))
    assert sum(x[2] for x in seen) == sum(len(t.split()) + 1 for t in texts)
    place = dict(zip(model.tokens, model.classes.tolist(), strict=True))
    for a, b in follow.items():
        a, b = place[a.encode()], place[b.encode()]
        scores = [model.log_probability(np.array([b]), np.array([a]), np.array([c]))[0] for c in (place[x.encode()] for x in follow)]
        assert np.exp(np.median(scores)) > 0.15  # 0.05 by counts alone


def test_lm_scores_are_normalised_and_counts_exact(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 30)
    monkeypatch.setattr(lm_scoring, "WORDS", 10)
    monkeypatch.setattr(lm_scoring, "ENDINGS", 5)
    rng = random.Random(13)
    texts = [None, "", *(" ".join(f"{rng.choice('abc')}{rng.choice(['x', 'yy', 'z'])}{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(1, 60))) for _ in range(60))]
    tokens = [[*(t or "").encode().translate(C.ASCII_LOWER).split(), b""] for t in texts]
    learned = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = Counter(w for k in learned for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, texts), C.fold(5) != 1).collect()}
    for k, own in enumerate(tokens):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert got[k].base_score == pytest.approx(base, abs=1e-9 * len(own) + 1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
    df = frame(spark, texts).filter(C.fold(5) != 1)
    model = lm_scoring.fit(df, C.stored(lm_scoring.token_counts(df), "c"))
    for a, b in ((model.start, model.start), (0, 3), (5, 1)):
        every = np.arange(len(model.target))
        p = np.exp(model.log_probability(every, np.full(len(every), a), np.full(len(every), b)).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-4)
        within = defaultdict(float)  # shares of a class's tokens, with one unknown
        for w, c in counts.items():
            place = dict(zip(model.tokens, model.classes, strict=True))
            k = int(place.get(w, lm_scoring.class_of(w, model.endings, model.own)))
            within[k] += 1.0 if k < model.own else (c + 0.5) / 10 ** model.log_class[k]
        for k, share in within.items():
            assert share + (0 if k < model.own else 0.5 / 10 ** model.log_class[k]) == pytest.approx(1, abs=1e-9)
    assert lm_scoring.score(empty(spark), F.lit(True)).count() == 0


@pytest.mark.parametrize("with_end", [True, False])
def test_lm_scores_whole_batches_as_word_by_word(spark, with_end):
    """op8's CPU budget: words are found, classed and scored by batches, with the results of plain loops."""
    rng = random.Random(19)
    texts = [*ODD, None, "\x0b\x0c", *(" ".join(rng.choice(["a", "b", "ab", "É", "c\x1cd", "xyz", f"n{rng.randrange(30)}"]) for _ in range(rng.randint(1, 40))) for _ in range(1200))]
    df = frame(spark, texts[:900])
    model = lm_scoring.fit(df, C.stored(lm_scoring.token_counts(df), "c"))
    model = dataclasses.replace(model, own=4, endings={b"n1": 5, b"b": 6, "É".encode(): 7}, log_class=np.arange(9) / 10)
    head = [k for k, t in enumerate(model.tokens) if t[:1] not in (b"b", b"x", b"\xc3") and (with_end or t)]
    model.tokens, model.log_counts, model.classes = [model.tokens[k] for k in head], model.log_counts[head], np.array([k % 9 for k in range(len(head))])
    place = {t: k for k, t in enumerate(model.tokens)}
    vocabulary = lm_scoring.Vocabulary(model.tokens, model.endings, model.own)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]
    found = lm_scoring.located(batches, vocabulary)
    got = [row for _, *words in found for row in zip(*(column.to_pylist() for column in lm_scoring.scored_head(*words, vocabulary, model)), strict=True)]
    assert len(got) == len(texts)
    for text, (n, held, known, log_p, tokens, numbers) in zip(texts, got, strict=True):
        own = [*(text or "").encode().translate(C.ASCII_LOWER).split(), b""]
        assert (n, known) == (len(own), sum(w in place for w in own)), text
        assert held == pytest.approx(sum(model.log_counts[place[w]] for w in own if w in place))
        assert dict(zip(tokens, numbers, strict=True)) == Counter(w for w in own if w not in place)
        classes = [int(model.classes[place[w]]) if w in place else lm_scoring.class_of(w, model.endings, model.own) if w else 0 for w in own]
        before, expected = [model.start, model.start, *classes], 0.0
        for k, (w, c) in enumerate(zip(own, classes, strict=True)):
            expected += float(model.log_probability(np.array([c]), np.array([before[k + 1]]), np.array([before[k]]))[0]) / math.log(10)
            expected += (model.log_counts[place[w]] if w in place else 0) - model.log_class[c] if c >= model.own else 0
        assert log_p == pytest.approx(expected, abs=1e-5 * n)


def test_lm_steps_follow_plain_gradients():
    rng, n = np.random.default_rng(2), 12
    shares = rng.random(n)
    p, seen = lm_scoring.new_network(shares / shares.sum(), 1)
    plain = {k: v.astype(float) for k, v in p.items()}
    texts = [rng.integers(0, n, size) for size in (1, 2, 30)]
    before = {k: v.copy() for k, v in p.items()}
    lm_scoring.learn(p, seen, texts, shares, np.random.default_rng(4), 1000)
    noise = shares / shares.sum()
    random_ = np.random.default_rng(4)
    random_.permutation(sum(map(len, texts)))  # one batch: its order doesn't matter
    false = np.minimum(np.searchsorted(np.cumsum(noise), random_.random(lm_scoring.NOISE)), n - 1)
    g, m = {k: np.zeros_like(v) for k, v in plain.items()}, sum(map(len, texts))
    for text in texts:
        before_token = [n, n, *text]
        for k, target in enumerate(text):
            a, b = before_token[k + 1], before_token[k]
            q = plain["r"][a] * plain["c"][0] + plain["r"][b] * plain["c"][1]
            dq = 0.0
            for c, true in [(target, 1), *((c, 0) for c in false)]:
                d = 1 / (1 + np.exp(-(q @ plain["e"][c] + plain["b"][c] - np.log(noise[c] * lm_scoring.NOISE)))) - true
                g["e"][c], g["b"][c], dq = g["e"][c] + d * q, g["b"][c] + d, dq + d * plain["e"][c]
            for place, token in enumerate((a, b)):
                g["c"][place] += dq * plain["r"][token]
                g["r"][token] += dq * plain["c"][place]
    for k, rate in {"r": 1, "e": 1, "c": 1, "b": 0.1}.items():
        assert np.abs(p[k] - before[k]).max() > 0
        step = g[k] / m
        assert p[k] == pytest.approx(plain[k] - lm_scoring.RATE * rate * step / np.sqrt(1e-3 + step**2), abs=2e-5)


# --- what is learned, against plain computations


def test_long_texts_alone_teach_a_language_and_a_label(spark):
    rng = random.Random(31)
    make = lambda parts, n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))
    common, rare = ["the", "ing", "and", "wh"], ["zzo", "kip", "lum", "raf"]
    rows = [(k, make(common, 40), "aa") for k in range(60)] + [(100 + k, make(rare, 9000), "dd") for k in range(4)] + [(200, make(rare, 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "dd"]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}[200] == "dd"
    bad = ["scoundrel", "blockhead", "nitwit"]
    texts = [(k, " ".join(rng.choice(bad) if k % 2 and rng.random() < 0.1 else make(common, 1) for _ in range(8000 if k % 2 else 80))) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert model.constant is None
    score = lambda n, share: toxicity.score(" ".join(rng.choice(bad) if rng.random() < share else make(common, 1) for _ in range(n)).encode(), model)
    assert score(8000, 0.1) > 0.5 > score(80, 0.0)


def test_languages_are_counted_and_mixed_like_plain_loops(spark):
    rng = random.Random(32)
    parts = {"aa": ["the", "ing", "ä"], "bb": ["sch", "ung", "ß"], "cc": ["que", "les", "é"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(lang, rng.randint(1, 30)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
        return [int.from_bytes(data[k : k + 3], "big") for k in range(len(data) - 2)]

    counts = {lang: Counter(g for _, t, own in rows for g in grams(t) if own == lang) for lang in parts}
    assert model.languages == sorted(parts) and set(model.trigrams.tolist()) == {g for c in counts.values() for g in c}  # fewer than TRIGRAMS
    known = {g: k for k, g in enumerate(model.trigrams.tolist())}
    for k, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + 0.5 * (len(known) + 1)
        assert all(model.shares[k, j] == pytest.approx((counts[lang][g] + 0.5) / total, rel=1e-4) for g, j in known.items())
    for text in (make("aa", 30), make("aa", 25) + " " + make("cc", 20), make("bb", 1), "unseen wörds only"):
        own = [known.get(g, len(known)) for g in grams(text)]

        def em(allowed, own=own):
            p = {i: 1 / len(allowed) for i in allowed}
            for _ in range(language_id.STEPS if len(allowed) > 1 else 0):
                new = dict.fromkeys(allowed, 0.0)
                for g in own:
                    whole = sum(p[i] * float(model.shares[i, g]) for i in allowed)
                    for i in allowed:
                        new[i] += p[i] * float(model.shares[i, g]) / whole / len(own)
                p = new
            return p, sum(math.log(sum(p[i] * float(model.shares[i, g]) for i in allowed)) for g in own)

        order = sorted(range(3), key=lambda i: -em(range(3))[0][i])  # noqa: B023
        best, kept = -math.inf, {}
        for k in range(1, 4):
            p, likelihood = em(order[:k])
            value = likelihood - (k - 1) * language_id.PENALTY * math.log(len(own) + 1)
            if value <= best:
                break
            best, kept = value, p
        got = language_id.infer([text, "another one"], model)[0]
        assert {i for i in range(3) if got[i] > 0} == set(kept) and all(got[i] == pytest.approx(kept[i], abs=2e-3) for i in kept)


def test_toxicity_is_what_plain_compression_gives(spark):
    import zstandard

    rng = random.Random(33)
    word = lambda: "".join(rng.choices(["the", "ing", "and", "wh", "er"], k=rng.randint(1, 3)))
    text = lambda n, share: " ".join(rng.choice(["scoundrel", "blockhead"]) if rng.random() < share else word() for _ in range(n))
    rows = [(k, text(rng.randint(20, 120), 0.1 * (k % 3 == 0))) for k in range(120)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int"))
    assert model.toxic.endswith(model.ordinary) and len(model.toxic) > len(model.ordinary) > 0
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda window, content: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(window))
    for own in ("", "Short", rows[0][1], rows[1][1] + " BLOCKHEAD"):
        data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own).encode()
        cut = [data[k : k + 64] for k in range(0, max(1, len(data) - 16), 48)]
        gain = [size(w, model.ordinary) - size(w, model.toxic) for w in cut]
        assert toxicity.gains(own.encode(), model).tolist() == gain
        shares = [sum(g >= t for g in gain) / len(gain) for t in toxicity.GAINS]
        x = [1.0, *(10 * s for s in shares), *(math.log(1 + s * len(gain)) for s in shares), max(gain) / 4, math.log(1 + len(gain)) / 4]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert toxicity.score(own.encode(), model) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
