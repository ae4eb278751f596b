"""Lossless WebP: every feature of the format, exact round trips, columns."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from hazeframe.llm import media_columns, webp

from .vp8l_writer import write


def picture(height, width, colours, seed=0):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 256, (colours, 4))
    index = np.cumsum(rng.integers(0, 2, (height, width)), axis=1) % colours
    return palette[index].astype(np.uint8)


def check(rgba, *transforms, **how):
    assert (webp.decode(write(rgba, transforms, **how)) == rgba).all()


def test_a_file_of_another_encoder():
    pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixels.shape == (1, 1, 4)


@pytest.mark.parametrize("colours", [1, 2, 3, 30, 256])
def test_prefix_codes(colours):
    check(picture(9, 23, colours))


def test_references_and_cache():
    rgba = picture(20, 31, 5)
    check(rgba, copies=True)
    for bits in (1, 4, 11):
        check(rgba, cache_bits=bits)
        check(rgba, cache_bits=bits, copies=True)


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_short_distances(width):
    check(picture(25, width, 3, seed=width), copies=True)


def test_groups_of_codes():
    check(picture(21, 33, 40), tile=2)
    check(picture(21, 33, 40), tile=3, cache_bits=3, copies=True)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    check(picture(11, 13, 60, seed=mode), ("predictor", np.full((3, 4), mode), 2))


def test_mixed_transforms():
    rng = np.random.default_rng(5)
    rgba = picture(18, 22, 200, seed=9)
    factors = rng.integers(0, 256, (5, 6, 4)).astype(np.int32)
    check(rgba, ("cross", factors, 2))
    check(rgba, ("green",))
    check(rgba, ("predictor", rng.integers(0, 14, (5, 6)), 2), ("cross", factors, 2), ("green",), copies=True, cache_bits=5)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    check(picture(7, 19, colours, seed=colours), ("palette",), copies=True)


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", webp.encode(np.zeros((2, 64, 3), np.uint8))[:-8], b"x" * 40])
def test_broken_files(data):
    with pytest.raises(webp.WebPError):
        webp.decode(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 100_000])
def test_round_trip(n):
    rng = random.Random(n)
    for data in (os.urandom(n), b"a" * n, bytes(rng.choices(b"ab", k=n)), bytes(rng.choices(b"the quick brown fox", k=n))):
        padded = media_columns.padded(data)
        assert len(padded) % 192 == 0 and padded.startswith(data) and set(padded[len(data) :]) <= {32} and 0 < len(padded) <= max(192, n + 191)
        n_bytes, size, sha, crc, media_bytes, media_sha, _ = media_columns.round_trip(data)
        media = media_columns.store(padded)
        assert (n_bytes, size, sha, crc) == (n, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (media_bytes, media_sha) == (len(media), hashlib.sha256(media).hexdigest())


def test_payloads_beyond_one_image():
    data = b"0123456789" * 320_000
    media = media_columns.store(media_columns.padded(data))
    assert len(list(media_columns.images(media))) == 2
    assert media_columns.round_trip(data)[2] == hashlib.sha256(media_columns.padded(data)).hexdigest()


def test_columns(spark, tmp_path: Path):
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, error string").withColumnRenamed("error", "other")
    encoded = media_columns.encode_column(df)
    rows = media_columns.decode_column(encoded).collect()
    back = sorted((r.doc_id, None if r.pixels is None else b"".join(bytes(p.rgba) for p in r.pixels)[:12], r.error) for r in rows if r.doc_id != 2)
    assert back == [(1, b"abc\xff   \xff   \xff", None)] + [(3, b"   \xff" * 3, None)] * 2
    assert [r.error for r in rows if r.doc_id == 2] == ["null"]
    broken = spark.createDataFrame([(bytearray(b"junk"),), (None,)], "media binary")
    assert {r.error for r in media_columns.decode_column(broken).collect()} == {"no image", "null"}
    assert media_columns.decode_column(broken.limit(0)).count() == 0


def test_the_table_of_short_distances():
    """Nearest first; at one distance by |dx|, and of a mirrored pair the positive dx first."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    assert list(webp.SHORT_DISTANCES) == sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def test_the_encoder_uses_the_format(monkeypatch):
    """Rows of text come back through the general decoder: prefix codes of several lengths, references, the cache, a palette."""
    seen = set()
    lengths, put = webp.code_lengths, webp._put_image
    monkeypatch.setattr(webp, "code_lengths", lambda c: seen.add(("lengths", len(set(lengths(c)[lengths(c) > 0]) ) > 1)) or lengths(c))
    monkeypatch.setattr(webp, "_put_image", lambda w, p, main, cache_bits=0: seen.update({("references", bool(webp.references(p))), ("cache", cache_bits > 0), ("palette", not main)}) or put(w, p, main, cache_bits))
    rng = random.Random(1)
    line = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(12)) + " "
    for data in ((line * 5 + "".join(rng.choices("the quick brown fox", k=3000))).encode(), b"ab " * 2000, b""):
        media = media_columns.store(media_columns.padded(data))
        back = b"".join(np.ascontiguousarray(p[..., :3]).tobytes() for p in media_columns.images(media))
        assert back == media_columns.padded(data)
        assert len(media) < len(back) or not data
    assert {("lengths", True), ("references", True), ("cache", True), ("palette", True)} <= seen


def test_code_lengths_are_complete():
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 300, 1304):
        for counts in (np.ones(n, int), rng.integers(1, 10**6, n), (2.0 ** rng.uniform(0, 40, n)).astype(int)):
            got = webp.code_lengths(counts)
            assert (2.0**-got).sum() == 1 and got.min() >= 1 and got.max() <= webp.LONGEST


def test_a_header_that_claims_too_much():
    media = bytearray(webp.encode(np.zeros((2, 64, 3), np.uint8)))
    media[21:25] = (16383 | 16383 << 14).to_bytes(4, "little")
    with pytest.raises(webp.WebPError, match="too large"):
        webp.decode(bytes(media))


@pytest.mark.parametrize("name", ["media", "pixels", "error"])
def test_columns_of_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "abc", "mine")], f"doc_id long, text string, {name} string")
    encoded = media_columns.encode_column(df)
    assert sorted(encoded.columns) == sorted({"doc_id", "text", "media", name})
    row = media_columns.decode_column(encoded).collect()[0]
    assert bytes(row.pixels[0].rgba)[:4] == b"abc\xff" and row.error is None and row.media != "mine"


def test_code_lengths_are_read_at_once_from_any_place():
    data = bytes(np.random.default_rng(1).integers(0, 256, 40, np.uint8))
    for at, n in ((0, 1), (3, 7), (5, 14), (8, 33), (7, 0), (16, 76)):
        one, all_ = webp._Bits(data), webp._Bits(data)
        one.at = all_.at = at
        want = [one.read(4) for _ in range(n)]
        assert all_.nibbles(n).tolist() == want and all_.at == one.at
    with pytest.raises(webp.WebPError):
        webp._Bits(data).nibbles(81)


@pytest.mark.parametrize("text", [b"abc " * 300, bytes(range(256)) * 9, "Sämtliche Wörter, einmal und noch einmal. ".encode() * 30 + bytes(range(200))])
def test_images_cut_short_are_errors_or_the_whole_image(text):
    media = media_columns.store(media_columns.padded(text))
    whole = webp.decode(media)
    assert whole[..., :3].tobytes() == media_columns.padded(text)
    for n in range(20, len(media), 7):
        try:
            assert (webp.decode(media[:n]) == whole).all()
        except webp.WebPError:
            pass
