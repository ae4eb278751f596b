"""Lossless WebP (VP8L, RFC 9649): a decoder of the whole format and an encoder.

The encoder writes a palette where colours repeat, back-references to strings of pixels seen before, colour-cache references and
literals, under prefix codes by frequency. The predictor, cross-colour and subtract-green transforms are for pictures; text rows don't
gain by them, so the encoder leaves them out.

The decoder handles simple and normal prefix codes, meta prefix images, LZ77 back-references with the short-distance map,
the colour cache, and the predictor, cross-colour, subtract-green and colour-indexing transforms. Where every code of an
image has one length and neither references nor a cache are in use, all pixels are decoded at once by numpy; otherwise
symbol by symbol.

Pixels are uint8 arrays of shape (height, width, 4) in the order R, G, B, A.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the order in which code-length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format (RFC 9649, 5.2.2): the near pixels that the first 120 distance codes stand for, as (dx, dy).
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MAX_SIDE = 16384
#: Pixels of an image that is decoded, at most: a header of a few bytes may claim 2**28.
MAX_PIXELS = 1 << 24
#: Fixed value of the format: the colour cache's multiplier.
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)


class WebPError(ValueError):
    """The bytes are no lossless WebP image."""


class _Bits:
    """Reads bits least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        return int.from_bytes(self.data[byte : byte + 8], "little") >> shift & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise WebPError("the data end early")
        return value

    def nibbles(self, n: int) -> np.ndarray:
        """The next n fields of four bits."""
        start, shift, size = self.at >> 3, self.at & 7, n + 1 >> 1
        self.at += 4 * n
        if self.at > self.end:
            raise WebPError("the data end early")
        raw = int.from_bytes(self.data[start : start + size + 1], "little") >> shift & ((1 << 8 * size) - 1)
        both = np.frombuffer(raw.to_bytes(size, "little"), np.uint8)
        out = np.empty(2 * size, np.uint8)
        out[::2], out[1::2] = both & 15, both >> 4
        return out[:n]

    def array(self, n: int) -> np.ndarray:
        """The next n bits, each as a number."""
        start = self.at >> 3
        if self.at + n > self.end:
            raise WebPError("the data end early")
        raw = np.unpackbits(np.frombuffer(self.data, np.uint8, count=(self.at + n + 7 >> 3) - start, offset=start), bitorder="little")
        raw = raw[self.at & 7 : (self.at & 7) + n]
        self.at += n
        return raw


class _Code:
    """A canonical prefix code: a table from the next `width` bits to (symbol, length)."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = lengths.nonzero()[0]
        self.single = int(used[0]) if len(used) == 1 else (0 if len(used) == 0 else None)
        self.uniform = 0 if self.single is not None else None
        self.values, self.lengths, self.mask = [self.single or 0], [0], 0  # symbol and length, by the next bits
        if self.single is not None:
            return
        own = lengths[used].astype(np.int64)
        self.width = int(own.max())
        if int((1 << (self.width - own)).sum()) != 1 << self.width:
            raise WebPError("a prefix code is not complete")
        order = own.astype(np.uint8).argsort(kind="stable")
        symbols, own = used[order], own[order]
        self.uniform = self.width if own[0] == self.width else None
        both = (symbols << 4 | own).repeat(1 << (self.width - own))[_reversed_bits(self.width)]
        self.symbols = both >> 4
        self.values, self.lengths, self.mask = self.symbols.tolist(), (both & 15).tolist(), (1 << self.width) - 1

    def read(self, bits: _Bits) -> int:
        if self.single is not None:
            return self.single
        found = bits.peek(self.width)
        bits.at += self.lengths[found]
        if bits.at > bits.end:
            raise WebPError("the data end early")
        return self.values[found]


_reversed: dict[int, np.ndarray] = {}


def _reversed_bits(width: int) -> np.ndarray:
    """For each number of `width` bits, the number with these bits reversed."""
    if width not in _reversed:
        n, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
        for k in range(width):
            out |= (n >> k & 1) << (width - 1 - k)
        _reversed[width] = out
    return _reversed[width]


@lru_cache(maxsize=64)
def _code_of_lengths(n: int, packed: int) -> _Code:
    """The code for code lengths, of n lengths of three bits."""
    lengths = np.zeros(19, np.int64)
    for i, k in enumerate(CODE_LENGTH_ORDER[:n]):
        lengths[k] = packed >> 3 * i & 7
    return _Code(lengths)


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        count = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first] + ([bits.read(8)] if count == 2 else [])
        if max(symbols) >= alphabet:
            raise WebPError("a symbol is outside its alphabet")
        lengths[symbols] = 1
        return _Code(lengths)
    n = bits.read(4) + 4
    code, left = _code_of_lengths(n, bits.read(3 * n)), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    if code.single is None and code.uniform is not None and int(code.symbols.max()) < 16:
        n = min(left, alphabet)  # as many bits for each length, no repeats: all at once
        index = bits.nibbles(n) if code.width == 4 else bits.array(n * code.width).reshape(n, code.width) @ (1 << np.arange(code.width))
        lengths[:n] = code.symbols[index]
        return _Code(lengths)
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[at] = k
            last, at = k or last, at + 1
            continue
        value, repeat = {16: (last, 3 + bits.read(2)) if k == 16 else 0, 17: (0, 3 + bits.read(3)) if k == 17 else 0, 18: (0, 11 + bits.read(7)) if k == 18 else 0}[k]
        if at + repeat > alphabet:
            raise WebPError("code lengths overrun the alphabet")
        lengths[at : at + repeat] = value
        at += repeat
    return _Code(lengths)


def _prefix_value(bits: _Bits, symbol: int) -> int:
    """Of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _entropy_image(bits: _Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """ARGB pixels, uint32, of shape (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    meta, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = _entropy_image(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile)
        meta = (tiles >> 8 & 0xFFFF).astype(np.int64)
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    total = width * height
    if meta is None and not cache_bits and all(code.uniform is not None for code in groups[0][:4]) and _only_literals(groups[0][0]):
        return _decode_uniform(bits, groups[0], total).reshape(height, width)
    out, at = [0] * total, 0  # a pixel too many fails
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    near = _near(width)
    place = bits.at
    windows = np.ndarray((len(bits.data) // 2 + 1,), "<u8", bits.data + bytes(8), 0, (2,)).tolist()  # 64 bits from every second byte on: 49 at least from any place, three codes have 45 at most
    last = len(windows) - 1
    ready = [_tables(group) for group in groups]
    (g_values, g_lengths, g_mask), (r_values, r_lengths, r_mask), (b_values, b_lengths, b_mask), (a_values, a_lengths, a_mask) = ready[0]
    group, symbols, factor = 0, 280 + (len(cache) if cache_bits else 0), CACHE_HASH
    plain = meta is None and not a_mask  # one group, one alpha: literals need no more than three lookups
    while at < total:
        if plain:
            try:
                while True:
                    window = windows[place >> 4] >> (place & 15)
                    i = window & g_mask
                    symbol = g_values[i]
                    size = g_lengths[i]
                    if symbol < 256:
                        window >>= size
                        j = window & r_mask
                        length = r_lengths[j]
                        k = window >> length & b_mask
                        out[at] = pixel = symbol << 8 | r_values[j] | b_values[k]
                        place += size + length + b_lengths[k]
                        if cache_bits:
                            cache[(factor * pixel & 0xFFFFFFFF) >> shift] = pixel
                    elif 280 <= symbol < symbols:
                        out[at] = cache[symbol - 280]
                        place += size
                    else:
                        break
                    at += 1
            except IndexError:  # the image is full, or the data have ended
                pass
            if at == total:
                break
        if meta is not None:
            group = int(meta[at // width >> tile, at % width >> tile])
            (g_values, g_lengths, g_mask), (r_values, r_lengths, r_mask), (b_values, b_lengths, b_mask), (a_values, a_lengths, a_mask) = ready[group]
        window = windows[min(place >> 4, last)] >> (place & 15)  # what lies beyond the end is found out after the loop
        i = window & g_mask
        symbol = g_values[i]
        place += g_lengths[i]
        if symbol < 256:
            window >>= g_lengths[i]
            j = window & r_mask
            window >>= r_lengths[j]
            k = window & b_mask
            place += r_lengths[j] + b_lengths[k]
            pixel = symbol << 8 | r_values[j] | b_values[k]
            if a_mask:
                m = windows[min(place >> 4, last)] >> (place & 15) & a_mask
                pixel |= a_values[m]
                place += a_lengths[m]
            out[at] = pixel
            if cache_bits:
                cache[(CACHE_HASH * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += 1
        elif symbol < 280:
            bits.at = place
            length = _prefix_value(bits, symbol - 256)
            code = _prefix_value(bits, groups[group][4].read(bits))
            place = bits.at
            back = code - 120 if code > 120 else near[code - 1]
            if back > at or at + length > total:
                raise WebPError("a back-reference leaves the image")
            own = out[at - back : at - back + length] if back >= length else (out[at - back : at] * (length // back + 1))[:length]
            out[at : at + length] = own
            if cache_bits:
                for pixel in own:
                    cache[(CACHE_HASH * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += length
        else:  # a pixel of the cache stays where it is
            if symbol >= symbols:
                raise WebPError("a colour cache index is too large")
            out[at] = cache[symbol - 280]
            at += 1
    bits.at = place
    if place > bits.end:
        raise WebPError("the data end early")
    return np.array(out, np.uint32).reshape(height, width)


def _tables(group: list[_Code]) -> list[tuple[list[int], list[int], int]]:
    """For green, red, blue and alpha: values, in their place in a pixel but for green, lengths and the mask. An alpha that is one value goes to red."""
    green, red, blue, alpha = group[:4]
    constant = 0 if alpha.mask else alpha.values[0] << 24
    reds = [constant | v << 16 for v in red.values]
    return [(green.values, green.lengths, green.mask), (reds, red.lengths, red.mask), (blue.values, blue.lengths, blue.mask), ([v << 24 for v in alpha.values], alpha.lengths, alpha.mask)]


def _only_literals(code: _Code) -> bool:
    return code.single < 256 if code.single is not None else int(code.symbols.max()) < 256


@lru_cache(maxsize=64)
def _near(width: int) -> list[int]:
    return [max(1, dx + dy * width) for dx, dy in SHORT_DISTANCES]


def _decode_uniform(bits: _Bits, group: list[_Code], total: int) -> np.ndarray:
    """All pixels at once: each takes as many bits as the next, so every code lies at a known place."""
    widths = [code.uniform for code in group[:4]]
    step = sum(widths)
    rows = bits.array(step * total).reshape(total, step) if step else np.zeros((total, 0), np.uint8)
    out, at = np.zeros(total, np.uint32), 0
    for code, width, shift in zip(group, widths, (8, 16, 0, 24), strict=False):
        if width == 0:
            value = np.uint32(code.single)
        else:
            index = np.packbits(rows[:, at : at + width], axis=1, bitorder="little")
            index = index[:, 0].astype(np.int64) if width <= 8 else index[:, 0].astype(np.int64) | index[:, 1].astype(np.int64) << 8
            value = code.symbols[index].astype(np.uint32)
        out |= value << np.uint32(shift)
        at += width
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB uint32 to int32 channels A, R, G, B in the last axis."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The format's prediction of a pixel's channels from its neighbours' (int32)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        near_left, near_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if near_left < near_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        average = mean(left, top)
        difference = average - top_left
        return np.clip(average + (np.abs(difference) >> 1) * np.sign(difference), 0, 255)
    return (
        np.array([255, 0, 0, 0], np.int32), left, top, top_right, top_left,
        mean(mean(left, top_right), top), mean(left, top_left), mean(left, top), mean(top_left, top), mean(top, top_right),
        mean(mean(left, top_left), mean(top, top_right)),
    )[mode] if mode <= 10 else np.array([255, 0, 0, 0], np.int32)


def _undo_predictor(values: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Residuals to pixels."""
    height, width, _ = values.shape
    out = pixels = values.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = pixels[0, x - 1] if x else np.array([255, 0, 0, 0], np.int32)
            elif x == 0:
                guess = pixels[y - 1, 0]
            else:
                right = pixels[y - 1, x + 1] if x + 1 < width else pixels[y, 0]
                guess = predicted(int(modes[y >> tile, x >> tile]), pixels[y, x - 1], pixels[y - 1, x], pixels[y - 1, x - 1], right)
            out[y, x] = (values[y, x] + guess) & 255
    return out


def _undo_cross_colour(values: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    signed = lambda a: ((a & 255) ^ 128) - 128
    height, width, _ = values.shape
    spread = factors[np.ix_(np.arange(height) >> tile, np.arange(width) >> tile)]
    red_to_blue, green_to_blue, green_to_red = (signed(spread[..., k]) for k in (1, 2, 3))
    out, green = values.copy(), signed(values[..., 2])
    out[..., 1] = (values[..., 1] + (green_to_red * green >> 5)) & 255
    out[..., 3] = (values[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[..., 1]) >> 5)) & 255
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels of one lossless WebP file, shape (height, width, 4), R, G, B, A."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no RIFF container of WebP data")
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"VP8L":
            return _decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise WebPError("no lossless image chunk")


def _decode_stream(data: bytes) -> np.ndarray:
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise WebPError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > MAX_PIXELS:
        raise WebPError("the image is too large")
    opaque = not bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    transforms, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            image = _entropy_image(bits, (coded + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile)
            transforms.append((kind, tile, image, coded))
        elif kind == COLOUR_INDEXING:
            size = bits.read(8) + 1
            palette = (np.cumsum(_channels(_entropy_image(bits, size, 1)[0]), axis=0)) & 255
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, pack, palette, coded))
            coded = (coded + (1 << pack) - 1) >> pack
        else:
            transforms.append((kind, 0, None, coded))
    coded_pixels = _entropy_image(bits, coded, height, main=True)
    if not transforms:  # bytes B, G, R, A
        if opaque:
            coded_pixels |= np.uint32(255 << 24)
        return coded_pixels.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
    pixels = _channels(coded_pixels)
    for kind, n, extra, wide in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, (extra >> 8 & 15).astype(np.int64), n)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, _channels(extra), n)
        elif kind == SUBTRACT_GREEN:
            pixels[..., 1] = (pixels[..., 1] + pixels[..., 2]) & 255
            pixels[..., 3] = (pixels[..., 3] + pixels[..., 2]) & 255
        else:
            depth = 8 >> n
            x = np.arange(wide)
            index = pixels[:, x >> n, 2] >> (x & ((1 << n) - 1)) * depth & ((1 << depth) - 1)
            palette = np.zeros((max(256, len(extra)), 4), np.int32)
            palette[: len(extra)] = extra
            pixels = palette[index]
    if opaque:
        pixels[..., 0] = 255
    return pixels[..., [1, 2, 3, 0]].astype(np.uint8)


class _Writer:
    """Gathers fields (value, width), which are written least significant bit first."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.single: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.single.append((value, n))

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.widths.append(widths)

    def _flush(self) -> None:
        if self.single:
            both = np.array(self.single, np.int64)
            self.single.clear()
            self.values.append(both[:, 0])
            self.widths.append(both[:, 1])

    def bytes(self) -> bytes:
        """Fields of 57 bits at most, put into words of 64 bits where they begin; what doesn't fit goes into the next word."""
        self._flush()
        values, widths = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.widths)
        ends = widths.cumsum()
        starts = ends - widths
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        new = np.ones(len(word), bool)
        np.not_equal(word[1:], word[:-1], out=new[1:])
        first = new.nonzero()[0]
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = ((starts & 63) + widths > 64).nonzero()[0]  # one for each word at most
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: int(ends[-1]) + 7 >> 3]


#: The longest code that the encoder may give; what a symbol's share is taken for at least, so that codes and their tables stay short; the
#: shortest string of pixels that it refers back to.
LONGEST, RAREST, MATCH = 12, 512, 6


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code, none above LONGEST: by the logarithm of each symbol's share, then shortened, the frequent first, until nothing is left."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    own = np.maximum(counts[used], counts.sum() / RAREST)
    n = np.ceil(np.log2(own.sum() / own)).astype(np.int64)
    left = (1 << LONGEST) - int((1 << (LONGEST - n)).sum())
    order = (-own).argsort(kind="stable").tolist()
    each = n.tolist()
    for k in order:
        while left and each[k] > 1 and 1 << (LONGEST - each[k]) <= left:
            left -= 1 << (LONGEST - each[k])
            each[k] -= 1
        if not left:
            break
    lengths[used] = each
    return lengths


_FOUR_BITS_EACH = sum((4 if k < 16 else 0) << 3 * i for i, k in enumerate(CODE_LENGTH_ORDER))
_NIBBLES = 4 * np.arange(14)


def _put_code(writer: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for the symbols counted. Returns each symbol's code, as it is written, and its length."""
    used = counts.nonzero()[0]
    codes, widths = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        writer.put(1, 1)
        writer.put(max(len(used), 1) - 1, 1)
        writer.put(1, 1)
        for symbol in used.tolist() or [0]:
            writer.put(symbol, 8)
        if len(used) == 2:
            codes[used], widths[used] = [0, 1], 1
        return codes, widths
    lengths = code_lengths(counts)
    writer.put((19 - 4) << 1, 5)  # lengths 0 to 15 have four bits each
    writer.put(_FOUR_BITS_EACH, 3 * 19)
    n = max(2, int(used[-1]) + 1)
    writer.put(1 | 5 << 1 | n - 2 << 4, 1 + 3 + 12)  # how many lengths follow
    whole, rest = divmod(n, 14)
    fields = np.zeros((whole + 1, 14), np.int64)
    fields.ravel()[:n] = _reversed_bits(4)[lengths[:n]]
    widths_of = np.full(whole + 1, 4 * 14)
    widths_of[whole] = 4 * rest
    writer.put_all(np.bitwise_or.reduce(fields << _NIBBLES, axis=1)[: whole + (rest > 0)], widths_of[: whole + (rest > 0)])
    if len(used) > 1:
        order = used[lengths[used].astype(np.uint8).argsort(kind="stable")]
        share = 1 << (LONGEST - lengths[order])
        codes[order] = _reversed_bits(LONGEST)[share.cumsum() - share]
        widths[order] = lengths[order]
    return codes, widths


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lengths or distances: symbol, extra bits' value and their number."""
    less = values - 1
    top = np.floor(np.log2(np.maximum(less, 1))).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    symbol = np.where(less < 2, less, 2 * top + (less >> np.maximum(top - 1, 0) & 1))
    return symbol, np.where(less < 4, 0, less & ((1 << extra) - 1)), np.where(less < 4, 0, extra)


def references(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of strings of MATCH pixels or more, none longer than 4096, that stood before; first come, first served."""
    n = len(pixels) - MATCH + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(MATCH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + pixels[k : k + n]
    order = h.argsort(kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    out, free = [], 0
    for at in (before >= 0).nonzero()[0].tolist():
        if at < free:
            continue
        back = at - int(before[at])
        most = min(4096, len(pixels) - at)
        differs = pixels[at : at + most] != pixels[at - back : at - back + most]
        length = int(differs.argmax()) if differs.any() else most
        if length >= MATCH:
            out.append((at, length, back))
            free = at + length
    return out


def _put_image(writer: _Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """ARGB pixels, in a row, as an entropy-coded image."""
    writer.put(int(cache_bits > 0), 1)
    if cache_bits:
        writer.put(cache_bits, 4)
    if main:
        writer.put(0, 1)  # no meta prefix image
    copies = np.array(references(pixels), np.int64).reshape(-1, 3)
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[copies[:, 0]] += 1
    covered[copies[:, 0] + copies[:, 1]] -= 1
    alone = (covered[:-1].cumsum() == 0).nonzero()[0]
    green = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)  # of a token at its place: symbol of green; or of length, or cache
    kind = np.full(len(pixels), -1, np.int8)  # 0: literal, 1: cache, 2: copy
    kind[alone] = 0
    if cache_bits:
        key = ((pixels * np.uint32(CACHE_HASH)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        order = key.argsort(kind="stable")
        hit = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        hits = order[1:][hit]
        hits = hits[kind[hits] == 0]
        kind[hits] = 1
        green[hits] = 280 + key[hits]
    far = np.zeros(0, np.int64)
    if len(copies):
        symbol, extra, n_extra = _prefix(copies[:, 1])
        far, far_extra, n_far = _prefix(copies[:, 2] + 120)
        kind[copies[:, 0]] = 2
        green[copies[:, 0]] = 256 + symbol
    literal, tokens = (kind == 0).nonzero()[0], (kind >= 0).nonzero()[0]
    own = pixels[literal].astype("<u4").view(np.uint8).reshape(-1, 4)
    others = [own[:, k].astype(np.int64) for k in (2, 0, 3)]  # red, blue, alpha
    first = green[tokens]
    counts = [np.bincount(first, minlength=280 + (1 << cache_bits if cache_bits else 0)), *(np.bincount(c, minlength=256) for c in others), np.bincount(far, minlength=40)]
    codes = [_put_code(writer, c) for c in counts]
    # each token is one field: green, red, blue, alpha; or length, its extra bits, distance, its extra bits
    values, widths = np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    values[tokens], widths[tokens] = codes[0][0][first], codes[0][1][first]
    value, width = values[literal], widths[literal]
    for channel, (code, size) in zip(others, codes[1:4], strict=True):
        if size.any():
            value |= code[channel] << width
            width += size[channel]
    values[literal], widths[literal] = value, width
    if len(copies):
        where = copies[:, 0]
        for value, width in ((extra, n_extra), (codes[4][0][far], codes[4][1][far]), (far_extra, n_far)):
            values[where] |= value << widths[where]
            widths[where] += width
    writer.put_all(values[tokens], widths[tokens])


def encode(samples: np.ndarray) -> bytes:
    """A lossless WebP file of R, G, B samples (height, width, 3)."""
    height, width, _ = samples.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise WebPError("a side is outside 1 to 16384")
    writer = _Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        writer.put(value, n)
    planes = samples.reshape(-1, 3).astype(np.uint32)
    pixels = planes[:, 0] << 16 | planes[:, 1] << 8 | planes[:, 2] | np.uint32(255 << 24)
    n_colours = 1 + np.count_nonzero(np.diff(np.sort(pixels)))
    if n_colours <= 256 and 4 * n_colours <= len(pixels):
        colours, index = np.unique(pixels, return_inverse=True)
        writer.put(1, 1)
        writer.put(COLOUR_INDEXING, 2)
        writer.put(len(colours) - 1, 8)
        channels = _channels(colours)
        _put_image(writer, _joined(np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.int32))), main=False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        rows = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack)
        packed = (rows << np.arange(1 << pack) * (8 >> pack)).sum(axis=2).ravel()
        pixels, cache_bits = packed.astype(np.uint32) << np.uint32(8) | np.uint32(255 << 24), 0
    else:
        cache_bits = min(10, max(4, len(pixels).bit_length() - 2))
    writer.put(0, 1)
    _put_image(writer, pixels, main=True, cache_bits=cache_bits)
    stream = writer.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
