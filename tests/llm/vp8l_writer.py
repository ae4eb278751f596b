"""A writer of lossless WebP streams that uses what a test asks for: transforms, references, a colour cache, several code groups."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from hazeframe.llm import webp


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        assert 0 <= value < 1 << n or n == 0
        self.value |= value << self.n
        self.n += n

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts, most=15):
    """Huffman lengths; counts are flattened until none exceeds most."""
    counts = dict(counts)
    while True:
        heap = [(c, k, [s]) for k, (s, c) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        length = Counter()
        tie = len(heap)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, tie, x + y))
            tie += 1
        if not length or max(length.values()) <= most:
            return dict(length) or {s: 1 for s in counts}
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def canonical(lengths):
    """symbol -> (code with its bits in the order they are written, length)"""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code, last = code + 1, n
    return out


def put_code(bits, counts, alphabet):
    """Writes a prefix code for the symbols counted; returns symbol -> (code, length)."""
    used = sorted(counts) or [0]
    if len(used) <= 2 and max(used) < 256:
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        bits.put(1, 1)
        for s in used:
            bits.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        counts = {used[0]: 1, (used[0] + 1) % alphabet: 1}
    lengths = code_lengths(counts)
    row = [lengths.get(s, 0) for s in range(alphabet)]
    symbols, k = [], 0
    while k < alphabet:  # runs of zeros by 17 and 18, repeats by 16
        run = 1
        while k + run < alphabet and row[k + run] == row[k]:
            run += 1
        if row[k] == 0 and run >= 3:
            run = min(run, 138)
            symbols.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif row[k] and run >= 4:
            run = min(run, 7)
            symbols += [(row[k], 0, 0), (16, run - 4, 2)]
        else:
            run = 1
            symbols.append((row[k], 0, 0))
        k += run
    kinds = Counter(s for s, _, _ in symbols)
    if len(kinds) == 1:
        kinds[(next(iter(kinds)) + 1) % 16] += 1
    inner = code_lengths(kinds, 7)
    bits.put(0, 1)
    n = max(4, 1 + max(webp.CODE_LENGTH_ORDER.index(s) for s in inner))
    bits.put(n - 4, 4)
    for s in webp.CODE_LENGTH_ORDER[:n]:
        bits.put(inner.get(s, 0), 3)
    bits.put(0, 1)
    codes = canonical(inner)
    for s, extra, width in symbols:
        bits.put(*codes[s])
        bits.put(extra, width)
    return canonical(lengths)


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    second = v >> (n - 1) & 1
    return 2 * n + second, v & ((1 << (n - 1)) - 1), n - 1


def tokens_of(pixels, width, cache_bits, copies):
    """Literals, references (length, distance code) and cache hits of flat ARGB pixels."""
    out, k, cache, near = [], 0, {}, {max(1, dx + dy * width): c + 1 for c, (dx, dy) in reversed(list(enumerate(webp.SHORT_DISTANCES)))}
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(pixels):
        best = (0, 0)
        if copies:
            for back in range(1, min(k, 300) + 1):
                n = 0
                while k + n < len(pixels) and n < 200 and pixels[k + n] == pixels[k + n - back]:
                    n += 1
                best = max(best, (n, -back))
        n, back = best[0], -best[1]
        if n >= 3:
            out.append(("copy", n, near.get(back, back + 120)))
        elif cache_bits and cache.get(slot(pixels[k])) == pixels[k]:
            n = 1
            out.append(("cache", slot(pixels[k])))
        else:
            n = 1
            out.append(("pixel", pixels[k]))
        for p in pixels[k : k + n]:
            if cache_bits:
                cache[slot(p)] = p
        k += n
    return out


def put_image(bits, image, main=False, cache_bits=0, copies=False, tile=0):
    """image: uint32 ARGB (height, width). tile: log2 of the meta prefix tiles, two groups by turns."""
    height, width = image.shape
    flat = [int(p) for p in image.ravel()]
    tokens = tokens_of(flat, width, cache_bits, copies)
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    meta = None
    if main:
        bits.put(int(tile > 0), 1)
        if tile:
            tall, wide = (height + (1 << tile) - 1) >> tile, (width + (1 << tile) - 1) >> tile
            meta = (np.add.outer(np.arange(tall), np.arange(wide)) % 2).astype(np.uint32)
            bits.put(tile - 2, 3)
            put_image(bits, meta << np.uint32(8) | np.uint32(0xFF000000))
    counts = [[Counter() for _ in range(5)] for _ in range(2 if tile else 1)]
    groups, at = [], 0
    for t in tokens:
        g = int(meta[at // width >> tile, at % width >> tile]) if meta is not None else 0
        groups.append(g)
        if t[0] == "pixel":
            for c, s in zip(range(4), (8, 16, 0, 24), strict=True):
                counts[g][c][t[1] >> s & 255] += 1
            at += 1
        elif t[0] == "cache":
            counts[g][0][280 + t[1]] += 1
            at += 1
        else:
            counts[g][0][256 + prefix(t[1])[0]] += 1
            counts[g][4][prefix(t[2])[0]] += 1
            at += t[1]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[put_code(bits, c, n) for c, n in zip(own, sizes, strict=True)] for own in counts]
    for g, t in zip(groups, tokens, strict=True):
        if t[0] == "pixel":
            for c, s in zip(range(4), (8, 16, 0, 24), strict=True):
                bits.put(*codes[g][c][t[1] >> s & 255])
        elif t[0] == "cache":
            bits.put(*codes[g][0][280 + t[1]])
        else:
            for c, value, base in ((0, t[1], 256), (4, t[2], 0)):
                symbol, extra, n = prefix(value)
                bits.put(*codes[g][c][base + symbol])
                bits.put(extra, n)


def guess(mode, left, top, top_left, top_right):
    """The format's 14 predictions, channel by channel, in whole numbers."""

    def average(a, b):
        return [(x + y) // 2 for x, y in zip(a, b, strict=True)]

    def clamp(v):
        return max(0, min(255, v))

    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(average(left, top), top_left, strict=True)]
    by_mode = {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: top_right, 4: top_left, 5: average(average(left, top_right), top), 6: average(left, top_left), 7: average(left, top),
        8: average(top_left, top), 9: average(top, top_right), 10: average(average(left, top_left), average(top, top_right)),
    }
    return by_mode[mode]


def residuals(argb, modes, tile):
    """Pixels (A, R, G, B) less their predictions."""
    height, width, _ = argb.shape
    own = argb.tolist()
    out = argb.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                expected = own[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                expected = own[y - 1][0]
            else:
                right = own[y - 1][x + 1] if x + 1 < width else own[y][0]
                expected = guess(int(modes[y >> tile, x >> tile]), own[y][x - 1], own[y - 1][x], own[y - 1][x - 1], right)
            out[y, x] = [(a - b) % 256 for a, b in zip(own[y][x], expected, strict=True)]
    return out


def decorrelated(argb, factors, tile):
    """Red less a part of green; blue less parts of green and of the red that there was."""
    signed = lambda v: v - 256 if v > 127 else v
    out = argb.copy()
    for y, row in enumerate(argb.tolist()):
        for x, (_, red, green, blue) in enumerate(row):
            _, red_to_blue, green_to_blue, green_to_red = (signed(int(v)) for v in factors[y >> tile, x >> tile])
            out[y, x, 1] = (red - (green_to_red * signed(green) >> 5)) % 256
            out[y, x, 3] = (blue - (green_to_blue * signed(green) >> 5) - (red_to_blue * signed(red) >> 5)) % 256
    return out


def write(rgba, transforms=(), **how):
    """A WebP file of the pixels after the transforms, in order: ('predictor', modes, tile), ('cross', factors, tile), ('green',), ('palette',)."""
    height, width, _ = rgba.shape
    bits = Bits()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        bits.put(value, n)
    c = rgba[..., [3, 0, 1, 2]].astype(np.int32)
    for t in transforms:
        bits.put(1, 1)
        if t[0] == "predictor":
            bits.put(webp.PREDICTOR, 2)
            bits.put(t[2] - 2, 3)
            put_image(bits, (t[1].astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000))
            c = residuals(c, t[1], t[2])
        elif t[0] == "cross":
            bits.put(webp.CROSS_COLOUR, 2)
            bits.put(t[2] - 2, 3)
            put_image(bits, webp._joined(t[1]))
            c = decorrelated(c, t[1], t[2])
        elif t[0] == "green":
            bits.put(webp.SUBTRACT_GREEN, 2)
            c = c.copy()
            c[..., 1] = (c[..., 1] - c[..., 2]) & 255
            c[..., 3] = (c[..., 3] - c[..., 2]) & 255
        else:
            bits.put(webp.COLOUR_INDEXING, 2)
            palette, index = np.unique(webp._joined(c), return_inverse=True)
            index = index.reshape(height, -1)
            bits.put(len(palette) - 1, 8)
            steps = webp._channels(palette)
            put_image(bits, webp._joined(np.diff(steps, axis=0, prepend=0) & 255)[None])
            pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            wide = (index.shape[1] + (1 << pack) - 1) >> pack
            packed = np.zeros((height, wide), np.int64)
            for x in range(index.shape[1]):
                packed[:, x >> pack] |= index[:, x] << (x & ((1 << pack) - 1)) * (8 >> pack)
            c = np.zeros((height, wide, 4), np.int32)
            c[..., 0], c[..., 2] = 255, packed
    bits.put(0, 1)
    put_image(bits, webp._joined(c), main=True, **how)
    stream = bits.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
