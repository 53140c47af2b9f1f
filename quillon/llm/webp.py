"""Lossless WebP: a full decoder of the VP8L bit stream.

It reads prefix codes (simple, normal and code-length coded), back-references with the short-distance map, the colour
cache and meta prefix codes, and inverts the predictor, cross-colour, subtract-green and palette transforms.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the lossless WebP format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120 as (x, y): left and up.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Bits of a byte string, the least significant first; reading beyond the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the bit stream ends early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (end + 7) >> 3], "little") >> (self.at & 7)
        self.at = end
        return value & ((1 << n) - 1)


class Prefix:
    """A canonical prefix code, as its code lengths define it."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.lengths = lengths
        self.longest = max((n for n, _ in used), default=0)
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.only is None and sum(2 ** (self.longest - n) for n, _ in used) != 2**self.longest:
            raise ValueError("a prefix code that is not complete")
        self.table: dict[tuple[int, int], int] = {}
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            self.table[n, code] = s
            code, last = code + 1, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | bits.read(1)
            if (s := self.table.get((n, code))) is not None:
                return s
        raise ValueError("no such prefix")


#: Codes read before, by alphabet size, how many bits they took and these bits: images of one writer share them.
SEEN: dict[tuple[int, int], dict[int, Prefix]] = {}
SEEN_BITS, SEEN_MOST = 512, 64


def _read_prefix(bits: Bits, size: int) -> Prefix:
    at = bits.at
    ahead = int.from_bytes(bits.data[at >> 3 : (at + SEEN_BITS + 7) >> 3], "little") >> (at & 7)
    for (n_symbols, used), codes in SEEN.items():
        if n_symbols == size and at + used <= 8 * len(bits.data) and (code := codes.get(ahead & ((1 << used) - 1))):
            bits.at += used
            return code
    code = _parse_prefix(bits, size)
    if (used := bits.at - at) <= SEEN_BITS:
        if len(SEEN) >= SEEN_MOST:
            SEEN.clear()
        SEEN.setdefault((size, used), {})[ahead & ((1 << used) - 1)] = code
    return code


def _parse_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return Prefix(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    reader = Prefix(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        code = reader.read(bits)
        if code < 16:
            lengths[at] = code
            at += 1
            last = code or last
            continue
        value, n = (last, 3 + bits.read(2)) if code == 16 else (0, 3 + bits.read(3)) if code == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    return Prefix(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """height x width pixels as uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    meta, groups, block = None, 1, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = (_pixels(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_prefix(bits, n) for n in (256 + 24 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    count = width * height
    out = [0] * count
    cache = [0] * cache_size
    at = kept = 0  # kept: pixels before it are in the cache

    def remember(upto: int) -> None:
        nonlocal kept
        if cache_size:
            for p in out[kept:upto]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        kept = upto

    while at < count:
        code = codes[int(meta[(at // width) >> block, (at % width) >> block]) if meta is not None else 0]
        symbol = code[0].read(bits)
        if symbol < 256:
            red, blue, alpha = code[1].read(bits), code[2].read(bits), code[3].read(bits)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 256 + 24:
            length, far = _extra(bits, symbol - 256), _extra(bits, code[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > count:
                raise ValueError("a back-reference beyond the image")
            for p in range(at, at + length):
                out[p] = out[p - far]
            at += length
        else:
            remember(at)
            if symbol - 280 >= cache_size:
                raise ValueError("no such colour in the cache")
            out[at] = cache[symbol - 280]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB to (..., 4) bytes in the order A, R, G, B."""
    return np.stack([pixels >> 24 & 255, pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], -1).astype(np.uint8)


def _joined(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., k].astype(np.uint32) for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def _predict(mode: int, left: np.ndarray, up: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """One pixel's prediction from its neighbours' four channels, as int16."""

    def half(a, b):
        return (a + b) >> 1

    if mode == 11:
        # distances of left and up from the gradient left + up - corner
        to_left, to_up = np.abs(up - corner).sum(), np.abs(left - corner).sum()
        return left if to_left < to_up else up
    if mode == 12:
        return np.clip(left + up - corner, 0, 255)
    if mode == 13:
        mean = half(left, up)
        step = mean - corner
        return np.clip(mean + (step + (step < 0)) // 2, 0, 255)
    return {
        0: lambda: np.array([255, 0, 0, 0], np.int16), 1: lambda: left, 2: lambda: up, 3: lambda: right, 4: lambda: corner,
        5: lambda: half(half(left, right), up), 6: lambda: half(left, corner), 7: lambda: half(left, up), 8: lambda: half(corner, up),
        9: lambda: half(up, right), 10: lambda: half(half(left, corner), half(up, right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0], np.int16))()


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int16)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = np.array([255, 0, 0, 0], np.int16) if x == 0 else out[0, x - 1]
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                mode = int(modes[y >> block, x >> block]) >> 8 & 15
                # to the right of the last column stands the row's own first pixel
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predict(mode, out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + guess) & 255
    return _joined(out.astype(np.uint8))


def _undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    spread = factors.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]
    by = _channels(spread).view(np.int8).astype(np.int32)  # -, red to blue, green to blue, green to red
    old = _channels(pixels)
    green = old[..., 2].view(np.int8).astype(np.int32)
    red = (old[..., 1] + (by[..., 3] * green >> 5)) & 255
    blue = old[..., 3] + (by[..., 2] * green >> 5) + (by[..., 1] * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)
    return _joined(np.stack([old[..., 0], red, old[..., 2], blue & 255], -1).astype(np.uint8))


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _joined(c)


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int, shift: int) -> np.ndarray:
    index = pixels >> 8 & 255
    if shift:
        each = 8 >> shift
        spread = index.repeat(1 << shift, 1)[:, :width]
        index = spread >> (np.arange(width, dtype=np.uint32) % (1 << shift) * each) & ((1 << each) - 1)
    padded = np.zeros(256, np.uint32)
    padded[: len(palette)] = palette
    return padded[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """The pixels of a VP8L stream: height x width x 4 bytes in the order A, R, G, B."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("no such version")
    undo = []
    wide = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            data_of = _pixels(bits, -(-wide >> block), -(-height >> block), False)
            undo.append((kind, data_of, block, wide))
        elif kind == 2:
            undo.append((kind, None, 0, wide))
        else:
            n = bits.read(8) + 1
            deltas = _channels(_pixels(bits, n, 1, False)[0])
            palette = _joined(np.cumsum(deltas, 0, dtype=np.uint8))
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, palette, shift, wide))
            wide = -(-wide >> shift)
    pixels = _pixels(bits, wide, height, True)
    for kind, extra, n, before in reversed(undo):
        if kind == 0:
            pixels = _undo_predictor(pixels, extra, n)
        elif kind == 1:
            pixels = _undo_cross_colour(pixels, extra, n)
        elif kind == 2:
            pixels = _undo_green(pixels)
        else:
            pixels = _undo_palette(pixels, extra, before, n)
    out = _channels(pixels)
    if not alpha:
        out[..., 0] = 255
    return out


def decode_webp(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, as decode_vp8l gives them."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, 8 + int.from_bytes(data[4:8], "little")
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in this file")
