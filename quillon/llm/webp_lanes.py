"""Many small lossless WebP images at once: a writer and a reader that keep one image in each numpy lane.

The writer subtracts green where that lowers the entropy, copies runs of pixels that came before (back-references), names
pixels that the colour cache holds, and gives every image prefix codes of its own. Images of few colours get a palette
instead; they and every stream of another structure are read by the general decoder of ``webp``.

The reader advances all lanes together, one code a step: a literal, a cache entry or a back-reference.
"""

from __future__ import annotations

import struct

import numpy as np

from quillon.llm.webp import CACHE_FACTOR, CODE_LENGTH_ORDER, decode_vp8l

WIDTH, MAX_ROWS = 64, 32
IMAGE_BYTES = 3 * WIDTH * MAX_ROWS
#: The longest code written, and the widest table of the lanes' reader.
LONGEST = 10
CACHE_BITS = 7
GREENS = 256 + 24 + (1 << CACHE_BITS)
#: Pixels of the shortest and the longest back-reference; every distance is written as itself plus 120.
SHORTEST, FARTHEST = 3, 120
#: An image gets a palette when it has at most so many colours and this many times as many pixels.
PALETTE, PALETTE_SHARE = 16, 6
#: Lengths of the code for code lengths: a complete code over 0 to 11, 17 and 18.
OWN = np.array([3, 4, 4, 4, 4, 4, 4, 4, 4, 3, 4, 4, 0, 0, 0, 0, 0, 4, 4])
OPAQUE = np.uint32(255 << 24)
REVERSED = np.array([int(f"{k:0{LONGEST}b}"[::-1], 2) for k in range(1 << LONGEST)], np.int64)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For each row of counts (lanes x symbols), lengths of a complete prefix code of its symbols, of which there are two at least."""
    lanes, size = counts.shape
    counts = counts.astype(np.int64)
    few = (counts > 0).sum(1) < 2
    counts[few, :2] += 1
    used = counts > 0
    with np.errstate(divide="ignore"):
        ideal = np.ceil(np.log2(counts.sum(1, keepdims=True) / counts))
    lengths = np.where(used, np.clip(np.nan_to_num(ideal, posinf=0), 1, longest), 0).astype(np.int64)
    room = (1 << longest) - np.where(used, 1 << (longest - lengths), 0).sum(1)
    order = np.argsort(-counts, 1, kind="stable")
    most, every = int(used.sum(1).max()), np.arange(lanes)
    # codes of p < 2^-longest were cut to longest: lengthen rare ones until all fit
    while (room < 0).any():
        for rank in range(most - 1, -1, -1):
            at = order[:, rank]
            n = lengths[every, at]
            grow = (room < 0) & (n > 0) & (n < longest)
            lengths[every[grow], at[grow]] += 1
            room[grow] += 1 << (longest - 1 - n[grow])
    while (room > 0).any():
        for rank in range(most):
            at = order[:, rank]
            n = lengths[every, at]
            cost = np.int64(1) << (longest - n)
            shrink = (n > 1) & (cost <= room)
            lengths[every[shrink], at[shrink]] -= 1
            room[shrink] -= cost[shrink]
    return lengths


def canonical(lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The codes of each row of lengths, with the first bit to read lowest."""
    out = np.zeros(lengths.shape, np.int64)
    code = np.zeros(len(lengths), np.int64)
    for n in range(1, longest + 1):
        code <<= 1
        own = lengths == n
        rank = np.cumsum(own, 1) - 1
        forward = code[:, None] + rank
        out[own] = REVERSED[(forward[own] << (LONGEST - n)) & ((1 << LONGEST) - 1)]
        code += own.sum(1)
    return out


def tables(lengths: np.ndarray, longest: int) -> np.ndarray:
    """For each row of lengths of a complete code, symbol * 16 + length by the next longest bits."""
    lane, symbol = np.nonzero(lengths)
    n = lengths[lane, symbol]
    code = canonical(lengths, longest)[lane, symbol]
    times = 1 << (longest - n)
    at = np.repeat(lane * (1 << longest) + code, times)
    at += (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)) << np.repeat(n, times)
    out = np.zeros(len(lengths) << longest, np.uint16)
    out[at] = np.repeat(symbol * 16 + n, times)
    return out


def whole_code(lengths: np.ndarray, longest: int) -> np.ndarray:
    """Which rows of lengths are complete codes of two symbols or more."""
    ok = (lengths <= longest).all(1)
    return ok & (np.where((lengths > 0) & (lengths <= longest), 1 << (longest - np.minimum(lengths, longest)), 0).sum(1) == 1 << longest)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) of lengths and distances from 1 up."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, high - 1)
    second = (v >> np.maximum(high - 1, 0)) & 1
    return np.where(v < 4, v, 2 * high + second), np.where(v < 4, 0, v & ((np.int64(1) << n) - 1)), n


def bit_strings(lane: np.ndarray, value: np.ndarray, n: np.ndarray, lanes: int) -> list[bytes]:
    """The pairs (value, number of bits up to 56) of each lane, in order, as bytes; lanes must ascend."""
    some = n > 0
    lane, value, n = lane[some], value[some].astype(np.uint64), n[some]
    bits = np.bincount(lane, n, lanes).astype(np.int64)
    size = (bits + 7) >> 3
    start = 8 * (np.cumsum(size) - size)
    first = np.cumsum(bits) - bits
    at = np.cumsum(n) - n + (start - first)[lane]
    word, off = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(size.sum()) // 8 + 2, "<u8")
    if len(at):
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(value << off, heads)
        over = np.flatnonzero((at & 63) + n > 64)  # one pair a word at most reaches into the next
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - off[over])
    raw = out.tobytes()
    ends = np.cumsum(size).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def header_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, value, bits) of the pairs that write each row of lengths as a normal code; zeros go in runs."""
    lanes, size = lengths.shape
    own_codes = canonical(OWN[None])[0]
    head = [(0, 1), (len(CODE_LENGTH_ORDER) - 4, 4), *((int(OWN[s]), 3) for s in CODE_LENGTH_ORDER), (0, 1)]
    flat = lengths.reshape(-1)
    zero = flat == 0
    edge = np.zeros(len(flat), bool)
    edge[::size] = True
    first = zero & (edge | ~np.concatenate([[False], zero[:-1]]))
    begin = np.flatnonzero(first)
    last = zero & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([zero[1:], [False]]))
    run = np.flatnonzero(last) - begin + 1
    at, value, n = [np.flatnonzero(~zero)], [own_codes[flat[~zero]]], [OWN[flat[~zero]]]
    for _ in range(-(-size // 138) + 2):
        long, some, few = run >= 11, (run >= 3) & (run < 11), (run > 0) & (run < 3)
        part = np.where(long, np.minimum(run, 138), np.where(some, run, np.minimum(run, 1)))
        at.append(begin[run > 0])
        value.append(np.select([long, some, few], [own_codes[18] | (part - 11) << OWN[18], own_codes[17] | (part - 3) << OWN[17], own_codes[0]])[run > 0])
        n.append(np.select([long, some, few], [OWN[18] + 7, OWN[17] + 3, OWN[0]])[run > 0])
        begin, run = begin + part, run - part
    at, value, n = np.concatenate(at), np.concatenate(value), np.concatenate(n)
    lane = np.concatenate([np.repeat(np.arange(lanes), len(head)), at // size])
    place = np.concatenate([np.tile(np.arange(len(head)) - len(head), lanes), at % size])
    order = np.lexsort((place, lane))
    value = np.concatenate([np.tile([v for v, _ in head], lanes), value])
    n = np.concatenate([np.tile([b for _, b in head], lanes), n])
    return lane[order], value[order], n[order]


def riff(vp8l: bytes) -> bytes:
    pad = b"\0" * (len(vp8l) & 1)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(vp8l) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(vp8l)) + vp8l + pad


def _entropy(lane: np.ndarray, values: np.ndarray, lanes: int) -> np.ndarray:
    counts = np.bincount(lane * 256 + values, minlength=256 * lanes).reshape(lanes, 256).astype(np.float64)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return -(counts * np.log2(np.maximum(counts, 1) / total)).sum(1)


def _earlier(key: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one of equal key, if what ``same`` holds there is equal too; -1 for none."""
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    again &= (same[order[1:]] == same[order[:-1]]).all(-1)
    out = np.full(len(key), -1, np.int64)
    out[order[1:][again]] = order[:-1][again]
    return out


def _copies(lane: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references, apart from each other: runs of three pixels or more that came before in the lane."""
    count = len(pixels)
    if count < SHORTEST:
        return (np.zeros(0, np.int64),) * 3
    grams = np.stack([pixels[k : count - SHORTEST + 1 + k] for k in range(SHORTEST)], 1)
    inside = lane[SHORTEST - 1 :] == lane[: count - SHORTEST + 1]
    key = lane[: len(grams)].astype(np.uint64)
    for k in range(SHORTEST):
        key = (key ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.flatnonzero(inside)
    found = _earlier(key[place], np.concatenate([grams[place], lane[place][:, None]], 1))
    met = found >= 0
    at = place[met]
    far = at - place[found[met]]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(far) != 0)
    first = np.flatnonzero(new)
    start = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + SHORTEST if len(at) else at
    start[1:] = np.maximum(start[1:], end[:-1])  # what the run before covers
    # a reference is written for runs that are worth it: a short run far away costs as much as its literals
    keep = end - start >= SHORTEST
    return start[keep], (end - start)[keep], far[first][keep]


def encoded(images: list[bytes]) -> list[bytes]:
    """A WebP file for each image of up to 2048 pixels, 64 in a row, given as R, G and B of each."""
    out: list[bytes] = [b""] * len(images)
    plain = []
    for k, image in enumerate(images):
        pixels = _pixels_of(image)
        # no palette for what has too many colours in its first row already
        colours = np.unique(pixels) if len(np.unique(pixels[:WIDTH])) <= PALETTE else pixels
        if len(colours) <= PALETTE and len(colours) * PALETTE_SHARE <= len(image) // 3:
            out[k] = riff(palette_image(image, colours))
        else:
            plain.append(k)
    if plain:
        for k, stream in zip(plain, _lanes([images[k] for k in plain]), strict=True):
            out[k] = riff(stream)
    return out


def _pixels_of(image: bytes) -> np.ndarray:
    rgb = np.frombuffer(image, np.uint8).reshape(-1, 3).astype(np.uint32)
    return rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]


def _lanes(images: list[bytes]) -> list[bytes]:
    lanes = len(images)
    sizes = np.array([len(x) // 3 for x in images])
    rgb = np.frombuffer(b"".join(images), np.uint8).reshape(-1, 3).copy()
    lane = np.repeat(np.arange(lanes), sizes)
    less = rgb - rgb[:, 1:2]
    cheaper = _entropy(lane, less[:, 0], lanes) + _entropy(lane, less[:, 2], lanes) < _entropy(lane, rgb[:, 0], lanes) + _entropy(lane, rgb[:, 2], lanes)
    use = cheaper[lane]
    rgb[use, 0], rgb[use, 2] = less[use, 0], less[use, 2]
    wide = rgb.astype(np.uint32)
    pixels = OPAQUE | wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]
    start, length, far = _copies(lane, pixels)
    slot = (np.uint32(CACHE_FACTOR) * pixels) >> np.uint32(32 - CACHE_BITS)
    held = _earlier(lane * (1 << CACHE_BITS) + slot, pixels[:, None]) >= 0
    covered = np.zeros(len(pixels) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + length, -1)
    copied = np.cumsum(covered)[:-1] > 0
    begins = ~copied
    begins[start] = True
    at = np.flatnonzero(begins)
    is_copy = copied[at]
    named = held[at] & ~is_copy
    literal = ~is_copy & ~named
    green = np.where(named, 280 + slot[at].astype(np.int64), rgb[at, 1].astype(np.int64))
    length_symbol, length_extra, length_n = prefix_of(length)
    far_symbol, far_extra, far_n = prefix_of(far + FARTHEST)
    green[is_copy] = 256 + length_symbol
    own = lane[at]

    def counted(symbols: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(of * size + symbols, minlength=size * lanes).reshape(lanes, size)

    lit = at[literal]
    red, blue = rgb[lit, 0].astype(np.int64), rgb[lit, 2].astype(np.int64)
    codes = [code_lengths(counted(green, own, GREENS)), code_lengths(counted(red, lane[lit], 256)), code_lengths(counted(blue, lane[lit], 256))]
    far_lengths = code_lengths(counted(far_symbol, lane[start], 40))
    without = np.bincount(lane[start], minlength=lanes) == 0  # lanes that copy nothing
    green_code, red_code, blue_code, far_code = (canonical(x) for x in (*codes, far_lengths))
    value, n = green_code[own, green], codes[0][own, green]
    of = lane[lit]
    value[literal] |= (red_code[of, red] | blue_code[of, blue] << codes[1][of, red]) << n[literal]
    n[literal] += codes[1][of, red] + codes[2][of, blue]
    of = lane[start]
    value[is_copy] |= (length_extra | (far_code[of, far_symbol] | far_extra << far_lengths[of, far_symbol]) << length_n) << n[is_copy]
    n[is_copy] += length_n + far_lengths[of, far_symbol] + far_n

    every = np.arange(lanes)
    parts: list[tuple] = []  # (lane, value, bits), in the order of the stream

    def put(values, bits) -> None:
        parts.append((every, np.broadcast_to(values, lanes).astype(np.int64), np.broadcast_to(bits, lanes).astype(np.int64)))

    put(0x2F, 8)
    put(WIDTH - 1, 14)
    put(sizes // WIDTH - 1, 14)
    put(0, 4)  # no alpha, version 0
    put(np.where(cheaper, 0b101, 0), np.where(cheaper, 3, 0))  # subtract green
    put(0, 1)  # no more transforms
    put(1 | CACHE_BITS << 1, 5)
    put(0, 1)  # one group of codes
    parts += [header_of(x) for x in codes]
    put(0b101 | 255 << 3, 11)  # alpha: the one symbol 255
    put(np.where(without, 0b0001, 0), np.where(without, 4, 0))  # distance: the one symbol 0
    held_lane, held_value, held_n = header_of(far_lengths[~without])
    parts.append((every[~without][held_lane] if len(held_lane) else held_lane, held_value, held_n))
    parts.append((own, value, n))
    all_lane, all_value, all_n = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((rank, all_lane))  # stable within a part
    return bit_strings(all_lane[order], all_value[order], all_n[order], lanes)


def palette_image(image: bytes, colours: np.ndarray) -> bytes:
    """The VP8L stream of an image of few colours: a palette, several pixels in a byte, back-references to whole runs."""
    pixels = _pixels_of(image)
    rows, count = len(pixels) // WIDTH, len(colours)
    shift = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
    index = np.searchsorted(colours, pixels).reshape(rows, WIDTH >> shift, 1 << shift)
    packed = (index << (np.arange(1 << shift) * (8 >> shift))).sum(-1).reshape(-1)
    start, length, far = _copies(np.zeros(len(packed), np.int64), packed.astype(np.uint32))
    parts: list[tuple[int, int]] = [(0x2F, 8), (WIDTH - 1, 14), (rows - 1, 14), (0, 4), (0b111, 3), (count - 1, 8)]

    def code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = code_lengths(counts[None])
        _, value, n = header_of(lengths)
        parts.extend(zip(value.tolist(), n.tolist(), strict=True))
        return lengths[0], canonical(lengths)[0]

    rgb = np.stack([colours >> 16 & 255, colours >> 8 & 255, colours & 255], 1).astype(np.uint8)
    steps = np.diff(rgb, axis=0, prepend=np.zeros((1, 3), np.uint8))
    parts.append((0, 1))  # the palette's pixels: no cache
    three = [code(np.bincount(steps[:, c], minlength=280 if c == 1 else 256)) for c in (1, 0, 2)]
    # the first colour's alpha is 255 and the others differ by 0: a code of the two symbols 0 and 255
    parts += [(0b111 | 0 << 3 | 255 << 11, 19), (0b0001, 4)]
    for k, step in enumerate(steps.tolist()):
        for (lengths, codes), s in zip(three, (step[1], step[0], step[2]), strict=True):
            parts.append((int(codes[s]), int(lengths[s])))
        parts.append((int(k == 0), 1))
    parts += [(0, 1), (0, 1), (0, 1)]  # no more transforms, no cache, one group
    symbols, extra, extra_n = prefix_of(length)
    far_symbols, far_extra, far_n = prefix_of(far + FARTHEST)
    counts = np.bincount(256 + symbols, minlength=280)
    tokens: list[tuple[int, int]] = []
    at = 0
    for k, s in enumerate([*start.tolist(), len(packed)]):
        tokens += [(p, -1) for p in packed[at:s].tolist()]
        if k < len(start):
            tokens.append((256 + int(symbols[k]), k))
            at = s + int(length[k])
    counts += np.bincount([t for t, k in tokens if k < 0], minlength=280)
    lengths, codes = code(counts)
    parts += [(0b0001, 4), (0b0001, 4), (0b101 | 255 << 3, 11)]  # red 0, blue 0, alpha 255
    far_lengths, far_codes = code(np.bincount(far_symbols, minlength=40))
    for t, k in tokens:
        parts.append((int(codes[t]), int(lengths[t])))
        if k >= 0:
            parts += [(int(extra[k]), int(extra_n[k])), (int(far_codes[far_symbols[k]]), int(far_lengths[far_symbols[k]])), (int(far_extra[k]), int(far_n[k]))]
    value, n = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    return bit_strings(np.zeros(len(parts), np.int64), value, n, 1)[0]


class _Reader:
    """The bits of many streams, each at a place of its own."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        raw = b"".join(streams) + b"\0" * 16
        self.words = np.ndarray((len(raw) - 8,), "<u8", raw, 0, (1,))  # eight bytes from every byte on
        self.at = 8 * (np.cumsum(sizes) - sizes)
        self.ends = self.at + 8 * sizes

    def peek(self, lanes) -> np.ndarray:
        at = self.at[lanes]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7).astype(np.uint64)

    def read(self, lanes, n) -> np.ndarray:
        value = (self.peek(lanes) & ((np.uint64(1) << np.asarray(n).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        self.at[lanes] += n
        return value


def _read_lengths(bits: _Reader, lanes: np.ndarray, sizes: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Code lengths (lanes x most of sizes) of normal codes; clears ok of those that aren't of the lanes' kind."""
    ok[lanes] &= bits.read(lanes, 1) == 0
    own = np.zeros((len(lanes), 19), np.int64)
    upto = 4 + bits.read(lanes, 4)
    for k, symbol in enumerate(CODE_LENGTH_ORDER):
        more = np.flatnonzero(k < upto)
        own[more, symbol] = bits.read(lanes[more], 3)
    good = whole_code(own, 7)
    good &= bits.read(lanes, 1) == 0
    ok[lanes] &= good
    own[~good] = np.array([1, 1] + [0] * 17)
    table = tables(own, 7)
    out = np.zeros((len(lanes), int(sizes.max(initial=0)) + 256), np.int64)
    at, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), 8)
    active = np.flatnonzero(ok[lanes])
    while len(active):
        ahead = bits.peek(lanes[active])
        found = table[(active << 7) + (ahead & np.uint64(127)).astype(np.int64)]
        n, symbol = (found & 15).astype(np.int64), (found >> 4).astype(np.int64)
        ahead >>= n.astype(np.uint64)
        plain = symbol < 16
        wide = np.select([symbol == 16, symbol == 17, symbol == 18], [2, 3, 7], 0)
        extra = (ahead & ((np.uint64(1) << wide.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        times = np.select([symbol == 16, symbol == 17, symbol == 18], [3 + extra, 3 + extra, 11 + extra], 1)
        value = np.where(plain, symbol, np.where(symbol == 16, last[active], 0))
        some = np.flatnonzero(value > 0)  # zeros stand there already
        for k in range(int(times[some].max(initial=0))):
            more = some[k < times[some]]
            out[active[more], at[active[more]] + k] = value[more]
        last[active] = np.where(plain & (symbol > 0), symbol, last[active])
        bits.at[lanes[active]] += n + wide
        at[active] += times
        over = at[active] > sizes[active]
        ok[lanes[active[over]]] = False
        active = active[at[active] < sizes[active]]
    return out[:, : int(sizes.max(initial=0))]


def decoded(files: list[bytes]) -> list[bytes]:
    """R, G and B of every pixel of each WebP file."""
    streams = [f[20 : 20 + int.from_bytes(f[16:20], "little")] for f in files]
    out: list[bytes] = [b""] * len(files)
    done = _decode_lanes(streams, out)
    for k in np.flatnonzero(~done).tolist():
        out[k] = decode_vp8l(streams[k])[..., 1:].tobytes()
    return out


def _decode_lanes(streams: list[bytes], out: list[bytes]) -> np.ndarray:
    """Fills in the images of the writer's plain structure; returns which these are."""
    bits = _Reader(streams)
    count = len(streams)
    every = np.arange(count)
    ok = bits.ends - bits.at > 12 * 8
    ok &= bits.read(every, 8) == 0x2F
    width, height = bits.read(every, 14) + 1, bits.read(every, 14) + 1
    ok &= (bits.read(every, 4) == 0) & (width * height <= WIDTH * MAX_ROWS)
    green_less = (bits.peek(every) & np.uint64(7)) == 0b101
    bits.at[every] += np.where(green_less, 3, 0)
    ok &= bits.read(every, 1) == 0
    cached = bits.read(every, 5)
    ok &= (cached & 1 == 1) & (cached >> 1 <= 11) & (cached >> 1 > 0)
    ok &= bits.read(every, 1) == 0
    lanes = np.flatnonzero(ok)
    if not len(lanes):
        return ok
    cache_bits = cached >> 1
    size = np.full(count, 256)
    kinds = []
    for kind in range(3):
        lanes = np.flatnonzero(ok)
        lengths = _read_lengths(bits, lanes, (280 + (1 << cache_bits[lanes])) if kind == 0 else size[lanes], ok)
        good = whole_code(lengths, LONGEST)
        ok[lanes] &= good
        full = np.zeros((count, lengths.shape[1]), np.int64)
        full[lanes] = lengths
        kinds.append(full)
    lanes = np.flatnonzero(ok)
    ok[lanes] &= bits.read(lanes, 11) == 0b101 | 255 << 3
    simple = ok & ((bits.peek(every) & np.uint64(15)) == 1)
    bits.at[simple] += 4
    lanes = np.flatnonzero(ok & ~simple)
    far_lengths = np.zeros((count, 40), np.int64)
    if len(lanes):
        own = _read_lengths(bits, lanes, np.full(len(lanes), 40), ok)
        ok[lanes] &= whole_code(own, LONGEST)
        far_lengths[lanes] = own
    lanes = np.flatnonzero(ok)
    if not len(lanes):
        return ok
    green_table, red_table, blue_table = (tables(x[lanes], LONGEST) for x in kinds)
    far_table = tables(far_lengths[lanes], LONGEST)
    total = (width * height)[lanes]
    base = np.cumsum(total) - total
    pixels = np.zeros(int(total.sum()), np.uint32)
    slots = int(cache_bits[lanes].max())
    cache = np.zeros(len(lanes) << slots, np.uint32)
    shift = (32 - cache_bits[lanes]).astype(np.uint32)
    at = np.zeros(len(lanes), np.int64)
    mask = np.uint64((1 << LONGEST) - 1)
    factor = np.uint32(CACHE_FACTOR)
    place, ends = bits.at[lanes], bits.ends[lanes]
    view = bits.words
    active = np.arange(len(lanes))
    failed = np.zeros(len(lanes), bool)
    while len(active):
        p = place[active]
        ahead = view[p >> 3] >> (p & 7).astype(np.uint64)
        found = green_table[(active << LONGEST) + (ahead & mask).astype(np.int64)]
        symbol, used = found >> 4, (found & 15).astype(np.int64)
        ahead = ahead >> (found & 15)
        is_literal = symbol < 256
        row = np.flatnonzero(is_literal)
        if len(row):
            who, rest = active[row], ahead[row]
            red = red_table[(who << LONGEST) + (rest & mask).astype(np.int64)]
            n = red & 15
            rest = rest >> n
            blue = blue_table[(who << LONGEST) + (rest & mask).astype(np.int64)]
            used[row] += n + (blue & 15)
            colour = (OPAQUE | (red >> 4).astype(np.uint32) << 16 | symbol[row].astype(np.uint32) << 8 | (blue >> 4).astype(np.uint32)).astype(np.uint32)
            pixels[base[who] + at[who]] = colour
            cache[(who << slots) + ((factor * colour) >> shift[who])] = colour
            at[who] += 1
        if len(row) < len(active):
            row = np.flatnonzero(symbol >= 280)
            who = active[row]
            colour = cache[(who << slots) + (symbol[row].astype(np.int64) - 280)]
            pixels[base[who] + at[who]] = colour  # the cache holds it already
            at[who] += 1
            row = np.flatnonzero(~is_literal & (symbol < 280))
            if len(row):
                who, rest = active[row], ahead[row]
                s = symbol[row].astype(np.int64) - 256
                n = np.where(s < 4, 0, (s - 2) >> 1)
                length = np.where(s < 4, s + 1, ((2 + (s & 1)) << n) + (rest & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1)
                rest = rest >> n.astype(np.uint64)
                far = far_table[(who << LONGEST) + (rest & mask).astype(np.int64)]
                s, m = (far >> 4).astype(np.int64), (far & 15).astype(np.int64)
                rest = rest >> m.astype(np.uint64)
                k = np.where(s < 4, 0, (s - 2) >> 1)
                distance = np.where(s < 4, s + 1, ((2 + (s & 1)) << k) + (rest & ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1) - FARTHEST
                used[row] += (n + m + k).astype(used.dtype)
                bad = (distance < 1) | (distance > at[who]) | (at[who] + length > total[who])
                failed[who[bad]] = True  # near distances have a map of their own, which the general decoder knows
                who, length, distance = who[~bad], length[~bad], distance[~bad]
                first = np.repeat(np.cumsum(length) - length, length)
                step = np.arange(len(first)) - first
                to = np.repeat(base[who] + at[who], length)
                by = np.repeat(distance, length)
                colour = pixels[to - by + step % by]
                pixels[to + step] = colour
                owner = np.repeat(who, length)
                cache[(owner << slots) + ((factor * colour) >> shift[owner])] = colour  # the last of equal places stays
                at[who] += length
        place[active] = p + used
        failed[active] |= place[active] > ends[active]
        active = active[(at[active] < total[active]) & ~failed[active]]
    ok[lanes[failed]] = False
    rgb = np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], 1).astype(np.uint8)
    add = np.repeat(green_less[lanes], total)
    rgb[add, 0] += rgb[add, 1]
    rgb[add, 2] += rgb[add, 1]
    raw = rgb.tobytes()
    for k, lane in enumerate(lanes.tolist()):
        if not failed[k]:
            out[lane] = raw[3 * int(base[k]) : 3 * int(base[k] + total[k])]
    return ok
