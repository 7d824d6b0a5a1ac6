"""Lossless WebP: a decoder for the whole format, an encoder, and texts stored as images.

**Decoder.** Prefix codes (simple and normal, groups by an entropy image), back-references (with the near-distance
map), colour cache, and the inverse predictor, cross-colour, subtract-green and palette transforms (with packed
indices). Each image's codes are read from its own bytes. Pixels of many images are decoded in lockstep, one pixel of
all of them at a time, side images (palettes, predictor modes, cross-colour elements) too; only images with several
groups of codes are decoded one by one.

**Texts.** A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the RGB samples of images 64
pixels wide, of at most 64 rows each: longer texts make several images, in order, so that no image grows with the
text. The stored form is these files joined; sizes in their headers part them again. An image takes the one of palette
(at most 256 colours), predictor, cross-colour, subtract-green and no transform of fewest estimated bits, and a colour
cache where it is hit often. Copies of earlier pixels become back-references. Codes are in one group: fitted to the
image, or a standard group where that takes fewer bits, head included (small images). The decoder knows no standard
group: it parses what the bytes say, and remembers groups by their bits.

One scan, no shuffle; equal texts of a batch are stored and read once. Nulls: a null text is empty; a null id keeps its row. Equal texts give equal values. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Generator, Iterator
from functools import cache, cached_property, lru_cache
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from astrolith.llm.text import id_and_bytes

PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
#: Fixed values of the format: the order of code-length codes, and the offsets of the 120 near distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        a = self.at
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("image data ends early")
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


@cache
def _reversed(n: int) -> np.ndarray:
    """The numbers below 2^n with their n bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Code:
    """A canonical prefix code: symbol lengths, and (symbol << 4 | length) of each window of the stream."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        size = np.array(lengths)
        used = np.flatnonzero(size)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.single = int(used[0]) if len(used) == 1 else None
        self.codes = np.zeros(len(size), np.int64)
        if self.single is not None:
            self.mask = 0
        else:
            used = used[np.argsort(size[used], kind="stable")]
            n = size[used]
            longest = int(n[-1])
            room = 1 << (longest - n)
            ends = np.cumsum(room)
            if ends[-1] != 1 << longest:
                raise ValueError("a prefix code that isn't complete")
            self.codes[used] = _reversed(longest)[ends - room]
            self.parts = (used << 4 | n).astype(np.int32), room, longest
            self.mask = (1 << longest) - 1

    @cached_property
    def table(self) -> np.ndarray:
        if self.single is not None:
            return np.array([self.single << 4], np.int32)
        values, room, longest = self.parts
        return np.repeat(values, room)[_reversed(longest)]

    @cached_property
    def bits(self) -> np.ndarray:
        """Bits that each symbol takes."""
        return np.zeros(len(self.lengths), np.int64) if self.single is not None else np.array(self.lengths)

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        a = bits.at
        v = int(self.table[(int.from_bytes(bits.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7)) & self.mask])
        bits.at += v & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("image data ends early")
        return v >> 4

    def put(self, out: Writer, s: int) -> None:
        if self.single is None:
            out.put(int(self.codes[s]), self.lengths[s])


@lru_cache(1 << 10)
def code_of(lengths: bytes) -> Code:
    return Code(list(lengths))


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return code_of(bytes(lengths))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    code, at, before = code_of(bytes(own)), 0, 8
    table, mask, data, place = code.table.tolist(), code.mask, bits.data, bits.at
    while at < size and left:
        left -= 1
        w = int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7)
        v = table[w & mask]
        s, n = v >> 4, v & 15
        place += n
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value, extra, base = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
            n = base + ((w >> n) & ((1 << extra) - 1))
            place += extra
            if at + n > size:
                raise ValueError("too many code lengths")
            if value:
                lengths[at : at + n] = [value] * n
            at += n
    bits.at = place
    if place > 8 * len(data):
        raise ValueError("image data ends early")
    return code_of(bytes(lengths))


def write_code(out: Writer, lengths: list[int]) -> Code:
    value, n = _written(bytes(lengths))
    out.put(value, n)
    used = len(lengths) - lengths.count(0)
    return code_of(bytes(min(1, k) for k in lengths) if used == 2 and n <= 19 else bytes(lengths))


@lru_cache(1 << 10)
def _written(lengths: bytes) -> tuple[int, int]:
    """A code's lengths as bits, and their number."""
    out = Writer()
    used = [s for s, n in enumerate(lengths) if n] if len(lengths) - lengths.count(0) <= 2 else [256]
    if len(used) <= 2 and all(s < 256 for s in used):
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return out.value, out.n
    out.put(0, 1)
    tokens = []  # (symbol, extra bits, their value)
    for n, same in groupby(lengths):
        k = len(list(same))
        if n:
            tokens.append((n, 0, 0))
            k -= 1
        while k >= 3:
            if n:
                step, token = min(k, 6), (16, 2, min(k, 6) - 3)
            elif k <= 10:
                step, token = k, (17, 3, k - 3)
            else:
                step, token = min(k, 138), (18, 7, min(k, 138) - 11)
            tokens.append(token)
            k -= step
        tokens += [(n, 0, 0)] * k
    weights = [0] * 19
    for t in tokens:
        weights[t[0]] += 1
    own = huffman_lengths(weights, 7)
    count = max(4, 1 + max(k for k in range(19) if own[LENGTH_ORDER[k]]))
    out.put(count - 4, 4)
    for k in range(count):
        out.put(own[LENGTH_ORDER[k]], 3)
    out.put(0, 1)
    code = code_of(bytes(own))
    codes, sizes = code.codes.tolist(), code.bits.tolist()
    value = at = 0
    for t, extra, rest in tokens:
        n = sizes[t]
        value |= (codes[t] | rest << n) << at
        at += n + extra
    out.put(value, at)
    return out.value, out.n


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + ((v >> extra) & 1), extra, v & ((1 << extra) - 1)


def _prefixes(values: list[int]) -> np.ndarray:
    """The same of many values, as rows."""
    if not values:
        return np.zeros((3, 0), np.int64)
    v = np.array(values, np.int64) - 1
    extra = np.where(v < 4, 0, np.frexp(v.astype(np.float64))[1] - 2)
    return np.stack([np.where(v < 4, v, 2 * (extra + 1) + ((v >> extra) & 1)), extra, v & ((1 << extra) - 1)])


def read_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Groups of codes that were parsed before, by the size of the cache and their first 64 bits, with all of their bits.
_PARSED: dict[tuple[int, int], list[tuple[int, int, list[Code]]]] = {}


def _read_codes(bits: Bits, cache: int) -> list[Code]:
    """A group of codes. Parsing depends on its bits only, so a group with the same bits as an earlier one isn't parsed again."""
    a = bits.at
    peek = lambda n: (int.from_bytes(bits.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)
    known = _PARSED.get((cache, peek(64)), ())
    for n, value, codes in known:
        if a + n <= 8 * len(bits.data) and peek(n) == value:
            bits.at = a + n
            return codes
    codes = [read_code(bits, n) for n in (280 + cache, 256, 256, 256, 40)]
    if len(_PARSED) >= 512 or len(known) >= 8:
        _PARSED.clear()
    _PARSED.setdefault((cache, peek(64)), []).append((bits.at - a, peek(bits.at - a), codes))
    return codes


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width // (1 << shift))
        groups = (_read_pixels(bits, across, -(-height // (1 << shift)), False) >> 8) & 0xFFFF
    codes = [_read_codes(bits, len(cache)) for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    out, n, at = [0] * (width * height), width * height, 0
    noted = 0
    while at < n:
        g = codes[0] if groups is None else codes[int(groups[(at // width) >> shift, (at % width) >> shift])]
        s = g[0].read(bits)
        if s < 256:
            r, b, a = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = read_value(bits, s - 256)
            d = distance(read_value(bits, g[4].read(bits)), width)
            if d > at or at + length > n:
                raise ValueError("back-reference outside the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            while noted < at:
                cache[(CACHE_FACTOR * out[noted] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[noted]
                noted += 1
            out[at] = cache[s - 280]
            at += 1
        while cache and noted < at:
            cache[(CACHE_FACTOR * out[noted] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[noted]
            noted += 1
    return np.array(out, np.uint32).reshape(height, width)


def channels(p: np.ndarray) -> np.ndarray:
    """ARGB words as bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4).astype(np.int16)


def words(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view("<u4")[..., 0]


def _clamp(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, 255)


def predict(mode: int, left, top, corner, after) -> np.ndarray:
    """One pixel's prediction from its neighbours: left, top, top-left, top-right."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int16)
    if mode <= 4:
        return (left, top, after, corner)[mode - 1]
    if mode == 5:
        return avg(avg(left, after), top)
    if mode == 6:
        return avg(left, corner)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(corner, top)
    if mode == 9:
        return avg(top, after)
    if mode == 10:
        return avg(avg(left, corner), avg(top, after))
    if mode == 11:
        guess = left + top - corner
        return np.where(np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return _clamp(left + top - corner)
    mean = avg(left, top)
    return _clamp(mean + (np.abs(mean - corner) // 2) * np.sign(mean - corner))


#: Predictors that don't use the pixel to the left.
FROM_ABOVE = (0, 2, 3, 4, 8, 9, 14, 15)


def apply_predictor(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Differences from the predictions."""
    c = channels(p)
    h, w = p.shape
    mode = ((modes >> 8) & 15)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    guess = np.zeros_like(c)
    guess[0, 0] = [0, 0, 0, 255]
    guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
    left, top, corner = c[1:, :-1], c[:-1, 1:], c[:-1, :-1]
    after = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1) if w > 1 else top
    for m in np.unique(mode[1:, 1:]).tolist():
        guess[1:, 1:] = np.where((mode[1:, 1:] == m)[..., None], predict(m, left, top, corner, after), guess[1:, 1:])
    return words((c - guess) & 255)


def undo_predictor(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Row by row: what is predicted from above at once, what is predicted by the left pixel as sums, the rest in turn."""
    c = channels(p)
    h, w = p.shape
    c[0, 0] = (c[0, 0] + [0, 0, 0, 255]) & 255
    c[0] = np.cumsum(c[0], axis=0, dtype=np.int64) & 255
    kinds = ((modes >> 8) & 15).tolist()
    for y in range(1, h):
        row, up = c[y], c[y - 1]
        row[0] = (row[0] + up[0]) & 255
        after = np.concatenate([up[1:], row[:1]])  # of pixel x at x
        at = 1
        for mode, same in groupby(kinds[y >> shift]):
            end = min(w, ((at >> shift) + len(list(same))) << shift)
            if mode in FROM_ABOVE:
                row[at:end] = (row[at:end] + predict(mode, None, up[at:end], up[at - 1 : end - 1], after[at:end])) & 255
            elif mode == 1:
                row[at:end] = np.cumsum(row[at - 1 : end], axis=0, dtype=np.int64)[1:] & 255
            else:
                for x in range(at, end):
                    row[x] = (row[x] + predict(mode, row[x - 1], up[x], up[x - 1], after[x])) & 255
            at = end
    return words(c)


def undo_cross(p: np.ndarray, elements: np.ndarray, shift: int, forward: bool = False) -> np.ndarray:
    c = channels(p)
    h, w = p.shape
    e = channels(elements)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    signed = lambda v: ((v + 128) & 255) - 128
    delta = lambda t, v: (signed(t).astype(np.int32) * signed(v)) >> 5
    green, red, blue = c[..., 1], c[..., 2], c[..., 0]
    sign = -1 if forward else 1
    new_red = (red + sign * delta(e[..., 0], green)) & 255
    new_blue = (blue + sign * (delta(e[..., 1], green) + delta(e[..., 2], red if forward else new_red))) & 255
    c[..., 2], c[..., 0] = new_red, new_blue
    return words(c)


def undo_green(p: np.ndarray, forward: bool = False) -> np.ndarray:
    c = channels(p)
    sign = -1 if forward else 1
    for k in (0, 2):
        c[..., k] = (c[..., k] + sign * c[..., 1]) & 255
    return words(c)


def undo_palette(p: np.ndarray, palette: np.ndarray, pack: int, width: int) -> np.ndarray:
    index = (p >> 8) & 255
    if pack:
        bits = 8 >> pack
        x = np.arange(width)
        index = (index[:, x >> pack] >> ((x & ((1 << pack) - 1)) * bits)) & ((1 << bits) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def pack_of(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def image_steps(bits: Bits) -> Generator[tuple[int, int, bool], np.ndarray, np.ndarray]:
    """A VP8L chunk's pixels as ARGB words, (height, width). Asks for each pixel stream as (width, height, main)."""
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            shift = bits.read(3) + 2
            sub = yield -(-inner // (1 << shift)), -(-height // (1 << shift)), False
            steps.append((kind, sub, shift))
        elif kind == GREEN:
            steps.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            sub = yield n, 1, False
            colours = words(np.cumsum(channels(sub)[0].astype(np.int64), axis=0) & 255)
            steps.append((kind, (colours, inner), pack_of(n)))
            inner = -(-inner // (1 << pack_of(n)))
    p = yield inner, height, True
    for kind, sub, shift in reversed(steps):
        if kind == PREDICTOR:
            p = undo_predictor(p, sub, shift)
        elif kind == CROSS:
            p = undo_cross(p, sub, shift)
        elif kind == GREEN:
            p = undo_green(p)
        else:
            p = undo_palette(p, sub[0], shift, sub[1])
    return p


def decode_image(data: bytes) -> np.ndarray:
    """One chunk's pixels, symbol by symbol."""
    bits = Bits(data)
    steps = image_steps(bits)
    ask = next(steps)
    while True:
        try:
            ask = steps.send(_read_pixels(bits, *ask))
        except StopIteration as done:
            return done.value


def decode_images(chunks: list[bytes]) -> list[np.ndarray]:
    """The same for many chunks, in lockstep."""
    out: list[np.ndarray | None] = [None] * len(chunks)
    lanes = []
    for k, c in enumerate(chunks):
        bits = Bits(c)
        steps = image_steps(bits)
        lanes.append((k, bits, steps, next(steps)))
    while lanes:
        after = []
        for (k, bits, steps, _), p in zip(lanes, read_together([(bits, *ask) for _, bits, _, ask in lanes])):
            try:
                after.append((k, bits, steps, steps.send(p)))
            except StopIteration as done:
                out[k] = done.value
        lanes = after
    return out


NEAR_X, NEAR_Y = np.array(NEAR).T


def read_together(asked: list[tuple[Bits, int, int, bool]]) -> list[np.ndarray]:
    """A pixel stream (width, height, main) of each of the readers, as ``_read_pixels`` gives them."""
    out: list[np.ndarray | None] = [None] * len(asked)
    lanes = []
    for k, (bits, width, height, main) in enumerate(asked):
        at = bits.at
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11:
            raise ValueError("colour cache too large")
        if main and bits.read(1):
            bits.at = at
            out[k] = _read_pixels(bits, width, height, main)
        else:
            lanes.append((width * height, k, cache_bits, _read_codes(bits, 1 << cache_bits if cache_bits else 0)))
    if not lanes:
        return out
    lanes.sort(key=lambda x: (-x[0], x[1]))  # those that live at a step come first
    count = np.array([x[0] for x in lanes])
    width = np.array([asked[x[1]][1] for x in lanes])
    base = np.cumsum(count) - count
    sizes = np.array([len(asked[x[1]][0].data) for x in lanes])
    starts = np.cumsum(sizes + 16) - (sizes + 16)
    data = np.frombuffer(b"".join(asked[x[1]][0].data + b"\0" * 16 for x in lanes), np.uint8)
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    pos = starts * 8 + np.array([asked[x[1]][0].at for x in lanes])
    stop = (starts + sizes) * 8
    table, mask, off = [], [], []
    for j in range(5):  # lanes with equal codes share a table
        different = {id(x[3][j]): x[3][j] for x in lanes}
        ends = dict(zip(different, np.cumsum([c.mask + 1 for c in different.values()]).tolist()))
        table.append(np.concatenate([c.table for c in different.values()]))
        mask.append(np.array([x[3][j].mask for x in lanes]))
        off.append(np.array([ends[id(x[3][j])] for x in lanes]) - mask[-1] - 1)
    opaque = not mask[3].any()
    alpha = table[3][off[3]].astype(np.int64) >> 4 << 24
    cached = np.flatnonzero([x[2] > 0 for x in lanes])
    cache_size = np.array([1 << x[2] if x[2] else 0 for x in lanes])
    cache_base, cache_shift = np.cumsum(cache_size) - cache_size, np.array([32 - x[2] for x in lanes])
    memory = np.zeros(int(cache_size.sum()), np.int64)
    pixels = np.zeros(int(count.sum()), np.int64)
    left, dist = np.zeros(len(lanes), np.int64), np.ones(len(lanes), np.int64)
    copying = 0

    def window(at):
        return (view[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64)

    def symbol(j, lane, w):
        v = table[j][off[j][lane] + (w & mask[j][lane])].astype(np.int64)
        return v >> 4, v & 15

    def value(at, s):
        extra = np.where(s < 4, 0, (s - 2) >> 1)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + (window(at) & ((1 << extra) - 1)) + 1), at + extra

    for t, m in enumerate(np.searchsorted(-count, -np.arange(int(count[0]))).tolist()):
        lane = np.flatnonzero(left[:m] == 0) if copying else slice(0, m)
        at = pos[lane]
        w = window(at)
        s, n = symbol(0, lane, w)
        at = at + n
        if len(s) and s.max() >= 256:
            lane = np.arange(m)[lane]
            pos[lane] = at
            far = lane[(s >= 256) & (s < 280)]
            if len(far):
                length, a = value(pos[far], s[(s >= 256) & (s < 280)] - 256)
                code, step = symbol(4, far, window(a))
                code, pos[far] = value(a + step, code)
                k = np.minimum(code, 120) - 1
                d = np.where(code > 120, code - 120, np.maximum(1, NEAR_X[k] + NEAR_Y[k] * width[far]))
                if (d > t).any() or (t + length > count[far]).any():
                    raise ValueError("back-reference outside the image")
                left[far], dist[far] = length, d
                copying += len(far)
            hit = lane[s >= 280]
            pixels[base[hit] + t] = memory[cache_base[hit] + s[s >= 280] - 280]
            literal = s < 256
            lane, s, at, w, n = lane[literal], s[literal], at[literal], w[literal], n[literal]
        w = w >> n
        red, n = symbol(1, lane, w)
        blue, k = symbol(2, lane, w >> n)
        at = at + n + k
        if opaque:
            a = alpha[lane]
        else:
            a, n = symbol(3, lane, window(at))
            a, at = a << 24, at + n
        pixels[base[lane] + t] = a | red << 16 | s << 8 | blue
        pos[lane] = at
        if copying:
            far = np.flatnonzero(left[:m])
            to = base[far] + t
            pixels[to] = pixels[to - dist[far]]
            left[far] -= 1
            copying = int(np.count_nonzero(left[far]))
        if len(cached):
            some = cached[: int(np.searchsorted(cached, m))]
            p = pixels[base[some] + t]
            memory[cache_base[some] + ((CACHE_FACTOR * p & 0xFFFFFFFF) >> cache_shift[some])] = p
        if (pos[:m] > stop[:m]).any():
            raise ValueError("image data ends early")
    for (n, k, *_), b, at in zip(lanes, base.tolist(), (pos - starts * 8).tolist()):
        out[k] = pixels[b : b + n].astype(np.uint32).reshape(asked[k][2], asked[k][1])
        asked[k][0].at = at
    return out


def riff(chunk: bytes) -> bytes:
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def files(stored: bytes) -> Iterator[bytes]:
    """The VP8L chunks of WebP files that follow each other."""
    at = 0
    while at < len(stored):
        if stored[at : at + 4] != b"RIFF" or stored[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        size, chunk = struct.unpack("<I", stored[at + 4 : at + 8])[0], struct.unpack("<I", stored[at + 16 : at + 20])[0]
        yield stored[at + 20 : at + 20 + chunk]
        at += 8 + size


def decode(stored: bytes) -> list[np.ndarray]:
    """Pixel arrays (height, width, 4: red, green, blue, alpha) of the files."""
    return [channels(decode_image(x))[..., [2, 1, 0, 3]].astype(np.uint8) for x in files(stored)]


def huffman_lengths(weights: list[int], longest: int = 15) -> list[int]:
    """Code lengths by Huffman's rule; weights are flattened until no code is too long."""
    used = [k for k, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    flat = [weights[k] for k in used]
    while True:
        heap = [w << 16 | k for k, w in enumerate(flat)]
        heapq.heapify(heap)
        above, n = [0] * (2 * len(flat) - 1), len(flat)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, ((a >> 16) + (b >> 16)) << 16 | n)
            above[a & 65535] = above[b & 65535] = n
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= longest:
            for k, d in zip(used, depth):
                lengths[k] = d
            return lengths
        flat = [(w + 1) // 2 for w in flat]


def _slots(flat: np.ndarray, cache_bits: int) -> np.ndarray:
    return (CACHE_FACTOR * flat & 0xFFFFFFFF) >> (32 - cache_bits)


def _before(keys: np.ndarray) -> np.ndarray:
    """The last earlier place of an equal key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1)
    out[order[1:]] = np.where(keys[order[1:]] == keys[order[:-1]], order[:-1], -1)
    return out


def cache_hits(flat: np.ndarray, cache_bits: int) -> np.ndarray:
    """Whether the cache holds each pixel when it is its turn."""
    last = _before(_slots(flat, cache_bits).astype(np.uint16))  # narrow keys are sorted by their digits
    return (last >= 0) & (flat[last] == flat)


def _copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy copies (place, length, distance) of three pixels or more, from the last place with the same three."""
    if len(flat) < 4:
        return []
    mixed = (flat[:-2] * 0x9E3779B1) ^ (flat[1:-1] * 0x85EBCA77 << 8) ^ (flat[2:] * 0xC2B2AE3D << 16)
    last = _before((mixed >> 24).astype(np.uint16))
    out, at = [], 0
    same = (last >= 0) & (flat[last] == flat[:-2]) & (flat[last + 1] == flat[1:-1]) & (flat[last + 2] == flat[2:])
    places = np.flatnonzero(same)
    for i, j in zip(places.tolist(), last[places].tolist()):
        if i < at:
            continue
        end = min(len(flat), i + 4096)
        other = np.flatnonzero(flat[i:end] != flat[j : j + end - i])
        n = int(other[0]) if len(other) else end - i
        if n >= 3:
            out.append((i, n, i - j))
            at = i + n
    return out


def _write_pixels(out: Writer, p: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = True, hits: np.ndarray | None = None) -> None:
    """One group of codes fitted to the image; a greedy search for copies of earlier pixels."""
    flat, width = p.ravel().astype(np.int64), p.shape[1]
    found = _copies(flat) if copies else []
    keep = np.ones(len(flat), bool)
    for i, n, _ in found:
        keep[i + 1 : i + n] = False
    kind = np.zeros(len(flat), np.int64)  # pixel, cache, copy
    if cache_bits:
        kind[cache_hits(flat, cache_bits) if hits is None else hits] = 1
    kind[[i for i, _, _ in found]] = 2
    pixel, hit = np.flatnonzero(keep & (kind == 0)), np.flatnonzero(keep & (kind == 1))
    near = _near(width)
    far = np.array([i for i, _, _ in found], np.int64)
    lengths, gaps = np.split(_prefixes([n for _, n, _ in found] + [near.get(d, d + 120) for _, _, d in found]), 2, axis=1)
    values = [(flat[pixel] >> s) & 255 for s in (8, 16, 0, 24)]
    first = np.concatenate([values[0], 280 + _slots(flat[hit], cache_bits) if cache_bits else hit[:0], 256 + lengths[0]])
    weights = [np.bincount(v, minlength=size) for v, size in zip((first, *values[1:], gaps[0]), (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
    weights[1] = weights[2] = weights[1] + weights[2]  # one code for red and blue
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    every = np.concatenate([weights[0], weights[1], weights[3], weights[4]])
    used = every[every > 0]
    sums = np.array([max(1, int(weights[k].sum())) for k in (0, 1, 3, 4)])
    # Bits of the pixels by entropy, and about seven for each symbol's length in the head.
    fitting = 7 * len(used) + float((sums * np.log2(sums)).sum() - (used * np.log2(used)).sum())
    bits_of, standard = standard_codes(cache_bits)
    cost = bits_of @ every
    best = int(cost.argmin())
    if cost[best] * (1 - EFFORT) < fitting:
        codes, value, n = standard[best]
        out.put(value, n)
    else:
        codes = []
        for w in weights:
            if not w.any():
                w[0] = 1
            if len(codes) != 2:
                fitted = huffman_lengths(w.tolist(), LONGEST)
            codes.append(write_code(out, fitted))
    lens = [c.bits for c in codes]
    # The bits of each place (at most 60) as one number; then numbers are laid side by side in words of 64 bits.
    places = np.concatenate([pixel, hit, far])
    v, n = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    v[places], n[places] = codes[0].codes[first], lens[0][first]
    for k in (1, 2, 3):
        if codes[k].single is None:
            v[pixel] |= codes[k].codes[values[k]] << n[pixel]
            n[pixel] += lens[k][values[k]]
    for bits, size in ((lengths[2], lengths[1]), (codes[4].codes[gaps[0]], lens[4][gaps[0]]), (gaps[2], gaps[1])) if len(far) else ():
        v[far] |= bits << n[far]
        n[far] += size
    if found:
        v, n = v[keep], n[keep]
    ends = np.cumsum(n)
    pos, end = ends - n, int(ends[-1])
    word, at, v = pos >> 6, (pos & 63).astype(np.uint64), v.astype(np.uint64)
    packed = np.zeros(end // 64 + 2, np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    packed[word[starts]] = np.bitwise_or.reduceat(v << at, starts)
    last = np.r_[starts[1:], len(v)] - 1  # only a word's last number can reach into the next one
    over = last[at[last] > 0]
    packed[word[over] + 1] |= v[over] >> (np.uint64(64) - at[over])
    out.put(int.from_bytes(packed.astype("<u8").tobytes(), "little") & ((1 << end) - 1), end)


#: Longest fitted code, in bits.
LONGEST = 12
#: A group fitted to an image is taken if it saves more than this share of its bits: most of an encoder's time goes into fitted codes.
EFFORT = 0.12
#: Common words and endings of four languages, from whose bytes the standard codes of texts follow.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one there were been has when who will more ing ion tion ent er re, and the. ",
    "der die und das von zu den mit ist im des sich nicht ein eine auf dem für als auch werden aus bei einer um am sind noch nach über heit keit schaft ung lich sch ein, der ich. und die beheit ",
    "le la les de et à un une est que dans en pour du qui sur pas par au avec ment eux elle tion ion ê ç où mais plus tout ses son leur aux eau été, elle et. que ",
    "el los y del se las por con para su al lo como más o pero ción ado ciones mente señor año está qué también donde desde es ar er que, con los. para ",
)


@cache
def standard_codes(cache_bits: int) -> tuple[np.ndarray, list[tuple[list[Code], int, int]]]:
    """Groups of codes for small images, whose own codes would take more bits than they save: (bits of each symbol, with
    a prohibitive number where a group has no code; and the groups with their heads). Lower-case, upper-case and mixed
    text, any bytes, palette indices, and differences of sorted colours."""
    any_byte, slots = [1] * 256, [2] * (1 << cache_bits) if cache_bits else []
    text = lambda t: [1 + 16 * n for n in np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256).tolist()]
    only = lambda *at: [int(k in at) for k in range(256)]
    near = [1 + 256 // (1 + k) for k in range(256)]
    texts = [text(t) for t in (*COMMON, *map(str.upper, COMMON), "".join(COMMON) + "0123456789,.;:!?#$%&*-()\n" * 8)]
    groups = [(w, w, only(255), [k + 1 for k in range(24)][::-1]) for w in (*texts, any_byte)]
    groups += [(any_byte, only(0), only(255), [1] * 24), (any_byte, any_byte, only(0, 255), [1] * 24), (any_byte, near, only(0, 255), [1] * 24)]
    costs, out = [], []
    for green, other, alpha, copies in groups:
        head = Writer()
        codes = [write_code(head, huffman_lengths(w, LONGEST)) for w in (green + copies + slots, other, other, alpha, [1] * 40)]
        costs.append(np.concatenate([np.where(np.array(c.lengths) > 0, c.bits, 1 << 20) for c in (codes[0], codes[1], codes[3], codes[4])]))
        out.append((codes, head.value, head.n))
    return np.stack(costs), out


@cache
def _near(width: int) -> dict[int, int]:
    """The distance code of each near distance."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def encode_image(p: np.ndarray, transforms: tuple = (), cache_bits: int = 0, modes: np.ndarray | None = None, elements: np.ndarray | None = None, shift: int = 2, hits: np.ndarray | None = None) -> bytes:
    """ARGB words (height, width) as a VP8L chunk, after the named transforms in their order."""
    h, w = p.shape
    out = Writer()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS):
            side = (-(-p.shape[0] // (1 << shift)), -(-p.shape[1] // (1 << shift)))
            sub = modes if kind == PREDICTOR else elements
            sub = np.resize(np.array([0xFF000000], np.uint32) if sub is None else sub, side).astype(np.uint32)
            out.put(shift - 2, 3)
            _write_pixels(out, sub, False)
            p = apply_predictor(p, sub, shift) if kind == PREDICTOR else undo_cross(p, sub, shift, True)
        elif kind == GREEN:
            p = undo_green(p, True)
        else:
            colours, index = np.unique(p, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            index = index.reshape(p.shape).astype(np.uint32)
            out.put(len(colours) - 1, 8)
            c = channels(colours)
            _write_pixels(out, words(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int16)) & 255)[None, :], False)
            pack = pack_of(len(colours))
            if pack:
                per, bits = 1 << pack, 8 >> pack
                wide = np.zeros((p.shape[0], -(-p.shape[1] // per) * per), np.uint32)
                wide[:, : p.shape[1]] = index
                index = (wide.reshape(p.shape[0], -1, per) << (np.arange(per, dtype=np.uint32) * bits)).sum(axis=2).astype(np.uint32)
            p = np.uint32(0xFF000000) | (index << np.uint32(8))
    out.put(0, 1)
    _write_pixels(out, p, True, cache_bits, hits=hits)
    return out.bytes()


# Texts as images.

WIDTH, ROWS = 64, 64
UNIT = 3 * WIDTH
class Preset:
    """The fixed choices of text images."""

    #: Side of the blocks of predictor modes (8 pixels) and of cross-colour elements (the whole image), as shifts.
    predictor_shift, cross_shift = 3, 6
    cache_bits = 7


def estimated_bits(p: np.ndarray) -> float:
    """Entropy of the channels, each by itself."""
    c = channels(p).reshape(-1, 4)
    h = np.bincount((c + np.arange(0, 1024, 256, dtype=np.int16)).ravel(), minlength=1024)
    h = h[h > 0]
    return float(4 * len(c) * np.log2(len(c)) - (h * np.log2(h)).sum())


def predictor_modes(p: np.ndarray, preset: Preset) -> np.ndarray:
    """For each block the mode (left, top, top-right, top-left) that foretells most of its pixels, or 0 if none foretells half of them."""
    shift = preset.predictor_shift
    h, w = -(-p.shape[0] // (1 << shift)), -(-p.shape[1] // (1 << shift))
    best, here = np.zeros((h, w), np.int64), p[1:, 1:-1]
    near = [(m, here == there) for m, there in ((1, p[1:, :-2]), (2, p[:-1, 1:-1]), (3, p[:-1, 2:]), (4, p[:-1, :-2]))]
    near = [(m, same) for m, same in near if np.count_nonzero(same) >= 1 << shift >> 1]  # half of the smallest block
    if near:
        y, x = (np.minimum(1 << shift, n - (np.arange(k) << shift)) for n, k in ((p.shape[0], h), (p.shape[1], w)))
        most, right = y[:, None] * x // 2, np.zeros((h << shift, w << shift), bool)
    for m, same in near:
        right[1 : p.shape[0], 1 : p.shape[1] - 1] = same
        hits = right.reshape(h, 1 << shift, w, 1 << shift).sum((1, 3))
        best, most = np.where(hits > most, m, best), np.maximum(hits, most)
    return (0xFF000000 | best << 8).astype(np.uint32)


def cross_element(p: np.ndarray) -> np.ndarray:
    """Multipliers of green in red and in blue by least squares, and none of red in blue."""
    c = ((channels(p).reshape(-1, 4) + 128) & 255) - 128.0
    green = c[:, 1] - c[:, 1].mean()
    spread = max(1.0, float(green @ green))
    red, blue = (int(np.clip(np.rint(32 * float(green @ c[:, k]) / spread), -128, 127)) & 255 for k in (2, 0))
    return np.array([[0xFF000000 | blue << 8 | red]], np.uint32)


def _moments(px: np.ndarray) -> tuple[float, ...]:
    """Covariances of green with blue and red, and variances of blue, green, red."""
    c = px.reshape(-1, 3).T.astype(np.float64)
    red, green, blue = c - c.sum(axis=1, keepdims=True) / c.shape[1]
    return tuple(float((a * b).sum()) / c.shape[1] for a, b in ((green, blue), (red, green), (blue, blue), (green, green), (red, red)))


def encode_tile(samples: np.ndarray, preset: Preset) -> bytes:
    """RGB samples of rows of 64 pixels as one file."""
    px = samples.reshape(-1, WIDTH, 3).astype(np.uint32)
    p = np.uint32(0xFF000000) | px[..., 0] << np.uint32(16) | px[..., 1] << np.uint32(8) | px[..., 2]
    modes, element = predictor_modes(p, preset), None
    ways = []
    blue_green, red_green, blue, green, red = _moments(px)
    # A transform is tried if the spread that is left promises some bits.
    gain = lambda before, after: 0.5 * p.size * np.log2((before + 0.1) / (max(after, 0.0) + 0.1))
    if gain(red, red + green - 2 * red_green) + gain(blue, blue + green - 2 * blue_green) > 100:
        ways.append((estimated_bits(q := undo_green(p, True)), 1, (GREEN,), q, 2))
    if (modes & 0xFF00).any():
        q = apply_predictor(p, modes, preset.predictor_shift)
        ways.append((estimated_bits(q) + 4 * modes.size, 2, (PREDICTOR,), q, preset.predictor_shift))
    if green and gain(red, red - red_green**2 / green) + gain(blue, blue - blue_green**2 / green) > 200:
        element = cross_element(p)
        q = undo_cross(p, element, preset.cross_shift, True)
        ways.append((estimated_bits(q) + 32, 3, (CROSS,), q, preset.cross_shift))
    colours = len(np.unique(p))
    if colours <= 256:
        # An index for each pixel, or for two to eight; a colour's differences take about two bytes.
        ways.append((p.size * min(8, max(1, np.log2(colours))) / (1 << pack_of(colours) if colours <= 16 else 1) + 18 * colours, 4, (PALETTE,), p, 2))
    transforms, q, shift = (), p, 2
    if ways:
        _, _, transforms, q, shift = min([(estimated_bits(p), 0, (), p, 2), *ways], key=lambda x: x[:2])
    if transforms == (PALETTE,):
        return riff(encode_image(p, transforms))
    hits = cache_hits(q.ravel().astype(np.int64), preset.cache_bits)
    cached = np.count_nonzero(hits) >= 1 << (preset.cache_bits - 2)
    return riff(encode_image(p, transforms, preset.cache_bits if cached else 0, modes, element, shift, hits))


def encode_text(body: bytes, preset: Preset) -> tuple[bytes, int]:
    """(stored form, payload bytes)."""
    size = max(1, -(-len(body) // UNIT)) * UNIT
    data = np.frombuffer(body.ljust(size, b" "), np.uint8)
    return b"".join(encode_tile(data[a : a + UNIT * ROWS], preset) for a in range(0, size, UNIT * ROWS)), size


#: Images whose pixels are read in one lockstep.
LANES = 8192


def decode_tiles(chunks: list[bytes], preset: Preset) -> list[np.ndarray]:
    """RGB samples of each chunk."""
    out = []
    for a in range(0, len(chunks), LANES):
        out += [channels(p)[..., [2, 1, 0]].astype(np.uint8).ravel() for p in decode_images(chunks[a : a + LANES])]
    return out


def feature(payload: np.ndarray, stored: int) -> str:
    """Sums of the channels, the number of different pixels beside each other, and bits a sample."""
    px = payload.reshape(-1, 3).astype(np.int64)
    sums = px.sum(axis=0).tolist()
    edges = int((px[1:] != px[:-1]).any(axis=1).sum())
    return f"{len(px) // WIDTH}x{WIDTH}:{sums[0]}:{sums[1]}:{sums[2]}:{edges}:{8 * stored // len(payload)}"


#: Bytes of text that are stored and read back together.
TOGETHER = 12 << 20


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Per row ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media)``,
    all but n_bytes and media's own from the bytes read back."""
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        preset = Preset()

        def solve(ids, bodies):
            place = {b: k for k, b in enumerate(dict.fromkeys(bodies))}  # equal texts of a batch are stored and read once
            rows, bodies = [place[b] for b in bodies], list(place)
            stored = [encode_text(b, preset)[0] for b in bodies]
            chunks, of = [], []
            for k, x in enumerate(stored):
                found = list(files(x))
                chunks += found
                of += [k] * len(found)
            tiles = decode_tiles(chunks, preset)
            back: list[list[np.ndarray]] = [[] for _ in bodies]
            for k, t in zip(of, tiles):
                back[k].append(t)
            cols: list[list] = [[] for _ in names[1:]]
            for body, x, parts in zip(bodies, stored, back):
                payload = np.concatenate(parts)
                raw = payload.tobytes()
                row = [len(body), len(raw), sha256(raw).hexdigest(), crc32(raw[-16:]), len(x), sha256(x).hexdigest(), feature(payload, len(x)), x]
                for c, v in zip(cols, row):
                    c.append(v)
            return pa.record_batch([ids, *(pa.array(c).take(pa.array(rows)) for c in cols)], names=names)

        for b in batches:
            bodies, at, held = [], 0, 0
            for k, x in enumerate(b.column(1)):
                bodies.append(x.as_py() or b"")
                held += len(bodies[-1])
                if held >= TOGETHER:
                    yield solve(b.column(0).slice(at, k + 1 - at), bodies)
                    bodies, at, held = [], k + 1, 0
            if bodies:
                yield solve(b.column(0).slice(at), bodies)

    return rows.mapInArrow(run, schema)
