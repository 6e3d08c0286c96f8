"""Lossless WebP: a decoder for all of the format's tools, an encoder for payload rows, and the column operator.

The decoder reads prefix codes, back-references, the colour cache and groups of codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where one group of codes serves the whole image it first looks up the
symbol at every bit offset at once in numpy, then follows the chain of offsets that are in use; only back-references and
cached colours are replayed one by one.

The encoder writes literals under one code for the three channels, which is fast to read back. Where half of a payload's
pixels may repeat earlier ones, or its colours are few, it also tries back-references, alone, with a colour cache, and for up
to 16 colours with a palette of bundled pixels, and the smallest file is kept. Predictor, cross-colour and subtract-green transforms never made a
text smaller and are not written; they are decoded in files of others.

Payloads are images of 64 RGB pixels (192 bytes) a row. A payload of more than MAX_ROWS rows is several images, one after
the other; each begins with its own length, so the bytes can be cut again.

Defined cases: null text is the empty text; an empty text is one row of spaces; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
MAX_ROWS = 16383
#: Pixels of the shortest and the longest back-reference that is written, and the share of pixels that must repeat earlier ones.
LEAST, MOST, SHARE = 3, 4096, 0.5
#: Pixels for each colour from which an image counts as one of few colours.
FEW = 32

# Fixed values of the format (RFC 9649): order of code-length codes, extra bits of repeats, and the pixel
# offsets (x, y) that distance codes 1 to 120 stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
OFFSETS = (
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
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.padded = np.frombuffer(data + b"\0" * 8, np.uint8)
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image ends early")
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def windows(self) -> np.ndarray:
        """The next 15 bits at every bit offset from the current byte on."""
        tail = self.padded[self.at >> 3 :].astype(np.uint32)
        word = tail[:-2] | tail[1:-1] << np.uint32(8) | tail[2:] << np.uint32(16)
        return (word[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(0x7FFF)).ravel()


class Code:
    """A canonical prefix code as a lookup table: symbol * 16 + length at every value of the next bits."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        self.size = len(lengths)
        if len(used) < 2:
            self.bits, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4], np.int32)
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        widths = lengths[used]
        self.bits = int(widths[-1])
        spans = 1 << (self.bits - widths)
        ends = np.cumsum(spans)
        if ends[-1] != 1 << self.bits:
            raise ValueError("the prefix code is not complete")
        # table in order of the code read from its most significant bit; the stream has that bit first, so turn the index
        self.table = np.repeat(used << 4 | widths, spans)[reversed_bits(self.bits)].astype(np.int32)

    @classmethod
    def one(cls, symbol: int, size: int) -> Code:
        lengths = np.zeros(size, int)
        lengths[symbol] = 1
        return cls(lengths)

    def next(self, bits: Bits) -> int:
        found = int(self.table[bits.peek(self.bits)])
        bits.read(found & 15)
        return found >> 4


_turned: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits turned round."""
    if n not in _turned:
        x = np.zeros(1, np.int64)
        for _ in range(n):
            x = np.concatenate((2 * x, 2 * x + 1))
        _turned[n] = x
    return _turned[n]


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if several else [])
        lengths = np.zeros(max(size, 256), int)
        lengths[symbols] = 1
        return Code(lengths)
    first = np.zeros(19, int)
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, at, before = np.zeros(size, int), 0, 8
    while at < size and left:
        left -= 1
        symbol = code.next(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
        else:
            run = 3 + bits.read(2) if symbol == 16 else 3 + bits.read(3) if symbol == 17 else 11 + bits.read(7)
            if at + run > size:
                raise ValueError("a run of code lengths is too long")
            lengths[at : at + run] = before if symbol == 16 else 0
            at += run
    return Code(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = OFFSETS[code - 1]
    return max(1, x + y * width)


def _chain(follow: np.ndarray, start: int, n: int) -> np.ndarray:
    view, out, at = memoryview(follow), [0] * n, start
    for i in range(n):
        out[i] = at
        at = view[at]
    return np.array(out)


def _literals(bits: Bits, codes: list[Code], n: int) -> np.ndarray | None:
    """n pixels of one group, if all of them are literals."""
    green, red, blue, alpha, _ = codes
    if not any(c.bits for c in (green, red, blue, alpha)):
        if green.table[0] >> 4 >= LITERALS:
            return None
        return np.full(n, alpha.table[0] >> 4 << 24 | red.table[0] >> 4 << 16 | green.table[0] >> 4 << 8 | blue.table[0] >> 4, np.uint32)
    base = bits.at & ~7
    windows = bits.windows()
    last = len(windows) - 1
    place = np.arange(len(windows))
    found: dict[int, np.ndarray] = {}
    order = (green, red, blue, alpha)
    at = place
    steps = []
    for code in order:
        key = id(code)
        if code.bits == 0:
            steps.append(None)
            continue
        same = next((k for k in found if np.array_equal(found[k][0], code.table)), key)
        if same not in found:
            looked = code.table[windows & ((1 << code.bits) - 1)]
            found[same] = (code.table, looked, np.minimum(place + (looked & 15), last))
        _, looked, step = found[same]
        steps.append((looked, at))
        at = step if at is place else step[at]
    starts = _chain(np.ascontiguousarray(at), bits.at - base, n)
    pixels = np.zeros(n, np.uint32)
    for code, step, shift in zip(order, steps, (8, 16, 0, 24), strict=True):
        symbol = np.broadcast_to(code.table[0] >> 4, n) if step is None else step[0][step[1][starts]] >> 4
        if code is green and symbol.max(initial=0) >= LITERALS:
            return None
        pixels |= symbol.astype(np.uint32) << np.uint32(shift)
    end = base + int(at[starts[-1]])
    if end > bits.end:
        raise ValueError("the image ends early")
    bits.at = end
    return pixels


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    groups, block, per_row = None, 0, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        per_row = (width + (1 << block) - 1) >> block
        meta = read_pixels(bits, per_row, (height + (1 << block) - 1) >> block, False)
        groups = meta >> np.uint32(8) & np.uint32(0xFFFF)
    codes = [[read_code(bits, size) for size in (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    if groups is None and not cache_size:
        begun = bits.at
        pixels = _literals(bits, codes[0], n)
        if pixels is not None:
            return pixels
        bits.at = begun
    out = np.zeros(n, np.uint32)
    cache = [0] * cache_size
    cached = at = 0
    green, red, blue, alpha, distances = codes[0]
    while at < n:
        if groups is not None:
            green, red, blue, alpha, distances = codes[int(groups[(at // width >> block) * per_row + (at % width >> block)])]
        symbol = green.next(bits)
        if symbol < LITERALS:
            r, b, a = red.next(bits), blue.next(bits), alpha.next(bits)
            out[at] = a << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = _prefixed(symbol - LITERALS, bits)
            back = _distance(_prefixed(distances.next(bits), bits), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            done = 0
            while done < length:  # what is copied may overlap what is written; then it doubles
                step = min(length - done, back + done)
                out[at + done : at + done + step] = out[at - back : at - back + step]
                done += step
            at += length
        else:
            while cached < at:  # the cache is brought up to date only when it is read
                colour = int(out[cached])
                cache[(CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
                cached += 1
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return out


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(np.uint32)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """Predicted components of one pixel; the arguments are its neighbours' components."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode == 11:
        by_left = np.abs(top - top_left).sum()
        by_top = np.abs(left - top_left).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        average = mean(left, top)
        difference = average - top_left
        return np.clip(average + np.where(difference < 0, -((-difference) >> 1), difference >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left),
        7: lambda: mean(left, top), 8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def neighbours(image: np.ndarray, y: int, x: int):
    """Left, top, top right and top left; right of the last column is this row's first pixel."""
    width = image.shape[1]
    right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
    return image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1]


def mode_at(image_mode: np.ndarray, block: int, y: int, x: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(image_mode[y >> block, x >> block])


def undo_predictor(argb: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    image = _split(argb)
    height, width = argb.shape
    modes = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, (width + (1 << block) - 1) >> block)
    for y in range(height):
        for x in range(width):
            mode = mode_at(modes, block, y, x)
            guess = np.array([255, 0, 0, 0]) if mode == 0 else image[0, x - 1] if y == 0 else image[y - 1, 0] if x == 0 else predict(mode, *neighbours(image, y, x))
            image[y, x] = (image[y, x] + guess) & 255
    return _join(image)


def colour_delta(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    signed = lambda x: (x & 255 ^ 128) - 128
    return signed(factor) * signed(value) >> 5


def undo_cross_colour(argb: np.ndarray, block: int, factors: np.ndarray) -> np.ndarray:
    height, width = argb.shape
    factors = _split(factors.reshape(-1, (width + (1 << block) - 1) >> block))
    factors = factors.repeat(1 << block, axis=0).repeat(1 << block, axis=1)[:height, :width]
    image = _split(argb)
    red_to_blue, green_to_blue, green_to_red = factors[..., 1], factors[..., 2], factors[..., 3]
    image[..., 1] = (image[..., 1] + colour_delta(green_to_red, image[..., 2])) & 255
    image[..., 3] = (image[..., 3] + colour_delta(green_to_blue, image[..., 2]) + colour_delta(red_to_blue, image[..., 1])) & 255
    return _join(image)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    image = _split(argb)
    image[..., 1] += image[..., 2]
    image[..., 3] += image[..., 2]
    return _join(image)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    bundle = bundle_bits(len(table))
    index = argb >> np.uint32(8) & np.uint32(255)
    if bundle:
        depth = 8 >> bundle
        shifts = np.arange(1 << bundle, dtype=np.uint32) * np.uint32(depth)
        index = (index[:, :, None] >> shifts & np.uint32((1 << depth) - 1)).reshape(len(index), -1)[:, :width]
    return np.concatenate((table, np.zeros(256, np.uint32)))[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, RGBA) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(bytes(data[20 : 20 + size]))
    if bits.read(8) != 0x2F:
        raise ValueError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = (1 << block) - 1
            table = read_pixels(bits, (now + side) >> block, (height + side) >> block, False)
            undo.append((undo_predictor if kind == PREDICTOR else undo_cross_colour, (block, table)))
        elif kind == SUBTRACT_GREEN:
            undo.append((undo_subtract_green, ()))
        else:
            table = read_pixels(bits, bits.read(8) + 1, 1, False)
            table = _join(np.cumsum(_split(table), axis=0))
            undo.append((undo_palette, (now, table)))
            now = (now + (1 << bundle_bits(len(table))) - 1) >> bundle_bits(len(table))
    argb = read_pixels(bits, now, height, True).reshape(height, now)
    for f, args in reversed(undo):
        argb = f(argb, *args)
    return _split(argb)[..., [1, 2, 3, 0]].astype(np.uint8)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most limit bits."""
    counts = counts.astype(np.int64)
    while True:
        used = np.flatnonzero(counts)
        lengths = np.zeros(len(counts), np.int64)
        if len(used) < 2:
            lengths[used] = 1
            return lengths
        heap = [(int(counts[s]), i, (i,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth = [0] * len(used)
        serial = len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            members = a[2] + b[2]
            for i in members:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, members))
            serial += 1
        lengths[used] = depth
        if max(depth) <= limit:
            return lengths
        counts[used] = counts[used] // 2 + 1  # flatter counts, shallower tree


def codewords(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits in the order of the stream."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths[used[-1]])
    starts = np.cumsum(1 << (bits - lengths[used])) - (1 << (bits - lengths[used]))
    out = np.zeros(len(lengths), np.int64)
    out[used] = reversed_bits(bits)[starts]
    return out


def put(values: np.ndarray, widths: np.ndarray) -> bytes:
    """The values' bits after one another, each value of at most 32 bits."""
    ends = np.cumsum(widths)
    at = ends - widths
    word, shift = at >> 5, at & 31
    shifted = values.astype(np.uint64) << shift.astype(np.uint64)
    n = int(ends[-1] >> 5) + 2
    low = np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(word + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
    return (low + high).astype(np.uint64).astype("<u4").tobytes()[: int(ends[-1] + 7) >> 3]


def code_fields(lengths: np.ndarray) -> list[tuple[int, int]]:
    """A prefix code of at most 12 bits as (value, width) fields: 13 lengths and 3 repeats, all with codes of 4 bits."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        symbol = int(used[0]) if len(used) else 0
        return [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    fields = [(0, 1), (12, 4)]
    fields += [(0 if s in (13, 14, 15) else 4, 3) for s in LENGTH_ORDER[:16]]
    word = {s: int(w) for s, w in zip([*range(13), 16, 17, 18], reversed_bits(4), strict=True)}
    tokens, at, end = [], 0, int(used[-1]) + 1
    sizes = lengths[:end].tolist()
    while at < end:
        run = 1
        while at + run < end and sizes[at + run] == sizes[at]:
            run += 1
        if sizes[at] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append([(word[17], 4), (run - 3, 3)] if run <= 10 else [(word[18], 4), (run - 11, 7)])
        else:
            run = 1
            tokens.append([(word[sizes[at]], 4)])
        at += run
    width = 4 if len(tokens) - 2 < 16 else 10
    fields += [(1, 1), ((width - 2) // 2, 3), (max(0, len(tokens) - 2), width)]
    while len(tokens) < 2:
        tokens.append([(word[0], 4)])
    return fields + [f for t in tokens for f in t]


def container(stream: bytes) -> bytes:
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def prefixed(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    extra = high - 1
    return 2 * high + ((value - 1) >> extra & 1), (value - 1) & ((1 << extra) - 1), extra


_near: dict[int, dict[int, int]] = {}


def distance_code(distance: int, width: int) -> int:
    """The shortest code: of a pixel near by, or of the distance itself."""
    if width not in _near:
        _near[width] = {}
        for i, (x, y) in enumerate(OFFSETS):
            _near[width].setdefault(max(1, x + y * width), i + 1)
    return _near[width].get(distance, distance + len(OFFSETS))


def copies(pixels: np.ndarray) -> list[tuple[int, int, int]] | None:
    """(at, length, distance) of the parts that repeat earlier pixels, greedily; None where less than SHARE of them may."""
    n = len(pixels)
    if n < LEAST + 1:
        return None
    wide = pixels.astype(np.uint64)
    key = np.zeros(n - LEAST + 1, np.uint64)
    for i in range(LEAST):
        key = key * np.uint64(0x9E3779B97F4A7C15) + wide[i : n - LEAST + 1 + i]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if np.count_nonzero(same) < SHARE * n:
        return None
    before = np.full(len(key), -1)
    before[order[1:][same]] = order[:-1][same]
    starts = np.flatnonzero(before >= 0).tolist()
    out, at = [], 0
    for i in starts:
        if i < at:
            continue
        j = int(before[i])
        end = min(n, i + MOST)
        differ = pixels[i:end] != pixels[j : j + end - i]
        length = int(differ.argmax()) if differ.any() else end - i
        if length >= LEAST:
            out.append((i, length, i - j))
            at = i + length
    return out


def entropy_coded(pixels: np.ndarray, width: int, top: bool, parts: list[tuple[int, int, int]], cache_bits: int) -> tuple[list[int], list[int]]:
    """(values, widths) of the pixels' bits: prefix codes, then literals, cached colours and back-references."""
    cache: dict[int, int] = {}
    slots = (pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits) if cache_bits else None
    colours, slots = pixels.tolist(), slots.tolist() if cache_bits else []
    tokens, at = [], 0  # (green symbol, red, blue, extra, bits, distance symbol, extra, bits)
    for begin, length, distance in [*parts, (len(colours), 0, 0)]:
        for i in range(at, begin):
            colour = colours[i]
            if cache_bits and cache.get(slots[i]) == colour:
                tokens.append((LITERALS + LENGTHS + slots[i], -1, -1, 0, 0, -1, 0, 0))
            else:
                tokens.append((colour >> 8 & 255, colour >> 16 & 255, colour & 255, 0, 0, -1, 0, 0))
            if cache_bits:
                cache[slots[i]] = colour
        if length:
            symbol, extra, bits = prefixed(length)
            tokens.append((LITERALS + symbol, -1, -1, extra, bits, *prefixed(distance_code(distance, width))))
            if cache_bits:
                cache.update(zip(slots[begin : begin + length], colours[begin : begin + length], strict=True))
        at = begin + length
    x = np.array(tokens)
    counts = [np.bincount(x[:, i][x[:, i] >= 0], minlength=size) for i, size in ((0, LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)), (1, 256), (2, 256), (5, DISTANCES))]
    lengths = [code_lengths(c, 12) for c in counts]
    words = [codewords(v) if np.count_nonzero(v) > 1 else np.zeros(len(v), np.int64) for v in lengths]
    lengths = [v if np.count_nonzero(v) > 1 else np.zeros(len(v), np.int64) for v in lengths]
    fields = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    fields += [(0, 1)] * top
    green, red, blue, distances = (code_fields(code_lengths(c, 12)) for c in counts)
    fields += [*green, *red, *blue, (1, 1), (0, 1), (1, 1), (255, 8), *distances]
    put_symbol = lambda i, column: (np.where(x[:, column] >= 0, words[i][x[:, column]], 0), np.where(x[:, column] >= 0, lengths[i][x[:, column]], 0))
    order = [put_symbol(0, 0), put_symbol(1, 1), put_symbol(2, 2), (x[:, 3], x[:, 4]), put_symbol(3, 5), (x[:, 6], x[:, 7])]
    values, widths = (np.stack([o[k] for o in order], axis=1).ravel() for k in (0, 1))
    used = widths > 0
    return [f[0] for f in fields] + values[used].tolist(), [f[1] for f in fields] + widths[used].tolist()


def encode_repeats(samples: np.ndarray) -> bytes | None:
    """A file with back-references, and a colour cache or a palette where they make it smaller; None for few repeats of many colours."""
    height, width, _ = samples.shape
    wide = samples.astype(np.uint32)
    pixels = (0xFF000000 | wide[..., 0] << 16 | wide[..., 1] << 8 | wide[..., 2]).astype(np.uint32)
    parts = copies(pixels.ravel())
    table, index = np.unique(pixels, return_inverse=True)
    if parts is None and len(table) * FEW > pixels.size:
        return None
    parts = parts or []
    size = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)]
    found = []
    for cache_bits in (0, 4, 7):
        values, widths = entropy_coded(pixels.ravel(), width, True, parts, cache_bits)
        found.append(([f[0] for f in size] + [0] + values, [f[1] for f in size] + [1] + widths))
    if len(table) <= 16:
        bundle = bundle_bits(len(table))
        per, depth = 1 << bundle, 8 >> bundle
        now = -(-width // per)
        index = np.pad(index.reshape(height, width), ((0, 0), (0, now * per - width))).reshape(height, now, per)
        packed = (index << (np.arange(per) * depth)).sum(axis=2).astype(np.uint32)
        bundled = (np.uint32(0xFF000000) | packed << np.uint32(8)).ravel()
        deltas = _join(np.diff(_split(table), axis=0, prepend=np.zeros((1, 4), np.int32)))
        # the palette's pixels are deltas of alpha too, so theirs are written as literals with an alpha code
        head = palette_fields(deltas)
        values, widths = entropy_coded(bundled, now, True, copies(bundled) or [], 0)
        fields = [*size, (1, 1), (PALETTE, 2), (len(table) - 1, 8), *head, (0, 1)]
        found.append(([f[0] for f in fields] + values, [f[1] for f in fields] + widths))
    return min((container(put(np.array(v), np.array(w))) for v, w in found), key=len)


def palette_fields(deltas: np.ndarray) -> list[tuple[int, int]]:
    """The palette's differences as literals under four codes."""
    parts = _split(deltas)
    columns = [parts[:, i] for i in (2, 1, 3, 0)]  # green, red, blue, alpha
    lengths = [code_lengths(np.bincount(c, minlength=256), 12) for c in columns]
    fields = [(0, 1), *[f for v in lengths for f in code_fields(v)], (1, 1), (0, 1), (0, 1), (0, 1)]
    several = [np.count_nonzero(v) > 1 for v in lengths]
    words = [codewords(v) if m else None for v, m in zip(lengths, several, strict=True)]
    for row in zip(*columns, strict=True):
        fields += [(int(w[v]), int(n[v])) for v, w, n, m in zip(row, words, lengths, several, strict=True) if m]
    return fields


def encode_literals(samples: np.ndarray) -> bytes:
    """A file of RGB rows (height, width, 3): literals under one code for the three channels."""
    height, width, _ = samples.shape
    order = samples[..., [1, 0, 2]].ravel()
    lengths = code_lengths(np.bincount(order, minlength=256), 12)
    code = code_fields(lengths)
    fields = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), *code, *code, *code, (1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1)]
    head = np.array(fields)
    if np.count_nonzero(lengths) < 2:
        return container(put(head[:, 0], head[:, 1]))
    return container(put(np.concatenate((head[:, 0], codewords(lengths)[order])), np.concatenate((head[:, 1], lengths[order]))))


def encode_rows(samples: np.ndarray) -> bytes:
    """The smaller of a file of literals and, where enough pixels repeat, one that refers back."""
    plain, other = encode_literals(samples), encode_repeats(samples)
    return other if other is not None and len(other) < len(plain) else plain


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, CHANNELS)
    return b"".join(encode_rows(rows[i : i + MAX_ROWS]) for i in range(0, len(rows), MAX_ROWS))


def load(media: bytes) -> np.ndarray:
    """RGB rows of the images stored one after the other."""
    parts, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append(decode(media[at:end])[..., :3])
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % ROW if text else ROW)


def features(rows: np.ndarray) -> str:
    """Height, sum of each channel, and the sum of absolute steps along the rows."""
    sums = rows.sum(axis=(0, 1), dtype=np.int64)
    edges = int(np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{len(rows)}x{rows.shape[1]}:{sums[0]}:{sums[1]}:{sums[2]}:{edges}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text stored as lossless images, read back, and described by what was read."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media)}
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = store(payload_of(raw))
                rows = load(media)
                back = rows.tobytes()
                for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(rows), media), strict=False):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.binary() if k == "media" else pa.int64()) for k, v in out.items())], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT + ", media binary" * keep_media)
