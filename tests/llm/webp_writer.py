"""An encoder that uses all tools of lossless WebP, to test the decoder with; it aims at coverage and not at size."""

import random

import numpy as np

from weft.llm import webp


def prefix(value):
    """(symbol, extra value, extra width) of a length or distance."""
    d = value - 1
    if d < 4:
        return d, 0, 0
    high = d.bit_length() - 1
    return 2 * high + (d >> (high - 1) & 1), d & ((1 << (high - 1)) - 1), high - 1


def tokens_of(pixels, width, cache_bits, copies, rnd):
    """Literals, copies and cached colours that give the pixels."""
    out, cache, i, n = [], {}, 0, len(pixels)
    seen = {}
    slot = lambda c: (webp.CACHE_FACTOR * c & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < n:
        best, back = 0, 0
        if copies:
            for j in seen.get(pixels[i], [])[-8:]:
                k = 0
                while i + k < n and pixels[j + k] == pixels[i + k] and k < 4000:
                    k += 1
                if k > best:
                    best, back = k, i - j
        if best >= 2:
            short = [c for c, (x, y) in enumerate(webp.OFFSETS, 1) if max(1, x + y * width) == back]
            out.append(("copy", best, rnd.choice(short) if short and rnd.random() < 0.8 else back + 120))
            step = best
        elif cache_bits and cache.get(slot(pixels[i])) == pixels[i]:
            out.append(("cache", slot(pixels[i])))
            step = 1
        else:
            out.append(("pixel", pixels[i]))
            step = 1
        for k in range(i, i + step):
            seen.setdefault(pixels[k], []).append(k)
            if cache_bits:
                cache[slot(pixels[k])] = pixels[k]
        i += step
    return out


def code(sizes, counts):
    lengths = webp.code_lengths(np.array([counts.get(s, 0) for s in range(sizes)]), 12)
    words = webp.codewords(lengths) if np.count_nonzero(lengths) > 1 else np.zeros(sizes, int)
    emit = lambda s: (int(words[s]), int(lengths[s]) if np.count_nonzero(lengths) > 1 else 0)
    used = np.flatnonzero(lengths)
    if len(used) == 2 and max(used) < 256:  # the short form of two symbols
        a, b = sorted(int(x) for x in used)
        fields = [(1, 1), (1, 1), (0, 1), (a, 1), (b, 8)] if a < 2 else [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]
    elif len(used) < 2 and (len(used) == 0 or used[0] < 256):
        fields = webp.code_fields(lengths)
    else:
        fields = webp.code_fields(lengths) if len(used) > 1 else None
    return fields, emit


def image(pixels, width, height, top, rnd, cache_bits=0, copies=False, groups=0):
    """Fields of entropy-coded pixels."""
    pixels = [int(p) for p in pixels]
    fields = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    block = 2
    per_row = (width + 3) >> 2
    group_of = [0]
    if top:
        if groups > 1:
            count = per_row * ((height + 3) >> 2)
            group_of = [rnd.randrange(groups) for _ in range(count)]
            group_of[0] = groups - 1
            fields += [(1, 1), (block - 2, 3), *image([0xFF000000 | g << 8 for g in group_of], per_row, (height + 3) >> 2, False, rnd)]
        else:
            fields.append((0, 1))
    tokens = tokens_of(pixels, width, cache_bits, copies, rnd)
    sizes = (webp.LITERALS + webp.LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, webp.DISTANCES)
    n_groups = max(group_of) + 1
    counts = [[{} for _ in range(5)] for _ in range(n_groups)]
    placed, at = [], 0
    add = lambda table, s: table.__setitem__(s, table.get(s, 0) + 1)
    for t in tokens:
        g = group_of[(at // width >> block) * per_row + (at % width >> block)] if n_groups > 1 else 0
        placed.append((g, t))
        if t[0] == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                add(counts[g][k], t[1] >> s & 255)
        elif t[0] == "copy":
            add(counts[g][0], 256 + prefix(t[1])[0])
            add(counts[g][4], prefix(t[2])[0])
        else:
            add(counts[g][0], 280 + t[1])
        at += t[1] if t[0] == "copy" else 1
    emitters = []
    for g in range(n_groups):
        row = []
        for k in range(5):
            if len(counts[g][k]) == 1 and next(iter(counts[g][k])) > 255:
                add(counts[g][k], 0)
            f, emit = code(sizes[k], counts[g][k])
            fields += f
            row.append(emit)
        emitters.append(row)
    for g, t in placed:
        green, red, blue, alpha, distance = emitters[g]
        if t[0] == "pixel":
            fields += [green(t[1] >> 8 & 255), red(t[1] >> 16 & 255), blue(t[1] & 255), alpha(t[1] >> 24)]
        elif t[0] == "copy":
            for emit, base, value in ((green, 256, t[1]), (distance, 0, t[2])):
                symbol, extra, bits = prefix(value)
                fields += [emit(base + symbol), (extra, bits)]
        else:
            fields.append(green(280 + t[1]))
    return fields


def argb(parts):
    return webp._join(np.asarray(parts))


def write(rgba, transforms=(), seed=0, **how):
    """A file of the picture; transforms are applied in the order given."""
    rnd = random.Random(seed)
    height, width, _ = rgba.shape
    parts = rgba[..., [3, 0, 1, 2]].astype(np.int32)
    fields = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]
    for kind in transforms:
        fields += [(1, 1), (kind, 2)]
        h, w = parts.shape[:2]
        cols, lines = (w + 3) >> 2, (h + 3) >> 2
        if kind == webp.SUBTRACT_GREEN:
            parts = parts.copy()
            for c in (1, 3):
                parts[..., c] = (parts[..., c] - parts[..., 2]) & 255
        elif kind == webp.CROSS_COLOUR:
            factors = np.array([[[255, *(rnd.randrange(256) for _ in range(3))] for _ in range(cols)] for _ in range(lines)])
            fields += [(0, 3), *image(argb(factors).ravel(), cols, lines, False, rnd)]
            signed = lambda v: v - 256 if v > 127 else v
            out = parts.copy()
            for y in range(h):
                for x in range(w):
                    _, red_blue, green_blue, green_red = (signed(int(v)) for v in factors[y >> 2, x >> 2])
                    _, r, g, b = (int(v) for v in parts[y, x])
                    out[y, x, 1] = (r - (green_red * signed(g) >> 5)) & 255
                    out[y, x, 3] = (b - (green_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5)) & 255
            parts = out
        elif kind == webp.PREDICTOR:
            modes = np.array([[rnd.randrange(14) for _ in range(cols)] for _ in range(lines)])
            fields += [(0, 3), *image((0xFF000000 | modes << 8).ravel(), cols, lines, False, rnd)]
            out = parts.copy()
            for y in range(h):
                for x in range(w):
                    if x == 0 and y == 0:
                        guess = np.array([255, 0, 0, 0])
                    elif y == 0:
                        guess = parts[0, x - 1]
                    elif x == 0:
                        guess = parts[y - 1, 0]
                    else:
                        guess = guessed(int(modes[y >> 2, x >> 2]), parts[y, x - 1], parts[y - 1, x], parts[y - 1, x + 1] if x + 1 < w else parts[y, 0], parts[y - 1, x - 1])
                    out[y, x] = (parts[y, x] - guess) & 255
            parts = out
        else:
            colours, index = np.unique(argb(parts).ravel(), return_inverse=True)
            table = webp._split(colours)
            steps = np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int32)) & 255
            fields += [(len(colours) - 1, 8), *image(argb(steps), len(colours), 1, False, rnd)]
            bundle = webp.bundle_bits(len(colours))
            packed = np.zeros((h, (w + (1 << bundle) - 1) >> bundle), np.int64)
            for i, v in enumerate(index.reshape(h, w).T):
                packed[:, i >> bundle] |= v << ((i & ((1 << bundle) - 1)) * (8 >> bundle))
            parts = np.stack([np.full_like(packed, 255), np.zeros_like(packed), packed, np.zeros_like(packed)], axis=-1).astype(np.int32)
    h, w = parts.shape[:2]
    fields += [(0, 1), *image(argb(parts).ravel(), w, h, True, rnd, **how)]
    table = np.array(fields)
    return webp.container(webp.put(table[:, 0], table[:, 1]))


def guessed(mode, left, top, top_right, top_left):
    """The fourteen predictors written out for one component at a time."""
    out = []
    sums = [sum(abs(int(t) - int(c)) for t, c in zip(top, top_left, strict=True)), sum(abs(int(a) - int(c)) for a, c in zip(left, top_left, strict=True))]
    for i in range(4):
        a, b, c, d = int(left[i]), int(top[i]), int(top_right[i]), int(top_left[i])
        half = (a + b) // 2
        out.append([
            (255, 0, 0, 0)[i], a, b, c, d, ((a + c) // 2 + b) // 2, (a + d) // 2, half, (d + b) // 2, (b + c) // 2, ((a + d) // 2 + (b + c) // 2) // 2,
            a if sums[0] < sums[1] else b, min(255, max(0, a + b - d)), min(255, max(0, half + int((half - d) / 2))),
        ][mode])
    return np.array(out)
