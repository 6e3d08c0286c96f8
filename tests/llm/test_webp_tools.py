"""The decoder on files that use each of the format's tools."""

import itertools
import random

import numpy as np
import pytest

from weft.llm import webp
from webp_writer import write


def picture(seed, height, width, colours):
    r = np.random.default_rng(seed)
    palette = r.integers(0, 256, (colours, 4), np.uint8)
    base = palette[r.integers(0, colours, (height, width))]
    base[height // 3 :, width // 3 :] = base[0, 0]  # runs
    return base


@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN), (webp.SUBTRACT_GREEN, webp.PREDICTOR)])
@pytest.mark.parametrize("how", [{}, {"copies": True}, {"cache_bits": 4}, {"cache_bits": 3, "copies": True, "groups": 3}, {"groups": 2}])
def test_tools(transforms, how):
    for seed, (h, w) in enumerate([(1, 1), (5, 7), (13, 22)]):
        rgba = picture(seed, h, w, 90)
        assert np.array_equal(webp.decode(write(rgba, transforms, seed, **how)), rgba)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    for seed, how in enumerate(({}, {"copies": True, "cache_bits": 2})):
        rgba = picture(seed, 9, 21, colours)
        assert np.array_equal(webp.decode(write(rgba, (webp.PALETTE,), seed, **how)), rgba)
        assert np.array_equal(webp.decode(write(rgba, (webp.PALETTE, webp.PREDICTOR), seed, **how)), rgba)


def test_long_copies_and_distances():
    rgba = np.tile(picture(0, 4, 40, 50), (20, 1, 1))
    assert np.array_equal(webp.decode(write(rgba, copies=True)), rgba)


def test_damaged_files_are_refused():
    data = write(picture(1, 8, 8, 30))
    for bad in (b"", b"RIFF", data[:30], data.replace(b"VP8L", b"VP8 "), data[:20] + b"\0" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.Code([1, 2])


def test_codes_are_complete_and_bounded():
    r = random.Random(0)
    for n, limit in itertools.product((2, 3, 40, 256), (9, 12)):
        lengths = webp.code_lengths(np.array([int(1.5 ** r.randint(0, 40)) for _ in range(n)]), limit)
        assert lengths.max() <= limit and sum(2.0**-x for x in lengths if x) == 1
