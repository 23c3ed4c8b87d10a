"""Corruptions of RGB images of 8 bits: whole stacks (images x height x width x 3) of one shape at a time.

Levels are cut to 0..255. Brightness, contrast and noise drop the fraction; filters and colour conversions round. Blurs mirror the
image about its outermost pixels. Results of the filters, the hue shift and the JPEG round trip may differ by a level from libraries
that compute in fixed point.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# The enabled corruptions in canonical order with kind, parameter and the beginning of the variant's id.
VARIANTS = (
    ("original", "none", None, "original"),
    ("bright", "brightness", 1.2, "brightness_increase"),
    ("dark", "brightness", 0.8, "brightness_decrease"),
    ("high_contrast", "contrast", 1.15, "contrast_increase"),
    ("low_contrast", "contrast", 0.85, "contrast_decrease"),
    ("gaussian_noise", "noise", 8, "gaussian_noise_sigma"),
    ("gaussian_blur", "blur", 5, "gaussian_blur_kernel"),
    ("stain_shift", "stain", 12, "stain_hue_shift"),
    ("defocus_blur", "blur", 7, "defocus_blur_kernel"),
    ("jpeg_compression", "compression", 45, "jpeg_quality"),
)
SEED = 42
# Gaussian kernels of the least odd sizes, in 256ths; the quantisation tables of JPEG at quality 50 (annex K).
KERNELS = {1: (256,), 3: (64, 128, 64), 5: (16, 64, 96, 64, 16), 7: (8, 28, 56, 72, 56, 28, 8)}
LUMINANCE = """
16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""


def _levels(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def brightness(x: np.ndarray, factor: float) -> np.ndarray:
    return _levels(x.astype(np.float32) * np.float32(factor))


def contrast(x: np.ndarray, factor: float) -> np.ndarray:
    """Away from or towards the mean of all of an image's levels."""
    f = x.astype(np.float32)
    mean = f.mean(axis=(1, 2, 3), keepdims=True)
    return _levels((f - mean) * np.float32(factor) + mean)


def noise(x: np.ndarray, sigma: float, seed: int = SEED) -> np.ndarray:
    """The same noise for every image of a shape, so that samples compare."""
    return _levels(x.astype(np.float32) + np.random.default_rng(seed).normal(0, sigma, x.shape[1:]).astype(np.float32))


def odd(size: int) -> int:
    if size < 1:
        raise ValueError(f"a kernel has a size of 1 at least, not {size}")
    return int(size) | 1


def gaussian(size: int) -> np.ndarray:
    if size in KERNELS:
        return np.array(KERNELS[size]) / 256
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a kernel, image by image and channel by channel."""
    r, (h, w) = len(kernel) // 2, x.shape[1:3]
    at = np.pad(x.astype(np.float64), ((0, 0), (r, r), (r, r), (0, 0)), mode="reflect")
    out = np.zeros(x.shape)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * at[:, i : i + h, j : j + w]
    return _levels(np.rint(np.round(out, 9)))


def blur(x: np.ndarray, size: int) -> np.ndarray:
    k = gaussian(odd(size))
    return filtered(x, np.outer(k, k))


def defocus(x: np.ndarray, size: int) -> np.ndarray:
    """A disc of equal weights."""
    r = odd(size) // 2
    i, j = np.ogrid[-r : r + 1, -r : r + 1]
    disc = (i * i + j * j <= r * r).astype(np.float64)
    return filtered(x, disc / disc.sum())


def hue_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in steps of two degrees (0..179), saturation and value in 0..255, all rounded."""
    r, g, b = (x[..., k].astype(np.int32) for k in range(3))
    value, least = x.max(-1).astype(np.int32), x.min(-1).astype(np.int32)
    spread = value - least
    turn = np.select([value == r, value == g], [g - b, b - r + 2 * spread], r - g + 4 * spread)
    hue = np.floor(30 * turn / np.maximum(spread, 1) + 0.5).astype(np.int32)
    saturation = np.floor(255 * spread / np.maximum(value, 1) + 0.5).astype(np.int32)
    return np.where(hue < 0, hue + 180, hue), saturation, value


def rgb_of(hue: np.ndarray, saturation: np.ndarray, value: np.ndarray) -> np.ndarray:
    sixth = hue / 30.0
    sector, part = np.floor(sixth).astype(np.int32) % 6, sixth - np.floor(sixth)
    s, v = saturation / 255.0, value.astype(np.float64)
    low, falling, rising = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    order = ((v, rising, low), (falling, v, low), (low, v, rising), (low, falling, v), (rising, low, v), (v, low, falling))
    return _levels(np.rint(np.stack([np.choose(sector, [o[k] for o in order]) for k in range(3)], -1)))


def stain(x: np.ndarray, shift: int) -> np.ndarray:
    hue, saturation, value = hue_of(x)
    return rgb_of((hue + shift) % 180, saturation, value)


def _quantised(plane: np.ndarray, table: str, quality: int) -> np.ndarray:
    """Each 8 x 8 block through the cosine transform, rounded to steps of the table, and back."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    step = np.clip((np.array(table.split(), np.int64).reshape(8, 8) * scale + 50) // 100, 1, 255)
    k, n = np.ogrid[:8, :8]
    dct = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    m, h, w = plane.shape
    blocks = plane.reshape(m, h // 8, 8, w // 8, 8).swapaxes(2, 3) - 128.0
    kept = np.rint(dct @ blocks @ dct.T / step) * step
    return np.clip(np.rint(dct.T @ kept @ dct + 128), 0, 255).swapaxes(2, 3).reshape(m, h, w)


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice as high and wide: three parts of the nearest and one of the next."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (1, 1)
        at = np.pad(plane, pad, mode="edge")
        n = plane.shape[axis]
        before, after = np.take(at, np.arange(n), axis), np.take(at, np.arange(2, n + 2), axis)
        both = np.stack([3 * plane + before, 3 * plane + after], axis + 1)
        plane = both.reshape([*plane.shape[:axis], 2 * n, *plane.shape[axis + 1 :]])
    return plane / 16


def jpeg(x: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG of this quality keeps, with colour at half the resolution. (Its coding of the rounded numbers loses nothing.)"""
    _, h, w, _ = x.shape
    f = np.pad(x.astype(np.float64), ((0, 0), (0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    r, g, b = (f[..., k] for k in range(3))
    luma = np.rint(0.299 * r + 0.587 * g + 0.114 * b)
    half = lambda p: np.rint(p.reshape(len(p), p.shape[1] // 2, 2, p.shape[2] // 2, 2).mean((2, 4)))
    blue, red = half(0.5 * b - 0.168735892 * r - 0.331264108 * g + 128), half(0.5 * r - 0.418687589 * g - 0.081312411 * b + 128)
    pad = lambda p: np.pad(p, ((0, 0), (0, -p.shape[1] % 8), (0, -p.shape[2] % 8)), mode="edge")
    luma = _quantised(luma, LUMINANCE, quality)
    blue, red = (np.rint(_doubled(_quantised(pad(p), CHROMINANCE, quality)))[:, : f.shape[1], : f.shape[2]] - 128 for p in (blue, red))
    out = np.stack([luma + 1.402 * red, luma - 0.344136286 * blue - 0.714136286 * red, luma + 1.772 * blue], -1)
    return _levels(np.rint(out))[:, :h, :w]


MAKE: dict[str, Callable] = {"original": lambda x, _: x, "bright": brightness, "dark": brightness, "high_contrast": contrast, "low_contrast": contrast, "gaussian_noise": noise, "gaussian_blur": blur, "stain_shift": stain, "defocus_blur": defocus, "jpeg_compression": jpeg}


def variant_id(name: str, parameter: float | None, head: str) -> str:
    return head if parameter is None else f"{head}_{parameter}"
