"""Images as NumPy arrays: decoding rows of Spark's image source, resizing, features, distances.

Arrays are height x width x 3, red first, float in [0, 1] unless said otherwise.
"""

from __future__ import annotations

from typing import Any

import numpy as np


#: How an image of each Exif orientation is turned upright.
UPRIGHT = {
    1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1],
    5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a),
}


def from_row(image: dict[str, Any], orientation: int = 1) -> np.ndarray:
    """A row of Spark's image source, whose bytes are blue first, as uint8, turned upright."""
    flat = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    rgb = np.repeat(flat, 3, axis=2) if image["nChannels"] == 1 else flat[:, :, 2::-1]
    return UPRIGHT[orientation](rgb)


def _cubic(t: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2."""
    t, a = np.abs(t), -0.5
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((t - 5) * t + 8) * t * a - 4 * a
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


def _weights(old: int, new: int) -> np.ndarray:
    """new x old weights: the kernel is widened when an image shrinks, so no pixel is skipped."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = _cubic((np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """uint8 to uint8, rows and columns in turn, rounded after each as 8-bit images are."""
    across = np.einsum("nw,hwc->hnc", _weights(image.shape[1], width), image.astype(float))
    across = np.clip(np.rint(across), 0, 255)
    down = np.einsum("nh,hwc->nwc", _weights(image.shape[0], height), across)
    return np.clip(np.rint(down), 0, 255).astype(np.uint8)


def square(image: np.ndarray, size: int) -> np.ndarray:
    """The shortest side to ``size``, then the middle square; floats."""
    height, width = image.shape[:2]
    if not height or not width:
        raise ValueError(f"no pixels: {image.shape}")
    scale = size / min(height, width)
    image = resize(image, round(width * scale), round(height * scale))
    top, left = (max(0, (n - size) // 2) for n in image.shape[:2])
    return image[top : top + size, left : left + size].astype(np.float32) / 255.0


def corner(image: np.ndarray) -> np.ndarray:
    return image[0, 0]


def pixel_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The root of the mean squared difference of all values."""
    return float(np.sqrt(np.mean((a.astype(float) - b) ** 2)))


def _box(a: np.ndarray, n: int) -> np.ndarray:
    """Means over n x n windows, by sums from the corner."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def ssim_distance(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """1 - structural similarity of channel means: uniform windows, sample covariances, whole windows only."""
    x, y = a.mean(axis=2, dtype=float), b.mean(axis=2, dtype=float)
    sample = window * window / (window * window - 1)
    mx, my = _box(x, window), _box(y, window)
    vx, vy, vxy = (sample * (_box(p * q, window) - m * n) for p, q, m, n in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = 0.01**2, 0.03**2
    found = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
    return float(1.0 - found.mean())


def _cells(values: np.ndarray, n: int) -> np.ndarray:
    """Means of n x n nearly equal cells, row by row."""
    edges = [np.cumsum([0] + [len(p) for p in np.array_split(np.arange(k), n)]) for k in values.shape[:2]]
    return np.concatenate([np.atleast_1d(values[t:b, left:r].mean(axis=(0, 1))) for t, b in zip(edges[0], edges[0][1:], strict=False) for left, r in zip(edges[1], edges[1][1:], strict=False)])


def features(image: np.ndarray) -> np.ndarray:
    """386 numbers of length 1: colour means, deviations and histograms, grey quantiles, a colour
    grid, a grid of contrast with the border, and 15 measures of what stands out from it."""
    border = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    away = np.linalg.norm(image - np.median(border, axis=0), axis=2)
    histograms = [np.histogram(image[:, :, c], 8, (0.0, 1.0), density=True)[0] for c in range(3)]
    out = away > max(0.08, float(np.quantile(away, 0.75)))
    shape = np.zeros(15)
    if out.any():
        ys, xs = np.nonzero(out)
        height, width = out.shape
        x, y = xs / max(1, width - 1), ys / max(1, height - 1)
        box = [(np.ptp(xs) + 1) / width, (np.ptp(ys) + 1) / height]
        shape = np.array([out.mean(), x.mean(), y.mean(), x.std(), y.std(), *box, *image[out].mean(0), *image[out].std(0), away[out].mean(), away[out].max()])
    parts = [image.mean((0, 1)), image.std((0, 1)), *histograms, np.quantile(image.mean(2), [0.05, 0.25, 0.5, 0.75, 0.95]), _cells(image, 8), _cells(away, 12) * 8.0, shape * 4.0]
    vector = np.concatenate(parts).astype(np.float32)
    return vector / max(float(np.linalg.norm(vector)), 1e-12)


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits as a signed number: signs, against the median, of the lowest 8 x 8 cosine terms of a 32 x 32 grey image."""
    grey = resize(image, 32, 32).astype(float) @ [0.299, 0.587, 0.114]
    k = np.arange(32)
    basis = np.cos(np.pi * np.outer(k, 2 * k + 1) / 64)
    low = (basis @ grey @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def _bits(flags: np.ndarray) -> int:
    return int(np.packbits(flags.ravel()).view(">i8")[0])


def _plain_grey(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return resize(image, width, height).astype(float) @ [0.299, 0.587, 0.114]


def average_hash(image: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grey image are lighter than their mean."""
    grey = _plain_grey(image, 8, 8)
    return _bits(grey > grey.mean())


def difference_hash(image: np.ndarray) -> int:
    """64 bits: which cells of a 9 x 8 grey image have a lighter one to their right."""
    grey = _plain_grey(image, 9, 8)
    return _bits(grey[:, 1:] > grey[:, :-1])


def wavelet_hash(image: np.ndarray) -> int:
    """64 bits: which coarsest Haar terms of a 64 x 64 grey image, left after three halvings, are above their median."""
    low = _plain_grey(image, 64, 64)
    for _ in range(3):
        low = (low[0::2] + low[1::2]) / np.sqrt(2)
        low = (low[:, 0::2] + low[:, 1::2]) / np.sqrt(2)
    return _bits(low > np.median(low))


#: Hashes by name, in the order in which near duplicates are looked for.
HASHES = {"perceptual": perceptual_hash, "difference": difference_hash, "wavelet": wavelet_hash, "average": average_hash}


# --- nuisance families --------------------------------------------------------------------------
# The ranges that each family draws from, the names of its recipe, and its own name.


def _blend(image: np.ndarray, other: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(np.rint(other + (image.astype(float) - other) * factor), 0, 255).astype(np.uint8)


def _grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image.astype(float) @ [0.299, 0.587, 0.114])[..., None]


def _rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the middle, counter-clockwise, cubic; what comes from outside has the corner's colour."""
    height, width = image.shape[:2]
    turn = np.deg2rad(degrees)
    y, x = np.mgrid[0:height, 0:width].astype(float)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    sx = np.cos(turn) * (x - cx) - np.sin(turn) * (y - cy) + cx
    sy = np.sin(turn) * (x - cx) + np.cos(turn) * (y - cy) + cy
    total, base_x, base_y = np.zeros(image.shape), np.floor(sx).astype(int), np.floor(sy).astype(int)
    for j in range(-1, 3):
        for i in range(-1, 3):
            weight = _cubic(sx - (base_x + i)) * _cubic(sy - (base_y + j))
            total += weight[..., None] * image[np.clip(base_y + j, 0, height - 1), np.clip(base_x + i, 0, width - 1)]
    inside = (sx >= -0.5) & (sx <= width - 0.5) & (sy >= -0.5) & (sy <= height - 0.5)
    return np.where(inside[..., None], np.clip(np.rint(total), 0, 255), corner(image)).astype(np.uint8)


def _smoothed(image: np.ndarray, radius: float) -> np.ndarray:
    """A Gaussian blur of this deviation, edges repeated; floats in [0, 255]."""
    reach = max(1, int(np.ceil(3 * radius)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(radius, 1e-6)) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(image.astype(float), ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    rows = sum(k * padded[i : i + image.shape[0]] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + image.shape[1]] for i, k in enumerate(kernel))


def _noisy(image: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return np.clip(image.astype(np.float32) + rng.normal(0.0, sigma, image.shape), 0, 255).astype(np.uint8)


def mild(image: np.ndarray, index: int, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, Any]]:
    brightness, contrast = 1 + float(rng.uniform(-0.08, 0.08)), 1 + float(rng.uniform(-0.06, 0.06))
    angle = float(rng.uniform(-4.0, 4.0))
    blur, noise = (0.18 if index % 3 == 1 else 0.0), (1.5 if index % 3 == 2 else 0.0)
    image = _blend(image, 0.0, brightness)
    image = _blend(image, float(int(_grey(image).mean() + 0.5)), contrast)
    image = _rotated(image, angle)
    if blur:
        image = np.rint(_smoothed(image, blur)).astype(np.uint8)
    if noise:
        image = _noisy(image, noise, rng)
    return image, {"family": "brightness_contrast_rotation_blur_noise", "severity": "mild", "brightness": round(brightness, 4), "contrast": round(contrast, 4), "rotation_degrees": round(angle, 4), "blur_radius": blur, "noise_sigma": noise}


# The standard's quantisation tables at quality 50, for light and for colour.
LIGHT = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
COLOUR = np.full((8, 8), 99)
COLOUR[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

_WAVES = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _quantised(plane: np.ndarray, table: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = np.clip((table * scale + 50) // 100, 1, 255)
    height, width = plane.shape
    padded = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge") - 128.0
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    terms = np.rint((_WAVES @ blocks @ _WAVES.T) / steps) * steps
    back = (_WAVES.T @ terms @ _WAVES).swapaxes(1, 2).reshape(padded.shape)
    return np.clip(np.rint(back + 128.0), 0, 255)[:height, :width]


def jpeg_round_trip(image: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG of this quality keeps of an image: its coding of the terms loses nothing, so it is left out.

    Colour at half resolution. Decoders differ in how they bring it back; here pixels are repeated.
    """
    to = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    light, blue, red = np.moveaxis(np.clip(np.rint(image.astype(float) @ to.T + [0, 128, 128]), 0, 255), 2, 0)
    height, width = light.shape
    planes = [_quantised(light, LIGHT, quality)]
    for plane in (blue, red):
        even = np.pad(plane, ((0, height % 2), (0, width % 2)), mode="edge")
        half = np.rint(even.reshape(even.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)))
        planes.append(_quantised(half, COLOUR, quality).repeat(2, 0).repeat(2, 1)[:height, :width])
    back = (np.stack(planes, 2) - [0, 128, 128]) @ np.linalg.inv(to).T
    return np.clip(np.rint(back), 0, 255).astype(np.uint8)


def _hue_turned(image: np.ndarray, steps: int) -> np.ndarray:
    """Hue moved by ``steps`` of 256, saturation and value kept."""
    rgb = image.astype(float)
    top, low = rgb.max(2), rgb.min(2)
    span = np.where(top > low, top - low, 1.0)
    r, g, b = np.moveaxis(rgb, 2, 0)
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))
    hue = (np.floor(hue / 6 * 255) + steps) % 256 / 255 * 6
    # Each channel falls from the top as its distance on the hue circle grows.
    far = [np.clip(np.abs((hue - at + 3) % 6 - 3) - 1, 0, 1) for at in (0, 2, 4)]
    return np.clip(np.rint(top[..., None] - (top - low)[..., None] * np.stack(far, 2)), 0, 255).astype(np.uint8)


def recapture(image: np.ndarray, index: int, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, Any]]:
    """A second photograph: light, colour, angle, framing, focus, noise and JPEG. Even rows are mirrored."""
    ranges = {
        "brightness": (0.7, 1.3), "contrast": (0.75, 1.25), "saturation": (0.75, 1.25), "rotation_degrees": (-15.0, 15.0), "scale": (0.82, 1.0),
        "translate_x_fraction": (-0.05, 0.05), "translate_y_fraction": (-0.05, 0.05), "blur_radius": (0.3, 1.2), "noise_sigma": (3.0, 7.0),
    }
    d = {name: float(rng.uniform(*ends)) for name, ends in ranges.items()}
    quality, mirrored = int(rng.integers(45, 70)), index % 2 == 0
    height, width = image.shape[:2]
    image = _blend(image, 0.0, d["brightness"])
    image = _blend(image, float(int(_grey(image).mean() + 0.5)), d["contrast"])
    image = _rotated(_blend(image, _grey(image), d["saturation"]), d["rotation_degrees"])
    image = image[:, ::-1] if mirrored else image
    small = resize(image, max(1, int(width * d["scale"])), max(1, int(height * d["scale"])))
    canvas = np.empty_like(image)
    canvas[:] = corner(image)
    left = int((width - small.shape[1]) // 2 + d["translate_x_fraction"] * width)
    top = int((height - small.shape[0]) // 2 + d["translate_y_fraction"] * height)
    ys, xs = slice(max(top, 0), min(top + small.shape[0], height)), slice(max(left, 0), min(left + small.shape[1], width))
    canvas[ys, xs] = small[ys.start - top : ys.stop - top, xs.start - left : xs.stop - left]
    image = _noisy(np.rint(_smoothed(canvas, d["blur_radius"])), d["noise_sigma"], rng)
    recipe = {k: round(v, 4) for k, v in d.items()} | {"hflip": mirrored, "jpeg_quality": quality}
    return jpeg_round_trip(image, quality), recipe | {"family": "brightness_contrast_saturation_rotation_scale_translate_hflip_blur_noise_jpeg", "severity": "strong"}


def occlusion(image: np.ndarray, index: int, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, Any]]:
    """Hue, fewer levels, sharpening, motion, a covered rectangle and a poor JPEG.

    Motion sums 2 * (L // 2) + 1 moved copies, which wrap around, and divides by L: an even
    length brightens.
    """
    height, width = image.shape[:2]
    hue, bits = float(rng.uniform(-12.0, 12.0)), int(rng.integers(4, 7))
    image = _hue_turned(image, round(hue / 360 * 255)) & np.uint8(256 - (1 << (8 - bits)))
    radius, percent = float(rng.uniform(1.0, 3.0)), int(rng.integers(100, 220))
    edges = image - np.rint(_smoothed(image, radius))
    image = np.clip(np.rint(image + np.where(np.abs(edges) >= 3, edges * percent / 100, 0)), 0, 255).astype(np.uint8)
    length, upright = int(rng.integers(5, 16)), bool(rng.integers(0, 2))
    moved = [np.roll(image.astype(np.float32), k, 0 if upright else 1) for k in range(-(length // 2), length // 2 + 1)]
    image = np.clip(sum(moved) / length, 0, 255).astype(np.uint8)
    area = float(rng.uniform(0.06, 0.18))
    wide, tall = (round(n * area**0.5) for n in (width, height))
    x, y = int(rng.integers(0, max(1, width - wide))), int(rng.integers(0, max(1, height - tall)))
    image[y : y + tall, x : x + wide] = corner(image).copy()
    quality = int(rng.integers(20, 41))
    recipe = {
        "family": "hue_posterize_sharpen_motionblur_erase_lowq_jpeg", "severity": "strong_held_out", "hue_shift_degrees": round(hue, 4), "posterize_bits": bits,
        "sharpen_radius": round(radius, 4), "sharpen_percent": percent, "motion_blur_length_px": length, "motion_blur_vertical": upright,
        "erase_area_fraction": round(area, 4), "erase_x": x, "erase_y": y, "jpeg_quality": quality,
    }
    return jpeg_round_trip(image, quality), recipe


def photometric(image: np.ndarray, index: int, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, Any]]:
    """Gamma, colour temperature, vignette, impulse noise and a good JPEG."""
    height, width = image.shape[:2]
    cut = lambda a: np.clip(a, 0, 255).astype(np.uint8)
    gamma = float(rng.uniform(0.6, 1.6))
    image = cut(np.power(image.astype(np.float32) / 255.0, gamma) * 255.0)
    warmth = float(rng.uniform(0.85, 1.15))
    image = cut(image.astype(np.float32) * np.array([warmth, 1.0, 1.0 / warmth], np.float32))
    fall = float(rng.uniform(0.25, 0.55))
    y, x = np.mgrid[0:height, 0:width].astype(np.float32)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    shade = 1 - fall * np.clip(np.hypot(x - cx, y - cy) / np.hypot(cx, cy), 0, 1) ** 2
    image = cut(image.astype(np.float32) * shade[..., None])
    share = float(rng.uniform(0.005, 0.025))
    n = int(height * width * share)
    xs, ys, ends = rng.integers(0, width, n), rng.integers(0, height, n), rng.integers(0, 2, n) * 255
    image = image.copy()
    image[ys, xs] = ends[:, None]
    quality = int(rng.integers(80, 96))
    return jpeg_round_trip(image, quality), {"family": "gamma_colortemp_vignette_saltpepper_highq_jpeg", "severity": "strong_held_out_2", "gamma": round(gamma, 4), "color_temperature": round(warmth, 4), "vignette_strength": round(fall, 4), "salt_pepper_fraction": round(share, 4), "jpeg_quality_hq": quality}


FAMILIES = {"mild": mild, "strong": recapture, "strong_held_out": occlusion, "strong_held_out_2": photometric}


def fitted(image: np.ndarray, size: int) -> np.ndarray:
    """The middle of the image in the shape of a square, resized to ``size``; uint8."""
    height, width = image.shape[:2]
    side = min(height, width)
    top, left = (height - side) // 2, (width - side) // 2
    return resize(image[top : top + side, left : left + side], size, size)


def variant(image: np.ndarray, size: int, families: list[str], index: int, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, Any]]:
    """The index-th stable variant of an image: families take turns; a mixture is named in the recipe."""
    made, recipe = FAMILIES[families[index % len(families)]](fitted(image, size), index, rng)
    if len(families) > 1:
        recipe = recipe | {"mixture": ",".join(families)}
    return made, dict(sorted(recipe.items()))


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB image as a PNG file."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image).reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
