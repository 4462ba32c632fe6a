"""Per-image numbers from grey pixel arrays (ARRAY<FLOAT> with width and height), in Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FOURIER_NAMES = [
    "energy_total", "energy_mean", "energy_std", "entropy", "flatness", "band_0", "band_1", "band_2", "band_3", "band_4", "high_low_ratio", "coherence", "anisotropy",
]


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of the source pixels below each target pixel (nearest where it is enlarged)."""
    ys, xs = np.linspace(0, img.shape[0], h + 1), np.linspace(0, img.shape[1], w + 1)
    y0, x0 = np.floor(ys[:-1]).astype(int), np.floor(xs[:-1]).astype(int)
    y1, x1 = np.maximum(y0 + 1, np.ceil(ys[1:]).astype(int)), np.maximum(x0 + 1, np.ceil(xs[1:]).astype(int))
    s = np.pad(img.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]) / area


def dhash(img: np.ndarray, size: int = 8) -> int:
    """size * size bits: whether a pixel of the shrunk image is brighter than its right neighbour's left."""
    s = resize(img, size, size + 1)
    v = 0
    for bit in (s[:, 1:] > s[:, :-1]).ravel():
        v = v << 1 | int(bit)
    return v


def ahash_words(img: np.ndarray, size: int = 16) -> list[int]:
    """256 bits (brighter than the mean) as four signed 64-bit words."""
    s = resize(img, size, size)
    bits = (s >= s.mean()).ravel()
    return [int(np.uint64(int("".join("1" if b else "0" for b in bits[i : i + 64]), 2)).view(np.int64)) for i in range(0, size * size, 64)]


def trim_border(img: np.ndarray, tolerance: float = 18.0) -> np.ndarray:
    """Without rows and columns at the edges that stay within a tolerance of the border's median."""
    border = np.median(np.concatenate([img[0], img[-1], img[:, 0], img[:, -1]]))
    rows, cols = np.flatnonzero((abs(img - border) > tolerance).any(1)), np.flatnonzero((abs(img - border) > tolerance).any(0))
    return img[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) and len(cols) else img


def frequency_split(img: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, residual): the image inside a circle of the centred spectrum, and the rest of it."""
    h, w = img.shape
    y, x = np.ogrid[:h, :w]
    mask = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= radius**2
    low = np.fft.ifft2(np.fft.ifftshift(np.fft.fftshift(np.fft.fft2(img)) * mask)).real
    return low, img - low


def fourier_features(img: np.ndarray) -> dict[str, float]:
    """Thirteen numbers of the power spectrum: energy, entropy, flatness, five radial bands, high to low, coherence, anisotropy."""
    f = np.fft.fftshift(np.fft.fft2(img.astype(np.float64)))
    power = np.abs(f) ** 2
    total = float(power.sum()) or 1.0
    p = (power / total).ravel()
    h, w = img.shape
    y, x = np.ogrid[:h, :w]
    r = np.hypot(y - h // 2, x - w // 2)
    r = r / r.max()
    bands = [float(power[(r >= i / 5) & ((r < (i + 1) / 5) if i < 4 else (r <= 1))].sum() / total) for i in range(5)]
    low, high = float(power[r < 0.5].sum()), float(power[r >= 0.5].sum())
    across, along = float(power[h // 2, :].sum()), float(power[:, w // 2].sum())
    nz = p[p > 0]
    values = [
        total, float(power.mean()), float(power.std()), float(-(nz * np.log2(nz)).sum()), float(np.exp(np.log(power + 1e-12).mean()) / (power.mean() + 1e-12)), *bands,
        high / (low + 1e-12), float(abs(f.sum()) / (np.abs(f).sum() + 1e-12)), (across - along) / (across + along + 1e-12),
    ]
    return dict(zip(FOURIER_NAMES, values))


def sticker_like(alpha: np.ndarray, min_transparent: float = 0.35, max_box: float = 0.70) -> bool:
    """Mostly transparent, with a small opaque box away from the edges."""
    ys, xs = np.nonzero(alpha > 20)
    if not alpha.size or not len(ys):
        return True
    y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
    h, w = alpha.shape
    edge = x0 <= 2 or y0 <= 2 or x1 >= w - 2 or y1 >= h - 2
    return bool((alpha < 8).mean() >= min_transparent and (y1 - y0) * (x1 - x0) / (h * w) <= max_box and not edge)


def patches(img: np.ndarray, size: int, stride: int, least: int = 1) -> np.ndarray:
    """All windows of a stride; the four corners and the centre where there are fewer than least."""
    h, w = img.shape
    out = [img[i : i + size, j : j + size] for i in range(0, h - size + 1, stride) for j in range(0, w - size + 1, stride)]
    if len(out) < least:
        ii, jj = max(0, h - size), max(0, w - size)
        out = [img[i : i + size, j : j + size] for i, j in ((0, 0), (0, jj), (ii, 0), (ii, jj), (ii // 2, jj // 2))]
    return np.stack(out)


def image_features(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, dhash, 13 numbers) of images (id, width, height, pixels)."""
    names = ", ".join(f"{n} double" for n in FOURIER_NAMES)

    def run(batches):
        for b in batches:
            rows = []
            for i, w, h, px in zip(b[id_col], b["width"], b["height"], b["pixels"]):
                img = np.asarray(px, np.float64).reshape(h, w)
                rows.append({id_col: i, "dhash": int(np.uint64(dhash(img)).view(np.int64)), **fourier_features(img)})
            yield pd.DataFrame(rows, columns=[id_col, "dhash", *FOURIER_NAMES])

    return images.select(id_col, "width", "height", "pixels").mapInPandas(run, f"{id_col} bigint, dhash bigint, {names}")


def butterworth_split(img: np.ndarray, cutoff: float = 0.1, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(low, noise) by a Butterworth low-pass of the spectrum."""
    fy, fx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None, :]
    gain = 1 / (1 + (np.hypot(fy, fx) / cutoff) ** (2 * order))
    low = np.fft.ifft2(np.fft.fft2(img) * gain).real
    return low, img - low


def log_spectrum(img: np.ndarray) -> np.ndarray:
    """Centred log magnitude between 0 and 1."""
    m = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(img))))
    span = m.max() - m.min()
    return (m - m.min()) / span if span else np.zeros_like(m)


def fit_square(img: np.ndarray, size: int = 224) -> np.ndarray:
    """Scaled to fit a square, the rest filled with zeros on both sides."""
    k = size / max(img.shape)
    h, w = max(1, round(img.shape[0] * k)), max(1, round(img.shape[1] * k))
    out = np.zeros((size, size))
    y, x = (size - h) // 2, (size - w) // 2
    out[y : y + h, x : x + w] = resize(img, h, w)
    return out


#: Crops that tell recropped pictures, in quarters of the width (from, to) and the height (from, to).
CROPS = [(0, 4, 0, 4), (0, 2, 0, 4), (2, 4, 0, 4), (0, 4, 0, 2), (0, 4, 2, 4), (1, 3, 1, 3), (0, 3, 0, 4), (1, 4, 0, 4), (0, 4, 0, 3), (0, 4, 1, 4), (0, 3, 0, 3), (1, 4, 0, 3), (0, 3, 1, 4), (1, 4, 1, 4)]
#: Least side of a picture or crop that is hashed by itself.
LEAST_SIDE = 8


def crop_hashes(img: np.ndarray, size: int = 16) -> list[list[int]]:
    """Distinct average hashes of a picture without its border and of its crops, with and without theirs."""
    def trimmed(x: np.ndarray) -> np.ndarray:
        t = trim_border(x) if min(x.shape) >= LEAST_SIDE else x
        return t if min(t.shape) >= LEAST_SIDE else x

    h, w = img.shape
    if min(h, w) < LEAST_SIDE:
        return [ahash_words(img, size)]
    views = [trimmed(img)]
    for x0, x1, y0, y1 in CROPS:
        crop = img[h * y0 // 4 : h * y1 // 4, w * x0 // 4 : w * x1 // 4]
        if min(crop.shape) >= LEAST_SIDE:
            views += [crop, trimmed(crop)]
    return [list(t) for t in dict.fromkeys(tuple(ahash_words(v, size)) for v in views)]


def crop_hash_sets(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, hashes) of images (id, width, height, pixels): their sets of hashes, for hash_set_matches."""

    def run(batches):
        for b in batches:
            rows = [(i, crop_hashes(np.asarray(px, np.float64).reshape(h, w))) for i, w, h, px in zip(b[id_col], b["width"], b["height"], b["pixels"])]
            yield pd.DataFrame(rows, columns=[id_col, "hashes"])

    return images.select(id_col, "width", "height", "pixels").mapInPandas(run, f"{id_col} bigint, hashes array<array<bigint>>")


def ten_crops(img: np.ndarray, size: int) -> np.ndarray:
    """Corners and centre of a picture, and of its mirror image; smaller pictures are padded with zeros around."""
    h, w = img.shape[:2]
    dh, dw = max(0, size - h), max(0, size - w)
    img = np.pad(img, [(dh // 2, dh - dh // 2), (dw // 2, dw - dw // 2)] + [(0, 0)] * (img.ndim - 2))
    h, w = img.shape[:2]
    at = [(0, 0), (0, w - size), (h - size, 0), (h - size, w - size), (round((h - size) / 2), round((w - size) / 2))]
    five = lambda x: [x[i : i + size, j : j + size] for i, j in at]
    return np.stack(five(img) + five(img[:, ::-1]))


def joined_views(views: np.ndarray, side_by_side: bool = False) -> np.ndarray:
    """Views of one picture as they are, or side by side as one."""
    return np.concatenate(list(views), axis=1)[None] if side_by_side else views
