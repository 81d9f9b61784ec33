"""Image kernels for scans, on uint8 arrays: gray, denoise, contrast, binarise, deskew, resize; and all of them on a DataFrame of pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def denoise(img: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian blur, edges reflected."""
    x = np.pad(img.astype(np.float64), 1, mode="reflect")
    x = (x[:-2] + 2 * x[1:-1] + x[2:]) / 4
    return np.rint((x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4).astype(np.uint8)


def contrast(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation of tiles with clipped histograms, blended between tile centres."""
    h, w = img.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(img, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over / 256
            maps[i, j] = np.cumsum(n) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], img]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The threshold with the largest variance between the classes."""
    n = np.bincount(img.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    s = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * below - s * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarise(img: np.ndarray) -> np.ndarray:
    return np.where(img > otsu(img), 255, 0).astype(np.uint8)


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the centre, bilinear, edge pixels repeated."""
    h, w = img.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(np.float64)
    cy, cx = h / 2, w / 2
    sx = np.clip(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, 0, w - 1)
    sy = np.clip(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(w - 2, 0)), np.minimum(sy.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    out = (1 - fy) * ((1 - fx) * img[y0, x0] + fx * img[y0, x1]) + fy * ((1 - fx) * img[y1, x0] + fx * img[y1, x1])
    return np.rint(out).astype(np.uint8)


def skew(img: np.ndarray, votes: int = 200, most: float = 45.0) -> float | None:
    """Median angle, in degrees, of the straight edges within ``most`` of the horizontal; None without any.

    Edges are steps of brightness; lines are found by voting over angles of one
    degree and distances of one pixel.
    """
    g = img.astype(np.int32)
    edge = np.zeros(g.shape, bool)
    edge[1:] = np.abs(np.diff(g, axis=0)) > 100
    y, x = np.nonzero(edge)
    if not len(y):
        return None
    angles = np.arange(-int(most) + 1, int(most))
    found = []
    for a in angles:
        d = np.rint(y * np.cos(np.deg2rad(a)) - x * np.sin(np.deg2rad(a))).astype(int)
        n = np.bincount(d - d.min())
        found += [(int(v), a) for v in n[n >= votes]]
    if not found:
        return None
    most_votes = max(v for v, _ in found)
    return float(np.median([a for v, a in found if v >= 0.5 * most_votes]))


def deskew(img: np.ndarray, least: float = 0.5, votes: int = 200) -> np.ndarray:
    angle = skew(img, votes)
    return img if angle is None or abs(angle) <= least else rotate(img, angle)


def resize_to(img: np.ndarray, nh: int, nw: int) -> np.ndarray:
    """Bilinear."""
    h, w = img.shape[:2]
    if (h, w) == (nh, nw):
        return img
    y, x = np.clip((np.arange(nh) + 0.5) * h / nh - 0.5, 0, h - 1), np.clip((np.arange(nw) + 0.5) * w / nw - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (img.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (img.ndim - 2))
    at = lambda a, b: img[a][:, b].astype(np.float64)
    return np.rint((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))).astype(np.uint8)


def resize(img: np.ndarray, dpi: float, from_dpi: float = 72.0) -> np.ndarray:
    """By the ratio of resolutions."""
    h, w = img.shape[:2]
    return resize_to(img, max(1, round(h * dpi / from_dpi)), max(1, round(w * dpi / from_dpi)))


def prepare(rgb: np.ndarray, denoised: bool = True, contrasted: bool = True, binarised: bool = True, deskewed: bool = True) -> np.ndarray:
    """The steps in order."""
    img = gray(rgb)
    for on, step in ((denoised, denoise), (contrasted, contrast), (binarised, binarise), (deskewed, deskew)):
        if on:
            img = step(img)
    return img


def prepare_pages(pages: DataFrame, denoised: bool = True, contrasted: bool = True, binarised: bool = True, deskewed: bool = True) -> DataFrame:
    """(path, page_num, width, height, pixels) of pages, RGB or gray bytes, as prepared gray bytes; pages without a picture don't appear."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, n, w, h, raw = (batch.column(c)[k].as_py() for c in ("path", "page_num", "width", "height", "pixels"))
                x = np.frombuffer(raw, np.uint8)
                x = prepare(x.reshape(h, w) if len(x) == h * w else x.reshape(h, w, 3), denoised, contrasted, binarised, deskewed)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.shape[0]], pa.int32()), pa.array([x.tobytes()])], ["path", "page_num", "width", "height", "pixels"])

    own = pages.where("pixels is not null and width > 0 and height > 0").select("path", "page_num", "width", "height", "pixels")
    return own.mapInArrow(run, "path string, page_num int, width int, height int, pixels binary")
