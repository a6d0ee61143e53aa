"""Pixel statistics of frames (BINARY, height x width x 3, BGR) and predicates on them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Luma weights of blue, green and red.
LUMA = (0.114, 0.587, 0.299)
STATS = "y_mean double, y_std double, b_std double, g_std double, r_std double, max_range double, green_share double, g_mean double, g_over double, b_mean double, r_mean double"
#: Fixed thresholds.
BLACK = {"mean": 8.0, "std": 6.0}
SOLID = {"std": 4.0, "range": 12.0}
GREEN = {"share": 0.35, "mean": 120.0, "over": 80.0, "std": 50.0}


def frame_stats(bgr: np.ndarray) -> dict[str, float]:
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    y = LUMA[0] * b + LUMA[1] * g + LUMA[2] * r
    return {
        "y_mean": y.mean(), "y_std": y.std(), "b_std": b.std(), "g_std": g.std(), "r_std": r.std(), "max_range": max(np.ptp(b), np.ptp(g), np.ptp(r)),
        "green_share": float(((g >= 180) & (r <= 90) & (b <= 90)).mean()), "g_mean": g.mean(), "g_over": g.mean() - max(r.mean(), b.mean()), "b_mean": b.mean(), "r_mean": r.mean(),
    }


def with_stats(frames: DataFrame) -> DataFrame:
    """frames(.., h, w, bgr) with the statistics of STATS; empty frames get nulls."""
    names = [c.split()[0] for c in STATS.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name != "bgr") + ", " + STATS

    def run(batches):
        for pdf in batches:
            found = [frame_stats(np.frombuffer(x, np.uint8).reshape(h, w, 3)) if x else dict.fromkeys(names) for x, h, w in zip(pdf["bgr"], pdf["h"], pdf["w"])]
            for n in names:
                pdf[n] = [f[n] for f in found]
            yield pdf.drop(columns="bgr")

    return frames.mapInPandas(run, schema)


def is_black() -> Column:
    return (F.col("y_mean") <= BLACK["mean"]) & (F.col("y_std") <= BLACK["std"])


def is_solid() -> Column:
    flat = F.greatest("y_std", "b_std", "g_std", "r_std") <= SOLID["std"]
    return flat & (F.col("max_range") <= SOLID["range"])


def is_green() -> Column:
    return (F.col("green_share") >= GREEN["share"]) | ((F.col("g_mean") > GREEN["mean"]) & (F.col("g_over") > GREEN["over"]) & (F.col("g_std") < GREEN["std"]))


def is_bad() -> Column:
    """Black, solid or corrupted green; frames without pixels are bad."""
    return F.coalesce(is_black() | is_solid() | is_green(), F.lit(True))


def letterbox(bgr: np.ndarray, threshold: float = 16.0, most: float = 0.45) -> tuple[int, int, int, int]:
    """(top, bottom, left, right), half-open: dark rows and columns are cut from each side, at most 45 % of it."""
    h, w = bgr.shape[:2]
    y = bgr.astype(np.float64) @ np.array(LUMA)

    def cut(means, n):
        limit, k = int(n * most), 0
        while k < limit and means[k] < threshold:
            k += 1
        return k

    rows, cols = y.mean(1), y.mean(0)
    top, bottom, left, right = cut(rows, h), h - cut(rows[::-1], h), cut(cols, w), w - cut(cols[::-1], w)
    return (top, bottom, left, right) if bottom > top and right > left else (0, h, 0, w)


def pooled(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area-averaged resize by overlap weights."""

    def weights(src, dst):
        edges = np.arange(dst + 1) * src / dst
        out = np.zeros((dst, src))
        for d in range(dst):
            for s in range(int(edges[d]), min(src, int(np.ceil(edges[d + 1])))):
                out[d, s] = min(s + 1, edges[d + 1]) - max(s, edges[d])
        return out / out.sum(1, keepdims=True)

    return weights(gray.shape[0], rows) @ gray @ weights(gray.shape[1], cols).T


def block_descriptors(bgr: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """rows x cols x 4 x 4 pooled gray descriptors in [0, 1]."""
    small = pooled(bgr.astype(np.float64) @ np.array(LUMA) / 255, 4 * rows, 4 * cols)
    return small.reshape(rows, 4, cols, 4).transpose(0, 2, 1, 3)


def full_difference(a: np.ndarray, b: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean absolute gray difference of two frames by block."""
    d = np.abs((a.astype(np.float64) - b.astype(np.float64)) @ np.array(LUMA)) / 255
    return d.reshape(rows, d.shape[0] // rows, cols, d.shape[1] // cols).mean((1, 3))


def edges(descriptors: np.ndarray) -> np.ndarray:
    """Half the mean absolute difference along each of the last two axes."""
    return 0.5 * np.abs(np.diff(descriptors, axis=-1)).mean((-2, -1)) + 0.5 * np.abs(np.diff(descriptors, axis=-2)).mean((-2, -1))


def nearest(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by the source index floor(y * src / dst)."""
    h, w = pixels.shape[:2]
    return pixels[np.arange(height) * h // height][:, np.arange(width) * w // width]


def padded(pixels: np.ndarray, factor: int) -> np.ndarray:
    """Zeros below and on the right up to multiples of ``factor``."""
    h, w = pixels.shape[:2]
    return np.pad(pixels, ((0, -h % factor), (0, -w % factor), *[(0, 0)] * (pixels.ndim - 2)))


def gradient(bgr: np.ndarray) -> np.ndarray:
    """A stand-in for residuals: 128 plus the scaled size of Sobel gradients of luma, as bytes."""
    y = np.pad(np.rint(bgr.astype(np.float64) @ np.array(LUMA)), 1, mode="reflect")
    smooth = lambda a, axis: a.take(range(a.shape[axis] - 2), axis) + 2 * a.take(range(1, a.shape[axis] - 1), axis) + a.take(range(2, a.shape[axis]), axis)
    dx = smooth(y, 0)[:, 2:] - smooth(y, 0)[:, :-2]
    dy = smooth(y, 1)[2:] - smooth(y, 1)[:-2]
    size = np.hypot(dx, dy)
    top = np.percentile(size, 95)
    return (128 + np.minimum(size / (top if top > 1e-6 else 1.0), 1.0) * 127).astype(np.uint8)


def png(rgb: np.ndarray, level: int = 3) -> bytes:
    """A PNG file of height x width x 3 bytes."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The pixels of a file that ``png`` wrote."""
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)
