"""Pictures as matrices: decoding, channels of depth, cuts and colours. None of it has a built-in form, so these are Arrow UDFs
over whole batches. A picture is STRUCT<height, width, channels, pixels ARRAY<INT>>, row by row, the channels of a pixel together."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean and deviation of the ImageNet pictures by channel. Fixed values.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
#: Kernels of the gradients along x and y. Fixed values.
PREWITT_X = ((-1.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (-1.0, 0.0, 1.0))
PREWITT_Y = ((-1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def convolved(images: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """True 3 x 3 convolution (the kernel is flipped) of a stack of pictures; edges are mirrored, the edge itself included."""
    padded = np.pad(images, [(0, 0)] * (images.ndim - 2) + [(1, 1), (1, 1)], mode="symmetric")
    flipped = kernel[::-1, ::-1]
    h, w = images.shape[-2:]
    return sum(flipped[i, j] * padded[..., i : i + h, j : j + w] for i in range(3) for j in range(3))


def to_255(a: np.ndarray) -> np.ndarray:
    """Each picture min-max to 0 to 255, cut; zeros if flat."""
    low, high = a.min(axis=(-2, -1), keepdims=True), a.max(axis=(-2, -1), keepdims=True)
    width = np.where(high > low, high - low, 1.0)
    return np.where(high > low, np.floor((a - low) / width * 255), 0).astype(np.int64)


def gradients(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and angle of the gradient."""
    gx, gy = convolved(images, np.array(PREWITT_X)), convolved(images, np.array(PREWITT_Y))
    return np.sqrt(gx * gx + gy * gy), np.arctan2(gy, gx)


def depth_channels(flat: Column, width: int, imagenet: bool = False) -> Column:
    """ARRAY<ARRAY<INT>>: depth, gradient magnitude and gradient angle, each scaled to 0 to 255, of a flat matrix of that
    width; with imagenet normalised by the means of photographs and clipped, as the evaluators do. NULL for NULL, and for a
    length that is no multiple of the width. Pictures of one size are worked on as a stack, whole batches at a time."""

    @F.pandas_udf("array<array<int>>")
    def run(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        by_size: dict[int, list[int]] = {}
        for at, r in enumerate(rows):
            if r is not None and len(r) and len(r) % width == 0:
                by_size.setdefault(len(r), []).append(at)
        for size, places in by_size.items():
            images = np.stack([np.asarray(rows.iloc[at], dtype=float) for at in places]).reshape(len(places), -1, width)
            channels = [to_255(c) for c in (images, *gradients(images))]
            if imagenet:
                channels = [np.clip((c / 255.0 - m) / s * 255, 0, 255).astype(np.int64) for c, m, s in zip(channels, IMAGENET_MEAN, IMAGENET_STD)]
            for at, three in zip(places, np.stack(channels, axis=1).reshape(len(places), 3, size).tolist()):
                out[at] = three
        return pd.Series(out, dtype=object)

    return run(flat)


def grey_channels(scaled: Column) -> Column:
    """One scaled channel three times."""
    return F.array(scaled, scaled, scaled)


PICTURE = "struct<height: int, width: int, channels: int, pixels: array<int>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_pixels(data: bytes | None) -> np.ndarray | None:
    """(height, width, channels) of a PNG of 8 or 16 bits without palette and interlacing; None for anything else."""
    if not data or not data.startswith(_SIGNATURE):
        return None
    at, header, packed = len(_SIGNATURE), None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if header is None:
        return None
    width, height, depth, color, *_, interlaced = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if channels is None or depth not in (8, 16) or interlaced:
        return None
    step = channels * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    except (zlib.error, ValueError):
        return None
    rows = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    values = rows.view(">u2") if depth == 16 else rows
    return values.reshape(height, width, channels).astype(np.int64)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from its differences: to nothing, the left, the line above, their mean, or the nearest of three."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):
        left = int(out[i - step]) if i >= step else 0
        if kind == 3:
            out[i] = (out[i] + (left + int(up[i])) // 2) & 255
        else:
            corner = int(up[i - step]) if i >= step else 0
            guess = left + int(up[i]) - corner
            near = min((abs(guess - left), 0, left), (abs(guess - int(up[i])), 1, int(up[i])), (abs(guess - corner), 2, corner))[2]
            out[i] = (out[i] + near) & 255
    return out.astype(np.uint8)


def _as_picture(a: np.ndarray | None) -> dict | None:
    return None if a is None else {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "pixels": a.ravel().tolist()}


def _frame(pictures: list[np.ndarray | None]) -> pd.DataFrame:
    rows = [_as_picture(a) or {} for a in pictures]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("height", "width", "channels", "pixels")})


def _arrays(pictures: pd.DataFrame) -> list[np.ndarray | None]:
    """The matrices of a column of pictures, None for NULL."""
    columns = (pictures[c] for c in ("height", "width", "channels", "pixels"))
    return [np.asarray(p, dtype=np.int64).reshape(int(h), int(w), int(c)) if isinstance(p, (list, np.ndarray)) else None for h, w, c, p in zip(*columns)]


def decoded(content: Column) -> Column:
    """Pictures from the bytes of PNG files (``sources.files.read_bytes``); NULL for other formats, which a slot may decode."""

    @F.pandas_udf(PICTURE)
    def run(files: pd.Series) -> pd.DataFrame:
        return _frame([png_pixels(f) for f in files])

    got = run(content)
    return F.when(got["height"].isNotNull(), got)


def inside(height: int, width: int, x: list[float], y: list[float]) -> np.ndarray:
    """Which pixels lie within a polygon, by crossings of the line to the right; its own points count as within."""
    row, column = np.mgrid[0:height, 0:width]
    hit = np.zeros((height, width), bool)
    n = min(len(x), len(y))
    for i in range(n):
        x1, y1, x2, y2 = x[i], y[i], x[(i + 1) % n], y[(i + 1) % n]
        if y1 != y2:
            crossing = (y1 > row) != (y2 > row)
            hit ^= crossing & (column < (x2 - x1) * (row - y1) / (y2 - y1) + x1)
    for a, b in zip(x, y):
        if 0 <= int(b) < height and 0 <= int(a) < width:
            hit[int(b), int(a)] = True
    return hit


def cut_out(picture: Column, x: Column, y: Column) -> Column:
    """The part of a picture within a polygon: black outside, and cut to the rows and columns that are not all black. NULL for
    a polygon of fewer than three points or without a pixel that is not black."""

    @F.pandas_udf(PICTURE)
    def run(pictures: pd.DataFrame, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for image, px, py in zip(_arrays(pictures), xs, ys):
            part = None
            if image is not None and px is not None and py is not None and min(len(px), len(py)) >= 3:
                part = np.where(inside(*image.shape[:2], list(px), list(py))[..., None], image, 0)
                lit = part.any(axis=2)
                part = part[np.ix_(lit.any(axis=1), lit.any(axis=0))] if lit.any() else None
            out.append(part)
        return _frame(out)

    got = run(picture, x, y)
    return F.when(got["height"].isNotNull(), got)


#: From sRGB to XYZ under D65, and the white point. Fixed values.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of colours of 0 to 255."""
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ np.array(TO_XYZ).T / np.array(WHITE)
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def mean_lab(picture: Column) -> Column:
    """ARRAY<DOUBLE>: the mean colour of the pixels that are not black, as L*a*b*; NULL if there is none, or fewer than three channels."""

    @F.pandas_udf("array<double>")
    def run(pictures: pd.DataFrame) -> pd.Series:
        out = []
        for image in _arrays(pictures):
            lit = None if image is None or image.shape[2] < 3 else image[..., :3][image[..., :3].any(axis=2)]
            out.append(lab(lit.astype(float)).mean(axis=0).tolist() if lit is not None and len(lit) else None)
        return pd.Series(out, dtype=object)

    return run(picture)


def npy_bytes(values: Column, width: Column) -> Column:
    """Flat matrices as the bytes of .npy files of unsigned bytes; NULL where the length is no multiple of the width."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for r, w in zip(rows, widths):
            if r is None or not w or w != w or len(r) % int(w):
                out.append(None)
                continue
            file = io.BytesIO()
            np.save(file, np.asarray(r).astype(np.uint8).reshape(-1, int(w)))
            out.append(file.getvalue())
        return pd.Series(out, dtype=object)

    return run(values, width)
