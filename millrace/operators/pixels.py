"""Image transforms on Arrow batches: a whole chain in one pass over the pixels.

The expressions of ``image`` suit short vectors; full images go through here. A step is a
NumPy function over images of one size, (n, height, width, channels). Its random numbers
are hashed in the JVM from (seed, row key, name), the same ones the expressions use, so
both give the same pixels. Images of different sizes are worked on size by size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import hash_uniform
from millrace.operators.image import LUMA_BLUE, LUMA_GREEN, LUMA_RED, gaussian_kernel

BATCH_PIXELS = 4_000_000


@dataclass(frozen=True)
class Step:
    """``apply(images, uniforms)``; ``draws`` names one hashed uniform per column of ``uniforms``."""

    apply: Callable[[np.ndarray, np.ndarray], np.ndarray]
    draws: tuple[tuple, ...] = ()


def run(
    df: DataFrame,
    column: str,
    key: str,
    shape: tuple[int, int, int] | Sequence[str],
    chains: Mapping[str, Sequence[Step]] | Sequence[Step],
    split: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Replace pixels (number array or binary) by the output of a chain of steps; NULL stays NULL.

    ``shape`` is (height, width, channels) or the names of columns that hold them. With
    ``split``, ``chains`` maps each value of that column to its own chain.
    """
    chains = dict(chains) if split else {None: list(chains)}
    draws = list(dict.fromkeys(d for steps in chains.values() for s in steps for d in s.draws))
    uniforms = [hash_uniform(seed, F.col(key), *[F.lit(p) for p in d]) for d in draws] or [F.lit(0.0)]
    names, size_columns = df.columns, list(shape) if isinstance(shape[0], str) else []
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == column else f.dataType) for f in df.schema])

    def transformed(b: pa.RecordBatch) -> pa.RecordBatch:
        values = b.column(column)
        u = b.column("__u").flatten().to_numpy().reshape(b.num_rows, -1)
        sizes = list(zip(*(b.column(c).to_pylist() for c in size_columns))) if size_columns else [tuple(shape)] * b.num_rows
        kinds = b.column(split).to_pylist() if split else [None] * b.num_rows
        groups: dict[tuple, list[int]] = {}
        for i, group in enumerate(zip(kinds, sizes)):
            if values[i].is_valid:
                groups.setdefault(group, []).append(i)
        out: list = [None] * b.num_rows
        for (kind, size), rows in groups.items():
            if kind not in chains:
                continue
            if binary:
                flat = np.stack([np.frombuffer(values[i].as_buffer(), np.uint8) for i in rows])
            else:
                flat = np.stack([values[i].values.to_numpy(zero_copy_only=False) for i in rows])
            images = flat.astype(float).reshape(len(rows), *size)
            for step in chains[kind]:
                images = step.apply(images, u[np.ix_(rows, [draws.index(d) for d in step.draws])])
            for i, image in zip(rows, images.reshape(len(rows), -1)):
                out[i] = image
        done = pa.array(out, pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([done if c == column else b.column(c) for c in names], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = max(1, BATCH_PIXELS * b.num_rows // max(1, b.column(column).nbytes // (1 if binary else 8)))
                for at in range(0, b.num_rows, rows):
                    yield transformed(b.slice(at, rows))

    return df.withColumn("__u", F.array(*uniforms)).mapInArrow(work, schema)


def _spread(u: np.ndarray) -> np.ndarray:
    return u[:, :, None, None]


def normalise(mean: Sequence[float], std: Sequence[float]) -> Step:
    return Step(lambda a, u: (a / 255 - np.array(mean)) / np.array(std))


def _luma(a: np.ndarray) -> np.ndarray:
    return np.floor((a @ [LUMA_BLUE, LUMA_GREEN, LUMA_RED] + 32768) / 65536)


def grayscale() -> Step:
    return Step(lambda a, u: _luma(a)[..., None])


def _nearest(n: int, new: int) -> np.ndarray:
    return (2 * np.arange(new) + 1) * n // (2 * new)


def resize_nearest(h: int, w: int) -> Step:
    return Step(lambda a, u: a[:, _nearest(a.shape[1], h)][:, :, _nearest(a.shape[2], w)])


def triangle_weights(old: int, new: int) -> np.ndarray:
    """(new, old) weights of the bilinear filter, widened when shrinking, rows sum to 1."""
    step = old / new
    reach = max(step, 1.0)
    centre = (np.arange(new) + 0.5) * step
    weights = np.clip(1 - np.abs(np.arange(old) + 0.5 - centre[:, None]) / reach, 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def _bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.einsum("yh,nhwc,xw->nyxc", triangle_weights(a.shape[1], h), a, triangle_weights(a.shape[2], w), optimize=True)


def resize(h: int, w: int) -> Step:
    """Bilinear, with the filter widened when shrinking."""
    return Step(lambda a, u: _bilinear(a, h, w))


def resize_shorter(size: int) -> Step:
    """Bring the shorter side to ``size`` and keep the aspect ratio."""
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        h, w = a.shape[1:3]
        short = min(h, w)
        return _bilinear(a, size * h // short, size * w // short)

    return Step(apply)


def centre_crop(h: int, w: int) -> Step:
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        top, left = round((a.shape[1] - h) / 2), round((a.shape[2] - w) / 2)
        return a[:, top : top + h, left : left + w]

    return Step(apply)


TRIES = 10
BOX_DRAWS = tuple((t, n) for t in range(TRIES) for n in ("area", "aspect", "top", "left"))


def _box(u: np.ndarray, h: int, w: int, scale: tuple, ratio: tuple, strict: bool) -> tuple[int, int, int, int] | None:
    """First of the hashed boxes (top, left, height, width) that fits."""
    low, high = math.log(ratio[0]), math.log(ratio[1])
    for area, aspect, top, left in u.reshape(TRIES, 4):
        size = h * w * (scale[0] + area * (scale[1] - scale[0]))
        shape = math.exp(low + aspect * (high - low))
        bh, bw = np.rint(math.sqrt(size / shape)), np.rint(math.sqrt(size * shape))
        if strict:
            bh, bw = np.rint(math.sqrt(size * shape)), np.rint(math.sqrt(size / shape))
        room = 1 if strict else 0
        if 0 < bh <= h - room and 0 < bw <= w - room:
            return int(top * (h - bh + 1)), int(left * (w - bw + 1)), int(bh), int(bw)
    return None


def random_resized_crop(h: int, w: int, scale: tuple[float, float] = (0.08, 1.0), ratio: tuple[float, float] = (3 / 4, 4 / 3), smooth: bool = False) -> Step:
    """Hashed crop box, resized (nearest, or bilinear if ``smooth``); the centre square if none fits."""
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        old_h, old_w = a.shape[1:3]
        side = min(old_h, old_w)
        whole = ((old_h - side) // 2, (old_w - side) // 2, side, side)
        out = np.empty((len(a), h, w, a.shape[3]))
        for i, image in enumerate(a):
            top, left, bh, bw = _box(u[i], old_h, old_w, scale, ratio, strict=False) or whole
            cut = image[top : top + bh, left : left + bw]
            out[i] = _bilinear(cut[None], h, w)[0] if smooth else cut[_nearest(bh, h)][:, _nearest(bw, w)]
        return out

    return Step(apply, BOX_DRAWS)


def random_flip(p: float = 0.5) -> Step:
    return Step(lambda a, u: np.where(_spread(u) < p, a[:, :, ::-1], a), (("flip",),))


def _factor(u: np.ndarray, reach: float) -> np.ndarray:
    low = max(0.0, 1.0 - reach)
    return _spread(low + u * (1.0 + reach - low))


def brightness(reach: float) -> Step:
    return Step(lambda a, u: np.clip(a * _factor(u, reach), 0, 255), (("brightness",),))


def contrast(reach: float) -> Step:
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        gray = _luma(a) if a.shape[3] == 3 else a[..., 0]
        mean = np.floor(gray.mean(axis=(1, 2)) + 0.5)[:, None, None, None]
        return np.clip(mean + _factor(u, reach) * (a - mean), 0, 255)

    return Step(apply, (("contrast",),))


def saturation(reach: float) -> Step:
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        if a.shape[3] == 1:
            return a
        gray = _luma(a)[..., None]
        return np.clip(gray + _factor(u, reach) * (a - gray), 0, 255)

    return Step(apply, (("saturation",),))


def turn_hue(rgb: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Shift the hue of (n, pixels, 3) values in 0..255 by ``shift`` turns per image."""
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = top - low
    safe = np.where(span == 0, 1, span)
    r, g, b = np.moveaxis(rgb, 2, 0)
    sixth = np.select([top == r, top == g], [((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4)
    sixth = np.where(span == 0, 0, sixth)
    h = (sixth + 6 * shift[:, None]) % 6
    channels = [top - span * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1) for n in (5, 3, 1)]
    return np.stack(channels, axis=2)


def hue(reach: float) -> Step:
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        if a.shape[3] == 1:
            return a
        flat = a.reshape(len(a), -1, 3)[:, :, ::-1]
        return turn_hue(flat, (2 * u[:, 0] - 1) * reach)[:, :, ::-1].reshape(a.shape)

    return Step(apply, (("hue",),))


def colour_jitter(bright: float = 0.0, contrasted: float = 0.0, saturated: float = 0.0, hued: float = 0.0) -> list[Step]:
    return [brightness(bright), contrast(contrasted), saturation(saturated), hue(hued)]


def inverse_affine(angle: float, translate: tuple[float, float], scale: float, shear: float, h: int, w: int) -> np.ndarray:
    """2 x 3 matrix from output to input pixel centres; turn, shear and zoom about the middle."""
    a, s = math.radians(angle), math.radians(shear)
    turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    skew = np.array([[1.0, -math.tan(s)], [0.0, 1.0]])
    back = np.linalg.inv(scale * turn @ skew)
    middle = np.array([(w - 1) / 2, (h - 1) / 2])
    return np.column_stack([back, middle - back @ (middle + np.array(translate))])


def _sampled(a: np.ndarray, matrices: Sequence[np.ndarray], fill: float) -> np.ndarray:
    """Each output pixel takes the nearest input pixel its matrix points to."""
    n, h, w, c = a.shape
    ys, xs = np.divmod(np.arange(h * w), w)
    places = np.stack([xs, ys, np.ones(h * w)])
    pixels, out = a.reshape(n, h * w, c), np.full((n, h * w, c), fill)
    for i, matrix in enumerate(matrices):
        x, y = np.rint(matrix @ places + 1e-9).astype(int)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        out[i, inside] = pixels[i, (y * w + x)[inside]]
    return out.reshape(a.shape)


def affine(angle: float = 0.0, translate: tuple[float, float] = (0.0, 0.0), scale: float = 1.0, shear: float = 0.0, fill: float = 0.0) -> Step:
    """The same turn, shift (in pixels), zoom and shear for every image."""
    return Step(lambda a, u: _sampled(a, [inverse_affine(angle, translate, scale, shear, *a.shape[1:3])] * len(a), fill))


def random_affine(
    degrees: float = 0.0, translate: tuple[float, float] = (0.0, 0.0), scale: tuple[float, float] = (1.0, 1.0), shear: float = 0.0, fill: float = 0.0, name: str = ""
) -> Step:
    """Hashed amounts: turn up to ``degrees``, shift up to a share of the sides, zoom, shear.

    Rotation alone is the case with only ``degrees`` set; ``name`` sets two such steps of a
    chain apart.
    """
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        h, w = a.shape[1:3]
        matrices = [
            inverse_affine(
                (2 * turn - 1) * degrees,
                (round((2 * right - 1) * translate[0] * w), round((2 * down - 1) * translate[1] * h)),
                scale[0] + zoom * (scale[1] - scale[0]),
                (2 * skew - 1) * shear,
                h, w,
            )
            for turn, right, down, zoom, skew in u
        ]
        return _sampled(a, matrices, fill)

    return Step(apply, tuple((name + n,) for n in ("turn", "right", "down", "zoom", "shear")))


def blur(sigma: float = 0.3, size: int = 3) -> Step:
    """Gaussian blur; the edge is mirrored without repeating the border pixel."""
    kernel, half = gaussian_kernel(size, sigma), size // 2

    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        h, w = a.shape[1:3]
        padded = np.pad(a, ((0, 0), (half, half), (half, half), (0, 0)), mode="reflect")
        rows = sum(k * padded[:, i : i + h] for i, k in enumerate(kernel))
        return sum(k * rows[:, :, i : i + w] for i, k in enumerate(kernel))

    return Step(apply)


def random_erase(p: float = 0.1, scale: tuple[float, float] = (0.02, 0.1), ratio: tuple[float, float] = (0.3, 3.3), value: float = 0.0) -> Step:
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        out = a.copy()
        for i in np.flatnonzero(u[:, 0] < p):
            box = _box(u[i, 1:], *a.shape[1:3], scale, ratio, strict=True)
            if box:
                top, left, bh, bw = box
                out[i, top : top + bh, left : left + bw] = value
        return out

    return Step(apply, (("erase",), *BOX_DRAWS))


def min_max() -> Step:
    """Scale each image to [0, 1]; a constant image becomes zeros."""
    def apply(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        low, high = a.min(axis=(1, 2, 3), keepdims=True), a.max(axis=(1, 2, 3), keepdims=True)
        return np.where(high == low, 0.0, (a - low) / np.where(high == low, 1.0, high - low))

    return Step(apply)
