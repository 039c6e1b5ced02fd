"""Image and vector preparation on pixel arrays.

An image is a flat array, row by row, channels interleaved: the layout of Spark's image
source, whose channels are in the order blue, green, red. Geometry is an index gather,
colour is arithmetic; both are array expressions. Rotation, hue and bilinear resizing
run on Arrow batches with NumPy. Random choices depend only on (seed, row key, step).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import hash_uniform
from millrace.functions.vectors import bind, indices

# The usual 16-bit luma weights for red, green, blue.
LUMA_RED, LUMA_GREEN, LUMA_BLUE = 19595, 38470, 7471


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gather(px: Column, count: Column | int, source: Callable[[Column], Column]) -> Column:
    """New array whose element i is ``px[source(i)]``."""
    return bind(px, lambda a: F.transform(indices(count), lambda i: F.get(a, source(i).cast("int"))))


def normalise(px: str | Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(v / 255 - mean) / std per channel."""
    means, stds, c = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)), len(mean)
    if c == 1:
        return F.transform(_col(px), lambda v: (v / F.lit(255.0) - F.lit(mean[0])) / F.lit(std[0]))
    return F.transform(_col(px), lambda v, i: (v / F.lit(255.0) - F.get(means, i % c)) / F.get(stds, i % c))


def unnormalise(px: str | Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(_col(px), lambda x: x * F.lit(std) + F.lit(mean))


def grayscale(px: str | Column) -> Column:
    """One luma value per blue-green-red triple; a length that is not made of triples is an error."""
    def luma(a: Column) -> Column:
        whole = F.transform(
            indices(F.floor(F.size(a) / 3).cast("int")),
            lambda i: F.floor(
                (F.get(a, i * 3 + 2) * LUMA_RED + F.get(a, i * 3 + 1) * LUMA_GREEN + F.get(a, i * 3) * LUMA_BLUE + 32768) / 65536
            ).cast("double"),
        )
        broken = F.raise_error(F.lit("grayscale needs three values per pixel")).cast("array<double>")
        return F.when(F.size(a) % 3 == 0, whole).when(a.isNotNull(), broken)

    return bind(_col(px), luma)


def resize_nearest(px: str | Column, h: int, w: int, new_h: int, new_w: int, c: int = 1) -> Column:
    """Each new pixel takes the old pixel under its centre."""
    def source(i: Column) -> Column:
        p, ch = F.floor(i / c), i % c
        y = F.floor((F.floor(p / new_w) * 2 + 1) * h / (2 * new_h))
        x = F.floor((p % new_w * 2 + 1) * w / (2 * new_w))
        return (y * w + x) * c + ch

    return gather(_col(px), new_h * new_w * c, source)


def crop(px: str | Column, w: int, c: int, top: Column | int, left: Column | int, ch: int, cw: int) -> Column:
    top, left = (F.lit(v) if isinstance(v, int) else v for v in (top, left))

    def source(i: Column) -> Column:
        p = F.floor(i / c)
        return ((F.floor(p / cw) + top) * w + p % cw + left) * c + i % c

    return gather(_col(px), ch * cw * c, source)


def centre_crop(px: str | Column, h: int, w: int, ch: int, cw: int, c: int = 1) -> Column:
    return crop(px, w, c, round((h - ch) / 2), round((w - cw) / 2), ch, cw)


def hashed_box(seed: int, key: str | Column, h: int, w: int, scale: tuple[float, float], ratio: tuple[float, float], strict: bool) -> Column:
    """First of ten hashed boxes (top, left, bh, bw) of random area and aspect that fits, else NULL.

    ``strict`` asks for a box smaller than the image on both sides.
    """
    key, low, high = _col(key), math.log(ratio[0]), math.log(ratio[1])

    def box(t: Column) -> Column:
        area = F.lit(float(h * w)) * (F.lit(scale[0]) + hash_uniform(seed, key, t, F.lit("area")) * F.lit(scale[1] - scale[0]))
        aspect = F.exp(F.lit(low) + hash_uniform(seed, key, t, F.lit("aspect")) * F.lit(high - low))
        tall, wide = F.sqrt(area / aspect), F.sqrt(area * aspect)
        if strict:
            tall, wide = F.sqrt(area * aspect), F.sqrt(area / aspect)
        return F.struct(
            F.rint(tall).cast("int").alias("bh"),
            F.rint(wide).cast("int").alias("bw"),
            hash_uniform(seed, key, t, F.lit("top")).alias("u"),
            hash_uniform(seed, key, t, F.lit("left")).alias("v"),
        )

    def fits(b: Column) -> Column:
        if strict:
            return (b["bh"] < h) & (b["bw"] < w) & (b["bh"] > 0) & (b["bw"] > 0)
        return (b["bh"] > 0) & (b["bh"] <= h) & (b["bw"] > 0) & (b["bw"] <= w)

    first = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), box), fits), F.lit(0))
    return F.when(
        first.isNotNull(),
        F.struct(
            F.floor(first["u"] * (h - first["bh"] + 1)).cast("int").alias("top"),
            F.floor(first["v"] * (w - first["bw"] + 1)).cast("int").alias("left"),
            first["bh"].alias("bh"),
            first["bw"].alias("bw"),
        ),
    )


def random_resized_crop(
    px: str | Column, key: str | Column, h: int, w: int, new_h: int, new_w: int, c: int = 1,
    seed: int = 0, scale: tuple[float, float] = (0.08, 1.0), ratio: tuple[float, float] = (3 / 4, 4 / 3),
) -> Column:
    """Hashed crop box, resized to a fixed size; the whole centre square if no box fits."""
    side = min(h, w)
    centre = F.struct(
        F.lit((h - side) // 2).alias("top"), F.lit((w - side) // 2).alias("left"), F.lit(side).alias("bh"), F.lit(side).alias("bw")
    )
    box = F.coalesce(hashed_box(seed, key, h, w, scale, ratio, strict=False), centre)

    def cut(b: Column) -> Column:
        def source(i: Column) -> Column:
            p = F.floor(i / c)
            y = b["top"] + F.floor((F.floor(p / new_w) * 2 + 1) * b["bh"] / (2 * new_h))
            x = b["left"] + F.floor((p % new_w * 2 + 1) * b["bw"] / (2 * new_w))
            return (y * w + x) * c + i % c

        return gather(_col(px), new_h * new_w * c, source)

    return bind(box, cut)


def flip(px: str | Column, w: int, c: int = 1) -> Column:
    """Mirror left to right."""
    def mirrored(a: Column) -> Column:
        def source(i: Column) -> Column:
            p = F.floor(i / c)
            return (p - p % w + (w - 1 - p % w)) * c + i % c

        return F.transform(a, lambda v, i: F.get(a, source(i).cast("int")))

    return bind(_col(px), mirrored)


def random_flip(px: str | Column, key: str | Column, w: int, c: int = 1, seed: int = 0, p: float = 0.5) -> Column:
    return F.when(hash_uniform(seed, key, F.lit("flip")) < F.lit(p), flip(px, w, c)).otherwise(_col(px))


def jitter_factor(seed: int, key: str | Column, step: str, reach: float) -> Column:
    """Uniform in [max(0, 1 - reach), 1 + reach]."""
    low = max(0.0, 1.0 - reach)
    return F.lit(low) + hash_uniform(seed, key, F.lit(step)) * F.lit(1.0 + reach - low)


def _clip(x: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))


def brightness(px: str | Column, factor: Column) -> Column:
    return bind(factor, lambda f: F.transform(_col(px), lambda x: _clip(x * f)))


def contrast(px: str | Column, factor: Column, c: int = 1) -> Column:
    """Blend with the rounded mean luma of the image."""
    def blend(a: Column) -> Column:
        gray = a if c == 1 else grayscale(a)
        mean = bind(gray, lambda g: F.floor(F.aggregate(g, F.lit(0.0), lambda s, x: s + x) / F.size(g) + F.lit(0.5)).cast("double"))
        return bind(F.struct(mean.alias("m"), factor.alias("f")), lambda r: F.transform(a, lambda x: _clip(r["m"] + r["f"] * (x - r["m"]))))

    return bind(_col(px), blend)


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    half = (size - 1) / 2
    raw = [math.exp(-0.5 * ((i - half) / sigma) ** 2) for i in range(size)]
    return [r / sum(raw) for r in raw]


def blur(px: str | Column, h: int, w: int, c: int = 1, sigma: float = 0.3) -> Column:
    """3 x 3 Gaussian blur; the edge is mirrored without repeating the border pixel."""
    k = gaussian_kernel(3, sigma)

    def mirror(v: Column, n: int) -> Column:
        return F.abs(F.lit(n - 1) - F.abs(F.lit(n - 1) - v))

    def smooth(a: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            p = F.floor(i / c)
            y, x, ch = F.floor(p / w), p % w, i % c
            acc = F.lit(0.0)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    at = (mirror(y + dy, h) * w + mirror(x + dx, w)) * c + ch
                    acc = acc + F.get(a, at.cast("int")) * F.lit(k[dy + 1] * k[dx + 1])
            return acc

        return F.transform(a, one)

    return bind(_col(px), smooth)


def random_erase(
    px: str | Column, key: str | Column, h: int, w: int, c: int = 1, seed: int = 0, p: float = 0.1,
    scale: tuple[float, float] = (0.02, 0.1), ratio: tuple[float, float] = (0.3, 3.3), value: float = 0.0,
) -> Column:
    """Overwrite one hashed rectangle with probability ``p``."""
    box = hashed_box(seed, key, h, w, scale, ratio, strict=True)

    def erased(b: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            q = F.floor(i / c)
            y, x = F.floor(q / w), q % w
            inside = (y >= b["top"]) & (y < b["top"] + b["bh"]) & (x >= b["left"]) & (x < b["left"] + b["bw"])
            return F.when(inside, F.lit(value)).otherwise(v)

        return F.transform(_col(px), one)

    return F.when(hash_uniform(seed, key, F.lit("erase")) < F.lit(p), bind(box, erased)).otherwise(_col(px))


def chain(px: str | Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """Compile a list of pixel transforms into one expression, each evaluated once per row."""
    out = _col(px)
    for step in steps:
        out = bind(out, step)
    return out


def by_split(px: str | Column, split: str, chains: dict[str, Sequence[Callable[[Column], Column]]]) -> Column:
    """The chain of each row's split; rows of other splits get NULL."""
    out = None
    for name, steps in chains.items():
        test = F.col(split) == name
        out = F.when(test, chain(px, steps)) if out is None else out.when(test, chain(px, steps))
    return out
