"""Image and mask augmentation on pixel tables.

Random choices come from seeded hashes of (image, step, pixel), so a result does not depend on
partitioning, retries or row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import color
from maskloom.functions.hashing import seeded_unit
from maskloom.functions.numbers import half_even
from maskloom.operators.features import gaussian_filter
from maskloom.operators.stencils import apply_filters

RGB = ("r", "g", "b")

# Transform names and their short forms in output names.
GEOMETRIC = {"orig": "orig", "flip_h": "fh", "flip_v": "fv", "rot90": "r90", "rot180": "r180"}
PHOTOMETRIC = {
    "color_jitter": "cj", "grayscale": "gs", "channel_shuffle": "cs", "gaussian_noise": "gn",
    "speckle_noise": "sn", "gaussian_blur": "gb",
}


def moved(transform: str, row: Column, col: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Where a pixel goes: rot90 turns counter-clockwise."""
    places = {
        "orig": (row, col), "flip_h": (row, width - 1 - col), "flip_v": (height - 1 - row, col),
        "rot90": (width - 1 - col, row), "rot180": (height - 1 - row, width - 1 - col),
    }
    if transform not in places:
        raise ValueError(f"no such geometric step: {transform}")
    return places[transform]


def geometric(px: DataFrame, transform: str, height: str = "height", width: str = "width") -> DataFrame:
    """Pixels (of an image or a mask) in their new places: a projection, nothing is moved between tasks."""
    row, col = moved(transform, F.col("row"), F.col("col"), F.col(height), F.col(width))
    return px.withColumns({"row": row, "col": col})


def _byte(value: Column) -> Column:
    return F.floor(F.greatest(F.least(value, F.lit(255.0)), F.lit(0.0))).cast("int")


def _setting(settings: dict, name: str, low: float, high: float, default: float) -> float:
    try:
        value = float(settings.get(name, default))
    except (TypeError, ValueError):
        value = default
    return max(low, min(high, value))


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * color.LUMA_601[0] + g * color.LUMA_601[1] + b * color.LUMA_601[2]


def grayscale(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    alpha = _setting(settings, "alpha", 0.0, 1.0, 1.0)
    if alpha <= 0:
        return px
    gray = luma601(*[F.col(c) for c in RGB])
    return px.withColumns({c: _byte(F.col(c) * (1.0 - alpha) + gray * alpha) for c in RGB})


def channel_shuffle(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    """A fixed order (2, 1, 0 unless given) or one of the six orders drawn per image."""
    channels = F.array(*RGB)
    if str(settings.get("mode", "random")).strip().lower() == "fixed":
        order = settings.get("order")
        order = [int(v) for v in (order.split(",") if isinstance(order, str) else order or (2, 1, 0))]
        if sorted(order) != [0, 1, 2]:
            order = [2, 1, 0]
        return px.select(*[c for c in px.columns if c not in RGB], *[F.col(RGB[o]).alias(c) for c, o in zip(RGB, order)])
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    table = F.array(*[F.array(*[F.lit(v) for v in o]) for o in orders])
    drawn = F.get(table, F.floor(seeded_unit(seed, F.lit("order"), F.col("image_id")) * 6).cast("int"))
    return px.select(
        *[c for c in px.columns if c not in RGB],
        *[F.get(channels, F.get(drawn, F.lit(i))).alias(c) for i, c in enumerate(RGB)],
    )


def _normal(seed: int, *keys: Column) -> Column:
    """Standard normal from two seeded uniforms."""
    first = F.greatest(seeded_unit(seed, F.lit("u"), *keys), F.lit(1e-12))
    return F.sqrt(F.log(first) * -2.0) * F.cos(seeded_unit(seed, F.lit("v"), *keys) * (2 * math.pi))


def _noise(px: DataFrame, seed: int, shift, mean: float, std: float) -> DataFrame:
    def drawn(channel: str) -> Column:
        return _normal(seed, F.col("image_id"), F.col("row"), F.col("col"), F.lit(channel)) * std + mean

    return px.withColumns({c: _byte(shift(F.col(c), drawn(c))) for c in RGB})


def gaussian_noise(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    mean, std = _setting(settings, "mean", -255.0, 255.0, 0.0), _setting(settings, "std", 0.0, 255.0, 8.0)
    return px if std <= 0 else _noise(px, seed, lambda v, n: v + n, mean, std)


def speckle_noise(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    std = _setting(settings, "std", 0.0, 3.0, 0.15)
    return px if std <= 0 else _noise(px, seed, lambda v, n: v + v * n, 0.0, std)


def gaussian_blur(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    sigma = _setting(settings, "sigma", 0.0, 10.0, 1.0)
    if sigma <= 0:
        return px
    kept = [c for c in px.columns if c not in RGB]
    blurred = apply_filters(px, [gaussian_filter(f"_b_{c}", c, sigma) for c in RGB], keep=kept)
    return blurred.select(*kept, *[_byte(half_even(F.col(f"_b_{c}"))).alias(c) for c in RGB])


def color_jitter(px: DataFrame, settings: dict = {}, seed: int = 0) -> DataFrame:
    """Brightness, contrast and saturation factors and a hue turn, each drawn once per image.

    A factor f blends from a degenerate image: black, the mean gray level, the gray image.
    """
    ranges = {k: _setting(settings, k, 0.0, 1.0, 0.2) for k in ("brightness", "contrast", "saturation")}
    hue = abs(_setting(settings, "hue", -0.5, 0.5, 0.05))

    def factor(kind: str, reach: float) -> Column:
        return (seeded_unit(seed, F.lit(kind), F.col("image_id")) * 2 - 1) * reach

    def blend(base: Column, channel: str, f: Column) -> Column:
        return _byte(base + (F.col(channel) - base) * f)

    if ranges["brightness"] > 0:
        f = factor("brightness", ranges["brightness"]) + 1
        px = px.withColumns({c: blend(F.lit(0.0), c, f) for c in RGB})
    gray = F.floor(luma601(*[F.col(c) for c in RGB]) + 0.5)
    if ranges["contrast"] > 0:
        means = px.groupBy("image_id").agg(F.floor(F.avg(gray) + 0.5).alias("_mean"))
        f = factor("contrast", ranges["contrast"]) + 1
        px = px.join(means, "image_id").withColumns({c: blend(F.col("_mean"), c, f) for c in RGB}).drop("_mean")
    if ranges["saturation"] > 0:
        f = factor("saturation", ranges["saturation"]) + 1
        px = px.withColumns({c: blend(gray, c, f) for c in RGB})
    if hue > 0:
        h, s, v = color.hsv(*[F.col(c) for c in RGB])
        turned = F.pmod(h + half_even(factor("hue", hue) * 255) / 255.0, F.lit(1.0))
        px = px.withColumns({"_h": turned, "_s": s, "_v": v})
        rgb = color.rgb_from_hsv(F.col("_h"), F.col("_s"), F.col("_v"))
        px = px.withColumns({c: _byte(half_even(value * 255)) for c, value in zip(RGB, rgb)}).drop("_h", "_s", "_v")
    return px


# Plug-in table of image transforms: name to function of (pixels, settings, seed).
TRANSFORMS = {
    "color_jitter": color_jitter, "grayscale": grayscale, "channel_shuffle": channel_shuffle,
    "gaussian_noise": gaussian_noise, "speckle_noise": speckle_noise, "gaussian_blur": gaussian_blur,
}


def register_transform(name: str, job) -> None:
    TRANSFORMS[name] = job


def apply_transform(px: DataFrame, transform: str, settings: dict = {}, seed: int = 0) -> DataFrame:
    if transform in GEOMETRIC:
        return geometric(px, transform)
    if transform not in TRANSFORMS:
        raise ValueError(f"no step is registered as {transform!r}")
    return TRANSFORMS[transform](px, settings, seed)


# --- resize -----------------------------------------------------------------------------------

def resize_nearest(px: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Each target pixel takes the source pixel under its centre.

    Every source pixel names the targets that read it, so there is no grid to join against.
    ``px`` carries the source ``height`` and ``width``.
    """
    def targets(position: str, size: Column, goal: int) -> Column:
        # Target i reads floor((i + 0.5) * size / goal).
        scale = size / F.lit(float(goal))
        low = F.greatest(F.floor(F.col(position) / scale - 0.5) - 1, F.lit(0))
        high = F.least(F.ceil((F.col(position) + 1) / scale - 0.5) + 1, F.lit(goal - 1))
        return F.filter(F.sequence(low, high), lambda i: F.floor((i + 0.5) * scale) == F.col(position))

    rows = px.withColumn("_row", F.explode(targets("row", F.col("height"), height)))
    cells = rows.withColumn("_col", F.explode(targets("col", F.col("width"), width)))
    return cells.select("image_id", F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), value)


def resize_bilinear(px: DataFrame, channels: list[str], height: int, width: int) -> DataFrame:
    """Triangle-filter resize, columns then rows, rounding to whole numbers after each.

    The triangle is widened when shrinking, so every source pixel counts.  Each source pixel is sent
    to the targets within its reach and weights are normalised per target.
    """
    def one_axis(frame: DataFrame, position: str, size: str, goal: int) -> DataFrame:
        other = "row" if position == "col" else "col"
        kept = [c for c in ("height", "width") if c != size and c in frame.columns]
        scale = F.col(size) / F.lit(float(goal))
        reach = F.greatest(scale, F.lit(1.0))
        low = F.greatest(F.floor((F.col(position) + 0.5 - reach) / scale - 0.5) - 1, F.lit(0))
        high = F.least(F.ceil((F.col(position) + 0.5 + reach) / scale - 0.5) + 1, F.lit(goal - 1))
        spread = frame.withColumn("_t", F.explode(F.sequence(low, high)))
        weight = F.greatest(
            F.lit(1.0) - F.abs((F.col(position) + 0.5 - (F.col("_t") + 0.5) * scale) / reach), F.lit(0.0)
        )
        weighted = spread.withColumn("_w", weight).where("_w > 0")
        return weighted.groupBy("image_id", *kept, other, F.col("_t").cast("int").alias(position)).agg(*[
            F.floor(half_even(F.sum(F.col(c) * F.col("_w")) / F.sum("_w"), 9) + 0.5).alias(c) for c in channels
        ])

    narrow = one_axis(px.select("image_id", "height", "width", "row", "col", *channels), "col", "width", width)
    return one_axis(narrow, "row", "height", height).select(
        "image_id", "row", "col", *[F.col(c).cast("int").alias(c) for c in channels]
    )
