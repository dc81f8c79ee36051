"""Per-pixel feature channels, named from a config and computed in shared stages."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import color
from maskloom.functions.strings import short_number
from maskloom.operators.stencils import (
    Filter, apply_filters, box_taps, filter_block, gaussian_taps, irregular_images, kernel_taps, neighbour_lines, reach_of, run_tiles,
)
from maskloom.session import cut

# One-dimensional Laws vectors.
LAWS = {
    "L5": (1, 4, 6, 4, 1),
    "E5": (-1, -2, 0, 2, 1),
    "S5": (-1, 0, 2, 0, -1),
    "R5": (1, -4, 6, -4, 1),
    "W5": (-1, 2, 0, -2, 1),
}


@dataclass(frozen=True)
class FeatureConfig:
    use_rgb: bool = True
    use_hsv: bool = True
    use_lab: bool = True
    gaussian_sigmas: tuple[float, ...] = (1.0, 3.0)
    use_sobel: bool = True
    lbp_radii: tuple[int, ...] = ()
    lbp_points: int = 8
    gabor_frequencies: tuple[float, ...] = ()
    gabor_thetas: tuple[float, ...] = (0.0, 45.0, 90.0, 135.0)
    gabor_bandwidth: float = 1.0
    gabor_parts: tuple[str, ...] = ("mag",)
    laws_vectors: tuple[str, ...] = ()
    laws_window: int = 15
    laws_l5l5: bool = False
    laws_rotations: bool = False
    laws_abs: bool = True
    tensor: tuple[str, ...] = ()
    tensor_sigma: float = 1.0
    tensor_rho: float = 3.0
    stats_sigmas: tuple[float, ...] = ()
    stats_parts: tuple[str, ...] = ("mean", "std")


def laws_pairs(config: FeatureConfig) -> list[tuple[str, str]]:
    """Ordered vector pairs; with rotations both directions, L5·L5 only when asked for."""
    vectors = [v for v in config.laws_vectors if v in LAWS]
    both = [
        pair
        for i, left in enumerate(vectors)
        for right in vectors[0 if config.laws_rotations else i:]
        for pair in ([(left, right), (right, left)] if config.laws_rotations else [(left, right)])
    ]
    return [p for p in dict.fromkeys(both) if config.laws_l5l5 or p != ("L5", "L5")]


def feature_names(config: FeatureConfig) -> list[str]:
    n = short_number
    names: list[str] = []
    names += ["rgb_r", "rgb_g", "rgb_b"] * config.use_rgb
    names += ["hsv_h", "hsv_s", "hsv_v"] * config.use_hsv
    names += ["lab_l", "lab_a", "lab_b"] * config.use_lab
    names += [f"gauss_{n(s)}_{c}" for s in config.gaussian_sigmas for c in "rgb"]
    names += ["sobel_gray"] * config.use_sobel
    names += [f"lbp_p{config.lbp_points}_r{r}" for r in dict.fromkeys(config.lbp_radii)]
    names += [
        f"gabor_f{n(f)}_t{n(t)}_{part}"
        for f in config.gabor_frequencies for t in config.gabor_thetas
        for part in ("real", "imag", "mag") if part in config.gabor_parts
    ]
    names += [f"laws_{a}{b}_w{config.laws_window}" for a, b in laws_pairs(config)]
    if "eigenvalues" in config.tensor:
        names += ["structure_tensor_lambda1", "structure_tensor_lambda2"]
    names += [f"structure_tensor_{p}" for p in ("coherence", "orientation") if p in config.tensor]
    names += [
        f"local_stats_sigma{n(s)}_{p}"
        for s in config.stats_sigmas for p in ("mean", "std", "min", "max") if p in config.stats_parts
    ]
    return names


# --- channel families -------------------------------------------------------------------------

def color_channels(px: DataFrame) -> DataFrame:
    """rgb, hsv, lab and gray in unit range (lab in its own) from byte r, g, b: a projection."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    h, s, v = color.hsv(*rgb)
    lab_l, lab_a, lab_b = color.lab(*rgb)
    return px.withColumns({
        **{f"rgb_{c}": color.unit(F.col(c)) for c in "rgb"},
        "hsv_h": h, "hsv_s": s, "hsv_v": v, "lab_l": lab_l, "lab_a": lab_a, "lab_b": lab_b,
        "gray01": color.gray(*rgb),
    })


def gaussian_filter(name: str, source: str, sigma: float, mode: str = "nearest") -> Filter:
    taps = gaussian_taps(sigma)
    return Filter(name, ((source, taps, taps),), mode)


SMOOTH, SLOPE = kernel_taps((1, 2, 1)), ((-1, -1.0), (1, 1.0))


def slope_filters(source: str, prefix: str) -> list[Filter]:
    """Smoothed differences along columns (``_x``) and rows (``_y``), weights unnormalised."""
    return [
        Filter(f"{prefix}_x", ((source, SLOPE, SMOOTH),)), Filter(f"{prefix}_y", ((source, SMOOTH, SLOPE),))
    ]


def sobel_magnitude(prefix: str) -> Column:
    """Root of the mean squared difference, differences smoothed with (1, 2, 1) / 4."""
    return F.sqrt((F.pow(F.col(f"{prefix}_x") / 4, F.lit(2.0)) + F.pow(F.col(f"{prefix}_y") / 4, F.lit(2.0))) / 2)


def gabor_filters(source: str, prefix: str, frequency: float, theta_deg: float, bandwidth: float) -> list[Filter]:
    """Real and imaginary response.  With equal sigmas the kernel is a product of two complex
    one-dimensional kernels, so each response is two separable terms."""
    theta = math.radians(theta_deg)
    spread = 2.0 ** bandwidth
    sigma = math.sqrt(math.log(2) / 2) / math.pi * (spread + 1) / (spread - 1) / frequency
    reach = math.ceil(max(abs(3 * sigma * math.cos(theta)), abs(3 * sigma * math.sin(theta)), 1))

    def part(turn: float, wave, scale: float):
        return tuple(
            (-x, scale * math.exp(-0.5 * (x / sigma) ** 2) * wave(2 * math.pi * frequency * x * turn))
            for x in range(-reach, reach + 1)
        )

    scale = 1.0 / (2 * math.pi * sigma * sigma)
    cos_h, sin_h = part(math.cos(theta), math.cos, scale), part(math.cos(theta), math.sin, scale)
    cos_v, sin_v = part(math.sin(theta), math.cos, 1.0), part(math.sin(theta), math.sin, 1.0)
    minus = tuple((o, -w) for o, w in sin_v)
    return [
        Filter(f"{prefix}_real", ((source, cos_h, cos_v), (source, sin_h, minus))),
        Filter(f"{prefix}_imag", ((source, cos_h, sin_v), (source, sin_h, cos_v))),
    ]


def lbp_codes(px: DataFrame, value: str, points: int, radius: int, method: str = "uniform", out: str = "lbp") -> DataFrame:
    """Local binary pattern codes from ``points`` bilinear samples on a circle.

    Samples outside the image read 0.  Sample and centre are compared to six decimals, so equal
    neighbourhoods count as "not darker" whatever the interpolation rounding.
    """
    lines = neighbour_lines(px, value, radius)
    around = [F.try_element_at("_rows", F.lit(d)) for d in range(-radius, radius + 1)]
    coded = lines.select("image_id", "row", _lbp_lines(points, radius, method)(*around).alias("_codes"))
    return coded.select("image_id", "row", F.posexplode("_codes").alias("col", out))


def _lbp_codes(points: int, radius: int, method: str):
    """Codes of lines of one length, each given with its neighbour lines, all framed by ``radius`` zeros."""
    samples = []
    for p in range(points):
        dr = round(-radius * math.sin(2 * math.pi * p / points), 5)
        dc = round(radius * math.cos(2 * math.pi * p / points), 5)
        r0, c0 = math.floor(dr), math.floor(dc)
        corners = [
            (i, k, wr * wc)
            for i, wr in ((r0, 1 - (dr - r0)), (r0 + 1, dr - r0))
            for k, wc in ((c0, 1 - (dc - c0)), (c0 + 1, dc - c0)) if wr * wc
        ]
        samples.append(corners)

    def codes(block: dict[int, np.ndarray], length: int) -> np.ndarray:
        center = block[0][:, radius: radius + length]
        bits = np.stack([
            np.round(sum(block[i][:, radius + k: radius + k + length] * w for i, k, w in corners) - center, 6) >= 0
            for corners in samples
        ]).astype(np.int64)
        if method == "uniform":
            turns = (bits[1:] != bits[:-1]).sum(axis=0)
            return np.where(turns <= 2, bits.sum(axis=0), points + 1)
        powers = (1 << np.arange(points)).reshape(-1, 1, 1)
        if method == "default":
            return (bits * powers).sum(axis=0)
        return np.min([(np.roll(bits, -s, axis=0) * powers).sum(axis=0) for s in range(points)], axis=0)

    return codes


def _lbp_lines(points: int, radius: int, method: str):
    """Codes of a batch of raster lines, each given with its neighbour lines (NULL off the image)."""
    codes = _lbp_codes(points, radius, method)

    def run(*lines: pd.Series) -> pd.Series:
        lengths = lines[radius].map(len).to_numpy()
        out = np.empty(len(lengths), dtype=object)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            off = np.zeros(length)
            block = {
                d - radius: np.pad(
                    np.stack([off if v is None else v for v in line.to_numpy()[rows]]), ((0, 0), (radius, radius))
                )
                for d, line in enumerate(lines)
            }
            out[rows] = list(codes(block, length).astype(np.float64))
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")


# --- the stack --------------------------------------------------------------------------------

def feature_stack(px: DataFrame, config: FeatureConfig, carry: list[str] = []) -> DataFrame:
    """``image_id, row, col``, carried columns, and every channel under its name.

    Images that are full rectangles are filtered in tiles, all stages at once and without a shuffle of pixels dealt by image.  Of
    others the filters of a stage share two exchanges: one stage for blur, edges, Gabor, Laws and local
    statistics, one for the box and tensor smoothing that build on it, one for tensor integration.
    """
    if not feature_names(config):
        raise ValueError("no feature is switched on")
    held = px.select("image_id", "row", "col", *dict.fromkeys(["r", "g", "b", *carry]))
    odd = cut(irregular_images(held))
    if odd.isEmpty():
        return _stack_by_tiles(held, config, carry)
    same = F.col("image_id").eqNullSafe(F.col("_odd"))
    odd = odd.withColumnRenamed("image_id", "_odd").hint("merge")
    return _stack_by_tiles(held.join(odd, same, "left_anti"), config, carry).unionByName(
        _stack_by_lines(held.join(odd, same, "left_semi"), config, carry)
    )


def _stages(config: FeatureConfig) -> tuple[list[Filter], list[Filter], list[Filter]]:
    """Filters on the channels, on the responses of these, and on the smoothed tensor."""
    def n(value: float) -> str:
        return _plain(short_number(value))

    first: list[Filter] = []
    for s in config.gaussian_sigmas:
        first += [gaussian_filter(f"gauss_{n(s)}_{c}", f"rgb_{c}", s) for c in "rgb"]
    if config.use_sobel or config.tensor:
        first += slope_filters("gray01", "_slope")
    for f in config.gabor_frequencies:
        for t in config.gabor_thetas:
            first += gabor_filters("gray01", f"gabor_f{n(f)}_t{n(t)}", f, t, config.gabor_bandwidth)
    pairs = laws_pairs(config)
    first += [
        Filter(f"_laws_{a}{b}", (("gray01", kernel_taps(LAWS[b]), kernel_taps(LAWS[a])),)) for a, b in pairs
    ]
    for s in config.stats_sigmas:
        first += [gaussian_filter(f"local_stats_sigma{n(s)}_mean", "gray01", s), gaussian_filter(f"_sq_{n(s)}", "_gray2", s)]
        radius = max(1, round(s * 3.0))
        window = tuple((o, 1.0) for o in range(-radius, radius + 1))
        first += [
            Filter(f"local_stats_sigma{n(s)}_{k}", (("gray01", window, window),), kind=k)
            for k in ("min", "max") if k in config.stats_parts
        ]
    box = box_taps(config.laws_window)
    second = [Filter(f"laws_{a}{b}_w{config.laws_window}", ((f"_laws_{a}{b}", box, box),)) for a, b in pairs]
    if config.tensor:
        second += [gaussian_filter(f"_a{k}", f"_{k}", config.tensor_sigma, "reflect") for k in ("rr", "rc", "cc")]
    third = [gaussian_filter(f"_b{k}", f"_a{k}", config.tensor_rho) for k in ("rr", "rc", "cc")] if config.tensor and config.tensor_rho > 0 else []
    return first, second, third


def _magnitudes(config: FeatureConfig) -> dict[str, Column]:
    """Channels that follow from the first filters pixel by pixel."""
    def n(value: float) -> str:
        return _plain(short_number(value))

    derived = {}
    if config.use_sobel:
        derived["sobel_gray"] = sobel_magnitude("_slope")
    for f in config.gabor_frequencies:
        for t in config.gabor_thetas:
            stem = f"gabor_f{n(f)}_t{n(t)}"
            derived[f"{stem}_mag"] = F.hypot(f"{stem}_real", f"{stem}_imag")
    for s in config.stats_sigmas:
        mean = F.col(f"local_stats_sigma{n(s)}_mean")
        derived[f"local_stats_sigma{n(s)}_std"] = F.sqrt(F.greatest(F.col(f"_sq_{n(s)}") - mean * mean, F.lit(0.0)))
    return derived


def _tensor_channels() -> dict[str, Column]:
    half, diff = (F.col("_arr") + F.col("_acc")) / 2, F.col("_arr") - F.col("_acc")
    root = F.sqrt(F.pow(diff / 2, F.lit(2.0)) + F.pow(F.col("_arc"), F.lit(2.0)))
    return {
        "structure_tensor_lambda1": half + root, "structure_tensor_lambda2": half - root,
        "structure_tensor_coherence": (root * 2) / (half * 2 + 1e-8),
        "structure_tensor_orientation": (F.atan2(F.col("_arc") * 2, diff) / 2 + math.pi / 2) / math.pi,
    }


def _published(stage: DataFrame, config: FeatureConfig, carry: list[str]) -> DataFrame:
    return stage.select("image_id", "row", "col", *carry, *[F.col(_plain(c)).cast("float").alias(c) for c in feature_names(config)])


def _stack_by_tiles(px: DataFrame, config: FeatureConfig, carry: list[str]) -> DataFrame:
    """The stack of images that are full rectangles.  Channels of single pixels are worked out where the tiles arrive."""
    first, second, third = _stages(config)
    pairs, radii = laws_pairs(config), list(dict.fromkeys(config.lbp_radii))
    patterns = {r: _lbp_codes(config.lbp_points, r, "uniform") for r in radii}
    base = color_channels(px).withColumns({"_gray2": F.col("gray01") * F.col("gray01"), "_g": _byte_gray()})
    sources = sorted({s for f in first for s, _, _ in f.terms} | ({"_g"} if radii else set()))
    kept = list(dict.fromkeys(["r", "g", "b", *carry]))
    held = base.select("image_id", "row", "col", *kept, *sources)
    if not sources:
        stage = held
    else:
        names = [f"lbp_p{config.lbp_points}_r{r}" for r in radii]

        def coded(channels: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            gray = channels["_g"]
            out = {}
            for name, (r, codes) in zip(names, patterns.items()):
                framed = np.pad(gray, r)
                out[name] = codes({d: framed[r + d: r + d + len(gray)] for d in range(-r, r + 1)}, gray.shape[1]).astype(np.float64)
            return out

        def work(channels: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            out = filter_block(channels, first)
            for a, b in pairs:
                response = out[f"_laws_{a}{b}"]
                out[f"_laws_{a}{b}"] = np.abs(response) if config.laws_abs else response * response
            if config.tensor:
                x, y = out["_slope_x"], out["_slope_y"]
                out |= {"_rr": y * y, "_rc": y * x, "_cc": x * x}
            if second:
                out |= filter_block(out, second)
            if third:
                out |= {f"_a{k[2:]}": v for k, v in filter_block(out, third).items()}
            return out | (coded(channels) if radii else {})

        if radii:
            # One row per image, joined before the tiles: a pattern is divided by the greatest of its image.
            widest = max(radii)
            codes = run_tiles(base.select("image_id", "row", "col", "_g"), ["_g"], coded, names, widest)
            tops = codes.groupBy("image_id").agg(*[F.max(name).alias(f"_top_{name}") for name in names])
            held = held.join(tops.hint("merge"), "image_id")
        reach = max(reach_of(first) + reach_of(second) + reach_of(third), *radii, 0)
        made = [f.name for f in first if not f.name.startswith("_laws_")] + [f.name for f in second] + names
        stage = run_tiles(held, sources, work, made, reach)
        for name in names:
            top = F.col(f"_top_{name}")
            stage = stage.withColumn(name, F.when(top > 0, F.col(name) / top).otherwise(F.col(name)))
        stage = stage.withColumns(_magnitudes(config) | (_tensor_channels() if config.tensor else {}))
    return _published(color_channels(stage), config, carry)


def _stack_by_lines(px: DataFrame, config: FeatureConfig, carry: list[str]) -> DataFrame:
    """The stack of any pixels, in passes along lines."""
    # Dots in names would read as struct access, so channels carry dot-free names until the end.
    names = [_plain(c) for c in feature_names(config)]
    first, second, third = _stages(config)
    base = color_channels(px).withColumn("_gray2", F.col("gray01") * F.col("gray01"))
    point = [c for c in names if c.startswith(("rgb_", "hsv_", "lab_"))]
    stage = apply_filters(base, first, keep=[*carry, *point, "gray01"])
    derived = _magnitudes(config)
    for a, b in laws_pairs(config):
        response = F.col(f"_laws_{a}{b}")
        derived[f"_laws_{a}{b}"] = F.abs(response) if config.laws_abs else response * response
    if config.tensor:
        derived |= {
            "_rr": F.col("_slope_y") * F.col("_slope_y"), "_rc": F.col("_slope_y") * F.col("_slope_x"),
            "_cc": F.col("_slope_x") * F.col("_slope_x"),
        }
    stage = stage.withColumns(derived) if derived else stage
    done = {f.name for f in second}
    ready = [c for c in names if c in stage.columns and c not in done]
    stage = apply_filters(stage, second, keep=[*carry, *ready, "gray01"]) if second else stage
    if config.tensor:
        if third:
            stage = apply_filters(stage, third, keep=[c for c in stage.columns if not c.startswith("_a")])
            stage = stage.withColumnsRenamed({f"_b{k}": f"_a{k}" for k in ("rr", "rc", "cc")})
        stage = stage.withColumns(_tensor_channels())
    if config.lbp_radii:
        stage = _with_lbp(stage, base, config)
    return _published(stage, config, carry)


def _plain(name: str) -> str:
    return name.replace(".", "p")


def _byte_gray() -> Column:
    return F.greatest(F.least(F.bround(F.col("gray01") * 255), F.lit(255.0)), F.lit(0.0))


def _with_lbp(stage: DataFrame, base: DataFrame, config: FeatureConfig) -> DataFrame:
    gray = base.select("image_id", "row", "col", _byte_gray().alias("_g"))
    for r in dict.fromkeys(config.lbp_radii):
        name = f"lbp_p{config.lbp_points}_r{r}"
        codes = lbp_codes(gray, "_g", config.lbp_points, r)
        # One row per image; the division by the image maximum is a join, not a window per image.
        tops = codes.groupBy("image_id").agg(F.max("lbp").alias("_top"))
        scaled = codes.join(tops, "image_id").select(
            "image_id", "row", "col",
            F.when(F.col("_top") > 0, F.col("lbp") / F.col("_top")).otherwise(F.col("lbp")).alias(name),
        )
        stage = stage.join(scaled.hint("merge"), ["image_id", "row", "col"])
    return stage


def gather(stack: DataFrame, sampled: DataFrame) -> DataFrame:
    """Feature rows at sampled pixels only."""
    return sampled.join(stack, ["image_id", "row", "col"])
