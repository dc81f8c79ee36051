"""Feature channels (survey group J)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even
from maskloom.operators import features as ft
from maskloom.operators.stencils import apply_filters, gaussian_taps
from workload.registry import query
from workload.scalars import COLOR_SQL, _color

OFF = dict(use_rgb=False, use_hsv=False, use_lab=False, gaussian_sigmas=(), use_sobel=False)
PX = ["image_id", "row", "col"]


def rounded(df, digits=6, cut_at=None):
    names = [c for c in df.columns if c not in PX]
    return df.select(*PX, *[(half_even(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c) for c in names])


query("feat_color", COLOR_SQL, "px")(_color)

GRAY = "(r * 0.2125::DOUBLE + g * 0.7154::DOUBLE + b * 0.0721::DOUBLE) / 255"


def taps_sql(taps) -> str:
    return ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in taps)


def pass_sql(source: str, value: str, out: str, taps, along: str, edge: str) -> str:
    """One filter pass in SQL: every target pixel joined to its taps."""
    across = "col" if along == '"row"' else '"row"'
    at = {
        "nearest": f"greatest(least(a.{along} + k.o, 31), 0)",
        "reflect": f"CASE WHEN a.{along} + k.o < 0 THEN -1 - a.{along} - k.o WHEN a.{along} + k.o > 31 THEN 63 - a.{along} - k.o ELSE a.{along} + k.o END",
    }[edge]
    return f"""SELECT a.image_id, a."row", a.col, sum(k.w * s.{value}) AS {out} FROM px a CROSS JOIN (VALUES {taps_sql(taps)}) k(o, w)
JOIN ({source}) s ON s.image_id = a.image_id AND s.{across} = a.{across} AND s.{along} = {at} GROUP BY ALL"""


G1 = gaussian_taps(1.0)


@query("feat_gaussian", f"""
WITH c AS (SELECT image_id, "row", col, r / 255.0::DOUBLE AS v FROM px), h AS ({pass_sql('SELECT * FROM c', 'v', 'v', G1, 'col', 'nearest')}),
w AS ({pass_sql('SELECT * FROM h', 'v', 'v', G1, '"row"', 'nearest')})
SELECT image_id, "row", col, round_even(v, 6)::DOUBLE AS gauss_1_r FROM w
""", "px")
def _gaussian(t):
    base = ft.color_channels(t.px)
    return rounded(apply_filters(base, [ft.gaussian_filter("gauss_1_r", "rgb_r", 1.0)], keep=[]))


SOBEL = f"""
WITH c AS MATERIALIZED (SELECT image_id, "row", col, {GRAY} AS v FROM px),
n AS (SELECT a.image_id, a."row", a.col, sum(k.x * s.v) AS gx, sum(k.y * s.v) AS gy FROM px a
  CROSS JOIN (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) k(dr, dc, x, y)
  JOIN c s ON s.image_id = a.image_id AND s."row" = greatest(least(a."row" + k.dr, 31), 0) AND s.col = greatest(least(a.col + k.dc, 31), 0) GROUP BY ALL)
"""


@query("feat_sobel", SOBEL + """
SELECT image_id, "row", col, round_even(sqrt((gx / 4 * gx / 4 + gy / 4 * gy / 4) / 2), 6)::DOUBLE AS sobel_gray FROM n
""", "px")
def _sobel(t):
    base = ft.color_channels(t.px)
    edges = apply_filters(base, ft.slope_filters("gray01", "_slope"), keep=[])
    return rounded(edges.select(*PX, ft.sobel_magnitude("_slope").alias("sobel_gray")))


def lbp_values():
    rows = []
    for p in range(8):
        dr, dc = round(-math.sin(2 * math.pi * p / 8), 5), round(math.cos(2 * math.pi * p / 8), 5)
        r0, c0 = math.floor(dr), math.floor(dc)
        for i, wr in ((r0, 1 - (dr - r0)), (r0 + 1, dr - r0)):
            for k, wc in ((c0, 1 - (dc - c0)), (c0 + 1, dc - c0)):
                if wr * wc:
                    rows.append(f"({p}, {i}, {k}, {wr * wc!r}::DOUBLE)")
    return ", ".join(rows)


@query("feat_lbp", f"""
WITH s AS (SELECT a.image_id, a."row", a.col, a.gray, k.p, CAST(round_even(sum(coalesce(b.gray, 0) * k.w) - a.gray, 6) >= 0 AS INTEGER) AS bit
  FROM px a CROSS JOIN (VALUES {lbp_values()}) k(p, dr, dc, w)
  LEFT JOIN px b ON b.image_id = a.image_id AND b."row" = a."row" + k.dr AND b.col = a.col + k.dc GROUP BY a.image_id, a."row", a.col, a.gray, k.p),
q AS (SELECT image_id, "row", col, sum(bit) AS ones, list(bit ORDER BY p) AS bits FROM s GROUP BY ALL)
SELECT image_id, "row", col, CAST(CASE WHEN list_sum(list_transform(range(1, 8), lambda i: CASE WHEN bits[i] <> bits[i + 1] THEN 1 ELSE 0 END)) <= 2 THEN ones ELSE 9 END AS INTEGER) AS lbp FROM q
""", "px")
def _lbp(t):
    return ft.lbp_codes(t.px, "gray", 8, 1).select(*PX, F.col("lbp").cast("int").alias("lbp"))


@query("feat_gabor")
def _gabor(t):
    config = ft.FeatureConfig(**OFF, gabor_frequencies=(0.2,), gabor_thetas=(0.0, 45.0), gabor_parts=("real", "imag", "mag"))
    return rounded(ft.feature_stack(t.px, config))


L5, E5 = ft.kernel_taps(ft.LAWS["L5"]), ft.kernel_taps(ft.LAWS["E5"])
BOX5 = ft.box_taps(5)


@query("feat_laws", f"""
WITH c AS (SELECT image_id, "row", col, {GRAY} AS v FROM px), h AS ({pass_sql('SELECT * FROM c', 'v', 'v', E5, 'col', 'reflect')}),
w AS ({pass_sql('SELECT * FROM h', 'v', 'v', L5, '"row"', 'reflect')}), e AS (SELECT image_id, "row", col, abs(v) AS v FROM w),
bh AS ({pass_sql('SELECT * FROM e', 'v', 'v', BOX5, 'col', 'reflect')}), bw AS ({pass_sql('SELECT * FROM bh', 'v', 'v', BOX5, '"row"', 'reflect')})
SELECT image_id, "row", col, round_even(v, 4)::DOUBLE AS laws_L5E5_w5 FROM bw
""", "px")
def _laws(t):
    from maskloom.operators.stencils import Filter

    base = ft.color_channels(t.px)
    response = apply_filters(base, [Filter("_l", (("gray01", E5, L5),))], keep=[]).withColumn("_l", F.abs("_l"))
    return rounded(apply_filters(response, [Filter("laws_L5E5_w5", (("_l", BOX5, BOX5),))], keep=[]), 4)


@query("feat_structure_tensor")
def _tensor(t):
    config = ft.FeatureConfig(**OFF, tensor=("eigenvalues", "coherence", "orientation"), tensor_rho=1.0)
    return rounded(ft.feature_stack(t.px, config))


@query("feat_local_stats", f"""
WITH c AS (SELECT image_id, "row", col, {GRAY} AS v, {GRAY} * {GRAY} AS v2 FROM px),
h AS ({pass_sql('SELECT * FROM c', 'v', 'v', G1, 'col', 'nearest')}), m AS ({pass_sql('SELECT * FROM h', 'v', 'v', G1, '"row"', 'nearest')}),
h2 AS ({pass_sql('SELECT * FROM c', 'v2', 'v', G1, 'col', 'nearest')}), m2 AS ({pass_sql('SELECT * FROM h2', 'v', 'v', G1, '"row"', 'nearest')}),
rw AS (SELECT image_id, "row", col, min(v) OVER x AS lo, max(v) OVER x AS hi FROM c WINDOW x AS (PARTITION BY image_id, "row" ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
cw AS (SELECT image_id, "row", col, min(lo) OVER x AS lo, max(hi) OVER x AS hi FROM rw WINDOW x AS (PARTITION BY image_id, col ORDER BY "row" ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT m.image_id, m."row", m.col, round_even(m.v, 6)::DOUBLE AS mean, round_even(sqrt(greatest(m2.v - m.v * m.v, 0)), 5)::DOUBLE AS std,
  round_even(cw.lo, 6)::DOUBLE AS min, round_even(cw.hi, 6)::DOUBLE AS max
FROM m JOIN m2 ON m2.image_id = m.image_id AND m2."row" = m."row" AND m2.col = m.col JOIN cw ON cw.image_id = m.image_id AND cw."row" = m."row" AND cw.col = m.col
""", "px")
def _local(t):
    from maskloom.operators.stencils import Filter

    base = ft.color_channels(t.px).withColumn("g2", F.col("gray01") * F.col("gray01"))
    window = tuple((o, 1.0) for o in range(-3, 4))
    out = apply_filters(base, [
        ft.gaussian_filter("mean", "gray01", 1.0), ft.gaussian_filter("sq", "g2", 1.0),
        Filter("min", (("gray01", window, window),), kind="min"), Filter("max", (("gray01", window, window),), kind="max"),
    ], keep=[])
    std = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    shaped = out.select(*PX, "mean", std.alias("std"), "min", "max")
    return shaped.select(*PX, *[half_even(F.col(c), 5 if c == "std" else 6).alias(c) for c in ("mean", "std", "min", "max")])


@query("feature_stack")
def _stack(t):
    config = ft.FeatureConfig(
        gaussian_sigmas=(1.0,), lbp_radii=(1,), gabor_frequencies=(0.25,), gabor_thetas=(0.0, 90.0),
        laws_vectors=("L5", "E5"), laws_window=5, tensor=("coherence", "orientation"), tensor_rho=1.0, stats_sigmas=(1.0,),
    )
    return rounded(ft.feature_stack(t.px, config))
