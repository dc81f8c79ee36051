"""Augmentation (survey group J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from maskloom.operators import augment as au
from maskloom.operators import masks as mk
from maskloom.plans import augmentation as plan
from maskloom.operators.stencils import gaussian_taps
from workload.features import pass_sql
from workload.registry import query
from workload.tables import SIDE

PX = ["image_id", "row", "col", "r", "g", "b"]


def _sized(t):
    return t.px.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})


@query("aug_geometric", """
SELECT 'orig' AS t, image_id, "row", col, r, pred_raw FROM px UNION ALL SELECT 'flip_h', image_id, "row", 31 - col, r, pred_raw FROM px
UNION ALL SELECT 'flip_v', image_id, 31 - "row", col, r, pred_raw FROM px UNION ALL SELECT 'rot90', image_id, 31 - col, "row", r, pred_raw FROM px
UNION ALL SELECT 'rot180', image_id, 31 - "row", 31 - col, r, pred_raw FROM px
""", "px")
def _geometric(t):
    parts = [
        au.geometric(_sized(t), name).select(F.lit(name).alias("t"), "image_id", "row", "col", "r", "pred_raw") for name in au.GEOMETRIC
    ]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("aug_grayscale", """
SELECT image_id, "row", col, CAST(floor(r * 0.25::DOUBLE + (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) * 0.75::DOUBLE) AS INTEGER) AS r,
  CAST(floor(g * 0.25::DOUBLE + (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) * 0.75::DOUBLE) AS INTEGER) AS g,
  CAST(floor(b * 0.25::DOUBLE + (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) * 0.75::DOUBLE) AS INTEGER) AS b FROM px
""", "px")
def _grayscale(t):
    return au.grayscale(t.px, {"alpha": 0.75}).select(*PX)


@query("aug_channel_shuffle", """
WITH o AS (SELECT image_id, CAST(floor(('0x' || substring(md5('9|order|' || image_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 6) AS INTEGER) AS k FROM images),
c AS (SELECT p.image_id, p."row", p.col, [r, g, b] AS v, ([[1,2,3],[1,3,2],[2,1,3],[2,3,1],[3,1,2],[3,2,1]])[k + 1] AS p FROM px p JOIN o ON o.image_id = p.image_id)
SELECT image_id, "row", col, v[p[1]] AS r, v[p[2]] AS g, v[p[3]] AS b FROM c
""", "px images")
def _shuffle(t):
    return au.channel_shuffle(t.px, {"mode": "random"}, seed=9).select(*PX)


@query("aug_channel_fixed", 'SELECT image_id, "row", col, b AS r, g, r AS b FROM px', "px")
def _fixed(t):
    return au.channel_shuffle(t.px, {"mode": "fixed"}).select(*PX)


@query("aug_noise")
def _noise(t):
    return au.gaussian_noise(t.px, {"std": 8.0}, seed=3).select(*PX)


@query("aug_speckle")
def _speckle(t):
    return au.speckle_noise(t.px, {"std": 0.15}, seed=3).select(*PX)


@query("aug_color_jitter")
def _jitter(t):
    return au.color_jitter(t.px, {}, seed=3).select(*PX)


G = gaussian_taps(1.5)


@query("aug_blur", f"""
WITH c AS (SELECT image_id, "row", col, r::DOUBLE AS v FROM px), h AS ({pass_sql('SELECT * FROM c', 'v', 'v', G, 'col', 'nearest')}),
w AS ({pass_sql('SELECT * FROM h', 'v', 'v', G, '"row"', 'nearest')})
SELECT image_id, "row", col, CAST(round_even(round(v, 9), 0) AS INTEGER) AS r FROM w
""", "px")
def _blur(t):
    return au.gaussian_blur(t.px, {"sigma": 1.5}).select("image_id", "row", "col", "r")


@query("resize_nearest", """
SELECT g.image_id, r.i AS "row", c.i AS col, p.pred_raw FROM images g CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS i) r CROSS JOIN (SELECT CAST(unnest(range(45)) AS INTEGER) AS i) c
JOIN px p ON p.image_id = g.image_id AND p."row" = floor((r.i + 0.5::DOUBLE) * (32 / 20.0::DOUBLE)) AND p.col = floor((c.i + 0.5::DOUBLE) * (32 / 45.0::DOUBLE))
""", "px images")
def _nearest(t):
    return au.resize_nearest(_sized(t), "pred_raw", 20, 45)


def axis_sql(source: str, along: str, goal: int) -> str:
    across = "col" if along == '"row"' else '"row"'
    scale, reach = f"(32 / {goal}.0::DOUBLE)", f"greatest(32 / {goal}.0::DOUBLE, 1)"
    weight = f"(1 - abs((s.{along} + 0.5::DOUBLE - (k.i + 0.5::DOUBLE) * {scale}) / {reach}))"
    return f"""SELECT s.image_id, s.{across}, k.i AS {along}, floor(round_even(sum(s.v * {weight}) / sum({weight}), 9) + 0.5) AS v FROM ({source}) s
JOIN (SELECT CAST(unnest(range({goal})) AS INTEGER) AS i) k ON {weight} > 0 GROUP BY ALL"""


@query("resize_bilinear", f"""
WITH c AS (SELECT image_id, "row", col, r AS v FROM px), h AS ({axis_sql('SELECT * FROM c', 'col', 40)}), w AS ({axis_sql('SELECT * FROM h', '"row"', 20)})
SELECT image_id, "row", col, CAST(v AS INTEGER) AS r FROM w
""", "px")
def _bilinear(t):
    return au.resize_bilinear(_sized(t), ["r"], 20, 40)


RECIPE = [
    {"transform": "rot90", "mode": "fifo", "percent": 50.0},
    {"transform": "flip_h", "mode": "random", "percent": 30.0},
    {"transform": "grayscale", "mode": "fifo", "percent": 100.0, "settings": {"alpha": 1.0}},
]

PLAN = """
n AS (SELECT *, row_number() OVER (ORDER BY file_name) AS by_name, row_number() OVER (ORDER BY md5('20021|' || image_id)) AS by_key, count(*) OVER () AS c FROM images),
s AS (SELECT 0 AS step, 'orig' AS transform, image_id, file_name FROM n UNION ALL SELECT 1, 'rot90', image_id, file_name FROM n WHERE by_name <= round_even(0.5::DOUBLE * c, 0)
  UNION ALL SELECT 2, 'flip_h', image_id, file_name FROM n WHERE by_key <= round_even(0.3::DOUBLE * c, 0) UNION ALL SELECT 3, 'grayscale', image_id, file_name FROM n),
pl AS (SELECT *, row_number() OVER (ORDER BY step, file_name, image_id) AS new_image_id FROM s)
"""


def _plan(t):
    return plan.plan_images(t.images, RECIPE, True, 7)


@query("augment_plan", f"""
WITH {PLAN} SELECT new_image_id, image_id, step, transform, 'images/img_' || image_id || '__i' || image_id || '__'
  || CASE step WHEN 0 THEN 'orig' WHEN 1 THEN 's01_r90' WHEN 2 THEN 's02_fh' ELSE 's03_gs' END || '.png' AS file_name FROM pl
""", "images")
def _augment_plan(t):
    return _plan(t).select("new_image_id", "image_id", "step", "transform", "file_name")


@query("augment_dataset", f"""
WITH {PLAN}, b AS (SELECT * FROM ann WHERE w * h >= 12)
SELECT row_number() OVER (ORDER BY pl.new_image_id, b.order_idx, b.ann_id) AS new_annotation_id, pl.new_image_id, b.category_id, b.w * b.h AS area,
  CASE transform WHEN 'rot90' THEN y0 WHEN 'flip_h' THEN 32 - x0 - w ELSE x0 END AS x, CASE transform WHEN 'rot90' THEN 32 - x0 - w ELSE y0 END AS y,
  CASE transform WHEN 'rot90' THEN h ELSE w END AS box_width, CASE transform WHEN 'rot90' THEN w ELSE h END AS box_height
FROM pl JOIN b ON b.image_id = pl.image_id
""", "images ann")
def _augment_dataset(t):
    boxes = t.ann.selectExpr(
        "ann_id", "image_id", "category_id", "order_idx", "w * h AS area", "x0 AS x", "y0 AS y", "w AS box_width", "h AS box_height"
    )
    out = plan.augment_annotations(boxes, _plan(t), t.images, 12)
    return out.select("new_annotation_id", "new_image_id", "category_id", "area", "x", "y", "box_width", "box_height")


@query("augment_dataset_rle", f"""
WITH {PLAN}, b AS (SELECT * FROM ann WHERE w * h >= 12),
m AS (SELECT pl.new_image_id, b.ann_id, CASE transform WHEN 'rot90' THEN y0 WHEN 'flip_h' THEN 32 - x0 - w ELSE x0 END AS x,
  CASE transform WHEN 'rot90' THEN 32 - x0 - w ELSE y0 END AS y, CASE transform WHEN 'rot90' THEN h ELSE w END AS bw,
  CASE transform WHEN 'rot90' THEN w ELSE h END AS bh FROM pl JOIN b ON b.image_id = pl.image_id),
c AS (SELECT *, 1024 - x * 32 - y - (bw - 1) * 32 - bh AS tail FROM m)
SELECT new_image_id, ann_id, x * 32 + y || ',' || bh || repeat(',' || (32 - bh) || ',' || bh, bw - 1)
  || CASE WHEN tail > 0 THEN ',' || tail ELSE '' END AS counts FROM c
""", "images ann")
def _augment_dataset_rle(t):
    sized = t.polygons.where("w * h >= 12").withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    runs = mk.polygon_runs(sized, ["image_id", "ann_id"])
    out = plan.augment_encoded(runs, _plan(t), t.images, ["ann_id"])
    # Through the compressed text and back.
    back = mk.decompress_counts(out.select("new_image_id", "ann_id", "compressed"), ["new_image_id", "ann_id"], "compressed")
    return back.select("new_image_id", "ann_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("augment_pixels", f"""
WITH {PLAN} SELECT pl.new_image_id, CASE transform WHEN 'rot90' THEN 31 - p.col ELSE p."row" END AS "row",
  CASE transform WHEN 'rot90' THEN p."row" WHEN 'flip_h' THEN 31 - p.col ELSE p.col END AS col,
  CASE WHEN transform = 'grayscale' THEN CAST(floor(r * 0.0::DOUBLE + (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) * 1.0::DOUBLE) AS INTEGER) ELSE r END AS r
FROM pl JOIN px p ON p.image_id = pl.image_id
""", "images px")
def _augment_pixels(t):
    made = plan.augment_pixels(_sized(t), _plan(t), RECIPE, True, 7)
    return made.select("new_image_id", "row", "col", "r")


@query("augment_masks", f"""
WITH {PLAN} SELECT pl.new_image_id, CASE transform WHEN 'rot90' THEN 31 - p.col ELSE p."row" END AS "row",
  CASE transform WHEN 'rot90' THEN p."row" WHEN 'flip_h' THEN 31 - p.col ELSE p.col END AS col, p.true_class AS class_id
FROM pl JOIN px p ON p.image_id = pl.image_id WHERE p.true_class > 0
""", "images px")
def _augment_masks(t):
    fg = t.px.where("true_class > 0").select("image_id", "row", "col", F.col("true_class").alias("class_id"))
    return plan.augment_masks(fg, _plan(t), t.images)


@query("transform_counts", f"WITH {PLAN} SELECT step, transform, count(*) AS images FROM pl GROUP BY ALL", "images")
def _counts(t):
    return plan.transform_counts(_plan(t))


def invert(px, settings={}, seed=0):
    return px.withColumns({c: (255 - F.col(c)).cast("int") for c in au.RGB})


@query("transform_plugin", 'SELECT image_id, "row", col, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM px', "px")
def _plugin(t):
    au.register_transform("invert", invert)
    return au.apply_transform(t.px, "invert").select(*PX)
