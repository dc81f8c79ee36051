"""Area, flip, confusion and region statistics (survey group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even
from maskloom.operators import statistics as st
from workload.registry import query
from workload.tables import CLASS_IDS, CLASSES

def run_of():
    """Five runs over the images."""
    return F.expr("image_id % 5")


@query("class_counts", """
SELECT image_id, class_id, pixels, round_even(pixels / CAST(sum(pixels) OVER (PARTITION BY image_id) AS DOUBLE) * 100, 3)::DOUBLE AS percent
FROM (SELECT image_id, pred_raw AS class_id, count(*) AS pixels FROM px GROUP BY ALL) c
""", "px")
def _class_counts(t):
    return st.class_counts(t.px, "pred_raw")


AREA = """
SELECT i.image_id, k.class_id, count(p.image_id) AS pixels, count(p.image_id) / 1024.0::DOUBLE * 100 AS percent
FROM images i CROSS JOIN classes k LEFT JOIN px p ON p.image_id = i.image_id AND p.{label} = k.class_id
GROUP BY ALL
"""


@query("area_percentages", f"""
SELECT image_id, class_id, pixels, round_even(percent, 6)::DOUBLE AS percent FROM ({AREA.format(label='pred_raw')}) a
""", "px images classes")
def _area(t):
    return st.area_percentages(t.px, "pred_raw", CLASSES).select(
        "image_id", "class_id", "pixels", half_even(F.col("percent"), 6).alias("percent")
    )


@query("area_change", f"""
SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.class_id, b.class_id) AS class_id,
       coalesce(a.pixels, 0) AS raw_pixels, coalesce(b.pixels, 0) AS refined_pixels,
       coalesce(b.pixels, 0) - coalesce(a.pixels, 0) AS delta_pixels,
       round_even(coalesce(b.percent, 0) - coalesce(a.percent, 0), 6)::DOUBLE AS delta_percent
FROM ({AREA.format(label='pred_raw')}) a FULL JOIN ({AREA.format(label='pred_refined')}) b
  ON a.image_id = b.image_id AND a.class_id = b.class_id
""", "px images classes")
def _area_change(t):
    raw = st.area_percentages(t.px, "pred_raw", CLASSES)
    refined = st.area_percentages(t.px, "pred_refined", CLASSES)
    return st.area_change(raw, refined).select(
        "image_id", "class_id", "raw_pixels", "refined_pixels", "delta_pixels",
        half_even(F.col("delta_percent"), 6).alias("delta_percent"),
    )


FLIPS = """
SELECT image_id % 5 AS run_id, class_id, sum((pred_raw = class_id)::INT)::BIGINT AS raw_pixels,
       sum((pred_refined = class_id)::INT)::BIGINT AS refined_pixels,
       sum((pred_raw = class_id AND pred_refined <> class_id)::INT)::BIGINT AS flipped_out_pixels,
       sum((pred_raw <> class_id AND pred_refined = class_id)::INT)::BIGINT AS flipped_in_pixels
FROM px CROSS JOIN classes GROUP BY ALL
"""


@query("flip_stats", f"""
SELECT *, coalesce(round_even(flipped_out_pixels / nullif(raw_pixels, 0)::DOUBLE, 6), 0)::DOUBLE AS flipped_out_rate,
       coalesce(round_even(flipped_in_pixels / nullif(refined_pixels, 0)::DOUBLE, 6), 0)::DOUBLE AS flipped_in_rate
FROM ({FLIPS}) f
""", "px classes")
def _flip_stats(t):
    pairs = st.label_pairs(t.px.withColumn("run_id", run_of()), "pred_raw", "pred_refined", ["run_id"])
    out = st.flip_stats(pairs, CLASSES, ["run_id"])
    return out.drop("name").withColumns({
        c: half_even(F.col(c), 6) for c in ("flipped_out_rate", "flipped_in_rate")
    })


@query("flip_totals", """
SELECT image_id, count(*) AS total_pixels, sum((pred_raw <> pred_refined)::INT)::BIGINT AS flip_pixels,
       round_even(sum((pred_raw <> pred_refined)::INT) / count(*)::DOUBLE, 6)::DOUBLE AS flip_rate
FROM px GROUP BY image_id
""", "px")
def _flip_totals(t):
    pairs = st.label_pairs(t.px, "pred_raw", "pred_refined", ["image_id"])
    return st.flip_totals(pairs).withColumn("flip_rate", half_even(F.col("flip_rate"), 6))


@query("run_rollup", """
SELECT coalesce(run_id, -1) AS run_id, coalesce(image_id, -1) AS image_id, coalesce(class_id, -1) AS class_id,
       count(*) AS pixels, CAST(grouping(run_id, image_id, class_id) AS INTEGER) AS level
FROM (SELECT image_id % 5 AS run_id, image_id, pred_raw AS class_id FROM px) p
GROUP BY ROLLUP (run_id, image_id, class_id) HAVING grouping(run_id, image_id, class_id) < 7
""", "px")
def _run_rollup(t):
    out = st.run_rollup(t.px.withColumn("run_id", run_of()), "pred_raw", "run_id")
    return out.fillna(-1, subset=["image_id", "class_id"])


@query("run_area", """
SELECT run_id, class_id, pixels,
       round_even(pixels / sum(pixels) OVER (PARTITION BY run_id)::DOUBLE * 100, 6)::DOUBLE AS percent
FROM (SELECT r.run_id, k.class_id, count(p.image_id) AS pixels
      FROM (SELECT DISTINCT image_id % 5 AS run_id FROM images) r CROSS JOIN classes k
      LEFT JOIN px p ON p.image_id % 5 = r.run_id AND p.pred_refined = k.class_id GROUP BY ALL) c
""", "px images classes")
def _run_area(t):
    per_image = st.class_counts(t.px, "pred_refined").withColumn("run_id", run_of())
    return st.aggregate_area(per_image, CLASSES, ["run_id"]).select(
        "run_id", "class_id", "pixels", half_even(F.col("percent"), 6).alias("percent")
    )


@query("confusion_matrix", """
SELECT true_class, sum((pred_raw = 0)::INT)::BIGINT AS p_0, sum((pred_raw = 1)::INT)::BIGINT AS p_1,
       sum((pred_raw = 2)::INT)::BIGINT AS p_2, sum((pred_raw = 3)::INT)::BIGINT AS p_3
FROM px GROUP BY true_class
""", "px")
def _confusion(t):
    return st.confusion_matrix(t.px, "true_class", "pred_raw", CLASS_IDS)


@query("iou_accuracy", """
SELECT image_id, class_id,
       round_even(sum((true_class = class_id AND pred_raw = class_id)::INT)
         / nullif(sum((true_class = class_id OR pred_raw = class_id)::INT), 0)::DOUBLE, 5)::DOUBLE AS iou,
       round_even(sum((true_class = pred_raw)::INT) / count(*)::DOUBLE, 5)::DOUBLE AS pixel_accuracy
FROM px CROSS JOIN classes GROUP BY ALL
""", "px classes")
def _iou(t):
    return st.iou_accuracy(t.px, "true_class", "pred_raw", CLASS_IDS, ["image_id"])


@query("region_means", """
SELECT image_id, seg_id, count(*) AS pixels, round_even(avg(r), 6)::DOUBLE AS mean_r,
       round_even(avg(g), 6)::DOUBLE AS mean_g, round_even(avg(b), 6)::DOUBLE AS mean_b FROM px GROUP BY ALL
""", "px")
def _region_means(t):
    out = st.region_means(t.px, ["r", "g", "b"])
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("mean_r", "mean_g", "mean_b")})


PROBA = [f"p{c}" for c in CLASS_IDS]


def proba_of():
    """One-sided class probabilities from the predicted class and its confidence."""
    return {f"p{c}": F.expr(f"CASE WHEN pred_raw = {c} THEN conf_u8 ELSE 0 END / 255D") for c in CLASS_IDS}


@query("region_probabilities", """
SELECT image_id, seg_id, round_even(p0 / s, 6)::DOUBLE AS p0, round_even(p1 / s, 6)::DOUBLE AS p1,
       round_even(p2 / s, 6)::DOUBLE AS p2, round_even(p3 / s, 6)::DOUBLE AS p3
FROM (SELECT *, p0 + p1 + p2 + p3 AS s FROM (
  SELECT image_id, seg_id, greatest(least(avg(CASE WHEN pred_raw = 0 THEN conf_u8 ELSE 0 END / 255.0::DOUBLE), 1), 1e-8) AS p0,
    greatest(least(avg(CASE WHEN pred_raw = 1 THEN conf_u8 ELSE 0 END / 255.0::DOUBLE), 1), 1e-8) AS p1,
    greatest(least(avg(CASE WHEN pred_raw = 2 THEN conf_u8 ELSE 0 END / 255.0::DOUBLE), 1), 1e-8) AS p2,
    greatest(least(avg(CASE WHEN pred_raw = 3 THEN conf_u8 ELSE 0 END / 255.0::DOUBLE), 1), 1e-8) AS p3
  FROM px GROUP BY ALL) a) b
""", "px")
def _region_probabilities(t):
    px = t.px.withColumns(proba_of())
    out = st.region_probabilities(px, PROBA)
    return out.withColumns({c: half_even(F.col(c), 6) for c in PROBA})


@query("region_histogram", """
SELECT image_id, seg_id, bin, round_even(count(p.code) / 16.0::DOUBLE, 6)::DOUBLE AS share
FROM (SELECT DISTINCT image_id, seg_id, CAST(unnest(range(10)) AS INTEGER) AS bin FROM px) s
LEFT JOIN (SELECT image_id AS i, seg_id AS s_id, CAST(gray // 20 AS INTEGER) AS c0, least(gray // 20, 9) AS code FROM px) p
  ON p.i = s.image_id AND p.s_id = s.seg_id AND p.code = s.bin GROUP BY ALL
""", "px")
def _region_histogram(t):
    out = st.region_histogram(t.px.withColumn("code", F.expr("gray DIV 20")), "code", 10)
    return out.select("image_id", "seg_id", F.posexplode("hist").alias("bin", "share")).withColumn(
        "share", half_even(F.col("share"), 6)
    )


@query("region_centroids", """
SELECT image_id, seg_id, avg(col) AS x, avg("row") AS y, count(*) AS pixels FROM px GROUP BY ALL
""", "px")
def _region_centroids(t):
    return st.region_centroids(t.px)


@query("mask_area_bbox", """
SELECT image_id, pred_refined AS class_id, count(*) AS area, min(col) AS x, min("row") AS y,
       max(col) - min(col) + 1 AS width, max("row") - min("row") + 1 AS height
FROM px WHERE pred_refined > 0 GROUP BY ALL
""", "px")
def _mask_bbox(t):
    fg = t.px.where("pred_refined > 0").withColumn("class_id", F.col("pred_refined"))
    return st.mask_area_bbox(fg, ["image_id", "class_id"])


@query("polygon_area", "SELECT ann_id, CAST(w * h AS DOUBLE) AS polygon_area FROM ann", "ann")
def _polygon_area(t):
    return t.polygons.select("ann_id", st.polygon_area(F.col("polygon")).alias("polygon_area"))


@query("top_area_changes", f"""
SELECT image_id, class_id, delta_percent, CAST(row_number() OVER (PARTITION BY image_id ORDER BY abs(delta_percent) DESC, class_id) AS INTEGER) AS rank
FROM (SELECT a.image_id, a.class_id, b.percent - a.percent AS delta_percent
      FROM ({AREA.format(label='pred_raw')}) a JOIN ({AREA.format(label='pred_refined')}) b
        ON a.image_id = b.image_id AND a.class_id = b.class_id) c
QUALIFY rank <= 3
""", "px images classes")
def _top_area(t):
    raw = st.area_percentages(t.px, "pred_raw", CLASSES)
    refined = st.area_percentages(t.px, "pred_refined", CLASSES)
    changes = st.area_change(raw, refined)
    return st.top_area_changes(changes, ["image_id"]).select("image_id", "class_id", "delta_percent", "rank")
