"""Polygons, run-length masks, overlap and dataset merge (survey groups D, F, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import line_runs as lr
from maskloom.operators import masks as mk
from maskloom.plans.painting import paint_annotations
from workload.registry import query
from workload.scratch import scratch
from workload.tables import SIDE


def polygon_px(t, *carry):
    return mk.runs_to_pixels(mk.polygon_runs(
        t.polygons.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)}), ["ann_id", "image_id", *carry]
    ))


@query("polygon_rasterize", 'SELECT ann_id, image_id, "row", col FROM ann_px', "ann_px")
def _rasterize(t):
    return polygon_px(t)


RECT_COUNTS = """
SELECT ann_id, CASE WHEN x0 * 32 + y0 > -1 THEN x0 * 32 + y0 END AS lead_gap, h, w, x0, y0 FROM ann
"""


@query("runs_to_mask", 'SELECT ann_id, "row", col FROM ann_px', "ann_px")
def _runs_to_mask(t):
    # Through the compressed text form and back, so both directions are exercised.
    text = t.counts.select("ann_id", mk.compress_counts(F.col("counts")).alias("text"))
    counts = mk.decompress_counts(text, ["ann_id"], "text")
    good, _ = mk.split_rle(counts.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)}), "counts", "height", "width")
    flat = mk.counts_to_flat_runs(good, ["ann_id"])
    return mk.flat_runs_to_pixels(flat, ["ann_id"], SIDE, column_major=True)


@query("rle_rejects", """
SELECT CASE WHEN bad = 1 THEN 'counts do not fill the image' ELSE 'ok' END AS outcome, count(*) AS n
FROM (SELECT CASE WHEN order_idx % 13 = 0 THEN 1 ELSE 0 END AS bad FROM ann) a GROUP BY ALL
""", "ann")
def _rle_rejects(t):
    broken = t.counts.withColumn(
        "counts", F.when(F.col("order_idx") % 13 == 0, F.slice("counts", 1, F.size("counts") - 1)).otherwise(F.col("counts"))
    ).withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    good, bad = mk.split_rle(broken, "counts", "height", "width")
    both = good.select(F.lit("ok").alias("outcome")).unionAll(bad.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query("mask_to_runs", """
WITH f AS (SELECT image_id, pred_refined AS class_id, col * 32 + "row" AS idx FROM px WHERE pred_refined > 0),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY image_id, class_id ORDER BY idx) AS island FROM f)
SELECT image_id, class_id, min(idx) AS start, count(*) AS len FROM g GROUP BY image_id, class_id, island
""", "px")
def _mask_to_runs(t):
    fg = t.px.where("pred_refined > 0").withColumn("class_id", F.col("pred_refined"))
    return mk.flat_runs(fg, ["image_id", "class_id"], SIDE, column_major=True)


@query("mask_to_counts", """
WITH f AS (SELECT image_id, pred_refined AS class_id, col * 32 + "row" AS idx FROM px WHERE pred_refined > 0),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY image_id, class_id ORDER BY idx) AS island FROM f),
r AS (SELECT image_id, class_id, min(idx) AS s, count(*) AS n FROM g GROUP BY image_id, class_id, island),
q AS (SELECT *, s - coalesce(lag(s + n) OVER w, 0) AS gap, row_number() OVER w AS i,
        max(s + n) OVER (PARTITION BY image_id, class_id) AS fin FROM r WINDOW w AS (PARTITION BY image_id, class_id ORDER BY s))
SELECT image_id, class_id, string_agg(gap || ',' || n, ',' ORDER BY i) || CASE WHEN max(fin) < 1024 THEN ',' || (1024 - max(fin)) ELSE '' END AS counts
FROM q GROUP BY image_id, class_id
""", "px")
def _mask_to_counts(t):
    fg = t.px.where("pred_refined > 0").withColumn("class_id", F.col("pred_refined"))
    flat = mk.flat_runs(fg, ["image_id", "class_id"], SIDE, column_major=True)
    counts = mk.rle_counts(flat, ["image_id", "class_id"], SIDE * SIDE)
    return counts.select("image_id", "class_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


PAINT = """
SELECT image_id, "row", col, arg_max(category_id, {key}) AS class_id FROM
(SELECT *, CASE WHEN area <= 0 THEN CAST(w * h AS DOUBLE) ELSE area END AS a FROM ann_px) p GROUP BY image_id, "row", col
"""


def painted(t, policy):
    """The label map as runs; queries that need pixels list them at the end, where nothing is shuffled any more."""
    from maskloom.operators.statistics import polygon_area

    # Annotations become lines where they lie and travel once, as whole masks, so they carry no more than their outline.
    sized = t.outlined.select(
        "image_id", "category_id", "order_idx", "ann_id", "polygon",
        F.when(F.col("area") <= 0, polygon_area(F.col("polygon"))).otherwise(F.col("area")).alias("area"),
    )
    ranked = mk.paint_order(sized, policy, ["order_idx", "ann_id"]).withColumn("outlines", F.array("polygon"))
    runs = mk.outline_runs(ranked, ["image_id", "category_id", "paint_rank"], height=SIDE, width=SIDE, whole=True)
    return lr.painted_runs(runs, "category_id", "paint_rank").withColumnRenamed("category_id", "class_id")


@query("overlap_resolve", PAINT.format(key="(a, order_idx, ann_id)"), "ann_px")
def _overlap_area(t):
    return mk.runs_to_pixels(painted(t, "higher_area_wins"))


@query("overlap_resolve_last", PAINT.format(key="(order_idx, ann_id)"), "ann_px")
def _overlap_last(t):
    return mk.runs_to_pixels(painted(t, "last_annotation_wins"))


def mixed_annotations(t):
    """Annotation rows in three forms by order: outlines, run counts, compressed counts; some counts are cut short."""
    from maskloom.sources import coco

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    outline = F.expr("cast(array(x0, y0, x0 + w, y0, x0 + w, y0 + h, x0, y0 + h) AS array<double>)")
    rows = t.counts.withColumn("polygon", outline)
    counts = F.when(F.col("order_idx") % 13 == 0, F.slice("counts", 1, F.size("counts") - 1)).otherwise(F.col("counts"))
    listed = text("[", F.array_join(counts.cast("array<string>"), ","), "]")
    packed = text('"', F.replace(mk.compress_counts(counts), F.lit("\\"), F.lit("\\\\")), '"')
    form = F.col("order_idx") % 3
    segmentation = F.when(form == 0, F.to_json(F.array("polygon"))).otherwise(
        text('{"size":[', str(SIDE), ",", str(SIDE), '],"counts":', F.when(form == 1, listed).otherwise(packed), "}")
    )
    fields = F.to_json(F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", "area", F.col("order_idx")))
    spliced = text(F.substring(fields, 1, F.length(fields) - 1), ',"segmentation":', segmentation, "}")
    # One document an image and block of orders, its annotations in order.
    block = F.expr("concat(image_id, '/', order_idx DIV 8000)").alias("shard")
    sizes = text('{"images":[{"id":', F.first("image_id").cast("string"), f',"width":{SIDE},"height":{SIDE}}}],"annotations":[')
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_idx", "ann_id", "_json"))), lambda s: s["_json"]), ",")
    categories = ",".join(f'{{"id":{c},"name":"c{c}"}}' for c in (1, 2, 3))
    docs = rows.withColumn("_json", spliced).groupBy(block).agg(text(sizes, body, f'],"categories":[{categories}]}}').alias("doc"))
    path = scratch(t.spark, "forms")
    docs.select("doc").write.text(path, compression="gzip")
    parsed = stored(t, coco.parse_documents(coco.read_documents(t.spark, path, lines=True)), "parsed")
    images = coco.coco_images(parsed).select("source_id", "image_id", "height", "width")
    # An annotation of a block is placed after those of the blocks before by its own name.
    known = coco.annotation_classes(coco.coco_annotations(parsed), coco.coco_categories(parsed))
    first = F.regexp_extract("ann_id", r"^([0-9]+)-([0-9]+)", 1).cast("long") * 8 + F.regexp_extract("ann_id", r"^([0-9]+)-([0-9]+)", 2).cast("long")
    return stored(t, known.withColumn("order_idx", first).join(images.hint("merge"), ["source_id", "image_id"]), "placed")


def stored(t, rows, name):
    """Rows written to the shared folder and read again, a column at a time: several readers do not make them anew."""
    path = scratch(t.spark, name)
    rows.write.parquet(path)
    return t.spark.read.parquet(path)


FORMS = "(SELECT * FROM ann_px WHERE order_idx % 3 = 0 OR order_idx % 13 <> 0)"


@query("overlap_resolve_forms", PAINT.format(key="(a, order_idx, ann_id)").replace("FROM ann_px)", f"FROM {FORMS} f)"), "ann_px")
def _overlap_forms(t):
    runs, _ = paint_annotations(mixed_annotations(t), "higher_area_wins")
    return mk.runs_to_pixels(runs).withColumnRenamed("class_index", "class_id")


@query("overlap_rejects", """
SELECT image_id, ann_id, 'counts do not fill the image' AS reason FROM ann WHERE order_idx % 3 > 0 AND order_idx % 13 = 0
""", "ann")
def _overlap_rejects(t):
    return paint_annotations(mixed_annotations(t), "last_annotation_wins")[1]


@query("overlap_resolve_no_rle", PAINT.format(key="(order_idx, ann_id)").replace("FROM ann_px)", "FROM ann_px WHERE order_idx % 3 = 0)"), "ann_px")
def _overlap_no_rle(t):
    runs, _ = paint_annotations(mixed_annotations(t), "last_annotation_wins", use_rle=False)
    return mk.runs_to_pixels(runs).withColumnRenamed("class_index", "class_id")


@query("seed_masks_from_annotations", f"""
WITH painted AS ({PAINT.format(key='(a, order_idx, ann_id)')})
SELECT 'img_' || image_id || '__cid_' || class_id || f.suffix AS path, count(*) AS pixels
FROM painted CROSS JOIN (VALUES ('.png'), ('__frozen.png')) f(suffix) GROUP BY ALL
""", "ann_px")
def _seed(t):
    from maskloom.plans.seeding import seed_masks

    return seed_masks(painted(t, "higher_area_wins"), t.images.withColumn(
        "file_name", F.lower("file_name")
    ), frozen=True).groupBy("path").agg(F.sum("col_len").alias("pixels"))


def drawn_runs(t):
    sized = t.polygons.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    return mk.polygon_runs(sized, ["ann_id", "image_id", "category_id"]).select(
        "image_id", F.col("category_id").alias("class_id"), "row", "col_start", "col_len"
    )


def live_runs(t):
    return mk.class_runs(t.px, "pred_raw")


@query("mask_union", """
SELECT image_id, class_id, count(*) AS pixels FROM (
  SELECT image_id, category_id AS class_id, "row", col FROM ann_px
  UNION SELECT image_id, pred_raw, "row", col FROM px WHERE pred_raw > 0) u GROUP BY ALL
""", "ann_px px")
def _union(t):
    both = lr.union_runs(drawn_runs(t).unionByName(live_runs(t)), ["image_id", "class_id"])
    return both.groupBy("image_id", "class_id").agg(F.sum("col_len").alias("pixels"))


@query("mask_difference", """
SELECT DISTINCT p.image_id, p.pred_raw AS class_id, p.seg_id FROM px p
WHERE p.pred_raw > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT image_id, category_id, "row", col FROM ann_px) a
  WHERE a.image_id = p.image_id AND a.category_id = p.pred_raw AND a."row" = p."row" AND a.col = p.col)
""", "ann_px px")
def _difference(t):
    editable = lr.difference_runs(live_runs(t), drawn_runs(t), ["image_id", "class_id"])
    return mk.touched_regions(mk.runs_to_pixels(editable), t.px, ["image_id", "class_id"])


@query("runs_to_pixels", """
SELECT image_id, idx // 32 AS "row", idx % 32 AS col FROM (
  SELECT DISTINCT user_id AS image_id, unnest(range(least(greatest(event_id * 7 % 1100 - 40, 0), 1024),
     least(least(greatest(event_id * 7 % 1100 - 40, 0), 1024) + event_id % 30, 1024))) AS idx FROM events WHERE event_id % 30 > 0) r
""")
def _runs_to_pixels(t):
    rois = t.read("events").selectExpr(
        "user_id AS image_id", "array(named_struct('start', event_id * 7 % 1100 - 40, 'len', event_id % 30)) AS runs",
        f"{SIDE} AS height", f"{SIDE} AS width",
    )
    flat = mk.roi_runs(rois, ["image_id"], "runs", "height", "width")
    px = mk.flat_runs_to_pixels(flat, ["image_id"], "width").distinct()
    return px.select("image_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
