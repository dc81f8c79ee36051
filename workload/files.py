"""Sources and sinks (survey groups A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.numbers import confidence_u8
from maskloom.sinks import coco as coco_sink
from maskloom.sinks import rasters
from maskloom.sources import coco, images, masks, registry
from workload.registry import query
from workload.scratch import scratch
from workload.tables import CLASSES, SIDE

EXT_SPARK = "element_at(array('jpg','JPEG','png','txt','TIF','pdf','bmp'), cast(doc_id % 7 AS int) + 1)"
EXT_SQL = "(['jpg','JPEG','png','txt','TIF','pdf','bmp'])[doc_id % 7 + 1]"


def listing(t):
    """A file listing grown from the document table."""
    return t.read("documents").selectExpr(
        f"concat('/lib/', source, '/doc_', doc_id, '.', {EXT_SPARK}) AS path",
        "n_chars AS length", "timestamp'2024-01-01' AS modificationTime", "doc_id",
    )


LISTING = f"SELECT *, '/lib/' || source || '/doc_' || doc_id || '.' || {EXT_SQL} AS path FROM documents"
IMAGE_EXT = "lower(regexp_extract(path, '[^.](\\.[^./]*)$', 1)) IN ('.jpg','.jpeg','.png','.bmp','.tif','.tiff')"


@query("scan_images", f"""
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file_name FROM ({LISTING}) l WHERE {IMAGE_EXT}
""")
def _scan(t):
    return images.scan_images(listing(t)).select("path", "file_name")


@query("image_file_stats", f"""
SELECT regexp_extract(path, '([^/]*)$', 1) AS file_name, 'doc_' || doc_id AS stem, n_chars AS size_bytes,
       lower(regexp_extract(path, '([^.]*)$', 1)) AS extension FROM ({LISTING}) l WHERE {IMAGE_EXT}
""")
def _stats(t):
    return images.image_file_stats(listing(t)).select("file_name", "stem", "size_bytes", "extension")


def encoded_images(t):
    """Pixels packed as the image source delivers them: one BGR byte block per image."""
    cell = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")])
    lines = t.px.groupBy("image_id", "row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", cell.alias("h")))), lambda s: s["h"]), "").alias("h")
    )
    whole = lines.groupBy("image_id").agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "h"))), lambda s: s["h"]), "")).alias("data")
    )
    return whole.select(
        "image_id", F.concat(F.lit("/img/img_"), "image_id", F.lit(".png")).alias("path"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(3).alias("nChannels"), "data",
    )


@query("image_to_pixels", "SELECT image_id, \"row\", col, r, g, b FROM px", "px")
def _pixels(t):
    return images.image_to_pixels(encoded_images(t), ["image_id"])


@query("image_registry", """
SELECT 'img_' || image_id || '.png' AS file_name, '/img/img_' || image_id || '.png' AS path,
       CAST(32 AS INTEGER) AS width, CAST(32 AS INTEGER) AS height,
       sha256(unhex(string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY "row", col))) AS sha256
FROM px GROUP BY image_id
""", "px")
def _registry(t):
    packed = encoded_images(t)
    return images.image_registry(
        packed.select("path", F.col("data").alias("content")), packed.select("path", "width", "height")
    )


@query("image_path_resolve", """
SELECT file_name, CASE WHEN starts_with(file_name, '/') THEN file_name
  WHEN doc_id % 4 <> 0 THEN '/data/images/' || file_name ELSE '/data/' || file_name END AS resolved_path
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '/abs/' || file_name ELSE file_name END AS file_name FROM library) l
""", "library")
def _resolve(t):
    wanted = t.library.selectExpr(
        "CASE WHEN doc_id % 10 = 0 THEN concat('/abs/', file_name) ELSE file_name END AS file_name"
    )
    present = t.library.where("doc_id % 4 <> 0").selectExpr("concat('/data/images/', file_name) AS path")
    return images.resolve_image_paths(wanted, present, "/data", "images").select("file_name", "resolved_path")


@query("registered_images_list", """
WITH doc AS (SELECT source AS source_id, doc_id AS pos,
  CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '_' || doc_id // 6 || '.png' ELSE lang || '_' || doc_id // 6 || '.png' END AS file_name
  FROM documents WHERE source <> (SELECT min(source) FROM documents)),
listed AS (SELECT source_id, min(pos) AS pos, arg_min(file_name, pos) AS file_name, 'document' AS origin
  FROM doc GROUP BY source_id, lower(file_name))
SELECT * FROM listed
UNION ALL
SELECT source, -1, 'doc_' || doc_id || '.png', 'listing' FROM documents
WHERE source = (SELECT min(source) FROM documents)
""")
def _registered(t):
    docs = t.read("documents")
    first = docs.agg(F.min("source")).scalar()
    named = docs.where(F.col("source") != first).selectExpr(
        "source AS source_id", "doc_id AS pos",
        "concat(IF(doc_id % 3 = 0, upper(lang), lang), '_', doc_id DIV 6, '.png') AS file_name",
    )
    files = docs.selectExpr("source AS source_id", "concat('doc_', doc_id, '.png') AS file_name")
    return images.registered_images(named, files).fillna(-1, subset=["pos"])


# --- annotation documents ---------------------------------------------------------------------

CATEGORIES = [{"id": c * 10, "name": n, "supercategory": "object"} for c, n in CLASSES[1:]]


def coco_documents(t):
    """Annotation documents of bounded size: one per image and block of 1,000 orders."""
    block = F.expr("concat(image_id, '/', order_idx DIV 8000)")
    rows = t.outlined.select(
        block.alias("shard"), F.struct("order_idx", "ann_id").alias("_order"), F.col("ann_id").alias("id"),
        "image_id", (F.col("category_id") * 10).alias("category_id"),
        F.array("polygon").alias("segmentation"), "area",
        F.expr("array(cast(x0 AS double), y0, w, h)").alias("bbox"), F.lit(0).alias("iscrowd"),
    )
    listed = rows.select("shard", "image_id").distinct().join(t.images, "image_id").select(
        "shard", F.col("image_id").alias("id"), "file_name", "width", "height"
    )
    return coco_sink.shard_documents(listed, rows, CATEGORIES, "shard")


@query("coco_scan", """
SELECT image_id, ann_id, category_id * 10 AS category_id, area, x0 AS first_x, y0 AS first_y FROM ann
""", "ann")
def _coco_scan(t):
    path = scratch(t.spark, "coco")
    coco_documents(t).select("doc").write.text(path, compression="gzip")
    docs = t.spark.read.text(path).select(F.xxhash64("value").alias("source_id"), F.col("value").alias("doc"))
    rows = coco.annotation_polygons(coco.coco_annotations(coco.parse_documents(docs)))
    return rows.select(
        "image_id", "ann_id", "category_id", "area",
        F.get("polygon", F.lit(0)).cast("int").alias("first_x"), F.get("polygon", F.lit(1)).cast("int").alias("first_y"),
    )


BLOCKS = "SELECT DISTINCT image_id || '/' || order_idx // 8000 AS source_id FROM ann"


@query("coco_categories", f"""
SELECT source_id, class_id * 10 AS category_id, name FROM ({BLOCKS}) s CROSS JOIN classes WHERE class_id > 0
""", "ann classes")
def _coco_categories(t):
    cats = coco.coco_categories(coco.parse_documents(coco_documents(t)))
    return cats.select("source_id", "category_id", "name")


@query("category_class_index", f"""
SELECT source_id, class_id * 10 AS category_id, class_id AS class_index FROM ({BLOCKS}) s CROSS JOIN classes WHERE class_id > 0
""", "ann classes")
def _class_index(t):
    cats = coco.coco_categories(coco.parse_documents(coco_documents(t)))
    return cats.select("source_id", "category_id", "class_index")


@query("annotation_category_join", """
SELECT ann_id, category_id AS class_index FROM ann WHERE category_id <> 2
""", "ann")
def _category_join(t):
    known = t.spark.createDataFrame([(1, 1), (3, 3)], "category_id int, class_index int")
    rows = t.ann.withColumn("source_id", F.lit(0))
    return coco.annotation_classes(rows, F.broadcast(known.withColumn("source_id", F.lit(0)))).select("ann_id", "class_index")


# --- mask files -------------------------------------------------------------------------------

@query("mask_name_attrs", """
SELECT path, 'img_' || image_id AS image_stem, CASE WHEN legacy THEN -1 ELSE m.class_id END AS cid,
       CASE WHEN legacy THEN k.name ELSE '' END AS legacy_name, frozen AS is_frozen
FROM masks m JOIN classes k ON k.class_id = m.class_id
""", "masks classes")
def _mask_attrs(t):
    return masks.mask_name_attrs(t.masks.select("path")).fillna({"cid": -1, "legacy_name": ""})


@query("mask_pick", """
SELECT image_stem, class_id, path FROM (
  SELECT 'img_' || image_id AS image_stem, class_id, path,
         row_number() OVER (PARTITION BY image_id, class_id ORDER BY legacy) AS n
  FROM masks WHERE NOT frozen) m WHERE n = 1
""", "masks")
def _mask_pick(t):
    attrs = masks.mask_name_attrs(t.masks.select("path"))
    return masks.pick_masks(attrs, t.classes).select("image_stem", "class_id", "path")


@query("mask_migrate", """
SELECT m.path, 'img_' || image_id || '__cid_' || class_id || '.png' AS target,
       CASE WHEN EXISTS (SELECT 1 FROM masks b WHERE b.image_id = m.image_id AND b.class_id = m.class_id AND NOT b.frozen AND NOT b.legacy)
            THEN 'removed' ELSE 'renamed' END AS action
FROM masks m WHERE legacy
""", "masks")
def _mask_migrate(t):
    attrs = masks.mask_name_attrs(t.masks.select("path"))
    return masks.migrate_masks(attrs, t.classes).select("path", "target", "action")


@query("mask_scan", """
SELECT image_id, category_id AS class_id, count(DISTINCT "row" * 32 + col) AS pixels
FROM ann_px WHERE image_id % 10 <> 0 GROUP BY ALL
""", "ann_px")
def _mask_scan(t):
    from maskloom.operators.line_runs import union_runs
    from maskloom.operators.masks import runs_to_pixels

    runs = t.ann.selectExpr(
        "concat('img_', image_id, '__cid_', category_id, '.png') AS path",
        "explode(sequence(y0, y0 + h - 1)) AS row", "x0 AS col_start", "w AS col_len",
    )
    gray = runs_to_pixels(union_runs(runs, ["path"])).withColumn("value", F.lit(255))
    files = t.ann.selectExpr(
        "concat('img_', image_id, '__cid_', category_id, '.png') AS path", "image_id", "category_id AS class_id",
        f"IF(image_id % 10 = 0, 16, {SIDE}) AS height", f"{SIDE} AS width",
    ).distinct()
    return masks.mask_pixels(gray, files, t.images).groupBy("image_id", "class_id").agg(F.count("*").alias("pixels"))


@query("registry_scan", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def _registry_scan(t):
    path = scratch(t.spark, "registry")
    t.read("events").selectExpr("event_id", "props AS props_json", "event_type").write.parquet(path)
    decoded = registry.read_registry(t.spark, path)
    return decoded.select("event_id", F.variant_get("props_json", "$.k", "bigint").alias("k"))


# --- rasters out and back ---------------------------------------------------------------------

@query("label_grid_csv_export", """
SELECT image_id, "row", string_agg(pred_refined, ',' ORDER BY col) AS line FROM px GROUP BY ALL
""", "px")
def _grid_export(t):
    return rasters.label_grid_lines(t.px, "pred_refined")


@query("label_grid_csv_scan", "SELECT image_id, \"row\", col, pred_refined AS class_id FROM px", "px")
def _grid_scan(t):
    path = scratch(t.spark, "grids")
    rasters.write_label_grids(t.px, "pred_refined", path)
    return masks.read_label_grids(t.spark, path)


@query("confidence_encode", """
SELECT image_id, "row", col, CAST(least(greatest(round_even((gray / 200.0::DOUBLE) * 255, 0), 0), 255) AS SMALLINT) AS conf FROM px
""", "px")
def _confidence(t):
    return t.px.select("image_id", "row", "col", confidence_u8(F.col("gray") / 200.0).alias("conf"))


PALETTE = {1: (200, 40, 90), 2: (61, 180, 75), 3: (67, 99, 216)}


@query("overlay_blend", """
SELECT image_id, "row", col,
  CASE WHEN pred_raw > 0 THEN CAST(floor(r * 0.55::DOUBLE + ([200, 61, 67])[pred_raw] * 0.45::DOUBLE) AS INTEGER) ELSE r END AS overlay_r,
  CASE WHEN pred_raw > 0 THEN CAST(floor(g * 0.55::DOUBLE + ([40, 180, 99])[pred_raw] * 0.45::DOUBLE) AS INTEGER) ELSE g END AS overlay_g,
  CASE WHEN pred_raw > 0 THEN CAST(floor(b * 0.55::DOUBLE + ([90, 75, 216])[pred_raw] * 0.45::DOUBLE) AS INTEGER) ELSE b END AS overlay_b
FROM px
""", "px")
def _overlay(t):
    out = rasters.overlay_blend(t.px, "pred_raw", PALETTE)
    return out.select("image_id", "row", "col", "overlay_r", "overlay_g", "overlay_b")


@query("boundary_overlay", """
SELECT a.image_id, a."row", a.col,
  CASE WHEN bool_or(b.seg_id <> a.seg_id AND abs(a."row" - b."row") + abs(a.col - b.col) = 1)
        AND (a.seg_id = 0 OR bool_or(b.seg_id <> 0 AND b.seg_id <> a.seg_id)) THEN 255 ELSE 0 END AS alpha
FROM px a JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc) ON true
JOIN px b ON b.image_id = a.image_id AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc
GROUP BY a.image_id, a."row", a.col, a.seg_id
""", "px")
def _boundary_overlay(t):
    return rasters.boundary_overlay(t.px).select("image_id", "row", "col", "alpha")


@query("class_mask_export", """
SELECT image_id, pred_refined AS class_id, count(*) AS pixels FROM px WHERE pred_refined > 0 GROUP BY ALL
""", "px")
def _class_masks(t):
    path = scratch(t.spark, "masks")
    rasters.write_class_masks(t.px, "pred_refined", path)
    back = t.spark.read.parquet(path)
    return back.groupBy("image_id", "class_id").agg(F.sum("col_len").alias("pixels"))


@query("coco_export", """
WITH m AS (SELECT p.image_id, pred_refined AS class_id, i.file_name, count(*) AS area, min(col) AS x, min("row") AS y,
  max(col) - min(col) + 1 AS bw, max("row") - min("row") + 1 AS bh
  FROM px p JOIN images i ON i.image_id = p.image_id WHERE pred_refined > 0 GROUP BY ALL HAVING count(*) >= 250)
SELECT row_number() OVER (ORDER BY file_name, class_id) AS annotation_id, image_id, class_id AS category_id,
       CAST(area AS DOUBLE) AS area, x || ',' || y || ',' || bw || ',' || bh AS bbox FROM m
""", "px images")
def _coco_export(t):
    fg = t.px.where("pred_refined > 0").withColumn("class_id", F.col("pred_refined"))
    order = t.classes.withColumn("class_order", F.col("class_id"))
    rows = coco_sink.export_annotations(fg, t.images, order, min_area=250)
    return rows.select(
        "annotation_id", "image_id", "category_id", "area",
        F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ",").alias("bbox"),
    )


@query("coco_export_images", """
SELECT row_number() OVER (ORDER BY file_name) AS export_id, image_id, file_name FROM images
""", "images")
def _coco_export_images(t):
    return coco_sink.export_images(t.images).select("export_id", "image_id", "file_name")
