"""Annotation export: masks to COCO rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.masks import compress_counts, flat_runs, rle_counts
from maskloom.operators.ordering import ordered_index
from maskloom.operators.statistics import mask_area_bbox


def export_images(images: DataFrame) -> DataFrame:
    """Images with export ids: 1-based by name; images without annotations stay listed."""
    return ordered_index(images, ["file_name"], "export_id")


def export_annotations(
    mask_px: DataFrame, images: DataFrame, classes: DataFrame, min_area: int = 50
) -> DataFrame:
    """One annotation per (image, class) mask of at least ``min_area`` pixels.

    ``mask_px``: image_id, class_id, row, col.  ``images``: image_id, file_name, height, width.
    ``classes``: class_id, class_order.  Ids follow (image name, class order).
    """
    keys = ["image_id", "class_id"]
    boxed = (
        mask_area_bbox(mask_px, keys)
        .where(F.col("area") >= min_area)
        .withColumnsRenamed({"width": "box_width", "height": "box_height"})
    )
    named = boxed.join(images.select("image_id", "file_name", "height", "width"), "image_id").join(
        F.broadcast(classes.select("class_id", "class_order")), "class_id"
    )
    numbered = ordered_index(named, ["file_name", "class_order"], "annotation_id")
    # Only masks that pass the area filter are run-length encoded.
    tall = mask_px.join(numbered.select(*keys, "height", (F.col("height") * F.col("width")).alias("_size")), keys)
    flat = flat_runs(tall, [*keys, "_size"], "height", column_major=True)
    counts = rle_counts(flat, keys, "_size")
    return numbered.join(counts, keys).select(
        "annotation_id", "image_id", F.col("class_id").alias("category_id"), "file_name",
        F.struct(
            F.array("height", "width").alias("size"), compress_counts(F.col("counts")).alias("counts")
        ).alias("segmentation"),
        F.col("area").cast("double").alias("area"),
        F.array(*[F.col(c).cast("double") for c in ("x", "y", "box_width", "box_height")]).alias("bbox"),
        F.lit(1).alias("iscrowd"),
    )


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """Three JSON-lines folders.  One document for a whole corpus would have to pass through one
    task; readers of a single document can take :func:`shard_documents`."""
    images.write.mode("overwrite").json(f"{path}/images")
    annotations.write.mode("overwrite").json(f"{path}/annotations")
    categories.write.mode("overwrite").json(f"{path}/categories")


def shard_documents(
    images: DataFrame, annotations: DataFrame, categories: list[dict], shard: str, keep_empty: bool = True
) -> DataFrame:
    """Complete COCO documents, one per ``shard`` (a column of both frames that bounds their size)."""
    imgs = images.groupBy(shard).agg(
        F.sort_array(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images")
    )
    fields = [c for c in annotations.columns if c not in (shard, "_order")]
    order = ["_order"] if "_order" in annotations.columns else []
    anns = annotations.groupBy(shard).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("a")))), lambda s: s["a"]
        ).alias("annotations")
    )
    cats = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in categories
    ])
    joined = imgs.join(anns, shard, "left" if keep_empty else "inner")
    return joined.select(
        F.col(shard).alias("source_id"),
        F.to_json(F.struct(
            F.col("images"),
            F.coalesce("annotations", F.from_json(F.lit("[]"), anns.schema["annotations"].dataType)).alias("annotations"),
            cats.alias("categories"),
        )).alias("doc"),
    )
