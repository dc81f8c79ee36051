"""Mask files: attributes in names, legacy names, shape checks, class-index grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.strings import sanitize_class_name, stem
from maskloom.operators.ordering import first_per_key

# Mask name forms.
CID_NAME = r"^(.+?)__cid_(\d+)$"
FROZEN_NAME = r"^(.+?)__cid_(\d+)__frozen$"


def mask_name_attrs(files: DataFrame, path: str = "path") -> DataFrame:
    """Image stem, class id or legacy class name, and frozen flag, read from each mask name."""
    name = stem(F.col(path))
    frozen = name.rlike(FROZEN_NAME)
    keyed = name.rlike(CID_NAME) | frozen
    pattern = F.when(frozen, F.regexp_extract(name, FROZEN_NAME, 2)).otherwise(
        F.regexp_extract(name, CID_NAME, 2)
    )
    return files.where(name.contains("__")).select(
        "*", F.split(name, "__")[0].alias("image_stem"),
        F.when(keyed, pattern.cast("int")).alias("cid"),
        F.when(~keyed, F.regexp_extract(name, r"__(.*)$", 1)).alias("legacy_name"),
        frozen.alias("is_frozen"),
    ).where("image_stem <> ''")


def pick_masks(attrs: DataFrame, classes: DataFrame) -> DataFrame:
    """The one live mask file per (image, class): class-id name first, legacy name second."""
    named = classes.select("class_id", sanitize_class_name(F.col("name")).alias("_legacy"))
    live = attrs.where(~F.col("is_frozen"))
    by_id = live.where("cid IS NOT NULL").join(
        F.broadcast(classes.select("class_id")), F.col("cid") == F.col("class_id")
    ).withColumn("precedence", F.lit(0))
    by_name = live.where("legacy_name IS NOT NULL").join(
        F.broadcast(named), F.col("legacy_name") == F.col("_legacy")
    ).drop("_legacy").withColumn("precedence", F.lit(1))
    return first_per_key(by_id.unionByName(by_name), ["image_stem", "class_id"], ["precedence", "path"])


def migrate_masks(attrs: DataFrame, classes: DataFrame) -> DataFrame:
    """What migration does with each legacy mask: renamed, or removed when the target exists.

    When two class names fold to one legacy name, the first class in order takes the file.
    """
    named = classes.select("class_id", sanitize_class_name(F.col("name")).alias("_legacy"))
    owners = named.groupBy("_legacy").agg(F.min("class_id").alias("class_id"))
    legacy = attrs.where("legacy_name IS NOT NULL").join(
        F.broadcast(owners), F.col("legacy_name") == F.col("_legacy")
    )
    taken = attrs.where("cid IS NOT NULL AND NOT is_frozen").select(
        "image_stem", F.col("cid").alias("class_id"), F.lit(True).alias("_taken")
    ).distinct()
    joined = legacy.join(taken, ["image_stem", "class_id"], "left")
    return joined.select(
        "path", "image_stem", "class_id",
        F.format_string("%s__cid_%d.png", "image_stem", "class_id").alias("target"),
        F.when(F.col("_taken"), "removed").otherwise("renamed").alias("action"),
    )


def mask_pixels(gray_px: DataFrame, masks: DataFrame, images: DataFrame, key: str = "path") -> DataFrame:
    """Foreground pixels (value > 0) of masks whose size equals their image's; others are rejected.

    ``gray_px`` has ``key, row, col, value``; ``masks`` has ``key, image_id, height, width``.
    """
    shapes = images.select("image_id", F.col("height").alias("_h"), F.col("width").alias("_w"))
    good = masks.join(shapes, "image_id").where("height = _h AND width = _w").drop("_h", "_w")
    kept = [c for c in good.columns if c not in (key, "height", "width")]
    return gray_px.where("value > 0").join(good, key).select(*kept, "row", "col")


def read_label_grids(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated class grids, one line per raster row: ``file, row, col, class_id``.

    Lines carry their row number in front (``row|a,b,c``) as our sink writes them, so a grid may be
    split over tasks without losing line order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.split("value", r"\|").alias("_p")
    )
    return lines.select(
        F.col("_p")[0].cast("long").alias("image_id"), F.col("_p")[1].cast("int").alias("row"),
        F.posexplode(F.split(F.col("_p")[2], ",")).alias("col", "_v"),
    ).select("image_id", "row", "col", F.col("_v").cast("int").alias("class_id"))


def read_plain_grid(spark: SparkSession, path: str) -> DataFrame:
    """Plain grid files (no row numbers): each file is one image, read whole so lines keep order."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("_lines")
    )
    rows = files.select("file", F.posexplode("_lines").alias("row", "_line"))
    return rows.select("file", "row", F.posexplode(F.split("_line", ",")).alias("col", "_v")).select(
        "file", "row", "col", F.trim("_v").cast("int").alias("class_id")
    )
