"""Seed per-class masks from a painted label map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.strings import stem
from maskloom.operators.masks import class_runs


def seed_masks(painted: DataFrame, images: DataFrame, frozen: bool = False) -> DataFrame:
    """Run table keyed by mask name; with ``frozen`` every mask also gets its frozen copy.

    ``painted`` is a label map, as runs (with ``col_start, col_len``) or as pixels.
    The class id in the name is the class *position* in the category list.  Images that are not in
    the registry drop out (see :func:`missing_images`).
    """
    runs = painted.where("class_id > 0") if "col_start" in painted.columns else class_runs(painted, "class_id")
    runs = runs.join(
        images.select("image_id", stem(F.col("file_name")).alias("_stem")), "image_id"
    )
    suffixes = [".png", "__frozen.png"] if frozen else [".png"]
    return runs.select(
        "image_id", "class_id", "row", "col_start", "col_len", "_stem",
        F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("_suffix"),
    ).withColumn("path", F.concat("_stem", F.lit("__cid_"), "class_id", "_suffix")).drop("_stem", "_suffix")


def missing_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Warnings: annotated images that are not in the registry."""
    return annotations.select("image_id").distinct().join(images, "image_id", "left_anti")
