"""Image files: listing, registry, pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from maskloom.functions.strings import base_name, extension, stem

# Accepted image extensions.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and modification time of every file; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")


def scan_images(files: DataFrame) -> DataFrame:
    """Keep image files (by extension, any case) and name them.  Ordering by ``file_name`` is the
    reader's choice: a listing is a set until someone sorts it."""
    return files.withColumn("file_name", base_name(F.col("path"))).where(
        extension(F.col("path")).isin(IMAGE_EXTENSIONS)
    )


def image_file_stats(files: DataFrame) -> DataFrame:
    return scan_images(files).select(
        "file_name", stem(F.col("path")).alias("stem"),
        F.expr("substring(file_name, length(file_name) - locate('.', reverse(file_name)) + 2)").alias("_ext"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    ).withColumn("extension", F.lower("_ext")).drop("_ext")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: ``path, height, width, nChannels, data`` (bytes in BGR order)."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(
        F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"
    )


def _bytes_as_numbers(slices: pd.Series) -> pd.Series:
    return slices.map(lambda raw: np.frombuffer(raw, dtype=np.uint8).astype(np.int16))


def image_to_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pixel with r, g, b.  Gray is repeated over the channels, alpha is dropped.

    The byte block is cut into raster lines in the JVM first, so no Python batch or array is longer
    than one line of one image.
    """
    stride = F.col("width") * F.col("nChannels")
    lines = images.select(
        *keys, "width", "nChannels", F.col("data"), F.explode(F.expr("sequence(0, height - 1)")).alias("row"),
    ).select(
        *keys, "width", "nChannels", "row", F.substring("data", F.col("row") * stride + 1, stride).alias("_slice")
    )
    numbers = F.pandas_udf(_bytes_as_numbers, ArrayType(ShortType()))
    numbered = lines.withColumn("_v", numbers("_slice"))
    cells = numbered.select(
        *keys, "row", "nChannels", "_v", F.explode(F.expr("sequence(0, width - 1)")).alias("col")
    )

    def channel(offset: int) -> Column:
        gray = F.get("_v", F.col("col"))
        return F.when(F.col("nChannels") == 1, gray).otherwise(
            F.get("_v", F.col("col") * F.col("nChannels") + offset)
        )

    return cells.select(
        *keys, "row", "col", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b")
    )


def image_registry(contents: DataFrame, shapes: DataFrame) -> DataFrame:
    """Path, pixel size and SHA-256 of each image file.

    ``contents`` has ``path, content`` (the binaryFile source), ``shapes`` ``path, width, height``
    (the image source).  Hashing happens in the scan, so file bytes never enter the join.
    """
    plain = F.regexp_replace("path", "^file:/+", "/")
    hashed = contents.select(plain.alias("path"), F.sha2("content", 256).alias("sha256"))
    sized = shapes.select(plain.alias("path"), "width", "height")
    return scan_images(hashed).join(sized, "path").select("file_name", "path", "width", "height", "sha256")


def read_image_registry(spark: SparkSession, folder: str) -> DataFrame:
    contents = spark.read.format("binaryFile").load(folder).select("path", "content")
    return image_registry(contents, read_images(spark, folder))


def resolve_image_paths(wanted: DataFrame, files: DataFrame, root: str, image_root: str) -> DataFrame:
    """Absolute names stay; else ``root/image_root/name`` when that file exists; else ``root/name``."""
    inside = F.concat(F.lit(f"{root}/{image_root}/"), F.col("file_name"))
    known = files.select(F.col("path").alias("_inside")).distinct()
    looked = wanted.withColumn("_want", inside).join(known, F.col("_want") == F.col("_inside"), "left")
    return looked.withColumn(
        "resolved_path",
        F.when(F.col("file_name").startswith("/"), F.col("file_name")).otherwise(
            F.coalesce("_inside", F.concat(F.lit(f"{root}/"), F.col("file_name")))
        ),
    ).drop("_want", "_inside")


def registered_images(documents: DataFrame, listing: DataFrame, source: str = "source_id") -> DataFrame:
    """Image names of a source: those its document lists (blank dropped, first spelling kept,
    document order), or the directory listing when the document lists none.

    ``documents`` has ``source, pos, file_name``; ``listing`` has ``source, file_name``.
    """
    named = documents.withColumn("file_name", F.trim("file_name")).where("file_name <> ''")
    first = named.groupBy(source, F.lower("file_name").alias("_k")).agg(
        F.min_by("file_name", "pos").alias("file_name"), F.min("pos").alias("pos")
    ).select(source, "pos", "file_name", F.lit("document").alias("origin"))
    fallback = scan_images(listing.withColumn("path", F.col("file_name"))).join(
        first.select(source).distinct(), source, "left_anti"
    ).select(source, F.lit(None).cast("long").alias("pos"), "file_name", F.lit("listing").alias("origin"))
    return first.unionByName(fallback)
