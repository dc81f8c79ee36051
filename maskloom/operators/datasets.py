"""Draft and dataset life cycle, and merging of annotated datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.line_runs import merge_overlap_runs
from maskloom.operators.masks import line_runs, runs_to_pixels
from maskloom.operators.ordering import ordered_index, running_total


def first_occurrence(rows: DataFrame, key: Column, order: list[str], out: str, carry: list[str]) -> DataFrame:
    """Distinct keys numbered by first appearance, with the first row's columns."""
    first = rows.groupBy(key.alias("_key")).agg(
        F.min_by(F.struct(*carry), F.struct(*order)).alias("_row"), F.min(F.struct(*order)).alias("_at")
    )
    numbered = ordered_index(first, ["_at"], out)
    return numbered.select(out, "_key", *[F.col("_row")[c].alias(c) for c in carry])


def merge_categories(categories: DataFrame) -> DataFrame:
    """Categories of several sources merged by exact name; ids by first appearance.

    Input: dataset_index, pos, category_id, name.  Output maps (dataset_index, category_id).
    """
    merged = first_occurrence(categories, F.col("name"), ["dataset_index", "pos"], "merged_category_id", ["name"])
    return categories.join(merged.select("merged_category_id", "name"), "name").select(
        "dataset_index", "category_id", "name", "merged_category_id"
    )


def merge_images(images: DataFrame) -> DataFrame:
    """Images of several sources merged by file name.  Input: dataset_index, pos, image_id, file_name, and height and width.

    A name that comes with two sizes fails the merge; without sizes nothing is compared.
    """
    if "width" in images.columns:
        message = F.concat(F.lit("one file name, two sizes: "), "file_name")
        clash = size_clashes(images).select("file_name", F.raise_error(message).cast("boolean").alias("_clash"))
        # The error is raised by the row that clashes; where none does, the join is with nothing.
        images = images.join(clash, "file_name", "left").where(F.col("_clash").isNull()).drop("_clash")
    merged = first_occurrence(images, F.col("file_name"), ["dataset_index", "pos"], "merged_image_id", ["file_name"])
    return images.join(merged.select("merged_image_id", "file_name"), "file_name").select(
        "dataset_index", "image_id", "file_name", "merged_image_id"
    )


def size_clashes(images: DataFrame) -> DataFrame:
    """File names that come with more than one size: an error for the merge."""
    return images.groupBy("file_name").agg(
        F.min("width").alias("w0"), F.max("width").alias("w1"), F.min("height").alias("h0"), F.max("height").alias("h1")
    ).where("w0 <> w1 OR h0 <> h1").select("file_name")


def remap_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations under merged ids; references to unknown images or categories are dropped."""
    return annotations.join(
        images.select("dataset_index", "image_id", "merged_image_id"), ["dataset_index", "image_id"]
    ).join(categories.select("dataset_index", "category_id", "merged_category_id"), ["dataset_index", "category_id"])


def merge_priority(candidates: DataFrame, priority: str, order: list[str]) -> DataFrame:
    """A 64-bit rank: lower goes first.  ``last`` puts later datasets in front."""
    lead = F.col("dataset_index") if priority == "first" else -F.col("dataset_index")
    return ordered_index(candidates.withColumn("_lead", lead), ["_lead", *order], "rank").drop("_lead")


def merge_overlap(cover: DataFrame, action: str, min_area: int = 1) -> tuple[DataFrame, DataFrame]:
    """:func:`maskloom.operators.line_runs.merge_overlap_runs` for masks given as pixels, ``image_id, rank, row, col``.

    The pixels that kept masks own come back as pixels.
    """
    runs = line_runs(cover.select("image_id", "rank", "row", "col").distinct(), ["image_id", "rank"]).select(
        "image_id", "rank", "row", F.col("start").alias("col_start"), F.col("len").alias("col_len")
    )
    owned, verdicts = merge_overlap_runs(runs, action, min_area)
    return runs_to_pixels(owned), verdicts


def merge_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict") == "kept").alias("kept_annotations"),
        F.count_if(F.col("overlap") > 0).alias("overlap_annotations"),
        F.coalesce(F.sum("overlap"), F.lit(0)).alias("overlap_pixels"),
        F.count_if(F.col("verdict") == "dropped_overlap").alias("dropped_overlap"),
        F.count_if(F.col("verdict") == "dropped_small").alias("dropped_small"),
    )


def ordered_union(rows: DataFrame, key: str, name: str, source: str, pos: str) -> DataFrame:
    """Ordered union of name lists per key: first source, first place wins; numbered from 0.

    Groups are class lists, bounded by the class index.
    """
    trimmed = rows.withColumn(name, F.trim(name)).where(F.col(name) != "")
    first = trimmed.groupBy(key, name).agg(F.min(F.struct(source, pos)).alias("_at"))
    order = Window.partitionBy(key).orderBy("_at")
    return first.select(key, name, (F.row_number().over(order) - 1).alias("position"))


def draft_items(selected: DataFrame, library: DataFrame, key: str = "image_id") -> DataFrame:
    """Items of a new draft: distinct selected images that exist in the library."""
    return selected.select("draft_id", key).distinct().join(library.select(key), key, "left_semi")


def draft_rows(items: DataFrame) -> DataFrame:
    """New drafts at version 1; a draft without images is not created."""
    return items.groupBy("draft_id").agg(F.count("*").alias("image_count")).withColumn("version", F.lit(1))


def branch_drafts(drafts: DataFrame, new_id: Column) -> DataFrame:
    """Copies at version 1 that point back to what they were copied from."""
    return drafts.select(
        new_id.alias("draft_id"), F.concat("name", F.lit(" (branch)")).alias("name"), "workspace_id",
        F.lit(1).alias("version"), F.lit("branched_from_draft").alias("origin_type"),
        F.col("draft_id").alias("origin_draft_id"), F.col("version").alias("origin_version"),
    )


# Actions that raise a draft's version.
MUTATING = ["mask_saved", "classes_edited", "images_added", "images_removed", "destructive_recompute", "frozen_recompute"]


def draft_versions(actions: DataFrame) -> DataFrame:
    """Version per draft: 1 plus its mutating actions."""
    return actions.groupBy("draft_id").agg(
        (F.count_if(F.col("action").isin(MUTATING)) + 1).alias("version")
    )


def draft_version_history(actions: DataFrame) -> DataFrame:
    """The version after every action, by a running total that spreads a busy draft over tasks."""
    flagged = actions.withColumn("_hit", F.col("action").isin(MUTATING).cast("bigint"))
    return running_total(flagged, ["seq"], "_hit", "_sum", ["draft_id"]).select(
        "draft_id", "seq", "action", (F.col("_sum") + 1).alias("version")
    )


def drop_images(removed: DataFrame, tables: dict[str, DataFrame], key: str = "image_id") -> dict[str, DataFrame]:
    """Every table without the rows of removed images."""
    gone = removed.select(key).distinct()
    return {name: frame.join(gone, key, "left_anti") for name, frame in tables.items()}


def add_images(draft_items: DataFrame, wanted: DataFrame, library: DataFrame) -> DataFrame:
    """Requested library images a draft does not hold yet."""
    return wanted.distinct().join(library.select("image_id"), "image_id", "left_semi").join(
        draft_items.select("draft_id", "image_id"), ["draft_id", "image_id"], "left_anti"
    )


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], when: str, created: str | None = None) -> DataFrame:
    """Latest row per key; with ``created`` the first creation time is kept."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(when)).alias("_row"),
        *([F.min(created).alias("_created")] if created else []),
    )
    return latest.select(*keys, *[
        F.col("_created").alias(c) if c == created else F.col("_row")[c].alias(c) for c in rest
    ])


def next_class_index(classes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Next class index per dataset; datasets without classes start at 1."""
    tops = classes.groupBy("dataset_id").agg(F.max("class_index").alias("_top"))
    return datasets.select("dataset_id").join(tops, "dataset_id", "left").select(
        "dataset_id", (F.coalesce("_top", F.lit(0)) + 1).alias("next_class_index")
    )
