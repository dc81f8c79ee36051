"""Joins between registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even
from maskloom.functions.strings import base_name, stem
from maskloom.operators.ordering import ordered_index


def models_with_dataset(models: DataFrame, datasets: DataFrame) -> DataFrame:
    named = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    return models.join(named, "dataset_id").withColumn(
        "classes_count", F.greatest(F.col("class_entries") - 1, F.lit(0))
    )


def runs_with_model(runs: DataFrame, models: DataFrame) -> DataFrame:
    return runs.join(models.select("model_id", F.col("name").alias("model_name"), "dataset_id"), "model_id")


def projects_with_dataset(drafts: DataFrame, datasets: DataFrame) -> DataFrame:
    return drafts.join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")


def snapshot_items(items: DataFrame, images: DataFrame, revisions: DataFrame) -> DataFrame:
    """Snapshot items with their image and their pinned revision."""
    rev = revisions.select("revision_id", F.col("checksum").alias("revision_checksum"))
    img = images.select("image_id", "file_name", "width", "height")
    return items.join(img, "image_id").join(rev, "revision_id")


def available_images(library: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return library.join(used.select(key).distinct(), key, "left_anti")


def labeled_flags(images: DataFrame, mask_stems: DataFrame, name: str = "file_name") -> DataFrame:
    """Images with a flag telling whether any mask of that stem exists."""
    marked = mask_stems.select(F.col("image_stem").alias("_stem"), F.lit(True).alias("_has")).distinct()
    return images.join(marked, stem(F.col(name)) == F.col("_stem"), "left").select(
        images["*"], F.coalesce("_has", F.lit(False)).alias("is_labeled")
    )


def labeled_summary(flagged: DataFrame, keys: list[str], name: str = "file_name") -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if("is_labeled").alias("labeled"), F.count_if(~F.col("is_labeled")).alias("unlabeled"),
        F.min(F.when(~F.col("is_labeled"), F.col(name))).alias("next_unlabeled"),
    )


def registrations(datasets: DataFrame) -> DataFrame:
    """Registrations of every draft, newest first: one row each with its position."""
    linked = datasets.where("source_draft_id IS NOT NULL").select(
        F.col("source_draft_id").alias("draft_id"), "dataset_id", "name", "created_on"
    )
    return ordered_index(
        linked, [F.col("created_on").desc(), F.col("dataset_id").desc()], "position", ["draft_id"]
    )


def linked_dataset(drafts: DataFrame, datasets: DataFrame) -> DataFrame:
    """The dataset a draft points to, or its newest registration when that one is gone."""
    direct = datasets.select("dataset_id", F.col("dataset_id").alias("_direct"))
    newest = datasets.where("source_draft_id IS NOT NULL").groupBy(F.col("source_draft_id").alias("draft_id")).agg(
        F.max_by("dataset_id", F.struct("created_on", "dataset_id")).alias("_newest")
    )
    return drafts.join(direct, "dataset_id", "left").join(newest, "draft_id", "left").select(
        "draft_id", F.coalesce("_direct", "_newest").alias("linked_dataset_id")
    )


def related_models(drafts: DataFrame, datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Models trained on any registration of a draft or on its linked dataset."""
    registered = datasets.where("source_draft_id IS NOT NULL").select(
        F.col("source_draft_id").alias("draft_id"), "dataset_id"
    )
    linked = linked_dataset(drafts, datasets).where("linked_dataset_id IS NOT NULL").select(
        "draft_id", F.col("linked_dataset_id").alias("dataset_id")
    )
    pairs = registered.join(drafts.select("draft_id"), "draft_id", "left_semi").unionByName(linked).distinct()
    return pairs.join(models.select("model_id", "dataset_id"), "dataset_id")


def draft_origin(drafts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Where a draft came from, as a label."""
    parents = drafts.select(F.col("draft_id").alias("origin_draft_id"), F.col("name").alias("_parent"))
    sources = datasets.select(F.col("dataset_id").alias("origin_dataset_id"), F.col("name").alias("_source"))
    version = F.concat(F.lit(" v"), F.coalesce(F.col("origin_version").cast("string"), F.lit("?")))
    branched = (
        F.when(F.col("origin_draft_id").isNull(), F.concat(F.lit("Branched from draft"), version))
        .when(F.col("_parent").isNull(), F.concat(F.lit("Branched from draft #"), "origin_draft_id", version))
        .otherwise(F.concat(F.lit("Branched from "), "_parent", version))
    )
    augmented = (
        F.when(F.col("origin_dataset_id").isNull(), F.lit("Augmented from registered dataset"))
        .when(F.col("_source").isNull(), F.concat(F.lit("Augmented from registered #"), "origin_dataset_id"))
        .otherwise(F.concat(F.lit("Augmented from "), "_source"))
    )
    label = (
        F.when(F.col("origin_type") == "branched_from_draft", branched)
        .when(F.col("origin_type") == "augmented_from_registered", augmented)
        .otherwise("Manual draft")
    )
    return drafts.join(parents, "origin_draft_id", "left").join(sources, "origin_dataset_id", "left").select(
        "draft_id", label.alias("origin")
    )


def job_target(jobs: DataFrame, models: DataFrame, runs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Label of what a job works on: a model, an analysis run or a dataset."""
    kind, key = F.lower(F.trim("entity_type")), F.col("entity_id")
    named_runs = runs.join(models.select("model_id", F.col("name").alias("_rm")), "model_id", "left").select(
        F.col("run_id").alias("_run"), "_rm"
    )
    wide = (
        jobs.join(models.select(F.col("model_id").alias("_mid"), F.col("name").alias("_m")),
                  (kind == "model") & (key == F.col("_mid")), "left")
        .join(named_runs, (kind == "analysis_run") & (key == F.col("_run")), "left")
        .join(drafts.select(F.col("draft_id").alias("_did"), F.col("name").alias("_d")),
              (kind == "dataset") & (key == F.col("_did")), "left")
    )
    run_label = F.concat(F.lit("Run #"), key)
    label = (
        F.when(F.coalesce(key, F.lit(0)) <= 0, F.lit("-"))
        .when(kind == "model", F.coalesce("_m", F.concat(F.lit("Model #"), key)))
        .when(kind == "analysis_run", F.when(F.col("_rm").isNull(), run_label).otherwise(
            F.concat(run_label, F.lit(" ("), "_rm", F.lit(")"))))
        .when(kind == "dataset", F.coalesce("_d", F.concat(F.lit("Dataset #"), key)))
        .otherwise("-")
    )
    return wide.select("job_id", label.alias("target"))


def not_members(wanted: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows that are not members; must be empty for the request to pass."""
    return wanted.join(members.select(*keys).distinct(), keys, "left_anti")


def match_names(requested: DataFrame, available: DataFrame, name: str = "file_name") -> DataFrame:
    """Requested names (base name, any case, first spelling) with their canonical form or NULL."""
    asked = requested.select(base_name(F.col(name)).alias("requested"), "pos").where("requested <> ''")
    first = asked.groupBy(F.lower("requested").alias("_k")).agg(F.min_by("requested", "pos").alias("requested"))
    known = available.groupBy(F.lower(name).alias("_k")).agg(F.max(name).alias("canonical"))
    return first.join(known, "_k", "left").select("requested", "canonical")


def completeness(heads: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Images without a head revision (``missing``) and heads without an image (``extra``)."""
    left = members.select(*keys, F.lit(True).alias("_m")).distinct()
    right = heads.select(*keys, F.lit(True).alias("_h")).distinct()
    return left.join(right, keys, "full_outer").where("_m IS NULL OR _h IS NULL").select(
        *keys, F.when(F.col("_h").isNull(), "missing").otherwise("extra").alias("problem")
    )


def image_references(items: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Which active jobs, active runs and finished runs list each image: one row per reference.

    ``items``: run_id, input_image.  A job lists the images of the run it works on.
    """
    listed = items.where("input_image <> ''").select("run_id", F.trim("input_image").alias("input_image")).distinct()
    active = F.col("status").isin("queued", "running")
    by_run = listed.join(runs.select("run_id", "status"), "run_id").select(
        "input_image", F.when(active, "active_run").otherwise("completed_run").alias("kind"), F.col("run_id").alias("ref_id")
    )
    working = jobs.where((F.col("job_type") == "analysis") & active).select(
        F.col("entity_id").alias("run_id"), "job_id"
    )
    by_job = listed.join(working, "run_id").select(
        "input_image", F.lit("active_job").alias("kind"), F.col("job_id").alias("ref_id")
    )
    return by_run.unionByName(by_job).distinct()


# --- selections on the segment grid -----------------------------------------------------------

def segment_runs(px: DataFrame) -> DataFrame:
    """Segments as line runs."""
    from maskloom.operators.masks import line_runs

    return line_runs(px, ["image_id", "seg_id"])


def clip_rectangles(rects: DataFrame, width: int, height: int) -> DataFrame:
    """Corners in any order, clipped to the image; rectangles fully outside are dropped."""
    return rects.select(
        "rect_id", "image_id",
        F.greatest(F.least("x1", "x2"), F.lit(0)).alias("xa"),
        F.least(F.greatest("x1", "x2"), F.lit(width - 1)).alias("xb"),
        F.greatest(F.least("y1", "y2"), F.lit(0)).alias("ya"),
        F.least(F.greatest("y1", "y2"), F.lit(height - 1)).alias("yb"),
    ).where("xa <= xb AND ya <= yb")


def marquee_intersects(rects: DataFrame, px: DataFrame, band: int = 16) -> DataFrame:
    """Segments with any pixel inside each rectangle: rectangles meet segment runs in bands of lines.

    Size estimates do not see how many rows a rectangle becomes, so both sides are merged, never broadcast.
    """
    spread = rects.select("*", F.explode(F.expr(f"sequence(ya DIV {band}, yb DIV {band})")).alias("_band"))
    runs = segment_runs(px).withColumn("_band", F.expr(f"row DIV {band}"))
    hit = spread.hint("merge").join(runs, ["image_id", "_band"]).where("row BETWEEN ya AND yb AND start <= xb AND start + len > xa")
    return hit.select("rect_id", "image_id", "seg_id").distinct()


def marquee_centroid(rects: DataFrame, centroids: DataFrame, cell: int = 16) -> DataFrame:
    """Segments whose centroid lies inside each rectangle, borders included.

    Rectangles are spread over grid cells, so a centroid only meets rectangles over its own cell.
    """
    spread = rects.withColumn("_cy", F.explode(F.expr(f"sequence(ya DIV {cell}, yb DIV {cell})"))).withColumn(
        "_cx", F.explode(F.expr(f"sequence(xa DIV {cell}, xb DIV {cell})"))
    )
    placed = centroids.withColumns({
        "_cy": F.floor(F.col("y") / cell).cast("bigint"), "_cx": F.floor(F.col("x") / cell).cast("bigint"),
    })
    inside = spread.join(placed, ["image_id", "_cy", "_cx"]).where("x BETWEEN xa AND xb AND y BETWEEN ya AND yb")
    return inside.select("rect_id", "image_id", "seg_id")


def brush_pixels(points: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels under brush strokes: clipped points, joined by evenly rounded straight steps.

    ``points``: stroke_id, image_id, seq, x, y.  A stroke is one gesture, so its window is short.
    """
    def keep(value: Column, size: int) -> Column:
        return F.greatest(F.least(value, F.lit(size - 1)), F.lit(0))

    inside = points.select(
        "stroke_id", "image_id", "seq", keep(F.col("x"), width).alias("x"), keep(F.col("y"), height).alias("y")
    )
    order = Window.partitionBy("stroke_id", "image_id").orderBy("seq")
    legs = inside.withColumns({
        "px": F.coalesce(F.lag("x").over(order), F.col("x")), "py": F.coalesce(F.lag("y").over(order), F.col("y")),
    })
    steps = F.greatest(F.abs(F.col("x") - F.col("px")), F.abs(F.col("y") - F.col("py")))
    walked = legs.withColumn("n", steps).withColumn("i", F.explode(F.expr("sequence(cast(0 AS bigint), cast(n AS bigint))")))
    ratio = F.when(F.col("n") > 0, F.col("i") / F.col("n")).otherwise(0.0)

    def at(start: str, end: str, size: int) -> Column:
        return keep(half_even(F.col(start) + (F.col(end) - F.col(start)) * ratio).cast("int"), size)

    return walked.select(
        "stroke_id", "image_id", at("py", "y", height).alias("row"), at("px", "x", width).alias("col")
    ).distinct()


def touched_segments(cells: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct segments under a set of pixels (ROI or brush)."""
    return cells.join(px.select("image_id", "row", "col", "seg_id").hint("merge"), ["image_id", "row", "col"]).select(
        *keys, "seg_id"
    ).distinct()


# --- run listings -----------------------------------------------------------------------------

def run_rows(datasets: DataFrame, snapshots: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with their snapshot, dataset and (when known) model."""
    return (
        runs.join(snapshots, "snapshot_id")
        .join(datasets.select("dataset_id", F.col("name").alias("dataset_name"), "workspace_id"), "dataset_id")
        .join(models.select("model_id", F.col("name").alias("model_name")), "model_id", "left")
    )


def promote_source(items: DataFrame) -> DataFrame:
    """The mask each run item is promoted from: refined, else primary, else raw."""
    def given(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c))

    source = F.coalesce(given("refined_path"), given("mask_path"), given("raw_path"))
    return items.select(
        "run_id", "item_id", "image_id", base_name(F.trim("input_image")).alias("input_name"),
        source.alias("source_mask"),
        F.when(given("refined_path").isNotNull(), "Refined").otherwise("Raw").alias("source_label"),
        given("conf_path").isNotNull().alias("has_conf"),
    ).where("input_name <> '' AND source_mask IS NOT NULL")


def provenance_rows(picked: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """One lineage row per promoted item."""
    return picked.join(runs.select("run_id", "model_id"), "run_id").join(
        models.select("model_id", F.col("name").alias("model_name")), "model_id"
    ).select(
        F.col("run_id").alias("source_run_id"), F.col("item_id").alias("source_item_id"),
        F.col("model_id").alias("source_model_id"), "model_name", "source_mask", "source_label", "has_conf",
        F.concat(stem(F.col("input_name")), F.lit("__label.png")).alias("label_file"),
    )
