"""Annotation revisions, heads, lineage, snapshots and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import combined_checksum
from maskloom.operators.ordering import last_per_key
from maskloom.session import cut

RASTERS = ("label", "provenance", "protection")


def head_revisions(revisions: DataFrame) -> DataFrame:
    """The newest revision of every (dataset, image)."""
    return last_per_key(
        revisions.select("dataset_id", "image_id", "revision_id", "created_on"), ["dataset_id", "image_id"],
        ["created_on", "revision_id"],
    )


def raster_checksums(px: DataFrame, key: str = "revision_id") -> DataFrame:
    """SHA-256 per raster and combined, over row-major content.

    Rows are hashed first, so no group is longer than one raster line; a raster is hashed from its
    line digests in row order.
    """
    lines = px.groupBy(key, "row").agg(*[
        F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("col", F.col(r).alias("v")))), lambda s: s["v"].cast("string")
        ), ","), 256).alias(r) for r in RASTERS
    ])
    whole = lines.groupBy(key).agg(*[
        F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("row", F.col(r).alias("h")))), lambda s: s["h"]
        ), ""), 256).alias(f"{r}_checksum") for r in RASTERS
    ])
    return whole.withColumn("revision_checksum", combined_checksum(*[F.col(f"{r}_checksum") for r in RASTERS]))


def save_problems(px: DataFrame, revisions: DataFrame) -> DataFrame:
    """Why a save must be refused: unknown or locked revision, or a raster of another size."""
    shape = px.groupBy("revision_id").agg(
        F.count("*").alias("_n"), F.max("row").alias("_r"), F.max("col").alias("_c")
    )
    joined = shape.join(revisions.select("revision_id", "is_locked", "height", "width"), "revision_id", "left")
    misfit = (F.col("_r") + 1 != F.col("height")) | (F.col("_c") + 1 != F.col("width")) | (
        F.col("_n") != F.col("height").cast("bigint") * F.col("width")
    )
    problem = (
        F.when(F.col("is_locked").isNull(), "unknown revision").when(F.col("is_locked"), "locked revision")
        .when(misfit, "wrong size")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("revision_id", "problem")


def checksum_mismatches(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Revisions whose rasters no longer match their recorded checksums, and which raster."""
    now = actual.select("revision_id", *[F.col(f"{r}_checksum").alias(f"_{r}") for r in RASTERS])
    bad = F.array(*[F.when(F.col(f"{r}_checksum") != F.col(f"_{r}"), r) for r in RASTERS])
    return stored.join(now, "revision_id").withColumn("rasters", F.filter(bad, lambda v: v.isNotNull())).where(
        F.size("rasters") > 0
    ).select("revision_id", "rasters")


def empty_revisions(targets: DataFrame, images: DataFrame) -> DataFrame:
    """All-zero rasters for new revisions: ``revision_id, image_id`` targets, sized by their image."""
    sized = targets.join(images.select("image_id", "height", "width"), "image_id")
    rows = sized.withColumn("row", F.explode(F.expr("sequence(0, height - 1)")))
    cells = rows.withColumn("col", F.explode(F.expr("sequence(0, width - 1)")))
    return cells.select("revision_id", "image_id", "row", "col", *[F.lit(0).alias(r) for r in RASTERS])


def fork(heads: DataFrame, px: DataFrame, new_id) -> tuple[DataFrame, DataFrame]:
    """Children of head revisions: their rows (pointing at the parent) and copied rasters."""
    children = heads.select(
        new_id.alias("revision_id"), "dataset_id", "image_id", F.col("revision_id").alias("parent_revision_id")
    )
    copied = px.withColumnRenamed("revision_id", "parent_revision_id").join(
        children.select("revision_id", "parent_revision_id"), "parent_revision_id"
    ).drop("parent_revision_id")
    return children, copied


def promote_rasters(px: DataFrame, label: str) -> DataFrame:
    """Predictions as annotation rasters: provenance 2 and protection 1 wherever a class is set."""
    on = F.col(label) > 0
    return px.select(
        "image_id", "row", "col", F.col(label).alias("label"),
        F.when(on, 2).otherwise(0).alias("provenance"), F.when(on, 1).otherwise(0).alias("protection"),
    )


def lineage(revisions: DataFrame) -> DataFrame:
    """Depth and root of every revision by pointer doubling: log2(depth) rounds for any depth.

    Parents that form a cycle raise a ValueError.
    """
    state = cut(revisions.select(
        "revision_id", F.col("parent_revision_id").alias("_up"), F.when(F.col("parent_revision_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth")
    ))
    reach, rows = 1, state.count()
    while not state.where("_up IS NOT NULL").limit(1).isEmpty():
        if reach > rows:  # a path longer than all revisions
            raise ValueError("revisions are their own ancestors")
        reach *= 2
        hop = state.select(
            F.col("revision_id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_d"), F.col("root").alias("_root") if "root" in state.columns else F.lit(None).cast("bigint").alias("_root"),
        )
        known = F.col("root") if "root" in state.columns else F.lit(None).cast("bigint")
        state = cut(state.join(hop, "_up", "left").select(
            "revision_id", F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.coalesce(known, F.when(F.col("_next").isNull(), F.coalesce("_root", "_up"))).alias("root"),
        ))
    root = F.coalesce("root", "revision_id") if "root" in state.columns else F.col("revision_id")
    return state.select("revision_id", "depth", root.alias("root_revision_id"))


def lineage_paths(spark, table: str, levels: int = 1000) -> DataFrame:
    """Every (revision, ancestor, distance) pair of a registered view by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE chain(revision_id, ancestor_id, distance) MAX RECURSION LEVEL {int(levels)} AS (
            SELECT revision_id, parent_revision_id, 1 FROM {table} WHERE parent_revision_id IS NOT NULL
            UNION ALL
            SELECT c.revision_id, r.parent_revision_id, c.distance + 1
            FROM chain c JOIN {table} r ON r.revision_id = c.ancestor_id WHERE r.parent_revision_id IS NOT NULL)
        SELECT * FROM chain""")


def register_snapshots(heads: DataFrame, members: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots of datasets whose images all have a head and no other head exists, and their items.

    Returns ``(snapshots, items)``; locking is ``lock_revisions`` on the items.
    """
    from maskloom.operators.relations import completeness

    broken = completeness(heads, members, ["dataset_id", "image_id"]).select("dataset_id").distinct()
    items = heads.join(broken, "dataset_id", "left_anti")
    counts = items.groupBy("dataset_id").agg(F.count("*").alias("image_count"))
    snapshots = datasets.join(counts, "dataset_id").select(
        "dataset_id", F.concat("name", F.lit(" snapshot")).alias("name"), "image_count"
    )
    return snapshots, items.select("dataset_id", "image_id", "revision_id")


def lock_revisions(revisions: DataFrame, items: DataFrame) -> DataFrame:
    pinned = items.select("revision_id", F.lit(True).alias("_pin")).distinct()
    return revisions.join(pinned, "revision_id", "left").withColumn(
        "is_locked", F.col("is_locked") | F.coalesce("_pin", F.lit(False))
    ).drop("_pin")


# --- manifests --------------------------------------------------------------------------------

def manifest_items(items: DataFrame, images: DataFrame, revisions: DataFrame, extra: dict | None = None) -> DataFrame:
    """One JSON line per snapshot item.

    A manifest of millions of items is a dataset, not one document, so items stay rows; the header
    row comes from :func:`manifest_headers`.
    """
    wide = items.join(images.select("image_id", "file_name", "width", "height"), "image_id").join(
        revisions.select("revision_id", "checksum"), "revision_id"
    )
    fields = [
        F.col("image_id"), F.col("file_name").alias("source_path"), F.col("width"), F.col("height"),
        F.col("revision_id").alias("annotation_revision_id"), F.col("checksum").alias("revision_checksum"),
        *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
    ]
    return wide.select("dataset_id", "image_id", F.to_json(F.struct(*fields)).alias("item"))


def manifest_headers(items: DataFrame, builder: str, extra: dict | None = None) -> DataFrame:
    """Per snapshot: builder, item count and an order-free checksum over its items."""
    return items.groupBy("dataset_id").agg(
        F.lit(builder).alias("builder_id"), F.count("*").alias("item_count"),
        F.sum(F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("bigint")).alias("items_checksum"),
        *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
    )


def raster_export(px: DataFrame, label: str) -> DataFrame:
    """Per image: raster checksum and largest class; more than 16 bits is an error."""
    ranged = F.when(F.col(label).between(0, 65535), F.col(label)).otherwise(
        F.raise_error(F.lit("raster export only holds class indices up to 65535"))
    )
    lines = px.groupBy("image_id", "row").agg(
        F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("col", ranged.alias("v")))), lambda s: s["v"].cast("string")
        ), ","), 256).alias("_h"), F.max(label).alias("_m"),
    )
    return lines.groupBy("image_id").agg(
        F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("row", "_h"))), lambda s: s["_h"]), ""), 256).alias("mask_checksum"),
        F.max("_m").alias("largest_class"),
    )


# Snapshot views by id: function of (items, images, revisions, label pixels) to one row per item.
SNAPSHOT_BUILDERS = {
    "canonical_semantic_dataset": lambda items, images, revisions, px: manifest_items(items, images, revisions),
    "raster_mask_export": lambda items, images, revisions, px: items.join(raster_export(px, "label"), "image_id").select(
        "dataset_id", "image_id", F.to_json(F.struct("image_id", "mask_checksum", "largest_class")).alias("item")
    ),
}


def build_snapshot(builder: str, items: DataFrame, images: DataFrame, revisions: DataFrame, px: DataFrame) -> DataFrame:
    if builder not in SNAPSHOT_BUILDERS:
        raise KeyError(f"unknown snapshot builder: {builder}")
    return SNAPSHOT_BUILDERS[builder](items, images, revisions, px)


# Builder registry: id to item extras, so callers can add their own dataset builds.
DATASET_BUILDERS = {
    "classical.dataset": {"task_type": "semantic_segmentation", "feature_mode": "baseline-copy"},
    "image-mask.dataset": {"task_type": "semantic_segmentation", "input_contract": "image-mask-pairs", "tile_mode": "full-image"},
}


def register_builder(name: str, extra: dict) -> None:
    DATASET_BUILDERS[name] = dict(extra)


def training_manifest(builder: str, items: DataFrame, images: DataFrame, revisions: DataFrame, config: dict | None = None) -> DataFrame:
    """Items of a dataset build by a registered builder; ``config`` overrides its options."""
    if builder not in DATASET_BUILDERS:
        raise KeyError(f"unknown dataset builder: {builder}")
    options = {**DATASET_BUILDERS[builder], **{k: v for k, v in (config or {}).items() if k in DATASET_BUILDERS[builder]}}
    return manifest_items(items, images, revisions, {"builder_id": builder, **options})
