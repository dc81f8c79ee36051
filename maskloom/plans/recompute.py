"""Recompute superpixels under new settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.datasets import upsert
from maskloom.operators.masks import mask_union
from maskloom.operators.superpixels import ALGORITHMS, algorithm

MASK = ["image_id", "class_id", "row", "col"]


def recompute(
    px: DataFrame, images: DataFrame, settings: DataFrame, overrides: DataFrame, masks: DataFrame, frozen: DataFrame,
    channels: list[str], *, keep: str = "freeze", **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New settings for the images in ``settings`` (image_id, updated, ... like ``overrides``).

    ``n_segments`` and ``compactness`` of a row, where ``settings`` has them, act on that image.

    ``keep="freeze"`` turns what is drawn on those images into frozen pixels first; ``"drop"``
    throws it away.  Returns ``(frozen, overrides, segments)``; images without new settings keep
    their frozen pixels and get no new segments.
    """
    if keep not in ("freeze", "drop"):
        raise ValueError("keep must be 'freeze' or 'drop'")
    chosen = settings.select("image_id").distinct()
    drawn = masks.select(*MASK).join(chosen, "image_id", "left_semi").select(*MASK)
    old = frozen.select(*MASK)
    if keep == "freeze":
        now = mask_union(old, drawn)
    else:
        now = old.join(chosen, "image_id", "left_anti").select(*MASK)
    merged = upsert(overrides, settings, ["image_id"], "updated")
    # One job per registered algorithm, each over its own images; unknown names run as slic.
    known = sorted(ALGORITHMS)
    resolved = F.when(F.col("algorithm").isin(known), F.col("algorithm")).otherwise("slic")
    acting = [c for c in ("n_segments", "compactness") if c in settings.columns]
    wanted = settings.select("image_id", resolved.alias("_algorithm"), *acting)
    segments = None
    for name in known:
        mine = images.drop(*acting).join(wanted.where(F.col("_algorithm") == name), "image_id").drop("_algorithm")
        part = px.join(mine.select("image_id"), "image_id", "left_semi")
        made = algorithm(name)(part, channels, mine, **options).select(
            "image_id", "row", "col", F.col("seg_id").cast("bigint").alias("seg_id")
        )
        segments = made if segments is None else segments.unionByName(made)
    return now, merged, segments
