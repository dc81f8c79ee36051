"""Label maps, confidence, overlays and class masks on their way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import seeded_unit
from maskloom.operators.grids import neighbour_values, ring_values
from maskloom.operators.masks import class_runs


def label_grid_lines(px: DataFrame, label: str, image: str = "image_id") -> DataFrame:
    """One comma-separated text line per raster row; each group is one line of one image."""
    cells = F.sort_array(F.collect_list(F.struct("col", F.col(label).alias("v"))))
    return px.groupBy(image, "row").agg(
        F.array_join(F.transform(cells, lambda s: s["v"].cast("string")), ",").alias("line")
    )


def write_label_grids(px: DataFrame, label: str, path: str, image: str = "image_id") -> None:
    """Lines as ``image|row|a,b,c`` text, read back by ``sources.masks.read_label_grids``."""
    lines = label_grid_lines(px, label, image)
    lines.select(F.concat_ws("|", F.col(image), "row", "line").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def palette_color(class_id: Column, seed: int) -> list[Column]:
    """A seeded colour per class, channels in 35..254; class 0 is black."""
    return [
        F.when(class_id == 0, 0).otherwise(
            (F.lit(35) + F.floor(seeded_unit(seed, class_id, F.lit(channel)) * 220)).cast("int")
        )
        for channel in "rgb"
    ]


def overlay_blend(px: DataFrame, label: str, palette: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Foreground: 0.55 image + 0.45 class colour, truncated.  Background stays as it is."""
    colors = F.create_map(*[
        item for c, rgb in palette.items() for item in (F.lit(int(c)), F.array(*[F.lit(int(v)) for v in rgb]))
    ])

    def mix(channel: str, position: int) -> Column:
        tint = F.coalesce(F.get(F.try_element_at(colors, F.col(label)), F.lit(position)), F.lit(0))
        blended = F.floor(F.col(channel) * 0.55 + tint * 0.45).cast("int")
        return F.when(F.col(label) > 0, blended).otherwise(F.col(channel).cast("int"))

    return px.withColumns({f"overlay_{c}": mix(c, i) for i, c in enumerate("rgb")})


def boundary_overlay(
    px: DataFrame, segment: str = "seg_id", color: tuple[int, int, int, int] = (255, 255, 0, 255)
) -> DataFrame:
    """Outer outline of segments: transparent elsewhere.

    A pixel is drawn when a 4-neighbour belongs to another segment and either the pixel is in
    segment 0, which counts as background, or two other-than-0 segments meet in its 3×3 square.
    """
    around = ring_values(neighbour_values(px, segment), segment)
    own = F.col(segment)
    beside = F.array("_left", "_right", "_up", "_down")
    differs = F.exists(beside, lambda v: v.isNotNull() & (v != own))
    meets = F.exists("_ring", lambda v: (v != 0) & (v != own))
    drawn = differs & ((own == 0) | meets)
    rgba = {k: F.when(drawn, int(v)).otherwise(0) for k, v in zip(("red", "green", "blue", "alpha"), color)}
    return around.withColumns(rgba).drop("_left", "_right", "_up", "_down", "_ring")


def write_class_masks(px: DataFrame, label: str, path: str, image: str = "image_id") -> None:
    """Per-class run tables, partitioned by class; classes with no pixel write nothing."""
    class_runs(px, label, image).write.mode("overwrite").partitionBy("class_id").parquet(path)


def write_predictions(px: DataFrame, path: str, run: str = "run_id") -> None:
    """Raw and refined label maps under ``run_id=/variant=``."""
    variants = px.select(
        run, "image_id", "row", "col",
        F.explode(F.create_map(
            F.lit("raw"), F.col("pred_raw"), F.lit("refined"), F.col("pred_refined")
        )).alias("variant", "class_id"),
    )
    variants.write.mode("overwrite").partitionBy(run, "variant").parquet(path)
