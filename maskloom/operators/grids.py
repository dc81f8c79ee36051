"""Pixel-grid neighbourhoods.

Windows run along one raster line (image, row) or (image, col), so the largest group is one line
of one image however large or hot the image is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _line(image: str, across: str, along: str):
    return Window.partitionBy(image, across).orderBy(along)


def neighbour_values(px: DataFrame, value: str, image: str = "image_id") -> DataFrame:
    """The four neighbours' values as ``_left, _right, _up, _down`` (NULL past the border).

    Pixels are assumed dense; a missing neighbour pixel counts as the border.
    """
    row, col = _line(image, "row", "col"), _line(image, "col", "row")

    def beside(window, along: str, step: int):
        moved = F.lag if step < 0 else F.lead
        return F.when(
            moved(along).over(window) == F.col(along) + step, moved(value).over(window)
        )

    wide = px.withColumns({"_left": beside(row, "col", -1), "_right": beside(row, "col", 1)})
    return wide.withColumns({"_up": beside(col, "row", -1), "_down": beside(col, "row", 1)})


def ring_values(px: DataFrame, value: str, out: str = "_ring", image: str = "image_id") -> DataFrame:
    """The eight surrounding values (those inside the image) as one array column."""
    row, col = _line(image, "row", "col"), _line(image, "col", "row")
    beside = px.withColumns({"_l": F.lag(value).over(row), "_r": F.lead(value).over(row)})
    trio = F.array("_l", value, "_r")
    stacked = beside.withColumn("_trio", trio).withColumns(
        {"_u": F.lag("_trio").over(col), "_d": F.lead("_trio").over(col)}
    )
    empty = F.array().cast(dict(px.dtypes)[value].join(("array<", ">")))
    ring = F.concat(F.array("_l", "_r"), F.coalesce("_u", empty), F.coalesce("_d", empty))
    return stacked.withColumn(out, F.filter(ring, lambda v: v.isNotNull())).drop("_l", "_r", "_u", "_d", "_trio")


def label_boundary(px: DataFrame, label: str, image: str = "image_id") -> DataFrame:
    """Pixels with a 4-neighbour of another label; both sides of a border are marked."""
    around = neighbour_values(px, label, image)
    edge = F.exists(
        F.array("_left", "_right", "_up", "_down"), lambda v: v.isNotNull() & (v != F.col(label))
    )
    return around.where(edge).drop("_left", "_right", "_up", "_down")


def adjacent_pairs(px: DataFrame, segment: str, carry: list[str] = [], image: str = "image_id") -> DataFrame:
    """One row per pair of touching pixels in different segments, ``src < dst``.

    ``carry`` columns come along as ``<name>_a`` and ``<name>_b``.
    """
    row, col = _line(image, "row", "col"), _line(image, "col", "row")
    here = F.struct(F.col(segment).alias("s"), *[F.col(c).alias(c) for c in carry])
    cells = px.select(image, "row", "col", here.alias("_here"))
    right = F.when(F.lead("col").over(row) == F.col("col") + 1, F.lead("_here").over(row))
    below = F.when(F.lead("row").over(col) == F.col("row") + 1, F.lead("_here").over(col))
    pairs = cells.withColumn("_r", right).withColumn("_d", below).select(
        image, "_here", F.explode(F.array("_r", "_d")).alias("_there")
    ).where("_there IS NOT NULL AND _here.s <> _there.s")
    return pairs.select(
        image, F.least("_here.s", "_there.s").alias("src"), F.greatest("_here.s", "_there.s").alias("dst"),
        *[F.col(f"_here.{c}").alias(f"{c}_a") for c in carry],
        *[F.col(f"_there.{c}").alias(f"{c}_b") for c in carry],
    )


def region_adjacency(px: DataFrame, segment: str = "seg_id", image: str = "image_id") -> DataFrame:
    """Distinct touching segment pairs with the number of shared pixel edges."""
    return adjacent_pairs(px, segment, image=image).groupBy(image, "src", "dst").agg(
        F.count("*").alias("shared")
    )
