"""Counts, areas, flips, confusion and region statistics over pixel tables.

All of it is partial-then-final hash aggregation: a pixel table is reduced to one row per
(image, class, ...) inside the map tasks before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even, safe_ratio

ClassList = list[tuple[int, str]]


def class_array(classes: ClassList) -> Column:
    """The class list, a parameter of the job, as a literal array of (class_id, name)."""
    return F.array(*[
        F.struct(F.lit(int(c)).cast("int").alias("class_id"), F.lit(n).alias("name")) for c, n in classes
    ])


def class_counts(px: DataFrame, label: str, keys: list[str] = ["image_id"], digits: int = 3) -> DataFrame:
    """Pixels and rounded percent of every class present."""
    counts = px.groupBy(*keys, F.col(label).alias("class_id")).agg(F.count("*").alias("pixels"))
    total = F.sum("pixels").over(Window.partitionBy(*keys))
    return counts.withColumn("percent", half_even(F.col("pixels") / total * 100.0, digits))


def area_percentages(px: DataFrame, label: str, classes: ClassList, keys: list[str] = ["image_id"]) -> DataFrame:
    """Pixels and percent of every class in the list, absent ones as zero."""
    counts = px.groupBy(*keys, F.col(label).alias("_c")).agg(F.count("*").alias("_n"))
    return _dense_area(counts, classes, keys)


def _dense_area(counts: DataFrame, classes: ClassList, keys: list[str]) -> DataFrame:
    # One small map per key: its size is the number of classes present, never the pixel count.
    folded = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_m"), F.sum("_n").alias("_t")
    )
    dense = folded.select(*keys, "_m", "_t", F.explode(class_array(classes)).alias("k"))
    pixels = F.coalesce(F.try_element_at("_m", F.col("k.class_id")), F.lit(0))
    return dense.select(
        *keys, F.col("k.class_id").alias("class_id"), F.col("k.name").alias("name"),
        pixels.alias("pixels"), (safe_ratio(pixels, F.col("_t")) * 100.0).alias("percent"),
    )


def area_change(raw: DataFrame, refined: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:
    """Refined minus raw per class, over the union of classes on both sides."""
    on = [*keys, "class_id"]
    left = raw.select(*on, F.col("pixels").alias("_rp"), F.col("percent").alias("_rq"))
    right = refined.select(*on, F.col("pixels").alias("_fp"), F.col("percent").alias("_fq"))
    zero, zero_f = F.lit(0), F.lit(0.0)
    rp, fp = F.coalesce("_rp", zero), F.coalesce("_fp", zero)
    rq, fq = F.coalesce("_rq", zero_f), F.coalesce("_fq", zero_f)
    return left.join(right, on, "full_outer").select(
        *on, rp.alias("raw_pixels"), fp.alias("refined_pixels"), (fp - rp).alias("delta_pixels"),
        rq.alias("raw_percent"), fq.alias("refined_percent"), (fq - rq).alias("delta_percent"),
    )


def label_pairs(px: DataFrame, raw: str, refined: str, keys: list[str]) -> DataFrame:
    """Pixel count per (raw, refined) label pair: the only pass over pixels the flip job needs."""
    return px.groupBy(*keys, F.col(raw).alias("raw"), F.col(refined).alias("refined")).agg(
        F.count("*").alias("n")
    )


def flip_totals(pairs: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:
    flips = F.coalesce(F.sum(F.when(F.col("raw") != F.col("refined"), F.col("n"))), F.lit(0))
    return pairs.groupBy(*keys).agg(
        F.sum("n").alias("total_pixels"), flips.alias("flip_pixels")
    ).withColumn("flip_rate", safe_ratio(F.col("flip_pixels"), F.col("total_pixels")))


def flip_stats(pairs: DataFrame, classes: ClassList, keys: list[str] = ["image_id"]) -> DataFrame:
    """Per class: raw, refined, flipped-out and flipped-in pixels with their rates."""
    moved = F.col("raw") != F.col("refined")
    sides = pairs.select(
        *keys,
        F.inline(F.array(
            F.struct(
                F.col("raw").alias("class_id"), F.col("n").alias("raw_n"), F.lit(0).cast("long").alias("ref_n"),
                F.when(moved, F.col("n")).otherwise(0).alias("out_n"), F.lit(0).cast("long").alias("in_n"),
            ),
            F.struct(
                F.col("refined").alias("class_id"), F.lit(0).cast("long").alias("raw_n"), F.col("n").alias("ref_n"),
                F.lit(0).cast("long").alias("out_n"), F.when(moved, F.col("n")).otherwise(0).alias("in_n"),
            ),
        )),
    )
    sums = sides.groupBy(*keys, "class_id").agg(
        *[F.sum(c).alias(c) for c in ("raw_n", "ref_n", "out_n", "in_n")]
    )
    folded = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("class_id", F.struct("raw_n", "ref_n", "out_n", "in_n")))).alias("_m")
    )
    dense = folded.select(*keys, "_m", F.explode(class_array(classes)).alias("k")).withColumn(
        "s", F.try_element_at("_m", F.col("k.class_id"))
    )

    def part(name: str) -> Column:
        return F.coalesce(F.col("s")[name], F.lit(0))

    return dense.select(
        *keys, F.col("k.class_id").alias("class_id"), F.col("k.name").alias("name"),
        part("raw_n").alias("raw_pixels"), part("ref_n").alias("refined_pixels"),
        part("out_n").alias("flipped_out_pixels"), part("in_n").alias("flipped_in_pixels"),
        safe_ratio(part("out_n"), part("raw_n")).alias("flipped_out_rate"),
        safe_ratio(part("in_n"), part("ref_n")).alias("flipped_in_rate"),
    )


def run_rollup(px: DataFrame, label: str, run: str, image: str = "image_id") -> DataFrame:
    """Pixels per class, image and run in one pass; ``level`` 0 = class, 1 = image, 3 = run."""
    counted = px.groupBy(run, image, F.col(label).alias("class_id")).agg(F.count("*").alias("n"))
    rolled = counted.rollup(run, image, "class_id").agg(
        F.sum("n").alias("pixels"), F.grouping_id().cast("int").alias("level")
    )
    return rolled.where(F.col("level") < 7)


def aggregate_area(counts: DataFrame, classes: ClassList, keys: list[str]) -> DataFrame:
    """Run-level area from per-image counts: percent comes from summed counts, not mean percents."""
    summed = counts.groupBy(*keys, F.col("class_id").alias("_c")).agg(F.sum("pixels").alias("_n"))
    return _dense_area(summed, classes, keys)


def confusion_matrix(px: DataFrame, truth: str, pred: str, labels: list[int], keys: list[str] = []) -> DataFrame:
    """One row per true label, one column ``p_<label>`` per predicted label, zero-filled."""
    inside = px.where(F.col(truth).isin(labels) & F.col(pred).isin(labels))
    counts = inside.groupBy(*keys, F.col(truth).alias("true_class"), F.col(pred).alias("_p")).agg(
        F.count("*").alias("_n")
    )
    wide = counts.groupBy(*keys, "true_class").pivot("_p", labels).agg(F.sum("_n")).fillna(0)
    wide = wide.select(*keys, "true_class", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"p_{v}") for v in labels])
    frame = px.select(*keys).distinct() if keys else px.sparkSession.range(1).select()
    rows = frame.select(*keys, F.explode(F.array(*[F.lit(v).cast("int") for v in labels])).alias("true_class"))
    filled = rows.join(wide, [*keys, "true_class"], "left")
    return filled.fillna(0, subset=[f"p_{v}" for v in labels])


def iou_accuracy(px: DataFrame, truth: str, pred: str, labels: list[int], keys: list[str] = []) -> DataFrame:
    """Per label IoU (NULL when the label is on neither side) with the pixel accuracy alongside."""
    pairs = px.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    scored = pairs.groupBy(*keys).agg(
        F.sum("n").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("n"))), F.lit(0)).alias("_hit"),
        F.collect_list(F.struct("t", "p", "n")).alias("_cells"),
    )
    dense = scored.withColumn("class_id", F.explode(F.array(*[F.lit(v).cast("int") for v in labels])))

    def cells(keep) -> Column:
        chosen = F.filter(F.col("_cells"), keep)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])

    inside = lambda c: c["t"].isin(labels) & c["p"].isin(labels)
    tp = cells(lambda c: (c["t"] == F.col("class_id")) & (c["p"] == F.col("class_id")))
    either = cells(lambda c: inside(c) & ((c["t"] == F.col("class_id")) | (c["p"] == F.col("class_id"))))
    return dense.select(
        *keys, "class_id",
        half_even(tp / F.nullif(either, F.lit(0)), 5).alias("iou"),
        half_even(safe_ratio(F.col("_hit"), F.col("_all")), 5).alias("pixel_accuracy"),
    )


def region_means(px: DataFrame, channels: list[str], keys: list[str] = ["image_id", "seg_id"]) -> DataFrame:
    return px.groupBy(*keys).agg(
        F.count("*").alias("pixels"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in channels]
    )


def region_probabilities(
    px: DataFrame, proba: list[str], keys: list[str] = ["image_id", "seg_id"], eps: float = 1e-8
) -> DataFrame:
    """Mean class probabilities per region, clipped to [eps, 1], then normalised to sum 1."""
    means = px.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in proba])
    clipped = [F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(eps)) for c in proba]
    total = sum(clipped[1:], clipped[0])
    return means.select(*keys, *[(v / F.greatest(total, F.lit(eps))).alias(c) for v, c in zip(clipped, proba)])


def region_histogram(
    px: DataFrame, code: str, bins: int | None, keys: list[str] = ["image_id", "seg_id"]
) -> DataFrame:
    """Dense normalised code histogram per region.

    ``bins=None`` takes the largest code plus one, per image (first key).  Codes are clipped.
    """
    image = keys[0]
    counted = px.groupBy(*keys, F.col(code).cast("int").alias("_code")).agg(F.count("*").alias("_n"))
    if bins is None:
        tops = counted.groupBy(image).agg((F.greatest(F.max("_code"), F.lit(0)) + 1).alias("_bins"))
        counted = counted.join(tops, image)
    else:
        counted = counted.withColumn("_bins", F.lit(int(bins)))
    bucket = F.greatest(F.least(F.col("_code"), F.col("_bins") - 1), F.lit(0))
    merged = counted.groupBy(*keys, "_bins", bucket.alias("_b")).agg(F.sum("_n").alias("_n"))
    folded = merged.groupBy(*keys, "_bins").agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"), F.sum("_n").alias("pixels")
    )
    return folded.select(
        *keys, "pixels",
        F.transform(
            F.sequence(F.lit(0), F.col("_bins") - 1),
            lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)) / F.col("pixels"),
        ).alias("hist"),
    )


def region_centroids(px: DataFrame, keys: list[str] = ["image_id", "seg_id"]) -> DataFrame:
    return px.groupBy(*keys).agg(
        F.avg(F.col("col").cast("double")).alias("x"), F.avg(F.col("row").cast("double")).alias("y"),
        F.count("*").alias("pixels"),
    )


def mask_area_bbox(mask_px: DataFrame, keys: list[str]) -> DataFrame:
    """Area and [x, y, width, height] of each mask."""
    return mask_px.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("col").alias("x"), F.min("row").alias("y"),
        (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"),
    )


def polygon_area(flat: Column) -> Column:
    """Shoelace area of a flat x, y list; 0 below three points."""
    n = (F.size(flat) / 2).cast("int")
    last = n - 1

    def cross(i: Column) -> Column:
        j = F.when(i == last, 0).otherwise(i + 1)
        return F.get(flat, i * 2) * F.get(flat, j * 2 + 1) - F.get(flat, i * 2 + 1) * F.get(flat, j * 2)

    terms = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), cross)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(total) * 0.5)


def named_counts(df: DataFrame, keys: list[str], counters: dict[str, Column]) -> DataFrame:
    """Conditional counts in one pass: merge, warm-up and promotion summaries."""
    aggs = [F.count_if(cond).alias(name) for name, cond in counters.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def top_area_changes(changes: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` classes with the largest absolute percent change, class order on ties."""
    window = Window.partitionBy(*keys).orderBy(F.abs("delta_percent").desc(), "class_id")
    # A key holds one row per class, so the window partition is as small as the class list.
    return changes.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
