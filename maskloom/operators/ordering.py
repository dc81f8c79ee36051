"""Ranks, running totals and top-k that stay safe when one key holds most rows.

A window over a hot key sorts that key in one task.  These helpers split the order into ranges
first, so a key is spread over as many tasks as its rows need; only per-range totals are ranked in
a window, and there is at most one such row per (key, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.session import cut


def _ranged(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows in range partitions of (keys, order), tagged with the partition number.

    Range bounds come from sampling, so the tagged frame is materialised before it is read twice.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut(spread.withColumn("_range", F.spark_partition_id()))


def _earlier_totals(ranged: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(out)
    )


def _as_columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ordered_index(df: DataFrame, order, out: str = "idx", keys: list[str] | None = None, start: int = 1) -> DataFrame:
    """Consecutive numbers in ``order`` (a total order), over everything or within ``keys``."""
    keys, order = list(keys or []), _as_columns(order)
    ranged = _ranged(df, keys, order)
    offsets = _earlier_totals(ranged, keys, F.lit(1), "_before")
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    numbered = ranged.withColumn("_pos", F.row_number().over(within))
    joined = numbered.join(offsets, ["_range", *keys])
    return joined.withColumn(out, F.col("_before") + F.col("_pos") + F.lit(start - 1)).drop(
        "_range", "_before", "_pos"
    )


def running_total(df: DataFrame, order, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order``, over everything or within ``keys``."""
    keys, order = list(keys or []), _as_columns(order)
    ranged = _ranged(df, keys, order)
    offsets = _earlier_totals(ranged, keys, F.col(value), "_before")
    within = (
        Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = ranged.withColumn("_within", F.sum(value).over(within))
    return summed.join(offsets, ["_range", *keys]).withColumn(
        out, F.col("_before") + F.col("_within")
    ).drop("_range", "_before", "_within")


def previous_value(df: DataFrame, keys: list[str], order, value: str, out: str) -> DataFrame:
    """``value`` of the row before in ``order`` within ``keys``, null for a key's first row.

    ``value`` itself must not be null.  The first row of a range takes the last value of the nearest
    earlier range of its key.
    """
    order = _as_columns(order)
    ranged = _ranged(df, keys, order)
    lasts = ranged.groupBy(*keys, "_range").agg(
        F.max_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_last")
    )
    carried = lasts.select(
        *keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carried")
    )
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    lagged = ranged.withColumn("_within", F.lag(value).over(within))
    return lagged.join(carried, ["_range", *keys]).withColumn(
        out, F.coalesce("_within", "_carried")
    ).drop("_range", "_within", "_carried")


def top_k(df: DataFrame, keys: list[str], order, k: int, out: str = "rank", spread: Column | None = None) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, ranked from 1.

    Two rounds: each of 64 salted parts of a key keeps its own first ``k``, then the survivors
    (at most 64·k per key) are ranked.  Spark also prunes to ``k`` before the shuffle for small k.
    """
    order = _as_columns(order)
    salt = spread if spread is not None else F.pmod(F.xxhash64(*df.columns), F.lit(64))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= k)
        .drop("_r", "_salt")
    )
    ranked = kept.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per key, the smallest in ``order`` (names or columns): a two-phase aggregate."""
    order = _as_columns(order)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per key, the greatest in ``order``."""
    order = _as_columns(order)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
