"""Class lists: parsing, normalising, diffing, resolving.

Groups here are class lists, bounded by the 16-bit class index, so a window per list is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.strings import parse_names


def class_names(lists: DataFrame, key: str, text: str) -> DataFrame:
    """Names of each list: split, trimmed, distinct without case, first spelling and place kept."""
    tokens = lists.select(key, F.posexplode(parse_names(F.col(text))).alias("pos", "name"))
    first = tokens.groupBy(key, F.lower("name").alias("_k")).agg(
        F.min_by("name", "pos").alias("name"), F.min("pos").alias("_p")
    )
    return first.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("_p")) - 1).alias("position"), "name"
    )


def normalize_schema(entries: DataFrame, key: str) -> DataFrame:
    """Valid entries of each list, first per id, ordered by (order, id) and renumbered from 0.

    ``entries``: key, idx, class_id, name, class_order.  Ids must be positive, names not blank; an
    absent order is the entry's place in the list.
    """
    valid = entries.select(
        key, "idx", "class_id", F.trim("name").alias("name"), F.coalesce("class_order", "idx").alias("class_order")
    ).where("class_id > 0 AND name <> ''")
    kept = valid.groupBy(key, "class_id").agg(F.min_by(F.struct("name", "class_order"), "idx").alias("e"))
    order = Window.partitionBy(key).orderBy("e.class_order", "class_id")
    return kept.select(key, "class_id", "e.name", (F.row_number().over(order) - 1).alias("class_order"))


def next_class_id(schema: DataFrame, key: str, given: DataFrame) -> DataFrame:
    """The next free id: one past the largest, or the given one when that is larger."""
    tops = schema.groupBy(key).agg((F.max("class_id") + 1).alias("_top"))
    return given.join(tops, key, "left").select(
        key, F.greatest(F.coalesce("_top", F.lit(1)), F.coalesce("next_class_id", F.lit(1))).alias("next_class_id")
    )


def schema_diff(existing: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """Match proposed names to existing classes.

    ``existing``: key, class_id, name, class_order; ``proposed``: key, position, name (distinct).
    Same name (any case) keeps its id; leftover ids are handed to leftover names in order
    (renames); further names get new ids after the largest.  Rows carry ``change``:
    kept, renamed, added or removed.
    """
    by_name = existing.groupBy(key, F.lower(F.trim("name")).alias("_k")).agg(
        F.max_by(F.struct("class_id", "name"), "class_order").alias("_hit")
    )
    planned = proposed.withColumn("_k", F.lower("name")).join(by_name, [key, "_k"], "left")
    matched = planned.where("_hit IS NOT NULL").select(
        key, "position", "name", F.col("_hit.class_id").alias("class_id"), F.col("_hit.name").alias("before")
    )
    rank = Window.partitionBy(key)
    new_names = planned.where("_hit IS NULL").select(
        key, "position", "name", F.row_number().over(rank.orderBy("position")).alias("_n")
    )
    spare = existing.join(matched.select(key, "class_id"), [key, "class_id"], "left_anti").select(
        key, F.col("class_id").alias("_spare"), F.col("name").alias("_before"),
        F.row_number().over(rank.orderBy("class_order")).alias("_n"),
    )
    paired = new_names.join(spare, [key, "_n"], "full_outer")
    tops = existing.groupBy(key).agg(F.max("class_id").alias("_top"), F.count("*").alias("_have"))
    used = matched.groupBy(key).agg(F.count("*").alias("_used"))
    counts = tops.join(used, key, "left").withColumn("_left", F.col("_have") - F.coalesce("_used", F.lit(0)))
    extra = paired.join(counts, key, "left")
    fresh_id = F.coalesce("_top", F.lit(0)) + F.col("_n") - F.coalesce("_left", F.lit(0))
    rest = extra.select(
        key, "position", "name", F.coalesce("_spare", fresh_id).alias("class_id"), F.col("_before").alias("before"),
        F.when(F.col("name").isNull(), "removed").when(F.col("_spare").isNull(), "added")
        .when(F.col("_before") != F.col("name"), "renamed").otherwise("kept").alias("change"),
    )
    kept = matched.withColumn("change", F.when(F.col("before") != F.col("name"), "renamed").otherwise("kept"))
    return kept.unionByName(rest)


def diff_flags(diff: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Per list: whether classes were removed, renamed, reordered, or only appended."""
    placed = diff.where("change <> 'removed'").join(
        existing.select(key, "class_id", F.col("class_order").alias("_was")), [key, "class_id"], "left"
    )
    order = Window.partitionBy(key).orderBy("position")
    stepped = placed.where("_was IS NOT NULL").withColumn("_prev", F.lag("_was").over(order))
    moved = stepped.groupBy(key).agg(F.bool_or(F.coalesce(F.col("_was") < F.col("_prev"), F.lit(False))).alias("reordered"))
    sums = diff.groupBy(key).agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "renamed").alias("renamed"),
    )
    joined = sums.join(moved, key, "left").withColumn("reordered", F.coalesce("reordered", F.lit(False)))
    return joined.withColumns({
        "append_only": F.expr("removed = 0 AND renamed = 0 AND NOT reordered"), "destructive": F.expr("removed > 0"),
    })


def resolve_class(requests: DataFrame, schema: DataFrame, key: str, value: str) -> DataFrame:
    """A class id from a number that is in the list, else from a name in any case (first in order)."""
    ids = schema.select(key, F.col("class_id").alias("_id"))
    names = schema.groupBy(key, F.lower(F.trim("name")).alias("_k")).agg(F.min_by("class_id", "class_order").alias("_named"))
    asked = requests.withColumns({"_id": F.col(value).try_cast("int"), "_k": F.lower(F.trim(value))})
    found = asked.join(ids.withColumn("_ok", F.lit(True)), [key, "_id"], "left").join(names, [key, "_k"], "left")
    return found.withColumn("class_id", F.when(F.col("_ok"), F.col("_id")).otherwise(F.col("_named"))).drop(
        "_id", "_k", "_ok", "_named"
    )


def drop_class_masks(masks: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Masks that survive the removal of classes (base, frozen and legacy masks all go)."""
    return masks.join(removed.select(*keys).distinct(), keys, "left_anti")
