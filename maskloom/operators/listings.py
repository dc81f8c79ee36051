"""Filtered, sorted and searched listings, positions and neighbours in an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even
from maskloom.functions.strings import base_name
from maskloom.operators.ordering import ordered_index, top_k


def equal_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; ``None`` means no filter.  Plain predicates, so they reach the scan."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def recent_first(df: DataFrame, when: str, key: str, limit: int) -> DataFrame:
    """Newest first with a key tie-break; a bounded top-k, never a full sort."""
    return df.orderBy(F.col(when).desc(), F.col(key).desc()).limit(max(1, int(limit)))


def jobs_filter(
    jobs: DataFrame, workspace_id: int | None = None, job_type: str | None = None,
    statuses: list[str] | None = None, limit: int = 200,
) -> DataFrame:
    chosen = equal_filter(jobs, workspace_id=workspace_id, job_type=job_type and job_type.strip().lower())
    wanted = [s.strip().lower() for s in statuses or [] if s.strip()]
    if wanted:
        chosen = chosen.where(F.col("status").isin(wanted))
    return recent_first(chosen, "created_on", "job_id", limit)


def active_jobs_by_key(jobs: DataFrame) -> DataFrame:
    """The oldest queued or running job of every dedupe key."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("dedupe_key").agg(
        F.min("job_id").alias("job_id")
    )


def search_facets(df: DataFrame, text: str, columns: list[str], facets: dict[str, str]) -> DataFrame:
    """Rows where any column contains the text (any case) and every facet equals its value."""
    needle = text.strip().lower()
    hits = [F.lower(F.col(c).cast("string")).contains(needle) for c in columns]
    visible = reduce(lambda a, b: a | b, hits) if needle else F.lit(True)
    for column, value in facets.items():
        visible = visible & (F.lower(F.col(column)) == value.lower())
    return df.withColumn("visible", F.coalesce(visible, F.lit(False)))


def facet_counts(flagged: DataFrame, facet: str) -> DataFrame:
    return flagged.groupBy(facet).agg(F.count("*").alias("total"), F.count_if("visible").alias("visible"))


SORT_KEYS = ("name", "size", "date", "count", "status")


def list_sort(df: DataFrame, keys: dict[str, Column], sort: str, descending: bool, tie: str, limit: int) -> DataFrame:
    """User sort on a named key with an id tie-break, first page only."""
    if sort not in keys:
        raise ValueError(f"unknown sort key: {sort}")
    key = keys[sort]
    return df.orderBy(key.desc() if descending else key.asc(), F.col(tie)).limit(limit)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Global position of queued jobs: type class, priority, age, id."""
    rank = (
        F.when(F.col("job_type").isin("training", "analysis"), 0)
        .when(F.col("job_type") == "slic_warmup", 1)
        .otherwise(2)
    )
    queued = jobs.where("status = 'queued'").withColumn("_class", rank)
    return ordered_index(queued, ["_class", "priority", "created_on", "job_id"], "position").drop("_class")


def nav_prev_next(df: DataFrame, group: str, name: str) -> DataFrame:
    """Previous and next name inside each group.  Positions come from ranges, so one huge group is
    spread over tasks; neighbours are an equi join on position."""
    placed = ordered_index(df.select(group, name), [name], "_i", [group])
    moved = placed.select(group, name, F.explode(F.array(F.col("_i") - 1, F.col("_i"), F.col("_i") + 1)).alias("_at"), "_i")
    around = moved.groupBy(group, "_at").agg(
        F.max(F.when(F.col("_i") == F.col("_at"), F.col(name))).alias(name),
        F.max(F.when(F.col("_i") == F.col("_at") - 1, F.col(name))).alias("prev_name"),
        F.max(F.when(F.col("_i") == F.col("_at") + 1, F.col(name))).alias("next_name"),
    )
    return around.where(F.col(name).isNotNull()).drop("_at")


def log_tail(events: DataFrame, keys: list[str], order: str, keep: int = 500) -> DataFrame:
    """The last ``keep`` log entries of every job."""
    return top_k(events, keys, [F.col(order).desc()], keep)


def relabel_contiguous(px: DataFrame, segment: str, image: str = "image_id") -> DataFrame:
    """Compact segment ids per image, from 0 in id order.

    Ids are ranked among distinct segments, which are few, and joined back to pixels.
    """
    ids = px.select(image, segment).distinct()
    numbered = ordered_index(ids, [segment], "new_id", [image], start=0)
    return px.join(numbered, [image, segment])


def workspace_counts(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per workspace with a column per kind; each kind comes counted, ``workspace_id, count``, so little moves."""
    both = None
    for kind, frame in counts.items():
        part = frame.select("workspace_id", F.lit(kind).alias("_kind"), "count")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("workspace_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("count"))), F.lit(0)).alias(kind) for kind in counts
    ])


def _smallest_free(clash: DataFrame, numbers: DataFrame, keys: list[str], first: int) -> DataFrame:
    """``keys, _n``: the smallest number from ``first`` on that ``numbers`` (keys, _n) do not hold for a key of ``clash``.

    It is the smallest of {first} and {taken + 1} that is not taken: one anti join and one minimum, whatever the number of
    copies.
    """
    asked = clash.select(*keys).distinct()
    options = asked.withColumn("_n", F.lit(first).cast("long")).unionByName(
        numbers.join(asked, keys, "left_semi").withColumn("_n", F.col("_n") + 1)
    ).distinct()
    return options.join(numbers, [*keys, "_n"], "left_anti").groupBy(*keys).agg(F.min("_n").alias("_n"))


def _numbered(taken: DataFrame, pattern: str, parts: dict[str, int], number: int, keys: list[str], first: int) -> DataFrame:
    """Names of ``_k`` that carry a plain number: ``keys, _n``."""
    return taken.where(F.col("_k").rlike(pattern)).select(
        *[k for k in keys if k not in parts], *[F.regexp_extract("_k", pattern, i).alias(k) for k, i in parts.items()],
        F.regexp_extract("_k", pattern, number).alias("_text"),
    ).withColumn("_n", F.col("_text").try_cast("bigint")).where(
        (F.col("_n") >= first) & (F.col("_n").cast("string") == F.col("_text"))
    ).select(*keys, "_n")


def unique_names(wanted: DataFrame, existing: DataFrame, scope: str = "scope") -> DataFrame:
    """Collision-free names: ``base``, else ``base (n)`` with the smallest free n from 2.  Both frames are ``scope, name``."""
    taken = existing.select(scope, F.lower("name").alias("_k")).distinct()
    numbers = _numbered(taken, r"^(.*) \((\d+)\)$", {"_k": 1}, 2, [scope, "_k"], 2)
    asked = wanted.select(scope, "name", F.lower("name").alias("_k")).distinct()
    free = _smallest_free(asked.join(taken, [scope, "_k"], "left_semi"), numbers, [scope, "_k"], 2)
    return asked.join(free, [scope, "_k"], "left").select(
        scope, "name",
        F.when(F.col("_n").isNull(), F.col("name")).otherwise(
            F.concat("name", F.lit(" ("), F.col("_n"), F.lit(")"))
        ).alias("unique_name"),
    )


def unique_files(wanted: DataFrame, existing: DataFrame, scope: str = "scope") -> DataFrame:
    """Collision-free file names: ``stem.ext``, else ``stem_n.ext`` with the smallest free n from 1, in any case of letters."""
    keys = [scope, "_stem", "_ext"]
    taken = existing.select(scope, F.lower("name").alias("_k")).distinct()
    numbers = _numbered(taken, r"^(.*)_(\d+)(\.[^.]*|)$", {"_stem": 1, "_ext": 3}, 2, keys, 1)
    split = r"^(.*?)(\.[^.]*|)$"
    own = wanted.select(scope, "name").distinct().withColumns({
        "_k": F.lower("name"), "_stem": F.regexp_extract(F.lower("name"), split, 1), "_ext": F.regexp_extract(F.lower("name"), split, 2),
    })
    free = _smallest_free(own.join(taken, [scope, "_k"], "left_semi"), numbers, keys, 1)
    clash = own.join(taken, [scope, "_k"], "left_semi").select(scope, "name", *keys[1:]).join(free, keys).select(scope, "name", "_n")
    stem, ext = F.regexp_extract("name", split, 1), F.regexp_extract("name", split, 2)
    return own.select(scope, "name").join(clash, [scope, "name"], "left").select(
        scope, "name",
        F.when(F.col("_n").isNull(), F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n"), ext)).alias("unique_name"),
    )



def step_select(
    images: DataFrame, mode: str, percent: float, seed: int = 0, names: DataFrame | None = None,
    name: str = "file_name", key: str = "image_id",
) -> DataFrame:
    """Source images of one recipe step.

    ``fifo``: first k by name; ``random``: k smallest seeded keys; ``selected``: listed names, by
    full name, else by base name.  k = half-even(percent of n), at least 1 when percent > 0.
    """
    from maskloom.functions.hashing import seeded_key

    if mode == "selected":
        if names is None:
            return images.limit(0)
        asked = names.select(F.trim(name).alias("_n")).where("_n <> ''").distinct()
        full = images.join(asked, F.col(name) == F.col("_n"), "left_semi")
        # Only names with no full match fall back to the base name.
        rest = asked.join(images.select(F.col(name).alias("_n")), "_n", "left_anti").select(
            base_name(F.col("_n")).alias("_b")
        ).distinct()
        base = images.join(rest, base_name(F.col(name)) == F.col("_b"), "left_semi")
        return full.unionByName(base).dropDuplicates([key])
    order = [F.col(name), F.col(key)] if mode == "fifo" else [seeded_key(seed, F.col(key)), F.col(key)]
    placed = ordered_index(images.withColumns({f"_o{i}": o for i, o in enumerate(order)}), ["_o0", "_o1"], "_i")
    count = half_even(F.lit(float(percent)) / 100.0 * images.agg(F.count("*")).scalar())
    k = F.when(F.lit(percent > 0) & (count == 0), F.lit(1.0)).otherwise(count)
    return placed.where(F.col("_i") <= k).drop("_i", "_o0", "_o1")


def status_bucket(status: Column) -> Column:
    key = F.lower(F.trim(status))
    return (
        F.when(key.isin("completed", "trained", "success"), "is-good")
        .when(key.isin("queued", "running", "training", "cancel_requested"), "is-progress")
        .when(key.isin("failed", "error", "canceled"), "is-bad")
        .otherwise("is-neutral")
    )


def job_type_label(job_type: Column) -> Column:
    from maskloom.functions.strings import title_label

    key = F.lower(F.trim(job_type))
    return (
        F.when(key == "training", "Training").when(key == "analysis", "Analysis")
        .when(key == "slic_warmup", "SLIC Warmup").otherwise(title_label(key))
    )
