"""Filters, listings, positions, dataset life cycle and merging (survey groups C, E, F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import datasets as ds
from maskloom.operators import listings as ls
from maskloom.operators import masks as mk
from maskloom.operators import statistics as st
from maskloom.operators.line_runs import merge_overlap_runs
from maskloom.operators.ordering import ordered_index
from workload.registry import query
from workload.tables import SIDE


@query("workspace_filter", "SELECT draft_id, name FROM drafts WHERE workspace_id = 2", "drafts")
def _workspace(t):
    return ls.equal_filter(t.drafts, workspace_id=2, dataset_id=None).select("draft_id", "name")


@query("jobs_filter", """
SELECT job_id, status FROM jobs WHERE workspace_id = 3 AND job_type = 'analysis' AND status IN ('queued', 'running')
ORDER BY created_on DESC, job_id DESC LIMIT 50
""", "jobs")
def _jobs(t):
    return ls.jobs_filter(t.jobs, 3, " Analysis ", ["queued", "RUNNING"], 50).select("job_id", "status")


@query("active_job_by_key", """
SELECT dedupe_key, min(job_id) AS job_id FROM jobs WHERE status IN ('queued', 'running') GROUP BY dedupe_key
""", "jobs")
def _active(t):
    return ls.active_jobs_by_key(t.jobs)


@query("list_search_facets", """
SELECT lang, count(*) AS total, sum((lower(file_name) LIKE '%c_1%' AND source = (SELECT min(source) FROM documents))::INT)::BIGINT AS visible
FROM library GROUP BY lang
""".replace("'%c_1%'", "'%c\\_1%' ESCAPE '\\'"), "library")
def _facets(t):
    first = t.read("documents").agg(F.min("source")).scalar()
    flagged = ls.search_facets(t.library, " C_1 ", ["file_name"], {})
    narrowed = flagged.withColumn("visible", F.col("visible") & (F.col("source") == first))
    return ls.facet_counts(narrowed, "lang")


@query("recent_first", """
SELECT run_id, created_on::VARCHAR AS created_on FROM runs ORDER BY runs.created_on DESC, run_id DESC LIMIT 100
""", "runs")
def _recent(t):
    return ls.recent_first(t.runs, "created_on", "run_id", 100).select("run_id", F.col("created_on").cast("string").alias("created_on"))


@query("list_sort", "SELECT doc_id, file_name FROM library ORDER BY n_chars DESC, doc_id LIMIT 60", "library")
def _sort(t):
    keys = {"name": F.lower("file_name"), "size": F.col("n_chars"), "date": F.col("doc_id"), "status": F.col("lang")}
    return ls.list_sort(t.library, keys, "size", True, "doc_id", 60).select("doc_id", "file_name")


@query("queue_position", """
SELECT job_id, row_number() OVER (ORDER BY CASE WHEN job_type IN ('training', 'analysis') THEN 0 WHEN job_type = 'slic_warmup' THEN 1 ELSE 2 END,
  priority, created_on, job_id) AS position FROM jobs WHERE status = 'queued'
""", "jobs")
def _queue(t):
    return ls.queue_positions(t.jobs).select("job_id", "position")


@query("nav_prev_next", """
SELECT lang, file_name, coalesce(lag(file_name) OVER w, '-') AS prev_name, coalesce(lead(file_name) OVER w, '-') AS next_name
FROM library WINDOW w AS (PARTITION BY lang ORDER BY file_name)
""", "library")
def _nav(t):
    return ls.nav_prev_next(t.library, "lang", "file_name").fillna("-")


@query("log_tail", """
SELECT job_id, event_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM job_events QUALIFY rank <= 20
""", "job_events")
def _log_tail(t):
    return ls.log_tail(t.job_events.select("job_id", "event_id"), ["job_id"], "event_id", 20)


@query("log_last", "SELECT job_id, arg_max(message, event_id) AS last_message FROM job_events GROUP BY job_id", "job_events")
def _log_last(t):
    return t.job_events.groupBy("job_id").agg(F.max_by("message", "event_id").alias("last_message"))


@query("relabel_contiguous", """
SELECT image_id, "row", col, dense_rank() OVER (PARTITION BY image_id ORDER BY seg_id * 5 % 61) - 1 AS new_id FROM px
""", "px")
def _relabel(t):
    px = t.px.withColumn("s", F.expr("seg_id * 5 % 61"))
    return ls.relabel_contiguous(px, "s").select("image_id", "row", "col", "new_id")


@query("assign_ids", "SELECT ann_id, row_number() OVER (ORDER BY image_id, order_idx, ann_id) AS new_id FROM ann", "ann")
def _assign(t):
    return ordered_index(t.ann.select("ann_id", "image_id", "order_idx"), ["image_id", "order_idx", "ann_id"], "new_id").select("ann_id", "new_id")


NAMES = """
existing AS (SELECT DISTINCT c_nationkey AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'Draft ' || c_custkey % 7
  ELSE 'draft ' || c_custkey % 7 || ' (' || 1 + c_custkey % 5 || ')' END AS name FROM customer),
asked AS (SELECT DISTINCT n_nationkey AS scope, 'Draft ' || s_suppkey % 9 AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
"""


@query("unique_names", f"""
WITH {NAMES}
SELECT a.scope, a.name, CASE WHEN NOT EXISTS (SELECT 1 FROM existing e WHERE e.scope = a.scope AND lower(e.name) = lower(a.name)) THEN a.name
  ELSE a.name || ' (' || min(n.n) || ')' END AS unique_name
FROM asked a JOIN (SELECT unnest(range(2, 50)) AS n) n
  ON NOT EXISTS (SELECT 1 FROM existing e WHERE e.scope = a.scope AND lower(e.name) = lower(a.name || ' (' || n.n || ')'))
GROUP BY a.scope, a.name
""")
def _unique(t):
    existing = t.read("customer").selectExpr(
        "c_nationkey AS scope",
        "IF(c_custkey % 3 = 0, concat('Draft ', c_custkey % 7), concat('draft ', c_custkey % 7, ' (', 1 + c_custkey % 5, ')')) AS name",
    )
    asked = t.read("supplier").selectExpr("s_nationkey AS scope", "concat('Draft ', s_suppkey % 9) AS name")
    return ls.unique_names(asked, existing)


FILES = """
held AS (SELECT DISTINCT o_custkey % 20 AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'IMG_' || o_orderkey % 5 || '.PNG'
  ELSE 'img_' || o_orderkey % 5 || '_' || o_orderkey % 7 || '.png' END AS name FROM orders),
asked AS (SELECT DISTINCT s_suppkey % 20 AS scope, 'img_' || s_suppkey % 9 || '.png' AS name FROM supplier)
"""


@query("unique_files", f"""
WITH {FILES}
SELECT a.scope, a.name, CASE WHEN NOT EXISTS (SELECT 1 FROM held e WHERE e.scope = a.scope AND lower(e.name) = lower(a.name)) THEN a.name
  ELSE replace(a.name, '.png', '') || '_' || min(n.n) || '.png' END AS unique_name
FROM asked a JOIN (SELECT unnest(range(1, 50)) AS n) n
  ON NOT EXISTS (SELECT 1 FROM held e WHERE e.scope = a.scope AND lower(e.name) = replace(a.name, '.png', '') || '_' || n.n || '.png')
GROUP BY a.scope, a.name
""")
def _unique_files(t):
    held = t.read("orders").selectExpr(
        "o_custkey % 20 AS scope",
        "IF(o_orderkey % 3 = 0, concat('IMG_', o_orderkey % 5, '.PNG'), concat('img_', o_orderkey % 5, '_', o_orderkey % 7, '.png')) AS name",
    )
    asked = t.read("supplier").selectExpr("s_suppkey % 20 AS scope", "concat('img_', s_suppkey % 9, '.png') AS name")
    return ls.unique_files(asked, held)


STEP_N = "(SELECT CAST(round_even(0.35::DOUBLE * count(*), 0) AS BIGINT) FROM images)"


@query("step_select", f"""
SELECT 'fifo' AS mode, image_id FROM (SELECT image_id, row_number() OVER (ORDER BY file_name) AS n FROM images) a WHERE n <= {STEP_N}
UNION ALL SELECT 'random', image_id FROM (SELECT image_id, row_number() OVER (ORDER BY md5('5|' || image_id)) AS n FROM images) a WHERE n <= {STEP_N}
UNION ALL SELECT 'selected', image_id FROM images WHERE file_name IN (SELECT 'img_' || user_id || '.png' FROM events)
""", "images")
def _step(t):
    names = t.read("events").selectExpr(
        "IF(user_id % 2 = 0, concat('up/img_', user_id, '.png'), concat('img_', user_id, '.png')) AS file_name"
    )
    parts = [
        ls.step_select(t.images, "fifo", 35.0), ls.step_select(t.images, "random", 35.0, seed=5),
        ls.step_select(t.images, "selected", 0.0, names=names),
    ]
    frames = [p.select(F.lit(m).alias("mode"), "image_id") for p, m in zip(parts, ("fifo", "random", "selected"))]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@query("status_bucket", """
SELECT job_id, CASE WHEN status = 'completed' THEN 'is-good' ELSE 'is-progress' END AS bucket,
  CASE job_type WHEN 'training' THEN 'Training' WHEN 'analysis' THEN 'Analysis' WHEN 'slic_warmup' THEN 'SLIC Warmup' ELSE 'Export' END AS label
FROM jobs
""", "jobs")
def _bucket(t):
    return t.jobs.select("job_id", ls.status_bucket(F.col("status")).alias("bucket"), ls.job_type_label(F.col("job_type")).alias("label"))


@query("dashboard_counts", """
SELECT workspace_id, sum((kind = 'i')::INT)::BIGINT AS images, sum((kind = 'd')::INT)::BIGINT AS datasets, sum((kind = 'f')::INT)::BIGINT AS drafts,
  sum((kind = 'm')::INT)::BIGINT AS models, sum((kind = 'r')::INT)::BIGINT AS runs FROM (
  SELECT workspace_id, 'i' AS kind FROM images UNION ALL SELECT workspace_id, 'd' FROM datasets UNION ALL SELECT workspace_id, 'f' FROM drafts
  UNION ALL SELECT d.workspace_id, 'm' FROM models m JOIN datasets d ON d.dataset_id = m.dataset_id
  UNION ALL SELECT workspace_id, 'r' FROM runs) u GROUP BY workspace_id
""", "images datasets drafts models runs")
def _dashboard(t):
    # A model is in the workspace of its dataset; it is counted per dataset before the two meet.
    models = t.models.groupBy("dataset_id").count().join(t.datasets.select("dataset_id", "workspace_id"), "dataset_id").groupBy(
        "workspace_id"
    ).agg(F.sum("count").alias("count"))
    return ls.workspace_counts({
        **{k: f.groupBy("workspace_id").count() for k, f in (("images", t.images), ("datasets", t.datasets), ("drafts", t.drafts), ("runs", t.runs))},
        "models": models,
    })


# --- drafts -----------------------------------------------------------------------------------

SELECTED_SQL = "SELECT DISTINCT o_custkey AS draft_id, o_orderkey % 140 AS image_id FROM orders"


def _selected(t):
    return t.read("orders").selectExpr("o_custkey AS draft_id", "o_orderkey % 140 AS image_id")


@query("draft_create", f"""
SELECT draft_id, count(*) AS image_count, CAST(1 AS INTEGER) AS version FROM ({SELECTED_SQL}) s
WHERE image_id IN (SELECT image_id FROM images) GROUP BY draft_id
""", "images")
def _draft_create(t):
    return ds.draft_rows(ds.draft_items(_selected(t), t.images))


@query("branch_dataset", """
SELECT draft_id + 1000000 AS draft_id, name || ' (branch)' AS name, CAST(1 AS INTEGER) AS version, 'branched_from_draft' AS origin_type,
       draft_id AS origin_draft_id, CAST(1 + draft_id % 9 AS INTEGER) AS origin_version FROM drafts
""", "drafts")
def _branch(t):
    drafts = t.drafts.withColumn("version", F.expr("cast(1 + draft_id % 9 AS int)"))
    return ds.branch_drafts(drafts, F.col("draft_id") + 1000000).drop("workspace_id")


ACTION = "CASE event_type WHEN 'click' THEN 'mask_saved' WHEN 'purchase' THEN 'classes_edited' WHEN 'signup' THEN 'images_added' ELSE 'opened' END"


@query("draft_version", f"""
SELECT draft_id, seq, 1 + sum((action <> 'opened')::INT) OVER (PARTITION BY draft_id ORDER BY seq)::BIGINT AS version
FROM (SELECT user_id AS draft_id, event_id AS seq, {ACTION} AS action FROM events) e
""")
def _version(t):
    actions = t.read("events").selectExpr("user_id AS draft_id", "event_id AS seq", f"{ACTION} AS action")
    return ds.draft_version_history(actions).select("draft_id", "seq", "version")


@query("draft_version_final", f"""
SELECT draft_id, 1 + sum((action <> 'opened')::INT)::BIGINT AS version
FROM (SELECT user_id AS draft_id, {ACTION} AS action FROM events) e GROUP BY draft_id
""")
def _version_final(t):
    return ds.draft_versions(t.read("events").selectExpr("user_id AS draft_id", f"{ACTION} AS action"))


@query("drop_image_assets", """
SELECT 'images' AS asset, image_id, count(*) AS n FROM images WHERE image_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000) GROUP BY ALL
UNION ALL SELECT 'masks', image_id, count(*) FROM masks WHERE image_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000) GROUP BY ALL
""", "images masks")
def _drop(t):
    removed = t.read("supplier").where("s_acctbal < 3000").selectExpr("s_suppkey AS image_id")
    kept = ds.drop_images(removed, {"images": t.images, "masks": t.masks})
    parts = [f.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("asset", F.lit(k)) for k, f in kept.items()]
    return parts[0].unionByName(parts[1])


@query("add_images", f"""
SELECT * FROM (SELECT DISTINCT o_custkey AS draft_id, o_orderkey % 131 AS image_id FROM orders) w
WHERE image_id IN (SELECT image_id FROM images) AND NOT EXISTS (SELECT 1 FROM ({SELECTED_SQL}) h WHERE h.draft_id = w.draft_id AND h.image_id = w.image_id)
""", "images")
def _add(t):
    wanted = t.read("orders").selectExpr("o_custkey AS draft_id", "o_orderkey % 131 AS image_id")
    return ds.add_images(_selected(t), wanted, t.images)


UPSERT_ROWS = """
SELECT o_custkey AS owner_id, o_orderkey % 3 AS kind, md5('a' || o_orderkey) AS checksum, o_orderkey AS updated, o_orderkey AS created FROM orders
"""


@query("artifact_upsert", f"""
SELECT owner_id, kind, arg_max(checksum, updated) AS checksum, max(updated) AS updated, min(created) AS created FROM ({UPSERT_ROWS}) u GROUP BY owner_id, kind
""")
def _artifact(t):
    rows = t.read("orders").selectExpr(
        "o_custkey AS owner_id", "o_orderkey % 3 AS kind", "md5(concat('a', o_orderkey)) AS checksum",
        "o_orderkey AS updated", "o_orderkey AS created", "o_orderstatus",
    )
    old, new = rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return ds.upsert(old, new, ["owner_id", "kind"], "updated", "created")


@query("override_upsert", """
SELECT o_custkey AS draft_id, o_orderkey % 20 AS image_id, arg_max(o_orderkey % 900 + 100, o_orderkey) AS n_segments FROM orders GROUP BY ALL
""")
def _override(t):
    rows = t.read("orders").selectExpr(
        "o_custkey AS draft_id", "o_orderkey % 20 AS image_id", "o_orderkey % 900 + 100 AS n_segments", "o_orderkey AS updated"
    )
    return ds.upsert(rows, rows.limit(0), ["draft_id", "image_id"], "updated").drop("updated")


@query("override_delete", """
SELECT DISTINCT o_custkey AS draft_id, o_orderkey % 20 AS image_id FROM orders
WHERE (o_custkey, o_orderkey % 20) NOT IN (SELECT (user_id, event_id % 20) FROM events WHERE event_type = 'error')
""".replace("(o_custkey, o_orderkey % 20) NOT IN (SELECT (user_id, event_id % 20)", "(o_custkey, o_orderkey % 20) NOT IN (SELECT user_id, event_id % 20"))
def _override_delete(t):
    rows = t.read("orders").selectExpr("o_custkey AS draft_id", "o_orderkey % 20 AS image_id").distinct()
    gone = t.read("events").where("event_type = 'error'").selectExpr("user_id AS draft_id", "event_id % 20 AS image_id")
    return rows.join(gone.distinct(), ["draft_id", "image_id"], "left_anti")


@query("next_class_index", """
SELECT d.dataset_id, coalesce(max(c.class_index), 0) + 1 AS next_class_index FROM datasets d
LEFT JOIN (SELECT DISTINCT o_custkey AS dataset_id, o_orderkey % 12 AS class_index FROM orders WHERE o_orderstatus = 'F') c
  ON c.dataset_id = d.dataset_id GROUP BY d.dataset_id
""", "datasets")
def _next_index(t):
    classes = t.read("orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS dataset_id", "o_orderkey % 12 AS class_index")
    return ds.next_class_index(classes, t.datasets)


# --- summaries --------------------------------------------------------------------------------

@query("promote_stats", """
SELECT run_id, sum((input_image <> '' AND coalesce(refined_path, mask_path, raw_path) IS NOT NULL)::INT)::BIGINT AS processed,
  sum((input_image = '' OR coalesce(refined_path, mask_path, raw_path) IS NULL)::INT)::BIGINT AS skipped,
  sum((input_image <> '' AND coalesce(refined_path, mask_path, raw_path) IS NOT NULL AND conf_path IS NOT NULL)::INT)::BIGINT AS threshold_applied,
  sum((input_image <> '' AND coalesce(refined_path, mask_path, raw_path) IS NOT NULL AND conf_path IS NULL)::INT)::BIGINT AS missing_confidence
FROM run_items GROUP BY run_id
""", "run_items")
def _promote_stats(t):
    usable = F.expr("input_image <> '' AND coalesce(refined_path, mask_path, raw_path) IS NOT NULL")
    return st.named_counts(t.run_items, ["run_id"], {
        "processed": usable, "skipped": ~usable, "threshold_applied": usable & F.col("conf_path").isNotNull(),
        "missing_confidence": usable & F.col("conf_path").isNull(),
    })


@query("warmup_stats", """
SELECT o_custkey % 10 AS dataset_id, sum((o_orderstatus = 'F')::INT)::BIGINT AS cache_hits, sum((o_orderstatus = 'O')::INT)::BIGINT AS generated,
       sum((o_orderstatus = 'P')::INT)::BIGINT AS missing FROM orders GROUP BY ALL
""")
def _warmup(t):
    rows = t.read("orders").withColumn("dataset_id", F.expr("o_custkey % 10"))
    status = F.col("o_orderstatus")
    return st.named_counts(rows, ["dataset_id"], {"cache_hits": status == "F", "generated": status == "O", "missing": status == "P"})


# --- dataset merge ----------------------------------------------------------------------------

HALF = "CAST(order_idx // 8 % 2 AS INTEGER)"


@query("merge_datasets", f"""
WITH i AS (SELECT DISTINCT {HALF} AS dataset_index, image_id FROM ann WHERE image_id % 9 <> order_idx // 8 % 2),
f AS (SELECT image_id, min((dataset_index, image_id)) AS first_at FROM i GROUP BY image_id),
m AS (SELECT image_id, row_number() OVER (ORDER BY first_at) AS merged_image_id FROM f),
c AS (SELECT * FROM (VALUES (0, 1, 1), (0, 2, 2), (1, 2, 3), (1, 3, 1)) v(dataset_index, category_id, merged_category_id))
SELECT a.ann_id, m.merged_image_id, c.merged_category_id FROM (SELECT *, {HALF} AS dataset_index FROM ann) a
JOIN i ON i.image_id = a.image_id AND i.dataset_index = a.dataset_index JOIN m ON m.image_id = a.image_id
JOIN c ON c.dataset_index = a.dataset_index AND c.category_id = a.category_id
""", "ann")
def _merge(t):
    half = F.expr("cast(order_idx DIV 8 % 2 AS int)")
    ann = t.ann.select("ann_id", "image_id", "category_id", half.alias("dataset_index"))
    listed = ann.where("image_id % 9 <> dataset_index").select("dataset_index", "image_id").distinct()
    images = ds.merge_images(listed.withColumns({"pos": F.col("image_id"), "file_name": F.concat(F.lit("img_"), "image_id"), "height": F.lit(SIDE), "width": F.lit(SIDE)}))
    names = t.spark.createDataFrame(
        [(0, 0, 1, "road"), (0, 1, 2, "roof"), (1, 0, 2, "tree"), (1, 1, 3, "road")],
        "dataset_index int, pos int, category_id int, name string",
    )
    categories = ds.merge_categories(names)
    return ds.remap_annotations(ann, images, F.broadcast(categories)).select("ann_id", "merged_image_id", "merged_category_id")


def merge_lines(t, where="true"):
    runs = t.ann.where(where).select(
        F.expr("cast(order_idx DIV 8 % 2 AS int)").alias("dataset_index"), "order_idx", "ann_id", "image_id", "x0", "y0", "w", "h"
    )
    ranked = ds.merge_priority(runs, "last", ["order_idx", "ann_id"])
    return ranked.select(
        "rank", "ann_id", "image_id", F.explode(F.expr("sequence(y0, y0 + h - 1)")).alias("row"),
        F.col("x0").alias("col_start"), F.col("w").alias("col_len"),
    )


@query("merge_overlap", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY -(order_idx // 8 % 2), order_idx, ann_id) AS rank FROM ann),
p AS (SELECT rank, image_id, r2 AS "row", x0 + unnest(range(w)) AS col FROM (SELECT *, y0 + unnest(range(h)) AS r2 FROM r) q)
SELECT image_id, "row", col, min(rank) AS rank FROM p GROUP BY image_id, "row", col
""", "ann")
def _merge_overlap(t):
    owned = mk.runs_to_pixels(merge_overlap_runs(merge_lines(t), "trim", 1)[0])
    return owned.select("image_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "rank")


@query("merge_stats", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY -(order_idx // 8 % 2), order_idx, ann_id) AS rank FROM ann),
p AS (SELECT rank, image_id, r2 AS r, x0 + unnest(range(w)) AS c FROM (SELECT *, y0 + unnest(range(h)) AS r2 FROM r) q),
o AS (SELECT *, min(rank) OVER (PARTITION BY image_id, r, c) AS top FROM p),
v AS (SELECT rank, count(*) AS area, sum((top < rank)::INT) AS overlap FROM o GROUP BY rank)
SELECT sum((overlap < area)::INT)::BIGINT AS kept_annotations, sum((overlap > 0)::INT)::BIGINT AS overlap_annotations,
       sum(overlap)::BIGINT AS overlap_pixels, sum((overlap = area)::INT)::BIGINT AS dropped_overlap, CAST(0 AS BIGINT) AS dropped_small FROM v
""", "ann")
def _merge_stats(t):
    return ds.merge_stats(merge_overlap_runs(merge_lines(t), "trim", 1)[1])


@query("merge_overlap_skip")
def _merge_skip(t):
    return merge_overlap_runs(merge_lines(t), "skip", 6)[1]


@query("merge_overlap_trim_min_area")
def _merge_trim(t):
    return merge_overlap_runs(merge_lines(t), "trim", 9)[1]


@query("ordered_union_names", """
SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY first_at) - 1 AS position FROM (
  SELECT o_custkey AS key, 'c' || o_orderkey % 6 AS name, min((o_orderkey % 2, o_orderkey)) AS first_at FROM orders GROUP BY ALL) a
""")
def _ordered_union(t):
    rows = t.read("orders").selectExpr(
        "o_custkey AS key", "concat(' c', o_orderkey % 6) AS name", "o_orderkey % 2 AS source", "o_orderkey AS pos"
    )
    return ds.ordered_union(rows, "key", "name", "source", "pos")
