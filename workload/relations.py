"""Registry joins and segment selections (survey groups D and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import relations as rel
from maskloom.operators.statistics import region_centroids
from workload.registry import query
from workload.tables import SIDE


@query("models_with_dataset", """
SELECT m.model_id, d.name AS dataset_name, greatest(m.class_entries - 1, 0) AS classes_count
FROM models m JOIN datasets d ON d.dataset_id = m.dataset_id
""", "models datasets")
def _models(t):
    return rel.models_with_dataset(t.models, t.datasets).select("model_id", "dataset_name", "classes_count")


@query("runs_with_model", """
SELECT r.run_id, m.name AS model_name, r.status FROM runs r JOIN models m ON m.model_id = r.model_id
""", "runs models")
def _runs(t):
    return rel.runs_with_model(t.runs, t.models).select("run_id", "model_name", "status")


@query("projects_with_dataset", """
SELECT p.draft_id, coalesce(d.name, '-') AS dataset_name FROM drafts p LEFT JOIN datasets d ON d.dataset_id = p.dataset_id
""", "drafts datasets")
def _projects(t):
    return rel.projects_with_dataset(t.drafts, t.datasets).select("draft_id", F.coalesce("dataset_name", F.lit("-")).alias("dataset_name"))


@query("dataset_images", """
SELECT a.dataset_id, a.image_id, i.file_name FROM (SELECT DISTINCT l_partkey % 50 AS dataset_id, l_suppkey AS image_id FROM lineitem) a
JOIN images i ON i.image_id = a.image_id
""", "images")
def _dataset_images(t):
    items = t.read("lineitem").selectExpr("l_partkey % 50 AS dataset_id", "l_suppkey AS image_id").distinct()
    return items.join(t.images, "image_id").select("dataset_id", "image_id", "file_name")


ITEMS = "SELECT DISTINCT o_custkey % 10 AS snapshot_id, o_orderkey AS revision_id, o_custkey AS image_id FROM orders"


@query("snapshot_items_join", f"""
SELECT s.snapshot_id, s.image_id, i.file_name, r.checksum AS revision_checksum FROM ({ITEMS}) s
JOIN images i ON i.image_id = s.image_id JOIN revisions r ON r.revision_id = s.revision_id
""", "images revisions")
def _snapshot_items(t):
    items = t.revisions.selectExpr("dataset_id AS snapshot_id", "revision_id", "image_id").distinct()
    return rel.snapshot_items(items, t.images, t.revisions).select(
        "snapshot_id", "image_id", "file_name", "revision_checksum"
    )


@query("available_images", """
SELECT doc_id, file_name FROM library l WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = l.doc_id)
""", "library")
def _available(t):
    return rel.available_images(t.library, t.read("labels"), "doc_id").select("doc_id", "file_name")


def _flags(t):
    stems = t.read("labels").selectExpr("concat('doc_', doc_id) AS image_stem")
    return rel.labeled_flags(t.library, stems)


@query("labeled_images", """
SELECT l.doc_id, b.doc_id IS NOT NULL AS is_labeled FROM library l
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) b ON b.doc_id = l.doc_id AND l.doc_id % 5 <> 0
""", "library")
def _labeled(t):
    return _flags(t).select("doc_id", "is_labeled")


@query("labeled_summary", """
SELECT l.lang, sum((b.doc_id IS NOT NULL)::INT)::BIGINT AS labeled, sum((b.doc_id IS NULL)::INT)::BIGINT AS unlabeled,
       coalesce(min(CASE WHEN b.doc_id IS NULL THEN file_name END), '-') AS next_unlabeled
FROM library l LEFT JOIN (SELECT DISTINCT doc_id FROM labels) b ON b.doc_id = l.doc_id AND l.doc_id % 5 <> 0 GROUP BY l.lang
""", "library")
def _labeled_summary(t):
    return rel.labeled_summary(_flags(t), ["lang"]).fillna("-", subset=["next_unlabeled"])


@query("registration_history", """
SELECT source_draft_id AS draft_id, dataset_id, row_number() OVER (PARTITION BY source_draft_id ORDER BY created_on DESC, dataset_id DESC) AS position
FROM datasets WHERE source_draft_id IS NOT NULL
""", "datasets")
def _history(t):
    return rel.registrations(t.datasets).select("draft_id", "dataset_id", "position")


LINKED = """
SELECT p.draft_id, coalesce(d.dataset_id, n.dataset_id) AS linked_dataset_id FROM drafts p
LEFT JOIN datasets d ON d.dataset_id = p.dataset_id
LEFT JOIN (SELECT source_draft_id, arg_max(dataset_id, (created_on, dataset_id)) AS dataset_id FROM datasets
           WHERE source_draft_id IS NOT NULL GROUP BY ALL) n ON n.source_draft_id = p.draft_id
"""


@query("linked_dataset", f"SELECT draft_id, coalesce(linked_dataset_id, -1) AS linked_dataset_id FROM ({LINKED}) x", "drafts datasets")
def _linked(t):
    return rel.linked_dataset(t.drafts, t.datasets).fillna(-1)


@query("related_models", f"""
SELECT p.draft_id, m.model_id FROM (
  SELECT source_draft_id AS draft_id, dataset_id FROM datasets WHERE source_draft_id IN (SELECT draft_id FROM drafts)
  UNION SELECT draft_id, linked_dataset_id FROM ({LINKED}) x WHERE linked_dataset_id IS NOT NULL) p
JOIN models m ON m.dataset_id = p.dataset_id
""", "drafts datasets models")
def _related(t):
    return rel.related_models(t.drafts, t.datasets, t.models).select("draft_id", "model_id")


@query("draft_origin", """
SELECT d.draft_id, CASE d.origin_type WHEN 'branched_from_draft' THEN
  CASE WHEN d.origin_draft_id IS NULL THEN 'Branched from draft' WHEN p.name IS NULL THEN 'Branched from draft #' || d.origin_draft_id
       ELSE 'Branched from ' || p.name END || ' v' || coalesce(d.origin_version::VARCHAR, '?')
  WHEN 'augmented_from_registered' THEN
  CASE WHEN d.origin_dataset_id IS NULL THEN 'Augmented from registered dataset'
       WHEN s.name IS NULL THEN 'Augmented from registered #' || d.origin_dataset_id ELSE 'Augmented from ' || s.name END
  ELSE 'Manual draft' END AS origin
FROM drafts d LEFT JOIN drafts p ON p.draft_id = d.origin_draft_id LEFT JOIN datasets s ON s.dataset_id = d.origin_dataset_id
""", "drafts datasets")
def _origin(t):
    return rel.draft_origin(t.drafts, t.datasets)


@query("job_target", """
SELECT j.job_id, CASE WHEN entity_id <= 0 THEN '-' WHEN entity_type = 'model' THEN coalesce(m.name, 'Model #' || entity_id)
  WHEN entity_type = 'analysis_run' THEN 'Run #' || entity_id || coalesce(' (' || rm.name || ')', '')
  WHEN entity_type = 'dataset' THEN coalesce(d.name, 'Dataset #' || entity_id) ELSE '-' END AS target
FROM jobs j LEFT JOIN models m ON m.model_id = j.entity_id LEFT JOIN runs r ON r.run_id = j.entity_id
LEFT JOIN models rm ON rm.model_id = r.model_id LEFT JOIN drafts d ON d.draft_id = j.entity_id
""", "jobs models runs drafts")
def _target(t):
    return rel.job_target(t.jobs, t.models, t.runs, t.drafts)


@query("membership_check", """
SELECT DISTINCT user_id AS image_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
""")
def _members(t):
    wanted = t.read("events").selectExpr("user_id AS image_id").distinct()
    return rel.not_members(wanted, t.images, ["image_id"])


@query("submitted_image_match", """
SELECT r.requested, coalesce(c.file_name, '-') AS canonical FROM (
  SELECT lower(nm) AS k, arg_min(nm, pos) AS requested FROM (
    SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'IMG_' || user_id || '.png' ELSE 'img_' || user_id || '.PNG' END AS nm FROM events) e
  GROUP BY lower(nm)) r LEFT JOIN images c ON lower(c.file_name) = r.k
""", "images")
def _match(t):
    asked = t.read("events").selectExpr(
        "event_id AS pos",
        "concat('up/', IF(event_id % 2 = 0, concat('IMG_', user_id, '.png'), concat('img_', user_id, '.PNG'))) AS file_name",
    )
    return rel.match_names(asked, t.images).fillna("-", subset=["canonical"])


@query("snapshot_completeness", """
SELECT coalesce(m.dataset_id, h.dataset_id) AS dataset_id, coalesce(m.image_id, h.image_id) AS image_id,
       CASE WHEN h.image_id IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM (SELECT DISTINCT l_partkey % 10 AS dataset_id, l_suppkey AS image_id FROM lineitem) m
FULL JOIN (SELECT DISTINCT dataset_id, image_id FROM revisions) h ON h.dataset_id = m.dataset_id AND h.image_id = m.image_id
WHERE m.image_id IS NULL OR h.image_id IS NULL
""", "revisions")
def _complete(t):
    members = t.read("lineitem").selectExpr("l_partkey % 10 AS dataset_id", "l_suppkey AS image_id")
    return rel.completeness(t.revisions, members, ["dataset_id", "image_id"])


@query("image_references", """
WITH l AS (SELECT DISTINCT run_id, input_image FROM run_items WHERE input_image <> '')
SELECT DISTINCT input_image, CASE WHEN r.status IN ('queued', 'running') THEN 'active_run' ELSE 'completed_run' END AS kind, l.run_id AS ref_id
FROM l JOIN runs r ON r.run_id = l.run_id
UNION SELECT input_image, 'active_job', j.job_id FROM l JOIN jobs j ON j.entity_id = l.run_id
WHERE j.job_type = 'analysis' AND j.status IN ('queued', 'running')
""", "run_items runs jobs")
def _references(t):
    return rel.image_references(t.run_items, t.runs, t.jobs)


RECTS_SQL = """
SELECT o_orderkey AS rect_id, o_custkey AS image_id, greatest(least(x1, x2), 0) AS xa, least(greatest(x1, x2), 31) AS xb,
       greatest(least(y1, y2), 0) AS ya, least(greatest(y1, y2), 31) AS yb
FROM (SELECT o_orderkey, o_custkey, o_orderkey * 7 % 45 - 5 AS x1, o_orderkey * 5 % 41 - 4 AS x2,
             o_orderkey * 3 % 43 - 6 AS y1, o_orderkey * 11 % 39 - 3 AS y2 FROM orders) o
"""


def _rects(t):
    raw = t.read("orders").selectExpr(
        "o_orderkey AS rect_id", "o_custkey AS image_id", "o_orderkey * 7 % 45 - 5 AS x1", "o_orderkey * 5 % 41 - 4 AS x2",
        "o_orderkey * 3 % 43 - 6 AS y1", "o_orderkey * 11 % 39 - 3 AS y2",
    )
    return rel.clip_rectangles(raw, SIDE, SIDE)


@query("marquee_intersects", f"""
SELECT DISTINCT r.rect_id, r.image_id, p.seg_id FROM ({RECTS_SQL}) r
JOIN px p ON p.image_id = r.image_id AND p.col BETWEEN r.xa AND r.xb AND p."row" BETWEEN r.ya AND r.yb
""", "px")
def _intersects(t):
    return rel.marquee_intersects(_rects(t), t.px)


@query("marquee_centroid", f"""
SELECT r.rect_id, r.image_id, c.seg_id FROM ({RECTS_SQL}) r
JOIN (SELECT image_id, seg_id, avg(col) AS x, avg("row") AS y FROM px GROUP BY ALL) c ON c.image_id = r.image_id
WHERE c.x BETWEEN r.xa AND r.xb AND c.y BETWEEN r.ya AND r.yb AND r.xa <= r.xb AND r.ya <= r.yb
""", "px")
def _centroid(t):
    return rel.marquee_centroid(_rects(t), region_centroids(t.px))


STROKE = """
WITH p AS (SELECT user_id || '/' || event_id // 1000 AS stroke_id, user_id AS image_id, event_id AS seq,
  greatest(least(event_id * 7 % 40 - 4, 31), 0) AS x, greatest(least(event_id * 11 % 40 - 4, 31), 0) AS y FROM events),
l AS (SELECT *, coalesce(lag(x) OVER w, x) AS px_, coalesce(lag(y) OVER w, y) AS py_ FROM p WINDOW w AS (PARTITION BY stroke_id ORDER BY seq)),
n AS (SELECT *, greatest(abs(x - px_), abs(y - py_)) AS n FROM l),
s AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n),
c AS (SELECT DISTINCT stroke_id, image_id,
  CAST(greatest(least(round_even(py_ + (y - py_) * (CASE WHEN n > 0 THEN i / n::DOUBLE ELSE 0 END), 0), 31), 0) AS INTEGER) AS r,
  CAST(greatest(least(round_even(px_ + (x - px_) * (CASE WHEN n > 0 THEN i / n::DOUBLE ELSE 0 END), 0), 31), 0) AS INTEGER) AS k FROM s)
SELECT DISTINCT c.stroke_id, c.image_id, q.seg_id FROM c JOIN px q ON q.image_id = c.image_id AND q."row" = c.r AND q.col = c.k
"""


@query("brush_select", STROKE, "px")
def _brush(t):
    points = t.read("events").selectExpr(
        "concat(user_id, '/', event_id DIV 1000) AS stroke_id", "user_id AS image_id", "event_id AS seq",
        "event_id * 7 % 40 - 4 AS x", "event_id * 11 % 40 - 4 AS y",
    )
    cells = rel.brush_pixels(points, SIDE, SIDE)
    return rel.touched_segments(cells, t.px, ["stroke_id", "image_id"])


@query("roi_candidates", """
SELECT DISTINCT p.image_id, p.seg_id FROM px p JOIN ann_px a ON a.image_id = p.image_id AND a."row" = p."row" AND a.col = p.col
""", "px ann_px")
def _roi(t):
    from maskloom.operators.line_runs import union_runs
    from maskloom.operators.masks import polygon_runs, runs_to_pixels

    sized = t.polygons.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    cells = runs_to_pixels(union_runs(polygon_runs(sized, ["ann_id", "image_id"]), ["image_id"]))
    return rel.touched_segments(cells, t.px, ["image_id"])


@query("v2_run_rows", """
SELECT r.run_id, s.dataset_id, d.name AS dataset_name, coalesce(m.name, '-') AS model_name
FROM (SELECT run_id, model_id, run_id % 977 AS snapshot_id FROM runs) r
JOIN (SELECT DISTINCT o_orderkey % 977 AS snapshot_id, o_orderkey % 977 % 130 AS dataset_id FROM orders) s ON s.snapshot_id = r.snapshot_id
JOIN datasets d ON d.dataset_id = s.dataset_id LEFT JOIN models m ON m.model_id = r.model_id
""", "runs datasets models")
def _run_rows(t):
    runs = t.runs.withColumn("snapshot_id", F.expr("run_id % 977"))
    snaps = t.read("orders").selectExpr("o_orderkey % 977 AS snapshot_id", "o_orderkey % 977 % 130 AS dataset_id").distinct()
    return rel.run_rows(t.datasets, snaps, runs, t.models).select(
        "run_id", "dataset_id", "dataset_name", F.coalesce("model_name", F.lit("-")).alias("model_name")
    )


PICKED = """
SELECT run_id, item_id, image_id, regexp_extract(input_image, '([^/]*)$', 1) AS input_name,
       coalesce(refined_path, mask_path, raw_path) AS source_mask,
       CASE WHEN refined_path IS NOT NULL THEN 'Refined' ELSE 'Raw' END AS source_label, conf_path IS NOT NULL AS has_conf
FROM run_items WHERE input_image <> '' AND coalesce(refined_path, mask_path, raw_path) IS NOT NULL
"""


@query("promote_source_pick", PICKED, "run_items")
def _picked(t):
    return rel.promote_source(t.run_items)


@query("provenance_rows", f"""
SELECT p.item_id AS source_item_id, p.run_id AS source_run_id, m.model_id AS source_model_id, m.name AS model_name,
       p.source_mask, p.source_label, p.has_conf, 'img_' || image_id || '__label.png' AS label_file
FROM ({PICKED}) p JOIN runs r ON r.run_id = p.run_id JOIN models m ON m.model_id = r.model_id
""", "run_items runs models")
def _provenance(t):
    return rel.provenance_rows(rel.promote_source(t.run_items), t.runs, t.models)
