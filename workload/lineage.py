"""Revisions, snapshots, manifests, predictions (survey groups B, F, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import cleanup as cl
from maskloom.operators import relations as rel
from maskloom.operators import revisions as rv
from maskloom.sinks import rasters
from workload.cleanup import components_sql
from workload.registry import query
from workload.scratch import scratch
from workload.tables import SIDE

HEADS = """
heads AS (SELECT dataset_id, image_id, arg_max(revision_id, (created_on, revision_id)) AS revision_id FROM revisions GROUP BY dataset_id, image_id)
"""


@query("head_revision", f"WITH {HEADS} SELECT * FROM heads", "revisions")
def _heads(t):
    return rv.head_revisions(t.revisions).select("dataset_id", "image_id", "revision_id")


@query("revision_lineage", """
WITH RECURSIVE c(revision_id, up, depth, root) AS (
  SELECT revision_id, parent_revision_id, 0, revision_id FROM revisions
  UNION ALL SELECT c.revision_id, r.parent_revision_id, c.depth + 1, r.revision_id FROM c JOIN revisions r ON r.revision_id = c.up)
SELECT revision_id, CAST(max(depth) AS BIGINT) AS depth, arg_max(root, depth) AS root_revision_id FROM c GROUP BY revision_id
""", "revisions")
def _lineage(t):
    return rv.lineage(t.revisions)


@query("revision_ancestors", """
WITH RECURSIVE c(revision_id, ancestor_id, distance) AS (
  SELECT revision_id, parent_revision_id, 1 FROM revisions WHERE parent_revision_id IS NOT NULL
  UNION ALL SELECT c.revision_id, r.parent_revision_id, c.distance + 1 FROM c JOIN revisions r ON r.revision_id = c.ancestor_id WHERE r.parent_revision_id IS NOT NULL)
SELECT * FROM c
""", "revisions")
def _ancestors(t):
    t.revisions.createOrReplaceTempView("maskloom_revisions")
    t.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return rv.lineage_paths(t.spark, "maskloom_revisions")


@query("revision_fork", f"""
WITH {HEADS}, k AS (SELECT image_id, revision_id + 1000000 AS revision_id, revision_id AS parent_revision_id FROM heads)
SELECT k.revision_id, k.parent_revision_id, count(*) AS pixels, sum(p.pred_raw)::BIGINT AS label_sum FROM k JOIN px p ON p.image_id = k.image_id GROUP BY ALL
""", "revisions px")
def _fork(t):
    heads = rv.head_revisions(t.revisions)
    px = rv.promote_rasters(t.px, "pred_raw").join(heads.select("image_id", "revision_id"), "image_id")
    children, copied = rv.fork(heads, px, F.col("revision_id") + 1000000)
    sums = copied.groupBy("revision_id").agg(F.count("*").alias("pixels"), F.sum("label").alias("label_sum"))
    return children.join(sums, "revision_id").select("revision_id", "parent_revision_id", "pixels", "label_sum")


@query("revision_create", """
SELECT r.revision_id, 1024::BIGINT AS pixels, 0::BIGINT AS label_sum FROM revisions r JOIN images i ON i.image_id = r.image_id WHERE r.parent_revision_id IS NULL OR r.is_locked
""", "revisions images")
def _create(t):
    fresh = t.revisions.where("parent_revision_id IS NULL OR is_locked").select("revision_id", "image_id")
    made = rv.empty_revisions(fresh, t.images)
    return made.groupBy("revision_id").agg(F.count("*").alias("pixels"), F.sum("label").alias("label_sum"))


def line_hash(value: str) -> str:
    return f"""(SELECT image_id, sha256(string_agg(h, '' ORDER BY "row")) AS h FROM (SELECT image_id, "row", sha256(string_agg({value}, ',' ORDER BY col)) AS h FROM px GROUP BY ALL) l GROUP BY image_id)"""


@query("revision_save_verify", f"""
SELECT a.image_id AS revision_id, a.h AS label_checksum, sha256(a.h || b.h || c.h) AS revision_checksum
FROM {line_hash('pred_raw')} a JOIN {line_hash('CASE WHEN pred_raw > 0 THEN 2 ELSE 0 END')} b ON b.image_id = a.image_id
JOIN {line_hash('CASE WHEN pred_raw > 0 THEN 1 ELSE 0 END')} c ON c.image_id = a.image_id
""", "px")
def _verify(t):
    px = rv.promote_rasters(t.px, "pred_raw").withColumn("revision_id", F.col("image_id"))
    return rv.raster_checksums(px).select("revision_id", "label_checksum", "revision_checksum")


@query("revision_save_problems", """
SELECT r.revision_id, CASE WHEN r.is_locked THEN 'locked revision' ELSE 'wrong size' END AS problem
FROM revisions r JOIN images i ON i.image_id = r.revision_id WHERE r.is_locked OR r.revision_id % 4 = 0
""", "revisions images")
def _problems(t):
    known = t.revisions.withColumns({
        "height": F.expr(f"IF(revision_id % 4 = 0, 16, {SIDE})"), "width": F.lit(SIDE),
    })
    return rv.save_problems(t.px.withColumn("revision_id", F.col("image_id")), known)


MEMBERS = "members AS (SELECT DISTINCT dataset_id, image_id FROM revisions UNION SELECT dataset_id, revision_id FROM revisions WHERE revision_id % 2500 = 7)"


def _members(t):
    base = t.revisions.select("dataset_id", "image_id")
    return base.unionByName(t.revisions.where("revision_id % 2500 = 7").select("dataset_id", F.col("revision_id").alias("image_id"))).distinct()


@query("snapshot_register", f"""
WITH {HEADS}, {MEMBERS},
bad AS (SELECT DISTINCT m.dataset_id FROM members m LEFT JOIN heads h ON h.dataset_id = m.dataset_id AND h.image_id = m.image_id WHERE h.image_id IS NULL),
it AS (SELECT * FROM heads WHERE dataset_id NOT IN (SELECT dataset_id FROM bad))
SELECT d.dataset_id, d.name || ' snapshot' AS name, count(*) AS image_count, sum((r.is_locked)::INT)::BIGINT AS locked_before FROM it
JOIN datasets d ON d.dataset_id = it.dataset_id JOIN revisions r ON r.revision_id = it.revision_id GROUP BY ALL
""", "revisions datasets")
def _snapshot(t):
    heads = rv.head_revisions(t.revisions).select("dataset_id", "image_id", "revision_id")
    snapshots, items = rv.register_snapshots(heads, _members(t), t.datasets)
    before = items.join(t.revisions.select("revision_id", "is_locked"), "revision_id").groupBy("dataset_id").agg(F.count_if("is_locked").alias("locked_before"))
    return snapshots.join(before, "dataset_id")


@query("snapshot_lock", f"""
WITH {HEADS} SELECT revision_id, is_locked OR revision_id IN (SELECT revision_id FROM heads) AS is_locked FROM revisions
""", "revisions")
def _lock(t):
    return rv.lock_revisions(t.revisions, rv.head_revisions(t.revisions)).select("revision_id", "is_locked")


def manifest_sql(extra: str) -> str:
    return f"""
WITH {HEADS} SELECT h.dataset_id, h.image_id, '{{"image_id":' || h.image_id || ',"source_path":"' || i.file_name || '","width":32,"height":32,"annotation_revision_id":' || h.revision_id
  || ',"revision_checksum":"' || r.checksum || '"{extra}}}' AS item FROM heads h JOIN images i ON i.image_id = h.image_id JOIN revisions r ON r.revision_id = h.revision_id
"""


def _items(t):
    return rv.head_revisions(t.revisions).select("dataset_id", "image_id", "revision_id")


@query("canonical_manifest", manifest_sql(""), "revisions images")
def _manifest(t):
    return rv.manifest_items(_items(t), t.images, t.revisions)


@query("training_manifest", manifest_sql(',"builder_id":"image-mask.dataset","task_type":"semantic_segmentation","input_contract":"image-mask-pairs","tile_mode":"tiles"'), "revisions images")
def _training(t):
    return rv.training_manifest("image-mask.dataset", _items(t), t.images, t.revisions, {"tile_mode": "tiles"})


@query("manifest_headers", f"""
WITH {HEADS} SELECT h.dataset_id, 'canonical_semantic_dataset' AS builder_id, count(*) AS item_count FROM heads h JOIN images i ON i.image_id = h.image_id GROUP BY h.dataset_id
""", "revisions images")
def _headers(t):
    items = rv.manifest_items(_items(t), t.images, t.revisions)
    return rv.manifest_headers(items, "canonical_semantic_dataset").drop("items_checksum")


@query("dataset_builder", f"""
WITH {HEADS} SELECT h.dataset_id, b.builder_id, count(*) AS item_count FROM heads h JOIN images i ON i.image_id = h.image_id
CROSS JOIN (VALUES ('classical.dataset'), ('image-mask.dataset')) b(builder_id) GROUP BY ALL
""", "revisions images")
def _builders(t):
    frames = [
        rv.manifest_headers(rv.training_manifest(name, _items(t), t.images, t.revisions), name)
        for name in ("classical.dataset", "image-mask.dataset")
    ]
    return frames[0].unionByName(frames[1]).drop("items_checksum")


@query("snapshot_builder", f"""
WITH {HEADS} SELECT h.dataset_id, h.image_id, b.builder_id, CASE b.builder_id WHEN 'raster_mask_export' THEN '{{"image_id":' || h.image_id || ',"mask_checksum":"' || x.h || '","largest_class":' || m.top || '}}'
  ELSE '{{"image_id":' || h.image_id || ',"source_path":"' || i.file_name || '","width":32,"height":32,"annotation_revision_id":' || h.revision_id || ',"revision_checksum":"' || r.checksum || '"}}' END AS item
FROM heads h JOIN images i ON i.image_id = h.image_id JOIN revisions r ON r.revision_id = h.revision_id JOIN (SELECT image_id, max(pred_refined) AS top FROM px GROUP BY image_id) m ON m.image_id = h.image_id
JOIN {line_hash('pred_refined')} x ON x.image_id = h.image_id CROSS JOIN (VALUES ('canonical_semantic_dataset'), ('raster_mask_export')) b(builder_id)
""", "revisions images px")
def _snapshot_builders(t):
    px = t.px.select("image_id", "row", "col", F.col("pred_refined").alias("label"))
    frames = [
        rv.build_snapshot(name, _items(t), t.images, t.revisions, px).withColumn("builder_id", F.lit(name)) for name in rv.SNAPSHOT_BUILDERS
    ]
    return frames[0].unionByName(frames[1])


@query("raster_export_manifest", f"""
SELECT a.image_id, a.h AS mask_checksum, m.top AS largest_class FROM {line_hash('pred_refined')} a
JOIN (SELECT image_id, max(pred_refined) AS top FROM px GROUP BY image_id) m ON m.image_id = a.image_id
""", "px")
def _raster(t):
    return rv.raster_export(t.px, "pred_refined")


@query("prediction_run_sink", """
SELECT image_id % 5 AS run_id, image_id, count(*) AS pixels, sum(pred_raw)::BIGINT AS raw_sum, sum(pred_refined)::BIGINT AS refined_sum FROM px GROUP BY ALL
""", "px")
def _sink(t):
    path = scratch(t.spark, "predictions")
    rasters.write_predictions(t.px.withColumn("run_id", F.expr("image_id % 5")), path)
    back = t.spark.read.schema("image_id bigint, row int, col int, class_id int, run_id bigint, variant string").parquet(path)
    return back.groupBy("run_id", "image_id").agg(
        F.count_if(F.col("variant") == "raw").alias("pixels"),
        F.sum(F.when(F.col("variant") == "raw", F.col("class_id"))).alias("raw_sum"),
        F.sum(F.when(F.col("variant") == "refined", F.col("class_id"))).alias("refined_sum"),
    )


@query("prediction_export", f"""
SELECT a.image_id % 5 AS run_id, a.image_id, i.file_name, a.h AS mask_checksum FROM {line_hash('pred_refined')} a JOIN images i ON i.image_id = a.image_id
""", "px images")
def _export(t):
    from maskloom.plans.predictions import export_run

    path = scratch(t.spark, "export")
    rasters.write_predictions(t.px.withColumn("run_id", F.expr("image_id % 5")), path)
    return export_run(t.spark, path, "refined", t.images).select("run_id", "image_id", "file_name", "mask_checksum")


@query("promote_v2", """
SELECT image_id, "row", col, pred_refined AS label, CASE WHEN pred_refined > 0 THEN 2 ELSE 0 END AS provenance, CASE WHEN pred_refined > 0 THEN 1 ELSE 0 END AS protection FROM px
""", "px")
def _promote_v2(t):
    return rv.promote_rasters(t.px, "pred_refined")


@query("promote_predictions", f"""
WITH RECURSIVE th AS MATERIALIZED (SELECT image_id, "row" AS r, col AS c, CASE WHEN image_id % 6 <> 0 AND conf_u8 < 76 THEN 0 ELSE pred_refined END AS v FROM px),
{components_sql('SELECT * FROM th WHERE v > 0', 'bc')},
bs AS (SELECT image_id, lbl FROM bc GROUP BY image_id, lbl HAVING count(*) < 5)
SELECT th.image_id, th.v AS class_id, count(*) AS pixels FROM th LEFT JOIN bc ON bc.image_id = th.image_id AND bc.a = th.r * 32 + th.c
LEFT JOIN bs ON bs.image_id = bc.image_id AND bs.lbl = bc.lbl WHERE th.v > 0 AND bs.lbl IS NULL GROUP BY ALL
""", "px")
def _promote(t):
    from maskloom.plans.predictions import promote

    px = t.px.withColumn("conf", F.when(F.col("image_id") % 6 != 0, F.col("conf_u8")))
    masks, _ = promote(px, "pred_refined", "conf", percent=30, min_blob_px=5)
    return masks.groupBy("image_id", "class_id").agg(F.sum("col_len").alias("pixels"))


@query("dataset_register", """
SELECT source_draft_id AS draft_id, 1 + count(*) AS next_version FROM datasets WHERE source_draft_id IS NOT NULL GROUP BY ALL
""", "datasets")
def _register(t):
    return t.datasets.where("source_draft_id IS NOT NULL").groupBy(F.col("source_draft_id").alias("draft_id")).agg(
        (F.count("*") + 1).alias("next_version")
    )
