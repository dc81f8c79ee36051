"""Edit log replay (survey group J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import edits as ed
from workload.registry import query

SELECTED = """
s AS (SELECT image_id, sp_id, class_id, arg_max(mode, seq) AS mode FROM clicks GROUP BY ALL),
o AS (SELECT image_id, sp_id, arg_max(class_id, seq) AS owner FROM clicks WHERE mode = 'add' GROUP BY ALL),
kept AS (SELECT s.image_id, s.sp_id, s.class_id FROM s JOIN o ON o.image_id = s.image_id AND o.sp_id = s.sp_id WHERE s.mode = 'add' AND o.owner = s.class_id)
"""


@query("edit_log_replay", f"""
WITH {SELECTED},
fz AS (SELECT p.image_id, pred_raw AS class_id, p."row", p.col FROM px p WHERE pred_raw > 0
  AND NOT EXISTS (SELECT 1 FROM clicks c WHERE c.image_id = p.image_id AND c.sp_id = p.seg_id AND (c.mode = 'add' OR c.class_id = p.pred_raw))),
u AS (SELECT k.image_id, k.class_id, p."row", p.col FROM kept k JOIN px p ON p.image_id = k.image_id AND p.seg_id = k.sp_id UNION SELECT * FROM fz)
SELECT image_id, class_id, count(*) AS pixels FROM u GROUP BY ALL
""", "clicks px")
def _replay(t):
    frozen = t.px.where("pred_raw > 0").select("image_id", F.col("pred_raw").alias("class_id"), "row", "col")
    left = ed.surviving_frozen(frozen, t.clicks, t.px)
    masks = ed.class_masks(ed.replay(t.clicks), t.px, left)
    return masks.groupBy("image_id", "class_id").agg(F.count("*").alias("pixels"))


@query("edit_selected", f"WITH {SELECTED} SELECT * FROM kept", "clicks")
def _selected(t):
    return ed.replay(t.clicks)


@query("edit_undo_redo")
def _undo(t):
    return ed.effective_edits(t.edits)


@query("edit_undo_redo_frozen")
def _undo_frozen(t):
    frozen = t.px.where("pred_raw > 0").select("image_id", F.col("seg_id").alias("sp_id"), F.col("pred_raw").alias("class_id"))
    return ed.effective_edits(t.edits, frozen)
