"""Segmentation-shaped views derived from the given tables, once for Spark and once as SQL text.

Every view is integer arithmetic over a given table, so both engines build equal rows and every
view grows with its table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32
CLASSES = [(0, "background"), (1, "road"), (2, "roof"), (3, "tree")]
CLASS_IDS = [c for c, _ in CLASSES]
# Rows of one task before they fan out, so that a task's share of what they fan out to stays the same as tables grow.
IMAGES_A_TASK, ANNOTATIONS_A_TASK = 256, 50_000

# --- SQL text of every view -------------------------------------------------------------------

VIEWS: dict[str, str] = {}

VIEWS["classes"] = "SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({c} AS INTEGER), '{n}')" for c, n in CLASSES
) + ") AS v(class_id, name)"

VIEWS["px"] = """
SELECT image_id, "row", col, r, g, b, gray, true_class, pred_raw,
       CASE WHEN pred_raw <> true_class AND ("row" + col) % 2 = 0 THEN true_class ELSE pred_raw END AS pred_refined,
       CAST((gray * 3 + "row") % 256 AS INTEGER) AS conf_u8,
       CAST(("row" // 4) * 8 + (col // 4) AS INTEGER) AS seg_id
FROM (SELECT *, CASE WHEN (image_id + "row" * 3 + col * 5) % 11 = 0 THEN (true_class + 1) % 4 ELSE true_class END AS pred_raw
      FROM (SELECT s_suppkey AS image_id, "row", col,
                   CAST((s_suppkey * 11 + "row" * 5 + col * 3) % 256 AS INTEGER) AS r,
                   CAST((s_suppkey * 3 + "row" * 23 + col * 7) % 256 AS INTEGER) AS g,
                   CAST((s_suppkey * 5 + "row" * 9 + col * 37) % 256 AS INTEGER) AS b,
                   CAST((s_suppkey * 7 + "row" * 13 + col * 19 + "row" * col) % 256 AS INTEGER) AS gray,
                   CAST((s_suppkey * 31 + ("row" // 8) * 17 + (col // 8) * 29) % 4 AS INTEGER) AS true_class
            FROM (SELECT s_suppkey, "row", CAST(unnest(range(32)) AS INTEGER) AS col
                  FROM (SELECT s_suppkey, CAST(unnest(range(32)) AS INTEGER) AS "row" FROM supplier) y) x) a) b
"""

VIEWS["images"] = """
SELECT s_suppkey AS image_id,
       CASE WHEN s_suppkey % 7 = 0 THEN 'IMG_' || s_suppkey || '.PNG' ELSE 'img_' || s_suppkey || '.png' END AS file_name,
       CAST(32 AS INTEGER) AS width, CAST(32 AS INTEGER) AS height, md5('img' || s_suppkey) AS checksum,
       s_nationkey % 5 AS workspace_id
FROM supplier
"""

VIEWS["ann"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS ann_id,
       l_suppkey AS image_id, CAST(1 + l_linenumber % 3 AS INTEGER) AS category_id,
       l_orderkey * 8 + l_linenumber AS order_idx,
       CAST(l_partkey % 24 AS INTEGER) AS x0, CAST(l_orderkey % 24 AS INTEGER) AS y0,
       CAST(2 + l_partkey % 7 AS INTEGER) AS w, CAST(2 + l_orderkey % 6 AS INTEGER) AS h,
       CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE CAST((2 + l_partkey % 7) * (2 + l_orderkey % 6) AS DOUBLE) END AS area
FROM lineitem
"""

VIEWS["ann_px"] = """
SELECT ann_id, image_id, category_id, order_idx, area, w, h, "row", x0 + unnest(range(w)) AS col
FROM (SELECT *, y0 + unnest(range(h)) AS "row" FROM ann) r
"""

VIEWS["masks"] = """
SELECT image_id, class_id, frozen, legacy,
       'img_' || image_id || CASE WHEN legacy THEN '__' || name || '.png'
            WHEN frozen THEN '__cid_' || class_id || '__frozen.png'
            ELSE '__cid_' || class_id || '.png' END AS path
FROM (SELECT image_id, k.class_id, k.name, f.frozen, f.legacy
      FROM (SELECT DISTINCT image_id, category_id FROM ann) a
      JOIN classes k ON k.class_id = a.category_id
      JOIN (VALUES (false, false), (true, false), (false, true)) AS f(frozen, legacy)
        ON CASE WHEN f.frozen THEN (a.image_id + a.category_id) % 4 = 0
                WHEN f.legacy THEN (a.image_id + a.category_id) % 3 = 0
                ELSE (a.image_id + a.category_id) % 3 <> 1 END) m
"""

VIEWS["edits"] = """
SELECT event_id AS seq, user_id AS image_id, CAST((event_id // 7) % 16 AS INTEGER) AS sp_id,
       CAST(1 + event_id % 3 AS INTEGER) AS class_id,
       CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'add' END AS mode
FROM events
"""

VIEWS["clicks"] = "SELECT * FROM edits WHERE mode IN ('add', 'remove')"

VIEWS["seg_feat"] = """
SELECT vec_id AS seg_id, label,
       list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE) * 100) AS lab,
       list_transform(embedding[4:13], lambda x: abs(CAST(x AS DOUBLE))
            / list_sum(list_transform(embedding[4:13], lambda y: abs(CAST(y AS DOUBLE))))) AS hist
FROM embeddings
"""

VIEWS["jobs"] = """
SELECT o_orderkey AS job_id, o_custkey % 10 AS workspace_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'training' WHEN '2-HIGH' THEN 'analysis'
            WHEN '3-MEDIUM' THEN 'slic_warmup' ELSE 'export' END AS job_type,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
       'key-' || (o_custkey // 4) AS dedupe_key,
       CAST((o_orderkey % 50) * 10 AS INTEGER) AS priority,
       CAST(o_orderdate AS DATE) AS created_on,
       CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'analysis_run' WHEN 2 THEN 'dataset' ELSE '' END AS entity_type,
       o_custkey * 2 AS entity_id, o_totalprice AS cost
FROM orders
"""

VIEWS["job_events"] = """
SELECT event_id, ts, user_id AS job_id, event_type AS kind,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value,
       CASE event_type WHEN 'click' THEN 'Analyzing image ' || json_extract_string(props, '$.k') || '/80'
            WHEN 'view' THEN 'Sampling image ' || json_extract_string(props, '$.k') || '/80'
            WHEN 'purchase' THEN 'Loading COCO annotations' WHEN 'signup' THEN 'Running validation'
            ELSE 'worker note' END AS message,
       CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed'
            WHEN 'signup' THEN 'queued' ELSE 'failed' END AS status
FROM events
"""

VIEWS["revisions"] = """
SELECT o_orderkey AS revision_id, o_custkey % 10 AS dataset_id, o_custkey AS image_id,
       CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 2 END AS parent_revision_id,
       CAST(o_orderdate AS DATE) AS created_on, md5('rev' || o_orderkey) AS checksum,
       o_orderstatus = 'F' AS is_locked
FROM orders
"""

VIEWS["datasets"] = """
SELECT s_suppkey AS dataset_id, s_name AS name, s_nationkey % 5 AS workspace_id,
       CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 40 END AS source_draft_id,
       DATE '2024-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS created_on
FROM supplier
"""

VIEWS["drafts"] = """
SELECT c_custkey AS draft_id, c_name AS name, c_nationkey % 5 AS workspace_id,
       CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 150 END AS dataset_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'branched_from_draft' WHEN 'MACHINERY' THEN 'augmented_from_registered'
            ELSE 'manual' END AS origin_type,
       CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - 7 END AS origin_draft_id,
       CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 170 END AS origin_dataset_id,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(1 + c_custkey % 9 AS INTEGER) END AS origin_version,
       DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS created_on
FROM customer
"""

VIEWS["models"] = """
SELECT p_partkey AS model_id, p_name AS name, p_partkey % 120 AS dataset_id,
       CASE p_size % 4 WHEN 0 THEN 'trained' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'queued' END AS status,
       CAST(p_size % 6 AS INTEGER) AS class_entries,
       DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) AS created_on
FROM part
"""

VIEWS["runs"] = """
SELECT o_orderkey AS run_id, o_custkey * 2 AS model_id, o_custkey % 10 AS workspace_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
       CAST(o_orderdate AS DATE) AS created_on
FROM orders
"""

VIEWS["run_items"] = """
SELECT l_orderkey AS run_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS item_id,
       l_suppkey AS image_id,
       CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'uploads/img_' || l_suppkey || '.png' END AS input_image,
       CASE WHEN l_linenumber % 3 = 0 THEN 'refined/' || l_partkey || '.png' END AS refined_path,
       CASE WHEN l_linenumber % 2 = 0 THEN 'pred/' || l_partkey || '.png' END AS mask_path,
       CASE WHEN l_partkey % 4 = 0 THEN 'raw/' || l_partkey || '.png' END AS raw_path,
       CASE WHEN l_partkey % 5 <> 0 THEN 'conf/' || l_partkey || '.png' END AS conf_path
FROM lineitem
"""

VIEWS["library"] = """
SELECT doc_id, source, lang, n_chars,
       CASE WHEN doc_id % 5 = 0 THEN 'DOC_' || doc_id || '.JPG' ELSE 'doc_' || doc_id || '.jpg' END AS file_name
FROM documents
"""

# A view's own inputs, so that only what a query needs is put in front of it.
NEEDS = {"ann_px": ["ann"], "masks": ["ann", "classes"], "clicks": ["edits"]}


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named derived views (and what they read) as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    if body[:4].upper() == "WITH":
        rest = body[4:].strip()
        if rest[:9].upper() == "RECURSIVE":
            rest = rest[9:].strip()
        return f"WITH RECURSIVE {head},\n{rest}"
    return f"WITH {head}\n{body}"


class Tables:
    """The given tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, source: str, *columns: str) -> DataFrame:
        return self.read(source).selectExpr(*columns)

    def _dealt(self, rows: DataFrame, key: str, most: int) -> DataFrame:
        """Rows spread by key over as many tasks as they need, at about ``most`` rows each."""
        slots = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // most))
        return rows.repartition(slots, key)

    @cached_property
    def px(self) -> DataFrame:
        """One row per pixel.  Keys are spread before they fan out to 1,024 pixels each, and the
        fan-out keeps that partitioning, so image-keyed work downstream needs no further exchange.

        The fan-out is a join with the pixel numbers: Spark's size estimate follows a join but not an
        ``explode``, and an estimate of the bare keys would have all pixels broadcast through the driver."""
        keys = self._dealt(self._sql("supplier", "s_suppkey AS image_id"), "image_id", IMAGES_A_TASK)
        cells = self.spark.range(SIDE * SIDE).selectExpr(f"cast(id DIV {SIDE} AS int) AS row", f"cast(id % {SIDE} AS int) AS col")
        base = keys.crossJoin(F.broadcast(cells))
        return (
            base.selectExpr(
                "*",
                "cast((image_id*11 + row*5 + col*3) % 256 AS int) AS r",
                "cast((image_id*3 + row*23 + col*7) % 256 AS int) AS g",
                "cast((image_id*5 + row*9 + col*37) % 256 AS int) AS b",
                "cast((image_id*7 + row*13 + col*19 + row*col) % 256 AS int) AS gray",
                "cast((image_id*31 + (row DIV 8)*17 + (col DIV 8)*29) % 4 AS int) AS true_class",
            )
            .selectExpr(
                "*",
                "CASE WHEN (image_id + row*3 + col*5) % 11 = 0 THEN (true_class + 1) % 4 "
                "ELSE true_class END AS pred_raw",
            )
            .selectExpr(
                "*",
                "CASE WHEN pred_raw <> true_class AND (row + col) % 2 = 0 THEN true_class "
                "ELSE pred_raw END AS pred_refined",
                "cast((gray*3 + row) % 256 AS int) AS conf_u8",
                "cast((row DIV 4)*8 + (col DIV 4) AS int) AS seg_id",
            )
        )

    @cached_property
    def images(self) -> DataFrame:
        return self._sql(
            "supplier", "s_suppkey AS image_id",
            "CASE WHEN s_suppkey % 7 = 0 THEN concat('IMG_', s_suppkey, '.PNG') "
            "ELSE concat('img_', s_suppkey, '.png') END AS file_name",
            f"{SIDE} AS width", f"{SIDE} AS height", "md5(concat('img', s_suppkey)) AS checksum",
            "s_nationkey % 5 AS workspace_id",
        )

    @cached_property
    def classes(self) -> DataFrame:
        return self.spark.createDataFrame(CLASSES, "class_id int, name string")

    @cached_property
    def ann(self) -> DataFrame:
        return self._sql(
            "lineitem",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS bigint)) AS ann_id",
            "l_suppkey AS image_id", "1 + l_linenumber % 3 AS category_id",
            "l_orderkey * 8 + l_linenumber AS order_idx",
            "cast(l_partkey % 24 AS int) AS x0", "cast(l_orderkey % 24 AS int) AS y0",
            "cast(2 + l_partkey % 7 AS int) AS w", "cast(2 + l_orderkey % 6 AS int) AS h",
            "CASE WHEN l_orderkey % 5 = 0 THEN 0.0D "
            "ELSE cast((2 + l_partkey % 7) * (2 + l_orderkey % 6) AS double) END AS area",
        )

    @cached_property
    def outlined(self) -> DataFrame:
        """Annotations with their outline as a flat x, y list, where they lie: for queries that shuffle them by other keys."""
        return self._outlined(self.ann)

    @cached_property
    def polygons(self) -> DataFrame:
        """Annotations with their outline, spread out before they fan out."""
        return self._outlined(self._dealt(self.ann, "ann_id", ANNOTATIONS_A_TASK))

    def _outlined(self, ann: DataFrame) -> DataFrame:
        return ann.withColumn(
            "polygon",
            F.expr(
                "cast(array(x0, y0, x0 + w, y0, x0 + w, y0 + h, x0, y0 + h) AS array<double>)"
            ),
        )

    @cached_property
    def counts(self) -> DataFrame:
        """Annotations as uncompressed column-major run counts, background first, spread likewise."""
        return self._dealt(self.ann, "ann_id", ANNOTATIONS_A_TASK).withColumn(
            "counts",
            F.expr(
                f"concat(array(x0*{SIDE} + y0, h), "
                f"flatten(array_repeat(array({SIDE} - h, h), w - 1)), "
                f"array({SIDE * SIDE} - x0*{SIDE} - y0 - (w - 1)*{SIDE} - h))"
            ),
        )

    @cached_property
    def masks(self) -> DataFrame:
        pairs = self.ann.select("image_id", "category_id").distinct()
        named = pairs.join(
            F.broadcast(self.classes), F.col("category_id") == F.col("class_id")
        ).select("image_id", "class_id", "name")
        kinds = named.withColumn(
            "kind",
            F.explode(F.expr(
                "filter(array("
                "IF((image_id + class_id) % 3 <> 1, 'base', NULL),"
                "IF((image_id + class_id) % 4 = 0, 'frozen', NULL),"
                "IF((image_id + class_id) % 3 = 0, 'legacy', NULL)), k -> k IS NOT NULL)"
            )),
        )
        return kinds.selectExpr(
            "image_id", "class_id", "kind = 'frozen' AS frozen", "kind = 'legacy' AS legacy",
            "concat('img_', image_id, CASE kind WHEN 'legacy' THEN concat('__', name, '.png') "
            "WHEN 'frozen' THEN concat('__cid_', class_id, '__frozen.png') "
            "ELSE concat('__cid_', class_id, '.png') END) AS path",
        )

    @cached_property
    def edits(self) -> DataFrame:
        return self._sql(
            "events", "event_id AS seq", "user_id AS image_id",
            "cast((event_id DIV 7) % 16 AS int) AS sp_id", "cast(1 + event_id % 3 AS int) AS class_id",
            "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'undo' "
            "WHEN 'view' THEN 'redo' ELSE 'add' END AS mode",
        )

    @cached_property
    def clicks(self) -> DataFrame:
        return self.edits.where("mode IN ('add', 'remove')")

    @cached_property
    def seg_feat(self) -> DataFrame:
        return (
            self.read("embeddings")
            .selectExpr(
                "vec_id AS seg_id", "label",
                "transform(slice(embedding, 1, 3), x -> cast(x AS double) * 100) AS lab",
                "transform(slice(embedding, 4, 10), x -> abs(cast(x AS double))) AS parts",
            )
            .selectExpr(
                "seg_id", "label", "lab",
                "transform(parts, x -> x / aggregate(parts, 0D, (a, y) -> a + y)) AS hist",
            )
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return self._sql(
            "orders", "o_orderkey AS job_id", "o_custkey % 10 AS workspace_id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'training' WHEN '2-HIGH' THEN 'analysis' "
            "WHEN '3-MEDIUM' THEN 'slic_warmup' ELSE 'export' END AS job_type",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status",
            "concat('key-', o_custkey DIV 4) AS dedupe_key",
            "cast((o_orderkey % 50) * 10 AS int) AS priority", "cast(o_orderdate AS date) AS created_on",
            "CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'analysis_run' WHEN 2 THEN 'dataset' "
            "ELSE '' END AS entity_type",
            "o_custkey * 2 AS entity_id", "o_totalprice AS cost",
        )

    def shape_job_events(self, events: DataFrame) -> DataFrame:
        """Job log rows from event rows; works on a batch frame and on a stream."""
        k = "get_json_object(props, '$.k')"
        return events.selectExpr(
            "event_id", "cast(ts AS timestamp) AS ts", "user_id AS job_id", "event_type AS kind",
            f"cast({k} AS int) AS k", "value",
            f"CASE event_type WHEN 'click' THEN concat('Analyzing image ', {k}, '/80') "
            f"WHEN 'view' THEN concat('Sampling image ', {k}, '/80') "
            "WHEN 'purchase' THEN 'Loading COCO annotations' WHEN 'signup' THEN 'Running validation' "
            "ELSE 'worker note' END AS message",
            "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' "
            "WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'failed' END AS status",
        )

    @cached_property
    def job_events(self) -> DataFrame:
        return self.shape_job_events(self.read("events"))

    @cached_property
    def revisions(self) -> DataFrame:
        return self._sql(
            "orders", "o_orderkey AS revision_id", "o_custkey % 10 AS dataset_id", "o_custkey AS image_id",
            "CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) DIV 2 END AS parent_revision_id",
            "cast(o_orderdate AS date) AS created_on", "md5(concat('rev', o_orderkey)) AS checksum",
            "o_orderstatus = 'F' AS is_locked",
        )

    @cached_property
    def datasets(self) -> DataFrame:
        return self._sql(
            "supplier", "s_suppkey AS dataset_id", "s_name AS name", "s_nationkey % 5 AS workspace_id",
            "CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 40 END AS source_draft_id",
            "date_add(date'2024-01-01', cast(s_suppkey % 365 AS int)) AS created_on",
        )

    @cached_property
    def drafts(self) -> DataFrame:
        return self._sql(
            "customer", "c_custkey AS draft_id", "c_name AS name", "c_nationkey % 5 AS workspace_id",
            "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 150 END AS dataset_id",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'branched_from_draft' "
            "WHEN 'MACHINERY' THEN 'augmented_from_registered' ELSE 'manual' END AS origin_type",
            "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - 7 END AS origin_draft_id",
            "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 170 END AS origin_dataset_id",
            "CASE WHEN c_custkey % 3 <> 0 THEN cast(1 + c_custkey % 9 AS int) END AS origin_version",
            "date_add(date'2024-01-01', cast(c_custkey % 365 AS int)) AS created_on",
        )

    @cached_property
    def models(self) -> DataFrame:
        return self._sql(
            "part", "p_partkey AS model_id", "p_name AS name", "p_partkey % 120 AS dataset_id",
            "CASE p_size % 4 WHEN 0 THEN 'trained' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' "
            "ELSE 'queued' END AS status",
            "p_size % 6 AS class_entries",
            "date_add(date'2024-01-01', cast(p_partkey % 365 AS int)) AS created_on",
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self._sql(
            "orders", "o_orderkey AS run_id", "o_custkey * 2 AS model_id", "o_custkey % 10 AS workspace_id",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status",
            "cast(o_orderdate AS date) AS created_on",
        )

    @cached_property
    def run_items(self) -> DataFrame:
        return self._sql(
            "lineitem", "l_orderkey AS run_id",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS bigint)) AS item_id",
            "l_suppkey AS image_id",
            "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('uploads/img_', l_suppkey, '.png') END AS input_image",
            "CASE WHEN l_linenumber % 3 = 0 THEN concat('refined/', l_partkey, '.png') END AS refined_path",
            "CASE WHEN l_linenumber % 2 = 0 THEN concat('pred/', l_partkey, '.png') END AS mask_path",
            "CASE WHEN l_partkey % 4 = 0 THEN concat('raw/', l_partkey, '.png') END AS raw_path",
            "CASE WHEN l_partkey % 5 <> 0 THEN concat('conf/', l_partkey, '.png') END AS conf_path",
        )

    @cached_property
    def library(self) -> DataFrame:
        return self._sql(
            "documents", "doc_id", "source", "lang", "n_chars",
            "CASE WHEN doc_id % 5 = 0 THEN concat('DOC_', doc_id, '.JPG') "
            "ELSE concat('doc_', doc_id, '.jpg') END AS file_name",
        )
