"""Small worked examples with known answers."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions import hashing, numbers, strings, times, vectors
from maskloom.operators import class_schema, cleanup, configs, edits, features, grids, listings, masks, similarity
from maskloom.operators import statistics as st
from maskloom.sinks import rasters
from maskloom.sources import masks as mask_source
from maskloom.streaming import jobs as sj

CLASSES = [(0, "background"), (1, "a"), (2, "b")]


def test_threshold(raster, grid_of):
    # 24 per cent of 255 is 61.2, so 61: the two cells below it are cleared, the cell at it stays.
    px = raster({1: {"label": [[3, 4, 1], [1, 2, 3]], "conf": [[60, 10, 61], [62, 254, 90]]}})
    out = cleanup.threshold_confidence(px, "label", "conf", 24)
    assert grid_of(out, "thresholded") == [[0, 0, 1], [1, 2, 3]]
    stats = cleanup.threshold_stats(px, "conf", 24).first()
    assert (stats["threshold_u8"], stats["applied"], stats["cleared_pixels"]) == (61, True, 2)


def test_threshold_is_half_even(spark):
    values = spark.createDataFrame([(30,), (70,), (50,)], "p int").select(numbers.percent_to_u8(F.col("p")).alias("u")).collect()
    assert [r["u"] for r in values] == [round(30 / 100 * 255), round(70 / 100 * 255), 128]


def test_small_blobs(raster, grid_of):
    # A bent piece of three stays, a domino and a piece that touches it only at a corner go.
    grid = [[3, 0, 0, 4], [3, 3, 0, 4], [0, 0, 7, 0]]
    out = grid_of(cleanup.remove_small_blobs(raster({1: {"label": grid}}), "label", 3), "label")
    assert out == [[3, 0, 0, 0], [3, 3, 0, 0], [0, 0, 0, 0]]


def test_small_holes(raster, grid_of):
    # A hole of two is filled when the limit is three, and left when it is two.
    px = raster({1: {"label": [[5, 5, 5, 5], [5, 0, 0, 5], [5, 5, 5, 5]]}})
    assert grid_of(cleanup.fill_small_holes(px, "label", 3), "label") == [[5] * 4] * 3
    assert grid_of(cleanup.fill_small_holes(px, "label", 2), "label")[1] == [5, 0, 0, 5]


def test_boundary_band(raster, grid_of):
    # One class above the other: the two rows that meet, and one more on each side, are cleared.
    px = raster({1: {"label": [[3] * 3] * 4 + [[6] * 3] * 3}})
    out = grid_of(cleanup.boundary_ignore_band(px, "label", 1), "label")
    assert out == [[3] * 3] * 2 + [[0] * 3] * 4 + [[6] * 3]


def test_cleanup_chain(raster, grid_of):
    # The speck in the frame's hole goes first, then the hole of two cells is filled.
    frame = [[4, 4, 4, 4], [4, 9, 0, 4], [4, 4, 4, 4]]
    out, stats = cleanup.cleanup_label_map(raster({1: {"label": frame}}), "label", min_blob_px=2, max_hole_px=4)
    assert grid_of(out, "label") == [[4] * 4] * 3
    row = stats.first()
    assert (row["removed_pixels"], row["filled_pixels"]) == (1, 2)


def test_adjacency(raster):
    # 7 meets 8 once beside and once above it, and lies on 9 with two pixels; 9 and 8 meet once on the second line.
    px = raster({1: {"seg_id": [[7, 7, 7, 8], [9, 9, 8, 8]]}})
    pairs = {(r["src"], r["dst"]): r["shared"] for r in grids.region_adjacency(px).collect()}
    assert pairs == {(7, 8): 2, (7, 9): 2, (8, 9): 1}


def test_flip_stats(raster):
    # Two of three pixels of class 1 go over to class 2, which had one.
    px = raster({1: {"raw": [[1, 1, 1, 2, 0]], "ref": [[1, 2, 2, 2, 0]]}})
    pairs = st.label_pairs(px, "raw", "ref", ["image_id"])
    total = st.flip_totals(pairs).first()
    assert (total["total_pixels"], total["flip_pixels"], total["flip_rate"]) == (5, 2, 0.4)
    per = {r["class_id"]: r for r in st.flip_stats(pairs, CLASSES).collect()}
    assert [per[c]["flipped_out_pixels"] for c in (0, 1, 2)] == [0, 2, 0]
    assert [per[c]["flipped_in_pixels"] for c in (0, 1, 2)] == [0, 0, 2]
    assert per[1]["flipped_out_rate"] == per[2]["flipped_in_rate"] == pytest.approx(2 / 3)
    assert per[0]["flipped_out_rate"] == 0.0


def test_flip_in_equals_out(raster):
    px = raster({1: {"raw": [[0, 1, 2], [2, 2, 1]], "ref": [[1, 1, 0], [2, 0, 0]]}})
    sums = st.flip_stats(st.label_pairs(px, "raw", "ref", ["image_id"]), CLASSES).agg(
        F.sum("flipped_out_pixels").alias("o"), F.sum("flipped_in_pixels").alias("i")
    ).first()
    assert sums["o"] == sums["i"]


def test_iou_is_null_when_absent(raster):
    px = raster({1: {"t": [[0, 1]], "p": [[0, 0]]}})
    iou = {r["class_id"]: r["iou"] for r in st.iou_accuracy(px, "t", "p", [0, 1, 2]).collect()}
    assert iou == {0: 0.5, 1: 0.0, 2: None}


def test_chi_square(spark):
    # All weight in one bin each: every bin gives half of one.
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 1.0], [0.0, 1.0])], "a array<double>, b array<double>")
    apart, same = [r["d"] for r in df.select(vectors.chi_square(F.col("a"), F.col("b")).alias("d")).collect()]
    assert same == 0 and apart == pytest.approx(1, rel=1e-6)


def test_similarity(spark):
    # Region 4 is five colour steps (3, 4, 0) off the seed, region 5 has its colour and another texture.
    feats = spark.createDataFrame(
        [(3, 1, [50.0, 10.0, -10.0], [1.0, 0.0]), (4, 1, [53.0, 14.0, -10.0], [1.0, 0.0]), (5, 1, [50.0, 10.0, -10.0], [0.0, 1.0])],
        "seg_id int, label int, lab array<double>, hist array<double>",
    )
    pairs = similarity.with_seed(feats, "label")

    def hit(*limits, **tests):
        return {r["seg_id"] for r in similarity.similarity_select(pairs, *limits, **tests).where("matched").collect()}

    assert hit(5.0, 0.5) == {3, 4} and hit(4.9, 0.5) == {3}
    assert hit(4.9, 0.5, texture=False) == {3, 5} and hit(4.9, 0.5, color=False) == {3, 4}
    assert hit(4.9, 0.5, color=False, texture=False) == {3, 5}


def test_roi(raster, spark):
    from maskloom.operators.relations import touched_segments

    px = raster({1: {"seg_id": [[0, 0, 1], [2, 2, 1]]}})
    rois = spark.createDataFrame([(1, 2, 3, [(0, 1), (3, 1), (5, 9)])], "image_id bigint, height int, width int, runs array<struct<start:int,len:int>>")
    cells = masks.flat_runs_to_pixels(masks.roi_runs(rois, ["image_id"], "runs", "height", "width"), ["image_id"], "width")
    assert {r["seg_id"] for r in touched_segments(cells, px, ["image_id"]).collect()} == {0, 1, 2}


def test_seeding(spark):
    from maskloom.plans.seeding import seed_masks

    poly = spark.createDataFrame([(101, 1, [1.0, 1.0, 6.0, 1.0, 6.0, 6.0, 1.0, 6.0], 8, 8)], "ann_id int, image_id bigint, polygon array<double>, height int, width int")
    px = masks.runs_to_pixels(masks.polygon_runs(poly, ["image_id"])).withColumn("class_id", F.lit(1))
    assert px.count() == 25
    images = spark.createDataFrame([(1, "img1.png")], "image_id bigint, file_name string")
    out = seed_masks(px, images, frozen=True).groupBy("path").agg(F.sum("col_len").alias("n")).collect()
    assert {(r["path"], r["n"]) for r in out} == {("img1__cid_1.png", 25), ("img1__cid_1__frozen.png", 25)}


def _edits(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "image_id bigint, seq bigint, sp_id int, class_id int, mode string")


def _final(log, frozen=None):
    return {(r["sp_id"], r["class_id"]) for r in edits.replay(edits.effective_edits(log, frozen)).collect()}


def test_edit_moves_between_classes(spark):
    assert _final(_edits(spark, [(0, 1, "add"), (0, 2, "add")])) == {(0, 2)}
    assert _final(_edits(spark, [(0, 1, "add"), (0, 2, "remove")])) == {(0, 1)}
    assert _final(_edits(spark, [(0, 1, "add"), (0, 2, "add"), (0, 0, "undo")])) == {(0, 1)}
    assert _final(_edits(spark, [(0, 1, "add"), (0, 2, "add"), (0, 0, "undo"), (0, 0, "redo")])) == {(0, 2)}


def test_undo_skips_edits_that_change_nothing(spark):
    assert _final(_edits(spark, [(0, 1, "add"), (0, 1, "add"), (0, 0, "undo")])) == set()
    assert _final(_edits(spark, [(0, 1, "add"), (1, 1, "remove"), (0, 0, "undo")])) == set()


def test_new_edit_clears_redo(spark):
    assert _final(_edits(spark, [(0, 1, "add"), (0, 0, "undo"), (1, 2, "add"), (0, 0, "redo")])) == {(1, 2)}


def test_frozen_makes_a_removal_effective(spark):
    frozen = spark.createDataFrame([(1, 0, 2)], "image_id bigint, sp_id int, class_id int")
    log = _edits(spark, [(1, 1, "add"), (0, 2, "remove"), (0, 0, "undo")])
    assert _final(log, frozen) == {(1, 1)}
    assert _final(log) == set()


def test_surviving_frozen(raster, spark):
    segs = raster({1: {"seg_id": [[0, 1], [2, 3]]}})
    frozen = raster({1: {"class_id": [[1, 2], [1, 2]]}})
    log = _edits(spark, [(0, 3, "add"), (1, 1, "remove"), (3, 2, "remove")])
    left = {(r["row"], r["col"]) for r in edits.surviving_frozen(frozen, log, segs).collect()}
    assert left == {(0, 1), (1, 0)}


def _schema(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "key int, class_id int, name string, class_order int")


def _names(spark, names):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "key int, position int, name string")


def test_schema_rename_reorder_remove(spark):
    old = _schema(spark, [(1, "road", 0), (2, "roof", 1), (3, "tree", 2)])
    renamed = class_schema.schema_diff(old, _names(spark, ["road", "house", "tree"]), "key")
    assert {(r["class_id"], r["change"]) for r in renamed.collect()} == {(1, "kept"), (2, "renamed"), (3, "kept")}
    turned = class_schema.diff_flags(class_schema.schema_diff(old, _names(spark, ["Tree", "road", "roof"]), "key"), old, "key").first()
    assert turned["reordered"] and not turned["destructive"]
    cut = class_schema.diff_flags(class_schema.schema_diff(old, _names(spark, ["road"]), "key"), old, "key").first()
    assert cut["destructive"] and cut["removed"] == 2
    more = class_schema.schema_diff(old, _names(spark, ["road", "roof", "tree", "water"]), "key")
    assert {r["class_id"] for r in more.where("change = 'added'").collect()} == {4}
    assert class_schema.diff_flags(more, old, "key").first()["append_only"]


def test_mask_migration(spark):
    files = spark.createDataFrame([("img1__cat.png",), ("img2__cat.png",), ("img2__cid_1.png",), ("img3__my_dog.png",)], "path string")
    classes = spark.createDataFrame([(1, "cat"), (2, "my dog")], "class_id int, name string")
    done = {r["path"]: (r["target"], r["action"]) for r in mask_source.migrate_masks(mask_source.mask_name_attrs(files), classes).collect()}
    assert done == {
        "img1__cat.png": ("img1__cid_1.png", "renamed"), "img2__cat.png": ("img2__cid_1.png", "removed"),
        "img3__my_dog.png": ("img3__cid_2.png", "renamed"),
    }


def test_feature_names_match_stack(raster):
    config = features.FeatureConfig(
        use_hsv=False, use_lab=False, gaussian_sigmas=(), use_sobel=False, lbp_radii=(1, 2), laws_vectors=("L5", "E5"),
        laws_window=3, tensor=("eigenvalues", "coherence", "orientation"), stats_sigmas=(0.5,), stats_parts=("mean", "min"),
    )
    names = features.feature_names(config)
    assert names[:5] == ["rgb_r", "rgb_g", "rgb_b", "lbp_p8_r1", "lbp_p8_r2"] and "laws_L5E5_w3" in names
    px = raster({1: {c: [[(r * 7 + k * 11 + i * 50) % 256 for k in range(8)] for r in range(8)] for i, c in enumerate("rgb")}})
    stack = features.feature_stack(px, config)
    assert stack.columns == ["image_id", "row", "col", *names] and stack.count() == 64
    assert stack.where(" OR ".join(f"`{n}` IS NULL" for n in names)).count() == 0


def test_grid_lines(raster):
    lines = rasters.label_grid_lines(raster({1: {"v": [[0, 1, 12], [2, 2, 655]]}}), "v").orderBy("row").collect()
    assert [r["line"] for r in lines] == ["0,1,12", "2,2,655"]


def test_queue_order(spark):
    rows = [(1, "slic_warmup", "queued", 10), (2, "training", "queued", 30), (3, "analysis", "queued", 20), (4, "training", "running", 1)]
    jobs = spark.createDataFrame(rows, "job_id int, job_type string, status string, priority int").withColumn("created_on", F.lit("2024-01-01"))
    placed = {r["job_id"]: r["position"] for r in listings.queue_positions(jobs).collect()}
    assert placed == {3: 1, 2: 2, 1: 3}


def test_cancel(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "completed"), (4, "queued")], "job_id int, status string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    out = {r["job_id"]: (r["status"], r["cancel_requested"]) for r in sj.cancel(jobs, asked).collect()}
    assert out == {1: ("canceled", True), 2: ("running", True), 3: ("completed", False), 4: ("queued", False)}


def test_progress_text(spark):
    lines = ["Sampling image 3/10 (train): a.png", "Analyzing image 7/31: b.png", "Training complete.", "hello"]
    df = spark.createDataFrame([(x,) for x in lines], "message string")
    out = [(r["stage"], r["progress"], r["counter"]) for r in sj.progress(df).collect()]
    assert out[0][0] == "sampling_pixels" and abs(out[0][1] - (0.22 + 0.42 * 0.3)) < 1e-12
    assert out[1][2] == "7/31 images" and out[2] == ("training_complete", 0.98, None) and out[3] == ("running", None, None)


def test_terminal_state_sticks(spark):
    rows = [(1, 1, "running"), (2, 1, "failed"), (3, 1, "running"), (4, 2, "queued"), (5, 2, "running")]
    df = spark.createDataFrame(rows, "event_id int, job_id int, status string").withColumns({"ts": F.timestamp_seconds("event_id"), "message": F.lit("")})
    assert {(r["job_id"], r["status"]) for r in sj.job_state(df).collect()} == {(1, "failed"), (2, "running")}


def test_dedupe_key_ignores_order(spark):
    df = spark.createDataFrame([(["b", " a "],), (["a", "b", " "],)], "images array<string>")
    keys = df.select(hashing.analysis_dedupe_key(F.lit(1), F.lit(2), F.col("images"), F.lit("{}")).alias("k")).collect()
    import hashlib

    want = hashing.canonical_json({"kind": "analysis", "workspace_id": 1, "model_id": 2, "input_images": ["a", "b"], "postprocess_config": {}})
    assert keys[0]["k"] == keys[1]["k"] == hashlib.sha256(want.encode()).hexdigest()


def test_text_helpers(spark):
    df = spark.createDataFrame([("  My Model (v2)! ",), ("***",)], "t string")
    assert [r["s"] for r in df.select(strings.slugify(F.col("t")).alias("s")).collect()] == ["my_model_v2", "model"]
    row = spark.range(1).select(
        strings.sanitize_class_name(F.lit(" a b/c.é ")).alias("name"), strings.stem(F.lit("x/y.tar.png")).alias("stem"),
        strings.metric_text(F.lit(1234567.0)).alias("m"), strings.metric_text(F.lit(0.5)).alias("h"),
        times.human_datetime(F.lit("2024-01-05T15:07:00+00:00")).alias("d"), times.human_datetime(F.lit("")).alias("e"),
    ).first()
    assert tuple(row) == ("a_b_c.é", "y.tar", "1,234,567", "0.5", "Jan 05, 2024 03:07 PM UTC", "-")


def test_flatten_nested(spark):
    docs = spark.sql("""SELECT 1 AS id, parse_json('{"b":{"x":1.5,"y":{"z":[1,2]}},"a":true}') AS p""")
    out = {(r["path"], r["value"]) for r in configs.flatten_config(docs, "id", "p").collect()}
    assert out == {("a", "true"), ("b.x", "1.5"), ("b.y.z", "[1,2]")}


def test_accepted_jobs_with_one_hot_key_over_many_files_and_triggers(spark, tmp_path):
    log = str(tmp_path / "log")
    events = spark.range(60_000).selectExpr(
        "id AS event_id", "IF(id % 100 = 99, concat('key-', id % 7), 'hot') AS dedupe_key",
        "CASE WHEN id % 5 = 3 THEN 'running' WHEN id % 3 = 0 THEN 'failed' ELSE 'queued' END AS status",
    )
    for at in range(3):
        events.where(f"event_id DIV 20000 = {at}").repartition(8).write.mode("append").parquet(log)
    stream = sj.read_log(spark, log, "*.parquet", events.schema, 8)
    out = str(tmp_path / "out")
    sj.run_accepted(stream, out, str(tmp_path / "active"), str(tmp_path / "state"))
    active, wanted = set(), set()
    for row in sorted(events.collect(), key=lambda r: r["event_id"]):
        if row["status"] == "queued" and row["dedupe_key"] not in active:
            active.add(row["dedupe_key"])
            wanted.add((row["dedupe_key"], row["event_id"]))
        elif row["status"] == "failed":
            active.discard(row["dedupe_key"])
    got = spark.read.parquet(out).select("dedupe_key", "event_id").collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
