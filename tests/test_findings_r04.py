"""Findings of round 4: tables as folders, size estimates, work that stays where it lies, whole jobs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from maskloom.operators import line_runs as lr
from maskloom.operators import masks as mk
from maskloom.operators import relations as rel
from maskloom.sources import coco
from maskloom.streaming import jobs as sj
from workload.tables import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_log_may_be_a_file_or_a_folder(spark, tmp_path):
    schema = "event_id long"
    rows = spark.range(40).withColumnRenamed("id", "event_id")
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows.repartition(2).write.parquet(f"{tmp_path}/others.parquet")
    (tmp_path / "flat").mkdir()
    rows.toPandas().to_parquet(tmp_path / "flat" / "events.parquet")
    rows.toPandas().to_parquet(tmp_path / "flat" / "others.parquet")
    for folder in (tmp_path, tmp_path / "flat"):
        out = f"{folder}/out"
        sj.run_available(sj.read_log(spark, str(folder), "events.parquet", schema), out, f"{folder}/state")
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_arrivals_from_a_folder_of_parts(spark, tmp_path):
    import __spark_entry__ as entry

    docs = spark.range(30).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.file_name: r.path for r in entry.queries()["stream_image_arrivals"](spark, str(tmp_path)).collect()}
    want = {}
    for d in range(30):
        if d % 6 < 4:
            name = f"up_{d // 2}.png"
            want[name] = min(want.get(name, "~"), f"/in/{d}/{name}")
    assert got == want


def test_rectangles_are_not_broadcast(spark, raster):
    px = raster({i: {"seg_id": [[(r // 3) * 5 + c // 4 for c in range(20)] for r in range(40)]} for i in (1, 2)})
    rects = spark.range(60).selectExpr(
        "id AS rect_id", "1 + id % 3 AS image_id", "cast(id % 9 AS int) AS xa", "cast(id % 9 + id % 7 AS int) AS xb",
        "cast(id * 5 % 37 AS int) AS ya", "cast(least(39, id * 5 % 37 + id % 20) AS int) AS yb",
    )
    hits = rel.marquee_intersects(rects, px)
    assert "Broadcast" not in plan_of(hits)
    want = {
        (k.rect_id, k.image_id, (r // 3) * 5 + c // 4) for k in rects.collect() if k.image_id < 3
        for r in range(k.ya, k.yb + 1) for c in range(k.xa, k.xb + 1)
    }
    got = hits.collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_documents_are_parsed_once(spark, tmp_path):
    doc = '{"images":[{"id":1,"width":4,"height":4}],"annotations":[{"id":"a","image_id":1,"category_id":7,"segmentation":[[0,0,2,0,2,2]]}],"categories":[{"id":7}]}'
    spark.createDataFrame([("s", doc), ("e", '{"images":[],"annotations":[],"categories":[]}')], "source_id string, doc string").write.parquet(f"{tmp_path}/docs")
    parsed = coco.parse_documents(spark.read.parquet(f"{tmp_path}/docs"))
    for rows in (coco.coco_images(parsed), coco.coco_annotations(parsed), coco.coco_categories(parsed)):
        assert plan_of(rows).count("from_json") == 1 and rows.count() == 1
    records = coco.annotation_rle(coco.coco_annotations(parsed)).where("text IS NOT NULL")
    assert plan_of(records).count("from_json") == 3  # the document, and a record in its two forms


def test_painting_sends_whole_masks_once(spark, monkeypatch):
    rnd, height, width = random.Random(9), 150, 23
    boxes = [
        (rnd.choice([1, 2]), k, rnd.choice([None, 3, 4]), x, y, x + rnd.randrange(1, 9), y + rnd.randrange(1, 100))
        for k in range(80) for x, y in [(rnd.randrange(-2, width), rnd.randrange(-5, height))]
    ]
    df = spark.createDataFrame(boxes, "image_id long, order_idx int, class_id int, x1 int, y1 int, x2 int, y2 int").withColumn(
        "outlines", F.expr("array(cast(array(x1, y1, x2, y1, x2, y2, x1, y2) AS array<double>))")
    )
    ranked = mk.paint_order(df, "last_annotation_wins", ["order_idx"])
    monkeypatch.setattr(lr, "PLACES", 40)
    runs = lr.painted_runs(mk.outline_runs(ranked, ["image_id", "class_id", "paint_rank"], height=height, width=width, whole=True), "class_id", "paint_rank")
    assert plan_of(runs).count("Exchange") == 1
    want = {}
    for image, _, label, x1, y1, x2, y2 in boxes:
        want |= {(image, r, c): label for r in range(max(y1, 0), min(y2, height)) for c in range(max(x1, 0), min(x2, width))}
    rows = runs.collect()
    assert {(r.image_id, r.row, c): r.class_id for r in rows for c in range(r.col_start, r.col_start + r.col_len)} == want
    ends = sorted((r.image_id, r.row, r.col_start, r.col_start + r.col_len, str(r.class_id)) for r in rows)
    assert all(a[:2] != b[:2] or a[3] < b[2] or (a[3] == b[2] and a[4] != b[4]) for a, b in zip(ends, ends[1:]))


def test_records_are_turned_where_they_lie(spark, monkeypatch):
    rnd, records = random.Random(3), []
    for k in range(60):
        height, width = rnd.randrange(1, 90), rnd.randrange(1, 7)
        counts, left = [], height * width
        while left:
            counts.append(min(left, rnd.randrange(0, 40)))
            left -= counts[-1]
        records.append((k, height, counts))
    records.append((60, None, [1, 2]))
    df = spark.createDataFrame(records, "k int, height int, counts array<bigint>")
    for at_once in (mk.TURNED_AT_ONCE, 30):
        monkeypatch.setattr(mk, "TURNED_AT_ONCE", at_once)
        got = set()
        lists = mk._turned(pa.array([r[2] for r in records], pa.list_(pa.int64())), pa.array([r[1] for r in records], pa.int64()))
        for k, strips in enumerate(lists.to_pylist()):
            for s in strips:
                for row, a, b in zip(s["lines"][::3], s["lines"][1::3], s["lines"][2::3]):
                    assert row // mk.STRIP == s["strip"]
                    got |= {(k, row, c) for c in range(a, b)}
        want = set()
        for k, height, counts in records[:-1]:
            at = 0
            for i, n in enumerate(counts):
                want |= {(k, p % height, p // height) for p in range(at, at + n)} if i % 2 else set()
                at += n
        assert got == want
    assert "Exchange" not in plan_of(mk.record_runs(df, ["k"])) and mk.record_runs(df, ["k"]).count() > 0


def test_tiles_give_what_the_line_passes_give(spark, monkeypatch):
    from maskloom.operators import features as ft
    from maskloom.operators import stencils

    rnd = random.Random(1)
    # Images 1 and 2 are full rectangles, 3 lacks a line.
    sizes = {1: (37, 21), 2: (5, 40), 3: (9, 9)}
    places = [(i, r, c) for i, (h, w) in sizes.items() for r in range(h) for c in range(w) if (i, r) != (3, 4)]
    px = spark.createDataFrame([(*p, *[rnd.randrange(256) for _ in "rgb"], "x") for p in places], "image_id long, row int, col int, r int, g int, b int, tag string")
    config = ft.FeatureConfig(
        gaussian_sigmas=(1.0,), lbp_radii=(1, 2), gabor_frequencies=(0.25,), gabor_thetas=(0.0,), laws_vectors=("L5", "E5"), laws_window=5,
        tensor=("coherence", "orientation"), tensor_rho=1.0, stats_sigmas=(1.0,), stats_parts=("mean", "std", "min"),
    )
    monkeypatch.setattr(stencils, "TILE_SIDE", 8)
    stack = ft.feature_stack(px, config, ["tag"])
    names = stack.columns
    got = sorted(map(tuple, stack.collect()))
    want = sorted(map(tuple, ft._stack_by_lines(px, config, ["tag"]).collect()))
    assert len(got) == len(want) == len(places)
    for a, b in zip(got, want):
        assert a[:4] == b[:4]
        assert all(x == y or abs(x - y) < 1e-6 for x, y in zip(a[4:], b[4:])), (names, a, b)


def test_pixels_dealt_by_image_are_filtered_without_a_shuffle(spark, tmp_path):
    from maskloom.operators import features as ft

    spark.range(1, 30).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    config = ft.FeatureConfig(tensor=("coherence",), laws_vectors=("L5", "E5"))
    plan = plan_of(ft.feature_stack(Tables(spark, str(tmp_path)).px, config))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


class Stop(Exception):
    pass


def test_models_are_trained_whole(spark, tmp_path, monkeypatch):
    from workload import models

    spark.range(1, 6).selectExpr("id AS s_suppkey", "id AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []

    def train(rows, names, classes, config):
        seen.append((names, config.trees, config.depth))
        raise Stop

    monkeypatch.setattr(models.fr, "train_forest", train)
    for job in (models._persist, models._analysis):
        try:
            job(Tables(spark, str(tmp_path)))
        except Stop:
            pass
    whole = models.ft.feature_names(models.ft.FeatureConfig())
    assert "sobel_gray" in whole and seen == [(whole, 200, 30)] * 2


def test_superpixels_run_all_rounds(spark, monkeypatch):
    from workload import regions

    seen = []
    monkeypatch.setattr(regions.sp, "superpixels", lambda px, channels, images, **settings: seen.append(settings))
    regions._superpixels(type("T", (), {"px": None, "images": None}))
    assert seen[0].get("rounds", 5) >= 10 and "area" not in seen[0]
