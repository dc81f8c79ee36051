"""What keeps queries from growing faster than their tables: size estimates, task shares, records that stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import line_runs as lr
from maskloom.operators import masks as mk
from workload.tables import ANNOTATIONS_A_TASK, IMAGES_A_TASK, SIDE, Tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 20 * IMAGES_A_TASK).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(12 * ANNOTATIONS_A_TASK).selectExpr(
        "id AS l_orderkey", "cast(id % 3 AS int) AS l_linenumber", "id AS l_partkey", "id % 50 AS l_suppkey", "1D AS l_quantity"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_estimated_as_pixels(tables):
    rows = 20 * IMAGES_A_TASK * SIDE * SIDE
    assert tables.px._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 8 * rows


def test_pixels_are_not_broadcast(tables):
    at = tables.px.select("image_id", "row", "col", "seg_id")
    regions = mk.touched_regions(tables.px.where("pred_raw > 0").select("image_id", "row", "col"), at, ["image_id"])
    assert "BroadcastHashJoin" not in plan_of(regions) and "SortMergeJoin" in plan_of(regions)


def test_tasks_follow_the_rows(tables):
    assert tables.px.rdd.getNumPartitions() >= 20
    assert tables.polygons.rdd.getNumPartitions() >= 12 and tables.counts.rdd.getNumPartitions() >= 12


def test_records_are_decoded_whole(spark):
    records = [(1, [0, 5, 1019]), (2, [3, 1, 40, 1, 979]), (3, [1024]), (None, [1, 2, 1021]), (4, [5, 100000, 7, 2, 9, 1])]
    df = spark.createDataFrame(records, "id int, counts array<bigint>")
    text = df.select("id", mk.compress_counts(F.col("counts")).alias("text")).unionAll(
        spark.createDataFrame([(5, None), (6, "")], "id int, text string")
    )
    back = mk.decompress_counts(text, ["id"], "text")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(records, key=str)
    assert "Window" not in plan_of(back) and "Generate" not in plan_of(back)


def written(values):
    """A record by plain Python."""
    out = ""
    for i, v in enumerate(values):
        before = values[i - 2] if i > 2 else 0
        if v is None or before is None:
            continue
        x = v - before
        while True:
            group, x = x & 31, x >> 5
            more = not ((x == 0 and not group & 16) or (x == -1 and group & 16))
            out += chr(group + 32 * more + 48)
            if not more:
                break
    return out


def test_absent_counts_write_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 31, 4, 5, -20])], "id int, counts array<bigint>")
    assert [r.t for r in df.select("id", mk.compress_counts(F.col("counts")).alias("t")).orderBy("id").collect()] == [None, "", written([1, None, 31, 4, 5, -20])]


def inside(outlines, row, col):
    """Even-odd test of a pixel's place against all outlines of a mask."""
    odd = False
    for o in outlines:
        points = list(zip(o[::2], o[1::2]))
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
            if y1 != y2 and min(y1, y2) <= row < max(y1, y2) and x1 + (row - y1) * (x2 - x1) / (y2 - y1) <= col:
                odd = not odd
    return odd


def test_outlines_are_converted_where_they_lie(spark):
    rnd = random.Random(2)
    masks = {k: [[rnd.choice([rnd.randrange(-3, 15), rnd.uniform(-3, 15)]) * 1.0 for _ in range(2 * rnd.randrange(3, 6))] for _ in range(rnd.randrange(1, 4))] for k in range(40)}
    want = {(k, r, c) for k, outlines in masks.items() for r in range(12) for c in range(10) if inside(outlines, r, c)}
    whole = spark.createDataFrame(list(masks.items()), "id int, outlines array<array<double>>")
    runs = mk.outline_runs(whole, ["id"], height=12, width=10)
    assert set(map(tuple, mk.runs_to_pixels(runs).select("id", "row", "col").collect())) == want
    assert "Exchange" not in plan_of(runs)
    apart = whole.select("id", F.explode("outlines").alias("polygon")).repartition(5)
    runs = mk.polygon_runs(apart, ["id"], height=12, width=10)
    assert set(map(tuple, mk.runs_to_pixels(runs).select("id", "row", "col").collect())) == want
    # What is exchanged is outlines: once, before they are converted.
    assert plan_of(runs.select("id")).index("ArrowEvalPython") < plan_of(runs.select("id")).index("hashpartitioning(id")


@pytest.mark.parametrize("action,min_area", [("skip", 3), ("trim", 1), ("trim", 7), ("allow", 4)])
def test_merging_takes_one_shuffle_of_runs(spark, monkeypatch, action, min_area):
    rnd = random.Random(4)
    rows = [
        (rnd.choice([None, 1, 2, 2]) if r % 9 else 3, r, y + k, rnd.randrange(-2, 12), rnd.randrange(1, 6))
        for r in range(90) for y in [rnd.randrange(9)] for k in range(rnd.randrange(1, 4))
    ]
    image = {r[1]: r[0] for r in rows}
    runs = spark.createDataFrame([(image[r[1]], *r[1:]) for r in rows], "image_id bigint, rank bigint, row int, col_start int, col_len int")
    owned, verdicts = lr.merge_overlap_runs(runs, action, min_area)
    assert plan_of(owned).count("Exchange") == plan_of(verdicts).count("Exchange") == 1
    monkeypatch.setattr(lr, "RUNS_IN_TURN", 25)  # the largest images in rounds, the others in turn
    other = lr.merge_overlap_runs(runs, action, min_area)
    for a, b in zip((owned, verdicts), other):
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_painting_hides_what_lies_under(spark):
    rnd = random.Random(6)
    held = [(rnd.randrange(-5, 30), rnd.randrange(1, 12), rank, rnd.randrange(1, 4)) for rank in range(60)]
    df = spark.createDataFrame([(1, 0, *h) for h in held], "image_id bigint, row int, col_start int, col_len int, rank bigint, label int")
    want = {}
    for start, length, rank, label in held:
        want |= {c: label for c in range(start, start + length)}
    runs = lr.painted_runs(df, "label", "rank").collect()
    assert {c: r.label for r in runs for c in range(r.col_start, r.col_start + r.col_len)} == want
    ends = sorted((r.col_start, r.col_start + r.col_len, r.label) for r in runs)
    assert all(a[1] < b[0] or (a[1] == b[0] and a[2] != b[2]) for a, b in zip(ends, ends[1:]))
