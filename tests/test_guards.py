"""Inputs that must fail instead of giving a wrong answer, and names of files."""

import json

import pytest

from maskloom.operators import datasets, listings
from maskloom.sources import coco

IMAGES = "dataset_index int, pos int, image_id bigint, file_name string, height int, width int"


def test_two_sizes_fail_the_merge(spark):
    rows = [(0, 0, 1, "a.png", 4, 5), (1, 0, 7, "a.png", 4, 5), (1, 1, 8, "b.png", 9, 9)]
    merged = datasets.merge_images(spark.createDataFrame(rows, IMAGES)).collect()
    assert sorted((r["image_id"], r["merged_image_id"]) for r in merged) == [(1, 1), (7, 1), (8, 2)]
    with pytest.raises(Exception, match="two sizes: a.png"):
        datasets.merge_images(spark.createDataFrame([*rows, (2, 0, 9, "a.png", 5, 4)], IMAGES)).collect()


def test_a_category_twice_is_an_error(spark):
    def categories(ids):
        doc = json.dumps({"images": [], "annotations": [], "categories": [{"id": i, "name": str(i)} for i in ids]})
        return coco.coco_categories(coco.parse_documents(spark.createDataFrame([("s", doc)], "source_id string, doc string")))

    assert [r["class_index"] for r in categories([4, 9]).collect()] == [1, 2]
    with pytest.raises(Exception, match="category id twice"):
        categories([4, 9, 4]).collect()


def test_file_names(spark):
    held = spark.createDataFrame([(1, n) for n in ("A.PNG", "a_1.png", "a_3.png", "a_02.png", "b", "b_1", "c.x.png")], "scope int, name string")
    asked = spark.createDataFrame([(1, n) for n in ("a.png", "A.png", "b", "c.x.png", "new.png")] + [(2, "a.png")], "scope int, name string")
    got = {(r["scope"], r["name"]): r["unique_name"] for r in listings.unique_files(asked, held).collect()}
    assert got == {
        (1, "a.png"): "a_2.png", (1, "A.png"): "A_2.png", (1, "b"): "b_2", (1, "c.x.png"): "c.x_1.png", (1, "new.png"): "new.png", (2, "a.png"): "a.png",
    }
