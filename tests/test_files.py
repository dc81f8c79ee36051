"""Real files in and out."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from maskloom.operators import forest
from maskloom.sinks import coco as coco_sink
from maskloom.sources import coco, images
from maskloom.sources import masks as mask_source


def png(path, rows, color):
    """A minimal PNG: color 0 gray, 2 RGB, 6 RGBA."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    depth = {0: 1, 2: 3, 6: 4}[color]
    raw = b"".join(b"\0" + bytes(v for px in row for v in (px if depth > 1 else [px])) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, color, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def folder(tmp_path):
    png(tmp_path / "b.PNG", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)]], 2)
    png(tmp_path / "a.png", [[9, 0, 255]], 0)
    png(tmp_path / "c.png", [[(10, 20, 30, 0)]], 6)
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_listing(spark, folder):
    files = images.scan_images(images.list_files(spark, str(folder)))
    assert sorted(r["file_name"] for r in files.collect()) == ["a.png", "b.PNG", "c.png"]


def test_pixels(spark, folder):
    px = images.image_to_pixels(images.read_images(spark, str(folder)).withColumn("name", F.element_at(F.split("path", "/"), -1)), ["name"])
    got = {(r["name"], r["row"], r["col"]): (r["r"], r["g"], r["b"]) for r in px.collect()}
    assert got["b.PNG", 0, 1] == (4, 5, 6) and got["b.PNG", 1, 1] == (250, 251, 252)
    assert got["a.png", 0, 2] == (255, 255, 255) and got["c.png", 0, 0] == (10, 20, 30)
    assert len(got) == 4 + 3 + 1


def test_registry(spark, folder):
    import hashlib

    rows = {r["file_name"]: r for r in images.read_image_registry(spark, str(folder)).collect()}
    assert (rows["b.PNG"]["width"], rows["b.PNG"]["height"]) == (2, 2)
    assert rows["a.png"]["sha256"] == hashlib.sha256((folder / "a.png").read_bytes()).hexdigest()


def test_document_shapes(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.png", "width": 8, "height": 8}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 7, "segmentation": [[1, 1, 6, 1, 6, 6, 1, 6]], "area": 25},
            {"id": 2, "image_id": 1, "category_id": 7, "segmentation": [0, 0, 2, 0, 2, 2, 0, 2]},
            {"id": 3, "image_id": 1, "category_id": 9, "segmentation": {"size": [8, 8], "counts": [0, 64]}},
            {"id": 4, "image_id": 1, "category_id": 9, "segmentation": {"size": [8, 8], "counts": "0P2"}},
            {"id": 5, "image_id": 1, "category_id": 5, "segmentation": None},
        ],
        "categories": [{"id": 7, "name": "roof"}, {"id": 9}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    parsed = coco.parse_documents(coco.read_documents(spark, str(tmp_path)))
    cats = {r["category_id"]: (r["name"], r["class_index"]) for r in coco.coco_categories(parsed).collect()}
    assert cats == {7: ("roof", 1), 9: ("category_9", 2)}
    ann = coco.coco_annotations(parsed)
    kinds = {r["ann_id"]: r["k"] for r in ann.select("ann_id", coco.segmentation_kind(F.col("segmentation")).alias("k")).collect()}
    assert [kinds[str(i)] for i in (1, 2, 3, 4)] == ["polygons", "polygon", "rle", "rle"]
    assert coco.annotation_polygons(ann).count() == 2
    rle = {r["ann_id"]: (r["counts"], r["text"]) for r in coco.annotation_rle(ann).collect()}
    assert rle == {"3": ([0, 64], None), "4": (None, "0P2")}
    assert coco.annotation_classes(ann, coco.coco_categories(parsed)).count() == 4


def test_document_without_arrays_is_an_error(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"images": []}')
    with pytest.raises(Exception, match="lacks one of its three arrays"):
        coco.coco_images(coco.parse_documents(coco.read_documents(spark, str(tmp_path)))).collect()


def test_duplicate_categories(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "source_id string, category_id int")
    with pytest.raises(ValueError, match="duplicate"):
        coco.require_empty(coco.duplicate_categories(rows), "duplicate category id")


def test_plain_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text("0,1,12\n2,2,655\n")
    cells = {(r["row"], r["col"]): r["class_id"] for r in mask_source.read_plain_grid(spark, str(tmp_path)).collect()}
    assert cells == {(0, 0): 0, (0, 1): 1, (0, 2): 12, (1, 0): 2, (1, 1): 2, (1, 2): 655}


def test_export_filters_small_masks_and_keeps_empty_images(spark, tmp_path):
    px = spark.createDataFrame([(1, 1, r, c) for r in range(2) for c in range(3)] + [(1, 2, 3, 3)], "image_id bigint, class_id int, row int, col int")
    imgs = spark.createDataFrame([(1, "z.png", 4, 4), (2, "a.png", 4, 4)], "image_id bigint, file_name string, height int, width int")
    classes = spark.createDataFrame([(1, 0), (2, 1)], "class_id int, class_order int")
    rows = coco_sink.export_annotations(px, imgs, classes, min_area=5).collect()
    assert len(rows) == 1 and rows[0]["bbox"] == [0.0, 0.0, 3.0, 2.0] and rows[0]["area"] == 6.0 and rows[0]["annotation_id"] == 1
    listed = {r["file_name"]: r["export_id"] for r in coco_sink.export_images(imgs).collect()}
    assert listed == {"a.png": 1, "z.png": 2}


def test_probabilities_align_to_the_class_list(spark):
    rows = [(float(i % 2) + i * 0.001, 10 if i % 2 else 30) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, class_id int")
    model = forest.train_forest(df, ["x"], [10, 20, 30], forest.ForestConfig(trees=3, max_depth=3))
    scored = forest.argmax_confidence(forest.predict(model, df, [10, 20, 30]), [10, 20, 30])
    for r in scored.collect():
        assert len(r["proba"]) == 3 and abs(sum(r["proba"]) - 1) < 1e-9 and r["proba"][1] == 0
        assert r["label"] == r["class_id"]


def test_families():
    with pytest.raises(KeyError):
        forest.family("nope")
    with pytest.raises(ValueError):
        forest.register_family("forest", forest.ForestFamily())
